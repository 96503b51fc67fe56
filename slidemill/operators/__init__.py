"""DataFrame operators of the patch pipeline."""
