"""slidemill: patch datasets from very large pyramidal images, as Spark DataFrame plans."""

__version__ = "0.1.0"
