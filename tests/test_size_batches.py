"""Batches by one sort of the tiles."""

from slidemill.operators import tiles


def test_batches_sort_once(spark):
    r = spark.createDataFrame([(s, i, 3 * i, 5 * i, 40 + 9 * i, 70 - 6 * i, 100, 90) for i in range(6) for s in (0, 1)], "slide_ord int, roi_index long, x long, y long, w long, h long, sw long, sh long")
    t = tiles.with_windows(tiles.plan_tiles(tiles.dealt(r, 2), 16, 12), 16, 12, 24)
    got = tiles.with_batches(t, 3)
    assert got._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    want, places = {}, {}
    for x in sorted(t.collect(), key=lambda x: (x.slide_ord, x.roi_index, x.win_key, x.tile_ord)):
        n = places[w] = places.get(w := (x.slide_ord, x.roi_index, x.win_key), -1) + 1
        want.setdefault((*w, n // 3), []).append(x.tile_ord)
    number = {k: sum(o[0] == k[0] and o < k for o in want) for k in want}
    assert {(b.slide_ord, b.roi_index, b.win_key, b.tile_ord): b.batch_ord for b in got.collect()} == {(*k[:3], t): number[k] for k, ts in want.items() for t in ts}
