import pytest
from pyspark.sql import functions as F

from slidemill.operators import audit
from slidemill.operators.audit import Knob


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(0, i, m) for i, m in enumerate((0.12, 0.47, 0.58, 0.83, 0.91))], "slide_ord int, x int, m double").withColumn("n", F.lit(None).cast("double"))


@pytest.mark.parametrize("threshold,kept", [(-1.0, 5), (0.12, 5), (0.3, 4), (0.58, 3), (0.85, 1), (2.0, 0)])
def test_thresholds(rows, threshold, kept):
    f = {r.stage: r for r in audit.funnel(rows, [Knob("f", "m", ">=", threshold)]).collect()}
    assert (f["f"].n_in, f["f"].n_out, f["f"].dropped) == (5, kept, 5 - kept) and f["source"].n_out == 5


def test_missing_metric(rows):
    assert audit.resolve(rows, [Knob("f", "n", ">=", 1)]).filter("dropped_by is null").count() == 5
    assert audit.resolve(rows, [Knob("f", "n", ">=", 1, missing="unknown")]).filter("dropped_by = 'f'").count() == 5


def test_order_owns_drops(rows):
    knobs = [Knob("low", "m", ">=", 0.5), Knob("high", "m", "<=", 0.45)]
    owners = lambda k: {r.x: r.dropped_by for r in audit.resolve(rows, k).collect()}
    assert owners(knobs) == {0: "low", 1: "low", 2: "high", 3: "high", 4: "high"}
    assert owners(audit.tuned(knobs, order=["high", "low"])) == {0: "low", 1: "high", 2: "high", 3: "high", 4: "high"}
    assert {r.x: r.seen for r in audit.reached(rows, knobs).collect()} == {0: ["low"], 1: ["low"], **{i: ["low", "high"] for i in (2, 3, 4)}}
    with pytest.raises(KeyError):
        audit.tuned(knobs, {"c": 1})
    with pytest.raises(ValueError):
        Knob("a", "m", "=", 1)


def test_slider(rows):
    low, high, step = audit.slider_range(rows, Knob("f", "m", ">=", 1.3))
    assert low <= 0.12 and high >= 1.3 and step == pytest.approx(0.01)
    assert audit.slider_range(rows, Knob("f", "x", ">=", 1, integer=True)) == (0.0, 4.0, 1.0)
    assert audit.slider_range(rows.limit(0), Knob("f", "m", ">=", 0.25)) == (0.0, 1.0, 0.01)
    low, high, step = audit.slider_range(rows.filter("x = 0"), Knob("f", "m", ">=", 0.12))
    assert low <= 0.12 < high and step > 0
    assert "f" in audit.text_table(audit.funnel(rows, [Knob("f", "m", ">=", 0.2)]).collect())
