"""Keep and drop accounting: which stage owns each drop, funnels, and what other thresholds would have done.

A pipeline's filters are Knobs over metric columns. All metrics stay on one wide row, so any thresholds, order
or choice of stages is one pass over it, without running anything again.
"""

from __future__ import annotations

from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = {">=": Column.__ge__, "<=": Column.__le__, ">": Column.__gt__, "<": Column.__lt__}


@dataclass(frozen=True)
class Knob:
    """A stage that keeps rows with `column op value`. permissive: the value that keeps all."""

    stage: str
    column: str
    op: str
    value: float
    permissive: float = 0.0
    integer: bool = False
    missing: str = "kept"

    def __post_init__(self):
        if self.op not in OPS:
            raise ValueError(f"unknown op {self.op!r}; one of {tuple(OPS)}")
        if self.missing not in ("kept", "unknown"):
            raise ValueError("missing must be 'kept' or 'unknown'")

    def fails(self) -> Column:
        """If a row is dropped; a missing metric keeps it, or drops it as unknown."""
        return F.coalesce(~OPS[self.op](F.col(self.column), F.lit(self.value)), F.lit(self.missing == "unknown"))


def labelled(knobs: Sequence[Knob]) -> list[Knob]:
    """The knobs with stage names that are theirs alone: the second of a name is name#2, the third name#3."""
    seen: dict[str, int] = {}
    out = []
    for k in knobs:
        seen[k.stage] = n = seen.get(k.stage, 0) + 1
        out.append(replace(k, stage=f"{k.stage}#{n}") if n > 1 else k)
    return out


def tuned(knobs: Sequence[Knob], values: dict[str, float] | None = None, order: Sequence[str] | None = None, off: Sequence[str] = ()) -> list[Knob]:
    """The knobs, as labelled() names them, with other values by stage, in another order, without those switched off. Each place of the run is a knob of its own, also where two stages have one name."""
    by = {k.stage: replace(k, value=(values or {}).get(k.stage, k.value)) for k in labelled(knobs)}
    if unknown := [s for s in [*(values or {}), *(order or ()), *off] if s not in by]:
        raise KeyError(f"no such stages: {unknown}")
    return [by[s] for s in (order or by) if s not in off]


def resolve(rows: DataFrame, knobs: Sequence[Knob]) -> DataFrame:
    """rows with dropped_by, the first stage whose test fails (null: kept), and its number dropped_at."""
    stage, at = F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, k in reversed(list(enumerate(knobs, 1))):
        stage, at = F.when(k.fails(), k.stage).otherwise(stage), F.when(k.fails(), i).otherwise(at)
    return rows.withColumns({"dropped_by": stage, "dropped_at": at})


def funnel(rows: DataFrame, knobs: Sequence[Knob], by: Sequence[str] = ("slide_ord",), source: str = "source") -> DataFrame:
    """by, stage_ord, stage, n_in, n_out, dropped: one aggregate over the rows. The source has as many in as out; a stage that drops a whole slide has a row with 0 out."""
    drops = [F.count_if(F.col("dropped_at") == i).alias(f"d{i}") for i in range(1, len(knobs) + 1)]
    counts = resolve(rows, knobs).groupBy(*by).agg(F.count("*").alias("total"), *drops)
    entry = lambda i, name, before, d: F.struct(F.lit(i).alias("stage_ord"), F.lit(name).alias("stage"), before.alias("n_in"), (before - d).alias("n_out"), d.alias("dropped"))
    left, out = F.col("total"), [entry(0, source, F.col("total"), F.lit(0).cast("long"))]
    for i, k in enumerate(knobs, 1):
        out.append(entry(i, k.stage, left, F.col(f"d{i}")))
        left = left - F.col(f"d{i}")
    return counts.select(*by, F.explode(F.array(*out)).alias("f")).select(*by, "f.*")


def reached(rows: DataFrame, knobs: Sequence[Knob]) -> DataFrame:
    """rows with seen: the stages that each row came to, in order."""
    names = F.array(*[F.lit(k.stage) for k in knobs])
    return resolve(rows, knobs).withColumn("seen", F.slice(names, 1, F.coalesce("dropped_at", F.lit(len(knobs)))))


def slider_range(rows: DataFrame, knob: Knob) -> tuple[float, float, float]:
    """Low, high and step of a slider that reaches every observed value of the metric and the knob's own.

    An integer knob steps by one; any other by the power of ten that gives 100 to 1,000 positions. Both ends are
    multiples of the step. A slider has one step at least, and stands for the unit interval where nothing was observed.
    """
    seen = rows.agg(F.min(knob.column).alias("low"), F.max(knob.column).alias("high")).first()
    values = [Decimal(repr(float(v))) for v in (knob.value, *(seen if seen["low"] is not None else (0, 1)))]
    low, high = min(values), max(values)
    step = Decimal(1) if knob.integer else Decimal(1).scaleb(((high - low) or Decimal(1)).adjusted() - 2)
    low = (low / step).to_integral_value(ROUND_FLOOR) * step
    high = (high / step).to_integral_value(ROUND_CEILING) * step
    return float(low), float(max(high, low + step)), float(step)


def text_table(funnel_rows: Sequence) -> str:
    """A funnel's rows as text, with what each stage dropped in per cent."""
    lines = [f"{'stage':<28}{'in':>10}{'out':>10}{'dropped':>10}{'%':>8}"]
    for r in sorted(funnel_rows, key=lambda r: r["stage_ord"]):
        lines.append(f"{r['stage']:<28}{r['n_in']:>10}{r['n_out']:>10}{r['dropped']:>10}{100 * r['dropped'] / max(1, r['n_in']):>7.1f}%")
    return "\n".join(lines)
