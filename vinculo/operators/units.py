"""Quantities in different units (problem 6): conversions as a graph of affine functions.

Units are nodes; an edge ``a -> b`` says ``x_b = scale * x_a + shift``. The shortest composition (fewest edges) from
every unit to the canonical one is worked out once on the driver, for the graph is a fixed table; every cycle is
checked to be the identity within a tolerance, so contradicting conversions are an error and not a silent choice.
Rows are then converted by an equi-join on source unit and canonical target, so one table serves several targets. The
table has a row for each unit and target; it is broadcast up to MAX_UNITS rows and joined by a shuffle beyond.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scales of sums of money, as powers of ten of the plain currency. Fixed values.
MONEY_SCALES = {"": 0, "k": 3, "lakh": 5, "m": 6, "crore": 7, "b": 9, "t": 12}
#: How a scale is made of a smaller one, besides of the plain currency; so the graph of money has cycles to check. Fixed values.
SCALE_STEPS = [("lakh", "k", 100), ("m", "k", 1000), ("m", "lakh", 10), ("crore", "lakh", 100), ("crore", "m", 10), ("b", "m", 1000), ("t", "b", 1000)]
#: Above so many rows a table of conversions isn't broadcast.
MAX_UNITS = 10_000


class InconsistentUnits(ValueError):
    """Two ways through the graph convert differently."""


@dataclass(frozen=True)
class Affine:
    scale: Fraction
    shift: Fraction = Fraction(0)

    def then(self, after: Affine) -> Affine:
        return Affine(after.scale * self.scale, after.scale * self.shift + after.shift)

    def inverse(self) -> Affine:
        return Affine(1 / self.scale, -self.shift / self.scale)


class UnitGraph:
    """Conversions between units; each edge can be used both ways."""

    def __init__(self, tolerance: float = 1e-9):
        self.edges: dict[str, list[tuple[str, Affine]]] = {}
        self.tolerance = tolerance

    def add(self, source: str, target: str, scale, shift=0) -> None:
        f = Affine(Fraction(str(scale)), Fraction(str(shift)))
        if not f.scale:
            raise ValueError(f"{source} -> {target}: a scale of 0 can't be undone")
        self.edges.setdefault(source, []).append((target, f))
        self.edges.setdefault(target, []).append((source, f.inverse()))

    def to(self, canonical: str) -> dict[str, tuple[Affine, int]]:
        """Of each unit that reaches the canonical one, the composed function and its number of steps.

        Breadth first from the canonical unit; each edge that closes a cycle is checked.
        """
        found = {canonical: (Affine(Fraction(1)), 0)}
        queue = deque([canonical])
        while queue:
            unit = queue.popleft()
            way, steps = found[unit]
            for other, f in self.edges.get(unit, []):
                back = f.inverse().then(way)
                if other not in found:
                    found[other] = back, steps + 1
                    queue.append(other)
                elif not self._same(back, found[other][0]):
                    raise InconsistentUnits(f"{other} -> {canonical}: {found[other][0]} and, by {unit}, {back}")
        return found

    def _same(self, a: Affine, b: Affine) -> bool:
        return abs(a.scale - b.scale) <= self.tolerance * abs(b.scale) and abs(a.shift - b.shift) <= self.tolerance * max(1, abs(b.shift))

    def table(self, spark: SparkSession, canonical: str) -> DataFrame:
        """``unit, target, scale decimal, shift decimal, steps`` for every unit that reaches the canonical one."""
        rows = [(u, canonical, _decimal(f.scale), _decimal(f.shift), n) for u, (f, n) in sorted(self.to(canonical).items())]
        texts = spark.createDataFrame(rows, "unit string, target string, scale string, shift string, steps int")
        return texts.select("unit", "target", F.col("scale").cast("decimal(38,12)").alias("scale"), F.col("shift").cast("decimal(38,12)").alias("shift"), "steps")


def _decimal(x: Fraction) -> str:
    scaled = round(x * 10**12)
    return f"{'-' if scaled < 0 else ''}{abs(scaled) // 10**12}.{abs(scaled) % 10**12:012d}"


def money_graph(rates: list[tuple[str, float]], canonical: str = "USD") -> UnitGraph:
    """Every currency in every scale: scales are edges to the plain currency, rates edges to the canonical one.

    ``rates`` are (currency, canonical units for one); rows with a null in them are left out. A currency given twice
    with different rates is inconsistent.
    """
    graph = UnitGraph()
    for currency, rate in rates:
        if currency is None or rate is None:
            continue
        if currency != canonical or rate != 1:
            graph.add(currency, canonical, rate)
        for name, power in MONEY_SCALES.items():
            if name:
                graph.add(f"{name} {currency}", currency, 10**power)
        for name, smaller, times in SCALE_STEPS:
            graph.add(f"{name} {currency}", f"{smaller} {currency}", times)
    return graph


def convert(df: DataFrame, quantity: Column, unit: Column, target: Column, conversions: DataFrame, *, out: str = "canonical") -> DataFrame:
    """Adds ``out``, the quantity in the target unit; null for a null quantity or where no conversion leads to the target.

    Every row of ``df`` comes out once. The multiplication is in exact decimals: quantities have up to 19 digits before
    the point and 6 behind it, factors 13 and 9; what is larger comes out as null, what is finer is rounded.
    """
    known = conversions.select(F.col("unit").alias("__unit"), F.col("target").alias("__target"), F.col("scale").alias("__scale"), F.col("shift").alias("__shift"))
    if known.count() <= MAX_UNITS:
        known = F.broadcast(known)
    value = quantity.cast("decimal(25,6)") * F.col("__scale").cast("decimal(22,9)") + F.col("__shift").cast("decimal(22,9)")
    return df.join(known, (unit == F.col("__unit")) & (target == F.col("__target")), "left").withColumn(out, value).drop("__unit", "__target", "__scale", "__shift")
