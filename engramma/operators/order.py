"""Order statistics without a sort (histograms narrow the place down, a job a step, nothing collected but counts), and values carried along an order that no single task holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramma.sources.snapshots import checkpointed

BINS = 1024


def kth(rows: DataFrame, column: str, k: int):
    """The value at place k (from 0, ascending) of a numeric column without nulls; each step narrows the range about `BINS` times."""
    x = F.col(column)
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low is not None and low != high:
        bucket = F.least(F.lit(BINS - 1), F.floor((x.cast("double") - F.lit(float(low))) / F.lit(float(high) - float(low)) * BINS)).alias("b")
        counts = rows.where(x.between(low, high)).groupBy(bucket).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        found = sorted(counts.collect(), key=lambda r: r["b"])  # at most BINS rows
        for r in found:
            if k < r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return low


def nearest_ranks(rows: DataFrame, groups: list[str], value: str, q: float) -> DataFrame:
    """Per group the value at place min(n - 1, int(q n)) in ascending order, as `value`: values are counted first, so repeats cost nothing."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("c"))
    inside = Window.partitionBy(*groups)
    upto = F.sum("c").over(inside.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("upto", upto).withColumn("n", F.sum("c").over(inside))
    place = F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(q)))
    return placed.where(F.col("upto") > place).groupBy(*groups).agg(F.min(value).alias(value))


def least_rows(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n rows that come first by numeric keys (the last one unique): a filter found by `kth`, key after key, and no sort."""
    if n <= 0:
        return rows.limit(0)
    taken, open_ = F.lit(False), F.lit(True)
    left = rows
    for key in keys:
        value = kth(left, key, n - 1)
        if value is None or (n >= left.count() if key == keys[0] else False):
            return rows
        taken = taken | (open_ & (F.col(key) < value))
        open_ = open_ & (F.col(key) == value)
        n -= left.where(F.col(key) < value).count()
        left = left.where(F.col(key) == value)
    return rows.where(taken | open_)


class Ranged:
    """Rows in ranges of (keys, order): a key of any size spans as many ranges as it needs, and each range is a task's.

    Values are carried along the order of a key within a range by a window, and from range to range by a table of a row a key and range. Keys must not be null; nulls in the order come first."""

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str]):
        self.keys, self.order = keys, order
        by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
        self.rows = checkpointed(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))

    def _window(self, start: int, end: int):
        return Window.partitionBy("_range", *self.keys).orderBy(*[F.col(c).asc_nulls_first() for c in self.order]).rowsBetween(start, end)

    def with_last(self, name: str, value: Column, inclusive: bool = True) -> Ranged:
        """Adds the last value that isn't null up to a row (or before it)."""
        return self._carry(name, value, F.last, self._window(Window.unboundedPreceding, 0 if inclusive else -1), F.max_by, Window.partitionBy(*self.keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))

    def with_next(self, name: str, value: Column) -> Ranged:
        """Adds the first value that isn't null behind a row."""
        return self._carry(name, value, F.first, self._window(1, Window.unboundedFollowing), F.min_by, Window.partitionBy(*self.keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1))

    def _carry(self, name: str, value: Column, pick, inside, edge, across) -> Ranged:
        rows = self.rows.withColumn("_v", value)
        edges = rows.where("_v is not null").groupBy("_range", *self.keys).agg(edge("_v", F.struct(*self.order)).alias("_e"))
        every = rows.select("_range", *self.keys).distinct().join(edges, ["_range", *self.keys], "left")
        beyond = every.select("_range", *self.keys, F.last("_e", ignorenulls=True).over(across).alias("_b"))
        out = object.__new__(Ranged)
        out.keys, out.order = self.keys, self.order
        out.rows = rows.withColumn(name, pick("_v", ignorenulls=True).over(inside)).join(beyond, ["_range", *self.keys], "left").withColumn(name, F.coalesce(name, "_b")).drop("_v", "_b")
        return out

    def done(self) -> DataFrame:
        return self.rows.drop("_range")
