"""Sums along an order within groups of any size: totals by range, offsets, then sums within each range.

A window over a group puts all of it into one task. Here rows are dealt by ranges of (group, order), so a large group
lies in several ranges, and only groups that go on from one range to the next need an offset: there are fewer of them
than ranges, and at most two totals a range for them, whatever the groups are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.shared import written

#: Rows of a range, more or less: what a task sorts.
ROWS_A_RANGE = 1 << 18
#: Rows of a key from which a join broadcasts what meets it instead of bringing the rows together.
HOT_ROWS = 1 << 16


@dataclass(frozen=True)
class Ranges:
    """``rows`` with their ``range``; ``crossing``: the groups that lie in more than one, of which there are fewer than ranges."""

    rows: DataFrame
    by: str
    order: tuple[str, ...]
    crossing: DataFrame

    def running(self, rows: DataFrame, **values: Column) -> DataFrame:
        """``rows`` with the sums of each value over its group's rows up to and including each.

        ``rows`` are the rows of these ranges, which may have got more columns. Null counts as 0.
        """
        values = {name: F.coalesce(v, F.lit(0.0)) for name, v in values.items()}
        along = Window.partitionBy("range", self.by).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = rows.withColumns({name: F.sum(v).over(along) for name, v in values.items()})
        totals = rows.join(F.broadcast(self.crossing), self.by, "left_semi").groupBy("range", self.by).agg(*[F.sum(v).alias(name) for name, v in values.items()])
        before = Window.partitionBy(self.by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select("range", self.by, *[F.sum(name).over(before).alias(f"_{name}") for name in values])
        joined = local.join(F.broadcast(offsets), ["range", self.by], "left")  # two rows a range at most
        return joined.withColumns({name: F.col(name) + F.coalesce(F.col(f"_{name}"), F.lit(0.0)) for name in values}).drop(*[f"_{name}" for name in values])


def ranges(rows: DataFrame, by: str, *order: str, rows_a_range: int = ROWS_A_RANGE) -> Ranges:
    """Deal ``rows`` out by ranges of their group and order, in which no two rows tie; they are written to the shared folder."""
    rows = written(rows, "unranged")
    n = max(1, -(-rows.count() // rows_a_range))
    dealt = written(rows.repartitionByRange(n, by, *order).withColumn("range", F.spark_partition_id()), "ranged")
    ends = dealt.groupBy(by).agg(F.min("range").alias("first"), F.max("range").alias("last"))
    return Ranges(dealt, by, order, written(ends.where("first < last").select(by), "crossing"))


def joined_hot(big: DataFrame, small: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``big`` joined with ``small``, which has one row a key, where no key of ``big`` meets in one task if it has many rows.

    Keys of more than ``hot_rows`` rows are broadcast with what ``small`` has for them: there are fewer than a
    ``hot_rows``-th of the rows.
    """
    hot = written(big.groupBy(key).count().where(F.col("count") > hot_rows).select(key).join(small, key), "hot-keys")
    cold = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(small, key)
    return big.join(F.broadcast(hot), key).unionByName(cold)


def numbered(rows: DataFrame, name: str, *order: str, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """``rows`` with their numbers from 0 along ``order``, in which no two tie; written to the shared folder, in no order.

    Ranges are counted, and each range numbers its own rows from where the ones before it end.
    """
    rows = written(rows, "unnumbered")
    n = max(1, -(-rows.count() // rows_a_range))
    dealt = written(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))  # a row a range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return written(dealt.withColumn("_own", own).join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_own") - 1).drop("_range", "_start", "_own"), "numbered")
