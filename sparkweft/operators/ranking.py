"""Numbers and running sums over any number of rows, without a task that sees all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.sources.store import stored


def _dealt(df: DataFrame, order: tuple[Column | str, ...]) -> DataFrame:
    """Rows dealt into ranges of their order, with the range's number; stored, so that ranges stay as they are."""
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    return stored(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")


def runnings(df: DataFrame, sums: dict[str, str], *order: Column | str) -> DataFrame:
    """``df`` and, for each new name in ``sums``, the sum of that column up to each row in a total order: sums in each range, and the sums of the ranges before."""
    rows = _dealt(df, order)
    in_ranges = rows.groupBy("_range").agg(*(F.sum(v).alias(f"_sum_{n}") for n, v in sums.items()))
    # One row for each range.
    all_before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = in_ranges.select("_range", *(F.coalesce(F.sum(f"_sum_{n}").over(all_before), F.lit(0)).alias(f"_before_{n}") for n in sums))
    here = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(before), "_range").select(*rows.columns, *(F.col(f"_before_{n}") for n in sums), *(F.sum(v).over(here).alias(f"_here_{n}") for n, v in sums.items()))
    out = out.select(*df.columns, *((F.col(f"_here_{n}") + F.col(f"_before_{n}")).alias(n) for n in sums))
    # For whoever stores the result: the ranges are spent then.
    out._stored_at = rows._stored_at
    return out


def running(df: DataFrame, value: str, *order: Column | str, name: str = "used") -> DataFrame:
    """``df`` and the sum of ``value`` up to each row in a total order."""
    return runnings(df, {name: value}, *order)


def numbered(df: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """``df`` and each row's place, from 1, in a total order."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), "_one", *order, name=name).drop("_one")
