"""As-of and bounded-forward lookups by sorted union instead of inequality joins: one shuffle by key, no pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _together(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Both sides as rows of (key, time, side, row, value); right rows of a time stand before left ones."""
    own = left.select(key, time, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    other = right.select(key, time, F.lit(0).alias("_side"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"))
    return own.unionByName(other)


def before(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """left with first_ and last_ value: the first and the latest of right's values at or before each row."""
    w = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _together(left, right, key, time, value)
    rows = rows.withColumns({f"first_{value}": F.first("_value", ignorenulls=True).over(w), f"last_{value}": F.last("_value", ignorenulls=True).over(w)})
    return rows.where("_side = 1").select("_row.*", f"first_{value}", f"last_{value}")


def next_within(df: DataFrame, key: str, order: list[str], start, target, value: str, steps: int, stop=None) -> DataFrame:
    """Rows of df where start holds, with next_ value: that of the first later row where target holds, no more than
    so many rows ahead and before any row where stop holds. The frame is bounded, so memory is as well."""
    w = Window.partitionBy(key).orderBy(*order)
    ahead = w.rowsBetween(1, steps)
    n = F.row_number().over(w)
    rows = df.withColumns({"_n": n, "_start": start, "_hit": F.when(target, F.struct(n.alias("n"), F.col(value).alias("v"))), "_stop": F.when(stop, n) if stop is not None else F.lit(None).cast("int")})
    hit, end = F.first("_hit", ignorenulls=True).over(ahead), F.first("_stop", ignorenulls=True).over(ahead)
    rows = rows.withColumns({"_found": hit, "_end": end})
    found = F.when(F.col("_end").isNull() | (F.col("_found.n") < F.col("_end")), F.col("_found.v"))
    return rows.withColumn(f"next_{value}", found).where("_start").drop("_n", "_start", "_hit", "_stop", "_found", "_end")


def following(df: DataFrame, key: str, order: list[str], start, group: str, groups: int, value: str, cut=None) -> DataFrame:
    """(key, order..., later): for each row where start holds, the values of the next distinct groups after its own.

    cut: nothing from the first later row on where it holds (its own row doesn't count).
    """
    w = Window.partitionBy(key)
    rows = df.withColumn("_g", F.dense_rank().over(w.orderBy(group)))
    ahead = w.orderBy("_g").rangeBetween(1, groups)
    if cut is None:
        return rows.withColumn("later", F.collect_list(value).over(ahead)).where(start).drop("_g")
    rows = rows.withColumn("_cut", F.min(F.when(cut, F.col("_g"))).over(w.orderBy("_g").rangeBetween(1, Window.unboundedFollowing)))
    rows = rows.withColumn("_later", F.collect_list(F.struct("_g", F.col(value).alias("v"))).over(ahead))
    kept = F.filter("_later", lambda x: F.col("_cut").isNull() | (x["_g"] < F.col("_cut")))
    return rows.withColumn("later", F.transform(kept, lambda x: x["v"])).where(start).drop("_g", "_cut", "_later")
