"""Choice under a budget. What doesn't fit is skipped and the walk goes on, so sizes are taken in order, group by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fitting(items: Column, size, budget: int) -> Column:
    """Of an ordered array, those that fit one after another; size maps an item to its size."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array_except(items, items).alias("taken"))

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + size(x) <= budget
        return F.when(fits, F.struct((s["used"] + size(x)).cast("long").alias("used"), F.concat(s["taken"], F.array(x)).alias("taken"))).otherwise(s)

    return F.aggregate(items, start, step, lambda s: s["taken"])


def greedy_pick(df: DataFrame, group: str, item: str, score: str, size: str, budget: int, keep: float = 0.5) -> DataFrame:
    """(group, item, score, size) of what is taken in each group: score at least keep, best first, ties by item.

    What is left only shrinks, so of items of one size none is taken after one that didn't fit: the first
    budget / size of each size are all that can be. Only their ids, scores and sizes are gathered by group, at most
    about budget * ln(budget) of them, however large the group is; items of size 0 are taken without being gathered.
    """
    able = df.where((F.col(score) >= keep) & (F.col(size) <= budget)).select(group, item, score, F.col(size).cast("long").alias(size))
    place = F.row_number().over(Window.partitionBy(group, size).orderBy(F.col(score).desc(), item))
    first = able.where(F.col(size) > 0).withColumn("_place", place).where(F.col("_place") <= F.lit(budget) / F.col(size))
    entry = F.struct((-F.col(score)).alias("rank"), F.col(item).alias("item"), F.col(size).alias("size"))
    ordered = first.groupBy(group).agg(F.array_sort(F.collect_list(entry)).alias("items"))
    taken = ordered.select(group, F.explode(fitting(F.col("items"), lambda x: x["size"], budget)).alias("x"))
    taken = taken.select(group, F.col("x.item").alias(item), (-F.col("x.rank")).alias(score), F.col("x.size").alias(size))
    return taken.unionByName(able.where(F.col(size) == 0))


def over_budget(df: DataFrame, group: str, item: str, score: str, size: str, budget: int, keep: float = 0.3, least: int = 0) -> DataFrame:
    """(group, asked, taken, chars, over_budget, stage) of a greedy choice of whole outputs of at least the least size."""
    able = df.withColumns({"ask": F.col(size) >= least, "able": (F.col(size) >= least) & (F.col(score) >= keep)})
    asked = able.groupBy(group).agg(F.count_if("ask").alias("asked"), F.count_if("able").alias("wanted"))
    got = greedy_pick(df.where(F.col(size) >= least), group, item, score, size, budget, keep).groupBy(group).agg(F.count("*").alias("taken"), F.sum(size).alias("chars"))
    out = asked.join(got, group, "left").withColumns({"taken": F.coalesce("taken", F.lit(0)).cast("long"), "chars": F.coalesce("chars", F.lit(0)).cast("long")})
    out = out.withColumn("over_budget", F.col("wanted") - F.col("taken"))
    stage = F.when(F.col("asked") == 0, "nothing_to_ask").when(F.col("taken") > 0, "carried").when(F.col("over_budget") > 0, "over_budget").otherwise("none_needed")
    return out.select(group, "asked", "taken", "chars", "over_budget", stage.alias("stage"))


def pick_standouts(lines: DataFrame, group: str, order: str, budget: int, per_output: int = 1500) -> DataFrame:
    """(group, order, pos, line) of the standout lines (group, order, pos, line) that are kept.

    Outputs are taken newest first; a line is skipped if it doesn't fit its output's or the total budget. After
    each pick the size grows by the line and one; the one isn't part of the test.

    Lines of one size are skipped in an output only once it or the whole is nearly full, and either takes some of the
    total: so per size only the first lines of the first outputs can be taken, and only those are gathered.
    """
    size = F.length("line")
    outputs = F.dense_rank().over(Window.partitionBy(group, size).orderBy(F.col(order).desc()))
    inside = F.row_number().over(Window.partitionBy(group, order, size).orderBy("pos"))
    some = F.greatest(F.lit(1), F.least(size, per_output - size + 1))
    lines = lines.withColumns({"_outputs": outputs, "_inside": inside}).where((size <= per_output) & ((size == 0) | (F.col("_inside") <= F.lit(per_output) / size) & (F.col("_outputs") <= F.floor(F.lit(budget) / some) + 1))).drop("_outputs", "_inside")
    entry = F.struct((-F.col(order)).alias("newest"), F.col("pos"), F.col(order).alias("at"), F.length("line").cast("long").alias("size"))
    ordered = lines.groupBy(group).agg(F.array_sort(F.collect_list(entry)).alias("items"))
    zero = F.lit(0).cast("long")
    none = F.array_except(F.col("items"), F.col("items"))
    start = F.struct(F.lit(None).cast(lines.schema[order].dataType).alias("at"), zero.alias("before"), zero.alias("own"), none.alias("taken"))

    def step(s: Column, x: Column) -> Column:
        new = ~s["at"].eqNullSafe(x["at"])
        before = F.when(new, s["before"] + s["own"]).otherwise(s["before"])
        own = F.when(new, zero).otherwise(s["own"])
        fits = (own + x["size"] <= per_output) & (before + own + x["size"] <= budget)
        grown = F.when(fits, own + x["size"] + 1).otherwise(own)
        taken = F.when(fits, F.concat(s["taken"], F.array(x))).otherwise(s["taken"])
        return F.struct(x["at"].alias("at"), before.alias("before"), grown.alias("own"), taken.alias("taken"))

    taken = ordered.select(group, F.explode(F.aggregate("items", start, step, lambda s: s["taken"])).alias("x")).select(group, F.col("x.at").alias(order), F.col("x.pos").alias("pos"))
    return taken.join(lines, [group, order, "pos"])


def cheapest(df: DataFrame, group: str, text: str, budget: Column) -> DataFrame:
    """(group, text): the shortest candidate within the budget (null: none), the first of equals by text."""
    fits = df.where(budget.isNull() | (F.length(text) <= budget))
    return fits.groupBy(group).agg(F.min_by(text, F.struct(F.length(text), F.col(text))).alias(text))
