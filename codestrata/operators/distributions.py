"""Exact percentiles without interpolation, and how concentrated high complexity is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codestrata import constants as C
from codestrata.functions.exprs import pct1, zero
from codestrata.operators.ranges import ranked
from codestrata.sources.scratch import cut_lineage


def floor_percentiles(d: DataFrame, keys: tuple[str, ...], values: dict[str, str], ps: tuple[float, ...] = (0.5, 0.75, 0.9), median: bool = False, weight: str | None = None, wide: bool = False) -> DataFrame:
    """For each (name, column) of ``values`` and each p: p50_name, ... - the element at place min(floor(p n), n - 1).

    Values are counted first, so a group is as large as its number of different values. Those of lengths and complexities add up to no more
    than the group's total, so a group of 10**12 lines has at most 1.5 million. A running count over them finds the places. Where values may be different
    without such a bound (fractions, times), ``wide`` counts over ranges of their order, so that no task holds a group. ``median`` adds
    median_name, the mean of the two middle elements; a row counts as often as its column ``weight`` says.
    """
    out = None
    for name, c in values.items():
        often = F.sum(weight) if weight else F.count(F.lit(1))
        counts = d.where(F.col(c).isNotNull()).groupBy(*keys, F.col(c).alias("v")).agg(often.alias("c"))
        whole = Window.partitionBy(*keys)
        upto = whole.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        if wide:
            ran = ranked(counts, keys, [F.col("v")], "upto", weight="c")
            total = ran.groupBy(*keys).agg(F.sum("c").alias("n")).select(*[F.col(k).alias(f"{k}_t") for k in keys], "n")
            ran = ran.join(total, [F.col(k).eqNullSafe(F.col(f"{k}_t")) for k in keys] or F.lit(True))
        else:
            ran = counts.withColumn("n", F.sum("c").over(whole)).withColumn("upto", F.sum("c").over(upto))
        at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v"))).cast("double")
        picks = [at(F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1)).alias(f"p{round(p * 100)}_{name}") for p in ps]
        if median:
            picks.append(((at(F.expr("(n - 1) div 2")) + at(F.expr("n div 2"))) / 2).alias(f"median_{name}"))
        got = ran.groupBy(*keys).agg(*picks)
        out = got if out is None else out.join(got, list(keys), "full")
    return out


#: Weights are counted by steps of about a sixty-fourth first.
STEPS = 64
#: Rows of equal weight, at the edge of the top share, that one window may rank; more are ranked over ranges.
TIED_ROWS = 1_000_000


def top_share_concentration(entities: DataFrame, keys: tuple[str, ...], weight: str, high: str, tie: str, share: float = C.TOP_SHARE, tied_rows: int = TIED_ROWS) -> DataFrame:
    """(keys, concentration): of all ``high``, the percentage in the ceil(share n) heaviest entities; ties by ``tie`` ascending.

    Without keys it ranks all entities together. Entities are not sorted: equal weights are counted, counts are added up from the
    heaviest step of weights down to the step that the share ends in, then from weight to weight within that step. Only if
    the share ends among entities of one weight that differ in ``high`` are those ranked by ``tie``.
    """
    d = entities.select(*keys, F.col(weight).alias("w"), F.col(high).alias("h"), F.col(tie).alias("t"))
    x = F.col("w").cast("double")
    step = F.floor(F.signum(x) * F.log1p(F.abs(x)) * STEPS)  # never falls where the weight grows
    step = F.when(F.isnan(x), F.lit(2**63 - 1)).otherwise(step)
    weights = d.groupBy(*keys, step.alias("step"), "w").agg(F.count(F.lit(1)).alias("c"), zero(F.sum("h")).alias("s"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("h").alias("known"))
    whole = Window.partitionBy(*keys)
    heavier = lambda c: whole.orderBy(F.desc(c)).rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda c, by: F.coalesce(F.sum(c).over(heavier(by)), F.lit(0))
    steps = weights.groupBy(*keys, "step").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
    steps = steps.withColumn("n", F.sum("c").over(whole)).withColumn("total", F.sum("s").over(whole)).withColumn("before", ahead("c", "step")).withColumn("above", ahead("s", "step"))
    steps = steps.withColumn("left", F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(share))) - F.col("before")).where((F.col("left") > 0) & (F.col("left") <= F.col("c")))
    edge = steps.select(*[F.col(k).alias(f"{k}_e") for k in keys], F.col("step").alias("step_e"), "left", "above", "total")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_e")) for c in (*keys, "step")]
    last = weights.join(edge, same).withColumn("before", ahead("c", "w")).withColumn("higher", ahead("s", "w"))
    last = last.withColumn("left", F.col("left") - F.col("before")).where((F.col("left") > 0) & (F.col("left") <= F.col("c")))
    last = cut_lineage(last.select(*keys, "w", "c", "s", "left", (F.col("above") + F.col("higher")).alias("above"), "total", "lo", ((F.col("left") < F.col("c")) & ((F.col("lo") < F.col("hi")) | ((F.col("known") > 0) & (F.col("known") < F.col("c"))))).alias("open")))
    most = last.where("open").agg(F.max("c")).first()[0]
    whole_tie = F.when(F.col("left") == F.col("c"), F.col("s")).otherwise(F.col("left") * F.coalesce("lo", F.lit(0)))
    if most is None:
        return last.select(*keys, pct1(F.col("above") + whole_tie, "total").alias("concentration"))
    wanted = last.where("open").select(*[F.col(k).alias(f"{k}_e") for k in keys], F.col("w").alias("w_e"), "left")
    tied = d.join(wanted, [F.col(c).eqNullSafe(F.col(f"{c}_e")) for c in (*keys, "w")]).select(*keys, "h", "t", "left")
    order = [F.asc("t"), F.desc("h")]
    tied = tied.withColumn("rank", F.row_number().over(whole.orderBy(*order))) if most <= tied_rows else ranked(tied, keys, order)
    part = tied.where("rank <= left").groupBy(*keys).agg(zero(F.sum("h")).alias("part"))
    part = part.select(*[F.col(k).alias(f"{k}_e") for k in keys], "part")
    got = last.join(part, [F.col(k).eqNullSafe(F.col(f"{k}_e")) for k in keys] or F.lit(True), "left")
    return got.select(*keys, pct1(F.col("above") + F.when(F.col("open"), F.col("part")).otherwise(whole_tie), "total").alias("concentration"))


def distributions(functions: DataFrame, files: DataFrame) -> DataFrame:
    """The seven measures of each repository that has files; files without functions count among the ranked ones."""
    high = F.count_if(F.coalesce(F.col("complexity") >= C.HIGH_COMPLEXITY, F.lit(False)))
    sums = functions.groupBy("repo_id", "file").agg(F.sum("complexity").alias("t"), high.alias("h"))  # before the join, so that a row a file moves, not one a function
    per_file = files.select("repo_id", "file").join(sums, ["repo_id", "file"], "left").groupBy("repo_id", "file").agg(zero(F.sum("t")).alias("t"), zero(F.sum("h")).alias("h"))
    shares = top_share_concentration(per_file, ("repo_id",), "t", "h", "file").withColumnRenamed("concentration", "percent_high_complexity_in_top_10_percent_files")
    names = {"function_length": "lines", "complexity": "complexity"}
    d = shares.join(floor_percentiles(functions, ("repo_id",), names), "repo_id", "left")
    zeros = [F.coalesce(f"p{p}_{n}", F.lit(0.0)).alias(f"p{p}_{n}") for n in names for p in (50, 75, 90)]
    return d.select("repo_id", *zeros, "percent_high_complexity_in_top_10_percent_files")


def file_stats(functions: DataFrame, keys: tuple[str, ...] = ("repo_id", "file")) -> DataFrame:
    """What the file table shows: highest and mean complexity (unrounded), longest function, deepest nesting."""
    return functions.groupBy(*keys).agg(
        zero(F.max("complexity")).alias("max_complexity"), zero(F.avg("complexity")).alias("avg_complexity"), zero(F.max("lines")).alias("longest"),
        zero(F.max("max_nesting")).alias("max_nesting"), F.count(F.lit(1)).alias("functions"), zero(F.sum("complexity")).alias("total_complexity"),
    )


def top_k(d: DataFrame, keys: tuple[str, ...], by: list[Column], k: int = C.HOTSPOTS) -> DataFrame:
    """The first k rows of each group, with ``rank``; Spark limits groups before the shuffle."""
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("rank") <= k)
