"""Uncertainty of metrics (bootstrap, permutation) and calibration of confidences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MILLION = 1_000_000


def draw(*parts: Column | str) -> Column:
    """A number from 0 to 2^32 - 1 by the MD5 of the parts, the same on any partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 8), 16, 10).cast("long")


def poisson_steps() -> list[int]:
    """Of 2^32 draws, how many give at most 0, 1, 2... in a Poisson distribution of mean 1, until all do."""
    total, steps = 0.0, []
    for k in range(13):
        total += math.exp(-1) / math.factorial(k)
        steps.append(round(total * 2**32))
    return steps


def poisson(u: Column) -> Column:
    """The Poisson number of mean 1 of a draw."""
    return sum(((u >= step).cast("int") for step in poisson_steps()), F.lit(0))


def in_millionths(value: Column) -> Column:
    """Whole numbers add up to the same sum in any order."""
    return F.round(value * MILLION).cast("long")


def bootstrap(samples: DataFrame, metrics: list[str], replicates: int = 200, seed: int = 1, level: float = 0.95, key: str = "sample_id") -> DataFrame:
    """(metric, n, mean, low, high): means over clips with a bootstrap interval.

    Each clip has a Poisson weight in each replicate, drawn by a hash of both, so no
    sample is drawn and the result doesn't depend on partitions. Clips are combined per
    replicate before anything moves. Null values don't count; repeated rows draw alike.
    The interval goes from the (1 - level) / 2 percentile of the replicates' means to its counterpart.
    """
    clips = samples.select(F.col(key).cast("string").alias("key"), *(in_millionths(F.col(m)).alias(m) for m in metrics))
    drawn = clips.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("replicate"))  # 0 is the table itself
    drawn = drawn.withColumn("u", draw(F.lit(seed), "replicate", "key"))  # a column of its own: inside the condition each step would hash anew
    weight = F.when(F.col("replicate") == 0, 1).otherwise(poisson(F.col("u")))
    sums = drawn.withColumn("w", weight).groupBy("replicate").agg(*(F.struct(F.sum(F.col("w") * F.col(m)).alias("sum"), F.sum(F.when(F.col(m).isNotNull(), F.col("w"))).alias("n")).alias(m) for m in metrics))
    rows = sums.select("replicate", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}.sum").alias("sum"), F.col(f"{m}.n").alias("n")) for m in metrics))).alias("x"))
    means = rows.select("replicate", "x.metric", "x.n", F.when(F.col("x.n") > 0, F.col("x.sum") / F.col("x.n") / MILLION).alias("mean"))
    own = lambda c: F.max(F.when(F.col("replicate") == 0, F.col(c)))
    cut = lambda q: F.round(F.percentile(F.when(F.col("replicate") > 0, F.col("mean")), F.lit(q)), 6)
    return means.groupBy("metric").agg(F.coalesce(own("n"), F.lit(0)).alias("n"), F.round(own("mean"), 6).alias("mean"), cut((1 - level) / 2).alias("low"), cut((1 + level) / 2).alias("high"))


def paired_permutation(pairs: DataFrame, a: str, b: str, replicates: int = 1000, seed: int = 1, key: str = "sample_id") -> DataFrame:
    """One row: n, mean_difference, at_least, p_value of the mean of a - b over clips.

    Under the hypothesis that both are alike each clip's difference may have either sign. A
    replicate flips each by a bit of a hash; p is the share of replicates, the table itself
    included, whose sum is as far from 0. Sums are of whole millionths, so that ties count.
    """
    clips = pairs.select(F.col(key).cast("string").alias("key"), (in_millionths(F.col(a)) - in_millionths(F.col(b))).alias("d")).where("d IS NOT NULL")
    drawn = clips.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("replicate"))
    sign = F.when((F.col("replicate") == 0) | (draw(F.lit(seed), "replicate", "key") % 2 == 0), 1).otherwise(-1)
    sums = drawn.groupBy("replicate").agg(F.sum(sign * F.col("d")).alias("sum"), F.count("*").alias("n"))
    every = sums.agg(F.max(F.when(F.col("replicate") == 0, F.col("sum"))).alias("own"), F.max("n").alias("n"), F.collect_list(F.when(F.col("replicate") > 0, F.col("sum"))).alias("flipped"))  # a number per replicate
    far = every.select("own", F.coalesce("n", F.lit(0)).alias("n"), F.size(F.filter("flipped", lambda x: F.abs(x) >= F.abs(F.col("own")))).cast("long").alias("at_least"))
    return far.select("n", F.round(F.col("own") / F.col("n") / MILLION, 6).alias("mean_difference"), "at_least", F.round((F.col("at_least") + 1) / F.lit(replicates + 1), 6).alias("p_value"))


def ranked(rows: DataFrame, confidence: str, correct: str, ranges: int | None = None) -> DataFrame:
    """(units, n, right, n_before, right_before, n_all, right_all): rows per distinct confidence, and sums over all lower ones.

    Confidences are whole millionths; rows of equal confidence are one. The running sums
    need no window over everything: values fall into ranges by their quantiles, the sums of
    the ranges before are added to those inside.
    """
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = in_millionths(F.col(confidence))
    each = rows.where(F.col(confidence).isNotNull()).groupBy(units.alias("units")).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("int")).cast("long").alias("right"))
    bounds = each.agg(F.percentile_approx("units", [i / ranges for i in range(1, ranges)] or [0.5]).alias("b")).first().b or []  # a number per range
    part = F.size(F.filter(F.array(*(F.lit(x).cast("long") for x in bounds)), lambda x: x < F.col("units"))) if bounds else F.lit(0)
    dealt = each.withColumn("part", part)
    inside = Window.partitionBy("part").orderBy("units").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("part").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))  # one row per range
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_part") for c in ("n", "right")), *(F.sum(c).over(Window.partitionBy(F.lit(0))).alias(f"{c}_all") for c in ("n", "right")))
    run = lambda c: (F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"{c}_part")).alias(f"{c}_before")
    return dealt.join(F.broadcast(before), "part").select("units", "n", "right", run("n"), run("right"), "n_all", "right_all")


def binned(rows: DataFrame, confidence: str, correct: str, bins: int) -> DataFrame:
    """(bin, n, c, a, off): rows, mean confidence, share that is right and summed squared distance (in square millionths) of each bin."""
    r = ranked(rows, confidence, correct).withColumn("bin", F.floor(F.col("n_before") * bins / F.col("n_all")).cast("int"))
    square = lambda x: (x * x).cast("decimal(38,0)")
    off = square(F.col("units") - MILLION) * F.col("right") + square(F.col("units")) * (F.col("n") - F.col("right"))
    return r.groupBy("bin").agg(F.sum("n").alias("n"), (F.sum(F.col("units") * F.col("n")) / F.sum("n") / MILLION).alias("c"), (F.sum("right") / F.sum("n")).alias("a"), F.sum(off).alias("off"))


def calibration_bins(rows: DataFrame, confidence: str = "confidence", correct: str = "correct", bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy, gap): bins of about equal numbers of rows, by confidence.

    Rows of equal confidence stay together, in the bin where the first of them falls.
    Null confidences don't count.
    """
    gap = F.round(F.abs(F.col("a") - F.col("c")), 6)
    return binned(rows, confidence, correct, bins).select("bin", "n", F.round("c", 6).alias("confidence"), F.round("a", 6).alias("accuracy"), gap.alias("gap"))


def calibration(rows: DataFrame, confidence: str = "confidence", correct: str = "correct", bins: int = 10) -> DataFrame:
    """One row: n, ece (the bins' gaps, weighted), the largest gap, brier (mean squared distance from 0 or 1)."""
    gap = F.round(F.abs(F.col("a") - F.col("c")), 6)
    return binned(rows, confidence, correct, bins).agg(
        F.sum("n").alias("n"), F.round(F.sum(F.col("n") * gap) / F.sum("n"), 6).alias("ece"), F.max(gap).alias("max_gap"), F.round(F.sum("off").cast("double") / F.sum("n") / 1e12, 6).alias("brier")
    )


def risk_coverage(rows: DataFrame, confidence: str = "confidence", correct: str = "correct") -> DataFrame:
    """(confidence, n, coverage, risk): if only rows of at least that confidence are answered, their share and the errors among them."""
    kept, good = F.col("n_all") - F.col("n_before"), F.col("right_all") - F.col("right_before")
    return ranked(rows, confidence, correct).select(
        F.round(F.col("units") / MILLION, 6).alias("confidence"), kept.alias("n"), F.round(kept / F.col("n_all"), 6).alias("coverage"), F.round((kept - good) / kept, 6).alias("risk")
    )
