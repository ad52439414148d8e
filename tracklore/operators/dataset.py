"""Dataset work: groups and splits, sampling, set differences, preference pairs, removal, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals as iv


def group_key(paths: Column) -> Column:
    """Key of a clip's set of sources: 12 hex digits of the SHA-1 of the sorted paths; none: `empty`."""
    return F.when(F.size(paths) > 0, F.substring(F.sha1(F.array_join(F.array_sort(paths), "|")), 1, 12)).otherwise(F.lit("empty"))


def short_sha256(data: Column) -> Column:
    return F.substring(F.sha2(data.cast("binary"), 256), 1, 16)


def seed_of(key: Column) -> Column:
    """A 32-bit number from a text, the first eight hex digits of its SHA-256."""
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number from 0 to 1 by a text and a seed, the same on any partitioning."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def group_split(rows: DataFrame, group: str, fraction: float, seed: str, bins: int = 1 << 14) -> DataFrame:
    """`rows` with `split`: whole groups go to `val` or `train`.

    Groups are taken in the order of their hash; val gets the rounded share of them and at
    least one, so a single group goes to val. The last hash taken is found from counts in
    `bins` and an ordering of one bin, so groups never meet in one task.
    """
    u = uniform(F.coalesce(F.col(group).cast("string"), F.lit("")), seed)
    groups = rows.select(group).distinct().select(u.alias("u"), F.floor(u * bins).alias("bin"))
    counts = sorted(map(tuple, groups.groupBy("bin").count().collect()))
    left, last = max(1, round(sum(n for _, n in counts) * fraction)), 0.0
    for k, n in counts:
        if left <= n:
            last = groups.where(F.col("bin") == k).orderBy("u").limit(left).agg(F.max("u")).first()[0]
            break
        left -= n
    return rows.withColumn("split", F.when(u <= last, "val").otherwise("train"))


def hash_split(rows: DataFrame, group: str, fraction: float, seed: str) -> DataFrame:
    """`rows` with `split` by a threshold on the group's hash: no count, no join, the share in expectation."""
    return rows.withColumn("split", F.when(uniform(F.coalesce(group, F.lit("")), seed) < fraction, "val").otherwise("train"))


def weighted_choice(rows: DataFrame, key: str, weights: dict[str, float], seed: str) -> DataFrame:
    """`rows` with `choice`: a name drawn by weight from the hash of the key."""
    total, low = sum(weights.values()), 0.0
    u, out = uniform(F.col(key).cast("string"), seed), None
    for name, w in weights.items():
        low += w / total
        out = F.when(u < low, name) if out is None else out.when(u < low, name)
    return rows.withColumn("choice", out.otherwise(list(weights)[-1]))


def sample_rows(rows: DataFrame, key: str, k: int, seed: str) -> DataFrame:
    """k rows by the order of the key's hash."""
    return rows.orderBy(uniform(F.col(key).cast("string"), seed), key).limit(k)


def top_per_stratum(rows: DataFrame, strata: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each stratum, with their `rank`; partial top-k before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).where(F.col("rank") <= k)


def review_sheet(rows: DataFrame, template: str, has_error: str, key: str, seed: str, errors: int = 2, correct: int = 3, total: int = 50) -> DataFrame:
    """Per template at most `errors` clips with an error and `correct` without, errors first, `total` in all.

    The larger of the two numbers is a constant limit on the rank, which Spark applies
    within partitions before the shuffle.
    """
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(template, has_error).orderBy(uniform(F.col(key).cast("string"), seed), key)))
    kept = ranked.where(F.col("rank") <= max(errors, correct)).where(F.col("rank") <= F.when(F.col(has_error), errors).otherwise(correct))
    return kept.orderBy(F.col(has_error).desc(), template, "rank", key).limit(total)


def fill_quotas(rows: DataFrame, stratum: str, quotas: dict[str, int], key: str, seed: str, bins: int = 1 << 14) -> DataFrame:
    """The first rows of each stratum of `quotas` by the hash of their key, as many as its quota, or all if it has fewer.

    A stratum may hold any share of the rows: they are counted by bins of the hash, running
    sums over the bins tell which bins are taken whole, and only the bin in which a quota
    ends is put in order. Rows of equal key go by the hash of all their columns.
    """
    u = uniform(F.col(key).cast("string"), seed)
    wanted = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))
    dealt = rows.withColumns({"u__": u, "quota__": wanted[F.col(stratum)]}).where("quota__ IS NOT NULL").withColumn("bin__", F.floor(F.col("u__") * bins))
    counts = dealt.groupBy(stratum, "bin__", "quota__").agg(F.count("*").alias("n__"))
    before = F.coalesce(F.sum("n__").over(Window.partitionBy(stratum).orderBy("bin__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most `bins` rows of a stratum
    left = counts.withColumn("left__", F.col("quota__") - before).where("left__ > 0").select(stratum, "bin__", "n__", "left__")
    taken = dealt.drop("quota__").join(F.broadcast(left), [stratum, "bin__"])  # at most bins x quotas rows
    order = Window.partitionBy(stratum, "bin__").orderBy("u__", F.xxhash64(*rows.columns))
    last = taken.where("left__ < n__").withColumn("rank__", F.row_number().over(order)).where("rank__ <= left__")
    return taken.where("left__ >= n__").select(*rows.columns).union(last.select(*rows.columns))


def sharing_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str = "text", width: int = 5) -> DataFrame:
    """(left_id, right_id) of the rows whose texts share `width` consecutive words, in lower case; each pair once.

    Every row of either side takes part. Shingles meet by their hash, one row per text and
    shingle, and pairs are collapsed before they move on. Texts with fewer words, and null
    ones, share nothing.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\u00a0]+"), lambda w: w != "")
    each = lambda w: F.when(F.size(w) >= width, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(width)), " ")))))
    side = lambda df, key: df.select(key, F.explode(iv.let(words, each)).alias("shingle"))
    return side(left, left_id).join(side(right, right_id), "shingle").select(left_id, right_id).distinct()


def event_keys(events: Column, ends: bool = True) -> Column:
    """Distinct keys of events: type and first start, with `ends` also the last end, in tenths."""
    key = lambda e: F.concat_ws(":", e["type"], iv.onset(e["spans"]).cast("string"), *([iv.offset(e["spans"]).cast("string")] if ends else []))
    return F.coalesce(F.array_distinct(F.transform(events, key)), F.array().cast("array<string>"))


def set_difference(pairs: DataFrame, gt: str = "gt_keys", pred: str = "pred_keys") -> DataFrame:
    """`pairs` with counts of correct, hallucinated and omitted keys, and the kind of error."""
    rows = pairs.withColumns(
        {
            "n_correct": F.size(F.array_intersect(gt, pred)).cast("long"),
            "n_halluc": F.size(F.array_except(pred, gt)).cast("long"),
            "n_omit": F.size(F.array_except(gt, pred)).cast("long"),
        }
    )
    kind = F.when((F.col("n_halluc") == 0) & (F.col("n_omit") == 0), "correct").when(F.col("n_omit") == 0, "hallucination").when(F.col("n_halluc") == 0, "omission").otherwise("mixed")
    return rows.withColumn("error_type", kind)


def preference_pairs(pairs: DataFrame, gt: str, pred: str, chosen: Column, rejected: Column) -> DataFrame:
    """(sample_id, chosen, rejected) of clips whose predicted key set differs from the reference's."""
    differs = (F.size(F.array_except(gt, pred)) > 0) | (F.size(F.array_except(pred, gt)) > 0)
    return pairs.where(differs).select("sample_id", chosen.alias("chosen"), rejected.alias("rejected"))


def without_source(ledgers: DataFrame, removed: Column) -> DataFrame:
    """Ledgers without one source: its track goes, and the events that refer to it."""
    return ledgers.withColumns(
        {"tracks": F.filter("tracks", lambda t: ~t["id"].eqNullSafe(removed)), "events": F.filter("events", lambda e: ~e["track_id"].eqNullSafe(removed))}
    )


def data_card(clips: DataFrame, events: DataFrame) -> DataFrame:
    """One row: clips, shortest and longest, and events per clip (min, max, mean), clips without events included."""
    n = clips.join(events.groupBy("sample_id").agg(F.count("*").alias("n")), "sample_id", "left").select("duration_ds", F.coalesce("n", F.lit(0)).alias("n"))
    return n.agg(
        F.count("*").alias("n_clips"), F.min("duration_ds").alias("min_duration_ds"), F.max("duration_ds").alias("max_duration_ds"),
        F.min("n").alias("min_events"), F.max("n").alias("max_events"), F.round(F.avg("n"), 6).alias("mean_events"),
    )


def parse_summary(reports: DataFrame) -> DataFrame:
    """One row of `reports(ok, strict_format_success, events_recovered, events_rejected)`."""
    n = F.greatest(F.count("*"), F.lit(1))
    return reports.agg(
        F.count("*").alias("n_samples"), F.count_if("ok").alias("n_ok"), F.round(F.count_if("strict_format_success") / n, 4).alias("strict_format_success_rate"),
        F.round(F.coalesce(F.sum("events_recovered"), F.lit(0)) / n, 3).alias("mean_events_recovered"), F.coalesce(F.sum("events_rejected"), F.lit(0)).alias("total_events_rejected"),
    )
