"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of (source, language, topic). The cells' token weights
are raked: scaled to each dimension's target shares in turn until all hold. A document's
probability of being sampled is its cell's weight over its tokens, times one factor that
makes the expected tokens meet the budget, and at most one; whether it is sampled follows
from a hash of its id.

A topic is a set of words: the most widespread ones that no large share of the texts holds
are found from counts over all texts and dealt to the topics; a text belongs to the topic
whose words it uses most.

Only cells are iterated over, in as few partitions as they need: a few hundred cells lie
in one, where raking moves nothing. Texts are read twice, or three times where columns are
kept with the sample; documents are joined once with the cells.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import released, sized, staged

SEED, TOLERANCE, ROUNDS, AT_ONCE, PATIENCE = "mix-1", 1e-9, 50, 5, 3
BROADCAST = 50_000  # cells up to which they are broadcast, and cells in a partition; more are joined by a shuffle
DIMENSIONS = ("source", "lang", "topic")
TOPICS, WORDS, COMMON, OTHER = 8, 128, 0.1, "other"


def token_count(text: Column) -> Column:
    """Runs of characters other than white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def text_words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def topic_words(docs: DataFrame, text_col: str = "text", words: int = WORDS, common: float = COMMON) -> list[str]:
    """The `words` words that most texts hold, of those that two or more and at most a share `common` of all texts hold.

    Counts are over all texts; equal counts go by the word. Fewer words, or none, where
    the table has no more.
    """
    held = docs.select(F.explode(F.array_distinct(text_words(F.col(text_col)))).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    return [r.word for r in held.where((F.col("n") > 1) & (F.col("n") <= common * docs.count())).orderBy(F.desc("n"), "word").limit(words).collect()]


def topic_of(text: Column, words: list[str], topics: int = TOPICS) -> Column:
    """topic-0, topic-1, ..: the topic whose words a text uses most, of several the first; `OTHER` if it uses none.

    The words, most widespread first, are dealt to the topics in turn; so each topic has
    words of each language of some size, and topics can be weighted beside languages.
    """
    if not words:
        return F.lit(OTHER)
    place = lambda w: F.pmod(F.array_position(F.split(F.lit(" ".join(words)), " "), w) - 1, F.lit(topics))
    uses = lambda used, k: F.size(F.filter(used, lambda t: t == k))
    best = lambda used: F.array_max(F.array(*(F.struct(uses(used, k).alias("n"), F.lit(-k).alias("less")) for k in range(topics))))
    used = F.transform(F.filter(text_words(text), lambda w: w.isin(words)), place)
    named = lambda top: F.when(top["n"] > 0, F.concat(F.lit("topic-"), (-top["less"]).cast("string"))).otherwise(F.lit(OTHER))
    return F.element_at(F.transform(F.transform(F.array(used), best), named), 1)  # inside a lambda; named twice, the text would be split twice


def unit_hash(ident: Column) -> Column:
    """A number from 0 to 1 by the id's text, from the first 52 bits of its MD5; a null id counts as ''."""
    key = F.concat(F.lit(SEED + ":"), F.coalesce(ident.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(value, share): shares in proportion to a power of each value's tokens."""
    totals = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").cast("double").alias("n"))
    raised = totals.select("value", F.pow("n", F.lit(power)).alias("n"))
    return raised.select("value", (F.col("n") / (raised.agg(F.sum("n")).first()[0] or 1.0)).alias("share"))


def with_total(cells: DataFrame, dimension: str, few: bool) -> DataFrame:
    """`cells` with `total`, the weight of all cells of the same value: few, in one partition, by a window; many by partial sums and a join."""
    if few:
        return cells.withColumn("total", F.sum("weight").over(Window.partitionBy(dimension)))
    return cells.join(cells.groupBy(dimension).agg(F.sum("weight").alias("total")), dimension)


def raked(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """`cells` with `weight`: shares that sum to 1 and have each target's marginals.

    A value without a target, or without tokens, has no weight; the targets of a dimension
    are scaled to sum to 1 over the values that occur (a dimension whose targets are all
    zero leaves no cell). A round scales each dimension in turn; it is the last when no
    marginal was off by more than `tolerance` before its scaling. Targets that no weights
    can meet, because of cells that don't occur, don't converge: after `rounds`, or when
    `PATIENCE` stages of rounds don't halve it, a warning says how far they are off.
    """
    known = cells.where("tokens > 0")
    for d, target in targets.items():
        here = staged(known.select(F.col(d).alias("value")).distinct().join(target, "value").where("share > 0"))  # else each dimension's plan would hold those before it twice
        all_ = here.agg(F.sum("share")).first()[0] or 1.0
        known = staged(known.join(here.select(F.col("value").alias(d), (F.col("share") / all_).alias(f"{d}_share")), d))  # so the next dimension's plan holds one join
    parts = 1 + cells.count() // BROADCAST
    known = staged(known.withColumn("weight", F.col("tokens").cast("double")).coalesce(parts))
    seen, at_once = [float("inf")], AT_ONCE if parts == 1 else 1
    while (len(seen) - 1) * at_once < rounds and seen[-1] > tolerance and not (len(seen) > PATIENCE and seen[-1] > seen[-1 - PATIENCE] / 2):
        known = known.coalesce(parts)  # of one partition, windows need no exchange
        for _ in range(at_once):
            known = known.withColumn("off", F.lit(0.0))
            for d in targets:
                total, share = F.col("total"), F.col(f"{d}_share")
                known = with_total(known, d, parts == 1)
                known = known.withColumns({"off": F.greatest("off", F.abs(total - share)), "weight": F.col("weight") * share / total}).drop("total")
        known = staged(known)
        seen.append(known.agg(F.max("off")).first()[0] or 0.0)
        known = known.drop("off")
    if seen[-1] > tolerance:
        warnings.warn(f"raking stopped after {(len(seen) - 1) * at_once} rounds with marginals off by {seen[-1]:.3g}", stacklevel=2)
    return known.drop(*(f"{d}_share" for d in targets))


def probabilities(weighted: DataFrame, budget: float) -> DataFrame:
    """`weighted` with `probability`, at most 1, so that the expected tokens are `budget` of all, or as near as can be.

    Cells that a factor takes beyond 1 are taken whole and the factor of the others grows
    by what they leave, until no further cell is beyond 1.
    """
    ratio, tokens = F.col("weight") / F.col("tokens"), F.col("tokens").cast("double")
    total, rest = weighted.agg(F.sum(tokens), F.sum("weight")).first()
    if not total:
        return weighted.withColumn("probability", F.lit(0.0))
    taken, whole, factor = 0.0, -1, 0.0
    while rest:
        factor = (budget * total - taken) / rest
        full = ratio * factor >= 1
        taken, rest, n = weighted.agg(F.sum(F.when(full, tokens).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count_if(full)).first()
        if n == whole:
            break
        whole = n
    return weighted.withColumn("probability", F.least(F.lit(1.0), ratio * factor) if rest else F.lit(1.0))


def mixed(docs: DataFrame, targets: dict[str, DataFrame | float], budget: float, id_col: str = "doc_id", text_col: str = "text", columns: dict[str, str | Column] | None = None, keep: list[str] = ()) -> DataFrame:
    """Documents sampled so that tokens meet the targets: id, source, lang, topic, tokens, weight, probability, kept (a struct of the columns `keep`).

    `targets` has per dimension a table (value, share) or a power for `tempered`; `columns`
    says what the dimensions are (default: the columns source and lang, and the topic that
    `topic_words` of all texts give). Ties don't arise: a document is judged by itself.
    A null source, language or topic is the value ''. Documents without tokens and those
    whose value has no target are never sampled. Repeated ids are sampled together; null
    ids count as one id. An empty table gives an empty result; other columns are not read.
    """
    columns = {"source": "source", "lang": "lang", "topic": None} | (columns or {})
    if columns["topic"] is None:
        columns["topic"] = topic_of(F.col(text_col), topic_words(docs, text_col))
    dims = [F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).alias(d) for d, c in columns.items()]
    rows = docs.select(F.col(id_col), *dims, token_count(F.col(text_col)).alias("tokens"), *([F.struct(*keep).alias("kept")] if keep else []))
    if not keep:
        rows = staged(rows)  # a few numbers and words a document, so that texts aren't split again
    cells = staged(rows.groupBy(*columns).agg(F.sum("tokens").alias("tokens")))
    tables = {d: t if isinstance(t, DataFrame) else tempered(cells, d, t) for d, t in targets.items()}
    weighted = probabilities(raked(cells, tables), budget).withColumnRenamed("tokens", "cell_tokens")
    weighted = staged(weighted.withColumns({c: F.round(c, 12) for c in ("weight", "probability")}))  # the last bits depend on the order of sums
    released(docs)
    weighted = sized(weighted, BROADCAST)
    joined = rows.where("tokens > 0").join(weighted, list(columns))
    return joined.where(unit_hash(F.col(id_col)) < F.col("probability")).select(id_col, *columns, "tokens", "weight", "probability", *(["kept"] if keep else []))
