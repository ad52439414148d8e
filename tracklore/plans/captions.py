"""Queries over caption texts and datasets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import dataset as ds
from ..operators import ledger as lg
from . import bindings as b
from . import sql


def clips_of(events: DataFrame) -> DataFrame:
    return lg.nested(events)


def token_f1_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs, items = b.table(spark, d, "documents").select("doc_id", "text"), b.table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"))
    return docs.join(items, docs.doc_id % 40 == items.item_id).select("doc_id", "item_id", tx.token_f1(F.col("text"), F.col("item")).alias("token_f1"))


def benchmark_token_f1(spark: SparkSession, d: str) -> DataFrame:
    """Token F1 of each document with every benchmark item that it shares five consecutive words with."""
    docs, items = b.table(spark, d, "documents").select("doc_id", "text"), b.table(spark, d, "benchmark").select("item_id", F.col("text").alias("item_text"))
    pairs = ds.sharing_pairs(docs, items.withColumnRenamed("item_text", "text"), "doc_id", "item_id")
    rows = pairs.join(docs, "doc_id").join(items, "item_id")
    return rows.select("doc_id", "item_id", tx.token_f1(F.col("text"), F.col("item_text")).alias("token_f1"))


def style_text(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "documents").select("doc_id", *(F.sha2(tx.styled(F.col("text"), s), 256).alias(s) for s in tx.STYLE_WORDS))


def time_token_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = b.base(spark, d).select("event_id", tx.time_token(F.col("start_ds")).alias("token"))
    return rows.select("event_id", "token", tx.token_time(F.col("token")).cast("long").alias("back_ds"))


def caption(spark: SparkSession, d: str, make) -> DataFrame:
    return clips_of(b.references(spark, d)).select("sample_id", make(F.col("events")).alias("caption"))


def atomic_caption(spark: SparkSession, d: str) -> DataFrame:
    return caption(spark, d, tx.atomic_caption)


def slot_caption(spark: SparkSession, d: str) -> DataFrame:
    return caption(spark, d, tx.slot_caption)


def xml_caption(spark: SparkSession, d: str) -> DataFrame:
    return caption(spark, d, tx.xml_caption)


def parse_atomic(spark: SparkSession, d: str) -> DataFrame:
    parsed = atomic_caption(spark, d).select("sample_id", tx.parsed_atomic(F.col("caption")).alias("parsed"))
    events = parsed.select("sample_id", F.posexplode(tx.ledger_events(F.col("parsed"))).alias("ord", "e"))
    return events.select("sample_id", F.col("e.id").alias("event_id"), "e.type", "e.text", F.col("e.spans")[0]["start_ds"].cast("long").alias("start_ds"), F.col("e.spans")[0]["end_ds"].cast("long").alias("end_ds"))


def tag_scan_pages(spark: SparkSession, d: str) -> DataFrame:
    tags = b.table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), 1)).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


def keyed(spark: SparkSession, d: str) -> DataFrame:
    sets = lambda df, name: clips_of(df).select("sample_id", ds.event_keys(F.col("events")).alias(name))
    none = F.array().cast("array<string>")
    rows = sets(b.references(spark, d), "gt_keys").join(sets(b.predictions(spark, d), "pred_keys"), "sample_id", "left")
    return rows.withColumn("pred_keys", F.coalesce("pred_keys", none))


def event_key_diff(spark: SparkSession, d: str) -> DataFrame:
    return ds.set_difference(keyed(spark, d)).select("sample_id", "n_correct", "n_halluc", "n_omit", "error_type")


def error_label(spark: SparkSession, d: str) -> DataFrame:
    return ds.set_difference(keyed(spark, d)).groupBy("error_type").agg(F.count("*").alias("n"))


def preference_pairs(spark: SparkSession, d: str) -> DataFrame:
    gt = clips_of(b.references(spark, d)).select("sample_id", tx.slot_caption(F.col("events")).alias("gt_text"))
    pred = clips_of(b.predictions(spark, d)).select("sample_id", tx.slot_caption(F.col("events")).alias("pred_text"))
    rows = keyed(spark, d).join(gt, "sample_id").join(pred, "sample_id")
    return ds.preference_pairs(rows, "gt_keys", "pred_keys", F.col("gt_text"), F.col("pred_text"))


def removal_view(spark: SparkSession, d: str) -> DataFrame:
    """Each clip of two tracks or more without its first track, and the caption that is left."""
    refs = b.references(spark, d)
    tracks = refs.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_set("track_id")), lambda t: F.struct(t.alias("id"))).alias("tracks"))
    clips = clips_of(refs).join(tracks, "sample_id").where(F.size("tracks") > 1).withColumn("removed", F.element_at("tracks", 1)["id"])
    left = ds.without_source(clips, F.col("removed"))
    return left.select("sample_id", "removed", F.size("tracks").cast("long").alias("n_tracks"), F.size("events").cast("long").alias("n_events"), tx.atomic_caption(F.col("events")).alias("caption"))


def paths(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "conversations").groupBy("conv_id").agg(ds.group_key(F.collect_set(F.concat_ws("/", "role", F.col("turn").cast("string")))).alias("group_key"))


def group_key_sha1(spark: SparkSession, d: str) -> DataFrame:
    return paths(spark, d)


def group_split(spark: SparkSession, d: str) -> DataFrame:
    rows = b.table(spark, d, "documents").select("doc_id", "source")
    return ds.group_split(rows, "source", 0.2, "split-1").select("doc_id", "source", "split")


def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return ds.hash_split(b.table(spark, d, "documents").select("doc_id", "source"), "source", 0.25, "split-2")


def weighted_template(spark: SparkSession, d: str) -> DataFrame:
    rows = b.table(spark, d, "conversations").select("conv_id").distinct()
    return ds.weighted_choice(rows, "conv_id", {"dialogue": 3.0, "music_bed": 2.0, "street": 1.0}, "templates-1")


def topk_per_stratum(spark: SparkSession, d: str) -> DataFrame:
    rows = b.table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_extendedprice")
    top = ds.top_per_stratum(rows, ["l_returnflag", "l_linestatus"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 5)
    return top.withColumn("rank", F.col("rank").cast("long"))


def review_sheet(spark: SparkSession, d: str) -> DataFrame:
    rows = ds.set_difference(keyed(spark, d)).select("sample_id", (F.col("error_type") != "correct").alias("has_error"))
    rows = rows.join(b.references(spark, d).groupBy("sample_id").agg(F.min("type").alias("template")), "sample_id")
    return ds.review_sheet(rows, "template", "has_error", "sample_id", "review-1").select("sample_id", "template", "has_error", F.col("rank").cast("long").alias("rank"))


def data_card(spark: SparkSession, d: str) -> DataFrame:
    refs = b.references(spark, d)
    return ds.data_card(b.clips(refs), refs).withColumns({c: F.col(c).cast("long") for c in ("min_duration_ds", "max_duration_ds")})


def canonical_order(spark: SparkSession, d: str) -> DataFrame:
    rows = clips_of(b.references(spark, d)).select("sample_id", F.posexplode(tx.ordered(F.col("events"))).alias("pos", "e"))
    return rows.select("sample_id", F.col("pos").cast("long").alias("pos"), F.col("e.id").alias("event_id"))


def positional_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids E001.. in time order, and a track number per type by first appearance."""
    rows = b.references(spark, d).select("sample_id", "event_id", "type", "ord", F.col("spans")[0]["start_ds"].alias("start"))
    order = Window.partitionBy("sample_id").orderBy("start", "ord")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("first_seen", F.min("n").over(Window.partitionBy("sample_id", "type")))
    dense = F.dense_rank().over(Window.partitionBy("sample_id").orderBy("first_seen"))
    return rows.select("sample_id", "event_id", F.format_string("E%03d", "n").alias("new_id"), F.concat(F.lit("T"), dense.cast("string")).alias("track"))


def label_confusion(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "labels").groupBy("quality").pivot("toxic", [0, 1]).count().na.fill(0).select("quality", F.col("0").alias("clean"), F.col("1").alias("toxic"))


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Counts of events whose value reaches each of seven thresholds, in one pass."""
    steps = F.array(*(F.lit(t) for t in (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7)))
    rows = b.table(spark, d, "events").select("event_type", "value", F.explode(steps).alias("threshold"))
    return rows.groupBy("threshold", "event_type").agg(F.count_if(F.col("value") >= F.col("threshold")).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        token_f1_pairs, benchmark_token_f1, style_text, time_token_roundtrip, atomic_caption, slot_caption, xml_caption, parse_atomic, tag_scan_pages, event_key_diff, error_label, preference_pairs, removal_view,
        group_key_sha1, group_split, hash_split, weighted_template, topk_per_stratum, review_sheet, data_card, canonical_order, positional_ids, label_confusion, threshold_sweep,
    )
}

WORDS = "list_filter(string_split_regex({0}, '[\\s\\x{{a0}}]+'), lambda w: w <> '')"
RANK = "CASE type WHEN 'speech' THEN 0 WHEN 'lys' THEN 1 WHEN 'music' THEN 2 ELSE 3 END"
TOKEN = "'<|t_' || lpad(CAST(greatest(0, least(300, {0})) AS VARCHAR), 3, '0') || '|>'"
ONE = f"'<' || type || '>' || {TOKEN.format('start_ds')} || text || {TOKEN.format('end_ds')} || '</' || type || '>'"
SECONDS = "CAST({0} // 10 AS VARCHAR) || CASE WHEN {0} % 10 = 0 THEN '' ELSE '.' || ({0} % 10) END"
XML = f"'<' || type || ' t=\"' || {SECONDS.format('start_ds')} || '-' || {SECONDS.format('end_ds')} || '\" confidence=\"0.9\" track=\"' || track_id || '\">' || text || '</' || type || '>'"
KEYS = f"""WITH {sql.BOTH}, g AS (SELECT DISTINCT sample_id, type || ':' || start_ds || ':' || end_ds AS k FROM refs), p AS (SELECT DISTINCT sample_id, type || ':' || start_ds || ':' || end_ds AS k FROM hyps WHERE sample_id IN (SELECT sample_id FROM refs)),
j AS (SELECT coalesce(g.sample_id, p.sample_id) AS sample_id, g.k AS gk, p.k AS pk FROM g FULL JOIN p ON g.sample_id = p.sample_id AND g.k = p.k),
n AS (SELECT sample_id, count(*) FILTER (gk = pk) AS n_correct, count(*) FILTER (gk IS NULL) AS n_halluc, count(*) FILTER (pk IS NULL) AS n_omit FROM j GROUP BY ALL),
diff AS (SELECT *, CASE WHEN n_halluc = 0 AND n_omit = 0 THEN 'correct' WHEN n_omit = 0 THEN 'hallucination' WHEN n_halluc = 0 THEN 'omission' ELSE 'mixed' END AS error_type FROM n)"""
UNIT = "CAST(('0x' || substr(md5('{0}:' || {1}), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE"
SLOTS = f"'<n>' || count(*) || '</n>' || string_agg('<slot>' || {ONE} || '</slot>', '' ORDER BY start_ds, {RANK}, event_id)"

ORACLES = {
    "token_f1_pairs": f"""WITH w AS (SELECT doc_id, item_id, list_distinct({WORDS.format('lower(d.text)')}) AS x, list_distinct({WORDS.format('lower(b.text)')}) AS y FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id),
n AS (SELECT doc_id, item_id, len(x) AS nx, len(y) AS ny, len(list_intersect(x, y)) AS k FROM w)
SELECT doc_id, item_id, CASE WHEN nx = 0 AND ny = 0 THEN 1.0::DOUBLE WHEN k = 0 THEN 0.0::DOUBLE ELSE round(2.0::DOUBLE * k / (nx + ny), 6) END AS token_f1 FROM n""",
    "benchmark_token_f1": f"""WITH dw AS (SELECT doc_id, {WORDS.format('lower(text)')} AS w FROM documents), bw AS (SELECT item_id, {WORDS.format('lower(text)')} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)), bs AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM bw)),
pairs AS (SELECT DISTINCT doc_id, item_id FROM ds JOIN bs USING (s)), n AS (SELECT p.doc_id, p.item_id, len(list_distinct(dw.w)) AS nx, len(list_distinct(bw.w)) AS ny, len(list_intersect(list_distinct(dw.w), list_distinct(bw.w))) AS k FROM pairs p JOIN dw USING (doc_id) JOIN bw USING (item_id))
SELECT doc_id, item_id, round(2.0::DOUBLE * k / (nx + ny), 6) AS token_f1 FROM n""",
    "style_text": f"WITH w AS (SELECT doc_id, text, {WORDS.format('text')} AS w FROM documents) SELECT doc_id, "
    + ", ".join(f"sha256(CASE WHEN len(w) <= {n} THEN text ELSE array_to_string(w[1:{n}], ' ') || '…' END) AS {s}" for s, n in tx.STYLE_WORDS.items())
    + " FROM w",
    "time_token_roundtrip": f"WITH {sql.BASE} SELECT event_id, {TOKEN.format('start_ds')} AS token, greatest(0, least(300, start_ds)) AS back_ds FROM based",
    "atomic_caption": f"WITH {sql.REFS} SELECT sample_id, string_agg({ONE}, '' ORDER BY start_ds, {RANK}, event_id) AS caption FROM refs GROUP BY ALL",
    "slot_caption": f"WITH {sql.REFS} SELECT sample_id, {SLOTS} AS caption FROM refs GROUP BY ALL",
    "xml_caption": f"WITH {sql.REFS} SELECT sample_id, string_agg({XML}, chr(10) ORDER BY start_ds, {RANK}, event_id) AS caption FROM refs GROUP BY ALL",
    "parse_atomic": f"WITH {sql.REFS} SELECT sample_id, 'E' || lpad(CAST(row_number() OVER (PARTITION BY sample_id ORDER BY start_ds, {RANK}, event_id) AS VARCHAR), 3, '0') AS event_id, type, text, start_ds, end_ds FROM refs WHERE end_ds > start_ds",
    "tag_scan_pages": "SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL",
    "event_key_diff": f"{KEYS} SELECT sample_id, n_correct, n_halluc, n_omit, error_type FROM diff",
    "error_label": f"{KEYS} SELECT error_type, count(*) AS n FROM diff GROUP BY ALL",
    "preference_pairs": f"{KEYS}, c AS (SELECT sample_id, {SLOTS} AS t FROM refs GROUP BY ALL), r AS (SELECT sample_id, {SLOTS} AS t FROM hyps GROUP BY ALL) "
    "SELECT d.sample_id, c.t AS chosen, r.t AS rejected FROM diff d JOIN c ON c.sample_id = d.sample_id JOIN r ON r.sample_id = d.sample_id WHERE error_type <> 'correct'",
    "removal_view": f"WITH {sql.REFS}, f AS (SELECT sample_id, min(track_id) AS removed, count(DISTINCT track_id) - 1 AS n_tracks FROM refs GROUP BY ALL HAVING count(DISTINCT track_id) > 1) "
    f"SELECT r.sample_id, removed, n_tracks, count(*) AS n_events, string_agg({ONE}, '' ORDER BY start_ds, {RANK}, event_id) AS caption FROM refs r JOIN f ON r.sample_id = f.sample_id WHERE track_id <> removed GROUP BY ALL",
    "group_key_sha1": "SELECT conv_id, substr(sha1(array_to_string(list_sort(list(DISTINCT role || '/' || turn)), '|')), 1, 12) AS group_key FROM conversations GROUP BY ALL",
    "group_split": f"WITH g AS (SELECT source, row_number() OVER (ORDER BY {UNIT.format('split-1', 'source')}) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) "
    "SELECT doc_id, d.source, CASE WHEN r <= greatest(1, round_even(n * 0.2::DOUBLE, 0)) THEN 'val' ELSE 'train' END AS split FROM documents d JOIN g ON d.source = g.source",
    "hash_split": f"SELECT doc_id, source, CASE WHEN {UNIT.format('split-2', 'source')} < 0.25::DOUBLE THEN 'val' ELSE 'train' END AS split FROM documents",
    "weighted_template": f"SELECT conv_id, CASE WHEN u < 0.5::DOUBLE THEN 'dialogue' WHEN u < 0.5::DOUBLE + 2.0::DOUBLE / 6.0::DOUBLE THEN 'music_bed' ELSE 'street' END AS choice FROM (SELECT conv_id, {UNIT.format('templates-1', 'conv_id')} AS u FROM (SELECT DISTINCT conv_id FROM conversations))",
    "topk_per_stratum": "SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem QUALIFY rank <= 5",
    "review_sheet": f"{KEYS}, t AS (SELECT sample_id, min(type) AS template FROM refs GROUP BY ALL), k AS (SELECT d.sample_id, template, error_type <> 'correct' AS has_error, {UNIT.format('review-1', 'd.sample_id')} AS u FROM diff d JOIN t ON t.sample_id = d.sample_id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY template, has_error ORDER BY u, sample_id) AS rank FROM k) SELECT sample_id, template, has_error, rank FROM r WHERE rank <= CASE WHEN has_error THEN 2 ELSE 3 END ORDER BY has_error DESC, template, rank, sample_id LIMIT 50",
    "data_card": f"WITH {sql.REFS}, n AS (SELECT sample_id, count(*) AS n FROM refs GROUP BY ALL) SELECT count(*) AS n_clips, 300 AS min_duration_ds, 300 AS max_duration_ds, min(n) AS min_events, max(n) AS max_events, round(avg(n), 6) AS mean_events FROM n",
    "canonical_order": f"WITH {sql.REFS} SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY start_ds, {RANK}, event_id) - 1 AS pos, event_id FROM refs",
    "positional_ids": f"WITH {sql.REFS}, n AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY start_ds, ord) AS n FROM refs), f AS (SELECT *, min(n) OVER (PARTITION BY sample_id, type) AS s FROM n) "
    "SELECT sample_id, event_id, 'E' || lpad(CAST(n AS VARCHAR), 3, '0') AS new_id, 'T' || dense_rank() OVER (PARTITION BY sample_id ORDER BY s) AS track FROM f",
    "label_confusion": "SELECT quality, count(*) FILTER (toxic = 0) AS clean, count(*) FILTER (toxic = 1) AS toxic FROM labels GROUP BY ALL",
    "threshold_sweep": "SELECT t AS threshold, event_type, count(*) FILTER (value >= t) AS n FROM events, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]::DOUBLE[]) AS t) GROUP BY ALL",
}
