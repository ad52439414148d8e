"""Ledgers of real mixes as table work: kinds, spans with a default, files by category, answers in prose, and captioners."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals as iv
from . import stems

#: Fixed value: a source below this RMS isn't heard in its mix.
PRESENT = 0.001


def kind_of(label: Column) -> Column:
    """music and speech stay, all else, null too, is sfx."""
    return F.when(label.isin("music", "speech"), label).otherwise("sfx")


def present(wave: Column) -> Column:
    """Whether a source can be heard in its mix."""
    return stems.loudness(F.coalesce(wave, F.array().cast("array<double>"))) > PRESENT


def containing(clips: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """The clips of which a source is of one of the kinds; `clips` has sources with a kind."""
    return clips.where(F.exists("sources", lambda s: s["kind"].isin(*kinds)))


def spans_or_whole(spans: Column, duration_ds: Column, gap: int = 1) -> Column:
    """Spans with gaps below `gap` tenths closed; without any the whole clip."""
    joined = lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(iv.span(F.lit(0), duration_ds)))
    return iv.let(iv.merged(spans, gap), joined)


def remapped(label: Column, names: dict[str, str]) -> Column:
    """A label by the table of names; what isn't in it stays."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[label], label) if names else label


def chosen_files(requests: DataFrame, files: DataFrame, key: str, category: str, path: str, seed: str) -> DataFrame:
    """`requests` with a file of their category, picked by the hash of their key; null where the category has none.

    Files are numbered within their category by path, and each request asks for one number,
    so no request meets all files of a category.
    """
    numbered = files.select(F.col(category).alias("c__"), path, (F.row_number().over(Window.partitionBy(category).orderBy(path)) - 1).alias("n__"))
    counts = numbered.groupBy("c__").agg(F.count("*").alias("of__"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), 1, 13), 16, 10).cast("long")
    asked = requests.join(counts, requests[category] == counts.c__, "left").withColumn("ask__", draw % F.col("of__")).drop("c__", "of__")
    found = asked.join(numbered, (asked[category] == numbered.c__) & (asked["ask__"] == numbered.n__), "left")
    return found.drop("c__", "n__", "ask__")


def json_in(text: Column, schema: str) -> Column:
    """The JSON object in a text, from its first brace to its last; null if there is none or it can't be read."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)


def bounded(value: Column, low: float, high: float) -> Column:
    """A number moved into low to high; null stays."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def relative_path(path: Column, base: str) -> Column:
    """A path without the folder `base` in front; others stay as they are."""
    folder = base.rstrip("/") + "/"
    return F.when(path.startswith(folder), F.substring(path, len(folder) + 1, 1 << 30)).otherwise(path)


def captioned(clips: DataFrame, make: Callable[[], Callable[[pd.DataFrame], list[str]]], out: str = "raw_text") -> DataFrame:
    """`clips` with what a captioner writes, and `error` where it failed.

    `make` is called once a task and gives a function from a batch of rows to a text per
    row, so that a model is loaded where it runs. A batch that fails is tried row by row;
    a row that fails has a null text and the reason, and the job goes on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caption = make()
        for rows in batches:
            try:
                texts, errors = list(caption(rows)), [None] * len(rows)
            except Exception:  # noqa: BLE001  the captioner is someone else's
                texts, errors = [], []
                for i in range(len(rows)):
                    try:
                        texts.append(caption(rows.iloc[i : i + 1])[0])
                        errors.append(None)
                    except Exception as fault:  # noqa: BLE001
                        texts.append(None)
                        errors.append(f"{type(fault).__name__}: {fault}"[:200])
            yield rows.assign(**{out: texts, "error": errors})

    from pyspark.sql.types import StringType, StructField, StructType

    return clips.mapInPandas(run, StructType([*clips.schema, StructField(out, StringType()), StructField("error", StringType())]))
