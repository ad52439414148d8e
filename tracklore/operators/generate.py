"""Synthetic clips: seeded scenes, rendering, degradation, validation by replay.

A scene follows from its id and seed alone: every number comes from a hash, so any task
makes the same scene, and a render can be checked by making it again. The samples are
made with numpy, a clip per row; the draw order of other generators isn't reproduced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intervals as iv
from .dataset import uniform

RATE = 8000
#: Templates of scenes: the kinds of sources that they place.
TEMPLATES = {
    "single_speech": ["speech"], "dialogue": ["speech", "speech"], "speech_over_music": ["speech", "music"], "song": ["vocal", "music"], "street": ["ambience", "sfx", "sfx"],
    "music_bed": ["music"], "busy": ["speech", "music", "sfx", "sfx"], "crowd": ["speech", "speech", "speech"], "ambience_only": ["ambience"], "alarm": ["sfx"], "concert": ["vocal", "music", "ambience"], "silence": [],
}
FADE_S = {"music": 1.5, "ambience": 1.5, "speech": 0.05, "vocal": 0.05, "sfx": 0.05}


def scenes(ids: DataFrame, seed: int = 0, duration_ds: int = 100) -> DataFrame:
    """Per `ids(scene_id)`: template and sources (source_id, kind, onset_ds, length_ds, gain_db), all by hash."""
    u = lambda *key: uniform(F.concat_ws("/", F.col("scene_id").cast("string"), *key), f"scene-{seed}")
    names = F.array(*map(F.lit, TEMPLATES))
    kinds = F.create_map(*(x for k, v in TEMPLATES.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    rows = ids.withColumn("template", F.element_at(names, (F.floor(u(F.lit("template")) * len(TEMPLATES)) + 1).cast("int")))

    def source(kind: Column, i: Column) -> Column:
        n = i.cast("string")
        steady = kind.isin("music", "ambience")
        onset = F.when(steady, 0).otherwise(F.floor(u(F.lit("on"), n) * (duration_ds - 10)))
        length = F.when(steady, duration_ds).otherwise(F.least(F.floor(u(F.lit("len"), n) * 40) + 5, F.lit(duration_ds) - onset))
        gain = F.round(-12 * u(F.lit("gain"), n), 2)
        return F.struct(F.concat(F.lit("S"), (i + 1).cast("string")).alias("source_id"), kind.alias("kind"), onset.cast("int").alias("onset_ds"), length.cast("int").alias("length_ds"), gain.alias("gain_db"))

    return rows.select("scene_id", "template", F.lit(duration_ds).alias("duration_ds"), F.transform(kinds[F.col("template")], source).alias("sources"))


def target_events(scene: DataFrame) -> DataFrame:
    """Events and tracks of scenes from their placements, in time order."""
    from ..operators.ledger import type_of_kind

    rows = scene.select("scene_id", F.posexplode("sources").alias("pos", "s"))
    return rows.select(
        F.col("scene_id").cast("string").alias("sample_id"), F.concat(F.lit("E"), F.lpad((F.col("pos") + 1).cast("string"), 3, "0")).alias("event_id"), F.col("pos").alias("ord"), type_of_kind(F.col("s.kind")).alias("type"),
        F.concat(F.lit("T"), (F.col("pos") + 1).cast("string")).alias("track_id"), F.col("s.kind").alias("text"), F.lit(0.9).alias("confidence"), F.array(iv.span(F.col("s.onset_ds"), F.col("s.onset_ds") + F.col("s.length_ds"))).alias("spans"),
    )


def tone(kind: str, n: int, seed: int) -> np.ndarray:
    """n samples of a synthetic source."""
    r = np.random.default_rng(seed)
    t = np.arange(n) / RATE
    if kind == "music":
        chord = 220 * 2 ** (r.integers(0, 12, 3) / 12)
        return np.sin(2 * np.pi * chord[:, None] * t).mean(axis=0) * 0.5
    if kind in ("speech", "vocal"):
        pitch = r.uniform(100, 240)
        return np.sin(2 * np.pi * pitch * t + 3 * np.sin(2 * np.pi * 5 * t)) * (0.4 + 0.3 * np.sin(2 * np.pi * 3 * t))
    noise = r.standard_normal(n)
    return 0.05 * noise if kind == "ambience" else noise * np.exp(-t * 6) * 0.4


def reverb(wave: np.ndarray, t60: float, seed: int) -> np.ndarray:
    """Convolution with decaying noise through the frequency domain, at the input's peak."""
    n = max(1, int(t60 * RATE))
    room = np.random.default_rng(seed).standard_normal(n) * 10 ** (-3 * np.arange(n) / n)
    size = 1 << (len(wave) + n - 2).bit_length()
    wet = np.fft.irfft(np.fft.rfft(wave, size) * np.fft.rfft(room / np.abs(room).sum(), size), size)[: len(wave)]
    return wet * (np.abs(wave).max() / max(np.abs(wet).max(), 1e-9)) if len(wave) else wet


def ducked(bed: np.ndarray, front: np.ndarray, db: float = 3.5) -> np.ndarray:
    """The bed lowered where the front is active, smoothed over ten steps of 50 ms."""
    hop = RATE // 20
    level = np.sqrt(np.add.reduceat(front**2, np.arange(0, len(front), hop)) / hop)
    gain = np.where(level > 0.01, 10 ** (-db / 20), 1.0)
    smooth = np.convolve(gain, np.ones(10) / 10)[: len(gain)]
    return bed * np.repeat(smooth, hop)[: len(bed)]


def render(scene_id, sources: list[dict], duration_ds: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The mixture of a scene, at most 0.99, and its stems."""
    n = duration_ds * RATE // 10
    stems = {}
    for s in sources:
        seed = int(hashlib.sha256(f"{scene_id}:{s['source_id']}".encode()).hexdigest()[:8], 16)
        wave = tone(s["kind"], s["length_ds"] * RATE // 10, seed) * 10 ** (s["gain_db"] / 20)
        k = min(int(FADE_S[s["kind"]] * RATE), len(wave) // 2)
        if k:
            edge = np.linspace(0, 1, k)
            wave[:k] *= edge
            wave[-k:] *= edge[::-1]
        stem, start = np.zeros(n), s["onset_ds"] * RATE // 10
        stem[start : start + len(wave)] = wave[: n - start]
        stems[s["source_id"]] = stem
    dry = sum(stems.values(), np.zeros(n))
    top = np.abs(dry).max() if n else 0
    return (dry * 0.99 / top if top > 0.99 else dry), stems


def digest(wave: np.ndarray) -> str:
    return hashlib.sha256(np.asarray(wave, np.float32).tobytes()).hexdigest()[:16]


def rendered(scene: DataFrame) -> DataFrame:
    """Per scene what its render measures: samples, peak, RMS, hashes of the mixture and of each stem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                sources = [s.asDict() if hasattr(s, "asDict") else dict(s) for s in row.sources]
                mix, stems = render(row.scene_id, sources, row.duration_ds)
                out.append((row.scene_id, len(mix), float(np.abs(mix).max(initial=0)), float(np.sqrt((mix**2).mean())), digest(mix), {k: digest(v) for k, v in stems.items()}))
            yield pd.DataFrame(out, columns=["scene_id", "n_samples", "peak", "rms", "mixture_hash", "stem_hashes"])

    kind = scene.schema["scene_id"].dataType.simpleString()
    return scene.mapInPandas(run, f"scene_id {kind}, n_samples long, peak double, rms double, mixture_hash string, stem_hashes map<string,string>")


def validated(manifest: DataFrame) -> DataFrame:
    """One row of counters: clips of `manifest(scene_id, sources, duration_ds, mixture_hash)` and those whose replay has the same hash."""
    again = rendered(manifest.select("scene_id", "sources", "duration_ds")).select("scene_id", F.col("mixture_hash").alias("replayed"))
    return manifest.join(again, "scene_id").agg(F.count("*").alias("n_clips"), F.count_if(F.col("mixture_hash") == F.col("replayed")).alias("n_replayed"), F.count_if(F.col("mixture_hash") != F.col("replayed")).alias("n_failed"))


def degraded(events: DataFrame, seed: str = "mock-1", omit: float = 0.1, shift: float = 0.5, retrack: float = 0.05, invent: float = 0.1) -> DataFrame:
    """Predictions as a weak captioner would make them, by the hash of each event: omitted,
    shifted by up to 0.3 s, pointed at another track, and invented ones."""
    u = lambda what: uniform(F.concat_ws("/", "sample_id", "event_id", F.lit(what)), seed)
    by = F.when(u("shift") < shift, F.round(u("by") * 6 - 3)).otherwise(0).cast("int")
    moved = lambda s: iv.span(F.greatest(F.lit(0), s["start_ds"] + by), F.greatest(F.greatest(F.lit(0), s["start_ds"] + by) + 1, s["end_ds"] + by))
    kept = events.where(u("omit") >= omit).withColumn("spans", F.transform("spans", moved)).withColumn("track_id", F.when(u("track") < retrack, F.lit("T9")).otherwise(F.col("track_id")))
    extra = events.where(u("invent") < invent).withColumn("event_id", F.concat("event_id", F.lit("9"))).withColumn("spans", F.array(iv.span(F.floor(u("at") * 280), F.floor(u("at") * 280) + 10))).withColumn("text", F.lit("invented event"))
    return kept.unionByName(extra)
