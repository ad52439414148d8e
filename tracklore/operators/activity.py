"""Activity of a waveform column: short-time RMS, mask, spans; and simple array effects.

Waveforms are array<double>; each function is a Column expression over one row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import intervals as iv

THRESHOLD, MERGE_DS = 0.05, 3  # share of the peak; gaps below 0.25 s are whole tenths below 3


@iv.bound
def frame_rms(wave: Column, hop: int) -> Column:
    """Root mean square of each whole frame of `hop` samples; a rest at the end is dropped."""
    n = F.floor(F.size(wave) / hop).cast("int")
    one = lambda i: F.sqrt(F.aggregate(F.slice(wave, i * hop + 1, F.lit(hop)), F.lit(0.0), lambda s, x: s + x * x) / hop)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<double>"))


@iv.bound
def windowed_rms(wave: Column, hop: int, window: int) -> Column:
    """RMS of `window` samples around each hop, cut at the ends."""
    n = F.ceil(F.size(wave) / hop).cast("int")

    def one(i: Column) -> Column:
        start = F.greatest(F.lit(0), i * hop - window // 2)
        part = F.slice(wave, start + 1, F.least(F.size(wave), i * hop + (window - window // 2)) - start)
        return F.sqrt(F.aggregate(part, F.lit(0.0), lambda s, x: s + x * x) / F.size(part))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<double>"))


@iv.bound
def active(rms: Column, continuous: bool = False, threshold: float = THRESHOLD) -> Column:
    """Flags of the frames above the threshold; a continuous source has a floor just above silence."""
    peak = F.coalesce(F.array_max(rms), F.lit(0.0))
    level = lambda top: F.greatest(F.lit(1e-6), top * 1e-4) if continuous else top * threshold
    return iv.let(peak, lambda top: F.transform(rms, lambda x: (x > level(top)) & (top > 0)))


@iv.bound
def coarser(mask: Column, ratio: int) -> Column:
    """One flag per `ratio` frames: whether any is set."""
    n = F.ceil(F.size(mask) / ratio).cast("int")
    one = lambda i: F.exists(F.slice(mask, i * ratio + 1, F.lit(ratio)), lambda x: x)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<boolean>"))


@iv.bound
def padded(mask: Column, n: Column) -> Column:
    """The mask cut or filled up with unset flags to n."""
    missing = F.greatest(n - F.size(mask), F.lit(0))
    return F.slice(F.concat(mask, F.array_repeat(F.lit(False), missing)), F.lit(1), n)


def activity_spans(wave: Column, hop: int, ratio: int, n: Column, continuous: bool = False, threshold: float = THRESHOLD, gap: int = MERGE_DS) -> Column:
    """Spans, in frames of `ratio` hops, in which a waveform is active; gaps below `gap` are closed."""
    mask = padded(coarser(active(frame_rms(wave, hop), continuous, threshold), ratio), n)
    return F.filter(iv.merged(iv.runs(mask), gap), lambda s: s["end_ds"] > s["start_ds"])


def gained(wave: Column, db: Column | float) -> Column:
    factor = F.pow(F.lit(10.0), F.lit(db) / 20 if not isinstance(db, Column) else db / 20)
    return F.transform(wave, lambda x: x * factor)


@iv.bound
def faded(wave: Column, n: int) -> Column:
    """Linear fade over the first and last n samples, of at most half the length."""
    size = F.size(wave)
    k = F.least(F.lit(n), F.floor(size / 2).cast("int"))
    edge = lambda i: F.least(F.lit(1.0), F.when(k > 0, i / k).otherwise(1.0), F.when(k > 0, (size - 1 - i) / k).otherwise(1.0))
    return F.transform(wave, lambda x, i: x * edge(i))


@iv.bound
def repeated(wave: Column, times: int, gap: int) -> Column:
    """The waveform `times` over with `gap` zeros between."""
    silence = F.array_repeat(F.lit(0.0), gap)
    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(times)), lambda i: F.when(i < times, F.concat(wave, silence)).otherwise(wave)))


@iv.bound
def echoed(wave: Column, delay: int, db: float) -> Column:
    """The waveform and, `delay` samples later, itself at a gain of `db`; its length stays."""
    late = F.slice(F.concat(F.array_repeat(F.lit(0.0), delay), gained(wave, db)), F.lit(1), F.size(wave))
    return F.zip_with(wave, late, lambda a, b: a + b)


def placed(wave: Column, onset: Column | int, size: Column | int) -> Column:
    """The waveform from `onset` on in `size` samples of silence; what is beyond is cut."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    head = F.concat(F.array_repeat(F.lit(0.0), lit(onset)), wave)
    return F.slice(F.concat(head, F.array_repeat(F.lit(0.0), F.greatest(lit(size) - F.size(head), F.lit(0)))), F.lit(1), lit(size))


@iv.bound
def summed(waves: Column) -> Column:
    """Sum, sample by sample, of an array of waveforms, as long as the shortest."""
    n = F.array_min(F.transform(waves, F.size))
    return F.when(F.size(waves) > 0, F.transform(F.slice(F.get(waves, F.lit(0)), F.lit(1), n), lambda _, i: F.aggregate(waves, F.lit(0.0), lambda s, w: s + F.get(w, i))))


def peak(wave: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(wave, F.abs)), F.lit(0.0))


@iv.bound
def guarded(wave: Column, most: float = 0.99) -> Column:
    """The waveform scaled so that no sample exceeds `most`; unchanged if none does."""
    return iv.let(peak(wave), lambda top: F.when(top > most, F.transform(wave, lambda x: x * most / top)).otherwise(wave))


@iv.bound
def smoothed(wave: Column, taps: int = 10) -> Column:
    """Mean of each sample and the `taps` - 1 before it; before the start are zeros."""
    return F.transform(wave, lambda _, i: F.aggregate(F.slice(wave, F.greatest(i - taps + 2, F.lit(1)), F.least(i + 1, F.lit(taps))), F.lit(0.0), lambda s, x: s + x) / taps)
