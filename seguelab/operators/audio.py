"""Audio features of files, by NumPy in one Arrow batch function, and their derived scores as column arithmetic.

Beat tracking, harmonic separation and constant-Q chroma are approximated by
onset autocorrelation, median-free spectral flatness and folded spectra: values
are comparable among files analysed here, not with those of other tools.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import key_profiles
from ..functions.text import analysis_signature
from ..functions.values import clip, min_max
from .relations import is_temporary

FRAME, HOP = 2048, 512
BASES = "tempo key mode loudness rms spectral_centroid spectral_bandwidth spectral_flatness spectral_rolloff zcr onset_strength harmonic_ratio mfcc1 mfcc2 mfcc3 mfcc4 mfcc5".split()
INTRO = "attack_time_s rise_slope onset_density flux_peak beat_stability pad_silence_s downbeat_strength chroma_stability".split()
OUTRO = "release_time_s decay_slope abruptness onset_density flux_peak beat_stability tail_silence_s downbeat_strength chroma_stability".split()
COLUMNS = [f"{p}{b}" for p in ("", "intro_", "outro_") for b in BASES] + [f"intro_{c}" for c in INTRO] + [f"outro_{c}" for c in OUTRO] + ["intro_seconds_used", "outro_seconds_used", "intro_leading_silence_s", "outro_trailing_silence_s"]
SCHEMA = "video_id string, path string, status string, " + ", ".join(f"{c} double" for c in COLUMNS)


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 and their rate."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = np.frombuffer(w.readframes(w.getnframes()), {1: np.uint8, 2: np.int16, 4: np.int32}[width])
    y = (raw.astype(np.float64) - 128) / 128 if width == 1 else raw / float(2 ** (8 * width - 1))
    return y.reshape(-1, channels).mean(axis=1), rate


def frames(y: np.ndarray) -> np.ndarray:
    y = np.pad(y, (0, max(FRAME - len(y), 0)))
    return np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]


def unit_range(x: np.ndarray) -> np.ndarray:
    low, high = x.min(initial=np.inf), x.max(initial=-np.inf)
    return (x - low) / (high - low) if high > low else np.zeros_like(x)


def loud_spans(y: np.ndarray, top_db: float) -> np.ndarray:
    """Sample ranges that are less than ``top_db`` below the loudest frame."""
    rms = np.sqrt((frames(y) ** 2).mean(axis=1))
    loud = 20 * np.log10(np.maximum(rms, 1e-10) / max(rms.max(initial=0), 1e-10)) > -top_db
    edge = np.flatnonzero(np.diff(np.concatenate([[0], loud.astype(int), [0]])))
    return np.minimum(edge.reshape(-1, 2) * HOP, len(y))


def gather_loud(y: np.ndarray, spans: np.ndarray, samples: int, from_start: bool) -> np.ndarray:
    """The first or last so many samples of the loud ranges; of the whole where there are none."""
    if samples <= 0:
        return y[:0]
    kept = np.concatenate([y[a:b] for a, b in spans]) if len(spans) else y
    return kept[:samples] if from_start else kept[max(len(kept) - samples, 0) :]


def estimate_key(chroma: np.ndarray) -> tuple[int, int]:
    """The best key and mode of 24 profiles; major, then the lower key, of equals."""
    score = key_profiles() @ (chroma / (np.linalg.norm(chroma) + 1e-9))
    flat = score[::-1].T.ravel()  # by key, major first
    best = int(np.argmax(flat))
    return best // 2, 1 - best % 2


def _spectrum(y: np.ndarray, rate: int):
    s = np.abs(np.fft.rfft(frames(y) * np.hanning(FRAME), axis=1))
    return s, np.fft.rfftfreq(FRAME, 1 / rate)


def _onsets(s: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.maximum(np.diff(np.log1p(s), axis=0), 0).mean(axis=1)])


def _tempo(onset: np.ndarray, rate: int) -> float:
    x = onset - onset.mean()
    a = np.correlate(x, x, "full")[len(x) - 1 :]
    lag = np.arange(1, len(a))
    bpm = 60 * rate / HOP / lag if len(lag) else np.zeros(0)
    ok = (bpm >= 40) & (bpm <= 220)
    return float(bpm[ok][np.argmax(a[1:][ok] * np.exp(-0.5 * (np.log2(bpm[ok] / 120)) ** 2))]) if ok.any() else 0.0


def _chroma(s: np.ndarray, f: np.ndarray) -> np.ndarray:
    ok = f > 27.5
    place = np.round(12 * np.log2(f[ok] / 440) + 9).astype(int) % 12
    return np.stack([s[:, ok][:, place == k].sum(axis=1) for k in range(12)], axis=1)


def segment_features(y: np.ndarray, rate: int, prefix: str = "") -> dict[str, float]:
    s, f = _spectrum(y, rate)
    power, total = s**2, np.maximum(s.sum(axis=1), 1e-12)
    center = (s * f).sum(axis=1) / total
    flat = np.exp(np.log(power + 1e-10).mean(axis=1)) / (power.mean(axis=1) + 1e-10)
    rolled = f[np.argmax(np.cumsum(s, axis=1) >= 0.85 * total[:, None], axis=1)]
    rms = float(np.sqrt((frames(y) ** 2).mean(axis=1)).mean())
    key, mode = estimate_key(_chroma(s, f).mean(axis=0))
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), 42) / 2595) - 1)
    bands = np.stack([power[:, (f >= a) & (f < b)].sum(axis=1) for a, b in zip(edges[:-1], edges[1:], strict=True)], axis=1)
    db = 10 * np.log10(np.maximum(bands.mean(axis=0), 1e-10))
    mfcc = [float((db * np.cos(np.pi * k * (np.arange(41) + 0.5) / 41)).sum() * np.sqrt((1 if k == 0 else 2) / 41)) for k in range(5)]
    onset = _onsets(s)
    values = [_tempo(onset, rate), key, mode, 20 * np.log10(max(rms, 1e-5)), rms, center.mean(), np.sqrt((s * (f - center[:, None]) ** 2).sum(axis=1) / total).mean(), flat.mean(), rolled.mean(), (np.diff(np.signbit(y)) != 0).mean() if len(y) > 1 else 0.0, onset.mean(), 1 - flat.mean(), *mfcc]
    return {f"{prefix}{b}": float(v) for b, v in zip(BASES, values, strict=True)}


def edge_features(y: np.ndarray, rate: int, side: str, silence: float, deep: bool = True) -> dict[str, float]:
    """How a beginning rises or an ending falls: times, slopes, onset density, and for the deep profile stability of beat and chroma."""
    s, f = _spectrum(y, rate)
    seconds, rms = len(y) / rate, unit_range(np.sqrt((frames(y) ** 2).mean(axis=1)))
    times, onset = np.arange(len(rms)) * HOP / rate, _onsets(s)
    norm = unit_range(onset)
    peaks = np.flatnonzero((norm[1:-1] > norm[:-2]) & (norm[1:-1] >= norm[2:]) & (norm[1:-1] > norm.mean() + 0.5 * norm.std())) + 1
    within = lambda x: float(min(max(x, 0.0), 1.0))
    out = {"onset_density": len(peaks) / max(seconds, 1e-6), "flux_peak": within(norm.max(initial=0)), "beat_stability": np.nan, "downbeat_strength": np.nan, "chroma_stability": np.nan}
    if deep:
        gaps = np.diff(times[peaks]) if len(peaks) else np.zeros(0)
        out["beat_stability"] = within(1 - gaps.std() / max(gaps.mean(), 1e-6)) if len(peaks) >= 3 else 0.5 if len(peaks) else 0.0
        out["downbeat_strength"] = within(onset[peaks[0 if side == "intro" else -1]] / max(onset.max(), 1e-6)) if len(peaks) else 0.0
        c = _chroma(s, f)
        c = c / (np.linalg.norm(c, axis=1, keepdims=True) + 1e-9)
        out["chroma_stability"] = within(1 - np.linalg.norm(np.diff(c, axis=0), axis=1).mean() / 1.5) if len(c) > 1 else 1.0
    active, strong = np.flatnonzero(rms >= 0.15), np.flatnonzero(rms >= 0.80)
    if side == "intro":
        at = int(strong[0]) if len(strong) else len(rms) - 1
        out |= {"attack_time_s": times[at], "rise_slope": within(max(rms[at] - rms[0], 0) / max(times[at], 0.05)), "pad_silence_s": silence + times[int(active[0]) if len(active) else 0]}
    else:
        at, last = (int(strong[-1]) if len(strong) else 0), (int(active[-1]) if len(active) else len(rms) - 1)
        release, tail = max(seconds - times[at], 0.0), rms[-3:].mean()
        out |= {
            "release_time_s": release,
            "decay_slope": within(max(rms[max(0, at - 3) : at + 1].mean() - tail, 0) / max(release, 0.05)),
            "abruptness": within(0.55 * tail + 0.45 * (1 - within(release / min(max(seconds, 1.0), 8.0)))),
            "tail_silence_s": silence + max(seconds - times[last], 0.0),
        }
    return {f"{side}_{k}": float(v) for k, v in out.items()}


def extract(data: bytes, edge_seconds: float = 30, silence_db: float = 35, deep: bool = True) -> dict[str, float]:
    """All features of one file: the whole, its first and its last loud stretch."""
    y, rate = decode_wav(data)
    if not len(y):
        raise ValueError("no samples")
    spans, want = loud_spans(y, silence_db), int(edge_seconds * rate)
    lead = spans[0, 0] / rate if len(spans) else 0.0
    trail = (len(y) - spans[-1, 1]) / rate if len(spans) else 0.0
    intro, outro = gather_loud(y, spans, want, True), gather_loud(y, spans, want, False)
    out = segment_features(y, rate) | segment_features(intro, rate, "intro_") | segment_features(outro, rate, "outro_")
    out |= edge_features(intro, rate, "intro", lead, deep) | edge_features(outro, rate, "outro", trail, deep)
    return out | {"intro_seconds_used": len(intro) / rate, "outro_seconds_used": len(outro) / rate, "intro_leading_silence_s": lead, "outro_trailing_silence_s": trail}


def pick_files(files: DataFrame) -> DataFrame:
    """One file for each id, the name up to its first dot: waveforms first, then by name; temporary files don't count."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.withColumn("video_id", F.substring_index(name, ".", 1)).filter(~is_temporary(name))
    rank = F.struct((~F.lower(F.col("path")).endswith(".wav")).cast("int"), F.lower("path"))
    return rows.groupBy("video_id").agg(F.min_by("path", rank).alias("path"))


def analyse(files: DataFrame, extractor: Callable[[bytes], dict[str, float]] = extract) -> DataFrame:
    """(video_id, path, status, features) of files with their ``content``; a file that can't be read has status ``failed`` and no features."""

    def run(frames_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames_:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    rows.append({"video_id": r.video_id, "path": r.path, "status": "ok", **extractor(bytes(r.content))})
                except Exception:  # one bad file doesn't end the job; its status tells
                    rows.append({"video_id": r.video_id, "path": r.path, "status": "failed"})
            yield pd.DataFrame(rows).reindex(columns=["video_id", "path", "status", *COLUMNS])

    return add_derived(files.select("video_id", "path", "content").mapInPandas(run, SCHEMA))


def derived(prefix: str = "") -> dict[str, Column]:
    """Energy, danceability, speechiness, acousticness, liveness and valence from the measured features."""
    c = lambda n: F.col(prefix + n)
    pace, bright = min_max(c("tempo"), 60, 180), min_max(c("spectral_centroid"), 1000, 5000)
    made = {
        "energy": min_max(c("loudness"), -60, 0),
        "danceability": clip(0.6 * pace + 0.4 * min_max(c("onset_strength"), 0, 5)),
        "speechiness": clip(0.6 * min_max(c("spectral_flatness"), 0, 0.5) + 0.4 * min_max(c("zcr"), 0, 0.2)),
        "acousticness": clip(c("harmonic_ratio")),
        "liveness": min_max(c("spectral_bandwidth"), 500, 4000),
        "valence": clip(0.5 * c("mode") + 0.25 * pace + 0.25 * bright),
    }
    return {prefix + k: F.when(c("tempo").isNotNull(), v) for k, v in made.items()}


def add_derived(df: DataFrame) -> DataFrame:
    return df.withColumns({k: v for p in ("", "intro_", "outro_") for k, v in derived(p).items()})


def analyse_directory(spark, path: str, cache: DataFrame | None = None, edge_seconds: float = 30, silence_db: float = 35, flow: str = "deep-dj") -> DataFrame:
    """Features of a directory's files: those in the cache under the same signature are reused, the others are read and analysed."""
    sign = analysis_signature(edge_seconds, silence_db, flow)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    chosen = pick_files(files.select("path"))
    if cache is not None:
        chosen = chosen.join(cache.filter(F.col("analysis_signature") == sign).select("video_id"), "video_id", "left_anti")
    todo = files.select("path", "content").join(chosen, "path")
    fresh = analyse(todo, lambda b: extract(b, edge_seconds, silence_db, flow == "deep-dj")).withColumn("analysis_signature", F.lit(sign))
    return fresh if cache is None else cache.unionByName(fresh, allowMissingColumns=True)
