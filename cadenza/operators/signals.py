"""Signals between and within series: wavelet coherence of pairs, causal change points.

Each is a grouped function over one pair or one series; Spark joins the series and deals the groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAND, RELIABLE, COMPUTABLE = (3.0, 12.0), 36, 24
PENALTY, MIN_SIZE, MIN_START, JUMP = 3.0, 3, 12, 6
#: Scales of the wavelets: from 2 months in steps of a twelfth of an octave.
SCALES = 2.0 * 2.0 ** (np.arange(37) / 12)
FOURIER = 4 * np.pi / (6 + np.sqrt(2 + 36.0))


# Coherence.


def transform(x: np.ndarray) -> np.ndarray:
    """The Morlet wavelet transform (frequency 6), scales down, months across."""
    size = 1 << int(np.ceil(np.log2(2 * len(x))))
    omega = 2 * np.pi * np.fft.fftfreq(size)
    psi = np.pi**-0.25 * np.sqrt(2 * np.pi * SCALES)[:, None] * np.exp(-0.5 * (SCALES[:, None] * omega - 6) ** 2) * (omega > 0)
    return np.fft.ifft(np.fft.fft(x, size) * psi, axis=1)[:, : len(x)]


def smoothed(w: np.ndarray) -> np.ndarray:
    """Smoothed in time by a Gaussian as wide as the scale, and over 0.6 octaves of scale."""
    n = w.shape[1]
    size = 1 << int(np.ceil(np.log2(2 * n)))
    k = 2 * np.pi * np.fft.fftfreq(size)
    in_time = np.fft.ifft(np.fft.fft(w, size, axis=1) * np.exp(-0.5 * (SCALES[:, None] * k) ** 2), axis=1)[:, :n]
    kernel = np.full(7, 1.0)
    kernel[[0, -1]] = 0.6
    padded = np.pad(in_time, ((3, 3), (0, 0)), mode="edge")
    return sum(kernel[i] / kernel.sum() * padded[i : i + len(SCALES)] for i in range(7))


def band_coherence(wx: np.ndarray, wy: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> float:
    """Mean coherence in the band, inside the cone of influence."""
    n = wx.shape[1]
    cross = smoothed(wx * wy.conj() / SCALES[:, None])
    coherence = np.abs(cross) ** 2 / np.maximum(sx * sy, 1e-300)
    period = FOURIER * SCALES
    cone = FOURIER / np.sqrt(2) * np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1))
    valid = ((period >= BAND[0]) & (period <= BAND[1]))[:, None] & (period[:, None] <= cone)
    return float(coherence[valid].mean()) if valid.any() else np.nan


def pair_coherence(x: np.ndarray, y: np.ndarray, seed: int, permutations: int) -> tuple[float | None, float | None]:
    """Coherence and its p-value under circular shifts of x, which keep its own correlation."""
    n = len(x)
    t = np.arange(n)
    x, y = (v - np.polyval(np.polyfit(t, v, 1), t) for v in (x, y))
    if x.std() < 1e-9 or y.std() < 1e-9:
        return None, None
    x, y = x / x.std(), y / y.std()
    wy = transform(y)
    sy = smoothed(np.abs(wy) ** 2 / SCALES[:, None]).real

    def of(v: np.ndarray) -> float:
        wx = transform(v)
        return band_coherence(wx, wy, smoothed(np.abs(wx) ** 2 / SCALES[:, None]).real, sy)

    seen = of(x)
    if not np.isfinite(seen):
        return None, None
    shifts = np.random.default_rng(seed).integers(3, n - 3, permutations)
    return seen, (1 + sum(of(np.roll(x, int(k))) >= seen for k in shifts)) / (1 + permutations)


def coherence(injection: DataFrame, panel: DataFrame, upto, permutations: int = 150) -> DataFrame:
    """(inj, key, same_block, n, reliable, coherence, p): all pairs are the result; a group is one pair's months."""
    i = injection.where(F.col("date") <= F.lit(upto)).select("inj", F.col("block").alias("bi"), "date", F.col("winj_m3").alias("x"))
    p = panel.where(F.col("date") <= F.lit(upto)).select("key", "block", "date", F.col("liq_tpd").alias("y"))
    pairs = i.join(p, "date").withColumn("same_block", F.col("block") == F.col("bi"))

    def run(names: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        part = part.iloc[int((part["x"] > 0).to_numpy().argmax()) :]
        n, found = len(part), (None, None)
        if n >= COMPUTABLE:
            y = part["y"].interpolate(limit_direction="both").to_numpy(float)
            found = pair_coherence(part["x"].fillna(0.0).to_numpy(float), y, int(part["seed"].iloc[0]), permutations)
        return pd.DataFrame([(*names, bool(part["same_block"].iloc[0]), n, n >= RELIABLE, *found)], columns=["inj", "key", "same_block", "n", "reliable", "coherence", "p"])

    seeded = pairs.withColumn("seed", F.abs(F.hash("inj", "key")))
    return seeded.groupBy("inj", "key").applyInPandas(run, "inj string, key string, same_block boolean, n int, reliable boolean, coherence double, p double")


# Change points.


def last_change(x: np.ndarray) -> int | None:
    """Where the last regime starts, by optimal partition with a kernel cost; None without a change."""
    n = len(x)
    if n < 2 * MIN_SIZE + 2 or x.std() < 1e-12:
        return None
    d = (x[:, None] - x[None, :]) ** 2
    gamma = 1 / np.median(d[d > 0]) if (d > 0).any() else 1.0
    kernel = np.exp(-np.clip(gamma * d, 1e-2, 1e2))
    square = np.pad(kernel.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    trace = np.concatenate([[0.0], np.cumsum(np.diag(kernel))])
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -PENALTY
    for t in range(MIN_SIZE, n + 1):
        s = np.arange(0, t - MIN_SIZE + 1)
        inside = square[t, t] - square[s, t] - square[t, s] + square[s, s]
        cost = best[s] + trace[t] - trace[s] - inside / (t - s) + PENALTY
        back[t] = s[int(np.argmin(cost))]
        best[t] = cost.min()
    return int(back[n]) or None


def change_points(rows: DataFrame, value: str, key: str = "key") -> DataFrame:
    """(key, date, cp_months, cp_jump) at each month from the months up to it: a group is one key's months."""

    def run(names: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        x, out, held = part[value].fillna(0.0).to_numpy(float), [], (-1, 0.0)
        for t, at in enumerate(part["date"]):
            start = last_change(x[: t + 1]) if t >= MIN_START else None
            if start is not None:
                seen = x[: t + 1]
                jump = 100 * (seen[start : start + JUMP].mean() - seen[max(0, start - JUMP) : start].mean()) / max(np.abs(seen).mean(), 1e-9)
                held = (start, float(jump))
            out.append((names[0], at, t - max(held[0], 0), held[1]))
        return pd.DataFrame(out, columns=[key, "date", "cp_months", "cp_jump"])

    return rows.select(key, "date", value).groupBy(key).applyInPandas(run, f"`{key}` string, date date, cp_months int, cp_jump double")


def frozen(points: DataFrame, cutoff, horizon: int, key: str = "key") -> DataFrame:
    """The features on the horizon as known at the cutoff: months go on counting, the jump stays."""
    at = points.where(F.col("date") == F.lit(cutoff))
    steps = at.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.select(key, "step", F.add_months("date", F.col("step")).alias("date"), (F.col("cp_months") + F.col("step")).alias("cp_months"), "cp_jump")
