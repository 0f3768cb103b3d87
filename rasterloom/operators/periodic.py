"""Periodic banding in line profiles: detrending, spectra, stable periods and harmonics.

A profile is the table ``(<keys>, pos, v, n)`` with one row per frame line, so it is as long as a
frame's side.  Each of its residuals is transformed once, and all searches read bands of that spectrum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.ordered import running_total
from rasterloom.operators.quantiles import bounded_percentiles
from rasterloom.session import materialize

LINE = ["image_id", "axis"]
FLOOR_HALF, FLOOR_SKIP = 30, 3


def odd(c: Column) -> Column:
    return c.bitwiseOR(F.lit(1))


def detrend(profile: DataFrame, keys: Sequence[str], windows: Sequence[int]) -> DataFrame:
    """Relative residual against zero-padded moving averages, one copy per window: adds ``win`` and ``rel``.

    The average comes from prefix sums, so its width may differ per frame.
    """
    keys = list(keys)
    p = running_total(profile, keys, F.floor(F.col("pos") / 4096), [F.asc("pos")], {"_p": "v"})
    sums = p.select(*keys, F.col("pos").alias("_at"), F.col("_p"))
    q = p.select(*keys, "pos", "v", "n", F.posexplode(F.array(*[F.lit(int(x)) for x in windows])).alias("win", "_x"))
    q = q.withColumn("_w", F.least(F.col("_x"), odd(F.floor(F.col("n") / 2).cast("int"))))
    half = F.floor(F.col("_w") / 2)
    q = q.withColumns({"_hi": F.least(F.col("pos") + half, F.col("n") - 1).cast("int"), "_lo": (F.col("pos") - half - 1).cast("int")})
    q = q.join(sums.withColumnsRenamed({"_at": "_hi", "_p": "_ph"}), keys + ["_hi"])
    q = q.join(sums.withColumnsRenamed({"_at": "_lo", "_p": "_pl"}), keys + ["_lo"], "left")
    base = (F.col("_ph") - F.coalesce("_pl", F.lit(0.0))) / F.col("_w")
    return q.select(*keys, "win", "pos", "n", ((F.col("v") - base) / F.greatest(F.abs(base), F.lit(1e-9))).alias("rel"))


def spectra(profile: DataFrame, keys: Sequence[str], base_win: int) -> DataFrame:
    """Magnitudes (keys, win, n, k, mag) of every bin 0..n/2 under the three detrending windows; ``win`` 1 is ``base_win``."""
    keys = list(keys)
    rel = detrend(profile.select(*keys, "pos", "v", "n"), keys, [int(base_win * 0.6) | 1, base_win, int(base_win * 1.6) | 1])
    kinds = dict(rel.dtypes)
    group = keys + ["win", "n"]

    def transform(pdf):
        import numpy as np

        line = np.zeros(int(pdf["n"].iloc[0]))
        line[pdf["pos"].to_numpy()] = pdf["rel"].to_numpy()
        return pdf.iloc[:1][group].assign(mags=[np.abs(np.fft.rfft(line))])

    whole = rel.groupBy(*group).applyInPandas(transform, ", ".join(f"{c} {kinds[c]}" for c in group) + ", mags array<double>")
    return whole.select(*group, F.posexplode("mags").alias("k", "mag"))


def stable_in(mags: DataFrame, line: Sequence[str], bands: DataFrame, keys: Sequence[str], tol: float = 0.03) -> DataFrame:
    """Period of each band (keys, n, _min, _max) of its line's spectra, found at nearly the same place under all windows, else absent."""
    keys = list(keys)
    own = bands.withColumn("_max", F.least("_max", F.floor(F.col("n") / 3))).filter("_max > _min")
    j = mags.join(own.drop("n"), list(line)).filter(F.col("k").between(F.floor(F.col("n") / F.col("_max")) + 1, F.ceil(F.col("n") / F.col("_min")) - 1))
    peak = j.groupBy(*keys, "win").agg((F.first("n") / F.max_by("k", F.struct(F.round("mag", 9), -F.col("k")))).alias("_p"))
    out = peak.groupBy(*keys).agg(F.avg("_p").alias("period"), (F.max("_p") - F.min("_p")).alias("_spread"), F.count(F.lit(1)).alias("_c"))
    return out.filter((F.col("_c") == 3) & (F.col("_spread") / F.col("period") <= tol)).select(*keys, "period")


def stable_period(profile: DataFrame, keys: Sequence[str], min_period: Column, max_period: Column, base_win: int = 251, tol: float = 0.03) -> DataFrame:
    """Period found at nearly the same place under three detrending windows, else the signal is absent from the result."""
    keys = list(keys)
    bands = profile.withColumns({"_min": min_period, "_max": max_period}).groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("n", "_min", "_max")])
    return stable_in(materialize(spectra(profile, keys, base_win), "spectra"), keys, bands, keys, tol)


def peak_snr(mags: DataFrame, line: Sequence[str], asked: DataFrame, keys: Sequence[str], freq: str) -> DataFrame:
    """Peak near ``freq`` of each (keys) against the median of the spectrum around it, under the middle window."""
    keys = list(keys)
    bins = F.floor(F.col("n") / 2) + 1
    m = mags.filter("win = 1").join(asked.select(*keys, F.col(freq).alias("_f")), list(line))
    m = m.withColumn("_i", F.greatest(F.lit(1), F.least(F.rint(F.col("_f") * F.col("n")), bins - 2)).cast("int"))
    off = F.col("k") - F.col("_i")
    m = m.filter((off >= -FLOOR_HALF) & (off < FLOOR_HALF))
    near, around = F.abs(off) <= 1, (F.col("k") >= 1) & ((off < -FLOOR_SKIP) | (off > FLOOR_SKIP))
    peak = m.filter(near).groupBy(*keys).agg(F.max("mag").alias("_peak"))
    floor = bounded_percentiles(m.filter(around), keys, "mag", {"_floor": 0.5})
    return peak.join(floor, keys, "left").select(*keys, (F.col("_peak") / F.greatest(F.coalesce("_floor", F.lit(0.0)), F.lit(1e-12))).alias("snr"))


def analyze(profile: DataFrame, min_period: int = 80, base_win: int = 251, tol: float = 0.03, fundamental_snr: float = 2.0,
            harmonic_snr: float = 3.0, max_harmonics: int = 4, max_freq: float = 0.48, harmonic_band: float = 0.10) -> DataFrame:
    """Validated period of each (image_id, axis): period, snr and the harmonics that pass the same tests on their own."""
    top = F.greatest(F.lit(min_period + 1), F.floor(F.col("n") / 3))
    profile = materialize(profile, "profile")
    mags = materialize(spectra(profile, LINE, base_win), "spectra")
    lines = profile.groupBy(*LINE).agg(F.first("n").alias("n"))
    base = stable_in(mags, LINE, lines.select(*LINE, "n", F.lit(min_period).alias("_min"), top.alias("_max")), LINE, tol)
    orders = base.join(lines, LINE).select(*LINE, "n", "period", F.explode(F.sequence(F.lit(1), F.lit(max_harmonics))).alias("h"))
    orders = orders.withColumn("freq", F.col("h") / F.col("period")).filter((F.col("h") == 1) | (F.col("freq") < max_freq))
    goal = F.col("period") / F.col("h")
    orders = orders.withColumns({"goal": goal, "lo": F.greatest(F.lit(float(min_period)), goal * (1 - harmonic_band)),
                                 "hi": F.least(F.floor(F.col("period") * 1e6), goal * (1 + harmonic_band))})
    keys = LINE + ["h"]
    orders = materialize(orders, "orders")
    snr = peak_snr(mags, LINE, orders, keys, "freq")
    again = orders.filter("h > 1 AND hi > lo").select(*keys, "n", F.col("lo").alias("_min"), F.col("hi").alias("_max"))
    own = stable_in(mags, LINE, again, keys, tol).withColumnRenamed("period", "own")
    j = orders.join(snr, keys).join(own, keys, "left")
    first = j.filter("h = 1").filter(F.col("snr") >= fundamental_snr).select(*LINE, "period", "snr")
    good = j.filter("h > 1").filter((F.abs(F.col("own") - F.col("goal")) / F.col("goal") <= harmonic_band) & (F.col("snr") >= harmonic_snr))
    extra = good.groupBy(*LINE).agg(F.sort_array(F.collect_list("h")).alias("harmonics"))
    return first.join(extra, LINE, "left").withColumn("harmonics", F.coalesce("harmonics", F.array().cast("array<int>")))
