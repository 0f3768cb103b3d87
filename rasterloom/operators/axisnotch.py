"""Second banding filter: frequencies on a frame's two axes that stand out of their surroundings are removed whole.

Every tile is summed onto the few lowest frequencies of one direction, which leaves lines as long as the
other side; tiles' lines add up, and each line is transformed once.  A peak of the axis spectrum is a
bin above a running median by so many robust deviations; all of it is columns on the spectrum table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators import halo as H
from rasterloom.operators.composites import frames_of, pixels
from rasterloom.session import materialize

ROBUST = 1.4826  # median absolute deviation to standard deviation


def axis_spectrum(tiles: DataFrame, band: int) -> DataFrame:
    """(image_id, axis, across, n, bins re[], im[]): a row for each axis and each of its 2·band+1 lines.

    Axis "x" runs along the columns: its lines are the row frequencies -band..band, each with all column frequencies.
    """
    kind = dict(tiles.dtypes)["image_id"]

    def lines(batches):
        import numpy as np
        import pandas as pd

        low = np.arange(-band, band + 1)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                a = np.asarray(r.data).reshape(r.h, r.w)
                for axis, b, at, size, start, n in (("x", a, r.y0 + np.arange(r.h), r.fh, r.x0, r.fw), ("y", a.T, r.x0 + np.arange(r.w), r.fw, r.y0, r.fh)):
                    summed = np.exp(-2j * np.pi * np.outer(low, at) / size) @ b
                    rows += [(r.image_id, axis, int(k), int(n), int(start), s.real, s.imag) for k, s in zip(low, summed)]
            yield pd.DataFrame(rows, columns=["image_id", "axis", "across", "n", "start", "re", "im"])

    def transform(pdf):
        import numpy as np
        import pandas as pd

        n = int(pdf["n"].iloc[0])
        line = np.zeros(n, complex)
        for start, re, im in zip(pdf["start"], pdf["re"], pdf["im"]):
            line[start:start + len(re)] += re + 1j * im
        z = np.fft.fft(line)
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "axis": [pdf["axis"].iloc[0]], "across": [pdf["across"].iloc[0]], "n": [n], "re": [z.real], "im": [z.imag]})

    part = tiles.select("image_id", "y0", "x0", "h", "w", "fh", "fw", "data").mapInPandas(
        lines, f"image_id {kind}, axis string, across int, n int, start int, re array<double>, im array<double>")
    return part.groupBy("image_id", "axis", "across").applyInPandas(
        transform, f"image_id {kind}, axis string, across int, n int, re array<double>, im array<double>")


def running_median(values, half: int):
    """Median of the up to ``2 * half + 1`` values around each place; the line is mirrored once at either end."""
    from bisect import bisect_left, insort

    import numpy as np

    n, half = len(values), min(half, 2 * len(values))
    v = np.concatenate([values[::-1], values, values[::-1]]).tolist()
    held, out = sorted(v[max(0, n - half):min(3 * n, n + half)]), np.empty(n)
    for f in range(n):
        first, last = n + f - half, n + f + half
        if last < 3 * n:
            insort(held, v[last])
        if f and first > 0:
            del held[bisect_left(held, v[first - 1])]
        size = len(held)
        out[f] = (held[(size - 1) // 2] + held[size // 2]) / 2
    return out


def spectrum_peaks(mags: DataFrame, dc: int, peak_k: float) -> DataFrame:
    """Bins ``f`` of (image_id, axis, n, f, m) above the running median by ``peak_k`` robust deviations.

    The ``dc`` lowest frequencies of either sign count as 0.  The median's window is an odd 1/64 of the
    line, nine bins at least, and mirrors the line at its ends.  Where the deviation is 0, the standard deviation
    of what exceeds the median stands in.
    """
    quiet = mags.withColumn("m", F.when((F.col("f") < dc) | (F.col("f") >= F.col("n") - dc), F.lit(0.0)).otherwise(F.col("m")))
    line = ["image_id", "axis"]

    def settle(pdf):
        pdf = pdf.sort_values("f")
        return pdf.assign(floor=running_median(pdf["m"].to_numpy(), (max(9, int(pdf["n"].iloc[0]) // 64) | 1) // 2))

    kinds = dict(quiet.dtypes)
    columns = [*line, "n", "f", "m"]
    floor = quiet.select(*columns).groupBy(*line).applyInPandas(settle, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", floor double")
    rest = floor.withColumn("over", F.col("m") - F.col("floor"))
    whole = Window.partitionBy(*line)
    rest = rest.withColumn("mid", F.percentile("over", 0.5).over(whole))
    spread = F.percentile(F.abs(F.col("over") - F.col("mid")), 0.5).over(whole) * ROBUST
    above = F.coalesce(F.nullif(F.stddev_pop(F.when(F.col("over") > 0, F.col("over"))).over(whole), F.lit(0.0)), F.lit(1.0))
    rest = rest.withColumn("spread", F.when(spread > 0, spread).otherwise(above))
    return rest.filter((F.col("over") > 0) & (F.col("over") > peak_k * F.col("spread"))).select(*line, "n", "f")


def axis_peak_notch(tiles: DataFrame, band: int = 2, peak_k: float = 3.0, half: int = 1, dc: int = 4) -> tuple[DataFrame, DataFrame]:
    """Tiles without the peaks of their frames' axis spectra, and per frame what was found and removed.

    A peak takes ``half`` bins on either side with it, within the spectrum's two ends; the ``dc`` lowest frequencies stay.
    """
    lines = materialize(axis_spectrum(tiles, band), "axis")
    bins = lines.select("image_id", "axis", "across", "n", F.posexplode(F.arrays_zip("re", "im")).alias("f", "z"))
    bins = bins.select("image_id", "axis", "across", "n", "f", F.col("z.re").alias("re"), F.col("z.im").alias("im"))
    mags = bins.groupBy("image_id", "axis", "n", "f").agg(F.avg(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("m"))
    peaks = materialize(spectrum_peaks(mags, dc, peak_k), "peaks")
    middle = F.expr("n div 2")
    signed = F.pmod(F.col("f") + middle, F.col("n")) - middle
    beside = F.least(F.greatest(signed + F.col("d"), -middle), F.col("n") - 1 - middle)
    wide = peaks.withColumn("d", F.explode(F.sequence(F.lit(-half), F.lit(half))))
    cut = wide.select("image_id", "axis", "n", beside.alias("s")).filter(F.abs("s") > dc)
    counts = peaks.groupBy("image_id").agg(F.count_if(F.col("axis") == "x").cast("int").alias("peaks_x"), F.count_if(F.col("axis") == "y").cast("int").alias("peaks_y"))
    counts = counts.join(cut.groupBy("image_id").agg(F.count(F.lit(1)).cast("int").alias("n_notched")), "image_id", "left")
    gone = bins.join(cut.select("image_id", "axis", "n", F.pmod("s", "n").alias("f")).distinct(), ["image_id", "axis", "n", "f"])
    own = gone.withColumn("s", signed)
    # A bin near both axes may be removed by either; it goes once.
    placed = own.select("image_id", "axis", "across", "n", "f", "re", "im", F.when(F.col("axis") == "x", F.col("across")).otherwise(F.col("s")).cast("int").alias("u"),
                        F.when(F.col("axis") == "x", F.col("s")).otherwise(F.col("across")).cast("int").alias("v")).dropDuplicates(["image_id", "u", "v"])
    sides = tiles.filter("ty = 0 AND tx = 0").select("image_id", F.col("h").alias("th"), F.col("w").alias("tw"))
    placed = placed.join(sides, "image_id").select("image_id", "axis", "across", "n", "f", "re", "im", F.when(F.col("axis") == "x", F.col("tw")).otherwise(F.col("th")).alias("step"))
    kind = dict(tiles.dtypes)["image_id"]

    def back(pdf):
        """The removed bins of one line as waves along it, cut at tile borders."""
        import numpy as np
        import pandas as pd

        first = pdf.iloc[0]
        n, step = int(first["n"]), int(first["step"])
        z = np.zeros(n, complex)
        z[pdf["f"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        wave = np.fft.ifft(z)
        cut = [wave[at:at + step] for at in range(0, n, step)]
        return pd.DataFrame({"image_id": first["image_id"], "axis": first["axis"], "at": range(len(cut)), "across": int(first["across"]),
                             "re": [c.real for c in cut], "im": [c.imag for c in cut]})

    waves = placed.groupBy("image_id", "axis", "across").applyInPandas(back, f"image_id {kind}, axis string, at int, across int, re array<double>, im array<double>")
    waves = materialize(waves.groupBy("image_id", "axis", "at").agg(F.collect_list(F.struct("across", "re", "im")).alias("waves")), "removed")
    schema = f"image_id {kind}, ty int, tx int, y0 int, x0 int, h int, w int, fh int, fw int, data array<double>, orig array<double>"

    def subtract(batches):
        import numpy as np

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                a = np.asarray(r.data).reshape(r.h, r.w)
                if r.yk is not None:
                    for k, re, im in zip(r.yk, r.yre, r.yim):
                        a = a - np.real(np.outer(re + 1j * im, np.exp(2j * np.pi * k * (r.x0 + np.arange(r.w)) / r.fw) / r.fw))
                if r.xk is not None:
                    for k, re, im in zip(r.xk, r.xre, r.xim):
                        a = a - np.real(np.outer(np.exp(2j * np.pi * k * (r.y0 + np.arange(r.h)) / r.fh) / r.fh, re + 1j * im))
                out.append(a.ravel())
            yield pdf[H.GEOMETRY].assign(data=out, orig=pdf["data"])

    work = tiles
    for axis, tile in (("y", "ty"), ("x", "tx")):
        mine = waves.filter(F.col("axis") == axis).select("image_id", F.col("at").alias(tile), *[F.col(f"waves.{c}").alias(axis + n) for c, n in (("across", "k"), ("re", "re"), ("im", "im"))])
        work = work.join(mine, ["image_id", tile], "left")
    work = work.select(*H.GEOMETRY, "data", "yk", "yre", "yim", "xk", "xre", "xim")
    both = materialize(work.mapInPandas(subtract, schema), "axisout")
    px = pixels(both, "data", "orig")
    stat = px.groupBy("image_id").agg(F.corr("data", "orig").alias("corr"), (1 - F.try_divide(F.sum(F.col("data") * F.col("data")), F.sum(F.col("orig") * F.col("orig")))).alias("energy_removed"))
    none = F.lit(0)
    report = frames_of(tiles).select("image_id").join(counts, "image_id", "left").select(
        "image_id", *[F.coalesce(c, none).alias(c) for c in ("peaks_x", "peaks_y", "n_notched")])
    return both.drop("orig"), report.join(stat, "image_id")
