"""Banding and destitching queries on the event grid with a known ripple added to its rows."""

from pyspark.sql import functions as F

from rasterloom.functions import scalars as S
from rasterloom.operators import axisnotch as X
from rasterloom.operators import destitch as D
from rasterloom.operators import periodic as Q
from rasterloom.plans.raster import GRID_CUT, as_rows, grid_tiles
from rasterloom.plans.regions import grid_frame_table
from rasterloom.plans.registry import query
from rasterloom.sources import tables as T

RIPPLE = 10
OPTS = {"min_period": 6, "base_win": 25, "pad_min": 10}


def rippled(spark, root):
    tiles = grid_tiles(spark, root)
    data = F.transform("data", lambda v, i: v + F.lit(0.6) + F.lit(0.25) * F.cos(
        F.lit(6.283185307179586 / RIPPLE) * (F.col("y0") + F.floor(i / F.col("w")))))
    return tiles.withColumn("data", data)


def row_profile(spark, root):
    """Mean value per grid row, empty rows included, with the ripple."""
    g = T.grid(spark, root).groupBy("image_id", F.col("y").alias("pos")).agg(F.sum("p").alias("s"))
    fr = grid_frame_table(spark, root).select("image_id", F.col("fh").alias("n"), F.explode(F.sequence(F.lit(0), F.col("fh") - 1)).alias("pos"))
    ripple = F.lit(0.6) + F.lit(0.25) * F.cos(F.lit(6.283185307179586 / RIPPLE) * F.col("pos"))
    return fr.join(g, ["image_id", "pos"], "left").select("image_id", "pos", "n", (F.coalesce("s", F.lit(0.0)) / T.GRID_WIDTH + ripple).alias("v"))


@query("c12_stable_period", "grid", """, fr AS (SELECT image_id, max(y) + 1 AS n FROM grid GROUP BY 1), rows1 AS (SELECT image_id, n, unnest(range(n)) AS pos FROM fr),
    prof AS (SELECT r.image_id, r.pos, r.n, coalesce(sum(p), 0) / 30 + 0.6 + 0.25 * cos(6.283185307179586 / 10 * r.pos) AS v FROM rows1 r LEFT JOIN grid g ON g.image_id = r.image_id AND g.y = r.pos GROUP BY 1, 2, 3),
    ws AS (SELECT p.*, win, least(w, (n // 2) | 1) AS w FROM prof p, (VALUES (0, 15), (1, 25), (2, 41)) t(win, w)),
    base AS (SELECT a.image_id, a.win, a.pos, a.n, any_value(a.v) AS v, sum(b.v) / any_value(a.w) AS base FROM ws a JOIN prof b ON a.image_id = b.image_id
    AND b.pos BETWEEN a.pos - a.w // 2 AND a.pos + a.w // 2 GROUP BY 1, 2, 3, 4),
    rel AS (SELECT image_id, win, pos, n, (v - base) / greatest(abs(base), 1e-9) AS rel FROM base),
    ks AS (SELECT image_id, n, unnest(range(1, n // 2)) AS k FROM fr), kb AS (SELECT * FROM ks WHERE k > n / least(40, n // 3) AND k < n / 6.0),
    sp AS (SELECT r.image_id, win, k, any_value(r.n) AS n, sum(rel * cos(2 * pi() * ((k * pos) % r.n) / r.n)) AS re, sum(rel * sin(2 * pi() * ((k * pos) % r.n) / r.n)) AS im
    FROM rel r JOIN kb ON kb.image_id = r.image_id GROUP BY 1, 2, 3),
    pk AS (SELECT image_id, win, any_value(n) / arg_max(k, (round(sqrt(re * re + im * im), 9), -k)) AS p FROM sp GROUP BY 1, 2)
    SELECT image_id, round(avg(p), 6) AS period FROM pk GROUP BY 1 HAVING count(*) = 3 AND (max(p) - min(p)) / avg(p) <= 0.03""")
def stable_period(spark, root):
    out = Q.stable_period(row_profile(spark, root), ["image_id"], F.lit(6), F.lit(40), 25)
    return out.select("image_id", S.r6("period").alias("period"))


@query("c13_harmonics")
def harmonics(spark, root):
    out = Q.analyze(row_profile(spark, root).withColumn("axis", F.lit("row")), min_period=6, base_win=25)
    return out.withColumns({"period": S.r6("period"), "snr": S.r6("snr")})


@query("c14_periodic_notch")
def periodic_notch(spark, root):
    fixed, _ = D.periodic_notch(rippled(spark, root), **OPTS)
    return as_rows(fixed, ["data"], ["v"], "string")


PASS = {"edge_margin": 3, "win_min": 3, "win_max": 9, "tile": GRID_CUT, **OPTS}


@query("c15_protected_blend")
def protected_blend(spark, root):
    _, report = D.protected_pass(rippled(spark, root), **PASS)
    return report.select("image_id", "applied", *[S.r6(c).alias(c) for c in ("row_p", "frac_touched", "frac_strong", "mean_weight", "max_weight")])


@query("c16_repeat_passes")
def repeat_passes(spark, root):
    _, log = D.repeat_passes(rippled(spark, root), **PASS)
    return log.select("image_id", "n_passes", "stopped", S.r6("row0").alias("row0"))


@query("c17_destitch")
def destitch(spark, root):
    opts = {k: v for k, v in PASS.items() if k != "tile"}
    fixed, _ = D.destitch(rippled(spark, root), GRID_CUT, max_band=2, ref_window=3, min_hits=9, **opts)
    return as_rows(fixed, ["data"], ["v"], "string")


@query("c18_axis_peak_notch")
def axis_peak_notch(spark, root):
    _, stats = X.axis_peak_notch(rippled(spark, root), dc=2)
    return stats.select("image_id", "peaks_x", "peaks_y", "n_notched", S.r6("corr").alias("corr"), S.r6("energy_removed").alias("energy_removed"))
