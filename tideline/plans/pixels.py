"""Queries over raw frames: crops, profiles, cells, edges and bursts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import pixels as P
from ..sources import adapters as A
from .registry import query

def _frame():
    return [F.col(c) for c in ("w", "h", "stride", "data")]


def _hex(c):
    return F.lower(F.hex(c))


_HEX = "array_to_string(list_transform({px}, lambda v: printf('%02x', v)), '')"
#: Frames some of which are cut short, or say that their rows are shorter than their pixels.
_ODD_SQL = f"""{A.SHOTS_SQL}, odd AS (SELECT frame_id, w, h, CASE WHEN frame_id % 17 = 0 THEN 8 ELSE stride END AS stride, CASE WHEN frame_id % 13 = 0 THEN px[1:60] ELSE px END AS px,
  frame_id % 4 AS x, frame_id // 4 % 4 AS y, frame_id % 3 AS cw, 1 + frame_id % 2 AS ch FROM shots)"""


def _odd(spark, sf_dir):
    i = F.col("frame_id")
    f = A.shots(spark, sf_dir).withColumn("stride", F.when(i % 17 == 0, 8).otherwise(F.col("stride"))).withColumn("data", F.when(i % 13 == 0, F.substring("data", 1, 60)).otherwise(F.col("data")))
    return f.withColumn("x", i % 4).withColumn("y", F.floor(i / 4) % 4).withColumn("cw", i % 3).withColumn("ch", 1 + i % 2)


@query("geo4_crop", f"""WITH {_ODD_SQL}, e AS (SELECT *, CASE WHEN cw = 0 OR ch = 0 THEN 'zero_area' WHEN x + cw > w OR y + ch > h THEN 'out_of_frame' WHEN stride < w * 4 THEN 'short_stride' WHEN len(px) < stride * h THEN 'short_buffer' END AS error FROM odd)
SELECT frame_id, error, CASE WHEN error IS NULL THEN {_HEX.format(px="flatten(list_transform(range(y, y + ch), lambda r: px[r * stride + x * 4 + 1 : r * stride + (x + cw) * 4]))")} END AS pixels FROM e""")  # fmt: skip
def crop(spark, sf_dir):
    """A rectangle of each frame, or why it can't be cut."""
    rect = [F.col(c) for c in ("x", "y", "cw", "ch")]
    return _odd(spark, sf_dir).select("frame_id", P.crop_error(_frame(), rect).alias("error"), _hex(P.crop(_frame(), rect)).alias("pixels"))


@query("geo17_row_repack", f"""WITH {_ODD_SQL}, s AS (SELECT frame_id, w, h, px, len(px) // h AS stride FROM odd)
SELECT frame_id, CASE WHEN stride = w * 4 THEN {_HEX.format(px="px")} ELSE {_HEX.format(px="flatten(list_transform(list_filter(range(0, h), lambda i: i * stride + w * 4 <= len(px)), lambda i: px[i * stride + 1 : i * stride + w * 4]))")} END AS pixels FROM s""")  # fmt: skip
def row_repack(spark, sf_dir):
    """Frames without the padding of their rows."""
    return _odd(spark, sf_dir).select("frame_id", _hex(P.packed(F.col("w"), F.col("h"), F.col("data"))).alias("pixels"))


#: Targets by name: a region in parts of the frame.
_TARGETS = {"left": (0.0, 0.0, 0.5, 1.0), "corner": (0.8, 0.7, 0.6, 0.9), "line": (0.25, 0.4, 0.5, 0.01), "low": (0.5, 0.95, 0.5, 0.05)}
_TARGETS_SQL = ", ".join(f"({i}, '{n}', {', '.join(f'{v}::DOUBLE' for v in r)})" for i, (n, r) in enumerate(_TARGETS.items()))
_BOXES_SQL = f"{A.REGIONS_SQL}, boxes AS (SELECT frame_id, idx, x // 25 AS x, y // 25 AS y, w // 25 AS w, h // 25 AS h FROM regions WHERE frame_id % 5 <> 0)"


@query("src13_named_target", f"""WITH {A.SCREENS_SQL}, {_BOXES_SQL}, t(k, name, nx, ny, nw, nh) AS (VALUES {_TARGETS_SQL}),
c AS (SELECT frame_id, name, h, px, round(nx * 16)::BIGINT AS x, round(ny * h)::BIGINT AS y, least(nw, 1 - nx) AS nw, least(nh, 1 - ny) AS nh FROM screens JOIN t ON k = frame_id % 4),
r AS (SELECT frame_id, name, h, px, x, y, least(greatest(round(nw * 16), 1), greatest(16 - x, 1))::BIGINT AS w, least(greatest(round(nh * h), 1), greatest(h - y, 1))::BIGINT AS ch FROM c),
k AS (SELECT r.frame_id, count(b.idx) AS had, count(b.idx) FILTER (WHERE least(b.x + b.w, r.x + r.w) > greatest(b.x, r.x) AND least(b.y + b.h, r.y + r.ch) > greatest(b.y, r.y)) AS met FROM r LEFT JOIN boxes b ON b.frame_id = r.frame_id GROUP BY 1)
SELECT r.frame_id, name, CASE WHEN x + w > 16 OR y + ch > h THEN 'occluded' ELSE 'available' END AS state, CASE WHEN x + w <= 16 AND y + ch <= h THEN
  sha256({_HEX.format(px="flatten(list_transform(px[y + 1 : y + ch], lambda p: p[x * 4 + 1 : (x + w) * 4]))")}) END AS pixels, CASE WHEN had = 0 OR met > 0 THEN met END AS n_regions FROM r JOIN k USING (frame_id)""")  # fmt: skip
def named_target(spark, sf_dir):
    """What a named target shows of each frame, and how many regions it keeps: null where the frame has some and none
    meets the target, which is not the same as none."""
    pairs = F.create_map(*[F.lit(x) for i, n in enumerate(_TARGETS) for x in (i, n)])
    part = [F.create_map(*[F.lit(x) for i, r in enumerate(_TARGETS.values()) for x in (i, r[j])])[(F.col("frame_id") % 4).cast("int")] for j in range(4)]
    f = A.screens(spark, sf_dir).withColumn("name", pairs[(F.col("frame_id") % 4).cast("int")])
    rect = P.norm_to_pixel(part, F.col("w"), F.col("h"))
    f = f.select("*", *[c.alias(n) for c, n in zip(rect, ("x", "y", "cw", "ch"), strict=True)])
    rect = [F.col(c) for c in ("x", "y", "cw", "ch")]
    b = A.regions(spark, sf_dir).where("frame_id % 5 <> 0").select("frame_id", *[F.floor(F.col(c) / 25).alias(f"b{c}") for c in "xywh"])
    w, h = (F.least(F.col(f"b{a}") + F.col(f"b{s}"), F.col(a) + F.col(c)) - F.greatest(f"b{a}", a) for a, s, c in (("x", "w", "cw"), ("y", "h", "ch")))
    met = f.select("frame_id", "x", "y", "cw", "ch").join(b, "frame_id").groupBy("frame_id").agg(F.count_if((w > 0) & (h > 0)).alias("met"))
    f = f.join(met, "frame_id", "left")
    n = F.when(F.col("met").isNull(), 0).when(F.col("met") > 0, F.col("met")).cast("long")
    error = P.crop_error(_frame(), rect)
    return f.select("frame_id", "name", F.when(error.isNull(), "available").otherwise("occluded").alias("state"), F.sha2(_hex(P.crop(_frame(), rect)).cast("binary"), 256).alias("pixels"), n.alias("n_regions"))


_POINTS_SQL = f"{A.SCREENS_SQL}, p AS (SELECT frame_id, h, y, x, px[y + 1][x * 4 + 1] AS b, px[y + 1][x * 4 + 2] AS g, px[y + 1][x * 4 + 3] AS r FROM screens, range(16) s(y), range(16) t(x) WHERE y < h)"


@query("geo18_measured_gray", f"""WITH {_POINTS_SQL} SELECT frame_id, string_agg(printf('%02x', floor((0.114::FLOAT * b::FLOAT + 0.587::FLOAT * g::FLOAT + 0.299::FLOAT * r::FLOAT)::DOUBLE + 0.5)::INT), '' ORDER BY y, x) AS gray FROM p GROUP BY frame_id""")
def measured_gray(spark, sf_dir):
    """Luma as the measuring path has it: parts of 32-bit floats, rounded."""
    return A.screens(spark, sf_dir).select("frame_id", _hex(P.gray(*_frame())).alias("gray"))


@query("geo10_red_marker", f"""WITH {_POINTS_SQL}, m AS (SELECT frame_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM p WHERE r > 150 AND g < 100 AND b < 100 GROUP BY 1)
SELECT s.frame_id, x, y, w, m.h FROM screens s LEFT JOIN m USING (frame_id)""")  # fmt: skip
def red_marker(spark, sf_dir):
    """The box around a frame's red pixels."""
    return A.screens(spark, sf_dir).select("frame_id", P.red_marker(*_frame()).alias("m")).select("frame_id", "m.*")


@query("geo11_salient_region", f"""WITH RECURSIVE {_POINTS_SQL},
c AS (SELECT frame_id, y * 16 + x AS cell, x, y FROM p WHERE CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b))::DOUBLE / greatest(r, g, b) ELSE 0 END < 0.35),
near AS (SELECT a.frame_id, a.cell, b.cell AS other FROM c a JOIN c b ON a.frame_id = b.frame_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
reach AS (SELECT frame_id, cell, cell AS root FROM c UNION SELECT n.frame_id, n.other AS cell, r.root FROM reach r JOIN near n ON n.frame_id = r.frame_id AND n.cell = r.cell WHERE r.root < n.other),
own AS (SELECT frame_id, cell, min(root) AS root FROM reach GROUP BY ALL),
sizes AS (SELECT frame_id, root, count(*) AS n, min(cell % 16) AS x, min(cell // 16) AS y, max(cell % 16) AS x1, max(cell // 16) AS y1 FROM own GROUP BY ALL),
best AS (SELECT * FROM sizes QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY n DESC, root) = 1)
SELECT s.frame_id, x, y, x1 - x + 1 AS w, y1 - y + 1 AS h FROM screens s LEFT JOIN best USING (frame_id)""")  # fmt: skip
def salient_region(spark, sf_dir):
    """The box around a frame's largest connected part of little colour."""
    return A.screens(spark, sf_dir).select("frame_id", P.salient_region(*_frame()).alias("m")).select("frame_id", "m.*")


_PROFILE_SQL = f"""{A.WIDE_SQL}, a AS (SELECT frame_id, i, round(sqrt(greatest(q / n - (s / n) * (s / n), 0)) * 1e9)::BIGINT AS v FROM wide),
sm AS (SELECT frame_id, x, sum(v) OVER w / count(*) OVER w AS s FROM (SELECT frame_id, i * 10 + j AS x, v FROM a, range(10) t(j)) WINDOW w AS (PARTITION BY frame_id ORDER BY x ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING))"""


@query("agg20_panels", f"""WITH {_PROFILE_SQL}, t AS (SELECT frame_id, list_sort(list(s))[76 + 1] AS thr FROM sm GROUP BY 1),
r AS (SELECT frame_id, x, x - row_number() OVER (PARTITION BY frame_id ORDER BY x) AS run FROM sm JOIN t USING (frame_id) WHERE s < thr),
d AS (SELECT frame_id, (min(x) + max(x) + 1) // 2 AS x FROM r GROUP BY frame_id, run HAVING count(*) >= 10 AND min(x) > 100 AND max(x) + 1 < 540),
b AS (SELECT frame_id, x FROM d UNION ALL SELECT frame_id, unnest([0, 640]) FROM t), p AS (SELECT frame_id, x, lead(x) OVER (PARTITION BY frame_id ORDER BY x) AS x1 FROM b),
k AS (SELECT frame_id, string_agg(x || '-' || x1, ' ' ORDER BY x) AS panels FROM p WHERE x1 - x > 250 GROUP BY 1)
SELECT t.frame_id, coalesce(panels, '0-640') AS panels FROM t LEFT JOIN k USING (frame_id)""")  # fmt: skip
def panels(spark, sf_dir):
    """The panels of each frame, told apart by gutters of little activity."""
    f = P.panels(A.wide(spark, sf_dir).select("frame_id", P.column_activity(*_frame()).alias("profile")))
    return f.select("frame_id", F.array_join(F.transform("panels", lambda r: F.concat(r["first"].cast("string"), F.lit("-"), r["end"].cast("string"))), " ").alias("panels"))


@query("agg20_gutters", f"""WITH {A.WIDE_SQL}, m AS (SELECT frame_id, i, s / n AS v FROM wide), t AS (SELECT frame_id, avg(v) * 0.5 AS thr FROM m GROUP BY 1),
f AS (SELECT frame_id, i, v < thr AS dark, lag(v < thr, 1, FALSE) OVER (PARTITION BY frame_id ORDER BY i) AS before FROM m JOIN t USING (frame_id))
SELECT frame_id, CASE WHEN count(*) FILTER (WHERE dark AND NOT before AND i > 0) > 0 THEN count(*) FILTER (WHERE dark AND NOT before AND i > 0) + 1 END::INT AS grid_columns FROM f GROUP BY 1""")  # fmt: skip
def gutters(spark, sf_dir):
    """The columns of a tiled frame, by dark gutters between them."""
    f = A.wide(spark, sf_dir).select("frame_id", "h", P.column_means(*_frame()).alias("means"))
    return f.select("frame_id", P.gutters(F.col("means"), F.col("h")).alias("grid_columns"))


@query("geo9_measure")
def measure(spark, sf_dir):
    """A rough region of each wide frame, snapped to the edges found in it."""
    i = F.col("frame_id")
    region = [F.lit(0.2) + (i % 3) * 0.05, F.lit(0.25), F.lit(0.5), F.when(i % 7 == 0, 0.9).otherwise(0.5)]
    f = P.measure(A.wide(spark, sf_dir), region, 0.02)
    return f.select("frame_id", "measured.*")


_STACKED_SQL = f"""{A.SHOTS_SQL}, v AS (SELECT burst, seq, w, p, px[(p // (w * 4)) * 16 + p % (w * 4) + 1] AS v FROM shots, range(64) t(p) WHERE p < w * 16),
m AS (SELECT burst, w, p, count(*) AS n, median(v) AS med, avg(v) AS mean FROM v GROUP BY ALL HAVING count(*) > 1)"""


@query("agg18_pixel_stack", f"""WITH {_STACKED_SQL} SELECT burst, any_value(n) AS n, string_agg((2 * med)::INT::VARCHAR, ',' ORDER BY p) AS twice_median, string_agg(round(1000 * mean::FLOAT::DOUBLE)::INT::VARCHAR, ',' ORDER BY p) AS thousandth_mean FROM m GROUP BY burst""")
def pixel_stack(spark, sf_dir):
    """The median and the mean of the frames of each burst, pixel by pixel and channel by channel."""
    shots = A.shots(spark, sf_dir)
    good = shots.join(P.stack_errors(shots, "burst"), "burst", "left_anti")
    text = lambda by, name: F.array_join(F.transform("values", lambda x: F.round(x.cast("double") * by).cast("int").cast("string")), ",").alias(name)
    med, mean = (P.image(P.stack(good, "burst", how), "burst", 4) for how in ("median", "mean"))
    return med.select("burst", "n", text(2, "twice_median")).join(mean.select("burst", text(1000, "thousandth_mean")), "burst")


@query("agg19_residual", f"""WITH {_STACKED_SQL} SELECT burst, any_value(n) AS n, round(sum(abs(v - med)) / count(*), 6) AS residual_mad FROM v JOIN m USING (burst, p) GROUP BY burst""")
def residual(spark, sf_dir):
    """How far the frames of each burst lie from their median."""
    shots = A.shots(spark, sf_dir)
    good = shots.join(P.stack_errors(shots, "burst"), "burst", "left_anti")
    return P.residual(P.stack(good, "burst"), "burst", 4).select("burst", "n", F.round("residual_mad", 6).alias("residual_mad"))


@query("geo14_coherent_group", f"""WITH {A.MOVED_SQL}, d AS (SELECT a.burst, a.seq, a.n, a.by - b.by AS d FROM moved a JOIN moved b ON a.burst = b.burst AND b.seq = b.n // 2),
c AS (SELECT a.burst, a.seq, a.d, a.n, sum(abs(a.d - b.d)) AS cost FROM d a JOIN d b USING (burst) GROUP BY ALL),
m AS (SELECT burst, d AS center FROM c QUALIFY row_number() OVER (PARTITION BY burst ORDER BY cost, seq) = 1)
SELECT burst, count(*) AS frames, string_agg(seq::VARCHAR, ',' ORDER BY seq) FILTER (WHERE abs(d - center) <= 2) AS kept, round(max(abs(d - center)), 2)::DOUBLE AS max_drift,
  CASE WHEN count(*) FILTER (WHERE abs(d - center) <= 2) < 2 THEN 'no_coherent_frames' ELSE 'coherent' END AS verdict FROM d JOIN m USING (burst) GROUP BY burst""")  # fmt: skip
def coherent_group(spark, sf_dir):
    """Which frames of each burst show the same content, by their shift against the middle one."""
    moved = P.shifts(A.moved_bursts(spark, sf_dir), "burst")
    center = R.medoids(moved.select("burst", F.col("seq").alias("id"), F.col("dx").alias("x"), F.col("dy").alias("y")), ["burst"]).withColumnRenamed("id", "seq")
    g = P.coherent(moved, center, "burst")
    return g.select("burst", "frames", F.array_join("kept", ",").alias("kept"), F.round("max_drift", 2).alias("max_drift"), "verdict")
