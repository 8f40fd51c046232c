"""Queries over frames and the boxes found on them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import frames as O
from ..sources import adapters as A
from .registry import query

BUFFERS_SQL = """b AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: round((x::DOUBLE + 1) * 127.5)::INT) AS g FROM embeddings),
o AS (SELECT *, lag(g) OVER (PARTITION BY label, id // 100 ORDER BY id) AS p FROM b),
m AS (SELECT id, g, p, list_avg(list_transform(list_zip(g, p), lambda z: abs(z[1] - z[2])::DOUBLE)) AS mag,
  list_avg(list_transform(list_zip(g, p), lambda z: CASE WHEN abs(z[1] - z[2]) > 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS frac, list_avg(list_transform(g, lambda x: x::DOUBLE)) AS mean,
  list_avg(list_transform(g, lambda x: (x * x)::DOUBLE)) AS sq FROM o)"""


def _buffers(spark, sf_dir):
    g = F.transform("embedding", lambda x: F.round((x.cast("double") + 1) * 127.5).cast("int"))
    b = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", g.alias("g"))
    # as-of the last buffer of the same session and display: the one before, empty ones left out
    return b.withColumn("p", O.previous(F.col("g"), F.size("g") > 0, ["label", F.floor(F.col("id") / 100)], "id"))


@query("gat5_change_gate", f"""WITH {BUFFERS_SQL} SELECT id, CASE WHEN sqrt(greatest(sq - mean * mean, 0)) < 8 THEN 'blank' WHEN p IS NULL THEN 'first_sight' WHEN mag > 6 OR frac > 0.4 THEN 'changed' ELSE 'unchanged' END AS verdict FROM m""")
def change_gate(spark, sf_dir):
    b = _buffers(spark, sf_dir)
    return b.select("id", O.verdict(F.size("g"), O.gray_std(F.col("g")), F.col("p").isNull(), O.mean_abs_diff(F.col("g"), F.col("p")), O.changed_fraction(F.col("g"), F.col("p"))).alias("verdict"))


@query("gat2_mean_abs_diff", f"WITH {BUFFERS_SQL} SELECT id, round(mag, 6) AS magnitude, round(frac, 6) AS fraction FROM m WHERE p IS NOT NULL")
def measures(spark, sf_dir):
    b = _buffers(spark, sf_dir).where("p is not null")
    return b.select("id", F.round(O.mean_abs_diff(F.col("g"), F.col("p")), 6).alias("magnitude"), F.round(O.changed_fraction(F.col("g"), F.col("p")), 6).alias("fraction"))


@query("gat4_gray_std", f"WITH {BUFFERS_SQL} SELECT id, round(mean, 4) AS mean, round(sqrt(greatest(sq - mean * mean, 0)), 4) AS std FROM m")
def gray_std(spark, sf_dir):
    b = _buffers(spark, sf_dir)
    return b.select("id", F.round(O.mean(F.transform("g", lambda x: x.cast("double"))), 4).alias("mean"), F.round(O.gray_std(F.col("g")), 4).alias("std"))


@query("gat6_perceive", f"WITH {BUFFERS_SQL} SELECT label, count(*) AS n, count(*) FILTER (WHERE perceive) AS perceived FROM (SELECT b.label, NOT (sqrt(greatest(sq - mean * mean, 0)) < 8 OR (m.p IS NOT NULL AND NOT (mag > 6 OR frac > 0.4))) AS perceive FROM m JOIN b USING (id)) GROUP BY label")
def perceive(spark, sf_dir):
    """Blank and unchanged frames are skipped, as rows, not as absences."""
    b = _buffers(spark, sf_dir)
    v = O.verdict(F.size("g"), O.gray_std(F.col("g")), F.col("p").isNull(), O.mean_abs_diff(F.col("g"), F.col("p")), O.changed_fraction(F.col("g"), F.col("p")))
    return b.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(~v.isin("blank", "unchanged")).alias("perceived"))


@query("jn1_align_band_join", f"""WITH {A.UTTERANCES_SQL}, {A.FRAMES_SQL}
SELECT u.stream, u.idx, count(f.idx) AS n, coalesce(string_agg(f.idx::VARCHAR, ',' ORDER BY at_ms, f.idx), '') AS frames FROM utterances u
LEFT JOIN frames f ON f.stream = u.stream AND at_ms BETWEEN greatest(start_ms - 3000, 0) AND end_ms + 3000 GROUP BY u.stream, u.idx""")  # fmt: skip
def align(spark, sf_dir):
    return O.align(A.utterances(spark, sf_dir), A.frames(spark, sf_dir), of=lambda m: {"n": F.size(m).cast("long"), "frames": F.array_join(m, ",")})


PARENTS_SQL = f"""{A.REGIONS_SQL}, pairs AS (SELECT c.frame_id, c.idx, p.idx AS parent, row_number() OVER (PARTITION BY c.frame_id, c.idx ORDER BY p.w * p.h, p.idx) AS n FROM regions c JOIN regions p
  ON p.frame_id = c.frame_id AND p.display_id = c.display_id AND p.granularity <= c.granularity AND p.idx <> c.idx AND p.x <= c.x AND p.y <= c.y AND p.x + p.w >= c.x + c.w AND p.y + p.h >= c.y + c.h
  AND NOT (p.x = c.x AND p.y = c.y AND p.w = c.w AND p.h = c.h)),
parents AS (SELECT r.frame_id, r.idx, parent FROM regions r LEFT JOIN pairs q ON q.frame_id = r.frame_id AND q.idx = r.idx AND n = 1)"""


@query("jn2_containment_parent", f"WITH {PARENTS_SQL} SELECT * FROM parents")
def containment(spark, sf_dir):
    return O.parents(A.regions(spark, sf_dir))


@query("jn8_region_crops", f"WITH {A.REGIONS_SQL} SELECT frame_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY idx) AS n FROM regions) WHERE n <= 6 AND display_id = 1")
def region_crops(spark, sf_dir):
    """The first six boxes of a frame, and of those the ones on this display: in that order."""
    n = F.row_number().over(Window.partitionBy("frame_id").orderBy("idx"))
    return A.regions(spark, sf_dir).withColumn("n", n).where("n <= 6").where("display_id = 1").select("frame_id", "idx")


@query("fil10_granularity_depth", f"WITH {A.REGIONS_SQL} SELECT granularity, source, count(*) AS n FROM regions WHERE granularity <= 2 GROUP BY ALL")
def granularity_depth(spark, sf_dir):
    return A.regions(spark, sf_dir).where("granularity <= 2").groupBy("granularity", "source").agg(F.count(F.lit(1)).alias("n"))


@query("geo1_iou", f"""WITH {A.REGIONS_SQL}, p AS (SELECT a.frame_id, a.idx AS a, b.idx AS b, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS o, a.w * a.h + b.w * b.h AS t
  FROM regions a JOIN regions b ON a.frame_id = b.frame_id AND a.idx < b.idx) SELECT frame_id, a, b, round((o / (t - o)) * 1000)::BIGINT AS permille FROM p WHERE o > 0""")  # fmt: skip
def iou(spark, sf_dir):
    r = A.regions(spark, sf_dir)
    side = lambda n: r.select("frame_id", F.col("idx").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in "xywh"])
    p = side("a").join(side("b"), "frame_id").where("a < b")
    w, h = O.overlap("a_", "b_")
    both = w * h
    share = both / (F.col("a_w") * F.col("a_h") + F.col("b_w") * F.col("b_h") - both)
    return p.where(both > 0).select("frame_id", "a", "b", F.round(share * 1000).cast("long").alias("permille"))


@query("geo2_fuse")
def fuse(spark, sf_dir):
    return O.fuse(A.regions(spark, sf_dir))


@query("geo6_reading_order")
def reading_order(spark, sf_dir):
    r = A.regions(spark, sf_dir)
    return O.reading_order(r.join(O.parents(r), ["frame_id", "idx"]))


@query("geo3_normalised_rect", f"WITH {A.REGIONS_SQL} SELECT frame_id, idx, least(greatest(round(x / 400 * 1920), 0), 1919)::BIGINT AS px, greatest(round(w / 1000 * 1920), 1)::BIGINT AS pw FROM regions")
def normalised_rect(spark, sf_dir):
    """Shares of the frame to pixels: rounded half away from zero, inside the frame, at least one pixel wide."""
    px = F.least(F.greatest(F.round(F.col("x") / 400 * 1920), F.lit(0)), F.lit(1919))
    return A.regions(spark, sf_dir).select("frame_id", "idx", px.cast("long").alias("px"), F.greatest(F.round(F.col("w") / 1000 * 1920), F.lit(1)).cast("long").alias("pw"))


@query("src15_clip_regions", f"""WITH {A.REGIONS_SQL}, c AS (SELECT frame_id, idx, greatest(x, 100) - 100 AS x, greatest(y, 80) - 80 AS y, least(x + w, 300) - greatest(x, 100) AS w, least(y + h, 240) - greatest(y, 80) AS h FROM regions)
SELECT * FROM c WHERE w > 0 AND h > 0""")  # fmt: skip
def clip_regions(spark, sf_dir):
    x, y, w, h = O.clipped(*[F.col(c) for c in "xywh"], 100, 80, 200, 160)
    return A.regions(spark, sf_dir).select("frame_id", "idx", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")).where("w > 0 and h > 0")


@query("set1_ordered_union", f"WITH {A.REGIONS_SQL}, f AS (SELECT frame_id, source, min(idx) AS first FROM regions GROUP BY ALL) SELECT frame_id, string_agg(source, ',' ORDER BY first) AS sources FROM f GROUP BY frame_id")
def ordered_union(spark, sf_dir):
    s = F.sort_array(F.collect_list(F.struct("idx", "source")))
    return A.regions(spark, sf_dir).groupBy("frame_id").agg(F.array_join(F.array_distinct(F.transform(s, lambda x: x["source"])), ",").alias("sources"))


@query("set3_provider_concatenation", f"WITH {A.REGIONS_SQL} SELECT frame_id, idx, source FROM regions WHERE source = 'wm' UNION ALL SELECT frame_id, idx, source FROM regions WHERE source = 'at_spi'")
def provider_concatenation(spark, sf_dir):
    r = A.regions(spark, sf_dir).select("frame_id", "idx", "source")
    return r.where("source = 'wm'").unionByName(r.where("source = 'at_spi'"))


@query("geo8_entry_provenance")
def entry_provenance(spark, sf_dir):
    """The first box of a frame in reading order."""
    r = A.regions(spark, sf_dir)
    return O.reading_order(r.join(O.parents(r), ["frame_id", "idx"])).where("place = 0").select("frame_id", "idx")
