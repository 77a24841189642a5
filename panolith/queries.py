"""Registered queries: each operator on a stand-in relation of the provided tables, with its SQL.

The tables hold no photos, so parts, orders, events, vectors and page addresses stand in for
features, points, pixels and paths. Doubles are rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable
from math import pi, radians, tan

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panolith.functions import geometry, photometric, screen, tags
from panolith.operators import canvas, gains, graph, images, layout, match, points, tiles
from panolith.schema import Layout
from panolith.session import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def rounded(c: Column | str, name: str) -> Column:
    return (F.round(geometry.col(c), 6) + 0.0).alias(name)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as features of the image that their label names."""
    e = load(spark, sf_dir, "embeddings")
    at = lambda m: ((F.col("vec_id") % m) * 10).cast("double")
    return e.select(F.col("label").alias("image_id"), F.col("vec_id").alias("feature_id"), F.col("embedding").alias("descriptor"), at(97).alias("x"), at(89).alias("y"))


# --- matching

_FEATURES = "f AS (SELECT label AS image, vec_id AS id, embedding::DOUBLE[] AS d, (vec_id % 97 * 10)::DOUBLE AS x, (vec_id % 89 * 10)::DOUBLE AS y FROM embeddings)"
_MATCHES = (
    f"WITH {_FEATURES}"
    """, knn AS (
    SELECT * FROM (
        SELECT q.image AS qi, q.id AS q, c.image AS ci, c.id AS c, list_distance(q.d, c.d) AS dist,
               row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.d, c.d), c.image, c.id) AS n
        FROM f q, f c) WHERE n <= 150 AND qi <> ci
), best AS (
    SELECT * FROM (SELECT *, row_number() OVER w AS k, lead(dist) OVER w AS second FROM knn WINDOW w AS (PARTITION BY q, ci ORDER BY dist, c)) WHERE k = 1
), directed AS (
    SELECT a.qi, a.q, a.ci, a.c FROM best a JOIN best b ON a.q = b.c AND a.c = b.q AND a.qi = b.ci AND a.ci = b.qi
    WHERE a.second IS NULL OR a.dist <= 0.95 * a.second
), votes AS (
    SELECT least(qi, ci) AS img_a, greatest(qi, ci) AS img_b, count(*) AS votes, count(DISTINCT (least(q, c), greatest(q, c))) AS matches
    FROM directed GROUP BY 1, 2
)"""
)


@query(_MATCHES + " SELECT * FROM votes")
def candidate_pairs(spark, sf_dir):
    return match.pair_votes(match.matches(features(spark, sf_dir), ratio=0.95))


@query(
    _MATCHES
    + """, ends AS (SELECT *, unnest([img_a, img_b]) AS image FROM votes WHERE votes >= 1)
    SELECT DISTINCT img_a, img_b, votes, matches FROM (
        SELECT *, row_number() OVER (PARTITION BY image ORDER BY votes DESC, img_a DESC, img_b DESC) AS n FROM ends) WHERE n <= 3"""
)
def top_pairs(spark, sf_dir):
    return match.top_pairs(match.pair_votes(match.matches(features(spark, sf_dir), ratio=0.95)), 1, 3)


@query(
    _MATCHES
    + """, ends AS (SELECT *, unnest([img_a, img_b]) AS image FROM votes WHERE votes >= 8)
    SELECT DISTINCT img_a, img_b, votes, matches FROM (
        SELECT *, row_number() OVER (PARTITION BY image ORDER BY votes DESC, img_a DESC, img_b DESC) AS n FROM ends) WHERE n <= 10"""
)
def top_pairs_default(spark, sf_dir):
    return match.top_pairs(match.pair_votes(match.matches(features(spark, sf_dir), ratio=0.95)))


@query(
    f"WITH {_FEATURES}"
    """, n AS (
        SELECT a.image, a.id, b.id AS other, list_distance(a.d, b.d) AS dist, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS away
        FROM f a JOIN f b ON a.image = b.image AND a.id <> b.id
    ), r AS (SELECT *, row_number() OVER (PARTITION BY image, id ORDER BY dist, other) AS k FROM n)
    SELECT a.image AS image_id, a.id AS feature_id FROM r a JOIN r b ON a.image = b.image AND a.id = b.id AND a.k = 1 AND b.k = 2
    WHERE b.dist < 1e-9 OR (a.dist / b.dist > 0.95 AND a.away > 30)"""
)
def self_ambiguous(spark, sf_dir):
    return match.self_ambiguous(features(spark, sf_dir))


@query(
    """SELECT vec_id, pos::INTEGER AS pos, round(sqrt(d[pos + 1] / greatest(list_sum(d), 1e-7)), 6) AS value FROM (
        SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS d, unnest(range(64)) AS pos FROM embeddings)"""
)
def root_sift(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("d"))
    return e.select("vec_id", F.posexplode(match.root_sift(F.col("d"))).alias("pos", "value")).select("vec_id", "pos", rounded("value", "value"))


def part_points(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.select(
        (F.col("p_size") % 4).alias("image_id"),
        F.col("p_partkey").alias("feature_id"),
        (F.col("p_partkey") % 640).cast("double").alias("x"),
        (F.col("p_partkey") * 7 % 480).cast("double").alias("y"),
        F.col("p_retailprice").alias("response"),
        F.lit(640).alias("width"),
        F.lit(480).alias("height"),
    )


@query(
    """WITH p AS (SELECT p_size % 4 AS image_id, p_partkey AS feature_id, floor(p_partkey % 640 / 80.0) AS gx, floor(p_partkey * 7 % 480 / 60.0) AS gy, p_retailprice AS r FROM part),
    c AS (SELECT *, row_number() OVER (PARTITION BY image_id, gx, gy ORDER BY r DESC, feature_id) > 2 AS late FROM p)
    SELECT image_id, feature_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY late, r DESC, feature_id) AS n FROM c) WHERE n <= 160"""
)
def spatial_quota(spark, sf_dir):
    return match.spatial_quota(part_points(spark, sf_dir), 160).select("image_id", "feature_id")


@query(
    """WITH p AS (SELECT (user_id % 3)::INTEGER AS img_a, (3 + user_id % 2)::INTEGER AS img_b, event_id AS seq, least(6, floor(value / 500.0 * 7)) AS gx, least(6, floor(user_id % 100 / 100.0 * 7)) AS gy FROM events),
    u AS (SELECT img_a, img_b, count(DISTINCT (gx, gy)) AS cells FROM p GROUP BY 1, 2),
    l AS (SELECT p.*, row_number() OVER (PARTITION BY img_a, img_b, gx, gy ORDER BY seq) > greatest(1, floor(40 / cells)) AS late FROM p JOIN u USING (img_a, img_b))
    SELECT img_a, img_b, seq FROM (SELECT *, row_number() OVER (PARTITION BY img_a, img_b ORDER BY late, seq) AS n FROM l) WHERE n <= 40"""
)
def spatial_thin(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    p = e.select(
        (F.col("user_id") % 3).cast("int").alias("img_a"),
        (3 + F.col("user_id") % 2).cast("int").alias("img_b"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("xa"),
        (F.col("user_id") % 100).cast("double").alias("ya"),
        F.lit(500).alias("width"),
        F.lit(100).alias("height"),
    )
    return match.spatial_thin(p, 40).select("img_a", "img_b", "seq")


# --- control points


def event_points(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("cp_index"),
        (F.col("user_id") % 20).cast("int").alias("img_a"),
        (F.col("event_id") % 20).cast("int").alias("img_b"),
        F.col("value").alias("xa"),
        (F.col("value") / 2).alias("ya"),
        (F.col("value") / 4).alias("xb"),
        (F.col("value") / 8).alias("yb"),
        F.element_at(F.array(*map(F.lit, ("auto", "manual", "vertical", "horizontal"))), (F.col("event_id") % 4 + 1).cast("int")).alias("kind"),
        F.lit(1.0).alias("weight"),
        (F.col("event_id") % 7 != 0).alias("enabled"),
        F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("error"),
        F.col("event_type"),
    )


_POINTS = """WITH p AS (SELECT event_id AS cp_index, (user_id % 20)::INTEGER AS img_a, (event_id % 20)::INTEGER AS img_b, value AS xa, value / 2 AS ya, value / 4 AS xb, value / 8 AS yb,
    ['auto', 'manual', 'vertical', 'horizontal'][event_id % 4 + 1] AS kind, event_id % 7 <> 0 AS enabled, CASE WHEN event_id % 5 <> 0 THEN value END AS error, event_type FROM events)"""


@query(_POINTS + " SELECT cp_index FROM p WHERE enabled AND kind IN ('auto', 'manual')")
def pair_points(spark, sf_dir):
    return points.pair_points(event_points(spark, sf_dir)).select("cp_index")


@query(_POINTS + " SELECT cp_index FROM p WHERE enabled AND kind IN ('vertical', 'horizontal')")
def line_points(spark, sf_dir):
    return points.line_points(event_points(spark, sf_dir)).select("cp_index")


@query(_POINTS + " SELECT cp_index, img_a, img_b FROM p WHERE (img_a = 3 AND img_b = 8) OR (img_a = 8 AND img_b = 3)")
def points_of_pair(spark, sf_dir):
    return points.of_pair(event_points(spark, sf_dir), 8, 3).select("cp_index", "img_a", "img_b")


@query(_POINTS + " SELECT DISTINCT least(img_a, img_b) AS img_a, greatest(img_a, img_b) AS img_b FROM p WHERE enabled AND img_a <> img_b")
def distinct_pairs(spark, sf_dir):
    return points.distinct_pairs(event_points(spark, sf_dir))


@query(
    _POINTS
    + """, t AS (SELECT event_type, greatest(3, 3 * sqrt(avg(error * error))) AS lim FROM p WHERE enabled AND error > 0 GROUP BY 1)
    SELECT cp_index, enabled AND coalesce(error <= lim, true) AS enabled FROM p LEFT JOIN t USING (event_type)"""
)
def prune_points(spark, sf_dir):
    return points.prune(event_points(spark, sf_dir).withColumn("error", F.col("error")), by=["event_type"]).select("cp_index", "enabled")


@query(_POINTS + " SELECT cp_index, enabled AND coalesce(error <= 100, true) AS enabled FROM p")
def prune_fixed(spark, sf_dir):
    return points.prune(event_points(spark, sf_dir), 100.0).select("cp_index", "enabled")


@query(_POINTS + " SELECT CASE WHEN error > 12 THEN 'bad' WHEN error > 5 THEN 'mid' ELSE 'good' END AS class, count(*) AS n FROM p GROUP BY 1")
def residual_class(spark, sf_dir):
    return event_points(spark, sf_dir).groupBy(points.residual_class(F.col("error")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    _POINTS
    + """ SELECT least(img_a, img_b) AS img_a, greatest(img_a, img_b) AS img_b, count(*) AS n, round(sqrt(avg(error * error)), 6) AS rms, max(error) AS max_error,
    CASE WHEN sqrt(avg(error * error)) < 5 THEN 'good' WHEN sqrt(avg(error * error)) < 12 THEN 'warn' ELSE 'bad' END AS class
    FROM p WHERE enabled AND error > 0 GROUP BY 1, 2"""
)
def pair_summary(spark, sf_dir):
    s = points.pair_summary(event_points(spark, sf_dir))
    return s.select("img_a", "img_b", "n", rounded("rms", "rms"), "max_error", points.rms_class(F.col("rms")).alias("class"))


@query(_POINTS + " SELECT cp_index, img_a AS image_id, xa AS x, ya AS y, 'a' AS side FROM p UNION ALL SELECT cp_index, img_b, xb, yb, 'b' FROM p")
def points_by_image(spark, sf_dir):
    return points.by_image(event_points(spark, sf_dir)).select("cp_index", "image_id", "x", "y", "side")


@query(
    _POINTS
    + """ SELECT cp_index, CASE WHEN img_a <> 8 THEN img_b ELSE img_a END AS img_a, CASE WHEN img_a <> 8 THEN xb ELSE xa END AS xa
    FROM p WHERE least(img_a, img_b) = 3 AND greatest(img_a, img_b) = 8"""
)
def points_facing(spark, sf_dir):
    return points.facing(points.of_pair(event_points(spark, sf_dir), 3, 8), 8).select("cp_index", "img_a", "xa")


@query(_POINTS + " SELECT cp_index - (cp_index > 100)::BIGINT AS cp_index, img_a, img_b FROM p WHERE cp_index <> 100")
def delete_point(spark, sf_dir):
    return points.delete_point(event_points(spark, sf_dir), 100).select("cp_index", "img_a", "img_b")


@query(_POINTS + " SELECT cp_index, CASE WHEN cp_index = 100 THEN false ELSE enabled END AS enabled, CASE WHEN cp_index = 100 THEN 2.5 ELSE xa END AS xa FROM p")
def patch_point(spark, sf_dir):
    return points.patch_point(event_points(spark, sf_dir), 100, enabled=False, xa=2.5).select("cp_index", "enabled", "xa")


@query(
    _POINTS
    + """, old AS (SELECT cp_index, img_a, img_b, xa FROM p WHERE kind <> 'auto'),
    new AS (SELECT img_a, img_b, xa, row_number() OVER (ORDER BY img_a, img_b, xa, ya, xb, yb) AS n FROM p WHERE kind = 'auto')
    SELECT * FROM old UNION ALL SELECT (SELECT max(cp_index) FROM old) + n, img_a, img_b, xa FROM new"""
)
def merge_points(spark, sf_dir):
    p = event_points(spark, sf_dir)
    return points.merge_points(p, p.where("kind = 'auto'")).select("cp_index", "img_a", "img_b", "xa")


_GRAPH = """WITH RECURSIVE img AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0),
    pt AS (SELECT o_custkey AS a, 1 + (o_custkey * 7 + o_orderkey) % (SELECT count(*) FROM customer) AS b, o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AS enabled FROM orders),
    e0 AS (SELECT a, b FROM pt WHERE enabled AND a <> b AND a IN (SELECT id FROM img) AND b IN (SELECT id FROM img)),
    e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
    r(node, root) USING KEY (node) AS (SELECT id, id FROM img UNION SELECT e.b, min(r.root) FROM r JOIN e ON r.node = e.a JOIN recurring.r AS k ON k.node = e.b WHERE r.root < k.root GROUP BY e.b),
    g AS (SELECT node AS image_id, root AS group_id FROM r)"""


def order_graph(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    n = c.count()
    photos = c.select(F.col("c_custkey").alias("image_id"), (F.col("c_acctbal") > 0).alias("enabled"))
    o = load(spark, sf_dir, "orders")
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")
    pts = o.select(F.col("o_custkey").alias("img_a"), (1 + (F.col("o_custkey") * 7 + F.col("o_orderkey")) % n).alias("img_b"), urgent.alias("enabled"))
    return photos, pts


@query(_GRAPH + " SELECT * FROM g")
def image_groups(spark, sf_dir):
    return points.groups(*order_graph(spark, sf_dir))


@query(
    _GRAPH
    + """, s AS (SELECT group_id, count(*) AS n FROM g GROUP BY 1)
    SELECT (SELECT count(*) FROM pt) AS total, (SELECT count(*) FROM pt WHERE enabled) AS enabled, count(*) AS n_groups, max(n) AS largest, count(*) FILTER (WHERE n = 1) AS n_orphans FROM s"""
)
def point_stats(spark, sf_dir):
    return points.stats(*order_graph(spark, sf_dir))


@query(_GRAPH + ", s AS (SELECT group_id, count(*) AS n FROM g GROUP BY 1) SELECT group_id, n, row_number() OVER (ORDER BY n DESC, group_id) - 1 AS place FROM s")
def group_sizes(spark, sf_dir):
    return points.largest_first(points.groups(*order_graph(spark, sf_dir)))


@query(
    _GRAPH
    + """, s AS (SELECT group_id, count(*) AS n FROM g GROUP BY 1), t AS (SELECT count(*) AS n_groups, count(*) FILTER (WHERE n = 1) AS n_orphans FROM s)
    SELECT (SELECT count(*) FROM pt WHERE enabled) || ' of ' || (SELECT count(*) FROM pt) || ' points, RMS 1.25' || CASE WHEN n_groups > 1 THEN ', split into ' || n_groups ELSE '' END
        || CASE WHEN n_orphans > 0 THEN ', ' || n_orphans || ' unlinked' ELSE '' END AS line FROM t"""
)
def status_line(spark, sf_dir):
    return points.status_line(points.stats(*order_graph(spark, sf_dir)), F.lit(1.25))


@query(_GRAPH + " SELECT id AS node FROM img WHERE id NOT IN (SELECT a FROM e)")
def orphans(spark, sf_dir):
    photos, pts = order_graph(spark, sf_dir)
    active = photos.where("enabled").select(F.col("image_id").alias("node"))
    used = pts.where("enabled").select(F.col("img_a").alias("u"), F.col("img_b").alias("v"))
    for end in ("u", "v"):
        used = used.join(active.withColumnRenamed("node", end), end, "left_semi")
    return graph.orphans(active, used)


# --- photos and lenses


def photos(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    maybe = lambda c, ok: F.when(ok, c.cast("double"))
    k = F.col("p_partkey")
    exif = F.struct(
        maybe(k % 60 + 10, k % 2 != 0).alias("focal_length"),
        maybe(k % 90 + 12, k % 3 == 0).alias("focal_35"),
        maybe(k % 3000 + 1000, k % 5 == 0).alias("fp_x_res"),
        maybe(k % 6, k % 7 != 0).alias("fp_unit"),
        maybe(k % 4000 + 2000, k % 11 != 0).alias("exif_w"),
        F.when(k % 4 != 0, F.col("p_brand")).alias("make"),
    )
    return p.select(
        k.alias("image_id"),
        F.concat(F.lit("/photos/"), F.col("p_name"), F.lit(".JPG")).alias("path"),
        (F.col("p_size") * 100 + 100).alias("width"),
        F.lit(2600).alias("height"),
        exif.alias("exif"),
        (F.col("p_size") % 5 != 0).alias("enabled"),
        (F.col("p_size") % 8).alias("lens_id"),
        F.col("p_brand").alias("lens"),
        F.col("p_retailprice").alias("fov_hint"),
        (k % 6).cast("double").alias("focal"),
    )


_PHOTOS = """WITH p AS (SELECT p_partkey AS k, p_size * 100 + 100 AS w, 2600 AS h, p_size % 5 <> 0 AS enabled, p_size % 8 AS lens_id, p_brand, p_retailprice,
    CASE WHEN k % 2 <> 0 THEN (k % 60 + 10)::DOUBLE END AS f, CASE WHEN k % 3 = 0 THEN (k % 90 + 12)::DOUBLE END AS f35, CASE WHEN k % 5 = 0 THEN (k % 3000 + 1000)::DOUBLE END AS res,
    CASE WHEN k % 7 <> 0 THEN k % 6 ELSE 2 END AS unit, CASE WHEN k % 11 <> 0 THEN (k % 4000 + 2000)::DOUBLE END AS ew FROM part)"""


@query(
    _PHOTOS
    + """, s AS (SELECT *, CASE WHEN h > w THEN 24.0 ELSE 36.0 END AS frame, ew / res * CASE unit WHEN 3 THEN 10.0 WHEN 4 THEN 1.0 WHEN 5 THEN 0.001 ELSE 25.4 END AS sensor FROM p)
    SELECT k AS image_id, CASE WHEN f35 > 1 THEN 'focal_35' WHEN f > 0 AND sensor > 1 AND sensor < 100 THEN 'sensor' WHEN f > 1 THEN 'crop' ELSE 'default' END AS source,
    coalesce(f35 > 1 OR (f > 0 AND sensor > 1 AND sensor < 100), false) AS trusted,
    round(CASE WHEN f35 > 1 THEN degrees(2 * atan(frame / (2 * f35)))
        WHEN f > 0 AND sensor > 1 AND sensor < 100 THEN degrees(2 * atan(CASE WHEN h > w THEN sensor * least(w, h) / greatest(w, h) ELSE sensor END / (2 * f)))
        WHEN f > 1 THEN degrees(2 * atan(frame / 1.5 / (2 * f))) ELSE 50.0 END, 6) AS hfov FROM s"""
)
def hfov_estimate(spark, sf_dir):
    hint = geometry.scaled_fov_hint()
    return photos(spark, sf_dir).select("image_id", hint["source"].alias("source"), hint["trusted"].alias("trusted"), rounded(hint["hfov"], "hfov"))


@query(
    """WITH known AS (SELECT '/photos/' || p_partkey || '.JPG' AS path FROM part WHERE p_size < 10), fresh AS (SELECT '/photos/' || p_partkey || '.JPG' AS path, p_size * 100 + 100 AS w, 2600 AS h FROM part WHERE p_size >= 5),
    n AS (SELECT *, row_number() OVER (ORDER BY path) AS n, least(1.0::DOUBLE, 1600 / greatest(w, h)) AS z FROM fresh WHERE path NOT IN (SELECT path FROM known))
    SELECT ((SELECT max(p_partkey) FROM part WHERE p_size < 10) + n)::INTEGER AS image_id, path, greatest(round_even(w * z, 0), 1)::INTEGER AS proxy_width, greatest(round_even(h * z, 0), 1)::INTEGER AS proxy_height FROM n"""
)
def registered_photos(spark, sf_dir):
    from panolith.schema import IMAGES

    p = photos(spark, sf_dir).withColumn("path", F.concat(F.lit("/photos/"), F.col("image_id"), F.lit(".JPG"))).withColumn("size", F.col("width") / 100 - 1)
    empty = spark.createDataFrame([], IMAGES)
    old = p.where("size < 10").select(F.col("image_id").cast("int").alias("image_id"), "path")
    known = empty.unionByName(old, allowMissingColumns=True)
    return images.register(p.where("size >= 5").select("path", "width", "height", "exif"), known).select("image_id", "path", "proxy_width", "proxy_height")


@query("SELECT coalesce((SELECT p_partkey FROM part WHERE p_partkey = 12 AND p_size > 10), (SELECT min(p_partkey) FROM part WHERE p_size > 10)) AS anchor")
def anchor_after(spark, sf_dir):
    return images.anchor_after(load(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("image_id")), 12)


@query(
    """WITH x AS (SELECT event_id, greatest(value / 1.4, 1) AS fov, 1000 + event_id % 3000 AS w, ['rectilinear', 'fisheye', 'equirect', 'stereographic', 'orthographic'][event_id % 5 + 1] AS kind FROM events),
    h AS (SELECT *, radians(least(greatest(fov, 0.001), 359)) / 2 AS half FROM x)
    SELECT event_id, round(CASE kind WHEN 'rectilinear' THEN w / 2 / tan(least(half, radians(89))) WHEN 'stereographic' THEN w / 4 / tan(half / 2) WHEN 'orthographic' THEN w / 2 / sin(least(half, radians(89.9))) ELSE w / 2 / half END, 5) AS focal FROM h"""
)
def focal_lengths(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("rectilinear", "fisheye", "equirect", "stereographic", "orthographic")))
    e = load(spark, sf_dir, "events").select(
        "event_id", F.greatest(F.col("value") / 1.4, F.lit(1.0)).alias("fov"), (1000 + F.col("event_id") % 3000).alias("width"), F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("projection")
    )
    return e.select("event_id", (F.round(geometry.focal_px(), 5) + 0.0).alias("focal"))


@query(
    """WITH s AS (SELECT s_suppkey AS image_id, 100 + s_suppkey % 300 AS w, 80 + s_suppkey % 200 AS h FROM supplier), t AS (SELECT range / 23.0::DOUBLE AS t FROM range(24)), q AS (SELECT range AS i FROM range(5)),
    p AS (SELECT image_id, t * (w - 1) AS x, 0.0::DOUBLE AS y FROM s, t UNION ALL SELECT image_id, t * (w - 1), h - 1 FROM s, t UNION ALL SELECT image_id, 0, t * (h - 1) FROM s, t UNION ALL SELECT image_id, w - 1, t * (h - 1) FROM s, t
        UNION ALL SELECT image_id, a.i / 4.0::DOUBLE * (w - 1), b.i / 4.0::DOUBLE * (h - 1) FROM s, q a, q b)
    SELECT image_id, round(x, 6) AS x, round(y, 6) AS y FROM p"""
)
def border_points(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), (100 + F.col("s_suppkey") % 300).alias("width"), (80 + F.col("s_suppkey") % 200).alias("height"))
    return layout.border_points(s).select("image_id", rounded("x", "x"), rounded("y", "y"))


@query(_PHOTOS + " SELECT k AS image_id FROM p WHERE enabled")
def active_ids(spark, sf_dir):
    return images.active_ids(photos(spark, sf_dir))


@query(_PHOTOS + " SELECT k AS image_id, lens_id FROM p WHERE enabled")
def active_params(spark, sf_dir):
    p = photos(spark, sf_dir)
    return images.active_params(p, p.select("image_id", "lens_id"))


@query(_PHOTOS + " SELECT lens_id, string_agg(k::VARCHAR, ',' ORDER BY k) AS users FROM p GROUP BY 1")
def lens_users(spark, sf_dir):
    return images.lens_users(photos(spark, sf_dir)).select("lens_id", F.array_join(F.col("users").cast("array<string>"), ",").alias("users"))


@query(_PHOTOS + " SELECT round(max(w::DOUBLE * h * 3 / 1e6), 6) AS megabytes FROM p WHERE enabled")
def largest_megabytes(spark, sf_dir):
    return images.largest_megabytes(photos(spark, sf_dir)).select(rounded("megabytes", "megabytes"))


@query("SELECT p_partkey AS image_id, min(p_partkey) OVER (PARTITION BY p_size, p_brand, p_partkey % 6) AS lens_id FROM part")
def lens_matching(spark, sf_dir):
    return images.match_lenses(photos(spark, sf_dir), tolerance=0.0)


@query(
    """WITH m AS (SELECT p_partkey AS image_id, min(p_partkey) OVER (PARTITION BY p_size, p_brand, p_partkey % 6) AS lens_id FROM part)
    SELECT image_id, 0.0::DOUBLE AS yaw, m.lens_id, 1.0::DOUBLE AS exposure, round(p_retailprice, 6) AS fov, 'rectilinear' AS projection FROM m JOIN part ON p_partkey = m.lens_id"""
)
def starting_poses(spark, sf_dir):
    poses, lenses = images.starting(photos(spark, sf_dir), tolerance=0.0)
    return poses.join(lenses, "lens_id").select("image_id", "yaw", "lens_id", "exposure", rounded("fov", "fov"), "projection")


@query("SELECT p_size % 8 AS lens_id, round(median(p_retailprice), 6) AS fov FROM part WHERE p_partkey % 3 = 0 GROUP BY 1")
def refreshed_fov(spark, sf_dir):
    p = photos(spark, sf_dir)
    lenses = p.select("lens_id", F.lit(50.0).alias("fov")).distinct()
    out = images.refreshed_fov(lenses, p.select("image_id", "lens_id"), p.where("image_id % 3 = 0").select("image_id", "fov_hint"))
    return out.select("lens_id", rounded("fov", "fov"))


@query("SELECT p_partkey AS image_id FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 2 = 0")
def unread_photos(spark, sf_dir):
    return images.unread(photos(spark, sf_dir)).select("image_id")


@query(
    _PHOTOS
    + """ SELECT k AS image_id, round(coalesce(CASE WHEN lens_id < 5 THEN -0.1::DOUBLE * lens_id END, 0.0), 6) + 0.0 AS a, round(coalesce(CASE WHEN k % 3 = 0 THEN 1.0 + k % 7 / 10.0 END, 1.0)::DOUBLE, 6) AS exposure,
    round((CASE WHEN k % 3 = 0 THEN 0.01 ELSE 0.0 END)::DOUBLE, 6) AS flare FROM p"""
)
def corrections(spark, sf_dir):
    p = photos(spark, sf_dir)
    v = spark.range(5).select(F.col("id").cast("int").alias("lens_id"), (F.col("id") * -0.1).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"))
    light = p.where("image_id % 3 = 0").select("image_id", (1 + F.col("image_id") % 7 / 10).alias("photo_exposure"), F.lit(0.01).alias("photo_flare"))
    return images.corrections(p, v, light).select("image_id", rounded("a", "a"), rounded("exposure", "exposure"), rounded("flare", "flare"))


@query(
    """WITH x AS (SELECT p_partkey AS k, 2000 + p_size AS full_w, 1000 AS full_h, 200.0 + p_partkey % 160 AS hfov, p_partkey % 50 AS x0, p_partkey % 30 AS y0, 1800 AS w, 900 AS h,
        CASE WHEN p_partkey % 2 = 0 THEN 1800 ELSE 3600 END AS width, CASE WHEN p_partkey % 2 = 0 THEN 900 ELSE 1800 END AS height, CASE WHEN p_size % 3 = 0 THEN 'fisheye' ELSE 'equirect' END AS projection FROM part),
    a AS (SELECT *, round_even(360 * (full_w / hfov), 0) AS pw, round_even(180 * (full_w / hfov), 0) AS ph, width / w AS sx, height / h AS sy, width = w AND height = h AS same FROM x),
    b AS (SELECT *, round_even(pw / 2 - full_w / 2, 0) + x0 AS l, round_even(ph / 2 - full_h / 2, 0) + y0 AS t FROM a),
    c AS (SELECT k, projection = 'equirect' AS ok, width, height, CASE WHEN same THEN pw ELSE round_even(pw * sx, 0) END AS pw, CASE WHEN same THEN ph ELSE round_even(ph * sy, 0) END AS ph,
        CASE WHEN same THEN l ELSE round_even(l * sx, 0) END AS l, CASE WHEN same THEN t ELSE round_even(t * sy, 0) END AS t FROM b)
    SELECT k, CASE WHEN ok THEN pw::BIGINT END AS pano_width, CASE WHEN ok THEN ph::BIGINT END AS pano_height, CASE WHEN ok THEN greatest(0, least(l, greatest(0, pw - width)))::BIGINT END AS crop_left,
    CASE WHEN ok THEN greatest(0, least(t, greatest(0, ph - height)))::BIGINT END AS crop_top FROM c"""
)
def panorama_tags(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    x = load(spark, sf_dir, "part").select(
        k.alias("k"), (2000 + size).alias("full_w"), F.lit(1000).alias("full_h"), (200.0 + k % 160).alias("hfov"), (k % 50).alias("x0"), (k % 30).alias("y0"), F.lit(1800).alias("w"), F.lit(900).alias("h"),
        F.when(k % 2 == 0, 1800).otherwise(3600).alias("width"), F.when(k % 2 == 0, 900).otherwise(1800).alias("height"), F.when(size % 3 == 0, "fisheye").otherwise("equirect").alias("projection"),
    )
    return tags.panorama_tags(x).select("k", "pano_width", "pano_height", "crop_left", "crop_top")


_PACKET = [
    ("UsePanoramaViewer", "'True'"), ("ProjectionType", "'equirectangular'"), ("CroppedAreaImageWidthPixels", "w"), ("CroppedAreaImageHeightPixels", "h"), ("FullPanoWidthPixels", "pw"), ("FullPanoHeightPixels", "ph"),
    ("CroppedAreaLeftPixels", "l"), ("CroppedAreaTopPixels", "t"), ("InitialViewHeadingDegrees", "'0'"), ("InitialViewPitchDegrees", "'0'"), ("InitialViewRollDegrees", "'0'"), ("InitialHorizontalFOVDegrees", "'70'"),
]


@query(
    "WITH x AS (SELECT p_partkey, 2000 + p_size AS w, 1000 AS h, 2000 + p_size AS pw, round_even((2000 + p_size) / 2, 0)::BIGINT AS ph FROM part), y AS (SELECT *, 0 AS l, greatest(0, least(round_even(ph / 2 - h / 2, 0), ph - h))::BIGINT AS t FROM x) "
    "SELECT p_partkey, "
    + " || ".join(f"' GPano:{k}=\"' || {v} || '\"'" for k, v in _PACKET)
    + " AS tags FROM y"
)
def viewer_packets(spark, sf_dir):
    x = load(spark, sf_dir, "part").select("p_partkey", (2000 + F.col("p_size")).alias("full_w"), F.lit(1000).alias("full_h"), F.lit(360.0).alias("hfov"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit("equirect").alias("projection"))
    x = tags.panorama_tags(x.withColumns({"w": F.col("full_w"), "h": F.col("full_h"), "width": F.col("full_w"), "height": F.col("full_h")}))
    return x.select("p_partkey", F.regexp_extract(tags.panorama_packet(F.col("width"), F.col("height")), r"(( GPano:\w+=\"[^\"]*\")+)", 1).alias("tags"))


@query(
    """SELECT page_id, lower(regexp_extract(url, '\\.([^./\\\\]+)$', 1)) AS ending, regexp_extract(url, '([^/\\\\]+)[/\\\\]*$', 1) AS name,
    substr(sha1(url || '|' || length(html) || '|' || page_id || '|proxy'), 1, 20) AS key,
    replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM pages"""
)
def path_functions(spark, sf_dir):
    p = load(spark, sf_dir, "pages")
    key = tags.cache_key(F.col("url"), F.length("html"), F.col("page_id"), "proxy")
    return p.select("page_id", tags.ending(F.col("url")).alias("ending"), tags.base_name(F.col("url")).alias("name"), key.alias("key"), tags.xml_escaped(F.col("html")).alias("escaped"))


@query(
    """WITH known AS (SELECT '/photos/' || p_partkey || '.JPG' AS path FROM part WHERE p_brand < 'Brand#3')
    SELECT DISTINCT path FROM (SELECT '/photos/' || p_partkey || CASE WHEN p_size % 3 = 0 THEN '.txt' ELSE '.JPG' END AS path FROM part) WHERE path LIKE '%.JPG' AND path NOT IN (SELECT path FROM known)"""
)
def new_paths(spark, sf_dir):
    p = load(spark, sf_dir, "part").withColumn("path", F.concat(F.lit("/photos/"), F.col("p_partkey"), F.when(F.col("p_size") % 3 == 0, ".txt").otherwise(".JPG")))
    known = p.where("p_brand < 'Brand#3'").select(F.concat(F.lit("/photos/"), F.col("p_partkey"), F.lit(".JPG")).alias("path"))
    return images.new_paths(p.select("path").unionByName(p.select("path")), known)


_ENDINGS = ("jpg", "CR3", "txt", "Tiff", "gpr", "nef", "png", "JPEG", "md", "3fr", "exr")


@query(
    f"""WITH p AS (SELECT p_partkey, '/a.b/' || p_name || '.' || {list(_ENDINGS)}[p_partkey % {len(_ENDINGS)} + 1] AS path FROM part)
    SELECT p_partkey, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ending, ending IN ('cr3', 'nef', '3fr') AS raw, ending NOT IN ('txt', 'gpr', 'md') AS supported FROM p"""
)
def path_kinds(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("p_partkey") % len(_ENDINGS) + 1).cast("int"))
    p = load(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/a.b/"), F.col("p_name"), F.lit("."), name).alias("path"))
    return p.select("p_partkey", tags.ending(F.col("path")).alias("ending"), tags.is_raw(F.col("path")).alias("raw"), tags.is_supported(F.col("path")).alias("supported"))


@query(_PHOTOS + " SELECT k AS image_id, w AS width, h AS height, round(w / greatest(w // 2, 1), 6) AS scale, round_even(w::DOUBLE * h / 1e6, 1) AS megapixels FROM p")
def photo_sizes(spark, sf_dir):
    p = photos(spark, sf_dir).withColumn("proxy_width", F.floor(F.col("width") / 2).cast("int"))
    both = images.sizes(p).join(images.proxy_scale(p), "image_id")
    return both.select("image_id", "width", "height", rounded("scale", "scale"), screen.megapixels(F.col("width"), F.col("height")).alias("megapixels"))


@query(
    """SELECT 'image' AS kind, p_partkey AS id FROM part WHERE p_partkey <> 7 UNION ALL SELECT 'pose', p_partkey FROM part WHERE p_partkey <> 7 UNION ALL SELECT 'light', p_partkey FROM part WHERE p_size < 20 AND p_partkey <> 7
    UNION ALL SELECT 'point', event_id FROM events WHERE user_id % 20 <> 7 AND event_id % 20 <> 7"""
)
def remove_image(spark, sf_dir):
    p = photos(spark, sf_dir)
    left = images.remove_image(7, p, p.select("image_id", "lens_id"), load(spark, sf_dir, "part").where("p_size < 20").select(F.col("p_partkey").alias("image_id")), event_points(spark, sf_dir))
    out = [t.select(F.lit(kind).alias("kind"), F.col("cp_index" if kind == "point" else "image_id").cast("long").alias("id")) for kind, t in zip(("image", "pose", "light", "point"), left, strict=True)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(_PHOTOS + " SELECT k AS image_id, CASE WHEN k = 9 THEN false ELSE enabled END AS enabled, CASE WHEN k = 9 THEN 4 ELSE lens_id END AS lens_id FROM p")
def patch_image(spark, sf_dir):
    return images.patch_image(photos(spark, sf_dir), 9, enabled=False, lens_id=4).select("image_id", "enabled", F.col("lens_id").cast("int").alias("lens_id"))


@query("SELECT p_partkey AS image_id, round(CASE WHEN p_partkey = 9 THEN radians(30.0) ELSE p_size / 10.0 END, 6) AS yaw, round(CASE WHEN p_partkey = 9 THEN radians(-45.0) ELSE p_size / 20.0 END, 6) + 0.0 AS pitch, 0.0::DOUBLE AS roll FROM part")
def patch_params(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") / 10).alias("yaw"), (F.col("p_size") / 20).alias("pitch"), F.lit(0.0).alias("roll"))
    return images.patch_params(p, 9, yaw=30, pitch=-45).select("image_id", *[rounded(c, c) for c in ("yaw", "pitch", "roll")])


@query("SELECT s_suppkey AS lens_id, CASE WHEN s_suppkey = 3 THEN 75.5 ELSE 50.0 END::DOUBLE AS fov, 'rectilinear' AS projection, CASE WHEN s_suppkey = 3 THEN 0.01 ELSE 0.0 END::DOUBLE AS a FROM supplier")
def patch_lens(spark, sf_dir):
    lenses = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("lens_id"), F.lit(50.0).alias("fov"), F.lit("rectilinear").alias("projection"), F.lit(0.0).alias("a"))
    return images.patch_lens(lenses, 3, fov=75.5, projection=None, a=0.01)


@query("SELECT s_suppkey AS lens_id, row_number() OVER (ORDER BY s_suppkey) - 1 AS place FROM supplier")
def lens_order(spark, sf_dir):
    return images.lens_order(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("lens_id")))


@query(_POINTS + " SELECT cp_index, row_number() OVER (ORDER BY error DESC NULLS LAST, cp_index) - 1 AS place FROM p")
def points_by_error(spark, sf_dir):
    return points.by_error(event_points(spark, sf_dir)).select("cp_index", "place")


@query("SELECT event_id, value / 500 >= 0.45 AS accepted FROM events")
def accepted_suggestions(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", points.accepted_suggestion(F.col("value") / 500).alias("accepted"))


# --- what a viewer computes


@query(
    """WITH p AS (SELECT event_id, value AS x, 0.5 + event_id % 7 AS zoom, (event_id % 90 - 45)::DOUBLE AS off FROM events)
    SELECT event_id, round(x * (640 / 4000.0) * zoom + off, 6) AS shown, round(x, 6) AS back FROM p"""
)
def screen_places(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.col("value").alias("x"), (0.5 + F.col("event_id") % 7).alias("zoom"), (F.col("event_id") % 90 - 45).cast("double").alias("off"))
    view = (F.col("zoom"), F.col("off"), F.lit(640.0), F.lit(4000.0))
    e = e.withColumn("shown", screen.to_screen(F.col("x"), *view))
    return e.select("event_id", rounded("shown", "shown"), rounded(screen.to_source(F.col("shown"), *view), "back"))


@query(
    """WITH m AS (SELECT s_suppkey % 5 AS pane, s_suppkey AS marker, (s_suppkey * 37 % 400)::DOUBLE AS vx, (s_suppkey * 91 % 300)::DOUBLE AS vy FROM supplier),
    c AS (SELECT c_custkey AS cursor_id, c_custkey % 5 AS pane, (c_custkey * 13 % 400)::DOUBLE AS x, (c_custkey * 29 % 300)::DOUBLE AS y FROM customer)
    SELECT cursor_id, max(marker) AS marker FROM c JOIN m USING (pane)
    WHERE sqrt((x - vx) * (x - vx) + (y - vy) * (y - vy)) < 11 OR (x >= vx + 2 AND x < vx + 28 AND y >= vy AND y < vy + 18) GROUP BY 1"""
)
def marker_hits(spark, sf_dir):
    at = lambda k, a, b: [(F.col(k) % 5).alias("pane"), (F.col(k) * a % 400).cast("double"), (F.col(k) * b % 300).cast("double")]
    pane, vx, vy = at("s_suppkey", 37, 91)
    m = load(spark, sf_dir, "supplier").select(pane, F.col("s_suppkey").alias("marker"), vx.alias("vx"), vy.alias("vy"))
    pane, x, y = at("c_custkey", 13, 29)
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cursor_id"), pane, x.alias("x"), y.alias("y"))
    return screen.marker_hits(m, c)


@query(
    """SELECT p_partkey, floor(p_size * 64 / 1.6 + 0.5)::INTEGER AS height, floor(p_size * 64 * 1.6 + 0.5)::INTEGER AS width,
    CASE p_size % 3 WHEN 0 THEN 'stereographic' WHEN 1 THEN 'stereographic' END AS projection, CASE p_size % 3 WHEN 0 THEN -90.0 WHEN 1 THEN 90.0 END::DOUBLE AS center_pitch FROM part"""
)
def view_presets(spark, sf_dir):
    p = load(spark, sf_dir, "part").withColumn("side", F.col("p_size") * 64)
    view = screen.preset(F.element_at(F.array(F.lit("planet"), F.lit("tunnel"), F.lit("other")), F.col("p_size") % 3 + 1))
    sides = [screen.other_side(F.col("side"), F.lit(1.6), wide).alias(n) for n, wide in (("height", False), ("width", True))]
    return p.select("p_partkey", *sides, view["projection"].alias("projection"), view["center_pitch"].alias("center_pitch"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN p_size END AS a, CASE WHEN p_size % 4 <> 0 THEN (p_partkey % 50)::INTEGER END AS b,
    CASE WHEN p_size % 2 = 0 THEN p_name WHEN p_size % 3 = 0 THEN p_brand ELSE 'panorama' END || '.tif' AS name FROM part"""
)
def viewer_texts(spark, sf_dir):
    size = F.col("p_size")
    text = F.when(size % 4 == 0, F.concat(F.col("p_name"), F.lit(",1"))).otherwise(F.concat(size.cast("string"), F.lit(" , "), (F.col("p_partkey") % 50).cast("string")))
    pair = screen.pair_of(text)
    path = F.when(size % 2 == 0, F.concat(F.lit("/home/a.b/"), F.col("p_name"), F.lit(".json")))
    name = screen.output_name(path, F.when(size % 3 == 0, F.col("p_brand")).otherwise(""), F.lit("tif"))
    return load(spark, sf_dir, "part").select("p_partkey", pair["a"].alias("a"), pair["b"].alias("b"), name.alias("name"))


@query(
    f"""WITH e AS (SELECT event_id, value / 50 - 5 AS r, value * 3 - 500 AS d, value / 3 - 90 AS pitch, event_id % 200 - 100 AS dx, event_id % 160 - 80 AS dy FROM events), w AS (SELECT *, d - dx * 0.25 AS turned FROM e)
    SELECT event_id, round(atan2(sin(r), cos(r)), 6) + 0.0 AS wrapped, round(d + 180 - 360 * floor((d + 180) / 360) - 180, 6) + 0.0 AS degrees,
    round(turned + 180 - 360 * floor((turned + 180) / 360) - 180, 6) + 0.0 AS yaw, round(least(greatest(pitch - dy * 0.25, -90), 90), 6) + 0.0 AS pitch FROM w"""
)
def view_angles(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    v, d = F.col("value"), F.col("value") * 3 - 500
    yaw, pitch = geometry.drag(d, v / 3 - 90, F.col("event_id") % 200 - 100, F.col("event_id") % 160 - 80, 0.25)
    return e.select("event_id", rounded(geometry.wrap_angle(v / 50 - 5), "wrapped"), rounded(geometry.wrap180(d), "degrees"), rounded(yaw, "yaw"), rounded(pitch, "pitch"))


_KINDS = ("equirect", "cylindrical", "mercator", "rectilinear", "stereographic", "fisheye")


@query(
    f"""WITH x AS (SELECT kind, hfov::DOUBLE AS hfov, 700.0::DOUBLE AS f, radians(hfov) / 2 AS half FROM (SELECT unnest({list(_KINDS)}) AS kind), (SELECT unnest([20, 65, 100, 200, 330, 360]) AS hfov)),
    s AS (SELECT *, round_even(CASE kind WHEN 'rectilinear' THEN 2 * f * tan(least(half, radians(70))) WHEN 'stereographic' THEN 4 * f * tan(least(half, radians(179)) / 2) ELSE 2 * f * half END, 0) AS w FROM x)
    SELECT kind, hfov, w::BIGINT AS width, greatest(2, round_even(CASE kind WHEN 'equirect' THEN w * 180 / hfov WHEN 'fisheye' THEN w ELSE 4 * w END, 0))::BIGINT AS height,
    round(CASE kind WHEN 'cylindrical' THEN f * tan(radians(75)) WHEN 'mercator' THEN f * ln(tan(radians(80) / 2 + {pi} / 4)) WHEN 'rectilinear' THEN f * tan(radians(70)) WHEN 'stereographic' THEN 2 * f * tan(radians(80)) END, 3) AS cut,
    hfov >= 358 AND kind IN ('equirect', 'cylindrical', 'mercator') AS wraps,
    CASE WHEN hfov >= 358 AND kind IN ('equirect', 'cylindrical', 'mercator') THEN floor(greatest(1.6 * pow(2, least(7, greatest(1, floor(log2(greatest(w, CASE kind WHEN 'equirect' THEN w * 180 / hfov ELSE 4 * w END)) - 4)))), round_even(w * 0.1, 0))) ELSE 0 END::BIGINT AS pad,
    round(CASE WHEN kind = 'rectilinear' THEN degrees(tan(least(half, radians(70))) / (w / 2)) ELSE hfov / w END, 6) AS per_pixel FROM s"""
)
def canvas_sizes(spark, sf_dir):
    rows = []
    for kind in _KINDS:
        for hfov in (20.0, 65.0, 100.0, 200.0, 330.0, 360.0):
            w, h = layout.full_size(kind, hfov, 700.0)
            lay, cut = Layout(kind, w, h, hfov, w=w, h=h), layout.vertical_limit(kind, 700.0)
            rows.append((kind, hfov, w, h, None if cut is None else round(cut, 3), layout.canvas_wraps(lay), layout.wrap_pad(lay), round(geometry.degrees_per_pixel(lay), 6)))
    return spark.createDataFrame(rows, "kind string, hfov double, width long, height long, cut double, wraps boolean, pad long, per_pixel double")


@query(
    f"""WITH x AS (SELECT unnest({list(_KINDS)}) AS kind), y AS (SELECT kind, percent, most FROM x, (SELECT unnest([37, 100, 250]) AS percent), (SELECT unnest([0, 900]) AS most)),
    s AS (SELECT *, round_even(CASE kind WHEN 'rectilinear' THEN 1400 * tan(radians(50)) WHEN 'stereographic' THEN 2800 * tan(radians(25)) ELSE 700 * radians(100) END, 0) AS w,
        round_even(CASE kind WHEN 'rectilinear' THEN 1400 * tan(radians(30)) WHEN 'cylindrical' THEN 1400 * tan(radians(30)) WHEN 'mercator' THEN 1400 * ln(tan(radians(15) + {pi} / 4)) WHEN 'stereographic' THEN 2800 * tan(radians(15)) ELSE 700 * radians(60) END, 0) AS h FROM y),
    b AS (SELECT *, round_even(700 * radians(100), 0) AS ew FROM s), c AS (SELECT *, ew * round_even(ew * 1.8, 0) AS most_area FROM b),
    d AS (SELECT *, CASE WHEN kind IN ('rectilinear', 'stereographic') AND w * h > most_area THEN sqrt(most_area / (w * h)) ELSE 1 END AS k FROM c),
    e AS (SELECT *, CASE WHEN k < 1 THEN round_even(w * k, 0) ELSE w END AS w1, CASE WHEN k < 1 THEN round_even(h * k, 0) ELSE h END AS h1 FROM d),
    f AS (SELECT *, CASE WHEN most > 0 THEN least(percent / 100.0::DOUBLE, most / greatest(w1, h1)) ELSE percent / 100.0::DOUBLE END AS z FROM e)
    SELECT kind, percent, most, CASE WHEN abs(z - 1) <= 1e-9 THEN w1 ELSE round_even(w1 * z, 0) END::BIGINT AS width, CASE WHEN abs(z - 1) <= 1e-9 THEN h1 ELSE round_even(h1 * z, 0) END::BIGINT AS height FROM f"""
)
def finished_sizes(spark, sf_dir):
    rows = []
    for kind in _KINDS:
        for percent in (37, 100, 250):
            for most in (0, 900):
                lay = layout.finished(layout.fixed_layout(kind, 100.0, 60.0, 700.0, (0.0, 0.0, 0.0)), 700.0, most, percent)
                rows.append((kind, percent, most, lay.w, lay.h))
    return spark.createDataFrame(rows, "kind string, percent int, most int, width long, height long")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def settings_json(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT p_partkey AS image_id, p_size % 8 AS lens_id FROM part WHERE p_partkey % 10 <> 0 UNION ALL SELECT p_partkey, 99 FROM part WHERE p_partkey % 10 = 0")
def upsert_params(spark, sf_dir):
    p = photos(spark, sf_dir).select("image_id", "lens_id")
    return images.upsert(p, p.where("image_id % 10 = 0").withColumn("lens_id", F.lit(99)), "image_id")


# --- light

_SRGB = "CASE WHEN {x} <= 0.04045 THEN {x} / 12.92 ELSE pow(({x} + 0.055) / 1.055, 2.4) END"
_LINEAR = "CASE WHEN {x} <= 0.0031308 THEN {x} * 12.92 ELSE 1.055 * pow({x}, 1 / 2.4) - 0.055 END"


@query(
    f"""WITH v AS (SELECT range AS value, range / 255.0 AS x FROM range(256)), l AS (SELECT value, {_SRGB.format(x="x")} AS light FROM v),
    e AS (SELECT value, light, least(greatest(greatest(light - 0.01, 0) / 1.3, 0), 1) AS toned FROM l)
    SELECT value::INTEGER AS value, round(light, 6) AS light, floor(({_LINEAR.format(x="toned")}) * 255 + 1e-9)::INTEGER AS toned FROM e"""
)
def tone_table(spark, sf_dir):
    t = photometric.tone_table(spark, 1.3, 0.01)
    return t.select("value", rounded(photometric.srgb_to_linear(F.col("value") / 255), "light"), "toned")


@query(
    """WITH p AS (SELECT p_partkey, p_size / 40.0 AS r2, p_retailprice - floor(p_retailprice / 256) * 256 AS v FROM part), f AS (SELECT *, 1 + r2 * (-0.2 + r2 * (-0.05 + r2 * 0.01)) AS fall FROM p)
    SELECT p_partkey, round(fall, 6) AS falloff, floor(least(greatest(floor(v) * pow(1 / greatest(fall, 0.08), 1 / 2.2), 0), 255) + 1e-9)::INTEGER AS fixed,
    floor(least(greatest(floor(v) * 1.21 * pow(2, 0.5), 0), 255) + 1e-9)::INTEGER AS gained FROM f"""
)
def light_functions(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 40).alias("r2"), F.floor(F.col("p_retailprice") - F.floor(F.col("p_retailprice") / 256) * 256).alias("v"))
    p = p.withColumn("fall", photometric.falloff(F.col("r2"), -0.2, -0.05, 0.01))
    return p.select("p_partkey", rounded("fall", "falloff"), photometric.devignetted(F.col("v"), F.col("fall")).alias("fixed"), photometric.gained(F.col("v"), F.lit(1.21), 0.5).alias("gained"))


@query(
    f"""WITH v AS (SELECT range AS value, range / 255.0 AS x FROM range(256)), l AS (SELECT value, {_SRGB.format(x="x")} AS light FROM v), e AS (SELECT value, least(greatest(light - 0.01, 0) * 1.3, 1) AS toned FROM l)
    SELECT value::INTEGER AS value, floor(({_LINEAR.format(x="toned")}) * 255 + 1e-9)::INTEGER AS toned FROM e"""
)
def tone_multiplied(spark, sf_dir):
    return photometric.tone_table(spark, 1.3, 0.01, parity=True)


@query(
    f"""WITH p AS (SELECT p_partkey, p_retailprice - floor(p_retailprice / 256) * 256 AS b, p_size * 5.0::DOUBLE AS g, (p_partkey % 256)::DOUBLE AS r, p_size * 80.0::DOUBLE AS x, (p_partkey % 3000)::DOUBLE AS y,
        (p_size - 25) / 100.0::DOUBLE AS a, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE 0.02 END AS k FROM part), l AS (SELECT *, (0.0722 * b + 0.7152 * g + 0.2126 * r) / 255 AS v FROM p), m AS (SELECT *, {_SRGB.format(x="v")} AS light FROM (SELECT * REPLACE (least(v, 1) AS v) FROM l))
    SELECT p_partkey, round(light, 6) AS light, light > 0.04 AND light < 0.92 AS usable, round(((x - 2000) * (x - 2000) + (y - 1500) * (y - 1500)) / (1500.0 * 1500.0), 6) AS r2, round(1 + a + k, 6) AS corner,
    abs(a) + abs(k) > 1e-6 AS active, round(ln(1 + exp(a * 40)) * 0.02, 6) AS flare FROM m"""
)
def light_parts(spark, sf_dir):
    price, size, key = F.col("p_retailprice"), F.col("p_size"), F.col("p_partkey")
    p = load(spark, sf_dir, "part").select("p_partkey", (price - F.floor(price / 256) * 256).alias("b"), (size * 5.0).alias("g"), (key % 256).cast("double").alias("r"), (size * 80.0).alias("x"),
        (key % 3000).cast("double").alias("y"), ((size - 25) / 100).alias("a"), F.when(size % 5 == 0, 0.0).otherwise(0.02).alias("k"))
    light = photometric.luminance(F.col("b"), F.col("g"), F.col("r"))
    return p.select(
        "p_partkey", rounded(light, "light"), photometric.usable_light(light).alias("usable"), rounded(photometric.radius2(F.col("x"), F.col("y"), F.lit(4000), F.lit(3000)), "r2"),
        rounded(photometric.corner_falloff("a", "k", F.lit(0.0)), "corner"), photometric.vignetting_active("a", "k", F.lit(0.0)).alias("active"), rounded(photometric.softplus_flare(F.col("a") * 40), "flare"),
    )


_CENTS = "px AS (SELECT (l_suppkey % 10)::INTEGER AS image_id, l_partkey AS x, l_linenumber AS y, (sum(round(l_extendedprice * 100)::BIGINT) % 256)::BIGINT AS b FROM lineitem GROUP BY 1, 2, 3)"


def cent_pixels(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) % 256
    return li.groupBy((F.col("l_suppkey") % 10).cast("int").alias("image_id"), F.col("l_partkey").alias("x"), F.col("l_linenumber").alias("y")).agg(cents.alias("b"))


_STATS = f"WITH {_CENTS}, st AS (SELECT a.image_id AS i, c.image_id AS j, count(*) AS n, avg(a.b) AS mi, avg(c.b) AS mj FROM px a JOIN px c USING (x, y) WHERE a.image_id < c.image_id GROUP BY 1, 2 HAVING count(*) >= 12)"


@query(_STATS + " SELECT i, j, n, round(mi, 6) AS mean_i_b, round(mj, 6) AS mean_j_b FROM st")
def overlap_stats(spark, sf_dir):
    s = gains.overlap_stats(cent_pixels(spark, sf_dir), channels=("b",))
    return s.select("i", "j", "n", rounded("mean_i_b", "mean_i_b"), rounded("mean_j_b", "mean_j_b"))


@query(
    _STATS
    + """, s AS (SELECT i, j, n, mi / 255 AS mi, mj / 255 AS mj, (5 / 255.0) * (5 / 255.0) AS sn, 0.0144 AS sg FROM st),
    e AS (SELECT i, i AS j, n * (mi * mi / sn + 1 / sg) AS a, n / sg AS b FROM s UNION ALL SELECT j, j, n * (mj * mj / sn + 1 / sg), n / sg FROM s
        UNION ALL SELECT i, j, -n * mi * mj / sn, 0 FROM s UNION ALL SELECT j, i, -n * mi * mj / sn, 0 FROM s)
    SELECT i, j, round(sum(a), 3) AS a, round(sum(b), 3) AS b FROM e GROUP BY 1, 2"""
)
def gain_normal(spark, sf_dir):
    s = gains.overlap_stats(cent_pixels(spark, sf_dir), channels=("b",))
    s = s.withColumns({c: F.col(c) / 255 for c in ("mean_i_b", "mean_j_b")})
    return gains.normal_entries(s).select("i", "j", (F.round("a", 3) + 0.0).alias("a"), (F.round("b", 3) + 0.0).alias("b"))


@query(
    """WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1)
    SELECT event_id, round(value / m, 6) AS value, round(log2(greatest((value + value / 2 + value / 4) / 3, 1e-6)), 6) AS ev FROM events JOIN m USING (event_type)"""
)
def exposure_median(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "event_type", "value", F.col("value").alias("b"), (F.col("value") / 2).alias("g"), (F.col("value") / 4).alias("r"))
    return gains.over_median(gains.gains_to_ev(e), "value", ["event_type"]).select("event_id", rounded("value", "value"), rounded("ev", "ev"))


# --- geometry

_YAW, _PITCH, _ROLL = 0.4, -0.2, 0.1
_ROT = (
    "cy * cr + sy * sp * sr AS m00, sy * sp * cr - cy * sr AS m01, sy * cp AS m02, cp * sr AS m10, cp * cr AS m11, -sp AS m12, "
    "cy * sp * sr - sy * cr AS m20, sy * sr + cy * sp * cr AS m21, cy * cp AS m22"
)
_TURN = f"t AS (SELECT {_ROT} FROM (SELECT cos({_YAW}) AS cy, sin({_YAW}) AS sy, cos({_PITCH}) AS cp, sin({_PITCH}) AS sp, cos({_ROLL}) AS cr, sin({_ROLL}) AS sr))"
_GRID = "grid AS (SELECT i % 100 AS x, i // 100 AS y FROM (SELECT range AS i FROM range(5000)))"


def canvas_of(kind: str) -> Layout:
    hfov = {"rectilinear": 100.0, "stereographic": 250.0}.get(kind, 300.0)
    return Layout(kind, 100, 50, hfov, _YAW, _PITCH, _ROLL)


def grid(spark: SparkSession) -> DataFrame:
    return spark.range(5000).select((F.col("id") % 100).alias("x"), F.floor(F.col("id") / 100).alias("y"))


def _canvas_sql(kind: str) -> tuple[str, str]:
    half = radians(canvas_of(kind).hfov) / 2
    s = {"rectilinear": 50 / tan(half), "stereographic": 25 / tan(half / 2)}.get(kind, 50 / half)
    at = f"g AS (SELECT x, y, x - 50 + 0.5 AS gx, y - 25 + 0.5 AS gy, sqrt((x - 49.5) * (x - 49.5) + (y - 24.5) * (y - 24.5)) AS r FROM grid)"
    if kind == "rectilinear":
        ray = f"SELECT x, y, true AS ok, gx / sqrt(gx * gx + gy * gy + {s * s}) AS a, gy / sqrt(gx * gx + gy * gy + {s * s}) AS b, {s} / sqrt(gx * gx + gy * gy + {s * s}) AS c FROM g"
    elif kind in ("stereographic", "fisheye"):
        theta = f"2 * atan2(r, {2 * s})" if kind == "stereographic" else f"r / {s}"
        ray = f"SELECT x, y, {'true' if kind == 'stereographic' else f'th <= {pi}'} AS ok, gx / r * sin(th) AS a, gy / r * sin(th) AS b, cos(th) AS c FROM (SELECT *, {theta} AS th FROM g)"
    else:
        lat = {"equirect": f"gy / {s}", "cylindrical": f"atan(gy / {s})", "mercator": f"2 * atan(exp(gy / {s})) - {pi / 2}"}[kind]
        ray = (
            f"SELECT x, y, abs(lat) <= {pi / 2 + 1e-9} AS ok, cos(l) * sin(lon) AS a, sin(l) AS b, cos(l) * cos(lon) AS c FROM "
            f"(SELECT *, gx / {s} AS lon, {lat} AS lat, least(greatest({lat}, {-pi / 2}), {pi / 2}) AS l FROM g)"
        )
    rays = f"WITH {_GRID}, {at}, {_TURN}, v AS ({ray})"
    out = "SELECT x, y, ok AS on_canvas, round(m00 * a + m01 * b + m02 * c, 6) + 0.0 AS rx, round(m10 * a + m11 * b + m12 * c, 6) + 0.0 AS ry, round(m20 * a + m21 * b + m22 * c, 6) + 0.0 AS rz FROM v, t"
    return f"{rays} {out}", f"WITH {_GRID} SELECT x, y, x::DOUBLE AS qx, y::DOUBLE AS qy FROM grid"


def _register_canvas(kind: str) -> None:
    rays_sql, back_sql = _canvas_sql(kind)
    lay = canvas_of(kind)

    def rays(spark, sf_dir):
        return geometry.canvas_to_rays(grid(spark), lay).select("x", "y", "on_canvas", *[rounded(c, c) for c in ("rx", "ry", "rz")])

    def back(spark, sf_dir):
        df = geometry.rays_to_canvas(geometry.canvas_to_rays(grid(spark), lay), lay)
        return df.select("x", "y", rounded("qx", "qx"), rounded("qy", "qy"))

    query(rays_sql, f"pano_rays_{kind}")(rays)
    query(back_sql, f"pano_roundtrip_{kind}")(back)


for _kind in ("equirect", "cylindrical", "mercator", "rectilinear", "stereographic", "fisheye"):
    _register_canvas(_kind)


def camera_columns(kind: str, bent: bool = True) -> dict[str, Column]:
    a, b, c = (0.01, -0.03, 0.02) if bent else (0.0, 0.0, 0.0)
    values = {"fov": 60.0, "a": a, "b": b, "c": c, "cx": 1.25, "cy": -2.75, "shear_x": 0.01, "shear_y": -0.005, "yaw": _YAW, "pitch": _PITCH, "roll": _ROLL}
    return {k: F.lit(v) for k, v in values.items()} | {"projection": F.lit(kind), "width": F.lit(100), "height": F.lit(50)}


def _lens_sql(kind: str) -> str:
    half = radians(60) / 2
    from math import sin

    f = {"rectilinear": 50 / tan(half), "stereographic": 25 / tan(half / 2), "orthographic": 50 / sin(half)}.get(kind, 50 / half)
    ray = {
        "rectilinear": f"SELECT x, y, ix AS a, iy AS b, {f} AS c FROM i",
        "fisheye": f"SELECT x, y, ix / r * sin(r / {f}) AS a, iy / r * sin(r / {f}) AS b, cos(r / {f}) AS c FROM i",
        "stereographic": f"SELECT x, y, ix / r * sin(2 * atan2(r, {2 * f})) AS a, iy / r * sin(2 * atan2(r, {2 * f})) AS b, cos(2 * atan2(r, {2 * f})) AS c FROM i",
        "orthographic": f"SELECT x, y, ix / r * least(r / {f}, 1) AS a, iy / r * least(r / {f}, 1) AS b, sqrt(greatest(1 - least(r / {f}, 1) * least(r / {f}, 1), 0)) AS c FROM i",
        "equirect": f"SELECT x, y, cos(iy / {f}) * sin(ix / {f}) AS a, sin(iy / {f}) AS b, cos(iy / {f}) * cos(ix / {f}) AS c FROM i",
    }[kind]
    return f"""WITH {_GRID}, {_TURN}, s0 AS (SELECT x, y, x - 50 + 0.5 - 1.25 AS a, y - 25 + 0.5 + 2.75 AS b FROM grid), s1 AS (SELECT x, y, a + 0.01 * b AS a, b FROM s0),
    s2 AS (SELECT x, y, a, b - 0.005 * a AS b FROM s1), d AS (SELECT *, sqrt(a * a + b * b) / 25 AS rm FROM s2), k AS (SELECT *, ((0.01 * rm - 0.03) * rm + 0.02) * rm + (1 - 0.01 + 0.03 - 0.02) AS k FROM d),
    i0 AS (SELECT x, y, a * k AS ix, b * k AS iy FROM k), i AS (SELECT *, sqrt(ix * ix + iy * iy) AS r FROM i0), v0 AS ({ray}), v AS (SELECT x, y, a / n AS a, b / n AS b, c / n AS c FROM (SELECT *, sqrt(a * a + b * b + c * c) AS n FROM v0))
    SELECT x, y, round(m00 * a + m01 * b + m02 * c, 6) + 0.0 AS rx, round(m10 * a + m11 * b + m12 * c, 6) + 0.0 AS ry, round(m20 * a + m21 * b + m22 * c, 6) + 0.0 AS rz FROM v, t"""


def _register_lens(kind: str) -> None:
    def rays(spark, sf_dir):
        df = geometry.pixels_to_rays(grid(spark).withColumns(camera_columns(kind)))
        return df.select("x", "y", *[rounded(c, c) for c in ("rx", "ry", "rz")])

    def back(spark, sf_dir):
        df = geometry.rays_to_pixels(geometry.pixels_to_rays(grid(spark).withColumns(camera_columns(kind))))
        return df.select("x", "y", "valid", rounded("px", "px"), rounded("py", "py"))

    query(_lens_sql(kind), f"lens_rays_{kind}")(rays)
    query(f"WITH {_GRID} SELECT x, y, true AS valid, x::DOUBLE AS px, y::DOUBLE AS py FROM grid", f"lens_roundtrip_{kind}")(back)


for _kind in ("rectilinear", "fisheye", "equirect", "stereographic", "orthographic"):
    _register_lens(_kind)


@query("SELECT vec_id, round(embedding[1]::DOUBLE * 5, 6) AS yaw, round(embedding[2]::DOUBLE * 2, 6) AS pitch, round(embedding[3]::DOUBLE * 5, 6) AS roll FROM embeddings")
def rotation_roundtrip(spark, sf_dir):
    at = lambda i, k: (F.element_at("embedding", i).cast("double") * k)
    e = load(spark, sf_dir, "embeddings").select("vec_id", at(1, 5).alias("yaw"), at(2, 2).alias("pitch"), at(3, 5).alias("roll"))
    return geometry.yaw_pitch_roll(geometry.rotation(e).drop("yaw", "pitch", "roll")).select("vec_id", *[rounded(c, c) for c in ("yaw", "pitch", "roll")])


@query(
    """SELECT event_id, round(least(greatest(value, 1), CASE WHEN p = 'rectilinear' THEN 170 WHEN p = 'stereographic' THEN 358 ELSE 360 END), 6) AS hfov,
    round(least(greatest(value, 1), CASE WHEN p = 'equirect' THEN 180 WHEN p IN ('cylindrical', 'mercator', 'rectilinear') THEN 170 WHEN p = 'stereographic' THEN 358 ELSE 360 END), 6) AS vfov
    FROM (SELECT event_id, value, ['equirect', 'cylindrical', 'mercator', 'rectilinear', 'stereographic', 'fisheye'][event_id % 6 + 1] AS p FROM events)"""
)
def clamp_fov(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("equirect", "cylindrical", "mercator", "rectilinear", "stereographic", "fisheye")))
    e = load(spark, sf_dir, "events").withColumn("projection", F.element_at(kinds, (F.col("event_id") % 6 + 1).cast("int")))
    h, v = geometry.clamp_fov("projection", "value", "value")
    return e.select("event_id", rounded(h, "hfov"), rounded(v, "vfov"))


def vector_rays(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    at = lambda i: F.element_at("embedding", i).cast("double")
    return geometry.unit(e.select("vec_id", "label", at(1).alias("rx"), at(2).alias("ry"), (F.abs(at(3)) + 0.05).alias("rz")))


_RAYS = """r0 AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, abs(embedding[3]::DOUBLE) + 0.05 AS z FROM embeddings),
    r AS (SELECT vec_id, label, x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM r0))"""


@query(
    f"""WITH {_RAYS}, a AS (SELECT label, atan2(x, z) AS v FROM r), m AS (SELECT label, CASE WHEN v < 0 THEN v + {2 * pi} ELSE v END AS v FROM a),
    g AS (SELECT label, lead(v) OVER (PARTITION BY label ORDER BY v) - v AS gap, v FROM m)
    SELECT label, round({2 * pi} - greatest(max(gap), min(v) + {2 * pi} - max(v)), 6) AS span FROM g GROUP BY label"""
)
def angular_span(spark, sf_dir):
    a = vector_rays(spark, sf_dir).withColumn("angle", F.atan2("rx", "rz"))
    return layout.angular_span(a, "angle", ["label"]).select("label", rounded("span", "span"))


@query(
    f"""WITH {_RAYS}, m AS (SELECT label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM r GROUP BY 1), k AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM m)
    SELECT label, round(CASE WHEN n >= 0.35 THEN atan2(x, z) ELSE 0 END, 6) AS center_yaw, round(CASE WHEN n >= 0.35 THEN asin(y / n) ELSE 0 END, 6) AS center_pitch, 0.0::DOUBLE AS center_roll FROM k"""
)
def auto_center(spark, sf_dir):
    c = layout.mean_direction(vector_rays(spark, sf_dir), ["label"])
    return c.select("label", *[rounded(n, n) for n in ("center_yaw", "center_pitch", "center_roll")])


def _fit_sql(kind: str) -> str:
    side = "sqrt(x * x + y * y)"
    h, v = {
        "rectilinear": ("2 * degrees(atan(max(abs(x / z))))", "2 * degrees(atan(max(abs(y / z))))"),
        "stereographic": (f"4 * degrees(atan(max(abs(x / {side} * 2 * tan(atan2({side}, z) / 2))) / 2))", f"4 * degrees(atan(max(abs(y / {side} * 2 * tan(atan2({side}, z) / 2))) / 2))"),
        "fisheye": (f"2 * degrees(max(abs(x / {side} * atan2({side}, z))))", f"2 * degrees(max(abs(y / {side} * atan2({side}, z))))"),
    }.get(kind, ("2 * degrees(max(abs(atan2(x, z))))", "2 * degrees(max(abs(asin(y))))"))
    (hc, vc), (hm, vm) = geometry.FIT_MAX[kind], geometry.FOV_MAX[kind]
    return f"""WITH {_RAYS} SELECT label, round(least(greatest(round(least({h}, {hc}), 1), 1), {hm}), 6) AS hfov, round(least(greatest(round(least({v}, {vc}), 1), 1), {vm}), 6) AS vfov FROM r GROUP BY 1"""


def _register_fit(kind: str) -> None:
    def fit(spark, sf_dir):
        e = layout.fov_extents(vector_rays(spark, sf_dir), kind, ["label"])
        h, v = layout.fitted(kind, F.col("h"), F.col("v"))
        return e.select("label", rounded(h, "hfov"), rounded(v, "vfov"))

    query(_fit_sql(kind), f"fit_fov_{kind}")(fit)


for _kind in ("equirect", "cylindrical", "mercator", "rectilinear", "stereographic", "fisheye"):
    _register_fit(_kind)


# --- tiles and canvas

_CANVAS = Layout("equirect", 4000, 2000, 360.0, w=4000, h=2000)


def supplier_rects(spark, sf_dir):
    k = F.col("s_suppkey")
    return load(spark, sf_dir, "supplier").select(k.alias("image_id"), (k * 37 % 3600).alias("x0"), (k * 91 % 1700).alias("y0"), (100 + k % 300).alias("w"), (80 + k % 200).alias("h"))


_RECTS = "rc AS (SELECT s_suppkey AS image_id, s_suppkey * 37 % 3600 AS x0, s_suppkey * 91 % 1700 AS y0, 100 + s_suppkey % 300 AS w, 80 + s_suppkey % 200 AS h FROM supplier)"
_CELLS = f"""WITH {_RECTS}, c0 AS (SELECT image_id, y0, h, unnest(range(x0 // 32, (x0 + w - 1) // 32 + 1)) AS cx FROM rc), cells AS (SELECT image_id, cx, unnest(range(y0 // 32, (y0 + h - 1) // 32 + 1)) AS cy FROM c0)"""


def rect_cells(spark, sf_dir):
    r = supplier_rects(spark, sf_dir)
    span = lambda a, n: F.explode(F.sequence(F.floor(F.col(a) / 32).cast("int"), F.floor((F.col(a) + F.col(n) - 1) / 32).cast("int")))
    return r.withColumn("cx", span("x0", "w")).withColumn("cy", span("y0", "h")).select("image_id", "cx", "cy")


@query(
    _CELLS
    + """, tl AS (SELECT range % 8 AS tx, range // 8 AS ty, greatest(range % 8 * 512 - 64, 0) AS ex0, greatest(range // 8 * 512 - 64, 0) AS ey0, least(range % 8 * 512 + least(512, 4000 - range % 8 * 512) + 64, 4000) AS ex1,
        least(range // 8 * 512 + least(512, 2000 - range // 8 * 512) + 64, 2000) AS ey1 FROM range(32)),
    j AS (SELECT tx, ty, image_id, ex0, ey0, ex1, ey1, min(cx) AS a, min(cy) AS b, max(cx) AS c, max(cy) AS d FROM tl JOIN cells ON cx BETWEEN ex0 // 32 AND (ex1 - 1) // 32 AND cy BETWEEN ey0 // 32 AND (ey1 - 1) // 32 GROUP BY ALL)
    SELECT tx::INTEGER AS tx, ty::INTEGER AS ty, image_id, greatest(a * 32, ex0)::INTEGER AS bx0, greatest(b * 32, ey0)::INTEGER AS by0, least((c + 1) * 32, ex1)::INTEGER AS bx1, least((d + 1) * 32, ey1)::INTEGER AS by1 FROM j"""
)
def tile_images(spark, sf_dir):
    grid_ = tiles.expanded(tiles.tile_grid(spark, _CANVAS, 512), _CANVAS, 64)
    return tiles.tile_images(grid_, rect_cells(spark, sf_dir), 32)


@query(
    _CELLS
    + """, o AS (SELECT unnest([-1, 0, 1]) AS d), w AS (SELECT DISTINCT image_id, cx + a.d AS cx, cy + b.d AS cy FROM cells, o a, o b)
    SELECT image_id, cx::INTEGER AS cx, cy::INTEGER AS cy FROM w WHERE cx >= 0 AND cx < 125 AND cy >= 0 AND cy < 63"""
)
def dilated_coverage(spark, sf_dir):
    return tiles.dilated(rect_cells(spark, sf_dir), 125, 63).select("image_id", "cx", "cy")


@query(
    f"""WITH {_RECTS} SELECT a.image_id AS i, b.image_id AS j, greatest(a.x0, b.x0) AS x, greatest(a.y0, b.y0) AS y, least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0) AS w,
    least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0) AS h FROM rc a JOIN rc b ON a.image_id < b.image_id
    WHERE least(a.x0 + a.w, b.x0 + b.w) > greatest(a.x0, b.x0) AND least(a.y0 + a.h, b.y0 + b.h) > greatest(a.y0, b.y0)"""
)
def overlapping_pairs(spark, sf_dir):
    return tiles.overlapping_pairs(supplier_rects(spark, sf_dir))


@query("SELECT x, image_id FROM (SELECT o_custkey AS x, o_orderkey AS image_id, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 50000) DESC, o_orderkey) AS n FROM orders WHERE floor(o_totalprice / 50000) > 0) WHERE n = 1")
def ownership(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("x"), F.col("o_orderkey").alias("image_id"), F.floor(F.col("o_totalprice") / 50000).alias("depth"))
    return canvas.ownership(o, at=("x",))


@query(f"WITH {_CENTS} SELECT x, y, arg_max(b, image_id) AS b FROM px GROUP BY 1, 2")
def paste(spark, sf_dir):
    return canvas.pasted(cent_pixels(spark, sf_dir), values=("b",))


@query(f"WITH {_CENTS}, w AS (SELECT *, least(1, greatest((1 + image_id) * 0.02, 0)) AS k FROM px) SELECT x, y, round(sum(b * k) / greatest(sum(k), 1e-3), 6) AS b FROM w GROUP BY 1, 2")
def feather(spark, sf_dir):
    px = cent_pixels(spark, sf_dir).withColumn("depth", (F.col("image_id") + 1).cast("double"))
    return canvas.feathered(px, values=("b",)).select("x", "y", rounded("b", "b"))


@query(
    f"""WITH {_CENTS}, top AS (SELECT image_id, x, y FROM px WHERE image_id % 2 = 0)
    SELECT image_id, x, y, b FROM px SEMI JOIN top USING (image_id, x, y)"""
)
def mask_pixels(spark, sf_dir):
    px = cent_pixels(spark, sf_dir)
    return canvas.masked(px, px.where("image_id % 2 = 0").select("image_id", "x", "y")).select("image_id", "x", "y", "b")


def wave(spark: SparkSession) -> DataFrame:
    n = spark.range(3 * 40 * 30).select((F.col("id") % 3).cast("int").alias("image_id"), (F.floor(F.col("id") / 3) % 40).cast("int").alias("gx"), F.floor(F.col("id") / 120).cast("int").alias("gy"))
    return n.withColumns({"px": F.col("gx") * (F.col("image_id") + 1) + F.sin(F.col("gx") / 5.0) * 3, "py": F.col("gy") * 1.5 + F.cos(F.col("gx") * F.col("gy") / 50.0)})


_WAVE = """w AS (SELECT image_id, gx, gy, gx * (image_id + 1) + sin(gx / 5.0) * 3 AS px, gy * 1.5 + cos(gx * gy / 50.0) AS py FROM (SELECT (range % 3)::INTEGER AS image_id, (range // 3 % 40)::INTEGER AS gx, (range // 120)::INTEGER AS gy FROM range(3600)))"""


@query(
    f"""WITH {_WAVE}, s AS (SELECT image_id, sqrt(pow(px - lag(px) OVER a, 2) + pow(py - lag(py) OVER a, 2)) AS d FROM w WINDOW a AS (PARTITION BY image_id, gy ORDER BY gx)
        UNION ALL SELECT image_id, sqrt(pow(px - lag(px) OVER b, 2) + pow(py - lag(py) OVER b, 2)) FROM w WINDOW b AS (PARTITION BY image_id, gx ORDER BY gy))
    SELECT image_id, round(least(greatest(1.4 / quantile_cont(d, 0.02), 0.02), 1), 6) AS scale FROM s WHERE d IS NOT NULL GROUP BY 1"""
)
def source_scale(spark, sf_dir):
    return tiles.source_scale(wave(spark), ["image_id"]).select("image_id", rounded("scale", "scale"))


@query(f"WITH {_WAVE} SELECT a.image_id, a.gx, a.gy, round(sqrt(pow(b.px - a.px, 2) + pow(b.py - a.py, 2)), 6) AS step FROM w a JOIN w b ON a.image_id = b.image_id AND a.gy = b.gy AND b.gx = a.gx + 1")
def neighbour_distance(spark, sf_dir):
    return canvas.neighbour_distance(wave(spark), ["image_id"]).select("image_id", "gx", "gy", rounded("step", "step"))


@query(
    """WITH s AS (SELECT event_type, event_id, value, max(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events),
    b AS (SELECT event_type, min(event_id) AS cut FROM s WHERE value < top GROUP BY 1) SELECT s.event_type, event_id FROM s LEFT JOIN b USING (event_type) WHERE cut IS NULL OR event_id < cut"""
)
def monotone_prefix(spark, sf_dir):
    return canvas.monotone_prefix(load(spark, sf_dir, "events"), ["event_type"], "event_id", "value").select("event_type", "event_id")


@query(
    """SELECT event_id, round(CASE WHEN lag(value) OVER w IS NULL THEN 0 ELSE greatest(value - lag(value) OVER w, 0) END, 6) AS rise, round(value - 2 * lag(value) OVER w + lag(value, 2) OVER w, 6) AS bend
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)"""
)
def curve_penalties(spark, sf_dir):
    c = canvas.curve_penalties(load(spark, sf_dir, "events"), ["event_type"], "event_id", "value")
    return c.select("event_id", rounded("rise", "rise"), rounded("bend", "bend"))


@query(
    """WITH px AS (SELECT (range % 20)::INTEGER AS x, (range // 20)::INTEGER AS y, range * 37 % 251 AS b FROM range(400)),
    q AS (SELECT range AS point_id, least(greatest(range * 0.37::DOUBLE % 21 - 0.5, 0), 19) AS px, least(greatest(range * 0.73::DOUBLE % 21 - 0.5, 0), 19) AS py FROM range(300)),
    f AS (SELECT *, floor(px)::INTEGER AS x0, floor(py)::INTEGER AS y0, px - floor(px) AS fx, py - floor(py) AS fy FROM q)
    SELECT point_id, round(a.b * (1 - fx) * (1 - fy) + b.b * fx * (1 - fy) + c.b * (1 - fx) * fy + d.b * fx * fy, 6) AS b FROM f
    JOIN px a ON a.x = x0 AND a.y = y0 JOIN px b ON b.x = least(x0 + 1, 19) AND b.y = y0 JOIN px c ON c.x = x0 AND c.y = least(y0 + 1, 19) JOIN px d ON d.x = least(x0 + 1, 19) AND d.y = least(y0 + 1, 19)"""
)
def bilinear(spark, sf_dir):
    px = spark.range(400).select(F.lit(0).alias("image_id"), (F.col("id") % 20).cast("int").alias("x"), F.floor(F.col("id") / 20).cast("int").alias("y"), (F.col("id") * 37 % 251).alias("b"))
    q = spark.range(300).select(F.col("id").alias("point_id"), F.lit(0).alias("image_id"), (F.col("id") * 0.37 % 21 - 0.5).alias("px"), (F.col("id") * 0.73 % 21 - 0.5).alias("py"))
    return canvas.bilinear(q, px, values=("b",)).select("point_id", rounded("b", "b"))
