"""Small checks of operators that no table query covers."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from panolith import session
from panolith.operators import canvas, gains, graph, images, kernels, layout, match, order, points, tiles
from panolith.schema import Layout, Settings
from panolith.sources import photos

POINTS = "cp_index long, img_a int, img_b int, xa double, ya double, xb double, yb double, kind string, weight double, enabled boolean, error double"


def cps(spark, errors):
    return spark.createDataFrame([(i, 0, 1, 1.0, 2.0, 3.0, 4.0, "auto", 1.0, True, e) for i, e in enumerate(errors)], POINTS)


@pytest.mark.parametrize("errors, off", [([0.0, 0.0], 0), ([0.1, 2.9], 0), ([1.0] * 20 + [50.0], 1), ([None, 1.0], 0)])
def test_prune(spark, errors, off):
    assert points.prune(cps(spark, errors)).where("not enabled").count() == off


@pytest.mark.parametrize("n", [0, 1, 2, 300])
def test_components(spark, n):
    r = np.random.default_rng(n)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 400, (n, 2))] + [(None, 3), (5, 5)]
    up = list(range(400))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    touched = {x for a, b in pairs if a is not None and a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}


def test_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(64)] + [(1000, 1000 + i) for i in range(1, 200)]
    got = graph.connected_components(spark.createDataFrame(chain, "u long, v long")).groupBy("component").count()
    assert {r.component: r["count"] for r in got.collect()} == {0: 65, 1000: 200}


@pytest.mark.parametrize("degrees, span", [([], None), ([10], 0), ([350, 10], 20), ([0, 90, 180, 270], 270), ([5, 5], 0)])
def test_angular_span(spark, degrees, span):
    rows = layout.angular_span(spark.createDataFrame([(float(np.radians(d)),) for d in degrees], "angle double")).collect()
    if span is None:
        assert rows[0].span is None or rows[0].span == 0
    else:
        assert np.degrees(rows[0].span) == pytest.approx(span, abs=1e-6)


def test_ownership_ties_and_gaps(spark):
    d = spark.createDataFrame([(0, 0, 2, 1.0), (0, 0, 1, 1.0), (1, 0, 3, 0.0)], "x int, y int, image_id int, depth double")
    assert [tuple(r) for r in canvas.ownership(d).collect()] == [(0, 0, 1)]


def test_gains(spark):
    stats = spark.createDataFrame([(0, 1, 100, 100.0, 120.0)], "i int, j int, n long, mean_i_b double, mean_j_b double")
    g = gains.solve_gains(stats, [0, 1, 7])
    assert g[0][0] / g[1][0] == pytest.approx(1.2, abs=0.02) and 0.9 < g[7][0] < 1.1


def test_touching_rectangles_do_not_overlap(spark):
    r = spark.createDataFrame([(0, 0, 0, 10, 10), (1, 10, 0, 10, 10), (2, 9, 9, 5, 5)], "image_id int, x0 int, y0 int, w int, h int")
    assert {(x.i, x.j) for x in tiles.overlapping_pairs(r).collect()} == {(0, 2), (1, 2)}


def test_canvas_that_wraps_keeps_its_width():
    lay = Layout("equirect", 3601, 1800, 360.0, w=3601, h=900, y0=450)
    half = layout.scaled(lay, 0.5)
    assert half.w == half.full_w and half.x0 == 0 and layout.wrap_pad(lay) >= 360


@pytest.mark.parametrize("kind", ["equirect", "cylindrical", "mercator", "rectilinear", "stereographic", "fisheye"])
def test_fixed_layout_is_symmetric(kind):
    lay = layout.fixed_layout(kind, 90.0, 60.0, 500.0, (0.0, 0.0, 0.0))
    assert lay.w == lay.full_w and lay.h == lay.full_h and lay.w > lay.h


def test_settings_of_other_versions():
    s = Settings.read({"seam": "gc_color", "odd": 1, "hfov": 90.0})
    assert s.seam == "dp_color_grad" and s.hfov == 90.0


def test_kernels():
    m = np.zeros((20, 30), bool)
    m[5:15, 5:25] = True
    assert kernels.depth(m).max() == 5
    assert kernels.depth(np.ones((4, 9), bool), wrap=True)[1].tolist() == [2.0] * 9
    two = np.zeros((6, 6), bool)
    two[0, 0] = two[1, 1] = two[4, 4] = True
    assert kernels.labelled(two).max() == 2
    a = np.full((8, 8, 3), 100.0)
    assert np.allclose(kernels.resized(a, 3, 5), 100) and np.allclose(kernels.blurred(a, 2), 100)
    left = np.zeros((8, 8), bool)
    left[:, :4] = True
    assert np.abs(kernels.multiband([a, a], [left, ~left], 3) - 100).max() < 1e-6
    h = np.array([[1.1, 0.02, 5], [-0.01, 0.95, 3], [1e-4, 2e-4, 1]])
    p = np.random.default_rng(0).uniform(0, 200, (60, 2))
    q = kernels.mapped(h, p)
    q[:15] += 50
    got, ok = kernels.ransac(p, q)
    assert np.allclose(got, h, atol=1e-6) and not ok[:15].any() and ok[15:].all()


def test_distinctive_agrees_with_the_join(spark):
    r = np.random.default_rng(3)
    rows = [(i % 3, i, float(r.integers(0, 200)), float(r.integers(0, 200)), [float(v) for v in r.integers(0, 3, 4)]) for i in range(120)]
    f = spark.createDataFrame(rows, "image_id long, feature_id long, x double, y double, descriptor array<double>")
    left = {(x.image_id, x.feature_id) for x in match.distinctive(f).collect()}
    gone = {(x.image_id, x.feature_id) for x in match.self_ambiguous(f).collect()}
    assert gone and left == {(i, k) for i, k, *_ in rows} - gone


def test_projection_under_a_join_and_a_filter(spark):
    from panolith.functions import geometry
    from panolith.plans import panorama
    from panolith.plans.solve import Camera

    cams = {i: Camera(480, 320, 0, float(np.radians(y)), 0.1, 0.05, 60.0, 0.01, -0.02, 0.01) for i, y in enumerate((0, 35))}
    rays = spark.range(300).select(F.sin("id").alias("rx"), (F.cos("id") / 3).alias("ry"), F.lit(0.9).alias("rz"), "id")
    posed = geometry.rotation(panorama.camera_table(spark, cams), prefix="cam")
    seen = geometry.rays_to_pixels(rays.join(F.broadcast(posed)), matrix="cam")
    got = geometry.kept(seen, F.col("valid") & (F.col("px") >= 0) & (F.col("px") < 480)).select("id", "image_id", "px").collect()
    want = {}
    for r in rays.collect():
        for i, cam in cams.items():
            v = np.array([[r.rx, r.ry, r.rz]])
            x, _, ok = panorama.photo_places(cam, v / np.linalg.norm(v))
            if ok[0] and 0 <= x[0] < 480:
                want[r.id, i] = x[0]
    assert {(r.id, r.image_id): pytest.approx(r.px, abs=1e-2) for r in got} == want


def test_orientations():
    img = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    shapes = [photos.oriented(img, k).shape[:2] for k in range(1, 9)]
    assert shapes == [(2, 3)] * 4 + [(3, 2)] * 4
    assert photos.oriented(img, 6)[:, :, 0].tolist() == [[3, 0], [4, 1], [5, 2]]
    assert photos.oriented(img, 8)[:, :, 0].tolist() == [[2, 5], [1, 4], [0, 3]]
    assert photos.oriented(img, 5)[:, :, 0].tolist() == [[0, 3], [1, 4], [2, 5]]
    assert photos.oriented(img, 7)[:, :, 0].tolist() == [[5, 2], [4, 1], [3, 0]]


def test_media_boxes():
    body = b"\0\0\0\x10ftypcrx \0\0\0\1" + b"\0\0\0\x01moov" + (24).to_bytes(8, "big") + b"12345678" + b"\0\0\0\0mdatxyz"
    found = [(k, e - s) for k, s, e in photos.box_index(body)]
    assert [x for x in found if b"/" not in x[0]] == [(b"ftyp", 8), (b"moov", 8), (b"mdat", 3)]


def test_tags_of_a_cr3():
    def box(name, body):
        return (8 + len(body)).to_bytes(4, "big") + name + body

    def tiff(tag, value):
        return b"II*\0\x08\0\0\0\x01\0" + tag.to_bytes(2, "little") + b"\x02\0" + (len(value) + 1).to_bytes(4, "little") + b"\x1a\0\0\0\0\0\0\0" + value + b"\0"

    inner = box(b"CMT1", tiff(0x0110, b"Maker One")) + box(b"CMT2", tiff(0xA434, b"A long lens")) + box(b"CMT3", tiff(0x010F, b"not read"))
    data = box(b"ftyp", b"crx " + bytes(4)) + box(b"moov", box(b"free", b"xx") + box(b"uuid", photos.CANON_UUID + inner)) + box(b"uuid", bytes(16) + inner)
    assert photos.canon_tags(data) == {"model": "Maker One", "lens": "A long lens"}
    assert photos.canon_tags(data[:60]) == {} and photos.box_index(b"") == []


def test_registering_skips_known_paths(spark):
    from panolith.schema import EXIF, IMAGES

    old = spark.createDataFrame([(4, "/a.jpg", 1, 1, 1, 1, None, 50.0, "x", True)], IMAGES)
    new = spark.createDataFrame([("/a.jpg", 10, 10, None), ("/b.jpg", 4000, 3000, None), ("/b.jpg", 4000, 3000, None)], f"path string, width int, height int, exif {EXIF}")
    assert [(r.image_id, r.proxy_width, r.proxy_height, r.fov_hint) for r in images.register(new, old).collect()] == [(5, 1600, 1200, 50.0)]


def test_photo_stream(spark, tmp_path):
    from panolith.sources.encode import png
    from panolith.streaming.photos import photo_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png(np.zeros((4, 6, 3), np.uint8)))
    (tmp_path / "in" / "b.txt").write_text("no photo")
    q = photo_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.width, r.height) for r in spark.table("seen").select(F.col("width"), F.col("height")).collect()] == [(6, 4)]


def test_ransac_finds_a_map_of_few_inliers():
    r = np.random.default_rng(7)
    a, b = r.uniform(0, 1000, (100, 2)), r.uniform(0, 1000, (100, 2))
    b[:15] = a[:15] + [30.0, -20.0]
    assert kernels.ransac(a, b)[1][:15].all()


def test_align_takes_the_reference_number_of_features():
    import inspect

    from panolith.plans import panorama

    for f in (panorama.align, panorama.detect):
        assert inspect.signature(f).parameters["max_features"].default == 5000


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1000]", "k8s://host"])
def test_a_cluster_names_its_shared_folder(master):
    def fake(base):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: base), sparkContext=SimpleNamespace(master=master))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(fake(None))
    assert session.shared_folder(fake("hdfs://host/shared/")) == "hdfs://host/shared"


def test_written_tables_go(spark):
    def there(df):
        return df.count() == 3

    with session.temporary_tables(spark) as kept:
        a, b = (session.written(spark.range(3), name) for name in "ab")
        kept.append(b)
    assert there(b)
    with pytest.raises(Exception, match="(?i)path|file"):
        spark.read.parquet(a._panolith_folder)
    session.discard(b)
    with pytest.raises(Exception, match="(?i)path|file"):
        spark.read.parquet(b._panolith_folder)


def test_lenses_within_half_a_degree(spark):
    """Against a plain walk over the photos in the order of their ids."""
    r = np.random.default_rng(7)
    rows = [(int(i), int(r.choice([600, 800])), 400, r.choice(["A", "B", None]), float(r.choice([10.0, 10.04, 35.0, np.nan])), float(r.uniform(40, 60))) for i in range(300)]
    df = spark.createDataFrame([(*x[:4], None if x[4] != x[4] else x[4], x[5]) for x in rows], "image_id long, width int, height int, lens string, focal double, fov_hint double")
    first, want = [], {}
    for i, w, h, name, focal, fov in rows:
        mark = (name, round(0.0 if focal != focal else focal, 1))
        mine = next((k for k, size, m, f in first if size == (w, h) and (m == mark or abs(f - fov) < 0.5)), None)
        if mine is None:
            first.append((i, (w, h), mark, fov))
            mine = i
        want[i] = mine
    got = {x.image_id: x.lens_id for x in images.match_lenses(df).collect()}
    assert got == want and 2 < len(first) < 100


def test_photos_of_any_depth_are_read(spark, tmp_path):
    import struct
    import zlib

    def png(name, kind, row):
        chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
        head = struct.pack(">IIBBBBB", 2, 1, 8, kind, 0, 0, 0)
        (tmp_path / name).write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"\0" + row)) + chunk(b"IEND", b""))

    png("rgb.png", 2, bytes([1, 2, 3, 4, 5, 6]))
    png("gray.png", 0, bytes([9, 200]))
    png("alpha.png", 6, bytes([1, 2, 3, 255, 4, 5, 6, 255]))
    (tmp_path / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nnothing")
    got = {x.path.rsplit("/", 1)[1]: x for x in photos.decoded(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["alpha.png", "broken.png", "gray.png", "rgb.png"]
    assert [k for k, x in got.items() if x.failed] == ["broken.png"]
    assert bytes(got["rgb.png"].bgr) == bytes([3, 2, 1, 6, 5, 4]) and bytes(got["alpha.png"].bgr) == bytes([3, 2, 1, 6, 5, 4])
    assert bytes(got["gray.png"].bgr) == bytes([9, 9, 9, 200, 200, 200])
    small = photos.thumbs(photos.proxies(photos.decoded(spark, str(tmp_path)).withColumn("orientation", F.lit(1))), 1).collect()
    assert len(small) == 3 and all((x.thumb_width, x.thumb_height, len(x.thumb)) == (1, 1, 3) for x in small)


@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 0.77, 1.0])
def test_quantiles(spark, share):
    r = np.random.default_rng(8)
    groups = {0: r.normal(size=997), 1: np.repeat([1.0, 2.0, 3.0], 50), 2: np.array([4.5]), 3: np.r_[r.exponential(size=500), 1e9]}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [(0, None), (4, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {x.g: (x.q, x.n) for x in order.quantile(df, "v", share, ["g"], "q").collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for g, values in groups.items():
        assert got[g][0] == pytest.approx(float(np.quantile(values, share)), rel=1e-12) and got[g][1] == len(values)
    whole = np.concatenate(list(groups.values()))
    assert order.quantile(df, "v", share, [], "q").first().q == pytest.approx(float(np.quantile(whole, share)), rel=1e-12)


def test_smooth_gains_even_out_a_slope():
    """Two overlapping photos of one gray, one with a slope of light: gains bring both near their mean."""
    h, w = 120, 400
    slope = np.linspace(0.8, 1.2, 260)[None, :, None] * np.full((h, 1, 3), 120.0)
    a = kernels.Patch(0, 0, np.full((h, 240, 3), 120.0), np.ones((h, 240), bool))
    b = kernels.Patch(140, 0, slope, np.ones((h, 260), bool))
    fields = kernels.smooth_gains([a, b], (h, w), 1.0)
    before = abs(a.img[:, 140:].mean() - b.img[:, :100].mean())
    grown = [kernels.resized(f, w, h) for f in fields]
    after = abs((a.img * grown[0][a.box])[:, 140:].mean() - (b.img * grown[1][b.box])[:, :100].mean())
    assert after < 0.35 * before and all(0.5 < f.min() and f.max() < 1.95 for f in fields)
    assert all((f == 1).all() for f in kernels.smooth_gains([a], (h, w), 1.0))


@pytest.mark.parametrize("seams", [False, True])
def test_owners_share_out_what_is_covered(seams):
    r = np.random.default_rng(9)
    patches = []
    for _ in range(6):
        x, y, w, h = (int(v) for v in r.integers([0, 0, 20, 20], [60, 40, 60, 50]))
        patches.append(kernels.Patch(x, y, r.integers(0, 255, (h, w, 3)).astype(np.uint8), r.random((h, w)) < 0.95))
    shape = (100, 130)
    parts, total = kernels.owners(patches, shape, seams), np.zeros(shape, int)
    for p, part in zip(patches, parts):
        assert not (part & ~p.mask).any()
        total[p.box] += part
    covered = np.zeros(shape, bool)
    for p in patches:
        covered[p.box] |= p.mask
    assert total.max() == 1 and (total[covered] == 1).mean() > 0.9


def test_a_patch_is_found_again():
    r = np.random.default_rng(10)
    area = r.normal(size=(60, 70))
    x, y, score = kernels.ncc_best(area[20:41, 30:51] * 3 + 5, area)
    assert (x, y) == (30, 20) and score == pytest.approx(1.0)
    assert kernels.ncc_best(r.normal(size=(21, 21)), area)[2] < 0.6


def test_holes_take_the_nearest_colour():
    img, mask = np.zeros((40, 60, 3)), np.zeros((40, 60), bool)
    img[:, :20], img[:, 40:], mask[:, :20], mask[:, 40:] = 50.0, 200.0, True, True
    out = kernels.filled(img, mask)
    assert (out[mask] == img[mask]).all() and 50 <= out[:, 20:40].min() and out[:, 20:40].max() <= 200
    assert abs(out[20, 21, 0] - 50) < 80 and abs(out[20, 38, 0] - 200) < 80
