"""The two vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panolith.llm.ann import nearest
from panolith.llm.queries import op2_cross_polytope, op10_va_file
from panolith.llm.search import product_bounds, quantised
from panolith.llm.vafile import exact_top_k, products

SCHEMA = "vec_id long, embedding array<float>, label int, id string, dim int, score int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", 1, 2) for i, v in rows], SCHEMA)


def plain(rows, every, k, score, sign):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    out, seen = [], set()
    for i, q in sorted(ok, key=lambda r: (r[0], r[1].tolist())):
        if i % every or i in seen:
            continue
        seen.add(i)
        best = sorted((sign * score(q, v), j) for j, v in ok if j != i and len(v) == len(q))[:k]
        out += [(i, n + 1, j, sign * s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def odd(rng):
    rows = [(int(i), [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(400)]
    rows += [(1000, None), (1050, []), (1100, [1.0, None] + [0.0] * 6), (1150, [float("nan")] * 8), (1200, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]
    rows += [(1250, [1.0, 2.0]), (1300, [2.0, 1.0]), (401, rows[7][1]), (402, rows[7][1]), (402, rows[7][1])]
    rows += [(50, [3.0, 1.0]), (100, rows[3][1]), (100, rows[3][1])]  # ids of two vectors, of two lengths
    rows += [(2000 + i, rows[100][1]) for i in range(120)]  # one vector of many rows, queries among them
    return rows


def whole(v):
    return np.floor(256 * v)


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 60, "group_queries": 3}])
def test_exact_search(spark, blocks):
    rows = odd(np.random.default_rng(1))
    got = exact_top_k(vectors(spark, rows), k=5, every=50, **blocks)
    want = plain(rows, 50, 5, lambda a, b: int(whole(a) @ whole(b)), -1)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert exact_top_k(vectors(spark, rows).limit(0)).count() == 0


def test_exact_search_of_large_values(spark):
    q, r = np.array([1e17, 3.0]), np.array([[1e17, 1.0], [1e17, 2.0], [-5.0, 1.0]])
    score, value = products(q, r)
    assert score == [2**63 - 1, 2**63 - 1, -(5 * 10**17) + 3] and sorted(value) == value
    rows = [(50, [1e30, 2.0]), (1, [1e30, 1.0]), (2, [-1e30, 0.0]), (3, [1.0, 1.0]), (4, [2e30, 1.0])]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    want = [(1, 1, 2**63 - 1), (2, 3, 2**63 - 1), (3, 4, 2**63 - 1), (4, 2, -(2**63))]
    for k in (1, 4):
        got = sorted((x["rank"], x.vec_id, x.score) for x in exact_top_k(vectors(spark, rows), k=k).collect())
        assert got == want[:k]


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for scale in (1e-3, 1.0, 1e6):
        rows, q = rng.normal(size=(500, 13)) * scale * np.exp(rng.normal(size=(500, 1))), rng.normal(size=13)
        codes, step, rest = quantised(rows)
        lo, hi = product_bounds(q, codes.astype(float), step, rest)
        assert (lo <= -rows @ q).all() and (-rows @ q <= hi).all() and (hi - lo).mean() < 0.1 * np.abs(rows @ q).mean()


def test_no_rows_give_none(spark):
    rows = [(100, None), (None, [1.0]), (200, [0.0, 0.0])]
    assert nearest(vectors(spark, rows)).count() == nearest(vectors(spark, rows).limit(0)).count() == 0
    assert exact_top_k(vectors(spark, rows)).count() == 0 and nearest(vectors(spark, [(100, [1.0])])).count() == 0
    far = [(100, [1e38, 0.0]), (1, [1e-38, 1e-38]), (2, [3e38, 0.0])]
    assert [x.vec_id for x in nearest(vectors(spark, far)).orderBy("rank").collect()] == [1, 2]


def test_few_rows_give_all_candidates(spark):
    rows = [(i, [float(i), 1.0]) for i in range(5)]
    got = nearest(vectors(spark, rows), k=10, every=2)
    assert sorted((r.query_id, r.vec_id) for r in got.collect()) == [(q, i) for q in (0, 2, 4) for i in range(5) if i != q]


@pytest.mark.parametrize("blocks", [{}, {"bucket_entries": 100, "hot_entries": 5}])
def test_neighbours_are_exact_where_all_cells_are_opened(spark, blocks):
    rows = odd(np.random.default_rng(2)) + [(1350, [0.0] * 8)]
    sound = [(i, v) for i, v in rows if i != 1350]
    got = nearest(vectors(spark, rows), k=10, every=50, tables=2, share=1.0, **blocks).collect()
    want = plain(sound, 50, 10, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), 1)
    assert [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in sorted(got)] == [(q, n, i, round(s, 9)) for q, n, i, s in want]


def recall(e, got, k=10):
    """(recall, candidates per query as a share of the rows)."""
    ids = np.array(sorted(e))
    m, hit, met = np.array([e[i] for i in ids], float), 0, {}
    for q in ids[ids % 100 == 0]:
        d = ((m - m[np.searchsorted(ids, q)]) ** 2).sum(axis=1)
        true = [i for i in ids[np.lexsort((ids, d))] if i != q][:k]
        mine = [r.vec_id for r in got if r.query_id == q]
        assert len(mine) == k
        hit += len(set(true) & set(mine))
        met[q] = next(r.candidates for r in got if r.query_id == q)
    return hit / (k * len(met)), sum(met.values()) / len(met) / len(ids)


def test_recall_on_the_tables(spark):
    for sf, most in (("sf0.001", 1.0), ("sf0.1", 0.25)):
        folder = f"/root/testdata/{sf}"
        e = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
        found, met = recall(e, op2_cross_polytope(spark, folder).collect())
        assert found >= 0.9 and met <= most


def test_recall_with_unlike_norms(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(8000, 64)) * np.exp(rng.normal(size=(8000, 1)))
    e = {i: [float(x) for x in v.astype(np.float32)] for i, v in enumerate(m)}
    found, met = recall(e, nearest(vectors(spark, list(e.items()))).collect())
    assert found >= 0.9 and met < 0.12


def test_clusters_are_found_among_few_candidates(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(400, 32))
    m = centre[np.arange(8000) % 400] + 0.15 * rng.normal(size=(8000, 32))
    e = {i: [float(x) for x in v.astype(np.float32)] for i, v in enumerate(m)}
    found, met = recall(e, nearest(vectors(spark, list(e.items())), share=0.001, least_entries=0).collect())
    assert found >= 0.95 and met < 0.05


def test_va_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = op10_va_file(spark, folder).select("query_id", "rank", "vec_id", "score")
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 50, 5, lambda a, b: int(whole(a) @ whole(b)), -1)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert got.where(F.col("query_id") == F.col("vec_id")).count() == 0
