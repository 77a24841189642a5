"""The pipeline's stages, each on its own input."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from panolith.llm import neardup
from panolith.llm.packing import word_tokens
from panolith.llm.queries import QUERIES
from panolith.session import shared_folder, temporary_tables, written


def corpus(spark, docs_of, odd_rows):
    r = random.Random(11)
    words = [f"w{i}" for i in range(2000)]
    rows = list(odd_rows)
    for i in range(100, 300):
        t = [r.choice(words) for _ in range(80)]
        if i % 9 == 0:
            t[5], t[30], t[60] = "idiot", "scum", "Moron."
        rows.append((i, " ".join(t) + ("\nShared  footer" if i % 4 == 0 else "")))
    rows += [(300 + i, rows[20][1]) for i in range(6)]
    near = rows[21][1].split()
    rows += [(320 + i, " ".join([*near[:40], f"x{i}", *near[41:]])) for i in range(4)]
    return rows, docs_of(rows)


def test_stages(spark, docs_of, odd_rows, tmp_path):
    rows, docs = corpus(spark, docs_of, odd_rows)
    spark.createDataFrame([(i, 0, int("idiot" in t)) for i, t in rows if i and i >= 100], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    docs = written(docs, "documents")
    clean = written(pipeline.drop_toxic(spark, docs, sf), "clean")
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()}
    assert gone == {i for i, t in rows if t and "idiot" in t}
    lines = written(pipeline.drop_lines(spark, clean, sf), "lines")
    assert lines.count() == clean.count() and not [r for r in lines.collect() if r.text and "footer" in r.text]
    assert all(r.n_chars == len(r.text or "") for r in lines.collect())
    single = written(pipeline.drop_copies(spark, lines, sf), "single")
    kept = single.collect()
    left, all_ = ([set(neardup.shingle_hashes(r.text, 5).tolist()) for r in rows] for rows in (kept, lines.collect()))
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    assert not any(alike(a, b) for n, a in enumerate(left) for b in left[:n])
    assert all(any(len(a & b) >= 0.5 * len(a | b) for b in left) for a in all_)
    mixed = written(pipeline.mix(spark, single, sf), "mixed")
    assert sorted(map(repr, mixed.collect())) == sorted(map(repr, kept))
    packed = pipeline.pack(spark, mixed, sf)
    want = {r.doc_id: r.n for r in mixed.select("doc_id", word_tokens().alias("n")).collect()}
    got = {}
    for r in packed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    for frame in (clean, lines, single, mixed):
        assert frame.columns == docs.columns


def test_empty_corpus(spark, docs_of, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = written(docs_of([]), "documents")
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name.replace(" ", "_"))
        assert docs.count() == 0
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def tables_left(spark):
    return set(Path(shared_folder(spark).removeprefix("file:")).iterdir())


def test_run(spark):
    before = tables_left(spark)
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "bin_id", "capacity"} <= set(out.columns) and out.count() > 0
    assert len(tables_left(spark) - before) == 1  # the result


def test_operators_leave_no_tables(spark):
    before = tables_left(spark)
    for name in ("op2_cross_polytope", "op5_simhash"):
        with temporary_tables(spark):
            assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert tables_left(spark) == before


@pytest.mark.parametrize("block", [1 << 16, 600])
def test_near_dedup_is_by_similarity(spark, docs_of, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", block)
    r = random.Random(5)
    texts = []
    for g in range(40):
        base = [f"v{r.randrange(5000)}" for _ in range(120)]
        texts.append(" ".join(base))
        for edits in (1, 2, 2, 3, 3, 4, 4, 5, 6):
            t = list(base)
            for k in r.sample(range(len(t)), edits):
                t[k] = f"e{r.randrange(10**9)}"
            texts.append(" ".join(t))

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [shingles(t) for t in texts]
    up, pairs = list(range(len(texts))), 0

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                pairs += 1
                x, y = sorted((root(i), root(j)))
                up[y] = x
    assert pairs > 100
    want = {i for i in range(len(texts)) if root(i) == i}
    assert 40 < len(want) < len(texts) - 40
    got = [x.doc_id for x in pipeline.drop_copies(spark, docs_of(list(enumerate(texts))), "").collect()]
    assert sorted(got) == sorted(want)


def test_pairs_at_the_bound(spark, docs_of):
    """Pairs just over 0.8 lose one text each, pairs just under it none."""
    r = random.Random(8)
    texts, close = [], []
    while len(close) < 400:
        base = [f"v{r.randrange(5000)}" for _ in range(r.randrange(60, 160))]
        t = list(base)
        one = {tuple(base[i : i + 5]) for i in range(len(base) - 4)}
        for k in range(40):
            t[r.randrange(len(t))] = f"e{r.randrange(10**9)}"
            two = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
            j = len(one & two) / len(one | two)
            if j < 0.83:
                break
        if 0.76 <= j:
            close.append(j >= 0.8)
            texts += [" ".join(base), " ".join(t)]
    kept = {x.doc_id for x in pipeline.drop_copies(spark, docs_of(list(enumerate(texts))), "").collect()}
    lost = [2 * n + 1 not in kept for n in range(len(close))]
    assert all(2 * n in kept for n in range(len(close)))
    assert 100 < sum(close) < 300 and not any(x and not y for x, y in zip(lost, close))
    assert sum(x and y for x, y in zip(lost, close)) >= 0.99 * sum(close)


def plain_mix(rows, shares, block):
    """(slot, offset) of each (stream, length) row, streams in their order: earliest deadline first, slot by slot."""
    ends, places = {}, []
    for stream, n in rows:
        at = ends.get(stream, 0)
        ends[stream] = at + n
        places.append((stream, at // block, at % block))
    left = {s: -(-n // block) for s, n in ends.items()}
    done, slot_of, slot = dict.fromkeys(left, 0), {}, 0
    while left:
        period, got = sum(shares[s] for s in left), dict.fromkeys(left, 0)
        for t in range(10**6):
            due = [(-(-(got[s] + 1) * period // shares[s]), s) for s in sorted(left) if got[s] * period // shares[s] <= t]
            s = min(due)[1]
            if not left[s]:
                break
            slot_of[s, done[s]] = slot
            got[s], done[s], left[s], slot = got[s] + 1, done[s] + 1, left[s] - 1, slot + 1
        left = {s: n for s, n in left.items() if n}
    return [(slot_of[s, b], offset) for s, b, offset in places]


def test_mix_by_plain_version(spark, docs_of, odd_rows):
    r = random.Random(17)
    rows = [x for x in odd_rows if x[0] != 6] + [(100 + i, "x" * r.randrange(30_000)) for i in range(120)]
    docs = docs_of(rows)
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.concat(F.lit("src"), (F.col("doc_id") % 5).cast("string"))))
    known = docs.select("doc_id", "text", "source", F.xxhash64("doc_id", "text").alias("h")).collect()
    shares = {**pipeline.MIX_SHARES, "": 4}
    stream = lambda x: x.source if x.source in pipeline.MIX_SHARES else ""
    ordered = sorted(known, key=lambda x: (stream(x), x.h))
    places = plain_mix([(stream(x), max(1, len(x.text or ""))) for x in ordered], shares, 65_536)
    want = [(x.doc_id, x.text) for _, x in sorted(zip(places, ordered), key=lambda p: p[0])]
    assert len(set(places)) == len(places) and max(places)[0] > 10
    assert [(x.doc_id, x.text) for x in pipeline.mix(spark, docs, "").collect()] == want
