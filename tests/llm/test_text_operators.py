"""Each operator on documents against a plain version, with odd rows and clashing columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panolith.llm import linededup, queries
from panolith.llm.license import TEMPLATES, NoticeJoin, scan_licenses, words_of
from panolith.llm.linededup import drop_repeated_lines
from panolith.llm.mixing import mix_sources, pfair_pattern, pfair_phases
from panolith.llm.packing import cost, pack, pack_sequences, word_tokens
from panolith.llm.secrets import BANDS, CANDIDATE, DRIFT, ENCODINGS, KINDS, NAMED, SPREAD, false_discovery_steps, randomness, scan_secrets
from panolith.llm.simhash import allocation, fingerprint, near_duplicates
from panolith.llm.tokencount import PieceCounter, count_tokens
from panolith.llm.toxicity import called_for, ftrl, score_toxicity, train_toxicity

BLANKS = " \t\n\x0b\x0c\r"


def lower(s):
    return s.encode().lower().decode()


# --- line dedup


def plain_lines(rows, min_docs):
    seen = defaultdict(set)
    cut = [((t or "").split("\n")) for _, t in rows]
    for n, ((i, _), lines) in enumerate(zip(rows, cut)):
        for k in {lower(x.strip(BLANKS)) for x in lines} - {""}:
            seen[k].add(("row", n) if i is None else i)
    gone = {k for k, ids in seen.items() if len(ids) >= min_docs}
    out = []
    for (i, t), lines in zip(rows, cut):
        kept = [x for x in lines if lower(x.strip(BLANKS)) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept) if len(kept) < len(lines) else t))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [400_000, 0])
def test_line_dedup(spark, docs_of, odd_rows, monkeypatch, broadcast):
    monkeypatch.setattr(linededup, "BROADCAST_LINES", broadcast)
    r = random.Random(1)
    rows = odd_rows + [(100 + i, "\n".join(r.choice(["Menu ", " menu", "a", "b", "ÄHNLICH", "", f"own {i}"]) for _ in range(r.randrange(12)))) for i in range(60)]
    rows += [(500, f"one id, ten rows\n{i}") for i in range(10)] + [(None, f"no id, ten rows\n{i}") for i in range(10)]
    docs = docs_of(rows).withColumns({"n_lines": F.lit("clash"), "pos": F.lit(1), "h1": F.lit(2), "line": F.lit("x")})
    out = drop_repeated_lines(docs, min_docs=10)
    assert set(out.columns) == {*docs.columns, "n_dropped"}
    got = sorted([(x.doc_id, x.n_lines, x.n_dropped, x.text) for x in out.collect()], key=repr)
    assert got == plain_lines(rows, 10)
    assert drop_repeated_lines(docs.limit(0)).count() == 0


# --- mixing


@pytest.mark.parametrize("shares", [[1], [1, 1], [5, 3, 2], [7, 1, 1, 1], [20, 10, 3, 3, 3, 1]])
def test_pattern_deviates_less_than_a_block(shares):
    pattern, period = pfair_pattern(shares), sum(shares)
    assert sorted(t for slots in pattern for t in slots) == list(range(period))
    for slots, q in zip(pattern, shares):
        for t in range(period + 1):
            assert abs(sum(s < t for s in slots) - t * q / period) < 1


def test_phases_place_every_block_once():
    shares, blocks = {"a": 5, "b": 3, "c": 2}, {"a": 17, "b": 4, "c": 9}
    slots = []
    for s, first, end, share, period, base, pattern in pfair_phases(shares, blocks):
        slots += [(base + (b - first) // share * period + pattern[(b - first) % share], s, b) for b in range(first, end)]
    assert sorted(x[0] for x in slots) == list(range(30))
    assert Counter(x[1] for x in slots) == blocks
    by_source = defaultdict(list)
    for slot, s, b in sorted(slots):
        by_source[s].append(b)
    assert all(b == sorted(b) for b in by_source.values())


def test_mix(spark, docs_of, odd_rows):
    r = random.Random(2)
    rows = odd_rows + [(100 + i, "x" * r.randrange(400)) for i in range(600)]
    docs = docs_of(rows).withColumns({"mix_slot": F.lit("clash"), "c": F.lit(1), "g": F.lit(2), "before": F.lit(3)})
    out = mix_sources(docs, {"src0": 3, "src1": 1}, other_share=1, block_chars=1000).orderBy("mix_slot", "mix_offset").collect()
    assert len(out) == len(rows)
    assert len({(x.mix_slot, x.mix_offset) for x in out}) == len(rows)
    total, done = Counter(), Counter()
    for x in out:
        total[x.mix_stream] += max(1, len(x.text or ""))
    ends = {s: 0 for s in total}
    for x in out:
        at = x.mix_block * 1000 + x.mix_offset
        assert at == ends[x.mix_stream]
        ends[x.mix_stream] += max(1, len(x.text or ""))
    # While all streams last, each has its share of the slots within a block.
    last = min(max(x.mix_slot for x in out if x.mix_stream == s) for s in total)
    for x in out:
        if x.mix_slot < last:
            done[x.mix_stream] = max(done[x.mix_stream], x.mix_block + 1)
            share = {"src0": 3, "src1": 1, "": 1}[x.mix_stream]
            assert done[x.mix_stream] < (x.mix_slot + 1) * share / 5 + 1
    assert mix_sources(docs.limit(0), {"src0": 1}).count() == 0


def test_mix_of_one_row_repeated(spark, docs_of):
    docs = docs_of([(1, "same text")] * 1500 + [(i, "other") for i in range(2, 40)])
    out = mix_sources(docs, {"src1": 2}, block_chars=100).collect()
    at = sorted((x.mix_stream, x.mix_block * 100 + x.mix_offset, len(x.text)) for x in out)
    assert len(out) == 1538 and all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(at, at[1:]))


# --- token counts


def greedy(word, pieces):
    n = at = 0
    while at < len(word):
        size = max((k for k in range(1, len(word) - at + 1) if word[at : at + k] in pieces), default=1)
        n, at = n + 1, at + size
    return n


def test_automaton_is_greedy():
    r = random.Random(4)
    for _ in range(300):
        pieces = [bytes(r.choice(b"abc") for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, 12))]
        counter = PieceCounter(pieces)
        for _ in range(20):
            word = bytes(r.choice(b"abcd") for _ in range(r.randrange(0, 14)))
            assert counter.count(word) == greedy(word, set(pieces))


def test_token_counts(spark, docs_of, odd_rows, tmp_path):
    import base64

    pieces = [b" w1", b"w", b"1", b"23", b" same", b"text", b" ", b" te", b"xt"]
    path = tmp_path / "pieces"
    path.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % i for i, p in enumerate(pieces)))
    out = count_tokens(docs_of(odd_rows).withColumn("n_tokens", F.lit("clash")), str(path))
    got = sorted((repr(x.doc_id), x.n_words, x.n_tokens) for x in out.collect())
    want = [(repr(i), len((t or "").encode().split()), sum(greedy(b" " + w, set(pieces)) for w in (t or "").encode().split())) for i, t in odd_rows]
    assert got == sorted(want)
    assert count_tokens(docs_of(odd_rows).limit(0), str(path)).count() == 0


# --- toxicity


def test_toxicity_learns_words(spark, docs_of, odd_rows):
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows, marks = list(odd_rows), []
    for i in range(100, 900):
        t = [r.choice(words) for _ in range(r.randrange(5, 200))]
        bad = i % 7 == 0
        if bad:
            t[r.randrange(len(t))] = r.choice(["Scum,", "moron"])
        rows.append((i, " ".join(t)))
        marks.append((i, None if i % 50 == 1 else int(bad)))
    labels = spark.createDataFrame(marks + marks[:5] + [(None, 1)], "doc_id long, toxic int")
    docs = docs_of(rows).withColumn("score", F.lit("clash"))
    model = train_toxicity(docs, labels, width=1 << 14, l1=2.0)
    out = score_toxicity(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in out)
    right = [x.predicted == int(x.doc_id % 7 == 0) for x in out if x.doc_id and x.doc_id >= 100]
    assert sum(right) / len(right) > 0.97
    same = [x.score for x in out if x.doc_id == 6]
    assert same[0] == same[1]
    none = train_toxicity(docs.limit(0), labels.limit(0), width=1 << 10)
    assert all(x.score < 0.01 for x in score_toxicity(docs, none).collect())
    assert score_toxicity(docs.limit(0), model).count() == 0


def test_rare_features_change_nothing():
    r = np.random.default_rng(3)
    rows = [np.unique(np.append(r.zipf(1.3, 40) % 500, 500)).astype(np.int32) for _ in range(300)]
    marks = [bool(r.random() < 0.5) if 3 not in x else True for x in rows]
    args = (500, 4.0, 1.0, 5.0, 0.01, 4)
    keep = called_for(rows, 500, 5.0, 4)
    assert (keep == called_for([np.concatenate(rows)], 500, 5.0, 4)).all()
    few = [x[keep[x]] for x in rows]
    assert sum(map(len, few)) < sum(map(len, rows))
    whole = ftrl(rows, marks, *args)
    assert np.count_nonzero(whole) > 5 and (ftrl(few, marks, *args) == whole).all()


def plain_ftrl(rows, marks, width, alpha, beta, l1, l2, epochs):
    """FTRL-proximal coordinate by coordinate."""
    z, n = [0.0] * (width + 1), [0.0] * (width + 1)

    def weight(i):
        pull = 0.0 if i == width else l1
        if abs(z[i]) <= pull:
            return 0.0
        return -(z[i] - math.copysign(pull, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for row, y in zip(rows, marks):
            w = {i: weight(i) for i in row}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in row:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return [weight(i) for i in range(width + 1)]


def test_ftrl_is_the_method():
    r = np.random.default_rng(4)
    rows = [np.unique(np.append(r.integers(0, 30, 8), 30)) for _ in range(80)]
    marks = [bool(2 in x or 5 in x) for x in rows]
    args = (30, 1.0, 1.0, 0.5, 0.01, 3)
    got, want = ftrl(rows, marks, *args), plain_ftrl(rows, marks, *args)
    assert np.allclose(got, want, atol=1e-9) and np.count_nonzero(got) > 3


def plain_features(text, width):
    """Hashed words and pairs of words up to three apart, in whole numbers."""
    cut = [zlib.crc32(w.encode()) for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text or "")) if w]
    hashes = [h * 0x9E3779B97F4A7C15 for h in cut]
    for gap in (1, 2, 3):
        hashes += [(a * (0xC2B2AE3D27D4EB4F + 2 * gap) + b) * 0x165667B19E3779F9 for a, b in zip(cut, cut[gap:])]
    return sorted({(h % 2**64 >> 20) % width for h in hashes} | {width})


def test_toxicity_by_brute_force(spark, docs_of, odd_rows):
    """Training and scores of a small table against plain versions of every step."""
    r = random.Random(16)
    words = ["Scum!", "moron", *(f"w{i}" for i in range(40)), "ähnlich", "x-y"]
    rows = [x for x in odd_rows if x[0] != 5] + [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 30)))) for i in range(100, 220)]
    marks = {i: int("Scum" in t) for i, t in rows if i and i >= 100 and i % 3}
    labels = spark.createDataFrame(list(marks.items()), "doc_id long, toxic int")
    docs, width, args = docs_of(rows), 1 << 12, (4.0, 1.0, 1.5, 0.01, 5)
    model = train_toxicity(docs, labels, width=width, **dict(zip(("alpha", "beta", "l1", "l2", "epochs"), args)))
    order = spark.createDataFrame([(i,) for i in marks], "id long").select("id", F.xxhash64(F.lit(11), "id").alias("h"), (F.crc32(F.col("id").cast("string").cast("binary")) % 5).alias("m")).collect()
    assert all(x.m == zlib.crc32(str(x.id).encode()) % 5 for x in order)
    sample = [x.id for x in sorted(order, key=lambda x: x.h) if x.m]
    texts = dict(rows)
    w = plain_ftrl([plain_features(texts[i], width) for i in sample], [marks[i] for i in sample], width, *args)
    assert sum(x != 0 for x in w) > 5
    got = sorted((repr(x.doc_id), repr(x.text), x.score) for x in score_toxicity(docs, model).collect())
    want = sorted((repr(i), repr(t), 1 / (1 + math.exp(-sum(w[k] for k in plain_features(t, width))))) for i, t in rows)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert max(abs(a[2] - b[2]) for a, b in zip(got, want)) < 1e-6


def test_the_sample_is_bounded_and_repeatable(spark, docs_of):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["scum", "a", "b", "c", "d"]) for _ in range(6))) for i in range(400)]
    rows += [(3, "z " * 10)] * 3
    marks = spark.createDataFrame([(i, int("scum" in t)) for i, t in rows[:400]], "doc_id long, toxic int")
    docs = docs_of(rows)
    models = [train_toxicity(d, marks, train_rows=100, l1=1.0, **kw) for d, kw in ((docs, {}), (docs.repartition(7), {}), (docs, {"train_features": 300}))]
    assert models[0].index.tolist() == models[1].index.tolist() and models[0].weight.tolist() == models[1].weight.tolist()
    assert models[0].weight.tolist() != models[2].weight.tolist()


# --- simhash


def plain_fingerprint(text, k):
    w = lower(text or "").encode().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, differ):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= differ:
                up[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def near_rows(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    base = [[r.choice(words) for _ in range(r.randrange(3, 300))] for _ in range(n)]
    rows = []
    for i in range(4 * n):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((1000 + i, " ".join(t)))
    return rows


@pytest.mark.parametrize("shingle, differ, words", [(4, 4, 1), (5, 8, 1), (5, 19, 2)])
def test_simhash(spark, docs_of, odd_rows, shingle, differ, words):
    rows = odd_rows + near_rows(6, 60)
    fps = [sum(f << 64 * w for w, f in enumerate(fingerprint(t, shingle, words))) for _, t in rows]
    if words == 1:
        assert fps == [plain_fingerprint(t, shingle) for _, t in rows]
    part = plain_components(fps, differ)
    least = {}
    for (i, _), p in zip(rows, part):
        if i is not None:
            least[p] = min(i, least.get(p, i))
    docs = docs_of(rows).withColumns({"fingerprint": F.lit(1), "file": F.lit(2), "rep": F.lit(3)})
    want = sorted((repr(i), "".join(f"{f >> 64 * w & (1 << 64) - 1:016x}" for w in range(words)), repr(least.get(p))) for (i, _), f, p in zip(rows, fps, part))
    for carry, hot_rows in ((False, 1 << 16), (True, 4)):
        out = near_duplicates(docs, shingle, differ, words, carry=carry, hot_rows=hot_rows)
        assert sorted((repr(x.doc_id), x.fingerprint, repr(x.component_id)) for x in out.collect()) == want
    assert near_duplicates(docs.limit(0), shingle, differ, words).count() == 0


def test_allocation_covers_every_pair():
    import numpy as np

    r = np.random.default_rng(0)
    b = (r.random((4000, 64)) < 0.5).astype(float)
    b[:, 1] = b[:, 0]
    both = b.T @ b
    for n, differ in ((10**3, 4), (10**6, 4), (10**9, 4), (10**5, 10)):
        plan = allocation(n, both * n / 4000, differ)
        assert sum(t + 1 for _, t in plan) == differ + 1
        used = [x for g, _ in plan for x in g]
        assert len(used) == len(set(used))


# --- packing


SIZES = (512, 1024, 2048, 4096)


def total_cost(sizes):
    return sum(cost(c, 64, 24_576) for c in sizes)


def test_pack_places_all_and_downsizes():
    r = random.Random(7)
    lengths = [r.randrange(1, 4097) for _ in range(700)]
    bins, offsets, sizes = pack(lengths, SIZES, 64, 24_576)
    for b, size in enumerate(sizes):
        spans = sorted((offsets[i], offsets[i] + lengths[i]) for i in range(700) if bins[i] == b)
        assert spans[0][0] == 0 and all(a[1] == c[0] for a, c in zip(spans, spans[1:]))
        assert spans[-1][1] <= size and (size == 512 or spans[-1][1] > size // 2)
    assert sum(sizes) < 1.1 * sum(lengths)


def test_sizes_are_chosen_jointly():
    """Several sizes are used, and cost less than the largest alone with downsizing at the end."""
    r = random.Random(8)
    for most, gain in ((300, 0.03), (900, 0.03), (2000, 0.02), (4096, 0.01)):
        lengths = [min(most, int(r.expovariate(3 / most)) + 1) for _ in range(1500)]
        sizes = pack(lengths, SIZES, 64, 24_576)[2]
        alone = pack(lengths, (4096,), 64, 24_576)
        used = Counter()
        for n, b in zip(lengths, alone[0]):
            used[b] += n
        downsized = [next(c for c in SIZES if c >= u) for u in used.values()]
        assert total_cost(sizes) < (1 - gain) * total_cost(downsized)
        assert max(Counter(sizes).values()) < len(sizes)


def least_cost(lengths):
    """The cost of the best of all ways to deal the lengths to bins."""

    def go(i, bins):
        if i == len(lengths):
            return total_cost(next(c for c in SIZES if c >= b) for b in bins)
        ways = [bins[:k] + [b + lengths[i]] + bins[k + 1 :] for k, b in enumerate(bins) if b + lengths[i] <= 4096]
        return min(go(i + 1, w) for w in [*ways, [*bins, lengths[i]]])

    return go(0, [])


def test_pack_is_near_the_optimum():
    r, share = random.Random(9), []
    for _ in range(60):
        lengths = [r.randrange(1, r.choice([400, 1500, 4097])) for _ in range(r.randrange(1, 8))]
        share.append(total_cost(pack(lengths, SIZES, 64, 24_576)[2]) / least_cost(lengths))
    assert min(share) >= 1 - 1e-12 and max(share) < 1.5 and sum(share) / len(share) < 1.08


def test_pack_sequences(spark, docs_of, odd_rows):
    rows = odd_rows + [(100 + i, "w " * (i * 37 % 900)) for i in range(200)]
    docs = docs_of(rows).withColumns({"piece": F.lit("clash"), "total": F.lit(0)})
    out = pack_sequences(docs, word_tokens(), capacities=(64, 256, 1024)).collect()
    want, got = Counter(), Counter()
    for i, t in rows:
        want[i] += len((t or "").split()) + 1 if t is None or not t.strip(BLANKS) == "" else 1
    for x in out:
        got[x.doc_id] += x.length
        assert x.length <= x.capacity and x.bin_offset + x.length <= x.capacity
    assert got == want
    assert pack_sequences(docs.limit(0), word_tokens()).count() == 0


# --- licenses


def test_license_base_columns(spark, docs_of, odd_rows):
    rows = odd_rows + [
        (20, "Released under the MIT License. mit license, mit  license"),
        (21, "x CC-BY\nApache\nLicense y"),
        (22, "gnu general public license gnu general public licenses"),
        (23, "admit license"),
    ]
    out = {repr(x.doc_id) + str(x.n_words): x for x in scan_licenses(docs_of(rows).withColumn("score", F.lit("clash"))).collect()}
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
        places = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        x = out[repr(i) + str(len(w))]
        assert x.n_base == len(places) and x.base_labels == ",".join(sorted({label for _, label in places}))
        assert (x.first_word, x.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(filter(None, x.base_labels.split(","))) <= set(filter(None, x.labels.split(",")))
        assert 0 <= x.score <= 1
    assert scan_licenses(docs_of(rows).limit(0)).count() == 0


def test_notices_are_found(spark, docs_of):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    filler = "nothing of note " * 400
    out = {x.doc_id: x.labels for x in scan_licenses(docs_of([(1, filler + mit + filler), (2, filler), (3, "Licensed under CC BY-NC 4.0.")])).collect()}
    assert out == {1: "mit", 2: "", 3: "cc-by,cc-by-nc"}
    assert words_of("Äb-C3") == ["Äb".encode(), b"c3"]


def test_wrapped_notices_are_found(spark, docs_of):
    filler = "nothing of note\n" * 50
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:\n"
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed\n"
    cc = "This work is licensed under a Creative\nCommons Attribution 4.0\n\nInternational License.\n"
    apache = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
    rows = list(enumerate(filler + x + filler for x in (bsd, mpl, cc, apache, "mozilla redistribution commons apache permitted\n")))
    out = {x.doc_id: x for x in scan_licenses(docs_of(rows)).collect()}
    assert [out[i].labels for i in range(5)] == ["bsd", "mpl", "cc-by", "apache", ""]
    assert out[0].blocks == "bsd:150:171"
    assert any(int(b.split(":")[2]) - int(b.split(":")[1]) >= 60 for b in out[3].blocks.split(","))


def plain_blocks(words, notices, threshold):
    """Every window of every notice, by brute force: {(notice, first, end, containment)} of those that hold it."""
    full = set()
    for t, (_, notice) in enumerate(notices):
        of, size = set(notice), math.ceil(1.5 * len(notice))
        for e in range(1, len(words) + 1):
            at = [k for k in range(max(0, e - size), e) if words[k] in of]
            share = len({words[k] for k in at}) / len(of)
            if share >= threshold - 1e-9:
                full.add((t, at[0], at[-1] + 1, share))
    return full


def runs_of(full):
    """Windows that overlap, by notice, as one: {(notice, first, end, containment)}."""
    out = []
    for t, a, e, c in sorted(full, key=lambda x: (x[0], x[2], x[1])):
        if out and out[-1][0] == t and a < out[-1][2]:
            out[-1] = (t, out[-1][1], max(e, out[-1][2]), max(c, out[-1][3]))
        else:
            out.append((t, a, e, c))
    return set(out)


def test_notice_join_is_exact():
    r = random.Random(9)
    words = [b"%d" % i for i in range(60)]
    hits = 0
    for _ in range(100):
        notices = [(str(k), r.choices(words, k=r.randrange(2, 30))) for k in range(6)]
        join = NoticeJoin(notices, {w: r.randrange(50) for w in words}, 0.5)
        text = [r.choice(words) for _ in range(r.randrange(1, 300))]
        want = runs_of(plain_blocks(text, notices, 0.5))
        assert set(join.blocks(text)) == want
        hits += len(want)
    assert hits > 100


def test_license_blocks_by_brute_force(spark, docs_of, odd_rows):
    r = random.Random(10)
    rows = list(odd_rows)
    for i in range(60):
        parts = []
        for _ in range(r.randrange(1, 5)):
            words = r.choice(TEMPLATES)[1].split()
            for _ in range(r.randrange(3)):
                words[r.randrange(len(words))] = r.choice(["other", "License", "the", ""])
            parts.append("".join(w + r.choice([" ", " ", " ", "\n", "\n\n", "\n * ", "\n# ", " // "]) for w in words[: r.randrange(1, 2 * len(words))]))
            parts.append(" filler" * r.randrange(4))
        rows.append((100 + i, "".join(parts * r.randrange(1, 3))))
    found = scan_licenses(docs_of(rows)).collect()
    notices = [(label, words_of(t)) for label, t in TEMPLATES]
    want = []
    for i, t in rows:
        full = runs_of(plain_blocks(words_of(t or ""), notices, 0.9)) if i != 5 else set()
        spans = sorted({(a, e, notices[n][0]) for n, a, e, _ in full})
        want.append((repr(i), ",".join(f"{label}:{a}:{e}" for a, e, label in spans), {label for *_, label in spans}, max((c for *_, c in full), default=0.0)))
    assert sum(bool(w[1]) for w in want) > 20
    by = lambda x: (x[0], x[1])
    for x, (i, blocks, labels, share) in zip(sorted(found, key=lambda x: (repr(x.doc_id), x.blocks)), sorted(want, key=by), strict=True):
        assert (repr(x.doc_id), x.blocks) == (i, blocks)
        base = set(filter(None, x.base_labels.split(",")))
        assert x.labels == ",".join(sorted(base | labels)) and x.score == (1.0 if x.n_base else share)


def test_notices_of_a_table(spark, docs_of):
    table = spark.createDataFrame([("own", "All rights reserved by the makers"), ("own", "All rights reserved by the makers"), (None, "x y"), ("none", "--")], "label string, notice string")
    out = scan_licenses(docs_of([(1, "(c) all rights\nreserved, by\n\nthe makers"), (2, "x y --")]), templates=table).collect()
    assert sorted((x.doc_id, x.labels) for x in out) == [(1, "own"), (2, "")]


def test_many_phrases_in_one_text(spark, docs_of):
    began = time.time()
    x = scan_licenses(docs_of([(1, "mit license " * 200_000)])).first()
    assert (x.n_base, x.first_word, x.last_word) == (200_000, 0, 399_998) and time.time() - began < 60


# --- secrets


def plain_base(text):
    spans = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        if kind == "hex":
            pattern = "[0-9a-f]+"
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m.group(group)) >= least:
                spans.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))


def test_secrets(spark, docs_of, odd_rows):
    r = random.Random(9)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    base64 = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    rows = odd_rows + [
        (20, f"ä PassWord: 'hunter22' token=ab token ==abcdefg secret=token=abcdef \U0001f600 {hexes(40)}"),
        (21, "AKIA" + "A1" * 8 + " AKIAX AKIAAKIA" + "B" * 14),
        (22, f"{hexes(23)} {hexes(24)}g{hexes(30)}"),
    ]
    random_ones = [(100 + i, f"key {base64(48)} end") for i in range(30)]
    plain_ones = [(200 + i, "aninternationalconstitutionalestablishment" * 2) for i in range(5)]
    docs = docs_of(rows + random_ones + plain_ones).withColumns({"secrets": F.lit("clash"), "start": F.lit(1), "token": F.lit("x")})
    out = scan_secrets(docs).collect()
    assert len(out) == docs.count()
    got = sorted((repr(x.doc_id), ",".join(f"{s.kind}:{s.start}:{s.end}" for s in x.secrets if s.kind != "random")) for x in out)
    assert got == sorted((repr(i), plain_base(t or "")) for i, t in rows + random_ones + plain_ones)
    drawn = {x.doc_id for x in out for s in x.secrets if s.kind == "random"}
    assert len(drawn & {i for i, _ in random_ones}) >= 27
    assert not drawn & {i for i, _ in plain_ones}
    assert scan_secrets(docs.limit(0)).count() == 0


def plain_randomness(token):
    """The battery in NumPy, with the exact normal tail."""
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    a, kappa = next(((a, k) for a, k in ENCODINGS if set(token) <= set(a)), (None, None))
    if a is None:
        return 1.0
    v, n, size = np.array([a.index(c) + 1.0 for c in token]), len(token), len(a)
    chi = (np.bincount(v.astype(int)) ** 2).sum() * size / n - n
    extra = n * (size * kappa - 1)
    p = [tail((size - 1 + extra - chi) / math.sqrt(2 * (size - 1 + 2 * extra)))]
    high = v > (size + 1) / 2
    expected = 2 * high.sum() * (n - high.sum()) / n + 1
    z_runs = (1 + (high[1:] != high[:-1]).sum() - expected) / math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9))
    d = v - v.mean()
    z_pairs = ((d[1:] * d[:-1]).sum() / max((d * d).sum(), 1e-9) + 1 / n) * math.sqrt(n)
    if min(2 * tail(abs(z_runs)), 2 * tail(abs(z_pairs))) < 0.001:
        return 1.0
    drift = DRIFT * math.sqrt(n)
    p += [tail((drift - z_runs) / SPREAD), tail((z_pairs + drift) / SPREAD)]
    x = -sum(math.log(max(q, 1e-30)) for q in p)
    return math.exp(-x) * (1 + x + x * x / 2)


def some_tokens(r):
    alphabets = [a for a, _ in ENCODINGS]
    out = ["".join(r.choice(r.choice(alphabets[:k])) for _ in range(r.randrange(20, 90))) for k in range(1, len(alphabets)) for _ in range(6)]
    out += ["".join(r.choice(a) for _ in range(r.randrange(20, 90))) for a in alphabets for _ in range(6)]
    return out + ["a" * 30, "abcdefghijklmnopqrstuvwxyz", "ab" * 15, "aninternationalconstitutionalestablishment", "01234567890123456789"]


def test_randomness_is_the_battery(spark):
    tokens = some_tokens(random.Random(12))
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", randomness(F.col("t")).alias("p")).collect()
    for x in got:
        want = plain_randomness(x.t)
        assert abs(math.log10(max(x.p, 1e-30)) - math.log10(max(want, 1e-30))) < 0.02 + 0.05 * max(0, -math.log10(max(want, 1e-30)) - 4), x.t


def test_random_spans_pass_the_control(spark, docs_of):
    """The random spans are those that a Benjamini-Hochberg control of each band of lengths passes."""
    r = random.Random(13)
    tokens = [t for t in some_tokens(r) if re.fullmatch(CANDIDATE, t)] + ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(20, 60))) for _ in range(200)]
    rows = [(i, f"x {t} y") for i, t in enumerate(tokens)]
    got = {x.doc_id for x in scan_secrets(docs_of(rows)).collect() if any(s.kind == "random" for s in x.secrets)}
    p = spark.createDataFrame([(t,) for t in tokens], "t string").select(randomness(F.col("t")).alias("p")).collect()
    step = [min(math.floor(-math.log10(max(x.p, 1e-30)) * 20), 600) for x in p]
    band = [max(k for k, low in enumerate(BANDS) if len(t) >= low) for t in tokens]
    want = set()
    for k in range(len(BANDS)):
        mine = sorted((10 ** (-step[i] / 20), i) for i in range(len(tokens)) if band[i] == k)
        last = max((q for place, (q, _) in enumerate(mine, 1) if q * len(mine) <= 0.05 * sum(v <= q for v, _ in mine)), default=-1)
        want |= {i for q, i in mine if q <= last and not re.fullmatch(NAMED, tokens[i])}
    assert got == want and 30 < len(want) < len(tokens) - 100


def test_many_digests_in_one_text(spark, docs_of):
    r = random.Random(14)
    lines = [f"{r.getrandbits(160):040x}" for _ in range(100_000)]
    docs = docs_of([(1, "\n".join(f"ok {x}" for x in lines)), (2, "\n".join(f"token: {x}" for x in lines[:30_000]))])
    began = time.time()
    a, b = sorted(scan_secrets(docs).collect(), key=lambda x: x.doc_id)
    assert time.time() - began < 90
    assert [(s.start, s.end) for s in a.secrets] == [(44 * i + 3, 44 * i + 43) for i in range(100_000)]
    assert Counter(s.kind for s in b.secrets) == {"assign": 30_000, "hex": 30_000}


def test_false_discovery_steps():
    assert false_discovery_steps([], 0.05) == [601] * 4
    # 10 of 10 candidates at p = 1e-3: 1e-3 * 10 <= 0.05 * 10
    assert false_discovery_steps([(0, 60, 10)], 0.05)[0] == 60
    # 1 at p = 0.1 among 10: never
    assert false_discovery_steps([(1, 20, 1), (1, 0, 9)], 0.05)[1] == 601


def test_query_columns(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["op6_line_dedup"](spark, sf)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    empty = got.where("n_lines = n_dropped").first()
    assert empty is None or empty.kept_sha256 == hashlib.sha256(b"").hexdigest()


def test_large_shards_are_cut(spark, docs_of):
    docs = docs_of([(i, "x") for i in range(30)])
    out = pack_sequences(docs, F.lit(4096 * 1000), shard=F.when(F.col("doc_id") < 29, "a").otherwise("b")).collect()
    shards = Counter(x.bin_id.split(":")[0] for x in out)
    assert len(out) == 30_000 == len({(x.doc_id, x.piece) for x in out})
    assert max(shards.values()) < 9000 and shards["b"] == 1000 and all(k[0] == "a" for k in shards if k != "b")
