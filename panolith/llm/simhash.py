"""SimHash near-dedup: fingerprints of word shingles, linked by a generalised pigeonhole search."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panolith.llm.texts import map_texts
from panolith.operators.graph import connected_components
from panolith.session import discard, written

#: Shingles hashed at a time, and rows of a bucket compared at a time.
SHINGLES, ROWS = 1 << 16, 2048
#: Fingerprints of a bucket that one task compares.
HOT_ROWS = 1 << 16


def fingerprint(text: str | None, shingle: int, words: int = 1) -> list[int]:
    """`words` 64-bit SimHash words of the text's shingles; see `near_duplicates`."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return [0] * words
    last = max(1, len(tokens) - shingle + 1)
    ones = np.zeros((words, 64), dtype=np.int64)
    for s in range(0, last, SHINGLES):
        parts = [b" ".join(tokens[i : i + shingle]) for i in range(s, min(last, s + SHINGLES))]
        for w in range(words):
            h = np.array([xxhash.xxh64_intdigest(p, 42 + w) for p in parts], dtype="<u8")
            ones[w] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return [int(sum(1 << b for b in np.flatnonzero(2 * row > last).tolist())) for row in ones]


def fingerprints(docs: DataFrame, text: str, shingle: int, words: int) -> DataFrame:
    """`docs` without `text`, with fp0, fp1, ... as signed 64-bit integers."""

    def make():
        def run(texts: list) -> list[list]:
            made = np.array([fingerprint(t, shingle, words) for t in texts], dtype=np.uint64).reshape(-1, words)
            return [np.ascontiguousarray(made[:, w]).view(np.int64).tolist() for w in range(words)]

        return run

    return map_texts(docs, text, ", ".join(f"fp{w} long" for w in range(words)), make)


def bit_counts(classes: DataFrame, words: int) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each pair of bits how many have both set.

    Every row counts; tasks add up 64 x words squared numbers each, and Spark adds the tasks'.
    """
    bits = 64 * words

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((bits, bits), dtype=np.int64)
        for batch in batches:
            for s in range(0, len(batch), 1 << 14):
                b = unpacked(batch.iloc[s : s + (1 << 14)].to_numpy(dtype=np.int64)).astype(np.float32)
                both += (b.T @ b).astype(np.int64)
        yield pd.DataFrame({"i": np.repeat(np.arange(bits), bits), "j": np.tile(np.arange(bits), bits), "n": both.ravel()})

    cols = [f"fp{w}" for w in range(words)]
    n = classes.count()
    rows = classes.select(*cols).mapInPandas(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((bits, bits))
    for i, j, c in rows:
        both[i, j] = c
    return n, both


def unpacked(fps: np.ndarray) -> np.ndarray:
    """One column per bit, least first, of rows of signed 64-bit words."""
    return np.unpackbits(np.ascontiguousarray(fps).astype("<i8").view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")


def partitions(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m groups of nearly equal size, each grown around correlated bits.

    The uncorrelated rest keeps the groups independent of each other, which is what lets
    unequal thresholds pay.
    """
    bits = len(both)
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    left, groups = set(range(bits)), []
    for g in range(m):
        size = bits // m + (g < bits % m)
        group = [max(left, key=lambda b: (tie[b, sorted(left)].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (tie[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def agreement(n: int, both: np.ndarray, group: list[int]) -> np.ndarray:
    """Estimated chance that two fingerprints differ in exactly t bits of the group, for each t.

    Bits are chained, each after the earlier bit it is tied to most, so that correlated bits
    count less than independent ones.
    """
    p = np.clip(np.diag(both)[group] / max(n, 1), 0.01, 0.99)
    joint = both[np.ix_(group, group)] / max(n, 1)
    tie = (joint - np.outer(p, p)) / np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    chance = np.ones(1)
    for i, x in enumerate(p):
        same = x * x + (1 - x) * (1 - x)
        if i:
            same += (1 - same) * min(0.95, float(np.max(tie[i, :i] ** 2)))
        chance = np.append(chance * same, 0) + np.insert(chance * (1 - same), 0, 0)
    return chance


def allocation(n: int, both: np.ndarray, differ: int, most_partitions: int = 16) -> list[tuple[list[int], int]]:
    """The cheapest (bits, threshold) groups that find every pair with at most `differ` differing bits.

    If the thresholds of m groups add up to differ - m + 1, a pair above the threshold of every
    group would differ in more than `differ` bits. For each m, dynamic programming over the
    groups finds the thresholds of least cost: rows filed (a row is filed once for each way
    to leave out threshold bits of its group) plus the estimated pairs that share a file. A
    threshold of -1 leaves a group out.
    """
    best = (float("inf"), [])
    bits = len(both)
    for m in range(1, min(most_partitions, differ + 1, bits) + 1):
        groups = partitions(n, both, m)
        total = differ - m + 1
        costs = []
        for group in groups:
            chance, cost, pairs = agreement(n, both, group), {-1: 0.0}, 0.0
            for t in range(0, min(total, len(group) - 1) + 1):
                files = comb(len(group), t)
                if files > 4096:
                    break
                pairs = sum(chance[d] * comb(len(group) - d, t - d) for d in range(t + 1))
                cost[t] = FILE_COST * n * files + 0.5 * n * n * pairs
            costs.append(cost)
        # state: spent thresholds, with each -1 giving one more to spend elsewhere
        plans = {0: (0.0, [])}
        for cost in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for spent, (c, chosen) in plans.items():
                for t, more in cost.items():
                    if spent + t <= total + m and (spent + t not in step or c + more < step[spent + t][0]):
                        step[spent + t] = (c + more, [*chosen, t])
            plans = step
        if total in plans and plans[total][0] < best[0]:
            best = (plans[total][0], [(g, t) for g, t in zip(groups, plans[total][1], strict=True) if t >= 0])
    if not best[1]:
        raise ValueError(f"no groups of {bits} bits find all pairs that differ in {differ}")
    return best[1]


#: What filing, sorting and reading one row costs, in compared pairs.
FILE_COST = 40.0


def filed(classes: DataFrame, plan: list[tuple[list[int], int]], words: int) -> DataFrame:
    """(file, fp0, ...): each fingerprint once for each group and each way to leave out threshold bits."""
    masks = []
    for g, (group, t) in enumerate(plan):
        for out in combinations(group, t):
            keep = [0] * words
            for b in set(group) - set(out):
                keep[b // 64] |= 1 << b % 64
            masks.append((g * 1_000_003 + len(masks), keep))
    cols = [f"fp{w}" for w in range(words)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), ROWS):
                fps = batch[cols].iloc[s : s + ROWS].to_numpy(dtype=np.int64).view(np.uint64)
                for first in range(0, len(masks), 64):
                    files = [file_id(fps, number, keep) for number, keep in masks[first : first + 64]]
                    made = pd.DataFrame({"file": np.concatenate(files).view(np.int64)})
                    for w, c in enumerate(cols):
                        made[c] = np.tile(fps[:, w], len(files)).view(np.int64)
                    yield made

    return classes.select(*cols).mapInPandas(run, "file long, " + ", ".join(f"{c} long" for c in cols))


def dealt(rows: DataFrame, classes: DataFrame, plan: list[tuple[list[int], int]], words: int, hot_rows: int) -> DataFrame:
    """`rows` of `filed` with files of over `hot_rows` rows dealt to several.

    Such a file's rows fall into blocks by hash, and each pair of blocks becomes a file, so every
    pair of rows still meets and none holds more than about two blocks. A file that leaves out t
    bits joins 2^t keys of its group, so if no key of any group is large, no file is, and
    the sizes of the files need not be counted.
    """
    keys = filed(classes, [(group, 0) for group, _ in plan], words).groupBy("file").count()
    largest = keys.agg(F.max("count")).first()[0] or 0
    if largest << max((t for _, t in plan), default=0) <= hot_rows:
        return rows
    return deal_hot(rows, [f"fp{w}" for w in range(words)], hot_rows)


def deal_hot(rows: DataFrame, cols: list[str], hot_rows: int) -> DataFrame:
    """`rows` of (file, cols) with files of over `hot_rows` rows dealt by pairs of blocks."""
    sizes = written(rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows), "hot_files")
    if not sizes.count():
        return rows
    blocks = F.ceil(F.col("n") / hot_rows)
    own = F.pmod(F.xxhash64(*cols), blocks)
    pair = F.struct(F.least("own", "other"), F.greatest("own", "other"))
    hot = rows.join(sizes, "file").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    hot = hot.select(F.xxhash64("file", pair).alias("file"), *cols)
    return rows.join(sizes, "file", "left_anti").select("file", *cols).unionByName(hot)


def file_id(fps: np.ndarray, number: int, keep: list[int]) -> np.ndarray:
    """A 64-bit mix of the mask's number and the kept bits; a clash only adds candidates."""
    h = np.full(len(fps), (number * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64, dtype=np.uint64)
    for w, k in enumerate(keep):
        h ^= fps[:, w] & np.uint64(k)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(29)
    return h


class Forest:
    """Disjoint sets of fingerprints that one task has linked."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (above := up.get(root, root)) != root:
            root = above
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            a, b = min(a, b), max(a, b)
            self.up[b] = a
            self.up.setdefault(a, a)


def verify(rows: np.ndarray, files: np.ndarray, differ: int, forest: Forest) -> None:
    """Link the rows of equal file whose words differ in at most `differ` bits.

    `files` is sorted. Short runs are compared by shifting all of them at once; in a long run
    each row found is compared with the rows not yet found, block by block.
    """
    edge = np.flatnonzero(np.r_[True, files[1:] != files[:-1], True])
    size = np.diff(edge)
    short = np.repeat((size >= 2) & (size <= 256), size)
    x, f = rows[short], files[short]
    shift = 1
    while len(x) > shift:
        same = f[shift:] == f[:-shift]
        if not same.any():
            break
        a, b = x[:-shift][same], x[shift:][same]
        near = np.bitwise_count(a ^ b).sum(axis=1) <= differ
        link(a[near], b[near], forest)
        shift += 1
    for k in np.flatnonzero(size > 256):
        long_run(np.unique(rows[edge[k] : edge[k + 1]], axis=0), differ, forest)


def long_run(run: np.ndarray, differ: int, forest: Forest) -> None:
    """Links of a spanning forest of the run; a row that has been reached is compared no more."""
    unseen = np.ones(len(run), dtype=bool)
    while unseen.any():
        todo = [int(np.argmax(unseen))]
        unseen[todo[0]] = False
        while todo:
            i = todo.pop()
            rest = np.flatnonzero(unseen)
            if not len(rest):
                break
            near = rest[np.bitwise_count(run[rest] ^ run[i]).sum(axis=1) <= differ]
            unseen[near] = False
            link(np.repeat(run[i : i + 1], len(near), axis=0), run[near], forest)
            todo.extend(near.tolist())


def link(a: np.ndarray, b: np.ndarray, forest: Forest) -> None:
    for p, q in zip(map(tuple, a.tolist()), map(tuple, b.tolist()), strict=True):
        if p != q:
            forest.join(p, q)


def links(filed_rows: DataFrame, words: int, differ: int) -> DataFrame:
    """(a0, ..., b0, ...): links that join what is linked in each task's files, at most one per row."""
    cols = [f"fp{w}" for w in range(words)]
    out = ", ".join(f"{s}{w} long" for s in "ab" for w in range(words))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest()
        kept_rows, kept_files = np.zeros((0, words), np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            rows = np.concatenate([kept_rows, batch[cols].to_numpy(dtype=np.int64).view(np.uint64)])
            files = np.concatenate([kept_files, batch["file"].to_numpy()])
            cut = int(np.searchsorted(files, files[-1])) if len(files) else 0
            if cut:
                verify(rows[:cut], files[:cut], differ, forest)
            kept_rows, kept_files = rows[cut:], files[cut:]
        if len(kept_files):
            verify(kept_rows, kept_files, differ, forest)
        made = [(x, forest.find(x)) for x in list(forest.up)]
        made = [(x, r) for x, r in made if x != r]
        for s in range(0, len(made), 1 << 15):
            flat = np.array([[*x, *r] for x, r in made[s : s + (1 << 15)]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame(flat, columns=[f"{s}{w}" for s in "ab" for w in range(words)])

    n = filed_rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return filed_rows.repartition(int(n), "file").sortWithinPartitions("file").mapInPandas(run, out)


def near_duplicates(
    docs: DataFrame, shingle: int = 5, differ: int = 4, words: int = 1, text: str = "text", doc_id: str = "doc_id", carry: bool = True, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """`docs` with `fingerprint` (hexadecimal) and `component_id`, the least doc_id linked to it.

    Texts are lower-cased in A-Z and cut into words at ASCII white space; shingles of `shingle`
    words, repeats included, are hashed with XXH64 (seed 42, 43 for a second word of the
    fingerprint, and so on), and a bit is set if it is in over half the hashes. A text with
    fewer words is one shingle; a null or empty one, or one of white space, has fingerprint
    zero, which links like any other. Fingerprints with at most `differ` differing bits are
    linked, and components follow links.

    Equal fingerprints form a class, and only classes are searched, by `allocation`'s
    thresholds from statistics of all classes. Rows filed under equal kept bits are sorted into
    one task's stream and verified there, those of a file over `hot_rows` in several (see `dealt`); a task sends on a spanning forest of its links, never
    pairs, which loses no connection. Null doc_ids form components like others and don't
    count for the least id. Repeated rows are returned each. With carry False only doc_id comes along.
    """
    cols = [f"fp{w}" for w in range(words)]
    keep = [c for c in docs.columns if c not in ("fingerprint", "component_id")] if carry else [doc_id]
    ids = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), F.xxhash64(text).alias("__t"))
    prints = written(fingerprints(ids, "__text", shingle, words), "fingerprints")
    classes = written(prints.groupBy(*cols).agg(F.min("__id").alias("rep")), "classes")
    n, both = bit_counts(classes, words)
    plan = allocation(n, both, differ)
    found = written(links(dealt(filed(classes, plan, words), classes, plan, words, hot_rows), words, differ), "links")
    # Classes get numbers by their fingerprint; a class that is linked gets its component's.
    if words == 1:
        edges = found.select(F.col("a0").alias("u"), F.col("b0").alias("v"))
        number = F.col("fp0")
    else:
        edges = found.select(F.xxhash64(*[f"a{w}" for w in range(words)]).alias("u"), F.xxhash64(*[f"b{w}" for w in range(words)]).alias("v"))
        number = F.xxhash64(*cols)
    parts = written(connected_components(edges), "components")
    numbered = classes.withColumn("node", number).join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    numbered = written(numbered.select(*cols, "rep", "part"), "numbered")
    least = written(numbered.groupBy("part").agg(F.min("rep").alias("__least")), "least")
    of_class = written(numbered.join(least, "part").select(*cols, "__least"), "class_components")
    for old in (found, parts, numbered, least):
        discard(old)
    hexes = F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in cols])
    if not carry:
        out = prints.join(of_class, cols).select(F.col("__id").alias(doc_id), hexes.alias("fingerprint"), F.col("__least").alias("component_id"))
        return out
    known = prints.groupBy("__id", "__t").agg(*[F.first(c).alias(c) for c in cols])
    of_doc = written(known.join(of_class, cols).select("__id", "__t", hexes.alias("__hex"), "__least"), "document_components")
    joined = docs.join(of_doc, docs[doc_id].eqNullSafe(of_doc["__id"]) & (F.xxhash64(docs[text]) == of_doc["__t"]))
    return joined.select(*[docs[f"`{c}`"] for c in keep], F.col("__hex").alias("fingerprint"), F.col("__least").alias("component_id"))
