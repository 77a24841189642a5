"""Near-dedup by exact shingle similarity: fingerprints and minima find groups to search, sets of shingles decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panolith.llm.simhash import HOT_ROWS, SHINGLES, Forest, allocation, bit_counts, deal_hot, filed, links
from panolith.llm.texts import map_texts, whole_groups
from panolith.operators.graph import connected_components
from panolith.session import discard, written

#: Bands and minima of each: of pairs of similarity 0.8, 1 - (1 - 0.8 ** 5) ** 20 = 99.96 % share a band.
BANDS, MINIMA = 20, 5
#: The pigeonhole search over the 128 fingerprint bits finds all pairs that differ in so many; at similarity
#: 0.8 the mean is 19.4 and the deviation 4.1, so that the bands have to find most pairs near the bound.
PIGEONHOLE_BITS = 6
#: Rows of one file are kept together up to so many differing bits; the mean of two unrelated texts is 64.
FILE_BITS = 40
#: Of the 100 minima so many must agree, in their low bytes, before two sets are compared. At similarity
#: 0.8 the mean is 80 and the deviation 4; fewer agree in one pair of a million.
AGREE = 60
#: Shingles of one block of a group, which one call compares.
BLOCK_SHINGLES = 1 << 16
_R = np.random.default_rng(42)
_XOR, _MUL = (_R.integers(0, 1 << 64, BANDS * MINIMA, dtype=np.uint64) for _ in "ab")
_MUL |= np.uint64(1)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles of ASCII-lower-cased words; a text of fewer words is one, a blank one has none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    found = {b" ".join(tokens[i : i + shingle]) for i in range(max(1, len(tokens) - shingle + 1))} if tokens else set()
    return np.array(sorted(map(xxhash.xxh64_intdigest, found)), dtype=np.uint64)


def remixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sketch(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprint words of a set of hashes, and its minima."""
    ones = np.zeros(128, dtype=np.int64)
    least = np.full(BANDS * MINIMA, 2**64 - 1, dtype=np.uint64)
    for s in range(0, len(h), SHINGLES // 16):
        part = h[s : s + SHINGLES // 16]
        two = np.stack([part, remixed(part)], axis=1).astype("<u8")
        ones += np.unpackbits(two.view(np.uint8).reshape(len(part), 16), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        least = np.minimum(least, ((part[:, None] ^ _XOR) * _MUL).min(axis=0))
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8"), least


def sketches(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """`docs` without `text`, with a number of the set, its size, two fingerprint words, the bands' hashes, and low bytes of the minima."""

    def make():
        def run(texts: list) -> list[list]:
            out: list[list] = [[], [], [], [], [], []]
            for t in texts:
                h = shingle_hashes(t, shingle)
                words, least = sketch(h)
                bands = np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, MINIMA))], dtype="<u8")
                number = np.array([xxhash.xxh64_intdigest(h.tobytes())], dtype=np.uint64)
                signed = np.concatenate([number, words]).view(np.int64).tolist()
                for column, value in zip(out, [signed[0], len(h), *signed[1:], bands.tobytes(), (least >> np.uint64(7)).astype(np.uint8).tobytes()], strict=True):
                    column.append(value)
            return out

        return run

    return map_texts(docs, text, "node long, shingles int, fp0 long, fp1 long, bands binary, low binary", make)


def band_files(classes: DataFrame) -> DataFrame:
    """(file, fp0, fp1): each fingerprint once for each of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<i8")
            words = [np.repeat(batch.column(w).to_numpy(), BANDS) for w in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (files, *words)], names=["file", "fp0", "fp1"])

    return classes.select("bands", "fp0", "fp1").mapInArrow(run, "file long, fp0 long, fp1 long")


def candidate_groups(classes: DataFrame, hot_rows: int) -> DataFrame:
    """(node, group): classes that the search of the fingerprints' files has joined; groups of one are left out.

    Files are those of a pigeonhole plan and those of the bands; in each, fingerprints that differ
    in at most FILE_BITS bits are joined.
    """
    prints = written(classes.select("fp0", "fp1").distinct(), "prints")
    n, both = bit_counts(prints, 2)
    plan = allocation(n, both, PIGEONHOLE_BITS)
    files = written(filed(prints, plan, 2).unionByName(band_files(classes)), "files")
    found = written(links(deal_hot(files, ["fp0", "fp1"], hot_rows), 2, FILE_BITS), "file_links")
    parts = written(connected_components(found.select(F.xxhash64("a0", "a1").alias("u"), F.xxhash64("b0", "b1").alias("v"))), "file_parts")
    number = classes.select("node", F.xxhash64("fp0", "fp1").alias("p"))
    grouped = written(number.join(parts.withColumnRenamed("node", "p"), "p", "left").select("node", F.coalesce("component", "p").alias("group")), "grouped")
    several = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group")
    out = written(grouped.join(several, "group").select("node", "group"), "candidate_groups")
    for old in (prints, files, found, parts, grouped):
        discard(old)
    return out


class Sets:
    """Some sets of shingle hashes, with the low bytes of their minima."""

    def __init__(self, texts: list, low: list, shingle: int) -> None:
        sets = [shingle_hashes(t, shingle) for t in texts]
        self.size = np.array([len(s) for s in sets])
        self.start = np.cumsum(self.size) - self.size
        self.all = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.low = np.frombuffer(b"".join(low), dtype=np.uint8).reshape(len(sets), -1)

    def of(self, i: int) -> np.ndarray:
        return self.all[self.start[i] : self.start[i] + self.size[i]]

    def near(self, i: int, others: np.ndarray, similarity: float) -> np.ndarray:
        """The rows of `others` whose sets have at least the Jaccard similarity with row i's."""
        size = self.size[others]
        few, many = np.minimum(size, self.size[i]), np.maximum(size, self.size[i])
        others = others[(few >= similarity * many - 1e-9) & ((self.low[others] == self.low[i]).sum(axis=1) >= AGREE)]
        mine = self.of(i)
        if not len(others) or not len(mine):
            return others[self.size[others] == len(mine)]
        keep = []
        for s in range(0, len(others), 256):
            part = others[s : s + 256]
            n = self.size[part]
            every = self.all[np.repeat(self.start[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            hit = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(n) - n)
            keep.append(both >= similarity * (len(mine) + n - both) - 1e-9)
        return others[np.concatenate(keep)]


def block_links(sets: Sets, similarity: float) -> list[tuple[int, int]]:
    """(first, row) for every other row of each part of linked rows; a row that has been reached is compared no more."""
    unseen, out = np.ones(len(sets.size), dtype=bool), []
    for first in range(len(sets.size)):
        todo = [first] if unseen[first] else []
        unseen[first] = False
        while todo:
            near = sets.near(todo.pop(), np.flatnonzero(unseen), similarity)
            unseen[near] = False
            out += [(first, int(j)) for j in near]
            todo += near.tolist()
    return out


def stray_links(sets: Sets, parts: np.ndarray, stray: np.ndarray, own: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of strays from other blocks with the block's own rows, one at most for each two parts."""
    forest, out = Forest(), []
    rows = np.flatnonzero(own)
    for i in np.flatnonzero(stray):
        other = rows[parts[rows] != parts[i]]
        for j in sets.near(i, other, similarity):
            a, b = int(parts[i]), int(parts[j])
            if forest.find(a) != forest.find(b):
                forest.join(a, b)
                out.append((int(i), int(j)))
    return out


def exact_links(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v): links of `rows` (group, node, text, low, shingles) that join what is similar in each group.

    A group is cut into blocks of about BLOCK_SHINGLES shingles, and rows are linked within their
    block. If a group has several blocks, its largest part of linked rows stays where it is;
    the strays, rows of other parts, go to every block of the group, and are compared with the
    rows there. No pair is sent on that isn't a link, and of the links only a forest.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.groupBy("group").agg(F.ceil(F.sum("shingles") / BLOCK_SHINGLES).alias("blocks"))
    rows = written(rows.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1)))), "blocks")

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in whole_groups(batches, ["group", "block"]):
            node = block["node"].to_numpy()
            made = block_links(Sets(block["text"].tolist(), block["low"].tolist(), shingle), similarity)
            yield pd.DataFrame({"u": node[[i for i, _ in made]], "v": node[[j for _, j in made]]}, dtype="int64")

    dealt = rows.repartition(n, "group", "block").sortWithinPartitions("group", "block", "node")
    first = written(dealt.mapInPandas(within, "u long, v long"), "block_links")
    part = first.select(F.col("v").alias("node"), F.col("u").alias("part"))
    large = rows.where("blocks > 1").join(part, "node", "left").withColumn("part", F.coalesce("part", "node"))
    large = written(large, "large_groups")
    count = large.groupBy("group", "part").agg(F.count(F.lit(1)).alias("n"))
    main = written(count.groupBy("group").agg(F.max(F.struct("n", "part"))["part"].alias("main")), "main_parts")
    marked = large.join(main, "group").withColumn("stray", F.col("part") != F.col("main")).drop("main").withColumn("home", F.col("block"))
    every = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: b != F.col("home"))
    sent = marked.where("stray").withColumn("block", F.explode(every))

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in whole_groups(batches, ["group", "block"]):
            stray = block["stray"].to_numpy()
            if stray.any():
                node, own = block["node"].to_numpy(), (block["home"] == block["block"]).to_numpy()
                made = stray_links(Sets(block["text"].tolist(), block["low"].tolist(), shingle), block["part"].to_numpy(), stray & ~own, own, similarity)
                yield pd.DataFrame({"u": node[[i for i, _ in made]], "v": node[[j for _, j in made]]}, dtype="int64")

    dealt = marked.unionByName(sent).repartition(n, "group", "block").sortWithinPartitions("group", "block", "node")
    second = written(dealt.mapInPandas(across, "u long, v long"), "stray_links")
    out = written(first.unionByName(second), "links")
    for old in (rows, first, large, main, second):
        discard(old)
    return out


def drop_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The document of the least id of each group; groups follow pairs of at least the Jaccard similarity of shingle sets.

    Texts of equal sets form a class, and only classes are searched. Their fingerprints are filed by
    a pigeonhole plan, and under the bands of their minima as well: at similarity 0.8 texts differ in
    a sixth of the fingerprint's bits, too many for kept bits alone. What a file joins is a
    candidate, and each link is decided by the two sets themselves (see `exact_links`). Blank
    texts are one class. Null ids don't count for the least id; of repeated rows of one id,
    and of a group without any id, one row stays. An empty table gives an empty result.
    """
    ids = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), F.xxhash64(text).alias("__t"))
    prints = written(sketches(ids, "__text", shingle), "sketches")
    cols = ["shingles", "fp0", "fp1", "bands", "low"]
    classes = written(prints.groupBy("node").agg(F.min(F.struct("__t", *cols)).alias("m")).select("node", "m.*"), "classes")
    groups = candidate_groups(classes, hot_rows)
    sought = classes.join(groups, "node").select("node", "group", "shingles", "low", "__t")
    texts = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("__t")).join(sought, "__t").dropDuplicates(["node"])
    edges = exact_links(texts.select("group", "node", "text", "low", "shingles"), shingle, similarity)
    whole = written(connected_components(edges), "parts")
    of_doc = prints.select("__id", "__t", "node").join(whole, "node", "left").withColumn("part", F.coalesce("component", "node"))
    of_doc = written(of_doc.select("__id", "__t", "part"), "document_parts")
    repeated = not of_doc.groupBy("__id", "__t").count().where("count > 1").isEmpty()
    least = written(of_doc.groupBy("part").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__t")).alias("m")).select("m.__id", "m.__t"), "least")
    for old in (prints, classes, groups, edges, whole, of_doc):
        discard(old)
    rows = docs.withColumn("__t", F.xxhash64(text)).alias("d")
    same = F.col(f"d.{doc_id}").eqNullSafe(F.col("k.__id")) & (F.col("d.__t") == F.col("k.__t"))
    kept = rows.join(least.alias("k"), same, "left_semi")
    return (kept.dropDuplicates([doc_id, "__t"]) if repeated else kept).select(*docs.columns)
