"""Approximate nearest neighbours by cross-polytope hashing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panolith.llm.search import (
    BLOCK_ROWS, FOUND, GROUP_QUERIES, classes_of, codes_matrix, distance_bounds, encoded, exact_end, found_rows, matrix, possible, quantised, queries_of, scan_blocks, sound,
)
from panolith.session import written

#: Entries of a bucket, which one task holds, and entries from which a cell is cut.
BUCKET_ENTRIES, HOT_ENTRIES = 1 << 18, 1 << 16
#: Rows filed at a time, and queries of a task that looks for their cells.
FILE_ROWS, PROBE_QUERIES = 2048, 256
#: Norms of one band differ by less than this factor.
BAND = 1.25
#: Rows of each length, and components in all, of the sample that the order of the probes is fitted on.
SAMPLE_ROWS, SAMPLE_CELLS = 4096, 1 << 22
#: Up to so many distinct vectors a query opens the whole share of the entries; beyond, the share falls with this
#: power of their number. Measured on random directions, 10,000 and 51,000 of them, recall of 0.92 would allow 0.38.
SHARE_ROWS, SHARE_FALL = 10_000, 0.3
#: Axes of a table, best first, whose pairs a query may open.
AXES = 24


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The normalised fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, dim = rows.shape
    step = 1
    while step < dim:
        pair = rows.reshape(n, dim // (2 * step), 2, step)
        rows = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, dim)
        step *= 2
    return rows / np.sqrt(dim)


def polytope(unit: np.ndarray, table: int) -> np.ndarray:
    """Each row's closeness to the 2 dim signed axes after the table's pseudo-rotation.

    Three rounds of random signs and a Hadamard transform; signs come from the table's number.
    """
    signs = np.random.default_rng(table).choice(np.array([-1.0, 1.0], dtype=unit.dtype), (3, unit.shape[1]))
    for s in signs:
        unit = hadamard(unit * s)
    return np.concatenate([unit, -unit], axis=1)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Unit vectors of the rows, padded with zeros to a power of two, 2 at least."""
    dim = 1 << max(1, rows.shape[1] - 1).bit_length() if rows.shape[1] > 1 else 2
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    out = np.zeros((len(rows), dim), dtype=np.float32)
    out[:, : rows.shape[1]] = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    return out


def log_norms(rows: np.ndarray) -> np.ndarray:
    top = np.abs(rows).max(axis=1)
    return np.log(top) + np.log(np.linalg.norm(rows / top[:, None], axis=1))


def bands(logs: np.ndarray) -> np.ndarray:
    """The band of each norm; bands are centred on whole powers, so that unit vectors share one."""
    return np.rint(logs / np.log(BAND)).astype(np.int64)


def best_axes(near: np.ndarray, n: int) -> np.ndarray:
    """The n nearest axes of each row, nearest first."""
    some = np.argpartition(-near, n - 1, axis=1)[:, :n]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)


def cell_id(dim: int, table, band, one, two) -> np.ndarray:
    """A 64-bit mix of what names a cell: length, table, band and the unordered pair of axes; a clash only adds candidates."""
    h = np.full(1, dim, dtype=np.uint64)
    for part in (table, band, np.minimum(one, two), np.maximum(one, two)):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + np.atleast_1d(part).astype(np.int64).view(np.uint64))
    return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def own_cells(rows: np.ndarray, tables: int) -> np.ndarray:
    """The cell of every row (of one length) in every table: the pair of its two nearest axes, and its band."""
    unit, band, out = unit_rows(rows), bands(log_norms(rows)), []
    for t in range(tables):
        axes = best_axes(polytope(unit, t), 2)
        out.append(cell_id(rows.shape[1], t, band, axes[:, 0], axes[:, 1]))
    return np.stack(out, axis=1)


@dataclass
class Fit:
    """What orders the probes of queries of one length: all classes per band, and a bounded sample of them."""

    size: dict[int, int]
    sample: np.ndarray

    def probes(self, queries: np.ndarray, tables: int, share: float, least: int, k: int) -> Iterator[np.ndarray]:
        """The cells that each query opens: those likeliest to hold a neighbour per row read.

        A row of norm s is among the k nearest if its cosine is over (t + s^2) / (2 |q| s), t
        from the sample. A cell's axes give the expected cosine of its rows, and what is left
        its spread. Cells are opened, best first, until the rows expected in them reach the
        share of all entries.
        """
        n = sum(self.size.values())
        share *= min(1.0, SHARE_ROWS / n) ** SHARE_FALL
        names = np.array(sorted(self.size))
        count = np.array([self.size[b] for b in names.tolist()], dtype=float)
        dim = unit_rows(queries[:1]).shape[1]
        pairs = dim * (2 * dim - 2)
        wanted = max(share * n * tables, least)
        units = unit_rows(self.sample)
        close = np.sort(np.concatenate([polytope(units, t) for t in range(min(tables, 4))]), axis=1)
        mean = np.sqrt((close[:, -1] ** 2 + close[:, -2] ** 2).mean() / 2)
        take = min(AXES, 2 * dim)
        first, second = np.triu_indices(take, 1)
        place = min(len(self.sample) - 1, max(1, round(k * len(self.sample) / n)))
        unit, logs, table = unit_rows(queries), log_norms(queries), np.arange(tables)[:, None]
        own = log_norms(self.sample)
        for i in range(len(queries)):
            if i % 64 == 0:
                rotated = np.stack([polytope(unit[i : i + 64], t) for t in range(tables)], axis=1)
            # Gains 2 q.v - v.v in units of the query's squared length.
            size = np.exp(np.clip(own - logs[i], -300, 300))
            gain = 2 * (units @ unit[i]) * size - size**2
            least_gain = np.partition(gain, len(gain) - 1 - place)[len(gain) - 1 - place]
            s = np.exp(np.clip(names * np.log(BAND) - logs[i], -300, 300))
            cosine = (least_gain + s**2) / (2 * s)
            near = rotated[i % 64]
            axes = best_axes(near, take)
            a, b = axes[:, first], axes[:, second]
            pa, pb = np.take_along_axis(near, a, 1), np.take_along_axis(near, b, 1)
            spread = np.sqrt(np.maximum((1 - 2 * mean**2) * (1 - pa**2 - pb**2), 1e-6) / dim)
            chance = (mean * (pa + pb) - cosine[:, None, None]) / spread
            chance[:, (a - b) % dim == 0] = -np.inf
            flat = chance.ravel()
            rows = np.broadcast_to((count / pairs)[:, None, None], chance.shape).ravel()
            enough = min(len(flat), int(2 * wanted / max(rows.min(), wanted / len(flat))) + 1)
            some = np.argpartition(-flat, enough - 1)[:enough]
            some = some[np.argsort(-flat[some], kind="stable")]
            some = some[: np.searchsorted(np.cumsum(rows[some]), wanted) + 1]
            some = some[np.isfinite(flat[some])]
            at_band, at_pair = np.divmod(some, a.size)
            yield cell_id(queries.shape[1], np.broadcast_to(table, a.shape).ravel()[at_pair], names[at_band], a.ravel()[at_pair], b.ravel()[at_pair])


def fitted(classes: DataFrame) -> dict[int, Fit]:
    """The fit of each length. Sizes of bands count all classes; the sample takes them in hash order.

    Lengths and bands are few: a band is a power of the norm, so doubles have some thousands.
    """

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                band, n = np.unique(bands(log_norms(matrix(part["vec"]))), return_counts=True)
                yield pd.DataFrame({"dim": dim, "band": band, "n": n})

    size = classes.select("dim", "vec").mapInPandas(sizes, "dim int, band long, n long").groupBy("dim", "band").agg(F.sum("n").alias("n")).collect()
    out: dict[int, Fit] = {}
    for dim in {r["dim"] for r in size}:
        some = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("cid"), "cid").limit(max(1, min(SAMPLE_ROWS, SAMPLE_CELLS // dim))).select("vec").collect()
        out[dim] = Fit({r["band"]: r["n"] for r in size if r["dim"] == dim}, np.array([r["vec"] for r in some], dtype=float))
    return out


def hot_cells(classes: DataFrame, tables: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of over `hot` entries, sorted, and the parts each is cut into; at most tables * rows / hot of them.

    A class has one entry in a table, so with `hot` classes or fewer there is none.
    """
    if classes.count() <= hot:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby("dim"):
                cells, n = np.unique(own_cells(matrix(part["vec"]), tables).view(np.int64), return_counts=True)
                yield pd.DataFrame({"cell": cells, "n": n})

    rows = classes.select("dim", "vec").mapInPandas(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > hot)
    got = sorted((r["cell"], -(-r["n"] // hot)) for r in rows.collect())
    return np.array([c for c, _ in got], dtype=np.int64).view(np.uint64), np.array([p for _, p in got], dtype=np.int64)


def parts_of(cells: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Into how many parts each cell is cut."""
    names, parts = hot
    if not len(names):
        return np.ones(cells.shape, dtype=np.int64)
    order = np.argsort(names)
    at = np.minimum(np.searchsorted(names[order], cells), len(names) - 1)
    return np.where(names[order][at] == cells, parts[order][at], 1)


def in_buckets(at: np.ndarray, cells: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(bucket, row, cells): the cells of each row, in one list for each bucket they fall into."""
    bucket = (mixed(cells) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((bucket, at))
    at, bucket, cells = at[order], bucket[order], cells[order].view(np.int64)
    edge = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (bucket[1:] != bucket[:-1]), True])
    lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(cells, pa.int64()))
    return bucket[edge[:-1]], at[edge[:-1]], lists


def byte_rows(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    flat = np.ascontiguousarray(rows)
    places = pa.array(np.arange(len(flat) + 1) * (flat.nbytes // max(1, len(flat))), pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, places.buffers()[1], pa.py_buffer(flat.tobytes())])


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, vectors) of the rows (id, dim, vec) of a batch."""
    ids, dims, vectors = (batch.column(i) for i in range(3))
    known = dims.to_numpy()
    for dim in np.unique(known).tolist():
        rows = pa.array(np.flatnonzero(known == dim))
        yield dim, ids.take(rows).to_numpy(), vectors.take(rows).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def nearest(
    vectors: DataFrame,
    k: int = 10,
    every: int = 100,
    tables: int = 48,
    share: float = 0.003,
    least_entries: int = 600,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    bucket_entries: int = BUCKET_ENTRIES,
    hot_entries: int = HOT_ENTRIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score, candidates): k nearest rows found for each query, by Euclidean distance.

    Queries are the rows whose id is divisible by `every`, each against all rows but those of its
    own id. Every distinct vector is filed once in each of `tables` tables, under the pair of
    signed axes that are nearest to it after the table's pseudo-rotation, in a band of norms.
    A query opens cells of all tables, likeliest first (see `Fit.probes`), until they should
    hold `share` of all entries (less in larger tables, see SHARE_FALL), and `least_entries` at
    least; `candidates` is the number of rows it met there. Candidates are bounded by byte codes that lie with the entries, and those that
    may be among the best are ranked by the exact distance of the original vectors in double
    precision; ties go to the smaller id.

    Entries and probes meet in buckets of about `bucket_entries` entries; a row is sent once to a
    bucket, with all its cells there. Cells of over `hot_entries` are cut by hash and a query
    opens every part. A query that finds fewer than k rows is compared with all codes, so each
    query gets k rows, or all there are. Only the sample for the order of the probes is bounded
    (4096 vectors).

    Vectors that are null, empty or zero, or that hold null or non-finite components, take
    no part, nor do rows without id; vectors of different length aren't compared. A repeated
    row is a candidate each time, but an id is one query, of its least vector (the shorter
    first, if it has vectors of two lengths). An empty table gives none.
    """
    rows = sound(vectors, vec_id, embedding).where(F.exists("vec", lambda x: x != 0))
    queries, classes = queries_of(rows, F.col("id") % every == 0), classes_of(rows, k)
    need = k + 1
    fits = fitted(classes)
    hot = hot_cells(classes, tables, hot_entries)
    buckets = max(1, -(-classes.count() * tables // bucket_entries))

    def table_of(dim: int, ids: np.ndarray, bucket: np.ndarray, lists: pa.Array, **more: pa.Array) -> pa.RecordBatch:
        arrays = {"bucket": pa.array(bucket, pa.int64()), "id": pa.array(ids, pa.int64()), "cells": lists, "dim": pa.array(np.full(len(ids), dim), pa.int32()), **more}
        return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, FILE_ROWS):
                for dim, cids, m in by_length(batch.slice(s, FILE_ROWS)):
                    codes, step, rest = quantised(m)
                    cells = own_cells(m, tables)
                    parts = parts_of(cells, hot)
                    sub = mixed(cids.astype(np.uint64))[:, None] % parts.astype(np.uint64)
                    cells = np.where(parts > 1, mixed(cells + sub + np.uint64(1)), cells)
                    bucket, at, lists = in_buckets(np.repeat(np.arange(len(cids)), tables), cells.ravel(), buckets)
                    yield table_of(dim, cids[at], bucket, lists, code=byte_rows(codes[at]), step=pa.array(step[at]), rest=pa.array(rest[at]))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, m in by_length(batch):
                for i, cells in enumerate(fits[dim].probes(m, tables, share, least_entries, k) if dim in fits else ()):
                    parts = parts_of(cells, hot)
                    sub = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                    cells, many = np.repeat(cells, parts), np.repeat(parts, parts) > 1
                    cells = np.unique(np.where(many, mixed(cells + sub.astype(np.uint64) + np.uint64(1)), cells))
                    bucket, at, lists = in_buckets(np.zeros(len(cells), dtype=np.int64), cells, buckets)
                    yield table_of(dim, np.full(len(at), ids[i]), bucket, lists, vec=byte_rows(np.repeat(m[i : i + 1], len(at), axis=0)))

    columns = "bucket long, id long, cells array<long>, dim int"
    filed = classes.select("cid", "dim", "vec").mapInArrow(file, f"{columns}, code binary, step double, rest double")
    some = queries.select("query_id", "dim", "vec").repartition(max(1, -(-queries.count() // PROBE_QUERIES)))
    asked = some.mapInArrow(probe, f"{columns}, vec binary")

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made = []
        if len(left) and len(right):
            codes, step, rest, cids = codes_matrix(right["code"], key[1]), *(right[c].to_numpy() for c in ("step", "rest", "id"))
            cells = np.concatenate(right["cells"].to_numpy())
            order = np.argsort(cells, kind="stable")
            cells, row = cells[order], np.repeat(np.arange(len(right)), right["cells"].map(len))[order]
            for query, q, opened in zip(left["id"], np.frombuffer(b"".join(left["vec"])).reshape(-1, key[1]), left["cells"], strict=True):
                a, e = np.searchsorted(cells, opened, "left"), np.searchsorted(cells, opened, "right")
                n = e - a
                at = np.unique(row[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())])
                if len(at):
                    lo, hi = distance_bounds(q, codes[at], step[at], rest[at])
                    near = possible(lo, hi, need)
                    made.append((query, cids[at][near], lo[near], hi[near], len(at)))
        return found_rows(made)

    found = written(asked.groupBy("bucket", "dim").cogroup(filed.groupBy("bucket", "dim")).applyInPandas(meet, FOUND), "neighbour_bounds")

    def distances(q: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.linalg.norm(m - q, axis=1)
        return d, d

    best = written(exact_end(found, queries, classes, distances, "double", k).withColumnRenamed("seen", "candidates"), "neighbours")
    full = best.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    short = queries.join(full, "query_id", "left_anti").select("query_id", "dim", "vec")
    if not short.count():
        return best
    short = written(short, "short_queries")
    again = scan_blocks(short, encoded(classes), distance_bounds, need, BLOCK_ROWS, GROUP_QUERIES)
    more = exact_end(again, short, classes, distances, "double", k).withColumnRenamed("seen", "candidates")
    return best.join(full, "query_id", "left_semi").select(*more.columns).unionByName(more)
