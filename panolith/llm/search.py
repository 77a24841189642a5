"""What the two vector searches share: classes of equal vectors, codes, bounds, and the exact end."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panolith.session import written

#: Codes of a block, and queries of a group; a task of a scan holds one of each at a time.
BLOCK_ROWS, GROUP_QUERIES = 65_536, 16_384
#: Parts into which the ids of one vector are dealt before their least are taken.
SALTS = 32
FOUND = "query_id long, cid long, lo double, hi double, seen long"


def sound(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, vec) of the rows whose vector is there and has finite components only."""
    bad = F.exists(F.col(embedding), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(vec_id).isNotNull() & (F.size(embedding) > 0) & ~bad).select(
        F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("vec")
    )


def queries_of(rows: DataFrame, is_query: Column) -> DataFrame:
    """(query_id, dim, vec): one query for each id, of its least vector."""
    least = rows.where(is_query).groupBy(F.col("id").alias("query_id")).agg(F.min("vec").alias("vec"))
    return written(least.select("query_id", F.size("vec").alias("dim"), "vec"), "queries")


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """(cid, dim, vec, members): the distinct vectors, with the k + 1 least ids that have each.

    A member is an id and how often (at most k times) it has the vector. No query's k best can
    hold more rows of one vector, so a vector that a third of all rows share costs one row.
    """
    once = rows.groupBy("vec", "id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    for salt in (F.pmod(F.xxhash64("id"), F.lit(SALTS)), F.lit(0)):
        place = F.row_number().over(Window.partitionBy("vec", "salt").orderBy("id"))
        once = once.withColumn("salt", salt).withColumn("place", place).where(F.col("place") <= k + 1).select("vec", "id", "n")
    made = once.groupBy("vec").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("members"))
    return written(made.select(F.monotonically_increasing_id().alias("cid"), F.size("vec").alias("dim"), "vec", "members"), "vector_classes")


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in vectors])


def codes_matrix(codes: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(codes), dtype=np.int8).reshape(-1, dim)


def quantised(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, step, rest): row = step * code + something of at most the length `rest`; a code has a byte per component."""
    top = np.abs(rows).max(axis=1)
    step = np.where(top > 0, top / 127, 1.0)
    codes = np.rint(rows / step[:, None]).astype(np.int8)
    return codes, step, np.linalg.norm(rows - codes * step[:, None], axis=1) * (1 + 1e-9)


def encoded(classes: DataFrame) -> DataFrame:
    """(cid, dim, code, step, rest): the approximation file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                codes, step, rest = quantised(matrix(part["vec"]))
                yield pd.DataFrame({"cid": part["cid"].to_numpy(), "dim": dim, "code": [c.tobytes() for c in codes], "step": step, "rest": rest})

    return classes.select("cid", "dim", "vec").mapInPandas(run, "cid long, dim int, code binary, step double, rest double")


def product_bounds(q: np.ndarray, codes: np.ndarray, step: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest of minus the inner product of q and every row, within 64 bits; the margin covers rounding."""
    middle = -step * (codes @ q)
    size = np.linalg.norm(q)
    slack = size * rest + 1e-9 * size * (step * 127 * np.sqrt(len(q)) + rest)
    lo, hi = sure(middle, slack)
    return np.clip(lo, -(2.0**63), 2.0**63), np.clip(hi, -(2.0**63), 2.0**63)


def distance_bounds(q: np.ndarray, codes: np.ndarray, step: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest Euclidean distance of q and every row; the margin covers rounding."""
    middle = np.linalg.norm(codes * step[:, None] - q, axis=1)
    return sure(middle, rest + 1e-9 * (middle + rest))


def sure(middle: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds; where numbers grew too large for them, all is possible."""
    lo, hi = middle - slack, middle + slack
    bad = ~(np.isfinite(lo) & np.isfinite(hi))
    return np.where(bad, -np.inf, lo), np.where(bad, np.inf, hi)


def possible(lo: np.ndarray, hi: np.ndarray, need: int) -> np.ndarray:
    """Which rows may stand among the `need` least."""
    return lo <= (np.partition(hi, need - 1)[need - 1] if len(hi) > need else np.inf)


def found_rows(made: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]) -> pd.DataFrame:
    """Rows of FOUND from (query, cids, lo, hi, rows looked at); the first row of a query has the number."""
    n = [len(m[1]) for m in made]
    seen = [s for m in made for s in [m[4]] + [0] * (len(m[1]) - 1)]
    columns = [np.concatenate([m[i] for m in made]) if made else [] for i in (1, 2, 3)]
    return pd.DataFrame({"query_id": np.repeat([m[0] for m in made], n), "cid": columns[0], "lo": columns[1], "hi": columns[2], "seen": seen})


def scan_blocks(queries: DataFrame, coded: DataFrame, bounds: Callable, need: int, block_rows: int, group_queries: int) -> DataFrame:
    """FOUND: by the codes alone, what may stand among the `need` best of each query.

    Every block of codes meets every group of queries in one cogrouped task, which holds one of
    each. Blocks and groups are dealt by hash, per vector length, so no key makes one larger.
    """
    blocks, groups = (max(1, -(-t.count() // n)) for t, n in ((coded, block_rows), (queries, group_queries)))
    asked = queries.withColumns(
        {"g": F.pmod(F.xxhash64("query_id"), F.lit(groups)), "b": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))}
    )
    data = coded.withColumns(
        {"b": F.pmod(F.xxhash64(F.lit(1), "cid"), F.lit(blocks)), "g": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>"))}
    )

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made = []
        if len(left) and len(right):
            codes, step, rest, cids = codes_matrix(right["code"], key[0]), *(right[c].to_numpy() for c in ("step", "rest", "cid"))
            whole = codes.astype(float)
            for query, q in zip(left["query_id"], matrix(left["vec"]), strict=True):
                lo, hi = bounds(q, whole, step, rest)
                near = possible(lo, hi, need)
                made.append((query, cids[near], lo[near], hi[near], len(cids)))
        return found_rows(made)

    keys = ["dim", "b", "g"]
    return asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(meet, FOUND)


def exact_end(found: DataFrame, queries: DataFrame, classes: DataFrame, measure: Callable, score_type: str, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score, seen): the k best rows of each query among what was found.

    Only classes that the bounds of all blocks leave over have their exact vectors read, in the
    order of their least value, until the k-th result is certain. measure(query, rows) is the
    exact score of each row and its value, the least of which is best. An id is no result of its own query.
    """
    need = k + 1  # one class may hold the query's own row alone
    once = found.groupBy("query_id", "cid").agg(F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.sum("seen").alias("seen"))
    all_of = Window.partitionBy("query_id")
    ranked = once.withColumns({"place": F.row_number().over(all_of.orderBy("hi")), "seen": F.sum("seen").over(all_of)})
    ranked = ranked.withColumn("top", F.max(F.when(F.col("place") <= need, F.col("hi"))).over(all_of))
    left = ranked.where(F.col("lo") <= F.col("top")).select("query_id", "cid", "lo", "seen")
    asked = queries.select("query_id", F.col("vec").alias("q"))
    read = left.join(classes.select("cid", "vec"), "cid").join(asked, "query_id")
    read = read.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query_id").sortWithinPartitions("query_id", "lo", "cid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query, best = None, None
        for batch in batches:
            out = []
            edge = np.flatnonzero(np.r_[True, batch["query_id"].to_numpy()[1:] != batch["query_id"].to_numpy()[:-1], True]) if len(batch) else []
            for a, e in zip(edge[:-1], edge[1:], strict=True):
                if batch["query_id"].iloc[a] != query:
                    if best is not None:
                        out.append(best.assign(query_id=query))
                    query, best = batch["query_id"].iloc[a], pd.DataFrame({"cid": [], "score": [], "value": [], "seen": []})
                q = np.asarray(batch["q"].iloc[a], dtype=float)
                for s in range(a, e, 256):
                    part = batch.iloc[s : min(e, s + 256)]
                    if len(best) >= need and part["lo"].iloc[0] > best["value"].iloc[need - 1]:
                        break
                    score, value = measure(q, matrix(part["vec"]))
                    more = pd.DataFrame({"cid": part["cid"].to_numpy(), "score": score, "value": value, "seen": part["seen"].to_numpy()})
                    best = pd.concat([best, more]) if len(best) else more
                    # Rows that tie with the last place stay in; the smaller ids are chosen below.
                    best = best.sort_values(["value", "cid"], kind="stable")
                    best = best[best["value"] <= best["value"].iloc[min(need, len(best)) - 1]]
            if out:
                yield pd.concat(out)[["query_id", "cid", "score", "seen"]]
        if best is not None and len(best):
            yield best.assign(query_id=query)[["query_id", "cid", "score", "seen"]]

    scored = read.mapInPandas(run, f"query_id long, cid long, score {score_type}, seen long")
    rows = scored.join(classes.select("cid", F.explode("members").alias("m")), "cid").where("m.id <> query_id")
    rows = rows.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("m.n"))))
    order = F.col("score").asc() if score_type == "double" else F.col("score").desc()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "m.id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.col("m.id").alias("vec_id"), "score", "seen")
