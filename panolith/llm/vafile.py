"""Exact top-k search by inner product with vector-approximation files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panolith.llm.search import BLOCK_ROWS, GROUP_QUERIES, classes_of, encoded, exact_end, product_bounds, queries_of, scan_blocks, sound

#: Products below this are exact in double precision.
EXACT = 2.0**53
LEAST, MOST = -(2**63), 2**63 - 1


def products(q: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[float]]:
    """Whole-number inner products, at the ends of 64 bits if they lie beyond, and minus them."""
    if np.abs(q).max(initial=0) * np.abs(rows).max(initial=0) * len(q) < EXACT:
        score = [int(x) for x in rows @ q]
    else:
        mine = [int(x) for x in q]
        score = [max(LEAST, min(MOST, sum(int(a) * b for a, b in zip(row, mine, strict=True)))) for row in rows]
    return score, [-float(x) for x in score]


def exact_top_k(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    scale: int = 256,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    group_queries: int = GROUP_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of largest whole-number inner product.

    A component x becomes floor(scale x), x as double. Queries are the rows whose id is divisible
    by `every`, each against all rows but those of its own id; ties go to the smaller id, and
    queries with fewer candidates get all.

    The approximation file has one byte per component: the cell of the row's own grid. It alone is
    scanned for every query, and gives bounds of each product; then the exact vectors of what may
    still stand among the best are read, best bound first, until the k-th result is certain.
    Equal vectors are one row of the file, so a vector that many rows share is compared once.

    Vectors that are null or empty, or that hold null or non-finite components, take no part,
    nor do rows without id; vectors of different length aren't compared. A repeated row is a
    candidate each time, but an id is one query, of its least vector (the shorter first, if
    it has vectors of two lengths). Scores past 64 bits stand at, and are ranked by, their bound.
    An empty table gives none.
    """

    def cut(x: Column) -> Column:
        y = x.cast("double") * float(scale)
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole

    whole = sound(vectors, vec_id, embedding).select("id", F.transform("vec", cut).alias("vec"))
    queries, classes = queries_of(whole, F.col("id") % every == 0), classes_of(whole, k)
    found = scan_blocks(queries, encoded(classes), product_bounds, k + 1, block_rows, group_queries)
    return exact_end(found, queries, classes, products, "long", k).drop("seen")
