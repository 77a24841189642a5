"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces packed by one call.
SHARD_PIECES = 4096
#: A caller's shard of more pieces is cut by hash into shards of about so many at most.
MOST_PIECES = 2 * SHARD_PIECES


def cost(capacity: int, overhead: int, attention: int) -> float:
    """What a sequence costs: its tokens, a fixed part, and attention, which grows with the square of the length.

    `attention` is the length at which the quadratic part costs as much as the linear one.
    """
    return capacity + overhead + capacity * capacity / attention


def filling(lengths: list[int], n: int, room: int) -> int:
    """Tokens of the first n of the ascending lengths that fill the room, the longest that fits each time."""
    held = 0
    while n and (n := bisect_right(lengths, room - held, 0, n)):
        n -= 1
        held += lengths[n]
    return held


def pack(lengths: Sequence[int], capacities: Sequence[int], overhead: int, attention: int) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each piece, and the capacity of each bin.

    Longest pieces first. A piece goes to the open bin in which it leaves the least room. If it
    fits none, a size is opened: for each, the pieces still to be packed tell what a bin of it
    would hold with this piece, and the size (downsized to that) of least cost per token held
    wins. So a size is opened where the lengths at hand fill it well, not because it is large. At the
    end each bin shrinks to the smallest permitted size that holds its contents.
    """
    sizes = sorted(set(capacities))
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    used: list[int] = []
    room: list[tuple[int, int]] = []
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], -i))
    ascending = [lengths[i] for i in order]

    def fits(held: int) -> int:
        return sizes[bisect_left(sizes, held)]

    for rest in range(len(order) - 1, -1, -1):
        i, n = order[rest], ascending[rest]
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            held = {c: n + filling(ascending, rest, c - n) for c in sizes if c >= n}
            free = min(held, key=lambda c: (cost(fits(held[c]), overhead, attention) / held[c], c))
            b = len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    return bins, offsets, [fits(u) for u in used]


def pack_sequences(
    docs: DataFrame,
    length: Column,
    capacities: Sequence[int] = (512, 1024, 2048, 4096),
    overhead: int = 64,
    attention: int = 24_576,
    doc_id: str = "doc_id",
    shard: Column | None = None,
) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, bin_offset, capacity): where each piece of each document goes.

    `length` is a column of tokens per document, at least 1 (less or null counts 1). Documents
    over the largest capacity are cut into pieces of it, so nothing is dropped or cut off. Sizes are
    chosen jointly, by the cost per token (see `cost` and `pack`).
    Pieces are packed in shards, by default dealt by a hash into as many as keep a shard near
    4096 pieces, so no document or source decides how large a task gets. A bin holds pieces of one
    shard; its id is "shard:number". Rows are documents: null and repeated ids are packed each.
    With `shard`, a column of strings, the caller deals; large shards are cut by hash.
    """
    most = max(capacities)
    whole = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.greatest(F.coalesce(length, F.lit(1)), F.lit(1)).cast("long").alias("total"),
        (shard if shard is not None else F.lit("")).alias("__deal"),
    )
    pieces = whole.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / most).cast("int")))).select(
        "__deal",
        "doc_id",
        "piece",
        (F.col("piece").cast("long") * most).alias("start"),
        F.least(F.lit(most), F.col("total") - F.col("piece").cast("long") * most).cast("long").alias("length"),
    )
    if shard is None:
        shards = max(1, -(-pieces.count() // SHARD_PIECES))
        pieces = pieces.withColumn("__shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("string"))
    else:
        cuts = F.ceil(F.col("n") / MOST_PIECES)
        large = pieces.groupBy("__deal").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_PIECES).select("__deal", cuts.alias("__cuts"))
        cut = F.concat_ws("/", "__deal", F.pmod(F.xxhash64("doc_id", "piece"), F.col("__cuts")).cast("string"))
        pieces = pieces.join(large, "__deal", "left").withColumn("__shard", F.when(F.col("__cuts").isNull(), F.col("__deal")).otherwise(cut))
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType(
        [T.StructField("doc_id", id_type)]
        + [T.StructField(n, T.LongType()) for n in ("piece", "start", "length")]
        + [T.StructField("bin_id", T.StringType())]
        + [T.StructField(n, T.LongType()) for n in ("bin_offset", "capacity")]
    )

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "length"], kind="stable", na_position="last").reset_index(drop=True)
        bins, offsets, sizes = pack(rows["length"].tolist(), capacities, overhead, attention)
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"],
                "piece": rows["piece"],
                "start": rows["start"],
                "length": rows["length"],
                "bin_id": [f"{key[0]}:{b}" for b in bins],
                "bin_offset": offsets,
                "capacity": np.array(sizes, dtype=np.int64)[bins],
            }
        )

    pieces = pieces.withColumn("piece", F.col("piece").cast("long")).select("__shard", "doc_id", "piece", "start", "length")
    return pieces.groupBy("__shard").applyInPandas(run, schema)


def word_tokens(text: str = "text") -> Column:
    """Words of the whole text and one end mark."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1
