"""Mixing sources to target weights by Pfair scheduling. DataFrame functions only."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panolith.session import written

#: Rows of one hash bucket of a source, and buckets of one group, of the two-level prefix sums.
BUCKET_ROWS, GROUP_BUCKETS = 128, 1024


def pfair_pattern(shares: list[int]) -> list[list[int]]:
    """For each source the slots it gets in one period of sum(shares) slots.

    Block k of a source with share q of Q is released at floor(kQ/q) and due at ceil((k+1)Q/q).
    In each slot the released block that is due first goes (ties: the source named first). On
    one line of slots that meets every deadline, so after any number of slots t each source
    has had less than one block more or less than t q / Q.
    """
    period = sum(shares)
    slots: list[list[int]] = [[] for _ in shares]
    for t in range(period):
        due = [
            (-(-(len(got) + 1) * period // q), s)
            for s, (q, got) in enumerate(zip(shares, slots, strict=True))
            if len(got) < q and len(got) * period // q <= t
        ]
        slots[min(due)[1]].append(t)
    return slots


def pfair_phases(shares: Mapping[str, int], blocks: Mapping[str, int]) -> list[tuple]:
    """Rows (stream, first, end, share, period, base, slots) that place every block.

    Blocks first <= b < end of the stream stand in slot
    base + (b - first) div share * period + slots[(b - first) mod share]. A phase ends in the
    slot that a used-up source would get; the other sources go on with their own shares.
    """
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    base, rows = 0, []
    while left:
        names = sorted(left)
        quota = [shares[s] for s in names]
        period = sum(quota)
        pattern = dict(zip(names, pfair_pattern(quota), strict=True))
        length = min(left[s] // shares[s] * period + pattern[s][left[s] % shares[s]] for s in names)
        for s in names:
            got = length // period * shares[s] + bisect_left(pattern[s], length % period)
            rows.append((s, done[s], done[s] + got, shares[s], period, base, pattern[s]))
            done[s] += got
            left[s] -= got
        left = {s: n for s, n in left.items() if n}
        base += length
    return rows


def mix_sources(
    docs: DataFrame,
    shares: Mapping[str, int],
    other_share: int = 1,
    source: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
    block_chars: int = 65_536,
) -> DataFrame:
    """`docs` with its place in a mix that follows whole-number target shares of the sources.

    Each source is a stream of its documents in hash order, cut into blocks of `block_chars`
    characters; a document belongs to the block in which it starts. Blocks get the slots of a
    Pfair schedule (see `pfair_pattern`), so at any point of the mix every source has less
    than one block more or less than its share of the characters. When a source is used up
    the others go on with their own shares; every document appears exactly once.

    Adds `mix_stream`, `mix_block`, `mix_slot` and `mix_offset` (start within the block); order
    by (mix_slot, mix_offset) to read the mix. They replace input columns of those names.

    Sources that `shares` doesn't name, null among them, form one stream '' with
    `other_share`. A text counts its code points, null and empty ones 1. Documents of one
    source are ordered by the hash of (doc_id, text), then doc_id; repeated rows keep places
    of their own. An empty table gives an empty result.

    The driver gets one row per stream, as many as `shares` has entries. Running sums need no
    task to hold a source: they are taken in hash buckets of about 128 rows, over groups of
    1024 buckets, and over the groups. Rows that are repeated more often than that are numbered first.
    """
    if not all(isinstance(q, int) and q > 0 for q in [*shares.values(), other_share]) or "" in shares:
        raise ValueError("shares are whole numbers above 0, of sources with a name")
    named = F.col(source).isin(*shares) if shares else F.lit(False)
    cols = docs.columns
    rows = docs.withColumns(
        {
            "mix_stream": F.when(named, F.col(source)).otherwise(F.lit("")),
            "__len": F.greatest(F.coalesce(F.length(text), F.lit(1)), F.lit(1)).cast("long"),
            "__h": F.xxhash64(doc_id, text),
        }
    )
    sizes = {r["mix_stream"]: r for r in rows.groupBy("mix_stream").agg(F.count(F.lit(1)).alias("n"), F.sum("__len").alias("c")).collect()}
    if not rows.groupBy("__h").count().where(F.col("count") > BUCKET_ROWS).isEmpty():
        # A row that is repeated so often would be one bucket; numbers in a written table tell its copies apart.
        rows = written(rows.withColumn("__n", F.monotonically_increasing_id()), "numbered_rows")
        rows = rows.withColumn("__h", F.xxhash64("__h", "__n")).drop("__n")
    session = docs.sparkSession
    counts = session.createDataFrame(
        [(s, -(-r["n"] // BUCKET_ROWS)) for s, r in sizes.items()], "mix_stream string, __buckets long"
    )
    rows = rows.join(F.broadcast(counts), "mix_stream").withColumn("__f", F.pmod("__h", "__buckets"))
    # Prefix sums over buckets: within a group of buckets, then over the groups.
    buckets = rows.groupBy("mix_stream", "__f").agg(F.sum("__len").alias("c")).withColumn("g", F.col("__f").cast("long") - F.col("__f") % GROUP_BUCKETS)
    in_group = Window.partitionBy("mix_stream", "g").orderBy("__f").rowsBetween(Window.unboundedPreceding, -1)
    over_groups = Window.partitionBy("mix_stream").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = (
        buckets.groupBy("mix_stream", "g")
        .agg(F.sum("c").alias("c"))
        .select("mix_stream", "g", F.coalesce(F.sum("c").over(over_groups), F.lit(0)).alias("before"))
    )
    starts = (
        buckets.withColumn("inside", F.coalesce(F.sum("c").over(in_group), F.lit(0)))
        .join(groups, ["mix_stream", "g"])
        .select("mix_stream", "__f", (F.col("before") + F.col("inside")).alias("__start"))
    )
    in_bucket = Window.partitionBy("mix_stream", "__f").orderBy("__h", doc_id).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("__in", F.coalesce(F.sum("__len").over(in_bucket), F.lit(0)))
        .join(starts, ["mix_stream", "__f"])
        .withColumn("__at", F.col("__start") + F.col("__in"))
        .withColumns({"mix_block": F.floor(F.col("__at") / block_chars).cast("long"), "mix_offset": F.col("__at") % block_chars})
    )
    every = {**shares, "": other_share}
    schedule = session.createDataFrame(
        pfair_phases(every, {s: -(-r["c"] // block_chars) for s, r in sizes.items()}),
        T._parse_datatype_string("mix_stream string, __first long, __end long, __share long, __period long, __base long, __slots array<int>"),
    )
    b = F.col("mix_block") - F.col("__first")
    slot = F.col("__base") + F.floor(b / F.col("__share")) * F.col("__period") + F.get("__slots", (b % F.col("__share")).cast("int"))
    out = placed.join(
        F.broadcast(schedule.withColumnRenamed("mix_stream", "__s")),
        (F.col("mix_stream") == F.col("__s")) & (F.col("mix_block") >= F.col("__first")) & (F.col("mix_block") < F.col("__end")),
    ).withColumn("mix_slot", slot.cast("long"))
    added = ["mix_stream", "mix_block", "mix_slot", "mix_offset"]
    return out.select(*[F.col(f"`{c}`") for c in cols if c not in added], *added)
