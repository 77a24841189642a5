"""Line dedup: drop lines that stand in many documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panolith.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
#: Up to so many frequent lines (16 bytes each) are broadcast; more go through a shuffled join.
BROADCAST_LINES = 400_000


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all else as it is; all-ASCII strings take the fast path."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def by_document(docs: DataFrame, doc_id: str, once: DataFrame) -> DataFrame:
    """(h1, h2, n): in how many documents each key of `once` (__k1, h1, h2), a row's keys, stands.

    Rows whose id stands alone are counted before the shuffle. Only keys of ids that several
    rows share are made distinct first.
    """
    again = written(docs.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__k1")).count().where("count > 1").select("__k1"), "repeated_ids")
    rows = once.select("__k1", "h1", "h2")
    if again.count():
        rows = rows.join(again, "__k1", "left_anti").unionByName(rows.join(again, "__k1", "left_semi").distinct())
    return rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))


def drop_repeated_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """`docs` with the lines of `text` dropped whose key stands in at least `min_docs` documents.

    A line's key is the line stripped of ASCII white space and lower-cased in A-Z; keys under
    `min_chars` code points are never dropped. Adds `n_lines` (before) and `n_dropped`; these
    replace input columns of those names, and all other columns pass through.

    Method: each document's distinct keys are exploded, hashed to two 64-bit numbers and counted;
    lines are exploded with their positions, frequent ones come back as sets of positions,
    and the text is reassembled from the positions that are left. Only hashes are shuffled for
    the counts; texts move once, for the reassembly.

    Null text is one empty line and stays null if nothing is dropped. A document is a doc_id: rows
    that repeat one count once for a line, rows without one count each. Each row keeps its own
    text; rows are told apart by (doc_id, text). An empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.withColumns({"__k1": F.col(doc_id), "__k2": F.xxhash64(F.col(text))})
    keys = F.transform(F.split(ascii_lower(body), "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)))
    hashes = [F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2")]
    counted = F.length("key") >= max(1, min_chars)
    once = base.select("__k1", F.explode(F.array_distinct(keys)).alias("key")).where(counted).select("__k1", *hashes)
    counts = by_document(docs, doc_id, once)
    lines = base.select("__k1", "__k2", F.posexplode(keys).alias("pos", "key")).where(counted).select("__k1", "__k2", "pos", *hashes)
    frequent = written(
        counts.where(F.col("n") >= min_docs).select("h1", "h2"),
        "frequent_lines",
    )
    if frequent.count() <= BROADCAST_LINES:
        frequent = F.broadcast(frequent)
    hits = (
        lines.join(frequent, ["h1", "h2"])
        .groupBy("__k1", "__k2")
        .agg(F.collect_set("pos").alias("__hits"))
        .withColumnsRenamed({"__k1": "__j1", "__k2": "__j2"})
    )
    same = F.col("__k1").eqNullSafe(F.col("__j1")) & (F.col("__k2") == F.col("__j2"))
    joined = base.join(hits, same, "left").withColumn("__lines", F.split(body, "\n", -1))
    n = F.size("__lines")
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("__hits"))
    kept = F.array_join(F.transform(left, lambda p: F.get(F.col("__lines"), p)), "\n")
    out = joined.withColumns(
        {
            "n_lines": n.cast("long"),
            "n_dropped": F.when(F.col("__hits").isNull(), 0).otherwise(F.size("__hits")).cast("long"),
            text: F.when(F.col("__hits").isNull(), F.col(text)).otherwise(kept),
        }
    )
    return out.drop("__k1", "__k2", "__j1", "__j2", "__lines", "__hits")
