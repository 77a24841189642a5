"""The registered queries of the ten operators, one for each, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panolith.llm.ann import nearest
from panolith.llm.license import scan_licenses
from panolith.llm.linededup import drop_repeated_lines
from panolith.llm.mixing import mix_sources
from panolith.llm.packing import pack_sequences, word_tokens
from panolith.llm.secrets import scan_secrets, span_text
from panolith.llm.simhash import near_duplicates
from panolith.llm.tokencount import count_tokens
from panolith.llm.toxicity import held_out, score_toxicity, train_toxicity
from panolith.llm.vafile import exact_top_k
from panolith.session import load

#: Target shares of the mix, in parts; sources not named share one part of 4.
MIX_SHARES = {"src0": 20, "src1": 10, "src2": 10, "src3": 8, "src4": 8, "src5": 8, "src6": 6, "src7": 6} | {f"src{i}": 3 for i in range(8, 20)}


#: A public vocabulary; the driver reads it, and its pieces are sent to the tasks.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    mixed = mix_sources(docs, MIX_SHARES, other_share=4)
    return mixed.select("doc_id", "mix_stream", "mix_block", "mix_slot", "mix_offset")


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(load(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, vocabulary).select("doc_id", "n_words", "n_tokens")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs, load(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, shingle=4, differ=4, words=1, carry=False)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(load(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    digest = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(load(spark, sf_dir, "documents"), word_tokens())


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(load(spark, sf_dir, "documents").select("doc_id", "text"))

    def of(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = span_text(F.filter("secrets", lambda s: s["kind"] != "random"))
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(base, 256).alias("base_sha256"), span_text(F.col("secrets")).alias("spans"))


def op10_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(load(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_pfair_mix": op1_pfair_mix,
    "op2_cross_polytope": op2_cross_polytope,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_line_dedup": op6_line_dedup,
    "op7_best_fit": op7_best_fit,
    "op8_licenses": op8_licenses,
    "op9_secrets": op9_secrets,
    "op10_va_file": op10_va_file,
}

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KEY = f"translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op6_line_dedup": f"""
        WITH parts AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
        ), lines AS (
            SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM parts
        ), keyed AS (
            SELECT doc_id, pos, line, {_KEY} AS k FROM lines
        ), frequent AS (
            SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
        )
        SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN frequent f USING (k) GROUP BY doc_id
    """,
    "op10_va_file": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
        ) WHERE rank <= 5
    """,
}
