"""The opN_<name> queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query(
    "op8_exact_dedup",
    """
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY norm)
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"), keep="max", with_sha256=True)


@query("op1_token_output")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.runtime import scratch, tokenizer_path
    from cairn.llm.token_output import read_tokens, write_tokens

    out = scratch(spark, "op1-tokens")
    write_tokens(table(spark, sf_dir, "documents"), out, tokenizer_path(), end_id=2)
    return read_tokens(spark, out, with_ids=False)


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.packing import pack
    from cairn.llm.runtime import tokenizer_path

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0, window=1024)


@query("op10_minhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.minhash import near_duplicate_groups

    return near_duplicate_groups(table(spark, sf_dir, "documents"))


@query("op4_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.toxicity import label_categories, score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"), label_categories()))


def _fold(id_col: str, n: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(n))


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.quality import score, train

    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(_fold("doc_id", 5) != 0)
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op6_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.language import predict, train

    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(docs.filter(_fold("doc_id", 4) != 2)))
    return found.select("doc_id", (_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def _op7_sql() -> str:
    from cairn.llm.licenses import oracle

    return oracle()


@query("op7_licenses", _op7_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.licenses import license_runs

    return license_runs(table(spark, sf_dir, "documents"))


@query(
    "op2_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first_id FROM p)
    SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
           CASE WHEN n >= 1000 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 1000 AND first_id <> page_id THEN first_id END AS refers_to
    FROM m
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.runtime import scratch
    from cairn.llm.warc import read_warc, write_warc

    out = scratch(spark, "op2-warc")
    write_warc(table(spark, sf_dir, "pages"), out)
    return read_warc(spark, out)
