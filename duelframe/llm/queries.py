"""Registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.llm import alignment, chat_format, html_text, language_id, licenses, merkle, mixing, near_text, near_vectors, oracles, packing, toxicity, url_filter, vector_search
from duelframe.llm.common import query, table


@query("op1_html_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


@query("op3_url_filter", oracle=oracles.judge_urls())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added)


@query("op4_pack_documents")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packed(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens"
    )


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_documents(table(spark, sf_dir, "documents"))


#: Target mixture of the whole corpus; sources share equally. The tables name no domain, so sources form four of them.
MIX_WEIGHTS = {
    "domain": {"web0": 4.0, "web1": 3.0, "web2": 2.0, "web3": 1.0},
    "language": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0},
    "source": {},
}
MIX_BUDGET_SHARE, MIX_EPOCHS = 0.8, 2


def domain_of_source(source: str = "source"):
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1).try_cast("int")
    return F.concat(F.lit("web"), F.coalesce(number % 4, F.lit(0)).cast("string"))


def mixture(docs: DataFrame, max_epochs: int = MIX_EPOCHS) -> mixing.Mixture:
    return mixing.mix(
        docs, domain_of_source(), F.col("lang"), F.col("source"), MIX_BUDGET_SHARE, max_epochs, MIX_WEIGHTS
    )


@query("op10_mix_sources", oracle=oracles.mix_sources(MIX_WEIGHTS, MIX_BUDGET_SHARE, MIX_EPOCHS))
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = mixture(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).rows
    return picked.select("doc_id", "domain", "language", F.col("leaf_source").alias("source"), "n_tokens", "epochs", "take_tokens")


@query("op7_top_k_search", oracle="""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
WHERE rank <= 10
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op9_near_text", oracle=oracles.near_text(near_text.WORDS, near_text.PERCENT))
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_near_vectors", oracle=oracles.near_vectors(near_vectors.THRESHOLD))
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_license_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query("op12_merkle_manifest", oracle=oracles.manifest())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered)


def align(docs: DataFrame, **options) -> DataFrame:
    import public_tokenizers

    files = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align_documents(docs, files[0], public_tokenizers.PATTERN, files[1], **options)


@query("op13_align_tokenizers")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


#: A conversation of control strings beside those of the table.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query("op11_format_chat", oracle=oracles.formatted_chat(CONTROL_TEXT))
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(*extra.columns).unionByName(extra)
    return chat_format.read_back(*chat_format.format_conversations(rows)).withColumnRenamed("id", "conv_id")
