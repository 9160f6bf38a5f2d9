"""The registered queries of this subpackage and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import bpe, chat, compression, decontaminate, factorization, jaccard, licenses, negatives, packing, quality_rules, repair, spelling, style_tree
from quillgrid.session import shared_folder, stored

PREDICT_FROM = 0.7

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return add


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(key: str, folds: int) -> Column:
    """The fold of a row: crc32 of its key as text."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))


def labelled(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label"))
    return load(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id")


def predicted(scored: DataFrame, held_out: Column) -> DataFrame:
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))


END_ID = 2


@query("op1_repair_shards")
def op1(spark, sf_dir):
    folder = shared_folder(spark)
    repair.write_shards(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder, END_ID)
    return repair.digest_shards(spark, folder).withColumnRenamed("key", "doc_id")


@query("op2_toxicity")
def op2(spark, sf_dir):
    model = factorization.fit(labelled(spark, sf_dir, "toxic").where(fold("doc_id", 3) != 1))
    return predicted(factorization.score(load(spark, sf_dir, "documents").select("doc_id", "text"), model), fold("doc_id", 3) == 1)


@query("op3_quality_rules")
def op3(spark, sf_dir):
    weights = quality_rules.fit(labelled(spark, sf_dir, "quality"))
    return quality_rules.judge(load(spark, sf_dir, "documents").select("doc_id", "text"), weights).drop("text")


@query("op4_license_scan")
def op4(spark, sf_dir):
    return licenses.scan(load(spark, sf_dir, "documents"))


@query("op5_byte_bpe")
def op5(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


@query("op6_decontamination")
def op6(spark, sf_dir):
    return decontaminate.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


CONFLICT = "</s>[INST] ok [/INST]"


@query(
    "op7_chat_format",
    rf"""
    with turns as (
        select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all values (-1, 0, 'user', '{CONFLICT}'), (-1, 1, 'assistant', '{CONFLICT}')
    ),
    marked as (
        select *, regexp_replace(text, '(\\*)({chat.MARKERS})', '\1\\\2', 'g') as escaped,
            case when role = 'assistant' then 3 + 6 else 6 + 9 end as marks
        from turns
    )
    select conv_id, count(*) as n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
        cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
        sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
        cast(sum(marks + length(role) + 1 + length(escaped)) as bigint) as formatted_chars
    from marked group by conv_id
    """,
)
def op7(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql(f"select -1L as conv_id, turn, role, '{CONFLICT}' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    return chat.digest(chat.format_conversations(turns.unionByName(own)))


@query("op8_ngram_jaccard")
def op8(spark, sf_dir):
    return jaccard.near_duplicates(load(spark, sf_dir, "documents"))


@query("op9_compression_classifier")
def op9(spark, sf_dir):
    model = compression.fit(labelled(spark, sf_dir, "quality").where(fold("doc_id", 4) != 2))
    return predicted(compression.score(load(spark, sf_dir, "documents").select("doc_id", "text"), model), fold("doc_id", 4) == 2)


@query("op10_style_tree")
def op10(spark, sf_dir):
    return style_tree.extract(load(spark, sf_dir, "pages"))


@query("op11_bulk_best_fit")
def op11(spark, sf_dir):
    pieces = packing.encode(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 0)
    # The digest of the ids goes with a piece, not the ids themselves.
    return packing.pack(stored(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))).drop("piece_id")


@query("op12_hard_negatives")
def op12(spark, sf_dir):
    rows = negatives.usable(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.floor(256 * x).cast("double")))
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(rows, F.col("id") % 100 == 0)


@query("op13_spelling_variants")
def op13(spark, sf_dir):
    return spelling.forms(stored(spelling.count_words(load(spark, sf_dir, "documents"), min_length=6, min_count=5, damage=199)))
