"""File sources, audits and exports, over files made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.session import shared_folder
from quillgrid.sources.audit import audit_files, content_hash, read_files
from quillgrid.sources.catalog import ingest_files
from quillgrid.operators.grid import to_table
from quillgrid.sources.delimited import detect_delimiter, read_grid
from quillgrid.sources.export import csv_lines, json_lines, write_csv, write_json, write_tsv

from .base import load, query

_GUARDED = "case when left(trim({0}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(65279) || chr(8232) || chr(8233) || chr(12288)), 1) in ('=', '+', '-', '@', '|') then '''' || {0} else {0} end"
_QUOTED = "case when regexp_matches({0}, '[,\"' || chr(10) || chr(13) || ']') then '\"' || replace({0}, '\"', '\"\"') || '\"' else {0} end"


@query(
    "csv_lines",
    f"""
    select doc_id::varchar || ',' || lang || ',' || {_QUOTED.format('safe')} as line
    from (select doc_id, lang, {_GUARDED.format('text')} as safe from documents)
    """,
)
def csv_export(spark, sf):
    return csv_lines(load(spark, sf, "documents").select("doc_id", "lang", "text"))


@query(
    "json_lines",
    """select '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}' as line from customer""",
)
def json_export(spark, sf):
    return json_lines(load(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"))


@query(
    "csv_round_trip",
    """
    select doc_id::varchar as doc_id, lang, nullif(text, '') as text from documents
    """,
)
def csv_round_trip(spark, sf):
    """Whole documents written as CSV, with their line breaks and quotes, and read back as grid rows."""
    folder = shared_folder(spark)
    write_csv(load(spark, sf, "documents").select("doc_id", "lang", "text"), folder, guard=False)
    rows = read_grid(spark, folder).where("row_idx > 0")
    return rows.select(*[F.get("cells", i)["raw"].alias(name) for i, name in enumerate(["doc_id", "lang", "text"])])


@query("utf16_round_trip", "select doc_id::varchar as doc_id, lang, nullif(text, '') as text from documents")
def utf16_round_trip(spark, sf):
    """Whole documents as UTF-16 files whose lines end in carriage returns alone."""
    folder = shared_folder(spark)
    write_csv(load(spark, sf, "documents").select("doc_id", "lang", "text"), folder, guard=False, line_end="\r", utf16=True)
    rows = read_grid(spark, folder).where("row_idx > 0")
    return rows.select(*[F.get("cells", i)["raw"].alias(name) for i, name in enumerate(["doc_id", "lang", "text"])])


@query("ingest_files", "select o_orderkey::varchar as o_orderkey, o_orderstatus, o_orderpriority from orders")
def ingest(spark, sf):
    """Orders written as TSV files and taken in again as a table."""
    folder = shared_folder(spark)
    write_tsv(load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), folder)
    _, records = ingest_files(spark, folder)
    return to_table(records, ["o_orderkey", "o_orderstatus", "o_orderpriority"]).drop("file_id", "sheet", "row_idx")


@query("delimiters", "select chr(9) as delimiter")
def delimiters(spark, sf):
    folder = shared_folder(spark)
    write_tsv(load(spark, sf, "orders"), folder)
    return detect_delimiter(spark, folder).select("delimiter").distinct()


@query("json_round_trip", "select c_custkey, c_name, c_acctbal from customer")
def json_round_trip(spark, sf):
    folder = shared_folder(spark)
    df = load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    write_json(df, folder)
    return spark.read.schema(df.schema).json(folder)


@query("content_hash", "select doc_id::varchar as path, sha256(text) as sha256 from documents")
def hashes(spark, sf):
    files = load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return content_hash(files)


# What each language's documents are dressed up as: extension and first bytes.
_DRESS = {"en": ("csv", ""), "fr": ("csv", "504B0304"), "de": ("xls", "D0CF11E0A1B11AE1"), "es": ("xlsm", "")}


@query(
    "audit_files",
    """
    select doc_id::varchar || '.' || ext as path, (octet_length(encode(text)) + extra)::int as n_bytes, ext as extension,
           case when octet_length(encode(text)) + extra = 0 then 'empty' when octet_length(encode(text)) + extra > 10485760 then 'too_large'
                when lang = 'es' then 'macro' when lang = 'fr' then 'mismatch' when lang not in ('en', 'de') then 'binary' else 'ok' end as status
    from (select *, case lang when 'en' then 'csv' when 'fr' then 'csv' when 'de' then 'xls' when 'es' then 'xlsm' else 'bin' end as ext,
                 case lang when 'en' then 0 when 'es' then 0 when 'fr' then 4 when 'de' then 8 else 3 end as extra from documents)
    """,
)
def file_audit(spark, sf):
    """Documents dressed up as files of several kinds, some under false names; other languages get a zero byte."""
    lang = F.col("lang")
    ext, start = F.lit("bin"), F.unhex(F.lit("410041"))
    for code, (extension, first) in _DRESS.items():
        ext = F.when(lang == code, extension).otherwise(ext)
        start = F.when(lang == code, F.unhex(F.lit(first))).otherwise(start)
    files = load(spark, sf, "documents").select(
        F.concat(F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), F.concat(start, F.encode("text", "UTF-8")).alias("content")
    )
    return audit_files(files).select("path", "n_bytes", "extension", "status")


@query(
    "audit_written_files",
    """
    select upper(lang) || '/' || source as folder, count(*) as n_rows, 'csv' as file_type, 'ok' as status, true as hashed from documents group by 1
    union all select 'none/none', 0, null, 'empty', true from (select count(*) as n from documents) where n > 0
    """,
)
def audit_written(spark, sf):
    """Documents written in folders by language and source, then listed, digested and audited; one file is empty."""
    folder = shared_folder(spark)
    docs = load(spark, sf, "documents").select(F.upper("lang").alias("l"), F.col("source").alias("s"), F.concat(F.col("doc_id").cast("string"), F.lit(",x")).alias("value"))
    docs.repartition("l", "s").write.partitionBy("l", "s").option("lineSep", "\n").text(folder)
    docs.limit(0).coalesce(1).select("value").write.text(f"{folder}/l=none/s=none")
    files = read_files(spark, folder)
    place = F.concat_ws("/", F.regexp_extract("path", "/l=([^/]*)/", 1), F.regexp_extract("path", "/s=([^/]*)/", 1))
    # Rows are counted by reading the files again by themselves.
    rows = spark.read.text(folder).groupBy("l", "s").count().select(F.concat_ws("/", "l", "s").alias("folder"), "count")
    audited = audit_files(files.withColumn("path", F.concat("path", F.lit(".csv")))).withColumn("path", F.regexp_replace("path", r"\.csv$", ""))
    joined = audited.join(content_hash(files), "path").withColumn("folder", place).join(rows, "folder", "left")
    return joined.select("folder", F.coalesce("count", F.lit(0)).alias("n_rows"), "file_type", "status", (F.length("sha256") == 64).alias("hashed"))
