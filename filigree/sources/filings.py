"""Filings as tables: directory, history, stored documents, and their parsing into verified chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigree.functions.text import decode_bytes, pad_cik
from filigree.operators.chunking import MAX_CHARS, TARGET_CHARS, pack_chunks, with_chunk_ids
from filigree.operators.extract import html_blocks, verify_chunks
from filigree.operators.sections import assign_sections, detect_headings
from filigree.session import stored

FORMS = ("10-K", "10-Q")
CHUNK_FIELDS = (
    "chunk_id ticker cik form filing_date report_date accession_number source_path source_sha256 encoding"
    " section_key section_title chunk_order n_blocks oversized char_start char_end text"
).split()
HISTORY = T.StructType(
    [T.StructField(c, T.ArrayType(T.StringType())) for c in ("form", "filingDate", "reportDate", "accessionNumber", "primaryDocument")]
)


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """``ticker, cik, entity_name`` from ``{n: {cik_str, ticker, title}}`` JSON files."""
    entry = "map<string,struct<cik_str:bigint,ticker:string,title:string>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.map_values(F.from_json("value", entry))).alias("e"))
    return raw.select(F.upper("e.ticker").alias("ticker"), pad_cik(F.col("e.cik_str")).alias("cik"), F.col("e.title").alias("entity_name"))


def resolve(tickers: DataFrame, directory: DataFrame) -> DataFrame:
    """``ticker, cik``, whatever the case; an unknown ticker raises when the row is read."""
    d = directory.select(F.col("ticker").alias("t"), "cik").dropDuplicates(["t"])
    joined = tickers.select(F.upper("ticker").alias("ticker")).join(d, F.col("ticker") == F.col("t"), "left")
    unknown = F.raise_error(F.concat(F.lit("unknown ticker "), F.col("ticker"))).cast("string")
    return joined.select("ticker", F.when(F.col("cik").isNull(), unknown).otherwise(F.col("cik")).alias("cik"))


def history_rows(df: DataFrame, history: str = "history") -> DataFrame:
    """One row per filing of a struct of parallel arrays, ``pos`` 0 the newest."""
    h = F.col(history)
    zipped = F.arrays_zip(*[h[f.name].alias(f.name) for f in HISTORY])
    rest = [c for c in df.columns if c != history]
    exploded = df.select(*rest, F.posexplode(zipped).alias("pos", "f"))
    return exploded.select(
        *rest,
        "pos",
        F.col("f.form").alias("form"),
        F.col("f.filingDate").alias("filing_date"),
        F.col("f.reportDate").alias("report_date"),
        F.col("f.accessionNumber").alias("accession_number"),
        F.col("f.primaryDocument").alias("primary_document"),
    )


def latest_per_form(rows: DataFrame, company: str = "cik", order=None, forms=FORMS) -> DataFrame:
    """The first row of each (company, form) in ``order`` (default: position), exact forms only."""
    first = Window.partitionBy(company, "form").orderBy(*(order or [F.col("pos")]))
    wanted = rows.where(F.col("form").isin(*forms))
    return wanted.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def missing_forms(companies: DataFrame, found: DataFrame, forms=FORMS, company: str = "cik") -> DataFrame:
    """``company, form`` for each target form a company lacks."""
    wanted = companies.select(company).distinct().select(company, F.explode(F.array(*[F.lit(f) for f in forms])).alias("form"))
    return wanted.join(found.select(company, "form").distinct(), [company, "form"], "left_anti")


def fetch_company(spark: SparkSession, client, ticker: str, cik: str) -> tuple[DataFrame, list[str]]:
    """(the latest filing of each form with its bytes, ready to store; the forms the company lacks).

    Runs on the driver through ``client`` (``sources.fetch``): the rate limit is per address.
    """
    padded = str(int(cik)).zfill(10)
    body = client.get(f"https://data.sec.gov/submissions/CIK{padded}.json").body.decode("utf-8")
    wrapper = T.StructType([T.StructField("filings", T.StructType([T.StructField("recent", HISTORY)]))])
    parsed = spark.createDataFrame([(padded, body)], "cik string, body string").select(
        "cik", F.from_json("body", wrapper)["filings"]["recent"].alias("history")
    )
    rows, names = [], ["cik", "form", "filing_date", "report_date", "accession_number", "primary_document"]
    for r in latest_per_form(history_rows(parsed)).select(*names).collect():  # one row a form
        plain = r["accession_number"].replace("-", "")
        url = f"https://www.sec.gov/Archives/edgar/data/{int(cik)}/{plain}/{r['primary_document']}"
        stored = f"{ticker.upper()}/{r['form']}_{r['filing_date']}_{plain}/{r['primary_document']}"
        rows.append((ticker.upper(), *[r[n] for n in names], url, stored, bytearray(client.get(url).body)))
    schema = "ticker string, " + ", ".join(f"{n} string" for n in names) + ", source_url string, stored_filename string, content binary"
    return spark.createDataFrame(rows, schema), [f for f in FORMS if f not in {r[2] for r in rows}]


def store_facts(spark: SparkSession, client, ticker: str, cik: str, path: str) -> None:
    """Company facts as received, in a table of their own, apart from the narrative."""
    url = f"https://data.sec.gov/api/xbrl/companyfacts/CIK{str(int(cik)).zfill(10)}.json"
    row = [(ticker.upper(), url, bytearray(client.get(url).body))]
    store_documents(spark.createDataFrame(row, "ticker string, source_url string, content binary"), path)


def read_documents(spark: SparkSession, path: str, pattern: str = "*.htm*") -> DataFrame:
    """``source_path, content, size_bytes, sha256`` of stored documents, bytes untouched."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.select(
        F.col("path").alias("source_path"), "content", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256")
    )


def store_documents(df: DataFrame, path: str) -> None:
    """Sink: bytes, identity and SHA-256, by ticker; Spark's commit protocol makes it all or nothing.

    What is stored already, the same bytes of the same ticker, is not stored again.
    """
    sealed = df.withColumn("sha256", F.sha2("content", 256)).withColumn("size_bytes", F.length("content"))
    store_new(sealed, path, ["ticker", "sha256"], ["ticker"])


def store_new(df: DataFrame, path: str, key: str | list[str], partition: list[str] | None = None) -> None:
    """Append the rows whose ``key`` the table at ``path`` lacks: a cache that can be run again."""
    keys = [key] if isinstance(key, str) else key
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path).select(*keys)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        fresh = df
    else:
        fresh = df.join(there.distinct(), keys, "left_anti")
    writer = fresh.dropDuplicates(keys).write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def parse_filings(
    filings: DataFrame, target: int = TARGET_CHARS, limit: int = MAX_CHARS, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(chunk records, manifest) of ``filings`` with ``content`` and the filing fields.

    A filing fails as a whole, and gives no chunks, if its bytes do not match
    ``sha256``, its form has no section sequence, or a block or chunk does not
    give its text back from its span; the manifest has one row per filing with
    counts and ``status``.
    """
    text = decode_bytes(F.col("content"))
    docs = filings.withColumn("__d", text).select(
        F.col("accession_number").alias("doc"),
        F.col("__d.text").alias("html"),
        F.col("__d.encoding").alias("encoding"),
        "form",
        (F.sha2("content", 256) == F.col("sha256")).alias("sealed"),
        F.col("form").isin(*FORMS).alias("supported"),
    )
    good = docs.where("sealed AND supported")
    # The markup is read twice: once for its blocks, once to give the chunks' texts back.
    head = stored(docs.drop("html"))
    blocks = stored(html_blocks(good, "doc").join(head.select("doc", "form"), "doc"))
    headings = stored(detect_headings(blocks, strict))
    packed = stored(with_chunk_ids(pack_chunks(assign_sections(blocks, headings), target, limit)))
    checked = stored(verify_chunks(good, packed))
    b = blocks.groupBy("doc").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.count_if(~F.col("in_table")).alias("prose_blocks"),
        F.count_if("in_table").alias("table_blocks"),
        F.sum(F.when(~F.col("in_table"), F.length("text")).otherwise(0)).alias("prose_chars"),
        F.count_if("verified").alias("blocks_passed"),
    )
    c = packed.join(checked, ["doc", "chunk_order"]).groupBy("doc").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if("oversized").alias("oversized_chunks"), F.count_if("ok").alias("chunks_passed")
    )
    h = headings.groupBy("doc").agg(F.count_if(~F.col("is_part")).alias("sections_detected"))
    status = (
        F.when(~F.coalesce("sealed", F.lit(False)), "bytes_changed")
        .when(~F.coalesce("supported", F.lit(False)), "unsupported_form")
        .when((F.col("blocks") != F.col("blocks_passed")) | (F.col("chunks") != F.col("chunks_passed")), "round_trip_failed")
        .otherwise("ok")
    )
    counts = ["blocks", "prose_blocks", "table_blocks", "prose_chars", "blocks_passed", "chunks", "oversized_chunks", "chunks_passed", "sections_detected"]
    manifest = (
        head.join(b, "doc", "left").join(c, "doc", "left").join(h, "doc", "left").fillna(0, counts)
        .select(F.col("doc").alias("accession_number"), "form", "encoding", *counts, status.alias("status"))
    )
    manifest = stored(manifest)
    passed = manifest.where("status = 'ok'").select(F.col("accession_number").alias("doc"))
    identity = filings.select(
        F.col("accession_number").alias("doc"), "ticker", "cik", "form", "filing_date", "report_date", "accession_number",
        F.col("stored_filename").alias("source_path"), F.col("sha256").alias("source_sha256"),
    )
    encodings = head.select("doc", "encoding")
    records = packed.join(passed, "doc", "left_semi").join(encodings, "doc").join(identity, "doc").select(*CHUNK_FIELDS)
    return records, manifest


def write_chunks(records: DataFrame, path: str) -> None:
    """Chunk sink by ticker and form, in order within files."""
    records.repartition("ticker", "form").sortWithinPartitions("accession_number", "chunk_order").write.mode("overwrite").partitionBy(
        "ticker", "form"
    ).parquet(path)


def write_chunks_json(records: DataFrame, path: str) -> None:
    """The same records as JSON lines, their fields in a fixed order."""
    rows = records.select(*CHUNK_FIELDS).repartition("accession_number").sortWithinPartitions("accession_number", "chunk_order")
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_chunks_json(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records of JSON lines, blank lines skipped, with ``record_no`` in (path, order)."""
    types = {"chunk_order": "int", "n_blocks": "int", "char_start": "int", "char_end": "int", "oversized": "boolean"}
    schema = ", ".join(f"{c} {types.get(c, 'string')}" for c in CHUNK_FIELDS)
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path).withColumn("__f", F.col("_metadata.file_path"))
    # The index's own order; numbering a whole corpus needs no single task.
    from filigree.operators.ordering import row_numbers

    numbered = row_numbers(rows.withColumn("__g", F.lit(0)), ["__g"], [F.col("__f"), F.col("chunk_order")], "record_no")
    return numbered.withColumn("record_no", F.col("record_no") - 1).drop("__f", "__g")
