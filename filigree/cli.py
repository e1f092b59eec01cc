"""spark-submit entry points: fetch, resolve, parse, index, search, ask, gold, evaluate, serve."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from filigree.api import Service, serve
from filigree.functions.vectors import SLOTS, l2_normalize
from filigree.operators import harness
from filigree.operators.evaluate import evaluate_retrieval
from filigree.operators.search import index_search
from filigree.sources import cases, fetch, filings, index_store


def _fetch(spark: SparkSession, a: argparse.Namespace) -> int:
    client = fetch.Client(fetch.urllib_transport(), os.environ.get("USER_AGENT", ""), fetch.ByteCache(a.cache))
    listed = client.get_json("https://www.sec.gov/files/company_tickers.json")
    numbers = {str(e["ticker"]).upper(): str(e["cik_str"]) for e in listed.values()}
    for ticker in map(str.upper, a.ticker):
        if ticker not in numbers:
            raise SystemExit(f"unknown ticker {ticker}")
        found, missing = filings.fetch_company(spark, client, ticker, numbers[ticker])
        filings.store_documents(found, a.store)
        filings.store_facts(spark, client, ticker, numbers[ticker], a.facts)
        found.select("ticker", "form", "filing_date", "stored_filename").show(truncate=False)
        for form in missing:
            print(f"{ticker} {form}: none in the recent history")
    return 0


def _gold(spark: SparkSession, index: index_store.Index, path: str) -> int:
    asked, decoys = cases.read_gold(spark, path)
    windows = None if index.hashed else index.windows.select(F.col("chunk_id").alias("doc"), F.col("embedding").alias("v"))
    if index.hashed:  # slots as the unit vectors they stand for
        slots = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.array_contains("embedding", i.cast("long")).cast("double"))
        windows = index.windows.select(F.col("chunk_id").alias("doc"), l2_normalize(slots).alias("v"))
    found = evaluate_retrieval(lambda q, m, k, f: index_search(index, q, k=k, method=m, filters=f), asked, decoys, windows)
    for name in ("metrics", "bars", "rescues", "medians", "crowded"):
        found[name].show(truncate=False)
    print("the same twice:", found["same"], "passed:", found["passed"])
    return int(not found["passed"])


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="filigree")
    sub = parser.add_subparsers(dest="command", required=True)
    parse = sub.add_parser("parse", help="stored filings to verified chunks")
    index = sub.add_parser("index", help="chunks to a sealed index")
    for p, names in ((parse, ("filings", "chunks")), (index, ("chunks", "entities", "index"))):
        for n in names:
            p.add_argument(n)
    parse.add_argument("--ticker", action="append")
    resolve = sub.add_parser("resolve", help="tickers to company numbers")
    resolve.add_argument("directory")
    resolve.add_argument("ticker", nargs="+")
    suite = sub.add_parser("evaluate", help="run a folder of cases; exit 1 if one fails")
    for n in ("cases", "chunks", "entities"):
        suite.add_argument(n)
    suite.add_argument("--report")
    fetch_ = sub.add_parser("fetch", help="the latest filings and facts of companies; USER_AGENT names the caller")
    for n in ("store", "facts", "cache"):
        fetch_.add_argument(n)
    fetch_.add_argument("ticker", nargs="+")
    gold = sub.add_parser("gold", help="the gold set against an index; exit 1 if a bar is missed")
    gold.add_argument("index")
    gold.add_argument("gold")
    server = sub.add_parser("serve", help="an index over HTTP; refuses a stale one")
    server.add_argument("index")
    server.add_argument("--port", type=int, default=8000)
    for name in ("search", "ask"):
        p = sub.add_parser(name)
        p.add_argument("index")
        p.add_argument("query")
        p.add_argument("--k", type=int, default=8)
    sub.choices["search"].add_argument("--method", default="fused")
    for c in ("ticker", "form", "section_key"):
        sub.choices["search"].add_argument(f"--{c}")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"filigree {a.command}").getOrCreate()
    if a.command == "parse":
        rows = spark.read.parquet(a.filings)
        if a.ticker:
            rows = rows.where(F.upper("ticker").isin(*[t.upper() for t in a.ticker]))
        records, manifest = filings.parse_filings(rows)
        filings.write_chunks(records, a.chunks)
        failed = manifest.where("status <> 'ok'").select("accession_number", "status")
        failed.show(truncate=False)
        return int(not failed.isEmpty())
    if a.command == "index":
        chunks = spark.read.parquet(a.chunks)
        sources = chunks.select(F.col("source_path").alias("path"), F.col("source_sha256").alias("sha256"))
        print(index_store.build_index(chunks, spark.read.parquet(a.entities), sources, a.index))
        return 0
    if a.command == "resolve":
        asked = spark.createDataFrame([(t,) for t in a.ticker], "ticker string")
        filings.resolve(asked, filings.read_directory(spark, a.directory)).show(truncate=False)
        return 0
    if a.command == "evaluate":
        found = harness.outcomes(cases.read_cases(spark, a.cases), spark.read.parquet(a.chunks), spark.read.parquet(a.entities))
        table = harness.report(found, a.report)
        table.show()
        return int(not table.where("n_passed < n_cases").isEmpty())
    if a.command == "fetch":
        return _fetch(spark, a)
    index = index_store.load_index(spark, a.index)
    if a.command == "gold":
        return _gold(spark, index, a.gold)
    service = Service(None, None, index=index)
    if a.command == "serve":
        serve(service, port=a.port).serve_forever()
    if a.command == "search":
        service.search(a.query, a.k, a.method, ticker=a.ticker, form=a.form, section_key=a.section_key).show(a.k, truncate=False)
    else:
        service.ask(a.query, a.k).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
