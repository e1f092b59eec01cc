import json

import pytest
from pyspark.sql import functions as F

from filigree.functions.vectors import TextEncoder, hash_encode
from filigree.sources import cases, filings, index_store
from filigree.sources.fetch import ByteCache, Client, FetchError, RateLimiter, Response, valid_user_agent
from filigree.streaming.ingest import arrivals, ingest, stream_filings

UA = "Jane Doe jane@corp.io"


@pytest.mark.parametrize("ua,ok", [(UA, True), ("", False), ("Jane Doe", False), ("jane@corp.io", False), ("Your Name you@corp.io", False), ("J D j@localhost", False)])
def test_user_agent(ua, ok):
    assert valid_user_agent(ua) is ok


def test_rate_limit_holds_on_a_virtual_clock():
    now, times = [0.0], []
    limiter = RateLimiter(8, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(40):
        limiter.acquire()
        times.append(now[0])
    assert all(b - a >= 0.125 - 1e-9 for a, b in zip(times, times[1:]))


def client(tmp_path, answers, slept, retries=3):
    it = iter(answers)

    def send(url, headers):
        got = next(it)
        if isinstance(got, Exception):
            raise got
        return got

    return Client(send, UA, ByteCache(tmp_path), RateLimiter(8, lambda: 0.0, lambda s: None), retries, 0.5, slept.append)


def test_retries_and_cache(tmp_path):
    slept, body = [], b"\xef\xbb\xbfa\r\n\x00z"
    c = client(tmp_path, [OSError("down"), Response(b"", 503, {"Retry-After": "7"}), Response(b"", 429, {"Retry-After": "0"}), Response(body, 200, {})], slept)
    assert c.get("u").body == body and slept == [0.5, 7.0, 2.0]
    assert c.get("u").body == body  # from the cache: the transport has nothing left
    with pytest.raises(FetchError):
        client(tmp_path, [Response(b"", 404, {})], []).get("v")
    with pytest.raises(FetchError):
        client(tmp_path, [Response(b"", 500, {})] * 2, [], 1).get("w")


def test_directory_history_and_latest(spark, tmp_path):
    (tmp_path / "dir.json").write_text(json.dumps({"0": {"cik_str": 320193, "ticker": "abc", "title": "Abc"}}))
    d = filings.read_directory(spark, str(tmp_path / "dir.json"))
    assert [tuple(r) for r in d.collect()] == [("ABC", "0000320193", "Abc")]
    t = spark.createDataFrame([("Abc",)], "ticker string")
    assert filings.resolve(t, d).first().cik == "0000320193"
    with pytest.raises(Exception, match="unknown ticker"):
        filings.resolve(spark.createDataFrame([("zzz",)], "ticker string"), d).collect()
    h = {"form": ["8-K", "10-Q", "10-K/A", "10-Q"], "filingDate": list("dcba"), "reportDate": ["", None, "x", "y"], "accessionNumber": list("4321"), "primaryDocument": list("wxyz")}
    df = spark.createDataFrame([("1", h)], filings.T.StructType([filings.T.StructField("cik", filings.T.StringType()), filings.T.StructField("history", filings.HISTORY)]))
    rows = filings.history_rows(df)
    latest = filings.latest_per_form(rows)
    assert [(r.form, r.accession_number) for r in latest.collect()] == [("10-Q", "3")]
    assert [tuple(r) for r in filings.missing_forms(df, latest).collect()] == [("1", "10-K")]


def test_store_is_byte_exact_and_idempotent(spark, tmp_path):
    body = bytearray(b"\xef\xbb\xbf\x00\r\n\xff")
    df = spark.createDataFrame([("A", "1", body)], "ticker string, accession_number string, content binary")
    for _ in range(2):
        filings.store_new(df, str(tmp_path / "s"), "accession_number")
    assert bytes(spark.read.parquet(str(tmp_path / "s")).first().content) == bytes(body)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1
    for _ in range(2):
        filings.store_documents(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    assert spark.read.parquet(str(tmp_path / "t")).first().size_bytes == len(body)
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.htm").write_bytes(bytes(body))
    assert bytes(filings.read_documents(spark, str(tmp_path / "raw")).first().content) == bytes(body)


def test_index_gates(spark, tmp_path):
    rows = [("c1", "A", "10-K", "2024", "2023", "Business", "long text " * 120), ("c2", "B", "10-K", "2024", None, "Risk", "short")]
    chunks = spark.createDataFrame(rows, "chunk_id string, ticker string, form string, filing_date string, report_date string, section_title string, text string")
    entities = spark.createDataFrame([("A", "Acme"), ("B", None)], "ticker string, entity_name string")
    sources = spark.createDataFrame([("p1", "h1"), ("p2", "h2")], "path string, sha256 string")
    path = str(tmp_path / "index")
    m = index_store.build_index(chunks, entities, sources, path)
    assert m["n_docs"] == 2
    t = index_store.load_index(spark, path, sources, "hashed-512")
    assert t.windows.where("chunk_id = 'c1'").count() == 2 and t.records.where("text LIKE '%Acme%'").count() == 0
    new = spark.createDataFrame([("p1", "h1"), ("p2", "zz"), ("p3", "h3")], "path string, sha256 string")
    assert {tuple(r) for r in index_store.stale_sources(sources, new).collect()} == {("p2", "changed"), ("p3", "new")}
    with pytest.raises(index_store.StaleIndexError):
        index_store.load_index(spark, path, new)
    with pytest.raises(index_store.StaleIndexError):
        index_store.load_index(spark, path, model_id="other")
    with pytest.raises(index_store.StaleIndexError):
        index_store.load_index(spark, path, dim=384)
    with pytest.raises(ValueError):
        index_store.build_index(chunks, entities, sources, path, TextEncoder("hashed-512", 512, hash_encode))
    t.windows.limit(1).write.mode("append").parquet(f"{path}/windows")
    with pytest.raises(index_store.StaleIndexError):
        index_store.load_index(spark, path)


def test_cases_and_gold(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("id: c1\ntype: correctness\nquestion: q\nexpected_facts: ['x']\n")
    assert cases.read_cases(spark, str(tmp_path)).first().expected_facts == ["x"]
    for text in ("id: c1\ntype: filter\nquery: q\n", "id: c2\ntype: odd\n", "id: c2\ntype: filter\n", "id: c2\ntype: filter\nquery: q\nbogus: 1\n"):
        (tmp_path / "b.yaml").write_text(text)
        with pytest.raises(ValueError):
            cases.read_cases(spark, str(tmp_path))
    (tmp_path / "gold.jsonl").write_text('{"qid":"1","type":"lexical","query":"q","acceptable":["a"]}\n\n{"qid":"2","type":"off_corpus","query":"z"}\n')
    gold, decoys = cases.read_gold(spark, str(tmp_path / "gold.jsonl"))
    assert (gold.count(), decoys.count()) == (1, 1)
    assert cases.duplicate_ids(spark.createDataFrame([("a",), ("a",), ("b",)], "id string"), "id").count() == 1


def test_chunk_lines_are_numbered_in_order(spark, tmp_path):
    for name, orders in (("b", (0, 1)), ("a", (1, 0))):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"chunk_id": f"{name}{i}", "chunk_order": i, "text": "t"}) + "\n" for i in orders))
    rows = filings.read_chunks_json(spark, str(tmp_path)).orderBy("record_no").collect()
    assert [r.chunk_id for r in rows] == ["a0", "a1", "b0", "b1"] and [r.record_no for r in rows] == [0, 1, 2, 3]


def test_streaming_ingest(spark, tmp_path):
    import hashlib

    body = b"<p>Item 1. Business</p><p>Words.</p>"
    schema = "accession_number string, ticker string, cik string, form string, filing_date string, report_date string, content binary, sha256 string, stored_filename string"
    row = lambda n: (n, "A", "1", "10-K", "d", None, bytearray(body), hashlib.sha256(body).hexdigest(), n)
    for n, accession in enumerate(("1", "1", "2")):
        spark.createDataFrame([row(accession)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(stream_filings(spark, str(tmp_path / "in"), schema), str(tmp_path / "chunks"), str(tmp_path / "man"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.chunk_id for r in spark.read.parquet(str(tmp_path / "chunks")).collect()) == ["1-00000", "2-00000"]
    spark.createDataFrame([("2024-01-01 01:00:00",), ("2024-01-01 05:00:00",), ("2024-01-03 01:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "ev"))
    q = arrivals(spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "ev"))).writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("arrivals").collect()) == [1, 2]


def test_fetch_company_and_json_sinks(spark, tmp_path):
    history = {"filings": {"recent": {"form": ["10-K/A", "10-K", "8-K"], "filingDate": ["3", "2", "1"], "reportDate": ["", "r", ""], "accessionNumber": ["0-3", "0-2", "0-1"], "primaryDocument": ["a", "b.htm", "c"]}}}
    body = b"<p>Item 1. Business</p><p>Words.</p>"
    pages = {
        "https://data.sec.gov/submissions/CIK0000000042.json": json.dumps(history).encode(),
        "https://www.sec.gov/Archives/edgar/data/42/02/b.htm": body,
        "https://data.sec.gov/api/xbrl/companyfacts/CIK0000000042.json": b'{"entityName": "Acme"}',
    }
    c = Client(lambda url, headers: Response(pages[url], 200, {}), UA, None, RateLimiter(8, lambda: 0.0, lambda s: None))
    df, missing = filings.fetch_company(spark, c, "acm", "42")
    row = df.first()
    assert missing == ["10-Q"] and bytes(row.content) == body and row.accession_number == "0-2" and df.count() == 1
    filings.store_documents(df, str(tmp_path / "store"))
    filings.store_facts(spark, c, "acm", "42", str(tmp_path / "facts"))
    assert bytes(spark.read.parquet(str(tmp_path / "facts")).first().content) == b'{"entityName": "Acme"}'
    records, manifest = filings.parse_filings(spark.read.parquet(str(tmp_path / "store")))
    filings.write_chunks_json(records, str(tmp_path / "chunks"))
    filings.write_manifest(manifest, str(tmp_path / "manifest"))
    assert filings.read_chunks_json(spark, str(tmp_path / "chunks")).first().section_key == "item_1"
    assert spark.read.json(str(tmp_path / "manifest")).first().status == "ok"
    filings.write_chunks(records, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).first().form == "10-K"
