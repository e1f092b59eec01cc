"""The service's operations as functions over DataFrames, and a small HTTP layer over them."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.functions.vectors import Encoder
from filigree.operators.answer import Drafter, answer
from filigree.operators.search import index_search, search
from filigree.sources.index_store import Index

# Fixed values.
MAX_QUERY_CHARS, MAX_K_ASK, MAX_K_SEARCH = 2000, 20, 50


class InvalidRequest(ValueError):
    pass


def _checked(text: str, k: int, most: int) -> None:
    if not text or not text.strip() or len(text) > MAX_QUERY_CHARS:
        raise InvalidRequest(f"a query has 1 to {MAX_QUERY_CHARS} characters and is not blank")
    if not 1 <= k <= most:
        raise InvalidRequest(f"k is 1 to {most}")


class Service:
    """Over chunk records, or with ``index`` over a loaded one, whose records they then are.

    ``encoder`` is that of an index that was not built with the hashed one.
    """

    def __init__(
        self,
        chunks: DataFrame | None,
        entities: DataFrame | None,
        drafter: Drafter | None = None,
        index: Index | None = None,
        encoder: Encoder | None = None,
    ) -> None:
        self.chunks = chunks if index is None else index.records
        self.entities = entities if index is None else index.entities
        self.drafter, self.index, self.encoder = drafter, index, encoder
        self.spark = self.chunks.sparkSession

    def health(self) -> dict:
        row = self.chunks.agg(F.count_distinct("chunk_id").alias("n"), F.sort_array(F.collect_set(F.upper("ticker"))).alias("t")).first()
        models = {} if self.index is None else {"embedding_model": self.index.manifest["model_id"]}
        return {"status": "ok", "n_chunks": row["n"], "tickers": row["t"], **models}

    def search(self, query: str, k: int = 8, method: str = "fused", **filters: str) -> DataFrame:
        """The hits by rank, each with its record's fields."""
        _checked(query, k, MAX_K_SEARCH)
        asked = self.spark.createDataFrame([(0, query)], "qid long, text string")
        wanted = {c: v for c, v in filters.items() if v is not None}
        if self.index is not None:
            hits = index_search(self.index, asked, k=k, method=method, filters=wanted, encoder=self.encoder)
        else:
            hits = search(self.chunks, asked, k=k, method=method, filters=wanted, entities=self.entities)
        record = self.chunks.dropDuplicates(["chunk_id"])
        record = record.select(F.col("chunk_id").alias("doc"), F.struct(*record.columns).alias("record"))
        return hits.join(record, "doc").orderBy("rank")

    def ask(self, question: str, k: int = 8) -> DataFrame:
        _checked(question, k, MAX_K_ASK)
        asked = self.spark.createDataFrame([(0, question)], "qid long, text string")
        return answer(asked, self.chunks, self.entities, self.drafter, k, self.index, self.encoder)

    def chunk(self, chunk_id: str) -> dict | None:
        row = self.chunks.where(F.col("chunk_id") == chunk_id).limit(1).collect()
        return row[0].asDict() if row else None


def respond(service: Service, method: str, path: str, body: bytes = b"") -> tuple[int, dict]:
    """(status, JSON) of one request: /health, /search, /ask and /chunks/{id}."""
    try:
        if method == "GET" and path == "/health":
            return 200, service.health()
        if method == "GET" and path.startswith("/chunks/"):
            row = service.chunk(path.removeprefix("/chunks/"))
            return (200, row) if row else (404, {"detail": "no such chunk"})
        if method == "POST" and path in ("/search", "/ask"):
            said = json.loads(body or b"{}")
            if path == "/ask":
                row = service.ask(said.get("question", ""), said.get("k", 8)).first()
                return 200, {"question": said["question"], "refused": not row["answered"], **row.asDict(recursive=True)}
            names = {"ticker": "ticker", "form": "form", "section": "section_key"}
            filters = {column: said[n] for n, column in names.items() if said.get(n) is not None}
            kind = said.get("method", "fused")
            hits = service.search(said.get("query", ""), said.get("k", 8), kind, **filters).collect()
            return 200, {"query": said["query"], "method": kind, "hits": [h.asDict(recursive=True) for h in hits]}
        return 404, {"detail": "not found"}
    except (InvalidRequest, ValueError, TypeError) as e:
        return 422, {"detail": str(e)}


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> HTTPServer:
    """A server of ``respond``; the caller runs ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, said = respond(service, self.command, self.path, body)
            data = json.dumps(said, ensure_ascii=False, default=str).encode("utf-8")
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _do

        def log_message(self, *args) -> None:
            pass

    return HTTPServer((host, port), Handler)
