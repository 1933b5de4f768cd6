"""The SPARQL protocol over a store, the query log and a small HTTP server."""

from __future__ import annotations

import json
import random
import re
import threading
import uuid
from collections.abc import Iterator
from datetime import date
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import chain
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException

from ..plans.parser import SyntaxError_, UnsupportedQuery, parse
from ..store import HistoryStore
from ..vocabulary import PREFIXES
from . import results
from .negotiation import negotiate

TIMEOUT = 300.0


class QueryLog:
    """Queries by day, in files; a buffer is shuffled before it is written, so that their order tells nothing."""

    def __init__(self, folder: str, most: int = 128):
        self.folder, self.most, self.held = Path(folder), most, []
        self.folder.mkdir(parents=True, exist_ok=True)
        self.day, self.lock = date.today(), threading.Lock()

    def add(self, query: str) -> None:
        with self.lock:
            if (today := date.today()) != self.day:
                self._write()
                self.day = today
            self.held.append(re.sub(r"\s+", " ", query))
            if len(self.held) > self.most:
                self._write()

    def _write(self) -> None:
        random.shuffle(self.held)
        with (self.folder / f"{self.day.isoformat()}.txt").open("a") as f:
            f.writelines(q + "\n" for q in self.held)
        self.held = []

    def close(self) -> None:
        with self.lock:
            if self.held:
                self._write()


def answer(store: HistoryStore, query: str, accept: str | None = None, *, log: QueryLog | None = None, timeout: float = TIMEOUT) -> tuple[int, str, Iterator[str]]:
    """(HTTP status, media type, body).  400: malformed or unsupported; 406: no
    acceptable type; 500: Spark fails before the first row.  The status is known
    once there is one.  Spark's jobs of the query are cancelled after the timeout."""
    try:
        form = parse(query).form
    except (SyntaxError_, UnsupportedQuery) as e:
        return 400, "text/plain", iter([str(e)])
    if log:
        log.add(query)
    available = {"SELECT": results.SELECT, "ASK": results.ASK}.get(form, results.GRAPH)
    try:
        mime = negotiate(accept, available)
    except ValueError as e:
        return 400, "text/plain", iter([str(e)])
    if mime is None:
        return 406, "text/plain", iter([", ".join(available)])

    sc, tag = store.spark.sparkContext, f"query-{uuid.uuid4().hex}"

    def body() -> Iterator[str]:
        sc.addJobTag(tag)
        timer = threading.Timer(timeout, lambda: sc.cancelJobsWithTag(tag))
        timer.daemon = True
        timer.start()
        try:
            yield from results.write(store.sparql(query), form, mime)
        finally:
            timer.cancel()
            sc.removeJobTag(tag)

    pieces, held = body(), []
    try:
        for piece in pieces:  # what comes before the first row, and it
            held.append(piece)
            if len(held) == 2:
                break
    except (UnsupportedQuery, ValueError) as e:
        return 400, "text/plain", iter([str(e)])
    except (PySparkException, Py4JError) as e:
        return 500, "text/plain", iter([str(e)[:500]])
    return 200, mime, chain(held, pieces)


def describe(store: HistoryStore, accept: str | None) -> tuple[int, str, Iterator[str]]:
    """The service description, in a negotiated form."""
    try:
        mime = negotiate(accept, results.GRAPH)
    except ValueError as e:
        return 400, "text/plain", iter([str(e)])
    if mime is None:
        return 406, "text/plain", iter([", ".join(results.GRAPH)])
    return 200, mime, results.WRITERS[mime](store.spark.createDataFrame(results.service_description(), "s string, p string, o string"))


_PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>History of a graph</title></head><body><h1>SPARQL</h1>
<form action="sparql"><textarea name="query" rows="12" cols="100" aria-label="query">SELECT ?r ?t { ?r schema:about ?t } LIMIT 10</textarea><br><button>Run</button></form>
<p><a href="sparql">Service description</a>, <a href="prefixes">prefixes</a></p></body></html>"""


def serve(store: HistoryStore, host: str = "127.0.0.1", port: int = 7878, log: QueryLog | None = None) -> ThreadingHTTPServer:
    """A server for GET and POST /sparql and GET /prefixes; serve_forever() runs it."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, mime: str, body: Iterator[str]) -> None:
            self.send_response(status)
            self.send_header("Content-Type", mime)
            self.end_headers()
            try:
                for piece in body:
                    self.wfile.write(piece.encode())
            except (PySparkException, Py4JError) as e:  # after the first row: the connection ends before the document does
                self.log_error("%s", e)
                self.close_connection = True

        def _query(self, text: str) -> None:
            self._send(*answer(store, text, self.headers.get("Accept"), log=log))

        def do_GET(self) -> None:
            at = urlsplit(self.path)
            if at.path == "/prefixes":
                self._send(200, "application/json", iter([json.dumps(PREFIXES)]))
            elif at.path == "/sparql":
                asked = parse_qs(at.query).get("query")
                if asked:
                    self._query(asked[0])
                else:
                    self._send(*describe(store, self.headers.get("Accept")))
            elif at.path == "/":
                self._send(200, "text/html; charset=utf-8", iter([_PAGE]))
            else:
                self._send(404, "text/plain", iter(["not found"]))

        def do_POST(self) -> None:
            text = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            kind = (self.headers.get("Content-Type") or "").split(";")[0].strip()
            if kind == "application/sparql-query":
                self._query(text)
            elif kind == "application/x-www-form-urlencoded" and parse_qs(text).get("query"):
                self._query(parse_qs(text)["query"][0])
            else:
                self._send(400, "text/plain", iter(["a query is a form field or a body of application/sparql-query"]))

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
