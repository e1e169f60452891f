"""One protocol for an index, wherever it is: in the session, stored as files, or behind HTTP; and the server of the latter.

An index answers next_tokens(prefix), the map from next tokens to leaves; those in Spark answer probes of a whole table, too.
The server is for interactive use beside a stored index: it reads single keys. Jobs read the index's tables.
"""

from __future__ import annotations

import json
import os
import ssl
import time
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from factloom.operators import lookup

from . import readers, writers

#: Seconds that a look-up waits, times that it is tried, and the variable that names a certificate file (false: none is checked).
TIMEOUT, TRIES, CERTIFICATES = 15, 5, "HTTP_ROOTCERT"


class Index(Protocol):
    """What answers look-ups."""

    def next_tokens(self, prefix: list) -> dict: ...


class MemoryIndex:
    """An index of leaves(tokens), distinct and maximal."""

    def __init__(self, leaves: DataFrame):
        self.leaves = leaves

    def probe(self, probes: DataFrame) -> DataFrame:
        """probe and next of probes(probe)."""
        return lookup.next_tokens(probes, self.leaves).select("probe", "next")

    def next_tokens(self, prefix: list) -> dict:
        return _one(self, self.leaves.sparkSession, prefix, self.leaves.schema["tokens"].dataType.simpleString())


class StoredIndex:
    """An index that factloom.sources.writers stored."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.edge, self.suffixes = spark, readers.open_index(spark, path), spark.read.parquet(f"{path}/suffixes").select("key", "suffix")
        self.switch = writers.index_config(spark, path)["switch"]

    def probe(self, probes: DataFrame) -> DataFrame:
        return lookup.persisted_next_tokens(probes, self.edge, self.suffixes, self.switch)

    def next_tokens(self, prefix: list) -> dict:
        return _one(self, self.spark, prefix, self.edge.schema["prefix"].dataType.simpleString())


def _one(index: MemoryIndex | StoredIndex, spark: SparkSession, prefix: list, kind: str) -> dict:
    found = index.probe(spark.createDataFrame([(list(prefix),)], f"probe {kind}")).first()
    return dict(found["next"] or {})


class HttpIndex:
    """An index behind a server: a table at a URL. Tries again, a little later each time, when the server can't be reached or fails."""

    def __init__(self, url: str, tablename: str, certificates: str | None = None):
        self.url = f"{url.rstrip('/')}/{tablename}"
        found = certificates or os.environ.get(CERTIFICATES)
        self.context = ssl._create_unverified_context() if found == "false" else ssl.create_default_context(cafile=found)

    def next_tokens(self, prefix: list) -> dict:
        request = urllib.request.Request(self.url, json.dumps(list(prefix)).encode(), {"Content-Type": "application/json"})
        for attempt in range(TRIES):
            try:
                secure = {"context": self.context} if self.url.startswith("https") else {}
                with urllib.request.urlopen(request, timeout=TIMEOUT, **secure) as answer:
                    return {t: n for t, n in json.load(answer)}
            except urllib.error.HTTPError as e:
                if e.code < 500 or attempt == TRIES - 1:
                    raise
            except OSError:
                if attempt == TRIES - 1:
                    raise
            time.sleep(0.1 * 2**attempt)
        raise AssertionError


def server(tables: dict[str, Index], host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server, not yet running, that answers POST /<table> with a JSON array of tokens by [token, leaves] pairs; unknown tables are 404, other bodies 400."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            index = tables.get(self.path.strip("/"))
            try:
                prefix = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                code = 404 if index is None else 200 if isinstance(prefix, list) else 400
            except ValueError:
                code = 400
            body = json.dumps(list(index.next_tokens(prefix).items()) if code == 200 else []).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)


def open_served(spark: SparkSession, url: str) -> Index:
    """The index at a URL: files, or http(s)://host/table. A database's rows are read by readers.open_index()."""
    kind = readers.parse_url(url)["kind"]
    if kind == "http":
        base, _, table = url.rpartition("/")
        return HttpIndex(base, table)
    if kind == "file":
        return StoredIndex(spark, url)
    raise ValueError(f"read {url} as a table")
