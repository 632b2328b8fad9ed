"""The explorer as a web service: a page, the graph, and blocks of source."""

from __future__ import annotations

import json
from collections.abc import Iterable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame

from ..sources.blocks import read_block
from . import engine

PAGE = Path(__file__).with_name("viewer.html")
JSON = "application/json; charset=utf-8"


def answer(facts: dict[str, DataFrame | None], base: str, target: str) -> tuple[int, str, Iterable[str]]:
    """Status, type and body of a request: / is the page, /graph.json the graph, /source a block."""
    url = urlsplit(target)
    if url.path == "/":
        return 200, "text/html; charset=utf-8", [PAGE.read_text(encoding="utf-8")]
    if url.path == "/graph.json":
        return 200, JSON, engine.graph_chunks(facts)
    if url.path == "/source":
        asked = {k: v[0] for k, v in parse_qs(url.query).items()}
        try:
            return 200, JSON, [json.dumps(read_block(base, asked.get("file", ""), asked.get("range", "")).row(), ensure_ascii=False) + "\n"]
        except (ValueError, OSError) as e:
            return 400, "text/plain; charset=utf-8", [f"{e}\n"]
    return 404, "text/plain; charset=utf-8", ["404 page not found\n"]


def server(address: str, facts: dict[str, DataFrame | None], base: str) -> ThreadingHTTPServer:
    """A server on ``host:port`` that is not started yet."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            status, kind, body = answer(facts, base, self.path)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.end_headers()
            for part in body:
                self.wfile.write(part.encode())

        def log_message(self, *_: object) -> None:
            pass

    host, _, port = address.rpartition(":")
    return ThreadingHTTPServer((host or "localhost", int(port)), Handler)


def serve(address: str, facts: dict[str, DataFrame | None], base: str) -> None:
    with server(address, facts, base) as s:
        s.serve_forever()
