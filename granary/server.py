"""A small HTTP surface over an Engine: POST /chat, GET /retrieve, GET /bots, GET /, /health and /healthz.

Each request is a table of one row. For batches, call the Engine with tables.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from granary.engine import Engine
from granary.operators import generate


class BadRequest(ValueError):
    pass


def retrieve(engine: Engine, query: str, top_k: int = 6, alpha: float = 0.5) -> list[dict]:
    asked = engine.spark.createDataFrame([(0, query)], "qid int, query string")
    rows = engine.retrieve(asked, top_k, alpha).orderBy("rank").collect()  # top_k rows
    return [{"id": r["id"], "text": r["text"], "score": r["score"], "source": r["source"]} for r in rows]


def chat(engine: Engine, body: dict) -> dict:
    """The answer to a request: message, and if wanted history, persona, temperature, max_tokens, top_k, alpha."""
    if not isinstance(body.get("message"), str) or not body["message"].strip():
        raise BadRequest("message is missing")
    turns = [(str(t.get("role")), str(t.get("content"))) for t in body.get("history") or []]
    schema = f"qid int, message string, history {generate.MESSAGE}, persona string, temperature double, max_tokens int"
    number = lambda k, kind: None if body.get(k) is None else kind(body[k])
    row = (0, body["message"], turns or None, body.get("persona"), number("temperature", float), number("max_tokens", int))
    said = engine.chat(engine.spark.createDataFrame([row], schema), number("top_k", int) or 6, 0.5 if body.get("alpha") is None else float(body["alpha"])).first()
    return {"text": said["text"], "citations": list(said["citations"]), "meta": dict(said["meta"] or {})}


def answer(engine: Engine, method: str, target: str, body: bytes = b"") -> tuple[int, dict]:
    """Status and JSON of a request."""
    url = urlsplit(target)
    asked = {k: v[0] for k, v in parse_qs(url.query).items()}
    try:
        if method == "GET" and url.path in ("/", "/health", "/healthz"):
            return 200, engine.health()
        if (method, url.path) == ("GET", "/bots"):
            return 200, {"bots": engine.bots()}
        if (method, url.path) == ("GET", "/retrieve"):
            query = asked.get("query") or asked.get("q")
            if not query:
                raise BadRequest("query is missing")
            return 200, {"results": retrieve(engine, query, int(asked.get("top_k", 6)), float(asked.get("alpha", 0.5)))}
        if (method, url.path) == ("POST", "/chat"):
            got = json.loads(body or b"{}")
            if not isinstance(got, dict):
                raise BadRequest("the body is no object")
            return 200, chat(engine, got)
    except ValueError as e:  # BadRequest, JSON, numbers
        return 422, {"detail": str(e)}
    except Exception as e:
        return 500, {"detail": f"{type(e).__name__}: {e}"}
    return 404, {"detail": "not found"}


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is bound but not yet running: call serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, found = answer(engine, self.command, self.path, self.rfile.read(size))
            data = json.dumps(found).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _reply

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
