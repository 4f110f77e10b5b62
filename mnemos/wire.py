"""Answers as JSON values, what is absent left out, and two thin fronts: HTTP and a
tool server that speaks JSON-RPC over lines."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import TextIO

from pyspark.sql import functions as F

from mnemos.engine import Answer, MemoryEngine
from mnemos.operators.ingest import sizes

MAX_BODY = 1 << 20


def _time(t: datetime | None) -> str | None:
    if t is None:
        return None
    return t.replace(tzinfo=t.tzinfo or timezone.utc).astimezone(timezone.utc).isoformat().replace("+00:00", "Z")


def _interval(start, end) -> dict | None:
    return None if start is None else _present(start=_time(start), end=_time(end))


def _present(**values) -> dict:
    return {k: v for k, v in values.items() if v is not None and v != []}


def _hits(a: Answer) -> list[dict]:
    seen: dict[int, list[dict]] = {}
    if a.explain and "contributions" in a.explain:
        for c in a.explain["contributions"].orderBy("source", F.desc("score"), "via").collect():
            named = _present(via=c["via"], degree=c["degree"], named=c["named"] or None, held=c["held"])
            seen.setdefault(c["fact_key"], []).append({"source": c["source"], "score": c["score"], "rank": c["list_rank"] or 0, "count": c["cnt"] or 0} | named)
    out = []
    for r in a.rows.orderBy("place").collect():
        explain = {"seed": r["seed"], "decay": r["decay"], "contributions": seen.get(r["fact_key"], [])} if a.explain else None
        times = [_interval(i["start_at"], i["end_at"]) for i in r["occurred"] or []]
        out.append({"value": r["value"], "timestamp": _time(r["written_at"]), "score": r["score"]} | _present(said=_time(r["said_at"]), occurred=[t for t in times if t], explain=explain))
    return out


def _catalogue(a: Answer) -> dict:
    spans = lambda r: _present(**{c: _interval(r[f"{c}_start"], r[f"{c}_end"]) for c in ("happened", "said", "written")})
    c = a.catalogue
    out = {k: c[k] for k in ("graph", "scope", "facts", "anchors")} | (spans(c) if c["facts"] else {})
    rows = a.rows.orderBy("kind", "place").collect()
    for kind, name in (("topic", "topics"), ("entity", "entities")):
        out[name] = [{"value": r["anchor"], "facts": r["facts"]} | spans(r) for r in rows if r["kind"] == kind]
    return out


def results(a: Answer) -> dict:
    """A read's answer: count and hits, the time of a when, the catalogue of a describe, what an explain adds."""
    hits = [] if a.catalogue is not None or a.rows is None else _hits(a)
    out = {"count": len(hits), "hits": hits}
    if a.span:
        out |= _interval(a.span.start, a.span.end)
    if a.catalogue is not None:
        out |= {"catalogue": _catalogue(a)}
    if a.explain:
        e = {k: a.explain[k] for k in ("background", "seeds", "terms", "timings")}
        e |= _present(admission=a.explain.get("admission"), when={k: results(v) for k, v in a.explain.get("when", {}).items()} or None)
        out["explain"] = e
    return out


def stats(engine: MemoryEngine) -> dict:
    rows = sizes(engine.store.memory(), engine.config.num_graphs, engine.config.relevance).orderBy("graph_id").collect()
    return {"graphs": [{"id": r["graph_id"]} | {k: v for k, v in r.asDict().items() if k != "graph_id"} for r in rows]}


def respond(engine: MemoryEngine, query: str, parameters: dict | None = None, explain: bool = False) -> tuple[int, dict | None]:
    """Status and body: 204 without one for a read of an empty graph, 400 for what the caller can mend."""
    try:
        if explain and query.lstrip().startswith("recall"):
            query = f"explain {query.lstrip()}"
        with engine.execute(query, parameters) as a:
            if a.rows is None:
                return (204, None) if a.empty_graph else (200, {"status": a.status} | _present(warnings=a.warnings))
            return 200, {"results": results(a)} | _present(warnings=a.warnings)
    except ValueError as e:  # parse, limit and dimension errors are such
        return 400, {"error": str(e)}


def serve(engine: MemoryEngine, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """An HTTP server, to be started with ``serve_forever``: GET / and /v1/stats, POST /v1/q and
    /v1/explain with {"query": .., "parameters": {..}}. Each request is one Spark query; the scheduler shares the cores."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: dict | None) -> None:
            data = b"" if body is None else json.dumps(body).encode()
            self.send_response(status)
            if body is not None:
                self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _guarded(self, answer) -> None:
            try:
                self._send(*answer())
            except Exception:  # noqa: BLE001 - a failed request must not end the server
                self._send(500, {"error": "internal server error"})

        def do_GET(self) -> None:
            if self.path == "/":
                self._send(200, {"status": "ok"})
            elif self.path == "/v1/stats":
                self._guarded(lambda: (200, stats(engine)))
            else:
                self._send(404, {"error": f"no endpoint GET {self.path}"})

        def do_POST(self) -> None:
            if self.path not in ("/v1/q", "/v1/explain"):
                self._send(404, {"error": f"no endpoint POST {self.path}"})
                return
            size = int(self.headers.get("Content-Length") or 0)
            if size > MAX_BODY:
                self._send(400, {"error": f"a body of more than {MAX_BODY} bytes"})
                return
            try:
                asked = json.loads(self.rfile.read(size))
                text, params = asked["query"], asked.get("parameters") or {}
                if not isinstance(text, str) or not text.strip() or not isinstance(params, dict):
                    raise ValueError
            except (ValueError, KeyError, TypeError, AttributeError):
                self._send(400, {"error": 'expected {"query": "...", "parameters": {"name": [numbers]}}'})
                return
            self._guarded(lambda: respond(engine, text, params, self.path == "/v1/explain"))

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


TOOLS = [
    {
        "name": name,
        "description": text,
        "inputSchema": {"type": "object", "properties": {"statement": {"type": "string"}, "parameters": {"type": "object"}}, "required": ["statement"]},
    }
    for name, text in (("remember", "Stores a fact: remember@N 'text' topic:.. entity:.."), ("recall", "Runs a recall, an explain recall, a describe recall or a when."))
]


def tools(engine: MemoryEngine, lines: Iterable[str]) -> Iterator[str]:
    """Answers to JSON-RPC requests, one a line: initialize, ping, tools/list, tools/call. A tool's failure is a result marked as an error."""
    for line in lines:
        if not line.strip():
            continue
        try:
            asked = json.loads(line)
        except ValueError:
            yield json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}})
            continue
        if "id" not in asked:
            continue  # a notification
        method, params, out = asked.get("method"), asked.get("params") or {}, {}
        if method == "initialize":
            out = {"protocolVersion": params.get("protocolVersion", "2025-03-26"), "capabilities": {"tools": {}}, "serverInfo": {"name": "mnemos", "version": "2"}}
        elif method == "tools/list":
            out = {"tools": TOOLS}
        elif method == "tools/call":
            out = _call(engine, params.get("name"), params.get("arguments") or {})
        elif method != "ping":
            yield json.dumps({"jsonrpc": "2.0", "id": asked["id"], "error": {"code": -32601, "message": f"no method {method}"}})
            continue
        yield json.dumps({"jsonrpc": "2.0", "id": asked["id"], "result": out})


def _call(engine: MemoryEngine, tool: str | None, arguments: dict) -> dict:
    statement = str(arguments.get("statement", ""))
    try:
        if tool not in ("remember", "recall"):
            raise ValueError(f"no tool {tool}")
        if statement.lstrip().lower().startswith("remember") != (tool == "remember"):
            raise ValueError(f"{tool} doesn't run this statement: {statement}")
        with engine.execute(statement, arguments.get("parameters")) as a:
            text = a.text() or a.status
            body = {} if a.rows is None else {"structuredContent": {"results": results(a)} | _present(warnings=a.warnings)}
            return {"content": [{"type": "text", "text": text}], "isError": False} | body
    except ValueError as e:
        return {"content": [{"type": "text", "text": str(e)}], "isError": True}


def serve_tools(engine: MemoryEngine, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    for line in tools(engine, source):
        print(line, file=sink, flush=True)
