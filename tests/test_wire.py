import json
import threading
import urllib.error
import urllib.request
from datetime import datetime, timezone

import pytest

from mnemos import wire
from mnemos.engine import MemoryEngine
from mnemos.model import Config

T0 = datetime(2023, 6, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = MemoryEngine(spark, str(tmp_path_factory.mktemp("wire")), Config(half_life_s=-1, window_gamma=-1, num_graphs=4), lambda: T0)
    e.remember("the regatta began", topics=["sea"], entities=["anna"], occurred=["2023-05-07"])
    e.remember("the harbour was quiet", topics=["sea"])
    return e


def test_http(engine):
    server = wire.serve(engine, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def ask(path, body=None):
        data = None if body is None else json.dumps(body).encode() if not isinstance(body, bytes) else body
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data)) as r:
                return r.status, json.loads(r.read() or b"null")
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert ask("/") == (200, {"status": "ok"})
        status, body = ask("/v1/q", {"query": "recall regatta"})
        hit = body["results"]["hits"][0]
        assert status == 200 and body["results"]["count"] == 1 and "warnings" not in body and "said" not in hit and "explain" not in hit
        assert hit["value"] == "the regatta began" and hit["occurred"] == [{"start": "2023-05-07T00:00:00Z", "end": "2023-05-08T00:00:00Z"}] and hit["timestamp"] == "2023-06-01T00:00:00Z"
        status, body = ask("/v1/explain", {"query": "recall regatta topic:sea"})
        assert set(body["results"]["explain"]) == {"background", "seeds", "terms", "timings", "admission"} and set(body["results"]["explain"]["admission"]) == {"1", "2"}
        first = next(h for h in body["results"]["hits"] if "regatta" in h["value"])["explain"]
        assert first["seed"] and {c["source"] for c in first["contributions"]} == {"text", "graph"}
        assert ask("/v1/q", {"query": "when regatta"})[1]["results"]["start"] == "2023-05-07T00:00:00Z"
        catalogue = ask("/v1/q", {"query": "describe recall"})[1]["results"]["catalogue"]
        assert (catalogue["facts"], catalogue["topics"][0]["value"], catalogue["entities"][0]["facts"]) == (2, "sea", 1)
        assert ask("/v1/q", {"query": "recall x", "parameters": {}})[1]["results"] == {"count": 0, "hits": []}
        assert ask("/v1/q", {"query": "recall@2 x"}) == (204, None)
        for bad in ({"query": "forget x"}, {"query": "recall x top:9999"}, {"query": ""}, {"q": 1}, b"{"):
            assert ask("/v1/q", bad)[0] == 400 and "error" in ask("/v1/q", bad)[1]
        assert ask("/v1/nothing")[0] == ask("/v1/other", {"query": "x"})[0] == 404
        graphs = ask("/v1/stats")[1]["graphs"]
        assert graphs[0] == {"id": 0, "order": 4, "size": 3, "nodes": 7, "vectors": 0, "forest_entries": 0, "relevance": "bm25"} and len(graphs) == 4
        assert ask("/v1/q", {"query": "remember@1 'tea'"}) == (200, {"status": "ok"})
    finally:
        server.shutdown()


def test_tools(engine):
    asked = [
        {"id": 1, "method": "initialize", "params": {}}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "recall", "arguments": {"statement": "recall regatta"}}},
        {"id": 4, "method": "tools/call", "params": {"name": "recall", "arguments": {"statement": "remember 'x'"}}}, {"id": 5, "method": "tools/call", "params": {"name": "remember", "arguments": {"statement": "remember@3 'x'"}}},
        {"id": 6, "method": "nothing"}, {"id": 7, "method": "ping"}, {"id": 8, "method": "tools/call", "params": {"name": "recall", "arguments": {"statement": "recall@2 x"}}},
    ]
    got = [json.loads(x) for x in wire.tools(engine, [*map(json.dumps, asked), "", "{"])]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5, 6, 7, 8, None]
    assert got[0]["result"]["serverInfo"]["name"] == "mnemos" and len(got[1]["result"]["tools"]) == 2
    assert got[2]["result"]["content"][0]["text"].startswith("- [said 2023-06-01, happened 2023-05-07] the regatta began") and got[2]["result"]["structuredContent"]["results"]["count"] == 1
    assert got[3]["result"]["isError"] and not got[4]["result"]["isError"] and got[5]["error"]["code"] == -32601 and got[6]["result"] == {}
    assert "empty so far" in got[7]["result"]["content"][0]["text"] and got[8]["error"]["code"] == -32700
