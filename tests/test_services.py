"""HTTP clients, remote rows and the command line, against a server on this machine."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from ferrule import cli, services
from ferrule.sources import documents, remote, store


class Fake(BaseHTTPRequestHandler):
    """A service that embeds by length, reranks by length, chats in capitals, and pages through 230 rows."""

    def _say(self, body, status=200):
        data = json.dumps(body).encode()
        self.send_response(status)
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        asked = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items() if k in ("offset", "length")}
        rows = [{"row": {"issue_area": f"Area {i}", "conversation": f"talk {i}", "qa": {"knowledge": []}}} for i in range(asked["offset"], min(230, asked["offset"] + asked["length"]))]
        self._say({"rows": rows})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path == "/embeddings":
            self._say({"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]})
        elif self.path == "/rerank":
            self._say({"results": [{"index": i, "relevance_score": float(len(d["text"]))} for i, d in enumerate(body["documents"]) if d["text"] != "none"]})
        elif self.path == "/scroll":
            first, whole = body.get("offset", 0), body["with_payload"]
            ids = range(first, min(23, first + body["limit"]))
            points = [{"id": i} | ({"payload": {"doc": f"d{i}"}, "vector": [i, 0.5] if i % 2 else {"dense": [i]}} if whole else {}) for i in ids]
            self._say({"result": {"points": points, "next_page_offset": first + len(ids) if first + len(ids) < 23 else None}})
        elif self.path == "/v1/messages":
            self._say({"content": [{"type": "text", "text": body["messages"][0]["content"][0]["text"].upper()}, {"type": "tool"}]})
        else:
            self._say({"detail": "no"}, 500)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Fake)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_clients(url):
    assert services.HttpEmbedder(url, "m")(["a", "bcd"]) == [[1.0, 1.0], [3.0, 1.0]]
    assert services.HttpReranker(f"{url}/rerank")("q", ["ab", "none", "abc"]) == [2.0, 0.0, 3.0]
    assert services.HttpChat(url, "m")("hello") == "HELLO"
    assert services.scores_of({"scores": [1, "2"]}, 2) == [1.0, 2.0]
    for payload, match in (({"scores": [1]}, "1 scores for 2"), ({}, "scores or results")):
        with pytest.raises(RuntimeError, match=match):
            services.scores_of(payload, 2)
    assert services.text_of({"content": "said "}) == "said "
    with pytest.raises(RuntimeError, match="no text"):
        services.text_of({"content": []})
    with pytest.raises(RuntimeError, match="HTTP 500"):
        services.request_json("POST", f"{url}/nowhere", {})
    with pytest.raises(RuntimeError, match="refused"):
        services.request_json("GET", "http://127.0.0.1:9/x")


def test_remote_rows(spark, url, tmp_path):
    rows = remote.read_rest_rows(spark, url, limit=250, page=100, dataset="d")
    assert rows.count() == 230 and rows.agg(F.countDistinct("issue_area")).first()[0] == 230
    assert json.loads(rows.first().qa) == {"knowledge": []}
    few = remote.read_rest_rows(spark, url, limit=7, page=3)
    assert few.count() == 7 and few.rdd.getNumPartitions() == 3
    with pytest.raises(RuntimeError, match="no dataset rows. Local copy: .*REST"):
        remote.read_dataset(spark, str(tmp_path / "none.parquet"), "http://127.0.0.1:9/rows").count()


def test_rows_by_cursor(spark, url, tmp_path):
    found = remote.read_cursor_rows(spark, f"{url}/scroll", pageSize=5)
    assert found.rdd.getNumPartitions() == 5
    rows = {r.id: (json.loads(r.payload)["doc"], r.vector) for r in found.collect()}
    assert len(rows) == 23 and rows["3"] == ("d3", [3.0, 0.5]) and rows["4"] == ("d4", [4.0])
    assert remote.read_cursor_rows(spark, f"{url}/scroll", pageSize=5, cursor=20).count() == 3

    def run(batches):
        """The stream from its checkpoint on, stopped after a number of batches."""
        query = remote.read_cursor_rows(spark, f"{url}/scroll", stream=True, pageSize=4, pagesPerBatch=2).writeStream.format("parquet")
        query = query.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        if batches is None:
            query.processAllAvailable()
        while batches and (query.lastProgress is None or query.lastProgress["batchId"] < batches - 1):
            time.sleep(0.1)
        query.stop()
        return [int(r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()]

    some = run(1)
    assert 8 <= len(some) <= 23
    assert sorted(run(None)) == list(range(23))  # goes on where it stopped, no row twice


def test_command_line(spark, url, tmp_path, capsys):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "refunds.md").write_text("---\ndoc_id: refunds\ntitle: Refunds\n---\n\n## Refund\n\nA refund takes 7 days.\n", encoding="utf-8")
    (docs / "points.md").write_text("---\ndoc_id: points\ntitle: Points\n---\n\n## Points\n\nPoints expire.\n", encoding="utf-8")
    (tmp_path / "cases.csv").write_text("case_id,query,expected_doc_id,must_answer,expected_terms\n1,refund days,refunds,true,7 days\n2,unrelated,,false,\n", encoding="utf-8")
    index = ["--index", str(tmp_path / "index"), "--docs", str(docs)]
    assert cli.main(["index", *index], spark) == 0 and "2 added" in capsys.readouterr().out
    assert cli.main(["ask", *index, "--query", "refund days", "--events", str(tmp_path / "events")], spark) == 0
    said = capsys.readouterr().out
    assert "7 days" in said and "mode: extractive" in said and spark.read.json(str(tmp_path / "events")).count() == 1
    assert cli.main(["ask", *index, "--query", "refund days", "--trace-only"], spark) == 0
    assert json.loads(capsys.readouterr().out)["doc_ids"] == ["points", "refunds"]
    served = ["--embedder-url", url, "--embedder-model", "m", "--dimensions", "2", "--reranker-url", f"{url}/rerank", "--chat-url", url]
    assert cli.main(["ask", "--index", str(tmp_path / "other"), "--docs", str(docs), "--query", "refund days", *served], spark) == 0
    assert "mode: llm" in capsys.readouterr().out
    assert cli.main(["eval", *index, "--cases", str(tmp_path / "cases.csv")], spark) == 0
    assert "PASS 1" in (said := capsys.readouterr().out) and "/2 passed" in said
    assert cli.main(["import", "--url", url, "--limit", "30", "--output-dir", str(tmp_path / "cases")], spark) == 0
    assert len([p for p in (tmp_path / "cases").iterdir() if p.name.startswith("filename=")]) == 3


def test_stored_rows_by_id_and_relative_paths(spark, tmp_path):
    raw = [(f"f{i}", f"d{i}", f"# D{i}\n\n{t}\n") for i, t in enumerate(["one", "two"])]
    index = store.IndexStore(spark, str(tmp_path / "index"))
    index.sync(documents.with_defaults(documents.parse_frontmatter(spark.createDataFrame(raw, "source_path string, name string, raw_text string"))))
    ids = index.chunks().select("chunk_id", "parent_id")
    assert index.hydrate(ids.unionByName(ids).unionByName(spark.createDataFrame([("x", "y")], ids.schema))).count() == 2
    found = index.siblings(ids.limit(1).unionByName(spark.createDataFrame([("x", "y")], ids.schema)))
    assert sorted(len(r.siblings) for r in found.collect()) == [0, 1]
    paths = spark.createDataFrame([("file:///a/b/c.md",), ("/a/bc.md",), ("file:/a/b/d/e.md",)], "p string")
    assert [r[0] for r in paths.select(documents.relative_to(F.col("p"), "/a/b")).collect()] == ["c.md", "/a/bc.md", "d/e.md"]
