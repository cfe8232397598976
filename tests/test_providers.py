"""The providers' data source: statuses, waits, rate, batch and stream; the HTTP adapter against a server of this machine."""

import http.server
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from matchloom import session
from matchloom.operators import enrichment as N
from matchloom.sources import providers


class Scripted:
    """Answers in turn."""

    def __init__(self, *answers):
        self.answers = list(answers)

    def get(self, doi):
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a


def test_statuses_and_waits():
    waits = []
    ask = lambda *answers, tries=4: N.ask(Scripted(*answers), "10.1/x", tries, waits.append)
    assert ask((200, "{}")) == ("success", 200, "{}") and ask((404, "gone", {})) == ("not_found", 404, "") and ask((403, "", {})) == ("http_error", 403, "") and not waits
    assert ask((200, "[1]")) == ("invalid_response", 200, "") and ask((200, '{"message": 3}'))[0] == "invalid_response" and ask((200, "<html>"))[0] == "invalid_response"
    assert ask((429, "", {"retry-after": "7"}), (503, "", {"Retry-After": "soon"}), (500, "", {}), (200, '{"message": {}}', {}))[0] == "success" and waits == [7.0, 2, 4]
    waits.clear()
    assert ask(OSError(), OSError(), OSError(), OSError()) == ("network_error", 0, "") and waits == [1, 2, 4]
    assert ask(*[(502, "", {})] * 2, tries=2) == ("http_error", 502, "")


def test_parsers(spark):
    body = json.dumps({"message": {"title": [" A  b "], "license": [{"URL": "u"}, {"URL": " u "}, {}], "author": [{"given": "A", "family": "B", "ORCID": "o", "affiliation": [{"name": "X"}, {}]}], "publisher": "P", "container-title": ["J"], "is-referenced-by-count": 4, "resource": {"primary": {"URL": "r"}}}})
    work = json.dumps({"display_name": "W", "open_access": {"is_oa": True}, "topics": [{"id": "t", "display_name": "T", "score": 0.5, "field": {"display_name": "F"}}], "cited_by_count": 3})
    r = spark.createDataFrame([(body, work), ("{}", "{}")], "c string, o string").select(N.parse_crossref(F.col("c")).alias("c"), N.parse_openalex(F.col("o")).alias("o")).collect()
    c, o = r[0]["c"], r[0]["o"]
    assert c["title"] == "A b" and c["licenses"] == ["u"] and c["people"][0]["affiliations"] == ["X"] and c["people"][0]["full_name"] == "A B" and c["container_title"] == "J" and c["primary_resource_url"] == "r" and c["is_referenced_by_count"] == 4
    assert o["is_open_access"] and o["topic_records"][0]["field"] == "F" and o["topic_records"][0]["domain"] == "" and o["cited_by_count"] == 3
    assert r[1]["c"]["licenses"] == [] and r[1]["o"]["is_open_access"] is False


class Echo:
    def get(self, doi):
        n = int(doi.rsplit("/", 1)[1])
        return (404, "", {}) if n % 4 == 0 else (200, json.dumps({"message": {"title": [doi]}}), {})


def test_batch_stream_and_restart(spark, tmp_path):
    session.ship(spark)
    providers.register(spark, "echo_provider", Echo())
    path, out, check = f"file://{tmp_path}/dois", str(tmp_path / "out"), str(tmp_path / "check")
    df = lambda a, b: spark.createDataFrame([(f"10.1/{i}",) for i in range(a, b)] + [(" 10.1/1 ",), ("",), (None,)], "doi string")
    providers.deposit(df(0, 40), 6, path)
    want = lambda n: sorted((f"10.1/{i}", "not_found" if i % 4 == 0 else "success") for i in range(n))
    load = lambda r: r.format("echo_provider").option("path", path).option("lanes", 3).option("files_per_batch", 2).load()
    batch = load(spark.read)
    assert batch.rdd.getNumPartitions() == 3 and sorted((r["doi"], r["status"]) for r in batch.collect()) == want(40)

    def run():
        q = load(spark.readStream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        q.processAllAvailable()
        q.stop()
        return sorted((r["doi"], r["status"]) for r in spark.read.parquet(out).collect())

    assert run() == want(40)
    spark.createDataFrame([(f"10.1/{i}",) for i in range(40, 60)], "doi string").transform(lambda d: d.coalesce(1)).write.mode("append").parquet(path)
    assert run() == want(60)  # nothing is asked for twice
    assert sum(1 for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit()) >= 4


def test_rate(tmp_path, spark):
    path = providers.deposit(spark.createDataFrame([(f"10.1/{i}",) for i in range(6)], "doi string"), 1, f"file://{tmp_path}/d")
    began = time.monotonic()
    rows = [r for b in providers._answers(path, providers._listed(path)[1], Echo(), 1, 0.1) for r in b.to_pylist()]
    assert len(rows) == 6 and time.monotonic() - began >= 0.5


def test_http_adapter():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.path, self.headers["User-Agent"]))
            code = 429 if "busy" in self.path else 200
            self.send_response(code)
            self.send_header("Retry-After", "3")
            self.end_headers()
            self.wfile.write(b'{"message": {}}')

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    p = providers.Http(f"http://127.0.0.1:{server.server_port}", {"User-Agent": "me"}, {"mailto": "a@b"})
    assert p.get("10.1/a b")[:2] == (200, '{"message": {}}') and seen[0] == ("/works/10.1/a%20b?mailto=a%40b", "me")
    waits = []
    assert N.ask(p, "10.1/busy", 2, waits.append) == ("http_error", 429, "") and waits == [3.0]
    server.shutdown()
    with pytest.raises(ValueError):
        providers.crossref(" ")
    assert providers.openalex("k").params == {"api_key": "k"}
