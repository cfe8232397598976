"""Streamed enrichment: several micro-batches equal one, a restart does nothing again, errors are tried again."""

import random

from matchloom import session
from matchloom.streaming import enrich

SCHEMA = "publication_id string, turn long, fails boolean"


def work(row):
    if row["fails"]:
        raise OSError("busy")
    return ("no_doi", "") if row["publication_id"].endswith("0") else ("enriched", row["publication_id"])


def wanted(rows):
    out, state = [], {}
    for i, _, fails in sorted((r for r in rows if r[0] is not None), key=lambda r: r[1]):
        status, n = state.get(i, ("", 0))
        if status in ("enriched", "no_doi"):
            continue
        state[i] = ("retrieval_error" if fails else "no_doi" if i.endswith("0") else "enriched", n + 1)
        out.append((i, *state[i]))
    return sorted(out)


def test_micro_batches_restart_and_one_batch(spark, tmp_path):
    session.ship(spark)
    r = random.Random(1)
    rows = [(None if k % 50 == 9 else f"p{r.randint(0, 60)}", k, r.random() < 0.6) for k in range(400)]
    parts = [rows[:130], rows[130:260], rows[260:]]

    def run(name, source):
        told = enrich.enriched(enrich.arrivals(spark, source, SCHEMA), work, ["turn"])
        enrich.into(told, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-check")).awaitTermination()
        return sorted((x["publication_id"], x["status"], x["attempt"]) for x in spark.read.parquet(str(tmp_path / f"{name}-out")).collect())

    def put(name, part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    put("all", rows)
    put("some", parts[0])
    assert run("some", str(tmp_path / "some")) == wanted(parts[0])
    put("some", parts[1])
    assert run("some", str(tmp_path / "some")) == wanted(parts[0] + parts[1])  # restarted from its checkpoint
    assert run("some", str(tmp_path / "some")) == wanted(parts[0] + parts[1])  # nothing has come
    put("some", parts[2])
    assert run("some", str(tmp_path / "some")) == wanted(rows) == run("all", str(tmp_path / "all"))
