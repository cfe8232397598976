"""The queries that SQL can't express, against plain Python over the small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchloom import session
from matchloom.llm import op01_bpe, op02_decontaminate, op05_toxicity, op09_pii, op10_quality, registry
from matchloom.llm.common import ready
from tests.oracle import SF

vocab = pytest.importorskip("public_tokenizers")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The smallest tables have too few toxic labels to learn from.
LARGER = SF.replace("sf0.001", "sf0.01")
NONSPACE = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fold_of(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def rows(spark):
    return {r["doc_id"]: r["text"] or "" for r in ready(spark).read.parquet(f"{SF}/documents.parquet").collect()}


def test_op1_ids_are_the_librarys(spark, rows):
    enc = op01_bpe.load_encoder(vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN)
    got = registry.op1_bpe(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = enc.encode_ordinary(rows[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest()


def test_op7_counts_are_the_librarys(spark, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocab.path("byte_bpe_50k.json"))
    got = registry.op7_token_counts(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        n = len(lib.encode(rows[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(rows[r["doc_id"]].encode()), n, n > 512)


def naive_raw(model, text):
    """Every pattern tried at every place."""
    weights, exceptions = model[0], model[1]
    read, best = op05_toxicity.readings(text), {}
    for folded in read:
        for start in (i for i in range(len(folded)) if not i or not folded[i - 1].isalpha()):
            for name in weights:
                word = name.rstrip("*")
                end = start + len(word)
                if folded.startswith(word, start) and (name[-1] == "*" or end == len(folded) or not folded[end].isalpha()):
                    before = re.search(r"(\S+)\s*$", folded[:start])
                    if f"{before[1] if before else ''} {name}" not in exceptions and (start not in best or weights[name] > weights[best[start]]):
                        best[start] = name
    total = sum(weights[name] * (1 + math.log(n)) for name, n in Counter(best.values()).items())
    return total / (1 + 0.15 * math.log2(1 + len(read[0]) / 300)) if best else 0.0


def test_op5_equals_naive_matching(spark):
    docs = ready(spark).read.parquet(f"{LARGER}/documents.parquet")
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").where(op05_toxicity.fold_of("doc_id", 4) != 2)
    model = op05_toxicity.learn(docs, labels)
    got = {r["doc_id"]: r for r in registry.op5_toxicity(spark, LARGER).collect()}
    assert set(got) == set(rows) and model[0]
    hits = 0
    for d in sorted(rows)[:120]:
        raw = naive_raw(model, rows[d][:3000]) if len(rows[d]) <= 3000 else None
        if raw is not None:
            hits += raw > 0
            want = 1 / (1 + math.exp(-min(30.0, max(-30.0, model[2] * raw + model[3]))))
            assert abs(got[d]["score"] - want) < 1e-9 and got[d]["predicted"] == int(want >= 0.3) and got[d]["held_out"] == (fold_of(d, 4) == 2)
    assert hits


def test_op8_base_equals_direct_counts(spark, rows):
    tokens = {d: [*NONSPACE.findall(low(t)), None] for d, t in rows.items()}
    counts = Counter(t for d, ts in tokens.items() if fold_of(d, 5) != 1 for t in ts)
    n, v = sum(counts.values()), len(counts)
    got = registry.op8_lm_maxent(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        ts = tokens[r["doc_id"]]
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold_of(r["doc_id"], 5) == 1, len(ts), sum(counts[t] > 0 for t in ts), n)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["score"] < 0
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def regex_spans(text):
    """The base by the patterns as they are written."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern in ((2, r"[0-9]([\x20-]?[0-9])+"), (3, r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if (12 <= len(d) <= 19 and op09_pii.luhn(d)) if kind == 2 else 9 <= len(d) <= 15:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_op9_base_equals_plain_patterns(spark, rows):
    extra = ["a@b.c d@e 1.2.3.4.5 999.1.1.1 4242-4242 4242 4242 +1 (555) 010-9999 +12", "x" * 30_000 + " z@y.org " + "7" * 40, "+1 555 0100 22 10.0.0.1"]
    for t in [*rows.values(), *extra]:
        assert op09_pii.base_spans(t) == regex_spans(t)
    got = registry.op9_pii(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        base = regex_spans(rows[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(op09_pii.written(base).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert set(op09_pii.written(base).split(",")) <= set(r["spans"].split(",")) or not base


def test_op10_tells_quality_apart(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [(r["predicted"], labels[r["doc_id"]]) for r in registry.op10_quality_crf(spark, SF).collect() if r["held_out"] and r["doc_id"] in labels]
    assert got and sum(a == b for a, b in got) >= 0.8 * len(got)


def brute_pipeline(spark, sf_dir):
    """Ids that each stage keeps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = op05_toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(op05_toxicity.fold_of("doc_id", 4) != 2))
    known = op05_toxicity.Lexicon(*model)
    left = [x for x in left if known.score(x[1] or "") < 0.3]
    yield sorted(d for d, _ in left)
    first = {}
    for d, t in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (d, t))
    left = sorted(first.values(), key=lambda x: x[0])
    yield [d for d, _ in left]
    sets = []
    for _, t in left:
        w = NONSPACE.findall(low(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(left)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * min(len(a), len(sets[j])) >= 80 * max(len(a), len(sets[j])) and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    left = [x for i, x in enumerate(left) if top(i) == i]
    yield [d for d, _ in left]
    items = [ALNUM.findall(low(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    clean = []
    for d, t in left:
        w = ALNUM.findall(low(t))
        if not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1)):
            clean.append(d)
    yield clean


def test_pipeline_stage_by_stage(spark):
    docs = ready(spark).read.parquet(f"{LARGER}/documents.parquet")
    sizes = [docs.count()]
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute_pipeline(spark, LARGER)):
        docs, _ = session.materialise(spark, stage(spark, docs, LARGER), f"test-{name}")
        assert sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == want, name
        sizes.append(len(want))
    assert all(a > b for a, b in zip(sizes, sizes[1:]))  # every stage drops something here
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, LARGER).collect()) == want


def test_pipeline_edge_rows(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven"
    kept = "a quiet text about boats and rivers that nobody else has written down before today"
    texts = [None, "", " \n", kept, kept, kept + " again", f"so {item} it goes", "word " * 40_000, "x" * 60_000]
    rows = [(i, t, "en", "s", 1, 0.5, "q") for i, t in enumerate(texts)] + [(3, kept, "en", "s", 1, 0.5, "q"), (None, "no id but text", "en", "s", 1, 0.5, "q")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, __id string"
    labels, items = [(i, 1, int(i == 6)) for i in range(9)], [(1, item), (2, None)]
    for name, data, ddl in (("documents", rows, schema), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        ready(spark).createDataFrame(data, ddl).write.parquet(f"{tmp_path}/some/{name}.parquet")
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()) == ["0", "2", "3", "7", "8", "None"]
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_kept_columns_named_like_results(spark):
    docs = ready(spark).createDataFrame([(1, "t", 2, 3, "s", 0.5)], "doc_id long, text string, n_tokens int, n_hit int, spans string, score double")
    items = spark.createDataFrame([], "item_id long, text string")
    for ask in (
        lambda: op01_bpe.round_trip(docs, "r", "p", keep=("n_tokens",)), lambda: op02_decontaminate.find(docs, items, keep=("n_hit",)),
        lambda: op09_pii.find(docs, None, keep=("spans",)), lambda: op10_quality.score(docs, None, keep=("score",)), lambda: op05_toxicity.score(docs, None, keep=("score",)),
    ):
        with pytest.raises(ValueError):
            ask()
    assert op09_pii.find(docs, None, keep=("doc_id", "score")).columns[:2] == ["doc_id", "score"]
