"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, no rows, extra columns."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from matchloom.llm import op01_bpe, op02_decontaminate, op03_jaccard, op04_exact, op05_toxicity, op06_binary, op07_counts, op08_maxent, op09_pii, op10_quality
from matchloom.llm.common import ready
from matchloom.session import Scratch
from tests.oracle import same

vocab = pytest.importorskip("public_tokenizers")
LONG = "word " * 30_000 + "x" * 50_000
ITEM = "one two three four five six seven eight nine ten eleven"
TEXTS = [None, "", " \n", "a", "a b c d", "a  b\nc d", LONG, LONG + " end", f"before {ITEM.upper()} after", "Same Text here. " * 20, "same text here. " * 20, "mail x@y.org or 10.0.0.1"]
COLUMNS = "doc_id long, text string, n_hit long, score double, size int, node long, ids string, items string, spans string, bits int, `key` string"


def table(spark, texts=TEXTS):
    rows = [(i, t, 7, 0.5, 1, 2, "i", "j", "s", 3, "k") for i, t in enumerate(texts)]
    rows += [rows[4]] if len(rows) > 4 else []  # a repeated row
    return ready(spark).createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark)


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM), (2, "ten eleven"), (3, ""), (4, None), (5, "nothing of this occurs at all")], "item_id long, text string")


def test_op1(spark, docs, nothing):
    rank, n = vocab.path("byte_bpe_50k.tiktoken"), len(TEXTS) + 1
    got = op01_bpe.round_trip(docs, rank, vocab.PATTERN).collect()
    assert len(got) == n and all(r["decoded_sha256"] == hashlib.sha256((TEXTS[r["doc_id"]] or "").encode()).hexdigest() for r in got)
    back = op01_bpe.decode(op01_bpe.encode(docs, rank, vocab.PATTERN), rank, vocab.PATTERN).collect()
    assert all(r["bytes"].decode() == (TEXTS[r["doc_id"]] or "") for r in back)
    assert op01_bpe.round_trip(nothing, rank, vocab.PATTERN).count() == 0


def test_op2(spark, docs, nothing, benchmark):
    got = {r["doc_id"]: r for r in op02_decontaminate.find(docs, benchmark).collect()}
    assert (got[8]["n_words"], got[8]["n_hit"], got[8]["items"]) == (13, 11, ["1", "2"]) and got[0]["n_words"] == 0 and got[5]["n_hit"] == 0
    joined = {r["doc_id"]: r for r in op02_decontaminate.find(docs, benchmark, broadcast_bytes=0).collect()}
    assert joined == got
    kept = op02_decontaminate.remove_documents(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)
    cut = op02_decontaminate.remove_spans(docs, benchmark).where("doc_id = 8").first()["text"]
    assert cut == "before  after"
    assert op02_decontaminate.find(nothing, benchmark).count() == 0
    assert op02_decontaminate.remove_documents(docs, benchmark.limit(0)).count() == len(TEXTS) + 1


def test_op3(spark, docs, nothing):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op03_jaccard.classes(docs).collect()}
    assert got[0] == (0, 0) and got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (1, 3) and got[4] == (2, 4) and got[5] == (2, 4) and got[10][1] == 9
    kept = op03_jaccard.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(TEXTS))) - {5, 10} - ({7} if got[7][1] == 6 else set())
    assert op03_jaccard.classes(nothing).count() == 0


def test_op3_keeps_one_row_of_a_component(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = ready(spark).createDataFrame([(1, words), (1, words), (2, words), (None, words + " w1"), (3, words + " w2"), (5, ""), (6, None)], "doc_id long, text string")
    assert sorted(map(tuple, op03_jaccard.keep_one(rows).collect()), key=str) == sorted([(1, words), (5, ""), (6, None)], key=str)
    only = ready(spark).createDataFrame([(None, words), (None, words + " w1")], "doc_id long, text string")
    assert op03_jaccard.keep_one(only).count() == 1


def test_op3_many_near_copies_with_rare_shingles_of_their_own(spark):
    words = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(3_000):
        t = list(words)
        t[3 + i % 110] = f"own{i}"  # its three shingles are the rarest of the text
        texts.append(" ".join(t))
    texts += [" ".join(f"z{(i * k) % 97}" for i in range(80)) for k in range(2, 20)]
    got = {r["doc_id"]: r["component_id"] for r in op03_jaccard.classes(ready(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).collect()}
    assert all(got[i] == 0 for i in range(3_000)) and all(got[i] >= 3_000 for i in range(3_000, len(texts)))


def test_op3_against_brute_force(spark):
    import random

    r = random.Random(9)
    base = [[str(r.randint(0, 400)) for _ in range(r.randint(5, 60))] for _ in range(25)]
    texts = []
    for b in base:
        for _ in range(r.randint(1, 9)):
            t = list(b)
            for _ in range(r.randint(0, 2)):
                t[r.randrange(len(t))] = str(r.randint(0, 400))
            texts.append(" ".join(t))
    texts += [" ".join(base[0]) + f" {i}" for i in range(400)]  # a crowd that needs more than one block
    sets = [set(zip(w, w[1:], w[2:])) for w in map(str.split, texts)]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    df = ready(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in op03_jaccard.classes(df).collect()} == {i: top(i) for i in range(len(texts))}


def test_op4(spark, docs, nothing):
    same(spark, lambda s, d: __import__("matchloom.llm.registry", fromlist=["x"]).op4_exact_dedup(s, d), op04_exact.ORACLE)
    found = op04_exact.exact_groups(docs).collect()
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in found if r["doc_id"] != 4}
    assert got[0] == (0, 2, True) and got[1] == (0, 2, False) and got[2] == (2, 1, True) and got[5] == (4, 3, False) and got[6] == (6, 1, True)
    assert sorted(r["kept"] for r in found if r["doc_id"] == 4) == [False, True]
    kept = op04_exact.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, *range(2, 5), *range(6, len(TEXTS))]
    assert op04_exact.exact_groups(nothing).count() == 0 and op04_exact.deduplicate(nothing).count() == 0


def test_op4_keeps_one_of_repeated_rows(spark):
    rows = ready(spark).createDataFrame([(1, "t u"), (1, "t u"), (2, "t  u"), (None, "t u"), (3, None), (None, ""), (None, ""), (4, "a"), (4, "b")], "doc_id long, text string")
    assert sorted(map(tuple, op04_exact.deduplicate(rows).collect()), key=str) == sorted([(1, "t u"), (3, None), (4, "a"), (4, "b")], key=str)
    only = ready(spark).createDataFrame([(None, "same"), (None, "same")], "doc_id long, text string")
    assert op04_exact.deduplicate(only).collect() == [(None, "same")]
    assert sorted(r["kept"] for r in op04_exact.exact_groups(only).collect()) == [False, True]


def test_op4_hashes_only_texts_with_company(spark):
    rows = ready(spark).createDataFrame([(i, f"text {i}" * (i + 1)) for i in range(50)] + [(60, "twin"), (61, "twin")], "doc_id long, text string")
    assert {r["len"] for r in op04_exact.company(rows).collect()} == {4}
    scratch = Scratch(spark)
    assert sorted(r["doc_id"] for r in op04_exact._refined(rows, scratch, "doc_id", "text")[1].collect()) == [60, 61]
    scratch.clear()


def test_op5(spark, docs, nothing):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(len(TEXTS))], "doc_id long, toxic int")
    model = op05_toxicity.learn(docs, labels)
    got = op05_toxicity.score(docs, model).collect()
    assert len(got) == len(TEXTS) + 1 and all(0 <= r["score"] <= 1 for r in got)
    assert op05_toxicity.score(nothing, op05_toxicity.learn(nothing, labels.limit(0))).count() == 0
    many = ready(spark).createDataFrame([(i, f"plain words here {i} " + ("villain " if i % 5 == 0 else "")) for i in range(300)], "doc_id long, text string")
    told = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int")
    scored = {r["doc_id"]: r["score"] >= 0.3 for r in op05_toxicity.score(many, op05_toxicity.learn(many, told)).collect()}
    assert all(scored[i] == (i % 5 == 0) for i in range(200, 300))


def test_op5_counts_a_copied_text_once(spark):
    copied = [f"{w} villain" for w in "an old new bad sad mad big fat odd wet".split()]
    toxic = ["you villain again and again"] * 400 + [f"{c} {i}" for i, c in enumerate(copied)]
    long = " ".join(f"word{chr(97 + i)} harbour" for i in range(25))
    texts = toxic + [long] * 200 + [f"plain talk of things {i}" for i in range(400)]
    toxics = len(toxic) + 200
    many = ready(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told = spark.createDataFrame([(i, int(i < toxics)) for i in range(len(texts))], "doc_id long, toxic int")
    weights = op05_toxicity.learn(many, told)[0]
    assert "villain" in weights and "harbour" not in weights


def test_op6(spark, docs, nothing):
    from tokenizers import Tokenizer

    lib, at = Tokenizer.from_file(vocab.path("byte_bpe_50k.json")), 0
    got = sorted(op06_binary.checksums(op06_binary.write_and_read(docs, vocab.path("byte_bpe_50k.json"), 2)).collect())
    for r in got:
        ids = [*lib.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        at += len(ids)
    assert op06_binary.write_and_read(nothing, vocab.path("byte_bpe_50k.json"), 2).count() == 0


def test_op7(spark, docs, nothing, tmp_path):
    path, cache = vocab.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    one = sorted(op07_counts.count_tokens(docs, path, cache).collect())
    stored = op07_counts.read_cache(spark, cache).count()
    assert stored == len(set(t or "" for t in TEXTS)) and sorted(op07_counts.count_tokens(docs, path, cache).collect()) == one
    assert op07_counts.read_cache(spark, cache).count() == stored and one[0]["n_tokens"] == 0
    assert op07_counts.count_tokens(nothing, path).count() == 0


def test_op8(spark, docs, nothing):
    got = {r["doc_id"]: r for r in op08_maxent.score(docs, F.col("doc_id") % 5 == 1).collect()}
    assert len(got) == len(TEXTS) and got[0]["n_tokens"] == 1 and got[1]["held_out"] and all(r["score"] < 0 and r["base_score"] < 0 for r in got.values())
    assert op08_maxent.score(nothing, F.lit(False)).count() == 0


def test_op9(spark, docs, nothing):
    got = {r["doc_id"]: r for r in op09_pii.find(docs, op09_pii.learn(docs)).collect()}
    assert (got[11]["n_email"], got[11]["n_ip"]) == (1, 1) and got[11]["spans"].startswith("email:5:12,ip:16:24") and got[0]["spans"] == ""
    assert op09_pii.learn(nothing) is None and op09_pii.find(nothing, None).count() == 0


def test_op10(spark, docs, nothing):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(len(TEXTS))], "doc_id long, quality int")
    got = op10_quality.score(docs, op10_quality.learn(docs, labels)).collect()
    assert len(got) == len(TEXTS) + 1 and all(0 <= r["score"] <= 1 for r in got)
    assert op10_quality.score(nothing, op10_quality.learn(nothing, labels.limit(0))).count() == 0


def test_op10_one_long_labelled_text_does_not_hide_the_others(spark):
    good, bad = "This is a clean sentence about things.\nAnother fine line follows it here.\nAnd a third one.", "$$$ ### 00 11 !!!\n|||| 99 %%\n@@ ## 77"
    first = spark.range(1_000, 9_000).orderBy(F.xxhash64("id")).first()["id"]  # the first of all in the order in which labelled rows are taken
    rows = [(i, good if i % 2 else bad) for i in range(60)] + [(first, "\n".join([good] * 170))]
    docs = ready(spark).createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(first, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in op10_quality.score(docs, op10_quality.learn(docs, labels, most_lines=400)).collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i in range(60))
