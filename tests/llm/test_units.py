"""The operators' own functions, without Spark."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from matchloom.llm import op01_bpe, op02_decontaminate, op03_jaccard, op05_toxicity, op06_binary, op08_maxent, op09_pii, op10_quality, tokens, words

vocab = pytest.importorskip("public_tokenizers")
PIECES = ["a", "B", "é", " ", "  ", "\n", "\t", ".", "'s", "1", "23", "\x1c", "日", "本", "\r\n", "😀", "|", "\xa0", "<|endoftext|>", "***", "ɐ", "²"]


def mixed(seed, n, most=14):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_pieces_encode_like_the_whole():
    enc = op01_bpe.load_encoder(vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN)
    for t in mixed(1, 300, 60):
        ids = enc.encode_ordinary(t)
        assert op01_bpe.encode_text(enc, t, 5) == ids and enc.decode_bytes(ids) == t.encode()


def test_fast_tokens_equal_the_library():
    e = tokens.load(vocab.path("byte_bpe_50k.json"))
    for t in mixed(2, 1500):
        assert np.frombuffer(e.ids(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
    assert isinstance(tokens.load(vocab.path("word_bpe_49k.json")), tokens.Whole)
    assert tokens.load(vocab.path("piece_bpe_32k.model")).count("a b") > 0


def test_many_lines_without_spaces_equal_the_library():
    e = tokens.load(vocab.path("byte_bpe_50k.json"))
    for line in ("1234567", "https://a.b/c?d=1", "a,b,c", "日本語の行"):
        for t in ("\n".join([line] * 5_000), "x \n" + "\n".join([line] * 5_000) + "\n\n1\r\n2\n end", "\n\n1\n2\n\n3"):
            assert np.frombuffer(e.ids(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_words_equal_the_patterns():
    for kind, pattern in ((words.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (words.NONSPACE, r"[^\x20\x09-\x0D]+")):
        texts = mixed(3, 400) + ["", None]
        w = words.scan(pa.array(texts, pa.string()), kind)
        for t, a, b in zip(texts, w.first[:-1].tolist(), w.first[1:].tolist()):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
            assert [w.text(i, i + 1).decode() for i in range(a, b)] == re.findall(pattern, low)


def test_value_coding_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        v = r.integers(0, 1 << r.integers(1, 33), n, dtype=np.uint64).astype(np.uint32)
        control, data = op06_binary.encode_values(v)
        assert len(control) == -(-n // 4) and (op06_binary.decode_values(control, data, n) == v).all()


def test_divide_skip_equals_counting():
    r = random.Random(4)
    for _ in range(200):
        lists = [sorted(r.sample(range(30), r.randint(0, 30))) for _ in range(r.randint(1, 12))]
        need = r.randint(1, 8)
        counts = {x: sum(x in y for y in lists) for x in range(30)}
        assert op03_jaccard.divide_skip(lists, need) == {x: n for x, n in counts.items() if n >= need}


def test_parity_never_exceeds_the_difference():
    r = np.random.default_rng(2)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 300, 150).astype(np.uint64)) for _ in range(2))
        bits = sum(int(x).bit_count() for x in (op03_jaccard.parity(a) ^ op03_jaccard.parity(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))


def test_hit_words():
    assert op02_decontaminate.hit_words(6, [(1, 2), (2, 3)]).tolist() == [False, True, True, True, True, False]


def test_folding():
    assert op05_toxicity.fold("Ｉdі0t st4y 1100") == "idiot stay 1100"
    known = op05_toxicity.Lexicon({"idiot": 5.0, "low*": 3.0}, {"no idiot"})
    assert known.raw("an id1ot") > 0 and known.raw("no idiot") == 0 and known.raw("lower") > 0 and known.raw("slow idiots") == 0
    assert op05_toxicity.Lexicon({}).score("") < 0.3


def test_disguises_fold():
    known = op05_toxicity.Lexicon({"idiot": 5.0, "loser": 5.0, "stupid": 5.0, "worthless": 5.0})
    told = ["id10t", "l053r", "1diot", "5tupid", "idi07", "worthle55", "1d10t!!", "𝐢𝐝𝐢𝐨𝐭", "ıdıot", "ídíöt", "id\u200biot", "i\u00addiot", "i\u0336diot", "@idiot", "idiot1", "idiot!!you", "a\n$tup1d b"]
    assert [t for t in told if known.raw(t) <= 0] == []
    assert op05_toxicity.fold("1100 $5 10:07 !") == "1100 $5 10:07 !" and op05_toxicity.fold("がぎ 한국 日本") == "がぎ 한국 日本"
    assert known.raw("1diot idiot") == known.raw("idiot idiot") and known.raw("idiotic 5 1d 10t") == 0
    assert len(op05_toxicity.fold("x" * 200_000 + "1")) == 200_001


def test_bucket_probabilities_sum_to_one():
    n, weights = 1 << 11, 1 << 16
    model = op08_maxent.Model(np.arange(n), weights, np.random.default_rng(1).normal(0, 1, weights + n).astype(np.float32))
    h = (np.arange(n, dtype=np.uint64) << np.uint64(53)) + np.uint64(1)
    context = np.repeat(np.stack([h[3:4], h[5:6]], 1), n, 0)
    seq = np.concatenate([context, h[:, None]], 1).ravel()
    p = model.log10(seq, np.arange(0, len(seq) + 1, 3))[2::3]
    assert abs((10**p).sum() - 1) < 1e-3
    plain = op08_maxent.Model(np.arange(n), weights).log10(h, np.arange(n + 1))  # without weights: the shares of the counts
    assert np.allclose(10**plain, (np.arange(n) + 1) / (np.arange(n) + 1).sum(), rtol=1e-3)


def test_every_level_uses_every_feature():
    h = np.arange(1, 9, dtype=np.uint64) << np.uint64(55)
    first = np.array([0, len(h)])
    model = op08_maxent.Model(np.ones(1 << 11), 1 << 20)
    node, _ = model.path(op08_maxent.bucket(h, model.depth))
    one = model.slots(op08_maxent.features(h, first), node)[1]
    skipped = h.copy()
    skipped[3] += np.uint64(7)  # two words before the sixth: its skip and pair features change, at all levels
    two = model.slots(op08_maxent.features(skipped, first), node)[1]
    assert one.shape == (3, 11, 8) and (one[0, :, 5] == two[0, :, 5]).all() and (one[1:, :, 5] != two[1:, :, 5]).all()


def test_model_grows_with_the_corpus():
    small, large = op08_maxent.shape(10**7, 10**6), op08_maxent.shape(5 * 10**7, 5 * 10**6)
    assert small[0] < large[0] <= op08_maxent.MOST_DEPTH and small[1] < large[1] <= op08_maxent.MOST_WEIGHTS


def test_steps_raise_the_likelihood():
    r = np.random.default_rng(2)
    h = words.mix(r.integers(0, 50, 4_000).astype(np.uint64) // np.uint64(3))
    h[1::2] = words.mix(h[::2])  # every second word follows from the first
    first, prior = np.array([0, len(h)]), np.bincount(op08_maxent.bucket(h, 11), minlength=1 << 11)
    model = op08_maxent.Model(prior, 1 << 16)
    before = model.log10(h, first).mean()
    gains = np.ones(1 << 12, np.float32), np.ones(1 << 11, np.float32)
    for _ in range(20):
        model.descend(op08_maxent.features(h, first), op08_maxent.bucket(h, 11), gains)
    assert model.log10(h, first).mean() > before + 0.2


def test_neighbours_equal_columns_side_by_side():
    r = np.random.default_rng(0)
    first, x = np.array([0, 3, 3, 8, 9]), r.normal(size=(9, op10_quality.N_LINE)).astype(np.float32)
    doc, full = np.repeat(np.arange(4), np.diff(first)), []
    for i in range(9):
        before, after = i > 0 and doc[i - 1] == doc[i], i < 8 and doc[i + 1 if i < 8 else i] == doc[i]
        full.append(np.concatenate([x[i], x[i - 1] * before, x[(i + 1) % 9] * after, [before, after, 1]]))
    c, w, v = op10_quality.Context(first, x), r.normal(size=3 * op10_quality.N_LINE + 3), r.normal(size=9)
    assert np.allclose(np.array(full) @ w, c.scores(w), atol=1e-4) and np.allclose(np.array(full).T @ v, c.sums(v), atol=1e-4)


def test_crf_marginals_equal_enumeration():
    import itertools

    emit, pair = np.array([0.3, -1.0, 2.0, 0.5]), np.array([[0.2, -0.5], [0.1, 0.9]])
    weight = {s: np.exp(sum(emit[i] * x for i, x in enumerate(s)) + sum(pair[a, b] for a, b in zip(s, s[1:]))) for s in itertools.product((0, 1), repeat=4)}
    total = sum(weight.values())
    good, joint = op10_quality.marginals(np.array([0, 0, 4]), emit, pair)
    assert np.allclose(good, [sum(w for s, w in weight.items() if s[i]) / total for i in range(4)])
    assert np.isclose(joint[1, 1], sum(w * sum(a and b for a, b in zip(s, s[1:])) for s, w in weight.items()) / total)


def test_tagger_gradient():
    t = op09_pii.Tagger(hidden=3)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    r = np.random.default_rng(1)
    ids, tags = r.integers(0, 9, (2, 6)), r.integers(0, 5, (2, 6))

    def loss():
        emit = t.emissions(ids)[0].astype(float)
        path = emit[np.arange(2)[:, None], np.arange(6), tags].sum(1) + t.p["pair"][tags[:, :-1], tags[:, 1:]].sum(1)
        return float((t.marginals(emit)[2] - path).mean())

    g = t.gradient(ids, tags)
    for k in t.p:
        at = np.unravel_index(int(np.abs(g[k]).argmax()), g[k].shape)
        kept, e = t.p[k][at], 1e-3
        t.p[k][at] = kept + e
        up = loss()
        t.p[k][at] = kept - e
        assert abs((up - loss()) / (2 * e) - g[k][at]) < 2e-3
        t.p[k][at] = kept


def test_best_path_equals_enumeration():
    import itertools

    t = op09_pii.Tagger(hidden=3)
    r = np.random.default_rng(4)
    t.p["pair"] = r.normal(0, 1, t.p["pair"].shape)
    emit = r.normal(0, 1, (2, 4, t.TAGS))
    path, sure = t.decode(emit.copy(), np.array([4, 3]))
    total = lambda e, p: sum(e[i, x] for i, x in enumerate(p)) + sum(t.p["pair"][a, b] for a, b in zip(p, p[1:]))
    best = max(itertools.product(range(t.TAGS), repeat=4), key=lambda p: total(emit[0], p))
    assert path[0].tolist() == list(best) and path[1, 3] == 0 and (sure > 0).all()


def test_windows_cover_a_text():
    for n in (0, 1, 31, 384, 385, 5_000):
        at = op09_pii.windows_of(n)
        covered = sorted({x for a in at for x in range(a, min(n, a + op09_pii.WINDOW))})
        assert covered == list(range(n)) and all(b - a == op09_pii.WINDOW - op09_pii.SHARED for a, b in zip(at, at[1:]))


def test_tagger_adds_what_patterns_miss():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(2, 9)))
    number = lambda: "+1 555 " + "".join(r.choice("0123456789") for _ in range(7))
    found = []
    for i in range(240):
        left = " ".join(word() for _ in range(4)) + " "
        if i % 2:
            found.append((left + " ".join(word() for _ in range(8)), []))
        else:
            inner = number() if i % 4 else f"{word()}@{word()}.org"
            found.append((left + inner + " " + word(), [(len(left), 3 if i % 4 else 0, len(left) + len(inner))]))
    tagger = op09_pii.fit(found, 250)
    text = "x" * 20 + " " + " ".join(word() for _ in range(120)) + " write anna (at) leto.org or so " + " ".join(word() for _ in range(120))
    base = [op09_pii.base_spans(text)]
    added = op09_pii.added_spans([text], base, tagger)[0]
    assert base == [[]] and any(k == 0 and "anna" in text[a:e] for a, k, e in added) and len(added) <= 3
    assert op09_pii.added_spans(["", "plain words"], [[], []], tagger) == [[], []]


def test_base_spans():
    found = op09_pii.base_spans("x@y.co 1.2.3.4 300.1.1.1, 4242 4242 4242 4242; +1 (555) 555-5136 4242424242424241")
    assert op09_pii.written(found) == "email:0:6,ip:7:14,card:26:45"
    assert op09_pii.base_spans("") == []


def test_hits_in_a_text_without_white_space_take_linear_time():
    import time

    lexicon = op05_toxicity.Lexicon({"idiot": 2.0, "idi*": 1.0}, {"no idiot"})
    text = "idiot," * 160_000
    began = time.monotonic()
    assert lexicon.raw(text) > 0 and time.monotonic() - began < 20
    assert op05_toxicity.word_before("x " + "a" * 256 + " idiot", 259) == "a" * 256 and op05_toxicity.word_before("a" * 257 + " idiot", 258) is None and op05_toxicity.word_before("idiot", 0) == ""
    assert lexicon.raw("no idiot") < lexicon.raw("an idiot")


def test_mail_search_takes_linear_time_and_finds_what_the_pattern_finds():
    import re
    import time

    began = time.monotonic()
    assert list(op09_pii.emails("a" * 1_000_000 + "@")) == [] and list(op09_pii.emails("@a." * 300_000)) == [] and time.monotonic() - began < 20
    pattern, r = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), random.Random(7)
    for _ in range(5_000):
        text = "".join(r.choice("ab.@-_ ü%") for _ in range(r.randint(0, 30)))
        assert list(op09_pii.emails(text)) == [m.span() for m in pattern.finditer(text)]


def test_a_labelled_text_that_does_not_fit_is_passed_over():
    assert op10_quality.fitting([5, 500, 7, 395, 2, 386], 400) == [0, 2, 4, 5]
    assert op10_quality.fitting([2_000_001, 3], 2_000_000) == [1] and op10_quality.fitting([], 5) == []
