"""Operator 5: toxicity by a weighted lexicon.

Texts are folded first: lower case, compatibility forms (full width, mathematical letters) to plain
ones, accents and invisible characters away, look-alike letters of other scripts to Latin, and digits
and signs in a word that has a letter to the letters they stand for. As a digit or sign at a word's edge
may also be just that, a second reading folds only single ones between two letters; hits in either
count, once. An Aho-Corasick automaton finds the lexicon's words and word beginnings; hits inside a learned exception phrase (a hit
with the word before it) don't count. The weights' sum, each word's repeats damped, is divided by a
slowly growing function of the text's length and becomes a probability.

Lexicon, exceptions and the two numbers of the last step are learned from labelled rows, at most
LABELLED of them (those with the smallest hash of their id), copies of a text counting once; these
rows bound the lexicon, which has as many entries as they speak for.
Texts that are null, empty or without letters score as a text without hits. Repeated rows score
alike. With no labelled rows of either kind nothing is learned and every text gets the same score.
An empty table gives an empty result; extra columns are kept only where rows are passed on.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import no_clash
from matchloom.session import Scratch

#: Labelled rows that are learned from at most.
LABELLED = 20_000
#: Lengths of the word beginnings that can become entries.
STEMS = (4, 5, 6)
THRESHOLD = 0.3
#: Share of an entry's texts that must be toxic.
PURE = 0.9

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕԁһӏкмтвнαορτυνικıłøđħŧɑɡɩʟɴʀʏ",
    "aeopcyxijsdhlkmtbhaoptuvikilodhtagilnry",
)
#: Digits and signs that stand for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

#: Combining accents, and characters that are not seen: format characters, fillers and variation selectors.
_UNSEEN = re.compile("[\u0300-\u036f\u00ad\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb\U0001d173-\U0001d17a\U000e0000-\U000e0fff]")
#: A run of letters, digits and signs with at least one sign; only its beginnings are tried.
_TOKEN = re.compile(r"(?<![^\W_])(?<![@$!])[^\W_]*[0134578@$!](?:[^\W_]|[@$!])*")
_LETTER = re.compile(r"[^\W\d_]")
_MEANT = str.maketrans(SIGNS)
_SIGN = re.compile(r"(?<=[^\W\d_])[0134578@$!](?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")


#: Characters of a word before a hit that can be part of an exception: what stands after a longer one (a text without white space) has none.
LONGEST = 256


def _plain(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text))
        text = unicodedata.normalize("NFKC", text).lower().translate(LOOKALIKES)
    return text


def _meant(token: re.Match) -> str:
    word = token[0].rstrip("!")  # marks of a sentence's end stay
    return word.translate(_MEANT) + token[0][len(word) :] if _LETTER.search(word) else token[0]


def fold(text: str) -> str:
    """The reading with all signs folded that stand in a word with a letter."""
    return _TOKEN.sub(_meant, _plain(text))


def readings(text: str) -> list[str]:
    """The folded text and, where it differs, the one with only single signs between letters folded; both have the same length."""
    text = _plain(text)
    full, inner = _TOKEN.sub(_meant, text), _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return [full] if full == inner else [full, inner]


def patterns(folded: str) -> set[str]:
    """Words, and beginnings of longer words with a `*` behind."""
    found = set(_WORD.findall(folded))
    return found | {w[:n] + "*" for w in found for n in STEMS if len(w) > n}


def word_before(text: str, at: int) -> str | None:
    """What stands between the white space before `at` and the white space before that; None if it is longer than LONGEST."""
    end = at
    while end and text[end - 1].isspace():
        end -= 1
    start, least = end, max(0, end - LONGEST)
    while start > least and not text[start - 1].isspace():
        start -= 1
    return None if start and not text[start - 1].isspace() else text[start:end]


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: set[str] = frozenset(), slope: float = 1.0, offset: float = -3.0):
        import ahocorasick

        self.weights, self.exceptions, self.slope, self.offset = weights, exceptions, slope, offset
        self.machine = ahocorasick.Automaton()
        by: dict[str, list[str]] = {}
        for p in weights:
            by.setdefault(p.rstrip("*"), []).append(p)
        for word, names in by.items():
            self.machine.add_word(word, (len(word), names))
        if by:
            self.machine.make_automaton()

    def hits(self, folded: str):
        """(place, pattern, the phrase it ends) of each hit at a word's beginning; no phrase after a word that is too long for one."""
        if not self.weights:
            return
        for end, (size, names) in self.machine.iter(folded):
            start = end - size + 1
            if start and folded[start - 1].isalpha():
                continue
            whole = end + 1 == len(folded) or not folded[end + 1].isalpha()
            before = word_before(folded, start)
            for name in names:
                if whole or name[-1] == "*":
                    yield start, name, None if before is None else f"{before} {name}"

    def found(self, read: list[str]):
        """Hits in every reading of a text."""
        for folded in read:
            yield from self.hits(folded)

    def raw(self, text: str) -> float:
        read = readings(text)
        best: dict[int, str] = {}
        for start, name, phrase in self.found(read):
            if phrase not in self.exceptions and (start not in best or self.weights[name] > self.weights[best[start]]):
                best[start] = name
        if not best:
            return 0.0
        total = sum(self.weights[name] * (1 + math.log(n)) for name, n in Counter(best.values()).items())
        return total / (1 + 0.15 * math.log2(1 + len(read[0]) / 300))

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.slope * self.raw(text) + self.offset))))


def weigh(counts: list[tuple[str, int, int]], positive: int, negative: int, tried: int) -> dict[str, float]:
    """Log odds of the patterns that labelled rows speak for beyond chance, given how many patterns were tried."""
    if not positive or not negative:
        return {}
    base = positive / (positive + negative)
    out = {}
    for name, p, n in counts:
        if p < PURE * (p + n):
            continue
        gain = p * math.log(p / ((p + n) * base)) + (n * math.log(n / ((p + n) * (1 - base))) if n else 0)
        if gain > math.log(max(tried, 1)) + 1:
            out[name] = math.log((p + 0.5) / (n + 0.5)) - math.log(positive / negative)
    return out


def _count(batches):
    found: dict[str, list[int]] = {}
    for b in batches:
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for p in set().union(*map(patterns, readings(t or ""))):
                found.setdefault(p, [0, 0])[1 - y] += 1
    names = list(found)
    for at in range(0, len(names), 100_000):
        part = names[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([found[x][0] for x in part], pa.int64()), pa.array([found[x][1] for x in part], pa.int64())], names=["name", "pos", "neg"])


def _phrases(known: Lexicon):
    def run(batches):
        for b in batches:
            rows = []
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += [(phrase, y, 1 - y) for phrase in {x[2] for x in known.found(readings(t or "")) if x[2] is not None}]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["phrase", "pos", "neg"])

    return run


def _raws(weights: dict, exceptions: set):
    made: list[Lexicon] = []

    def run(batches):
        if not made:
            made.append(Lexicon(weights, exceptions))
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([made[0].raw(t or "") for t in b.column(0).to_pylist()], pa.float64()), b.column(1)], names=["raw", "y"])

    return run


def calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method with a light penalty."""
    if not len(y) or y.min() == y.max():
        return 1.0, -3.0
    x, w = np.stack([raw, np.ones_like(raw)], 1), np.array([0.5, -2.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (p - y) + 0.05 * (w - [0.5, -2.0]))
        w = w - np.clip(step, -2, 2)
    return float(max(w[0], 0.05)), float(min(w[1], -1.0))


def distinct(rows: DataFrame) -> DataFrame:
    """One of the rows (t, y) whose texts are equal but for case and white space; a text with both labels stays once with each."""
    same = F.sha2(F.trim(F.regexp_replace(F.lower(F.coalesce("t", F.lit(""))), r"[\x20\x09-\x0D]+", " ")), 256)
    return rows.groupBy(same.alias("same"), "y").agg(F.min("t").alias("t")).select("t", "y")


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = LABELLED):
    """weights, exceptions, slope and offset, from the rows of labels (ids and 0 or 1)."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__y")).dropDuplicates(["__id"])
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("__id"), "__id").limit(limit))  # 12 bytes a row
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(chosen, F.col("id") == F.col("__id")).select("t", F.col("__y").alias("y"))
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(distinct(rows), "labelled")  # read five times
    n = rows.groupBy("y").count().collect()
    size = {r["y"]: r["count"] for r in n}
    counts = rows.mapInArrow(_count, "name string, pos long, neg long").groupBy("name").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos + neg >= 3")
    tried = counts.agg(F.count("*").alias("n")).first()
    best = counts.where(f"pos >= 3 and pos >= {PURE} * (pos + neg)")  # few, as the labelled rows are
    weights = weigh([(r["name"], r["pos"], r["neg"]) for r in best.collect()], size.get(1, 0), size.get(0, 0), tried["n"])
    exceptions: set[str] = set()
    if weights:
        phrases = rows.mapInArrow(_phrases(Lexicon(weights)), "phrase string, pos long, neg long").groupBy("phrase").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        exceptions = {r["phrase"] for r in phrases.where("pos = 0 and neg >= 3").collect()}
    seen = rows.mapInArrow(_raws(weights, exceptions), "raw double, y int").groupBy(F.round("raw", 2).alias("raw"), "y").count().collect()
    raw = np.repeat([r["raw"] for r in seen], [r["count"] for r in seen]).astype(float)
    y = np.repeat([r["y"] for r in seen], [r["count"] for r in seen]).astype(float)
    scratch.clear()
    return (weights, exceptions, *calibrate(raw, y))


def score(docs: DataFrame, model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, and score."""
    no_clash(keep, "score", "__score")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    made: list[Lexicon] = []

    def run(batches):
        if not made:
            made.append(Lexicon(*model))
        for b in batches:
            found = pa.array([made[0].score(t or "") for t in b.column(b.num_columns - 1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], names=[*keep, "__score"])

    return docs.select(*keep, F.col(text)).mapInArrow(run, f"{ddl}, __score double").withColumnRenamed("__score", "score")


def fold_of(doc_id, modulus: int):
    """The fold that a row is in, from its id alone."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(modulus))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score under the threshold."""
    at = docs.columns.index("text")
    model = learn(docs, labels.where(fold_of("doc_id", 4) != 2))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    made: list[Lexicon] = []

    def run(batches):
        if not made:
            made.append(Lexicon(*model))
        for b in batches:
            yield b.filter(pa.array([made[0].score(t or "") < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, ddl)
