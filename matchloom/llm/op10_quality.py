"""Operator 10: document quality by a linear-chain conditional random field over lines.

Every line that isn't blank is good or bad. A line's features (shares of kinds of characters, word
lengths, repeats of words and lines, how it begins and ends) and its neighbours' make its potentials;
two more weights couple the states of lines that follow each other. Forward-backward gives each
line's marginal; their mean, weighted by length, and the share of the worst tenth give a document's
quality through a logistic curve.

Only documents are labelled, so lines start with their document's label; lines of bad documents that
look like those of good ones are then called good, but never a bad document's worst line. It is
learned from whole texts of labelled rows: at most LABELLED of them, in the order of a hash of their
id, and only as many as have LINES lines in all; a text that doesn't fit any more is passed over. Texts that are null, empty or blank get the share of
good labels. Texts of any length are scored whole. Repeated rows score alike; without labels of both
kinds every text gets that share, or a half. An empty table gives an empty result; extra columns are
dropped unless named in `keep`, and one named like the result is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm import words
from matchloom.llm.common import no_clash
from matchloom.session import Scratch

#: Labelled documents that are learned from at most, and their lines in all (68 bytes each on the driver).
LABELLED, LINES = 8_000, 2_000_000
THRESHOLD = 0.3

#: Kinds of bytes: 0 lower-case or non-ASCII, 1 upper-case, 2 digit, 3 white space, 4 sentence sign, 5 bar, 6 hash, star and the like, 7 other.
_KIND = np.array([
    3 if b == 32 or 9 <= b <= 13 else 2 if 48 <= b <= 57 else 1 if 65 <= b <= 90 else 0 if 97 <= b <= 122 or b >= 128
    else 4 if chr(b) in ".,;:!?'\"()-" else 5 if b == 124 else 6 if chr(b) in "#$%&*~^=_+" else 7 for b in range(256)
], np.uint8)
N_LINE = 17


def lines(column: pa.Array):
    """(first line of each text, and the end; length of each line in bytes; features of each line)."""
    w = words.scan(column, words.NONSPACE)
    data, at = words.column_bytes(column)
    if not len(w.hash):
        return np.zeros(len(column) + 1, np.int64), np.zeros(0), np.zeros((0, N_LINE), np.float32)
    edge = np.union1d(at[:-1], np.flatnonzero(data == 10) + 1)
    edge = edge[edge < len(data)]
    of_word = np.searchsorted(edge, w.start, "right") - 1
    used, first_word, n_words = np.unique(of_word, return_index=True, return_counts=True)
    # a line is from its first word to the end of its last
    start, end = w.start[first_word], w.end[first_word + n_words - 1]
    size = end - start
    flat = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    kinds = np.bincount(np.repeat(np.arange(len(used)) * 8, size) + _KIND[data[flat]], minlength=8 * len(used)).reshape(-1, 8).astype(np.float64)
    share = kinds / size[:, None]
    length = (w.end - w.start).astype(np.float64)
    mean_word = np.add.reduceat(length, first_word) / n_words
    short = np.add.reduceat((length <= 3).astype(np.float64), first_word) / n_words
    again = np.zeros(len(w.hash))
    again[1:] = w.hash[1:] == w.hash[:-1]
    again[first_word] = 0
    repeats = np.add.reduceat(again, first_word) / n_words
    whole = words.mix(np.add.reduceat(w.hash, first_word))
    doc = w.doc[first_word]
    twin = np.zeros(len(used))
    order = np.lexsort((whole, doc))
    same = (whole[order][1:] == whole[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twin[order[1:][same]] = 1
    twin[order[:-1][same]] = 1
    head, tail = _KIND[data[start]], _KIND[data[end - 1]]
    tail_sign = np.add.reduceat((_KIND[data[w.end - 1]] == 6).astype(np.float64), first_word) / n_words
    lone_sign = np.add.reduceat(((length == 1) & (_KIND[data[w.start]] >= 4)).astype(np.float64), first_word) / n_words
    x = np.stack([
        share[:, 0], share[:, 1], share[:, 2], share[:, 4], share[:, 5] * 5, share[:, 6] * 3, share[:, 7] * 3,
        np.log1p(size) / 8, np.log1p(n_words) / 6, np.minimum(mean_word, 30) / 10, short, repeats, twin, (head == 1) * 1.0, (tail == 4) * 1.0, tail_sign, lone_sign,
    ], 1).astype(np.float32)
    first = np.searchsorted(doc, np.arange(len(column) + 1))
    return first, size.astype(np.float64), x


class Context:
    """Lines' features with those of the lines before and after, whether there are such lines, and a constant; never laid out side by side."""

    def __init__(self, first: np.ndarray, x: np.ndarray):
        self.x, some = x, np.diff(first) > 0
        self.begins, self.stops = first[:-1][some], first[1:][some] - 1
        self.width = 3 * x.shape[1] + 3

    def _moved(self, v: np.ndarray, by: int) -> np.ndarray:
        """Each line's value from the line before (1) or after (-1), 0 where there is none."""
        out = np.zeros_like(v)
        if len(v):
            out[max(by, 0) : len(v) + min(by, 0)] = v[max(-by, 0) : len(v) - max(by, 0)]
            out[self.begins if by > 0 else self.stops] = 0
        return out

    def scores(self, w: np.ndarray) -> np.ndarray:
        k = self.x.shape[1]
        own, before, after = (self.x @ w[i * k : (i + 1) * k].astype(np.float32) for i in range(3))
        out = own.astype(np.float64) + self._moved(before, 1) + self._moved(after, -1) + w[3 * k :].sum()
        out[self.begins] -= w[3 * k]
        out[self.stops] -= w[3 * k + 1]
        return out

    def sums(self, r: np.ndarray) -> np.ndarray:
        """Sum of each feature, weighted by r."""
        parts = [v.astype(np.float32) @ self.x for v in (r, self._moved(r, -1), self._moved(r, 1))]
        # what a line takes from the one before it, that one gives to the one after
        total = r.sum()
        return np.concatenate([*parts, [total - r[self.begins].sum(), total - r[self.stops].sum(), total]]).astype(np.float64)


def marginals(first: np.ndarray, emit: np.ndarray, pair: np.ndarray):
    """P(good) of each line, and the expected number of pairs in each pair of states.

    emit: score of good against bad; pair: 2 x 2 scores of states that follow each other (bad, good).
    All chains go one step at a time together, long ones on their own at the end.
    """
    n, lens = len(emit), np.diff(first)
    order = np.argsort(-lens, kind="stable")
    lens, begin = lens[order], first[:-1][order]
    live = int((lens > 0).sum())
    lens, begin = lens[:live], begin[:live]
    t = np.exp(pair - pair.max())
    e = np.stack([np.ones(n), np.exp(np.clip(emit, -30, 30))], 1)
    e /= e.sum(1, keepdims=True)
    a, b = np.zeros((n, 2)), np.ones((n, 2))
    longest = int(lens[0]) if live else 0
    alive = np.searchsorted(-lens, -np.arange(longest), "left")  # chains longer than k
    for k in range(longest):
        at = begin[: alive[k]] + k
        now = e[at] if k == 0 else (a[at - 1] @ t) * e[at]
        a[at] = now / now.sum(1, keepdims=True)
    for k in range(longest - 2, -1, -1):
        at = begin[: alive[k + 1]] + k
        now = (b[at + 1] * e[at + 1]) @ t.T
        b[at] = now / now.sum(1, keepdims=True)
    good = a * b
    good = good[:, 1] / np.maximum(good.sum(1), 1e-300)
    inner = np.ones(n, bool)
    inner[begin] = False
    at = np.flatnonzero(inner)
    joint = a[at - 1][:, :, None] * t[None] * (b[at] * e[at])[:, None, :]
    joint /= np.maximum(joint.sum((1, 2), keepdims=True), 1e-300)
    return good, joint.sum(0)


def _adam(grad, w, steps, rate):
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def summary(first: np.ndarray, size: np.ndarray, good: np.ndarray) -> np.ndarray:
    """A text's quality: length-weighted mean of its marginals, and of the worst tenth of its length; nan without lines."""
    out = np.full((len(first) - 1, 2), np.nan)
    n = np.diff(first)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    begins = first[:-1][some]
    total = np.add.reduceat(size, begins)
    out[some, 0] = np.add.reduceat(size * good, begins) / total
    doc = np.repeat(np.arange(len(some)), n[some])
    order = np.lexsort((good, doc))
    s, g = size[order], good[order]
    upto = np.cumsum(s)
    room = np.clip(0.1 * total[doc] - (upto - s - np.repeat(upto[begins] - s[begins], n[some])), 0, s)
    out[some, 1] = np.add.reduceat(room * g, begins) / (0.1 * total)
    return out


def fit(first: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray):
    """Weights from documents' labels: (emission, pair, curve, share of good labels)."""
    base = float(y.mean()) if len(y) else 0.5
    if not len(x) or y.min() == y.max():
        return np.zeros(3 * N_LINE + 3), np.zeros((2, 2)), np.zeros(3), base
    full = Context(first, x)
    doc = np.repeat(np.arange(len(y)), np.diff(first))
    # every document counts alike, and both labels do
    weight = 1 / np.diff(first)[doc] * np.where(y[doc] == 1, 0.5 / base, 0.5 / (1 - base)) * len(x) / len(y)
    target = y[doc].astype(np.float64)
    w = np.zeros(full.width)
    for turn in range(3):
        def grad(w):
            p = 1 / (1 + np.exp(-np.clip(full.scores(w), -30, 30)))
            return full.sums((p - target) * weight) / len(x) + 1e-4 * w

        w = _adam(grad, w, 150, 0.1)
        if turn < 2:  # lines of bad documents that look good become good
            p = full.scores(w)
            usual = np.quantile(p[y[doc] == 1], 0.3)
            worst = np.zeros(len(y)) + np.inf
            np.minimum.at(worst, doc, p)
            target = np.where((y[doc] == 1) | ((p > usual) & (p > worst[doc])), 1.0, 0.0)
    pairs = np.zeros((2, 2))
    inner = np.ones(len(x), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    at = np.flatnonzero(inner)
    np.add.at(pairs, (target[at - 1].astype(int), target[at].astype(int)), 1)

    def chain(v):
        good, expected = marginals(first, full.scores(v[:-4]), v[-4:].reshape(2, 2))
        return np.concatenate([full.sums(good - target), (expected - pairs).reshape(-1)]) / len(x) + 1e-4 * v

    v = _adam(chain, np.concatenate([w, np.zeros(4)]), 60, 0.03)
    emission, pair = v[:-4], v[-4:].reshape(2, 2)
    s = summary(first, size, marginals(first, full.scores(emission), pair)[0])
    keep = ~np.isnan(s[:, 0])
    z = np.concatenate([s[keep], np.ones((keep.sum(), 1))], 1)

    def curve(c):
        p = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        return z.T @ (p - y[keep]) / len(z) + 1e-3 * c * [1, 1, 0]

    return emission, pair, _adam(curve, np.zeros(3), 600, 0.1), base


def quality(column: pa.Array, model) -> np.ndarray:
    emission, pair, curve, base = model
    first, size, x = lines(column)
    good, _ = marginals(first, Context(first, x).scores(emission), pair)
    s = summary(first, size, good)
    p = 1 / (1 + np.exp(-np.clip(s @ curve[:2] + curve[2], -30, 30)))
    return np.where(np.isnan(p), base, p)


def _featured(batches):
    for b in batches:
        first, size, x = lines(b.column(0))
        rows = [(size[a:e].astype("<f4").tobytes(), x[a:e].astype("<f4").tobytes()) for a, e in zip(first[:-1].tolist(), first[1:].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array(np.diff(first)), *b.columns[1:]], names=["size", "x", "n", "y", "place"])


def fitting(sizes: list[int], most: int) -> list[int]:
    """Places of those that fit into `most` one after the other; what doesn't fit is passed over."""
    out, held = [], 0
    for i, n in enumerate(sizes):
        if held + n <= most:
            held += n
            out.append(i)
    return out


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", limit: int = LABELLED, most_lines: int = LINES):
    """The model, from the rows of labels (ids and 0 or 1); a row without a label or id doesn't count, nor does an id's second label."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.min(F.col(label).cast("int")).alias("__y"))
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("__id"), "__id").limit(limit))  # 12 bytes a row
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(chosen, F.col("id") == F.col("__id")).select("t", F.col("__y").alias("y"), F.xxhash64("__id").alias("place"))
    scratch = Scratch(docs.sparkSession)
    told = scratch.keep(rows.mapInArrow(_featured, "size binary, x binary, n long, y int, place long"), "labelled-lines")
    order = ("place", "n", "y")
    sizes = told.select(*order).orderBy(*order).limit(limit).collect()  # LABELLED rows of three numbers
    fits = told.sparkSession.createDataFrame([sizes[i] for i in fitting([r["n"] for r in sizes], most_lines)], "place long, n long, y int")
    got = told.join(F.broadcast(fits.distinct()), list(order), "left_semi").orderBy(*order).select("size", "x", "y", "n").collect()
    got = [got[i] for i in fitting([r["n"] for r in got], most_lines)][:limit]  # repeated rows share their numbers
    scratch.clear()
    size = [np.frombuffer(r["size"], "<f4").astype(np.float64) for r in got]
    x = [np.frombuffer(r["x"], "<f4").reshape(-1, N_LINE) for r in got]
    first = np.concatenate([[0], np.cumsum([len(s) for s in size])]).astype(np.int64)
    y = np.array([r["y"] for r in got], np.int64)
    return fit(first, np.concatenate(size) if size else np.zeros(0), np.concatenate(x) if x else np.zeros((0, N_LINE), np.float32), y)


def score(docs: DataFrame, model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, and score: the probability that the text is good."""
    no_clash(keep, "score", "__score")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(quality(b.column(b.num_columns - 1), model), pa.float64())], names=[*keep, "__score"])

    return docs.select(*keep, F.col(text)).mapInArrow(run, f"{ddl}, __score double").withColumnRenamed("__score", "score")
