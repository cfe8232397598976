"""Operator 8: language-model scores by a hashed maximum-entropy model.

Tokens are words (runs of what isn't ASCII white space, A-Z folded) and one end a document. A word's
hash names its bucket; the softmax over buckets is factored into levels of classes, each level a
softmax over the two classes that a class divides into, with hashed features: the word before, the one
before that as a skip, both together, and a constant of the class. Within its bucket a word has its smoothed
share of the training counts, unseen words one share together as in the base. Probabilities of all
known words and one unknown word a bucket sum to 1.

The model grows with the corpus: a level for each doubling of the vocabulary (WORDS words a bucket)
and weights in proportion to the training tokens (one for TOKENS of them), up to MOST_WEIGHTS, which bounds what is broadcast.

Counts are exact and cover all training documents: each unit of scanned documents sends its distinct
words with their counts, packed, to the range that their hash is in, and gets them back with the
corpus's counts, so a frequent word costs one entry a unit. Weights are trained in ROUNDS rounds over
disjoint shares of all training documents; each task takes gradient steps from the last weights and a
weight's changes are averaged over the tasks that moved it. A task reads several times what it sends.
Scoring is in sparse numpy batches.

Null and empty texts have one token, the end. A text of any length is scored whole. Repeated rows all
count and all score. Without training documents every count is 0 and the base is that of an empty
corpus. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm import words
from matchloom.session import Scratch, release

#: Levels at least and at most, distinct training words a bucket, training tokens a weight, weights at least and at most.
LEAST_DEPTH, MOST_DEPTH, WORDS, TOKENS, LEAST_WEIGHTS, MOST_WEIGHTS = 11, 20, 2048, 8, 1 << 22, 1 << 23
ROUNDS, BATCH, RATE, STEP = 2, 1_024, 0.1, 4
#: A batch is small, so that what it reads is still near when it is written.
#: Training tasks of a round at least; bytes of text that a task reads for a byte that it sends.
TASKS, READ_FOR_SENT = 6, 8
#: Tokens after which a unit of documents is closed; weights in a piece on their way to the sum.
UNIT_TOKENS, PIECE = 4_000_000, 1 << 14

_END = np.uint64(0x5851F42D4C957F2D)
#: Buckets of the finest level.
_FINE = 1 << MOST_DEPTH


def tokens(column: pa.Array):
    """(hash of every token, first token of each text and the end)."""
    w = words.scan(column, words.NONSPACE)
    n = np.diff(w.first) + 1
    first = np.concatenate([[0], np.cumsum(n)])
    h = np.empty(first[-1], np.uint64)
    at = np.ones(first[-1], bool)
    at[first[1:] - 1] = False
    h[at] = w.hash
    h[~at] = _END
    return h, first


def bucket(h: np.ndarray, depth: int = MOST_DEPTH) -> np.ndarray:
    return (h >> np.uint64(64 - depth)).astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    """Bytes of whole numbers, compressed behind their number of bytes a value and their count."""
    x = np.ascontiguousarray(x)
    return np.array([x.itemsize, len(x)], "<i8").tobytes() + (pa.compress(x.tobytes(), "zstd", asbytes=True) if len(x) else b"")


def _unpack(raw) -> np.ndarray:
    view = memoryview(raw)
    size, n = np.frombuffer(view[:16], "<i8").tolist()
    return np.frombuffer(pa.decompress(view[16:], size * n, "zstd", asbytes=True) if n else b"", f"<u{size}")


def _counts_type(x: np.ndarray):
    return "<u4" if not len(x) or x.max() < 1 << 32 else "<u8"


def features(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of each token's features besides the constant: word before, word before that, both."""
    n = len(h)
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    one[1:] = h[:-1]
    two[2:] = h[:-2]
    begins = first[:-1]
    one[begins] = 0
    two[begins] = 0
    later = begins + 1
    two[later[later < first[1:]]] = 0
    k = np.uint64(0x9FB21C651E98DF25)
    found = np.stack([one * k + np.uint64(2), two * k + np.uint64(3), (one * k ^ two) * k + np.uint64(4)])
    return (words.mix(found) >> np.uint64(32)).astype(np.uint32)


def shape(tokens: int, vocabulary: int) -> tuple[int, int]:
    """(levels, weights) for a corpus of so many training tokens and distinct training words."""
    log2 = lambda x: int(np.ceil(np.log2(max(1, x))))
    return int(np.clip(log2(vocabulary / WORDS), LEAST_DEPTH, MOST_DEPTH)), 1 << int(np.clip(log2(tokens / TOKENS), LEAST_WEIGHTS.bit_length() - 1, MOST_WEIGHTS.bit_length() - 1))


class Model:
    """Hashed weights, then a constant for each class; their sum is added to the log odds of the class's halves.

    A feature's weights for the classes of STEP levels lie together in a block of 2**STEP, which keeps
    the memory that a token touches small, and share their rate of learning.
    """

    def __init__(self, prior: np.ndarray, weights: int, flat: np.ndarray | None = None):
        self.depth = len(prior).bit_length() - 1
        flat = np.zeros(weights + len(prior), np.float32) if flat is None else flat
        self.table, self.constant = flat[:weights], flat[weights:]
        tree = np.concatenate([np.zeros(len(prior)), prior + 1.0])
        for level in range(self.depth - 1, -1, -1):
            tree[1 << level : 2 << level] = tree[2 << level : 4 << level].reshape(-1, 2).sum(1)
        odds = np.zeros(len(prior))
        odds[1:] = np.log(tree[2:].reshape(-1, 2)[:, 1]) - np.log(tree[2:].reshape(-1, 2)[:, 0])
        self.odds = odds.astype(np.float32)
        self.names = (words.mix(np.arange(len(prior), dtype=np.uint64) + np.uint64(99)) >> np.uint64(32)).astype(np.uint32)
        self.blocks = weights >> STEP
        self.shift = np.uint32(32 - (self.blocks.bit_length() - 1))
        self.level = np.arange(self.depth)[:, None]
        self.heads = np.arange(0, self.depth, STEP)
        self.held = np.diff(np.append(self.heads, self.depth))  # levels of each block
        self.within = self.level % STEP

    def path(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class at each level of each bucket, and which half of it the bucket is in."""
        return (1 << self.level) + (b >> (self.depth - self.level)), (b >> (self.depth - 1 - self.level)) & 1

    def slots(self, feats: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each feature's block for each STEP levels, and its weight at each level."""
        block = (((feats[:, None, :] ^ self.names[node[self.heads]]) * np.uint32(0x9E3779B1)) >> self.shift).astype(np.intp)
        place = (1 << self.within) + (node & ((1 << self.within) - 1))
        return block, (np.repeat(block, self.held, 1) << STEP) + place

    def log_odds(self, node: np.ndarray, at: np.ndarray) -> np.ndarray:
        got = self.table[at]
        return self.odds[node] + self.constant[node] + got[0] + got[1] + got[2]

    def log10(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 P of each token's bucket."""
        feats, b = features(h, first), bucket(h, self.depth)
        out = np.empty(len(h))
        for k in range(0, len(h), BATCH):
            node, half = self.path(b[k : k + BATCH])
            z = self.log_odds(node, self.slots(feats[:, k : k + BATCH], node)[1])
            np.negative(z, out=z, where=half == 1)
            out[k : k + BATCH] = -np.log1p(np.exp(np.minimum(z, 80))).sum(0, dtype=np.float64) / np.log(10)
        return out

    def descend(self, feats: np.ndarray, b: np.ndarray, gains: tuple[np.ndarray, np.ndarray]) -> None:
        """One step on a batch, each block and each constant with its own falling rate."""
        node, half = self.path(b)
        block, at = self.slots(feats, node)
        wrong = (1 / (1 + np.exp(-self.log_odds(node, at))) - half).astype(np.float32)
        square = wrong * wrong
        each = np.add.reduceat(square, self.heads, 0) / np.float32(STEP)
        np.add.at(gains[0], block.reshape(-1), np.broadcast_to(each, block.shape).reshape(-1))
        rate = np.float32(RATE) / np.sqrt(gains[0][block])
        np.subtract.at(self.table, at.reshape(-1), (np.repeat(rate, self.held, 1) * wrong).reshape(-1))
        # constants are few: the same sums, a class at a time
        more, drift = (np.bincount(node.reshape(-1), x.reshape(-1), len(self.constant)).astype(np.float32) for x in (square, wrong))
        gains[1][:] += more
        self.constant -= np.float32(RATE) * drift / np.sqrt(gains[1])


_PIECES = pa.schema([("piece", pa.int32()), ("scale", pa.float64()), ("sum", pa.binary()), ("moved", pa.binary())])


def _train(prior, weights, sent):
    def run(batches):
        flat = sent.value.copy()
        model = Model(prior, weights, flat)
        gains = np.ones(model.blocks, np.float32), np.ones(len(prior), np.float32)
        for b in batches:
            h, first = tokens(b.column(0))
            feats, names = features(h, first), bucket(h, model.depth)
            for k in range(0, len(h), BATCH):
                model.descend(feats[:, k : k + BATCH], names[k : k + BATCH], gains)
        for k in range(0, len(flat), PIECE):
            part = flat[k : k + PIECE] - sent.value[k : k + PIECE]
            scale = float(np.abs(part).max()) / 127  # changes go as bytes
            if scale:
                yield pa.RecordBatch.from_arrays([pa.array([k // PIECE], pa.int32()), pa.array([scale]), pa.array([np.rint(part / scale).astype(np.int8).tobytes()], pa.binary()), pa.nulls(1, pa.binary())], schema=_PIECES)

    return run


def _sum_pieces(key, table):
    """Changes of a piece, and how many tasks moved each weight of it."""
    total, moved = np.zeros(PIECE, np.float32), np.zeros(PIECE, np.uint32)
    for scale, x, n in zip(table.column("scale").to_pylist(), table.column("sum"), table.column("moved")):
        part = np.frombuffer(x.as_buffer(), np.int8 if n.as_py() is None else "<f4")
        total[: len(part)] += part * np.float32(scale)
        moved[: len(part)] += part != 0 if n.as_py() is None else np.frombuffer(n.as_buffer(), "<u4")[: len(part)]
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "scale": pa.array([1.0]), "sum": pa.array([total.astype("<f4").tobytes()], pa.binary()), "moved": pa.array([moved.astype("<u4").tobytes()], pa.binary())})


def train(rows: DataFrame, prior: np.ndarray, weights: int, size: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after all rounds. rows: share (0 to rounds - 1) and text of the training documents, of `size` bytes."""
    context = rows.sparkSession.sparkContext
    flat = np.zeros(weights + len(prior), np.float32)
    ddl = "piece int, scale double, sum binary, moved binary"
    tasks = max(TASKS, size // (rounds * READ_FOR_SENT * weights))
    for r in range(rounds):
        sent = context.broadcast(flat)
        pieces = rows.where(F.col("share") == r).select("t").coalesce(tasks).mapInArrow(_train(prior, weights, sent), ddl)
        halfway = pieces.withColumn("salt", F.expr("spark_partition_id() div 16")).groupBy("piece", "salt").applyInArrow(_sum_pieces, ddl)
        flat = flat.copy()
        for row in halfway.groupBy("piece").applyInArrow(_sum_pieces, ddl).toLocalIterator():  # as many as the weights have pieces
            at = slice(row["piece"] * PIECE, min(len(flat), (row["piece"] + 1) * PIECE))
            total, moved = np.frombuffer(row["sum"], "<f4"), np.frombuffer(row["moved"], "<u4")
            flat[at] += (total / np.maximum(moved, 1))[: at.stop - at.start]
        sent.unpersist()
        release(rows.sparkSession)
    return flat


# ---- counts --------------------------------------------------------------------------------------

_STAGED = "unit long, range int, idx binary, hash binary, n binary, docs array<long>, held array<boolean>, lens array<long>, ids binary"
_STAGED_ARROW = pa.schema([
    ("unit", pa.int64()), ("range", pa.int32()), ("idx", pa.binary()), ("hash", pa.binary()), ("n", pa.binary()),
    ("docs", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lens", pa.list_(pa.int64())), ("ids", pa.binary()),
])


def _row(**given) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([given.get(f.name)], f.type) for f in _STAGED_ARROW], schema=_STAGED_ARROW)


def _stage(ranges: int):
    """doc_id, held out, text -> rows of documents with their words' places in the unit's vocabulary, rows of that vocabulary."""

    def run(batches):
        unit, held_tokens, pending = TaskContext.get().partitionId() << 20, 0, []

        def close():
            h = np.concatenate([p[0] for p in pending])
            train = np.concatenate([np.repeat(~p[2], np.diff(p[1])) for p in pending])
            vocab, ids = np.unique(h, return_inverse=True)
            n = np.bincount(ids, weights=train, minlength=len(vocab)).astype(np.int64)
            order = np.argsort(-n, kind="stable")  # frequent words get small places
            place = np.empty(len(vocab), np.int64)
            place[order] = np.arange(len(vocab))
            ids, at = place[ids].astype("<u4"), 0
            where = (bucket(vocab) * ranges) // _FINE
            edges = np.searchsorted(where, np.arange(ranges + 1))
            for r in range(ranges):
                a, b = edges[r], edges[r + 1]
                if b > a:
                    yield _row(unit=unit, range=r, idx=_pack(place[a:b].astype("<u4")), hash=vocab[a:b].astype("<u8").tobytes(), n=_pack(n[a:b].astype(_counts_type(n))))
            for p in pending:
                lens = np.diff(p[1])
                yield _row(unit=unit, docs=p[3], held=p[2].tolist(), lens=lens.tolist(), ids=_pack(ids[at : at + len(p[0])]))
                at += len(p[0])

        for b in batches:
            h, first = tokens(b.column(2))
            if len(first) > 1:
                pending.append((h, first, b.column(1).to_numpy(zero_copy_only=False).astype(bool), b.column(0).to_pylist()))
                held_tokens += len(h)
            if held_tokens >= UNIT_TOKENS:
                yield from close()
                unit, held_tokens, pending = unit + 1, 0, []
        if pending:
            yield from close()

    return run


_COUNTED = "unit long, range int, idx binary, hash binary, n binary, known binary, tokens binary"


def _bounds(r: int, ranges: int) -> tuple[int, int]:
    """The finest buckets of a range."""
    return -(-r * _FINE // ranges), -(-(r + 1) * _FINE // ranges)


def _count(ranges: int):
    def run(key, table):
        """One range of hashes: the corpus's count of each unit's words and, once, known words and tokens of each of its finest buckets."""
        hashes = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("hash")]
        n = np.concatenate([_unpack(x.as_buffer()) for x in table.column("n")]).astype(np.int64)
        vocab, at = np.unique(np.concatenate(hashes), return_inverse=True)
        c = np.bincount(at, weights=n, minlength=len(vocab)).astype(np.int64)
        low, high = _bounds(key[0].as_py(), ranges)
        each = [np.bincount(bucket(vocab) - low, weights=w, minlength=high - low).astype("<u8") for w in (c > 0, c)]
        counts = [_pack(x.astype(_counts_type(c))) for x in np.split(c[at], np.cumsum([len(h) for h in hashes])[:-1])]
        known, tokens_ = ([_pack(x)] + [None] * (len(hashes) - 1) for x in each)
        return pa.table({
            "unit": table.column("unit"), "range": table.column("range"), "idx": table.column("idx"), "hash": table.column("hash"), "n": pa.array(counts, pa.binary()),
            "known": pa.array(known, pa.binary()), "tokens": pa.array(tokens_, pa.binary()),
        })

    return run


def _score(prior, known_in, weights, sent):
    total, vocabulary = int(prior.sum()), int(known_in.sum())

    def run(key, docs, known):
        size = sum(len(x.as_buffer()) // 8 for x in known.column("hash"))
        h, c = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        for i, x, n in zip(*(known.column(k) for k in ("idx", "hash", "n"))):
            at = _unpack(i.as_buffer())
            h[at], c[at] = np.frombuffer(x.as_buffer(), "<u8"), _unpack(n.as_buffer())
        model = Model(prior, weights, sent.value)
        within = np.log10((c + 0.5) / (prior + 0.5 * (known_in + 1.0))[bucket(h, model.depth)])  # a word's share of its bucket
        base = np.log10((c + 0.5) / (total + 0.5 * (vocabulary + 1)))
        out = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        for d, held, lens, raw in zip(*(docs.column(k) for k in ("docs", "held", "lens", "ids"))):
            ids = _unpack(raw.as_buffer())
            n = np.array(lens.as_py(), np.int64)
            first = np.concatenate([[0], np.cumsum(n)])
            got = model.log10(h[ids], first) + within[ids]
            out["doc_id"] += d.as_py()
            out["held_out"] += held.as_py()
            out["n_tokens"].append(n)
            out["n_known"].append(np.add.reduceat((c[ids] > 0).astype(np.int64), first[:-1]))
            out["base_score"].append(np.add.reduceat(base[ids], first[:-1]))
            out["score"].append(np.add.reduceat(got, first[:-1]))
        join = lambda k, t: pa.array(np.concatenate(out[k]) if out[k] else np.zeros(0), t)
        return pa.table({
            "doc_id": pa.array(out["doc_id"], pa.int64()), "held_out": pa.array(out["held_out"], pa.bool_()), "n_tokens": join("n_tokens", pa.int64()), "n_known": join("n_known", pa.int64()),
            "train_tokens": pa.array([total] * len(out["doc_id"]), pa.int64()), "base_score": join("base_score", pa.float64()), "score": join("score", pa.float64()),
        })

    return run


def score(docs: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; held_out: a boolean column."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    ranges = int(np.clip(size // (24 << 20), 4, 1 << 16))
    asked = docs.select(F.col(doc_id).cast("long").alias("d"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    result = Scratch(spark)
    staged = result.keep(asked.mapInArrow(_stage(ranges), _STAGED), "units")
    vocab = staged.where("range is not null").select("unit", "range", "idx", "hash", "n")
    counted = result.keep(vocab.groupBy("range").applyInArrow(_count(ranges), _COUNTED), "counts")
    prior, known_in = np.zeros(_FINE, np.int64), np.zeros(_FINE, np.int64)
    for row in counted.where("known is not null").select("range", "known", "tokens").toLocalIterator():  # a slice of the finest buckets a range
        at = slice(*_bounds(row["range"], ranges))
        known_in[at], prior[at] = _unpack(row["known"]), _unpack(row["tokens"])
    depth, weights = shape(int(prior.sum()), int(known_in.sum()))
    prior, known_in = (x.reshape(1 << depth, -1).sum(1) for x in (prior, known_in))
    release(spark)
    share = F.pmod(F.xxhash64("d", F.octet_length("t")), F.lit(ROUNDS))
    sent = spark.sparkContext.broadcast(train(asked.where("not held").select(share.alias("share"), "t"), prior, weights, size))
    pages = staged.where("docs is not null").select("unit", "docs", "held", "lens", "ids").groupBy("unit")
    run = _score(prior, known_in, weights, sent)
    return pages.cogroup(counted.select("unit", "idx", "hash", "n").groupBy("unit")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
