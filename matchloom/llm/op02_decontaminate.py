"""Operator 2: benchmark decontamination.

Words are runs of digits, a-z and non-ASCII characters after A-Z is lower-cased. A window is `n`
consecutive words of a benchmark item, or all words of a shorter one. A document's windows are looked
up in a hash set of the items' windows; each hit is verified on the words themselves, and every word
inside an occurrence counts as hit.

The set is broadcast only if the benchmark's texts are within BROADCAST_BYTES, which is measured
first; a larger benchmark is joined by window hash instead, with the same result. Null texts have no
words; items without words never occur; equal items all count. Repeated rows each get their row.
Empty tables give empty results (no benchmark: nothing is contaminated). Extra columns stay where
rows are passed on and are otherwise ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm import words
from matchloom.llm.common import no_clash

#: UTF-8 bytes of benchmark text up to which its windows are broadcast.
BROADCAST_BYTES = 16 << 20

_SLOTS = 20


def item_windows(column: pa.Array, n: int) -> list[tuple[int, int, int, bytes]]:
    """(item's place, length, hash, words) of each window of the texts."""
    w = words.scan(column, words.ALNUM)
    out = []
    for item, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
        size = min(n, b - a)
        if size:
            hashes = words.windows(w.hash[a:b], size).tolist()
            out += [(item, size, h, w.text(a + k, a + k + size)) for k, h in enumerate(hashes)]
    return out


class WindowSet:
    """Windows of a benchmark: by length, a bit table, sorted hashes, and what has each hash."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.by: dict[int, dict[int, dict[bytes, list[str]]]] = {}
        for item, size, h, text in item_windows(pa.array([t for _, t in items], pa.string()), n):
            names = self.by.setdefault(size, {}).setdefault(h, {}).setdefault(text, [])
            if items[item][0] not in names:
                names.append(items[item][0])
        self.tables = {}
        for size, found in self.by.items():
            hashes = np.array(sorted(found), np.uint64)
            bits = np.zeros(1 << _SLOTS, bool)
            bits[hashes >> np.uint64(64 - _SLOTS)] = True
            self.tables[size] = hashes, bits

    def search(self, w: words.Words):
        """(first word, length, item ids) of each verified occurrence."""
        for size, (hashes, bits) in self.tables.items():
            got = words.windows(w.hash, size)
            if not len(got):
                continue
            maybe = np.flatnonzero(bits[got >> np.uint64(64 - _SLOTS)] & (w.doc[: len(got)] == w.doc[size - 1 :]))
            maybe = maybe[np.isin(got[maybe], hashes)]
            for i, h in zip(maybe.tolist(), got[maybe].tolist()):
                if names := self.by[size][h].get(w.text(i, i + size)):
                    yield i, size, names


def hit_words(n_words: int, found) -> np.ndarray:
    """Which words lie in an occurrence; found: (first word, length)."""
    edge = np.zeros(n_words + 1, np.int64)
    for i, size in found:
        edge[i] += 1
        edge[i + size] -= 1
    return np.cumsum(edge)[:-1] > 0


def _report(column: pa.Array, known: WindowSet):
    """For each text: words, hit words, item ids, (start, end) bytes of each run of hit words."""
    w = words.scan(column, words.ALNUM)
    occurrences = list(known.search(w))
    hit = hit_words(len(w.hash), [(i, size) for i, size, _ in occurrences])
    items: dict[int, set[str]] = {}
    for i, _, names in occurrences:
        items.setdefault(int(w.doc[i]), set()).update(names)
    _, at = words.column_bytes(column)
    for d, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
        spans = []
        if d in items:
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
            spans = [(int(w.start[a + x] - at[d]), int(w.end[a + y - 1] - at[d])) for x, y in zip(edges[::2].tolist(), edges[1::2].tolist())]
        yield b - a, int(hit[a:b].sum()), sorted(items.get(d, ())), spans


def _names(prefix: str) -> list[str]:
    return [prefix + n for n in ("n_words", "n_hit", "items", "spans")]


def _found(prefix: str) -> str:
    kinds = ("long", "long", "array<string>", "array<struct<start:long,end:long>>")
    return ", ".join(f"`{n}` {k}" for n, k in zip(_names(prefix), kinds))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _columns(rows) -> list[pa.Array]:
    rows = list(rows)
    return [
        pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.string())),
        pa.array([[{"start": a, "end": b} for a, b in r[3]] for r in rows], _SPANS),
    ]


def small_enough(benchmark: DataFrame, text: str, limit: int) -> bool:
    return (benchmark.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0) <= limit


def find(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES, prefix: str = "") -> DataFrame:
    """The columns of `keep`, n_words, n_hit, items (sorted item ids as strings), spans (bytes of each run of hit words); `prefix` goes before these names."""
    no_clash(keep, *_names(prefix))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    if not small_enough(items, "t", broadcast_bytes):
        return _find_by_join(docs, items, n, text, keep, ddl, prefix)
    known = docs.sparkSession.sparkContext.broadcast([(r["item"], r["t"]) for r in items.collect()])
    made: dict = {}

    def run(batches):
        if "set" not in made:
            made["set"] = WindowSet(known.value, n)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *_columns(_report(b.column(b.num_columns - 1), made["set"]))], names=[*keep, *_names(prefix)])

    return docs.select(*keep, F.col(text)).mapInArrow(run, f"{ddl}, {_found(prefix)}")


def _find_by_join(docs: DataFrame, items: DataFrame, n: int, text: str, keep: tuple[str, ...], ddl: str, prefix: str) -> DataFrame:
    """For a benchmark that is too large to broadcast: windows meet by hash in a shuffled join.

    Only occurrences go back to their document, whose key is its text's digest, so equal texts share them.
    """

    def of_items(batches):
        for b in batches:
            found = item_windows(b.column(1), n)
            names = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i, *_ in found], pa.string()), pa.array([s for _, s, *_ in found], pa.int32()), pa.array([x[3] for x in found], pa.binary())], names=["item", "size", "words"])

    wanted = items.mapInArrow(of_items, "item string, size int, words binary")
    sizes = sorted(r["size"] for r in wanted.select("size").distinct().collect())  # n of them at most

    def of_docs(batches):
        for b in batches:
            w = words.scan(b.column(1), words.ALNUM)
            keys = b.column(0)
            for size in sizes:
                got = np.flatnonzero(w.doc[: max(0, len(w.doc) - size + 1)] == w.doc[size - 1 :])
                for at in np.array_split(got, max(1, len(got) // 20_000)):
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(w.doc[at])), pa.array(at - w.first[w.doc[at]]), pa.array(np.full(len(at), size, np.int32)), pa.array([w.text(i, i + size) for i in at.tolist()], pa.binary())],
                        names=["key", "at", "size", "words"],
                    )

    key = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    seen = docs.select(key.alias("key"), F.col(text)).mapInArrow(of_docs, "key binary, at long, size int, words binary")
    found = seen.join(wanted, ["size", "words"]).groupBy("key", "at", "size").agg(F.collect_set("item").alias("names"))
    found = found.groupBy("key").agg(F.collect_list(F.struct("at", "size", "names")).alias("found"))
    both = docs.select(*keep, key.alias("__key"), F.col(text).alias("__text")).join(found.select(F.col("key").alias("__found_key"), F.col("found").alias("__found")), F.col("__key") == F.col("__found_key"), "left").select(*keep, "__found", "__text")

    class Given:
        def __init__(self, occurrences):
            self.occurrences = occurrences

        def search(self, w):
            return [(int(w.first[d]) + x["at"], x["size"], x["names"]) for d, xs in enumerate(self.occurrences) for x in xs or ()]

    def run(batches):
        for b in batches:
            told = Given(b.column(b.num_columns - 2).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *_columns(_report(b.column(b.num_columns - 1), told))], names=[*keep, *_names(prefix)])

    return both.mapInArrow(run, f"{ddl}, {_found(prefix)}")


def _cut(place: int):
    """Rows with their spans behind them -> rows with these cut out of the text in column `place`."""

    def run(batches):
        for b in batches:
            texts = []
            for t, spans in zip(b.column(place).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                raw, at, out = (t or "").encode(), 0, []
                for s in spans:
                    out.append(raw[at : s["start"]])
                    at = s["end"]
                texts.append(None if t is None else b"".join([*out, raw[at:]]).decode())
            columns = b.columns[:-1]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    return run


def _free(docs: DataFrame) -> str:
    """A prefix that no column of docs has."""
    prefix = "__found_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return prefix


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, that no window occurs in."""
    keep, prefix = tuple(docs.columns), _free(docs)
    return find(docs, benchmark, keep=keep, prefix=prefix, **options).where(F.col(f"{prefix}n_hit") == 0).select(*keep)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs with the hit words cut out of their texts."""
    keep, prefix = tuple(docs.columns), _free(docs)
    found = find(docs, benchmark, text=text, keep=keep, prefix=prefix, **options).select(*keep, f"{prefix}spans")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return found.mapInArrow(_cut(keep.index(text)), ddl)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS size, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win
       FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS win
       FROM (SELECT doc_id, ws, size, unnest(generate_series(1, len(ws) - size + 1)) AS i FROM w, sizes WHERE len(ws) >= size)),
occ AS (SELECT d.doc_id, d.i, d.size, iw.item_id FROM dw d JOIN iw ON iw.size = d.size AND iw.win = d.win),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM occ) GROUP BY doc_id),
names AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM occ GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits h USING (doc_id) LEFT JOIN names n USING (doc_id)
"""
