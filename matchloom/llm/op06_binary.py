"""Operator 6: token ids in a compact binary format.

Ids are replaced by their rank in order of falling frequency over the whole corpus (ties by id), so
common ones are small, and written byte-aligned: one to four data bytes a value, whose number, less
one, stands in two bits of a separate stream of control bytes, four values to a byte, low bits
first. Reading looks a control byte up in a table of four lengths and gathers the data bytes with
numpy. The files are blocks in ascending doc_id order (by `part`, then `block`); Spark's writers put
them in the store, so no task needs a file system of its own.

Texts are encoded where they are read; ids, packed to two bytes where the vocabulary allows, are what
is put in order, and their frequencies are counted in the same pass.

Null texts count as empty; a document always has its end id. Null doc_ids come first; rows with the
same doc_id are ordered by their ids. An empty table gives empty files. A document longer than a block is
a block of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm import tokens
from matchloom.session import Scratch, release, scratch

#: Ids after which a block is closed.
BLOCK_IDS = 1 << 20
#: Bytes of ids in a column of a batch, whose offsets have 32 bits.
MOST_BYTES = 1 << 30

_ENCODED = "d long, n long, ids binary, counts binary"
_CODED = "part int, block int, first long, doc_ids array<long>, lens array<long>, n long, control binary, data binary"

#: Lengths of the four values of each control byte.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    more = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = more
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    most = int(more.max(initial=0)) + 1
    width = 4 if most == 3 else most
    raw = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    data = raw[np.arange(width, dtype=np.uint8) <= more[:, None]]
    return control.tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    lens = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lens, dtype=np.int64)
    starts = ends - lens
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = raw[starts].astype(np.uint32)
    for k in (1, 2, 3):
        at = np.flatnonzero(lens > k)
        out[at] |= raw[starts[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _within(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows that hold `most` bytes at most, or are one row."""
    out, at, held = [], 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > at and held + size > most:
            out.append((at, k))
            at, held = k, 0
        held += size
    return [*out, (at, len(sizes))] if len(sizes) else out


def _encode(path: str, end_id: int):
    """d, text -> d, number of ids, packed ids; then the task's counts of ids."""

    def run(batches):
        encoder, end, total = tokens.load(path), np.uint32(end_id).tobytes(), np.zeros(0, np.int64)
        for b in batches:
            found = [encoder.ids(t or "") + end for t in b.column(1).to_pylist()]
            n = np.array([len(x) // 4 for x in found], np.int64)
            flat = np.frombuffer(b"".join(found), "<u4")
            if len(flat):
                counts = np.bincount(flat)
                if len(counts) > len(total):
                    total, counts = counts, total
                total[: len(counts)] += counts
            width = 2 if not len(flat) or flat.max() < 1 << 16 else 4
            for at, to in _within(width * n, MOST_BYTES):
                ends = np.cumsum(n[:to])
                ends = np.concatenate([[0], ends])[at:]
                raw = flat[ends[0] : ends[-1]].astype(f"<u{width}")
                packed = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer((width * (ends - ends[0])).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([b.column(0)[at:to], pa.array(n[at:to]), packed, pa.nulls(to - at, pa.binary())], names=["d", "n", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["d", "n", "ids", "counts"])

    return run


def _histogram(batches):
    total = np.zeros(0, np.int64)
    for b in batches:
        for counts in b.column(0):
            found = np.frombuffer(counts.as_buffer(), "<i8")
            if len(found) > len(total):
                total, found = found.copy(), total
            total[: len(found)] += found
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])


def _blocks(rank: np.ndarray):
    """Documents in order -> blocks of coded ranks."""

    def run(batches):
        part, block, first, held, ids, lens, docs = TaskContext.get().partitionId(), 0, 0, 0, [], [], []

        def closed():
            control, data = encode_values(rank[np.concatenate(ids)])
            values = [part, block, first, docs, lens, held, control, data]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _CODED_TYPES.values())], names=list(_CODED_TYPES))

        for b in batches:
            for d, n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if docs and held + n > BLOCK_IDS:
                    yield closed()
                    block, first, held, ids, lens, docs = block + 1, first + held, 0, [], [], []
                buffer = raw.as_buffer()
                ids.append(np.frombuffer(buffer, f"<u{len(buffer) // n}"))
                lens.append(n)
                docs.append(d)
                held += n
        if docs:
            yield closed()

    return run


_CODED_TYPES = {
    "part": pa.int32(), "block": pa.int32(), "first": pa.int64(), "doc_ids": pa.list_(pa.int64()), "lens": pa.list_(pa.int64()), "n": pa.int64(), "control": pa.binary(), "data": pa.binary(),
}


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> list[int]:
    """Writes the files under path; returns the ids in order of rank (as many as the vocabulary has)."""
    scratch = Scratch(docs.sparkSession)
    asked = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    encoded = scratch.keep(asked.mapInArrow(_encode(tokenizer, end_id), _ENCODED), "token-ids")
    counted = encoded.where("counts is not null").select("counts").mapInArrow(_histogram, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    by_rank = [r["id"] for r in counted.orderBy(F.desc("n"), "id").collect()]
    rank = np.zeros(max(by_rank, default=0) + 1, np.uint32)
    rank[np.array(by_rank, np.int64)] = np.arange(len(by_rank), dtype=np.uint32)
    ordered = encoded.where("ids is not null").select("d", "n", "ids").repartitionByRange("d").sortWithinPartitions("d", "ids")
    ordered.mapInArrow(_blocks(rank), _CODED).write.parquet(path)
    scratch.clear()
    release(docs.sparkSession)
    return by_rank


def read(spark, path: str, by_rank: list[int]) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) of each document in the files."""
    coded = spark.read.schema(_CODED).parquet(path)
    sizes = {r["part"]: r["n"] for r in coded.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row a written part
    base, at = {}, 0
    for part in sorted(sizes):
        base[part], at = at, at + sizes[part]
    back = np.array(by_rank, np.uint32)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ids = back[decode_values(row["control"], row["data"], row["n"])] if row["n"] else back[:0]
                lens = np.array(row["lens"], np.int64)
                ends = np.cumsum(lens)
                raw = [ids[e - k : e].tobytes() for e, k in zip(ends.tolist(), row["lens"])]
                cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(base[row["part"]] + row["first"] + ends - lens, pa.int64()), pa.array(lens), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids"])

    return coded.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def checksums(read_back: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what `read` gives."""
    return read_back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    path = path or scratch(docs.sparkSession, "token-files")
    return read(docs.sparkSession, path, write(docs, tokenizer, path, end_id))
