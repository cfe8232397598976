"""Operator 1: byte-level BPE encoding and decoding with a local rank file.

Null texts count as empty and give no ids. Texts of any length are cut at safe boundaries (a
non-space character followed by white space: no match of a pre-split pattern of this family goes
across, and what follows doesn't depend on what came before), so the library sees pieces of bounded
size; a piece without such a boundary stays whole. Repeated rows are encoded each on its own; an empty table gives an
empty result; extra columns are dropped unless named in `keep`, and one named like a result is an error. Decoding goes through raw bytes, so ids that
cut a character apart decode as they should.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import no_clash

#: Characters after which a long text is cut at the next safe boundary.
PIECE_CHARS = 16_384

_BOUNDARY = re.compile(r"\S(?=[ \n])")
_ENCODERS: dict = {}


def load_encoder(rank_file: str, pattern: str):
    """The library's encoder for a rank file; kept for the life of the worker."""
    key = (rank_file, pattern)
    if key not in _ENCODERS:
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _ENCODERS[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """text in pieces that encode independently."""
    out, start = [], 0
    while len(text) - start > size:
        cut = _BOUNDARY.search(text, start + size)
        if cut is None:
            break
        out.append(text[start : cut.end()])
        start = cut.end()
    out.append(text[start:])
    return out


def encode_text(encoder, text: str, size: int = PIECE_CHARS) -> list[int]:
    if len(text) <= size:
        return encoder.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text, size):
        ids += encoder.encode_ordinary(piece)
    return ids


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, and ids array<int>."""
    no_clash(keep, "ids")
    schema = docs.select(*keep).schema

    def run(batches):
        enc = load_encoder(rank_file, pattern)
        for b in batches:
            ids = pa.array([encode_text(enc, t or "") for t in b.column(b.num_columns - 1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids], names=[*keep, "ids"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.select(*keep, F.col(text)).mapInArrow(run, f"{ddl}, ids array<int>")


def decode(encoded: DataFrame, rank_file: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, and bytes binary: the raw bytes of the ids (null ids: none)."""
    no_clash(keep, "bytes")

    def run(batches):
        enc = load_encoder(rank_file, pattern)
        for b in batches:
            raw = pa.array([enc.decode_bytes(x) if x else b"" for x in b.column(b.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], raw], names=[*keep, "bytes"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema)
    return encoded.select(*keep, ids).mapInArrow(run, f"{ddl}, bytes binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, n_tokens, ids_sha256 and decoded_sha256 in one pass: ids needn't leave the worker."""
    no_clash(keep, "n_tokens", "ids_sha256", "decoded_sha256")

    def run(batches):
        enc = load_encoder(rank_file, pattern)
        for b in batches:
            counts, digests, decoded = [], [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                ids = encode_text(enc, t or "")
                counts.append(len(ids))
                digests.append(hashlib.sha256(str(ids)[1:-1].replace(",", "").encode()).hexdigest())
                decoded.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            cols = [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col(text)).mapInArrow(run, f"{ddl}, n_tokens long, ids_sha256 string, decoded_sha256 string")
