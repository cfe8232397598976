"""Chunking, encoding and dense scoring."""

from __future__ import annotations

import zlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of demand vectors that are broadcast at a time; more are taken in slices.
SLICE_BYTES = 32 << 20
#: Scores that a task holds at once: so many demand rows times the rows of a batch.
CELLS = 2_000_000


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Counts of words by hash, of unit length: deterministic and without a model file."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                out[i, zlib.crc32(w.encode()) % self.size] += 1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)


def chunks(text: Column, size: int = 180, overlap: int = 30, most: int = 16) -> Column:
    """Overlapping chunks of words; a short text is one chunk, an empty one none."""
    if not 0 <= overlap < size or most < 1:
        raise ValueError("need 0 <= overlap < size and at least one chunk")
    step = size - overlap
    w = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")
    n = F.least(F.when(F.size(w) <= size, 1).otherwise(F.ceil((F.size(w) - size) / step).cast("int") + 1), F.lit(most))
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, i * step + 1, size), " ")))


def encode(df: DataFrame, key: str, text: str, encoder: Encoder, **chunking) -> DataFrame:
    """key, vector: unit mean of the chunks' vectors; an empty text gives a zero vector."""
    cut = df.select(key, chunks(F.col(text), **chunking).alias("chunks"))

    def run(frames):
        for f in frames:
            out = []
            for parts in f["chunks"]:
                if len(parts):
                    v = np.asarray(encoder.encode(list(parts)), float).mean(0)
                    n = np.linalg.norm(v)
                    out.append((v / n if n else v).tolist())
                else:
                    out.append(np.zeros_like(np.asarray(encoder.encode(["x"]))[0]).tolist())
            yield pd.DataFrame({key: f[key], "vector": out})

    return cut.mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, vector array<double>")


def block_top_k(demand: DataFrame, supply: DataFrame, fields: dict[str, tuple[int, int, float]], k: int, demand_id: str = "demand_id", supply_id: str = "supply_id", vector: str = "vector") -> DataFrame:
    """Field-weighted cosine of each demand with all supply rows: the k best of each, with field scores.

    fields: name -> (first, end, weight) of its part of the vector. The demand side is a stated query
    set; it is taken in slices of SLICE_BYTES, in dense blocks of CELLS against every batch of supply rows,
    and only k rows a demand and batch are shuffled. Scores are clipped to [0, 1]; equal ones to nine
    places go by id.
    """
    size = demand.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    slices = max(1, -(-((size["n"] or 0) * (size["d"] or 0) * 8) // SLICE_BYTES))
    names = list(fields)
    ddl = f"{demand_id} long, {supply_id} long, score double, " + ", ".join(f"{n} double" for n in names)

    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n == 0, 1, n)

    found = None
    for s in range(slices):
        part = demand.where(F.pmod(F.xxhash64(demand_id), F.lit(slices)) == s).select(demand_id, vector).toPandas()
        ids = part[demand_id].to_numpy()
        dense = np.stack(part[vector].map(np.asarray).to_list()).astype(float) if len(part) else np.zeros((0, size["d"] or 0))
        sent = supply.sparkSession.sparkContext.broadcast((ids, {n: unit(dense[:, a:b]) for n, (a, b, _) in fields.items()}))

        def run(frames, sent=sent):
            ids, blocks = sent.value
            for f in frames:
                if not len(f) or not len(ids):
                    continue
                rows = np.stack(f[vector].map(np.asarray).to_list()).astype(float)
                units = {n: unit(rows[:, a:b]).T for n, (a, b, _) in fields.items()}
                supply_ids = f[supply_id].to_numpy()
                step = max(1, CELLS // len(f))
                for first in range(0, len(ids), step):
                    some = ids[first : first + step]
                    each = {n: np.clip(blocks[n][first : first + step] @ units[n], 0, 1) for n in names}
                    total = sum(w * each[n] for n, (_, _, w) in fields.items())
                    rounded = np.round(total, 9)
                    least = np.partition(rounded, -k, axis=1)[:, -k, None] if k < rounded.shape[1] else np.full((len(some), 1), -np.inf)
                    row, at = np.nonzero(rounded >= least)  # the k best of each row, and who is equal to the last of them
                    order = np.lexsort((supply_ids[at], -rounded[row, at], row))
                    row, at = row[order], at[order]
                    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                    row, at = row[kept], at[kept]
                    yield pd.DataFrame({demand_id: some[row], supply_id: supply_ids[at], "score": total[row, at], **{n: each[n][row, at] for n in names}})

        one = supply.select(supply_id, vector).mapInPandas(run, ddl)
        found = one if found is None else found.unionByName(one)
    w = Window.partitionBy(demand_id).orderBy(F.desc(F.round("score", 9)), supply_id)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def strongest_field(contributions: dict[str, Column]) -> Column:
    """Name of the largest contribution; the first on a tie."""
    best = F.greatest(*contributions.values())
    out = None
    for n, c in reversed(contributions.items()):
        out = F.when(c == best, n) if out is None else F.when(c == best, n).otherwise(out)
    return out
