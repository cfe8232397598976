"""Similar labels: a join of two catalogues by the better of three comparisons of their words.

ratio(a, b), 0 to 100, of the sets of words: what both have (common), and what only one has, each sorted and
joined by spaces. It is the best of: common and own words of both by their longest common subsequence; common
alone against all of a; common alone against all of b. Where one has no words of its own it is 100.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labels of one side that a task indexes, and of the other that it looks up there.
SHARD, ASKED = 4096, 512
_WORD = 64


def subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit by bit of a at once."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    all_ = (1 << len(a)) - 1
    v = all_
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & all_
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """As above; 0 where a label has no words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if common and (not left or not right):
        return 100.0
    gap = 1 if common else 0
    la, lb = len(common) + gap + len(left), len(common) + gap + len(right)
    best = 100 * 2 * (len(common) + gap + subsequence(left, right)) / (la + lb)
    if common:
        best = max(best, 200 * len(common) / (len(common) + la), 200 * len(common) / (len(common) + lb))
    return best


class Index:
    """One side's labels, by word and by character."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.words = [sorted(set(x.split())) for x in labels]
        self.texts = [" ".join(w) for w in self.words]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.lists: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            for x in w:
                self.lists.setdefault(x, []).append(i)
        self.letters: dict[str, int] = {c: k for k, c in enumerate(sorted(set("".join(self.texts))))}
        n, wide = len(labels), int(self.size.max(initial=0))
        self.counts = np.zeros((n, len(self.letters)), np.int32)
        self.signs = np.full((n, wide), len(self.letters), np.int32)  # the last one is no character
        for i, t in enumerate(self.texts):
            at = np.array([self.letters[c] for c in t], np.int64)
            self.signs[i, : len(at)] = at
            np.add.at(self.counts[i], at, 1)

    def _subsequences(self, text: str, rows: np.ndarray) -> np.ndarray:
        """Of a text and each of some labels; 64 bits of the text in a word, all labels at once."""
        if len(text) > _WORD:
            return np.array([subsequence(text, self.texts[i]) for i in rows.tolist()], np.int64)
        masks = np.zeros(len(self.letters) + 1, np.uint64)
        for k, c in enumerate(text):
            if c in self.letters:
                masks[self.letters[c]] |= np.uint64(1 << k)
        v = np.full(len(rows), (1 << _WORD) - 1, np.uint64)
        for j in range(int(self.size[rows].max(initial=0))):
            u = v & masks[self.signs[rows, j]]
            v = (v + u) | (v - u)
        bits = np.unpackbits((~v).view(np.uint8).reshape(len(rows), 8), axis=1).sum(1)
        return bits.astype(np.int64)

    def best(self, label: str, least: float, most: int) -> list[tuple[int, float]]:
        """The `most` labels that are most alike, with a ratio of `least` or more; of equal ones the smaller label first.

        Words give the common part through their lists; lengths and characters bound what the rest can
        add. Labels are compared from the highest bound on, until no bound reaches the last of the best.
        """
        mine = sorted(set(label.split()))
        text = " ".join(mine)
        if not mine or not self.labels:
            return []
        shared, number = np.zeros(len(self.labels), np.int64), np.zeros(len(self.labels), np.int64)
        for w in mine:
            if at := self.lists.get(w):
                shared[at] += len(w)
                number[at] += 1
        common = shared + np.maximum(number - 1, 0)
        gap = (number > 0).astype(np.int64)
        la, lb = len(text), self.size
        left, right = np.maximum(la - common - gap, 0), np.maximum(lb - common - gap, 0)
        counts = np.zeros(len(self.letters), np.int32)
        for c in text:
            if c in self.letters:
                counts[self.letters[c]] += 1
        alike = np.minimum(self.counts, counts).sum(1)
        bound = 200 * np.where(gap == 1, np.minimum(common + gap + np.minimum(left, right), alike), alike) / np.maximum(la + lb, 1)
        known = np.where(gap == 1, np.maximum(200 * common / np.maximum(common + la, 1), 200 * common / np.maximum(common + lb, 1)), 0.0)
        known = np.where((gap == 1) & ((left == 0) | (right == 0)), 100.0, known)
        known = np.where(lb == 0, -1.0, known)
        bound = np.where(lb == 0, -1.0, np.maximum(bound, known))
        order = np.flatnonzero(bound >= least)
        order = order[np.argsort(-bound[order], kind="stable")]
        found: list[tuple[float, str, int]] = []
        for k in range(0, len(order), 512):
            some = order[k : k + 512]
            if len(found) >= most and found[most - 1][0] < -bound[some[0]]:
                break
            apart = some[gap[some] == 0]
            value = dict(zip(apart.tolist(), (200 * self._subsequences(text, apart) / (la + lb[apart])).tolist()))
            for i in some[gap[some] == 1].tolist():
                value[i] = known[i] if known[i] >= bound[i] else ratio(label, self.labels[i])
            found = sorted([*found, *((-r, self.labels[i], i) for i, r in value.items() if r >= least)])[:most]
        return [(i, -r) for r, _, i in found]


def _compared(least: float, most: int):
    """A block of asked labels and a shard of the others -> the best of the shard for each."""

    def run(key, table):
        asked, labels = (table.filter(pc.equal(table.column("asks"), v)).column("label").to_pylist() for v in (True, False))
        index, rows = Index(sorted(labels)), []
        for a in asked if labels else []:
            rows += [(a, index.labels[i], r) for i, r in index.best(a, least, most)]
        return pa.table({"a": pa.array([r[0] for r in rows], pa.string()), "b": pa.array([r[1] for r in rows], pa.string()), "ratio": pa.array([r[2] for r in rows], pa.float64())})

    return run


def alike(asked: DataFrame, labels: DataFrame, least: float = 55.0, most: int = 30, label: str = "label") -> DataFrame:
    """a, b, ratio, rank: for each asked label its `most` (a top-k) most similar ones, equal ratios by label; null and blank ones have none.

    Labels are dealt into shards, each of which is indexed; asked labels are looked up in every shard, in
    blocks, and only a shard's best are exchanged. There is no limit on either side's number.
    """
    clean = lambda df: df.select(F.col(label).alias("label")).where(F.trim(F.coalesce(label, F.lit(""))) != "").distinct()
    a, b = clean(asked), clean(labels)
    blocks, shards = (max(1, -(-df.count() // n)) for df, n in ((a, ASKED), (b, SHARD)))
    part = lambda n: F.pmod(F.xxhash64("label"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    both = a.select("label", F.lit(True).alias("asks"), part(blocks).alias("block"), every(shards).alias("shard")).unionByName(b.select("label", F.lit(False).alias("asks"), every(blocks).alias("block"), part(shards).alias("shard")))
    found = both.groupBy("block", "shard").applyInArrow(_compared(least, most), "a string, b string, ratio double")
    w = Window.partitionBy("a").orderBy(F.desc("ratio"), "b")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def alike_staff(modules: DataFrame, staff: DataFrame, least: float = 55.0, most: int = 30) -> DataFrame:
    """module_id, staff_id, department, similarity, rank: staff whose department is named like one of the module's, by (similarity, department, name).

    modules: module_id, label (a row each label); staff: staff_id, full_name, department. Distinct labels are
    compared once, and modules with the same labels have the same people, who are found once. `most`
    departments a label are enough for `most` people, as each has someone; of a set's departments only those
    meet their people that come before `most` others, so no more than twice `most` people are met.
    """
    named = staff.where(F.trim(F.coalesce("department", F.lit(""))) != "")
    pairs = alike(modules, named.select(F.col("department").alias("label")), least, most).select(F.col("a").alias("label"), F.col("b").alias("department"), "ratio")
    labelled = modules.groupBy("module_id").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    sets = labelled.select("labels").distinct()
    units = sets.select("labels", F.explode("labels").alias("label")).join(pairs, "label").groupBy("labels", "department").agg(F.max("ratio").alias("similarity"))
    people = named.withColumn("__k", F.row_number().over(Window.partitionBy("department").orderBy("full_name", "staff_id"))).where(F.col("__k") <= most)
    w = Window.partitionBy("labels").orderBy(F.desc("similarity"), "department").rowsBetween(Window.unboundedPreceding, -1)
    sized = units.join(people.groupBy("department").agg(F.count("*").alias("__n")), "department").withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    found = sized.where(F.col("__before") < most).join(people, "department").withColumn("rank", (F.col("__before") + F.col("__k")).cast("int")).where(F.col("rank") <= most)
    return labelled.join(found, "labels").select("module_id", "staff_id", "department", "similarity", "rank")
