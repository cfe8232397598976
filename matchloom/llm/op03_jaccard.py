"""Operator 3: exact n-gram Jaccard join by T-occurrence search.

A document's set holds its distinct shingles of `n` words (A-Z folded; words are runs of what isn't
ASCII white space; a shorter text is one shingle, a text without words or null has an empty set and
links with nothing). Two sets link when 100 * |intersection| >= PERCENT * |union|.

1. Equal sets become one node. Its 64-bit name comes with 64 further bits; sets that share a name but not
   these get names of their own (a handful in a corpus of any size). Copies are never paired.
2. Shingles get one order for the whole corpus, rare before frequent: by how far their slot of a count
   table exceeds the usual, then by the rarest of their words, then by all their words. A link needs a
   common shingle among the first |x| - ceil(.9 |x|) + 1 of either set: those are the short inverted
   lists. A shingle with a word that occurs once in the corpus has a list of one and isn't posted.
3. Lists with one node drop out. Then, in turns, each node takes its first list that holds several
   components, and the nodes of a list are searched as a block: lists are divided, the short ones
   heap-merged and the long ones binary-probed (DivideSkip), and who reaches the required overlap
   links. That collapses groups of near copies; a crowd is split into blocks that share two members.
   Where a list still holds more than FEW components, one node of each is dealt to a block of that list;
   those that may link with another of their block are searched in the list in which most of them are.
   So a crowd becomes few components before pairs are made, of which it would have the square of its size.
4. In the lists that still hold several components, one node stands for each component of a list, then
   all do. A pair is made once, in the first list that it shares, where that is one of the first of both
   nodes (else in all that it shares). Pairs stay candidates while sizes, places in the order and a 512-bit parity sketch allow the
   overlap (bounds that only drop pairs that can't link). A node is searched among its candidates, again
   by DivideSkip, and gives one link to each component that it reaches.

No list is capped and no pair is dropped. A hot list is split by Spark's skew joins or by block.
Sets are compared by 64-bit hashes of shingles, and a link counts once the words behind equal hashes are
compared too. Repeated rows are copies. Null ids never name a
component unless it has no other. Empty tables give empty results; extra columns do no harm.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm import words
from matchloom.operators.components import components
from matchloom.session import Scratch, tasks

PERCENT = 90
#: Nodes and, about, shingles in a block.
BLOCK_NODES, BLOCK_SHINGLES = 256, 150_000
#: Nodes of a list whose pairs are looked at before texts are; a list of more components is a crowd.
FEW = 64
#: Turns in which each node is searched in its first list of several components, in which crowds are searched in blocks (at most), and in which components are represented.
BLOCK_TURNS, CROWD_TURNS, STAND_IN_TURNS = 2, 2, 3
#: A node's first lists that go with each of its postings, so that a pair needn't be made in every list it shares.
FIRST_LISTS = 4
#: Documents whose tables go in a task: those of few documents don't go in more tasks than these ask for.
TASK_DOCS = 10_000
#: Slots in a piece of the count tables, and their number at most (a byte each where they are broadcast).
PIECE, MOST_SLOTS = 4096, 1 << 26


def sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    return list(_sets(words.scan(column, words.NONSPACE), n))


def _sets(w: words.Words, n: int):
    whole = words.windows(w.hash, n)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= n:
            yield np.unique(whole[a : b - n + 1])
        else:
            yield words.windows(w.hash[a:b], b - a) if b > a else whole[:0]


def _digest(h: np.ndarray) -> int:
    parts = np.array([h.sum(dtype=np.uint64), np.bitwise_xor.reduce(h), len(h)], np.uint64)
    return int(words.mix((words.mix(parts) * np.array([3, 5, 7], np.uint64)).sum(keepdims=True, dtype=np.uint64)).view(np.int64)[0])


def signature(shingles: np.ndarray) -> tuple[int, int]:
    """A set's 64-bit name, and 64 bits that tell sets of one name apart."""
    h = words.mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return _digest(h), _digest(words.mix(h * np.uint64(0xD6E8FEB86659FD93) + shingles))


def prefix_size(size: int, percent: int = PERCENT) -> int:
    """Lists of which a link needs one in common: all but the required overlap, and one more."""
    return size - -(-percent * size // 100) + 1


def required(a: int, b: int, percent: int = PERCENT) -> int:
    """Least intersection of linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def divide_skip(lists: list[list[int]], need: int) -> dict[int, int]:
    """Members of `need` lists or more, with their number of lists. Lists are sorted and without repeats.

    The longest lists are set aside, as many as the balance of merging and probing asks for; the
    others are merged through a heap, and who occurs often enough there is looked up in the long ones
    by binary search until `need` is reached or out of reach.
    """
    lists = sorted((x for x in lists if x), key=len)
    if len(lists) < need or not lists:
        return {}
    longest = len(lists[-1])
    aside = min(need - 1, int(need / (0.01 * np.log2(longest + 1) + 1)))
    short, long = (lists[: len(lists) - aside], lists[len(lists) - aside :]) if aside else (lists, [])
    found: dict[int, int] = {}
    heap = [(x[0], i, 0) for i, x in enumerate(short)]
    heapq.heapify(heap)
    while heap:
        top, seen = heap[0][0], 0
        while heap and heap[0][0] == top:
            _, i, at = heap[0]
            seen += 1
            if at + 1 < len(short[i]):
                heapq.heapreplace(heap, (short[i][at + 1], i, at + 1))
            else:
                heapq.heappop(heap)
        if seen < need - len(long):
            continue
        for k, x in enumerate(long):
            if seen + len(long) - k < need:
                break
            at = bisect_left(x, top)
            seen += at < len(x) and x[at] == top
        if seen >= need:
            found[top] = seen
    return found


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common members: the smaller set is binary-probed in the larger one."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = overlap(a, b)
    return 100 * common >= percent * (len(a) + len(b) - common)


def always(i: int, j: int) -> bool:
    return True


def search_block(nodes: list[int], members: list[np.ndarray], percent: int = PERCENT, confirmed=always) -> list[tuple[int, int]]:
    """Links that connect what is connected in a block; a link within what is already connected is left out. confirmed: compares two members' words."""
    order = sorted(range(len(nodes)), key=lambda i: len(members[i]))
    root = list(range(len(nodes)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out, index, heads = [], {}, []

    def join(i, j):
        out.append((nodes[i], nodes[j]))
        root[top(i)] = top(j)

    for place, i in enumerate(order):
        mine = members[i]
        for j in heads[-4:]:  # most of a group of near copies links with one of its first
            if top(j) != top(i) and linked(mine, members[j], percent) and confirmed(i, j):
                join(i, j)
        apart = {top(order[k]) for k in range(place)} - {top(i)}
        if apart:
            lists = [index[t] for t in mine.tolist() if t in index]
            least = required(-(-percent * len(mine) // 100), len(mine), percent)
            for k, common in divide_skip(lists, max(1, least)).items():
                j = order[k]
                if top(j) != top(i) and 100 * common >= percent * (len(mine) + len(members[j]) - common) and confirmed(i, j):
                    join(i, j)
        if all(top(j) != top(i) for j in heads):
            heads.append(i)
        for t in mine.tolist():
            index.setdefault(t, []).append(place)
    return out


def search_one(mine: np.ndarray, others: list[np.ndarray], comps: list[int], percent: int = PERCENT, confirmed=lambda k: True) -> list[int]:
    """Places of one linked set of each component among the others. confirmed: compares the words with one of them."""
    lists: dict[int, list[int]] = {t: [] for t in mine.tolist()}
    for k, s in enumerate(others):
        for t in np.intersect1d(mine, s, assume_unique=True).tolist():
            lists[t].append(k)
    out, reached = [], set()
    for k, common in divide_skip(list(lists.values()), max(1, required(-(-percent * len(mine) // 100), len(mine), percent))).items():
        if comps[k] not in reached and 100 * common >= percent * (len(mine) + len(others[k]) - common) and confirmed(k):
            reached.add(comps[k])
            out.append(k)
    return out


# ---- the distributed part ------------------------------------------------------------------------


def _slots(h: np.ndarray, slots: int) -> np.ndarray:
    return h >> np.uint64(64 - slots.bit_length() + 1)


def pieces(table: np.ndarray):
    """(numbers, contents as compressed bytes) of a task's pieces in which something was counted, some at a time."""
    at = [p for p in range(0, len(table), PIECE) if table[p : p + PIECE].any()]
    for part in (at[i : i + 1024] for i in range(0, len(at), 1024)):
        yield [p // PIECE for p in part], [pa.compress(np.minimum(table[p : p + PIECE], 255).astype(np.uint8).tobytes(), "zstd", asbytes=True) for p in part]


def _describe(n: int, slots: int, word_slots: int):
    """doc_id, check, text -> a row a document (size, node), then the task's counts of shingles and words in pieces."""

    def run(batches):
        counts, used = np.zeros(slots, np.uint32), np.zeros(word_slots, np.uint32)
        schema = pa.schema([("doc_id", pa.int64()), ("check", pa.int64()), ("size", pa.int64()), ("node", pa.int64()), ("second", pa.int64()), ("piece", pa.int32()), ("counts", pa.binary())])
        seen: set[tuple[int, int]] = set()
        for b in batches:
            w = words.scan(b.column(2), words.NONSPACE)
            found = list(_sets(w, n))
            nodes = [signature(s) if len(s) else None for s in found]
            fresh = [d for d, x in enumerate(nodes) if x is not None and x not in seen and not seen.add(x)]
            if fresh:
                np.add.at(counts, _slots(np.concatenate([found[d] for d in fresh]), slots), 1)
                np.add.at(used, _slots(np.concatenate([w.hash[w.first[d] : w.first[d + 1]] for d in fresh]), word_slots), 1)
            k = len(found)
            named = [pa.array([x and x[i] for x in nodes], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in found], pa.int64()), *named, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=schema)
        for base, table in ((0, counts), (slots // PIECE, used)):
            for part, small in pieces(table):
                k = len(part)
                yield pa.RecordBatch.from_arrays([*[pa.nulls(k, pa.int64())] * 5, pa.array([base + p for p in part], pa.int32()), pa.array(small, pa.binary())], schema=schema)

    return run


def _summed(table: pa.Table) -> np.ndarray:
    total = np.zeros(PIECE, np.uint32)
    for x, wide in zip(table.column("counts"), table.column("wide").to_pylist()):
        total += np.frombuffer(pa.decompress(x.as_buffer(), PIECE * (4 if wide else 1), "zstd"), np.uint32 if wide else np.uint8)
    return total


def _add(key, table):
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([pa.compress(_summed(table).tobytes(), "zstd", asbytes=True)], pa.binary()), "wide": pa.array([True])})


def _grade(shingle_pieces: int, usual: float):
    """Counts of a piece as bytes: of shingles how far beyond the usual in powers of two, of words half powers of two, 0 up to one."""

    def run(key, table):
        total, piece = np.maximum(_summed(table), 1), key[0].as_py()
        if piece < shingle_pieces:
            grade = np.clip(np.floor(np.log2(total / usual)) + 1, 0, 60)
        else:
            grade = np.where(total > 1, 1 + np.floor(2 * np.log2(total)), 0)
        return pa.table({"piece": pa.array([piece], pa.int32()), "counts": pa.array([grade.astype(np.uint8).tobytes()], pa.binary())})

    return run


def _tables(counted: DataFrame, slots: int, word_slots: int, shingles: int, few: int) -> tuple[np.ndarray, np.ndarray]:
    """Grades of all slots of shingles and of words."""
    schema = "piece int, counts binary"
    salted = counted.withColumns({"wide": F.lit(False), "salt": F.expr("spark_partition_id() div 16")})
    halfway = salted.groupBy("piece", "salt").applyInArrow(_add, schema + ", wide boolean")
    total = np.zeros(slots + word_slots, np.uint8)
    graded = halfway.coalesce(few).groupBy("piece").applyInArrow(_grade(slots // PIECE, 2 * shingles / slots + 8), schema).coalesce(few)
    for r in graded.toLocalIterator():  # the tables' size, whatever the input's
        total[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(r["counts"], np.uint8)
    return total[:slots], total[slots:]


def parity(s: np.ndarray) -> np.ndarray:
    """512 bits: whether an odd number of members falls on each. They differ in no more bits than sets do in members."""
    odd = np.bincount((words.mix(s) >> np.uint64(55)).astype(np.int64), minlength=512).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def ordered(w: words.Words, n: int, tables) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text: its distinct shingles ascending, their places in the order of the corpus, and whether more than one set can hold them."""
    levels, grades = tables
    of_word = grades[_slots(w.hash, len(grades))].astype(np.uint64)
    whole = words.windows(w.hash, n)
    rarest, every = of_word[: len(whole)].copy(), of_word[: len(whole)].copy()
    for k in range(1, n):
        np.minimum(rarest, of_word[k : k + len(whole)], out=rarest)
        every += of_word[k : k + len(whole)]
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= n:
            s, at = np.unique(whole[a : b - n + 1], return_index=True)
            low, sums = rarest[a : b - n + 1][at], every[a : b - n + 1][at]
        elif b > a:
            s, low, sums = words.windows(w.hash[a:b], b - a), of_word[a:b].min(keepdims=True), of_word[a:b].sum(keepdims=True)
        else:
            s, low, sums = whole[:0], of_word[:0], of_word[:0]
        level = levels[_slots(s, len(levels))].astype(np.uint64)
        rank = (level << np.uint64(58)) | (low << np.uint64(51)) | (np.minimum(sums, np.uint64(511)) << np.uint64(42)) | (s >> np.uint64(22))
        out.append((s, np.argsort(rank, kind="stable"), low > 0))
    return out


_LISTS = "node long, size int, postings array<struct<at:int,key:long>>, bits array<long>"


def may_link(size: int, percent: int) -> bool:
    """Whether a set of this size can link with one that isn't equal."""
    return 100 * size >= percent * (size + 1) or 100 * (size - 1) >= percent * size


def lists_batch(nodes: list[int], sizes: list[int], places: list[np.ndarray], keys: list[np.ndarray], bits: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of _LISTS."""
    ends = np.cumsum([0, *map(len, places)])
    flat = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, t), *x]), t) for x, t in ((places, "int32"), (keys, "int64"))], names=["at", "key"])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), lists, pa.array(bits, pa.list_(pa.int64()))], names=["node", "size", "postings", "bits"])


def _short_lists(n: int, tables, percent: int, renamed: dict[tuple[int, int], int]):
    def run(batches):
        seen: set[tuple[int, int]] = set()
        for b in batches:
            nodes, sizes, places, keys, bits = [], [], [], [], []
            for s, order, shared in ordered(words.scan(b.column(0), words.NONSPACE), n, tables.value):
                if may_link(len(s), percent):
                    named = signature(s)
                    if named not in seen:
                        seen.add(named)
                        first = order[: prefix_size(len(s), percent)]
                        at = np.flatnonzero(shared[first])
                        nodes.append(renamed.get(named, named[0]))
                        sizes.append(len(s))
                        places.append(at.astype(np.int32))
                        keys.append(s[first[at]].view(np.int64))
                        bits.append(parity(s))
            yield lists_batch(nodes, sizes, places, keys, bits)

    return run


def _bits(values: DataFrame, column: str, words64: int) -> DataFrame:
    """One row: a bit table of a fixed size in which the values' slots are set."""
    spark = values.sparkSession
    slot = F.pmod(F.xxhash64(column), F.lit(words64 * 64))
    parts = values.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("b"))
    every = parts.unionByName(spark.range(words64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("b"))).groupBy("word").agg(F.bit_or("b").alias("b"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "b"))), lambda x: x["b"]).alias("__bits"))


def _maybe(df: DataFrame, column: str, bits: DataFrame, words64: int) -> DataFrame:
    return df.join(F.broadcast(bits), F.lit(True)).where(_tested(column, words64)).drop("__bits")


def _tested(column: str, words64: int):
    slot = f"pmod(xxhash64(cast(`{column}` as bigint)), {words64 * 64}L)"
    return F.expr(f"shiftright(__bits[cast(shiftright({slot}, 6) as int)], cast({slot} & 63 as int)) & 1L") == 1


def same_words(w: words.Words, n: int):
    """(i, j) -> whether all shingles of texts i and j with equal hashes have equal words."""

    def places(i: int):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a < n:
            return words.windows(w.hash[a:b], b - a), np.array([a]), b - a
        found, at = np.unique(words.windows(w.hash[a:b], n), return_index=True)
        return found, at + a, n

    def same(i: int, j: int) -> bool:
        (x, at, size), (y, to, _) = places(i), places(j)
        _, p, q = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        return bool(w.equal((at[p][:, None] + np.arange(size)).ravel(), (to[q][:, None] + np.arange(size)).ravel()))

    return same


def _search(n: int, percent: int, block=search_block, one=search_one):
    """The texts of a block -> links. With rows that ask, only these are searched among the others."""

    def run(key, table):
        table = table.combine_chunks()
        nodes, comps, asks = (table.column(c).to_pylist() for c in ("node", "comp", "asks"))
        texts = table.column("t").combine_chunks()
        w = words.scan(texts if isinstance(texts, pa.Array) else texts.chunk(0), words.NONSPACE)
        members, same, seen, found = list(_sets(w, n)), same_words(w, n), set(), []
        once = [i for i, x in enumerate(nodes) if x not in seen and not seen.add(x)]  # a text may come twice where rows are repeated
        if any(asks):
            others = [i for i in once if not asks[i]]
            for i in (i for i in once if asks[i]):
                found += [(nodes[i], nodes[others[k]]) for k in one(members[i], [members[j] for j in others], [comps[j] for j in others], percent, lambda k: same(i, others[k]))]
        else:
            found = block([nodes[i] for i in once], [members[i] for i in once], percent, lambda i, j: same(once[i], once[j]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _near(x: str, y: str, percent: int) -> str:
    """SQL: sizes and places of a common list allow a link; for a linked pair's first common list it holds."""
    return (
        f"100 * least({x}.size, {y}.size) >= {percent} * greatest({x}.size, {y}.size) and "
        f"{100 + percent} * least({x}.size - {x}.at, {y}.size - {y}.at) >= {percent} * ({x}.size + {y}.size)"
    )


def _alike(x: str, y: str, percent: int, first: int = 0) -> str:
    """SQL: parities (from word `first` of the sketches on) differ in no more bits than linked sets of these sizes do in members."""
    differ = " + ".join(f"bit_count({x}.p{i} ^ {y}.p{i})" for i in range(first, first + 8))
    return f"{differ} <= {x}.size + {y}.size - 2 * ceil({percent} * ({x}.size + {y}.size) / {100 + percent})"


class _Join:
    """The tables of one join, and its steps."""

    #: 64-bit words of a node's sketch.
    sketch_words = 8
    #: Tasks that its tables are coalesced to, by the number of documents.
    few = 1 << 20

    def __init__(self, docs: DataFrame, scratch: Scratch, n: int, percent: int, doc_id: str, text: str):
        self.spark, self.docs, self.scratch, self.n, self.percent, self.doc_id, self.text = docs.sparkSession, docs, scratch, n, percent, doc_id, text
        self.total = docs.agg(F.sum(F.octet_length(text)).alias("b"), F.count("*").alias("n")).first()
        self.words64 = self.sized(self.total["n"] / 4, 10, 1 << 20)
        self.few = tasks(self.spark, self.total["n"], TASK_DOCS)
        self.describe()
        flat = self.lists.select("node", "size", F.explode("postings").alias("p")).select("node", "size", "p.at", "p.key")
        shared = self.keep(flat.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("key"), "shared-lists")
        posted = _maybe(flat, "key", _bits(shared, "key", self.words64), self.words64).join(shared, "key").dropDuplicates(["key", "node"])
        self.posted = self.keep(posted.select("key", "node", "size", "at", F.col("node").alias("comp"), F.lit(True).alias("moved")), "postings")
        self.sketches = self.lists.select("node", *[F.col("bits")[i].alias(f"p{i}") for i in range(self.sketch_words)]).dropDuplicates(["node"])
        self.sketches = self.keep(self.sketches.join(self.posted.select("node").distinct(), "node"), "sketches")
        self.roots, self.left, self.left_of = None, self.posted, None

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df written and read back, in as many tasks as the documents ask for."""
        return self.scratch.keep(df.coalesce(self.few), name)

    @staticmethod
    def sized(x: float, least: int, most: int) -> int:
        """The power of two from x on, between 2^least and most."""
        return 1 << int(np.clip(np.ceil(np.log2(max(1, x))), least, most.bit_length() - 1))

    def describe(self) -> None:
        """Sets rows (a row a document) and lists (a row a node, with its short lists)."""
        held = self.total["b"] or 0
        slots, word_slots = self.sized(held / 400, 16, MOST_SLOTS), self.sized(held / 32, 16, MOST_SLOTS >> 2)
        asked = self.docs.select(F.col(self.doc_id).cast("long"), F.xxhash64(self.text), F.col(self.text))
        told = self.scratch.keep(asked.mapInArrow(_describe(self.n, slots, word_slots), "doc_id long, check long, size long, node long, second long, piece int, counts binary"), "sets")
        renamed = self.name(told.where("piece is null"))
        shingles = self.rows.agg(F.sum("size").alias("n")).first()["n"] or 0
        tables = self.spark.sparkContext.broadcast(_tables(told.where("piece is not null").select("piece", "counts"), slots, word_slots, shingles, self.few))
        self.lists = self.scratch.keep(self.docs.select(F.col(self.text)).mapInArrow(_short_lists(self.n, tables, self.percent, renamed), _LISTS), "short-lists")

    def name(self, told: DataFrame) -> dict[tuple[int, int], int]:
        """Sets rows; new names of sets whose 64-bit name another set has (as many as n * n / 2^65 of n sets: few at any size)."""
        self.rows = told.select("doc_id", "check", "size", "node")
        both = told.where("node is not null").groupBy("node").agg(F.min("second").alias("least"), F.max("second").alias("most")).where("least <> most")
        more = told.join(both, "node").where("second <> least").select("node", "second", F.xxhash64("second", "node").alias("other")).distinct().collect()
        if more:
            other = F.broadcast(self.spark.createDataFrame(more, "node long, second long, other long"))
            self.rows = told.join(other, ["node", "second"], "left").select("doc_id", "check", "size", F.coalesce("other", "node").alias("node"))
        return {(r["node"], r["second"]): r["other"] for r in more}

    def near(self, x: str, y: str) -> str:
        return _near(x, y, self.percent)

    def alike(self, x: str, y: str) -> str:
        return _alike(x, y, self.percent)

    def searcher(self):
        return _search(self.n, self.percent)

    def mixed(self) -> DataFrame:
        """The postings of lists that hold several components: key, node, size, at, comp, and whether the list's components have changed."""
        if self.roots is not self.left_of:
            named = self.left.withColumnRenamed("comp", "old").drop("moved").join(self.roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root").coalesce(self.few)
            keys = named.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.bool_or(F.col("comp") != F.col("old")).alias("moved")).where("x <> y").select("key", "moved")
            self.left = self.keep(named.join(keys, "key").select("key", "node", "size", "at", "comp", "moved"), "mixed-postings")  # what is one component stays one
            self.left_of = self.roots
        return self.left

    def add(self, links: DataFrame) -> bool:
        """Takes links in; whether there were any."""
        links = self.keep(links, "links")
        if links.isEmpty():
            return False
        if self.roots is not None:  # a component's links to its root say the same as all of its links
            links = links.unionByName(self.roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        self.roots = self.keep(components(links, self.scratch), "roots")
        return True

    def searched(self, asked: DataFrame) -> DataFrame:
        """Links among the nodes of each block. asked: block, part, node, comp, asks."""
        asked = self.keep(asked, "asked")
        if asked.isEmpty():
            return self.spark.createDataFrame([], "a long, b long")
        wanted = asked.select("node").distinct().coalesce(self.few)
        chosen = self.rows.join(wanted, "node", "left_semi").coalesce(self.few).groupBy("node").agg(F.min(F.struct("doc_id", "check")).alias("r"))  # one row's text for each node
        chosen = asked.join(chosen, "node").select("block", "part", "node", "comp", "asks", F.col("r.doc_id").alias("__id"), F.col("r.check").alias("__check"))
        chosen = self.keep(chosen, "chosen")
        seen = self.docs.select(F.col(self.doc_id).cast("long").alias("id"), F.xxhash64(self.text).alias("check"), F.col(self.text).alias("t"))
        seen = _maybe(seen, "check", _bits(chosen.select("__check").distinct(), "__check", self.words64), self.words64)
        told = seen.join(chosen, (F.col("check") == F.col("__check")) & F.col("id").eqNullSafe(F.col("__id"))).select("block", "part", "node", "comp", "asks", "t").coalesce(self.few)
        return told.groupBy("block", "part").applyInArrow(self.searcher(), "a long, b long")

    def by_first_list(self, left: DataFrame) -> DataFrame:
        """Blocks of the nodes whose first list of several components is the same; two of them are in every block of a list.

        In a list of few, nodes that may link with none of the others stay out.
        """
        firsts = left.groupBy("node").agg(F.min_by(F.struct("key", "comp", "size", "at"), "at").alias("f")).select("node", "f.*")
        firsts = self.keep(firsts, "firsts")
        lists = firsts.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n")).where("x <> y").select("key", (F.col("n") <= FEW).alias("few"))
        listed = self.keep(firsts.join(lists, "key"), "listed")
        some = self.keep(listed.where("few").drop("few").join(self.sketches, "node"), "of-few")
        alike = some.alias("x").join(some.alias("y"), self.matched(), "left_semi").select("node").coalesce(self.few)  # a row a node, however many others it may link with
        firsts = firsts.join(listed.where("not few").select("node").unionByName(alike), "node")
        firsts = self.keep(firsts, "searched-firsts")
        crowds = firsts.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n"), F.sum("size").alias("held"), F.min("node").alias("one"), F.max("node").alias("two")).where("x <> y")
        parts = F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("held") / BLOCK_SHINGLES)).cast("long")
        crowds = crowds.select("key", parts.alias("parts"), "one", "two")
        mine, everywhere = F.array(F.pmod(F.xxhash64("node"), F.col("parts"))), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
        part = F.explode(F.when(F.col("node").isin(F.col("one"), F.col("two")), everywhere).otherwise(mine))
        return firsts.join(crowds, "key").select(F.col("key").alias("block"), part.alias("part"), "node", "comp", F.lit(False).alias("asks"))

    def by_crowd(self, left: DataFrame, turn: int) -> DataFrame:
        """Blocks of the lists of more than FEW components: a node for each, another one and in other blocks each turn.

        Who may link with none of its block stays out; the others are searched in that of their lists in which most are left.
        """
        long = left.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("key")
        one = F.min_by(F.struct("node", "size", "at"), F.xxhash64("node", F.lit(turn)))
        some = self.keep(left.join(long, "key").groupBy("key", "comp").agg(one.alias("r")).select("key", "comp", "r.*"), "of-crowds")
        crowds = some.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("held")).where(F.col("n") > FEW)
        parts = F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("held") / BLOCK_SHINGLES)).cast("long")
        dealt = some.join(crowds.select("key", parts.alias("parts")), "key").withColumn("part", F.pmod(F.xxhash64("comp", F.lit(turn)), F.col("parts"))).drop("parts").coalesce(self.few)
        dealt = self.sketched(dealt)
        met = dealt.alias("x").join(dealt.alias("y"), self.matched() & (F.col("x.part") == F.col("y.part")), "left_semi").select("key", "part", "node", "comp")
        met = self.keep(met, "of-crowds-alike")
        most = met.join(met.groupBy("key").agg(F.count("*").alias("n")), "key").coalesce(self.few).groupBy("comp").agg(F.max(F.struct("n", "key", "part", "node")).alias("m")).select("m.*", "comp")
        most = self.keep(most, "of-one-crowd")
        blocks = most.groupBy("key", "part").agg(F.count("*").alias("n")).where("n > 1").select("key", "part")
        return most.join(blocks, ["key", "part"]).select(F.col("key").alias("block"), "part", "node", "comp", F.lit(False).alias("asks"))

    def matched(self):
        """Postings x and y are of one list and different components, and their nodes may link."""
        return (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & F.expr(self.near("x", "y")) & F.expr(self.alike("x", "y"))

    def first_shared(self):
        """The list is the first that x and y share, or none that they share is among the first ones of both.

        Of lists that are among the first ones of both, none before the first of these is shared. Who can't link by
        sizes and places there can't in later ones, where places are higher.
        """
        theirs = [F.col(f"y.q{i}") for i in range(FIRST_LISTS)]
        return F.coalesce(*[F.when(F.col(f"x.q{i}").isin(theirs), F.col(f"x.q{i}")) for i in range(FIRST_LISTS)], F.col("x.key")) == F.col("x.key")

    def candidates(self, x: DataFrame, y: DataFrame, also) -> DataFrame:
        """a, a_comp, a_size, b, b_comp: pairs of different components that share a list and may link."""
        both = x.alias("x").join(y.alias("y"), self.matched() & self.first_shared() & also)
        first = F.col("x.node") > F.col("y.node")
        one = lambda c: (F.when(first, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")), F.when(first, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")))
        (a, b), (ca, cb), (sa, _) = one("node"), one("comp"), one("size")
        return both.select(a.alias("a"), ca.alias("a_comp"), sa.alias("a_size"), b.alias("b"), cb.alias("b_comp")).coalesce(self.few).distinct()

    def among_candidates(self, pairs: DataFrame) -> DataFrame:
        """Blocks of a node that asks and those that it may link with; long lists of these are split."""
        width = F.greatest(F.lit(1), F.least(F.lit(BLOCK_NODES), F.lit(BLOCK_SHINGLES) / F.col("a_size"))).cast("long")
        sized = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("n")), "a").withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / width).cast("long")))
        others = sized.select(F.col("a").alias("block"), "part", F.col("b").alias("node"), F.col("b_comp").alias("comp"), F.lit(False).alias("asks"))
        asking = sized.select(F.col("a").alias("block"), "part", F.col("a").alias("node"), F.col("a_comp").alias("comp"), F.lit(True).alias("asks")).distinct()
        return others.unionByName(asking)

    def sketched(self, postings: DataFrame) -> DataFrame:
        return self.keep(postings.coalesce(self.few).join(self.sketches, "node"), "sketched")

    def with_firsts(self, postings: DataFrame) -> DataFrame:
        """Postings with their node's sketch and its first lists among them."""
        mine = Window.partitionBy("node").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return self.sketched(postings.withColumns({f"q{i}": F.nth_value("key", i + 1).over(mine) for i in range(FIRST_LISTS)}))

    def stand_ins(self, left: DataFrame) -> DataFrame:
        """Candidates among one node of each component of a list, another one in each list; lists that haven't changed since give the same and are left out."""
        one = F.min_by(F.struct("node", "size", "at"), F.xxhash64("node", "key"))
        some = self.with_firsts(left.where("moved").groupBy("key", "comp").agg(one.alias("r")).select("key", "comp", "r.*"))
        return self.candidates(some, some, F.col("x.node") > F.col("y.node"))

    def everybody(self, left: DataFrame) -> DataFrame:
        """Candidates among all nodes; those of a list's largest component needn't meet each other. Where every component has one node, it stood for itself."""
        per = left.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m")).where("m.n > 1").select("key", F.col("m.comp").alias("main"))
        all_ = self.with_firsts(left.join(per, "key"))
        return self.candidates(all_, all_.where("comp <> main"), (F.col("x.comp") == F.col("x.main")) | (F.col("x.node") > F.col("y.node")))  # a pair once, not in both orders

    def run(self) -> None:
        for _ in range(BLOCK_TURNS):
            if not self.add(self.searched(self.by_first_list(self.mixed()))):
                break
        for turn in range(CROWD_TURNS):
            if not self.add(self.searched(self.by_crowd(self.mixed(), turn))):
                break
        tested, found, left = None, True, self.posted
        for choose in [self.stand_ins] * STAND_IN_TURNS + [self.everybody]:
            if choose == self.stand_ins and not found:
                continue  # what stands for others links with nothing more
            if found:
                left = self.mixed() if tested is not None else self.mixed().withColumn("moved", F.lit(True))
            pairs = choose(left)
            pairs = self.keep(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "candidates")
            found = not pairs.isEmpty() and self.add(self.searched(self.among_candidates(pairs)))
            tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))


def link_classes(docs: DataFrame, scratch: Scratch, n: int = 3, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", kind: type[_Join] = _Join):
    """(a row a document: doc_id, check, size, node; node and root of every node that isn't its component's root).

    check is a hash of the text, to tell rows with the same id apart. kind: how links are found.
    """
    join = kind(docs, scratch, n, percent, doc_id, text)
    join.run()
    return join.rows, join.roots if join.roots is not None else docs.sparkSession.createDataFrame([], "node long, root long")


def _classes(docs: DataFrame, n: int, percent: int, doc_id: str, text: str, kind: type[_Join] = _Join) -> tuple[DataFrame, Scratch]:
    """(doc_id, check, size, comp of every row, what it is read from)."""
    scratch, result = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    rows, roots = link_classes(docs, scratch, n, percent, doc_id, text, kind)
    named = result.keep(rows.join(roots, "node", "left").select("doc_id", "check", "size", F.coalesce("root", "node").alias("comp")), "classes")
    scratch.clear()
    return named, result


def classes(docs: DataFrame, n: int = 3, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", kind: type[_Join] = _Join) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    named, _ = _classes(docs, n, percent, doc_id, text, kind)
    least = named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"))
    joined = named.where("comp is not null").join(least, "comp").select("doc_id", "size", "least")
    alone = named.where("comp is null").select("doc_id", "size", F.col("doc_id").alias("least"))
    return joined.unionByName(alone).select("doc_id", F.col("size").alias("n_shingles"), F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 3, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", kind: type[_Join] = _Join) -> DataFrame:
    """One row of docs, with all its columns, of each component: the one with the smallest id (a null id is larger than any other).

    Of rows with that id the text with the smallest hash stays, and of rows with the same id and text any one.
    Rows without words are no component and all stay.
    """
    named, scratch = _classes(docs, n, percent, doc_id, text, kind)
    spark = docs.sparkSession
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "check")
    groups = named.where("comp is not null").groupBy("comp").agg(F.min(row).alias("best"), F.count("*").alias("n")).where("n > 1")
    crowd = named.join(groups, "comp").groupBy("doc_id", "check").agg(F.max((row == F.col("best")).cast("int")).alias("best"), F.count("*").alias("n"))
    gone = scratch.keep(crowd.where("best = 0 or n > 1").select(F.col("doc_id").alias("__id"), F.col("check").alias("__check"), F.col("best").alias("__best")), "gone")
    words64 = 1 << int(np.clip(gone.count() // 4, 1 << 10, 1 << 20)).bit_length()
    bits = F.broadcast(_bits(gone, "__id", words64))  # one row; most texts needn't be shuffled to be kept
    whole = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("hash"))  # no name of docs can clash
    marked = whole.join(bits, F.lit(True)).withColumn("__maybe", _tested("id", words64)).drop("__bits")
    met = marked.where("__maybe").drop("__maybe").join(gone, F.col("id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__check")), "left")
    out = marked.where("not __maybe").select("row").unionByName(met.where("__best is null").select("row"))
    if not gone.where("__best = 1").isEmpty():  # rows that stay, but come more than once
        out = out.unionByName(met.where("__best = 1").dropDuplicates(["id", "hash"]).select("row"))
    return out.select("row.*")


def oracle(n: int, percent: int) -> str:
    """SQL of classes()."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) >= {n} THEN ws[i:i + {n} - 1] ELSE ws END, ' ') AS shingle
      FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - {n} + 1, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= {percent} * (p.n + q.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""


ORACLE = oracle(3, PERCENT)
