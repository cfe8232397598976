"""Operator 4 [native]: exact deduplication by progressive refinement.

Rows are grouped by the length of their text, the groups that are left by a hash of the text's
first part, and only what is still in a group with others is read as a whole and gets a full hash. No
text is shuffled: which (length, prefix) groups have company is kept in a bit table, which the second
scan tests, so a false hit costs one more hash and never a wrong result. The table has 16 bits a group
with company, up to MOST_WORDS words; beyond that more rows are hashed.

Null counts as the empty text; all empty texts are one group. Of equal texts the row with the
smallest doc_id stays (a null id counts as larger than any other); of repeated rows, with the same id
and text, one is kept and the others are not. An empty table gives an empty result.
Columns of the input are only read by name, so extra ones do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.session import Scratch

#: Words of 64 bits in the bit table at least and at most (16 MB).
LEAST_WORDS, MOST_WORDS = 1 << 10, 1 << 21
#: Characters of a text that its prefix hash reads.
PREFIX_CHARS = 256
_KEYS = ["len", "prefix", "full"]


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _narrow(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    norm = docs.select(*more, normalised(F.col(text)).alias("__norm"))
    return norm.withColumns({"__len": F.octet_length("__norm"), "__prefix": F.xxhash64(F.substring("__norm", 1, PREFIX_CHARS))})


def _slots(words64: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(words64 * 64))


def _table(values: DataFrame, words64: int, *columns: str) -> DataFrame:
    """One row: `__bits`, with the bit of every row's slot set."""
    slots = values.select(_slots(words64, *columns).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("b"))
    every = words.unionByName(slots.sparkSession.range(words64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("b")))
    every = every.groupBy("word").agg(F.bit_or("b").alias("b"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "b"))), lambda x: x["b"]).alias("__bits"))


def _marked(rows: DataFrame, values: DataFrame, columns: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """rows with `__maybe`: whether their columns may be among the values'."""
    wanted, words64 = values.count() // 4, LEAST_WORDS
    while words64 < min(wanted, MOST_WORDS):
        words64 *= 2
    bits = F.broadcast(_table(values, words64, *columns))  # one row of 16 MB at most
    at = f"pmod(xxhash64({', '.join(f'`{n}`' for n in names)}), {words64 * 64}L)"
    test = F.expr(f"shiftright(__bits[cast(shiftright({at}, 6) as int)], cast({at} & 63 as int)) & 1L") == 1
    return rows.join(bits, F.lit(True)).withColumn("__maybe", test).drop("__bits")


def company(docs: DataFrame, text: str = "text") -> DataFrame:
    """(len, prefix) of the groups of two rows or more: lengths that only one text has drop out first, then prefixes."""
    sized = _narrow(docs, text).groupBy(F.col("__len").alias("len"), F.col("__prefix").alias("prefix")).agg(F.count("*").alias("n"))
    lengths = sized.groupBy("len").agg(F.sum("n").alias("of_len")).where("of_len > 1").select("len")
    return sized.where("n > 1").join(lengths, "len", "left_semi").select("len", "prefix")


def _refined(docs: DataFrame, scratch: Scratch, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all rows with `__maybe`; rows of groups with company: doc_id, len, prefix, full, tag; groups of equal texts with the row that stays)."""
    hot = scratch.keep(company(docs, text), "company")
    rows = _marked(_narrow(docs, text, F.col(doc_id).alias("doc_id")), hot, ("len", "prefix"), ("__len", "__prefix"))
    some = rows.where("__maybe").select("doc_id", F.col("__len").alias("len"), F.col("__prefix").alias("prefix"), F.sha2("__norm", 256).alias("full"), F.monotonically_increasing_id().alias("tag"))
    some = scratch.keep(some, "full-hashes")  # some 70 bytes a row; what follows reads no text of these
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag")
    groups = some.groupBy(*_KEYS).agg(F.min(row).alias("best"), F.count("*").alias("group_size")).where("group_size > 1")
    return rows, some, scratch.keep(groups.select(*_KEYS, "best", "group_size"), "groups")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept of every row; with `digest` also text_sha256, which rows without company get as they are put out."""
    rows, some, groups = _refined(docs, Scratch(docs.sparkSession), doc_id, text)
    found = some.join(groups, _KEYS, "left")
    alone = F.col("group_size").isNull()
    crowd = found.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("tag") == F.col("best.tag"))).alias("kept"), F.col("full").alias("text_sha256"),
    )
    single = rows.where("not __maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.sha2("__norm", 256).alias("text_sha256"))
    both = crowd.unionByName(single)
    return both if digest else both.drop("text_sha256")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Only texts with company are hashed, and only rows whose id may be that of a dropped row are shuffled.
    Where an id comes with different texts, a row is dropped only if its id and text are.
    """
    scratch, result = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    _, some, groups = _refined(docs, scratch, doc_id, text)
    told = some.join(groups, _KEYS).groupBy("doc_id", *_KEYS).agg(F.max((F.col("tag") == F.col("best.tag")).cast("int")).alias("best"), F.count("*").alias("n"))
    gone = told.where("best = 0 or n > 1").select(F.col("doc_id").alias("__id"), F.col("len").alias("__of_len"), F.col("full").alias("__full"), F.col("best").alias("__best"))
    gone = result.keep(gone, "gone")
    scratch.clear()
    whole = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), normalised(F.col(text)).alias("norm"))  # no name of docs can clash
    marked = _marked(whole, gone, ("__id",), ("id",))
    rest, maybe = marked.where("not __maybe").select("row"), marked.where("__maybe").select("row", "id", F.octet_length("norm").alias("size"), F.sha2("norm", 256).alias("hash"))
    met = maybe.join(gone, F.col("id").eqNullSafe(F.col("__id")) & (F.col("size") == F.col("__of_len")) & (F.col("hash") == F.col("__full")), "left")
    out = rest.unionByName(met.where("__best is null").select("row"))
    if not gone.where("__best = 1").isEmpty():  # rows that stay, but come more than once
        out = out.unionByName(met.where("__best = 1").dropDuplicates(["id", "hash"]).select("row"))
    return out.select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY d.doc_id) = 1 AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
