"""Readers: explicit schemas, strict and lenient variants, nested records with inherited fields."""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class EmptySource(ValueError):
    """A source without records."""


def _missing(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(e)


def json_records(spark: SparkSession, path: str, schema: str, wrappers: tuple[str, ...] = ("records", "data", "items"), bare: bool = False) -> DataFrame:
    """A JSON array, or the first list under one of the wrapper keys, or with `bare` an object that has none of these as one row.

    A source without records is an error, and so is a list with something else than objects in it.
    """
    text = spark.read.option("wholetext", True).text(path).select(F.regexp_replace("value", "^﻿", "").alias("v"))
    listed = F.from_json(F.col("v"), f"array<struct<{_fields(schema)}>>", {"mode": "PERMISSIVE"})
    wrapped = F.coalesce(*[F.from_json(F.get_json_object("v", f"$.{w}"), f"array<struct<{_fields(schema)}>>") for w in wrappers])
    one = F.when(F.lit(bare) & F.trim("v").startswith("{"), F.array(F.from_json("v", schema)))
    found = text.select("v", F.when(F.trim("v").startswith("["), listed).otherwise(F.coalesce(wrapped, one)).alias("l"))
    odd = F.exists(F.from_json("v", "array<string>"), lambda x: ~F.trim(x).startswith("{"))
    if not found.where((F.trim("v").startswith("[") & (F.col("l").isNull() | odd)) | F.exists("l", lambda x: x.isNull())).isEmpty():
        raise ValueError(f"a record isn't an object: {path}")
    rows = found.select(F.explode("l").alias("r")).select("r.*")
    if rows.isEmpty():
        raise EmptySource(path)
    return rows


def _fields(schema: str) -> str:
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema))


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; the first line that isn't one is an error that tells its number. Blank lines are skipped."""
    wide = StructType.fromDDL(schema).add("_corrupt_record", "string")
    bad = (F.trim("value") != "") & (~F.trim("value").startswith("{") | F.from_json("value", wide)["_corrupt_record"].isNotNull())
    lines = spark.read.text(path)
    if not lines.where(bad).isEmpty():
        numbered = lines.withColumn("wrong", F.coalesce(bad, F.lit(False))).rdd.zipWithIndex()  # only where the read fails anyway
        row, at = numbered.filter(lambda x: x[0]["wrong"]).first()
        raise ValueError(f"{path}: line {at + 1} is no object: {row['value'][:80]}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def lenient_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that are no objects are dropped."""
    wide = StructType.fromDDL(schema).add("_corrupt_record", "string")
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", wide).alias("r"))
    return lines.where("r is not null and r._corrupt_record is null").select("r.*").drop("_corrupt_record")


def optional_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A missing file has no rows."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], schema)


def by_suffix(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return strict_jsonl(spark, path, schema) if re.search(r"\.(jsonl|ndjson)$", path) else json_records(spark, path, schema, bare=True)


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; a byte order mark before the first name is dropped."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def find_records(payload, id_keys: tuple[str, ...] = ("id",)) -> list[dict]:
    """All objects at any depth that carry one of the keys; what is inside a found one isn't searched. For configuration-sized documents."""
    if isinstance(payload, dict):
        if any(k in payload for k in id_keys):
            return [payload]
        return [r for v in payload.values() for r in find_records(v, id_keys)]
    if isinstance(payload, list):
        return [r for v in payload for r in find_records(v, id_keys)]
    return []


def deep_first(payload, names: set[str]):
    """The first value under one of the names (compared without case and signs): this level's keys first, then depth-first."""
    if isinstance(payload, dict):
        for k, v in payload.items():
            if re.sub("[^a-z0-9]", "", k.lower()) in names and v not in (None, "", [], {}):
                return v
    for v in payload.values() if isinstance(payload, dict) else payload if isinstance(payload, list) else ():
        if (got := deep_first(v, names)) is not None:
            return got
    return None


def deep_field(raw: Column, *names: str) -> Column:
    """`deep_first` over a column of JSON texts, for ingest."""
    wanted = {re.sub("[^a-z0-9]", "", n.lower()) for n in names}

    @F.pandas_udf("string")
    def run(values):
        def one(v):
            got = deep_first(json.loads(v), wanted) if v else None
            return got if isinstance(got, str) or got is None else json.dumps(got)

        return values.map(one, na_action=None)

    return run(raw)


def aliased(raw: Column, *names: str) -> Column:
    """The first non-blank value of a JSON object under any of the names, compared without case and signs."""
    entries = F.map_entries(F.from_json(raw, "map<string,string>"))
    wanted = [re.sub("[^a-z0-9]", "", n.lower()) for n in names]
    hits = F.filter(entries, lambda e: F.regexp_replace(F.lower(e["key"]), "[^a-z0-9]", "").isin(*wanted) & (F.trim(F.coalesce(e["value"], F.lit(""))) != ""))
    return F.get(hits, 0)["value"]


def aliased_within(raw: Column, *names: str, inside: str = "profile") -> Column:
    """As `aliased`; where the object has nothing under these names, the object inside it is asked."""
    return F.coalesce(aliased(raw, *names), aliased(F.get_json_object(raw, f"$.{inside}"), *names))


def nested(df: DataFrame, array: str, inherit: dict[str, str]) -> DataFrame:
    """A row for each element; where an element lacks a field, it has the parent's. inherit: element field -> parent column."""
    rows = df.withColumn("__x", F.explode_outer(array))
    return rows.select("__x.*", *[F.col(p).alias(f"__{c}") for c, p in inherit.items()]).select(
        *[F.coalesce(F.col(f.name), F.col(f"__{f.name}")).alias(f.name) if f.name in inherit else F.col(f.name) for f in df.schema[array].dataType.elementType.fields]
    )


def evidence_pages(pages: Column) -> Column:
    """Evidence pages given as a map: its keys become the type of pages that have none."""
    return F.transform(F.map_entries(pages), lambda e: e["value"].withField("evidence_type", F.coalesce(F.nullif(F.trim(e["value"]["evidence_type"]), F.lit("")), e["key"])))


def alias_table(spark: SparkSession, text: str) -> DataFrame:
    """label, slug of a simple alias file: `slug:` lines with `- label` lines below. The file is configuration, parsed on the driver."""
    from matchloom.functions.text import department_text

    rows, slug = [], None
    for line in text.splitlines():
        if m := re.match(r"\s*([A-Za-z0-9_-]+):\s*$", line):
            slug = m[1].lower().replace("_", "-")
            rows.append((department_text(slug.replace("-", " ")), slug))
        elif slug and (m := re.match(r"\s*-\s*[\"']?(.*?)[\"']?\s*$", line)):
            rows.append((department_text(m[1]), slug))
    return spark.createDataFrame(sorted(set(rows)), "label string, slug string")
