"""Topic candidates of records: whose id is found in a chain of fields, whose topics come in many fields and shapes."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that may hold topics, and an id, in the order they are asked.
FIELDS = ("topics", "topic_keywords", "keywords", "research_keywords", "topic_names", "extracted_topics", "staff_topics", "expertise_topics", "research_interests_topics")
IDS = ("module_id", "staff_id", "course_id", "id", "module_code", "code", "slug", "url", "name", "title")
#: Topics that say nothing, and words that don't make one.
GENERIC = (
    "research", "teaching", "education", "university", "academic", "module", "course", "student", "students", "learning", "learn", "lecture", "lectures", "seminar", "seminars", "topic", "topics", "knowledge", "skills", "skill",
    "study", "studies", "introduction", "advanced topics", "fundamentals", "fundamental", "principles", "principle", "applications", "application", "methods", "method", "methodologies", "methodology", "systems", "system",
    "technology", "technologies", "technique", "techniques",
)
STOP = ("and", "or", "of", "for", "in", "on", "to", "with", "the", "a", "an", "by", "from", "at", "into", "about", "using", "use", "based")
#: Words of a lemma table at most; more is an error. Every task holds them.
MOST_LEMMAS = 2_000_000


def cleaned(text: str) -> str:
    """Folded ASCII; names of languages survive, other signs are spaces."""
    s = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    s = re.sub(r"\bc\+\+\b|\bc\s*\+\+", "cpp", s)
    s = re.sub(r"\.net\b", "dotnet", re.sub(r"\bc#\b|\bc\s*#", "csharp", s))
    s = re.sub(r"[_\-]+", " ", re.sub(r"[/|]", " ", s.replace("&", " and ")))
    return " ".join(re.sub(r"[^\w\s]", " ", s).split())


def normalised(clean: str, lemmas: dict[str, str], stop: frozenset[str]) -> str:
    """Lemmas of a clean text's words, without stop words and numbers."""
    found = (lemmas.get(w, w) for w in clean.split())
    return " ".join(w for w in found if w and w not in stop and not re.fullmatch(r"\d+", w))


def valid(topic: str, generic: frozenset[str], stop: frozenset[str], least: int, most: int) -> bool:
    words = topic.split()
    return bool(topic) and topic not in generic and least <= len(words) <= most and len(topic) >= 2 and not re.fullmatch(r"\d+", topic) and not all(w in stop for w in words)


def lemma_table(lemmas: DataFrame) -> dict[str, str]:
    """word -> lemma of a table (word, lemma) whose size is bounded; of several lemmas of a word the first by letters."""
    rows = lemmas.groupBy(F.lower("word").alias("word")).agg(F.min(F.lower("lemma")).alias("lemma")).where("word <> lemma").limit(MOST_LEMMAS + 1).toPandas()
    if len(rows) > MOST_LEMMAS:
        raise ValueError(f"more than {MOST_LEMMAS} lemmas")
    return dict(zip(rows["word"], rows["lemma"]))


def record_id(records: DataFrame, ids: tuple[str, ...] = IDS) -> Column:
    """The first id field that says something, else a digest of the whole record as JSON with sorted keys."""
    have = [i for i in ids if i in records.columns]
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(records.columns)]))

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else hashlib.md5(json.dumps(json.loads(t), sort_keys=True).encode()).hexdigest())

    named = F.coalesce(*[F.nullif(F.col(i).cast("string"), F.lit("")) for i in have]) if have else F.lit(None).cast("string")
    return F.coalesce(named, digest(F.when(named.isNull(), whole)))


def _values(field: str, kind: str) -> Column:
    """Array of (text, weight) of a field: a text, an array of texts, or an array of records with topic, label or name and weight or score."""
    c = F.col(field)
    pair = lambda text, weight: F.struct(F.trim(text).alias("text"), weight.cast("double").alias("weight"))
    one = F.lit(1.0)
    if kind == "string":
        out = F.array(pair(c, one))
    elif kind == "array<string>":
        out = F.transform(c, lambda x: pair(x, one))
    elif kind.startswith("array<struct<"):
        have = [p.split(":")[0] for p in re.split(r",(?![^<]*>)", kind[len("array<struct<") : -2])]
        text = next((k for k in ("topic", "label", "name") if k in have), None)
        weight = next((k for k in ("weight", "score") if k in have), None)
        if text is None:
            raise ValueError(f"{field} has neither topic, label nor name")
        out = F.transform(c, lambda x: pair(x[text].cast("string"), F.coalesce(x[weight].try_cast("double"), one) if weight else one))
    else:
        raise ValueError(f"{field} can't hold topics as {kind}")
    return F.filter(F.coalesce(out, F.array().cast("array<struct<text:string,weight:double>>")), lambda x: F.coalesce(x["text"], F.lit("")) != "")


def candidates(records: DataFrame, source_type: str, lemmas: dict[str, str] | None = None, fields: tuple[str, ...] = FIELDS, ids: tuple[str, ...] = IDS, generic: tuple[str, ...] = GENERIC, stop: tuple[str, ...] = STOP, words: tuple[int, int] = (1, 8)) -> DataFrame:
    """record_id, source_type, field, place (the field's), original_text, cleaned_text, topic, weight of every value that makes a topic.

    Null and blank values make none; a field that records lack is passed over. Texts are cleaned in Arrow batches where they are read.
    """
    kinds, have = dict(records.dtypes), [f for f in fields if f in records.columns]

    def entry(field: str, place: int):
        return lambda v: F.struct(F.lit(field).alias("field"), F.lit(place).alias("place"), v["text"].alias("original_text"), v["weight"].alias("weight"))

    told = [F.transform(_values(f, kinds[f]), entry(f, i)) for i, f in enumerate(have)]
    if not told:
        return records.sparkSession.createDataFrame([], "record_id string, source_type string, field string, place int, original_text string, cleaned_text string, topic string, weight double")
    # ids are made before values are taken apart, and of a record only its id goes with each value
    listed = records.select(record_id(records, ids).alias("record_id"), reduce(lambda a, b: F.concat(a, b), told).alias("__all"))
    each = listed.select("record_id", F.explode("__all").alias("v")).select("record_id", "v.*")
    known, drop, least_most = dict(lemmas or {}), frozenset(stop), words
    plain = frozenset(x.strip().lower() for x in generic)

    @F.pandas_udf("cleaned_text string, topic string")
    def made(texts: pd.Series) -> pd.DataFrame:
        clean = texts.map(cleaned)
        topics = clean.map(lambda c: normalised(c, known, drop))
        return pd.DataFrame({"cleaned_text": clean, "topic": topics.where(topics.map(lambda t: valid(t, plain, drop, *least_most)), None)})

    # not deterministic, so that the filter below isn't moved before it, where it would clean each text a second time
    out = each.withColumn("__m", made.asNondeterministic()("original_text")).select("record_id", F.lit(source_type).alias("source_type"), "field", "place", "original_text", "__m.*", "weight")
    return out.where("topic is not null")
