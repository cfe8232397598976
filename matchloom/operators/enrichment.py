"""Publication metadata from two providers: parsing, merging, caching and resuming."""

from __future__ import annotations

import json
import time
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.text import collapse, distinct_parts, rebuilt

#: Outcomes after which a record isn't asked for again.
FINAL = ("enriched", "metadata_not_found", "no_doi")
RETRIED = (429, 500, 502, 503, 504)

CROSSREF = "title array<string>, abstract string, type string, subject array<string>, published struct<`date-parts`:array<array<int>>>, issued struct<`date-parts`:array<array<int>>>, author array<struct<given:string,family:string,ORCID:string,affiliation:array<struct<name:string>>>>, license array<struct<URL:string>>, publisher string, `container-title` array<string>, `reference-count` int, `is-referenced-by-count` int, URL string, resource struct<primary:struct<URL:string>>, language string"
OPENALEX = "display_name string, publication_year int, type string, abstract_inverted_index map<string,array<bigint>>, topics array<struct<id:string,display_name:string,score:double,subfield:struct<display_name:string>,field:struct<display_name:string>,domain:struct<display_name:string>>>, keywords array<struct<display_name:string,score:double>>, id string, cited_by_count int, open_access struct<is_oa:boolean>"


class Provider(Protocol):
    """Answers (HTTP status, body) or (HTTP status, body, headers) for a DOI; the network adapter and the fixture of the tests both do."""

    def get(self, doi: str) -> tuple[int, str] | tuple[int, str, dict[str, str]]: ...


def ask(provider: Provider, doi: str, tries: int = 4, wait=time.sleep) -> tuple[str, int, str]:
    """(status, HTTP status, body): success, not_found, http_error, network_error or invalid_response (no JSON object, or one whose message is none).

    Busy servers are asked again after the whole seconds that they name in Retry-After, else after 1, 2, 4 seconds and so on, 30 at most.
    """
    code, body = 0, ""
    for n in range(tries):
        try:
            code, body, *more = provider.get(doi)
        except OSError:
            code, body, more = 0, "", []
        if code and code not in RETRIED:
            break
        if n + 1 < tries:
            named = next((v for k, v in (more[0] if more else {}).items() if k.lower() == "retry-after"), "")
            wait(float(named) if named.isascii() and named.isdigit() else min(2**n, 30))
    if code == 404:
        return "not_found", code, ""
    if not code:
        return "network_error", 0, ""
    if code != 200:
        return "http_error", code, ""
    try:
        told = json.loads(body)
    except ValueError:
        return "invalid_response", code, ""
    if not isinstance(told, dict) or not isinstance(told.get("message", {}), dict):
        return "invalid_response", code, ""
    return "success", code, body


_CACHE = "key string, doi string, status string, http_status int, body string"


def cache_key(doi: Column) -> Column:
    return F.sha2(F.lower(doi), 256)


def cached(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_CACHE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _CACHE)


def fetch(dois: DataFrame, provider: Provider, path: str, lanes: int = 4) -> DataFrame:
    """Answers for distinct DOIs through a cache table: only unknown ones are asked for, at most `lanes` at a time."""
    spark = dois.sparkSession
    wanted = dois.where("doi <> ''").select(F.lower("doi").alias("doi")).distinct().withColumn("key", cache_key(F.col("doi")))
    new = wanted.join(cached(spark, path).where(F.col("status").isin("success", "not_found")), "key", "left_anti").repartition(lanes)

    def run(frames):
        for f in frames:
            got = [ask(provider, d) for d in f["doi"]]
            yield f.assign(status=[g[0] for g in got], http_status=[g[1] for g in got], body=[g[2] for g in got])[["key", "doi", "status", "http_status", "body"]]

    new.select("key", "doi").mapInPandas(run, _CACHE).write.mode("append").parquet(path)
    w = F.max_by(F.struct("status", "http_status", "body"), F.when(F.col("status") == "success", 1).otherwise(0))
    return wanted.select("key").join(cached(spark, path), "key").groupBy("doi").agg(w.alias("r")).select("doi", "r.*")


def parse_crossref(body: Column) -> Column:
    """Fields of a message, bare or within its envelope."""
    m = F.from_json(F.coalesce(F.get_json_object(body, "$.message"), body), CROSSREF)
    none = F.array().cast("array<string>")
    texts = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, none), collapse), lambda x: x != ""))
    author = F.transform(m["author"], lambda a: F.struct(collapse(a["given"]).alias("given_name"), collapse(a["family"]).alias("family_name"), F.trim(F.concat_ws(" ", collapse(a["given"]), collapse(a["family"]))).alias("full_name"), collapse(a["ORCID"]).alias("orcid"), F.filter(F.transform(F.coalesce(a["affiliation"]["name"], none), collapse), lambda x: x != "").alias("affiliations")))
    year = F.coalesce(m["published"]["date-parts"][0][0], m["issued"]["date-parts"][0][0])
    names = F.transform(m["author"], lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"])))
    return F.struct(collapse(F.get(m["title"], 0)).alias("title"), collapse(F.regexp_replace(m["abstract"], "<[^>]+>", " ")).alias("abstract"), year.alias("year"), m["type"].alias("type"), names.alias("authors"), texts(m["subject"]).alias("subjects"),
        texts(m["license"]["URL"]).alias("licenses"), author.alias("people"), collapse(m["publisher"]).alias("publisher"), collapse(F.get(m["container-title"], 0)).alias("container_title"), m["reference-count"].alias("reference_count"),
        m["is-referenced-by-count"].alias("is_referenced_by_count"), collapse(m["URL"]).alias("url"), collapse(m["resource"]["primary"]["URL"]).alias("primary_resource_url"), collapse(m["language"]).alias("language"))


def parse_openalex(body: Column) -> Column:
    m = F.from_json(body, OPENALEX)
    names = lambda c: F.coalesce(F.transform(c, lambda x: x["display_name"]), F.array().cast("array<string>"))
    return F.struct(collapse(m["display_name"]).alias("title"), rebuilt(m["abstract_inverted_index"]).alias("abstract"), m["publication_year"].alias("year"), m["type"].alias("type"), names(m["topics"]).alias("topics"), names(m["keywords"]).alias("keywords"),
        F.transform(m["topics"], lambda t: F.struct(collapse(t["id"]).alias("id"), collapse(t["display_name"]).alias("name"), t["score"].alias("score"), *[collapse(t[k]["display_name"]).alias(k) for k in ("subfield", "field", "domain")])).alias("topic_records"),
        F.coalesce(m["open_access"]["is_oa"], F.lit(False)).alias("is_open_access"), m["cited_by_count"].alias("cited_by_count"), collapse(m["id"]).alias("openalex_id"))


def first_nonempty(**sources: Column) -> tuple[Column, Column]:
    """(value, name of the source it came from)."""
    value = F.coalesce(*[F.nullif(collapse(c.cast("string")), F.lit("")) for c in sources.values()], F.lit(""))
    name = F.coalesce(*[F.when(collapse(c.cast("string")) != "", F.lit(k)) for k, c in sources.items()])
    return value, name


def merge(publications: DataFrame, crossref: DataFrame, openalex: DataFrame) -> DataFrame:
    """Publications (publication_id, doi, title, year) with what the providers add, where each field came from, and a status.

    Title, year and type: original, then the first provider, then the second; abstracts: first, then second provider.
    """
    p = publications.withColumn("doi", F.lower(F.coalesce("doi", F.lit(""))))
    c = crossref.select("doi", F.col("status").alias("c_status"), parse_crossref(F.col("body")).alias("c"))
    o = openalex.select("doi", F.col("status").alias("o_status"), parse_openalex(F.col("body")).alias("o"))
    both = p.join(c, "doi", "left").join(o, "doi", "left")
    title, t_from = first_nonempty(original=F.col("title"), crossref=F.col("c.title"), openalex=F.col("o.title"))
    year, y_from = first_nonempty(original=F.col("year"), crossref=F.col("c.year"), openalex=F.col("o.year"))
    abstract, a_from = first_nonempty(crossref=F.col("c.abstract"), openalex=F.col("o.abstract"))
    ok = (F.coalesce("c_status", F.lit("")) == "success") | (F.coalesce("o_status", F.lit("")) == "success")
    gone = (F.coalesce("c_status", F.lit("not_found")) == "not_found") & (F.coalesce("o_status", F.lit("not_found")) == "not_found")
    status = F.when(F.col("doi") == "", "no_doi").when(ok, "enriched").when(gone, "metadata_not_found").otherwise("retrieval_error")
    none = F.array().cast("array<string>")
    return both.select(
        "publication_id", "doi", title.alias("title"), year.alias("year"), abstract.alias("abstract"), distinct_parts(F.concat(F.coalesce("c.subjects", none), F.coalesce("o.topics", none))).alias("topics"),
        distinct_parts(F.coalesce("o.keywords", none)).alias("keywords"), F.map_from_arrays(F.array(F.lit("title"), F.lit("year"), F.lit("abstract")), F.array(t_from, y_from, a_from)).alias("field_sources"), status.alias("status"),
        F.coalesce("c.licenses", none).alias("licenses"), F.coalesce("o.is_open_access", F.lit(False)).alias("is_open_access"),
    )


def pending(publications: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Publications without a final outcome yet, in the order of their ids; a limit is the caller's batch size."""
    left = publications.join(done.where(F.col("status").isin(*FINAL)).select("publication_id"), "publication_id", "left_anti")
    return left.orderBy("publication_id").limit(limit) if limit is not None else left


def roll_up(staff: DataFrame, links: DataFrame, publications: DataFrame) -> DataFrame:
    """staff_id, publications, enriched, titles, abstracts, topics, keywords; people without links stay. Newest first, then by id."""
    order = F.struct((-F.coalesce(F.col("year").try_cast("int"), F.lit(0))).alias("y"), "publication_id", "title", "abstract", "topics", "keywords", "status")
    each = links.join(publications, "publication_id").groupBy("staff_id").agg(F.array_sort(F.collect_list(order)).alias("p"))
    none = F.array().cast("array<string>")
    joined = staff.select("staff_id").join(each, "staff_id", "left")
    text = lambda c: F.array_join(distinct_parts(F.coalesce(F.transform("p", lambda x: x[c]), none)), " ")
    names = lambda c: F.array_join(distinct_parts(F.coalesce(F.flatten(F.transform("p", lambda x: x[c])), none)), " ")
    enriched = F.coalesce(F.size(F.filter("p", lambda x: x["status"] == "enriched")), F.lit(0))
    return joined.select("staff_id", F.coalesce(F.when(F.col("p").isNull(), 0).otherwise(F.size("p")), F.lit(0)).cast("long").alias("publications"), F.when(F.col("p").isNull(), 0).otherwise(enriched).cast("long").alias("enriched"), text("title").alias("titles"), text("abstract").alias("abstracts"), names("topics").alias("topics"), names("keywords").alias("keywords"))
