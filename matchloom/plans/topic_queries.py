"""Queries: topics, graph, ingest shapes and enrichment."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from matchloom.operators import enrichment as N
from matchloom.operators import semantic
from matchloom.operators import topic_records as TR
from matchloom.operators import topics as T
from matchloom.plans.catalog import query
from matchloom.plans.roles import MODULE_SQL, SCORE_SQL, STAFF_SQL, modules, scores, staff
from matchloom.session import scratch
from matchloom.sources import readers, sinks
from matchloom.tables import table

_STOP = ", ".join(f"'{w}'" for w in (*T.STOP, *T.NOISE))
_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(coalesce(text, '')), '&', ' and '), '[/|_]', ' ', 'g'), '[^a-z0-9\-+.\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_TOKEN_SQL = rf"""sen AS (SELECT item_id, unnest(generate_series(1, len(p))) AS s, p FROM (SELECT item_id, string_split_regex({_CLEAN}, '[.;:\n\r]+') AS p FROM benchmark)),
tok AS (SELECT item_id, s, list_filter(list_transform(regexp_extract_all(p[s], '[a-z0-9][a-z0-9\-+.]*'), lambda t: regexp_replace(t, '^[-+.]+|[-+.]+$', '', 'g')), lambda t: length(t) >= 3 AND t NOT IN ({_STOP}) AND NOT regexp_matches(t, '^\d+$') AND NOT regexp_matches(t, '^[a-z]{{1,6}}\d{{1,8}}[a-z0-9\-]*$')) AS t FROM sen)"""


@query("g1_g3_tokens", f"WITH {_TOKEN_SQL} SELECT item_id, CAST(sum(len(t)) AS BIGINT) AS n, string_agg(array_to_string(t, ' '), '.' ORDER BY s) AS said FROM tok GROUP BY item_id")
def _(spark, sf):
    from matchloom.functions.text import topic_text

    s = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split(topic_text(F.col("text")), r"[.;:\n\r]+")).alias("s", "p")).select("item_id", "s", T.words(F.col("p")).alias("t"))
    parts = F.array_sort(F.collect_list(F.struct("s", F.array_join("t", " ").alias("x"))))
    return s.groupBy("item_id").agg(F.sum(F.size("t")).alias("n"), F.array_join(F.transform(parts, lambda x: x["x"]), ".").alias("said"))


_GRAM_SQL = f"""{_TOKEN_SQL}, gram AS (SELECT item_id, unnest(list_concat(list_concat(t, CASE WHEN len(t) >= 2 THEN list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END), CASE WHEN len(t) >= 3 THEN list_transform(generate_series(1, len(t) - 2), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) ELSE [] END)) AS topic FROM tok),
cnt AS (SELECT item_id, topic, count(*) AS score, len(string_split(topic, ' ')) AS nw FROM gram WHERE length(topic) >= 5 AND topic NOT IN ({", ".join(f"'{w}'" for w in T.GENERAL)}) AND (contains(topic, ' ') OR topic IN ({", ".join(f"'{w}'" for w in T.SINGLE)})) GROUP BY ALL)"""


@query("g5_g8_topics", f"WITH {_GRAM_SQL} SELECT item_id, topic, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, nw DESC, topic) AS rank FROM cnt WHERE score >= 2 AND (nw < 3 OR score >= 3)) WHERE rank <= 10")
def _(spark, sf):
    found = T.extract(table(spark, sf, "benchmark"), "item_id", "text")
    return found.select("item_id", "topic", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("g4_g7_explicit", f"""WITH {STAFF_SQL}, w AS (SELECT staff_id, list_filter(string_split(lower(position), ' '), lambda x: length(x) >= 3 AND x NOT IN ({_STOP})) AS t FROM staff)
SELECT staff_id, array_to_string(t, ' ') AS topic, CAST(14 AS BIGINT) AS score FROM w WHERE len(t) = 2 UNION ALL SELECT staff_id, x, CAST(CASE WHEN n = 1 THEN 14 ELSE 2 END AS BIGINT) FROM (SELECT staff_id, unnest(t) AS x, len(t) AS n FROM w) WHERE x IN ({", ".join(f"'{w}'" for w in T.SINGLE)})""")
def _(spark, sf):
    """A person's position, said twice and given as explicit, which weighs 12; words of the person's name are in no topic."""
    people = staff(spark, sf).select("staff_id", "position", F.split(F.lower("full_name"), "[^a-z]+").alias("name"), F.concat_ws(" ", "full_name", "position", F.lit("."), "position").alias("text"))
    found = T.extract(people, "staff_id", "text", F.array("position"), F.filter("name", lambda x: x != ""), least=2)
    return found.select("staff_id", "topic", F.col("score").cast("long").alias("score"))


_REJECT = """CASE WHEN p_partkey % 6 = 0 THEN 'empty_topic' WHEN p_partkey % 6 = 1 THEN 'too_short_or_generic_single_token' WHEN p_partkey % 6 = 2 THEN 'location_or_institution_term' WHEN p_partkey % 6 = 3 THEN 'generic_low_value_phrase' WHEN p_partkey % 6 = 4 THEN 'likely_broken_phrase_order' END"""


def _said(spark, sf):
    k = F.col("p_partkey") % 6
    said = F.when(k == 0, " ").when(k == 1, "systems").when(k == 2, F.concat(F.lit("school of "), "p_name")).when(k == 3, "Applied-methods: practice").when(k == 4, "generation of energy").otherwise(F.col("p_name"))
    said = F.when(k == 3, "methods, practice").otherwise(said)
    return table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 50).alias("entity"), said.alias("topic"))


@query("p16_topic_rejection", f"SELECT p_partkey, {_REJECT} AS reason FROM part")
def _(spark, sf):
    return _said(spark, sf).select("p_partkey", T.rejection(F.col("topic")).alias("reason"))


@query("p17_profile_filter", """SELECT p_partkey % 50 AS entity, count(*) AS kept FROM part WHERE p_partkey % 6 = 5 GROUP BY 1""")
def _(spark, sf):
    good, _ = T.split_profiles(_said(spark, sf), "entity")
    return good.select("entity", F.col("topic_count").alias("kept")).distinct()


@query("g9_g10_graph", f"WITH {STAFF_SQL}, {MODULE_SQL} SELECT 'staff:' || replace(lower(full_name), '#', '#') AS source, 'department:' || lower(department) AS target FROM staff UNION SELECT 'module:' || lower(module_code), 'department:' || lower(department) FROM module")
def _(spark, sf):
    s, m = staff(spark, sf), modules(spark, sf)
    _, edges = T.graph({"department": (s, "department")}, {"works_in": (s, "staff", "full_name", "department", "department"), "owned_by": (m, "module", "module_code", "department", "department")})
    return edges.select("source", "target")


@query("a19_graph_summary", f"WITH {STAFF_SQL}, {MODULE_SQL} SELECT 'college' AS kind, count(DISTINCT college) AS n FROM staff UNION ALL SELECT 'department', count(DISTINCT department) FROM staff UNION ALL SELECT 'module', count(DISTINCT lower(module_code)) FROM module")
def _(spark, sf):
    s, m = staff(spark, sf), modules(spark, sf)
    nodes, _ = T.graph({"college": (s, "college"), "department": (s, "department"), "module": (m, "module_code")}, {"owned_by": (m, "module", "module_code", "department", "department")})
    return nodes.groupBy(F.col("node_type").alias("kind")).agg(F.count("*").alias("n"))


def _clusters(spark, sf):
    labels = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("label")).distinct()
    return labels, T.greedy_clusters(semantic.encode(labels, "label", "label", semantic.HashingEncoder()), 0.6)


@query("t16_greedy_clusters")
def _(spark, sf):
    return _clusters(spark, sf)[1].select("label", "cluster")


@query("t17_canonical_labels")
def _(spark, sf):
    return T.canonical(_clusters(spark, sf)[1])


@query("t13_t14_t15_candidates", """SELECT p_partkey, 'name' AS field, lower(p_name) AS topic FROM part UNION SELECT p_partkey, 'type', lower(p_type) FROM part WHERE p_type <> 'PROMO'""")
def _(spark, sf):
    """Topics from three fields, of which sizes are mere digits; promotions are general."""
    fields = {"name": F.col("p_name"), "type": F.col("p_type"), "size": F.format_string("%03d", "p_size")}
    return T.candidates(table(spark, sf, "part"), "p_partkey", fields, ["promo", "general"]).select("p_partkey", "field", "topic")


_TOPIC_SQL = rf"""lem AS (SELECT word, CASE WHEN word LIKE '%s' THEN word[:length(word) - 1] ELSE word[:length(word) - 1] || 'ing' END AS lemma FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{5,}}')) AS word FROM benchmark) WHERE word LIKE '%s' OR word LIKE '%e'), lm AS (SELECT map(list(word), list(lemma)) AS m FROM lem),
raw AS (SELECT CASE WHEN doc_id % 3 > 0 THEN 'd' || CAST(doc_id AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) END AS record_id, 'topics' AS field, 0 AS place, trim(coalesce(source, '')) || ' C++ & .NET' AS original_text, CASE WHEN n_chars % 2 = 0 THEN 2.5 ELSE 1.0 END AS weight FROM documents
 UNION ALL SELECT CASE WHEN doc_id % 3 > 0 THEN 'd' || CAST(doc_id AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) END, 'keywords', 1, trim(unnest(string_split_regex(coalesce(text, ''), '[.|,;\n]'))), 1.0 FROM documents),
c AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(original_text)), '[^\x00-\x7F]', '', 'g'), '\bc\+\+\b|\bc\s*\+\+', 'cpp', 'g'), '\bc#\b|\bc\s*#', 'csharp', 'g'), '\.net\b', 'dotnet', 'g'), '&', ' and '), '[/|]', ' ', 'g'), '[_\-]+', ' ', 'g'), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS cleaned_text FROM raw WHERE original_text <> ''),
n AS (SELECT *, array_to_string(list_filter(list_transform(string_split(cleaned_text, ' '), lambda w: coalesce(m[w], w)), lambda w: w <> '' AND w NOT IN ({", ".join(f"'{w}'" for w in TR.STOP)}) AND NOT regexp_full_match(w, '[0-9]+')), ' ') AS topic FROM c, lm)"""


@query("t13_t15_record_topics", f"WITH {_TOPIC_SQL} SELECT record_id, field, place, original_text, cleaned_text, topic, CAST(weight AS DOUBLE) AS weight FROM n WHERE topic <> '' AND length(topic) >= 2 AND len(string_split(topic, ' ')) <= 8 AND topic NOT IN ({', '.join(f'{chr(39)}{w}{chr(39)}' for w in TR.GENERIC)})")
def _(spark, sf):
    """Every sentence of every document as a keyword, its source as a weighted topic, with lemmas of the benchmark's words."""
    docs = table(spark, sf, "documents")
    word = F.col("word")
    found = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"))).alias("word")).distinct().where(word.endswith("s") | word.endswith("e"))
    short = F.substring("word", F.lit(1), F.length("word") - 1)
    lemmas = TR.lemma_table(found.withColumn("lemma", F.when(word.endswith("s"), short).otherwise(F.concat(short, F.lit("ing")))))
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    records = docs.select(
        F.lit("").alias("module_id"), F.when(i % 3 > 0, F.concat(F.lit("d"), i.cast("string"))).alias("staff_id"), i.alias("id"),
        F.array(F.struct(F.concat(F.trim(F.coalesce("source", F.lit(""))), F.lit(" C++ & .NET")).alias("topic"), F.when(F.col("n_chars") % 2 == 0, "2.5").otherwise("heavy").alias("weight")), F.struct(none.alias("topic"), F.lit("1").alias("weight"))).alias("topics"),
        F.split(F.coalesce("text", F.lit("")), r"[.|,;\n]").alias("keywords"),
    )
    return TR.candidates(records, "staff", lemmas).drop("source_type")


@query("t18_assignments", """SELECT DISTINCT p_partkey AS record, split_part(p_name, ' ', 2) AS canonical FROM part""")
def _(spark, sf):
    p = table(spark, sf, "part")
    candidates = p.select(F.col("p_partkey").alias("record"), F.lit("name").alias("field"), F.lit(0).alias("place"), F.col("p_name").alias("label")).unionByName(p.select(F.col("p_partkey").alias("record"), F.lit("again").alias("field"), F.lit(1).alias("place"), F.col("p_name").alias("label")))
    chosen = p.select(F.col("p_name").alias("label"), F.element_at(F.split("p_name", " "), 2).alias("canonical")).distinct()
    return T.assignments(candidates, chosen).select("record", "canonical")


# ---- ingest --------------------------------------------------------------------------------------


@query("s7_s8_p1_aliases", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, event_type AS kind FROM events""")
def _(spark, sf):
    """A JSON field by any of its names, and nested rows that take what they lack from their parent."""
    item = F.array(F.struct(readers.aliased(F.col("props"), "K", "key").alias("k"), F.lit(None).cast("string").alias("kind")))
    rows = table(spark, sf, "events").select("event_id", "event_type", item.alias("items"))
    rows = rows.withColumn("items", F.transform("items", lambda x: x.withField("event_id", F.col("event_id"))))
    return readers.nested(rows, "items", {"kind": "event_type"}).select("event_id", "k", "kind")


@query("p3_deep_lookup", """SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def _(spark, sf):
    wrapped = F.concat(F.lit('{"outer": [{"x": 1}, {"inner": '), "props", F.lit("}]}"))
    return table(spark, sf, "events").select("event_id", readers.deep_field(wrapped, "k").alias("k"))


@query("p7_p8_evidence", """SELECT conv_id, string_agg(CAST(length(text) AS VARCHAR), ',' ORDER BY turn) AS sizes, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def _(spark, sf):
    rows = table(spark, sf, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("x"))
    return rows.select("conv_id", F.array_join(F.transform("x", lambda t: t["n"].cast("string")), ",").alias("sizes"), F.size("x").cast("long").alias("n"))


@query("p9_p10_flags", """SELECT conv_id, bool_or(role = 'user') AS asked, bool_or(contains(text, '?')) AS question, bool_or(length(text) > 400) AS long FROM conversations GROUP BY conv_id""")
def _(spark, sf):
    pages = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", F.contains("text", F.lit("?")).alias("q"), (F.length("text") > 400).alias("l"))).alias("p"))
    some = lambda f: F.exists("p", f)
    return pages.select("conv_id", some(lambda x: x["role"] == "user").alias("asked"), some(lambda x: x["q"]).alias("question"), some(lambda x: x["l"]).alias("long"))


@query("p5_p6_flatten", """SELECT l_orderkey, l_partkey, l_returnflag, min(l_linenumber) AS first_line FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    """Link rows by identity: of those with the same order, part and flag the first stays."""
    from matchloom.operators.ranking import best

    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", F.col("l_linenumber").alias("first_line"))
    return best(lines, ["l_orderkey", "l_partkey", "l_returnflag"], [F.col("first_line")])


@query("a10_context_sets", """SELECT l_partkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_partkey""")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), F.count_distinct("l_orderkey").alias("orders"))


@query("a24_key_paths", """SELECT k AS path, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k""")
def _(spark, sf):
    return table(spark, sf, "events").select(F.explode(F.json_object_keys("props")).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


@query("s22_web_bundle", f"WITH {SCORE_SQL}, t AS (SELECT module_id, staff_id, row_number() OVER (PARTITION BY module_id ORDER BY score DESC, staff_id) AS k FROM score) SELECT module_id, staff_id, coalesce(n, 0) AS n_links FROM t LEFT JOIN (SELECT l_partkey AS module_id, count(*) AS n FROM lineitem GROUP BY 1) USING (module_id) WHERE k = 1")
def _(spark, sf):
    from matchloom.operators.ranking import best

    one = best(scores(spark, sf), ["module_id"], [F.desc("score"), F.col("staff_id")]).select("module_id", "staff_id")
    links = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("module_id"), "l_orderkey", "l_linenumber")
    return sinks.bundle(None, one, links).select("module_id", "staff_id", F.size("links").cast("long").alias("n_links"))


def _written(spark, df, kind: str) -> str:
    """A source to read: df written in the shared folder."""
    path = scratch(spark, f"source-{kind}")
    {"text": df.write.text, "json": df.write.json}[kind](path)
    return path


@query("s1_json_array", "SELECT n_nationkey, n_name FROM nation")
def _(spark, sf):
    """A list under a wrapper key; the nations are a catalogue of fixed size."""
    listed = F.concat(F.lit('{"meta": 1, "data": '), F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))), F.lit("}"))
    return readers.json_records(spark, _written(spark, table(spark, sf, "nation").agg(listed.alias("value")), "text"), "n_nationkey bigint, n_name string")


@query("s2_s5_strict_lines", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def _(spark, sf):
    path = _written(spark, table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "json")
    return readers.strict_jsonl(spark, path, "o_orderkey bigint, o_custkey bigint, o_orderpriority string")


@query("s3_lenient_lines", "SELECT p_partkey, p_name FROM part WHERE p_type <> 'PROMO'")
def _(spark, sf):
    """Promoted parts are written as lists and broken lines, which are no objects."""
    good = F.to_json(F.struct("p_partkey", "p_name"))
    line = F.when(F.col("p_type") != "PROMO", good).when(F.col("p_size") > 25, F.concat(F.lit("["), good, F.lit("]"))).otherwise(F.substring(good, 1, 12))
    return readers.lenient_jsonl(spark, _written(spark, table(spark, sf, "part").select(line.alias("value")), "text"), "p_partkey bigint, p_name string")


@query("s4_optional_lines", "SELECT event_id, event_type FROM events")
def _(spark, sf):
    """A source that is there and one that is missing."""
    path, schema = scratch(spark, "source-lines"), "event_id bigint, event_type string"
    table(spark, sf, "events").select("event_id", "event_type").write.json(path)
    return readers.optional_jsonl(spark, path, schema).unionByName(readers.optional_jsonl(spark, scratch(spark, "source-missing"), schema))


@query("s6_bare_object", "SELECT count(*) AS orders, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders")
def _(spark, sf):
    one = table(spark, sf, "orders").agg(F.to_json(F.struct(F.count("*").alias("orders"), F.sum("o_custkey").alias("total"))).alias("value"))
    return readers.by_suffix(spark, _written(spark, one, "text"), "orders bigint, total bigint")


@query("s9_s18_csv", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, sf):
    """Written with a byte order mark and read without it; a column that isn't there is ignored."""
    path = scratch(spark, "source-csv")
    sinks.csv(table(spark, sf, "customer"), path, ["c_custkey", "c_name", "not_there", "c_mktsegment"])
    return readers.csv_table(spark, path, "c_custkey bigint, c_name string, c_mktsegment string")


@query("p2_profile_fallback", "SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS kind FROM events")
def _(spark, sf):
    """What an object lacks is looked up in its profile."""
    deep = F.concat(F.lit('{"K": " ", "profile": '), "props", F.lit("}"))
    raw = F.when(F.col("event_type") == "error", deep).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", readers.aliased_within(raw, "k").alias("k"), F.col("event_type").alias("kind"))


@query("p4_blank_values", "SELECT event_id, event_type IN ('click', 'error') AS blank FROM events")
def _(spark, sf):
    from matchloom.functions.text import is_blank_json

    said = F.when(F.col("event_type") == "click", " [ ] ").when(F.col("event_type") == "error", "{}").otherwise(F.when(F.col("value") > 50, F.lit("0")).otherwise(F.col("props")))
    return table(spark, sf, "events").select("event_id", is_blank_json(said).alias("blank"))


@query("s12_s20_vectors", "SELECT vec_id, 'core' AS field, len(embedding) AS n FROM embeddings")
def _(spark, sf):
    """A bundle of vectors, stored and read back with its checks."""
    path = scratch(spark, "vectors")
    e = table(spark, sf, "embeddings")
    sinks.save_vectors(e.select(F.lit("staff").alias("entity"), F.col("vec_id").alias("id"), F.lit("core").alias("field"), F.col("embedding").alias("vector")), path)
    back = sinks.load_vectors(spark, path, {"core": 1.0}, 64)
    return back.select(F.col("id").alias("vec_id"), "field", F.size("vector").cast("long").alias("n"))


@query("s17_swapped", "SELECT o_orderkey, o_custkey FROM orders")
def _(spark, sf):
    """A table written over another one in one move."""
    path = scratch(spark, "swapped")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    sinks.swapped(orders.where("o_custkey = 0"), path)
    sinks.swapped(orders, path, order=["o_orderkey"])
    return spark.read.parquet(path)


@query("s21_graphml", f"""WITH {STAFF_SQL}, {MODULE_SQL}, n AS (SELECT DISTINCT 'department:' || lower(department) AS id, 'department' AS kind FROM staff UNION SELECT 'module:' || lower(module_code), 'module' FROM module)
SELECT '<node id="' || id || '"><data key="node_type">' || kind || '</data></node>' AS line FROM n UNION ALL SELECT DISTINCT '<edge source="module:' || lower(module_code) || '" target="department:' || lower(department) || '"><data key="edge_type">owned_by</data></edge>' FROM module
UNION ALL SELECT unnest(['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="edge_type" for="edge" attr.name="edge_type" attr.type="string"/>', '<key id="node_type" for="node" attr.name="node_type" attr.type="string"/>', '<graph edgedefault="directed">', '</graph>', '</graphml>'])""")
def _(spark, sf):
    m = modules(spark, sf)
    nodes, edges = T.graph({"department": (staff(spark, sf), "department"), "module": (m, "module_code")}, {"owned_by": (m, "module", "module_code", "department", "department")})
    path = scratch(spark, "graphml")
    sinks.write_lines(sinks.graphml_document(nodes, edges), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


# ---- enrichment ------------------------------------------------------------------------------------


class FixtureProvider:
    """Answers made from the DOI itself, in a provider's format."""

    def __init__(self, kind: str):
        self.kind = kind

    def get(self, doi: str) -> tuple[int, str]:
        n = int(doi.rsplit("/", 1)[1])
        if n % 5 == 0:
            return 404, ""
        if self.kind == "crossref":
            return 200, json.dumps({"title": [f"Title {n}"], "abstract": "" if n % 2 else f"<p>First {n}</p>", "published": {"date-parts": [[2000 + n % 20]]}, "author": [{"given": "A", "family": "B"}]})
        return 200, json.dumps({"display_name": f"Other {n}", "publication_year": 1990, "abstract_inverted_index": {"Second": [0], str(n): [1]}, "topics": [{"display_name": "Robots"}, {"display_name": "robots"}], "keywords": []})


def _publications(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.cast("string").alias("publication_id"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("10.1000/"), k.cast("string"))).alias("doi"), F.when(k % 3 == 0, F.col("p_name")).otherwise("").alias("title"), F.when(k % 4 == 0, "1985").otherwise("").alias("year"))


def _merged(spark, sf):
    p = _publications(spark, sf)
    lanes = spark.sparkContext.defaultParallelism  # the fixture answers at once; a network provider's lanes are its own bound
    c = N.fetch(p, FixtureProvider("crossref"), scratch(spark, "crossref"), lanes)
    o = N.fetch(p, FixtureProvider("openalex"), scratch(spark, "openalex"), lanes)
    return N.merge(p, c, o)


@query("s13_s15_f17_f20_merge", """SELECT CAST(p_partkey AS VARCHAR) AS publication_id, CASE WHEN p_partkey % 7 = 0 THEN 'no_doi' WHEN p_partkey % 5 = 0 THEN 'metadata_not_found' ELSE 'enriched' END AS status,
CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 7 = 0 OR p_partkey % 5 = 0 THEN '' ELSE 'Title ' || CAST(p_partkey AS VARCHAR) END AS title, CASE WHEN p_partkey % 4 = 0 THEN '1985' WHEN p_partkey % 7 = 0 OR p_partkey % 5 = 0 THEN '' ELSE CAST(2000 + p_partkey % 20 AS VARCHAR) END AS year,
CASE WHEN p_partkey % 7 = 0 OR p_partkey % 5 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN 'First ' || CAST(p_partkey AS VARCHAR) ELSE 'Second ' || CAST(p_partkey AS VARCHAR) END AS abstract FROM part""")
def _(spark, sf):
    return _merged(spark, sf).select("publication_id", "status", "title", "year", "abstract")


class BusyProvider(FixtureProvider):
    """Every answer in its envelope; some servers are busy once, gone, or send no JSON. Who asks is remembered where it runs."""

    def __init__(self):
        super().__init__("crossref")
        self.asked: dict[str, int] = {}

    def get(self, doi: str) -> tuple[int, str, dict[str, str]]:
        n = int(doi.rsplit("/", 1)[1])
        self.asked[doi] = self.asked.get(doi, 0) + 1
        if n % 11 == 0:
            return 403, "no", {}
        if n % 13 == 0:
            return 200, "<html>", {}
        if n % 50 == 1 and self.asked[doi] == 1:
            return 429, "", {"Retry-After": "0"}
        code, body = super().get(doi)
        if code != 200:
            return code, body, {}
        told = json.loads(body) | {"license": [{"URL": "http://l/1"}, {"URL": "http://l/1"}, {"URL": ""}, {"URL": f"http://l/{n % 3}"}]}
        return code, json.dumps({"status": "ok", "message": told}), {}


@query("s13_s14_f19_source", """SELECT '10.1000/' || CAST(p_partkey AS VARCHAR) AS doi, CASE WHEN p_partkey % 11 = 0 THEN 'http_error' WHEN p_partkey % 13 = 0 THEN 'invalid_response' WHEN p_partkey % 5 = 0 THEN 'not_found' ELSE 'success' END AS status,
CASE WHEN p_partkey % 11 = 0 THEN 403 WHEN p_partkey % 13 = 0 THEN 200 WHEN p_partkey % 5 = 0 THEN 404 ELSE 200 END AS http_status,
CASE WHEN p_partkey % 11 = 0 OR p_partkey % 13 = 0 OR p_partkey % 5 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN 'http://l/1' ELSE 'http://l/1 http://l/' || CAST(p_partkey % 3 AS VARCHAR) END AS licenses FROM part WHERE p_partkey % 7 <> 0""")
def _(spark, sf):
    """Every publication's DOI through a provider's data source, with licences parsed."""
    from matchloom import session
    from matchloom.sources import providers

    session.ship(spark)
    providers.register(spark, "fixture_provider", BusyProvider())
    path = providers.deposit(_publications(spark, sf), 16)
    told = spark.read.format("fixture_provider").option("path", path).option("lanes", 8).load()
    licences = F.array_join(N.parse_crossref(F.col("body"))["licenses"], " ")
    return told.select("doi", "status", "http_status", F.when(F.col("status") == "success", licences).otherwise("").alias("licenses"))


@query("a9_roll_up", """WITH l AS (SELECT DISTINCT l_suppkey AS staff_id, l_partkey AS k FROM lineitem) SELECT s_suppkey AS staff_id, count(k) AS publications, count_if(k % 7 <> 0 AND k % 5 <> 0) AS enriched, CASE WHEN count_if(k % 7 <> 0 AND k % 5 <> 0) > 0 THEN 'Robots' ELSE '' END AS topics FROM supplier LEFT JOIN l ON staff_id = s_suppkey GROUP BY s_suppkey""")
def _(spark, sf):
    links = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("staff_id"), F.col("l_partkey").cast("string").alias("publication_id")).distinct()
    people = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("staff_id"))
    return N.roll_up(people, links, _merged(spark, sf)).select("staff_id", "publications", "enriched", "topics")


@query("x9_stream_state", """SELECT CAST(user_id AS VARCHAR) AS publication_id, CASE WHEN count_if(event_type <> 'error') = 0 THEN 'retrieval_error' WHEN user_id % 5 = 0 THEN 'metadata_not_found' ELSE 'enriched' END AS status,
CAST(CASE WHEN count_if(event_type <> 'error') > 0 THEN 1 ELSE 0 END AS BIGINT) AS finals, CASE WHEN count_if(event_type <> 'error') = 0 THEN count(*) END AS attempts FROM events GROUP BY user_id""")
def _(spark, sf):
    """Each event asks for its user's record, in seven micro-batches; an error is tried again with the next event, a final outcome never."""
    from matchloom import session
    from matchloom.streaming import enrich

    session.ship(spark)
    events = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("publication_id"), "event_id", "event_type")
    path, out, check = (scratch(spark, n) for n in ("arrivals", "outcomes", "checkpoint"))
    events.repartition(7).write.parquet(path)

    def work(row: dict) -> tuple[str, str]:
        if row["event_type"] == "error":
            raise OSError("busy")
        return ("metadata_not_found", "") if int(row["publication_id"]) % 5 == 0 else ("enriched", "{}")

    told = enrich.enriched(enrich.arrivals(spark, path, "publication_id string, event_id long, event_type string"), work, ["event_id"])
    enrich.into(told, out, check).awaitTermination()
    final = F.col("status").isin(*N.FINAL)
    per = spark.read.parquet(out).groupBy("publication_id").agg(F.max_by("status", "attempt").alias("status"), F.count_if(final).alias("finals"), F.max("attempt").cast("long").alias("tried"))
    return per.select("publication_id", "status", "finals", F.when(F.col("finals") == 0, F.col("tried")).alias("attempts"))


@query("x9_pending", """SELECT CAST(p_partkey AS VARCHAR) AS publication_id FROM part WHERE p_partkey % 3 <> 0""")
def _(spark, sf):
    p = _publications(spark, sf)
    done = p.where("cast(publication_id as int) % 3 = 0").select("publication_id", F.lit("enriched").alias("status"))
    return N.pending(p, done).select("publication_id")


@query("f11_code_and_title", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'CS' || CAST(10 + p_partkey % 90 AS VARCHAR) WHEN 1 THEN 'ED' || CAST(10 + p_partkey % 90 AS VARCHAR) WHEN 2 THEN 'BE' || CAST(10 + p_partkey % 90 AS VARCHAR) WHEN 3 THEN 'BB' || CAST(10 + p_partkey % 90 AS VARCHAR) || 'FU' ELSE 'N/A' END AS code, p_name AS title FROM part""")
def _(spark, sf):
    from matchloom.functions.text import code_and_title

    k, n = F.col("p_partkey") % 5, (10 + F.col("p_partkey") % 90).cast("string")
    code = F.when(k == 0, F.concat(F.lit(" cs"), n)).when(k == 3, F.concat(F.lit("BB"), n, F.lit("FUNDAMENTALS"))).when(k == 4, "TBC")
    title = F.when(k == 1, F.concat(F.lit("ED"), n, F.lit(" - ed"), n, F.lit(": "), "p_name")).otherwise(F.col("p_name"))
    c, t = code_and_title(code, title, F.when(k == 2, F.concat(F.lit("be"), n, F.lit("-something"))))
    return table(spark, sf, "part").select("p_partkey", c.alias("code"), t.alias("title"))


@query("c9_foundation", """WITH t AS (SELECT DISTINCT vec_id // 2 AS s, label AS topic FROM embeddings), v AS (SELECT label AS topic, arg_min(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), vec_id) AS e FROM embeddings GROUP BY 1),
p AS (SELECT x.s AS a, y.s AS b, x.topic AS ta, y.topic AS tb, list_dot_product(v.e, w.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(w.e, w.e))) AS c FROM t x JOIN t y ON y.s = x.s + 1 JOIN v ON v.topic = x.topic JOIN v w ON w.topic = y.topic)
SELECT a, b, CASE WHEN bool_or(ta = tb) THEN 'exact' WHEN max(c) >= 0.1 THEN 'semantic' ELSE 'none' END AS kind, CASE WHEN bool_or(ta = tb) THEN 1.0 ELSE round(max(c), 4) END AS similarity FROM p GROUP BY a, b""")
def _(spark, sf):
    """Neighbours with two topics each: do they share one, or have similar ones?"""
    from matchloom.operators import collaboration as C

    e = table(spark, sf, "embeddings").withColumn("topic", F.col("label").cast("string"))
    topics = e.select(F.expr("vec_id div 2").alias("staff_id"), "topic").distinct()
    people = topics.select("staff_id").distinct()
    pairs = people.select(F.col("staff_id").alias("a"), (F.col("staff_id") + 1).alias("b")).join(people.select(F.col("staff_id").alias("b")), "b")
    found = C.foundation(pairs, topics, e.groupBy("topic").agg(F.min_by("embedding", "vec_id").alias("vector")), least=0.1)
    return found.select("a", "b", "kind", F.round("similarity", 4).alias("similarity"))


@query("c13_unified_records", f"""WITH {MODULE_SQL}, {SCORE_SQL}, t AS (SELECT module_id, count(*) AS n, max(score) AS best, max(core) AS core, max(pub) AS pub FROM score GROUP BY module_id),
f AS (SELECT module_id, arg_min(staff_id, staff_id) FILTER (pub >= 0.5) AS helper FROM score GROUP BY module_id), m AS (SELECT module_id, NOT regexp_matches(lower(title), 'placement|dissertation|capstone project|study abroad') AS taught FROM module)
SELECT module_id, CASE WHEN taught THEN 'taught_academic' ELSE 'independent_project_placement' END AS classification, coalesce(least(n, 5), 0) AS candidates,
CASE WHEN taught THEN CAST(best < 0.6 AS INT) + CAST(core < 0.6 AS INT) + CAST(pub < 0.6 AS INT) END AS gaps, CASE WHEN taught THEN helper END AS helper FROM m LEFT JOIN t USING (module_id) LEFT JOIN f USING (module_id)""")
def _(spark, sf):
    """Gaps are fields in which nobody reaches 0.6; who has published enough and comes first helps."""
    from matchloom.operators import collaboration as C
    from matchloom.operators import policy
    from matchloom.operators.ranking import best, top_k

    m, s = modules(spark, sf).select("module_id", "title"), scores(spark, sf)
    primary = top_k(s, ["module_id"], [F.desc("score"), F.col("staff_id")], 5)
    most = s.groupBy("module_id").agg(*[F.max(c).alias(c) for c in ("score", "core", "pub")])
    aspects = F.array(*[F.struct(F.lit(c).alias("aspect"), (1 - F.col(c)).alias("gap")) for c in ("score", "core", "pub")])
    gaps = most.select("module_id", F.explode(aspects).alias("x")).select("module_id", "x.*").where("gap > 0.4").withColumn("need", F.lit("Moderate Co-Delivery Need"))
    fillers = best(s.where("pub >= 0.5"), ["module_id"], [F.col("staff_id")]).select("module_id", F.lit("pub").alias("aspect"), "staff_id", F.col("pub").alias("score"))
    got = C.unified(m, policy.is_taught(F.col("title")), primary, gaps, fillers)
    found = F.when(F.col("candidates").isNull(), 0).otherwise(F.size("candidates")).cast("long")
    seen, taught = F.col("candidates").isNotNull(), F.col("classification") == "taught_academic"
    n_gaps = F.when(taught & seen, F.when(F.col("gaps").isNull(), 0).otherwise(F.size("gaps")))
    return got.select("module_id", "classification", found.alias("candidates"), n_gaps.alias("gaps"), F.get("collaborators", 0)["staff_id"].alias("helper"))


@query("o2_nulls_last", f"WITH {SCORE_SQL}, r AS (SELECT module_id, count(*) AS n FROM score WHERE score >= 0.9 GROUP BY module_id) SELECT p_partkey, row_number() OVER (ORDER BY n ASC NULLS LAST, p_partkey) AS place FROM part LEFT JOIN r ON module_id = p_partkey")
def _(spark, sf):
    """Every part's place in an order in which missing ranks come last."""
    from matchloom.operators.reliability import before

    r = scores(spark, sf).where("score >= 0.9").groupBy("module_id").agg(F.count("*").alias("n"))
    all_ = table(spark, sf, "part").join(r, F.col("module_id") == F.col("p_partkey"), "left").select("p_partkey", F.struct(F.col("n").isNull().alias("last"), "n", "p_partkey").alias("at"), F.lit(1).alias("k"))
    return before(all_, [], "at").select("p_partkey", (F.col("before") + 1).alias("place"))


@query("c3_hierarchy_mapping", f"""WITH {STAFF_SQL}, l AS (SELECT staff_id, CASE WHEN balance < 0 THEN '' WHEN position = '' THEN lower(college) WHEN position = 'Consultant' THEN 'visitors' WHEN position = 'Technician' THEN 'workshop' ELSE lower(department) END AS label, path FROM staff),
i AS (SELECT DISTINCT lower(department) AS label, path FROM staff UNION SELECT DISTINCT lower(college), path FROM staff), m AS (SELECT label, count(DISTINCT path) AS n, min(path) AS one FROM i GROUP BY label)
SELECT staff_id, CASE WHEN label = '' THEN 'missing' WHEN label = 'workshop' OR n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status, CASE WHEN label = '' THEN NULL WHEN label = 'workshop' THEN 'europe/workshop' WHEN n = 1 THEN one END AS path FROM l LEFT JOIN m USING (label)""")
def _(spark, sf):
    """People under the units that their labels name: departments, colleges with several departments, labels that name nothing, and one that the source maps."""
    from matchloom.operators import hierarchy as H

    people, c = staff(spark, sf), F.col
    label = F.when(c("balance") < 0, "").when(c("position") == "", F.lower("college")).when(c("position") == "Consultant", "visitors").when(c("position") == "Technician", "workshop").otherwise(F.lower("department"))
    index = people.select(F.lower("department").alias("label"), "path").union(people.select(F.lower("college"), "path")).distinct()
    mapping = spark.createDataFrame([("workshop", "europe/workshop")], "label string, path string")
    return H.resolve(people.select("staff_id", label.alias("label")), index, mapping).select("staff_id", "status", "path")


@query("u4_pool", f"WITH {STAFF_SQL}, {SCORE_SQL} SELECT staff_id FROM staff WHERE position <> '' UNION SELECT staff_id FROM score WHERE score > 0.9")
def _(spark, sf):
    from matchloom.operators.allocation import everyone

    return everyone(staff(spark, sf).where("position <> ''"), scores(spark, sf).where("score > 0.9"))


@query("a23_a25_reports", f"""WITH {MODULE_SQL}, {STAFF_SQL}, {SCORE_SQL}, a AS (SELECT count(*) AS modules, count_if(regexp_matches(lower(title), 'placement|dissertation|capstone project|study abroad')) AS exempt FROM module), b AS (SELECT count(*) AS people, count_if(position = '') AS unplaced FROM staff), c AS (SELECT count(*) AS n, min(score) AS least, max(score) AS most FROM score)
SELECT 'modules' AS report, 'modules' AS metric, CAST(modules AS DOUBLE) AS value FROM a UNION ALL SELECT 'modules', 'exempt', exempt FROM a UNION ALL SELECT 'staff', 'people', people FROM b UNION ALL SELECT 'staff', 'unplaced', unplaced FROM b UNION ALL SELECT 'scores', 'n', n FROM c UNION ALL SELECT 'scores', 'least', least FROM c UNION ALL SELECT 'scores', 'most', most FROM c""")
def _(spark, sf):
    from matchloom.operators import audit, policy

    return audit.consolidated({
        "modules": modules(spark, sf).agg(F.count("*").alias("modules"), F.count_if(~policy.is_taught(F.col("title"))).alias("exempt")),
        "staff": staff(spark, sf).agg(F.count("*").alias("people"), F.count_if(F.col("position") == "").alias("unplaced")),
        "scores": audit.summary(scores(spark, sf), "score").select("n", "least", "most"),
    })
