"""Queries: scalar functions, audits, policies and rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.operators import audit, policy, ranking
from matchloom.operators.reliability import before
from matchloom.plans.catalog import query
from matchloom.plans.roles import MODULE_SQL, SCORE_SQL, STAFF_SQL, modules, scores, staff
from matchloom.tables import table


def _case(column: str, terms, prefix: str = "") -> str:
    return "CASE " + " ".join(f"WHEN contains({column}, '{t}') THEN '{prefix}{t}'" for t in terms) + " END"


@query("f1_f2_collapse", r"""SELECT conv_id, turn, length(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS n, md5(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))) AS folded FROM conversations""")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.length(T.collapse(F.col("text"))).cast("long").alias("n"), F.md5(T.folded(F.col("text"))).alias("folded"))


@query("f3_f4_keys", r"""SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]', '', 'g') AS k, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part""")
def _(spark, sf):
    both = F.concat_ws(" ", "p_name", "p_brand")
    return table(spark, sf, "part").select("p_partkey", T.key(both).alias("k"), T.slug(both).alias("slug"))


@query("f5_f6_distinct_parts", """WITH p AS (SELECT c_custkey, [c_mktsegment, lower(c_mktsegment), c_name, ' ' || c_name || ' ', ''] AS parts FROM customer)
SELECT c_custkey, CAST(2 AS BIGINT) AS n, c_mktsegment || ' ' || c_name AS joined FROM customer""")
def _(spark, sf):
    parts = F.array("c_mktsegment", F.lower("c_mktsegment"), "c_name", F.concat(F.lit(" "), "c_name", F.lit(" ")), F.lit(""))
    return table(spark, sf, "customer").select("c_custkey", F.size(T.distinct_parts(parts)).cast("long").alias("n"), T.combine(parts).alias("joined"))


@query("f7_f8_keywords", r"""SELECT doc_id, CAST(len(list_filter(list_transform(string_split_regex(coalesce(text, ''), '[,;|]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')) AS BIGINT) AS n FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.keywords(F.col("text"))).cast("long").alias("n"))


@query("f9_doi", r"""SELECT page_id, regexp_replace(regexp_extract(lower('see https://doi.org/10.' || CAST(1000 + page_id AS VARCHAR) || '/A.B(' || CAST(page_id AS VARCHAR) || ').'), '(10\.\d{4,9}/\S+)', 1), '[.,;)]+$', '') AS doi FROM pages""")
def _(spark, sf):
    said = F.concat(F.lit("see https://doi.org/10."), (1000 + F.col("page_id")).cast("string"), F.lit("/A.B("), F.col("page_id").cast("string"), F.lit(")."))
    return table(spark, sf, "pages").select("page_id", T.doi(said).alias("doi"))


@query("f10_module_codes", f"""WITH {MODULE_SQL} SELECT module_id, upper(module_code) AS codes FROM module""")
def _(spark, sf):
    said = F.concat(F.lit("see "), F.lower("module_code"), F.lit(", again "), "module_code", F.lit("."))
    return modules(spark, sf).select("module_id", F.array_join(T.module_codes(said, r"\b([A-Z]{2}\d{4,9})\b"), ",").alias("codes"))


@query("f12_stable_ids", """SELECT c_custkey, substr(sha256(c_name), 1, 20) AS a, substr(md5(c_name), 1, 12) AS b, substr(sha256(''), 1, 20) AS e FROM customer""")
def _(spark, sf):
    c = F.col("c_name")
    return table(spark, sf, "customer").select("c_custkey", T.stable_id(c).alias("a"), T.stable_id(c, "md5", 12).alias("b"), T.stable_id(F.lit(None).cast("string")).alias("e"))


@query("f13_f14_departments", """SELECT s_suppkey, lower(replace(n_name, '_', ' ')) AS label, replace(lower(n_name), '_', '-') AS slug FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def _(spark, sf):
    labels = table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("School of Department of "), "n_name", F.lit(" Division")).alias("said")).distinct()
    labels = labels.withColumn("label", T.vectorised(T.department_text)("said"))
    return table(spark, sf, "supplier").join(labels, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "label", T.slug(F.col("label")).alias("slug"))


@query("f15_plain_text")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.vectorised(T.plain_text)("html")).alias("digest"))


@query("f16_f17_first_and_year", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus END AS chosen, CAST(year(o_orderdate) AS INT) AS y FROM orders""")
def _(spark, sf):
    a = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("  "), "o_orderpriority")).when(F.col("o_orderkey") % 3 == 1, F.lit("  "))
    said = F.concat(F.lit("in "), F.date_format("o_orderdate", "yyyy-MM"))
    return table(spark, sf, "orders").select("o_orderkey", T.first_text(a, F.col("o_orderstatus")).alias("chosen"), T.year(said).alias("y"))


@query("f18_inverted_index", """SELECT p_partkey, p_type || ' ' || p_name || ' ' || p_brand AS text FROM part""")
def _(spark, sf):
    words = F.split(F.concat_ws(" ", "p_type", "p_name", "p_brand"), " ")
    placed = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.cast("long").alias("i")))
    inverted = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.transform(F.filter(placed, lambda p: p["w"] == w), lambda p: p["i"]))))
    return table(spark, sf, "part").select("p_partkey", T.rebuilt(inverted).alias("text"))


@query("f21_mojibake", """SELECT n_nationkey, n_name || ' caf' || chr(233) AS text FROM nation""")
def _(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", T.vectorised(T.repaired)(F.concat("n_name", F.lit(" cafÃ©"))).alias("text"))


@query("f22_urls", r"""SELECT page_id, CAST(len(regexp_extract_all(coalesce(html, ''), 'https?://[^\s"''<>]+')) AS BIGINT) AS n, regexp_replace(regexp_extract(lower(url), 'https?://([^/:?#]+)', 1), '^www\.', '') AS domain FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.size(T.urls(F.col("html"))).cast("long").alias("n"), T.domain(F.col("url")).alias("domain"))


@query("f23_safe_casts", r"""SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS INT), -1) AS i, coalesce(TRY_CAST(CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS DOUBLE), 0.5) AS d FROM events""")
def _(spark, sf):
    said = F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", T.whole(said, -1).alias("i"), T.number(said, 0.5).alias("d"))


@query("f24_formats", """SELECT n_nationkey, printf('%.1f%%', n_nationkey * 3.5) AS pct, printf('%.1f%%', n_nationkey * 3.75 + 0.25 * n_regionkey) AS ties, CASE WHEN n_regionkey = 0 THEN 'Yes' ELSE 'No' END AS yes,
CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'a and b' ELSE 'a, b and c' END AS listed FROM nation""")
def _(spark, sf):
    some = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), F.col("n_nationkey") % 4)
    return table(spark, sf, "nation").select("n_nationkey", T.percentage(F.col("n_nationkey") * 0.035).alias("pct"), T.percentage((F.col("n_nationkey") * 3.75 + 0.25 * F.col("n_regionkey")) / 100).alias("ties"), T.yes_no(F.col("n_regionkey") == 0).alias("yes"), T.listed(some).alias("listed"))


@query("f25_replace_ids", """SELECT s_suppkey, s_name || ' works with ' || s_name AS text FROM supplier""")
def _(spark, sf):
    said = F.concat(F.lit("STAFF_"), F.col("s_suppkey").cast("string"), F.lit("x works with staff_"), F.col("s_suppkey").cast("string"), F.lit("x"))
    return table(spark, sf, "supplier").select("s_suppkey", T.replace_ids(said, F.concat(F.lit("staff_"), F.col("s_suppkey").cast("string"), F.lit("x")), F.col("s_name")).alias("text"))


@query("f27_f29_topic_text", r"""SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9 ]', '', 'g') || ' cplusplus and csharp' AS cleaned, lower(p_name) || ' c++ c#' AS k FROM part""")
def _(spark, sf):
    names = table(spark, sf, "part").select("p_name").distinct()
    names = names.withColumn("cleaned", T.vectorised(T.ascii_topic)(F.concat("p_name", F.lit("! C++ & C#"))))
    return table(spark, sf, "part").join(names, "p_name").select("p_partkey", "cleaned", T.topic_key(F.concat("p_name", F.lit("! C++ & C#"))).alias("k"))


@query("f28_flatten_weighted", """SELECT o_orderkey, coalesce(trim(o_orderstatus), '') AS topic, 1.0 AS weight FROM orders UNION ALL SELECT o_orderkey, trim(o_orderpriority), CAST(o_custkey AS DOUBLE) FROM orders""")
def _(spark, sf):
    said = F.array(F.struct(F.lit(None).cast("string").alias("topic"), F.col("o_orderstatus").alias("label"), F.lit(None).cast("double").alias("weight")), F.struct(F.col("o_orderpriority").alias("topic"), F.lit(None).cast("string").alias("label"), F.col("o_custkey").cast("double").alias("weight")))
    return table(spark, sf, "orders").select("o_orderkey", F.explode(said).alias("x")).select("o_orderkey", T.first_text(F.col("x.topic"), F.col("x.label")).alias("topic"), F.coalesce("x.weight", F.lit(1.0)).alias("weight"))


@query("f30_rounding", """SELECT o_orderkey, round(o_totalprice / 7, 4) AS r4 FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 7, 4).alias("r4"))


# ---- audits --------------------------------------------------------------------------------------


@query("a1_a4_coverage", """WITH c AS (SELECT count(*) AS n, count_if(trim(coalesce(text, '')) <> '') AS a, count_if(trim(coalesce(lang, '')) <> '') AS b, count_if(n_chars > 500) AS c FROM documents)
SELECT unnest(['text', 'lang', 'long']) AS field, unnest([a, b, c]) AS available, n - unnest([a, b, c]) AS missing, round(100.0 * unnest([a, b, c]) / n, 2) AS percent FROM c""")
def _(spark, sf):
    return audit.coverage(table(spark, sf, "documents"), {"text": T.is_blank(F.col("text")), "lang": T.is_blank(F.col("lang")), "long": F.col("n_chars") <= 500})


@query("a2_identity_audit", """SELECT count(*) AS n, count(DISTINCT coalesce(CAST(nullif(l_partkey % 3, 0) AS VARCHAR), 'x' || CAST(l_suppkey AS VARCHAR))) AS identities FROM lineitem""")
def _(spark, sf):
    identity = F.coalesce(F.nullif(F.col("l_partkey") % 3, F.lit(0)).cast("string"), F.concat(F.lit("x"), F.col("l_suppkey").cast("string")))
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n"), F.count_distinct(identity).alias("identities"))


@query("a3_duplicates", """SELECT md5(text) AS digest, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1""")
def _(spark, sf):
    return audit.duplicates(table(spark, sf, "documents").select(F.md5("text").alias("digest")), "digest")


@query("a3_excess", """SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS excess FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)""")
def _(spark, sf):
    return audit.excess(table(spark, sf, "documents").select(F.md5("text").alias("digest")), "digest")


@query("a5_categories", r"""SELECT value, count(*) AS n FROM (SELECT unnest([event_type, CAST(user_id % 5 AS VARCHAR)]) AS value FROM events) GROUP BY value""")
def _(spark, sf):
    return audit.categories(table(spark, sf, "events"), F.array("event_type", (F.col("user_id") % 5).cast("string")))


@query("a6_blanks", """SELECT unnest(['text', 'role']) AS field, unnest([count_if(trim(coalesce(text, '')) = ''), count_if(trim(coalesce(role, '')) = '')]) AS blank FROM conversations""")
def _(spark, sf):
    return audit.blanks(table(spark, sf, "conversations"), ["text", "role"])


@query("a7_validation_report", """WITH s AS (SELECT bool_and(l_quantity > 0) AS quantity, bool_and(l_discount <= 0.05) AS discount, bool_and(l_linenumber >= 1) AS line FROM lineitem) SELECT *, quantity AND discount AND line AS valid FROM s""")
def _(spark, sf):
    return audit.report(table(spark, sf, "lineitem"), {"quantity": F.col("l_quantity") > 0, "discount": F.col("l_discount") <= 0.05, "line": F.col("l_linenumber") >= 1})


@query("a8_readiness", r"""SELECT regexp_replace(regexp_extract(lower(url), 'https?://([^/:?#]+)', 1), '^www\.', '') AS domain, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, domain LIMIT 30""")
def _(spark, sf):
    """The top thirty domains: the limit is the report's."""
    return table(spark, sf, "pages").groupBy(T.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(30)


@query("a14_numeric_summary", """SELECT c_mktsegment, count(c_nationkey) AS n, min(c_nationkey) AS least, max(c_nationkey) AS most, avg(c_nationkey) AS mean, CAST(median(c_nationkey) AS DOUBLE) AS median FROM customer GROUP BY c_mktsegment""")
def _(spark, sf):
    return audit.summary(table(spark, sf, "customer"), "c_nationkey", ["c_mktsegment"])


@query("a14_histogram", """SELECT CASE WHEN l_quantity < 10 THEN '0-10' WHEN l_quantity < 25 THEN '10-25' WHEN l_quantity < 40 THEN '25-40' ELSE '>=40' END AS band, count(*) AS n FROM lineitem GROUP BY 1""")
def _(spark, sf):
    return audit.histogram(table(spark, sf, "lineitem"), F.col("l_quantity"), [10, 25, 40])


@query("j2_referential", """SELECT 'lines without orders' AS "check", count(*) AS missing FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'orders without lines', count(*) FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
UNION ALL SELECT 'documents without labels', count(*) FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))""")
def _(spark, sf):
    t = lambda n: table(spark, sf, n)
    return audit.dangling({"lines without orders": (t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"), "orders without lines": (t("orders"), "o_orderkey", t("lineitem"), "l_orderkey"), "documents without labels": (t("documents"), "doc_id", t("labels"), "doc_id")})


@query("j3_code_sets", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT c_custkey AS k FROM customer)
SELECT 'both' AS side, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'second', count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def _(spark, sf):
    """Customers with urgent orders against all customers."""
    a = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")).distinct()
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).distinct()
    sides = {"both": a.intersect(b), "first": a.exceptAll(b), "second": b.exceptAll(a)}
    return reduce(DataFrame.unionByName, [d.agg(F.lit(k).alias("side"), F.count("*").alias("n")) for k, d in sides.items()])


# ---- policies ------------------------------------------------------------------------------------


@query("p12_eligibility", f"""WITH {STAFF_SQL} SELECT staff_id, CASE WHEN position = '' THEN 'missing_position' ELSE coalesce({_case('lower(position)', policy.EXCLUDED_ROLES, 'excluded_role:')}, {_case('lower(position)', policy.ALLOWED_ROLES, 'eligible_role:')}, 'unclassified_position') END AS reason FROM staff""")
def _(spark, sf):
    return staff(spark, sf).select("staff_id", policy.eligibility(F.col("position")).alias("reason"))


_GATE_SQL = """CASE WHEN score < 0.12 THEN 'low_total_score' WHEN greatest(core, pub) < 0.10 THEN 'no_strong_field_signal' WHEN pub < 0.06 AND core < 0.06 THEN 'insufficient_evidence_signal'
 WHEN module_id % 7 = 0 AND staff_id % 2 = 0 THEN 'profile_evidence_missing' WHEN staff_id % 5 = 0 AND pub > 0 THEN 'generic_evidence_only' ELSE 'passed' END"""


def _gated(spark, sf):
    c = F.col
    missing = (c("module_id") % 7 == 0) & (c("staff_id") % 2 == 0)
    terms = F.when(c("staff_id") % 5 == 0, F.array(F.lit("research"), F.lit("law"))).otherwise(F.array(F.lit("robotics")))
    return scores(spark, sf).withColumn("reason", policy.gate(c("score"), {"core": c("core"), "pub": c("pub")}, "core", ~missing, ~missing, policy.is_specific(terms)))


@query("p13_gate", f"""WITH {SCORE_SQL} SELECT module_id, staff_id, {_GATE_SQL} AS reason FROM score""")
def _(spark, sf):
    return _gated(spark, sf).select("module_id", "staff_id", "reason")


@query("p14_p15_titles", f"""WITH {MODULE_SQL} SELECT module_id, CASE WHEN {_case('lower(title)', policy.UNTAUGHT_TITLES)} IS NULL THEN 'taught_academic' ELSE 'independent_project_placement' END AS kind, {_case('lower(title)', policy.ADMINISTRATIVE_TITLES)} AS excluded FROM module""")
def _(spark, sf):
    return modules(spark, sf).select("module_id", policy.classification(F.col("title")).alias("kind"), policy.exclusion_reason(F.col("title")).alias("excluded"))


@query("p18_p19_display", f"""WITH {SCORE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY score DESC, staff_id) AS rank FROM score)
SELECT module_id, staff_id, CASE WHEN score >= 0.35 THEN 'high' WHEN score >= 0.2 THEN 'moderate' ELSE 'exploratory' END AS level, score >= 0.35 AND rank = 1 AND core >= 0.4 AND pub >= 0.1 AS shown FROM r""")
def _(spark, sf):
    ranked = ranking.top_k(scores(spark, sf), ["module_id"], [F.desc("score"), F.col("staff_id")], 1 << 30)
    return ranked.select("module_id", "staff_id", policy.band(F.col("score")).alias("level"), policy.displayed(policy.band(F.col("score")), F.col("rank"), F.col("core"), F.col("pub")).alias("shown"))


@query("p20_capacity", f"""WITH {STAFF_SQL} SELECT staff_id, CASE WHEN staff_id = 7 THEN 5 WHEN contains(lower(position), 'professor') THEN 2 WHEN contains(lower(position), 'head of department') THEN 1 WHEN contains(lower(position), 'reader') THEN 3 WHEN contains(lower(position), 'senior lecturer') THEN 3 WHEN contains(lower(position), 'lecturer') THEN 4 ELSE 3 END AS capacity FROM staff""")
def _(spark, sf):
    override = F.when(F.col("staff_id") == 7, 5)
    return staff(spark, sf).select("staff_id", policy.capacity(F.col("position"), override).alias("capacity"))


@query("p11_usable_text", """SELECT doc_id FROM documents WHERE trim(coalesce(text, '')) <> ''""")
def _(spark, sf):
    return table(spark, sf, "documents").where(~T.is_blank(F.col("text"))).select("doc_id")


@query("p23_ui_search", f"""WITH {MODULE_SQL} SELECT module_id FROM module WHERE (contains(lower(title), 'bolt') OR contains(lower(module_code), 'bolt') OR contains(CAST(module_id AS VARCHAR), 'bolt')) AND department IN ('NATION_1', 'NATION_2', 'NATION_3')""")
def _(spark, sf):
    hit = F.lit(False)
    for c in ("title", "module_code", "module_id"):
        hit = hit | F.contains(F.lower(F.col(c).cast("string")), F.lit("bolt"))
    return modules(spark, sf).where(hit & F.array_contains(F.array(*[F.lit(f"NATION_{i}") for i in (1, 2, 3)]), F.col("department"))).select("module_id")


@query("p24_p25_lookup", f"""WITH {MODULE_SQL}, h AS (SELECT module_id, lower(module_code) = 're1001' OR lower(title) = 're1001' AS exact FROM module WHERE contains(lower(module_code), 're1001') OR contains(lower(title), 're1001'))
SELECT module_id FROM h WHERE exact OR NOT (SELECT bool_or(exact) FROM h)""")
def _(spark, sf):
    """Exact hits on code or title if there are any, else all that contain the text."""
    code, title, asked = F.lower("module_code"), F.lower("title"), F.lit("re1001")
    found = modules(spark, sf).where(F.contains(code, asked) | F.contains(title, asked)).select("module_id", ((code == asked) | (title == asked)).alias("exact"))
    any_exact = found.agg(F.coalesce(F.bool_or("exact"), F.lit(False)).alias("some"))
    return found.join(F.broadcast(any_exact), F.lit(True)).where(F.col("exact") | ~F.col("some")).select("module_id")


@query("p26_p27_row_checks", f"""WITH {SCORE_SQL} SELECT module_id, staff_id, failure FROM (SELECT module_id, staff_id, unnest([CASE WHEN module_id = staff_id THEN 'self pair' END, CASE WHEN core > 0.8 THEN 'core out of range' END, CASE WHEN n > 2 THEN 'repeated' END]) AS failure FROM score) WHERE failure IS NOT NULL""")
def _(spark, sf):
    c = F.col
    return policy.checks(scores(spark, sf), {"self pair": c("module_id") == c("staff_id"), "core out of range": c("core") > 0.8, "repeated": c("n") > 2}, ["module_id", "staff_id"])


@query("p28_p29_bands", """SELECT doc_id, CASE WHEN n_chars % 4 < 3 THEN CAST(n_chars % 4 AS INT) END AS rating, CASE WHEN n_chars % 11 <= 2 THEN 'Slight' WHEN n_chars % 11 <= 4 THEN 'Fair' WHEN n_chars % 11 <= 6 THEN 'Moderate' WHEN n_chars % 11 <= 8 THEN 'Substantial' ELSE 'Almost Perfect' END AS band FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", policy.rating(F.concat(F.lit(" "), (F.col("n_chars") % 4).cast("string"))).alias("rating"), policy.kappa_band((F.col("n_chars") % 11) / 10).alias("band"))


# ---- rankings ------------------------------------------------------------------------------------

_RANKED = f"{SCORE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY score DESC, staff_id) AS rank FROM score)"


@query("w1_w2_top_k", f"WITH {_RANKED} SELECT module_id, staff_id, rank, score FROM r WHERE rank <= 5")
def _(spark, sf):
    return ranking.top_k(scores(spark, sf), ["module_id"], [F.desc("score"), F.col("staff_id")], 5).select("module_id", "staff_id", F.col("rank").cast("long").alias("rank"), "score")


@query("w3_gated_top_k", f"""WITH {SCORE_SQL}, g AS (SELECT *, {_GATE_SQL} = 'passed' AS passed, row_number() OVER (PARTITION BY module_id ORDER BY score DESC, staff_id) AS pre_rank FROM score),
e AS (SELECT *, coalesce(sum(CAST(passed AS INT)) OVER (PARTITION BY module_id ORDER BY pre_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g WHERE pre_rank <= 15)
SELECT module_id, staff_id, pre_rank, passed, CAST(CASE WHEN passed THEN before + 1 END AS BIGINT) AS final_rank FROM e WHERE before < 5""")
def _(spark, sf):
    found = ranking.gated_top_k(_gated(spark, sf), ["module_id"], [F.desc("score"), F.col("staff_id")], F.col("reason") == "passed", 5)
    return found.select("module_id", "staff_id", F.col("pre_rank").cast("long").alias("pre_rank"), "passed", F.col("final_rank").cast("long").alias("final_rank"))


@query("w5_longest_wins", """SELECT conv_id, turn, length(text) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS k FROM conversations) WHERE k = 1""")
def _(spark, sf):
    return ranking.best(table(spark, sf, "conversations"), ["conv_id"], [F.desc(F.length("text")), F.col("turn")]).select("conv_id", "turn", F.length("text").cast("long").alias("n"))


@query("w6_w7_best_record", f"WITH {SCORE_SQL} SELECT module_id, staff_id, score FROM (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY score DESC, core DESC, pub DESC, n DESC, staff_id DESC) AS k FROM score) WHERE k = 1")
def _(spark, sf):
    return ranking.best(scores(spark, sf), ["module_id"], [F.desc(c) for c in ("score", "core", "pub", "n", "staff_id")]).select("module_id", "staff_id", "score")


@query("w8_rank_checks", """WITH r AS (SELECT l_orderkey, l_linenumber AS rank, l_quantity AS score, row_number() OVER w AS k, lag(l_quantity) OVER w AS before FROM (SELECT DISTINCT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
SELECT l_orderkey, bool_or(k <> rank) AS rank_gap, bool_or(coalesce(before < score, false)) AS score_rise FROM r GROUP BY l_orderkey""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    return ranking.rank_problems(lines, "l_orderkey", "l_linenumber", "q")


@query("w14_repeated_pairs", """WITH p AS (SELECT l_orderkey, l_partkey AS a, l_suppkey AS b, row_number() OVER (PARTITION BY l_returnflag, least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey) ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS copy FROM lineitem) SELECT copy, count(*) AS n FROM p WHERE copy > 1 GROUP BY copy""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("o", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))
    return ranking.repeated_pairs(lines, "l_returnflag", "l_partkey", "l_suppkey", "o").groupBy(F.col("copy").cast("long").alias("copy")).agg(F.count("*").alias("n"))


@query("o1_o3_orders", """SELECT o_orderkey, row_number() OVER (ORDER BY year(o_orderdate) DESC, o_orderkey) AS place FROM orders""")
def _(spark, sf):
    """The place of every order in a total order, by global ranks: no task holds them all."""
    o = table(spark, sf, "orders").select("o_orderkey", F.struct((-F.year("o_orderdate")).alias("y"), "o_orderkey").alias("at"), F.lit(1).alias("k"))
    return before(o, [], "at").select("o_orderkey", (F.col("before") + 1).alias("place"))


@query("o4_stratified", """SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS k FROM documents) WHERE k <= 3""")
def _(spark, sf):
    return ranking.stratified(table(spark, sf, "documents"), "source", "doc_id", 3, 42).select("source", "doc_id")


@query("o5_interleaved", f"""WITH {SCORE_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY score DESC, core DESC, staff_id) AS k FROM score), t AS (SELECT *, row_number() OVER (PARTITION BY pub >= 0.5 ORDER BY score DESC, module_id) AS turn FROM b WHERE k = 1)
SELECT module_id, staff_id FROM t WHERE turn <= 10 ORDER BY turn, pub >= 0.5 DESC LIMIT 10""")
def _(spark, sf):
    one = ranking.best(scores(spark, sf), ["module_id"], [F.desc("score"), F.desc("core"), F.col("staff_id")])
    return ranking.interleaved(one, F.col("pub") >= 0.5, [F.desc("score"), F.col("module_id")], 10).select("module_id", "staff_id")


@query("o6_quotas", f"""WITH {SCORE_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY score DESC, staff_id) AS k FROM score),
l AS (SELECT *, CASE WHEN score < 0.5 THEN 'weak' WHEN core > 0.7 THEN 'strong' WHEN pub > 0.3 THEN 'published' END AS label FROM b WHERE k = 1)
SELECT module_id, label, place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, module_id) AS place FROM l WHERE label IS NOT NULL) WHERE place <= CASE label WHEN 'weak' THEN 15 WHEN 'strong' THEN 15 ELSE 10 END""")
def _(spark, sf):
    one = ranking.best(scores(spark, sf), ["module_id"], [F.desc("score"), F.col("staff_id")])
    labels = {"weak": (F.col("score") < 0.5, 15), "strong": (F.col("core") > 0.7, 15), "published": (F.col("pub") > 0.3, 10)}
    return ranking.quotas(one, "module_id", labels, [F.desc("score"), F.col("module_id")]).select("module_id", "label", F.col("place").cast("long").alias("place"))


@query("o7_first_distinct", """SELECT DISTINCT o_orderpriority AS p FROM orders ORDER BY p LIMIT 10""")
def _(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("p")).distinct().orderBy("p").limit(10)


@query("o8_page", """SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40""")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name").orderBy("c_name", "c_custkey").offset(40).limit(20)
