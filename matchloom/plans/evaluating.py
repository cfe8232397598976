"""Queries: allocation, fairness, retrieval metrics and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators import allocation as A
from matchloom.operators import evaluation as E
from matchloom.operators import explain, policy, ranking
from matchloom.operators import reliability as R
from matchloom.plans.catalog import query
from matchloom.plans.roles import MODULE_SQL, SCORE_SQL, STAFF_SQL, modules, scores, staff
from matchloom.session import materialise
from matchloom.tables import table

_LOAD_SQL = """g AS (SELECT module_id, staff_id FROM (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY score DESC, staff_id) AS k FROM score) JOIN supplier ON s_suppkey = staff_id WHERE k = 1 AND s_acctbal >= 0),
load AS (SELECT s_suppkey AS staff_id, count(module_id) AS load FROM supplier LEFT JOIN g ON staff_id = s_suppkey GROUP BY s_suppkey)"""


def _load(spark, sf):
    """First choices whose accounts aren't overdrawn; the others stay in the pool without a load."""
    people = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("staff_id"), "s_acctbal")
    greedy = ranking.best(scores(spark, sf), ["module_id"], [F.desc("score"), F.col("staff_id")]).join(people.where("s_acctbal >= 0"), "staff_id")
    return A.workloads(greedy.select("module_id", "staff_id"), people)


@query("w9_gini", f"WITH {SCORE_SQL}, {_LOAD_SQL}, r AS (SELECT load, row_number() OVER (ORDER BY load) AS i, count(*) OVER () AS n, sum(load) OVER () AS t FROM load) SELECT round(2.0 * sum(i * load) / (any_value(n) * any_value(t)) - (any_value(n) + 1.0) / any_value(n), 4) AS gini FROM r")
def _(spark, sf):
    return A.gini(_load(spark, sf)).select(F.round("gini", 4).alias("gini"))


@query("w10_lorenz", f"WITH {SCORE_SQL}, {_LOAD_SQL}, r AS (SELECT row_number() OVER (ORDER BY load, staff_id) - 1 AS i, sum(load) OVER (ORDER BY load, staff_id) AS cum, count(*) OVER () AS n, sum(load) OVER () AS t FROM load) SELECT round(i / CAST(n - 1 AS DOUBLE), 4) AS staff_share, round(cum / CAST(t AS DOUBLE), 4) AS load_share FROM r WHERE i IN (SELECT CAST(floor(k * (SELECT count(*) - 1 FROM load) / 9.0) AS BIGINT) FROM range(10) x(k))")
def _(spark, sf):
    return A.lorenz(_load(spark, sf))


@query("a15_w11_fairness", f"""WITH {SCORE_SQL}, {_LOAD_SQL}, r AS (SELECT load, row_number() OVER (ORDER BY load) AS i, row_number() OVER (ORDER BY load DESC, staff_id) AS d, count(*) OVER () AS n, sum(load) OVER () AS t FROM load)
SELECT any_value(n) AS pool, CAST(any_value(t) AS BIGINT) AS modules, count_if(load > 0) AS allocated, round(100.0 * count_if(load > 0) / any_value(n), 2) AS utilisation, round(2.0 * sum(i * load) / (any_value(n) * any_value(t)) - (any_value(n) + 1.0) / any_value(n), 4) AS gini,
max(load) AS most, min(load) FILTER (load > 0) AS least, round(avg(load) FILTER (load > 0), 3) AS mean, round(stddev_pop(load) FILTER (load > 0), 3) AS deviation,
round(100.0 * sum(load) FILTER (d <= 10) / any_value(t), 2) AS ten_share, round(100.0 * sum(load) FILTER (d <= greatest(1, ceil(0.05 * n))) / any_value(t), 2) AS busiest_share FROM r""")
def _(spark, sf):
    return A.fairness(_load(spark, sf))


def _offers(spark, sf, taught_only: bool = True):
    """Modules' five best, each with capacity."""
    best = ranking.top_k(scores(spark, sf), ["module_id"], [F.desc("score"), F.col("staff_id")], 5)
    kept = modules(spark, sf).where(policy.is_taught(F.col("title")) | F.lit(not taught_only)).select("module_id")
    cap = staff(spark, sf).select("staff_id", policy.capacity(F.col("position")).alias("capacity"))
    return best.join(kept, "module_id").join(cap, "staff_id").select("module_id", "staff_id", F.col("rank").cast("long").alias("rank"), "score", "capacity")


def _extracted(spark, sf):
    catalogue = modules(spark, sf).select("module_id", policy.is_taught(F.col("title")).alias("taught"))
    return A.extraction(catalogue, _offers(spark, sf, taught_only=False), A.balance(_offers(spark, sf)))


@query("c14_balance")
def _(spark, sf):
    """All taught modules as one problem; an optimal assignment isn't unique, so tests compare its cost and not its rows."""
    return A.balance(_offers(spark, sf)).select("module_id", "staff_id", "rank")


@query("c14_quota", f"""WITH {STAFF_SQL}, {SCORE_SQL}, {MODULE_SQL}, t AS (SELECT module_id FROM module WHERE NOT regexp_matches(lower(title), '{"|".join(policy.UNTAUGHT_TITLES)}')),
o AS (SELECT module_id, staff_id FROM (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY score DESC, staff_id) AS k FROM score) JOIN t USING (module_id) WHERE k <= 5) SELECT DISTINCT staff_id, true AS within FROM o""")
def _(spark, sf):
    """Whether everyone who is offered a module keeps within capacity and both extra tiers."""
    offers = _offers(spark, sf)
    load = A.balance(offers).groupBy("staff_id").agg(F.count("*").alias("load"))
    people = offers.select("staff_id", "capacity").distinct().join(load, "staff_id", "left")
    return people.select("staff_id", (F.coalesce("load", F.lit(0)) <= F.col("capacity") + sum(n for n, _ in A.TIERS)).alias("within"))


@query("c15_extraction")
def _(spark, sf):
    return _extracted(spark, sf).select("module_id", "taught", "staff_id", "greedy_id", "rank_shift", F.size("displaced").alias("displaced"))


@query("c15_exempt", f"""WITH {SCORE_SQL}, {MODULE_SQL}, b AS (SELECT module_id, staff_id FROM (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY score DESC, staff_id) AS k FROM score) WHERE k = 1)
SELECT module_id, staff_id, staff_id AS greedy_id, CAST(0 AS BIGINT) AS rank_shift, 0 AS displaced FROM module LEFT JOIN b USING (module_id) WHERE regexp_matches(lower(title), '{"|".join(policy.UNTAUGHT_TITLES)}')""")
def _(spark, sf):
    """Modules outside the capacity rules keep their first choice: nothing is balanced for them, so no allocation is solved."""
    exempt = modules(spark, sf).where(~policy.is_taught(F.col("title"))).select("module_id", F.lit(False).alias("taught"))
    offers = _offers(spark, sf, taught_only=False).join(exempt, "module_id", "left_semi")
    return A.extraction(exempt, offers, offers.where("false")).select("module_id", "staff_id", "greedy_id", F.col("rank_shift").cast("long").alias("rank_shift"), F.size("displaced").alias("displaced"))


@query("c16_balance_deltas")
def _(spark, sf):
    return A.deltas(_extracted(spark, sf), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("staff_id")))


@query("c17_capacity_sweep")
def _(spark, sf):
    offers = _offers(spark, sf)
    pool = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("staff_id"))
    capacities = (1, 2, 3, 4, 5, 8, 15)
    load = A.balance(offers, capacities=capacities).groupBy("capacity", "staff_id").agg(F.count("*").alias("load"))
    all_ = pool.withColumn("capacity", F.explode(F.array(*[F.lit(c) for c in capacities]))).join(load, ["capacity", "staff_id"], "left").select("capacity", F.coalesce("load", F.lit(0)).alias("load"))
    return A.gini(all_, ["capacity"]).select("capacity", F.round("gini", 4).alias("gini"))


_TOP_SQL = f"{SCORE_SQL}, top AS (SELECT module_id, staff_id, score, row_number() OVER (PARTITION BY module_id ORDER BY score DESC, staff_id) AS rank FROM score QUALIFY rank <= 5)"


def _top(spark, sf):
    return ranking.top_k(scores(spark, sf), ["module_id"], [F.desc("score"), F.col("staff_id")], 5).select("module_id", "staff_id", "score", F.col("rank").cast("long").alias("rank"))


@query("c18_lead_first", f"WITH {_TOP_SQL}, l AS (SELECT module_id, max(staff_id) AS lead FROM top GROUP BY module_id) SELECT module_id, staff_id, row_number() OVER (PARTITION BY module_id ORDER BY staff_id <> lead, rank) AS rank FROM top JOIN l USING (module_id)")
def _(spark, sf):
    top = _top(spark, sf)
    w = Window.partitionBy("module_id").orderBy(F.col("staff_id") != F.col("lead"), "rank")
    lead = top.groupBy("module_id").agg(F.max("staff_id").alias("lead"))
    return top.join(lead, "module_id").select("module_id", "staff_id", F.row_number().over(w).cast("long").alias("rank"))


_REL_SQL = f"""{_TOP_SQL}, truth AS (SELECT DISTINCT l_partkey AS query, l_suppkey AS item FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40),
rel AS (SELECT t.module_id AS query, t.rank, CASE WHEN truth.item IS NOT NULL THEN 2 WHEN t.score >= 0.3 THEN 1 ELSE 0 END AS rel FROM top t LEFT JOIN truth ON truth.query = t.module_id AND truth.item = t.staff_id)"""


def _graded(spark, sf):
    ranked = _top(spark, sf).select(F.col("module_id").alias("query"), F.col("staff_id").alias("item"), "rank", "score")
    truth = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_partkey").alias("query"), F.col("l_suppkey").alias("item"))
    return E.graded(ranked, truth)


@query("v1_graded_relevance", f"WITH {_REL_SQL} SELECT * FROM rel")
def _(spark, sf):
    return _graded(spark, sf).select("query", "rank", "rel")


_METRIC_SQL = f"""{_REL_SQL}, e AS (SELECT *, CAST(rel >= 1 AS INT) AS hit, row_number() OVER (PARTITION BY query ORDER BY rel DESC, rank) AS ideal, sum(CAST(rel >= 1 AS INT)) OVER (PARTITION BY query ORDER BY rank) AS hits FROM rel),
m AS (SELECT query, sum((pow(2, rel) - 1) / log2(rank + 1)) AS dcg, sum((pow(2, rel) - 1) / log2(ideal + 1)) AS idcg, avg(hit) AS precision, coalesce(1.0 / min(rank) FILTER (hit = 1), 0) AS rr, coalesce(sum(hits / rank) FILTER (hit = 1) / sum(hit), 0) AS ap, CAST(max(hit) AS DOUBLE) AS hit_rate, avg(rel) AS mean_rel FROM e GROUP BY query)"""


@query("w12_w13_metrics", f"WITH {_METRIC_SQL} SELECT query, round(dcg, 4) AS dcg, round(CASE WHEN idcg = 0 THEN 0 ELSE dcg / idcg END, 4) AS ndcg, round(precision, 4) AS precision, round(rr, 4) AS rr, round(ap, 4) AS ap, hit_rate, round(mean_rel, 4) AS mean_rel FROM m")
def _(spark, sf):
    m = E.metrics(_graded(spark, sf))
    return m.select("query", "hit_rate", *[F.round(c, 4).alias(c) for c in ("dcg", "ndcg", "precision", "rr", "ap", "mean_rel")])


@query("a16_macro_mean", f"WITH {_METRIC_SQL} SELECT count(*) AS queries, round(avg(CASE WHEN idcg = 0 THEN 0 ELSE dcg / idcg END), 4) AS ndcg, round(avg(precision), 4) AS precision, round(avg(rr), 4) AS mrr FROM m")
def _(spark, sf):
    return E.metrics(_graded(spark, sf)).agg(F.count("*").alias("queries"), F.round(F.avg("ndcg"), 4).alias("ndcg"), F.round(F.avg("precision"), 4).alias("precision"), F.round(F.avg("rr"), 4).alias("mrr"))


@query("a17_rating_sets", """SELECT source, count(*) AS rated, CAST(sum(quality) AS BIGINT) AS good, round(avg(quality), 4) AS mean FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (source))""")
def _(spark, sf):
    both = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return both.groupingSets([[], [F.col("source")]], "source").agg(F.count("*").alias("rated"), F.sum("quality").alias("good"), F.round(F.avg("quality"), 4).alias("mean")).select("source", "rated", "good", "mean")


@query("a18_ground_truth", f"WITH {MODULE_SQL} SELECT module_code, count(DISTINCT l_suppkey) AS n FROM lineitem JOIN module ON module_id = l_partkey WHERE length(module_code) >= 4 AND regexp_matches(module_code, '[0-9]') AND regexp_matches(module_code, '[A-Za-z]') GROUP BY module_code")
def _(spark, sf):
    code = F.col("module_code")
    usable = modules(spark, sf).where((F.length(code) >= 4) & code.rlike("[0-9]") & code.rlike("[A-Za-z]")).select("module_id", "module_code")
    return table(spark, sf, "lineitem").join(usable, F.col("module_id") == F.col("l_partkey")).groupBy("module_code").agg(F.count_distinct("l_suppkey").alias("n"))


@query("v2_registry", f"WITH {_TOP_SQL} SELECT 'm0' AS model, module_id, staff_id, rank FROM top UNION ALL SELECT 'm1', module_id, staff_id, row_number() OVER (PARTITION BY module_id ORDER BY core DESC, staff_id) AS rank FROM score QUALIFY rank <= 5")
def _(spark, sf):
    one = _top(spark, sf).select(F.lit("m0").alias("model"), "module_id", "staff_id", "rank")
    two = ranking.top_k(scores(spark, sf), ["module_id"], [F.desc("core"), F.col("staff_id")], 5).select(F.lit("m1").alias("model"), "module_id", "staff_id", F.col("rank").cast("long").alias("rank"))
    return one.unionByName(two)


_KAPPA = """WITH r AS (SELECT quality AS a, toxic AS b FROM labels), t AS (SELECT count(*) AS t FROM r), o AS (SELECT count_if(a = b) / CAST(count(*) AS DOUBLE) AS po, (count_if(a = 1) * count_if(b = 1) + count_if(a = 0) * count_if(b = 0)) / CAST(count(*) * count(*) AS DOUBLE) AS pe FROM r)
SELECT round(po, 4) AS observed, round((po - pe) / (1 - pe), 4) AS kappa FROM o"""


@query("v3_cohen_kappa", _KAPPA)
def _(spark, sf):
    return E.cohen_kappa(table(spark, sf, "labels"), "quality", "toxic").select(F.round("observed", 4).alias("observed"), F.round("kappa", 4).alias("kappa"))


@query("v3_weighted_kappa", """WITH r AS (SELECT l_linenumber AS a, 1 + CAST(l_quantity AS BIGINT) % 7 AS b FROM lineitem), ca AS (SELECT a, count(*) AS n FROM r GROUP BY a), cb AS (SELECT b, count(*) AS n FROM r GROUP BY b), t AS (SELECT count(*) AS t FROM r),
s AS (SELECT avg(((a - b) / 6.0) ** 2) AS seen, avg(CAST(a = b AS INT)) AS po FROM r), c AS (SELECT sum(((a - b) / 6.0) ** 2 * ca.n * cb.n / (CAST(t AS DOUBLE) * t)) AS chance FROM ca, cb, t) SELECT round(po, 4) AS observed, round(1 - seen / chance, 4) AS kappa FROM s, c""")
def _(spark, sf):
    rated = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("a"), (1 + F.col("l_quantity").cast("long") % 7).alias("b"))
    return E.cohen_kappa(rated, "a", "b", "quadratic").select(F.round("observed", 4).alias("observed"), F.round("kappa", 4).alias("kappa"))


@query("v4_fleiss_kappa", """WITH v AS (SELECT user_id AS item, event_type AS c, count(*) AS n FROM events WHERE false GROUP BY ALL), x AS (SELECT doc_id AS item, unnest([n_chars % 3, n_chars % 5 % 3, n_chars % 7 % 3]) AS c FROM documents), k AS (SELECT item, c, count(*) AS n FROM x GROUP BY ALL),
p AS (SELECT item, (sum(n * n) - sum(n)) / CAST(sum(n) * (sum(n) - 1) AS DOUBLE) AS p FROM k GROUP BY item), s AS (SELECT avg(p) AS seen FROM p), e AS (SELECT sum((c / CAST(t AS DOUBLE)) ** 2) AS chance FROM (SELECT sum(n) AS c, (SELECT sum(n) FROM k) AS t FROM k GROUP BY c)) SELECT round((seen - chance) / (1 - chance), 4) AS kappa FROM s, e""")
def _(spark, sf):
    c = F.col("n_chars")
    votes = table(spark, sf, "documents").select("doc_id", F.explode(F.array(c % 3, c % 5 % 3, c % 7 % 3)).alias("c")).groupBy("doc_id", "c").agg(F.count("*").alias("n"))
    return E.fleiss_kappa(votes, "doc_id", "c").select(F.round("kappa", 4).alias("kappa"))


#: Orders that stand for the six models: each ranks a module's people by another blend of their scores.
_MODELS = {"M0": "score", "M1": "core", "M2": "pub", "M3": "0.8 * score + 0.2 * core", "M4": "greatest(core, pub)", "M5": "0.5 * core + 0.5 * pub"}
_SIX_SQL = f"""{SCORE_SQL}, truth AS (SELECT DISTINCT l_partkey AS query, l_suppkey AS item FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40),
ranked AS ({" UNION ALL ".join(f"SELECT '{m}' AS model, module_id AS query, staff_id AS item, round({order}, 9) AS score FROM score" for m, order in _MODELS.items())}),
rel AS (SELECT model, r.query, rank, CASE WHEN t.item IS NOT NULL THEN 2 WHEN score >= 0.3 THEN 1 ELSE 0 END AS rel FROM (SELECT *, row_number() OVER (PARTITION BY model, query ORDER BY score DESC, item) AS rank FROM ranked QUALIFY rank <= 5) r LEFT JOIN truth t USING (query, item)),
e AS (SELECT *, CAST(rel = 2 AS INT) AS hit, row_number() OVER (PARTITION BY model, query ORDER BY rel DESC, rank) AS ideal, sum(CAST(rel = 2 AS INT)) OVER (PARTITION BY model, query ORDER BY rank) AS hits FROM rel),
m AS (SELECT model, query, round(CASE WHEN sum((pow(2, rel) - 1) / log2(ideal + 1)) = 0 THEN 0 ELSE sum((pow(2, rel) - 1) / log2(rank + 1)) / sum((pow(2, rel) - 1) / log2(ideal + 1)) END, 6) AS ndcg_at_5, CAST(max(CASE WHEN rank = 1 THEN hit ELSE 0 END) AS DOUBLE) AS precision_at_1_strict, round(avg(hit), 6) AS precision_at_5_strict,
 round(coalesce(1.0 / min(rank) FILTER (hit = 1), 0), 6) AS mrr_strict, round(coalesce(sum(hits / rank) FILTER (hit = 1) / sum(hit), 0), 6) AS map_at_5_strict FROM e WHERE query IN (SELECT query FROM truth) GROUP BY model, query),
long AS (UNPIVOT m ON {", ".join(R.METRICS)} INTO NAME metric VALUE v), pairs AS (SELECT unnest([{", ".join(f"'{a}'" for a, _ in R.PAIRS)}]) AS model_a, unnest([{", ".join(f"'{b}'" for _, b in R.PAIRS)}]) AS model_b),
d AS (SELECT model_a, model_b, x.metric, x.v AS a, round(y.v - x.v, 12) AS d FROM pairs JOIN long x ON x.model = model_a JOIN long y ON y.model = model_b AND y.query = x.query AND y.metric = x.metric)"""


def _six(spark, sf):
    """Metrics of all six models side by side, of modules that all of them and the truth know."""
    truth = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_partkey").alias("query"), F.col("l_suppkey").alias("item"))
    pairs = scores(spark, sf).select(F.col("module_id").alias("query"), F.col("staff_id").alias("item"), "score", "core", "pub")
    ranked = R.tops(E.marked(pairs, truth), _MODELS).withColumn("rel", E.relevance())
    wide, _ = materialise(spark, R.aligned(ranked, truth, list(_MODELS)), "six")  # a row a module, read several times
    return wide


@query("v5_bootstrap")
def _(spark, sf):
    """Confidence intervals of five metrics of six models, from shared draws."""
    return R.intervals(_six(spark, sf), "query", [f"{m}_{x}" for m in _MODELS for x in R.METRICS])


@query("v6_v7_paired_tests")
def _(spark, sf):
    """Seven pairs of models by five metrics, with both tests and the one that the check of normality chooses."""
    return R.benchmark(_six(spark, sf))


@query("v7_benchmark", f"""WITH {_SIX_SQL} SELECT model_a, model_b, metric, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(d), 6) AS mean_difference, round(avg(d) / stddev_samp(d), 6) AS cohens_d, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS ttest_statistic,
CAST(count(*) FILTER (d <> 0) AS BIGINT) AS differing FROM d GROUP BY ALL""")
def _(spark, sf):
    """What SQL can tell of the paired tests: 35 rows."""
    wide = _six(spark, sf)
    some = [F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.lit(m).alias("metric"), F.when(F.round(F.col(f"{b}_{m}") - F.col(f"{a}_{m}"), 12) != 0, 1).alias("x")) for a, b in R.PAIRS for m in R.METRICS]
    differing = wide.select(F.explode(F.array(*some)).alias("s")).select("s.*").groupBy("model_a", "model_b", "metric").agg(F.count("x").alias("differing"))
    tests = R.benchmark(wide).select("model_a", "model_b", "metric", "n", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_difference", "cohens_d", "ttest_statistic")])
    return tests.join(differing, ["model_a", "model_b", "metric"])


@query("v8_thresholded_raters", f"WITH {SCORE_SQL}, r AS (SELECT CASE WHEN score >= 0.4 THEN 1 ELSE 0 END AS a, CASE WHEN core >= 0.4 THEN 1 ELSE 0 END AS b FROM score) SELECT a, b, count(*) AS n FROM r GROUP BY a, b")
def _(spark, sf):
    """Two scores made ratings by a threshold; this says nothing about people agreeing."""
    return scores(spark, sf).groupBy((F.col("score") >= 0.4).cast("int").alias("a"), (F.col("core") >= 0.4).cast("int").alias("b")).agg(F.count("*").alias("n"))


# ---- policy ranking of whole modules ---------------------------------------------------------------


@query("c1_home_ranking", f"""WITH {STAFF_SQL}, {MODULE_SQL}, {SCORE_SQL}, e AS (SELECT s.module_id, s.staff_id, s.score, m.department = t.department AS home FROM score s JOIN module m USING (module_id) JOIN staff t USING (staff_id) WHERE regexp_matches(lower(position), 'lecturer|professor|reader|teaching fellow') AND NOT regexp_matches(lower(position), 'emeritus|visiting|research fellow|technician')),
h AS (SELECT module_id, bool_or(home) AS some_ FROM e GROUP BY module_id), p AS (SELECT e.*, some_, row_number() OVER (PARTITION BY module_id ORDER BY score DESC, staff_id) AS rank, count(*) OVER (PARTITION BY module_id) AS pool_n FROM e JOIN h USING (module_id) WHERE home = some_)
SELECT module_id, staff_id, rank, CASE WHEN NOT some_ THEN 'university_fallback_ranked' WHEN pool_n < 2 THEN 'limited_internal_pool' ELSE 'home_department_ranked' END AS status FROM p WHERE rank <= 2""")
def _(spark, sf):
    """The two best of the home department, or of the university where it has nobody eligible."""
    people = staff(spark, sf).where(policy.is_eligible(F.col("position"))).select("staff_id", F.col("department").alias("theirs"))
    pool = scores(spark, sf).select("module_id", "staff_id", "score").join(modules(spark, sf).select("module_id", "department"), "module_id").join(people, "staff_id")
    found = ranking.home_or_fallback(pool.withColumn("home", F.col("department") == F.col("theirs")), "module_id", [F.desc("score"), F.col("staff_id")], 2)
    return found.select("module_id", "staff_id", F.col("rank").cast("long").alias("rank"), "status")


@query("c2_hierarchy_status", f"""WITH {STAFF_SQL}, {MODULE_SQL}, {SCORE_SQL}, i AS (SELECT m.module_id, t.staff_id, t.position FROM module m JOIN staff t ON t.path = m.path OR starts_with(t.path, m.path || '/')),
e AS (SELECT * FROM i WHERE regexp_matches(lower(position), 'lecturer|professor|reader|teaching fellow') AND NOT regexp_matches(lower(position), 'emeritus|visiting|research fellow|technician')),
s AS (SELECT module_id, count(*) AS n, count_if(score >= 0.12 AND greatest(core, pub) >= 0.1) AS ok FROM e JOIN score USING (module_id, staff_id) GROUP BY module_id)
SELECT module_id, CASE WHEN module_id NOT IN (SELECT module_id FROM i) THEN 'no_hierarchy_internal_staff' WHEN module_id NOT IN (SELECT module_id FROM e) THEN 'no_eligible_hierarchy_staff' WHEN n IS NULL THEN 'no_hierarchy_staff_with_m2_evidence' WHEN ok = 0 THEN 'all_hierarchy_candidates_failed_gate' WHEN ok < 5 THEN 'limited_hierarchy_internal_pool' ELSE 'hierarchy_internal_ranked' END AS status FROM module LEFT JOIN s USING (module_id)""")
def _(spark, sf):
    """People are counted by path before they meet modules; only scored pairs are looked at one by one."""
    from matchloom.operators.hierarchy import under

    all_modules = modules(spark, sf).select("module_id", F.col("path").alias("wanted"))
    people = staff(spark, sf).select("staff_id", "path", policy.is_eligible(F.col("position")).alias("fit"))
    per = people.groupBy("path").agg(F.count("*").alias("inside"), F.count_if("fit").alias("fit"))
    inside = under(all_modules, per, "wanted", "path").groupBy("module_id").agg(F.sum("inside").alias("inside"), F.sum("fit").alias("fit"))
    ok = (F.col("score") >= policy.LEAST_TOTAL) & (F.greatest("core", "pub") >= policy.LEAST_FIELD)
    pairs = scores(spark, sf).join(people.where("fit"), "staff_id").join(all_modules, "module_id").where("path = wanted or startswith(path, concat(wanted, '/'))")
    seen = pairs.groupBy("module_id").agg(F.count("*").alias("seen"), F.count_if(ok).alias("ok"))
    n = lambda c: F.coalesce(c, F.lit(0))
    status = F.when(n("inside") == 0, "no_hierarchy_internal_staff").when(n("fit") == 0, "no_eligible_hierarchy_staff").when(n("seen") == 0, "no_hierarchy_staff_with_m2_evidence").when(n("ok") == 0, "all_hierarchy_candidates_failed_gate").when(n("ok") < 5, "limited_hierarchy_internal_pool").otherwise("hierarchy_internal_ranked")
    return all_modules.join(inside, "module_id", "left").join(seen, "module_id", "left").select("module_id", status.alias("status"))


@query("a11_status_summary", f"WITH {_TOP_SQL} SELECT CASE WHEN n < 5 THEN 'limited' ELSE 'full' END AS status, count(*) AS modules, CAST(sum(n) AS BIGINT) AS recs FROM (SELECT module_id, count(*) AS n FROM top GROUP BY module_id) GROUP BY 1")
def _(spark, sf):
    per = _top(spark, sf).groupBy("module_id").agg(F.count("*").alias("n"))
    return per.groupBy(F.when(F.col("n") < 5, "limited").otherwise("full").alias("status")).agg(F.count("*").alias("modules"), F.sum("n").alias("recs"))


@query("a13_candidate_statistics", f"WITH {SCORE_SQL}, p AS (SELECT module_id, count(*) AS n FROM score GROUP BY module_id) SELECT count(*) AS modules, CAST(sum(n) AS BIGINT) AS candidates, round(avg(n), 4) AS mean, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs FROM p")
def _(spark, sf):
    p = scores(spark, sf).groupBy("module_id").agg(F.count("*").alias("n"))
    return p.agg(F.count("*").alias("modules"), F.sum("n").alias("candidates"), F.round(F.avg("n"), 4).alias("mean"), F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"))


@query("a21_comparison_summary", f"WITH {_TOP_SQL}, b AS (SELECT module_id, staff_id AS other FROM (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY core DESC, staff_id) AS k FROM score) WHERE k = 1) SELECT count(*) AS modules, count_if(staff_id <> other) AS changed, round(100.0 * count_if(staff_id <> other) / count(*), 2) AS percent FROM top JOIN b USING (module_id) WHERE rank = 1")
def _(spark, sf):
    other = ranking.best(scores(spark, sf), ["module_id"], [F.desc("core"), F.col("staff_id")]).select("module_id", F.col("staff_id").alias("other"))
    both = _top(spark, sf).where("rank = 1").join(other, "module_id")
    moved = F.count_if(F.col("staff_id") != F.col("other"))
    return both.agg(F.count("*").alias("modules"), moved.alias("changed"), F.round(100.0 * moved / F.count("*"), 2).alias("percent"))


@query("a22_zero_filled", """SELECT t.event_type AS aspect, count(e.event_id) AS n FROM (SELECT DISTINCT event_type FROM events UNION SELECT 'never') t LEFT JOIN events e ON e.event_type = t.event_type AND e.value > 60 GROUP BY 1""")
def _(spark, sf):
    e = table(spark, sf, "events")
    aspects = e.select(F.col("event_type").alias("aspect")).distinct().union(spark.createDataFrame([("never",)], "aspect string"))
    counts = e.where("value > 60").groupBy(F.col("event_type").alias("aspect")).agg(F.count("*").alias("n"))
    return aspects.join(counts, "aspect", "left").select("aspect", F.coalesce("n", F.lit(0)).alias("n"))


@query("a20_chart_data", f"WITH {_TOP_SQL} SELECT 'rank' AS series, CAST(rank AS VARCHAR) AS x, count(*) AS y FROM top GROUP BY rank UNION ALL SELECT 'band', CASE WHEN score >= 0.35 THEN 'high' WHEN score >= 0.2 THEN 'moderate' ELSE 'exploratory' END, count(*) FROM top GROUP BY 2")
def _(spark, sf):
    top = _top(spark, sf)
    a = top.groupBy(F.lit("rank").alias("series"), F.col("rank").cast("string").alias("x")).agg(F.count("*").alias("y"))
    return a.unionByName(top.groupBy(F.lit("band").alias("series"), policy.band(F.col("score")).alias("x")).agg(F.count("*").alias("y")))


@query("p21_c19_uncovered", """WITH g AS (SELECT p_brand AS brand, p_size AS size, count(*) AS n, count_if(p_type IN ('PROMO', 'ECONOMY')) AS led FROM part GROUP BY ALL) SELECT brand, size, CASE WHEN n < 2 THEN 'no_active_gaps' WHEN led = n THEN 'all_gaps_covered_by_lead' WHEN led = 0 THEN 'no_external_candidate' ELSE 'below_score_threshold' END AS reason FROM g""")
def _(spark, sf):
    """Every part is a gap of its brand and size; the lead covers some types."""
    g = table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).agg(F.collect_list(F.col("p_type").isin("PROMO", "ECONOMY")).alias("covered"))
    return g.select("brand", "size", explain.uncovered_reason(F.col("covered"), least=2).alias("reason"))


@query("p22_c20_fallback_cause", f"WITH {STAFF_SQL}, {MODULE_SQL}, c AS (SELECT m.module_id, count(t.staff_id) AS n, count_if(position <> '') AS placed, count_if(regexp_matches(lower(position), 'lecturer|professor|reader')) AS fit FROM module m LEFT JOIN staff t USING (department) GROUP BY m.module_id) SELECT module_id, CASE WHEN n = 0 THEN 'no_staff_in_department' WHEN placed = 0 THEN 'positions_missing' WHEN fit = 0 THEN 'no_eligible_role' ELSE 'covered' END AS cause FROM c")
def _(spark, sf):
    p = F.lower("position")
    per = staff(spark, sf).groupBy("department").agg(F.count("*").alias("n"), F.count_if(p != "").alias("placed"), F.count_if(p.rlike("lecturer|professor|reader")).alias("fit"))
    c = modules(spark, sf).select("module_id", "department").join(per, "department", "left").fillna(0, ["n", "placed", "fit"])
    return c.select("module_id", explain.fallback_cause(F.col("n"), F.col("placed"), F.col("fit")).alias("cause"))


@query("x1_x3_texts", f"WITH {_TOP_SQL} SELECT module_id, staff_id, 'Ranked ' || CAST(rank AS VARCHAR) || ' with a ' || CASE WHEN score >= 0.35 THEN 'high' WHEN score >= 0.2 THEN 'moderate' ELSE 'exploratory' END || ' match' || CASE WHEN module_id % 2 = 0 THEN '; shares topics: a, b' ELSE '' END AS said FROM top")
def _(spark, sf):
    topics = F.when(F.col("module_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return _top(spark, sf).select("module_id", "staff_id", explain.match_text(F.col("rank"), policy.band(F.col("score")), topics).alias("said"))


@query("x3_gap_texts", f"WITH {_TOP_SQL} SELECT module_id, staff_id, 'Person ' || CAST(staff_id AS VARCHAR) || ' can bring rank ' || CAST(rank AS VARCHAR) || ' (' || printf('%.1f%%', score * 100) || ' fit)' AS said FROM top")
def _(spark, sf):
    return _top(spark, sf).select("module_id", "staff_id", explain.gap_text(F.concat(F.lit("Person "), F.col("staff_id").cast("string")), F.concat(F.lit("rank "), F.col("rank").cast("string")), F.col("score")).alias("said"))


@query("x4_allocation_texts", f"""WITH {_TOP_SQL}, l AS (SELECT module_id, max(staff_id) FILTER (rank = 1) AS original, max(score) AS best FROM top GROUP BY module_id)
SELECT module_id, staff_id, CASE WHEN rank = 1 THEN 'UnconstrainedOptimal' WHEN score >= 0.5 THEN 'CapacityQuotaEnforced' ELSE 'ExemptOrUnassigned' END AS kind,
CASE WHEN rank = 1 THEN 'Person ' || CAST(staff_id AS VARCHAR) || ' is the best match and has room' WHEN score >= 0.5 THEN 'Person ' || CAST(staff_id AS VARCHAR) || ' takes over from Person ' || CAST(original AS VARCHAR) || ', who is full (' || CAST(rank - 1 AS VARCHAR) || ' places down)' ELSE 'Person ' || CAST(original AS VARCHAR) || ' keeps the module outside the capacity rules' END AS said FROM top JOIN l USING (module_id)""")
def _(spark, sf):
    top = _top(spark, sf)
    first = top.where("rank = 1").select("module_id", F.col("staff_id").alias("original"))
    person = lambda c: F.concat(F.lit("Person "), F.col(c).cast("string"))
    shift = F.col("rank") - 1
    kind = explain.allocation_kind(shift, F.col("score") >= 0.5)
    return top.join(first, "module_id").select("module_id", "staff_id", kind.alias("kind"), explain.allocation_text(kind, person("staff_id"), person("original"), shift).alias("said"))


@query("x5_reviewer_rows", f"WITH {_TOP_SQL} SELECT module_id, rank, staff_id, '' AS rating FROM module_ids LEFT JOIN top USING (module_id)".replace("module_ids", "(SELECT p_partkey AS module_id FROM part)"))
def _(spark, sf):
    nested = _top(spark, sf).groupBy("module_id").agg(F.collect_list(F.struct("rank", "staff_id")).alias("recs"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("module_id")).join(nested, "module_id", "left")
    return rows.select("module_id", F.explode_outer("recs").alias("r")).select("module_id", "r.rank", "r.staff_id", F.lit("").alias("rating"))
