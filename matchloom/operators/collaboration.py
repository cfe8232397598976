"""Topic profiles, pairs that complete each other, and gaps that outsiders fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.ranking import top_k


def evidence(assigned: DataFrame, entity: str) -> DataFrame:
    """entity, topic, n, fields, score, weight of assignments (entity, topic, field, weight, similarity)."""
    each = assigned.groupBy(entity, "topic").agg(F.sum(F.col("weight") * F.col("similarity")).alias("direct"), F.count("*").alias("n"), F.count_distinct("field").alias("fields"))
    scored = each.withColumn("score", F.col("direct") + F.log(1.0 + F.col("n")) + 0.25 * F.log(1.0 + F.col("fields")))
    return scored.withColumn("weight", F.col("score") / F.max("score").over(Window.partitionBy(entity))).drop("direct")


def relevance(staff: DataFrame, module: DataFrame) -> DataFrame:
    """staff_id, module_id, matched, relevance: how much of a module's topic weight a person covers."""
    total = module.groupBy("module_id").agg(F.sum("w").alias("total"))
    both = module.withColumnRenamed("w", "mw").join(staff.withColumnRenamed("w", "sw"), "topic")
    each = both.groupBy("module_id", "staff_id").agg(F.count("*").alias("matched"), F.sum(F.least("mw", "sw")).alias("covered"))
    return each.join(total, "module_id").select("module_id", "staff_id", "matched", (F.col("covered") / F.col("total")).alias("relevance"))


def candidates(rel: DataFrame, least: float = 0.10, most: int = 20) -> DataFrame:
    order = [F.desc(F.round("relevance", 9)), F.desc("matched"), F.desc("staff_id")]
    return top_k(rel.where(F.round("relevance", 9) >= least), ["module_id"], order, most, "place")


def pairs(chosen: DataFrame, staff: DataFrame, module: DataFrame, least_gain: float = 0.05, most: int = 50) -> DataFrame:
    """Pairs of a module's candidates with coverage, gain, overlap and score; the pruned candidates bound their number.

    What both cover of a topic is the smaller of their shares, so a pair's coverage is both people's less the sum of these over the
    topics that both have: a join on (module, topic). How far two people's topics overlap is found once for each two people.
    """
    total = module.groupBy("module_id").agg(F.sum("w").alias("total"))
    held = chosen.select("module_id", "staff_id").join(staff.withColumnRenamed("w", "sw"), "staff_id").join(module.withColumnRenamed("w", "mw"), ["module_id", "topic"]).select("module_id", "topic", "staff_id", F.least("mw", "sw").alias("h"))
    side = lambda df, who, *keep: df.select(*keep, F.col("staff_id").alias(who), *[F.col(c).alias(f"{c}_{who}") for c in df.columns if c not in (*keep, "staff_id")])
    twice = side(held, "a", "module_id", "topic").join(side(held, "b", "module_id", "topic"), ["module_id", "topic"]).where("a < b").groupBy("module_id", "a", "b").agg(F.sum(F.least("h_a", "h_b")).alias("twice"))
    known = chosen.select("module_id", "staff_id", "relevance")
    both = side(known, "a", "module_id").join(side(known, "b", "module_id"), "module_id").where("a < b").join(twice, ["module_id", "a", "b"], "left").join(total, "module_id")
    people = both.select("a", "b").distinct()
    sizes = staff.groupBy("staff_id").agg(F.count_distinct("topic").alias("n"))
    topics = staff.select("staff_id", "topic").distinct()
    common = people.join(side(topics, "a", "topic"), "a").join(side(topics, "b", "topic"), ["b", "topic"]).groupBy("a", "b").agg(F.count("*").alias("common"))
    shared = F.coalesce("common", F.lit(0))
    overlap = people.join(side(sizes, "a"), "a").join(side(sizes, "b"), "b").join(common, ["a", "b"], "left").select("a", "b", (shared / (F.col("n_a") + F.col("n_b") - shared)).alias("overlap"))
    best, coverage = F.greatest("relevance_a", "relevance_b"), F.col("relevance_a") + F.col("relevance_b") - F.coalesce("twice", F.lit(0.0)) / F.col("total")
    found = both.select("module_id", "a", "b", best.alias("best"), coverage.alias("coverage")).withColumn("gain", F.greatest(F.lit(0.0), F.col("coverage") - F.col("best"))).where(F.round("gain", 9) >= least_gain)
    score = 0.50 * F.col("coverage") + 0.35 * F.col("gain") + 0.10 * F.col("best") + 0.05 * F.least("overlap", F.lit(0.2)) / 0.2
    return top_k(found.join(overlap, ["a", "b"]).withColumn("score", score), ["module_id"], [F.desc(F.round("score", 9)), F.desc("a"), F.desc("b")], most)


def gaps(affinity: DataFrame, usual: float = 0.20, again: float = 0.18) -> DataFrame:
    """Aspects a module needs: module_id, aspect, affinity, lead -> gap and need. Where none reaches `usual`, `again` does."""
    some = F.max(F.col("affinity") >= usual).over(Window.partitionBy("module_id"))
    kept = affinity.withColumn("__least", F.when(some, usual).otherwise(again)).where(F.col("affinity") >= F.col("__least")).drop("__least")
    gap = kept.withColumn("gap", F.round(F.col("affinity") * F.greatest(F.lit(0.0), 1.0 - F.col("lead") / 0.65), 4))
    return gap.withColumn("need", F.when(F.col("lead") >= 0.55, "Covered By Primary Lead").when(F.col("gap") >= 0.35, "High Co-Delivery Need").otherwise("Moderate Co-Delivery Need"))


def gap_fillers(found: DataFrame, offers: DataFrame, least_affinity: float = 0.28, least_score: float = 0.26, most: int = 3) -> DataFrame:
    """module_id, aspect, staff_id, score: gap by gap the best person not yet taken, at most `most` a module.

    offers: module_id, aspect, staff_id, affinity, fit. Each gap only needs its `most` best, for the
    others can be taken; the choice is a fold over the ordered gaps within one row.
    """
    scored = offers.where(F.col("affinity") >= least_affinity).withColumn("score", 0.7 * F.col("affinity") + 0.3 * F.greatest(F.lit(0.0), F.col("fit"))).where(F.col("score") >= least_score)
    short = top_k(scored, ["module_id", "aspect"], [F.desc(F.round("score", 9)), F.col("staff_id")], most, "place")
    each = short.groupBy("module_id", "aspect").agg(F.array_sort(F.collect_list(F.struct("place", "staff_id", "score"))).alias("offers"))
    open_gaps = found.where("need <> 'Covered By Primary Lead'").join(each, ["module_id", "aspect"])
    rows = open_gaps.groupBy("module_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("gap")).alias("order"), "aspect", "offers"))).alias("gaps"))
    nothing = F.array().cast("array<struct<aspect:string,staff_id:bigint,score:double>>")

    def step(acc, gap):
        free = F.filter(gap["offers"], lambda o: ~F.exists(acc, lambda t: t["staff_id"] == o["staff_id"]))
        first = F.get(free, 0)
        pick = F.struct(gap["aspect"].alias("aspect"), first["staff_id"].alias("staff_id"), first["score"].alias("score"))
        return F.when((F.size(acc) >= most) | (F.size(free) == 0), acc).otherwise(F.concat(acc, F.array(pick)))

    return rows.select("module_id", F.explode(F.aggregate("gaps", nothing, step)).alias("x")).select("module_id", "x.*")


def graph_support(n: Column, strength: Column, same_department: Column, same_college: Column) -> Column:
    """How strongly a graph of shared topics and units speaks for a pair, at most 1."""
    return F.least(F.lit(1.0), 0.5 * F.least(n / 5, F.lit(1.0)) + 0.3 * F.least(strength / 30, F.lit(1.0)) + 0.15 * same_department.cast("double") + 0.05 * same_college.cast("double"))


def shared_topics(module: DataFrame, staff: DataFrame, pairs_of: DataFrame, n: int = 5) -> DataFrame:
    """module_id, staff_id, shared, strength, names: what both sides have, and the n strongest of it."""
    both = pairs_of.join(module.withColumnRenamed("score", "ms"), "module_id").join(staff.withColumnRenamed("score", "ss"), ["staff_id", "topic"])
    w = Window.partitionBy("module_id", "staff_id").orderBy(F.desc(F.col("ms") + F.col("ss")), "topic")
    ranked = both.withColumn("both", F.col("ms") + F.col("ss")).withColumn("place", F.row_number().over(w))
    top = F.col("place") <= n
    return ranked.groupBy("module_id", "staff_id").agg(
        F.count("*").alias("shared"), F.sum(F.when(top, F.col("both")).otherwise(0)).alias("strength"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(top, F.struct("place", "topic")))), lambda x: x["topic"]), ", ").alias("names"),
    )


def rerank(df: DataFrame, semantic: str, graph: str, group: str, ids: str, share: float = 0.8) -> DataFrame:
    """hybrid and rank: mostly the semantic score, the rest graph support; pairs without support have 0."""
    hybrid = F.round(share * F.col(semantic) + (1 - share) * F.coalesce(graph, F.lit(0.0)), 6)
    w = Window.partitionBy(group).orderBy(F.desc("hybrid"), F.desc(semantic), ids)
    return df.withColumn("hybrid", hybrid).withColumn("rank", F.row_number().over(w))


def foundation(pairs: DataFrame, topics: DataFrame, vectors: DataFrame, least: float = 0.80, most: int = 5) -> DataFrame:
    """a, b -> kind (exact, semantic or none), similarity and evidence of what two people share.

    pairs: a, b; topics: staff_id, topic (few for a person); vectors: topic, vector. Pairs with a topic
    in common are exact; only the others are compared topic by topic.
    """
    from matchloom.functions.vectors import cosine

    one = topics.select(F.col("staff_id").alias("a"), F.col("topic").alias("ta"))
    two = topics.select(F.col("staff_id").alias("b"), F.col("topic").alias("tb"))
    exact = pairs.join(one, "a").join(two, "b").where("ta = tb").groupBy("a", "b").agg(F.array_sort(F.collect_set("ta")).alias("common"))
    rest = pairs.join(exact, ["a", "b"], "left_anti").join(one, "a").join(two, "b")
    known = rest.join(vectors.select(F.col("topic").alias("ta"), F.col("vector").alias("va")), "ta").join(vectors.select(F.col("topic").alias("tb"), F.col("vector").alias("vb")), "tb")
    scored = known.withColumn("s", cosine(F.col("va"), F.col("vb")))
    w = Window.partitionBy("a", "b").orderBy(F.desc(F.round("s", 9)), "ta", "tb")
    kept = scored.withColumn("k", F.row_number().over(w))
    near = kept.groupBy("a", "b").agg(F.max("s").alias("best"), F.array_sort(F.collect_list(F.when((F.col("k") <= most) & (F.col("s") >= least), F.concat_ws("~", "ta", "tb")))).alias("like"))
    out = pairs.join(exact, ["a", "b"], "left").join(near, ["a", "b"], "left")
    like = F.coalesce("like", F.array().cast("array<string>"))
    kind = F.when(F.col("common").isNotNull(), "exact").when(F.size(like) > 0, "semantic").otherwise("none")
    return out.select("a", "b", kind.alias("kind"), F.when(F.col("common").isNotNull(), 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("similarity"), F.coalesce("common", like).alias("evidence"))


def unified(modules: DataFrame, taught: Column, primary: DataFrame, found_gaps: DataFrame, fillers: DataFrame) -> DataFrame:
    """One record a module: classification, primary candidates, gaps and collaborators; modules that aren't taught have no second layer."""
    one = primary.groupBy("module_id").agg(F.array_sort(F.collect_list(F.struct("rank", "staff_id", "score"))).alias("candidates"))
    two = found_gaps.groupBy("module_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("gap")).alias("order"), "aspect", "need"))).alias("gaps"))
    three = fillers.groupBy("module_id").agg(F.array_sort(F.collect_list(F.struct("aspect", "staff_id", "score"))).alias("collaborators"))
    rows = modules.withColumn("taught", taught).join(one, "module_id", "left").join(two, "module_id", "left").join(three, "module_id", "left")
    kept = lambda c: F.when(F.col("taught"), F.col(c))
    return rows.select(*modules.columns, F.when(F.col("taught"), "taught_academic").otherwise("independent_project_placement").alias("classification"), "candidates", kept("gaps").alias("gaps"), kept("collaborators").alias("collaborators"))
