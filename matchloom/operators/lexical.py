"""TF-IDF as long tables: (id, term, weight) instead of matrices.

The vocabulary and the idf come from the supply side alone; terms of the demand side that it lacks
vanish in the join. Scores are an equi-join on term, so pairs without a common term cost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words that are no terms.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "were", "will", "with",
)
ACCENTED, PLAIN = "àáâäãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: Weights of a profile's five fields.
FIELD_WEIGHTS = {"core": 0.35, "titles": 0.15, "abstracts": 0.25, "topics": 0.15, "keywords": 0.10}


def tokens(text: Column) -> Column:
    """Lower-case words of two letters or digits or more, accents stripped, without stop words."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN)
    found = F.regexp_extract_all(plain, F.lit("([a-z0-9]{2,})"))
    return F.filter(found, lambda w: ~w.isin(*STOP_WORDS))


def with_bigrams(t: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.concat_ws(" ", F.get(t, i - 1), F.get(t, i)))
    return F.when(F.size(t) > 1, F.concat(t, pairs)).otherwise(t)


def terms(df: DataFrame, keys: list[str], text: str, bigrams: bool = True, within: DataFrame | None = None) -> DataFrame:
    """keys, term, tf; within: a bounded vocabulary, whose terms alone are counted."""
    # texts are dealt by id before they become many terms, so counts and norms of an id need no exchange of terms
    found = df.select(*keys, F.col(text).alias("__text")).repartition(keys[0]).select(*keys, tokens(F.col("__text")).alias("t"))
    made = with_bigrams(F.col("t")) if bigrams else F.col("t")
    each = found.select(*keys, F.explode(made).alias("term"))
    each = each if within is None else each.join(F.broadcast(within.select("term")), "term", "left_semi")
    return each.groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def counts(df: DataFrame, text: str, bigrams: bool = True) -> DataFrame:
    """term, df, total of all texts, of which each is one row: combined where texts are read, so only a row a task and term is exchanged."""
    made = with_bigrams(F.col("t")) if bigrams else F.col("t")
    ordered = df.select(tokens(F.col(text)).alias("t")).select(F.sort_array(made).alias("term"))
    # each term beside the one before it: of a text's equal terms the first counts for df
    beside = ordered.select(F.explode(F.arrays_zip("term", F.array_prepend("term", F.lit(None)).alias("last"))).alias("x")).select("x.term", "x.last").where("term is not null")
    return beside.groupBy("term").agg(F.count_if(~F.col("term").eqNullSafe(F.col("last"))).alias("df"), F.count("*").alias("total"))


def fit(found: DataFrame, ids: DataFrame, group: list[str] | None = None, max_df: float = 0.95, features: int | None = 75_000) -> DataFrame:
    """group, term, idf of the terms that at most max_df of the ids have; of those the `features` most frequent, or all where it is None."""
    counted = found.groupBy(*(group or []), "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    return fit_counts(counted, ids, group, max_df, features)


def fit_counts(counts: DataFrame, ids: DataFrame, group: list[str] | None = None, max_df: float = 0.95, features: int | None = 75_000) -> DataFrame:
    """As `fit`, from term, df, total (of each group)."""
    group = group or []
    n = ids.groupBy(*group).agg(F.count("*").alias("n")) if group else ids.agg(F.count("*").alias("n"))
    counts = counts.join(F.broadcast(n), group) if group else counts.join(F.broadcast(n), F.lit(True))  # a row a group
    counts = counts.where(F.col("df") <= max_df * F.col("n"))
    w = Window.partitionBy(*group).orderBy(F.desc("total"), "term")
    kept = counts if features is None else counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= features) if group else counts.orderBy(F.desc("total"), "term").limit(features)
    return kept.select(*group, "term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def save(idf: DataFrame, path: str) -> None:
    """Stores a fitted vocabulary."""
    idf.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A stored vocabulary; a term without a weight, or one that comes twice, is an error."""
    idf = spark.read.parquet(path)
    keys = [c for c in idf.columns if c not in ("idf", "asked")]
    if not idf.where("idf is null or idf <= 0").isEmpty() or not idf.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"no vocabulary: {path}")
    return idf


def asked(idf: DataFrame, demand: DataFrame, group: list[str] | None = None) -> DataFrame:
    """idf with `asked`: whether the demand side has the term."""
    on = [*(group or []), "term"]
    return idf.join(demand.select(*on).distinct().withColumn("asked", F.lit(True)), on, "left").withColumn("asked", F.coalesce("asked", F.lit(False)))


def weigh(found: DataFrame, idf: DataFrame, keys: list[str], group: list[str] | None = None, bounded: bool = True) -> DataFrame:
    """keys, term, w: sublinear tf times idf, each id's vector of unit length; only terms that are asked for, where idf tells.

    bounded: whether `fit` had a bound on the terms, so that every task can hold them.
    """
    raw = found.join(F.broadcast(idf) if bounded else idf, [*(group or []), "term"]).withColumn("x", (1.0 + F.log("tf")) * F.col("idf"))
    term = F.struct("term", "x")
    vectors = raw.groupBy(*keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.collect_list(F.when(F.col("asked"), term) if "asked" in idf.columns else term).alias("terms"))
    return vectors.select(*keys, "norm", F.explode("terms").alias("t")).select(*keys, "t.term", (F.col("t.x") / F.col("norm")).alias("w"))


def products(demand: DataFrame, supply: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Common terms of each pair, with the product of their weights; a demand side of few terms goes first."""
    return demand.withColumnRenamed("w", "dw").join(supply.withColumnRenamed("w", "sw"), [*(on or []), "term"]).withColumn("product", F.col("dw") * F.col("sw"))


def top_k(found: DataFrame, demand_id: str, supply_id: str, k: int) -> DataFrame:
    """demand_id, supply_id, score, n_terms, rank; scores equal to nine places count as ties, which go by id."""
    score = found.groupBy(demand_id, supply_id).agg(F.sum("product").alias("score"), F.count("*").alias("n_terms"))
    w = Window.partitionBy(demand_id).orderBy(F.desc(F.round("score", 9)), supply_id)
    return score.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def shared_terms(found: DataFrame, best: DataFrame, demand_id: str, supply_id: str, n: int = 8) -> DataFrame:
    """The n terms that contribute most to each of the best pairs."""
    w = Window.partitionBy(demand_id, supply_id).orderBy(F.desc(F.round("product", 9)), "term")
    return found.join(best.select(demand_id, supply_id), [demand_id, supply_id], "left_semi").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def field_scores(found: DataFrame, weights: dict[str, float], demand_id: str, supply_id: str) -> DataFrame:
    """demand_id, supply_id, field, score, contribution (of the rounded score), total over fields."""
    if abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("field weights must sum to 1")
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("field"))
    each = found.groupBy(demand_id, supply_id, "field").agg(F.sum("product").alias("score"))
    return each.withColumn("contribution", F.round(F.round("score", 6) * weight, 6)).withColumn("total", F.sum(F.col("score") * weight).over(Window.partitionBy(demand_id, supply_id)))
