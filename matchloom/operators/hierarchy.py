"""Units in a tree, labels that name them, and who belongs under whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """The path and all above it: a/b/c gives a, a/b, a/b/c."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def under(demand: DataFrame, supply: DataFrame, demand_path: str, supply_path: str) -> DataFrame:
    """Pairs whose supply path is the demand path or below it, as an equi-join on exploded ancestors."""
    spread = supply.withColumn("__above", F.explode(ancestors(F.col(supply_path))))
    return demand.join(spread, F.col(demand_path) == F.col("__above")).drop("__above")


def units(raw: DataFrame, path: str = "path", name: str = "name") -> tuple[DataFrame, DataFrame]:
    """(unit rows with level and parent; problems: repeated paths, empty names, missing parents)."""
    parts = F.split(path, "/")
    known = raw.withColumn("level", F.element_at(F.array(F.lit("college"), F.lit("department"), F.lit("division")), F.least(F.size(parts), F.lit(3)))).withColumn("parent_path", F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")))
    repeated = raw.groupBy(path).count().where("count > 1").select(F.col(path).alias("path"), F.lit("duplicate_path").alias("problem"))
    empty = raw.where(F.trim(F.coalesce(F.col(name), F.lit(""))) == "").select(F.col(path).alias("path"), F.lit("empty_name").alias("problem"))
    orphans = known.where("parent_path is not null").select(F.col(path).alias("path"), "parent_path").join(raw.select(F.col(path).alias("parent_path")), "parent_path", "left_anti").select("path", F.lit("missing_parent").alias("problem"))
    return known, repeated.unionByName(empty).unionByName(orphans)


def resolve(labels: DataFrame, index: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """key, label -> status and path: a mapping's entry wins, else one indexed unit resolves, several are ambiguous.

    index, mapping: label, path. Empty labels are missing.
    """
    many = index.groupBy("label").agg(F.count_distinct("path").alias("n"), F.min("path").alias("one"))
    found = labels.join(many, "label", "left")
    if mapping is not None:
        found = found.join(mapping.select("label", F.col("path").alias("mapped")), "label", "left")
    else:
        found = found.withColumn("mapped", F.lit(None).cast("string"))
    n = F.coalesce("n", F.lit(0))
    status = F.when(F.coalesce("label", F.lit("")) == "", "missing").when(F.col("mapped").isNotNull() | (n == 1), "resolved").when(n > 1, "ambiguous").otherwise("unresolved")
    return found.withColumn("status", status).withColumn("path", F.when(F.col("status") == "resolved", F.coalesce("mapped", "one"))).drop("n", "one", "mapped")


def bounded(labels: DataFrame, most: int = 20_000) -> DataFrame:
    """The labels, once their number is measured: comparing all with all is for catalogues, and more is an error."""
    n = labels.count()
    if n > most:
        raise ValueError(f"{n} labels, {most} are allowed")
    return labels


def outside(a: Column, b: Column) -> Column:
    """Neither label holds the other; an empty label is unknown, not inside."""
    return (a != "") & (b != "") & ~F.contains(a, b) & ~((F.length(b) > 3) & F.contains(b, a))
