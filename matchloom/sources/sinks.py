"""Writers: JSON lines, CSV, whole-table swaps, models, graphs and reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.session import remove


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a header after a byte order mark; columns that aren't asked for are left out, and those that df lacks are ignored."""
    kept = [c for c in columns or df.columns if c in df.columns]
    df.select(*[F.col(c).alias("\ufeff" + c if not i else c) for i, c in enumerate(kept)]).write.mode("overwrite").option("header", True).csv(path)


def swapped(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Writes beside the path, in the order asked for, and renames: a reader sees the old table or the new one, or for a moment none, and never half of one."""
    spark = df.sparkSession
    df = df.orderBy(*order) if order else df
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(new), at(path))
    remove(spark, old)


def markdown(df: DataFrame, title: str, limit: int = 200) -> str:
    """A report's table; the limit is the report's."""
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "-|" * len(df.columns)
    return f"## {title}\n\n{head}\n" + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in rows)


def summary(rows: dict[str, DataFrame]) -> str:
    """JSON of small aggregates: one row becomes an object, several a list."""
    out = {}
    for name, df in rows.items():
        got = [r.asDict(recursive=True) for r in df.collect()]
        out[name] = got[0] if len(got) == 1 else got
    return json.dumps(out, indent=2, ensure_ascii=False, default=str)


def graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node-link JSON lines: one text a node and an edge, tagged."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("json"))
    return n.unionByName(edges.select(F.lit("link").alias("kind"), F.to_json(F.struct(*edges.columns)).alias("json")))


_HEAD = (
    '<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="edge_type" for="edge" attr.name="edge_type" attr.type="string"/>',
    '<key id="node_type" for="node" attr.name="node_type" attr.type="string"/>', '<graph edgedefault="directed">',
)


def graphml_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """place, line of a whole GraphML document: its head, nodes, edges and end; `write_lines` keeps that order."""
    spark = nodes.sparkSession
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(_HEAD)] + [(9_000, "</graph>"), (9_001, "</graphml>")], "place int, line string")
    body = graphml(nodes, edges)
    return frame.unionByName(body.select(F.when(F.col("line").startswith("<node"), 100).otherwise(200).alias("place"), "line"))


def write_lines(df: DataFrame, path: str) -> None:
    """Text files that, one after the other by name, hold the lines by place."""
    df.orderBy("place", "line").select("line").write.mode("overwrite").text(path)


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a GraphML document's body."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    n = nodes.select(F.format_string('<node id="%s"><data key="node_type">%s</data></node>', esc("id"), esc("node_type")).alias("line"))
    return n.unionByName(edges.select(F.format_string('<edge source="%s" target="%s"><data key="edge_type">%s</data></edge>', esc("source"), esc("target"), esc("edge_type")).alias("line")))


def bundle(primary: DataFrame | None, fallback: DataFrame, links: DataFrame, key: str = "module_id") -> DataFrame:
    """Records of a web bundle: the allocated ones if there are any, with each one's links nested."""
    base = primary if primary is not None and not primary.isEmpty() else fallback
    nested = links.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in links.columns if c != key]))).alias("links"))
    empty = F.array().cast(nested.schema["links"].dataType)
    return base.join(nested, key, "left").withColumn("links", F.coalesce("links", empty))


def save_vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str, weights: dict[str, float], size: int) -> DataFrame:
    """Stored vectors (entity, id, field, vector), checked: weights sum to 1, all fields there, all vectors of one size."""
    if abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError("weights must sum to 1")
    df = spark.read.parquet(path)
    told = df.agg(F.collect_set("field").alias("fields"), F.min(F.size("vector")).alias("a"), F.max(F.size("vector")).alias("b")).first()
    if missing := set(weights) - set(told["fields"]):
        raise ValueError(f"no vectors for {sorted(missing)}")
    if (told["a"], told["b"]) != (size, size):
        raise ValueError(f"vectors of {told['a']} to {told['b']} numbers, not {size}")
    return df
