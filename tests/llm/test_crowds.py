"""How operators 3 and 11 keep crowds from meeting all with all."""

import random

from pyspark.sql import functions as F

from matchloom.llm import op03_jaccard as jaccard
from matchloom.llm import op11_minhash as minhash
from matchloom.llm.common import ready
from matchloom.session import Scratch


def crowd(spark, n, words=120, edits=4):
    r = random.Random(5)
    base = [f"w{i}" for i in range(words)]
    texts = []
    for i in range(n):
        w = base[:]
        for at in r.sample(range(words), edits):
            w[at] = f"w{r.randint(0, 40)}"
        texts.append((i, " ".join(w)))
    return spark.createDataFrame(texts, "doc_id long, text string")


def test_a_crowd_becomes_few_components_in_blocks(spark):
    for kind in (jaccard._Join, minhash._Collisions):
        join = kind(crowd(ready(spark), 150, edits=1), Scratch(spark), 3, 80, "doc_id", "text")
        assert join.add(join.searched(join.by_crowd(join.mixed(), 0)))
        assert join.roots.count() > 120


def test_pairs_come_from_the_first_list_that_they_share(spark):
    join = jaccard._Join(crowd(ready(spark), 30, edits=2), Scratch(spark), 3, 80, "doc_id", "text")
    all_ = join.with_firsts(join.mixed())
    every = all_.alias("x").join(all_.alias("y"), join.matched() & (F.col("x.node") > F.col("y.node"))).select("x.node", "y.node").toDF("a", "b")
    first = all_.alias("x").join(all_.alias("y"), join.matched() & join.first_shared() & (F.col("x.node") > F.col("y.node"))).select("x.node", "y.node").toDF("a", "b")
    pairs = {tuple(r) for r in every.collect()}
    assert pairs and {tuple(r) for r in first.collect()} == pairs
    assert first.count() < every.count() / 2


def test_components_stand_in_in_each_of_their_lists(spark):
    """Two pairs of lone nodes in two lists: the second is looked at nowhere else, so that one pair of nodes for two components loses it."""
    ready(spark)
    join = object.__new__(minhash._Collisions)
    join.spark, join.scratch, join.percent = spark, Scratch(spark), 80
    left = spark.createDataFrame([(10, 1, 1), (10, 3, 3), (11, 2, 1), (11, 4, 3)], "key long, node long, comp long")
    left = left.withColumns({"size": F.lit(100), "at": F.lit(0), "moved": F.lit(True)})
    join.sketches = spark.range(1, 5).select(F.col("id").alias("node"), *[F.lit(0).cast("long").alias(f"p{i}") for i in range(join.sketch_words)])
    assert {(r["a"], r["b"]) for r in join.stand_ins(left).collect()} == {(3, 1), (4, 2)}


def test_small_tables_go_in_few_tasks(spark):
    """A stage's tasks each leave files of their own, so that many for few rows take disk by themselves."""
    import glob

    from matchloom.operators.components import components
    from matchloom.session import tasks

    settings = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        scratch = Scratch(ready(spark))
        found = components(spark.range(3000).selectExpr("id as a", "id - id % 10 as b"), scratch)
        assert {r["root"] for r in found.collect()} == set(range(0, 3000, 10)) and found.count() == 2700
        assert len(glob.glob(f"{scratch.paths[-1].removeprefix('file://')}/*.parquet")) <= tasks(spark, 2700) < 97
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
