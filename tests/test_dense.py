"""Dense scores in blocks."""

import numpy as np

from matchloom.operators import semantic


def test_blocks_hold_a_bounded_number_of_scores(spark, monkeypatch):
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [round(float(x), 1) for x in r.random(4)]) for i in range(60)], "id long, vector array<double>").coalesce(1)
    demand, supply = df.withColumnRenamed("id", "demand_id"), df.withColumnRenamed("id", "supply_id")
    found = lambda: sorted((x["demand_id"], x["supply_id"], x["rank"], round(x["score"], 9)) for x in semantic.block_top_k(demand, supply, {"x": (0, 2, 0.6), "y": (2, 4, 0.4)}, 3).collect())
    whole = found()
    monkeypatch.setattr(semantic, "CELLS", 130)  # two demand rows a block
    assert len(whole) == 180 and found() == whole
