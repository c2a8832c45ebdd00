"""The cells of the grid of topic parameters share what is the same in each, and give what each gives alone."""

import pytest
from pyspark.sql import functions as F

from topicweave.operators import indicators as I
from topicweave.operators.graph import reliable
from topicweave.plans import fixtures as X
from topicweave.plans import stability_queries as G
from topicweave.plans.indicator_queries import Parts


def test_cells_are_those_of_a_plan_each(spark, data, monkeypatch):
    asked, near = [], I.nearest_levels
    monkeypatch.setattr(I, "nearest_levels", lambda v, how: (asked.append(v.count()), near(v, how))[-1])
    p = X.pub(spark, data).withColumn("size", F.length("abstract"))
    n = F.count(F.lit(1))
    sizes = p.filter("topic >= 0").groupBy("phase", "topic").agg(n.alias("n"))
    p = p.join(sizes, ["phase", "topic"], "left").withColumn("n", F.coalesce("n", F.lit(0))).cache()
    monkeypatch.setattr(G, "LEAST", (1, 4, 8))
    got = {(r.phase, r.topic): r for r in G._of_cells(spark, data, p).collect()}
    assert asked == [X.vectors(spark, data, p).count()]  # one pass for all cells
    seen = 0
    for cell, least in enumerate(G.LEAST):
        own = p.withColumn("topic", F.when(F.col("n") >= least, F.col("topic")).otherwise(-1))
        parts = Parts(spark, data, pub=own)
        for name in ("pe1", "pe2", "ds3", "ip1", "eo3"):
            one = I.relative_proportion(reliable(I.tem_metrics(I.yearly_shares(own)))) if name == "pe1" else parts.make(name)
            for r in one.collect():
                assert got[r.phase * 10 + cell, r.topic][name] == pytest.approx(r[name], abs=1e-12)
                seen += name == "pe2"
    assert seen == len(got) and len({k[0] for k in got}) == 6
