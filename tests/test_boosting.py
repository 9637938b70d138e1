"""Trees by histograms are those that Spark's own trees of the same depth are, in few jobs a round."""

from __future__ import annotations

import math
import random

from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from tidewater.operators import boosting
from tidewater.session import settled


def test_trees_are_those_of_spark(spark):
    rng = random.Random(6)
    data = [(i, [rng.choice([0.0, 0.0, rng.random()]), float(rng.randrange(3)), rng.gauss(0, 1)]) for i in range(400)]
    data = [(i, x, int(x[0] > 0.4 or x[2] > 0.9 - x[1]), i % 7 == 0) for i, x in data]
    table = spark.createDataFrame(data, "id int, x array<double>, target int, judge boolean").repartition(3)
    learnt = [r for r in data if not r[3]]
    start = [math.log(sum(r[2] == k for r in learnt) / len(learnt)) for k in range(2)]
    places, values = boosting.sparse(F.col("x"), 3)
    listed = settled(table.select("target", "judge", places.alias("places"), values.alias("values")), "listed")
    cuts = boosting.borders(listed.filter("NOT judge"), len(learnt), 3)
    rows = settled(boosting.binned(listed, cuts, start), "scores")
    context = spark.sparkContext
    context.setJobGroup("grown", "grown")
    trees = boosting.grown(rows, cuts, [], 0.5, 2, 3)
    context.setJobGroup("other", "other")
    # A job a level, and those that adaptive execution makes of it; before, each label's tree took as many and more.
    assert len(context.statusTracker().getJobIdsForGroup("grown")) <= 2 * 3
    found = {r["id"]: r["s"] for r in table.select("id", boosting.scores_of(F.col("x"), start, 0.5, [trees]).alias("s")).collect()}
    for k in range(2):
        own = spark.createDataFrame([(Vectors.dense(r[1]), float(r[2] == k) - math.exp(start[k])) for r in learnt], ["features", "label"])
        model = DecisionTreeRegressor(maxDepth=3, seed=7).fit(own)
        for i, x, _, _ in data:
            assert abs(start[k] + 0.5 * model.predict(Vectors.dense(x)) - found[i][k]) < 1e-6
