"""What the plans of track features cost: passes, joins, rows that a pass holds."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spoorline.functions import rolling
from spoorline.operators.boosting import Tree
from spoorline.plans import catalogue, feature_queries

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_a_query_of_two_features_passes_only_for_them(spark):
    assert plan(spark, "curvature_turn").count("MapInArrow") <= 3


def test_a_pass_holds_few_rows_of_short_tracks():
    n = 30_000
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n) % 10 == 0), pa.array(np.arange(n))], names=["_first", "v"])
    made = list(rolling._whole_groups(iter([batch.slice(0, 10_000), batch.slice(10_000, 9_995), batch.slice(19_995)])))
    assert np.array_equal(np.concatenate([b.column("v").to_numpy() for b in made]), np.arange(n))
    assert all(b.column("_first")[0].as_py() for b in made) and max(b.num_rows for b in made) <= 4096 + 10


def test_sections_share_their_passes(spark):
    text = plan(spark, "single_motion")
    assert text.count("MapInArrow") <= 5 and text.count("Union") == 0


def test_pairs_are_joined_once_and_dealt_without_their_distances(spark):
    text = plan(spark, "pair_posture")
    assert text.count("Join ") == 1
    dealt = text[text.index("RepartitionByExpression") :]
    assert "nose+tail_base" not in dealt and "nose+tail_base" in text


@pytest.mark.parametrize("name, passes", [("single_motion", 2), ("single_head", 1), ("single_shape", 1), ("pair_bodies", 1), ("all_pair_features", 1), ("all_single_features", 2)])
def test_the_row_before_takes_no_pass(spark, name, passes):
    text = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == passes
    # Windows over the row before follow the sort of the blocks: the pass's rows are sorted and dealt once, the tracks' frames before.
    ours = text[text.index("MapInArrow") :]
    one = ours[: ours.index("Exchange")]
    assert one.count("Sort [") == 1


def test_rounding_is_that_of_decimals(spark):
    halves = spark.range(400_000).select((F.col("id") / 32768.0 - 6).cast("float").cast("double").alias("x"))
    rest = spark.range(20_000).select(F.explode(F.array(*[((F.rand(i) - 0.5) * 10**i).cast("float").cast("double") for i in range(9)])).alias("x"))
    odd = spark.sql("select explode(array(double('NaN'), double('Infinity'), null, -0.00001D, 100D, -100000D)) as x")
    x = F.col("x")
    plain = F.when(F.abs(x) < 100, F.round(x, 4)).when(F.abs(x) < 100_000, F.round(x, 1)).otherwise(F.round(x, -2))
    rows = halves.union(rest).union(odd).select(feature_queries.rounded(x).alias("a"), plain.alias("b"))
    assert rows.where("not a <=> b").count() == 0
    # No value is written out as a decimal, which took most of a query's time.
    assert "round(" not in str(feature_queries.rounded(x)).split("ELSE round(")[0]




def test_leaves_by_column_are_those_of_a_walk():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 64, (500, 3)).astype(np.uint8)
    x[rng.random((500, 3)) < 0.2] = 0
    tree = Tree()
    left, right = tree.split(0, 1, 20, True)
    tree.split(left, 0, 63, False)
    tree.split(right, 2, 1, True)

    def walk(row):
        node = 0
        while tree.feature[node] >= 0:
            b = row[tree.feature[node]]
            node = tree.left[node] if (tree.missing[node] if b == 0 else b <= tree.bin[node]) else tree.right[node]
        return node

    assert tree.leaves(np.ascontiguousarray(x.T)).tolist() == tree.place(x).tolist() == [walk(r) for r in x]
