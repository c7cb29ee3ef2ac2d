"""What the physical plans must and must not hold."""

import pytest
from pyspark.sql import functions as F

from effectframe.operators.sequences import distinct_sequences, kmer_encoder
from effectframe.operators.splits import split_by_group
from effectframe.queries import REGISTRY, standins
from smallest import SF

ROW_LEVEL = [
    "curate_labels", "group_split", "json_flatten", "seq_annotation_join", "merge_back", "variant_windows",
    "kmer_embed", "graph_build", "hub_prune", "edge_holdout", "feature_concat", "prompt_context",
    "two_class_score",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ROW_LEVEL)
def test_no_single_task_and_no_python(spark, name):
    text = plan(REGISTRY[name].run(spark, SF))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert word not in text, f"{name}: {word}"
    # What meets in one task is one partial sum per task, never rows.
    lines = text.splitlines()
    for line, below in zip(lines, lines[1:], strict=False):
        if "SinglePartition" in line:
            assert "keys=[], functions=[partial_" in below, f"{name}: {below}"


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(REGISTRY["semi_slice"].run(spark, SF))
    assert "l_extendedprice" not in text and "PushedFilters: [IsNotNull(l_orderkey)" in text.replace("[IsNotNull(o_", "[")


def test_tokens_are_counted_where_their_text_is(spark):
    texts = distinct_sequences(spark.createDataFrame([("ACGT",)], "seq string"), ["seq"])
    exchanges = [line for line in plan(kmer_encoder(3, 8)(texts)).splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "seq_id" in exchanges[0]


def test_hot_genes_are_salted(spark):
    df = spark.range(10).select(F.lit("g").alias("GeneSymbol"), F.lit(1).alias("_y"), "id")
    assert "__salt" in plan(split_by_group(df))


def test_loci_are_not_dealt_by_hand(spark):
    """The join with the bins places the loci; a shuffle of all lines before it was one too many."""
    assert "RepartitionByExpression" not in standins.loci(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
