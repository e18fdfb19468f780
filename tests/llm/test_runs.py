"""Pipeline runs beside each other."""

import pytest


def test_a_run_leaves_the_results_of_others_alone(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    first = pipeline.run(spark, "/root/testdata/sf0.001")
    second = pipeline.run(spark, "/root/testdata/sf0.001")
    rows = sorted(map(repr, first.collect()))
    assert rows == sorted(map(repr, second.collect())) and rows
    assert rows == sorted(map(repr, first.collect()))
    pipeline.release(spark)
