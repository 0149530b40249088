"""What the operators leave in the shared folder."""

import os

import pytest

from barline.llm import common, registry


def tables(spark):
    d = f"{common.shared_dir(spark)}/barline"
    return set(os.listdir(d)) if os.path.isdir(d) else set()


@pytest.mark.parametrize("name, most", [("op7_suffix_dedup", 1), ("op9_simhash_dedup", 2), ("op4_weighted_sampling", 1), ("op6_source_mixing", 1)])
def test_only_tables_that_the_result_reads_stay(spark, sf_dir, name, most):
    before = tables(spark)
    out = registry.QUERIES[name](spark, sf_dir)
    assert len(tables(spark) - before) <= most and out.count() == 200


def test_a_failed_run_leaves_nothing(spark):
    before = tables(spark)
    with pytest.raises(ValueError), common.scratch(spark):
        common.durable(spark.range(3), "a")
        with common.scratch(spark):
            kept = common.durable(spark.range(3), "b", keep=True)
            common.durable(spark.range(3), "c")
        assert kept.count() == 3 and len(tables(spark) - before) == 2
        raise ValueError
    assert tables(spark) == before
