"""Neighbours, which are quadratic work, are found once by queries that read them several times."""

import pytest

from loomframe.operators import vectors as vec_ops
from loomframe.plans import catalog


@pytest.mark.parametrize("name", ["label_transfer_grid", "label_spreading", "snn_jaccard"])
def test_neighbours_are_found_once(spark, monkeypatch, name):
    seen, plain = spark.sparkContext.accumulator(0), vec_ops.nearest

    def counted(v, k, *more):
        near = plain(v, k, *more)

        def passed(batches):
            for b in batches:
                seen.add(len(b))
                yield b

        return near.mapInArrow(passed, near.schema)

    monkeypatch.setattr(vec_ops, "nearest", counted)
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert seen.value == 500 * 10
