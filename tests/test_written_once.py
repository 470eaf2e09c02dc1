"""Medians by counting read the cells' metrics many times, so these are made from the counts once."""

import pytest

from loomframe.plans.catalog import QUERIES


@pytest.mark.parametrize("name", ["qc_sample_stats", "mad_mask_filter"])
def test_the_entries_are_read_once(spark, name):
    files = QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any("lineitem" in f for f in files)
