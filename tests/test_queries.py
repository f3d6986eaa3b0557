"""Registered queries against their SQL on the smallest data folder.

Raster queries take longer; a few stand for them here. ``tests/compare.py`` runs them all.
"""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import connect, differences  # noqa: E402

from scanloom import registry  # noqa: E402
from scanloom.plans import all_oracles, all_queries  # noqa: E402

QUERIES, ORACLES = all_queries(), all_oracles()
RASTER = {"pixel_histogram", "light_presets", "paper_mask", "sauvola_masks", "warped_bilinear", "rotated_pages"}
NAMES = [
    n for n in ORACLES
    if n in RASTER or not registry.QUERIES[n].__module__.rsplit(".", 1)[-1].startswith("raster")
]


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, small, con, name):
    got = QUERIES[name](spark, small).toPandas()
    assert len(got) > 0
    assert differences(got, con.execute(ORACLES[name]).df()) is None


def test_every_check_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(set(QUERIES) - set(ORACLES)) <= 8
