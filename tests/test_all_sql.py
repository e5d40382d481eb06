"""Every registered core query with SQL gives what its SQL gives."""

import pytest

from tests.conftest import SMALL
from tests.oracle import compare
from tidemill.plans.catalog import CORE

DONE_ELSEWHERE = {"p1_rules", "p3_found", "p3_grid", "p3_counter", "p5_found", "p5_rolling", "trade_chain", "replay_fold", "bh_stepup", "asof_backward", "asof_strict_recent", "thin_hourly", "time_slice", "unpivot_years", "config_subsets"}


@pytest.mark.parametrize("name", sorted(set(CORE.sql) - DONE_ELSEWHERE))
def test_same_rows(spark, name):
    _, _, extra, missing = compare(spark, CORE.queries[name], CORE.sql[name], SMALL)
    assert not extra and not missing
