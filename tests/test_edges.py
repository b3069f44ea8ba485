import pytest

import edges
from pitloom.plans import general, reference


@pytest.mark.parametrize("kind", edges.KINDS)
def test_queries(spark, base, tmp_path, kind):
    edges.run(spark, base, edges.write(spark, base, kind, tmp_path), kind, general.QUERIES)


#: Queries over the reference's operators that hold what the others are made of, on tables without rows and of nulls.
REFERENCE = [
    "bars_in_force", "returns_labels", "returns_interval_join", "macro_asof_daily", "macro_pivot_wide", "mc_yoy", "vintage_reconstruct", "facts_pit_asof", "features_assembled", "baseline_top_rank", "portfolio_by_fold",
    "run_pooled", "calibration", "deflated_sharpe", "bootstrap_ci", "drift_status", "perf_status", "dq_contract_counts", "dq_first_violation", "dq_bar_events", "json_facts_messy", "snapshot_store_returns", "sample_exact_n",
]


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_reference_queries(spark, base, tmp_path, kind):
    folder = edges.write(spark, base, kind, tmp_path)
    for name in REFERENCE:
        got = reference.QUERIES[name](spark, folder).collect()
        assert kind == "nulls" or got == [] or name in ("calibration", "dq_contract_counts"), name
