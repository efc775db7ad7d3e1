"""Executors on other machines that share a mounted folder with the driver: ``file:`` on a remote cluster."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

#: Every query of the analytics that writes tables part-way.
QUERIES = [
    "rewritten_filters", "known_buyers_from_saved", "targeted_buyers_from_saved", "orders_in_range_by_month",
    "daily_sales_by_month", "sales_of_windows", "basket_with_product", "co_purchase", "pair_lines",
    "users_trait", "users_trait_saved", "trait_percentile_curve", "lift_deciles", "lift_percentiles",
    *[f"{job}{trait}_equal_{kind}" for job in ("", "job_") for trait in ("order_avg", "activity", "frequency") for kind in ("count", "width")],
]


@pytest.fixture(scope="module")
def said(tmp_path_factory):
    script = Path(__file__).with_name("cluster_job.py")
    folder = tmp_path_factory.mktemp("cluster")
    done = subprocess.run(
        [sys.executable, str(script), str(folder), *QUERIES], timeout=900, capture_output=True, text=True
    )
    return done.stdout.splitlines() or done.stderr.splitlines()[-3:]


@pytest.mark.parametrize("name", QUERIES)
def test_a_mount_that_the_executors_share_takes_intermediate_tables(said, name):
    assert f"{name} same" in said


def test_the_question_to_the_executors_leaves_nothing(said):
    assert "left 0" in said


def test_a_folder_of_each_machine_is_refused(said):
    assert said[-1].startswith("own refused: set spark.checkpoint.dir")
