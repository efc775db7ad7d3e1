from __future__ import annotations

import sys
from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tillscope.session import local_session  # noqa: E402

LINE_SCHEMA = (
    "user_id long, order_id long, product_id string, pay_date date, quantity double,"
    " pay_amt decimal(18,2), order_status string"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    session = local_session(
        4,
        app="tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": folder,
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lines(spark):
    """Order lines from short tuples: user, order, product, day, quantity, amount, status."""

    def build(rows):
        full = []
        for row in rows:
            user, order, product, day, *rest = row
            quantity, amount, status = [*rest, *[1.0, 10, "Sent"][len(rest) :]]
            full.append(
                (
                    user,
                    order,
                    product,
                    None if day is None else date.fromisoformat(day),
                    None if quantity is None else float(quantity),
                    None if amount is None else Decimal(str(amount)),
                    status,
                )
            )
        return spark.createDataFrame(full, LINE_SCHEMA)

    return build


@pytest.fixture(scope="session")
def products(spark):
    def build(*rows):
        return spark.createDataFrame(
            list(rows),
            "product_id long, product_name string, category_1 string, category_2 string",
        )

    return build


@pytest.fixture(scope="session")
def traits(spark):
    """Traits from values of one trait; the others are constant."""

    def build(values, column="order_avg"):
        names = ("order_avg", "activity", "frequency")
        kinds = {"order_avg": float, "activity": int, "frequency": float}
        rows = [
            (i, *[kinds[n](v if n == column else 1) if v is not None else None for n in names])
            for i, v in enumerate(values)
        ]
        return spark.createDataFrame(
            rows, "user_id long, order_avg double, activity int, frequency double"
        )

    return build


@pytest.fixture(scope="session")
def tuples():
    def rows(df):
        return [tuple(r) for r in df.collect()]

    return rows
