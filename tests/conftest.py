"""One local session, and small raw tables written by hand."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from retenta.session import build_session
from retenta.sources.retail import RawTables
from retenta.sources.schemas import RAW_SCHEMAS


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="6g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(shared),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str | None):
    return None if text is None else dt.datetime.fromisoformat(text)


def order(order_id, customer_id, bought, delivered=None, estimated="2018-02-01 00:00:00", status="delivered"):
    return (order_id, customer_id, status, at(bought), None, None, at(delivered), at(estimated))


@pytest.fixture(scope="session")
def edge_rows():
    """Rows for the cases that go wrong easily; see the comments."""
    orders = [
        order("o1", "c1", "2018-01-01 23:00:00", "2018-01-02 01:00:00"),  # one midnight
        order("o2", "c2", "2018-01-05 10:00:00", "2018-01-04 10:00:00"),  # before purchase
        order("o3", "c1", "2018-01-10 09:00:00"),  # two payments, items and reviews
        order("o4", "c1", "2018-01-10 21:00:00"),  # same day as o3
        order("o5", "c3", "2018-01-20 00:00:00"),  # paid, no items, no review; on the cutoff
        order("o6", "c3", "2018-01-21 00:00:00"),  # no payment
        order("o7", "c4", "2018-01-22 00:00:00", status="shipped"),
        order("o8", "c4", "2018-01-30 00:00:00"),  # outside of a ten-day window
        order("o9", "c5", "2018-01-12 00:00:00"),  # null values inside
        order("o10", "c6", "2018-01-15 00:00:00"),  # no such customer
        order("o11", "c2", "2018-01-25 00:00:00"),
    ]
    customers = [  # p1 has two ids
        ("c1", "p1", "01", "x", "SP"),
        ("c2", "p1", "01", "x", "SP"),
        ("c3", "p2", "02", "y", "RJ"),
        ("c4", "p3", "03", "z", "MG"),
        ("c5", "p4", "04", "z", "MG"),
    ]
    payments = [
        ("o1", 1, "boleto", 1, 10.25),
        ("o2", 1, "boleto", 1, 20.5),
        ("o3", 1, "credit_card", 3, 30.0),
        ("o3", 2, "voucher", 1, 5.75),
        ("o4", 1, "boleto", 1, 7.0),
        ("o5", 1, "boleto", 1, 100.0),
        ("o7", 1, "boleto", 1, 1.0),
        ("o8", 1, "boleto", 2, 64.01),
        ("o9", 1, "boleto", None, None),
        ("o9", 2, "boleto", 1, 3.33),
        ("o10", 1, "boleto", 1, 9.0),
        ("o11", 1, "boleto", 1, 11.11),
    ]
    items = [
        ("o1", 1, "a", "s", None, 1.0, 1.5),
        ("o2", 1, "b", "s", None, 1.0, 2.5),
        ("o3", 1, "a", "s", None, 1.0, 3.0),
        ("o3", 2, "c", "s", None, 1.0, None),
        ("o4", 1, "unknown", "s", None, 1.0, 4.0),
        ("o8", 1, "b", "s", None, 1.0, 5.25),
        ("o9", 1, None, "s", None, 1.0, 6.0),
        ("o9", 2, "d", "s", None, 1.0, 6.5),
        ("o11", 1, "b", "s", None, 1.0, 1.25),
    ]
    reviews = [
        ("r1", "o1", 5, None, None, None, None),
        ("r2", "o3", 1, None, None, None, None),
        ("r3", "o3", 4, None, None, None, None),
        ("r4", "o8", 3, None, None, None, None),
        ("r5", "o9", None, None, None, None, None),
    ]
    products = [
        ("a", "toys", 1, 1, 1, 1, 1, 1, 1),
        ("b", "art", 1, 1, 1, 1, 1, 1, 1),
        ("c", "toys", 1, 1, 1, 1, 1, 1, 1),
        ("d", None, 1, 1, 1, 1, 1, 1, 1),
    ]
    return {
        "orders": orders,
        "customers": customers,
        "order_payments": payments,
        "order_items": items,
        "order_reviews": reviews,
        "products": products,
        "sellers": [("s", "01", "x", "SP")],
        "geolocation": [],
        "product_category_translation": [("toys", "toys in English")],
    }


@pytest.fixture(scope="session")
def edge_tables(spark, edge_rows) -> RawTables:
    def builder(name):
        return lambda: spark.createDataFrame(edge_rows[name], RAW_SCHEMAS[name])

    return RawTables({name: builder(name) for name in edge_rows})


@pytest.fixture(scope="session")
def sample_rfm(spark):
    """Sixty buyers simulated order by order; each column is computed from their orders."""
    rng = np.random.default_rng(1809)
    today, rows = dt.date(2018, 12, 31), []
    for buyer in range(60):
        first = today - dt.timedelta(days=int(rng.integers(1, 700)))
        gaps = rng.exponential(90.0, rng.poisson(1.5)).astype(int) + 1
        days = [first, *(first + dt.timedelta(days=int(d)) for d in np.cumsum(gaps))]
        days = [day for day in days if day < today]
        spend = rng.gamma(2.0, 40.0, len(days)).round(2)
        rows.append(
            {
                "customer_unique_id": f"buyer-{buyer}",
                "recency_days": (today - days[-1]).days,
                "frequency": len(days),
                "monetary_value": float(spend.sum()),
                "customer_age_days": (today - days[0]).days,
                "customer_lifespan_days": (days[-1] - days[0]).days,
                "avg_order_value": float(spend.mean()),
                "avg_review_score": float(rng.choice([1, 3, 4, 5, 5], len(days)).mean()),
                "avg_delivery_days": float(rng.poisson(8, len(days)).mean()),
                "n_distinct_categories": len(set(rng.integers(0, 12, len(days)).tolist())),
                "avg_freight_value": float(rng.gamma(3.0, 5.0, len(days)).mean()),
                "used_installments": int(rng.random() < 0.4),
            }
        )
    return spark.createDataFrame(pd.DataFrame(rows))
