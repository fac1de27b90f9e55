import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tabsense.session import local_session
    s = local_session(4, shuffle_partitions=8, app="tabsense-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def orders_fixture(spark):
    """Our own order-shaped rows: 41 rows, 13 columns, one exact duplicate
    row, five missing cells (two country, three rating)."""
    countries = ["USA", "UK", "Germany", "France", "India"]
    cats = ["Electronics", "Clothing", "Books"]
    pays = ["Card", "PayPal", "Cash"]
    stats = ["Completed", "Pending", "Cancelled"]
    rows = []
    for i in range(40):
        qty = 1 + i % 5
        price = round(10.0 + 7.5 * (i % 9), 2)
        rows.append((5000 + i, f"Buyer {i}", 20 + i % 30, countries[i % 5], cats[i % 3], f"Item {i % 7}",
                     qty, price, round(qty * price, 2), f"2024-02-{1 + i % 28:02d}", pays[i % 3],
                     stats[i % 3], float(1 + i % 5)))
    rows = [list(r) for r in rows]
    rows[3][3] = None
    rows[33][3] = None
    rows[9][12] = None
    rows[26][12] = None
    rows[36][12] = None
    rows.append(list(rows[0]))  # exact duplicate of the first row
    schema = ("order_id bigint, customer_name string, age bigint, country string, product_category string, "
              "product_name string, quantity bigint, unit_price double, total_price double, order_date string, "
              "payment_method string, status string, rating double")
    return spark.createDataFrame([tuple(r) for r in rows], schema)
