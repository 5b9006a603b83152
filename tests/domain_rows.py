"""Rows of the reference fixtures as plain data, and helpers of the tests."""

import datetime as dt
from decimal import Decimal


def D(x):
    return None if x is None else Decimal(x)


def day(x):
    return None if x is None else dt.date.fromisoformat(x)


# FIXTURES.md section 2
ORDERS_SMALL = [
    (1, "Order Finished", "Ann", "2009-03-01", 2, "150.00", "0.0800", "10.00", "Technology", "Laptops"),
    (2, "Order Finished", "Ann", "2009-03-01", 2, "150.00", "0.0800", "10.00", "Technology", "Phones"),
    (3, "DELIVERED", "Bob", "2010-06-30", 1000, "100000.00", "1.0000", "1000.00", "Furniture", "Chairs"),
    (4, "returned", "Bob", "2010-07-01", 1001, "100000.01", "1.0001", "1000.01", "Furniture", "Chairs"),
    (5, "pending", "Cy", "2012-12-31", 0, "0.00", "0.0000", "0.00", "Office Supplies", "Paper"),
    (6, "shipped", "", "2012-01-01", 1, "5.00", "0.0000", "1.00", "Office Supplies", "Paper"),
    (7, None, "Dee", None, None, None, None, None, None, "Paper"),
    (8, "cancelled", "Eve", "2010-01-01", -1, "-5.00", "-0.1000", "-1.00", "Technology", "Laptops"),
    (9, " ", None, "2010-01-01", 1, "5.00", "0.0000", "1.00", "Technology", "Laptops"),
    (10, "pending", None, "2010-01-01", 1, "5.00", "0.0000", "1.00", "Technology", "Laptops"),
]


# FIXTURES.md section 4
PRODUCTS_SEED = [
    (1, 'Laptop Pro 15"', "Electronics", "Computers", "1299.99", 50),
    (2, "Wireless Mouse", "Electronics", "Accessories", "29.99", 200),
    (3, "USB-C Hub", "Electronics", "Accessories", "49.99", 150),
    (4, "Office Chair", "Furniture", "Office", "299.99", 75),
    (5, "Standing Desk", "Furniture", "Office", "499.99", 30),
    (6, 'Monitor 27"', "Electronics", "Monitors", "399.99", 60),
    (7, "Mechanical Keyboard", "Electronics", "Accessories", "89.99", 120),
    (8, "Desk Lamp", "Furniture", "Lighting", "39.99", 100),
    (9, "Webcam HD", "Electronics", "Accessories", "79.99", 80),
    (10, "Notebook Set", "Stationery", "Notebooks", "19.99", 300),
]

T0 = dt.datetime(2024, 1, 1)


def product_rows(seed=PRODUCTS_SEED, id_offset=0, active=True):
    return [(i + id_offset, n, f"{n} description", c, sc, Decimal(p), None, s, active, T0, T0)
            for i, n, c, sc, p, s in seed]


def rows_of(df, *cols, order=None):
    sel = df.select(*cols) if cols else df
    out = [tuple(r) for r in sel.collect()]
    return sorted(out, key=lambda t: tuple((v is None, v) for v in t)) if order is None else out
