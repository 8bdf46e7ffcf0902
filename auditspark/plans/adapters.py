"""Canonical audit tables made from the relational test tables, for Spark and, as text, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_WORDS = {
    "spark": {"days": "date_add({0}, CAST({1} AS INT))", "hours": "{0} + make_interval(0, 0, 0, 0, CAST({1} AS INT), 0, 0)", "diff": "datediff({0}, {1})"},
    "duckdb": {"days": "CAST({0} + CAST({1} AS INT) AS DATE)", "hours": "{0} + to_hours(CAST({1} AS BIGINT))", "diff": "({0} - {1})"},
}

LEDGER = {
    "_src_row": "o_orderkey",
    "expense_id": "CAST(o_orderkey AS STRING)",
    "employee_id": "CAST(CAST(floor(o_custkey / 5) AS BIGINT) AS STRING)",
    "employee_name": "'name ' || o_custkey",
    "department": "'dept ' || (o_custkey % 7)",
    "expense_type": "CASE WHEN o_orderkey % 89 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'hotel' WHEN o_orderkey % 11 = 1 THEN 'flight' ELSE o_orderpriority END",
    "amount": "CAST(floor(o_totalprice / 20000) * 20000 AS DOUBLE)",
    "currency": "'CNY'",
    "expense_date": "CAST(o_orderdate AS DATE)",
    "submit_date": "days(CAST(o_orderdate AS DATE); o_orderkey % 130 - 5)",
    "vendor_name": "'Vendor ' || (o_orderkey % 40)",
    "invoice_number": "CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN 'X@#' || o_orderkey WHEN o_orderkey % 10 < 3 THEN 'INV' || lpad(CAST(o_orderkey * 7 % 300 AS STRING), 6, '0') ELSE 'N' || lpad(CAST(CAST(floor(o_orderkey / 40) AS BIGINT) AS STRING), 9, '0') END",
    "approver": "CASE WHEN o_orderkey % 50 = 0 THEN 'boss; ' || CAST(floor(o_custkey / 5) AS BIGINT) WHEN o_orderkey % 3 = 0 THEN 'Team Lead' ELSE 'director' END",
    "pnr": "'P' || (o_orderkey % 5000)",
    "ticket_number": "'T-' || (o_orderkey % 12000)",
    "issue_date": "days(CAST(o_orderdate AS DATE); o_orderkey % 9 - 6)",
    "origin_city": "'City ' || (o_orderkey % 5)",
    "dest_city": "'City ' || (o_orderkey % 6)",
    "check_in": "CAST(o_orderdate AS DATE)",
    "check_out": "days(CAST(o_orderdate AS DATE); o_orderkey % 4)",
    "nights": "CAST(o_orderkey % 3 + 1 AS DOUBLE)",
    "weekday": "CASE o_orderkey % 8 WHEN 0 THEN 'week 1' WHEN 1 THEN 'Tue' WHEN 2 THEN '星期三' WHEN 3 THEN '周四' WHEN 4 THEN 'week Fri' WHEN 5 THEN '天' WHEN 6 THEN '7' ELSE 'Sunday' END",
    "row_limit": "CAST(CASE WHEN o_orderkey % 13 = 0 THEN floor(o_totalprice / 40000) * 20000 ELSE 1000000 END AS DOUBLE)",
    "item": "'item ' || (o_orderkey % 25)",
    "unit": "CAST(NULL AS STRING)",
    "unit_price": "CAST(NULL AS DOUBLE)",
    "status": "CASE WHEN o_orderkey % 23 = 0 THEN 'Rejected' ELSE 'approved' END",
    "depart_at": "hours(o_orderdate; o_orderkey % 24)",
    "arrive_at": "hours(o_orderdate; o_orderkey % 24 + 5)",
    "check_out_at": "hours(o_orderdate; 12)",
}
ORDERS = {
    "_src_row": "l_orderkey * 100000 + l_partkey * 10 + l_linenumber",
    "po_id": "l_orderkey",
    "buyer": "o_custkey",
    "vendor_id": "l_suppkey",
    "item": "CAST(l_partkey AS STRING)",
    "category": "CAST(l_suppkey % 5 AS STRING)",
    "amount": "l_extendedprice",
    "unit_price": "l_extendedprice / l_quantity",
    "currency": "'CNY'",
    "order_date": "CAST(o_orderdate AS DATE)",
    "approval_date": "days(CAST(o_orderdate AS DATE); l_partkey % 41 - 20)",
    "receipt_date": "CAST(l_shipdate AS DATE)",
}


def expression(text: str, dialect: str) -> str:
    """days(a; b) and hours(a; b) spelt out in the dialect."""
    for word, form in _WORDS[dialect].items():
        while f"{word}(" in text and ";" in text:
            at = text.index(f"{word}(") + len(word) + 1
            depth, end = 1, at
            while depth:
                depth += {"(": 1, ")": -1}.get(text[end], 0)
                end += 1
            a, b = text[at : end - 1].split(";")
            text = text[: at - len(word) - 1] + form.format(a.strip(), b.strip()) + text[end:]
    return text


def columns(spec: dict[str, str], dialect: str) -> list[str]:
    return [f"{expression(e, dialect)} AS {name}" for name, e in spec.items()]


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*columns(LEDGER, "spark"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, heads = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    return lines.join(heads, lines["l_orderkey"] == heads["o_orderkey"]).selectExpr(*columns(ORDERS, "spark"))


LEDGER_SQL = f"e AS (SELECT {', '.join(columns(LEDGER, 'duckdb'))} FROM orders)"
ORDERS_SQL = f"po AS (SELECT {', '.join(columns(ORDERS, 'duckdb'))} FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
