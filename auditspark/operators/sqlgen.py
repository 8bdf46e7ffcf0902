"""Generates extraction SQL from a data dictionary, in several dialects."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

#: Names by which a column is known.
FIELDS = {
    "employee_id": ("employee_id", "emp_id", "employee", "staff_id", "工号", "员工编号", "员工", "报销人", "申请人"),
    "expense_date": ("expense_date", "date", "transaction_date", "发生日期", "费用日期", "业务日期", "消费日期", "报销日期"),
    "amount": ("amount", "expense_amount", "claim_amount", "金额", "报销金额", "费用金额", "付款金额", "金额(元)"),
    "currency": ("currency", "币种", "货币"),
    "invoice_number": ("invoice_number", "invoice_no", "invoice", "发票号", "发票号码"),
    "expense_type": ("expense_type", "category", "type", "费用类型", "费用类别", "报销类型", "费用科目"),
    "approver": ("approver", "approved_by", "审批人", "审核人", "审批"),
    "vendor_name": ("vendor_name", "vendor", "merchant", "supplier", "商户", "商家", "供应商", "收款方"),
    "department": ("department", "dept", "部门", "成本中心"),
    "submit_date": ("submit_date", "submission_date", "提交日期", "申请日期", "申报日期"),
}


@dataclass(frozen=True)
class Dialect:
    """Quotes, the test for a weekend day {d}, whether approver {a} names employee {e} among others, and
    whether rows compare with subqueries as tuples."""

    left: str
    right: str
    weekend: str
    named: str
    tuples: bool = True

    def quote(self, name: str) -> str:
        return self.left + name.replace(self.right, self.right * 2) + self.right


_PIPES, _CONCAT = "{a} LIKE '%' || {e} || '%'", "{a} LIKE CONCAT('%', {e}, '%')"
DIALECTS = {
    "sqlite": Dialect('"', '"', "strftime('%w', {d}) IN ('0','6')", _PIPES),
    "mysql": Dialect("`", "`", "DAYOFWEEK({d}) IN (1,7)", _CONCAT),
    "postgres": Dialect('"', '"', "EXTRACT(DOW FROM {d}) IN (0,6)", _PIPES),
    "sqlserver": Dialect("[", "]", "DATEPART(weekday, {d}) IN (1,7)", _CONCAT, tuples=False),
    "oracle": Dialect('"', '"', "TRIM(TO_CHAR({d}, 'D')) IN ('1','7')", _PIPES),
    "spark": Dialect("`", "`", "WEEKDAY({d}) >= 5", "ARRAY_CONTAINS(TRANSFORM(SPLIT({a}, '[;；,，、]'), x -> TRIM(x)), CAST({e} AS STRING))"),
    "duckdb": Dialect('"', '"', "ISODOW({d}) >= 6", "LIST_CONTAINS(LIST_TRANSFORM(REGEXP_SPLIT_TO_ARRAY({a}, '[;；,，、]'), lambda x: TRIM(x)), CAST({e} AS VARCHAR))"),
}


@dataclass(frozen=True)
class Need:
    title: str
    requires: tuple[str, ...]
    order: tuple[str, ...]
    #: Fields that repeat together, of which `present` must not be null; else a condition.
    repeats: tuple[str, ...] = ()
    present: str | None = None


NEEDS = {
    "duplicate-claim": Need("Claims of one employee, day and amount", ("employee_id", "expense_date", "amount"), ("employee_id", "expense_date"), ("employee_id", "expense_date", "amount")),
    "duplicate-invoice": Need("Invoice numbers used twice for one amount", ("invoice_number", "amount"), ("invoice_number",), ("invoice_number", "amount"), "invoice_number"),
    "self-approval": Need("Claims approved by the claimant", ("employee_id", "approver"), ("employee_id",)),
    "weekend-expense": Need("Expenses on weekends", ("expense_date",), ("expense_date",)),
}


def key(text: str) -> str:
    return re.sub("[^0-9a-z一-鿿]+", "", unicodedata.normalize("NFKC", text or "").lower())


def suggest(columns: list[tuple]) -> dict[str, list[tuple[float, str, str]]]:
    """columns (table, column) or (table, column, label) -> for each field the three best (confidence,
    table, column): 1.0 where the column or its label is an alias, 0.7 where one holds the other."""
    out = {}
    for name, aliases in FIELDS.items():
        known = [key(a) for a in aliases]
        best: dict[tuple[str, str], float] = {}
        for t, c, *label in columns:
            for k in filter(None, map(key, (c, *label))):
                value = 1.0 if k in known else 0.7 if any(a in k or k in a for a in known) else 0.0
                if value > best.get((t, c), 0.0):
                    best[t, c] = value
        out[name] = [(s, t, c) for (t, c), s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:3]]
    return out


def resolve(suggested: dict[str, list[tuple[float, str, str]]], explicit: dict[str, tuple[str, str]] | None = None) -> dict[str, tuple[str, str]]:
    """Explicit columns, else a field's only suggestion; fields with several stay open."""
    out = dict(explicit or {})
    for name, found in suggested.items():
        good = [(t, c) for s, t, c in found if s >= 0.7]
        if name not in out and len(good) == 1:
            out[name] = good[0]
    return out


def render(need: str, mapping: dict[str, tuple[str, str]], dialect: str = "spark") -> tuple[str | None, list[str]]:
    """(SQL, missing): no SQL where fields are missing or lie in different tables."""
    n, d = NEEDS[need], DIALECTS[dialect]
    missing = [f for f in n.requires if f not in mapping]
    tables = {mapping[f][0] for f in n.requires if f in mapping}
    if missing or len(tables) != 1:
        return None, missing or ["fields lie in different tables"]
    (name,) = tables
    table = ".".join(map(d.quote, name.split(".")))
    col = lambda f, prefix="": prefix + d.quote(mapping[f][1])
    if n.repeats:
        inner = f"SELECT {', '.join(map(col, n.repeats))} FROM {table}" + (f" WHERE {col(n.present)} IS NOT NULL" if n.present else "") + f" GROUP BY {', '.join(map(col, n.repeats))} HAVING COUNT(*) > 1"
        if d.tuples:
            where = f"({', '.join(map(col, n.repeats))}) IN ({inner})"
        else:
            where = f"EXISTS (SELECT 1 FROM ({inner}) g WHERE {' AND '.join(f'g.{col(f)} = t.{col(f)}' for f in n.repeats)})"
    elif need == "self-approval":
        a, e = col("approver"), col("employee_id")
        where = f"{e} IS NOT NULL AND ({a} = {e} OR {d.named.format(a=a, e=e)})"
    else:
        where = d.weekend.format(d=col("expense_date"))
    return f"SELECT * FROM {table} t WHERE {where} ORDER BY {', '.join(map(col, n.order))}", []


def build(columns: list[tuple[str, str]], dialect: str = "spark", explicit: dict[str, tuple[str, str]] | None = None) -> dict:
    """The mapping, the SQL of every need that can be met, and what the others lack."""
    suggested = suggest(columns)
    mapping = resolve(suggested, explicit)
    rendered = {n: render(n, mapping, dialect) for n in NEEDS}
    return {"suggested": suggested, "mapping": mapping, "sql": {n: s for n, (s, _) in rendered.items() if s}, "missing": {n: m for n, (s, m) in rendered.items() if not s}}
