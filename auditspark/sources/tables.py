"""Tables beside the ledger and tables of procurement: their columns, files, configuration and quarantine."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark import functions as fn
from auditspark.sources import inside, map_columns, read_config, read_delimited
from auditspark.sources.sheets import read_workbook

#: Names by which the columns of the ledger's side tables are known.
TRAVEL_REQUESTS = {
    "employee_id": ("employee_id", "emp_id", "employee", "staff_id", "工号", "员工编号", "员工", "姓名", "name"),
    "travel_start": ("travel_start", "start_date", "begin_date", "出差开始日期", "开始日期", "出发日期", "出差日期"),
    "travel_end": ("travel_end", "end_date", "finish_date", "出差结束日期", "结束日期", "返回日期"),
    "travel_dest_city": ("travel_dest_city", "dest_city", "destination", "city", "目的城市", "目的地", "出差城市", "到达城市"),
    "transport": ("transport", "vehicle", "交通方式", "交通工具"),
    "estimated_amount": ("estimated_amount", "budget", "预计费用", "预算金额"),
}
ATTENDANCE = {
    "employee_id": ("employee_id", "emp_id", "employee", "staff_id", "工号", "员工编号", "员工", "姓名", "name"),
    "attendance_date": ("attendance_date", "date", "check_date", "打卡日期", "日期", "考勤日期"),
    "attendance_location": ("attendance_location", "location", "address", "place", "打卡地点", "打卡地址", "地点", "地址", "定位地址"),
    "is_office": ("is_office", "in_office", "office_flag", "是否在公司", "在公司", "打卡类型", "考勤类型", "外勤"),
    "lat": ("lat", "latitude", "纬度", "纬度(lat)"),
    "lon": ("lon", "lng", "longitude", "经度", "经度(lon)"),
}
VERIFICATION = {
    "expense_id": ("expense_id", "id", "claim_id", "单据号", "报销单号", "凭证号"),
    "flight_no": ("flight_no", "flight_number", "航班号", "航班"),
    "travel_date": ("travel_date", "date", "flight_date", "航班日期", "行程日期", "日期"),
    "depart_city": ("depart_city", "departure", "from_city", "from", "出发城市", "出发地", "起飞城市"),
    "arrive_city": ("arrive_city", "arrival", "to_city", "to", "到达城市", "目的地", "降落城市"),
    "passenger": ("passenger", "traveler", "name", "乘客", "乘机人", "旅客", "姓名"),
    "pnr": ("pnr", "booking_ref", "record_locator", "订座记录", "订座号"),
    "source": ("source", "来源", "数据来源", "核验来源"),
    "source_reliability": ("source_reliability", "reliability", "来源可靠性", "可靠性"),
}
LEDGER_PAYMENTS = {
    "expense_id": ("expense_id", "id", "claim_id", "单据号", "报销单号"),
    "payee": ("payee", "payee_name", "收款方", "收款人", "收款单位", "实际收款方", "收款账户名", "商户名称"),
    "payee_account": ("payee_account", "account", "收款账号", "收款账户", "账号"),
    "invoice_issuer": ("invoice_issuer", "issuer", "开票方", "销方名称", "销售方", "开票单位", "发票抬头"),
    "amount": ("amount", "金额", "付款金额", "支付金额"),
    "payment_date": ("payment_date", "付款日期", "支付日期", "收款日期"),
}
PRICES = {
    "item": ("item", "spec", "item_name", "项目", "规格", "品名", "材料", "配件"),
    "unit": ("unit", "uom", "单位", "计量单位"),
    "unit_price": ("unit_price", "price", "参考单价", "单价"),
    "min_price": ("min_price", "min", "最低价", "价格下限"),
    "max_price": ("max_price", "max", "最高价", "价格上限"),
    "source": ("source", "来源", "价格来源", "供应商"),
    "as_of": ("as_of", "date", "日期", "价格日期"),
}
SHIPMENTS = {
    "expense_id": ("expense_id", "id", "claim_id", "单据号", "报销单号"),
    "tracking_no": ("tracking_no", "waybill", "waybill_no", "运单号", "快递单号", "物流单号"),
    "amount": ("amount", "金额", "运单金额", "运费", "快递费"),
    "courier": ("courier", "carrier", "快递公司", "承运商", "物流公司"),
    "from_addr": ("from_addr", "from", "sender", "寄件地", "寄件地址", "发件地", "始发地"),
    "to_addr": ("to_addr", "to", "receiver", "收件地", "收件地址", "到件地", "目的地"),
    "ship_date": ("ship_date", "date", "寄件日期", "发货日期", "寄件时间"),
}
SIDE = {"travel_requests": TRAVEL_REQUESTS, "attendance": ATTENDANCE, "travel_verification": VERIFICATION, "payments": LEDGER_PAYMENTS, "price_reference": PRICES, "shipments": SHIPMENTS}

#: Required columns of the procurement tables, and names by which their columns are known.
VENDORS = {
    "vendor_id": ("vendor_id", "supplier_id", "供应商编码", "供应商编号", "供方编号", "厂商编号", "供货商编号"),
    "vendor_name": ("vendor_name", "supplier_name", "供应商名称", "供应商", "供方名称", "厂商名称", "供货商名称"),
    "legal_name": ("legal_name", "company_name", "企业名称", "法定名称", "公司名称", "法人名称"),
    "tax_id": ("tax_id", "tax_number", "统一社会信用代码", "税号", "纳税人识别号", "信用代码"),
    "bank_account": ("bank_account", "bank_no", "银行账号", "收款账号", "账号", "对公账户", "开户账号"),
    "phone": ("phone", "telephone", "联系电话", "手机号", "电话", "联系方式"),
    "email": ("email", "邮箱", "电子邮箱", "邮件"),
    "address": ("address", "registered_address", "地址", "注册地址", "公司地址", "经营地址"),
    "legal_representative": ("legal_representative", "owner_name", "法人", "法定代表人", "法人代表", "负责人"),
    "created_at": ("created_at", "create_date", "创建日期", "成立日期", "注册日期", "建档日期"),
}
PURCHASE_ORDERS = {
    "po_id": ("po_id", "order_id", "采购订单号", "订单号", "采购单号", "单据编号", "PO号"),
    "vendor_id": ("vendor_id", "supplier_id", "供应商编码", "供应商编号", "供方编号"),
    "buyer_id": ("buyer_id", "purchaser_id", "采购员", "采购人员编号", "采购员编号", "采购人"),
    "category": ("category", "采购类别", "品类", "物资类别", "商品类别"),
    "item": ("item", "material", "物料", "商品", "项目", "品名", "物资名称"),
    "unit": ("unit", "计量单位", "单位", "规格"),
    "region": ("region", "地区", "区域", "收货地区"),
    "quantity": ("quantity", "qty", "数量", "采购数量"),
    "unit_price": ("unit_price", "price", "单价", "采购单价", "不含税单价"),
    "total_amount": ("total_amount", "amount", "订单金额", "总金额", "采购金额"),
    "currency": ("currency", "币种", "货币"),
    "order_date": ("order_date", "po_date", "订单日期", "采购日期", "下单日期"),
    "approval_date": ("approval_date", "approved_at", "审批日期", "审批完成日期", "核准日期"),
    "receipt_date": ("receipt_date", "received_at", "收货日期", "验收日期", "到货日期", "入库日期", "goods_recv_date"),
}
EMPLOYEES = {
    "employee_id": ("employee_id", "emp_id", "员工编号", "工号", "员工ID", "人员编号"),
    "employee_name": ("employee_name", "name", "员工姓名", "姓名", "人员姓名"),
    "department": ("department", "dept", "部门", "所属部门", "组织"),
    "phone": ("phone", "联系电话", "手机号", "电话", "联系方式"),
    "email": ("email", "邮箱", "电子邮箱"),
    "address": ("address", "地址", "家庭地址", "住址"),
    "bank_account": ("bank_account", "银行账号", "工资卡号", "工资账户"),
}
PAYMENTS = {
    "payment_id": ("payment_id", "付款编号", "支付编号", "流水号", "付款单号"),
    "po_id": ("po_id", "order_id", "采购订单号", "订单号", "采购单号"),
    "vendor_id": ("vendor_id", "supplier_id", "供应商编码", "供应商编号"),
    "amount": ("amount", "payment_amount", "付款金额", "支付金额", "实际付款"),
    "currency": ("currency", "币种", "货币"),
    "payment_date": ("payment_date", "paid_at", "付款日期", "支付日期", "出账日期"),
    "bank_account": ("bank_account", "银行账号", "收款账号", "对公账户"),
}
BIDS = {
    "tender_id": ("tender_id", "招标编号", "项目编号", "招标项目编号"),
    "lot_id": ("lot_id", "标段编号", "包件编号", "标包编号"),
    "bidder_id": ("bidder_id", "vendor_id", "投标人编号", "供应商编码", "投标单位编号"),
    "bid_price": ("bid_price", "price", "投标报价", "报价", "投标金额"),
    "currency": ("currency", "币种", "货币"),
    "document_path": ("document_path", "file_path", "投标文件路径", "文本路径", "投标书路径"),
    "submitted_at": ("submitted_at", "submission_time", "提交时间", "投标时间"),
}
PROCUREMENT = {"vendors": VENDORS, "purchase_orders": PURCHASE_ORDERS, "employees": EMPLOYEES, "payments": PAYMENTS, "bids": BIDS}
REQUIRED = {
    "vendors": ("vendor_id", "vendor_name"),
    "purchase_orders": ("po_id", "vendor_id", "buyer_id", "unit_price", "total_amount", "order_date"),
    "employees": ("employee_id",),
    "payments": ("payment_id", "po_id", "vendor_id", "amount", "payment_date"),
    "bids": ("tender_id", "lot_id", "bidder_id", "bid_price"),
}
FILES = {
    "vendors": ("vendors.csv", "vendors.xlsx", "vendor_master.csv", "vendor_master.xlsx"),
    "purchase_orders": ("purchase_orders.csv", "purchase_orders.xlsx", "pos.csv", "pos.xlsx"),
    "employees": ("employees.csv", "employees.xlsx"),
    "payments": ("payments.csv", "payments.xlsx"),
    "bids": ("bids.csv", "bids.xlsx", "tenders.csv", "tenders.xlsx"),
}
NUMBERS = ("quantity", "unit_price", "total_amount", "amount", "bid_price")
DATES = ("created_at", "order_date", "approval_date", "receipt_date", "payment_date")
#: Date formats of procurement tables, and their shapes.
DATE_FORMATS = (("yyyy-M-d", r"\d{4}-\d{1,2}-\d{1,2}"), ("yyyy/M/d", r"\d{4}/\d{1,2}/\d{1,2}"), ("yyyy.M.d", r"\d{4}[.]\d{1,2}[.]\d{1,2}"), ("d/M/yyyy", r"\d{1,2}/\d{1,2}/\d{4}"), ("M/d/yyyy", r"\d{1,2}/\d{1,2}/\d{4}"))

#: The keys that a policy of the ledger, and a configuration of procurement, may have.
POLICY_KEYS = {
    "policy_version", "policy_source", "default_currency", "limits", "approval_thresholds", "near_duplicate_window_days", "near_duplicate_amount_tolerance",
    "split_window_days", "split_cross_merchant", "weekend_check", "holidays", "outlier_min_group_size", "outlier_robust_z", "outlier_min_amount",
    "fixed_amount_types", "multi_occurrence_types", "large_amount_threshold", "large_amount_check", "low_level_approver_keywords", "as_of_date",
    "cross_period_months", "high_frequency_window_days", "high_frequency_min_count", "high_frequency_max_amount", "status_filter", "resubmit_window_days",
    "amount_columns", "travel_cross_check", "vendor_concentration_check", "vendor_concentration_min_count", "vendor_concentration_share",
    "vendor_concentration_scope", "shared_voucher_check", "voucher_completeness_check", "voucher_consistency_check", "lodging_cross_check",
    "lodging_min_nights", "lodging_types", "lodging_same_amount_min_count", "weekday_check", "price_tolerance", "row_limit_check", "row_limit_tolerance",
    "shipment_types", "shipment_amount_tolerance", "private_address_check", "private_address_keywords", "sequential_invoice_window_days",
}
CONFIG_KEYS = {
    "config_version", "default_currency", "price_outlier_min_group_size", "price_outlier_robust_z", "split_window_days", "approval_thresholds",
    "bid_similarity_threshold", "bid_ngram_min", "bid_ngram_max", "bid_price_close_ratio", "concentration_share", "concentration_min_orders",
    "common_template_phrases", "whitelists", "files", "field_maps", "order_approval_direction", "same_day_approval_grace", "new_vendor_days_threshold",
    "new_vendor_amount_threshold", "order_amount_tolerance",
}


#: Keys of this library alone: every pair of a group instead of a row for each party or stay.
OWN_KEYS = {"all_pairs"}


def read_policy(path: str) -> dict:
    """A ledger's policy; keys that it may not have raise, those with a leading underscore are comments."""
    return read_config(path, POLICY_KEYS | OWN_KEYS)


def read_procurement_config(path: str) -> dict:
    return read_config(path, CONFIG_KEYS | OWN_KEYS, comments=False)


def read_table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A CSV, XLSX or XLS file by its suffix, all columns text, with _src_row, _src_sheet and _src_file."""
    kind = Path(path).suffix.lower()
    if kind == ".csv":
        return read_delimited(spark, path).withColumn("_src_sheet", F.lit(None).cast("string"))
    if kind in (".xlsx", ".xls"):
        return read_workbook(spark, path, sheet)
    raise ValueError(f"{path}: neither .csv nor .xlsx nor .xls")


def headers(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def optional_column(names: list[str], aliases: tuple[str, ...]) -> str | None:
    """The header that fits the first alias that any fits."""
    by_key = {fn.header_key(h): h for h in names}
    return next((by_key[k] for k in map(fn.header_key, aliases) if k in by_key), None)


def read_side_table(spark: SparkSession, path: str, table: str, sheet: str | None = None) -> DataFrame:
    """The known columns of a side table of the ledger, normalised text, with _src_row. The first alias that a
    header fits wins; unknown columns are not read."""
    raw = read_table(spark, path, sheet)
    known = {name: optional_column(headers(raw), aliases) for name, aliases in SIDE[table].items()}
    return raw.select("_src_row", *[(fn.norm_text(F.col(f"`{known[n]}`")) if known[n] else F.lit(None).cast("string")).alias(n) for n in known])


def find_table(root: str, table: str, config: dict | None = None, required: bool = False) -> str | None:
    """The configured file of a table, else the first usual one, below root."""
    named = (config or {}).get("files", {}).get(table)
    for name in [named] if named else FILES[table]:
        path = inside(root, name)
        if Path(path).is_file():
            return path
    if required:
        raise FileNotFoundError(f"no file for {table}; usual names are {', '.join(FILES[table])}")
    return None


def judged_table(raw: DataFrame, table: str, mapping: dict[str, str], default_currency: str = "CNY") -> DataFrame:
    """Every row with the table's canonical columns, _reasons, empty if it is good, and its record as _raw."""
    text = {n: fn.norm_text(F.col(f"`{mapping[n]}`")) if n in mapping else F.lit(None).cast("string") for n in PROCUREMENT[table]}
    read = lambda n, t: fn.amount(t) if n in NUMBERS else fn.date_value(t, DATE_FORMATS, chinese=False) if n in DATES else fn.currency(t, default_currency) if n == "currency" else t
    lacks = lambda n: lambda t: F.when(t.isNull(), f"{n} is empty").when(read(n, t).isNull(), f"{n} cannot be read")
    reasons = F.array_compact(F.array(*[fn.once(text[n], lacks(n)) for n in REQUIRED[table]]))
    record = F.to_json(F.struct(*[F.col(f"`{h}`").alias(n) for n, h in mapping.items()]))
    sheet = [F.col(c) for c in ("_src_row", "_src_sheet", "_src_file") if c in raw.columns]
    return raw.select(*sheet, *[read(n, text[n]).alias(n) for n in PROCUREMENT[table]], F.concat_ws("；", reasons).alias("_reasons"), record.alias("_raw"))


def normalise_table(raw: DataFrame, table: str, mapping: dict[str, str], default_currency: str = "CNY") -> tuple[DataFrame, DataFrame]:
    """(rows, bad): the table's canonical columns. Rows without a required value, or with one that cannot be read,
    are bad and keep their reasons and record; optional numbers and dates that cannot be read are null. Each reads
    the table anew; judged_table gives both at once."""
    full = judged_table(raw, table, mapping, default_currency)
    bad = full.filter("_reasons <> ''").select(F.lit(table).alias("table"), "_src_row", F.col("_reasons").alias("reasons"), F.col("_raw").alias("raw_record"))
    return full.filter("_reasons = ''").drop("_reasons", "_raw"), bad


def read_procurement(spark: SparkSession, root: str, config: dict | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, bad): the tables found below root, vendors and purchase orders required, and all their bad rows."""
    config = config or {}
    tables, bad = {}, None
    for name, columns in PROCUREMENT.items():
        path = find_table(root, name, config, required=name in ("vendors", "purchase_orders"))
        if path is None:
            continue
        raw = read_table(spark, path)
        mapping, _ = map_columns(headers(raw), columns, config.get("field_maps", {}).get(name), REQUIRED[name])
        tables[name], out = normalise_table(raw, name, mapping, config.get("default_currency", "CNY"))
        bad = out if bad is None else bad.unionByName(out)
    return tables, bad


def read_dictionary(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """(table, column, label) of a data dictionary, for sqlgen.suggest(); headers are found by name, else by part of
    it. A dictionary is a short list and comes to the driver."""
    from auditspark.operators.sqlgen import key

    raw = read_table(spark, path)

    def pick(*names: str) -> str | None:
        exact = next((h for n in names for h in headers(raw) if key(h) == key(n)), None)
        return exact or next((h for n in names for h in headers(raw) if key(n) in key(h)), None)

    table, column, label = pick("表名", "table", "table_name", "表"), pick("字段名", "column", "column_name", "字段", "列名"), pick("中文名", "label", "comment", "说明", "含义", "字段说明")
    if not table or not column:
        raise ValueError(f"{path}: needs a column of table names and one of column names")
    cell = lambda h: F.coalesce(fn.norm_text(F.col(f"`{h}`")), F.lit("")) if h else F.lit("")
    rows = raw.orderBy("_src_row").select(cell(table), cell(column), cell(label)).collect()
    return [tuple(r) for r in rows if r[0] or r[1]]
