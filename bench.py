"""Times the headline queries and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from auditspark import catalogue

HEADLINE = ("all_expense_findings", "dup_person_day", "exact_duplicate_employee_date_amount", "split_expense", "robust_outlier", "sequential_invoice", "space_time_conflict", "high_frequency_small_amount", "near_duplicate_days", "price_outlier", "buyer_vendor_concentration", "process_order", "shipment_amount_mismatch", "price_above_reference", "segment_overlap", "timeline", "purchase_graph", "sql_duplicate_invoice")


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["weekend_signal"](spark, sf).count()  # starts the workers
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline audit queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
