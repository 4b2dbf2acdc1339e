"""Write an N-times larger copy of the sf0.1 `events` and `customer` tables
(ids shifted per copy, same time range, several files) for local scaling
checks of the plans. Not used by any registered query.

usage: python tools/scale_copy.py OUT_DIR [N] [SRC_DIR]
"""

from __future__ import annotations

import os
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)

from pyspark.sql import functions as F  # noqa: E402

from patronage.session import local_session  # noqa: E402

if __name__ == "__main__":
    out = sys.argv[1]
    n = int(sys.argv[2]) if len(sys.argv) > 2 else 16
    src = sys.argv[3] if len(sys.argv) > 3 else "/root/testdata/sf0.1"
    spark = local_session(8)
    copy_ids = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")
    events = spark.read.parquet(f"{src}/events.parquet")
    customer = spark.read.parquet(f"{src}/customer.parquet")
    n_events = events.count()
    n_users = customer.count()
    big_events = events.select("*", copy_ids).select(
        (F.col("event_id") + F.col("k") * n_events).alias("event_id"),
        "ts",
        (F.col("user_id") + F.col("k") * n_users).alias("user_id"),
        "event_type",
        "value",
        "props",
    )
    big_customer = customer.select("*", copy_ids).select(
        (F.col("c_custkey") + F.col("k") * n_users).alias("c_custkey"),
        "c_name",
        "c_nationkey",
        "c_acctbal",
        "c_mktsegment",
    )
    big_events.repartition(n).write.mode("overwrite").parquet(f"{out}/events.parquet")
    big_customer.repartition(max(1, n // 4)).write.mode("overwrite").parquet(f"{out}/customer.parquet")
    print(out, n * n_events, "events")
