"""Headline queries, timed whole (every output row is produced).  Prints one JSON line."""

import json
import os
import re
import sys
import time

from paperlens.catalog import load
from paperlens.plans.flagship import findings_by_item
from paperlens.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "src_text_blocks", "str_sentences", "str_table_grid", "elm_elements", "cls_paper_type", "num_all", "fig_check_references",
    "gat_review_rules", "gat_review_model", "ret_search", "ret_directed_context", "dlg_truncate", "dlg_question_context",
    "eva_latency", "lif_quota", "lif_purge", "lif_redaction",
]


def main():
    spark = local_session(CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load()
    runs = {"flagship": findings_by_item} | {n: catalog[n][0] for n in HEADLINE}
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name, fn in runs.items():
        t = time.time()
        fn(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(name, times[name], file=sys.stderr)
    n_docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    m = re.search(r"sf([\d.]+)", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else None,
                "documents": n_docs,
                "review_docs_per_sec": round(n_docs / times["gat_review_rules"], 1),
            }
        )
    )


if __name__ == "__main__":
    main()
