"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The store is loaded once and written as parquet (the reference also loads once, then serves queries); the chart,
filter, search and catalogue queries read it back, as a deployment would.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cellguard.operators import filters as FL  # noqa: E402
from cellguard.operators.search import search  # noqa: E402
from cellguard.plans import catalogue as CT  # noqa: E402
from cellguard.plans.chart import filter_chart  # noqa: E402
from cellguard.plans.load import load_cohort  # noqa: E402
from cellguard.registry.charts import CFG_CHART  # noqa: E402
from cellguard.registry.store import CFG_F, F_AND, LCFG  # noqa: E402
from cellguard.registry.text import DOC_QUERY  # noqa: E402
from cellguard.session import ensure_checkpoint_dir, local_session  # noqa: E402
from cellguard.sources import testdata as T  # noqa: E402
from cellguard.sources.files import read_store_tables, save_store_tables  # noqa: E402


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="cellguard-bench", extra={"spark.ui.showConsoleProgress": "false"})
    ensure_checkpoint_dir(spark)
    times: dict[str, float] = {}

    def timed(name, fn):
        t = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t, 3)
        return out

    def run_all(data_dir: str) -> None:
        def chart_unfiltered():
            r = filter_chart(T.subjects(spark, data_dir), CFG_CHART)
            return [r.subject_counts.collect(), r.age_bl.collect(), r.age_fu.collect()]

        timed("chart_unfiltered", chart_unfiltered)
        prefix = f"bench_{uuid.uuid4().hex[:8]}"

        def load():
            # subject-level tables bucketed by case: filters and the chart join then need no exchange
            st = load_cohort(T.cohort_wide(spark, data_dir), T.dictionary(spark), LCFG)
            save_store_tables(st, prefix, int(spark.conf.get("spark.sql.shuffle.partitions")))

        timed("cohort_load", load)
        store = read_store_tables(spark, prefix)

        def chart_filtered():
            sel = FL.select_cases(store.variable, store.value, F_AND[:3])
            r = filter_chart(store.subjects, CFG_F, sel)
            return [r.subject_counts.collect(), r.age_bl.collect(), r.age_fu.collect()]

        timed("chart_3_filters", chart_filtered)
        timed("filter_4_conjunction", lambda: FL.select_cases(store.variable, store.value, F_AND).count())
        timed("search_documents", lambda: search(T.table(spark, data_dir, "documents"), "doc_id", ["text"],
                                                 DOC_QUERY, keep=["lang"])
              .write.format("noop").mode("overwrite").save())
        timed("catalogue", lambda: CT.catalogue(store).write.format("noop").mode("overwrite").save())

    # warm-up: the same work on the smallest tables, untimed (JVM JIT, codegen and parquet readers), so the
    # timings below are steady-state query times
    run_all(os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001"))
    times.clear()
    run_all(sf)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
