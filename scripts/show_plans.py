"""Print the physical plans of the headline queries (operator trees only) as markdown, for PLANS.md.

Usage: python scripts/show_plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import io
import sys
import contextlib
import uuid

sys.path.insert(0, ".")

from pyspark.sql import functions as F  # noqa: E402

from cellguard.operators import filters as FL  # noqa: E402
from cellguard.operators.groups import consecutive_groups_bucketed  # noqa: E402
from cellguard.operators.search import search  # noqa: E402
from cellguard.plans.chart import cell_table, chart_parts  # noqa: E402
from cellguard.functions.codes import value_options  # noqa: E402
from cellguard.plans.load import (  # noqa: E402
    column_rules, distinct_cells, load_cohort, normal_coded, prepare_dictionary,
)
from cellguard.registry.store import CFG_F, F_AND, LCFG  # noqa: E402
from cellguard.registry.text import DOC_QUERY  # noqa: E402
from cellguard.session import cut_lineage, local_session  # noqa: E402
from cellguard.sources import testdata as T  # noqa: E402
from cellguard.sources.files import read_store_tables, save_store_tables  # noqa: E402


def tree(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    lines = []
    for line in text.splitlines():
        if line.startswith("(") and lines:
            break
        lines.append(line)
    return "\n".join(lines).strip()


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, extra={"spark.ui.showConsoleProgress": "false"})
    prefix = f"plans_{uuid.uuid4().hex[:8]}"
    save_store_tables(load_cohort(T.cohort_wide(spark, sf), T.dictionary(spark), LCFG), prefix, 8)
    st = read_store_tables(spark, prefix)
    sel = FL.select_cases(st.variable, st.value, F_AND[:3])
    cells = cell_table(st.subjects, CFG_F, sel)
    wide = cut_lineage(T.cohort_wide(spark, sf).withColumnRenamed("subject_id", "__case"), "cohort")
    cols = [c for c in wide.columns if c != "__case"]
    d = prepare_dictionary(T.dictionary(spark), LCFG)
    rules = column_rules(spark, cols, d, LCFG).where(F.col("kind") == "coded")
    coded = distinct_cells(wide, [r["col"] for r in rules.collect()]).join(F.broadcast(rules), "col")
    sections = [
        ("Load: normalisation of the coded cells",
         "Reads the coded columns of the materialised cohort; the distinct cells join the resolved codes, worked out over their "
         "distinct values with dictionary-size broadcasts.",
         normal_coded(coded, value_options(d))),
        ("Filtered cell table (bucketed store, three filters)",
         "Partition pruning on item, no exchange for the `groupBy(case)` or the subjects join (buckets on case); "
         "the only exchange is the partial-aggregated cell table.", cells),
        ("Chart parts over the materialised cell table (enrolment totals)",
         "Everything reads the few rows of the cell table written by `cut_lineage`; one-row values (A7 totals) "
         "are scalar subqueries.",
         chart_parts(cut_lineage(cells, "cells").where("sel").drop("sel"), CFG_F)["enrollment"]),
        ("Substring search over documents, top 25",
         "One scan, each field lowered once; the limit is a TakeOrderedAndProject.",
         search(T.table(spark, sf, "documents"), "doc_id", ["text"], DOC_QUERY, limit=25, keep=["lang"])),
        ("Consecutive runs per user, split by day",
         "Window per (user, day) plus a small per-(user, day) offset table; a hot user spreads over its days.",
         consecutive_groups_bucketed(T.table(spark, sf, "events"), ["ts", "event_id"], "event_type", ["user_id"],
                                     F.to_date("ts"))),
    ]
    print("# Physical plans of the headline queries\n")
    print(f"Generated by `scripts/show_plans.py` at `{sf}` (local[8], AQE on; plans before AQE re-optimisation).\n")
    for title, note, df in sections:
        print(f"## {title}\n\n{note}\n\n```\n{tree(df)}\n```\n")
    spark.stop()


if __name__ == "__main__":
    main()
