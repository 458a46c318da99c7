"""Headline queries, timed cold at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    from rowassay import catalog
    from rowassay.catalog.injections import PLANNED, planned
    from rowassay.catalog.scores import grid
    from rowassay.catalog.views import frame
    from rowassay.operators.bind import bind_rules
    from rowassay.operators.profile import profile_rules
    from rowassay.operators.validate import outcomes
    from rowassay.plans.suites import hand_written
    from rowassay.session import local_session

    spark = local_session(CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors outside the clock

    seconds: dict[str, float] = {}

    def timed(name, run):
        started = time.time()
        result = run()
        seconds[name] = round(time.time() - started, 3)
        return result

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    registered = catalog.queries()
    timed("row_ids", lambda: drain(registered["row_ids"](spark, SF)))
    for table in ("customer", "orders", "lineitem", "events"):  # the numbered tables are everyone's input
        timed(f"numbered_{table}", lambda t=table: frame(spark, SF, t))

    lines = frame(spark, SF, "lineitem_rcv")
    suite = timed("profile_rules", lambda: profile_rules(lines)) + hand_written("tpch_lineitem")
    bound = bind_rules(suite, lines)
    timed("validate_fused", lambda: outcomes(lines, bound).collect())
    timed("validate_rule_by_rule", lambda: [outcomes(lines, [b]).collect() for b in bound])

    timed("inject_grid", lambda: drain(planned(spark, SF, "tpch_lineitem").rows()))
    timed("labels_grid", lambda: drain(planned(spark, SF, "tpch_lineitem").labels()))
    for table in PLANNED:
        timed(f"validate_grid_{table}", lambda t=table: grid(spark, SF, t).detection_facts())

    for name in (
        "select_k", "sample_exact", "clean_rows", "clean_audit", "dedup_first", "fk_semi", "rule_compound_unique",
        "flagged_rows", "inject_mixed", "detection", "parse_rules", "parse_lenient", "status_counts", "rule_large_sets",
        "validate_thousand_rules", "validate_deltas",
    ):
        timed(name, lambda n=name: drain(registered[n](spark, SF)))

    headline = ["validate_fused", "inject_grid", "profile_rules"] + [f"validate_grid_{t}" for t in PLANNED]
    print(json.dumps({
        "metric": "seconds for suite validation, injection grid, profiling and evaluation grids",
        "value": round(sum(seconds[q] for q in headline), 3),
        "unit": "sec",
        "queries": seconds,
        "rules_fused": len(bound),
        "speedup_fused_over_rule_by_rule": round(seconds["validate_rule_by_rule"] / seconds["validate_fused"], 2),
        "sf": os.path.basename(SF.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
