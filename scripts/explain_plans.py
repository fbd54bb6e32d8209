"""Print plan facts for catalogue queries: shuffle and broadcast exchanges,
and for every parquet scan its ReadSchema and PushedFilters. With --full,
also the formatted physical plan.

    python scripts/explain_plans.py [--full] [--sf DIR] query [query ...]
"""
import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("queries", nargs="*")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--full", action="store_true")
    a = ap.parse_args()
    from tierflow.plans import catalog
    from tierflow.session import get_spark
    spark = get_spark(master="local[4]", shuffle_partitions=8)
    for q in a.queries or list(catalog.QUERIES):
        df = catalog.QUERIES[q](spark, a.sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        shuffles = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan))
        print(f"== {q}: shuffle exchanges={shuffles} broadcasts={plan.count('BroadcastExchange')}")
        seen = set()
        for s in re.findall(r"FileScan parquet [^\n]*", plan):
            loc = re.search(r"\[file:[^\]]*/([^/\]]+)\]", s)
            rs = re.search(r"ReadSchema: (struct<.*?>)(?:,|$)", s)
            pf = re.search(r"PushedFilters: (\[[^\]]*\])", s)
            key = (loc.group(1) if loc else "?", rs.group(1) if rs else "", pf.group(1) if pf else "")
            if key not in seen:
                seen.add(key)
                print("   scan %-22s %s %s" % key)
        if a.full:
            df.explain("formatted")


if __name__ == "__main__":
    main()
