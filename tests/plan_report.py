"""Physical-plan summary of registered queries: exchanges, sorts, windows, broadcasts, Python
stages, scans with their pruned ReadSchema. Usage: python tests/plan_report.py [sf_dir] [names]"""
import os
import re
import sys

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))

from kickoff.session import get_spark  # noqa: E402
import __spark_entry__ as E  # noqa: E402

SKIP = {"train_models", "feature_importance", "test_predictions", "cv_scores", "batch_predict", "compare_versions",
        "goals_model", "route_events", "elo_stream", "corr_rank", "collinearity", "feature_corr_all"}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or [n for n in E.queries() if n not in SKIP]
    spark = get_spark("local[8]", 8)
    print("| query | exchanges | sorts | windows | broadcasts | python stages | scans (columns read) |")
    print("|---|---|---|---|---|---|---|")
    for name in names:
        df = E.queries()[name](spark, sf)
        p = df._jdf.queryExecution().executedPlan().toString()
        ex = len(re.findall(r"Exchange (hash|range|single|round)", p))
        bc = p.count("BroadcastExchange")
        so = p.count("Sort [")
        wi = p.count("Window [")
        py = len(re.findall(r"(MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython|FlatMapGroupsInPandasWithState)", p))
        scans = re.findall(r"FileScan (\w+) [^\[]*\[([^\]]*)\]", p)
        sc = "; ".join(f"{fmt}:{len(cols.split(','))}" for fmt, cols in scans[:4])
        print(f"| {name} | {ex} | {so} | {wi} | {bc} | {py} | {sc} |", flush=True)


if __name__ == "__main__":
    main()
