"""Command line: ``python -m cohortlens <command> ...``

  list                                   registered query names
  query NAME --data DIR --out PATH       run one registered query, write parquet
  train --data DIR --out DIR [--models a,b] [--tune]   flow A (train, report, explain)
  dashboard --data DIR --out DIR         flow B (totals, lists, distribution)
  validate --data DIR --models-dir DIR --out DIR      flow C (score saved models)

``--data`` of the three flows is a roster file (.csv, .txt, .tsv; ``--sep``) or a
folder of tables; validate reads the preparation that train saved beside the models.

On a cluster pass the master with spark-submit; ``--master`` is for local runs.
"""

from __future__ import annotations

import argparse
import json
import os
import sys


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="cohortlens")
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    q = sub.add_parser("query")
    q.add_argument("name")
    q.add_argument("--data", required=True)
    q.add_argument("--out", required=True)
    t = sub.add_parser("train")
    t.add_argument("--data", required=True)
    t.add_argument("--out", required=True)
    t.add_argument("--models", default=None)
    t.add_argument("--tune", action="store_true")
    t.add_argument("--fit-on", choices=("all", "train"), default="all")
    d = sub.add_parser("dashboard")
    d.add_argument("--data", required=True)
    d.add_argument("--out", required=True)
    v = sub.add_parser("validate")
    v.add_argument("--data", required=True)
    v.add_argument("--models-dir", required=True)
    v.add_argument("--out", required=True)
    for flow in (t, d, v):
        flow.add_argument("--sep", default=",")
    a = p.parse_args(argv)

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if a.cmd == "list":
        from cohortlens.plans.catalog import QUERIES
        print("\n".join(sorted(QUERIES)))
        return 0
    from cohortlens.session import get_session
    spark = get_session(a.master)
    try:
        if a.cmd == "query":
            from cohortlens.plans.catalog import QUERIES
            QUERIES[a.name](spark, a.data).write.mode("overwrite").parquet(a.out)
            print(json.dumps({"query": a.name, "out": a.out}))
        elif a.cmd == "train":
            from cohortlens.plans.workflows import DEFAULT_MODELS, train_and_explain
            models = tuple(a.models.split(",")) if a.models else DEFAULT_MODELS
            print(json.dumps(train_and_explain(spark, a.data, a.out, models, tune=a.tune, sep=a.sep, fit_on=a.fit_on), default=str))
        elif a.cmd == "dashboard":
            from cohortlens.plans.workflows import dashboard_tables
            print(json.dumps(dashboard_tables(spark, a.data, a.out, a.sep), default=str))
        elif a.cmd == "validate":
            from cohortlens.plans.workflows import validate_saved_models
            names = {"Decision Tree": "decision_tree", "KNN": "knn", "SVM": "svm"}
            paths = {k: f"{a.models_dir.rstrip('/')}/{v}" for k, v in names.items()}
            preparation = f"{os.path.dirname(a.models_dir.rstrip('/'))}/preparation"
            rows = [r.asDict() for r in validate_saved_models(spark, a.data, paths, a.out, preparation, a.sep).collect()]
            print(json.dumps(rows, default=str))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
