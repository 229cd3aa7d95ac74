"""Command line: python -m pulsegrid preprocess-clinical|preprocess-alarm|preprocess-anomaly|demo --help"""

from __future__ import annotations

import argparse
import json
import sys

from pulsegrid.plans import runner
from pulsegrid.session import local_session
from pulsegrid.sources.series import read_table


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="pulsegrid")
    sub = parser.add_subparsers(dest="job", required=True)
    for job in ("preprocess-clinical", "preprocess-alarm", "preprocess-anomaly"):
        p = sub.add_parser(job)
        p.add_argument("--input", required=True)
        p.add_argument("--output", required=True)
        p.add_argument("--gold-size", type=int, default=500)
        p.add_argument("--seed", type=int, default=0)
        if job == "preprocess-clinical":
            p.add_argument("--diagnoses", required=True)
            p.add_argument("--format", choices=("parquet", "csv"), default="parquet")
        if job == "preprocess-alarm":
            p.add_argument("--task", choices=("binary", "multiclass"), default="binary")
    p = sub.add_parser("demo")
    p.add_argument("--dataset", default="mimic")
    p.add_argument("--data-root", required=True)
    p.add_argument("--alpha", type=float, default=0.05)
    p.add_argument("--methods", nargs="*")
    p.add_argument("--out", required=True)
    a = parser.parse_args(argv)
    spark = local_session()
    if a.job == "preprocess-clinical":
        done = runner.preprocess_clinical(read_table(spark, a.input, a.format), read_table(spark, a.diagnoses, a.format), a.output, a.gold_size, a.seed)
    elif a.job == "preprocess-alarm":
        done = runner.preprocess_alarm(spark, a.input, a.output, a.task, a.gold_size, a.seed)
    elif a.job == "preprocess-anomaly":
        done = runner.preprocess_anomaly(spark, a.input, a.output, gold=a.gold_size, seed=a.seed)
    else:
        done = runner.demo(spark, a.dataset, a.data_root, a.out, alpha=a.alpha, names=a.methods, report=lambda line: print(line, file=sys.stderr))
    print(json.dumps(done, indent=2))


if __name__ == "__main__":
    main()
