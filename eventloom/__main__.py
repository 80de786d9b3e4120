"""Run a job: python -m eventloom {ingest,features,train,score} ...

Session settings (master, memory, shuffle partitions) come from spark-submit or spark-defaults.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from eventloom.contracts import FEATURE_KEY, SOURCES
from eventloom.operators.model import FOREST_DEPTH, TREES
from eventloom.plans.features import build_features
from eventloom.plans.ingest import ingest
from eventloom.plans.train import score_table, train_models
from eventloom.sources.tables import DEFAULT_FORMAT, read_table, write_table


def main() -> None:
    parser = argparse.ArgumentParser(prog="eventloom")
    jobs = parser.add_subparsers(dest="job", required=True)
    paths = {
        "ingest": ("raw", "tables", "reports"),
        "features": ("tables", "output", "reports"),
        "train": ("features", "output"),
        "score": ("features", "models", "output"),
    }
    for job, names in paths.items():
        sub = jobs.add_parser(job)
        sub.add_argument("--format", default=DEFAULT_FORMAT)
        for name in names:
            sub.add_argument(f"--{name}", required=True)
        if job == "ingest":
            sub.add_argument("--pattern", default="{source}.txt.gz", help="files of a log below --raw: a name, folder or glob")
            sub.add_argument("--spread", type=int, help="partitions to deal rows out to; by default as many as a shuffle has")
            sub.add_argument("--no-spread", action="store_true", help="leave rows where files were read")
            sub.add_argument("--strip-on-read", action="store_true", help="ignore blanks around fields while parsing")
            sub.add_argument("--exact-quantiles", action="store_true")
            sub.add_argument("--refused", help="folder for lines that do not fit their log, with the reason; by default they are kept with nulls")
        elif job == "features":
            sub.add_argument("--label", default="next_row", choices=("next_row", "adjacent"))
            sub.add_argument("--null-times", default="drop", choices=("drop", "zero", "keep"))
            sub.add_argument("--null-keys", default="unmatched", choices=("unmatched", "matched"))
        elif job == "train":
            sub.add_argument("--trees", type=int, default=TREES)
            sub.add_argument("--depth", type=int, default=FOREST_DEPTH)
            sub.add_argument("--sketched-medians", action="store_true", help="medians within 0.1 %% of the rows, in one pass")
    args = parser.parse_args()

    spark = SparkSession.builder.appName(f"eventloom-{args.job}").getOrCreate()
    if args.job == "ingest":
        raw = {s: f"{args.raw}/{args.pattern.format(source=s)}" for s in SOURCES}
        # a gzip file is one task however large it is, so rows are dealt out unless told otherwise
        spread = None if args.no_spread else args.spread or int(spark.conf.get("spark.sql.shuffle.partitions"))
        scan = {"spread": spread, "strip_on_read": args.strip_on_read}
        ingest(spark, raw, args.tables, args.reports, args.refused, fmt=args.format, exact_quantiles=args.exact_quantiles, **scan)
    elif args.job == "features":
        options = {"label": args.label, "null_times": args.null_times, "null_keys": args.null_keys}
        build_features(spark, args.tables, args.output, args.reports, fmt=args.format, **options)
    elif args.job == "train":
        options = {"trees": args.trees, "depth": args.depth, "exact_medians": not args.sketched_medians}
        train_models(spark, args.features, args.output, fmt=args.format, **options)
    else:
        scored = score_table(read_table(spark, args.features, args.format), args.models, args.format, list(FEATURE_KEY))
        write_table(scored, args.output, args.format)
    spark.stop()


if __name__ == "__main__":
    main()
