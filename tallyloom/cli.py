"""Command line: ``python -m tallyloom.cli reconcile|score|sweep|generate|show-config``."""

from __future__ import annotations

import argparse
import os
import time

from pyspark.sql import SparkSession


#: Bytes of exports up to which one machine's cores, and few partitions, are enough.
SMALL = 64 << 20


def _spark(zone: str | None, folder: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("tallyloom")
    if zone:
        builder = builder.config("spark.sql.session.timeZone", zone)
    if folder and sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names) <= SMALL:
        # Tasks and generated classes for a few rows cost more than the rows.
        few = {"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
        builder = builder.config(map=few)
    return builder.getOrCreate()


def _reconcile(args) -> int:
    from .plans import measures, persist, report
    from .plans.reconcile import reconcile

    if not os.path.isdir(args.data_dir):
        raise SystemExit(f"{args.data_dir} is no folder")
    spark, start = _spark(args.timezone, args.data_dir), time.perf_counter()
    result = reconcile(spark, args.data_dir, args.customer_threshold, args.lines)
    n_bad = result.quarantine.count()
    result.crosswalk = result.crosswalk.persist()
    result.crosswalk.count()
    seconds = time.perf_counter() - start
    merged = persist.save_crosswalk(result, args.crosswalk_path)
    persist.save_quarantine(result, args.quarantine_path)
    groups = persist.save_duplicates(result, args.duplicate_log_path)
    folder = os.path.dirname(os.path.abspath(args.report_path))
    os.makedirs(folder, exist_ok=True)
    with open(args.report_path, "w", encoding="utf-8") as out:
        out.write(report.render(result, seconds))
    for r in measures.match_rates(result.crosswalk).orderBy("place").collect():
        print(f"{r.entity_type}: {r.matched} of {r.total} matched")
    print(f"Quarantined records: {n_bad}\nReport: {args.report_path}\nCrosswalk: {args.crosswalk_path} ({merged} entries)")
    print(f"Quarantine log: {args.quarantine_path}\nDuplicate log: {args.duplicate_log_path} ({groups} groups)\nExecution time: {seconds:.2f}s")
    if args.target_dir:
        persist.load_targets(spark, result, args.target_dir)
    if args.jdbc_url:
        persist.load_jdbc(result, args.jdbc_url, {})
    return 0


def _score(args) -> int:
    from .plans.measures import score
    from .plans.reconcile import reconcile
    from .sources.exports import read_ground_truth

    spark = _spark(args.timezone, args.data_dir)
    truth = read_ground_truth(spark, f"{args.data_dir}/ground_truth.json")
    crosswalk = reconcile(spark, args.data_dir, args.threshold, args.lines).crosswalk
    for name, entities in (("invoices", ("invoice",)), ("payments", ("payment",)), ("combined", ("invoice", "payment"))):
        r = score(crosswalk, truth, entities).first()
        print(f"{name}: precision {r.precision:.1%}, recall {r.recall:.1%}, f1 {r.f1:.1%}")
    return 0


def _sweep(args) -> int:
    from .plans.measures import sweep
    from .plans.reconcile import reconcile
    from .sources.exports import read_ground_truth

    spark = _spark(args.timezone, args.data_dir)
    truth = read_ground_truth(spark, f"{args.data_dir}/ground_truth.json")
    for threshold, f1 in sweep(reconcile(spark, args.data_dir, lines=args.lines), truth, args.thresholds):
        print(f"{threshold:g}: f1 {f1:.1%}")
    return 0


def _config(args):
    from dataclasses import replace

    from .plans.generate import Config

    config = Config.from_yaml(args.config) if args.config else Config()
    given = {k: getattr(args, k) for k in ("seed", "num_customers", "output_dir", "with_ground_truth") if getattr(args, k) is not None}
    return replace(config, **given)


def _generate(args) -> int:
    from .plans.generate import generate

    config = _config(args)
    generate(_spark(args.timezone), config)
    print(f"Written to {config.output_dir}")
    return 0


def _show(args) -> int:
    print(_config(args).to_yaml(), end="")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyloom")
    commands = parser.add_subparsers(required=True)
    run = commands.add_parser("reconcile")
    run.add_argument("data_dir")
    run.add_argument("--crosswalk-path", default="data/processed/crosswalk.json")
    run.add_argument("--quarantine-path", default="data/processed/quarantine_log.json")
    run.add_argument("--duplicate-log-path", default="data/processed/duplicate_log.json")
    run.add_argument("--report-path", default="RECONCILIATION_REPORT.md")
    run.add_argument("--customer-threshold", type=float, default=0.75)
    run.add_argument("--target-dir", help="also upsert the run into Parquet tables there")
    run.add_argument("--jdbc-url", help="also write the run to staging tables of a database")
    run.set_defaults(call=_reconcile)
    rate = commands.add_parser("score")
    rate.add_argument("data_dir")
    rate.add_argument("--threshold", type=float, default=0.75)
    rate.set_defaults(call=_score)
    walk = commands.add_parser("sweep", help="F1 of the run at several customer thresholds")
    walk.add_argument("data_dir")
    walk.add_argument("--thresholds", type=float, nargs="+", default=[0.75, 0.8, 0.85, 0.9, 0.95])
    walk.set_defaults(call=_sweep)
    for command in (run, rate, walk):
        command.add_argument("--lines", action="store_true", help="exports without line breaks in values (CSV, JSON lines), which tasks read in parts")
    for name, call in (("generate", _generate), ("show-config", _show)):
        make = commands.add_parser(name)
        make.add_argument("--config")
        make.add_argument("--seed", type=int)
        make.add_argument("--num-customers", type=int)
        make.add_argument("--output-dir")
        make.add_argument("--with-ground-truth", action=argparse.BooleanOptionalAction)
        make.set_defaults(call=call)
    for command in commands.choices.values():
        command.add_argument("--timezone", help="session time zone, in which epoch dates are read and written")
    args = parser.parse_args(argv)
    return args.call(args)


if __name__ == "__main__":
    raise SystemExit(main())
