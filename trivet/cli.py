"""Command line: ``python -m trivet.cli COMMAND``. Paths are Spark paths; the cluster comes from spark-submit."""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivet import schema
from trivet.functions.text import is_real
from trivet.operators import metrics, records, report, synth, triage
from trivet.operators.clusters import written
from trivet.plans import artifacts, benchmark, dataset
from trivet.sources import readers, writers


def provider_of(a: argparse.Namespace) -> triage.Provider:
    """A model behind ``--endpoint``, else the rules that need none. A token comes from the environment variable that is named."""
    if not a.endpoint:
        return triage.native_provider
    model = triage.http_model(a.endpoint, a.timeout, os.environ[a.token_env] if a.token_env else None)
    return triage.callable_provider(model, a.retries, a.at_once, a.timeout * (a.retries + 1))


def run_triage(spark: SparkSession, a: argparse.Namespace) -> None:
    decided = written(triage.flat(triage.classify(readers.read_detections(spark, a.input), provider_of(a), a.model)))
    writers.write_json_lines(report.report_items(decided), f"{a.output}/items")
    writers.write_json_lines(report.nested_report(decided), f"{a.output}/nested")
    writers.write_json_lines(report.owner_summary(decided), f"{a.output}/owners")


def run_build(spark: SparkSession, a: argparse.Namespace) -> None:
    dataset.build(spark, a.source_tp, a.source_fp, a.source_review, a.out_dir, a.augment_fp, a.per_class_cap, a.seed, a.rationales)


def run_generate(spark: SparkSession, a: argparse.Namespace) -> None:
    vocabulary = written(synth.mine_vocabulary(spark.read.text(a.mine).withColumnRenamed("value", "text"))) if a.mine else None
    rows = written(synth.generate(spark, a.n_tp, a.n_fp, a.n_review, a.seed, vocabulary))
    writers.write_json_lines(rows, f"{a.out_dir}/records")
    writers.write_json_lines(rows.groupBy("label", "category").count().orderBy("label", "category"), f"{a.out_dir}/report")


def _records(spark: SparkSession, path: str, limit: int) -> DataFrame:
    rows = readers.read_json_lines(spark, artifacts.resolved(spark, path), schema.RECORD)
    return records.first_records(rows, limit)


def run_benchmark(spark: SparkSession, a: argparse.Namespace) -> None:
    models = {name: provider_of(a) for name in a.models}
    rows = written(benchmark.bench_rows(_records(spark, a.test, a.limit), models, tuple(a.strategies)))
    writers.write_json_lines(rows, f"{a.output}/rows")
    writers.write_json_lines(metrics.promotion(metrics.cost_multiplier(metrics.benchmark_summary(rows))), f"{a.output}/summary")


def run_evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = readers.read_json_lines(spark, artifacts.resolved(spark, a.answers), f"{schema.PROMPT_PAIR}, raw_response string, latency_ms double")
    rows = written(benchmark.evaluate(rows))
    for name, part in benchmark.evaluation_report(rows).items():
        writers.write_json_lines(part, f"{a.report}/{name}")


def run_distill(spark: SparkSession, a: argparse.Namespace) -> None:
    done = readers.read_done_ids(spark, a.output) if a.resume else None
    rows = readers.read_json_lines(spark, artifacts.resolved(spark, a.input), schema.PROMPT_PAIR)
    found = benchmark.distill(rows, provider_of(a), a.teacher, done, a.limit)
    writers.write_json_lines(found, a.output, mode="append" if a.resume else "errorifexists")


def run_smoke(spark: SparkSession, a: argparse.Namespace) -> None:
    cases = benchmark.smoke_cases(spark)
    rows = benchmark.bench_rows(cases.withColumn("is_credentials", is_real(F.col("status"))), {"native": triage.native_provider}, ("direct_json",))
    print(writers.small_json(benchmark.smoke_summary(rows)))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trivet")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, **flags) -> None:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for flag, options in flags.items():
            c.add_argument(f"--{flag.replace('_', '-')}", **options)

    model_flags = {"endpoint": {}, "timeout": {"type": float, "default": 60.0}, "retries": {"type": int, "default": 1}, "at_once": {"type": int, "default": 8}, "token_env": {}}
    need, whole = {"required": True}, lambda n: {"type": int, "default": n}
    command("triage", run_triage, input=need, output=need, model={"default": "native"}, **model_flags)
    command("build", run_build, source_tp=need, source_fp=need, source_review={}, out_dir=need, augment_fp=whole(3), per_class_cap=whole(0), seed=whole(42), rationales={}, target={"default": "both"})
    command("generate", run_generate, out_dir=need, n_tp=whole(4000), n_fp=whole(4000), n_review=whole(700), seed=whole(42), mine={})
    command("benchmark", run_benchmark, test=need, output=need, models={"nargs": "+", "default": ["native"]}, strategies={"nargs": "+", "default": list(triage.STRATEGIES)}, limit=whole(0), **model_flags)
    command("evaluate", run_evaluate, answers=need, report=need)
    command("distill", run_distill, input=need, output=need, teacher={"default": "native"}, limit=whole(0), resume={"action": "store_true"}, **model_flags)
    command("smoke", run_smoke)
    return p


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(SparkSession.builder.appName(f"trivet-{args.command}").getOrCreate(), args)


if __name__ == "__main__":
    main()
