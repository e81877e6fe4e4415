"""Headline timings: prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Staging (writing a
table out as files) is not timed. Each value is the median of BENCH_RUNS runs
after one warm-up; every run reads its input again and writes all rows and
columns to the no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from chatloom.operators import catalog, chat, generate, render, sampling  # noqa: E402
from chatloom.plans import QUERIES, staging  # noqa: E402
from chatloom.plans.catalogs import model_configs, model_files  # noqa: E402
from chatloom.plans.generation import _echo  # noqa: E402
from chatloom.plans.records import alpaca_json, mixed_json, qa_json  # noqa: E402
from chatloom.session import build_session, shared_path  # noqa: E402
from chatloom.sources import datasets  # noqa: E402
from chatloom.sources.files import list_files  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def workloads(spark):
    """name -> (build, amount, unit of the rate)."""
    table = lambda name: spark.read.parquet(f"{SF_DIR}/{name}.parquet")
    turns, documents = table("conversations"), table("documents")
    size = lambda path: list_files(spark, path).agg(F.sum("length")).first()[0] / 1e6
    n_turns, n_docs = turns.count(), documents.count()

    qa = staging.stage_lines(qa_json(documents).select("value"), "bench-qa")
    alpaca = staging.stage_arrays(alpaca_json(documents), "bench-alpaca")
    csv = staging.stage_csv(documents.selectExpr("text as question", "lang as answer"), "bench-csv")
    text = staging.stage_paragraphs(documents.select("text"), "bench-text")
    bad = staging.stage_lines(mixed_json(documents).select("value"), "bench-bad")

    listing, configs = shared_path(spark, "bench-listing"), shared_path(spark, "bench-configs")
    model_files(spark, SF_DIR).write.parquet(listing)
    model_configs(spark, SF_DIR).write.parquet(configs)
    n_files = spark.read.parquet(listing).count()

    def models():
        return catalog.model_catalog(spark.read.parquet(listing), spark.read.parquet(configs), "models", list_all=False)

    def quality():
        lines = datasets.read_json_records(spark, bad, "lines")
        return catalog.line_verdicts(lines)

    def replies():
        prompts = table("conversations").select("conv_id", "turn", render.single_prompt(F.col("text")).alias("prompt"))
        return generate.generate_batch(prompts, _echo)

    return {
        "render_training_text": (lambda: chat.fold_text(table("conversations")), n_turns, "rows/s"),
        "chat_turn_prompts": (lambda: chat.turn_prompts(table("conversations")), n_turns, "rows/s"),
        "jsonl_scan": (lambda: datasets.read_qa(spark, qa), size(qa), "MB/s"),
        "alpaca_array_scan": (lambda: datasets.read_alpaca(spark, alpaca, "array"), size(alpaca), "MB/s"),
        "csv_scan": (lambda: datasets.read_csv(spark, csv), size(csv), "MB/s"),
        "paragraph_scan": (lambda: datasets.read_text(spark, text), size(text), "MB/s"),
        "load_and_shuffle": (lambda: datasets.load_dataset(spark, qa, format="jsonl"), size(qa), "MB/s"),
        "jsonl_quality": (quality, n_docs, "rows/s"),
        "classify_records": (lambda: QUERIES["classify_records"](spark, SF_DIR), n_docs, "rows/s"),
        "seeded_sample": (lambda: sampling.seeded_sample(table("documents"), "doc_id", 1000), n_docs, "rows/s"),
        "seeded_numbers": (lambda: sampling.seeded_numbers(table("documents"), "doc_id"), n_docs, "rows/s"),
        "batch_plan": (lambda: sampling.batch_plan(table("documents"), "doc_id"), n_docs, "rows/s"),
        "model_catalog": (models, n_files, "rows/s"),
        "stub_generation": (replies, n_turns, "rows/s"),
    }


def timed(build) -> float:
    begin = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    spark = build_session("bench", CPUS, **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds, rates = {}, {}
    for name, (build, amount, unit) in workloads(spark).items():
        timed(build)
        seconds[name] = round(statistics.median(timed(build) for _ in range(RUNS)), 3)
        rates[name] = f"{amount / seconds[name]:.1f} {unit}"
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "rates": rates,
        "cores": CPUS,
        "spark": spark.version,
        "runs": RUNS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
