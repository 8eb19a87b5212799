"""Results of an evaluation: rows of queries, summaries, tables in Markdown, comparisons.

Tables that grow with the answer key stay DataFrames and are written by Spark; a
summary has a bounded number of rows (runs, slices, grid points), and only that
is collected.
"""

from __future__ import annotations

import json
import os
import platform
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import numbered
from . import evaluate
from .answer_key import DISTORTIONS

HEADLINE = ("dir", "far", "frr", "misid", "top1", "answer_precision", "offset_median_s", "offset_within_1s")


def per_query(specs: DataFrame, runs: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """A row for each query, by query_id: what it is, and accepted, correct and offset_err_s of each run; correct is null for held-out films.

    runs: by name, judged rows and whether each is accepted.
    """
    out = specs.select("query_id", "split", F.col("film_id").alias("film"), "role", "group", "distortion", "length_s", "true_offset_s")
    for i, (name, (rows, acc)) in enumerate(runs.items()):
        own = rows.select("query_id", "failed", acc.alias(f"{name}_accepted"), F.when(F.col("known"), F.col("correct")).alias(f"{name}_correct"), F.when(acc & F.col("correct"), F.col("err")).alias(f"{name}_offset_err_s"))
        out = out.join(own if i == 0 else own.drop("failed"), "query_id", "left")
    return out.orderBy("query_id")


def ordered(slices: DataFrame) -> DataFrame:
    """Rows of a breakdown in the order of a report: by kind; distortions as declared, numbers as numbers, others by name."""
    declared = F.coalesce(*[F.when(F.col("slice") == d, i) for i, d in enumerate(DISTORTIONS)], F.lit(len(DISTORTIONS)))
    return slices.orderBy("kind", F.when(F.col("kind") == "distortion", declared).otherwise(0), F.expr("try_cast(slice as double)").asc_nulls_last(), "slice")


def counts(specs: DataFrame) -> DataFrame:
    """(n_queries, n_base_clips, n_distortions, n_films)."""
    return specs.agg(F.count("*").alias("n_queries"), F.countDistinct("base_id").alias("n_base_clips"), F.countDistinct("distortion").alias("n_distortions"), F.countDistinct("film_id").alias("n_films"))


def latency_sample(specs: DataFrame, n: int = 300) -> DataFrame:
    """The first n queries by id: those whose search and decision are timed one by one."""
    return specs.orderBy("query_id").limit(n)


def base_index(rows: DataFrame) -> DataFrame:
    """(base_id, base_index): places of the distinct base clips in order."""
    return numbered(rows.select("base_id").distinct(), "base_id").select("base_id", F.col("_n").cast("int").alias("base_index"))


def environment(spark: SparkSession) -> dict:
    """What the numbers were taken on."""
    try:
        revision = subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=10, cwd=os.path.dirname(os.path.abspath(__file__))).stdout.strip()
    except OSError:
        revision = ""
    return {"spark": spark.version, "python": platform.python_version(), "machine": platform.machine(), "system": platform.system(), "cores": os.cpu_count(), "parallelism": spark.sparkContext.defaultParallelism, "revision": revision or None}


def summary(name: str, rows: DataFrame, acc: Column, *, answer_key_digest: str, thresholds: dict, weights: DataFrame | None = None) -> dict:
    """One run: its metrics on the test split, with intervals where weights are given, slices, thresholds."""
    test = rows.where("split = 'test'")
    out = {"run": name, "answer_key_digest": answer_key_digest, "thresholds": thresholds, "metrics": evaluate.metrics(test, acc).first().asDict()}
    if weights is not None:
        known, hit = F.col("known"), acc & F.col("correct")
        err = F.when(hit & known, F.col("err"))
        of = {"dir": (hit, known), "top1": (F.col("correct"), known), "far": (acc, ~known), "offset_within_1s": ((err <= 1.0).cast("double"), err.isNotNull())}
        out["intervals"] = {k: list(evaluate.bootstrap(test, v, o, weights).first()) for k, (v, o) in of.items()}
    out["breakdown"] = [r.asDict() for r in ordered(evaluate.breakdown(test, acc)).collect()]
    return out


def percent(x: float | None) -> str:
    return "-" if x is None else f"{100 * x:.1f}%"


def megabytes(n: float | None) -> str:
    return "-" if n is None else f"{n / 1e6:.0f} MB"


def interval(x: float | None, bounds: list | None) -> str:
    """A share and its interval in one cell."""
    return percent(x) if not bounds or bounds[0] is None else f"{percent(x)} [{100 * bounds[0]:.1f}, {100 * bounds[1]:.1f}]"


def _table(head: list[str], rows: list[list[str]]) -> str:
    return "\n".join(["| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *rows]])


def _cell(metric: str, run: dict) -> str:
    x = run["metrics"].get(metric)
    if metric.endswith("_s") and not metric.startswith("offset_within"):
        return "-" if x is None else f"{x:.2f} s"
    return interval(x, run.get("intervals", {}).get(metric))


def markdown(title: str, runs: list[dict], latency: dict | None = None, index_bytes: int | None = None) -> str:
    """Headline, breakdowns and latency of runs (of one answer key) as Markdown."""
    names = [r["run"] for r in runs]
    lines = [f"# {title}", "", _table(["metric", *names], [[m, *[_cell(m, r) for r in runs]] for m in HEADLINE])]
    for kind in dict.fromkeys(x["kind"] for r in runs for x in r["breakdown"]):
        metric = "far" if kind == "group" else "dir"
        own = [{x["slice"]: x for x in r["breakdown"] if x["kind"] == kind} for r in runs]
        lines += ["", f"## {metric.upper()} by {kind}", "", _table([kind, *names], [[s, *[percent(o[s][metric]) if s in o else "-" for o in own]] for s in dict.fromkeys(s for o in own for s in o)])]
    if latency:
        stages = sorted({k.rsplit("_", 1)[0] for k in latency})
        lines += ["", "## Latency", "", _table(["stage", "p50 ms", "p95 ms"], [[s, *["-" if latency.get(f"{s}_{p}") is None else f"{latency[f'{s}_{p}']:.2f}" for p in ("p50", "p95")]] for s in stages])]
    if index_bytes is not None:
        lines += ["", f"Index: {megabytes(index_bytes)}"]
    return "\n".join(lines) + "\n"


def write(spark: SparkSession, path: str, runs: list[dict], queries: DataFrame, roc: DataFrame | None = None, title: str = "Evaluation", **more) -> None:
    """summary/ (JSON), report/ (Markdown), per_query/ (CSV with a head) and roc/ (CSV) below path."""
    root = path.rstrip("/")
    spark.createDataFrame([(json.dumps({"runs": runs, "environment": environment(spark)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/summary")
    spark.createDataFrame([(markdown(title, runs, **more),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/report")
    queries.write.mode("overwrite").option("header", True).csv(f"{root}/per_query")
    if roc is not None:
        roc.write.mode("overwrite").option("header", True).csv(f"{root}/roc")


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(run, answer_key_digest, metrics...) of the summaries of earlier results."""
    runs = spark.read.text([f"{p.rstrip('/')}/summary" for p in paths])
    kinds = ", ".join(f"{m}:double" for m in evaluate.METRICS)
    each = runs.select(F.explode(F.from_json("value", f"runs array<struct<run:string, answer_key_digest:string, metrics:struct<{kinds}>>>")["runs"]).alias("r"))
    return each.select("r.run", "r.answer_key_digest", "r.metrics.*")


def compare(spark: SparkSession, paths: list[str], out: str) -> DataFrame:
    """Runs of several results by DIR, best first, written as CSV and Markdown below out; of different answer keys it is an error."""
    rows = evaluate.compare(read(spark, paths))
    rows.write.mode("overwrite").option("header", True).csv(f"{out.rstrip('/')}/comparison")
    found = [r.asDict() for r in rows.collect()]  # a row a run
    text = _table(["run", *HEADLINE], [[r["run"], *[_cell(m, {"metrics": r}) for m in HEADLINE]] for r in found])
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out.rstrip('/')}/report")
    return rows
