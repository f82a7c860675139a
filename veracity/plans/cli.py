"""Command line: train, evaluate, build, external, estimate. Paths may be in any store that Spark reads."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest, metrics, ml, quality, sampling, scoring
from ..sources import io


def _train(spark: SparkSession, a: argparse.Namespace) -> None:
    records = sampling.stratified_sample(quality.filter_negatives(io.read_jsonl(spark, a.dataset_path, io.RECORD)), a.limit)
    rows = metrics.stratify_labels(scoring.score(records)).select("_ord", "label", "variant_type", "stratum", "features")
    split = metrics.normalised_weights(sampling.stratified_split(rows, "stratum", F.col("_ord")), "is_validation").cache()
    train, held = split.where(~F.col("is_validation")), split.where("is_validation")
    name, model, found = ml.select_variant(train, held, weight="weight")
    model.save(f"{a.model_dir}/main")
    text = list(range(10, 17))
    ml.fit(train, held, indices=tuple(text), weight="weight", calibration="isotonic").save(f"{a.model_dir}/fallback")
    counts = lambda d: {r["variant_type"]: r["n"] for r in metrics.variant_counts(d).collect()}
    summary = {"selected_variant": name, "selected_indices": list(model.indices), "average_precision": found, "disable_api": True, "dataset_path": a.dataset_path, "variant_counts": counts(split), "train_variant_counts": counts(train), "val_variant_counts": counts(held), "variant_weighting": "enabled"}
    io.write_summary(a.summary_path or f"{a.model_dir}/training_summary.json", summary)
    print(summary)


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    bench = io.read_csv(spark, a.csv_path)
    if a.dev_slice_size is not None:
        bench = sampling.typed_dev_slice(bench, a.dev_slice_size) if a.slice_name == "typed" else sampling.dev_slice(bench, a.dev_slice_size, a.slice_name)
    elif a.limit is not None:
        bench = sampling.per_label_limit(bench, a.limit)
    keyed = bench.withColumn("row_key", T.key_digest(F.col("_ord"), F.col("prompt"), F.col("model_answer")))
    if a.resume_from_checkpoint and io.exists(spark, a.output_path):
        keyed = scoring.resume(keyed, spark.read.parquet(a.output_path), ["row_key"])
    main = ml.Classifier.load(spark, f"{a.model_dir}/main") if a.model_dir and io.exists(spark, f"{a.model_dir}/main") else None
    began = time.monotonic()
    score = lambda df: scoring.score(df.withColumnRenamed("model_answer", "answer"), main=main).withColumnRenamed("answer", "model_answer")
    columns = ["row_key", "prompt", "model_answer", "is_hallucination", "is_hallucination_proba", "pred_is_hallucination", "t_model_sec"]
    n = keyed.count() if a.checkpoint_every else 0
    if 0 < a.checkpoint_every < n:
        # rows keep to a part by their key, so what a lost run has written is what it need not score again
        keyed = keyed.withColumn("_part", F.pmod(F.xxhash64("row_key"), F.lit(-(-n // a.checkpoint_every))))
        parts = [keyed.where(F.col("_part") == k).drop("_part") for k in range(-(-n // a.checkpoint_every))]
    else:
        parts = [keyed]
    for part in parts:
        io.append_scored(score(part).select(columns), a.output_path)
    every = spark.read.parquet(a.output_path)
    ap = metrics.average_precision(every.where("is_hallucination is not null"), "is_hallucination_proba", "is_hallucination").first()[0]
    n = every.count()
    print({"rows": n, "average_precision": ap, "seconds": round(time.monotonic() - began, 3), **metrics.latency_summary(every, "t_model_sec").first().asDict()})


def _build(spark: SparkSession, a: argparse.Namespace) -> None:
    def save(df: DataFrame) -> None:
        io.write_jsonl(df, a.output_path)
        print({"rows": io.read_jsonl(spark, a.output_path, io.SEED if a.stage == "seed-harvest" else io.RECORD).count()})

    if a.stage == "seed-harvest":
        known = io.read_jsonl_or_empty(spark, a.resume_path, io.SEED) if a.resume_path else io.ordered(spark.createDataFrame([], io.SEED))
        return save(known.unionByName(ingest.harvest(io.read_jsonl(spark, a.seed_path, io.BINDING), a.per_spec, known).select(known.columns)))
    old = io.read_jsonl_or_empty(spark, a.resume_path, io.RECORD) if a.resume_path else None
    if a.stage == "targeted-augment":
        return save(ingest.augment(old if old is not None else io.read_jsonl(spark, a.dataset_path, io.RECORD), _rewrites(spark, a), a.limit or 120))
    seeds = io.read_jsonl(spark, a.seed_path, io.SEED)
    if a.stage == "seed":
        return save(ingest.positives(seeds if a.limit is None else seeds.orderBy("_ord").limit(a.limit)))
    built = ingest.build(seeds if a.limit is None or a.stage == "groq-negatives" else seeds.orderBy("_ord").limit(a.limit), old and quality.filter_negatives(old))
    if a.stage == "groq-negatives":
        built = built.unionByName(ingest.model_negatives(seeds, _rewrites(spark, a), a.limit, built).select(built.columns))
    save(quality.filter_augmented(quality.filter_negatives(built)))


def _rewrites(spark: SparkSession, a: argparse.Namespace) -> ingest.Rewrite:
    """Answers that a model gave elsewhere, by (prompt, answer, mode); without a file nothing is rewritten."""
    if not a.rewrites_path:
        return lambda df, mode: df.withColumn("rewritten", F.lit(None).cast("string"))
    every = io.read_jsonl(spark, a.rewrites_path, "prompt string, answer string, mode string, rewritten string")
    one = every.groupBy("prompt", "answer", "mode").agg(F.min_by("rewritten", "_ord").alias("rewritten"))
    return lambda df, mode: df.join(one.where(F.col("mode") == mode).drop("mode"), ["prompt", "answer"], "left")


def _external(spark: SparkSession, a: argparse.Namespace) -> None:
    """Records of question and claim files, merged into the main records; seeds of the questions, and seeds fetched before, merged
    into the main seeds."""
    none = lambda schema: io.ordered(spark.createDataFrame([], schema))
    records, seeds = none(io.RECORD), none(io.SEED)
    if a.popqa_path:
        rows = io.read_popqa(spark, a.popqa_path)
        records = ingest.merge_external(records, ingest.popqa(rows, a.popqa_limit), seeds=False)
        seeds = ingest.merge_external(seeds, ingest.popqa_seeds(rows, a.popqa_limit), seeds=True)
    if a.fever_path:
        records = ingest.merge_external(records, ingest.fever(io.read_jsonl(spark, a.fever_path, io.FEVER), a.fever_limit), seeds=False)
    if a.seed_path:
        seeds = ingest.merge_external(seeds, io.read_jsonl_or_empty(spark, a.seed_path, io.SEED), seeds=True)
    if a.main_path:
        records = ingest.merge_external(io.read_jsonl_or_empty(spark, a.main_path, io.RECORD), records, seeds=False)
    if a.main_seed_path:
        seeds = ingest.merge_external(io.read_jsonl_or_empty(spark, a.main_seed_path, io.SEED), seeds, seeds=True)
    io.write_jsonl(records, a.output_path)
    if a.seed_output_path:
        io.write_jsonl(seeds, a.seed_output_path)


def _estimate(spark: SparkSession, a: argparse.Namespace) -> None:
    n = lambda path, schema: io.read_jsonl_or_empty(spark, path, schema).count() if path else 0
    bench = io.read_csv(spark, a.public_csv).count() if a.public_csv else 0
    print(metrics.estimate(n(a.seed_path, io.SEED), n(a.synthetic_path, io.RECORD), bench, a.planned_negatives))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veracity")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run, *flags):
        c = sub.add_parser(name)
        for flag, kw in flags:
            c.add_argument(flag, **kw)
        c.set_defaults(run=run)

    need, number = {"required": True}, {"type": int}
    command("train", _train, ("--dataset-path", need), ("--limit", number), ("--model-dir", need), ("--summary-path", {}), ("--disable-api", {"action": "store_true"}))
    command("evaluate", _evaluate, ("--csv-path", need), ("--output-path", need), ("--limit", number), ("--dev-slice-size", number), ("--slice-name", {"choices": ["balanced", "typed"], "default": "balanced"}), ("--resume-from-checkpoint", {"action": "store_true"}), ("--checkpoint-every", {"type": int, "default": 0}), ("--model-dir", {}))
    command("build", _build, ("--stage", {"choices": ["seed", "seed-harvest", "rule-negatives", "groq-negatives", "targeted-augment"], "required": True}), ("--seed-path", {}), ("--dataset-path", {}), ("--rewrites-path", {}), ("--output-path", need), ("--resume-path", {}), ("--limit", number), ("--per-spec", {"type": int, "default": 25}))
    command("external", _external, ("--popqa-path", {}), ("--fever-path", {}), ("--popqa-limit", {"type": int, "default": 1000}), ("--fever-limit", {"type": int, "default": 1000}), ("--seed-path", {}), ("--main-path", {}), ("--main-seed-path", {}), ("--output-path", need), ("--seed-output-path", {}))
    command("estimate", _estimate, ("--seed-path", {}), ("--synthetic-path", {}), ("--public-csv", {}), ("--planned-negatives", {"type": int, "default": 300}))
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(SparkSession.builder.appName("veracity").getOrCreate(), a)


if __name__ == "__main__":
    main()
