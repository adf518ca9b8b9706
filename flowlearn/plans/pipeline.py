"""The whole run: profile, prepare, train, calibrate, evaluate."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flow
from ..operators import encode, evaluate, profile, sampling
from ..operators.classifier import RandomFeatureClassifier
from ..sources import flowlog
from ..sources.shared import fresh_folder, listed, parked, removed


@dataclass
class Settings:
    """What a run can be told; ``from_env`` reads the same from FLOWLEARN_<NAME>."""

    validation_scenario: str = "dataset12.csv"
    test_scenario: str = "dataset23.csv"
    representation: str = "behavioral"
    target_per_class: int = 500_000
    validation_target_per_class: int = 100_000
    hidden: int = 512
    ridge: float = 0.01
    seed: int = 42
    minimum_validation_recall: float | None = None
    minimum_validation_specificity: float | None = 0.90
    window_seconds: float = 60.0
    window_history: int = 50
    window_mode: str = "exact"
    #: Behaviour windows over the sampled rows alone (as the training data were made), or over
    #: all rows before sampling (as rows are scored).
    window_before_sample: bool = False

    @classmethod
    def from_env(cls) -> Settings:
        out = cls()
        for name, old in vars(out).copy().items():
            if (text := os.environ.get(f"FLOWLEARN_{name.upper()}")) is not None:
                kind = float if old is None else type(old)
                setattr(out, name, text.lower() in ("1", "true", "yes") if kind is bool else kind(text))
        return out

    @property
    def window(self) -> dict:
        return {"seconds": self.window_seconds, "history": self.window_history, "mode": self.window_mode}


#: What is kept of the numerics of all rows.
RAW = ["scenario", "row_seq", "label", "raw", *flow.CATEGORIES, "id.resp_p"]
#: Detailed labels of all scenarios that a run publishes, at most.
MAX_DETAILS = 100_000


@dataclass
class Prepared:
    """``flows`` (parsed lines) and ``raw`` (their numerics) lie in ``folder`` until ``close``."""

    profile: DataFrame
    split: DataFrame
    encoders: dict[str, encode.Encoder]
    validation: DataFrame
    details: DataFrame
    flows: DataFrame | None = None
    raw: DataFrame | None = None
    folder: str | None = None

    def close(self) -> None:
        if self.folder:
            removed(self.split.sparkSession, self.folder)
            self.folder = self.flows = self.raw = None


def prepare(lines: DataFrame, s: Settings, expected_scenarios: int | None = 23, representations: list[str] | None = None) -> Prepared:
    """Profile the scenarios, split them, fit encoders on training scenarios alone, and check
    the encoded held-out scenarios against the profile.

    Lines are read twice: for the profile, and to be parsed into a table in the shared folder.
    The numerics of all rows, windows included, are computed once, into another."""
    spark = lines.sparkSession
    profiled = profile.scenarios(lines).withColumnRenamed("scenario", "dataset")
    found = profiled.collect()  # a row for each scenario
    names = [r.dataset for r in found]
    if expected_scenarios is not None and len(names) != expected_scenarios:
        raise ValueError(f"expected {expected_scenarios} scenarios, found {len(names)}")
    held = (s.validation_scenario, s.test_scenario)
    for name in held:
        if name not in names:
            raise ValueError(f"held-out scenario {name} is missing")
    prof = spark.createDataFrame(found, profiled.schema)
    split = sampling.scenario_split(prof, *held).select("dataset", "rows", "benign", "malicious", "partition").orderBy(flowlog.scenario_order(F.col("dataset")))
    wanted, folder = representations or list(flow.REPRESENTATIONS), fresh_folder(spark, "flows")
    try:
        flows = parked(flowlog.parse(lines), f"{folder}/flows")
        details = flows.groupBy("scenario", "detailed_label").agg(F.count(F.lit(1)).alias("count")).limit(MAX_DETAILS + 1).collect()
        if len(details) > MAX_DETAILS:
            raise ValueError(f"more than {MAX_DETAILS} detailed labels")
        widest = encode.widest(wanted)
        raw = parked(encode.raw_numerics(flows, widest, **(s.window if widest == "behavioral" else {})).select(*[F.col(f"`{c}`") for c in RAW]), f"{folder}/raw")
        encoders = encode.fit_raw(raw.where(~F.col("scenario").isin(*held)), wanted)
        by, rows = {r.dataset: r for r in found}, []
        for name, e in encoders.items():
            if leaked := set(held) & set(e.fitted_scenarios):
                raise ValueError(f"{sorted(leaked)} leaked into the encoder")
            for scenario, got in encode.check(encode.encoded(raw.where(F.col("scenario").isin(*held)), e), e).items():
                if got != {k: by[scenario][k] for k in ("rows", "benign", "malicious")}:
                    raise ValueError(f"{scenario}: encoded rows differ from the profile")
                rows.append((name, scenario, got["rows"], got["benign"], got["malicious"], len(e.feature_names), e.datatype, e.log, len(e.fitted_scenarios), "passed"))
    except BaseException:
        removed(spark, folder)
        raise
    ddl = "representation string, scenario string, rows long, benign long, malicious long, feature_count int, datatype string, log_transform boolean, fitted_scenarios int, leakage_check string"
    told = spark.createDataFrame(sorted(details), "dataset string, detailed_label string, count long")
    return Prepared(prof, split, encoders, spark.createDataFrame(rows, ddl), told, flows, raw, folder)


def _sampled(prepared: Prepared, encoder: encode.Encoder, plan: sampling.Plan, s: Settings) -> DataFrame:
    """The plan's rows, encoded; windows over these alone, or over all rows."""
    flows = prepared.flows.where(F.col("scenario").isin(plan.scenarios))
    if not s.window_before_sample:
        return encode.transform(sampling.sample(flows, plan), encoder, **(s.window if encoder.representation == "behavioral" else {}))
    chosen = sampling.sample(flows.select("scenario", "row_seq", "label"), plan).select("scenario", "row_seq")
    return encode.encoded(prepared.raw.where(F.col("scenario").isin(plan.scenarios)), encoder).join(chosen, ["scenario", "row_seq"], "left_semi")


@dataclass
class Trained:
    model: RandomFeatureClassifier
    plan: sampling.Plan
    threshold: float
    decision_rule: DataFrame
    validation: DataFrame
    test: DataFrame
    summary: DataFrame


def train(lines: DataFrame, prepared: Prepared, s: Settings) -> Trained:
    """Fit on a balanced sample of the training scenarios, calibrate the threshold on the
    validation scenario, evaluate all of the test scenario. What was read back without its
    tables is parsed again from ``lines``."""
    spark = lines.sparkSession
    encoder = prepared.encoders[s.representation]
    if prepared.flows is None:
        flows = flowlog.parse(lines)
        wide = encode.raw_numerics(flows, encoder.representation, encoder.log, **(s.window if encoder.representation == "behavioral" else {}))
        prepared = replace(prepared, flows=flows, raw=wide.select(*[F.col(f"`{c}`") for c in RAW]))
    rows = prepared.split.collect()
    part = {p: [r for r in rows if r.partition == p] for p in ("train", "validation", "test")}
    leaked = {r.dataset for r in part["validation"] + part["test"]} & set(encoder.fitted_scenarios)
    if leaked or any(len(part[p]) != 1 for p in ("validation", "test")) or not part["train"]:
        raise ValueError(f"bad split: leaked {sorted(leaked)}, {', '.join(f'{p} {len(x)}' for p, x in part.items())}")
    plan_of = lambda p, n: sampling.balanced_plan([r.dataset for r in part[p]], [r.benign for r in part[p]], [r.malicious for r in part[p]], n, s.seed)
    plan, totals = plan_of("train", s.target_per_class), {r.partition: r for r in sampling.split_totals(prepared.split).collect()}
    target = min(s.validation_target_per_class, totals["validation"].balanced)
    if target <= 0:
        raise ValueError("the validation scenario must hold both classes")
    clock = [time.perf_counter()]
    took = lambda: clock.append(time.perf_counter()) or round(clock[-1] - clock[-2], 3)
    model = RandomFeatureClassifier(s.hidden, "abs", s.ridge, s.seed).fit(_sampled(prepared, encoder, plan, s), classes=[0, 1], width=len(encoder.feature_names))
    training_seconds = took()
    scored = model.decision(_sampled(prepared, encoder, plan_of("validation", target), s), positive=1).select("decision", F.col("label").cast("int").alias("label"))
    folder = fresh_folder(spark, "decisions")
    try:
        decided = parked(scored, folder)  # the sweep reads them several times
        best = evaluate.optimal_f1_threshold(decided, "decision", "label", 1, minimum_recall=s.minimum_validation_recall, minimum_specificity=s.minimum_validation_specificity)
    finally:
        removed(spark, folder)
    validation_seconds = took()
    test_rows = encode.encoded(prepared.raw.where(F.col("scenario") == part["test"][0].dataset), encoder)
    tested = evaluate.confusion(model.predict_at(test_rows, best["threshold"], positive=1), "label", "predicted").first()
    evaluation_seconds = took()
    if sum(tested) != part["test"][0].rows:
        raise ValueError("the confusion matrix misses rows")
    fixed = spark.createDataFrame([tuple(tested)], "tn long, fp long, fn long, tp long")
    rule = spark.createDataFrame(
        [("malicious", "benign", best["threshold"], "max_f1_subject_to_constraints", s.minimum_validation_recall, s.minimum_validation_specificity, s.validation_scenario, target, best["f1"], best["precision"], best["recall"], best["specificity"])],
        "positive_label string, negative_label string, threshold double, objective string, minimum_validation_recall double, minimum_validation_specificity double, validation_scenario string, validation_sample_per_class long, validation_f1 double, validation_precision double, validation_recall double, validation_specificity double",
    )
    about = {
        "train_scenarios int": len(part["train"]), "validation_scenario string": s.validation_scenario, "test_scenario string": s.test_scenario,
        "scanned_training_rows long": totals["train"].rows, "sampled_training_rows long": sum(plan.selected.values()),
        "sampled_benign long": s.target_per_class, "sampled_malicious long": s.target_per_class,
        "validation_scanned_rows long": totals["validation"].rows, "validation_sampled_rows long": 2 * target, "validation_target_per_class long": target,
        "decision_threshold double": best["threshold"], "minimum_validation_recall double": s.minimum_validation_recall, "minimum_validation_specificity double": s.minimum_validation_specificity,
        "hidden int": s.hidden, "batch_size int": int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")), "feature_count int": len(encoder.feature_names), "ridge double": float(s.ridge), "seed int": s.seed,
        "training_seconds double": training_seconds, "validation_seconds double": validation_seconds, "evaluation_seconds double": evaluation_seconds,
    }
    summary = spark.createDataFrame([tuple(about.values())], ", ".join(about))
    validation = evaluate.metrics(spark.createDataFrame([tuple(int(best[k]) for k in ("tn", "fp", "fn", "tp"))], "tn long, fp long, fn long, tp long"))
    return Trained(model, plan, best["threshold"], rule, validation, evaluate.metrics(fixed), summary)


def run(lines: DataFrame, s: Settings, expected_scenarios: int | None = 23) -> Trained:
    prepared = prepare(lines, s, expected_scenarios, [s.representation])
    try:
        return train(lines, prepared, s)
    finally:
        prepared.close()


def publish(trained: Trained, prepared: Prepared, folder: str) -> None:
    """All small tables as CSV with a header, one file each, and the encoders under ``folder``."""
    spark = trained.summary.sparkSession
    tables = {
        "profile": prepared.profile, "detailed_labels": prepared.details, "scenario_split": prepared.split, "preprocessing_validation": prepared.validation, "training_sampling_plan": trained.plan.table(spark),
        "decision_rule": trained.decision_rule, "training_summary": trained.summary, "validation_metrics": evaluate.long_form(trained.validation), "test_metrics": evaluate.long_form(trained.test),
        "validation_confusion": evaluate.confusion_table(trained.validation), "test_confusion": evaluate.confusion_table(trained.test),
        **{f"features_{r}": e.table(spark) for r, e in prepared.encoders.items()},
    }
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
    for r, e in prepared.encoders.items():
        e.save(f"{folder}/encoders/{r}.json")


def resume(spark: SparkSession, folder: str) -> Prepared:
    """What ``publish`` wrote of a preparation, with the types it had. Columns are found by name."""
    known = profile.scenarios(spark.createDataFrame([], "scenario string, row_seq long, value string, size_bytes long")).schema
    kinds = {f.name: f.dataType for f in known}

    def read(name: str, **more: str) -> DataFrame:
        found = spark.read.option("header", True).csv(f"{folder}/{name}")
        return found.select(*[F.col(f"`{c}`").cast(more.get(c, kinds.get(c, "string"))).alias(c) for c in found.columns])

    checks = {"rows": "long", "feature_count": "int", "log_transform": "boolean", "fitted_scenarios": "int"}
    encoders = {r: encode.Encoder.load(f"{folder}/encoders/{r}.json") for r in flow.REPRESENTATIONS if listed(spark, f"{folder}/encoders", f"{r}.json")}
    split = read("scenario_split").orderBy(flowlog.scenario_order(F.col("dataset")))
    return Prepared(read("profile"), split, encoders, read("preprocessing_validation", **checks), read("detailed_labels", count="long"))
