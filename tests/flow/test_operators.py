import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlearn.operators import classifier, encode, evaluate, sampling, scaling
from flowlearn.operators.windows import host_windows
from flowlearn.plans import experiments, pipeline, queries
from flowlearn.sources import shared
from flowlearn.streaming import host_windows as streamed

STATS = ["win_flow_count", "win_unique_resp_p", "win_unique_resp_h", "win_same_port_ratio"]


def windows(spark, rows, **how):
    df = spark.createDataFrame([("s", "h0", i, float(t), h, str(p)) for i, (t, h, p) in enumerate(rows)], "scenario string, orig_h string, row_seq long, ts double, resp_h string, resp_p string")
    return [tuple(r[c] for c in STATS) for r in host_windows(df, **how).orderBy("row_seq").collect()]


def fold(rows, seconds=60.0, history=50):
    """The same by hand: a list, trimmed at its front."""
    kept, out = [], []
    for t, h, p in rows:
        while kept and kept[0][0] < t - seconds:
            kept.pop(0)
        del kept[: max(0, len(kept) - history)]
        n = len(kept)
        out.append((float(n), float(len({x[2] for x in kept})), float(len({x[1] for x in kept})), sum(x[2] == p for x in kept) / n if n else 0.0))
        kept.append((t, h, p))
    return out


@pytest.mark.parametrize("mode", ["frame", "exact", "auto"])
def test_window_goldens(spark, mode):
    assert windows(spark, [(0, "h", 80), (10, "h", 80), (60, "h", 22), (61, "h", 80)], mode=mode) == [(0, 0, 0, 0), (1, 1, 1, 1), (2, 1, 1, 0), (2, 2, 1, 0.5)]
    assert windows(spark, [(5, "h", 80)] * 60, mode=mode)[-1] == (50, 1, 1, 1)


def test_time_running_backwards(spark):
    rows = [(100, "h", 80), (0, "h", 80), (101, "h", 80)]
    assert windows(spark, rows, mode="exact")[-1][0] == 2 == windows(spark, rows, mode="auto")[-1][0]
    assert windows(spark, rows, mode="frame")[-1][0] == 1
    rng = random.Random(1)
    rows = [(i + rng.uniform(-40, 40), rng.choice("ab"), rng.choice("123")) for i in range(400)]
    assert windows(spark, rows, mode="exact", history=7) == fold(rows, history=7)
    with pytest.raises(ValueError):
        windows(spark, rows, mode="none")


def test_streaming_windows(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice(["h1", "h2"]), i + rng.uniform(-30, 30), rng.choice("ab"), rng.choice("123")) for i in range(200)]
    schema = "row_seq long, orig_h string, ts double, resp_h string, resp_p string"
    for k in range(4):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").withColumn("scenario", F.lit("s"))
    q = streamed.host_windows(source).writeStream.format("memory").queryName("host_stream").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {r.row_seq: tuple(r[c] for c in STATS) for r in spark.table("host_stream").collect()}
    for h in ("h1", "h2"):
        own = [r for r in rows if r[1] == h]
        assert [got[r[0]] for r in own] == fold([r[2:] for r in own])


@pytest.mark.parametrize("capacities,target,want", [([10, 10, 10, 1], 9, [4, 2, 2, 1]), ([5, 0, 100, 30], 60, [5, 0, 28, 27]), ([3, 3, 3], 2, [1, 1, 0]), ([0, 7], 7, [0, 7]), ([1, 1], 1, [1, 0]), ([], 0, [])])
def test_quotas(capacities, target, want):
    assert sampling.equalized_quotas(capacities, target) == want


def test_quota_limits():
    rng = random.Random(4)
    for _ in range(300):
        c = [rng.randrange(0, 40) for _ in range(rng.randrange(1, 9))]
        t = rng.randrange(0, sum(c) + 1)
        q = sampling.equalized_quotas(c, t)
        assert sum(q) == t and all(0 <= x <= y for x, y in zip(q, c))
    for bad in (-1, 5):
        with pytest.raises(ValueError):
            sampling.equalized_quotas([1, 3], bad)
    for args in ((["a"], [1, 2], [1]), (["a", "a"], [1, 1], [1, 1]), (["a"], [-1], [1])):
        with pytest.raises(ValueError):
            sampling.balanced_plan(*args, target_per_class=1)
    with pytest.raises(ValueError):
        sampling.balanced_plan(["a"], [1], [1], 0)


def test_exact_sample(spark):
    rows = [("a", i, i % 3 == 0) for i in range(3000)] + [("b", i, i % 2 == 0) for i in range(50)]
    flows = spark.createDataFrame([(s, i, int(y)) for s, i, y in rows], "scenario string, row_seq long, label byte").repartition(7)
    counts = [[sum(r[0] == s and r[2] == y for r in rows) for s in "ab"] for y in (False, True)]
    plan = sampling.balanced_plan(["a", "b"], *counts, 400)
    got = sampling.sample(flows, plan)
    n = {(r.scenario, r.label): r["count"] for r in got.groupBy("scenario", "label").count().collect()}
    assert n == plan.selected and got.distinct().count() == 800
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in sampling.sample(flows.repartition(2), plan).collect()}
    wrong = sampling.balanced_plan(["a", "b"], [counts[0][0] + 1, counts[0][1]], counts[1], 10)
    with pytest.raises(ValueError, match="the plan counts"):
        sampling.sample(flows, wrong)


def test_split(spark):
    df = spark.createDataFrame([(i,) for i in range(25)], "id long")
    split = sampling.train_test_split(df, "id", 0.1)
    assert split.where("is_test").count() == 2 and split.count() == 25
    assert {r.id for r in split.where("is_test").collect()} == {r.id for r in sampling.train_test_split(df.repartition(3), "id", 0.1).where("is_test").collect()}
    assert [r.id for r in sampling.train_test_split(df, "id", 0.2, shuffle=False).where("is_test").orderBy("id").collect()] == [0, 1, 2, 3, 4]
    for bad, size in ((df, 0), (df, 1), (df.limit(1), 0.5)):
        with pytest.raises(ValueError):
            sampling.train_test_split(bad, "id", size)


def test_scaling(spark):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(1, 5)], "c1 double, c2 double")
    z = scaling.fit_scaling(df, ["c1", "c2"])
    assert math.isclose(z.offset[0], 2.5) and math.isclose(z.scale[0], math.sqrt(1.25)) and z.scale[1] == 1
    got = scaling.apply_scaling(df, z).collect()
    assert abs(sum(r.c1 for r in got)) < 1e-12 and all(r.c2 == 0 for r in got)
    m = scaling.apply_scaling(df, scaling.fit_scaling(df, ["c1", "c2"], "minmax")).orderBy("c1").collect()
    assert np.allclose([r.c1 for r in m], [0, 1 / 3, 2 / 3, 1]) and all(r.c2 == 0 for r in m)
    for how in (lambda: scaling.fit_scaling(df, ["c1"], "other"), lambda: scaling.fit_scaling(df.limit(0), ["c1"]), lambda: scaling.apply_scaling(df, z, ["c1"]), lambda: scaling.fit_scaling(df.withColumn("c1", F.lit(float("nan"))), ["c1"])):
        with pytest.raises(ValueError):
            how()


def test_labels(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b")], "i int, y string")
    got, classes = scaling.encode_labels(df, "y", "i")
    assert classes == ["b", "a"] and [r.one_hot for r in got.orderBy("i").collect()] == [[1, 0], [0, 1], [1, 0]]
    for classes in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            scaling.encode_labels(df, "y", "i", classes)
    with pytest.raises(Exception, match="unknown label"):
        scaling.encode_labels(df, "y", "i", ["a"])[0].collect()
    with pytest.raises(ValueError):
        scaling.classes_of(df.limit(0), "y", "i")


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "t int, p int")
    m = evaluate.scores(df, "t", "p")
    assert m["accuracy"] == 0.75 and math.isclose(m["precision"], 2 / 3) and m["recall"] == 1 and math.isclose(m["f1"], 0.8)
    row = evaluate.metrics(evaluate.confusion(df, "t", "p")).first()
    assert (row.tn, row.fp, row.fn, row.tp) == (1, 1, 0, 2) and row.specificity == 0.5
    assert {r.metric: r.value for r in evaluate.long_form(evaluate.metrics(evaluate.confusion(df, "t", "p"))).collect()}["recall"] == 1
    abc = spark.createDataFrame([(i, x, x) for i, x in enumerate("abc")], "i int, t string, p string")
    assert evaluate.scores(abc, "t", "p", order="i")["precision"] == 1
    for bad in (lambda: evaluate.scores(df.limit(0), "t", "p"), lambda: evaluate.scores(df, "t", "p", positive=7)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="empty confusion"):
        evaluate.metrics(evaluate.confusion(df.limit(0), "t", "p")).collect()


@pytest.mark.parametrize("scores,y,minima,want", [([0.8, 0.4, 0.3, 0.1], [1, 0, 1, 0], {}, {"threshold": 0.3, "f1": 0.8, "tp": 2, "fp": 1, "specificity": 0.5}), ([0.8, 0.4, 0.3, 0.1], [1, 0, 1, 0], {"minimum_specificity": 0.75}, {"threshold": 0.8, "specificity": 1.0, "tp": 1}), ([0.9, 0.8, 0.7, 0.6], [1, 0, 0, 1], {"minimum_recall": 0.75}, {"threshold": 0.6, "recall": 1.0, "fp": 2})])
def test_threshold_goldens(spark, scores, y, minima, want):
    got = evaluate.optimal_f1_threshold(spark.createDataFrame(list(zip(scores, y)), "s double, y int"), "s", "y", **minima)
    assert {k: got[k] for k in want} == want


def test_sweep_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(round(rng.gauss(y, 1), 1), y) for y in (rng.randrange(2) for _ in range(900))]
    got = {r.threshold: (r.tn, r.fp, r.fn, r.tp) for r in evaluate.sweep(spark.createDataFrame(rows, "s double, y int"), "s", "y").collect()}
    assert got == {t: tuple(sum((s >= t, y) == c for s, y in rows) for c in ((False, 0), (True, 0), (False, 1), (True, 1))) for t in {s for s, _ in rows}}


def test_threshold_errors(spark):
    df = spark.createDataFrame([(0.5, 1), (0.4, 0)], "s double, y int")
    for bad, how in ((df.limit(0), {}), (df.where("y = 0"), {}), (df.where("y = 1"), {}), (df.withColumn("s", F.lit(float("nan"))), {}), (df, {"minimum_recall": 2}), (df.withColumn("s", F.lit(1.0)), {"minimum_specificity": 0.5})):
        with pytest.raises(ValueError):
            evaluate.optimal_f1_threshold(bad, "s", "y", **how)


POINTS = [([-2.0, -1.0], "benign"), ([-1.5, -1.2], "benign"), ([-1.0, -2.0], "benign"), ([1.0, 1.5], "malware"), ([1.5, 1.0], "malware"), ([2.0, 2.0], "malware")]


def test_classifier(spark):
    df = spark.createDataFrame(POINTS, "x array<double>, y string")
    m = classifier.RandomFeatureClassifier(20, seed=7)
    with pytest.raises(ValueError, match="fit the model"):
        m.scores(df, "x")
    m.fit(df, "x", "y")
    assert [r.predicted for r in m.predict(df, "x").collect()] == [y for _, y in POINTS]
    assert all(len(r.scores) == 2 for r in m.scores(df, "x").collect())
    other = classifier.RandomFeatureClassifier(20, seed=7).fit(df.repartition(3), "x", "y", classes=["benign", "malware"])
    assert np.array_equal(m.weights, other.weights) and np.allclose(m.readout, other.readout)
    assert [r.predicted for r in m.predict_at(df, 0.0, "x", "malware").collect()] == [y for _, y in POINTS]
    # The same as a direct solution.
    x = np.array([p for p, _ in POINTS])
    h = np.abs(x @ m.weights + m.biases)
    t = np.eye(2)[[0, 0, 0, 1, 1, 1]]
    assert np.allclose(m.readout, np.linalg.solve(h.T @ h + 0.01 * np.eye(20), h.T @ t))
    with pytest.raises(ValueError):
        m.predict_at(df, float("inf"), "x")
    with pytest.raises(ValueError):
        m.decision(df, "x", "nobody")


def test_classifier_files(spark, tmp_path):
    df = spark.createDataFrame(POINTS, "x array<double>, y string")
    m = classifier.RandomFeatureClassifier(20, seed=7).fit(df, "x", "y")
    back = classifier.RandomFeatureClassifier.load(m.save(str(tmp_path / "a" / "model.npz")))
    assert back.classes == m.classes and [r.predicted for r in back.predict(df, "x").collect()] == [y for _, y in POINTS]
    with pytest.raises(ValueError):
        classifier.RandomFeatureClassifier.load(str(tmp_path / "none.npz"))
    m.activation = lambda x: x
    with pytest.raises(ValueError):
        m.save(str(tmp_path / "b.npz"))


def test_classifier_errors(spark):
    df = spark.createDataFrame(POINTS, "x array<double>, y string")
    for bad in ({"hidden": 0}, {"ridge": -1}):
        with pytest.raises(ValueError):
            classifier.RandomFeatureClassifier(**bad)
    new = lambda: classifier.RandomFeatureClassifier(4)
    for how in (lambda: new().fit(df.limit(0), "x", "y"), lambda: new().fit(df, "x", "y", classes=["benign"]), lambda: new().fit(df, "x", "y", classes=["benign", "benign"]), lambda: new().fit(df, "x", "y", classes=["benign", "malware", "other"])):
        with pytest.raises(ValueError):
            how()
    with pytest.raises(Exception, match="none of the classes"):
        new().fit(df, "x", "y", classes=["benign", "other"])
    with pytest.raises(Exception, match="must have 2 values"):
        new().fit(df.where("y = 'benign'").unionByName(spark.createDataFrame([([1.0], "malware")], "x array<double>, y string")), "x", "y")
    tanh = classifier.RandomFeatureClassifier(8, "tanh").fit(df, "x", "y")
    assert [r.predicted for r in tanh.predict(df, "x").collect()] == [y for _, y in POINTS]


def test_run(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    lines = queries._lines(spark, d).drop("event_id").persist()
    s = queries.settings_for(spark, d)
    prepared = pipeline.prepare(lines, s, representations=["behavioral"])
    done = pipeline.train(lines, prepared, s)
    test = done.test.first()
    assert test.tn + test.fp + test.fn + test.tp == lines.where("scenario = 'dataset23.csv'").count()
    pipeline.publish(done, prepared, f"file://{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out/scenario_split").count() == 23
    with pytest.raises(ValueError, match="expected 5"):
        pipeline.prepare(lines, s, 5)
    lines.unpersist()


def test_experiments(spark, tmp_path):
    found = experiments.validate(spark)
    assert found["accuracy"] > 0.95 and found["f1"] > 0.95
    (tmp_path / "d.csv").write_text("f1,f2,kind\n" + "".join(f"{i % 2 * 4 + i / 100},{i % 2 * 3 - i / 90},{'bad' if i % 2 else 'good'}\n" for i in range(60)))
    found = experiments.dataset_experiment(spark, str(tmp_path / "d.csv"), "kind", f"file://{tmp_path}/out", hidden=20)
    assert found["accuracy"] == 1 and spark.read.csv(f"file://{tmp_path}/out").count() == 4


def test_settings(monkeypatch):
    monkeypatch.setenv("FLOWLEARN_HIDDEN", "99")
    monkeypatch.setenv("FLOWLEARN_MINIMUM_VALIDATION_RECALL", "0.5")
    monkeypatch.setenv("FLOWLEARN_WINDOW_BEFORE_SAMPLE", "true")
    s = pipeline.Settings.from_env()
    assert (s.hidden, s.minimum_validation_recall, s.window_before_sample, s.seed) == (99, 0.5, True, 42)


def one_host(spark, rows, parts=5):
    df = spark.createDataFrame([("s", "h0", i, float(t), h, p) for i, (t, h, p) in enumerate(rows, 1)], "scenario string, orig_h string, row_seq long, ts double, resp_h string, resp_p string")
    return df.repartition(parts)


@pytest.mark.parametrize("mode", ["frame", "exact", "auto"])
def test_one_host_with_all_rows_is_cut_into_ranges(spark, mode):
    rng, t, rows = random.Random(8), 0.0, []
    for _ in range(3000):
        t += rng.choice([0, 0, 1, 5, 200])
        rows.append((t, rng.choice("abc"), rng.choice("1234")))
    got = host_windows(one_host(spark, rows), mode=mode, range_rows=130)
    assert [tuple(r[c] for c in STATS) for r in got.orderBy("row_seq").collect()] == fold(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "range#" in plan and got.columns == ["scenario", "orig_h", "row_seq", "ts", "resp_h", "resp_p", *STATS]


def test_ranges_keep_hosts_whose_time_runs_backwards(spark):
    rng = random.Random(9)
    rows = [(i + rng.uniform(-90, 90), rng.choice("ab"), rng.choice("123")) for i in range(900)]
    got = host_windows(one_host(spark, rows), history=7, range_rows=50)
    assert [tuple(r[c] for c in STATS) for r in got.orderBy("row_seq").collect()] == fold(rows, history=7)
    # Backwards only across the seam of two ranges, and sparse hosts that skip ranges.
    rows = [(float(i), "a", "1") for i in range(100)] + [(10.0, "a", "1")] + [(200.0 + i, "a", "2") for i in range(99)]
    assert [tuple(r[c] for c in STATS) for r in host_windows(one_host(spark, rows), range_rows=100).orderBy("row_seq").collect()] == fold(rows)
    sparse = one_host(spark, rows[:100]).withColumn("row_seq", F.col("row_seq") * 37)
    assert [tuple(r[c] for c in STATS) for r in host_windows(sparse, range_rows=50).orderBy("row_seq").collect()] == fold(rows[:100])


def test_split_deals_rows_not_ids(spark):
    df = spark.createDataFrame([(i // 4, f"r{i}") for i in range(20)] + [(9, "same")] * 5, "id long, v string")
    for shuffle in (True, False):
        got = sampling.train_test_split(df, "id", 0.2, shuffle=shuffle)
        assert got.count() == 25 and got.where("is_test").count() == 5
        assert sorted(r.v for r in got.collect()) == sorted(r.v for r in df.collect())
        assert {(r.id, r.v) for r in got.where("is_test").collect()} == {(r.id, r.v) for r in sampling.train_test_split(df.repartition(3), "id", 0.2, shuffle=shuffle).where("is_test").collect()}


def test_bins_follow_the_rows(monkeypatch, spark):
    assert [sampling._digits(n) for n in (1, 10_000, 10_001, 10**12)] == [1, 1, 1, 7]
    monkeypatch.setattr(sampling, "BIN_ROWS", 3)
    test_exact_sample(spark)
    test_split(spark)


def test_plan_order(spark):
    plan = sampling.balanced_plan(["dataset2.csv", "dataset10.csv"], [1, 1], [1, 1], 1)
    plan.check_order(["hdfs:///x/dataset2.csv", "hdfs:///x/dataset10.csv"])
    with pytest.raises(ValueError, match="the plan is for"):
        plan.check_order(["hdfs:///x/dataset10.csv", "hdfs:///x/dataset2.csv"])


def test_batches(spark):
    rows = [(s, i, [float(i), 1.0], i % 2) for s, n in (("a", 23), ("b", 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "scenario string, row_seq long, features array<float>, label byte").repartition(4)
    told = encode.each_batch(df, lambda x, y, s: {"s": [s], "n": [len(x)], "sum": [float(x[:, 0].sum())], "ones": [int(y.sum())]}, "s string, n long, sum double, ones long", 4).collect()
    assert all(r.n <= 4 for r in told)
    for s, n in (("a", 23), ("b", 5)):
        own = [r for r in told if r.s == s]
        assert (sum(r.n for r in own), sum(r["sum"] for r in own), sum(r.ones for r in own)) == (n, n * (n - 1) / 2, n // 2)
    assert encode.each_batch(df, lambda x, y, s: None, "s string").count() == 0
    with pytest.raises(ValueError):
        encode.each_batch(df, len, "s string", 0)


def test_resumed_run(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    lines = queries._lines(spark, d).drop("event_id").persist()
    s = queries.settings_for(spark, d)
    s.window_before_sample = True
    prepared = pipeline.prepare(lines, s, representations=["behavioral"])
    done = pipeline.train(lines, prepared, s)
    pipeline.publish(done, prepared, f"file://{tmp_path}/out")
    assert len(done.summary.columns) == 21 and done.summary.first().validation_sampled_rows == 2 * done.summary.first().validation_target_per_class
    folder = prepared.folder
    prepared.close()
    assert not shared.listed(spark, folder, "*") and prepared.flows is None
    again = pipeline.resume(spark, f"file://{tmp_path}/out")
    assert again.split.collect() == prepared.split.collect() and again.encoders == prepared.encoders
    assert sorted(again.profile.collect()) == sorted(prepared.profile.collect()) and again.profile.dtypes == prepared.profile.dtypes
    assert sorted(again.details.collect()) == sorted(prepared.details.collect()) and again.details.count() > 23
    other = pipeline.train(lines, again, s)
    assert other.test.collect() == done.test.collect() and math.isclose(other.threshold, done.threshold, rel_tol=1e-6)  # sums of doubles differ by their order
    lines.unpersist()


def test_element_types(spark, tmp_path):
    df = spark.createDataFrame(POINTS, "x array<double>, y string")
    m = classifier.RandomFeatureClassifier(20, seed=7, element="float").fit(df, "x", "y")
    assert m.weights.dtype == m.readout.dtype == np.float32
    assert [r.predicted for r in m.predict(df, "x").collect()] == [y for _, y in POINTS]
    assert classifier.RandomFeatureClassifier.load(m.save(f"file://{tmp_path}/m.npz")).weights.dtype == np.float32
    with pytest.raises(ValueError):
        classifier.RandomFeatureClassifier(4, element="half")
