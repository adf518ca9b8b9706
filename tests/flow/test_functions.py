import os
import subprocess
import sys

import pyspark
import pytest
from pyspark.sql import functions as F

from flowlearn.functions import flow
from flowlearn.operators import encode, profile
from flowlearn.sources import delimited, flowlog, shared


def row(proto="tcp", service="dns", duration="1.0", state="SF", label="-   benign   -", ts="1.0", port="80", history="Dd"):
    return f"{ts},u,10.0.0.1,123,10.0.0.2,{port},{proto},{service},{duration},10,20,{state},-,-,0,{history},1,50,2,70,{label}"


TRAIN = [row(), row("udp", "-", "-", "S0", "-   malicious   DDoS")]
TEST = [row("icmp", "ssh", "1000000", "REJ", "-   malicious   Attack")]


@pytest.fixture
def files(tmp_path):
    for name, rows in (("dataset1.csv", TRAIN), ("dataset23.csv", TEST)):
        (tmp_path / name).write_text("\n".join([flow.HEADER + "\r", *rows]) + "\n")
    return tmp_path


def one(spark, column, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_measures(spark):
    assert one(spark, lambda c: flow.measure(c, False), ["-", "?", "", " ", "-3", "inf", "nan", " 7 ", "1d", "0x10", "1e3", ".5", None, "\t2\t"]) == [None] * 7 + [7.0, None, None, 1000.0, 0.5, None, 2.0]
    assert one(spark, flow.measure, ["0"]) == [0.0]


def test_labels(spark):
    assert one(spark, flow.binary_label, ["-   Malicious   C&C-HeartBeat", "-   benign", "-   BENIGN   -", "\t-\tbenign\t x y ", "(empty)   malicious   a", None, ""]) == [1, None, None, 0, 1, None, None]
    assert one(spark, lambda c: F.get(flow.label_parts(c), 2), ["-  benign   a b  "]) == ["a b"]


def test_ports_and_flags(spark):
    assert one(spark, flow.port_bucket, [" 443 ", "444", "8883"]) == ["443", flow.OTHER_PORT, "8883"]
    flags = spark.createDataFrame([("ShADadFf",)], "h string").select(*[c.alias(n) for n, c in flow.flag_counts(F.col("h")).items()]).first()
    assert tuple(flags) == (1, 1, 2, 2, 2, 0)


def test_scan_and_parse(spark, files):
    paths = flowlog.list_scenarios(spark, f"file://{files}", expected=2)
    assert [p.rsplit("/", 1)[1] for p in paths] == ["dataset1.csv", "dataset23.csv"]
    lines = flowlog.scan(spark, paths)
    assert sorted((r.scenario, r.row_seq) for r in lines.collect()) == [("dataset1.csv", 1), ("dataset1.csv", 2), ("dataset23.csv", 1)]
    assert sorted((r.proto, r.label, r["id.resp_p"]) for r in flowlog.parse(lines).collect()) == [("icmp", 1, "80"), ("tcp", 0, "80"), ("udp", 1, "80")]
    with pytest.raises(ValueError):
        flowlog.list_scenarios(spark, f"file://{files}", expected=23)


def test_row_numbers_across_splits(spark, tmp_path):
    (tmp_path / "dataset7.csv").write_text("\n".join([flow.HEADER, *(row(ts=str(i)) for i in range(1, 3001))]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = flowlog.scan(spark, f"file://{tmp_path}/dataset7.csv")
        assert lines.rdd.getNumPartitions() >= 1 and all(int(r.value.split(",")[0]) == r.row_seq for r in lines.collect())
        assert lines.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_bad_files(spark, tmp_path):
    (tmp_path / "dataset1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "dataset2.csv").write_text("")
    for name in ("dataset1.csv", "dataset2.csv", "dataset3.csv"):
        with pytest.raises(ValueError):
            flowlog.check_headers(spark, [f"file://{tmp_path}/{name}"])
    with pytest.raises(Exception, match="unexpected header"):
        flowlog.scan(spark, f"file://{tmp_path}/dataset1.csv").collect()


def test_malformed_lines(spark):
    for bad in (TRAIN[0] + ",x", TRAIN[0].rsplit(",", 1)[0], row(label="-   BENIGN   -")):
        lines = spark.createDataFrame([("d", 1, TRAIN[0]), ("d", 2, bad)], "scenario string, row_seq long, value string")
        with pytest.raises(Exception, match="invalid"):
            flowlog.parse(lines).collect()
        assert [r.malformed for r in flowlog.parse(lines, strict=False).orderBy("row_seq").collect()] == [False, True]


def test_profile(spark):
    rows = [*TRAIN, row(duration="?", label="-   Unknown   x"), row(duration=" "), row(duration="abc"), row(duration="-5"), "1,2,3", row(duration="")]
    lines = spark.createDataFrame([("d", i, v) for i, v in enumerate(rows, 1)], "scenario string, row_seq long, value string")
    p = profile.scenarios(lines).first()
    assert (p.rows, p.benign, p.malicious, p.unknown_label, p.label_parse_errors) == (8, 5, 1, 1, 1)
    assert (p.duration_dash, p.duration_question, p.duration_empty, p.duration_missing, p.duration_other_invalid) == (1, 1, 1, 0, 1)
    assert (p.proto_values, p.service_values, p.detailed_label_classes) == ("tcp|udp", "-|dns", 3)
    assert {(r.detailed_label, r.n) for r in profile.detailed_labels(lines).collect()} == {("-", 5), ("DDoS", 1), ("x", 1)}


def test_encoder_without_leaks(spark, files, tmp_path):
    flows = flowlog.parse(flowlog.scan(spark, [f"file://{files}/dataset1.csv", f"file://{files}/dataset23.csv"]))
    train, test = flows.where("scenario = 'dataset1.csv'"), flows.where("scenario = 'dataset23.csv'")
    import math

    e = encode.fit(train)
    assert e.fitted_scenarios == ["dataset1.csv"] and e.valid_counts[0] == 1 and math.isclose(e.means[0], math.log1p(1)) and set(e.scales) == {1.0}
    assert e.vocabularies == [["tcp", "udp"], ["-", "dns"], ["S0", "SF"]] and len(e.feature_names) == 23
    out = encode.transform(test, e)
    f = dict(zip(e.feature_names, out.first().features))
    assert math.isclose(f["duration"], 13.1223643774, rel_tol=1e-6)
    assert all(f[f"{c}={flow.UNKNOWN}"] == 1 for c in flow.CATEGORIES)
    assert encode.check(out, e) == {"dataset23.csv": {"rows": 1, "benign": 0, "malicious": 1}}
    back = encode.Encoder.load(e.save(str(tmp_path / "x" / "encoder.json")))
    assert back == e and back.datatype == "float"
    every = encode.fit_all(train)
    assert [len(every[r].feature_names) for r in ("baseline", "light", "behavioral")] == [23, 27, 47]
    b = every["behavioral"]
    assert math.isclose(b.means[b.numerics.index("win_flow_count")], 0.3465735903, rel_tol=1e-9) and math.isclose(b.scales[b.numerics.index("win_flow_count")], 0.3465735903, rel_tol=1e-9)
    assert math.isclose(b.means[b.numerics.index("h_data")], math.log1p(2)) and every["baseline"] == e
    for name, enc in every.items():
        encode.check(encode.transform(test, enc), enc)
        assert enc.table(spark).count() == len(enc.feature_names), name


def test_encoder_files(tmp_path, spark):
    import json

    with pytest.raises(ValueError, match="does not exist"):
        encode.Encoder.load(str(tmp_path / "none.json"))
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError, match="incompatible"):
        encode.Encoder.load(str(tmp_path / "bad.json"))
    old = {"numerics": list("abcdefg"), "means": [0] * 7, "scales": [1] * 7, "valid_counts": [1] * 7, "categoricals": [], "vocabularies": []}
    (tmp_path / "old.json").write_text(json.dumps(old))
    assert encode.Encoder.load(str(tmp_path / "old.json")).representation == "baseline"
    empty = spark.createDataFrame([], "scenario string, row_seq long, value string")
    with pytest.raises(ValueError, match="no valid"):
        encode.fit(flowlog.parse(empty))
    with pytest.raises(ValueError, match="unknown representation"):
        encode.raw_numerics(flowlog.parse(empty), "none")


def test_load_dataset(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text("f1,f2,label\n1.0,2.0, benign \n3.0,4.0,malware\n")
    for target in ("label", "last", 3):
        df, features, t = delimited.load_dataset(spark, str(p), target)
        assert sorted(tuple(r) for r in df.collect()) == [(1.0, 2.0, "benign"), (3.0, 4.0, "malware")] and features == ["f1", "f2"] and t == "label"
    for how, error in (({"target": "no"}, ValueError), ({"target": 9}, IndexError), ({"target": "label", "header": False}, ValueError), ({"target": 1}, ValueError), ({"target": 1.5}, ValueError)):
        with pytest.raises(error):
            delimited.load_dataset(spark, str(p), **how)
    (tmp_path / "nan.csv").write_text("a,b\ninf,x\n")
    (tmp_path / "one.csv").write_text("a\n1\n")
    (tmp_path / "none.csv").write_text("a,b\n")
    for name in ("nan.csv", "one.csv", "none.csv", "absent.csv"):
        with pytest.raises(ValueError):
            delimited.load_dataset(spark, str(tmp_path / name))
    assert delimited.inferred_schema(spark, str(p)) == (["f1", "f2", "label"], "f1::double;f2::double;label::string")


def test_scan_shuffles_no_text(spark, tmp_path):
    """Line numbers come from a scalar subquery: the plan of the lines has no exchange or join."""
    for k in (1, 2, 3):
        (tmp_path / f"dataset{k}.csv").write_text(flow.HEADER + "\n" + "".join(f"{i},{TRAIN[0].split(',', 1)[1]}\n" for i in range(1, 41)))
    lines = flowlog.scan(spark, flowlog.list_scenarios(spark, f"file://{tmp_path}"))
    plan = lines._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert "Exchange" not in plan and "Join" not in plan
    assert all(int(r.value.split(",")[0]) == r.row_seq for r in lines.collect()) and lines.count() == 120


def test_written_scenarios_and_rejects(spark, tmp_path):
    rows = [("dataset2.csv", i, TRAIN[i % 2]) for i in range(1, 6)] + [("dataset10.csv", 1, TRAIN[0])]
    lines = spark.createDataFrame(rows, "scenario string, row_seq long, value string")
    paths = flowlog.write_scenarios(lines, f"file://{tmp_path}/out")
    assert [p.rsplit("/", 1)[1] for p in paths] == ["dataset2.csv", "dataset10.csv"]
    assert sorted((r.scenario, r.row_seq, r.value) for r in flowlog.scan(spark, paths).collect()) == sorted(rows)
    p = {r.scenario: r for r in profile.files(spark, paths).collect()}["dataset2.csv"]
    assert (p.columns, p.schema_matches, p.rows) == (21, True, 5) and p.size_bytes == (tmp_path / "out/dataset2.csv").stat().st_size and p.elapsed_seconds > 0 and "uid::" in p.inferred_types
    bad = spark.createDataFrame([("d", 1, TRAIN[0]), ("d", 2, TRAIN[0] + ",x"), ("d", 3, row(label="-   BENIGN   -"))], "scenario string, row_seq long, value string")
    assert [(r.row_seq, r.reason) for r in flowlog.rejects(bad).orderBy("row_seq").collect()] == [(2, "invalid row structure"), (3, "invalid binary label")]


ON_TWO_EXECUTORS = """
import sys
from pyspark.sql import SparkSession
from flowlearn.sources import delimited
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.driver.host", "127.0.0.1").config("spark.ui.enabled", "false").config("spark.sql.files.maxPartitionBytes", "1k").config("spark.sql.files.openCostInBytes", "1k").getOrCreate()
for path in sys.argv[1:]:
    assert delimited.inferred_schema(spark, path, 3) == (["n", "word"], "n::int;word::string"), path
spark.stop()
"""


def test_first_rows_of_files_of_many_splits(tmp_path):
    """Splits arrive in any order from executors: the header and the types are still those of the first rows."""
    paths = [tmp_path / f"{k}.csv" for k in range(10)]
    for path in paths:
        path.write_text("n,word\n1,a\n2,b\n3,c\n" + "x,y,z\n" * 2000)
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"PYTHONPATH": here, "SPARK_HOME": os.path.dirname(pyspark.__file__), "SPARK_WORKER_DIR": str(tmp_path / "work"), "SPARK_LOCAL_IP": "127.0.0.1"}
    subprocess.run([sys.executable, "-c", ON_TWO_EXECUTORS, *map(str, paths)], check=True, timeout=180, env=env, cwd=tmp_path)


def test_csv_files_of_a_folder(spark, tmp_path):
    (tmp_path / "b.CSV").write_text("x,y\n1,a\n2,b\n,c\n")
    (tmp_path / "c.csv").write_text("x\n1\n")
    (tmp_path / "a.txt").write_text("x\n")
    assert [p.rsplit("/", 1)[1] for p in delimited.list_csv(spark, f"file://{tmp_path}")] == ["b.CSV", "c.csv"]
    path, about, head = delimited.inspect(spark, f"file://{tmp_path}", 2)
    x, y = sorted(about.collect(), key=lambda r: r.column)
    assert path.endswith("b.CSV") and head.count() == 2 and (x.nulls, x["mean"], x["min"], x["max"]) == (1, 1.5, 1, 2) and y["mean"] is None
    with pytest.raises(ValueError):
        delimited.list_csv(spark, f"file://{tmp_path}/none")


def test_encoder_versions(spark, tmp_path):
    import json

    (tmp_path / "new.json").write_text(json.dumps({"format_version": 99, "numerics": []}))
    with pytest.raises(ValueError, match="incompatible"):
        encode.Encoder.load(str(tmp_path / "new.json"))
    assert encode.Encoder.load(encode.Encoder("baseline", [], [], [], [], [], []).save(f"file://{tmp_path}/a/b.json")).representation == "baseline"


def test_vocabularies_are_bounded(monkeypatch, spark, files):
    monkeypatch.setattr(encode, "MAX_VOCABULARY", 1)
    with pytest.raises(ValueError, match="more than 1 values"):
        encode.fit(flowlog.parse(flowlog.scan(spark, [f"file://{files}/dataset1.csv"])))


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)
