"""Registered queries of the flow-log operators, and the same in SQL.

The test tables hold no flow logs, so lines are made of ``events``; scenarios are days.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import flow
from ..operators import classifier, encode, evaluate, profile, sampling, scaling
from ..operators.windows import host_windows
from ..sources import delimited, flowlog
from ..sources.shared import fresh_folder
from . import pipeline

DAY = 86_400.0
HELD = ("dataset12.csv", "dataset23.csv")
H = 4
WEIGHTS = [[((31 * i + 17 * j) % 7 - 3) / 10 for j in range(64)] for i in range(H)]
BIASES = [(i % 3 - 1) / 10 for i in range(H)]
READOUT = [[0.5, -0.25, 0.125, -0.5], [-0.125, 0.25, -0.5, 0.375]]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return flowlog.from_events(_t(spark, d, "events"))


def _flows(spark: SparkSession, d: str) -> DataFrame:
    return flowlog.parse(_lines(spark, d))


def _train(df: DataFrame) -> DataFrame:
    return df.where(~F.col("scenario").isin(*HELD))


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


# In SQL: the fields that the lines spell.
FLOWS = r"""WITH f AS (
  SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY event_id) AS row_seq FROM (
    SELECT event_id, 'dataset' || least(day(ts), 23) || '.csv' AS scenario, epoch_us(ts) / 1e6 AS ts, CAST(user_id AS VARCHAR) AS orig_h,
      CAST(k % 10 AS VARCHAR) AS resp_h, CAST(k AS VARCHAR) AS resp_p, event_type AS proto,
      CASE WHEN event_id % 5 = 0 THEN '-' ELSE 'svc' || (k % 4) END AS service,
      CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 THEN NULL ELSE value END AS duration,
      CAST(event_id % 1000 AS DOUBLE) AS orig_bytes, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id % 77 AS DOUBLE) END AS resp_bytes,
      CASE WHEN event_id % 2 = 0 THEN 'SF' ELSE 'S0' END AS conn_state, CAST(event_id % 3 AS DOUBLE) AS missed_bytes,
      substr('ShADadFfRrHC', 1, CAST(event_id % 12 + 1 AS INT)) AS history, CAST(event_id % 10 AS DOUBLE) AS orig_pkts,
      CAST(event_id % 100 AS DOUBLE) AS orig_ip_bytes, CAST(event_id % 8 AS DOUBLE) AS resp_pkts, CAST(event_id % 50 AS DOUBLE) AS resp_ip_bytes,
      CAST(event_type = 'error' AS INT) AS label, CASE WHEN event_type = 'error' THEN 'Attack' || (event_id % 3) ELSE '-' END AS detailed_label,
      CASE WHEN k IN (21, 22, 23, 53, 80, 123, 443, 1883, 6667, 8080, 8883) THEN CAST(k AS VARCHAR) ELSE '__OTHER_PORT__' END AS port
    FROM (SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS INT) AS k FROM events)))
"""
NUM = flow.BASE_NUMERICS
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(FLOWS + f"""SELECT scenario, row_seq, round(ts, 6) AS ts, orig_h, resp_h, resp_p, port, service, history, label, detailed_label,
  {', '.join(f'round({n}, 6) AS {n}' for n in [*NUM, 'missed_bytes'])} FROM f""")
def parse_flow_lines(spark, d):
    return _parsed(_flows(spark, d))


def _parsed(p: DataFrame) -> DataFrame:
    return p.select("scenario", "row_seq", _r("ts"), "orig_h", "resp_h", "resp_p", F.col("`id.resp_p`").alias("port"), "service", "history", F.col("label").cast("int").alias("label"), "detailed_label", *[F.round(flow.measure(F.col(n), False), 6).alias(n) for n in [*NUM, "missed_bytes"]])


@query(FLOWS + """SELECT scenario, count(*) AS rows, sum(1 - label)::BIGINT AS benign, sum(label)::BIGINT AS malicious, 0::BIGINT AS unknown_label, 0::BIGINT AS label_parse_errors,
  count(DISTINCT detailed_label) AS detailed_label_classes, string_agg(DISTINCT proto, '|' ORDER BY proto) AS proto_values, string_agg(DISTINCT service, '|' ORDER BY service) AS service_values,
  string_agg(DISTINCT conn_state, '|' ORDER BY conn_state) AS conn_state_values, count(*) FILTER (event_id % 7 = 0) AS duration_dash,
  count(*) FILTER (event_id % 7 <> 0 AND event_id % 11 = 0) AS duration_question, 0::BIGINT AS duration_empty, 0::BIGINT AS duration_missing, 0::BIGINT AS duration_other_invalid,
  0::BIGINT AS orig_bytes_dash, count(*) FILTER (event_id % 9 = 0) AS resp_bytes_dash FROM f GROUP BY scenario""")
def numeric_quality_profile(spark, d):
    p = profile.scenarios(_lines(spark, d))
    return p.select("scenario", "rows", "benign", "malicious", "unknown_label", "label_parse_errors", "detailed_label_classes", "proto_values", "service_values", "conn_state_values", *[f"duration_{k}" for k in ("dash", "question", "empty", "missing", "other_invalid")], "orig_bytes_dash", "resp_bytes_dash")


@query(FLOWS + "SELECT scenario, detailed_label, count(*) AS n FROM f GROUP BY ALL")
def detailed_label_counts(spark, d):
    return profile.detailed_labels(_lines(spark, d))


@query("SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS \"values\" FROM orders GROUP BY 1")
def category_vocabulary(spark, d):
    return profile.vocabulary(_t(spark, d, "orders"), "o_orderpriority", ["o_orderstatus"])


_STATS = " UNION ALL ".join(f"SELECT '{n}' AS feature, round(avg(ln(1 + {n})), 6) AS mean, round(CASE WHEN stddev_pop(ln(1 + {n})) = 0 THEN 1 ELSE stddev_pop(ln(1 + {n})) END, 6) AS scale, count({n}) AS valid FROM f WHERE scenario NOT IN {HELD}" for n in NUM)


@query(FLOWS + _STATS)
def encoder_stats(spark, d):
    e = encode.fit(_train(_flows(spark, d)), "baseline")
    return spark.createDataFrame([(n, m, s, c) for n, m, s, c in zip(e.numerics, e.means, e.scales, e.valid_counts)], "feature string, mean double, scale double, valid long").select("feature", _r("mean"), _r("scale"), "valid")


_LIGHT = [*NUM, "missed_bytes"]
_SUMS = ", ".join(f"avg(ln(1 + {n})) FILTER (scenario NOT IN {HELD}) AS m_{n}, stddev_pop(ln(1 + {n})) FILTER (scenario NOT IN {HELD}) AS s_{n}" for n in _LIGHT)
_TRANSFORMED = " UNION ALL ".join(
    [f"SELECT scenario, '{n}' AS feature, round(sum(coalesce((ln(1 + {n}) - m_{n}) / s_{n}, 0)), 4) AS total FROM f, p GROUP BY 1" for n in _LIGHT]
    + [f"SELECT scenario, '{n}_missing' AS feature, round(sum(CAST({n} IS NULL AS INT)), 4) AS total FROM f GROUP BY 1" for n in _LIGHT]
    + [f"SELECT s.scenario, '{c}=' || v.v AS feature, CAST((SELECT count(*) FROM f x WHERE x.scenario = s.scenario AND x.{s} = v.v) AS DOUBLE) AS total FROM (SELECT DISTINCT scenario FROM f) s, (SELECT DISTINCT {s} AS v FROM f WHERE scenario NOT IN {HELD}) v" for c, s in (("proto", "proto"), ("service", "service"), ("conn_state", "conn_state"), ("id.resp_p", "port"))]
    + [f"SELECT scenario, '{c}=__UNKNOWN__' AS feature, CAST(count(*) FILTER ({s} NOT IN (SELECT DISTINCT {s} FROM f WHERE scenario NOT IN {HELD})) AS DOUBLE) AS total FROM f GROUP BY 1" for c, s in (("proto", "proto"), ("service", "service"), ("conn_state", "conn_state"), ("id.resp_p", "port"))]
)


@query(FLOWS + f", p AS (SELECT {_SUMS} FROM f) " + _TRANSFORMED)
def encode_transform(spark, d):
    """Sums of all encoded features by scenario."""
    flows = _flows(spark, d)
    e = encode.fit(_train(flows), "light", datatype="double")
    names = F.array(*map(F.lit, e.feature_names))
    x = encode.transform(flows, e).select("scenario", F.explode(F.arrays_zip(names.alias("feature"), F.col("features").alias("value"))).alias("z"))
    return x.groupBy("scenario", F.col("z.feature").alias("feature")).agg(F.round(F.sum("z.value"), 4).alias("total"))


@query(FLOWS + "SELECT scenario, row_seq, CAST(proto NOT IN ('click', 'view') AS INT) AS unknown_proto FROM f")
def encode_unknown_category(spark, d):
    flows = _flows(spark, d)
    e = encode.fit(flows.where(F.col("proto").isin("click", "view")), "baseline")
    at = e.feature_names.index(f"proto={flow.UNKNOWN}")
    return encode.transform(flows, e).select("scenario", "row_seq", F.get("features", at).cast("int").alias("unknown_proto"))


@query("""SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity,
  round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) AS l_extendedprice FROM lineitem""")
def zscore_normalize(spark, d):
    df, c = _t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]
    return scaling.apply_scaling(df, scaling.fit_scaling(df, c)).select("l_orderkey", "l_linenumber", *map(_r, c))


@query("SELECT p_partkey, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())::DOUBLE, 6) AS p_size, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS p_retailprice FROM part")
def minmax_normalize(spark, d):
    df, c = _t(spark, d, "part"), ["p_size", "p_retailprice"]
    return scaling.apply_scaling(df, scaling.fit_scaling(df, c, "minmax")).select("p_partkey", *map(_r, c))


@query("""WITH c AS (SELECT o_orderstatus, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS i FROM orders GROUP BY 1)
SELECT o_orderkey, CAST(i AS INT) AS class_index, CAST(i = 0 AS INT) AS first_class FROM orders JOIN c USING (o_orderstatus)""")
def label_encode_first_appearance(spark, d):
    df, _ = scaling.encode_labels(_t(spark, d, "orders"), "o_orderstatus", "o_orderkey")
    return df.select("o_orderkey", "class_index", F.get("one_hot", 0).cast("int").alias("first_class"))


def _window_sql(seconds: float, history: int, by_scenario: bool) -> str:
    key = "a.orig_h = b.orig_h" + " AND a.scenario = b.scenario" * by_scenario
    seq = "row_seq" if by_scenario else "event_id"
    part = "scenario, orig_h" if by_scenario else "orig_h"
    return FLOWS + f""", n AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {seq}) AS rn FROM f)
SELECT a.event_id, count(b.event_id)::DOUBLE AS win_flow_count, count(DISTINCT b.resp_p)::DOUBLE AS win_unique_resp_p, count(DISTINCT b.resp_h)::DOUBLE AS win_unique_resp_h,
  round(CASE WHEN count(b.event_id) = 0 THEN 0.0 ELSE count(*) FILTER (b.resp_p = a.resp_p) / count(b.event_id)::DOUBLE END, 6) AS win_same_port_ratio
FROM n a LEFT JOIN n b ON {key} AND b.rn BETWEEN a.rn - {history} AND a.rn - 1 AND b.ts >= a.ts - {seconds} GROUP BY a.event_id"""


def _events(spark, d) -> DataFrame:
    """Flows with the ``event_id`` that they were made of."""
    lines = _lines(spark, d)
    flows = flowlog.parse(lines).join(lines.select("scenario", "row_seq", "event_id"), ["scenario", "row_seq"])
    return flows.select("scenario", "orig_h", "row_seq", "event_id", "ts", "resp_h", "resp_p")


def _windowed(spark, d, **how) -> DataFrame:
    flows = _events(spark, d)
    if how.get("keys") == ("orig_h",):
        flows = flows.withColumn("row_seq", F.col("event_id"))
    return host_windows(flows, **how).select("event_id", *flow.WINDOW_STATS[:3], _r("win_same_port_ratio"))


@query(_window_sql(DAY, 50, True))
def host_window_features(spark, d):
    return _windowed(spark, d, seconds=DAY, mode="frame")


@query(_window_sql(DAY, 50, True))
def host_window_exact(spark, d):
    return _windowed(spark, d, seconds=DAY, mode="exact")


@query(_window_sql(7 * DAY, 3, False))
def host_window_capped(spark, d):
    return _windowed(spark, d, seconds=7 * DAY, history=3, mode="frame", keys=("orig_h",))


@query(_window_sql(7 * DAY, 3, False))
def host_window_capped_exact(spark, d):
    return _windowed(spark, d, seconds=7 * DAY, history=3, mode="exact", keys=("orig_h",))


@query(FLOWS + "SELECT scenario, row_seq, " + ", ".join(f"length(regexp_replace(history, '[^{p[1:-1]}]', '', 'g'))::DOUBLE AS {n}" for n, p in flow.FLAGS.items()) + " FROM f")
def history_flags(spark, d):
    return _flows(spark, d).select("scenario", "row_seq", *[c.alias(n) for n, c in flow.flag_counts(F.col("history")).items()])


@query(FLOWS + "SELECT scenario, port, count(*) AS n FROM f GROUP BY ALL")
def port_buckets(spark, d):
    return _flows(spark, d).groupBy("scenario", F.col("`id.resp_p`").alias("port")).agg(F.count(F.lit(1)).alias("n"))


@query(FLOWS + "SELECT scenario AS dataset, count(*) AS rows, CASE scenario WHEN 'dataset23.csv' THEN 'test' WHEN 'dataset12.csv' THEN 'validation' ELSE 'train' END AS partition FROM f GROUP BY scenario")
def scenario_split(spark, d):
    p = profile.scenarios(_lines(spark, d)).select(F.col("scenario").alias("dataset"), "rows")
    return sampling.scenario_split(p)


@query("SELECT CAST(NULL AS VARCHAR) AS dataset, CAST(NULL AS VARCHAR) AS partition WHERE false")
def leakage_check(spark, d):
    """Held-out scenarios among those an encoder was fitted on: none."""
    lines = _lines(spark, d)
    e = encode.fit(_train(flowlog.parse(lines)), "baseline")
    split = sampling.scenario_split(lines.select(F.col("scenario").alias("dataset")).distinct())
    return sampling.leakage(split, spark.createDataFrame([(s,) for s in e.fitted_scenarios], "dataset string"))


def _plan(spark, d, target: int) -> tuple[DataFrame, sampling.Plan]:
    flows = _flows(spark, d).select("scenario", "row_seq", "label")
    found = {(r.scenario, r.label): r.n for r in flows.groupBy("scenario", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted({s for s, _ in found})
    return flows, sampling.balanced_plan(names, [found.get((s, 0), 0) for s in names], [found.get((s, 1), 0) for s in names], target)


@query(FLOWS + "SELECT scenario AS dataset, CASE label WHEN 1 THEN 'malicious' ELSE 'benign' END AS class, count(*) AS available, 3::BIGINT AS selected FROM f GROUP BY scenario, label")
def quota_lookup(spark, d):
    """Three rows of each class and scenario: every stratum has as many."""
    return _plan(spark, d, 69)[1].table(spark)


_OPEN = "len(list_filter(range(1, {end}), lambda j: dealt[j] < caps[j]))"
_LEFT = "(target - list_sum(dealt))"


@query(FLOWS.replace("WITH f", "WITH RECURSIVE f", 1) + f""", c AS (SELECT scenario, label, count(*) AS n FROM f GROUP BY ALL),
k AS (SELECT y.label, s.scenario, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT scenario FROM f) s CROSS JOIN (VALUES (0), (1)) y(label) LEFT JOIN c ON c.scenario = s.scenario AND c.label = y.label),
caps AS (SELECT label, list(n ORDER BY scenario) AS caps, list(scenario ORDER BY scenario) AS names, (SELECT count(*) * 3 // 4 FROM f WHERE label = 1) AS target FROM k GROUP BY label),
r AS (SELECT label, caps, names, target, list_transform(caps, lambda x: 0::BIGINT) AS dealt FROM caps
  UNION ALL SELECT label, caps, names, target, list_transform(range(1, len(caps) + 1), lambda i: (dealt[i] + CASE WHEN dealt[i] < caps[i] THEN least(caps[i] - dealt[i], {_LEFT} // {_OPEN.format(end='len(caps) + 1')} + CAST({_OPEN.format(end='i')} < {_LEFT} % {_OPEN.format(end='len(caps) + 1')} AS BIGINT)) ELSE 0 END)::BIGINT)
  FROM r WHERE list_sum(dealt) < target)
SELECT u.name AS dataset, CASE label WHEN 1 THEN 'malicious' ELSE 'benign' END AS class, u.cap::BIGINT AS available, u.got::BIGINT AS selected
FROM (SELECT label, unnest(list_transform(range(1, len(caps) + 1), lambda i: {{'name': names[i], 'cap': caps[i], 'got': dealt[i]}})) AS u FROM r WHERE list_sum(dealt) = target)""")
def equalized_quotas(spark, d):
    """A target that the smaller strata can't share evenly."""
    flows, _ = _plan(spark, d, 1)
    n = flows.where("label = 1").count()
    return _plan(spark, d, n * 3 // 4)[1].table(spark)


@query(FLOWS + ", r AS (SELECT scenario, row_seq, label, row_number() OVER (PARTITION BY scenario, label ORDER BY md5('42|' || scenario || '|' || row_seq), row_seq) AS rn FROM f) SELECT scenario, row_seq, label FROM r WHERE rn <= 3")
def stratified_exact_sample(spark, d):
    flows, plan = _plan(spark, d, 69)
    return sampling.sample(flows, plan).select("scenario", "row_seq", F.col("label").cast("int").alias("label"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) <= (SELECT round_even(count(*) * 0.2, 0) FROM orders) AS is_test FROM orders")
def train_test_split(spark, d):
    return sampling.train_test_split(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey")


def _dot(row: list[float], bias: float) -> str:
    return f"abs(list_sum(list_transform(list_zip(embedding, {row}), lambda z: CAST(z[1] AS DOUBLE) * z[2])) + {bias})"


HIDDEN = "WITH h AS (SELECT vec_id, label, " + ", ".join(f"{_dot(r, b)} AS h{i}" for i, (r, b) in enumerate(zip(WEIGHTS, BIASES))) + " FROM embeddings)"


@query(HIDDEN + " SELECT vec_id, " + ", ".join(f"round(h{i}, 6) AS h{i}" for i in range(H)) + " FROM h")
def hidden_layer(spark, d):
    df = _t(spark, d, "embeddings").select("vec_id", classifier.hidden_layer(F.col("embedding"), WEIGHTS, BIASES).alias("hidden"))
    return df.select("vec_id", *[F.round(F.get("hidden", i), 6).alias(f"h{i}") for i in range(H)])


@query(HIDDEN + " " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(sum(h{i} * h{j}), 4) AS value FROM h" for i in range(H) for j in range(H)))
def gram_matrix(spark, d):
    m = classifier.RandomFeatureClassifier(H, weights=np.array(WEIGHTS).T, biases=np.array(BIASES))
    df = _t(spark, d, "embeddings").select("embedding", (F.col("label") >= 5).cast("int").alias("y"))
    g, _, _ = m.gram(df, "embedding", "y", [0, 1])
    return spark.createDataFrame([(i, j, float(g[i, j])) for i in range(H) for j in range(H)], "i int, j int, value double").select("i", "j", _r("value", 4))


def _fixed_model(classes: list) -> classifier.RandomFeatureClassifier:
    m = classifier.RandomFeatureClassifier(H, weights=np.array(WEIGHTS).T, biases=np.array(BIASES))
    m.readout, m.classes = np.array(READOUT).T, classes
    return m


_S = [" + ".join(f"{w} * h{i}" for i, w in enumerate(row)) for row in READOUT]


@query(HIDDEN + f" SELECT vec_id, round({_S[0]}, 6) AS s0, round({_S[1]}, 6) AS s1 FROM h")
def rf_scores(spark, d):
    s = _fixed_model(["a", "b"]).scores(_t(spark, d, "embeddings").select("vec_id", "embedding"), "embedding")
    return s.select("vec_id", F.round(F.get("scores", 0), 6).alias("s0"), F.round(F.get("scores", 1), 6).alias("s1"))


@query(HIDDEN + f" SELECT vec_id, CASE WHEN {_S[0]} >= {_S[1]} THEN 'a' ELSE 'b' END AS predicted FROM h")
def rf_predict(spark, d):
    return _fixed_model(["a", "b"]).predict(_t(spark, d, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", "predicted")


@query(HIDDEN + f" SELECT vec_id, CAST(({_S[1]}) - ({_S[0]}) >= 0.05 AS INT) AS predicted FROM h")
def rf_threshold_predict(spark, d):
    return _fixed_model([0, 1]).predict_at(_t(spark, d, "embeddings").select("vec_id", "embedding"), 0.05, "embedding", 1).select("vec_id", "predicted")


@query()
def rf_fit_predict(spark, d):
    df = _t(spark, d, "embeddings").select("vec_id", "embedding", "label")
    m = classifier.RandomFeatureClassifier(64, seed=7).fit(df, "embedding", "label")
    return m.predict(df, "embedding").groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def _sweep_sql(where: str) -> str:
    return f"""WITH g AS (SELECT l_discount AS t, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS n FROM lineitem GROUP BY 1),
c AS (SELECT t AS threshold, sum(p) OVER (ORDER BY t DESC) AS tp, sum(n) OVER (ORDER BY t DESC) AS fp, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM g),
m AS (SELECT threshold, 2.0 * tp / (tp + fp + ap) AS f1, tp / (tp + fp)::DOUBLE AS precision, tp / ap::DOUBLE AS recall, (an - fp) / an::DOUBLE AS specificity, (tp + an - fp) / (ap + an)::DOUBLE AS accuracy,
  (an - fp)::BIGINT AS tn, fp::BIGINT AS fp, (ap - tp)::BIGINT AS fn, tp::BIGINT AS tp FROM c)
SELECT threshold, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round(accuracy, 6) AS accuracy, tn, fp, fn, tp FROM m {where}"""


def _scored(spark, d) -> DataFrame:
    return _t(spark, d, "lineitem").select(F.col("l_discount").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("threshold", *[_r(c) for c in ("f1", "precision", "recall", "specificity", "accuracy")], "tn", "fp", "fn", "tp")


@query(_sweep_sql(""))
def threshold_curve(spark, d):
    return _rounded(evaluate.rates(evaluate.sweep(_scored(spark, d), "score", "y")))


@query(_sweep_sql("ORDER BY m.f1 DESC, threshold DESC LIMIT 1"))
def threshold_sweep(spark, d):
    return _rounded(evaluate.best_threshold(_scored(spark, d), "score", "y"))


@query(_sweep_sql("WHERE m.specificity >= 0.5 ORDER BY m.f1 DESC, threshold DESC LIMIT 1"))
def threshold_sweep_constrained(spark, d):
    return _rounded(evaluate.best_threshold(_scored(spark, d), "score", "y", minimum_specificity=0.5))


_CONF = "WITH c AS (SELECT l_linestatus, count(*) FILTER (NOT t AND NOT p) AS tn, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (t AND p) AS tp FROM (SELECT l_linestatus, l_returnflag = 'R' AS t, l_discount >= 0.05 AS p FROM lineitem) GROUP BY 1)"


def _confusion(spark, d) -> DataFrame:
    df = _t(spark, d, "lineitem").select("l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("t"), (F.col("l_discount") >= 0.05).cast("int").alias("p"))
    return evaluate.confusion(df, "t", "p", by=["l_linestatus"])


@query(_CONF + " SELECT l_linestatus, tn, fp, fn, tp FROM c")
def confusion_matrix(spark, d):
    return _confusion(spark, d)


@query(_CONF + """ SELECT l_linestatus, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
 round(coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0), 6) AS specificity, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def binary_metrics(spark, d):
    return evaluate.metrics(_confusion(spark, d)).select("l_linestatus", *[_r(c) for c in ("accuracy", "precision", "recall", "specificity", "f1")])


@query("""WITH c AS (SELECT count(*) FILTER (l.toxic = 1 AND d.n_chars < 500) AS tp, count(*) FILTER (l.toxic = 1 AND d.n_chars >= 500) AS fn, count(*) FILTER (l.toxic = 0 AND d.n_chars < 500) AS fp, count(*) FILTER (l.toxic = 0 AND d.n_chars >= 500) AS tn FROM labels l JOIN documents d USING (doc_id))
SELECT 'benign' AS actual, tn AS predicted_benign, fp AS predicted_malicious FROM c UNION ALL SELECT 'malicious', fn, tp FROM c""")
def confusion_long(spark, d):
    j = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("p", (F.col("n_chars") < 500).cast("int"))
    return evaluate.confusion_table(evaluate.confusion(j, "toxic", "p"))


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")) + ")")
def inspect_describe(spark, d):
    return delimited.describe(_t(spark, d, "lineitem")).select("column", "rows", "nulls")


@query(FLOWS + "SELECT count(*) AS rows, sum(1 - label)::BIGINT AS benign, sum(label)::BIGINT AS malicious FROM f")
def scan_totals(spark, d):
    """Totals of an encoded scan, all invariants checked."""
    flows = _flows(spark, d)
    e = encode.fit(_train(flows), "light")
    got = encode.check(encode.transform(flows, e), e)
    return spark.createDataFrame([tuple(sum(g[k] for g in got.values()) for k in ("rows", "benign", "malicious"))], "rows long, benign long, malicious long")


# In SQL: the behavioral numerics of each flow.
_FLAG_SQL = ", ".join(f"length(regexp_replace(history, '[^{p[1:-1]}]', '', 'g'))::DOUBLE AS {n}" for n, p in flow.FLAGS.items())
BEHAVIOR = FLOWS + f""", n AS (SELECT *, row_number() OVER (PARTITION BY scenario, orig_h ORDER BY row_seq) AS rn FROM f),
w AS (SELECT a.event_id, count(b.event_id)::DOUBLE AS win_flow_count, count(DISTINCT b.resp_p)::DOUBLE AS win_unique_resp_p, count(DISTINCT b.resp_h)::DOUBLE AS win_unique_resp_h,
  CASE WHEN count(b.event_id) = 0 THEN 0.0 ELSE count(*) FILTER (b.resp_p = a.resp_p) / count(b.event_id)::DOUBLE END AS win_same_port_ratio
  FROM n a LEFT JOIN n b ON a.scenario = b.scenario AND a.orig_h = b.orig_h AND b.rn BETWEEN a.rn - 50 AND a.rn - 1 AND b.ts >= a.ts - {DAY} GROUP BY a.event_id),
x AS (SELECT f.*, w.* EXCLUDE (event_id), {_FLAG_SQL}, scenario NOT IN {HELD} AS train FROM f JOIN w USING (event_id))"""
_NUMERICS, _CATS = flow.REPRESENTATIONS["behavioral"]
_SOURCES = {"id.resp_p": "port"}
_SLOTS = " UNION ALL ".join(f"SELECT {j} AS j, '{c}' AS source, 0 AS unknown, v FROM (SELECT DISTINCT {_SOURCES.get(c, c)} AS v FROM x WHERE train) UNION ALL SELECT {j}, '{c}', 1, '{flow.UNKNOWN}'" for j, c in enumerate(_CATS))
_TABLE = " UNION ALL ".join(
    f"SELECT {i + 1} AS feature_index, '{n}' AS feature_name, 'numeric' AS kind, '{n}' AS source, round(avg(ln(1 + {n})), 6) AS training_mean, round(CASE WHEN stddev_pop(ln(1 + {n})) < 1e-12 THEN 1 ELSE stddev_pop(ln(1 + {n})) END, 6) AS training_scale, count({n}) AS training_valid_count FROM x WHERE train"
    f" UNION ALL SELECT {len(_NUMERICS) + i + 1}, '{n}_missing', 'missing_indicator', '{n}', NULL, NULL, count({n}) FROM x WHERE train"
    for i, n in enumerate(_NUMERICS)
)


@query(BEHAVIOR + f", s AS ({_SLOTS}) {_TABLE} UNION ALL SELECT ({2 * len(_NUMERICS)} + row_number() OVER (ORDER BY j, unknown, v))::INT, source || '=' || v, 'one_hot', source, NULL, NULL, NULL FROM s")
def feature_table(spark, d):
    """The layout and statistics of the behavioral encoder."""
    t = encode.fit_all(_train(_flows(spark, d)), seconds=DAY, mode="frame")["behavioral"].table(spark)
    return t.select("feature_index", "feature_name", "kind", "source", _r("training_mean"), _r("training_scale"), "training_valid_count")


_B_SUMS = ", ".join(f"avg(ln(1 + {n})) FILTER (train) AS m_{n}, CASE WHEN stddev_pop(ln(1 + {n})) FILTER (train) < 1e-12 THEN 1 ELSE stddev_pop(ln(1 + {n})) FILTER (train) END AS s_{n}" for n in _NUMERICS)
_B_ROWS = " UNION ALL ".join(f"SELECT scenario, '{n}' AS feature, round(sum(coalesce((ln(1 + {n}) - m_{n}) / s_{n}, 0)), 4) AS total FROM x, p GROUP BY 1 UNION ALL SELECT scenario, '{n}_missing', round(sum(CAST({n} IS NULL AS DOUBLE)), 4) FROM x GROUP BY 1" for n in _NUMERICS)


@query(BEHAVIOR + f", p AS (SELECT {_B_SUMS} FROM x) SELECT scenario, feature, total + 0.0 AS total FROM ({_B_ROWS})")
def encode_behavioral(spark, d):
    """Sums of the numerics and their indicators of the behavioral encoder, by scenario."""
    raw = encode.raw_numerics(_flows(spark, d), "behavioral", seconds=DAY, mode="frame")
    e = encode.fit_raw(_train(raw), ["behavioral"], datatype="double")["behavioral"]
    names = F.array(*map(F.lit, e.feature_names[: 2 * len(e.numerics)]))
    x = encode.encoded(raw, e).select("scenario", F.explode(F.arrays_zip(names.alias("feature"), F.slice("features", 1, 2 * len(e.numerics)).alias("value"))).alias("z"))
    return x.groupBy("scenario", F.col("z.feature").alias("feature")).agg((F.round(F.sum("z.value"), 4) + 0.0).alias("total"))


_BACK, _KEEP = 3 * DAY, 5


@query(FLOWS.replace("WITH f", "WITH RECURSIVE f", 1) + f""", g AS (SELECT orig_h, event_id, ts - (event_id * 7919 % 5) * 200000 AS t, resp_h, resp_p, row_number() OVER (PARTITION BY orig_h ORDER BY event_id) AS rn FROM f),
l AS (SELECT orig_h, list(t ORDER BY rn) AS ts FROM g GROUP BY orig_h),
r AS (SELECT orig_h, 1::BIGINT AS rn, 1::BIGINT AS p FROM l
  UNION ALL SELECT r.orig_h, r.rn + 1, greatest(r.rn + 1 - {_KEEP}, r.p - 1 + coalesce(nullif(list_position(list_transform(l.ts[r.p : r.rn], lambda t: t >= l.ts[r.rn + 1] - {_BACK}), true), 0), r.rn - r.p + 2)) FROM r JOIN l USING (orig_h) WHERE r.rn < len(l.ts))
SELECT a.event_id, count(b.event_id)::DOUBLE AS win_flow_count, count(DISTINCT b.resp_p)::DOUBLE AS win_unique_resp_p, count(DISTINCT b.resp_h)::DOUBLE AS win_unique_resp_h,
  round(CASE WHEN count(b.event_id) = 0 THEN 0.0 ELSE count(*) FILTER (b.resp_p = a.resp_p) / count(b.event_id)::DOUBLE END, 6) AS win_same_port_ratio
FROM g a JOIN r ON r.orig_h = a.orig_h AND r.rn = a.rn LEFT JOIN g b ON b.orig_h = a.orig_h AND b.rn BETWEEN r.p AND a.rn - 1 GROUP BY a.event_id""")
def host_window_out_of_order(spark, d):
    """Time that runs backwards: what was forgotten stays forgotten."""
    e = F.col("event_id")
    flows = _events(spark, d).withColumn("row_seq", e).withColumn("ts", F.col("ts") - (e * 7919 % 5) * 200000)
    return host_windows(flows, seconds=_BACK, history=_KEEP, mode="exact", keys=("orig_h",)).select("event_id", *flow.WINDOW_STATS[:3], _r("win_same_port_ratio"))


@query(_window_sql(DAY, 50, True))
def host_window_ranged(spark, d):
    """Ranges of 40 lines, so that hosts span several."""
    return _windowed(spark, d, seconds=DAY, mode="exact", range_rows=40)


@query(FLOWS + "SELECT scenario AS dataset, CASE scenario WHEN 'dataset23.csv' THEN 'test' ELSE 'validation' END AS partition FROM f WHERE scenario IN ('dataset12.csv', 'dataset23.csv') GROUP BY scenario")
def leakage_planted(spark, d):
    """An encoder that was fitted on all scenarios leaks both held-out ones."""
    lines = _lines(spark, d)
    e = encode.fit(flowlog.parse(lines), "baseline")
    split = sampling.scenario_split(lines.select(F.col("scenario").alias("dataset")).distinct())
    return sampling.leakage(split, spark.createDataFrame([(s,) for s in e.fitted_scenarios], "dataset string")).select("dataset", "partition")


@query(ORACLES["parse_flow_lines"])
def scan_files(spark, d):
    """The lines written as scenario files, scanned and parsed."""
    paths = flowlog.write_scenarios(_lines(spark, d), fresh_folder(spark, "scenarios"))
    return _parsed(flowlog.parse(flowlog.scan(spark, paths)))


@query(FLOWS + "SELECT scenario, 21 AS columns, true AS schema_matches, count(*) AS rows, sum(label)::BIGINT AS malicious FROM f GROUP BY scenario")
def file_profile(spark, d):
    paths = flowlog.write_scenarios(_lines(spark, d), fresh_folder(spark, "scenarios"))
    return profile.files(spark, paths).select("scenario", "columns", "schema_matches", "rows", "malicious")


@query(FLOWS + "SELECT DISTINCT scenario AS dataset, row_number() OVER (ORDER BY CAST(regexp_extract(scenario, '[0-9]+') AS INT)) AS place FROM (SELECT DISTINCT scenario FROM f)")
def natural_order(spark, d):
    names = _lines(spark, d).select(F.col("scenario").alias("dataset")).distinct()
    return names.select("dataset", F.row_number().over(Window.orderBy(flowlog.scenario_order(F.col("dataset")))).cast("long").alias("place"))


def _odd_lines(spark, d) -> DataFrame:
    """Lines of which some lack a time, a field or a label, or have a field with spaces."""
    e, v = F.col("event_id"), F.col("value")
    odd = F.when(e % 17 == 0, F.regexp_replace(v, "^[^,]*", "-")).when(e % 19 == 0, F.concat(v, F.lit(",x"))).when(e % 23 == 0, F.regexp_replace(v, "(?i)benign|malicious", "unclear"))
    return _lines(spark, d).withColumn("value", odd.when(e % 29 == 0, F.regexp_replace(v, ",(click|view),", ", $1 ,")).otherwise(v)).drop("event_id")


_REASON = "CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 'invalid row structure' WHEN event_id % 23 = 0 THEN 'invalid binary label' END"


@query(FLOWS + f"""SELECT scenario, row_seq, {_REASON} IS NOT NULL AS malformed, CASE WHEN event_id % 17 = 0 OR {_REASON} = 'invalid row structure' THEN CAST(row_seq AS DOUBLE) ELSE round(ts, 6) END AS ts,
  CASE WHEN {_REASON} = 'invalid row structure' THEN NULL ELSE proto END AS proto, CASE WHEN {_REASON} IS NULL THEN label END AS label FROM f""")
def parse_permissive(spark, d):
    p = flowlog.parse(_odd_lines(spark, d), strict=False)
    return p.select("scenario", "row_seq", "malformed", _r("ts"), "proto", F.col("label").cast("int").alias("label"))


@query(FLOWS + f"SELECT scenario, row_seq, {_REASON} AS reason FROM f WHERE {_REASON} IS NOT NULL")
def rejected_lines(spark, d):
    return flowlog.rejects(_odd_lines(spark, d)).select("scenario", "row_seq", "reason")


@query(FLOWS + "SELECT CASE scenario WHEN 'dataset23.csv' THEN 'test' WHEN 'dataset12.csv' THEN 'validation' ELSE 'train' END AS partition, count(DISTINCT scenario) AS scenarios, count(*) AS rows, sum(1 - label)::BIGINT AS benign, sum(label)::BIGINT AS malicious, least(sum(1 - label), sum(label))::BIGINT AS balanced FROM f GROUP BY 1")
def split_totals(spark, d):
    p = profile.scenarios(_lines(spark, d)).withColumnRenamed("scenario", "dataset")
    return sampling.split_totals(sampling.scenario_split(p))


@query(FLOWS + "SELECT scenario, count(*) AS rows, sum(label)::BIGINT AS malicious, count(*) FILTER (label = 0)::DOUBLE AS benign_indicators FROM f GROUP BY scenario")
def batch_callback(spark, d):
    """A callback over batches of encoded rows; here it counts."""
    flows = _flows(spark, d)
    x = encode.transform(flows, encode.fit(_train(flows), "baseline"))
    count = lambda x, y, scenario: {"scenario": [scenario], "rows": [len(x)], "malicious": [int(y.sum())], "benign_indicators": [float((y == 0).sum())]}
    found = encode.each_batch(x, count, "scenario string, rows long, malicious long, benign_indicators double", 64)
    return found.groupBy("scenario").agg(*[F.sum(c).alias(c) for c in ("rows", "malicious", "benign_indicators")])


_RIDGE = HIDDEN.replace("WITH h", "WITH h0_", 1).replace("FROM embeddings)", "FROM embeddings), h AS (SELECT * FROM h0_)")


@query(_RIDGE + """, g AS (SELECT sum(h0 * h0) + 0.01 AS a, sum(h0 * h1) AS b, sum(h1 * h1) + 0.01 AS c, sum(h0) FILTER (label < 5) AS p0, sum(h1) FILTER (label < 5) AS q0, sum(h0) FILTER (label >= 5) AS p1, sum(h1) FILTER (label >= 5) AS q1 FROM h)
SELECT 0 AS unit, round((c * p0 - b * q0) / (a * c - b * b), 6) AS low, round((c * p1 - b * q1) / (a * c - b * b), 6) AS high FROM g
UNION ALL SELECT 1, round((a * q0 - b * p0) / (a * c - b * b), 6), round((a * q1 - b * p1) / (a * c - b * b), 6) FROM g""")
def ridge_readout(spark, d):
    """The readout of two hidden units with given weights, against Cramer's rule."""
    m = classifier.RandomFeatureClassifier(2, weights=np.array(WEIGHTS[:2]).T, biases=np.array(BIASES[:2]))
    df = _t(spark, d, "embeddings").select("embedding", (F.col("label") >= 5).cast("int").alias("y"))
    beta = m.fit(df, "embedding", "y", classes=[0, 1]).readout
    return spark.createDataFrame([(i, float(beta[i, 0]), float(beta[i, 1])) for i in range(2)], "unit int, low double, high double").select("unit", _r("low"), _r("high"))


@query("""WITH c AS (SELECT count(*) FILTER (NOT t AND NOT p) AS tn, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (t AND p) AS tp FROM (SELECT l_returnflag = 'R' AS t, l_discount >= 0.05 AS p FROM lineitem))
SELECT u.metric, round(u.value, 6) AS value FROM (SELECT unnest([{'metric': 'accuracy', 'value': (tp + tn) / (tp + tn + fp + fn)::DOUBLE}, {'metric': 'precision', 'value': tp / (tp + fp)::DOUBLE}, {'metric': 'recall', 'value': tp / (tp + fn)::DOUBLE}, {'metric': 'specificity', 'value': tn / (tn + fp)::DOUBLE}, {'metric': 'f1', 'value': 2.0 * tp / (2 * tp + fp + fn)}]) AS u FROM c)""")
def metrics_long(spark, d):
    df = _t(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("t"), (F.col("l_discount") >= 0.05).cast("int").alias("p"))
    return evaluate.long_form(evaluate.metrics(evaluate.confusion(df, "t", "p"))).select("metric", _r("value"))


def _csv(spark, d) -> str:
    folder = fresh_folder(spark, "csv")
    _t(spark, d, "part").select("p_partkey", "p_retailprice", "p_brand", "p_size").write.option("header", True).csv(folder)
    return folder


@query("SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, round(p_retailprice, 6) AS p_retailprice, p_brand, CAST(p_size AS DOUBLE) AS p_size FROM part")
def load_dataset(spark, d):
    """A dataset read back from CSV, its target in the middle."""
    df, features, target = delimited.load_dataset(spark, _csv(spark, d), "p_brand")
    return df.select(*features, target).withColumn("p_retailprice", F.round("p_retailprice", 6))


@query("SELECT * FROM (VALUES ('p_partkey', 'int'), ('p_retailprice', 'double'), ('p_brand', 'string'), ('p_size', 'int')) t(\"column\", type)")
def inferred_schema(spark, d):
    _, types = delimited.inferred_schema(spark, _csv(spark, d))
    return spark.createDataFrame([tuple(t.split("::")) for t in types.split(";")], "column string, type string")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg({c}), 4) AS mean, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM lineitem" for c in ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")) + ")")
def numeric_summary(spark, d):
    told = delimited.describe(_t(spark, d, "lineitem").select("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"))
    return told.where("mean is not null").select("column", _r("mean", 4), "min", "max")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) <= (SELECT round_even(count(*) * 0.2, 0) FROM orders) AS is_test FROM orders")
def train_test_split_ordered(spark, d):
    return sampling.train_test_split(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey", shuffle=False)


@query("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(round_even(count(*) * 0.2, 0) AS BIGINT) AS test_rows, count(DISTINCT o_orderkey) AS orders FROM orders")
def train_test_split_repeated(spark, d):
    """Rows that share an id: as many test rows are due as without."""
    got = sampling.train_test_split(_t(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey")
    return got.agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_test").alias("test_rows"), F.count_distinct("o_orderkey").alias("orders"))


def settings_for(spark, d, lines: DataFrame | None = None) -> pipeline.Settings:
    """The defaults, with targets that the table can meet."""
    flows = flowlog.parse(_lines(spark, d) if lines is None else lines)
    n = _train(flows).where("label = 1").count()
    return pipeline.Settings(target_per_class=min(500_000, n), hidden=64, window_seconds=DAY, window_mode="frame", minimum_validation_specificity=0.5)


@query()
def pipeline_end_to_end(spark, d):
    lines = _lines(spark, d).drop("event_id").persist()  # read to count, to profile and to parse
    done = pipeline.run(lines, settings_for(spark, d, lines))
    lines.unpersist()
    return done.test
