"""Feature encoding: fitted means, scales and vocabularies."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flow
from ..sources.shared import read_file, write_file
from .windows import host_windows

FORMAT = 1
#: A categorical may have so many values; more are no vocabulary.
MAX_VOCABULARY = 100_000


@dataclass
class Encoder:
    """Layout: numerics, their missing indicators, then for each categorical its sorted
    values and one slot for values unknown."""

    representation: str
    numerics: list[str]
    means: list[float]
    scales: list[float]
    valid_counts: list[int]
    categoricals: list[str]
    vocabularies: list[list[str]]
    log: bool = True
    fitted_scenarios: list[str] | None = None
    datatype: str = "float"

    @property
    def feature_names(self) -> list[str]:
        slots = [f"{c}={v}" for c, vocab in zip(self.categoricals, self.vocabularies) for v in [*vocab, flow.UNKNOWN]]
        return [*self.numerics, *(f"{n}_missing" for n in self.numerics), *slots]

    def save(self, path: str) -> str:
        """Write as JSON to any file system of Hadoop; the file appears whole or not at all."""
        return write_file(path, json.dumps({"format_version": FORMAT, **asdict(self)}).encode())

    @classmethod
    def load(cls, path: str) -> Encoder:
        """Read; older files without a representation are known by their numerics. ValueError for
        a missing file, another format version and anything else that isn't an encoder."""
        if (content := read_file(path)) is None:
            raise ValueError(f"encoder file does not exist: {path}")
        try:
            found = json.loads(content)
            if (version := found.pop("format_version", FORMAT)) != FORMAT:
                raise ValueError(f"format version {version}, not {FORMAT}")
            found.setdefault("representation", {7: "baseline", 8: "light"}.get(len(found["numerics"]), "behavioral"))
            return cls(**found)
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise ValueError(f"incompatible encoder file {path}: fit the encoder again and save it") from e

    def table(self, spark: SparkSession) -> DataFrame:
        """A row for each feature: index, name, kind, source, and the numerics' statistics."""
        n, rows = len(self.numerics), []
        for i, (name, m, s, c) in enumerate(zip(self.numerics, self.means, self.scales, self.valid_counts)):
            rows += [(i + 1, name, "numeric", name, m, s, c), (n + i + 1, f"{name}_missing", "missing_indicator", name, None, None, c)]
        sources = [c for c, vocab in zip(self.categoricals, self.vocabularies) for _ in range(len(vocab) + 1)]
        rows += [(2 * n + i + 1, name, "one_hot", source, None, None, None) for i, (name, source) in enumerate(zip(self.feature_names[2 * n :], sources))]
        return spark.createDataFrame(rows, "feature_index int, feature_name string, kind string, source string, training_mean double, training_scale double, training_valid_count long").orderBy("feature_index")


def raw_numerics(flows: DataFrame, representation: str, log: bool = True, **window) -> DataFrame:
    """``flows`` (parsed) with ``raw``: the numerics of a representation, null where invalid."""
    if representation not in flow.REPRESENTATIONS:
        raise ValueError(f"unknown representation: {representation}")
    df, extra = flows, {}
    if representation == "behavioral":
        df = host_windows(flows, **window)
        extra = {**flow.flag_counts(F.col("history")), **{n: F.col(n) for n in flow.WINDOW_STATS}}
    scaled = lambda c: F.log1p(c) if log else c
    columns = [scaled(extra[n]) if n in extra else flow.measure(F.col(n), log) for n in flow.REPRESENTATIONS[representation][0]]
    return df.withColumn("raw", F.array(*columns)).drop(*(flow.WINDOW_STATS if extra else []))


def _fitted(raw: DataFrame, numerics: list[str], categoricals: list[str]) -> dict:
    """One aggregation over all rows: moments of the numerics, values of the categoricals. Each row
    gives a cell for each of them, so the aggregates are three whatever the representation."""
    n, none = len(numerics), lambda kind: F.lit(None).cast(kind)
    measured = F.transform(F.slice("raw", 1, n), lambda x, i: F.struct(i.alias("k"), x.alias("x"), none("string").alias("v")))
    named = F.array(*[F.struct(F.lit(n + j).alias("k"), none("double").alias("x"), F.col(f"`{c}`").alias("v")) for j, c in enumerate(categoricals)])
    cells = raw.select(F.explode(F.concat(measured, named)).alias("c")).select("c.*")
    sums = cells.groupBy("k", "v").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"))
    most = n + len(categoricals) * (MAX_VOCABULARY + 1)
    rows = sums.limit(most + 1).collect()
    vocab = {c: sorted(r.v for r in rows if r.k == n + j and r.v is not None) for j, c in enumerate(categoricals)}
    if len(rows) > most or any(len(v) > MAX_VOCABULARY for v in vocab.values()):
        raise ValueError(f"a categorical has more than {MAX_VOCABULARY} values")
    stats = {numerics[r.k]: (r.n, r["mean"], r.deviation) for r in rows if r.k < n}
    if any(not stats.get(name, (0,))[0] for name in numerics):
        raise ValueError("one or more numerical features have no valid training values")
    return {"stats": stats, "vocab": vocab, "scenarios": sorted(r.scenario for r in raw.select("scenario").distinct().collect())}


def _encoder(found: dict, representation: str, log: bool, datatype: str) -> Encoder:
    numerics, categoricals = flow.REPRESENTATIONS[representation]
    stats = [found["stats"][n] for n in numerics]
    return Encoder(representation, list(numerics), [m for _, m, _ in stats], [s or 1.0 for _, _, s in stats], [c for c, _, _ in stats], list(categoricals), [found["vocab"][c] for c in categoricals], log, found["scenarios"], datatype)


def fit(flows: DataFrame, representation: str = "baseline", log: bool = True, datatype: str = "float", **window) -> Encoder:
    """The encoder of parsed training flows. Scales are population deviations, 1 where zero."""
    raw = raw_numerics(flows, representation, log, **window)
    return _encoder(_fitted(raw, *flow.REPRESENTATIONS[representation]), representation, log, datatype)


def fit_all(flows: DataFrame, log: bool = True, datatype: str = "float", **window) -> dict[str, Encoder]:
    """All representations from one pass: the largest is fitted, the others take its parts."""
    return fit_raw(raw_numerics(flows, "behavioral", log, **window), list(flow.REPRESENTATIONS), log, datatype)


def widest(representations: list[str]) -> str:
    """The representation whose first numerics are those of the others."""
    return [r for r in flow.REPRESENTATIONS if r in representations][-1]


def fit_raw(raw: DataFrame, representations: list[str], log: bool = True, datatype: str = "float") -> dict[str, Encoder]:
    """Representations from the numerics of the widest of them."""
    found = _fitted(raw, *flow.REPRESENTATIONS[widest(representations)])
    return {r: _encoder(found, r, log, datatype) for r in representations}


def one_hot(value: Column, vocab: list[str]) -> Column:
    """1 at the value's place, in the last slot where it is unknown or null."""
    at = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, vocab)), value), F.lit(0)), F.lit(len(vocab) + 1)) if vocab else F.lit(1)
    return F.transform(F.sequence(F.lit(1), F.lit(len(vocab) + 1)), lambda i: (i == at).cast("double"))


def transform(flows: DataFrame, encoder: Encoder, **window) -> DataFrame:
    """``scenario``, ``row_seq``, ``features`` and ``label``. No shuffle but for the windows."""
    return encoded(raw_numerics(flows, encoder.representation, encoder.log, **window), encoder)


def encoded(raw: DataFrame, encoder: Encoder) -> DataFrame:
    """The same of numerics already at hand: those of the encoder's representation or of a larger one."""
    x = lambda i: F.get("raw", i)
    scaled = [F.coalesce((x(i) - m) / s, F.lit(0.0)) for i, (m, s) in enumerate(zip(encoder.means, encoder.scales))]
    missing = [x(i).isNull().cast("double") for i in range(len(encoder.numerics))]
    blocks = [one_hot(F.col(f"`{c}`"), v) for c, v in zip(encoder.categoricals, encoder.vocabularies)]
    return raw.select("scenario", "row_seq", F.concat(F.array(*scaled, *missing), *blocks).cast(f"array<{encoder.datatype}>").alias("features"), "label")


def check(encoded: DataFrame, encoder: Encoder) -> dict[str, dict[str, int]]:
    """Rows, benign and malicious of each scenario; ValueError unless all features are finite,
    labels binary, indicators 0 or 1 and each one-hot block sums to one."""
    n, at, blocks = len(encoder.numerics), 2 * len(encoder.numerics), []
    for v in encoder.vocabularies:
        blocks.append(F.aggregate(F.slice("features", at + 1, len(v) + 1), F.lit(0.0), lambda s, f: s + f) == 1)
        at += len(v) + 1
    rules = {
        "finite": F.forall("features", lambda f: ~F.isnan(f) & (F.abs(f) < float("inf"))),
        "label": F.col("label").isin(0, 1),
        "indicator": F.forall(F.slice("features", n + 1, n), lambda f: f.isin(0, 1)),
        "width": F.size("features") == len(encoder.feature_names),
        **{f"one_hot_{c}": b for c, b in zip(encoder.categoricals, blocks)},
    }
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == 0).alias("benign"), F.count_if(F.col("label") == 1).alias("malicious")]
    found = encoded.groupBy("scenario").agg(*counts, *[F.count_if(~F.coalesce(r, F.lit(False))).alias(k) for k, r in rules.items()]).collect()  # a row for each scenario
    if broken := sorted({k for k in rules for r in found if r[k]}):
        raise ValueError(f"encoded rows break: {', '.join(broken)}")
    return {r.scenario: {k: r[k] for k in ("rows", "benign", "malicious")} for r in found}


def each_batch(rows: DataFrame, work: Callable[[np.ndarray, np.ndarray, str], dict[str, np.ndarray] | None], schema: str, batch_size: int = 100_000) -> DataFrame:
    """What ``work(X, y, scenario)`` makes of batches of encoded rows, on the executors.

    A batch has rows of one scenario, by ``row_seq``, and at most ``batch_size`` of them; a
    scenario's rows may be dealt over several tasks. ``work`` returns columns of ``schema``, or
    None for no rows."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            held.clear()
            x = t.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            found = work(x, t.column("label").to_numpy(), t.column("scenario")[0].as_py())
            if found is not None:
                yield pa.RecordBatch.from_pydict({n: pa.array(found[n]) for n in names})

        for b in batches:
            scenarios, at = b.column("scenario").to_pylist(), 0
            while at < b.num_rows:
                if held and (held[0].column("scenario")[0].as_py() != scenarios[at] or sum(h.num_rows for h in held) == batch_size):
                    yield from made()
                room = batch_size - sum(h.num_rows for h in held)
                end = next((k for k in range(at, b.num_rows) if scenarios[k] != scenarios[at]), b.num_rows)
                held.append(b.slice(at, min(end - at, room)))
                at += held[-1].num_rows
        if held:
            yield from made()

    dealt = rows.select("scenario", "row_seq", "features", "label").repartitionByRange("scenario", "row_seq").sortWithinPartitions("scenario", "row_seq")
    return dealt.mapInArrow(run, schema)
