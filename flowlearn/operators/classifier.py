"""A random hidden layer with a ridge readout, fitted from Gram sums."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import read_file, write_file
from .scaling import classes_of

#: Partial sums are united in so many tasks before the driver adds them.
SLOTS = 8

ACTIVATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"abs": np.abs, "tanh": np.tanh}


#: Element types of weights, hidden values and scores. Gram sums are of doubles in either.
ELEMENTS = {"float": np.float32, "double": np.float64}


def _matrix(column: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if len(values) != len(column) * width:
        raise ValueError(f"features must have {width} values")
    if not np.isfinite(values).all():
        raise ValueError("features must be finite numbers")
    return values.reshape(-1, width)


class RandomFeatureClassifier:
    """``activation`` is a name or a function of arrays. Weights are standard normal from
    ``seed``, or given as ``weights`` (inputs x hidden) and ``biases``; ``element`` is their type."""

    def __init__(self, hidden: int = 100, activation: str | Callable = "abs", ridge: float = 0.01, seed: int = 42, weights: np.ndarray | None = None, biases: np.ndarray | None = None, element: str = "double"):
        if element not in ELEMENTS:
            raise ValueError(f"element must be one of {sorted(ELEMENTS)}")
        self.element = element
        if hidden <= 0:
            raise ValueError("hidden must be positive")
        if ridge < 0:
            raise ValueError("ridge must not be negative")
        self.hidden, self.ridge, self.seed = hidden, ridge, seed
        self.activation = ACTIVATIONS[activation] if isinstance(activation, str) else activation
        self.weights, self.biases = weights, biases
        self.readout: np.ndarray | None = None
        self.classes: list | None = None

    def _start(self, width: int) -> None:
        if width <= 0:
            raise ValueError("there must be features")
        if self.weights is None:
            rng = np.random.default_rng(self.seed)
            self.weights, self.biases = rng.standard_normal((width, self.hidden)), rng.standard_normal(self.hidden)
        self.weights, self.biases = (np.asarray(x, dtype=ELEMENTS[self.element]) for x in (self.weights, self.biases))

    def gram(self, df: DataFrame, features: str, label: str, classes: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hidden Gram matrix, hidden-by-class sums and class counts over all rows.

        Each task sums its rows; the sums are united in ``SLOTS`` tasks and then here, so what
        reaches the driver depends on the model alone."""
        w, b, act, h, kind = self.weights, self.biases, self.activation, self.hidden, ELEMENTS[self.element]
        sent = df.sparkSession.sparkContext.broadcast((w, b))
        at = F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1

        def total(parts: list[bytes]) -> np.ndarray:
            return sum((np.frombuffer(p) for p in parts), np.zeros(h * h + h * len(classes) + len(classes)))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, b = sent.value
            g, r, n = np.zeros((h, h)), np.zeros((h, len(classes))), np.zeros(len(classes))
            for batch in batches:
                if not batch.num_rows:
                    continue
                y = batch.column(1).to_numpy(zero_copy_only=False)
                if batch.column(1).null_count or (y < 0).any():
                    raise ValueError("a label is none of the classes")
                hid = act(_matrix(batch.column(0), w.shape[0], kind) @ w + b).astype(np.float64)
                onehot = np.eye(len(classes))[y.astype(np.int64)]
                g += hid.T @ hid
                r += hid.T @ onehot
                n += onehot.sum(0)
            yield pa.RecordBatch.from_pydict({"slot": pa.array([TaskContext.get().partitionId() % SLOTS], pa.int32()), "sums": pa.array([np.concatenate([g.ravel(), r.ravel(), n]).tobytes()], pa.binary())})

        def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                if batch.num_rows:
                    out = total([p for p in batch.column(1).to_pylist()] + ([out.tobytes()] if out is not None else []))
            if out is not None:
                yield pa.RecordBatch.from_pydict({"sums": pa.array([out.tobytes()], pa.binary())})

        partial = df.select(F.col(features), at.cast("int")).mapInArrow(sums, "slot int, sums binary")
        found = total([bytes(x.sums) for x in partial.repartition(SLOTS, "slot").mapInArrow(unite, "sums binary").collect()])
        return found[: h * h].reshape(h, h), found[h * h : h * h + h * len(classes)].reshape(h, -1), found[h * h + h * len(classes) :]

    def fit(self, df: DataFrame, features: str = "features", label: str = "label", order: str | None = None, classes: list | None = None, width: int | None = None) -> RandomFeatureClassifier:
        """Fit on all rows. Classes come in the order of first rows by ``order`` (sorted by
        default). Given ``classes`` must be two or more, each with rows. ``width`` is the number
        of features, if it is known; else a row is asked for."""
        if classes is not None and len(classes) < 2:
            raise ValueError("at least two classes are required")
        if classes is not None and len(set(classes)) != len(classes):
            raise ValueError("classes must be unique")
        if width is None:
            if (first := df.select(features).first()) is None:
                raise ValueError("there are no rows")
            width = len(first[0])
        self._start(width)
        own = classes if classes is not None else classes_of(df, label, order or label)
        g, r, n = self.gram(df, features, label, own)
        if not (n > 0).all():
            raise ValueError("every class must occur")
        self.readout, self.classes = np.linalg.solve(g + self.ridge * np.eye(self.hidden), r).astype(ELEMENTS[self.element]), list(own)
        return self

    def _fitted(self) -> None:
        if self.classes is None:
            raise ValueError("fit the model first")

    def scores(self, df: DataFrame, features: str = "features") -> DataFrame:
        """``df`` with ``scores``, one for each class."""
        self._fitted()
        sent, act, names, kind = df.sparkSession.sparkContext.broadcast((self.weights, self.biases, self.readout)), self.activation, df.columns, ELEMENTS[self.element]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, b, beta = sent.value
            for batch in batches:
                s = (act(_matrix(batch.column(0), w.shape[0], kind) @ w + b) @ beta).astype(np.float64)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, s.size + 1, s.shape[1], dtype=np.int32)), pa.array(s.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], listed], names=[*names, "scores"])

        ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "scores array<double>"])
        return df.select(F.col(features).alias("features to score"), *[F.col(f"`{n}`").alias(f"kept {i}") for i, n in enumerate(names)]).mapInArrow(run, ddl)

    def predict(self, df: DataFrame, features: str = "features") -> DataFrame:
        """``df`` with ``scores`` and ``predicted``: the class of the greatest score, the first of equals."""
        scored = self.scores(df, features)
        return scored.withColumn("predicted", F.element_at(F.array(*map(F.lit, self.classes)), F.array_position("scores", F.array_max("scores")).cast("int")))

    def _sides(self, positive) -> tuple[int, int]:
        self._fitted()
        if len(self.classes) != 2:
            raise ValueError("thresholds need a model of exactly two classes")
        if positive is None:
            at = self.classes.index(1) if 1 in self.classes else 1
        elif positive in self.classes:
            at = self.classes.index(positive)
        else:
            raise ValueError("the positive label is none of the classes")
        return at, 1 - at

    def decision(self, df: DataFrame, features: str = "features", positive=None) -> DataFrame:
        """``df`` with ``scores`` and ``decision``, the positive score less the other."""
        p, n = self._sides(positive)
        return self.scores(df, features).withColumn("decision", F.get("scores", p) - F.get("scores", n))

    def predict_at(self, df: DataFrame, threshold: float, features: str = "features", positive=None) -> DataFrame:
        """``df`` with ``predicted``: positive where the decision reaches the threshold."""
        if not np.isfinite(threshold):
            raise ValueError("the threshold must be finite")
        p, n = self._sides(positive)
        return self.decision(df, features, positive).withColumn("predicted", F.when(F.col("decision") >= threshold, F.lit(self.classes[p])).otherwise(F.lit(self.classes[n])))

    def save(self, path: str) -> str:
        """Write arrays and settings to any file system of Hadoop; the file appears whole or not at all."""
        self._fitted()
        name = next((k for k, f in ACTIVATIONS.items() if f is self.activation), None)
        if name is None:
            raise ValueError("only models with a named activation can be saved")
        about = json.dumps({"hidden": self.hidden, "activation": name, "ridge": self.ridge, "seed": self.seed, "classes": self.classes, "element": self.element})
        out = io.BytesIO()
        np.savez(out, weights=self.weights, biases=self.biases, readout=self.readout, about=np.array(about))
        return write_file(path, out.getvalue())

    @classmethod
    def load(cls, path: str) -> RandomFeatureClassifier:
        if (content := read_file(path)) is None:
            raise ValueError(f"model file does not exist: {path}")
        with np.load(io.BytesIO(content)) as found:
            about = json.loads(str(found["about"]))
            classes = about.pop("classes")
            out = cls(**about, weights=found["weights"], biases=found["biases"])
            out.readout, out.classes = found["readout"], classes
        return out


def hidden_layer(features: Column, weights: list[list[float]], biases: list[float], activation: Callable[[Column], Column] = F.abs) -> Column:
    """A small hidden layer as one expression; ``weights`` by hidden unit."""
    dot = lambda row: F.aggregate(F.zip_with(features, F.array(*map(F.lit, row)), lambda x, w: x.cast("double") * w), F.lit(0.0), lambda s, v: s + v)
    return F.array(*[activation(dot(row) + b) for row, b in zip(weights, biases)])


def gram_cells(df: DataFrame, hidden: str = "hidden") -> DataFrame:
    """``i``, ``j`` and ``value`` of the Gram matrix of a small hidden column."""
    n = F.size(hidden)
    cells = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(i.alias("i"), j.alias("j"), (F.get(hidden, i) * F.get(hidden, j)).alias("v")))))
    return df.select(F.explode(cells).alias("c")).groupBy("c.i", "c.j").agg(F.sum("c.v").alias("value"))
