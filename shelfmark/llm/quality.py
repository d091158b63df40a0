"""Quality: ridge scores over random Fourier features of document statistics, with isotonic calibration.

The features approximate a Gaussian kernel. Each partition sums its own normal equations; the sums are added by
row, so the fit takes every labelled row and the driver gets one matrix of a fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import staged, text_buffers
from .learning import Isotonic, isotonic

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "spread_word", "capitals", "digits", "punctuation", "other_bytes", "line_ends", "exclamations",
    "marks", "bars", "distinct_words", "repeated_lines", "words_ending_in_marks", "capital_words",
)
_PUNCTUATION = np.array([33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 for c in range(256)])
_MARKS = np.array([chr(c) in "#$%&*" for c in range(256)])
#: Rows of a score bin's resolution in the calibration.
BINS = 2000


def statistics(text: bytes) -> list[float]:
    """The statistics of a whole text, in the order of STATISTICS."""
    words = text.split()
    n, size = max(len(words), 1), max(len(text), 1)
    length = np.fromiter(map(len, words), np.int64, len(words))
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [x for x in text.split(b"\n") if x]
    marked = sum(w[-1] in b"#$%&*!|" for w in words)
    return [
        np.log1p(len(text)), np.log1p(len(words)), float(length.mean()) if len(words) else 0.0, float(length.std()) if len(words) else 0.0,
        byte[65:91].sum() / size, byte[48:58].sum() / size, byte[_PUNCTUATION].sum() / size, byte[128:].sum() / size, byte[10] / size, byte[33] / size,
        byte[_MARKS].sum() / size, byte[124] / size, len(set(words)) / n, 1 - len(set(lines)) / max(len(lines), 1), marked / n,
        sum(map(bytes.isupper, words)) / n,
    ]


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weight: np.ndarray | None = None
    curve: Isotonic | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows of statistics, and a constant."""
        z = np.cos((x - self.mean) / self.scale @ self.frequency + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weight


def _measured(batch, text: str) -> np.ndarray:
    data, ends = text_buffers(batch[text])
    raw = data.tobytes()
    return np.array([statistics(raw[a:b]) for a, b in zip(ends[:-1], ends[1:])]).reshape(-1, len(STATISTICS))


def measured(docs: DataFrame, text: str = "text", out: str = "statistics") -> DataFrame:
    """docs with the statistics of the text instead of the text; a null text counts as empty."""
    fields = [f for f in docs.drop(out).schema.fields if f.name != text]
    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            x = _measured(batch, text)
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in fields), pa.array(x.tolist(), pa.list_(pa.float64()))], names=schema.names)

    return docs.select(*(f"`{f.name}`" for f in fields), text).mapInArrow(run, schema)


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", features: int = 256, width: float = 4.0, ridge: float = 1e-3, seed: int = 7,
    statistics_col: str | None = None,
) -> QualityModel:
    """A model from all labelled documents: four fifths fit the scores, the others the calibration.

    An id that is labelled more than once has its largest label; null labels, ids and texts are left out. Without
    labelled rows the model scores 0.5. Documents that are measured already have their statistics in statistics_col
    (null where the text is null) and need no text.
    """
    labels = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("label"))
    # Texts become statistics before they meet the labels: the join moves sixteen numbers a row, no text.
    held = docs.select(id_col, F.col(statistics_col).alias("x")) if statistics_col else measured(docs.select(id_col, text).where(F.col(text).isNotNull()), text, "x")
    rows = held.where("x is not null").join(labels, id_col)
    rows = staged(rows.select(F.pmod(F.xxhash64(id_col), F.lit(5)).cast("int").alias("fold"), (F.col("label") == 1).cast("double").alias("y"), "x"), "measured")
    d = len(STATISTICS)
    sums = rows.agg(F.count("*"), *[f(F.col("x")[k]) for f in (F.mean, F.stddev_pop) for k in range(d)]).first()
    rng = np.random.default_rng(seed)
    frequency, phase = rng.normal(0, 1 / width, (d, features)), rng.uniform(0, 2 * np.pi, features)
    if not sums[0]:
        return QualityModel(np.zeros(d), np.ones(d), frequency, phase)
    scale = np.array(sums[1 + d :])
    model = QualityModel(np.array(sums[1 : 1 + d]), np.where(scale > 1e-9, scale, 1.0), frequency, phase)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def equations(batches):
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            z = shared.value.features(np.array(batch["x"].to_pylist()).reshape(-1, d))
            total += np.hstack([z.T @ z, z.T @ batch["y"].to_numpy()[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(features + 1), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v) for v in group["sums"].to_pylist()], axis=0)
        return pa.table([group["i"].slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["i", "sums"])

    parts = rows.where("fold <> 0").mapInArrow(equations, "i int, sums binary")
    summed = sorted(parts.groupBy("i").applyInArrow(add, "i int, sums binary").collect())
    matrix = np.array([np.frombuffer(r.sums) for r in summed]) if summed else np.zeros((features + 1, features + 2))
    n = max(matrix[-1, -2], 1)
    model.weight = np.linalg.solve(matrix[:, :-1] + ridge * n * np.eye(features + 1), matrix[:, -1])
    again = docs.sparkSession.sparkContext.broadcast(model)

    def raws(batches):
        for batch in batches:
            raw = again.value.raw(np.array(batch["x"].to_pylist()).reshape(-1, d))
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(raw * BINS).astype(np.int64)), batch["y"]], names=["bin", "y"])

    # Raw scores lie near 0 to 1, so there are a few thousand bins, however many rows.
    held = rows.where("fold = 0") if rows.where("fold = 0").limit(1).count() else rows
    bins = held.mapInArrow(raws, "bin long, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n")).toPandas()
    model.curve = isotonic((bins.bin.to_numpy() + 0.5) / BINS, bins.y.to_numpy(np.float64), bins.n.to_numpy(np.float64))
    return model


def score(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "score", keep_text: bool = True, statistics_col: str | None = None) -> DataFrame:
    """docs with a calibrated score from 0 to 1.

    A null text counts as empty, and empty texts have the score of their statistics, which can also be given in
    statistics_col instead of a text. A model without labelled rows gives 0.5. Other columns and repeated rows pass unchanged; a column of docs that is named like the result is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(out)
    fields = [f for f in docs.schema.fields if keep_text or f.name != (statistics_col or text)]
    schema = T.StructType([*fields, T.StructField(out, T.DoubleType())])

    def run(batches):
        m = shared.value
        for batch in batches:
            x = np.array(batch[statistics_col].to_pylist()).reshape(-1, len(STATISTICS)) if statistics_col else _measured(batch, text)
            s = m.curve(m.raw(x)) if m.curve else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in fields), pa.array(s, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)
