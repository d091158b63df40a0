"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The lexicon is a short fixed list and what the labelled sample adds: words, and beginnings of words, that occur in
far more toxic than other documents. Copies in the sample count once, by all of their words, so that the words of one
toxic text with many copies do not become lexicon entries.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import lean, staged, text_buffers
from .learning import Isotonic, Trees, boosted_trees, isotonic, labelled_sample

#: Insults that count without any label.
INSULTS = "clown disgusting dumb dumbass fool idiot imbecile jerk loser moron pathetic scum stupid trash worthless".split()
#: Second-person words of the languages that the tables hold.
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti contigo usted ustedes vosotros".split()
#: Characters that stand for letters in disguised words.
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i", "*": "", "_": "", "-": "", ".": ""})
PREFIXES = (4, 5, 6)
EDGES = ".,;:!?\"'()[]{}*#%&$|"
HIT, BEGINNING, PERSON, CAPITALS, DISGUISED, STRETCHED = 1, 2, 4, 8, 16, 32
FEATURES = (
    "hit_density", "log_hits", "distinct_hits", "beginning_density", "log_beginnings", "near_second_person", "second_person_density",
    "disguised_density", "stretched_density", "capital_words", "capitals", "punctuation", "exclamations", "digits", "log_words",
)
_STRETCH = re.compile(r"([a-z])\1\1", re.I)
_INNER = re.compile(r"[a-z][0-9$@!*_.-]+[a-z]", re.I)
_PUNCTUATION = np.array([33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 for c in range(256)])


@dataclass
class ToxicityModel:
    words: frozenset[str]
    beginnings: frozenset[str]
    trees: Trees | None = None
    curve: Isotonic | None = None
    _memo: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_memo": {}}

    def _kind(self, word: str) -> int:
        low = word.strip(EDGES).lower()
        kind = HIT * (low in self.words) | PERSON * (low in SECOND_PERSON)
        kind |= BEGINNING * any(low[:n] in self.beginnings for n in PREFIXES)
        kind |= CAPITALS * (len(word) > 2 and word.isupper())
        if not kind & HIT and _INNER.search(low) and low.translate(DISGUISES) in self.words:
            kind |= HIT | DISGUISED
        return kind | STRETCHED * bool(_STRETCH.search(low))

    def features(self, text: bytes) -> list[float]:
        """The features of a whole text, in the order of FEATURES."""
        words = text.decode("utf-8").split()
        memo = self._memo
        if len(memo) > 300_000:
            memo.clear()
        kinds = list(map(memo.get, words))
        if None in kinds:
            for k, kind in enumerate(kinds):
                if kind is None:
                    kinds[k] = memo[words[k]] = self._kind(words[k])
        codes = np.frombuffer(bytes(kinds), np.uint8)
        n = max(len(words), 1)
        hit = np.flatnonzero(codes & (HIT | BEGINNING))
        person = np.flatnonzero(codes & PERSON)
        near = 0.0
        if len(hit) and len(person):
            after = np.searchsorted(person, hit)
            gap = np.minimum(np.abs(person[np.minimum(after, len(person) - 1)] - hit), np.abs(person[np.maximum(after - 1, 0)] - hit))
            near = float((gap <= 5).mean())
        share = [float(np.count_nonzero(codes & bit)) for bit in (HIT, BEGINNING, PERSON, DISGUISED, STRETCHED, CAPITALS)]
        distinct = len({words[k].strip(EDGES).lower() for k in hit})
        byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        size = max(len(text), 1)
        return [
            share[0] / n, np.log1p(share[0]), distinct, share[1] / n, np.log1p(share[1]), near, share[2] / n, share[3] / n, share[4] / n, share[5] / n,
            byte[65:91].sum() / size, byte[_PUNCTUATION].sum() / size, byte[33] / size, byte[48:58].sum() / size, np.log1p(len(words)),
        ]


def _matrix(batch, text: str, model: ToxicityModel) -> np.ndarray:
    data, ends = text_buffers(batch[text])
    raw = data.tobytes()
    return np.array([model.features(raw[a:b]) for a, b in zip(ends[:-1], ends[1:])]).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text: str = "text", max_rows: int = 12_000, least_share: float = 0.01, ratio: float = 20.0) -> ToxicityModel:
    """A model from labelled documents, max_rows of them at most, about.

    A word or beginning joins the lexicon if it occurs in least_share of the toxic sample (five documents at least)
    and, by smoothed share, ratio times as often as in the rest. Two thirds of the sample fit the trees, the others
    the calibration. Texts of the same words, whatever their case, are copies: they count once, as toxic if one of them
    is. Without labels of both kinds, only the fixed insults and an even curve remain.
    """
    lean()

    sample = labelled_sample(docs, labels, label, max_rows, id_col, text).select(F.col(text), F.col("label").cast("int").alias("label"))
    words = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    sample = sample.groupBy(F.sha2(words, 256).alias("digest")).agg(F.min(text).alias(text), F.max("label").alias("label"))
    sample = staged(sample.select(F.conv(F.substring("digest", 1, 15), 16, 10).cast("long").alias("key"), text, "label"), "sample")
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    positive, negative = sizes.get(1, 0), sum(n for x, n in sizes.items() if x != 1)
    model = ToxicityModel(frozenset(INSULTS), frozenset())
    if not positive or not negative:
        return model

    def terms(batches):
        for batch in batches:
            seen = {0: Counter(), 1: Counter()}
            for t, y in zip(batch[text].to_pylist(), batch["label"].to_pylist()):
                low = {w.strip(EDGES) for w in t.lower().split()}
                seen[int(y == 1)].update(low | {f"{w[:n]} " for w in low for n in PREFIXES if len(w) > n})
            both = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *(pa.array([seen[y][w] for w in both], pa.int64()) for y in (0, 1))], names=["term", "rest", "toxic"])

    counts = sample.mapInArrow(terms, "term string, rest long, toxic long").groupBy("term").agg(F.sum("rest").alias("rest"), F.sum("toxic").alias("toxic"))
    often = (F.col("toxic") + 0.5) / (positive + 1) >= ratio * (F.col("rest") + 0.5) / (negative + 1)
    found = [r.term for r in counts.where((F.col("toxic") >= max(5, least_share * positive)) & often).collect()]  # the sample bounds them
    model = ToxicityModel(frozenset([*INSULTS, *(x for x in found if x and x[-1] != " ")]), frozenset(x[:-1] for x in found if x[-1:] == " "))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            x = _matrix(batch, text, shared.value)
            yield pa.RecordBatch.from_arrays([batch["key"], batch["label"], pa.array(x.tolist(), pa.list_(pa.float64()))], names=["key", "label", "x"])

    rows = sample.mapInArrow(measure, "key long, label int, x array<double>").toPandas().sort_values("key")
    x, y = np.array(rows.x.tolist()).reshape(-1, len(FEATURES)), (rows.label == 1).to_numpy(np.float64)
    fit = rows.key.to_numpy(np.int64) % 3 != 0
    model.trees = boosted_trees(x[fit], y[fit])
    hold = ~fit if y[~fit].any() and not y[~fit].all() else np.ones(len(y), bool)
    model.curve = isotonic(model.trees(x[hold]), y[hold], np.ones(hold.sum()))
    return model


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score", keep_text: bool = True) -> DataFrame:
    """docs with a calibrated score from 0 to 1.

    A null text counts as empty; empty texts have the score of a text without hits. Without a trained model, a text
    scores 1 if it holds a fixed insult, else 0. Other columns and repeated rows pass unchanged; a column of docs that is
    named like the result is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(out)
    fields = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*fields, T.StructField(out, T.DoubleType())])

    def run(batches):
        for batch in batches:
            m = shared.value
            x = _matrix(batch, text, m)
            s = m.curve(m.trees(x)) if m.trees else (x[:, 0] > 0).astype(float)
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in fields), pa.array(s, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)
