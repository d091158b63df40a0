"""Language identification by prediction by partial matching.

A language's model is a tree of byte contexts of up to three bytes, with frozen counts. A byte's probability at a
context is its share of the counts if it was seen there, else the escape probability (distinct bytes seen over
counts and distinct bytes) times its probability at the next shorter context, with the bytes of the longer context
excluded; the empty context escapes to equal shares. A text's score is its exact code length under each tree; A-Z count as
a-z.

Since the counts are frozen, the trees of all languages become one table of contexts: each has the code lengths of the
bytes that it was seen with, and the bits of its escape. Scoring looks up a byte at its longest known context, and at
shorter ones as far as it escapes. All contexts of the sample are kept; the sample bounds the table's size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import free_name, lean, text_buffers

#: Bytes before a text, as its context.
PAD = 3
#: Positions that are scored together.
WINDOW = 100_000
UNKNOWN = "und"


@dataclass
class Contexts:
    """The contexts of all orders. Of bytes that any language saw at a context, bits holds the code lengths; others add
    the context's escape and go on at its parent. Entries lie in order of context and byte: a context's four words of
    bits tell which bytes it has, starts where each word's entries begin."""

    node_of: np.ndarray  # by context of three bytes: its longest known one
    words: np.ndarray
    starts: np.ndarray
    parent: np.ndarray
    escape: np.ndarray
    bits: np.ndarray

    def look_up(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Code lengths of bytes at contexts, by language."""
        at, low = node * 4 + (byte >> 6), (byte & 63).astype(np.uint64)
        word = self.words[at]
        entry = self.starts[at] + np.bitwise_count(word & ((np.uint64(1) << low) - np.uint64(1)))
        missing = np.flatnonzero(~(word >> low & np.uint64(1)).astype(bool))
        entry[missing] = 0
        out = self.bits[entry]
        if len(missing):
            top = node[missing] == 0
            rest = np.full((len(missing), out.shape[1]), 8.0, np.float32)  # the empty context escapes to equal shares
            if not top.all():
                rest[~top] = self.look_up(self.parent[node[missing][~top]], byte[missing][~top])
            out[missing] = self.escape[node[missing]] + rest
        return out


@dataclass
class PpmModel:
    """Counts of (context of three bytes, byte) by language; codes are the four bytes, the context first."""

    langs: list[str]
    lang: np.ndarray
    code: np.ndarray
    count: np.ndarray
    _tables: Contexts | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def tables(self) -> Contexts:
        if self._tables is None:
            self._tables = self._build()
        return self._tables

    def _build(self) -> Contexts:
        context, byte, many = self.code >> 8, self.code & 255, len(self.langs)
        node_of = np.zeros((256, 256, 256), np.int32)
        words, parent, escape, bits, first, size = [], [], [], [], 0, []
        for order in range(4):
            mask, short = (1 << 8 * order) - 1, (1 << 8 * max(order - 1, 0)) - 1
            entry, at = np.unique((context & mask) << 8 | byte, return_inverse=True)
            count = np.bincount(at * many + self.lang, self.count, len(entry) * many).reshape(-1, many)
            own, node = np.unique(entry >> 8, return_inverse=True)
            total = lambda v: np.stack([np.bincount(node, v[:, k], len(own)) for k in range(many)], axis=1)  # noqa: B023, E731
            if order:
                up = np.searchsorted(known, own & short)  # noqa: F821
                shorter, mass = p[np.searchsorted(entries, (entry >> 8 & short) << 8 | entry & 255)], masses[up]  # noqa: F821
                parent.append(first - size[-1] + up)
            else:
                shorter, mass = np.full((len(entry), many), 1 / 256), np.ones((len(own), many))
                parent.append(np.zeros(len(own), np.int64))
            seen, n, distinct = count > 0, total(count), total(count > 0)
            left = mass - total(np.where(seen, shorter, 0))
            escapes = (distinct < 256) & (left > 1e-12)
            whole = np.maximum(n + np.where(distinct < 256, distinct, 0), 1)
            share = np.where(n > 0, np.where(escapes, distinct / whole / np.where(escapes, left, 1), 0), 1)
            p = np.where(seen, count / whole[node], share[node] * shorter)
            masses = np.where(n > 0, n / whole + np.where(escapes, distinct / whole, 0), mass)
            word = np.zeros(4 * len(own), np.uint64)
            np.bitwise_or.at(word, node * 4 + (entry & 255) // 64, np.uint64(1) << (entry & 63).astype(np.uint64))
            if order == 1:
                node_of[:, :, own] = np.arange(len(own)) + first
            elif order == 2:
                node_of[:, own >> 8, own & 255] = np.arange(len(own)) + first
            elif order == 3:
                node_of[own >> 16, own >> 8 & 255, own & 255] = np.arange(len(own)) + first
            words.append(word)
            escape.append(-np.log2(np.maximum(share, 1e-30)).astype(np.float32))
            bits.append(-np.log2(np.maximum(p, 1e-30)).astype(np.float32))
            known, entries = own, entry
            first += len(own)
            size.append(len(own))
        words = np.concatenate(words)
        held = np.bitwise_count(words).astype(np.int64)
        return Contexts(node_of.reshape(-1), words, np.cumsum(held) - held, np.concatenate(parent), np.concatenate(escape), np.concatenate(bits))

    def code_lengths(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bits of each text under each language; texts are data[ends[i]:ends[i + 1]]."""
        tables = self.tables()
        docs = len(ends) - 1
        buffer = np.zeros(len(data) + PAD * docs, np.uint8)
        lo, hi = ends[:-1] + PAD * np.arange(1, docs + 1), ends[1:] + PAD * np.arange(1, docs + 1)
        inside = np.ones(len(buffer), bool)
        for k in range(1, PAD + 1):
            inside[lo - k] = False
        buffer[inside] = data
        out = np.zeros((docs, len(self.langs)))
        for a in range(PAD, len(buffer), WINDOW):
            b = min(a + WINDOW, len(buffer))
            part = buffer[a - PAD : b].astype(np.uint32)
            node = tables.node_of[part[:-3] << 16 | part[1:-2] << 8 | part[2:-1]].astype(np.int64)
            total = np.zeros((b - a + 1, len(self.langs)))
            np.cumsum(tables.look_up(node, part[3:].astype(np.int64)), axis=0, dtype=np.float64, out=total[1:])
            d, e = np.searchsorted(hi, a, "right"), np.searchsorted(lo, b)
            out[d:e] += total[np.minimum(hi[d:e], b) - a] - total[np.maximum(lo[d:e], a) - a]
        return out


def train(labelled: DataFrame, lang: str = "lang", text: str = "text", id_col: str = "doc_id", max_bytes: int = 1_500_000) -> PpmModel:
    """A model from rows with a text and a language.

    The sample is bounded by max_bytes of text a language, about: a hash of id and text picks rows, whole, in the
    share that the bound leaves, and at least the row with the smallest hash, so that a language of a few very long
    texts is learned too. It holds whatever the input's size; the number of languages is taken as small.
    """
    lean()
    labelled = labelled.where(F.col(text).isNotNull() & (F.col(text) != "") & F.col(lang).isNotNull()).select(id_col, lang, text)
    place = F.pmod(F.xxhash64(id_col, text), F.lit(1 << 40))
    sizes = {r[0]: r[1:] for r in labelled.groupBy(lang).agg(F.sum(F.octet_length(text)), F.min(place)).collect()}
    langs = sorted(sizes)
    if not langs:
        return PpmModel([], *(np.zeros(0, np.int64),) * 3)
    border = F.create_map(*[F.lit(v) for x in langs for v in (x, max(int(min(1.0, max_bytes / sizes[x][0]) * (1 << 40)), sizes[x][1] + 1))])
    picked = labelled.where(place < border[F.col(lang)])

    def count(batches):
        for batch in batches:
            names = batch[lang].to_pylist()
            data, ends = lowered(batch[text])
            for name in sorted(set(names)):
                grams = []
                for k in (i for i, x in enumerate(names) if x == name):
                    b = np.concatenate((np.zeros(PAD, np.uint32), data[ends[k] : ends[k + 1]]))
                    grams.append(b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:])
                code, n = np.unique(np.concatenate(grams).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code), pa.array(n)], names=["lang", "code", "n"])

    grams = picked.select(lang, text).mapInArrow(count, "lang string, code long, n long")
    table = grams.groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas().sort_values(["lang", "code"])
    table = table[table.lang.isin(langs)]
    number = table.lang.map({x: i for i, x in enumerate(langs)})
    return PpmModel(langs, number.to_numpy(np.int64), table.code.to_numpy(np.int64), table.n.to_numpy(np.int64))


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts with A-Z in lower case, and their offsets."""
    data, ends = text_buffers(column)
    return np.where((data >= 65) & (data <= 90), data | 32, data), ends


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: PpmModel, text: str = "text", lang_pred: str = "lang_pred", score: str = "score", keep_text: bool = True) -> DataFrame:
    """docs with the language of the shortest code and its share of the likelihood (ties: the first name).

    A null text, a text without a letter, or a model without languages gives ``und`` and score 0. Other columns and
    repeated rows pass unchanged; columns of docs that are named like the two results are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(lang_pred, score)
    letter = free_name(docs, "_letter")
    fields = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches):
        m = shared.value
        names = np.array([*m.langs, UNKNOWN], object)
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                known = np.array(batch[letter].to_pylist(), bool)
                best, share = np.full(batch.num_rows, len(m.langs)), np.zeros(batch.num_rows)
                if m.langs:
                    bits = m.code_lengths(*lowered(batch[text]))
                    best = np.where(known, bits.argmin(axis=1), best)
                    odds = np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000))
                    share = np.where(known, 1 / odds.sum(axis=1), 0)
                out = [pa.array(names[best], pa.string()), pa.array(share)]
                yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in fields), *out], names=schema.names)

    return docs.withColumn(letter, has_letter(text)).mapInArrow(run, schema)
