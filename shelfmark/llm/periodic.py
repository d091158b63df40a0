"""Periodic runs of words, by bit-parallel lags.

Word ids of many texts, a separator after each, are laid out as bit planes: big integers, one for each bit of an id.
A lag exclusive-ors each plane with itself shifted by the lag and ors what differs; zero bits are words that equal the
word so far behind them. And-ing the matches with themselves, shifted by ever doubled steps, leaves a bit exactly
where enough matches in a row begin. A stretch of matches at a lag is a run with that period, unless a smaller lag
gave the same words, whose period then divides this one.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._shared import text_buffers

#: A run has so many words at least, and so many periods.
LEAST, PERIODS = 24, 3
#: Words that are laid out in one integer; a longer text has one for itself.
PACK = 32_768
#: Planes that a lag looks at first; the others only where these leave a long stretch of matches.
FIRST_PLANES = 4
#: Texts of more words look only at lags at which long equal word sequences follow each other, since their lags are as many as a third of their words.
LONG = 4096

Run = tuple[int, int, int]


def _planes(ids: np.ndarray) -> list[int]:
    """Big integers of the bits of ids, the lowest bits first."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    return [int.from_bytes(np.packbits((ids >> k) & 1, bitorder="little").tobytes(), "little") for k in range(bits)]


def _long_enough(matches: int, length: int) -> int:
    """Bits at which so many ones in a row begin."""
    have = 1
    while have < length and matches:
        step = min(have, length - have)
        matches &= matches >> step
        have += step
    return matches


def _ones(bits: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of ones."""
    flat = np.unpackbits(np.frombuffer(bits.to_bytes(width // 8 + 1, "little"), np.uint8), bitorder="little").astype(np.int8)
    edge = np.diff(flat, prepend=0, append=0)
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1) - start


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dense ranks of keys, places in the order of keys, then place, which of these has the key of the one before), for keys below the square of their number."""
    n = np.uint64(len(keys))
    if len(keys) < 1 << 21:  # key and place fit into one integer
        both = np.sort(keys * n + np.arange(len(keys), dtype=np.uint64))
        place = (both % n).astype(np.int64)
        own = both // n
    else:
        place = np.argsort(keys, kind="stable")
        own = keys[place]
    same = own[1:] == own[:-1]
    ranks = np.empty(len(keys), np.uint64)
    ranks[place] = np.concatenate((np.zeros(1, np.uint64), np.cumsum(~same).astype(np.uint64)))
    return ranks, place, same


def _lags(ids: np.ndarray, least: int, periods: int) -> list[int]:
    """The lags that can be the period of a run: all of which two equal word sequences, one next after the other, are that far apart.

    A run with a lag q for its smallest period repeats each of its sequences of more than q words after q words, and not
    before, as it would have a smaller period then; and with three periods it has room for sequences as long as the next
    power of two.
    """
    found: set[int] = set()
    (h, place, same), width = _ranked(ids.astype(np.uint64)), 1
    largest = len(ids) // periods
    if periods < 3:
        return list(range(1, largest + 1))
    # The longest sequence, by powers of two, that every run has room for.
    first = 1 << (min(max(least - q, (periods - 1) * q) for q in range(1, least + 1)).bit_length() - 1)
    while width <= max(2 * largest, first) and len(h):
        lowest = 1 if width == first else width // 2
        if width >= first:
            apart = np.diff(place)[same]
            found.update(np.unique(apart[(apart >= lowest) & (apart < width) & (apart <= largest)]).tolist())
        if len(h) <= width:
            break
        # Pairs of ids name sequences of twice the words, without hashes.
        h, place, same = _ranked(h[:-width] * (h.max() + np.uint64(1)) + h[width:])
        width *= 2
    return sorted(found)


def find_runs(texts: list[np.ndarray], least: int = LEAST, periods: int = PERIODS) -> list[list[Run]]:
    """(start, length, period) of the runs of each text of word ids, by start, then period.

    A run is a stretch of max(least, periods * period) words at least in which words one period apart are equal, with
    no smaller period, and which no neighbouring word continues. Texts share a layout, and ids must mean the same in all.
    """
    out: list[list[Run]] = [[] for _ in texts]
    order = sorted((k for k, t in enumerate(texts) if len(t) >= least), key=lambda k: len(texts[k]))
    while order:
        pack, words = [order.pop()], 0  # the longest first, so that texts of one layout have about as many lags
        words = len(texts[pack[0]]) + 1
        while order and words + len(texts[order[-1]]) < PACK:
            words += len(texts[order[-1]]) + 1
            pack.append(order.pop())
        _pack_runs([texts[k] for k in pack], [out[k] for k in pack], least, periods)
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def _pack_runs(texts: list[np.ndarray], out: list[list[Run]], least: int, periods: int) -> None:
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    joined = np.zeros(int(begin[-1]), np.int64)
    for t, at in zip(texts, begin):
        joined[at : at + len(t)] = t
    _, ids = np.unique(joined, return_inverse=True)
    ids = ids.reshape(-1).astype(np.int64)
    # Each separator is a word of its own, so a stretch of matches between two texts is shorter than the lag.
    ids[begin[1:] - 1] = ids.max() + 1 + np.arange(len(texts))
    planes, n = _planes(ids), len(ids)
    longest = len(texts[0])
    seen: set[tuple[int, int]] = set()
    for lag in _lags(ids, least, periods) if longest > LONG else range(1, longest // periods + 1):
        room = n - lag
        if room < 1:
            break
        needed, differ = max(least, periods * lag) - lag, 0
        full, held = (1 << room) - 1, 0
        for k in range(0, len(planes), FIRST_PLANES):
            for p in planes[k : k + FIRST_PLANES]:
                differ |= p ^ (p >> lag)
            held = _long_enough(~differ & full, needed)
            if not held:
                break
        if held:
            for start, extra in zip(*(x.tolist() for x in _ones(held, n))):
                length = extra - 1 + needed + lag
                if (start, length) not in seen:  # else a smaller period has the same words
                    seen.add((start, length))
                    text = int(np.searchsorted(begin, start, side="right")) - 1
                    out[text].append((start - int(begin[text]), length, lag))


def planted(key: int | None, n: int) -> np.ndarray:
    """Positions of the words of a text of n words after every tenth text, by its key's checksum, was made periodic."""
    at = np.arange(n)
    if key is None or not n:
        return at
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return at
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(at >= a, a + (at - a) % p, at)


def _report(parts: list[bytes], runs: list[Run]) -> tuple:
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    keep = np.ones(len(parts), bool)
    for s, length, q in runs:
        keep[s + q : s + length] = False
    collapsed = b" ".join([w for w, k in zip(parts, keep.tolist()) if k]) if runs else b" ".join(parts)
    own = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *own, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())


SCHEMA = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _texts(batches, plant: bool):
    """(ids of rows, words of rows, word ids of rows) of parts of batches, of about a megabyte of text each."""
    for batch in batches:
        data, ends = text_buffers(batch["text"])
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + (1 << 20), side="right")) - 1)
            raw, ids = data[ends[lo] : ends[hi]].tobytes(), batch["id"].slice(lo, hi - lo)
            of: dict[bytes, int] = {}
            words, coded, known = [], [], 0
            for a, b, key in zip(ends[lo:hi] - ends[lo], ends[lo + 1 : hi + 1] - ends[lo], ids.to_pylist()):
                parts = raw[a:b].split()
                code = np.fromiter(map(of.setdefault, parts, itertools.count(known)), np.int64, len(parts))
                known += len(parts)
                if plant:
                    at = planted(key, len(parts))
                    parts, code = [parts[i] for i in at.tolist()], code[at]
                words.append(parts)
                coded.append(code)
            yield ids, words, coded
            lo = hi


def run_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST, periods: int = PERIODS, plant: bool = False) -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each row.

    Words are what blanks, tabs and line ends separate, of whole texts. The run of greatest exact length over period is
    named (ties: the smallest start, then period), with nulls where there is none; runs_sha256 is of all runs, a line
    ``start,length,period`` each, by start, then period; collapsed_sha256 is of the words, joined by blanks, without
    those that a run holds after its first period. With plant, every tenth text is made periodic first (see planted();
    a null id leaves it as it is). Null and empty texts have no words and no runs. Rows are looked at one by one: ties
    and repeated rows give a row each, no rows give none, and other columns are not read. Nothing is shuffled.
    """
    schema = T.StructType([docs.schema[id_col], *[T.StructField(c, T.StringType() if c.endswith("sha256") else T.LongType()) for c in SCHEMA]])
    rows = docs.select(docs[id_col].alias("id"), docs[text].alias("text"))

    def run(batches):
        for ids, words, coded in _texts(batches, plant):
            found = [_report(parts, runs) for parts, runs in zip(words, find_runs(coded, least, periods))]
            columns = [pa.array(list(c), pa.string() if name.endswith("sha256") else pa.int64()) for name, c in zip(SCHEMA, zip(*found))]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=schema.names)

    return rows.mapInArrow(run, schema)


def collapse(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """(id, text, runs) of each row: its words without those that a run holds after its first period, and the runs.

    A text without runs is left as it is, also a null one; runs are structs (start, length, period), by start, then period.
    """
    run_type = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    schema = T.StructType([docs.schema[id_col], T.StructField("text", T.StringType()), T.StructField("runs", run_type)])
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    rows = docs.select(docs[id_col].alias("id"), docs[text].alias("text"))

    def run(batches):
        for batch in batches:
            at = 0
            for ids, words, coded in _texts([batch], False):
                texts, found = batch["text"].slice(at, len(ids)).to_pylist(), find_runs(coded, least, periods)
                for k, (parts, runs) in enumerate(zip(words, found)):
                    if runs:
                        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
                        texts[k] = b" ".join(w for i, w in enumerate(parts) if i not in gone).decode()
                structs = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
                yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string()), pa.array(structs, kind)], names=schema.names)
                at += len(ids)

    return rows.mapInArrow(run, schema)
