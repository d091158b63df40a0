"""Boolean search over an item's own fields and its related rows, fuzzy candidates and ranking.

A query is built from the classes below, by hand or from what a user typed. Related rows become one array per field,
so that items are never multiplied.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity


@dataclass(frozen=True)
class Word:
    """A phrase in any of the free-text fields, whatever its case."""

    text: str


@dataclass(frozen=True)
class Field:
    """A condition on one field: ``=`` equality, ``~`` containment, both whatever their case, their negations ``!=`` and
    ``!~``, which a field without a value meets, or ``set``."""

    name: str
    op: str
    value: str = ""


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


_TYPED = re.compile(r'\s*(?:(?P<sign>\(|\)|-(?=\S)|!(?![=~]))|(?P<op>!=|!~|=|~)|"(?P<quoted>[^"]*)"?|(?P<bare>(?:(?!!=|!~)[^\s()=~"])+))')


def typed(text: str, aliases: dict[str, str] | None = None):
    """The query that a user typed, or None if there is nothing to search for.

    Words must all occur, unless ``or`` stands between them, which binds less than ``and``; ``not``, ``-`` and ``!`` exclude;
    quotes make a phrase, parentheses group; ``field = x``, ``!=``, ``~`` and ``!~`` ask one field, ``set field`` for any value.
    What is left open at the end counts as closed; an operator without a field or a value is taken as a word.
    """
    marks = [m for m in _TYPED.finditer(text) if m[0].strip()]
    at = 0

    def word(k: int, *wanted: str) -> bool:
        return k < len(marks) and (marks[k]["bare"] or marks[k]["sign"] or "").lower() in wanted

    def is_term(k: int) -> bool:
        return k < len(marks) and marks[k]["sign"] is None and marks[k]["op"] is None

    def value(k: int) -> str:
        return marks[k]["quoted"] if marks[k]["quoted"] is not None else marks[k]["bare"]

    def one():
        nonlocal at
        if word(at, "not", "-", "!") and at + 1 < len(marks):
            at += 1
            inner = one()
            return inner and Not(inner)
        if word(at, "("):
            at += 1
            inner = any_of()
            at += word(at, ")")
            return inner
        if word(at, "set") and is_term(at + 1):
            at += 2
            return Field(named(value(at - 1)), "set")
        if is_term(at) and at + 2 < len(marks) and marks[at + 1]["op"] and is_term(at + 2):
            at += 3
            return Field(named(value(at - 3)), marks[at - 2]["op"], value(at - 1))
        at += 1
        return Word(value(at - 1) if is_term(at - 1) else marks[at - 1][0].strip())

    def named(name: str) -> str:
        return (aliases or {}).get(name.lower(), name.lower())

    def all_of():
        nonlocal at
        parts = []
        while at < len(marks) and not word(at, "or", ")"):
            if word(at, "and"):
                at += 1
            elif part := one():
                parts.append(part)
        return And(tuple(parts)) if len(parts) > 1 else parts[0] if parts else None

    def any_of():
        nonlocal at
        parts = [all_of()]
        while word(at, "or"):
            at += 1
            parts.append(all_of())
        parts = [p for p in parts if p]
        return Or(tuple(parts)) if len(parts) > 1 else parts[0] if parts else None

    found = []
    while at < len(marks):
        found.append(any_of())
        at += word(at, ")")  # one that closes nothing
    found = [p for p in found if p]
    return And(tuple(found)) if len(found) > 1 else found[0] if found else None


def fuzzy_term(text: str) -> str | None:
    """The single plain word of three letters at least that a fuzzy search can take, else None."""
    low = text.strip().lower()
    return low if len(low) >= 3 and low.isalnum() and low not in ("and", "not") else None


def _test(column: Column, op: str, value: str) -> Column:
    low = F.lower(column)
    hit = {"=": low == value.lower(), "~": low.contains(value.lower()), "set": column.isNotNull() & (column != "")}[op]
    return F.coalesce(hit, F.lit(False))


def condition(query, columns: dict[str, str], related: dict[str, str], free: list[str]) -> Column:
    """The query as a predicate. columns: field to column; related: field to array column; free: fields that words look in."""

    def one(name: str, op: str, value: str) -> Column:
        if op[0] == "!":
            return ~one(name, op[1:], value)
        if name in related:
            return F.coalesce(F.exists(related[name], lambda x: _test(x, op, value)), F.lit(False))
        return _test(F.col(columns[name]), op, value)

    if isinstance(query, Word):
        return reduce(Column.__or__, [one(f, "~", query.text) for f in free])
    if isinstance(query, Field):
        return one(query.name, query.op, query.value)
    if isinstance(query, Not):
        return ~condition(query.part, columns, related, free)
    joined = [condition(p, columns, related, free) for p in query.parts]
    return reduce(Column.__and__ if isinstance(query, And) else Column.__or__, joined)


def with_related(items: DataFrame, key: str, **frames: tuple[DataFrame, str, str]) -> DataFrame:
    """items with an array column of distinct values for each related frame (frame, its key, its value)."""
    for name, (frame, other, value) in frames.items():
        grouped = frame.groupBy(F.col(other).alias(key)).agg(F.collect_set(value).alias(name))
        items = items.join(grouped, key, "left")
    return items


def fuzzy_score(term: str, name: Column, path: Column | None = None) -> Column:
    """How well one term fits: the greatest of trigram scores and 1, 0.85 or 0.7 for a name word at distance 0, 1 or 2."""
    distance = similarity.nearest_word(term, name)
    edits = F.when(distance == 0, 1.0).when(distance == 1, 0.85).when(distance == 2, 0.7).otherwise(0.0)
    scores = [f(*x) for c in (name, path) if c is not None for f, x in ((similarity.trigram_similarity, (F.lit(term), c)), (similarity.word_similarity, (F.lit(term), c)))]
    return F.greatest(edits, *scores)


def fuzzy(items: DataFrame, term: str, name: str, least: float = 0.5, score: str = "score", path: str | None = None, first: int | None = None, key: str = "id") -> DataFrame:
    """Items that fit the term at least so well, with their score. Terms that fuzzy_term() rejects find nothing.

    With first, only so many hits are kept, those with the smallest keys, whatever their score.
    """
    word = fuzzy_term(term)
    if word is None:
        return items.where(F.lit(False)).withColumn(score, F.lit(0.0))
    found = items.withColumn(score, fuzzy_score(word, F.col(name), F.col(path) if path else None)).where(F.col(score) >= least)
    return found if first is None else found.orderBy(key).limit(first)


def fuzzy_many(items: DataFrame, terms: DataFrame, name: str, least: float = 0.5, term: str = "term", score: str = "score", path: str | None = None) -> DataFrame:
    """(term, items' columns, score): the items that each of a table of terms fits at least so well, as fuzzy() scores them.

    Distinct names and words are indexed by their trigrams once for all terms, so that items are not read for each term;
    near words are those with a term's first letter and about its length. Terms that fuzzy_term() rejects find nothing.
    """
    low = F.lower(F.trim(F.col(term)))
    asked = terms.select(F.col(term).alias("l"), low.alias("w")).where((F.length("w") >= 3) & F.col("w").rlike(r"^[\p{L}\p{N}]+$") & ~F.col("w").isin("and", "not")).distinct()
    wanted = asked.select("l", similarity.trigrams(F.col("w")).alias("members"))
    texts = None
    for column, edits in ((name, True), *([(path, False)] if path else [])):
        own = items.select(F.col(column).alias("text"), F.lit(edits).alias("edits")).where("text is not null").distinct()
        texts = own if texts is None else texts.unionByName(own)
    texts = texts.groupBy("text").agg(F.max("edits").alias("edits"))
    whole = similarity.similar_sets(wanted, texts.select(F.col("text").alias("r"), similarity.trigrams(F.col("text")).alias("members")), least).withColumnRenamed("r", "text")
    within = texts.select("text", "edits", F.explode(F.array_distinct(similarity.words(F.col("text")))).alias("word"))
    words = within.select("word").distinct()
    alike = similarity.similar_sets(wanted, words.select(F.col("word").alias("r"), similarity.trigrams(F.col("word")).alias("members")), least)
    alike = alike.select("l", F.col("r").alias("word"), "score", F.lit(False).alias("edits"))
    lengths = F.explode(F.sequence(F.greatest(F.length("w") - 1, F.lit(3)), F.length("w") + 1)).alias("length")
    near = asked.select("l", "w", F.substring("w", 1, 1).alias("begin"), lengths).join(words.select("word", F.substring("word", 1, 1).alias("begin"), F.length("word").alias("length")), ["begin", "length"])
    distance = F.levenshtein("word", "w", 2)
    worth = F.when(distance == 0, 1.0).when(distance == 1, 0.85).when(distance == 2, 0.7)
    near = near.select("l", "word", worth.alias("score"), F.lit(True).alias("edits")).where(F.col("score") >= least)
    found = alike.unionByName(near).withColumnRenamed("edits", "by_edits").join(within, "word").where("edits or not by_edits")
    scored = whole.select("l", "text", "score").unionByName(found.select("l", "text", "score")).groupBy("l", "text").agg(F.max("score").alias("_score"))
    scored = scored.withColumnRenamed("l", "_term")
    hits = items.join(scored, F.col(name) == F.col("text")).select("_term", items["*"], "_score")
    if path:
        by_path = items.join(scored, F.col(path) == F.col("text")).select("_term", items["*"], "_score")
        hits = hits.unionByName(by_path)
        hits = hits.groupBy("_term", *items.columns).agg(F.max("_score").alias("_score"))
    return hits.withColumnRenamed("_term", term).withColumnRenamed("_score", score)
