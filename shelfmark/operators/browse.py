"""Orders, windows and pages. Every order ends in the key, so that pages are stable; nulls sort as PostgreSQL has them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALLEST, DEFAULT, LARGEST, FURTHEST = 1, 48, 96, 1_000_000


def order(name: str, key: str, created: str = "created_at", updated: str = "updated_at", label: str = "name", seed: str = "") -> list[Column]:
    """Sort columns for ``recent``, ``updated``, ``name`` or ``random`` (stable for a seed); else by key alone."""
    by = {
        "recent": [F.col(created).desc_nulls_first()] if created else [],
        "updated": [F.col(updated).desc_nulls_first()] if updated else [],
        "name": [F.lower(label).asc_nulls_last()],
        "random": [F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary"))],
    }
    return [*by.get(name, []), F.col(key).asc()]


@dataclass(frozen=True)
class Window:
    """An offset window, clamped to the limits above."""

    offset: int = 0
    size: int = DEFAULT

    @classmethod
    def of(cls, offset=None, size=None) -> Window:
        def number(x, default: int) -> int:
            return int(x) if str(x or "").strip().lstrip("-").isdigit() else default

        return cls(min(max(number(offset, 0), 0), FURTHEST), min(max(number(size, DEFAULT), SMALLEST), LARGEST))

    def cut(self, df: DataFrame, by: list[Column]) -> DataFrame:
        """The rows of the window."""
        return df.orderBy(*by).offset(self.offset).limit(self.size)

    def page(self, df: DataFrame, by: list[Column], total: str = "total", more: str = "has_more") -> DataFrame:
        """The rows of the window with the count of all rows, and whether rows follow; the count is one more aggregation."""
        count = df.agg(F.count("*").alias(total))
        return self.cut(df, by).join(F.broadcast(count)).withColumn(more, F.col(total) > self.offset + self.size)


def links(window: Window, total: Column) -> Column:
    """A struct of page numbers, from 1: of the window's page, the first, the previous and the next, where there are such, and the last."""
    page, last = window.offset // window.size + 1, F.greatest(F.ceil(total / window.size), F.lit(1)).cast("long")
    here = F.lit(page).cast("long")
    previous = F.when(here > 1, F.least(here - 1, last))
    return F.struct(here.alias("page"), F.lit(1).cast("long").alias("first"), previous.alias("previous"), F.when(here < last, here + 1).alias("next"), last.alias("last"))


def after(df: DataFrame, key: str, cursor, size: int) -> DataFrame:
    """A keyset page: the next rows by key after the cursor."""
    return df.where(F.col(key) > cursor).orderBy(key).limit(size)


def timeline(frames: dict[str, tuple[DataFrame, str, str]], n: int = 20) -> DataFrame:
    """(kind, id, at): the newest rows of several frames (frame, id, time), n from each and then n of all."""
    parts = [df.select(F.lit(kind).alias("kind"), F.col(i).cast("long").alias("id"), F.col(at).alias("at")) for kind, (df, i, at) in frames.items()]
    by = [F.col("at").desc_nulls_last(), "kind", "id"]
    out = None
    for part in parts:
        top = part.orderBy(*by).limit(n)
        out = top if out is None else out.unionByName(top)
    return out.orderBy(*by).limit(n)
