"""What users of the engine plug in: libraries to read from, enrichers to ask, and runs that give way to newer ones."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Protocol, TypeVar, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmesh.functions import ids
from litmesh.operators.resolve import enrich
from litmesh.session import stage

T = TypeVar("T")

#: Columns that each table of a library needs: fixed values.
TABLES = {"items": ("key", "item_id", "seq", "synced_at", "title", "doi", "date"), "attachments": ("att_key", "parent_key", "content_type"), "texts": ("att_key", "text"), "uris": ("att_key", "uris")}


@runtime_checkable
class Library(Protocol):
    """A source of held works: four tables, each a DataFrame that nothing has computed yet."""

    def items(self) -> DataFrame: ...
    def attachments(self) -> DataFrame: ...
    def texts(self) -> DataFrame: ...
    def uris(self) -> DataFrame: ...


def checked(library: Library) -> Library:
    """The library if it has its four tables with the columns they need; else an error that names what lacks."""
    if not isinstance(library, Library):
        raise TypeError(f"a library needs the methods {', '.join(TABLES)}")
    for name, wanted in TABLES.items():
        lacks = [c for c in wanted if c not in getattr(library, name)().columns]
        if lacks:
            raise ValueError(f"table {name} lacks {', '.join(lacks)}")
    return library


@dataclass(frozen=True)
class Enricher:
    """Looks works up: `resolve` takes (key) of the namespaces it supports and gives metadata rows; it may raise `Partial` with what it got."""

    id: str
    supports: tuple[str, ...]
    resolve: Callable[[DataFrame], DataFrame]


class Partial(Exception):
    """An enricher failed on the way; `answers` is what it has."""

    def __init__(self, message: str, answers: DataFrame | None = None):
        super().__init__(message)
        self.answers = answers


def enriched(keys: DataFrame, enrichers: Iterable[Enricher]) -> tuple[DataFrame, dict[str, str]]:
    """(metadata, errors): the keys filled by the enrichers in turn, each asked only for what is still incomplete.

    One that fails is named in the errors and its partial answers count; the next is asked for the rest."""
    errors, answers = {}, []
    out = enrich(keys)
    for e in enrichers:
        asked = out.where((F.col("title").isNull() | F.col("cited_by_global").isNull()) & ids.namespace(F.col("key")).isin(*e.supports)).select("key")
        try:
            got = stage(e.resolve(asked))
        except Exception as failure:  # noqa: BLE001 - one enricher's failure is no other's
            errors[e.id] = str(failure)
            if not isinstance(failure, Partial) or failure.answers is None:
                continue
            got = stage(failure.answers)
        answers.append((got, e.supports))
        out = enrich(keys, *answers)
    return out, errors


class Newest:
    """Runs of which only the newest counts: starting one interrupts the Spark jobs of the one before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.generation, self.lock = spark, name, 0, threading.Lock()

    def run(self, work: Callable[[Callable[[], bool]], T]) -> T | None:
        """What `work` gives, or None if a newer run began meanwhile. `work` gets a function that tells whether it is still the newest."""
        with self.lock:
            self.generation += 1
            mine = self.generation
        if mine > 1:
            self.spark.interruptTag(f"{self.name}-{mine - 1}")
        tag = f"{self.name}-{mine}"
        self.spark.addTag(tag)
        try:
            result = work(lambda: mine == self.generation)
        except Exception:
            if mine == self.generation:
                raise
            return None
        finally:
            self.spark.removeTag(tag)
        return result if mine == self.generation else None


class Throttle:
    """Passes reports on at most once in `every` seconds; `done` passes on the last one held back."""

    def __init__(self, report: Callable[..., None], every: float = 0.2, clock: Callable[[], float] = time.monotonic):
        self.report, self.every, self.clock, self.last, self.held = report, every, clock, float("-inf"), None

    def __call__(self, *args) -> None:
        now = self.clock()
        if now - self.last >= self.every:
            self.last, self.held = now, None
            self.report(*args)
        else:
            self.held = args

    def done(self) -> None:
        if self.held is not None:
            self.report(*self.held)
            self.held = None
