"""The three stages of an intake, as protocols, and traditions registered under a name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from folium.operators.segments import segment_lines


class Acquirer(Protocol):
    def __call__(self, spark: SparkSession, location: str) -> DataFrame: ...


class Normalizer(Protocol):
    def __call__(self, raw: DataFrame) -> DataFrame: ...


class Segmenter(Protocol):
    def __call__(self, texts: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Tradition:
    """Files to raw rows, raw rows to texts (doc_id, text), texts to segments."""

    acquire: Acquirer
    normalize: Normalizer
    segment: Segmenter = segment_lines


_TRADITIONS: dict[str, Tradition] = {}


def register(name: str, tradition: Tradition) -> None:
    if name in _TRADITIONS:
        raise ValueError(f"{name} is registered already")
    _TRADITIONS[name] = tradition


def intake(spark: SparkSession, name: str, location: str, check: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Segments of what lies at a location, by the stages of a tradition; `check` may refuse the texts before they are cut."""
    if name not in _TRADITIONS:
        raise ValueError(f"no tradition is called {name}; there are {sorted(_TRADITIONS)}")
    t = _TRADITIONS[name]
    texts = t.normalize(t.acquire(spark, location))
    if check:
        check(texts)
    return t.segment(texts)
