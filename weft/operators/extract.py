"""Pluggable entity extraction with a rule-based default.

An extractor takes a text and gives ``(type, name)`` pairs. A failing primary
falls back, a failing fallback gives nothing, and no row fails a batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Extractor = Callable[[str], list[tuple[str, str]]]
#: Rules of the default extractor.
RULES = (
    ("indicator", re.compile(r"\b(?:\d{1,3}\.){3}\d{1,3}\b")),
    ("indicator", re.compile(r"\b[\w.+-]+@[\w-]+\.[\w.-]+\w")),
    ("attack-pattern", re.compile(r"\bCVE-\d{4}-\d{4,}\b")),
    ("threat-actor", re.compile(r"\bAPT\d+\b")),
)


def by_rules(text: str) -> list[tuple[str, str]]:
    return sorted({(kind, m) for kind, rule in RULES for m in rule.findall(text)})


def extract(events: DataFrame, event_id: str, text: str, primary: Extractor = by_rules, fallback: Extractor = by_rules) -> DataFrame:
    """``(event_id, stix_type, name)`` for every entity in every text; null texts have none."""
    kind = events.schema[event_id].dataType.simpleString()

    def one(value: str | None) -> list[tuple[str, str]]:
        for extractor in (primary, fallback):
            try:
                return extractor(value or "")
            except Exception:  # isolation of a single text
                continue
        return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(e, k, n) for e, t in zip(batch[event_id], batch[text]) for k, n in one(t)]
            yield pd.DataFrame(rows, columns=["event_id", "stix_type", "name"])

    return events.select(event_id, text).mapInPandas(run, f"event_id {kind}, stix_type string, name string")
