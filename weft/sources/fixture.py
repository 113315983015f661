"""The small demonstration graph."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from weft.functions.exprs import COLOURS, DEFAULT_COLOUR

#: Names and types of the demonstration nodes, n1 to n20.
NODES = (
    ("Emotet", "malware"), ("APT28", "threat-actor"), ("Spear Phishing", "attack-pattern"), ("Operation Ghostnet", "campaign"),
    ("MiniDuke", "malware"), ("CVE-2021-44228", "vulnerability"), ("Cobalt Strike", "tool"), ("Fancy Bear", "threat-actor"),
    ("ACME Corp", "identity"), ("Moscow, Russia", "location"), ("Log4Shell Exploit", "attack-pattern"), ("DarkSide", "malware"),
    ("REvil", "threat-actor"), ("Colonial Pipeline", "campaign"), ("Mimikatz", "tool"), ("CVE-2022-30190", "vulnerability"),
    ("North Korea (DPRK)", "location"), ("Lazarus Group", "threat-actor"), ("WannaCry", "malware"), ("SolarWinds Attack", "campaign"),
)
#: Source, target and label of the demonstration edges, e1 to e15.
EDGES = (
    (2, 3, "uses"), (2, 1, "uses"), (4, 2, "attributed-to"), (2, 9, "targets"), (5, 4, "indicates"), (11, 6, "uses"),
    (8, 7, "uses"), (8, 2, "related-to"), (13, 14, "attributed-to"), (12, 14, "uses"), (15, 13, "uses"),
    (18, 17, "attributed-to"), (19, 18, "attributed-to"), (20, 9, "targets"), (2, 10, "attributed-to"),
)


def generator(seed: int) -> Iterator[float]:
    """A 32-bit linear congruential generator over [0, 1] (multiplier 1664525, increment 1013904223)."""
    state = seed
    while True:
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        yield state / 0xFFFFFFFF


def graph_fixture(spark: SparkSession, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Twenty nodes and fifteen edges, the same on each call."""
    draw = generator(seed)
    nodes = []
    for i, (label, kind) in enumerate(NODES):
        x, y, size = round(next(draw) * 500), round(next(draw) * 500), 5 + round(next(draw) * 10)
        nodes.append((f"n{i + 1}", label, kind, x, y, size, COLOURS.get(kind, DEFAULT_COLOUR), round(0.5 + next(draw) * 0.5, 2), i % 4))
    edges = [(f"e{i + 1}", f"n{a}", f"n{b}", label) for i, (a, b, label) in enumerate(EDGES)]
    return (
        spark.createDataFrame(nodes, "id string, label string, stix_type string, x int, y int, size int, colour string, confidence double, community int"),
        spark.createDataFrame(edges, "id string, source string, target string, label string"),
    )
