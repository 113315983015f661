"""Source plugins as a Python data source.

A plugin lists its tools and streams the text blocks of a tool call. It is read
with ``spark.read.format("weft_plugin").option("plugin", "module:Class")``; each
tool is one partition, so tools are called side by side on executors. A call
that fails is tried again after growing waits and then fails its task.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weft.functions.exprs import backoff_seconds

BLOCK = "plugin string, tool string, version string, seq int, type string, text string"
ATTEMPTS = 5


class Plugin:
    """What a plugin offers. Subclasses give ``tools`` and ``call``."""

    name = "plugin"
    version = ""

    def tools(self) -> list[str]:
        raise NotImplementedError

    def call(self, tool: str, options: dict[str, str]) -> Iterator[tuple[str, str]]:
        """``(type, text)`` blocks."""
        raise NotImplementedError


class Echo(Plugin):
    """The sample plugin: gives its ``message`` option back, once for each of ``times``."""

    name, version = "echo", "1.0.0"

    def tools(self) -> list[str]:
        return ["echo"]

    def call(self, tool: str, options: dict[str, str]) -> Iterator[tuple[str, str]]:
        for i in range(int(options.get("times", "1"))):
            yield "text", f'{{"text": "{options.get("message", "")}", "n": {i}}}'


def load_plugin(path: str) -> Plugin:
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)()


class _Tool(InputPartition):
    def __init__(self, tool: str):
        self.tool = tool


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.plugin = load_plugin(self.options["plugin"])

    def partitions(self) -> list[InputPartition]:
        wanted = self.options.get("tool")
        return [_Tool(t) for t in self.plugin.tools() if wanted in (None, t)]

    def read(self, partition: _Tool) -> Iterator[tuple]:
        blocks = call_with_retry(self.plugin, partition.tool, self.options, float(self.options.get("wait_scale", "1")))
        for i, (kind, text) in enumerate(blocks):
            yield self.plugin.name, partition.tool, self.plugin.version, i, kind, text


def call_with_retry(plugin: Plugin, tool: str, options: dict[str, str], scale: float = 1.0, attempts: int = ATTEMPTS) -> list[tuple[str, str]]:
    """A call's blocks; a failing call is repeated after the backoff times, ``scale`` times as long."""
    for attempt in range(attempts):
        try:
            return list(plugin.call(tool, options))
        except Exception:
            if attempt + 1 == attempts:
                raise
            time.sleep(scale * backoff_seconds(attempt))
    return []


class PluginSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weft_plugin"

    def schema(self) -> str:
        return BLOCK

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)


def read_plugin(spark: SparkSession, plugin: str, **options: str) -> DataFrame:
    """Text blocks of all tools of a plugin (``module:Class``), or of one ``tool``."""
    spark.dataSource.register(PluginSource)
    return spark.read.format("weft_plugin").options(plugin=plugin, **options).load()


def registry(spark: SparkSession, plugins: dict[str, Plugin], manual: list[tuple[str, str]] = ()) -> DataFrame:
    """``(url, plugin, tool, version)``: the tools of each plugin by its address, then those added by hand."""
    rows = [(url, p.name, tool, p.version) for url, p in plugins.items() for tool in p.tools()]
    rows += [("manual", name, tool, "") for name, tool in manual]
    return spark.createDataFrame(rows, "url string, plugin string, tool string, version string")


def replace_tools(old: DataFrame, new: DataFrame) -> DataFrame:
    """The registry after a listing: a listed plugin's tools are replaced whole, others stay, manual ones add up."""
    listed = new.where("url <> 'manual'").select("url").distinct()
    return old.join(F.broadcast(listed), "url", "left_anti").unionByName(new).distinct()
