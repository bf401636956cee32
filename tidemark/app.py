"""Applications: a class that sets properties and builds its streams; the runner starts every query it declares."""

from __future__ import annotations

import sys
from abc import ABC, abstractmethod
from typing import Any

from pyspark.sql import SparkSession

from tidemark.properties import Properties


class StreamApp(ABC):
    def prepare_properties(self, properties: Properties) -> None:
        """Set defaults; command-line values win."""

    @abstractmethod
    def build_stream(self, spark: SparkSession, properties: Properties) -> Any:
        """Declare streams and sinks. Returns streaming queries, or the results of bounded ones."""

    def on_start(self, spark: SparkSession, properties: Properties) -> None:
        """Called once before the streams are built."""


def parse_args(args: list[str]) -> Properties:
    """``key=value`` and ``--key value`` arguments."""
    out, rest = Properties(), list(args)
    while rest:
        a = rest.pop(0)
        if a.startswith("--") and "=" not in a:
            if not rest:
                raise ValueError(f"{a} has no value")
            out.set(a[2:], rest.pop(0))
        elif "=" in a:
            k, v = a.removeprefix("--").split("=", 1)
            out.set(k, v)
        else:
            raise ValueError(f"not key=value: {a}")
    return out


def execute(app: StreamApp, args: list[str] | None = None, spark: SparkSession | None = None) -> Any:
    given = parse_args(sys.argv[1:] if args is None else args)
    properties = Properties()
    app.prepare_properties(properties)
    properties.values |= given.values
    if spark is None:
        builder = SparkSession.builder
        if "application.name" in properties.values:
            builder = builder.appName(properties.application_name)
        for k, v in properties.spark_conf().items():
            builder = builder.config(k, v)
        spark = builder.getOrCreate()
    app.on_start(spark, properties)
    return app.build_stream(spark, properties)
