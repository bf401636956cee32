"""Counters and gauges: what :meth:`Stream.observed` counts, and rows that Spark's watermark dropped, summed over micro-batches."""

from __future__ import annotations

import time
from collections import defaultdict
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Meters(StreamingQueryListener):
    """Listens to the session's queries. ``counts[name]`` sums each observed number; ``dropped[query]`` the rows Spark held for late;
    ``latest[name]`` has the last micro-batch's values. Use as a context: ``with Meters(spark) as m: ...``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.counts: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(int))
        self.latest: dict[str, dict[str, Any]] = {}
        self.dropped: dict[str, int] = defaultdict(int)

    def __enter__(self) -> Meters:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_: Any) -> None:
        self.spark.streams.removeListener(self)

    def wait(self, name: str, seconds: float = 30) -> None:
        """Until the first numbers of ``name`` have arrived: progress is told by another thread."""
        end = time.monotonic() + seconds
        while name not in self.latest and time.monotonic() < end:
            time.sleep(0.05)

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        for name, row in p.observedMetrics.items():
            values = self.latest[name] = row.asDict()
            for k, v in values.items():
                if isinstance(v, (int, float)) and not isinstance(v, bool):
                    self.counts[name][k] += v
        self.dropped[p.name or str(p.id)] += sum(o.numRowsDroppedByWatermark for o in p.stateOperators)

    def onQueryTerminated(self, event: Any) -> None:
        pass


def measured(df: DataFrame, name: str, *aggs: Any) -> tuple[DataFrame, Observation]:
    """Bounded rows with an observation of aggregates over them: ``.get`` it after an action on the rows."""
    seen = Observation(name)
    return df.observe(seen, *aggs), seen
