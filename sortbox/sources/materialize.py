"""Materialised derived tables.

The mail tables are derived from the driver tables (``bridge``); in a real
deployment they are stored tables.  Each derived table is written once per
application to the shared checkpoint folder and read back, so every later
query scans stored parquet (with column pruning and predicate pushdown)
instead of re-deriving it.  A written table also cuts lineage, which keeps
plans small and survives executor loss.
"""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

_LOCK = threading.RLock()  # builders may materialise the tables they read
_PATHS: dict[tuple[str, str], str] = {}


def enabled() -> bool:
    return os.environ.get("SORTBOX_MATERIALIZE", "1") != "0"


def materialized(spark: SparkSession, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    if not enabled():
        return build()
    app = spark.sparkContext.applicationId
    with _LOCK:
        path = _PATHS.get((app, key))
        if path is None:
            safe = "".join(ch if ch.isalnum() else "_" for ch in key)[-80:]
            path = scratch_path(spark, f"tables/{safe}-{uuid.uuid4().hex[:8]}")
            build().write.mode("errorifexists").parquet(path)
            _PATHS[(app, key)] = path
    return spark.read.parquet(path)
