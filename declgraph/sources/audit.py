"""The usage log: one JSON object a line, appended under a lock; what cannot be read is skipped."""

from __future__ import annotations

import fcntl
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "timestamp string, operation string, path string, note string, argv array<string>, status string, ms long, _corrupt string"


def append(path: str | Path, event: dict) -> None:
    """Sorted keys; what is None is left out."""
    line = json.dumps({k: v for k, v in event.items() if v is not None}, sort_keys=True)
    with open(path, "a") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        f.write(line + "\n")


def events(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """Readable events with seq (their order in the log) and at (seconds); the last ones only, if asked for."""
    raw = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = raw.withColumn("seq", F.monotonically_increasing_id()).where("_corrupt is null and operation is not null").drop("_corrupt")
    rows = rows.withColumn("at", F.unix_timestamp(F.try_to_timestamp("timestamp")).cast("double"))
    return rows if last is None else rows.orderBy(F.desc("seq")).limit(last).orderBy("seq")


def envelope(command: str, data: list[dict] | dict, tier: str | None = None, warnings: tuple[str, ...] = (), freshness: str | None = None, fields: list[str] | None = None, ladder: list[dict] | None = None) -> str:
    """The JSON result of a command: sorted keys, the number of results, warnings; fields and ladder only where there are some."""
    # fixed values: tiers of commands that name none
    tiers = {"query": "T0", "weave": "T3", "clip": "write", "index": "write"}
    told = {"schema_version": 1, "command": command, "tier": tier or tiers.get(command), "result_count": len(data) if isinstance(data, list) else 1, "warnings": list(warnings), "freshness": freshness, "fields": fields, "ladder": ladder, "data": data}
    return json.dumps({k: v for k, v in told.items() if v is not None}, sort_keys=True, indent=2, default=str, ensure_ascii=False)
