"""Files outside a project: read a range of lines, write, append; each leaves a line in the usage log."""

from __future__ import annotations

from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import line_range, lines
from . import audit


def _told(log: Path | None, operation: str, path: Path, note: str | None) -> None:
    if log is not None:
        log.parent.mkdir(parents=True, exist_ok=True)
        stamp = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        audit.append(log, {"timestamp": stamp, "operation": operation, "path": str(path), "note": note})


def read(spark: SparkSession, path: str | Path, wanted: str | None = None, log: Path | None = None) -> DataFrame:
    """number and line of a text file: lines a-b, the last n for -n, else all."""
    path = Path(path).expanduser().resolve()
    whole = spark.read.text(str(path), wholetext=True).select(lines(F.col("value")).alias("l"))
    chosen = whole.select(line_range(F.col("l"), wanted).alias("c"), F.size("l").alias("n"))
    _told(log, "read", path, wanted)
    return chosen.select(F.posexplode("c").alias("number", "line"))


def write(path: str | Path, data: bytes, note: str | None = None, log: Path | None = None) -> None:
    path = Path(path).expanduser().resolve()
    path.write_bytes(data)
    _told(log, "write", path, note)


def append(path: str | Path, data: bytes, note: str | None = None, log: Path | None = None) -> None:
    """Add to a file's end; a file that is not there is made."""
    path = Path(path).expanduser().resolve()
    with path.open("ab") as f:
        f.write(data)
    _told(log, "append", path, note)
