"""Snapshots of the index as parts that are merged when they are read.

A build writes one part: the rows of files that are new or changed, and the ids of files whose earlier rows are gone. A snapshot
is a list of parts; a row counts unless a later part says that its file is gone. What a build writes grows with what changed.
Parts never change once they are named, so readers keep theirs. When parts or gone files are many, a build writes one whole part.
"""

from __future__ import annotations

import json
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema

#: A whole part is written instead of one more than these, or when more than this share of the files' rows is gone.
MOST_PARTS, MOST_GONE = 16, 0.25
#: Ids of gone files up to this number (16 bytes each) are broadcast to the rows; more are met by shuffle.
MOST_BROADCAST = 1_000_000


def _key(table: str) -> str:
    return "id" if table == "files" else "file_id"


def _stored(table: str) -> str:
    """Columns of a part: every table has its file's id."""
    return schema.TABLES[table] + ("" if _key(table) in schema.columns(table) else ", file_id long")


def read(spark: SparkSession, home: Path, meta: dict, table: str) -> DataFrame:
    """A table as its parts tell it, with the file's id."""
    if table == "narrative":
        return spark.read.schema(schema.TABLES[table]).parquet(str(home / meta["narrative_in"] / table))
    since = meta["sites_since"] if table in schema.SITE_TABLES else 0
    parts = [(k, p) for k, p in enumerate(meta["parts"]) if k >= since]
    rows = None
    for k, part in parts[:-1]:
        one = spark.read.schema(_stored(table)).parquet(str(home / part["name"] / table)).withColumn("_part", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    last = spark.read.schema(_stored(table)).parquet(str(home / parts[-1][1]["name"] / table))
    if rows is None:
        return last
    gone, n = None, 0
    for k, part in parts[1:]:
        if part["gone"]:
            one = spark.read.schema("file_id long").parquet(str(home / part["name"] / "gone")).select(F.col("file_id").alias("_gone"), F.lit(k).alias("_by"))
            gone, n = one if gone is None else gone.unionByName(one), n + part["gone"]
    if gone is not None:
        side = F.broadcast(gone) if n <= MOST_BROADCAST else gone
        rows = rows.join(side, (F.col(_key(table)) == F.col("_gone")) & (F.col("_part") < F.col("_by")), "left_anti")
    return rows.drop("_part").unionByName(last)


def edge_base(home: Path, meta: dict, folder: str) -> dict | None:
    """What the newest earlier snapshot was that has edges and whose parts (of call sites too) are the first ones of meta."""
    for k in range(len(meta["parts"]) - 2, meta["sites_since"] - 1, -1):
        if (home / meta["parts"][k]["name"] / folder).exists():
            return {**meta, "snapshot": meta["parts"][k]["name"], "parts": meta["parts"][: k + 1]}
    return None


def changed_since(spark: SparkSession, home: Path, base: dict, meta: dict) -> DataFrame:
    """file_id of files that parts of meta after those of base have rows of or call gone."""
    found = None
    for part in meta["parts"][len(base["parts"]) :]:
        new = spark.read.schema(_stored("files")).parquet(str(home / part["name"] / "files")).select(F.col("id").alias("file_id"))
        both = new.unionByName(spark.read.schema("file_id long").parquet(str(home / part["name"] / "gone")))
        found = both if found is None else found.unionByName(both)
    return found.distinct()


def read_edges(spark: SparkSession, home: Path, snapshot: str, folder: str) -> DataFrame:
    """Edges of a snapshot: its own, and those of the one it builds upon but for targets whose edges were made anew."""
    place = home / snapshot / folder
    told, rows = json.loads((place / "made.json").read_text()), spark.read.parquet(str(place / "rows"))
    if told["base"] is None:
        return rows
    gone = spark.read.schema("id long").parquet(str(place / "gone")).withColumnRenamed("id", "target")
    earlier = read_edges(spark, home, told["base"], folder)
    return earlier.join(F.broadcast(gone) if told["gone"] <= MOST_BROADCAST else gone, "target", "left_anti").unionByName(rows)


def due(meta: dict, counters: dict[str, int]) -> bool:
    """Whether the next part should be a whole one."""
    files = sum(counters[k] for k in ("added", "updated", "skipped"))
    gone = counters["updated"] + counters["removed"] + sum(p["gone"] for p in meta["parts"])
    return len(meta["parts"]) >= MOST_PARTS or gone > MOST_GONE * max(files, 1)


def write(spark: SparkSession, home: Path, meta: dict | None, new: dict[str, DataFrame], gone: DataFrame, whole: bool, sites: bool) -> dict:
    """Write a part of new rows (after meta's parts, or with all of their rows that still count) and tell what the snapshot is."""
    name = f"snapshot-{uuid.uuid4().hex}"
    for table, fresh in new.items():
        names = [*schema.columns(table), *([] if _key(table) in schema.columns(table) else ["file_id"])]
        rows = fresh.select(*names)
        if whole and meta is not None and (sites or table not in schema.SITE_TABLES):
            before = read(spark, home, meta, table)
            rows = rows.unionByName(before.join(gone.withColumnRenamed("file_id", _key(table)), _key(table), "left_anti").select(*names))
        rows.write.parquet(str(home / name / table))
    if whole or meta is None:
        return {"snapshot": name, "parts": [{"name": name, "gone": 0}], "sites_since": 0}
    gone.write.parquet(str(home / name / "gone"))
    n = spark.read.schema("file_id long").parquet(str(home / name / "gone")).count()
    return {"snapshot": name, "parts": [*meta["parts"], {"name": name, "gone": n}], "sites_since": meta["sites_since"] if sites else len(meta["parts"])}


def vacuum(home: Path, meta: dict) -> list[str]:
    """Delete the folders of parts that meta does not name."""
    used = {p["name"] for p in meta["parts"]} | {meta["narrative_in"], meta["snapshot"]}
    left = sorted(p.name for p in home.glob("snapshot-*") if p.name not in used)
    for x in left:
        shutil.rmtree(home / x)
    return left
