"""Times the index on generated sources and prints one JSON line: extraction, indexing again with 0, 1 and 100 percent of the
files changed, and the edges of the call graph against the number of call sites."""

from __future__ import annotations

import json
import os
import random
import shutil
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

from declgraph.index import Index, extract
from declgraph.sources.files import Project, scan

FILES = int(os.environ.get("BENCH_FILES", "1000"))
CPUS = os.environ.get("BENCH_CPUS", "8")


def source(k: int, rng: random.Random) -> str:
    """A type with twenty members that call members of other types."""
    members = "\n".join(
        f"    /// Says what step {m} does.\n    func step{m}_{k % 97}(value: Int, other: Type{rng.randrange(FILES)}) -> Int {{\n        let held = Type{rng.randrange(FILES)}()\n        log(\"\\(held.step{rng.randrange(20)}_{rng.randrange(97)}(value: value))\")\n        return other.step{rng.randrange(20)}_{rng.randrange(97)}(value: {m}) + limit\n    }}"
        for m in range(20)
    )
    return f"import Foundation\n\n//# ai:section: part{k % 7}\npublic struct Type{k} {{\n    public var limit: Int = {k}\n{members}\n}}\n"


def timed(f) -> float:
    began = time.perf_counter()
    f()
    return round(time.perf_counter() - began, 2)


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    root, rng = Path(tempfile.mkdtemp()), random.Random(1)
    project = Project.init(root)
    folder = root / "Sources"
    folder.mkdir()
    for k in range(FILES):
        (folder / f"Type{k}.swift").write_text(source(k, rng))
    size = sum(p.stat().st_size for p in folder.iterdir())
    out: dict[str, float] = {"files": FILES, "megabytes": round(size / 1e6, 2)}
    read = lambda: extract(scan(spark, project)).write.format("noop").mode("overwrite").save()
    read()  # warm
    out["extract_seconds"] = timed(read)
    out["extract_megabytes_a_second"] = round(size / 1e6 / out["extract_seconds"], 2)
    index = Index(spark, project)
    out["first_build_seconds"] = timed(index.build)
    out["build_seconds_0_percent_changed"] = timed(index.build)
    for k in range(0, FILES, 100):
        (folder / f"Type{k}.swift").write_text(source(k, rng))
    out["build_seconds_1_percent_changed"] = timed(index.build)
    for k in range(FILES):
        (folder / f"Type{k}.swift").write_text(source(k, rng))
    out["build_seconds_100_percent_changed"] = timed(index.build)
    out["call_sites"] = index.table("call_sites").count()
    out["edge_seconds"] = timed(lambda: index.edges()[0].count())
    out["call_tree_seconds"] = timed(lambda: index.calls("Type1.step1_1(value:Int,other:Type1)", least="low").count())
    out["outline_seconds"] = timed(lambda: index.outline(level=2, limit=FILES).count())
    print(json.dumps(out))
    spark.stop()
    shutil.rmtree(root)


if __name__ == "__main__":
    main()
