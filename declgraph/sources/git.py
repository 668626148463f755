"""Version-control history as frames: changed lines, hunks, logs. Git writes its text to files that Spark splits at records."""

from __future__ import annotations

import subprocess
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import renamed_path, under_prefix
from ..operators import diff, history, intervals
from ..plans.reports import documented


def run(root: Path, *args: str) -> str:
    return subprocess.run(["git", "-C", str(root), *args], capture_output=True, text=True, check=True).stdout


#: What a commit's record begins with in a log, and what parts the files of a diff: no line of a file's content can begin so.
MARK, FILE_MARK = "\x1e", "\ndiff --git "
_HEAD = "^commit\t([0-9a-f]+)\t(.*)\t([0-9]+)$"
_FORMAT = "--format=%x1ecommit%x09%H%x09%an%x09%at"
#: Texts of version control stay this long for frames that still read them.
KEPT_SECONDS = 86_400


def records(spark: SparkSession, root: Path, mark: str, *args: str) -> DataFrame:
    """value: what git tells, a row for each record. Its text goes to a file in the repository's own folder, not through the
    driver's memory, and Spark splits that at the marks, so a record is whole wherever it is read."""
    folder = Path(root, run(root, "rev-parse", "--git-path", "declgraph").strip())
    folder.mkdir(parents=True, exist_ok=True)
    for old in folder.glob("*.txt"):
        if time.time() - old.stat().st_mtime > KEPT_SECONDS:
            old.unlink(missing_ok=True)
    path = folder / f"{uuid.uuid4().hex}.txt"
    with path.open("wb") as out:
        subprocess.run(["git", "-C", str(root), *args], stdout=out, check=True)
    return spark.read.option("lineSep", mark).text(str(path.resolve()))


def _of_commits(found: DataFrame) -> DataFrame:
    """commit, author, at (seconds) and line, a row for each line under a record's head; records without such a head are none."""
    lines = F.split("value", "\n")
    head = lambda k: F.regexp_extract(lines[0], _HEAD, k)
    rows = found.where(lines[0].rlike(_HEAD))
    return rows.select(head(1).alias("commit"), head(2).alias("author"), head(3).cast("long").alias("at"), F.explode(F.slice(lines, 2, F.size(lines))).alias("line"))


def parse_numstat(found: DataFrame, prefix: str = "") -> DataFrame:
    """commit, author, at (seconds), path, insertions, deletions from records whose first line is
    `commit TAB sha TAB author TAB seconds`, before their numstat lines. A binary file's numbers are 0."""
    tagged = _of_commits(found).where(F.col("line").rlike("^([0-9]+|-)\t([0-9]+|-)\t.+$"))
    number = lambda k: F.coalesce(F.split("line", "\t")[k].try_cast("long"), F.lit(0))
    path = under_prefix(renamed_path(F.substring_index("line", "\t", -1)), prefix)
    return tagged.select("commit", "author", "at", path.alias("path"), number(0).alias("insertions"), number(1).alias("deletions")).where("path is not null")


def log(spark: SparkSession, root: Path, days: int, prefix: str = "") -> DataFrame:
    return parse_numstat(records(spark, root, MARK, "log", "--no-merges", "-M", "--numstat", f"--since={days} days ago", _FORMAT), prefix)


def parse_hunks(found: DataFrame, prefix: str = "") -> DataFrame:
    """path, low, high (lines of the new side) of a diff without context, a record for each file."""
    name = F.regexp_extract("value", r"(?m)^\+\+\+ b/(.*)$", 1)  # the first such line; those of the content come after it
    rows = found.select(F.nullif(name, F.lit("")).alias("path"), F.explode(F.split("value", "\n")).alias("line")).where(F.col("line").startswith("@@ "))
    start = F.regexp_extract("line", r"\+([0-9]+)", 1).cast("int")
    count = F.coalesce(F.nullif(F.regexp_extract("line", r"\+[0-9]+,([0-9]+)", 1), F.lit("")).cast("int"), F.lit(1))
    return rows.select(under_prefix(F.col("path"), prefix).alias("path"), start.alias("low"), (start + F.greatest(count, F.lit(1)) - 1).alias("high")).where("path is not null")


def hunks(spark: SparkSession, root: Path, since: str = "HEAD", prefix: str = "") -> DataFrame:
    return parse_hunks(records(spark, root, FILE_MARK, "diff", "-U0", "-M", since, "--", "."), prefix)


def changed_files(root: Path, since: str = "HEAD") -> list[tuple[str, str]]:
    """(state, path) of files that differ from a commit."""
    return [(x.split("\t")[0][0], x.split("\t")[-1]) for x in run(root, "diff", "--name-status", "-M", since, "--", ".").split("\n") if x]


def untracked(root: Path) -> list[str]:
    """Files that git neither knows nor ignores; a delta never has them."""
    return [x for x in run(root, "ls-files", "--others", "--exclude-standard").split("\n") if x]


def revision(root: Path, ref: str = "HEAD") -> str | None:
    """The commit that a name stands for; null if there is none."""
    done = subprocess.run(["git", "-C", str(root), "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}"], capture_output=True, text=True, check=False)
    return done.stdout.strip() or None


def prefix(root: Path) -> str:
    """Where a project lies in its repository; empty at the top."""
    return run(root, "rev-parse", "--show-prefix").strip().rstrip("/")


def last_touched(spark: SparkSession, root: Path, prefix: str = "") -> DataFrame:
    """path and touched (seconds of the newest commit) over all history."""
    found = records(spark, root, MARK, "log", "--no-merges", "--name-only", _FORMAT)
    return history.last_touched(parse_names(found, prefix)).withColumnRenamed("at", "touched")


def parse_names(found: DataFrame, prefix: str = "") -> DataFrame:
    """path and at (seconds) from records as in parse_numstat, with files' names under their heads."""
    return _of_commits(found).where("line <> ''").select(under_prefix(F.col("line"), prefix).alias("path"), "at").where("path is not null")


HOOKS = ("post-checkout", "post-merge", "post-rewrite")


def install_hooks(root: Path, command: str) -> list[Path]:
    """Hooks that run a command (to index anew) after the working tree changes; it runs aside and its failure stops nothing.
    A hook that is there already stays."""
    folder = Path(root, run(root, "rev-parse", "--git-path", "hooks").strip())
    folder.mkdir(parents=True, exist_ok=True)
    made = []
    for name in HOOKS:
        path = folder / name
        if not path.exists():
            path.write_text(f"#!/bin/sh\n( {command} >/dev/null 2>&1 || true ) &\n")
            path.chmod(0o755)
            made.append(path)
    return made


def changes_with_place(index, since: str = "HEAD") -> DataFrame:
    """The delta with what a list of entities needs: line, lines_touched, kind, documented and guards of each declaration; those
    that are gone have none of these."""
    found = delta(index, since).withColumnRenamed("lines", "lines_touched")
    d = index.declarations().select("id", F.col("file_path").alias("path"), "decl_id", F.col("start_line").alias("line"), "kind").dropDuplicates(["path", "decl_id"])
    tags = index.table("directives").where(F.col("tag").startswith("ai:")).groupBy(F.col("decl_id").alias("id")).agg(F.array_sort(F.collect_set("tag")).alias("guards"))
    place = documented(d, index.table("doc_comments")).join(tags, "id", "left").drop("id")
    rows = found.join(place, ["path", "decl_id"], "left")
    return rows.withColumns({"documented": F.coalesce("documented", F.lit(False)), "guards": F.coalesce("guards", F.array().cast("array<string>")), "kind": F.coalesce("kind", F.lit("-"))})


def contents_at(root: Path, ref: str, paths: list[str]) -> list[tuple[str, bytes]]:
    """(path, content) of files as they were at a commit, from one process; what was not there is left out."""
    asked = "".join(f"{ref}:./{p}\n" for p in paths).encode()
    told = subprocess.run(["git", "-C", str(root), "cat-file", "--batch"], input=asked, capture_output=True, check=True).stdout
    found, at = [], 0
    for p in paths:
        end = told.index(b"\n", at)
        head = told[at:end].split(b" ")
        at = end + 1
        if head[-1] != b"missing":
            size = int(head[-1])
            found.append((p, told[at : at + size]))
            at += size + 1
    return found


def delta(index, since: str = "HEAD") -> DataFrame:
    """Declaration changes since a commit: what git has, parsed as the index parses, against the index."""
    from ..index import extract

    spark, root = index.spark, index.project.root
    wanted = [(state, p) for state, p in changed_files(root, since) if p.endswith(".swift")]
    old = contents_at(root, since, [p for state, p in wanted if state != "A"])
    columns = "path string, content binary"
    parsed = extract(spark.createDataFrame(old, columns), call_sites=False)
    before = parsed.select("path", F.explode("declarations").alias("r")).select("path", "r.decl_id", "r.signature", "r.access", "r.ordinal")
    names = spark.createDataFrame([(p,) for _, p in wanted], "path string")
    now = index.declarations().withColumnRenamed("file_path", "path").join(F.broadcast(names), "path", "left_semi")
    spans = now.select("id", "path", "decl_id", "start_line", "end_line")
    touched = intervals.overlap_sum(spans, hunks(spark, root, since), "path", "id", "start_line", "end_line", "low", "high", "lines")
    touched = touched.join(spans, "id").groupBy("path", "decl_id").agg(F.sum("lines").alias("lines"))
    return diff.changes(before, now.select("path", "decl_id", "signature", "access", "ordinal"), touched)
