"""Source files as rows: path, modification time, digest and content."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scope import ignored, matches_glob

CONFIG = "declgraph.toml"


@dataclass
class Project:
    """A root folder and its configuration; found from a folder by walking up."""

    root: Path
    sources: list[str] = field(default_factory=lambda: ["Sources", "Tests"])
    exclude: list[str] = field(default_factory=list)
    follow_gitignore: bool = True
    call_sites: bool = True
    index_path: str = ".declgraph"
    audit: bool | str = True

    @classmethod
    def find(cls, start: str | Path) -> Project:
        at = Path(start).resolve()
        for folder in [at, *at.parents][:33]:
            if (folder / CONFIG).exists():
                return cls.load(folder)
        raise FileNotFoundError(f"no {CONFIG} in {at} or above")

    @classmethod
    def load(cls, root: str | Path) -> Project:
        root = Path(root).resolve()
        told = tomllib.loads((root / CONFIG).read_text()) if (root / CONFIG).exists() else {}
        index, parse = told.get("index", {}), told.get("parse", {})
        plain = {k: told[k] for k in ("sources", "exclude", "audit") if k in told}
        return cls(root, **plain, follow_gitignore=index.get("follow_gitignore", True), index_path=index.get("path", ".declgraph"), call_sites=parse.get("extract_call_sites", True))

    @classmethod
    def init(cls, root: str | Path, force: bool = False) -> Project:
        """Write a configuration; one that is there stays unless forced."""
        path = Path(root) / CONFIG
        if path.exists() and not force:
            raise FileExistsError(path)
        path.write_text('sources = ["Sources", "Tests"]\nexclude = ["**/.build/**"]\naudit = true\n\n[index]\npath = ".declgraph"\nfollow_gitignore = true\n\n[parse]\nextract_call_sites = true\n')
        return cls.load(root)

    def audit_path(self) -> Path:
        """The usage log: beside the index, or where the configuration says."""
        told = self.audit if isinstance(self.audit, str) and self.audit else f"{self.index_path}/audit.log"
        return Path(self.root, Path(told).expanduser())

    def rules(self) -> list[str]:
        path = self.root / ".gitignore"
        return path.read_text().splitlines() if self.follow_gitignore and path.exists() else []


_EMPTY = "path string, mtime double, bytes long, sha256 string, content binary"


def scan(spark: SparkSession, project: Project, glob: str = "*.swift") -> DataFrame:
    """path (relative), mtime, bytes, sha256, content of every source file that is neither hidden, excluded nor ignored."""
    roots = [str(p) for s in project.sources if (p := project.root / s).exists()]
    if not roots:
        return spark.createDataFrame([], _EMPTY)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(roots)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + str(project.root).replace(".", r"\.") + "/", "")
    files = raw.select(path.alias("path"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")
    files = files.where(~F.col("path").rlike(r"(^|/)\.") & F.call_function("is_valid_utf8", F.col("content").cast("string")))
    for pattern in project.exclude:
        files = files.where(~matches_glob(F.col("path"), pattern))
    rules = project.rules()
    return files.where(~ignored(F.col("path"), rules)) if rules else files


def narrative(spark: SparkSession, project: Project) -> DataFrame:
    """kind (book, sidecar), path and text: BOOK.md at the root, and X.md beside X.swift."""
    found = []
    book = project.root / "BOOK.md"
    parts = []
    if book.exists():
        found.append(("book", "BOOK.md", book.read_text()))
    sides = scan(spark, project, "*.md").select(F.lit("sidecar").alias("kind"), "path", F.col("content").cast("string").alias("text"))
    swift = scan(spark, project).select(F.regexp_replace("path", r"\.swift$", ".md").alias("path"))
    parts.append(sides.join(swift, "path", "left_semi").select("kind", "path", "text"))
    parts.append(spark.createDataFrame(found, "kind string, path string, text string"))
    return parts[0].unionByName(parts[1])
