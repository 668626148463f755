"""The index: extraction on executors, incremental snapshots, freshness, and questions over the tables."""

from __future__ import annotations

import fcntl
import json
import re
import shutil
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schema, snapshots, sqltext
from .edits import fold
from .operators import diff, graph, members, pieces, ranks, resolve, scope
from .plans import records, reports, usage, volatility
from .sources import audit, git
from .sources.files import Project, narrative, scan

_ROWS = {
    "declarations": "array<struct<ordinal:int,decl_id:string,container:string,container_kind:string,kind:string,name:string,signature:string,access:string,spi:array<string>,modifiers:array<string>,start_line:int,end_line:int,decl_offset:bigint,decl_length:bigint,body_offset:bigint,body_length:bigint,doc:string,directives:array<struct<tag:string,value:string,line:int>>,inherits:array<string>>>",
    "imports": "array<struct<module:string,path:string,kind:string,spi:array<string>,testable:boolean,line:int>>",
    "sites": "array<struct<ordinal:int,owner:int,name:string,receiver:string,kind:string,line:int>>",
    "bindings": "array<struct<owner:int,name:string,type:string,line:int>>",
}


class StaleIndexError(RuntimeError):
    """Files changed since they were indexed."""


class SchemaStaleError(RuntimeError):
    """The snapshot has another schema version; build the index anew."""


class BusyError(RuntimeError):
    """Another writer holds the index."""


#: How long a writer waits for another one.
BUSY_SECONDS = 5.0
#: How long a reader waits for another one that makes edges.
EDGE_SECONDS = 3600.0
#: Low edges (of callers) beyond this number are made for walks that ask for them only.
MOST_PAIRS = 50_000_000
#: From this number of files on, edges build upon those of an earlier snapshot; fewer files' edges are made anew, which takes less.
FILES_FROM_EARLIER = 2_000


def _locked(lock, seconds: float) -> None:
    until = time.monotonic() + seconds
    while True:
        try:
            return fcntl.flock(lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError as busy:
            if time.monotonic() > until:
                raise BusyError("another writer holds the index") from busy
            time.sleep(0.05)


def extract(files: DataFrame, call_sites: bool = True) -> DataFrame:
    """files (path, content) parsed on executors: path and one array of rows for each kind."""
    fields = ", ".join(f"{k} {v}" for k, v in _ROWS.items())
    types = T._parse_datatype_string(fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .extract.swift import Extraction, owner_of

        for batch in batches:
            columns: list[list] = [[] for _ in _ROWS]
            for content in batch.column(1):
                got = Extraction(content.as_py() or b"")
                decls = [{**x, "ordinal": k} for k, x in enumerate(got.declarations)]
                owned = lambda rows: [{**x, "owner": owner_of(got.declarations, x["offset"]), "ordinal": k} for k, x in enumerate(rows)]  # noqa: B023, E731
                sites, bindings = (owned(got.sites), [b for b in owned(got.bindings) if b["owner"] is not None]) if call_sites else ([], [])
                for column, rows in zip(columns, (decls, got.imports, sites, bindings), strict=True):
                    column.append(rows)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)]  # takes a struct's fields by name: what it lacks is null
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["path", *_ROWS])

    return files.select("path", "content").mapInArrow(run, f"path string, {fields}")


def _explode(parsed: DataFrame, column: str) -> DataFrame:
    return parsed.select(F.xxhash64("path").alias("file_id"), F.explode(column).alias("r"))


def tables_of(files: DataFrame, parsed: DataFrame) -> dict[str, DataFrame]:
    """The derived tables of parsed files."""
    row_id = lambda ordinal: F.xxhash64("file_id", ordinal)
    decls = _explode(parsed, "declarations").withColumn("id", row_id(F.col("r.ordinal")))
    sites, bound = _explode(parsed, "sites"), _explode(parsed, "bindings")
    owner = F.when(F.col("r.owner").isNotNull(), row_id(F.col("r.owner"))).alias("from_decl")
    plain = [n.split()[0] for n in schema.TABLES["declarations"].split(", ") if n.split()[0] not in ("id", "file_id")]
    return {
        "files": files.select(F.xxhash64("path").alias("id"), "path", "mtime", "sha256", "bytes", F.lit(time.time()).alias("last_indexed")),
        "declarations": decls.select("id", "r.decl_id", "file_id", *(f"r.{c}" for c in plain if c != "decl_id")),
        "imports": _explode(parsed, "imports").select("file_id", "r.*"),
        "doc_comments": decls.where("r.doc is not null").select(F.col("id").alias("decl_id"), F.col("r.doc").alias("text"), "file_id"),
        "directives": decls.select(F.col("id").alias("decl_id"), F.explode("r.directives").alias("t"), "file_id").select("decl_id", "t.*", "file_id"),
        "call_sites": sites.select(F.xxhash64("file_id", F.lit("site"), F.col("r.ordinal")).alias("id"), "file_id", owner, "r.name", "r.receiver", "r.kind", "r.line"),
        "bindings": bound.select("file_id", owner, "r.name", "r.type", "r.line"),
        "conformances": decls.select("file_id", F.col("r.name").alias("type_name"), F.explode("r.inherits").alias("protocol_name")),
    }


class Index:
    """A project's snapshots under its index folder. Readers keep the snapshot they opened; one writer at a time."""

    def __init__(self, spark: SparkSession, project: Project):
        self.spark, self.project = spark, project
        self.home = Path(project.root, project.index_path)

    # --- maintenance

    def _meta(self) -> dict | None:
        pointer = self.home / "current.json"
        return json.loads(pointer.read_text()) if pointer.exists() else None

    def _current(self) -> dict:
        meta = self._meta()
        if meta is None:
            raise StaleIndexError("there is no index yet")
        if meta["schema_version"] != schema.SCHEMA_VERSION:
            raise SchemaStaleError(f"schema {meta['schema_version']}, this is {schema.SCHEMA_VERSION}")
        return meta

    def table(self, name: str) -> DataFrame:
        """A table as the snapshot of this moment has it."""
        return snapshots.read(self.spark, self.home, self._current(), name).select(*schema.columns(name))

    def check(self) -> DataFrame:
        """path and state of every file, on disk and in the index."""
        return diff.file_states(scan(self.spark, self.project).drop("content"), self.table("files"))

    def build(self, full: bool = False, call_sites: bool | None = None) -> dict[str, int]:
        """Parse new and changed files only, write the next snapshot, then point to it. Counters: added, updated, skipped,
        removed."""
        sites = self.project.call_sites if call_sites is None else call_sites
        self.home.mkdir(parents=True, exist_ok=True)
        with (self.home / "writer.lock").open("a") as lock:  # the system lets go of it if the writer dies
            _locked(lock, BUSY_SECONDS)
            return self._build(full, sites)

    def _build(self, full: bool, sites: bool) -> dict[str, int]:
        meta = self._meta()
        usable = meta is not None and meta["schema_version"] == schema.SCHEMA_VERSION
        disk = scan(self.spark, self.project)
        old = self.table("files") if usable else self.spark.createDataFrame([], schema.TABLES["files"])
        states = diff.file_states(disk.drop("content"), old).persist()
        counters = {k: int(v or 0) for k, v in diff.index_counters(states, full).first().asDict().items()}
        text = narrative(self.spark, self.project)
        told = {"schema_version": schema.SCHEMA_VERSION, "call_sites": "on" if sites else "off", "narrative": text.agg(F.sum(F.xxhash64("kind", "path", "text").cast("decimal(38,0)")).cast("string")).first()[0]}
        if usable and not counters["added"] + counters["updated"] + counters["removed"] and all(meta.get(k) == v for k, v in told.items()):
            states.unpersist()
            return counters  # the snapshot is what the next one would be
        again = states.where(F.col("state").isin("unindexed", "modified", *(["fresh"] if full or not usable else []))).select("path")
        changed = disk.join(again, "path", "left_semi")
        parsed = extract(changed, sites).persist()
        new = tables_of(changed.drop("content"), parsed)
        gone = states.where(F.col("state").isin("modified", "missing")).select(F.xxhash64("path").alias("file_id"))
        whole = full or not usable or snapshots.due(meta, counters)
        written = snapshots.write(self.spark, self.home, None if not usable or full else meta, new, gone, whole, sites)
        if usable and meta["narrative"] == told["narrative"]:
            written["narrative_in"] = meta["narrative_in"]
        else:
            about = F.when(F.col("kind") == "sidecar", F.xxhash64(F.regexp_replace("path", r"\.md$", ".swift"))).alias("file_id")
            text.select(about, "kind", "path", "text").write.parquet(str(self.home / written["snapshot"] / "narrative"))
            written["narrative_in"] = written["snapshot"]
        parsed.unpersist(), states.unpersist()
        draft = self.home / f"current-{uuid.uuid4().hex}.json"
        draft.write_text(json.dumps({**told, **written}))
        draft.replace(self.home / "current.json")
        return counters

    def vacuum(self) -> list[str]:
        """Delete parts that the current snapshot does not read. Readers that still hold an earlier one lose it."""
        with (self.home / "writer.lock").open("a") as lock:
            _locked(lock, BUSY_SECONDS)
            return snapshots.vacuum(self.home, self._current())

    def require_fresh(self, paths: list[str]) -> None:
        """Refuse to slice files that changed or are not indexed."""
        wanted = self.spark.createDataFrame([(p,) for p in paths], "path string")
        known = self.check().join(F.broadcast(wanted), "path").where("state = 'fresh'").select("path")
        stale = sorted(set(paths) - {r.path for r in known.collect()})  # no more than were asked for
        if stale:
            raise StaleIndexError(", ".join(stale))

    def status(self) -> dict:
        meta = self._meta()
        counts = {t: self.table(t).count() for t in schema.TABLES} if meta else {}
        return {"meta": meta, "rows": counts, "states": {r.state: r.n for r in self.check().groupBy("state").agg(F.count("*").alias("n")).collect()} if meta else {}}

    # --- tables for questions

    def declarations(self) -> DataFrame:
        """Declarations with file_path."""
        files = self.table("files").select(F.col("id").alias("file_id"), F.col("path").alias("file_path"))
        return self.table("declarations").join(files, "file_id")

    def get(self, path: str | None = None, kind: str | None = None, container: str | None = None, name_like: str | None = None, text: str | None = None, tag: str | None = None, section: str | None = None, spi: str | None = None, access: str | None = None, limit: int = 500, offset: int = 0, fields: list[str] | None = None) -> DataFrame:
        """Declarations by filters, in order of path and line, a page at a time."""
        d = self.declarations()
        c = F.col
        checks = [(path, lambda v: scope.in_path(c("file_path"), v)), (kind, lambda v: c("kind") == v), (container, lambda v: c("container") == v), (name_like, lambda v: scope.name_like(c("name"), v)), (text, lambda v: scope.id_or_name_like(c("decl_id"), c("name"), v)), (spi, lambda v: scope.spi_is(c("spi"), v)), (access, lambda v: scope.access_floor(c("access"), v))]
        for value, check in checks:
            d = d if value is None else d.where(check(value))
        if tag is not None:
            d = scope.with_tag(d, self.table("directives"), tag, "id", "decl_id")
        if section is not None:
            d = scope.with_tag(d, self.table("directives"), "ai:section", "id", "decl_id", section)
        d = d.orderBy("file_path", "start_line", "ordinal").offset(offset).limit(limit)
        return scope.project(d, fields)

    def find(self, text: str) -> DataFrame:
        """Declarations whose id or name holds a text, in any case, as `get` finds them by text, from an index of the parts'
        names. A part's is made when it is first asked for; what a later part took away is left out when rows are met again."""
        meta, found = self._current(), None
        for part in meta["parts"]:
            place = self.home / part["name"] / "pieces"
            if not place.exists():
                with (self.home / "writer.lock").open("a") as lock:
                    _locked(lock, EDGE_SECONDS)
                    if not place.exists():
                        self._index_names(part["name"])
            one = pieces.search(self.spark, str(place), text, "term string, id long").select("id")
            found = one if found is None else found.unionByName(one)
        checked = scope.id_or_name_like(F.col("decl_id"), F.col("name"), text)
        return self.declarations().join(found.distinct(), "id", "left_semi").where(checked).orderBy("file_path", "start_line", "ordinal")

    def _index_names(self, part: str) -> None:
        decls = self.spark.read.schema("id long, decl_id string, name string").parquet(str(self.home / part / "declarations"))
        draft = self.home / part / f"draft-{uuid.uuid4().hex}"
        pieces.write(decls.select(F.explode(F.array_distinct(F.array("decl_id", "name"))).alias("term"), "id"), str(draft))
        draft.rename(self.home / part / "pieces")

    def resolve(self, query: str, path: str | None = None, ladder: Callable[[DataFrame, str], DataFrame] = resolve.lookup) -> DataFrame:
        """What a query means, by one of the ladders of `resolve`."""
        d = self.declarations()
        return ladder(d if path is None else d.where(scope.in_path_or_named(F.col("file_path"), path)), query)

    def for_edit(self, pattern: str, path: str | None = None) -> dict:
        """The one declaration that an edit is aimed at, with its file's digest; none or several are refused."""
        files = self.table("files").select(F.col("id").alias("file_id"), "sha256")
        found = self.resolve(pattern, path, resolve.for_edit).join(files, "file_id").orderBy("file_path", "ordinal").limit(9).collect()
        if len(found) != 1:
            raise LookupError(f"{pattern!r} fits {'nothing' if not found else ', '.join(r.decl_id for r in found)}")
        return found[0].asDict()

    def select(self, selector: str, level: int = 2, wanted: members.Wanted | None = None) -> DataFrame:
        """What `target:member` shows: roots in order of path and line, or members of what is named that take part."""
        path, roots, asked = self._scoped(selector, wanted)
        d = self.declarations()
        d = d if path is None else d.where(scope.in_path_or_named(F.col("file_path"), path))
        asked = asked if asked.members is not None else replace(asked, members=members.RUNGS[level])
        if roots is None:
            found = members.included_roots(d, asked)
        else:
            roots = members.outermost(roots)
            around = roots.select(F.col("file_id").alias("r_file"), F.col("decl_offset").alias("r_at"), F.col("decl_length").alias("r_size")).distinct()
            inside = (F.col("file_id") == F.col("r_file")) & (F.col("decl_offset") >= F.col("r_at")) & (F.col("decl_offset") + F.col("decl_length") <= F.col("r_at") + F.col("r_size"))
            found = members.included(d.join(around, inside, "left_semi"), asked).unionByName(roots.select(*d.columns)).dropDuplicates(["id"])
        return found.orderBy("file_path", "start_line", "ordinal")

    def peek(self, expand: str, path: str | None = None) -> DataFrame:
        """Types that the signatures of expanded declarations name, a few, by path and line."""
        d = self.declarations()
        shown = d if path is None else d.where(scope.in_path_or_named(F.col("file_path"), path))
        leaves = members.expanded_leaves(shown, members.Wanted(expand=expand))
        roots = members.included_roots(shown, members.Wanted(members=(), name=expand))
        return members.peek(d, leaves, roots.unionByName(leaves))

    def records(self, query: str) -> DataFrame:
        """Records of what a query means, with their text forms: line, folded, markdown."""
        found = records.records(self.resolve(query).drop("rung"), self.table("doc_comments"), self.table("directives"))
        forms = {"line": records.one_line(), "folded": records.folded(), "markdown": records.markdown()}
        return found.withColumns(forms).orderBy("file_path", "start_line", "ordinal")

    def folded(self, query: str, keep: tuple[str, ...] = (), deep: bool = False) -> str:
        """Source of what a query means with bodies folded, but those of declarations that a keep pattern fits. With deep a
        member is shown inside its type, unfolded."""
        d = self.declarations()
        row = self.resolve(query).orderBy("file_path", "ordinal").first()
        if row is None:
            raise LookupError(f"{query!r} fits nothing")
        inside = d.where((F.col("file_id") == row.file_id) & (F.col("decl_length") > 0))
        kept = {r.decl_id for p in keep for r in inside.where(scope.kept_by_pattern(F.col("decl_id"), F.col("name"), p)).collect()}  # of one file
        rows = inside.collect()
        if deep and row.kind not in schema.TYPE_KINDS:
            around = [r for r in rows if r.kind in schema.TYPE_KINDS and r.decl_offset <= row.decl_offset and r.decl_offset + r.decl_length >= row.decl_offset + row.decl_length]
            kept.add(row.decl_id)
            row = min(around, key=lambda r: r.decl_length, default=row)
        self.require_fresh([row.file_path])
        data = (self.project.root / row.file_path).read_bytes()
        start, end = row.decl_offset, row.decl_offset + row.decl_length
        of_type = row.kind in schema.TYPE_KINDS
        held = [r for r in rows if (start < r.decl_offset and r.decl_offset + r.decl_length <= end if of_type else r.id == row.id)]
        parts = [(r.decl_offset - start, r.decl_length, None if r.body_offset is None else r.body_offset - start, r.body_length, r.decl_id, r.kind in schema.TYPE_KINDS) for r in held]
        return fold(data[start:end], parts, frozenset(kept), deep).decode()

    def imports(self, path: str | None = None, module: str | None = None, testable: bool | None = None, spi: str | None = None) -> DataFrame:
        files = self.table("files").select(F.col("id").alias("file_id"), F.col("path").alias("file_path"))
        d = self.table("imports").join(files, "file_id")
        c = F.col
        checks = [(path, lambda v: scope.in_path(c("file_path"), v)), (module, lambda v: c("module") == v), (testable, lambda v: c("testable") == v), (spi, lambda v: scope.spi_is(c("spi"), v))]
        for value, check in checks:
            d = d if value is None else d.where(check(value))
        return d.orderBy("file_path", "line")

    # --- graph

    def edges(self, include_refs: bool = False) -> tuple[DataFrame, DataFrame]:
        """(callers' edges, callees' edges), with dispatch through protocols: tables of the snapshot, made when they are first
        asked for, each in order of the side that a walk starts from, so that a walk reads little of it."""
        return self._edges_of("callers", include_refs), self._edges_of("callees", include_refs)

    def _edges_of(self, side: str, include_refs: bool, least: int = graph.LOW) -> DataFrame:
        """One table of edges; of callers also those of medium and more alone, with the number of the others as `more`. Whoever
        makes one holds the writer's lock, and nobody sees it before it is whole."""
        meta = self._current()
        if graph.sites_disabled(meta.get("call_sites"), self.table("call_sites")):
            raise RuntimeError("call sites are not indexed")
        folder = self._edge_folder(side, include_refs, least)
        if not (self.home / meta["snapshot"] / folder).exists():
            with (self.home / "writer.lock").open("a") as lock:
                _locked(lock, EDGE_SECONDS)
                if not (self.home / meta["snapshot"] / folder).exists():
                    self._make_edges(meta, folder, side, include_refs, least)
        return snapshots.read_edges(self.spark, self.home, meta["snapshot"], folder)

    def _make_edges(self, meta: dict, folder: str, side: str, include_refs: bool, least: int) -> None:
        """Write edges of a snapshot: all of them, or, where an earlier snapshot of the same parts has its own, those of names
        that later parts touched."""
        draft = self.home / meta["snapshot"] / f"draft-{uuid.uuid4().hex}"
        tables = {t: snapshots.read(self.spark, self.home, meta, t) for t in graph.INPUTS}
        base = snapshots.edge_base(self.home, meta, folder)
        base = base if base is not None and snapshots.read(self.spark, self.home, meta, "files").count() >= FILES_FROM_EARLIER else None
        told = {"base": None, "gone": 0}
        if base is not None:
            before = {t: snapshots.read(self.spark, self.home, base, t) for t in graph.INPUTS}
            changed = snapshots.changed_since(self.spark, self.home, base, meta)
            graph.touched_names(before, tables, changed).write.parquet(str(draft / "names"))
            names = self.spark.read.schema("name string").parquet(str(draft / "names"))
            before["declarations"].join(names, "name", "left_semi").select("id").write.parquet(str(draft / "gone"))
            told = {"base": base["snapshot"], "gone": self.spark.read.schema("id long").parquet(str(draft / "gone")).count()}
            for t, rows in graph.around(names, tables).items():  # read many times below; it grows with what changed
                if t != "conformances":
                    rows.write.parquet(str(draft / "around" / t))
                    tables[t] = self.spark.read.schema(rows.schema).parquet(str(draft / "around" / t))
        made = self._sure_callers(tables, include_refs) if least else self._edges(tables, include_refs, side)
        by = "origin" if side == "callees" else "target"
        made.repartitionByRange(by).sortWithinPartitions(by).write.parquet(str(draft / "rows"))
        shutil.rmtree(draft / "around", ignore_errors=True)
        (draft / "made.json").write_text(json.dumps(told))
        draft.rename(self.home / meta["snapshot"] / folder)

    def _edge_folder(self, side: str, include_refs: bool, least: int) -> str:
        return f"edges-{side}{'-refs' if include_refs else ''}{'-sure' if least else ''}"

    def _too_many(self, include_refs: bool) -> bool:
        """Whether low edges of callers are left until they are asked for: they are not made yet, and sites times declarations,
        added up over names, are many."""
        if (self.home / self._current()["snapshot"] / self._edge_folder("callers", include_refs, graph.LOW)).exists():
            return False
        sites = self.table("call_sites").groupBy("name").agg(F.count("*").alias("s"))
        named = self.table("declarations").groupBy("name").agg(F.count("*").alias("d"))
        return (sites.join(named, "name").agg(F.sum(F.col("s") * F.col("d"))).first()[0] or 0) > MOST_PAIRS

    def _sure_callers(self, tables: dict[str, DataFrame], include_refs: bool) -> DataFrame:
        decls, conf, sites = tables["declarations"], tables["conformances"], tables["call_sites"]
        sure = graph.callers(sites, decls, tables["bindings"], conf, include_refs, least=graph.MEDIUM)
        return graph.unseen(graph.with_dispatch_in(sure, decls, conf), sites if include_refs else sites.where("kind = 'call'"), decls)

    def _edges(self, tables: dict[str, DataFrame], include_refs: bool, side: str) -> DataFrame:
        found = (tables["call_sites"], tables["declarations"], tables["bindings"], tables["conformances"], include_refs)
        return graph.callees_with_dispatch(*found) if side == "callees" else graph.callers_with_dispatch(*found)

    def calls(self, query: str, callees: bool = False, depth: int = 2, least: str = "medium", limit: int | None = 25, include_refs: bool = False, tests_only: bool = False) -> DataFrame:
        """The call tree of the declaration that query means: callers, or callees."""
        decls = self.declarations()
        root = resolve.for_calls(decls, query).orderBy("file_path", "ordinal").limit(1).select(F.col("id").alias("node"))
        src, dst = ("origin", "target") if callees else ("target", "origin")
        sure = not callees and least != "low" and self._too_many(include_refs)
        edges = self._edges_of("callees" if callees else "callers", include_refs, graph.MEDIUM if sure else graph.LOW)
        edges = edges.withColumn(src, F.coalesce(src, F.lit(0))).withColumn(dst, F.coalesce(dst, F.lit(0)))
        tree = graph.traverse(root, edges, depth, schema.CONFIDENCE.index(least), limit, src, dst)
        named = tree.join(decls.select(F.col("id").alias("node"), "decl_id", F.col("file_path").alias("path_name"), scope.is_test(F.col("file_path"), F.col("container")).alias("is_test")), "node", "left")
        return graph.towards(named, F.col("is_test")) if tests_only else named

    def blast_radius(self, query: str, depth: int = 2, least: str = "low") -> DataFrame:
        decls = self.declarations().select("id", F.col("file_path").alias("path_name"), scope.is_test(F.col("file_path"), F.col("container")).alias("is_test"))
        tree = self.calls(query, depth=depth, least=least, limit=None).drop("path_name", "is_test", "decl_id")
        return graph.blast_radius(tree, decls)

    # --- SQL

    def views(self) -> None:
        """Temporary views of the tables; lists as comma-joined text and booleans as 0 and 1, as their SQL expects."""
        for name in schema.TABLES:
            df = self.table(name)
            for f in df.schema.fields:
                if f.dataType.typeName() == "array":
                    df = df.withColumn(f.name, F.array_join(f.name, ","))
                elif f.dataType.typeName() == "boolean":
                    df = df.withColumn(f.name, F.col(f.name).cast("int"))
            df.createOrReplaceTempView(name)

    def sql(self, text: str) -> DataFrame:
        """Read-only SQL over the tables, as `sqltext` reads it; pragma table_info(t) lists a table's columns."""
        pragma = re.match(r"\s*pragma\s+table_info\s*\(\s*['\"]?(\w+)['\"]?\s*\)", text, re.I)
        self.views()
        if pragma:
            fields = self.spark.table(pragma[1]).schema.fields
            return self.spark.createDataFrame([(k, f.name, f.dataType.simpleString()) for k, f in enumerate(fields)], "cid int, name string, type string")
        return self.spark.sql(sqltext.to_spark(text))

    def recipe(self, name: str) -> DataFrame:
        return reports.recipe(name, {t: self.table(t) for t in schema.TABLES})

    def stats(self, path: str | None = None, top: int = 10) -> dict[str, DataFrame]:
        """Sections of the shape report; each is lazy, so one that is not read runs nothing."""
        return reports.sections({t: self.table(t) for t in schema.TABLES}, path, top)

    # --- history and use

    def volatility(self, now: float | None = None, days: int = 90, buckets: int = 12, path: str | None = None) -> DataFrame:
        """Every file of the index with how it changes; git adds columns, never rows."""
        files = self.table("files") if path is None else self.table("files").where(scope.in_path(F.col("path"), path))
        spine = volatility.structure(files, self.table("declarations"), self.table("doc_comments"), self.table("directives"))
        prefix = git.prefix(self.project.root)
        log, touched = git.log(self.spark, self.project.root, days, prefix), git.last_touched(self.spark, self.project.root, prefix)
        return volatility.enriched(spine, log, touched, time.time() if now is None else now, days, buckets)

    def dashboard(self, since: str = "HEAD", days: int = 90, buckets: int = 12, top: int = 10) -> DataFrame:
        """Entities of the mass, volatility and delta sections in one flat list."""
        mass = self.stats(top=top)["densest"]
        files = volatility.ranked(self.volatility(days=days, buckets=buckets), top)
        return volatility.entities(mass, files, git.changes_with_place(self, since))

    def _log(self, last: int | None) -> DataFrame:
        return audit.events(self.spark, str(self.project.audit_path()), last)

    def usage(self, last: int | None = None) -> dict[str, DataFrame]:
        """The report on the usage log."""
        return usage.report(self._log(last))

    def replay(self, program: str = "declgraph", last: int | None = None, failed: bool = False) -> DataFrame:
        return usage.replay(self._log(last), program, failed)

    # --- text

    def _contents(self, decls: DataFrame) -> DataFrame:
        """Sources of the files that hold declarations; files that changed since they were indexed are refused."""
        paths = [r.file_path for r in decls.select("file_path").distinct().collect()]  # of what is about to be printed
        self.require_fresh(paths)
        return scan(self.spark, self.project).select("path", "content")

    def _scoped(self, selector: str | None, wanted: members.Wanted | None) -> tuple[str | None, DataFrame | None, members.Wanted]:
        s = members.Selector.parse(selector, self.project.root)
        asked = replace(wanted or members.Wanted(), name=s.member or (wanted.name if wanted else None))
        return s.path, None if s.name is None else resolve.for_outline(self.declarations(), s.name).drop("rung"), asked

    def outline(self, selector: str | None = None, level: int | None = None, wanted: members.Wanted | None = None, doc: bool = False, numbers: bool = False, fold: bool = False, limit: int = 200, budget: int | None = None) -> DataFrame:
        """file_path, at, line, is_test: the outline of what a selector means. Without a level a budget (bytes) chooses the
        deepest rung within it; else it is 0, or 2 where a member or something to expand was asked for."""
        path, roots, asked = self._scoped(selector, wanted)
        if level is None:
            level = self.budget_level(selector, budget, wanted) if budget is not None else 2 if asked.name or asked.expand else 0
        d = self.declarations()
        tags = self.table("directives") if doc else None
        contents = None
        if level >= members.FULL or asked.expand:
            shown = (d if path is None else d.where(scope.in_path_or_named(F.col("file_path"), path))) if roots is None else roots
            contents = self._contents(shown if level >= members.FULL else members.expanded_leaves(shown, asked))
        return reports.outline(d, self.table("doc_comments"), path, level, asked, tags, contents, roots, "{ ... }" if fold else "{}", numbers, limit)

    def ladder(self, selector: str | None = None, wanted: members.Wanted | None = None, limit: int = 200) -> DataFrame:
        """level, bytes, estimated: what each rung of the outline costs."""
        path, roots, asked = self._scoped(selector, wanted)
        return reports.ladder(self.declarations(), self.table("doc_comments"), path, asked, roots=roots, limit=limit)

    def budget_level(self, selector: str | None, budget: int, wanted: members.Wanted | None = None) -> int:
        """The deepest rung whose bytes are within a budget; 0 if none is."""
        return ranks.deepest_within(self.ladder(selector, wanted).select("level", "bytes"), budget).first().level

    def weave(self, path: str | None = None, summary: bool = False, access: str | None = None, spi: str | None = None, section: str | None = None) -> str:
        """The project as Markdown: book, then files with docs, directives, and the source of declarations; signatures only for
        a summary."""
        d = self.declarations()
        contents = None if summary else self._contents(d if path is None else d.where(scope.in_path(F.col("file_path"), path)))
        return reports.weave({t: self.table(t) for t in schema.TABLES}, d, path, contents, access, spi, section)

    def body(self, decl: dict) -> str:
        """Source of one declaration, from a file that is as it was indexed."""
        self.require_fresh([decl["file_path"]])
        data = (self.project.root / decl["file_path"]).read_bytes()
        return data[decl["decl_offset"] : decl["decl_offset"] + decl["decl_length"]].decode()
