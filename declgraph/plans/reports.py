"""Reports over the index tables: shape sections, recipes, outlines with their cost, Markdown."""

from __future__ import annotations

import re
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import members, ranks, scope
from ..schema import ACCESS, CALLABLE, TYPE_KINDS, normal_access, rank

RECIPES = {
    "sections": "SELECT t.value AS section, count(DISTINCT d.file_id) AS files, count(*) AS declarations FROM {directives} t JOIN {declarations} d ON d.id = t.decl_id WHERE t.tag = 'ai:section' GROUP BY t.value ORDER BY declarations DESC, section",
    "mass": "SELECT f.path, count(d.id) AS declarations, coalesce(sum(CASE WHEN d.container IS NULL THEN d.decl_length END), 0) AS bytes FROM {files} f LEFT JOIN {declarations} d ON d.file_id = f.id GROUP BY f.path ORDER BY declarations DESC, f.path",
    "invariants": "SELECT f.path, d.decl_id, t.value FROM {directives} t JOIN {declarations} d ON d.id = t.decl_id JOIN {files} f ON f.id = d.file_id WHERE t.tag = 'ai:invariant' ORDER BY f.path, d.start_line",
    "protocols": "SELECT protocol_name, count(*) AS n FROM {conformances} GROUP BY protocol_name ORDER BY n DESC, protocol_name",
}


def recipe(name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A named question, asked of the tables it names."""
    wanted = {t: df for t, df in tables.items() if "{" + t + "}" in RECIPES[name]}
    return next(iter(wanted.values())).sparkSession.sql(RECIPES[name], **wanted)


def documented(decls: DataFrame, docs: DataFrame) -> DataFrame:
    """decls (id) with documented: whether a doc comment is there."""
    there = docs.select(F.col("decl_id").alias("id"), F.lit(True).alias("documented")).distinct()
    return decls.join(there, "id", "left").withColumn("documented", F.coalesce("documented", F.lit(False)))


def mass_per_file(files: DataFrame, decls: DataFrame) -> DataFrame:
    """path, declarations and bytes (of top-level declarations) of every file, also of those without any."""
    one = decls.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("container").isNull(), F.col("decl_length"))).alias("b"))
    return files.select("id", "path").join(one, "id", "left").select("path", F.coalesce("n", F.lit(0)).cast("long").alias("declarations"), F.coalesce("b", F.lit(0)).cast("long").alias("bytes"))


def fan_in(decls: DataFrame, docs: DataFrame, sites: DataFrame, bindings: DataFrame) -> DataFrame:
    """Undocumented callables with the number of declarations that call them in a way that a receiver bears out: none or
    self from the same container or to a top-level one, the container's name, or a binding of that type."""
    target = decls.where(F.col("kind").isin(*CALLABLE)).join(docs.select(F.col("decl_id").alias("id")), "id", "left_anti").select("id", "decl_id", "name", "container", "file_id")
    origin = decls.select(F.col("id").alias("from_decl"), F.col("container").alias("origin"))
    bound = bindings.select("from_decl", F.col("name").alias("receiver"), F.col("type").alias("bound")).distinct()
    calls = sites.where("kind = 'call'").select("name", "receiver", "from_decl").distinct().join(origin, "from_decl", "left").join(bound, ["from_decl", "receiver"], "left")
    bare = F.col("receiver").isNull() | F.col("receiver").isin("self", "Self")
    holds = (bare & (F.col("container").isNull() | F.coalesce(F.col("container") == F.col("origin"), F.lit(False)))) | F.coalesce(F.col("receiver") == F.col("container"), F.lit(False)) | F.coalesce(F.col("bound") == F.col("container"), F.lit(False))
    return target.join(calls, "name").where(holds).groupBy("id", "decl_id", "file_id").agg(F.count_distinct("from_decl").alias("callers"))


def sections(tables: dict[str, DataFrame], path: str | None = None, top: int = 10) -> dict[str, DataFrame]:
    """overview, mass, kinds, fold, coverage, directives, coupling, hotspots, fan_in of the files in scope."""
    files = tables["files"] if path is None else tables["files"].where(scope.in_path(F.col("path"), path))
    ids = files.select(F.col("id").alias("file_id"))
    held = {t: tables[t].join(ids, "file_id", "left_semi") for t in ("declarations", "imports", "call_sites", "conformances", "bindings")}
    d = held["declarations"]
    tags = tables["directives"].join(d.select(F.col("id").alias("decl_id")), "decl_id", "left_semi")
    mass = mass_per_file(files, d)
    docs = tables["doc_comments"]
    one = lambda df, name: df.agg(F.count("*").alias(name))
    test = scope.is_test_path(F.col("path"))
    overview = mass.agg(F.count("*").alias("files"), F.sum("declarations").alias("declarations"), F.sum("bytes").alias("source_bytes"), F.count_if(test).alias("test_files"), F.count_if(~test).alias("production_files"))
    for name, df in (("imports", held["imports"]), ("call_sites", held["call_sites"]), ("directives", tags)):
        overview = overview.crossJoin(F.broadcast(one(df, name)))  # one row each
    shape = mass.agg(F.coalesce(ranks.percentile("declarations", 0.5), F.lit(0)).alias("p50"), F.coalesce(ranks.percentile("declarations", 0.9), F.lit(0)).alias("p90"), F.max("declarations").alias("max"), F.count_if(F.col("declarations") == 0).alias("empty_files"))
    documented = d.join(docs.select(F.col("decl_id").alias("id"), F.lit(1).alias("doc")), "id", "left").groupBy(normal_access(F.col("access")).alias("access")).agg(F.count("*").alias("n"), F.count("doc").alias("documented"))
    fold = d.agg(F.coalesce(F.sum(F.when(F.col("container").isNull(), F.col("decl_length"))), F.lit(0)).alias("source_bytes"), F.coalesce(F.sum("body_length"), F.lit(0)).alias("body_bytes"))
    said = docs.join(d.select(F.col("id").alias("decl_id")), "decl_id", "left_semi").agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("doc_chars"))
    fold = fold.crossJoin(F.broadcast(said))  # one row each
    sectioned = d.join(tags.where("tag = 'ai:section'").select(F.col("decl_id").alias("id")), "id", "left_semi").select(F.col("file_id").alias("id")).distinct()
    names = files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path"))
    return {
        "overview": overview,
        "mass": shape.crossJoin(F.broadcast(ranks.concentration(mass, "declarations", 0.1, "top_decile_share"))),
        "densest": ranks.top(mass, top, F.desc("declarations"), "path"),
        "kinds": d.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines")).orderBy(F.desc("n"), "kind"),
        "fold": fold.withColumn("ratio", F.when(F.col("source_bytes") > 0, F.col("body_bytes") / F.col("source_bytes")).otherwise(0.0)),
        "coverage": documented.withColumn("ratio", F.col("documented") / F.col("n")).orderBy(rank(F.col("access"), ACCESS)),
        "directives": tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag"),
        "files_without_section": files.join(sectioned, "id", "left_anti").agg(F.count("*").alias("n")),
        "coupling": ranks.top(held["imports"].groupBy("module").agg(F.count_distinct("file_id").alias("files")), top, F.desc("files"), "module"),
        "protocols": ranks.top(held["conformances"].groupBy("protocol_name").agg(F.count("*").alias("n")), top, F.desc("n"), "protocol_name"),
        "hotspots": ranks.top(d.where("body_length is not null").where(F.col("kind").isin(*CALLABLE)).join(names, "file_id").select("decl_id", "file_path", "body_length"), top, F.desc("body_length"), "decl_id"),
        "fan_in": ranks.top(fan_in(d, docs, held["call_sites"], held["bindings"]).join(names, "file_id").select("decl_id", "file_path", "callers"), top, F.desc("callers"), "decl_id"),
    }


_LINES = "file_path string, at int, line string, is_test boolean"
_UNIT = "    "


def _reindented(text: str, pad: str) -> list[str]:
    """A slice of source under another indent; its first line begins at the declaration."""
    first, *rest = text.split("\n")
    common = min((len(x) - len(x.lstrip(" ")) for x in rest if x.strip()), default=0)
    return [pad + first.strip(), *(pad + x[common:] if x.strip() else "" for x in rest)]


def _forest(rows: list[dict]) -> list[dict]:
    """Rows of one file, in order of offset (the longer first), with the rows inside them; only types hold any."""
    top: list[dict] = []
    open_: list[dict] = []
    for r in rows:
        r["children"] = []
        while open_ and r["decl_offset"] + r["decl_length"] > open_[-1]["decl_offset"] + open_[-1]["decl_length"]:
            open_.pop()
        (open_[-1]["children"] if open_ else top).append(r)
        if r["kind"] in TYPE_KINDS:
            open_.append(r)
    return top


def _rendered(node: dict, depth: int, stub: str, numbers: bool, expanded: bool = False) -> list[str]:
    pad, expanded = _UNIT * depth, expanded or node["expanded"]
    lines = [f"{pad}/// {x}" for x in (node["doc"] or "").splitlines() if x] + [f"{pad}//# {t['tag']}: {t['value']}" for t in node["tags"]]

    def told(line: str) -> str:
        return f"{line}  // {node['start_line']}-{node['end_line']}" if numbers else line

    head = pad + node["header"]
    if node["kind"] in TYPE_KINDS:
        shown = [c for c in node["children"] if expanded or c["included"]]
        if not shown:
            return [*lines, told(f"{head} {{}}")]
        lines.append(told(f"{head} {{"))
        before = 0
        for c in shown:
            inner = _rendered(c, depth + 1, stub, numbers, expanded)
            if before and (before > 1 or len(inner) > 1):  # what spans lines stands apart
                lines.append("")
            lines += inner
            before = len(inner)
        return [*lines, f"{pad}}}"]
    if node["source"] is not None:
        whole = _reindented(node["source"], pad)
        return [*lines, told(whole[0]), *whole[1:]]
    if node["body_offset"] is None:
        return [*lines, told(head)]
    return [*lines, told(f"{head} {node['accessors'] or stub}")]


def outline(decls: DataFrame, docs: DataFrame, path: str | None, level: int, wanted: members.Wanted | None = None, directives: DataFrame | None = None, contents: DataFrame | None = None, roots: DataFrame | None = None, stub: str = "{}", numbers: bool = False, limit: int | None = None) -> DataFrame:
    """Lines of the outline of every file in scope, tests last; between two declarations that span lines an empty one.

    Level 0 shows top-level declarations, 1 also variables and cases, 2 all members, 3 their bodies; what `wanted` expands has
    its body at any level. Bodies come from contents (path, content) and are needed for these only. With directives, docs and
    directives are shown. roots, if given, are shown instead of top-level declarations; limit is the most of them.
    """
    d = decls if path is None else decls.where(scope.in_path_or_named(F.col("file_path"), path))
    asked = wanted or members.Wanted()
    asked = asked if asked.members is not None else replace(asked, members=members.RUNGS[min(level, members.FULL)])
    top = (members.included_roots(d, asked) if roots is None else members.outermost(roots)).select("id", scope.is_test_path(F.col("file_path")).alias("t"), "file_path", "start_line")
    if limit is not None:
        top = top.orderBy("t", "file_path", "start_line", "id").limit(limit)
    mark = lambda df, name: df.select("id", F.lit(True).alias(name)).distinct()
    held = d.join(mark(members.included(d, asked), "included"), "id", "left").join(mark(top, "root"), "id", "left")
    full = members.expanded_leaves(d, asked) if level < members.FULL else d.where(~F.col("kind").isin(*TYPE_KINDS))
    held = held.join(mark(full, "whole"), "id", "left")
    none = F.array().cast("array<struct<line:int,tag:string,value:string>>")
    if directives is None:
        held = held.withColumn("doc", F.lit(None).cast("string")).withColumn("tags", none)
    else:
        tags = directives.groupBy(F.col("decl_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("line", "tag", "value"))).alias("tags"))
        held = held.join(docs.select(F.col("decl_id").alias("id"), F.col("text").alias("doc")), "id", "left").join(tags, "id", "left").withColumn("tags", F.coalesce("tags", none))
    source = F.lit(None).cast("string")
    if contents is not None:
        held = held.join(contents.select(F.col("path").alias("file_path"), "content"), "file_path", "left")
        source = F.when(F.col("whole"), F.substring("content", (F.col("decl_offset") + 1).cast("int"), F.col("decl_length").cast("int")).cast("string"))
    has_body = F.col("body_offset").isNotNull()
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    rows = held.select(
        "file_id", "file_path", "kind", "start_line", "end_line", "decl_offset", "decl_length", "body_offset", "ordinal", tx.one_space(tx.header(F.col("signature"), F.col("kind"), has_body)).alias("header"),
        tx.accessors(F.col("signature"), F.col("kind")).alias("accessors"), "doc", "tags", source.alias("source"), flag("included"), flag("root"), asked.expanded().alias("expanded"),
    )

    def render(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["decl_offset"], -r["decl_length"], r["ordinal"]))
        out: list[str] = []

        def walk(nodes: list[dict]) -> None:
            for n in nodes:
                if n["root"]:
                    lines = _rendered(n, 0, stub, numbers)
                    out.extend([""] * bool(out and (len(lines) > 1 or out[-1][-1:] == "}")) + lines)
                else:
                    walk(n["children"])

        walk(_forest(rows))
        name = rows[0]["file_path"]
        return pa.table({"file_path": pa.array([name] * len(out), pa.string()), "at": pa.array(range(len(out)), pa.int32()), "line": pa.array(out, pa.string()), "is_test": pa.array([bool(re.search("(^|/)[^/]*Tests(/|$)", name))] * len(out), pa.bool_())})

    return rows.groupBy("file_id").applyInArrow(render, _LINES).orderBy("is_test", "file_path", "at")


def ladder(decls: DataFrame, docs: DataFrame, path: str | None = None, wanted: members.Wanted | None = None, **more) -> DataFrame:
    """level, bytes, estimated: three rungs measured, the one with bodies estimated from the third, by what its leaves' source
    has beyond their lines in it."""
    rungs = None
    for level in range(members.FULL):
        cost = outline(decls, docs, path, level, wanted, **more).agg(F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0)).alias("bytes")).select(F.lit(level).alias("level"), "bytes", F.lit(False).alias("estimated"))
        rungs = cost if rungs is None else rungs.unionByName(cost)
    d = decls if path is None else decls.where(scope.in_path_or_named(F.col("file_path"), path))
    asked = replace(wanted or members.Wanted(), members=members.RUNGS[members.FULL])
    leaves = members.included(d, asked).unionByName(members.included_roots(d, asked)).dropDuplicates(["id"]).where(~F.col("kind").isin(*TYPE_KINDS) & ~asked.expanded())
    has_body = F.col("body_offset").isNotNull()
    stub = F.octet_length(tx.one_space(tx.header(F.col("signature"), F.col("kind"), has_body))) + F.when(has_body, F.coalesce(F.octet_length(tx.accessors(F.col("signature"), F.col("kind"))), F.lit(2)) + 1).otherwise(0)
    extra = leaves.agg(F.coalesce(F.sum(F.greatest(F.lit(0), F.col("decl_length") - stub)), F.lit(0)).alias("more"))
    full = rungs.where(F.col("level") == members.FULL - 1).crossJoin(F.broadcast(extra)).select(F.lit(members.FULL).alias("level"), (F.col("bytes") + F.col("more")).alias("bytes"), F.lit(True).alias("estimated"))  # one row each
    return rungs.unionByName(full)


def trailer(costs: list[tuple[int, int, bool]], level: int, budget: int | None = None, chosen: bool = True) -> str | None:
    """The last line of an outline: what the budget led to, and what the next rungs cost."""
    def size(n: int) -> str:
        return f"{n} B" if n < 1000 else f"{n / 1000:.1f} KB"

    of = {rung: (n, estimated) for rung, n, estimated in costs}
    parts = []
    if budget is not None and not chosen:
        parts.append(f"--budget ignored: -L{level} was given")
    elif budget is not None and level in of and of[level][0] > budget:
        parts.append(f"budget {size(budget)} → -L{level} ({size(of[level][0])}, over budget — narrow the selector)")
    elif budget is not None:
        parts.append(f"budget {size(budget)} → -L{level}" + (f" ({'≈ ' if of[level][1] else ''}{size(of[level][0])})" if level in of else ""))
    after = [f"-L{rung} {'≈' if estimated else '='} {size(n)}" for rung, (n, estimated) in sorted(of.items()) if rung > level]
    parts += ["next: " + ", ".join(after)] if after else []
    return "// " + "; ".join(parts) if parts else None


def weave(tables: dict[str, DataFrame], decls: DataFrame, path: str | None = None, contents: DataFrame | None = None, access: str | None = None, spi: str | None = None, section: str | None = None) -> str:
    """Book, then every file with its sidecar, docs, directives and signatures, and with the source of leaves if contents
    (path, content) are given. The text is made on the driver, as its size is that of what is printed."""
    d = decls if path is None else decls.where(scope.in_path(F.col("file_path"), path))
    d = d if access is None else d.where(scope.access_floor(F.col("access"), access))
    d = d if spi is None else d.where(scope.spi_is(F.col("spi"), spi))
    d = d if section is None else scope.with_tag(d, tables["directives"], "ai:section", "id", "decl_id", section)
    tags = tables["directives"].groupBy("decl_id").agg(F.array_sort(F.collect_list(F.struct("line", "tag", "value"))).alias("tags"))
    rows = d.join(tables["doc_comments"].select(F.col("decl_id").alias("id"), F.col("text").alias("doc")), "id", "left").join(tags.withColumnRenamed("decl_id", "id"), "id", "left")
    source = F.lit(None).cast("string")
    if contents is not None:
        rows = rows.join(contents.select(F.col("path").alias("file_path"), "content"), "file_path", "left")
        source = F.when(~F.col("kind").isin(*TYPE_KINDS), F.substring("content", (F.col("decl_offset") + 1).cast("int"), F.col("decl_length").cast("int")).cast("string"))
    rows = rows.select("file_id", "file_path", "start_line", "ordinal", "decl_id", "signature", "doc", "tags", source.alias("source"))
    sides = {r.file_id: r.text for r in tables["narrative"].where("kind = 'sidecar'").collect()}
    out = [r.text for r in tables["narrative"].where("kind = 'book'").collect()]
    last = None
    for r in rows.orderBy("file_path", "start_line", "ordinal").toLocalIterator():
        if r.file_path != last:
            last = r.file_path
            out.append(f"## {last}")
            out += [sides[r.file_id]] if r.file_id in sides else []
        out.append(f"### {r.decl_id}")
        out += [r.doc] if r.doc else []
        out += [f"- **{t.tag}**: {t.value}" for t in (r.tags or [])]
        out.append(f"```swift\n{r.source or r.signature}\n```")
    return "\n\n".join(out) + "\n"
