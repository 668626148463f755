"""What an outline shows: selectors, kind groups, which members and roots take part, types to peek at.

Declarations are rows with id, file_id, file_path, container, kind, name, access, spi, signature, start_line, decl_offset and
decl_length. Nesting is containment of byte ranges in one file, found by joins with an equality on the file.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unicode_type_names
from ..schema import ACCESS, KIND_GROUPS, TYPE_KINDS, normal_access, rank
from . import scope

#: Types that a peek shows at most: the list is a report's, not a filter of data.
PEEK_LIMIT = 12
PEEK_KINDS = (*TYPE_KINDS, "typealias")


@dataclass(frozen=True)
class Selector:
    """A path or a name, and what members of it are called."""

    path: str | None = None
    name: str | None = None
    member: str | None = None

    @classmethod
    def parse(cls, text: str | None, root: str | Path) -> Selector:
        """target:member. The target is a path if it has a slash, ends in .swift, is a dot or is there under the root; a dot
        and the root itself mean everything."""
        target, _, member = (text or "").partition(":")
        if not target:
            return cls(member=member or None)
        root = Path(root).resolve()
        if "/" in target or target.endswith(".swift") or target == "." or (root / target).exists():
            return cls(path=relative(target, root) or None, member=member or None)
        return cls(name=target, member=member or None)


def relative(path: str, root: Path) -> str:
    """A path below the root as the index has it; empty for the root, unchanged outside it."""
    whole = Path(root, path).resolve()
    if whole == root:
        return ""
    return str(whole.relative_to(root)) if whole.is_relative_to(root) else path


def kinds_of(*groups: str) -> list[str]:
    """The kinds of kind groups: vars, funcs, types, cases; of all of them without a group."""
    return sorted({k for g in groups or KIND_GROUPS for k in KIND_GROUPS[g]})


@dataclass(frozen=True)
class Wanted:
    """What was asked for: kinds of members, kinds of roots, the least access, a system interface group, a part of the name,
    and what to expand."""

    members: tuple[str, ...] | None = None
    roots: tuple[str, ...] | None = None
    access: str | None = None
    spi: str | None = None
    name: str | None = None
    expand: str | None = None

    def allowed(self) -> Column:
        seen = F.lit(True) if self.access is None else scope.access_floor(F.col("access"), self.access)
        return seen & (F.lit(True) if self.spi is None else scope.spi_is(F.col("spi"), self.spi))

    def named(self) -> Column:
        return F.lit(True) if self.name is None else F.lower("name").contains(self.name.lower())

    def expanded(self) -> Column:
        return F.lower("name").contains(self.expand.lower()) if self.expand else F.lit(False)

    def own(self) -> Column:
        """Whether a member takes part by itself, whatever it holds. Expansion is no way past access or interface group."""
        kind = F.lit(True) if self.members is None else F.col("kind").isin(*self.members)
        return self.allowed() & (self.expanded() | (kind & self.named()))

    def own_root(self) -> Column:
        kind = F.lit(True) if self.roots is None else F.col("kind").isin(*self.roots)
        return self.allowed() & kind & self.named()


def _holders(decls: DataFrame, inner: DataFrame) -> DataFrame:
    """Ids of types around any of the rows of inner."""
    i = inner.select(F.col("file_id").alias("i_file"), F.col("decl_offset").alias("i_at"), F.col("decl_length").alias("i_size"))
    outer = decls.where(F.col("kind").isin(*TYPE_KINDS)).select("id", "file_id", "decl_offset", "decl_length")
    inside = (F.col("file_id") == F.col("i_file")) & (F.col("i_at") >= F.col("decl_offset")) & (F.col("i_at") + F.col("i_size") <= F.col("decl_offset") + F.col("decl_length")) & (F.col("i_size") < F.col("decl_length"))
    return outer.join(i, inside, "left_semi").select("id")


def included(decls: DataFrame, wanted: Wanted) -> DataFrame:
    """Members that an outline shows: those that take part by themselves, and types around any of them."""
    own = decls.where(wanted.own())
    return decls.join(own.select("id").unionByName(_holders(decls, own)).distinct(), "id", "left_semi")


def included_roots(decls: DataFrame, wanted: Wanted) -> DataFrame:
    """Top-level declarations that an outline lists: by kinds, access, group and name that were asked for, whatever a rung
    shows inside them; and types that hold a member that takes part."""
    own = decls.where(wanted.own())
    roots = decls.where("container is null")
    held = _holders(decls, own).join(roots, "id", "left_semi")
    return roots.join(roots.where(wanted.own_root()).select("id").unionByName(held).distinct(), "id", "left_semi")


#: Kinds of members that the rungs of an outline show; the last one also shows bodies.
RUNGS: tuple[tuple[str, ...], ...] = ((), tuple(kinds_of("vars", "cases")), tuple(kinds_of()), tuple(kinds_of()))
FULL = len(RUNGS) - 1


def outermost(decls: DataFrame) -> DataFrame:
    """Rows that lie inside no other row of the same file."""
    outer = decls.select(F.col("file_id").alias("o_file"), F.col("decl_offset").alias("o_at"), F.col("decl_length").alias("o_size"))
    inside = (F.col("file_id") == F.col("o_file")) & (F.col("decl_offset") >= F.col("o_at")) & (F.col("decl_offset") + F.col("decl_length") <= F.col("o_at") + F.col("o_size")) & (F.col("decl_length") < F.col("o_size"))
    return decls.join(outer, inside, "left_anti")


def expanded_leaves(decls: DataFrame, wanted: Wanted) -> DataFrame:
    """Declarations that are shown in full: those that match the expansion, or lie inside a type that does, and hold nothing."""
    match = decls.where(wanted.expanded())
    around = match.where(F.col("kind").isin(*TYPE_KINDS)).select(F.col("file_id").alias("o_file"), F.col("decl_offset").alias("o_at"), F.col("decl_length").alias("o_size"))
    inside = (F.col("file_id") == F.col("o_file")) & (F.col("decl_offset") >= F.col("o_at")) & (F.col("decl_offset") + F.col("decl_length") <= F.col("o_at") + F.col("o_size"))
    ids = match.select("id").unionByName(decls.join(around, inside, "left_semi").select("id")).distinct()
    return decls.join(ids, "id", "left_semi").where(~F.col("kind").isin(*TYPE_KINDS))


def peek(decls: DataFrame, leaves: DataFrame, shown: DataFrame, limit: int = PEEK_LIMIT) -> DataFrame:
    """Types of the project that the signatures of leaves name and that are not shown: by path and line, limit at most."""
    names = leaves.select(F.explode(unicode_type_names(F.col("signature"))).alias("name")).distinct()
    wanted = names.join(shown.select("name").distinct(), "name", "left_anti")  # names wanted minus shown
    return decls.where(F.col("kind").isin(*PEEK_KINDS)).join(wanted, "name", "left_semi").orderBy("file_path", "start_line", "id").limit(limit)


def by_access(column: str = "access") -> Column:
    """The fixed order of access levels, the most open first; others last."""
    return F.coalesce(rank(normal_access(F.col(column)), ACCESS), F.lit(len(ACCESS)))
