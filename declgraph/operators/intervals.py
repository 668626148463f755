"""Interval operators as sweeps: rows of a key in order of place, one pass with what is open at the moment.

Work is a sort and a pass, whatever a key holds: no row is met with all others of its key. A key of more than HOT rows falls into
TILES parts by place, and a range is dealt to every part that it reaches into, so no part needs another one. Rows with a null
in key, place or length hold nothing and are held by nothing.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a key beyond which it is cut, and parts of such a key.
HOT, TILES = 100_000, 64
#: Ranges that have ended are cleared away when so many are held.
_CLEAR = 64


def _cuts(places: DataFrame) -> DataFrame | None:
    """(key, cuts) of the hot keys of places (k, s): where their parts but the first begin; None if no key is hot, which one
    count by key tells beforehand."""
    hot = places.groupBy("k").agg(F.count("*").alias("n")).where((F.col("n") > HOT) & F.col("k").isNotNull()).select("k")
    if hot.isEmpty():
        return None
    inner = [k / TILES for k in range(1, TILES)]
    return places.join(hot, "k").groupBy("k").agg(F.array_distinct(F.percentile_approx("s", inner, 1000)).alias("cuts"))


def _tile(at: Column) -> Column:
    """The part of its key that a place lies in: 0 for keys that are not cut, else from 1 on."""
    return F.when(F.col("cuts").isNull(), 0).otherwise(1 + F.size(F.filter("cuts", lambda c: c <= at)))


def _earlier() -> WindowSpec:
    """The parts of a key before this one, TILES at most."""
    return Window.partitionBy("k").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)


def _dealt(rows: DataFrame, cuts: DataFrame | None, until: str | None = None) -> DataFrame:
    """rows (k, s, ...) with tile; those with `until` in every part from that of s to that of until."""
    if cuts is None:
        return rows.withColumn("tile", F.lit(0))
    met = rows.join(cuts, "k", "left").withColumn("tile", _tile(F.col("s")))
    if until is not None:
        met = met.withColumn("tile", F.explode(F.sequence("tile", F.greatest(F.col("tile"), _tile(F.col(until))))))
    return met.drop("cuts")


def _events(holders: DataFrame, asking: DataFrame, inside: bool) -> DataFrame:
    """Both in order of their part and place. Asking ranges come before the equal holders (what is equal holds nothing), asking
    points after all holders that begin there."""
    cuts = _cuts(holders.select("k", "s"))
    held = _dealt(holders.where("k is not null and s is not null and e is not null and id is not null"), cuts, "e").withColumn("asks", F.lit(False))
    asked = _dealt(asking, cuts).withColumn("asks", F.lit(True))
    both = held.unionByName(asked, allowMissingColumns=True).repartition("k", "tile")
    order = (F.desc("e"), F.desc("asks")) if inside else (F.col("asks"),)
    return both.sortWithinPartitions("k", "tile", "s", *order)


class _Shortest:
    """Open ranges that can be the shortest one for what comes: ends rise, and so do lengths with ids. One that ends earlier
    than another and is no shorter is never asked for again."""

    def __init__(self) -> None:
        self.ends: list = []
        self.values: list[tuple] = []

    def open(self, start, end, i) -> None:
        value, ends, values = (end - start, i), self.ends, self.values
        high = bisect_left(ends, end)
        if high < len(ends) and values[high] <= value:
            return
        low = high
        if high < len(ends) and ends[high] == end:
            high += 1
        while low and values[low - 1] >= value:
            low -= 1
        ends[low:high], values[low:high] = [end], [value]

    def passed(self, start) -> None:
        if len(self.ends) > _CLEAR:
            gone = bisect_left(self.ends, start)
            del self.ends[:gone], self.values[:gone]


class _Open(_Shortest):
    """All open ranges, by their ends."""

    def open(self, start, end, i) -> None:
        at = bisect_left(self.ends, end)
        self.ends.insert(at, end)
        self.values.insert(at, i)


_NAMES = ("k", "tile", "s", "e", "id", "asks")


def _swept(holding: Callable[[], _Shortest], answer: Callable[[_Shortest, object, list, int], None]) -> Callable:
    """Calls answer(open ranges, end of what asks, its row in the batch) in order; the state goes with each part of a key."""

    def run(batch: pa.RecordBatch, state: dict, found: list) -> None:
        for row, (k, tile, s, e, i, asks) in enumerate(zip(*(batch.column(n).to_pylist() for n in _NAMES), strict=True)):
            if state.get("at") != (k, tile):
                state["at"], state["open"] = (k, tile), holding()
            if not asks:
                state["open"].passed(s)
                state["open"].open(s, e, i)
            elif k is not None and s is not None and e is not None:
                answer(state["open"], e, found, row)

    return run


def _arrow(fields: dict[str, T.DataType]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType([T.StructField(n, t) for n, t in fields.items()]))


def _nearest(holders: DataFrame, asking: DataFrame, inside: bool, keep: list[str], owner: str) -> DataFrame:
    """Rows of asking, of which `keep` is returned, with the shortest holder, or null."""
    rows = asking.select("k", "s", "e", F.struct(*(F.col(c).alias(f"c{j}") for j, c in enumerate(keep))).alias("row"))
    events = _events(holders, rows, inside)
    types = {f"c{j}": asking.schema[c].dataType for j, c in enumerate(keep)} | {"owner": holders.schema["id"].dataType}
    schema, find = _arrow(types), bisect_left if inside else bisect_right

    def answer(open_: _Shortest, end, found: list, row: int) -> None:
        at = find(open_.ends, end)
        if at < len(open_.ends):
            found[row] = open_.values[at][1]

    sweep = _swept(_Shortest, answer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            found: list = [None] * len(batch)
            sweep(batch, state, found)
            asks = batch.column("asks")
            kept = batch.column("row").filter(asks).flatten()
            owners = pa.array([f for f, a in zip(found, asks.to_pylist(), strict=True) if a], schema.field("owner").type)
            yield pa.RecordBatch.from_arrays([*kept, owners], names=schema.names)

    out = events.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in types.items()]))
    return out.select(*(F.col(f"c{j}").alias(c) for j, c in enumerate(keep)), F.col("owner").alias(owner))


def _ranges(df: DataFrame, key: str, start: str, length: str, row_id: str) -> DataFrame:
    return df.select(F.col(key).alias("k"), F.col(start).alias("s"), (F.col(start) + F.col(length)).alias("e"), F.col(row_id).alias("id"))


def innermost_owner(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, length: str, range_id: str, point_id: str) -> DataFrame:
    """points with owner: the shortest range of the same key that holds the point (of equal ones the smallest id), or null.
    Every row of points gives one row; empty ranges hold none."""
    holders = _ranges(ranges, key, start, length, range_id).where("e > s")
    names = points.columns
    asking = points.toDF(*(f"p{j}" for j in range(len(names))))
    place = lambda c: F.col(f"p{names.index(c)}")
    asking = asking.select("*", place(key).alias("k"), place(at).alias("s"), place(at).alias("e"))
    out = _nearest(holders, asking, False, [f"p{j}" for j in range(len(names))], "owner")
    return out.toDF(*names, "owner")


def contained(outer: DataFrame, inner: DataFrame, key: str, start: str, length: str, row_id: str) -> DataFrame:
    """(outer_id, inner_id) of ranges strictly inside ranges of the same key; work grows with these pairs."""
    holders, asking = _ranges(outer, key, start, length, row_id), _ranges(inner, key, start, length, row_id)
    types = {"outer_id": holders.schema["id"].dataType, "inner_id": asking.schema["id"].dataType}
    schema = _arrow(types)
    events = _events(holders, asking, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            found: list = []
            ids = batch.column("id").to_pylist()
            sweep(batch, state, found)
            for k in range(0, len(found), 1024):  # each with its open ranges
                part = found[k : k + 1024]
                pairs = [(o, ids[row]) for held, row in part for o in held]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pairs, strict=True) if pairs else ([], []), schema, strict=True)], schema=schema)

    def answer(open_: _Shortest, end, found: list, row: int) -> None:
        held = open_.values[bisect_left(open_.ends, end) :]
        if held:
            found.append((held, row))

    sweep = _swept(_Open, answer)
    return events.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in types.items()]))


def drop_nested(df: DataFrame, key: str, start: str, length: str, row_id: str) -> DataFrame:
    """Rows that lie strictly inside another row's range go.

    Of the rows before a row (by start, the longer first) the furthest end, and of those with that end the first start, say
    whether one of them holds it. Parts of a hot key take the furthest end of the parts before them along."""
    names = df.columns
    rows = df.toDF(*(f"p{j}" for j in range(len(names))))
    place = lambda c: F.col(f"p{names.index(c)}")
    rows = rows.withColumns({"k": place(key), "s": place(start), "e": place(start) + place(length)})
    cuts = _cuts(rows.select("k", "s"))
    reach = F.max(F.struct("e", (-F.col("s")).alias("back")))
    own = Window.partitionBy("k", "tile").orderBy("s", F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)
    rows = _dealt(rows, cuts)
    seen = rows.withColumn("seen", reach.over(own))
    if cuts is not None:
        parts = rows.where("tile > 0").groupBy("k", "tile").agg(reach.alias("reach")).select("k", "tile", F.max("reach").over(_earlier()).alias("earlier"))
        seen = seen.join(parts, ["k", "tile"], "left").withColumn("seen", F.greatest("seen", "earlier"))
    held = (F.col("seen.e") > F.col("e")) | ((F.col("seen.e") == F.col("e")) & (-F.col("seen.back") < F.col("s")))
    return seen.where(F.col("k").isNull() | ~F.coalesce(held, F.lit(False))).select(*(F.col(f"p{j}").alias(n) for j, n in enumerate(names)))


def smallest_enclosing(inner: DataFrame, outer: DataFrame, key: str, start: str, length: str, row_id: str) -> DataFrame:
    """(inner_id, outer_id): the shortest range of outer (then the smallest id) strictly around each range of inner."""
    holders, asking = _ranges(outer, key, start, length, row_id), _ranges(inner, key, start, length, row_id).withColumnRenamed("id", "inner_id")
    return _nearest(holders, asking, True, ["inner_id"], "outer_id").where("outer_id is not null")


def overlap_sum(ranges: DataFrame, others: DataFrame, key: str, range_id: str, low: str, high: str, other_low: str, other_high: str, name: str) -> DataFrame:
    """Sum of the lengths of overlaps (ends inclusive) of each range with all others of its key; ranges without are left out.

    The places up to x that others cover, each as often as it is covered, follow from how many have begun and ended by then,
    and from the sums of their ends: one running sum over all ends. The difference at a range's two ends is its overlap."""
    o = others.select(F.col(key).alias("k"), F.col(other_low).cast("long").alias("a"), F.col(other_high).cast("long").alias("b")).where("k is not null and a <= b")
    r = ranges.select(F.col(key).alias("k"), F.col(range_id).alias("id"), F.col(low).cast("long").alias("a"), F.col(high).cast("long").alias("b")).where("k is not null and a <= b")
    # covered places up to x: x * n + c, summed over what has begun (n = 1, c = 1 - a) and ended (n = -1, c = b)
    ends = F.explode(F.array(F.struct(F.col("a").alias("s"), F.lit(1).alias("n"), (1 - F.col("a")).alias("c")), F.struct(F.col("b").alias("s"), F.lit(-1).alias("n"), F.col("b").alias("c"))))
    asks = F.explode(F.array(F.struct((F.col("a") - 1).alias("s"), F.lit(-1).alias("sign")), F.struct(F.col("b").alias("s"), F.lit(1).alias("sign"))))
    moved = o.select("k", ends.alias("x")).select("k", "x.*")
    asked = r.select("k", "id", asks.alias("x")).select("k", "id", "x.*")
    both = moved.unionByName(asked, allowMissingColumns=True).withColumns({"n": F.coalesce("n", F.lit(0)), "c": F.coalesce("c", F.lit(0))})
    cuts = _cuts(both.select("k", "s"))
    both = _dealt(both, cuts)
    c = F.col("c").cast("decimal(38,0)")
    own = Window.partitionBy("k", "tile").orderBy("s", F.col("sign").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    run = both.withColumns({"rn": F.sum("n").over(own), "rc": F.sum(c).over(own)}).where("sign is not null")
    begun, covered = F.col("rn"), F.col("rc")
    if cuts is not None:
        parts = both.where("tile > 0").groupBy("k", "tile").agg(F.sum("n").alias("tn"), F.sum(c).alias("tc"))
        parts = parts.select("k", "tile", F.sum("tn").over(_earlier()).alias("bn"), F.sum("tc").over(_earlier()).alias("bc"))
        run = run.join(parts, ["k", "tile"], "left")
        begun, covered = begun + F.coalesce("bn", F.lit(0)), covered + F.coalesce("bc", F.lit(0))
    up_to = F.col("s") * begun.cast("decimal(19,0)") + covered
    total = F.sum(F.col("sign") * up_to).cast("long").alias(name)
    return run.groupBy("id").agg(total).where(F.col(name) > 0).select(F.col("id").alias(range_id), name)
