"""Personal data and the terms that disclose it, with SQL functions only.

Protected entities are emails, addresses, card and phone numbers. Terms near an entity are counted over the corpus; a term
discloses an entity by its pointwise mutual information with it, as a share of the entity's own information content:

    PMI(e, t) = log2(N * c(e, t) / (df(e) * df(t)))        IC(e) = log2(N / df(e))

with N documents, df(x) documents that hold x, and c(e, t) documents where a context of e holds t, each document counted once by
its text, so copies are one. A term needs to be seen LEAST_CONTEXTS times with e: in so many documents or contexts of them. From GENERALISE on a term gives way to its class in documents that hold e, from REMOVE on it is removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Code points before and after an entity that are its context.
CONTEXT = 120
#: Shares of an entity's information from which on a term is generalised, or removed; and contexts that must show it.
GENERALISE, REMOVE, LEAST_CONTEXTS = 0.75, 0.95, 2
#: Candidate terms up to this number are broadcast to the counting pass; more are joined by shuffle.
MOST_BROADCAST = 1_000_000

#: Documents with spans up to this number are broadcast to the texts (some hundred bytes each); more are joined by shuffle.
MOST_MARKED = 200_000
KINDS = ("email", "ip", "card", "phone")
# A look-behind or \G (the end of the last match) keeps a search from starting again at each character of a long run, and
# possessive repeats from going back; both leave the leftmost matches as they are. Fewer than 14 digits never make a card.
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to occur; cheap to look for.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_TERM = r"(?<!\p{L})\p{L}{3,}(?!\p{L})"
#: Matches in one text from which on they are taken in stretches.
MANY = 100
_SPAN = "struct<start:long,rank:int,end:long,kind:string,value:string>"


def _spans(text: Column, pattern: Column, kind: str, rank: int) -> Column:
    """All matches as spans in code points: what lies between matches and the matches themselves, added up. Matches are taken
    in stretches of about the root of their number, so that lists which grow by copying stay short."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), m.alias("value")))
    none = F.array().cast(f"array<{_SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.when(x["value"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).cast(f"array<{_SPAN}>").alias("out")))

    def stretch(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step)

    def joined(each: Column) -> Column:
        begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("bases"))
        bases = F.aggregate(each, begin, lambda acc, e: F.struct((acc["at"] + e["at"]).alias("at"), F.concat(acc["bases"], F.array(acc["at"])).alias("bases")))["bases"]
        moved = F.zip_with(each, bases, lambda e, base: F.transform(e["out"], lambda s: F.struct((s["start"] + base).alias("start"), s["rank"].alias("rank"), (s["end"] + base).alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
        return F.flatten(moved)

    def all_of(pairs: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(pairs).cast("double"))).cast("int"), F.lit(1))
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / size).cast("int")), lambda k: stretch(F.slice(pairs, k * size + 1, size)))
        return joined(parts)

    # the array is bound to a name, so that it is made once
    return F.flatten(F.transform(F.array(pairs), lambda p: F.when(F.size(p) > MANY, all_of(p)).otherwise(stretch(p)["out"])))


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _is_valid(kind: str) -> Callable[[Column], Column]:
    return lambda span: _valid(kind, span["value"])


def base_spans(text: Column) -> Column:
    """Spans of the four kinds by start, then kind as listed: array of (start, rank, end, kind, value)."""
    none = F.array().cast(f"array<{_SPAN}>")
    each = []
    for rank, kind in enumerate(KINDS):
        hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(_HINTS[kind])
        each.append(F.when(hint, F.filter(_spans(text, F.lit(_PATTERNS[kind]), kind, rank), _is_valid(kind))).otherwise(none))
    return F.array_sort(F.concat(*each))


def _entity(span: Column) -> Column:
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"].isin("card", "phone"), F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"])))


def _context(text: Column, span: Column) -> Column:
    """The text around a span, hashed, and its different terms; a term that the edge may have cut is left out."""
    before = F.concat(F.lit(" "), F.substring(text, F.greatest(span["start"] - CONTEXT + 1, F.lit(1)).cast("int"), F.least(span["start"], F.lit(CONTEXT)).cast("int")))
    after = F.substring(text, (span["end"] + 1).cast("int"), F.lit(CONTEXT))
    cut_before = F.when(span["start"] > CONTEXT, F.regexp_replace(before, r"^ \p{L}+", " ")).otherwise(before)
    cut_after = F.when(F.length(after) == CONTEXT, F.regexp_replace(after, r"\p{L}++$", "")).otherwise(after)
    around = F.lower(F.concat(cut_before, F.lit(" "), cut_after))
    return F.struct(F.xxhash64(around).alias("context"), F.array_distinct(F.regexp_extract_all(around, F.lit(_TERM), F.lit(0))).alias("terms"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(found, terms). found has a row for each row of docs: id, key (hash of id and text), base (spans). terms has the
    disclosing terms of documents: key, term, remove (else to be generalised).

    Null texts are empty and have no spans; null ids are kept; equal rows share a key, and equal texts count as one document for terms.
    An empty table gives none. Texts are scanned twice and only those with entities and disclosing terms are shuffled.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    rows = rows.withColumn("document", F.xxhash64("text"))
    spotted = rows.withColumn("base", base_spans(F.col("text")))
    contexts = F.transform("base", lambda s: F.struct(_entity(s).alias("entity"), _context(F.col("text"), s).alias("around")))
    found = common.materialize(spotted.select("id", "key", "document", "base", contexts.alias("contexts")), "entities")
    seen = found.where(F.size("contexts") > 0).select("key", "document", F.explode("contexts").alias("c")).select("key", "document", "c.entity", "c.around.context", "c.around.terms")
    of_entity = seen.groupBy("entity").agg(F.count_distinct("document").alias("df_e"))
    pairs = seen.select("entity", "document", "context", F.explode("terms").alias("term")).distinct()
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("sightings"), F.count_distinct("document").alias("c")).where(F.col("sightings") >= LEAST_CONTEXTS)
    pairs = common.materialize(pairs, "pairs")
    wanted = pairs.select("term").distinct()
    if pairs.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    copied = found.groupBy("document").agg(F.count("*").alias("n")).where("n > 1").select("document", F.col("document").alias("copy"))
    if copied.count() <= MOST_BROADCAST:  # texts that only one row has need no distinct
        rows = rows.join(F.broadcast(copied), "document", "left")
    else:
        rows = rows.withColumn("copy", F.col("document"))
    words = rows.select("copy", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_TERM), F.lit(0)))).alias("term"))
    words = words.join(wanted, "term", "left_semi").groupBy("term", "copy").agg(F.count("*").alias("n"))
    of_term = words.groupBy("term").agg(F.sum(F.when(F.col("copy").isNull(), F.col("n")).otherwise(1)).alias("df_t"))
    total = float(found.select("document").distinct().count())
    information = F.log2(F.lit(total) / F.col("df_e"))
    share = F.log2(F.lit(total) * F.col("c") / (F.col("df_e") * F.col("df_t"))) / information
    strong = pairs.join(of_term, "term").join(of_entity, "entity").where(information > 0).withColumn("share", share).where(F.col("share") >= GENERALISE)
    held = seen.select("key", "entity").distinct()
    terms = held.join(strong.select("entity", "term", "share"), "entity").groupBy("key", "term").agg((F.max("share") >= REMOVE).alias("remove"))
    return found.drop("document", "contexts"), common.materialize(terms, "terms")


def _term_spans(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key and term spans of the documents that have disclosing terms; a removed term has rank 4, a generalised one 5."""
    lists = terms.groupBy("key").agg(F.collect_set(F.when(F.col("remove"), F.col("term"))).alias("out"), F.collect_set(F.when(~F.col("remove"), F.col("term"))).alias("general"))
    lists = F.broadcast(lists) if terms.select("key").distinct().count() <= MOST_MARKED else lists
    rows = docs.select(F.coalesce(text_col, F.lit("")).alias("text"), F.xxhash64(id_col, F.coalesce(text_col, F.lit(""))).alias("key")).join(lists, "key").dropDuplicates(["key"])

    def of(column: str, rank: int) -> Column:
        pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.array_sort(column), "|"), F.lit(r")(?!\p{L})"))
        return F.when(F.size(column) > 0, _spans(F.col("text"), pattern, "term", rank)).otherwise(F.array().cast(f"array<{_SPAN}>"))

    return rows.select("key", F.concat(of("out", 4), of("general", 5)).alias("terms"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key, base and all: base spans, and those with the term spans that no base span touches, in order of start."""
    found, terms = find(docs, id_col, text_col)
    met = found.join(_term_spans(docs, terms, id_col, text_col), "key", "left")
    free = F.filter(F.coalesce("terms", F.array().cast(f"array<{_SPAN}>")), lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    return met.select("id", "key", "base", F.array_sort(F.concat("base", free)).alias("all"))


def digest(of: str | Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def general(term: Column) -> Column:
    """The class that stands for a term: an acronym, a name (with a capital) or a word. Far more documents hold a term of a
    class than the term, so the class discloses next to nothing."""
    return F.when(term.rlike(r"^\p{Lu}+$"), "[acronym]").when(term.rlike(r"^\p{Lu}"), "[name]").otherwise("[word]")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with entities replaced by their kind in brackets, disclosing terms generalised to their class or removed. Other
    columns, rows and their number stay; a null text stays null. Of spans that overlap, one replacement is written."""
    keyed = docs.withColumn("__key", F.xxhash64(id_col, F.coalesce(text_col, F.lit(""))))
    marked = spans(docs, id_col, text_col).where(F.size("all") > 0).dropDuplicates(["key"]).select(F.col("key").alias("__k"), F.col("all").alias("__all"))
    marked = common.materialize(marked, "marked")
    side = F.broadcast(marked) if marked.count() <= MOST_MARKED else marked
    met = keyed.join(side, F.col("__key") == F.col("__k"), "left")
    text = F.col(text_col)
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        word = F.when(s["rank"] == 4, F.lit("")).when(s["rank"] == 5, general(s["value"])).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        new = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), word)
        inside = s["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(new).alias("out"))

    done = F.aggregate("__all", begin, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return met.withColumn(text_col, F.when(F.col("__all").isNull(), text).otherwise(done)).select(*docs.columns)
