"""Command lines as data: arguments parsed by the command tree, what a read asked for and aimed at, redaction.

All of it is column expressions over array<string>, so a log of any size is parsed without leaving the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The commands, their subcommands, and the options that take the argument after them.
GLOBAL_VALUES = ("--project",)
COMMAND_VALUES = {
    "init": (),
    "index": (),
    "doctor": (),
    "get": ("--fields", "--format", "--file", "--path", "--kind", "--container", "--name-like", "--tag", "--spi", "--limit", "--offset", "--body-mode", "--keep"),
    "code": ("-L", "--level", "--expand", "--access", "--spi", "--limit", "--budget", "--color"),
    "calls": ("-d", "--depth", "--min", "--file", "--limit"),
    "query": ("--recipe",),
    "stats": ("--section", "--top", "--since", "--window", "--buckets", "--format"),
    "weave": ("--output", "--section", "--access", "--spi"),
    "imports": ("--module", "--spi"),
    "clip": ("--file",),
    "move": ("--to", "--after", "--file"),
    "rename": ("--to", "--file"),
    "file": (),
    "file read": ("--lines",),
    "file write": ("--context",),
    "file append": ("--context",),
    "file log": ("--last",),
    "version": (),
}

_TOLD = "array<struct<name:string,value:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def normalised(argv: Column) -> Column:
    """-L2 as the two arguments it stands for; all others as they are."""
    return F.flatten(F.transform(argv, lambda t: F.when(t.rlike(r"^-L[0-9]+$"), F.array(F.substring(t, 1, 2), F.substring(t, 3, 1 << 20))).otherwise(F.array(t))))


def command_of(argv: Column) -> Column:
    """The command, with its subcommand if there is one; null for what is no command."""
    first, second = F.try_element_at(argv, F.lit(1)), F.try_element_at(argv, F.lit(2))
    both = F.concat_ws(" ", first, second)
    names = [F.lit(c) for c in COMMAND_VALUES]
    return F.when(both.isin(*names) & second.isNotNull(), both).when(first.isin(*names), first)


def _classes(rest: Column, taking: Column) -> Column:
    """One letter for each argument: an option that takes the next one (o), what it takes (v), a positional (p), an option with
    its value (e), a flag (f)."""
    letter = lambda acc, t: F.when(acc.endswith("o"), "v").when(~t.startswith("-") | (t == "-"), "p").when(F.locate("=", t) > 0, "e").when(F.array_contains(taking, t), "o").otherwise("f")
    return F.aggregate(rest, F.lit(""), lambda acc, t: F.concat(acc, letter(acc, t)))


def parsed(argv: Column) -> Column:
    """command, positionals, told (name and value of options, in order) and flags; null for what is no command.

    The command tree tells which options take the argument after them. An option it does not have, or one at the end without
    its argument, is a flag; - alone is a positional. One pass over the arguments tells what each is; lists are made from that."""
    pairs = [x for c, options in COMMAND_VALUES.items() for x in (F.lit(c), F.array(*(F.lit(o) for o in (*options, *GLOBAL_VALUES))))]
    taking = lambda command: F.try_element_at(F.create_map(*pairs), command)

    def lists(s: Column) -> Column:
        rest, size = s["rest"], F.size(s["rest"])
        of = lambda i: F.substring(s["classes"], i + 1, F.lit(1))
        pair = lambda name, held: F.struct(name.alias("name"), held.alias("value"))
        told = lambda t, i: F.when(of(i) == "e", pair(F.substring_index(t, "=", 1), F.substring(t, F.locate("=", t) + 1, F.length(t)))).when((of(i) == "o") & (i + 1 < size), pair(t, F.try_element_at(rest, i + 2)))
        positionals = F.filter(rest, lambda t, i: of(i) == "p")
        flags = F.filter(rest, lambda t, i: (of(i) == "f") | ((of(i) == "o") & (i + 1 == size)))
        return F.struct(s["command"].alias("command"), positionals.alias("positionals"), F.array_compact(F.transform(rest, told)).cast(_TOLD).alias("told"), flags.alias("flags"))

    def split(s: Column) -> Column:
        return _let(F.struct(s["command"].alias("command"), s["rest"].alias("rest"), _classes(s["rest"], s["taking"]).alias("classes")), lists)

    def known(s: Column) -> Column:
        words = F.size(F.split(s["command"], " "))
        rest = F.slice(s["argv"], words + 1, F.greatest(F.size(s["argv"]) - words, F.lit(0)))
        return F.when(s["command"].isNotNull(), _let(F.struct(s["command"].alias("command"), rest.alias("rest"), taking(s["command"]).alias("taking")), split))

    return _let(argv, lambda a: _let(F.struct(a.alias("argv"), command_of(a).alias("command")), known))


def with_call(df: DataFrame, argv: Column, name: str = "call") -> DataFrame:
    """Rows whose arguments are a command, with what they parse to; a generator, so that columns made of it do not parse anew."""
    return df.select("*", F.explode(F.array(parsed(argv))).alias(name)).where(F.col(name).isNotNull())


def value(call: Column, option: str) -> Column:
    """The last value that an option was given; null without one."""
    return F.try_element_at(F.filter(call["told"], lambda p: p["name"] == option), F.lit(-1))["value"]


def has(call: Column, option: str) -> Column:
    return F.array_contains(call["flags"], option) | F.exists(call["told"], lambda p: p["name"] == option)


def depth_label(call: Column) -> Column:
    """How deep a read asked to go; null for commands without depth."""
    rung = F.coalesce(value(call, "-L"), value(call, "--level"))
    extra = [F.when(has(call, f"--{x}"), F.lit(x)) for x in ("body", "expand", "doc")]
    outline = F.concat_ws("+", F.coalesce(F.concat(F.lit("L"), rung), F.lit("L default")), *extra)
    fields, mode = F.coalesce(value(call, "--fields"), F.lit("")), value(call, "--body-mode")
    record = F.when(fields.contains("body") | mode.isNotNull(), F.concat(F.lit("body:"), F.coalesce(mode, F.lit("ref")))).when(fields == "", "shell").otherwise("fields")
    return F.when(call["command"] == "code", outline).when(call["command"] == "get", record)


def target(call: Column) -> Column:
    """What a read was aimed at; the text of a query is no target."""
    return F.when(call["command"] != "query", F.try_element_at(call["positionals"], F.lit(1)))


def redacted(argv: Column) -> Column:
    """Arguments as they may be logged: the statement of a query gives way to <sql>, its options stay."""
    # fixed values: options of a query that take a value
    keeps = ("--recipe", "--project")
    before = F.concat(F.array(F.lit("")), F.slice(argv, 1, F.greatest(F.size(argv) - 1, F.lit(0))))
    hidden = F.transform(F.arrays_zip(argv.alias("t"), before.alias("b")), lambda p: F.when(p["t"].startswith("-") | p["b"].isin(*keeps) | (p["b"] == ""), p["t"]).otherwise("<sql>"))
    return F.when(F.try_element_at(argv, F.lit(1)) == "query", hidden).otherwise(argv)


def quoted(argv: Column) -> Column:
    """One line of a shell that gives these arguments."""
    plain = r"^[A-Za-z0-9_@%+=:,./-]+$"
    return F.array_join(F.transform(argv, lambda t: F.when(t.rlike(plain), t).otherwise(F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("'\\''")), F.lit("'")))), " ")
