"""Shell lines cut into words as a shell would, quotes and all, and what they run.

The characters of the distinct commands are rows; an automaton over them knows for each whether it is quoted. Scripts that
a command hands to another shell are commands of the next round, so no line is parsed in one piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.operators.automaton import look_up, run_automaton, table_of
from runloom.operators.slices import running, with_slice
from runloom.session import cut_lineage
from runloom.vocab import SEARCH_EXECUTABLES

SPACE, PUNCTUATION, SINGLE, DOUBLE, ESCAPE, OTHER = range(6)
#: Between words, in a word, in single and in double quotes, behind an escape in a word and in double quotes, in punctuation.
STATES = ("between", "word", "single", "double", "escaped", "escaped in double", "punctuation")
_OPEN = {SINGLE: "single", DOUBLE: "double", ESCAPE: "escaped", OTHER: "word", SPACE: "between", PUNCTUATION: "punctuation"}


def _next(state: str, symbol: int) -> str:
    if state == "single":
        return "word" if symbol == SINGLE else "single"
    if state == "double":
        return {DOUBLE: "word", ESCAPE: "escaped in double"}.get(symbol, "double")
    if state == "escaped":
        return "word"
    return "double" if state == "escaped in double" else _OPEN[symbol]


TABLE = table_of(STATES, range(6), _next)
#: Whether a character begins a word, begins punctuation, or stands for itself.
_BARE = ("between", "word", "punctuation")
BEGINS = [[1 if s in ("between", "punctuation") and x not in (SPACE, PUNCTUATION) else 2 if s in ("between", "word") and x == PUNCTUATION else 0 for x in range(6)] for s in STATES]
SHOWN = [[(s in _BARE and x in (OTHER, PUNCTUATION)) or (s == "single" and x != SINGLE) or (s == "double" and x not in (DOUBLE, ESCAPE)) or s.startswith("escaped") for x in range(6)] for s in STATES]

# Wrappers with the options that take a value, keywords, shells, navigation.
VALUE_OPTIONS = {
    "env": ("-u", "--unset", "-C", "--chdir", "-S", "--split-string"),
    "git": ("-C", "-c", "--git-dir", "--work-tree", "--namespace", "--super-prefix", "--config-env"),
    "sudo": ("-u", "--user", "-g", "--group", "-h", "--host", "-p", "--prompt", "-C", "--close-from", "-r", "--role", "-t", "--type", "-T", "--command-timeout", "-D", "--chdir", "-R", "--chroot", "-U", "--other-user"),
    "time": ("-f", "--format", "-o", "--output"),
    "nice": ("-n", "--adjustment"),
    "timeout": ("-k", "--kill-after", "-s", "--signal"),
    "xargs": ("-a", "--arg-file", "-E", "--eof", "-I", "--replace", "-L", "--max-lines", "-n", "--max-args", "-P", "--max-procs", "-s", "--max-chars"),
}
PLAIN_WRAPPERS = ("env", "sudo", "time", "nice", "nohup", "xargs")
KEYWORDS = ("busybox", "if", "then", "elif", "while", "until", "do", "!")
SHELLS = ("bash", "dash", "ksh", "sh", "zsh")
NAVIGATION = ("cd", "pushd", "popd")
PYTHON = r"^(?:pythonw?|pypy)\d*(?:\.\d+)*(?:\.exe)?$"
PYTHON_VALUES = ("-W", "-X", "-Q", "--check-hash-based-pycs")
#: Rounds of wrappers taken off, and of scripts inside scripts.
WRAPPED, NESTED = 12, 3


def words(commands: DataFrame) -> DataFrame:
    """(command_id, segment, tokens) of (command_id, command): the words of each simple command, in order.

    Segments end at ; & | ( ) and line ends outside quotes. A command whose quotes don't close has none.
    """
    text = F.when(F.col("command").rlike(r"(?i)[A-Za-z]:\\|\.exe\b"), F.replace("command", F.lit("\\"), F.lit("/"))).otherwise(F.col("command"))
    chars = commands.select("command_id", F.posexplode(F.split(text, "")).alias("pos", "ch")).filter(F.col("ch") != "")
    chars = with_slice(chars.withColumn("pos", F.col("pos").cast("bigint")), idx="pos")
    c = F.col("ch")
    symbol = F.when(c.isin(" ", "\t", "\r"), SPACE).when(c.isin(*";&|()\n"), PUNCTUATION).when(c == "'", SINGLE).when(c == '"', DOUBLE).when(c == "\\", ESCAPE).otherwise(OTHER)
    chars = cut_lineage(chars.withColumn("symbol", symbol.cast("int")))
    rows = run_automaton(chars, TABLE, F.col("symbol"), keys=("command_id",), order=("pos",))
    begins = look_up(BEGINS, F.col("state"), F.col("symbol"))
    number = [[STATES[n] for n in row] for row in TABLE]
    rows = rows.withColumns({"begins": begins, "shown": look_up(SHOWN, F.col("state"), F.col("symbol")), "after": look_up(number, F.col("state"), F.col("symbol"))})
    open_ = rows.groupBy("command_id").agg(F.max_by("after", "pos").alias("last")).filter(~F.col("last").isin(*_BARE)).select("command_id")
    rows = cut_lineage(rows.join(open_, "command_id", "left_anti"))
    rows = running(rows, {"token": F.when(F.col("begins") > 0, 1).otherwise(0), "segment": F.when(F.col("begins") == 2, 1).otherwise(0)}, keys=["command_id"], order=["pos"])
    # behind an escape in double quotes only a quote or an escape loses the backslash
    kept = F.when((F.col("state") == STATES.index("escaped in double")) & ~F.col("symbol").isin(DOUBLE, ESCAPE), F.concat(F.lit("\\"), F.col("ch"))).when(F.col("shown"), F.col("ch")).otherwise("")
    inside = ~((F.col("symbol") == SPACE) & F.col("state").isin(*[STATES.index(s) for s in _BARE]))
    rows = rows.filter(inside).withColumn("kept", kept)
    tokens = rows.groupBy("command_id", "segment", "token").agg(
        F.max("begins").alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "kept"))), lambda x: x["kept"]), "").alias("text")
    ).filter("kind = 1")
    held = tokens.groupBy("command_id", "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("token", "text"))), lambda x: x["text"]).alias("tokens"))
    return held.select("command_id", F.col("segment").cast("bigint").alias("segment"), "tokens")


def _base(word: Column) -> Column:
    return F.element_at(F.split(F.replace(word, F.lit("\\"), F.lit("/")), "/"), -1)


def _name(tokens: Column, at: int = 0) -> Column:
    return F.lower(_base(F.coalesce(F.get(tokens, F.lit(at)), F.lit(""))))


def _drop(tokens: Column, count: Column) -> Column:
    return F.slice(tokens, count + 1, F.size(tokens))


def _after_options(tokens: Column, values: tuple[str, ...]) -> Column:
    """``tokens`` without the options that lead them; one of ``values`` takes the next word along, -- ends them."""
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("done"), F.lit(False).alias("value"))

    def step(s: Column, word: Column) -> Column:
        ends = word == "--"
        option = word.startswith("-") & (word != "-") & ~ends
        takes = option & word.isin(*values) if values else F.lit(False)
        return (
            F.when(s["done"], s)
            .when(s["value"], F.struct((s["n"] + 1).alias("n"), F.lit(False).alias("done"), F.lit(False).alias("value")))
            .when(ends, F.struct((s["n"] + 1).alias("n"), F.lit(True).alias("done"), F.lit(False).alias("value")))
            .when(option, F.struct((s["n"] + 1).alias("n"), F.lit(False).alias("done"), takes.alias("value")))
            .otherwise(F.struct(s["n"].alias("n"), F.lit(True).alias("done"), F.lit(False).alias("value")))
        )

    return _drop(tokens, F.aggregate(tokens, start, step)["n"])


def _plain(tokens: Column) -> Column:
    """Without the assignments that lead it."""
    first = F.coalesce(F.array_position(F.transform(tokens, lambda t: t.rlike(r"^[\p{L}_][\p{L}\p{N}_]*=")), False), F.lit(0))
    return F.when(first == 0, F.slice(tokens, 1, 0)).otherwise(_drop(tokens, first.cast("int") - 1))


def _windows_timeout(tokens: Column) -> Column:
    return F.exists(F.slice(tokens, 2, 3), lambda t: F.lower(t).isin("/t", "/nobreak") | F.lower(t).startswith("/t:")) & F.coalesce(F.get(tokens, F.lit(1)).startswith("/"), F.lit(False))


def peeled(tokens: Column) -> Column:
    """What is left of a simple command without assignments and wrappers."""

    def once(t: Column, _: Column) -> Column:
        t = _plain(t)
        name, rest = _name(t), F.slice(t, 2, F.size(t))
        rules = F
        for wrapper in PLAIN_WRAPPERS:
            rules = rules.when(name == wrapper, _after_options(rest, VALUE_OPTIONS.get(wrapper, ())))
        asked = F.coalesce(F.get(rest, F.lit(0)).isin("-v", "-V"), F.lit(False))
        rules = rules.when((name == "command") & ~asked, _after_options(rest, ()))
        # the first word after timeout's options is the time
        rules = rules.when((name == "timeout") & ~_windows_timeout(t), F.slice(_after_options(rest, VALUE_OPTIONS["timeout"]), 2, F.size(rest)))
        return rules.when(name.isin(*KEYWORDS), rest).otherwise(t)

    return F.aggregate(F.sequence(F.lit(1), F.lit(WRAPPED)), tokens, once)


def _script(tokens: Column) -> Column:
    """The script that a shell is given with -c, or ``cmd`` with /c."""
    name, rest = _name(tokens), F.slice(tokens, 2, F.size(tokens))
    start = F.struct(F.lit(None).cast("string").alias("found"), F.lit(False).alias("next"), F.lit(False).alias("done"))

    def step(s: Column, word: Column) -> Column:
        flags = F.regexp_replace(word, "^-+", "")
        state = lambda found, take, done: F.struct(found.alias("found"), take.alias("next"), done.alias("done"))
        return (
            F.when(s["done"], s).when(s["next"], state(word, F.lit(False), F.lit(True)))
            .when(~word.startswith("-"), state(s["found"], F.lit(False), F.lit(True))).otherwise(state(s["found"], flags.contains("c"), F.lit(False)))
        )

    by_shell = F.aggregate(rest, start, step)["found"]
    at = F.array_position(F.transform(rest, lambda w: F.lower(w).isin("/c", "/k")), True)
    by_cmd = F.when(at > 0, F.array_join(_drop(rest, at.cast("int")), " "))
    return F.when(name.isin(*SHELLS), by_shell).when(name.isin("cmd", "cmd.exe"), by_cmd)


def _python(tokens: Column) -> Column:
    """Label of a python call: its module or script; else the interpreter."""
    name, rest = _name(tokens), F.slice(tokens, 2, F.size(tokens))
    start = F.struct(F.lit(None).cast("string").alias("label"), F.lit("").alias("await"))

    def step(s: Column, word: Column) -> Column:
        told = lambda label, wait: F.struct(label.alias("label"), F.lit(wait).alias("await"))
        base = F.when(word == "-", name).when(_base(word) != "", _base(word)).otherwise(name)
        return (
            F.when(s["label"].isNotNull(), s).when(s["await"] == "module", told(word, "")).when(s["await"] == "value", told(s["label"], ""))
            .when(s["await"] == "script", told(base, "")).when(word == "--", told(s["label"], "script")).when(word == "-m", told(s["label"], "module")).when(word == "-c", told(name, ""))
            .when(word.isin(*PYTHON_VALUES), told(s["label"], "value")).when(word.startswith("-") & (word != "-"), told(s["label"], "")).otherwise(told(base, ""))
        )

    return F.coalesce(F.aggregate(rest, start, step)["label"], name)


def runs(commands: DataFrame) -> DataFrame:
    """(command_id, path, name, label, git) of every simple command, also those in scripts handed to shells.

    ``path``: its place, from the outside in. ``name``: the executable, ``label``: what it goes by; ``git``: git's own command.
    """
    level = commands.select("command_id", F.array().cast("array<bigint>").alias("path"), "command")
    found = None
    for depth in range(NESTED + 1):
        named = level.select(F.xxhash64("command_id", "path").alias("key"), "command_id", "path", "command")
        named = cut_lineage(named)
        cut = words(named.select(F.col("key").alias("command_id"), "command")).withColumnRenamed("command_id", "key")
        rows = named.drop("command").join(cut, "key").select("command_id", F.concat("path", F.array("segment")).alias("path"), peeled(F.col("tokens")).alias("tokens")).filter(F.size("tokens") > 0)
        rows = cut_lineage(rows)
        script = _script(F.col("tokens")) if depth < NESTED else F.lit(None).cast("string")
        rows = rows.withColumn("script", script)
        here = rows.filter("script is null").select(
            "command_id", "path", _name(F.col("tokens")).alias("name"),
            F.when(_name(F.col("tokens")).rlike(PYTHON), _python(F.col("tokens"))).otherwise(_name(F.col("tokens"))).alias("label"),
            F.when(_name(F.col("tokens")) == "git", _name(_after_options(F.slice("tokens", 2, F.size("tokens")), VALUE_OPTIONS["git"]))).alias("git"),
        )
        found = here if found is None else found.unionByName(here)
        level = rows.filter("script is not null").select("command_id", "path", F.col("script").alias("command"))
        if level.isEmpty():
            break
    return cut_lineage(found)


def labels(commands: DataFrame) -> DataFrame:
    """(command_id, label, searches) of (command_id, command): the first command that isn't mere navigation (a single one counts), and whether any searches.

    Equal commands are read once. A line whose quotes don't close goes by its first word that is no assignment.
    """
    distinct = cut_lineage(commands.select("command").filter(F.trim("command") != "").distinct().withColumn("command_id", F.xxhash64("command")))
    every = runs(distinct)
    searching = F.col("name").isin(*SEARCH_EXECUTABLES) | F.coalesce(F.col("git") == "grep", F.lit(False))
    told = every.groupBy("command_id").agg(
        F.min_by("label", F.when(~F.col("name").isin(*NAVIGATION), F.col("path"))).alias("_doing"), F.min_by("label", "path").alias("_first"), F.count("*").alias("_n"), F.bool_or(searching).alias("searches")
    )
    tokens = F.filter(F.split(F.trim("command"), r"\s+"), lambda w: ~w.rlike(r"^[\p{L}_][\p{L}\p{N}_]*="))
    rough = F.lower(_base(F.coalesce(F.get(tokens, F.lit(0)), F.lit(""))))
    rows = distinct.join(told, "command_id", "left").select("command", F.coalesce("_doing", F.when(F.col("_n") == 1, F.col("_first")).when(F.col("_n") > 1, ""), rough).alias("_label"), F.coalesce("searches", F.lit(False)).alias("_searches"))
    return commands.join(rows, "command", "left").select("command_id", F.coalesce("_label", F.lit("")).alias("label"), F.coalesce("_searches", F.lit(False)).alias("searches"))
