"""Facts about one tool call, as column expressions over the calls table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from runloom import vocab
from runloom.functions.paths import strip

def _filled(value: Column) -> Column:
    return F.when(value != "", value)


def status_failed(status: Column) -> Column:
    return F.coalesce(F.lower(status).isin(*vocab.FAILURE_STATUSES), F.lit(False))


def failed() -> Column:
    """Failure status, a non-zero exit code, or an error text."""
    return (
        status_failed(F.col("status"))
        | F.coalesce(F.col("exit_code") != 0, F.lit(False))
        | F.coalesce(F.col("error") != "", F.lit(False))
        | F.coalesce(F.col("error_type") != "", F.lit(False))
    )


def is_tool(names: tuple[str, ...], column: str = "tool_name") -> Column:
    return F.coalesce(F.col(column).isin(*names), F.lit(False))


def is_plan() -> Column:
    return F.coalesce(F.lower("tool_name").isin(*vocab.PLAN_TOOLS), F.lit(False))


def is_mcp(name: Column) -> Column:
    return name.startswith("mcp__") | name.contains("__") | name.contains("-")


def error_kind() -> Column:
    return F.when(is_tool(vocab.SYSTEM_TOOLS), "system").otherwise("tool")


def write_path() -> Column:
    path = F.coalesce(*[_filled(F.col(f"input.{key}")) for key in vocab.WRITE_PATH_KEYS])
    return F.replace(path, F.lit("\\"), F.lit("/"))


def skill_name() -> Column:
    trimmed = [strip(F.col(f"input.{key}")) for key in vocab.SKILL_KEYS]
    named = F.coalesce(*[_filled(c) for c in trimmed], F.lit("(unnamed skill)"))
    return F.when(F.lower("tool_name").isin(*vocab.SKILL_TOOLS), named)


def duration_ms() -> Column:
    """Wall clock of the call, else its execution window, else a reported duration."""
    reported = F.coalesce("duration_ms", "meta_total_ms")
    return F.coalesce(
        F.when(F.col("time_updated") >= F.col("time_created"), F.col("time_updated") - F.col("time_created")).cast("double"),
        F.when(F.col("time_end") >= F.col("time_start"), F.col("time_end") - F.col("time_start")).cast("double"),
        F.when(reported > 0, reported),
    )


def stats_duration_ms() -> Column:
    return F.when(~is_tool(vocab.SPAWN_TOOLS), duration_ms())


def window_ms() -> Column:
    """(start, end) by the same precedence as ``duration_ms``."""
    return F.coalesce(
        F.when(
            F.col("time_updated") >= F.col("time_created"),
            F.struct(F.col("time_created").alias("start"), F.col("time_updated").alias("end")),
        ),
        F.when(
            F.col("time_end") >= F.col("time_start"),
            F.struct(F.col("time_start").alias("start"), F.col("time_end").alias("end")),
        ),
    )


def _headline(text: Column) -> Column:
    return F.split(strip(text), "\n")[0]


def error_pattern() -> Column:
    """Text the failure is known by: a whole first line, so long messages that differ late stay apart."""
    bad_status = status_failed(F.col("status"))
    return (
        F.when(F.coalesce(F.col("error") != "", F.lit(False)), _headline(F.col("error")))
        .when(
            F.coalesce(F.col("exit_code") != 0, F.lit(False)),
            F.concat(F.lit("exit code "), F.col("exit_code").cast("string")),
        )
        .when(bad_status & F.coalesce(F.col("output") != "", F.lit(False)), _headline(F.col("output")))
        .when(bad_status, F.concat(F.lit("status: "), F.lower("status")))
        .when(F.coalesce(F.col("error_type") != "", F.lit(False)), strip(F.col("error_type")))
        .otherwise("unknown error")
    )


# Ordered marks of a failed tool's output and the class each one means.
ERROR_MARKS = (
    ("command not found", "platform_error"),
    ("not recognized as", "platform_error"),
    ("command timed out", "platform_error"),
    ("Permission denied", "permission_error"),
    ("permission denied", "permission_error"),
    ("rule which prevents", "permission_error"),
    ("must read file", "permission_error"),
    ("No such file or directory", "missing_file"),
    ("cannot find the path", "missing_file"),
    ("ENOENT", "missing_file"),
    ("out of range", "bad_input"),
    ("ripgrep failed", "tool_error"),
)


def error_class(text: Column) -> Column:
    """Class of the first mark found in the text; null when there is none."""
    rules = F
    for mark, kind in ERROR_MARKS:
        rules = rules.when(text.contains(mark), F.lit(kind))
    return rules.otherwise(F.lit(None))


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_validation(command: Column) -> Column:
    lowered = F.lower(squash(command))
    return F.coalesce(reduce(lambda a, b: a | b, [lowered.contains(f) for f in vocab.VALIDATION_FRAGMENTS]), F.lit(False))


def hint() -> Column:
    """Title, else the first telling input, in one line of at most 64 characters."""
    keys = ("command", "file_path", "path", "pattern", "description", "prompt")
    text = F.coalesce(*[_filled(squash(c)) for c in [F.col("title"), *[F.col(f"input.{k}") for k in keys]]], F.lit(""))
    return F.when(F.length(text) > 64, F.concat(F.substring(text, 1, 63), F.lit("…"))).otherwise(text)


# Wrappers that stand before the real command, and navigation commands.
WRAPPERS = ("env", "sudo", "time", "nice", "nohup", "xargs", "command", "busybox")
NAVIGATION = ("cd", "pushd", "popd")

_SEGMENT = r"&&|\|\||[;|&()\n]"
_OPTION = r"(?:\s+-(?:[ughpCrtTDRnksafoEILP]\s+\S+|\S+))*"
_WRAPPER = (
    rf"^(?:(?:[A-Za-z_][A-Za-z0-9_]*=\S*|(?:env|sudo|time|nice|nohup|xargs|command|busybox){_OPTION}"
    rf"|timeout{_OPTION}\s+[0-9.]+[smhd]?|(?:\S*/)?(?:ba|da|k|z)?sh(?:\s+-\w+)*\s+-\w*c"
    r"|if|then|elif|while|until|do|!)\s+)+"
)


def segments(command: Column) -> Column:
    """Commands of an unquoted shell line, wrappers and assignments removed, in order."""
    parts = F.transform(
        F.split(command, _SEGMENT),
        lambda part: F.regexp_replace(F.regexp_replace(F.trim(part), r"""["']""", ""), _WRAPPER, ""),
    )
    return F.filter(parts, lambda part: (part != "") & ~part.rlike(r"^[A-Za-z_][A-Za-z0-9_]*=\S*$"))


def _head(part: Column) -> Column:
    return F.regexp_replace(F.split(part, r"\s+")[0], r"^.*[/\\]", "")


def label_segment(part: Column) -> Column:
    """Executable name; python is labelled by its module or script."""
    head = _head(part)
    option = r"(?:\s+(?:-[WXQ]\s+\S+|-(?![mc](?:\s|$))\S+))*"
    module = F.regexp_extract(part, rf"^\S+{option}\s+-m\s+(\S+)", 1)
    script = F.regexp_extract(part, rf"^\S+{option}\s+(?:[^-\s]\S*[/\\])?([^-\s/\\][^\s/\\]*)", 1)
    python = head.rlike(r"^(?:pythonw?|pypy)[0-9.]*(?:\.exe)?$")
    return F.when(python & (module != ""), module).when(python & (script != ""), script).otherwise(head)


def primary_command(command: Column) -> Column:
    """Label of the first segment that is not mere navigation; '' for a blank line."""
    parts = segments(command)
    doing = F.filter(parts, lambda part: ~_head(part).isin(*NAVIGATION))
    return F.coalesce(label_segment(F.coalesce(F.get(doing, F.lit(0)), F.get(parts, F.lit(0)))), F.lit(""))


def runs_search(command: Column) -> Column:
    from runloom.vocab import SEARCH_EXECUTABLES

    def searching(part: Column) -> Column:
        return _head(part).isin(*SEARCH_EXECUTABLES) | part.rlike(r"^(?:\S*/)?git\s+(?:-\S+\s+)*grep(?:\s|$)")

    return F.coalesce(F.exists(segments(command), searching), F.lit(False))


def chart_name() -> Column:
    """Tool label: shell calls go by their primary command."""
    line = F.coalesce(F.when(strip(F.col("input.command")) != "", F.col("input.command")), F.col("title"))
    shell = primary_command(line)
    return F.when(is_tool(vocab.BASH_TOOLS) & (shell != ""), shell).otherwise(F.col("tool_name"))


def is_search() -> Column:
    shell = is_tool(vocab.BASH_TOOLS)
    return is_tool(vocab.SEARCH_TOOLS) & (~shell | runs_search(F.col("input.command")))


def found_nothing() -> Column:
    return strip(F.coalesce("output", F.lit(""))).isin(*vocab.EMPTY_OUTPUTS)


def search_signature() -> Column:
    """What a search call asked for, comparable across calls; null when it is not a search."""
    pattern = strip(F.coalesce("input.pattern", F.lit("")))
    path = strip(F.coalesce("input.path", F.lit("")))
    asked = F.concat(pattern, F.lit("|"), path)
    command = squash(F.coalesce("input.command", F.lit("")))
    other = F.coalesce(*[_filled(F.col(f"input.{k}")) for k in ("pattern", "query", "path")], F.lit(""))
    signature = (
        F.when(is_tool(("Grep", "grep")), F.when(pattern != "", F.concat(F.lit("grep:"), asked)))
        .when(is_tool(("Glob", "glob")), F.when(pattern != "", F.concat(F.lit("glob:"), asked)))
        .when(is_tool(vocab.BASH_TOOLS), F.when(command != "", F.concat(F.lit("bash:"), command)))
        .otherwise(F.concat("tool_name", F.lit(":"), other))
    )
    return F.when(is_search(), signature)


def shell_paths(command: Column) -> Column:
    """Path-like tokens of a shell command."""
    quoted = F.regexp_extract_all(command, F.lit(vocab.SHELL_PATH_PATTERN), F.lit(1))
    bare = F.regexp_extract_all(command, F.lit(vocab.SHELL_PATH_PATTERN), F.lit(2))
    both = F.zip_with(quoted, bare, lambda q, b: F.when(q != "", q).otherwise(b))
    cut = F.transform(both, lambda p: F.regexp_replace(p, r"[,:]+$", ""))

    def telling(path: Column) -> Column:
        core = F.regexp_replace(path, r"[/\\]+$", "")
        last = F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]+)/*$", 1)
        return (F.length(path) >= 2) & ~core.isin("", "..") & last.rlike(r"[\p{L}\p{N}]")

    return F.filter(cut, telling)


def shell_writes(command: Column) -> Column:
    stripped = F.trim(command)
    tests = [stripped.startswith(f) | command.contains(f" {f}") for f in vocab.SHELL_WRITE_FRAGMENTS]
    return reduce(lambda a, b: a | b, tests)


def shell_read_pattern(command: Column) -> Column:
    rules = F
    for pattern in vocab.SHELL_READ_PATTERNS:
        rules = rules.when(command.rlike(pattern), F.lit(pattern))
    return rules.otherwise(F.lit(None))


def base_command(command: Column) -> Column:
    """First word that is not a VAR=value assignment."""
    words = F.split(F.trim(command), r"\s+")
    named = F.filter(words, lambda w: ~w.contains("=") | w.startswith("="))
    return F.coalesce(F.get(named, F.lit(0)), F.get(words, F.lit(0)), F.lit(""))
