"""Raw logs: scanning files, JSON lines with error isolation, dialect detection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runloom.functions.paths import strip
from runloom.operators.slices import dense_index


def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file: path, text, digest. A run log is one file, read in one piece."""
    rows = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    text = F.regexp_replace("value", "^﻿", "")
    return rows.select(F.col("_metadata.file_path").alias("path"), text.alias("text"), F.sha2("value", 256).alias("sha256"))


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else.

    The parser stops behind the first value, so the text is tried as the only element of a list and as a member's value:
    no text that goes on closes both. As a member it is only gone through, not built.
    """
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.json_object_keys(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return alone.isNotNull() & member.isNotNull()


def parse_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejected). Blank lines are skipped; a bad last line without line end is still being written
    and dropped; any other bad line rejects its file, with the line number."""
    rows = docs.select("path", F.split("text", r"\r?\n").alias("_l"))
    rows = rows.select("path", F.size("_l").alias("_n"), F.posexplode("_l").alias("pos", "line"))
    rows = rows.filter(strip(F.col("line")) != "").withColumn("ok", is_json(F.col("line")))
    open_tail = ~F.col("ok") & (F.col("pos") == F.col("_n") - 1)
    rows = rows.filter(~open_tail)
    rejected = rows.filter("not ok").groupBy("path").agg((F.min("pos") + 1).cast("bigint").alias("line_no"))
    events = rows.join(rejected, "path", "left_anti").select("path", F.col("pos").cast("bigint").alias("line_no"), "line")
    return events, rejected


def number_events(events: DataFrame) -> DataFrame:
    """Dense event number per file."""
    return dense_index(events, "path", F.col("line_no"), [], name="event_no")


#: Fixed value: the members of an object that tell its dialect.
HEAD = ", ".join(f"{name} STRING" for name in (
    "_cc_format", "_codex_format", "_pi_format", "_dsh_format", "_icode_format", "_cursor_format", "_codearts_format", "format", "export_metadata", "_chrys_export",
    "info", "messages", "meta", "state", "trajectory", "session", "type", "id",
))


def object_head(text: Column) -> Column:
    """The members of one JSON object that tell its dialect, in one reading."""
    return F.from_json(text, HEAD)


def member(head: Column, path: str) -> Column:
    """What ``get_json_object`` finds at ``path`` in the object whose :func:`object_head` is given."""
    name = re.split(r"[.\[]", path[2:])[0]
    rest = path[2 + len(name) :]
    return F.get_json_object(head[name], f"${rest}") if rest else head[name]


def first_events(events: DataFrame, n: int = 12) -> DataFrame:
    """The first ``n`` events of every file with their dense number; all others are dropped before anything is exchanged."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy("line_no"))
    return events.withColumn("_n", rank).filter(F.col("_n") <= n).withColumn("event_no", (F.col("_n") - 1).cast("bigint")).drop("_n")


def event_format(events: DataFrame) -> DataFrame:
    """Dialect of an event stream from its first twelve events (path, event_no, line)."""
    get = lambda p: F.get_json_object("line", p)
    kind = get("$.type")
    created = F.expr("try_variant_get(try_parse_json(line), '$.createdAt', 'double')")
    told = F.expr("schema_of_variant(variant_get(try_parse_json(line), '$.createdAt', 'variant'))")
    number = created.isNotNull() & ~F.coalesce(told.isin("STRING", "BOOLEAN"), F.lit(False))
    head = events.filter("event_no < 12").select(
        "path", "event_no", kind.alias("type"), get("$.id").alias("id"),
        (number | get("$.delegationDepth").isNotNull() | get("$.agentPreset").isNotNull() | F.coalesce(get("$.origin") == "subagent", F.lit(False))).alias("marked"),
    )
    first = lambda c: F.max(F.when(F.col("event_no") == 0, F.col(c)))
    facts = head.groupBy("path").agg(
        first("type").alias("type"), first("id").alias("id"), first("marked").alias("marked"),
        F.bool_or((F.col("event_no") > 0) & F.coalesce(F.col("type").contains("/"), F.lit(False))).alias("slashed"),
    )
    session = (F.col("type") == "session") & (F.col("id") != "")
    return facts.select(
        "path",
        F.when(F.col("type") == "session_meta", "codex")
        .when(F.coalesce(session, F.lit(False)) & (F.col("marked") | F.col("slashed")), "dsh")
        .when(F.coalesce(session, F.lit(False)), "pi").otherwise("unknown").alias("format"),
    )


def object_format(text: Column, head: Column | None = None) -> Column:
    """Dialect of one JSON object, by the first rule that fits; with its ``head`` the text itself isn't read."""
    get = (lambda p: F.get_json_object(text, p)) if head is None else (lambda p: member(head, p))
    is_list = lambda p: F.coalesce(get(p).startswith("["), F.lit(False))
    is_object = lambda p: F.coalesce(get(p).startswith("{"), F.lit(False))
    source, version = get("$.export_metadata.source_format"), get("$.export_metadata.schema_version")
    session = is_object("$.info") & is_list("$.messages")
    spoken = F.coalesce(get("$.state.messages[0].contents").startswith("["), F.lit(False)) & (
        F.coalesce(get("$.state.messages[0].type") == "message", F.lit(False))
        | F.coalesce(get("$.state.messages[0].role").isin("user", "assistant", "tool"), F.lit(False))
    )
    expanded = F.coalesce(get("$._chrys_export.format") == "chrys-expanded-session-v1", F.lit(False)) & is_list("$.state.messages")
    rules = F
    for flag, name in (("_cc_format", "ccsession"), ("_codex_format", "codex"), ("_pi_format", "pi"), ("_dsh_format", "dsh"), ("_icode_format", "icode"), ("_cursor_format", "cursor")):
        rules = rules.when(get(f"$.{flag}") == "true", F.lit(name))
    return (
        rules.when(get("$.format") == "ccsession-trajectory", "ccsession")
        .when((source == "cursor_composer") & session, "cursor")
        .when((get("$._codearts_format") == "true") | ((version == "2") & (source == "codearts_opencode_sqlite") & session), "codearts")
        .when((version == "2") & (source == "codearts_legacy_json") & is_list("$.messages"), "codearts")
        .when(expanded | (F.coalesce(get("$.meta.session_id") != "", F.lit(False)) & spoken), "icode")
        .when(session, "opencode")
        .otherwise("unknown")
    )


def resolve_format(detected: Column, hint: Column) -> Column:
    """(format, error): no hint takes what was found, a hint names the unknown, a wrong hint is an error."""
    free = F.coalesce(hint, F.lit("")).isin("", "auto")
    fits = free | (detected == "unknown") | (detected == hint)
    chosen = F.when(free, detected).when(fits, hint)
    error = F.when(~fits, F.concat(F.lit("format mismatch: expected "), hint, F.lit(", found "), detected))
    return F.struct(chosen.alias("format"), error.alias("error"))


def one_event_list(text: Column) -> Column:
    """A one-element list that holds an object dump is that object."""
    inner = F.get_json_object(text, "$[0]")
    single = F.trim(text).startswith("[") & inner.startswith("{") & F.get_json_object(text, "$[1]").isNull()
    dump = object_format(inner) != "unknown"
    return F.when(single & dump, inner).otherwise(text)


def iso_millis(text: Column) -> Column:
    """ISO-8601 to epoch milliseconds; outside the years 1970-9999 null."""
    ms = F.unix_millis(F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")))
    return valid_millis(ms)


def valid_millis(ms: Column) -> Column:
    return F.when((ms > 0) & (ms <= 253402300799999), ms)


def duplicates(docs: DataFrame) -> DataFrame:
    """Files with equal content, each with the first path that has it."""
    first = docs.groupBy("sha256").agg(F.min("path").alias("first_path"), F.count("*").alias("copies"))
    return docs.select("path", "sha256").join(first, "sha256")


def tree_digest(docs: DataFrame, parents: DataFrame) -> DataFrame:
    """Digest of a parent log with its children: the hash of their digests in order of path.

    A parent has the few sub-agent logs it spawned. ``parents``: path, root.
    """
    rows = docs.join(parents, "path").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("path", "sha256"))).alias("_m"))
    return rows.select("root", F.sha2(F.array_join(F.transform("_m", lambda m: m["sha256"]), ""), 256).alias("tree_sha256"), F.size("_m").cast("bigint").alias("files"))
