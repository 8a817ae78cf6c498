"""Canonical actions of a run: what each call did, to what, at what cost, with what effect."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom import vocab
from runloom.functions import calls as fc, paths
from runloom.operators import files
from runloom.operators.slices import carry

STEP = ["traj_id", "slice", "step_idx"]


def _search_target(pattern: Column, scope: Column) -> Column:
    return F.when(scope != "", F.concat(pattern, F.lit("@"), scope)).otherwise(pattern)


def _first_argument(command: Column) -> Column:
    words = F.split(F.trim(command), r"\s+")
    rest = F.slice(words, F.lit(2), F.greatest(F.lit(0), F.size(words) - 1))
    return F.coalesce(F.get(F.filter(rest, lambda w: ~w.startswith("-")), F.lit(0)), F.lit(""))


def _shell_kind(base: Column, command: Column) -> Column:
    in_place = ((base == "sed") & command.rlike(vocab.SED_IN_PLACE)) | (
        base.isin("awk", "gawk") & command.rlike(vocab.AWK_IN_PLACE)
    )
    return (
        F.when(base.isin(*vocab.SHELL_SEARCH), "SEARCH")
        .when(base.isin(*vocab.SHELL_READ), F.when(in_place, "FILE_WRITE").otherwise("FILE_READ"))
        .when(base.isin(*vocab.SHELL_WRITE), "FILE_WRITE")
    )


def reduced(command: Column) -> Column:
    """Finer action of a piped command, by its last stage; null when that stage tells nothing."""
    return paths.let(F.trim(F.substring_index(command, "|", -1)), _reduced_stage)


def _reduced_stage(last: Column) -> Column:
    kind = _shell_kind(F.split(last, r"\s+")[0], last)
    first = F.get(fc.shell_paths(last), F.lit(0))
    scope = F.coalesce(paths.target(first), F.lit(""))
    argument = _first_argument(last)
    target = F.when(kind == "SEARCH", F.when(argument != "", _search_target(argument, scope))).otherwise(paths.target(first))
    return F.when(kind.isNotNull() & target.isNotNull(), F.struct(kind.alias("action_type"), target.alias("target")))


def actions(steps: DataFrame, calls: DataFrame, parts: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row per call, plus one REASON per step that has text or reasoning (``act_pos`` -1).

    Step tokens are split over the step's non-REASON actions, the remainder going to the first.
    """
    command = F.coalesce("input.command", F.lit(""))
    # One projection for what the rules below use repeatedly.
    calls = calls.withColumns(
        {"_base": fc.base_command(command), "_first": F.get(fc.shell_paths(command), F.lit(0)), "_arg": _first_argument(command)}
    )
    base, first = F.col("_base"), F.col("_first")
    text = lambda *keys: F.coalesce(*[F.when(F.col(f"input.{k}") != "", F.col(f"input.{k}")) for k in keys], F.lit(""))
    shell = fc.is_tool(vocab.BASH_TOOLS)
    plain = ~command.contains("|")
    kind = _shell_kind(base, command)
    nav = shell & base.isin(*vocab.NAVIGATION_COMMANDS)
    mapped = shell & plain & kind.isNotNull()
    # The path a call is about, then one normalisation for all kinds.
    path = (
        F.when(fc.is_tool(vocab.COMPARE_READ_TOOLS), text("file_path", "filePath"))
        .when(fc.is_tool(vocab.WRITE_TOOLS), F.coalesce(fc.write_path(), F.lit("")))
        .when(fc.is_tool(vocab.COMPARE_SEARCH_TOOLS), text("path"))
        .when(mapped, F.coalesce(first, F.lit("")))
    )
    calls = calls.withColumns({"_path": paths.target(path), "_mapped": mapped, "_kind": kind, "_nav": nav, "_shell": shell})
    normal, mapped, kind = F.col("_path"), F.col("_mapped"), F.col("_kind")
    nav, shell = F.col("_nav"), F.col("_shell")
    action_type = (
        F.when(fc.is_tool(vocab.COMPARE_READ_TOOLS), "FILE_READ")
        .when(fc.is_tool(vocab.WRITE_TOOLS), "FILE_WRITE")
        .when(fc.is_tool(vocab.COMPARE_SEARCH_TOOLS), "SEARCH")
        .when(nav, "REASON")
        .when(mapped, kind)
        .when(shell, "COMMAND")
        .when(fc.is_tool(vocab.COMPARE_SPAWN_TOOLS), "AGENT_SPAWN")
        .when(fc.is_tool(vocab.COMPARE_PLAN_TOOLS), "REASON")
        .otherwise("COMMAND")
    )
    target = (
        F.when(fc.is_tool(vocab.COMPARE_READ_TOOLS + vocab.WRITE_TOOLS), normal)
        .when(fc.is_tool(vocab.COMPARE_SEARCH_TOOLS), _search_target(text("pattern"), normal))
        .when(nav, "")
        .when(mapped & (kind == "SEARCH"), _search_target(F.col("_arg"), normal))
        .when(mapped & (normal != ""), normal)
        .when(shell, base)
        .when(fc.is_tool(vocab.COMPARE_SPAWN_TOOLS), text("description", "prompt"))
        .when(fc.is_tool(vocab.COMPARE_PLAN_TOOLS), "")
        .otherwise(F.col("tool_name"))
    )
    reported = F.coalesce("duration_ms", "meta_total_ms")
    window = F.col("time_end") - F.col("time_start")
    latency = F.when(window >= 0, window).when(reported > 0, reported).otherwise(0).cast("bigint")
    by_call = calls.select(
        *STEP, F.col("call_pos").alias("act_pos"), action_type.alias("action_type"), target.alias("target"),
        F.col("tool_name").alias("tool"), fc.status_failed(F.col("status")).alias("status_failed"),
        (F.col("exit_code") != 0).alias("exit_failed"), command.alias("command"), latency.alias("latency_ms"),
    )
    said = parts.filter(F.col("type").isin("text", "reasoning")).groupBy(*STEP).agg(F.min_by("type", "part_pos").alias("tool"))
    spent = F.greatest(F.lit(0), F.col("time_completed_ms") - F.col("time_created_ms"))
    by_text = said.join(steps.select(*STEP, F.coalesce(spent, F.lit(0)).alias("latency_ms")), STEP).select(
        *STEP, F.lit(-1).cast("bigint").alias("act_pos"), F.lit("REASON").alias("action_type"), F.lit("").alias("target"), "tool",
        F.lit(False).alias("status_failed"), F.lit(False).alias("exit_failed"), F.lit("").alias("command"), "latency_ms",
    )
    rows = by_call.unionByName(by_text)
    # Shares are settled within one step, whose calls belong to one message.
    step = Window.partitionBy(*STEP)
    acts = F.col("action_type") != "REASON"
    rows = rows.withColumns(
        {"_n": F.count_if(acts).over(step), "_rank": F.row_number().over(step.orderBy(F.when(acts, 0).otherwise(1), "act_pos"))}
    ).join(steps.select(*STEP, F.col("tokens.total").alias("_tokens")), STEP)
    share = F.floor(F.col("_tokens") / F.col("_n")).cast("bigint")
    rest = F.when(F.col("_rank") == 1, F.col("_tokens") - share * F.col("_n")).otherwise(0)
    rows = rows.withColumn(
        "token_share",
        F.when(acts, share + rest).when((F.col("_n") == 0) & (F.col("_rank") == 1), F.col("_tokens")).otherwise(0),
    ).drop("_n", "_rank", "_tokens")
    if labels is None:
        return rows.withColumns({"phase_label": F.lit(None).cast("string"), "action_label": F.lit(None).cast("string")})
    marks = labels.select("traj_id", "step_idx", F.col("phase").alias("phase_label"), F.col("action").alias("action_label"))
    return rows.join(marks, ["traj_id", "step_idx"], "left")


def cost(rate: float = vocab.TOKEN_RATE) -> Column:
    return F.col("token_share") + F.col("latency_ms") / 1000 * rate


def milli_cost(rate: float = vocab.TOKEN_RATE) -> Column:
    """Cost in thousandths as a decimal: sums of it are exact."""
    return F.col("token_share").cast("decimal(28,3)") * 1000 + (F.col("latency_ms") * rate).cast("decimal(28,3)")


def _suffixes(text: Column) -> Column:
    size = F.length(text)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size)), lambda i: F.substring(text, i, size))


def justified_reads(acts: DataFrame, calls: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct (run, read target) that the run's targets, tests, errors or imports justify, with the reason.

    Suffix tests become equi joins on the suffixes of the one side; a path has few characters.
    """
    read = acts.filter("action_type = 'FILE_READ'").select("traj_id", "target").distinct()
    goals = targets.select("traj_id", paths.target(F.col("path")).alias("target")).distinct()
    by_target = read.join(goals, ["traj_id", "target"], "left_semi").withColumn("reason", F.lit("target_file"))
    test = reduce(lambda a, b: a | b, [F.col("target").contains(f) for f in vocab.TEST_FRAGMENTS])
    by_test = read.filter(test).withColumn("reason", F.lit("test_file"))
    error = F.coalesce(F.when(F.col("error") != "", F.col("error")), F.when(fc.status_failed(F.col("status")), F.col("output")))
    named = calls.select("traj_id", F.explode(fc.shell_paths(error)).alias("p")).select("traj_id", paths.target(F.col("p")).alias("target")).distinct()
    by_error = read.join(named, ["traj_id", "target"], "left_semi").withColumn("reason", F.lit("error_reference"))
    held = calls.select("traj_id", paths.target(F.coalesce("input.file_path", F.lit(""))).alias("target"), "output").join(goals, ["traj_id", "target"], "left_semi")
    groups = [F.regexp_extract_all("output", F.lit(vocab.IMPORT_PATTERN), F.lit(i)) for i in (1, 2, 3, 4)]
    imported = held.select("traj_id", F.explode(F.concat(*groups)).alias("m")).filter("m <> ''")
    imported = imported.select("traj_id", paths.target(F.replace(F.col("m"), F.lit("."), F.lit("/"))).alias("imp")).distinct()
    stem = F.split(paths.basename(F.col("target")), r"\.")[0]
    tails = read.select("traj_id", "target", F.explode(_suffixes(F.col("target"))).alias("imp"))
    by_tail = tails.join(imported, ["traj_id", "imp"], "left_semi").select("traj_id", "target")
    ends = imported.select("traj_id", F.explode(_suffixes(F.col("imp"))).alias("stem")).distinct()
    by_stem = read.withColumn("stem", stem).filter("stem <> ''").join(ends, ["traj_id", "stem"], "left_semi").select("traj_id", "target")
    by_import = by_tail.unionByName(by_stem).distinct().withColumn("reason", F.lit("imported_by_target"))
    ranked = by_target.withColumn("_r", F.lit(0))
    for rank, more in enumerate((by_test, by_error, by_import), start=1):
        ranked = ranked.unionByName(more.withColumn("_r", F.lit(rank)))
    return ranked.groupBy("traj_id", "target").agg(F.min_by("reason", "_r").alias("why"))


def with_effects(acts: DataFrame, calls: DataFrame, parts: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Effect of every action: failed, reverted, survived, justified or unknown, with the reason."""
    targets = anchors if anchors is not None else files.target_files(calls, parts)
    why = justified_reads(acts, calls, targets)
    at = F.struct("step_idx", "act_pos")
    last = acts.filter("action_type = 'FILE_WRITE'").groupBy("traj_id", "target").agg(F.max(at).alias("_last"))
    rows = acts.join(last, ["traj_id", "target"], "left").join(why, ["traj_id", "target"], "left")
    kind = F.col("action_type")
    broken = (kind != "REASON") & (F.col("status_failed") | F.coalesce("exit_failed", F.lit(False)))
    later = F.col("_last") != at
    validates = fc.is_validation(F.col("command"))
    effect = (
        F.when(kind == "REASON", "unknown")
        .when(broken, "failed")
        .when(kind == "FILE_WRITE", F.when(later, "reverted").otherwise("survived"))
        .when(kind == "COMMAND", F.when(validates, "justified").otherwise("survived"))
        .when((kind == "FILE_READ") & F.col("why").isNotNull(), "justified")
        .otherwise("unknown")
    )
    reason = (
        F.when(broken, F.when(F.col("status_failed"), "tool_status_error").otherwise("exit_code"))
        .when(kind == "FILE_WRITE", F.when(later, "overwritten_by_later_write").otherwise("survived_within_run"))
        .when(kind == "COMMAND", F.when(validates, "validation_command").otherwise("command_completed"))
        .when(kind == "FILE_READ", F.col("why"))
    )
    return rows.withColumns({"effect": effect, "reason": reason}).drop("_last", "why")


def next_write_step(acts: DataFrame) -> DataFrame:
    """Per (run, target, step with a write): the next step writing the same target."""
    writes = acts.filter("action_type = 'FILE_WRITE'").select(*STEP, "target").distinct()
    return carry(writes, {}, keys=["traj_id", "target"], back={"next_step": F.col("step_idx")})


def milestones(acts: DataFrame, targets: DataFrame | None = None, keys: tuple[str, ...] = ("traj_id",)) -> DataFrame:
    """First steps of note per run; with ``targets`` (keys, path) touches must hit one of them."""
    keys = list(keys)
    rows = acts.filter("action_type <> 'REASON'")
    if targets is None:
        rows = rows.withColumn("_goal", F.lit(None).cast("boolean"))
    else:
        touched = rows.select(*keys, "target").distinct().withColumn("file", paths.basename(paths.normal(F.col("target"))))
        goal = targets.select(*keys, paths.normal(F.col("path")).alias("_g")).distinct().withColumn("file", paths.basename(F.col("_g")))
        hits = touched.join(goal, [*keys, "file"]).filter(paths.same_file(paths.normal(F.col("target")), F.col("_g")))
        hits = hits.select(*keys, "target").distinct().withColumn("_hit", F.lit(True))
        some = targets.select(*keys).distinct().withColumn("_some", F.lit(True))
        rows = rows.join(hits, [*keys, "target"], "left").join(some, keys, "left")
        rows = rows.withColumn("_goal", F.when(F.col("_some"), F.coalesce("_hit", F.lit(False))))
    kind, effect, goal = F.col("action_type"), F.col("effect"), F.col("_goal")
    grounded = F.coalesce(goal, F.lit(True))
    looked = kind.isin("FILE_READ", "SEARCH") & F.coalesce(goal, effect.isin("justified", "survived"))
    base = paths.basename(F.col("target"))
    word = reduce(lambda a, b: a | b, [base.contains(w) for w in vocab.VALIDATION_WORDS])
    checks = (kind == "COMMAND") & (
        F.coalesce(F.col("reason") == "validation_command", F.lit(False)) | (effect.isin("justified", "survived") & word)
    )
    writes = kind == "FILE_WRITE"
    first = lambda test: F.min(F.when(test, F.col("step_idx")))
    return rows.groupBy(*keys).agg(
        first(looked).alias("first_relevant_file"),
        first(writes & grounded).alias("first_edit"),
        first(writes & (effect == "survived") & grounded).alias("first_surviving_edit"),
        first(checks).alias("first_passing_validation"),
        F.max(F.when(writes & (effect == "survived"), F.col("step_idx"))).alias("final_patch"),
    )


MILESTONES = ("first_relevant_file", "first_edit", "first_surviving_edit", "first_passing_validation", "final_patch")


def segments(acts: DataFrame, marks: DataFrame, keys: tuple[str, ...] = ("traj_id",)) -> DataFrame:
    """Stretches between consecutive milestones, [start, end); at most six per run."""
    keys = list(keys)
    last = acts.filter("action_type <> 'REASON'").groupBy(*keys).agg(
        F.min("step_idx").alias("_lo"), F.max("step_idx").alias("_hi")
    )
    rows = acts.select(*keys).distinct().join(last, keys, "left").join(marks, keys, "left")
    named = [
        F.when(F.col(n).isNotNull(), F.struct(F.col(n).alias("at"), F.lit(i).alias("rank"), F.lit(n).alias("name")))
        for i, n in enumerate(MILESTONES)
    ]
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(-1).alias("rank"), F.lit("start").alias("name"))
    rows = rows.withColumn("_m", F.array_sort(F.array_compact(F.array(*named))))
    end = F.struct((F.coalesce(F.col("_hi") + 1, F.lit(0))).alias("at"), F.lit(9).alias("rank"), F.lit("end").alias("name"))
    whole = F.array(
        F.struct(F.coalesce("_lo", F.lit(0)).alias("at"), F.lit(-1).alias("rank"), F.lit("start").alias("name")),
        F.struct(F.coalesce("_hi", F.lit(0)).alias("at"), F.lit(9).alias("rank"), F.lit("end").alias("name")),
    )
    rows = rows.withColumn("_b", F.when(F.size("_m") == 0, whole).otherwise(F.concat(F.array(begin), "_m", F.array(end))))
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("_b") - 1),
        lambda i: F.struct(
            i.cast("bigint").alias("seg"),
            F.concat(F.element_at("_b", i)["name"], F.lit(" → "), F.element_at("_b", i + 1)["name"]).alias("label"),
            F.element_at("_b", i)["at"].alias("start_step"),
            # Without milestones the one segment includes its last step.
            (F.element_at("_b", i + 1)["at"] + F.when(F.size("_m") == 0, 1).otherwise(0)).alias("end_step"),
        ),
    )
    order = F.array_join(F.transform("_m", lambda m: m["name"]), ",")
    return rows.select(*keys, order.alias("milestone_order"), F.explode(pairs).alias("_s")).select(*keys, "milestone_order", "_s.*")


def file_class(path: Column, custom: tuple[tuple[str, str], ...] = ()) -> Column:
    """Class of a file by the first matching rule, else 'source'."""
    import fnmatch

    rules = F
    flat = paths.slashes(path)
    for glob, kind in (*custom, *vocab.FILE_CLASSES):
        pattern = fnmatch.translate(glob).replace(r"\z", r"\Z").replace(r"(?>", "(?:")
        rules = rules.when(flat.rlike("^" + pattern), F.lit(kind))
    return rules.otherwise("source")


def anchor_hits(acts: DataFrame, anchors: DataFrame) -> DataFrame:
    """Distinct touched targets matched to anchor files of their run: equal, suffix, or two common last segments.

    All three imply the same file name, which is the join key.
    """
    touched = acts.filter("action_type in ('FILE_READ', 'FILE_WRITE')").select("traj_id", "target").distinct()
    touched = touched.withColumn("file", paths.basename(F.col("target")))
    goal = anchors.select("traj_id", F.col("path").alias("anchor"), paths.target(F.col("path")).alias("_g"))
    goal = goal.withColumn("file", paths.basename(F.col("_g")))
    both = touched.join(goal, ["traj_id", "file"])
    two = F.coalesce(paths.last_two(F.col("target")) == paths.last_two(F.col("_g")), F.lit(False))
    both = both.filter(paths.same_file(F.col("target"), F.col("_g")) | two)
    return both.groupBy("traj_id", "target").agg(F.min("anchor").alias("anchor"))


def anchor_metrics(acts: DataFrame, anchors: DataFrame) -> DataFrame:
    """How well a run's writes cover the anchor files."""
    rows = acts.filter("action_type in ('FILE_READ', 'FILE_WRITE')").join(anchor_hits(acts, anchors), ["traj_id", "target"], "left")
    writes = F.col("action_type") == "FILE_WRITE"
    by_target = rows.groupBy("traj_id", "target").agg(
        F.bool_or(writes).alias("w"), F.min("anchor").alias("anchor"),
        F.min(F.when(writes, F.col("step_idx"))).alias("fw"), F.min(F.when(~writes, F.col("step_idx"))).alias("fr"),
    )
    hit = F.col("anchor").isNotNull()
    by_anchor = by_target.groupBy("traj_id", "anchor").agg(
        F.count_if("w").alias("written"), F.min(F.when(hit, F.col("fw"))).alias("fw"), F.min(F.when(hit, F.col("fr"))).alias("fr")
    )
    sums = by_anchor.groupBy("traj_id").agg(
        F.sum("written").alias("files_written"), F.count_if(F.col("anchor").isNotNull() & (F.col("written") > 0)).alias("anchor_files_written"),
        F.min("fr").alias("first_anchor_read"), F.min("fw").alias("first_anchor_write"),
    )
    size = anchors.groupBy("traj_id").agg(F.count("*").alias("anchor_files"))
    out = size.join(sums, "traj_id", "left").fillna(0, ["files_written", "anchor_files_written"])
    w, a = F.col("files_written"), F.col("anchor_files_written")
    return out.withColumns(
        {
            "write_precision": F.when(w > 0, a / w), "write_recall": a / F.col("anchor_files"),
            "off_patch_write_ratio": F.when(w > 0, (w - a) / w),
        }
    )


def anchor_class_recall(acts: DataFrame, anchors: DataFrame) -> DataFrame:
    """Share of anchor files written, per file class."""
    written = acts.filter("action_type = 'FILE_WRITE'").select("traj_id", "target").distinct()
    done = written.join(anchor_hits(acts, anchors), ["traj_id", "target"]).select("traj_id", F.col("anchor").alias("path")).distinct()
    rows = anchors.withColumn("class", file_class(F.col("path"))).join(done.withColumn("_done", F.lit(True)), ["traj_id", "path"], "left")
    return rows.groupBy("traj_id", "class").agg(
        F.count("*").alias("files"), F.count_if("_done").alias("written"), (F.count_if("_done") / F.count("*")).alias("recall")
    )
