"""Alignment of two runs: longest common subsequence of their canonical actions.

The only Python of the engine. Pairs within ``cells`` table cells and ``rows`` actions are sorted next to each other and
aligned one after the other as a task's rows come by, so a task holds one of them.
A longer pair is cut into tiles: anti-diagonals of tiles are one Spark stage each and exchange only tile
borders, so the memory of a task is one tile whatever the run length, and the result is the same. Tiles of a
pair with a short side are longer along the other. A pair with an empty side matches nothing and is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.operators.slices import running
from runloom.session import cut_lineage

CELLS = 16_000_000
TILE = 2048
ROWS = 65_536
# Effects that may stand for each other.
EFFECTS = {"survived": 0, "justified": 1, "failed": 2, "reverted": 3, "unknown": 4}
# Equal effects agree, unknown agrees with all, and an effect that lasted agrees with one that was justified.
COMPATIBLE = np.array([[x == y or "unknown" in (x, y) or {x, y} == {"survived", "justified"} for y in EFFECTS] for x in EFFECTS])


def numbered(acts: DataFrame) -> DataFrame:
    """Non-REASON actions with their dense position in the run."""
    rows = acts.filter("action_type <> 'REASON'")
    rows = running(rows, {"_n": F.lit(1)}, order=["step_idx", "act_pos"])
    return rows.withColumn("seq", (F.col("_n") - 1).cast("bigint")).drop("_n")


def _key(kind: str, target: str) -> tuple[str, str]:
    """(head, end) of a key: what equivalent targets of a kind have in common, and what decides between them.

    The head is a search's pattern, a file's name, nothing of a spawn, else the target. The end is the last two parts of
    the file's path or the search's scope.
    """
    head, path = target, ""
    if kind == "SEARCH":
        pattern, at, scope = target.rpartition("@")
        head, path = (pattern, scope) if at else (target, "")
    elif kind in ("FILE_READ", "FILE_WRITE"):
        head, path = target.rsplit("/", 1)[-1], target
    elif kind == "AGENT_SPAWN":
        head = ""
    return head, "/".join(path.split("/")[-2:])


def short_target(kind: Column, target: Column) -> Column:
    """The shortest target with the same equivalents: nothing of a spawn, the last two parts of a path or scope, else all."""
    scope = F.substring_index(target, "@", -1)
    pattern = F.substr(target, F.lit(1), F.length(target) - F.length(scope))
    return (
        F.when(kind == "AGENT_SPAWN", "")
        .when(kind.isin("FILE_READ", "FILE_WRITE"), F.substring_index(target, "/", -2))
        .when((kind == "SEARCH") & F.contains(target, F.lit("@")), F.concat(pattern, F.substring_index(scope, "/", -2)))
        .otherwise(target)
    )


def _related(left: list[tuple[str, str]], right: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """Places of equivalent keys (kind, target) of both sides: look-ups by kind, head and the end of the path.

    Paths agree if one ends in the other or both end in the same two parts, so the last two parts decide: they are
    equal, or one path is the bare last part of the other. A search without scope fits any. Of short targets
    a key has at most three equivalents but for bare and empty paths, so there are no more pairs than a few per key.
    """
    found = []
    sides = [[(kind, *_key(kind, target)) for kind, target in keys] for keys in (left, right)]
    whole: dict = {}
    for j, key in enumerate(sides[1]):
        whole.setdefault(key, []).append(j)
    for i, key in enumerate(sides[0]):
        found += [(i, j) for j in whole.get(key, ())]
    for turned in (False, True):
        x, y = sides[::-1] if turned else sides
        bare: dict = {}
        for j, (kind, head, end) in enumerate(y):
            if "/" not in end and (end or kind == "SEARCH"):
                bare.setdefault((kind, head, end), []).append(j)
        for i, (kind, head, end) in enumerate(x):
            hits = bare.get((kind, head, end.rsplit("/", 1)[-1]), ()) if "/" in end else ()
            if "/" in end and not end.endswith("/"):
                found += [(j, i) if turned else (i, j) for j in hits]
            if end:
                found += [(j, i) if turned else (i, j) for j in bare.get((kind, head, ""), ())]
    return found


def _joined(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Equivalent keys (code_x, code_y) of both sides (code, kind, target)."""
    keys = [list(zip(df["kind"], df["target"])) for df in (left, right)]
    codes = [df["code"].tolist() for df in (left, right)]
    return pd.DataFrame([(codes[0][i], codes[1][j]) for i, j in _related(*keys)], columns=["code_x", "code_y"])


def _coded(kinds: list, targets: list) -> tuple[np.ndarray, list[tuple[str, str]]]:
    """Code of every row's key, and the distinct keys."""
    names: dict = {}
    codes = [names.setdefault((k or "", t or ""), len(names)) for k, t in zip(kinds, targets)]
    return np.array(codes, np.int64), list(names)


def _matches(ref: dict[str, list], cmp: dict[str, list]) -> np.ndarray:
    """Boolean match table from the equivalent distinct keys of both sides; commands also meet by their fuzzy key."""
    sides = []
    for side in (ref, cmp):
        kinds = side["action_type"]
        fuzzy = [f if k == "COMMAND" else "" for k, f in zip(kinds, side["fuzzy_type"])]
        effects = np.array([EFFECTS[e] for e in side["effect"]], np.int64)
        sides.append((*_coded(kinds, side["target"]), *_coded(fuzzy, side["fuzzy_target"]), effects))
    (ref_code, a, ref_fuzzy, c, ref_effect), (cmp_code, b, cmp_fuzzy, d, cmp_effect) = sides
    fits = np.zeros((len(ref_effect), len(cmp_effect)), dtype=bool)
    plain, fine = (lambda key: True), (lambda key: key[0] != "")
    other = lambda key: key[0] != "COMMAND"
    for x, y, left, right, of_left, of_right in ((ref_code, cmp_code, a, b, plain, plain), (ref_fuzzy, cmp_code, c, b, fine, other), (ref_code, cmp_fuzzy, a, d, other, fine)):
        kept = [[n for n, key in enumerate(keys) if test(key)] for keys, test in ((left, of_left), (right, of_right))]
        if not kept[0] or not kept[1]:
            continue
        table = np.zeros((len(left), len(right)), dtype=bool)
        for i, j in _related([left[n] for n in kept[0]], [right[n] for n in kept[1]]):
            table[kept[0][i], kept[1][j]] = True
        if table.any():
            fits |= table[x[:, None], y[None, :]]
    return fits & COMPATIBLE[ref_effect[:, None], cmp_effect[None, :]]


def _fill(match: np.ndarray, top: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Length table with its borders: ``top`` has one more entry than columns, ``left`` than rows."""
    n, m = match.shape
    table = np.empty((n + 1, m + 1), dtype=np.int32)
    table[0] = top
    for i in range(1, n + 1):
        row = np.maximum(table[i - 1, 1:], np.where(match[i - 1], table[i - 1, :-1] + 1, 0))
        table[i, 0] = left[i]
        table[i, 1:] = np.maximum(np.maximum.accumulate(row), left[i])
    return table


def _walk(match: np.ndarray, table: np.ndarray, i: int, j: int) -> tuple[list[tuple[int, int]], int, int]:
    """Walk back from (i, j): a match first, then up unless left is strictly longer."""
    found = []
    while i > 0 and j > 0:
        if match[i - 1, j - 1] and table[i, j] == table[i - 1, j - 1] + 1:
            i, j = i - 1, j - 1
            found.append((i, j))
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return found, i, j


MATCHED = "group_key string, ref_seq long, cmp_seq long"
SIDE = ["group_key", "side", "seq", "action_type", "target", "effect", "fuzzy_type", "fuzzy_target"]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """The rows of one pair after the other, from rows sorted by group_key."""
    kept: list[pd.DataFrame] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.to_pandas()
        keys = rows["group_key"].to_numpy()
        ends = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if kept and kept[0]["group_key"].iloc[0] != keys[0]:
            yield pd.concat(kept)
            kept = []
        for begin, end in zip(ends, ends[1:]):
            if begin:
                yield pd.concat(kept) if len(kept) > 1 else kept[0]
                kept = []
            kept.append(rows.iloc[begin:end])
    if kept:
        yield pd.concat(kept)


def _align_small(rows: pd.DataFrame) -> tuple[str, list[int], list[int]]:
    """(group_key, ref_seq, cmp_seq) of one pair's matches; ``rows`` are sorted by side and seq, and no side is empty."""
    n = int(np.searchsorted(rows["side"].to_numpy(), 1))
    columns = {name: rows[name].tolist() for name in SIDE[2:]}
    ref, cmp = {c: v[:n] for c, v in columns.items()}, {c: v[n:] for c, v in columns.items()}
    match = _matches(ref, cmp)
    m = match.shape[1]
    table = _fill(match, np.zeros(m + 1, np.int32), np.zeros(n + 1, np.int32))
    found, _, _ = _walk(match, table, n, m)
    return rows["group_key"].iloc[0], [ref["seq"][i] for i, _ in found], [cmp["seq"][j] for _, j in found]


def align(ref: DataFrame, cmp: DataFrame, fuzzy: bool = False, cells: int = CELLS, tile: int = TILE, rows: int = ROWS) -> DataFrame:
    """Matched positions (group_key, ref_seq, cmp_seq); both sides are numbered actions with ``group_key``."""
    from runloom.operators.actions import reduced

    def side(df: DataFrame, number: int) -> DataFrame:
        finer = F.when(F.col("action_type") == "COMMAND", reduced(F.col("command"))) if fuzzy else None
        df = df.withColumn("side", F.lit(number))
        blank = F.lit("")
        df = df.withColumn("fuzzy_type", F.coalesce(finer["action_type"], blank) if fuzzy else blank)
        df = df.withColumn("fuzzy_target", F.coalesce(finer["target"], blank) if fuzzy else blank)
        # Only positions are given back, so keys travel without what never decides (whole prompts of spawns).
        return df.withColumns({f"{k}target": short_target(F.col(t), F.col(f"{k}target")) for k, t in (("", "action_type"), ("fuzzy_", "fuzzy_type"))}).select(*SIDE)

    acts = side(ref, 0).unionByName(side(cmp, 1))
    sizes = acts.groupBy("group_key").agg(F.count_if(F.col("side") == 0).alias("n"), F.count_if(F.col("side") == 1).alias("m"))
    n, m = F.col("n"), F.col("m")
    sizes = sizes.filter((n > 0) & (m > 0)).withColumn("big", (n * m > cells) | (n + m > rows))
    small = acts.join(sizes.filter("not big").select("group_key"), "group_key", "left_semi")
    # Pairs cost by their cells, not their bytes, so tasks are not put together by size. The hash of the key makes it an
    # exchange of its own: by the key alone the parts that the union above claims would do, and at run time they don't hold.
    dealt = small.select(*SIDE).repartition(int(small.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("group_key"))
    align_pair = _align_small

    def aligned(batches):
        for pair in _pairs(batches):
            key, refs, cmps = align_pair(pair)
            if refs:
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(refs), pa.string()), pa.array(refs, pa.int64()), pa.array(cmps, pa.int64())], names=["group_key", "ref_seq", "cmp_seq"])

    out = dealt.sortWithinPartitions("group_key", "side", "seq").mapInArrow(aligned, MATCHED)
    # A tile's cells are at most tile * tile: across a side shorter than a tile it is longer along the other.
    along = lambda across: F.when(across < tile, F.least(F.lit(max(rows, tile)), F.floor(F.lit(tile * tile) / across))).otherwise(tile).cast("bigint")
    big = cut_lineage(sizes.filter("big").withColumns({"ti": along(m), "tj": along(n)}))
    # At most a handful of numbers per run of the loop: how many tile diagonals the longest pair needs.
    span = big.agg(F.max(F.ceil(n / F.col("ti")) + F.ceil(m / F.col("tj")) - 2)).first()[0]
    if span is None:
        return out
    return out.unionByName(_align_tiled(acts, big, int(span)))


BORDER = "group_key string, i long, j long, edge string, value array<int>"


def _tile_inputs(rows: DataFrame, todo: DataFrame, borders: DataFrame | None) -> DataFrame:
    """Rows of the two stretches and the incoming borders of every tile in ``todo`` (group_key, i, j, ...)."""
    at = [c for c in todo.columns if c not in ("group_key", "i", "j")]
    ref = rows.filter("side = 0").withColumnRenamed("part", "i").join(todo, ["group_key", "i"])
    cmp = rows.filter("side = 1").withColumnRenamed("part", "j").join(todo, ["group_key", "j"])
    cols = ["group_key", "i", "j", *at, *[c for c in SIDE if c != "group_key"]]
    out = ref.select(*cols).unionByName(cmp.select(*cols)).withColumns({"edge": F.lit(None).cast("string"), "value": F.lit(None).cast("array<int>")})
    if borders is None:
        return out
    into = borders.withColumns(
        {"i": F.when(F.col("edge") == "bottom", F.col("i") + 1).otherwise(F.col("i")), "j": F.when(F.col("edge") == "right", F.col("j") + 1).otherwise(F.col("j"))}
    ).join(todo, ["group_key", "i", "j"])
    return out.unionByName(into, allowMissingColumns=True)


def _tile_table(rows: pd.DataFrame):
    body = rows[rows["edge"].isna()]
    ref = body[body["side"] == 0].sort_values("seq", ignore_index=True)
    cmp = body[body["side"] == 1].sort_values("seq", ignore_index=True)
    edges = {e: np.asarray(v, dtype=np.int32) for e, v in zip(rows["edge"], rows["value"]) if isinstance(e, str)}
    top = edges.get("bottom", np.zeros(len(cmp) + 1, np.int32))
    left = edges.get("right", np.zeros(len(ref) + 1, np.int32))
    match = _matches(*({name: side[name].tolist() for name in SIDE[1:]} for side in (ref, cmp)))
    return ref, cmp, match, _fill(match, top, left)


def _fill_tile(rows: pd.DataFrame) -> pd.DataFrame:
    _, _, _, table = _tile_table(rows)
    head = rows.iloc[0]
    return pd.DataFrame(
        {"group_key": head["group_key"], "i": head["i"], "j": head["j"], "edge": ["bottom", "right"], "value": [table[-1], table[:, -1]]}
    )


WALK = "group_key string, i long, j long, at_i long, at_j long, ref_seq long, cmp_seq long"


def _walk_tile(rows: pd.DataFrame) -> pd.DataFrame:
    ref, cmp, match, table = _tile_table(rows)
    head = rows.iloc[0]
    i = len(ref) if head["at_i"] < 0 else int(head["at_i"])
    j = len(cmp) if head["at_j"] < 0 else int(head["at_j"])
    found, i, j = _walk(match, table, i, j)
    # One row per match, and one that says where the walk leaves the tile (-1: at the end of the next one).
    refs = [int(ref["seq"].iloc[a]) for a, _ in found] + [-1]
    cmps = [int(cmp["seq"].iloc[b]) for _, b in found] + [-1]
    out = pd.DataFrame({"group_key": head["group_key"], "i": head["i"] - (i == 0), "j": head["j"] - (j == 0), "ref_seq": refs, "cmp_seq": cmps})
    out["at_i"] = -1 if i == 0 else i
    out["at_j"] = -1 if j == 0 else j
    return out[["group_key", "i", "j", "at_i", "at_j", "ref_seq", "cmp_seq"]]


def _align_tiled(rows: DataFrame, big: DataFrame, span: int) -> DataFrame:
    grid = big.select("group_key", F.ceil(F.col("n") / F.col("ti")).alias("ni"), F.ceil(F.col("m") / F.col("tj")).alias("nj"))
    rows = rows.join(big.select("group_key", "ti", "tj"), "group_key")
    rows = rows.withColumn("part", F.floor(F.col("seq") / F.when(F.col("side") == 0, F.col("ti")).otherwise(F.col("tj")))).drop("ti", "tj")
    rows = cut_lineage(rows)
    borders = None
    for diagonal in range(span + 1):
        tiles = grid.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ni") - 1))).withColumn("j", F.lit(diagonal) - F.col("i"))
        tiles = tiles.filter("j >= 0 and j < nj").select("group_key", "i", "j")
        done = cut_lineage(_tile_inputs(rows, tiles, borders).groupBy("group_key", "i", "j").applyInPandas(_fill_tile, BORDER))
        borders = done if borders is None else borders.unionByName(done)
    todo = grid.select("group_key", (F.col("ni") - 1).alias("i"), (F.col("nj") - 1).alias("j"), F.lit(-1).cast("bigint").alias("at_i"), F.lit(-1).cast("bigint").alias("at_j"))
    found = None
    for _ in range(span + 1):
        walked = cut_lineage(_tile_inputs(rows, todo, borders).groupBy("group_key", "i", "j").applyInPandas(_walk_tile, WALK))
        hits = walked.filter("ref_seq >= 0").select("group_key", "ref_seq", "cmp_seq")
        found = hits if found is None else found.unionByName(hits)
        todo = walked.filter("ref_seq < 0 and i >= 0 and j >= 0").select("group_key", "i", "j", "at_i", "at_j")
    return found
