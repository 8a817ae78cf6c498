"""File paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """``text`` without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` bound once, so repeated use does not copy its expression into the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def normal(path: Column) -> Column:
    """Resolve '.', '..' and doubled slashes; '' stays ''. Segments of one path only, so a small fold."""

    def resolve(p: Column) -> Column:
        rooted = p.startswith("/")

        def step(kept: Column, part: Column) -> Column:
            size = F.size(kept)
            climbs = (part == "..") & (size > 0) & (F.coalesce(F.get(kept, size - 1), F.lit("")) != "..")
            return (
                F.when(climbs, F.slice(kept, F.lit(1), size - 1))
                .when((part == "..") & rooted, kept)
                .otherwise(F.concat(kept, F.array(part)))
            )

        parts = F.filter(F.split(p, "/"), lambda q: ~q.isin("", "."))
        # A lone leading double slash is kept by POSIX rules.
        root = F.when(p.rlike("^//[^/]") | (p == "//"), "//").when(rooted, "/").otherwise("")
        kept = F.aggregate(parts, F.array().cast("array<string>"), step)
        out = F.concat(root, F.array_join(kept, "/"))
        # Most paths have nothing to resolve and skip the fold.
        dirty = p.rlike(r"(^|/)\.{0,2}(/|$)")
        return F.when((p == "") | ~dirty, p).otherwise(F.coalesce(F.when(out != "", out), F.lit(".")))

    return let(path, resolve)


def target(path: Column) -> Column:
    """Comparable form across Windows, WSL and POSIX spellings."""
    share = r"(?i)^//*(?:wsl\.localhost|wsl\$)/[^/]+(/home/.*)$"
    flat = F.regexp_replace(slashes(strip(path)), share, "$1")
    return normal(F.regexp_replace(flat, r"^[A-Za-z]:", ""))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def same_file(a: Column, b: Column) -> Column:
    """Equal, or one is a whole-segment suffix of the other."""
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def last_two(path: Column) -> Column:
    """The last two segments, null for a bare name."""
    return F.when(path.contains("/"), F.substring_index(path, "/", -2))
