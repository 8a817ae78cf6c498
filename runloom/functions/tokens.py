"""Token arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(value: Column) -> Column:
    """A token count that may be summed: finite and not negative, else null."""
    finite = ~F.isnan(value.cast("double")) & (F.abs(value.cast("double")) != float("inf"))
    return F.when(finite & (value >= 0), value.cast("bigint"))


def finite_or_zero(value: Column) -> Column:
    number = value.cast("double")
    return F.when(value.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), F.lit(0)).otherwise(value)


def cache_share(cache_read: Column, total: Column) -> Column:
    read, whole = usable(cache_read), usable(total)
    return F.when((whole > 0) & (read <= whole), read / whole)


def segments(total: Column, inp: Column, out: Column, reasoning: Column, read: Column, write: Column) -> Column:
    """Disjoint parts of a step's total. The reading whose implied total is nearest wins, earlier first."""
    total, inp, out, reasoning, read, write = (
        F.coalesce(c, F.lit(0)).cast("bigint") for c in (total, inp, out, reasoning, read, write)
    )
    implied = [
        ("fresh_disjoint", inp + out + reasoning + read + write),
        ("fresh_nested", inp + out + read + write),
        ("cached_disjoint", inp + out + reasoning),
        ("cached_nested", inp + out),
    ]
    nearest = F.least(
        *[
            F.struct(F.abs(total - value).alias("gap"), F.lit(rank).alias("rank"), F.lit(name).alias("name"))
            for rank, (name, value) in enumerate(implied)
        ]
    )["name"]
    bare = (total > 0) & (inp == 0) & (out == 0) & (reasoning == 0) & (read == 0) & (write == 0)
    reading = F.when(bare, "total_only").otherwise(nearest)
    fresh_kind, nested = reading.startswith("fresh"), reading.endswith("nested")
    zero = F.lit(0).cast("bigint")
    return F.struct(
        F.when(bare, total).otherwise(F.greatest(zero, F.when(fresh_kind, inp).otherwise(inp - read))).alias("fresh"),
        F.greatest(zero, read).alias("cache_read"),
        F.when(fresh_kind, F.greatest(zero, write)).otherwise(zero).alias("cache_write"),
        F.greatest(zero, F.when(nested, out - reasoning).otherwise(out)).alias("output"),
        F.greatest(zero, reasoning).alias("reasoning"),
        reading.alias("reading"),
    )


def step_segments(tokens: str = "tokens") -> Column:
    field = lambda name: F.col(f"{tokens}.{name}")
    return segments(*[field(n) for n in ("total", "input", "output", "reasoning", "cache_read", "cache_write")])


def missing_fields(reported: dict[str, Column]) -> Column:
    """Labels of the token fields a payload lacks; ``reported`` maps label -> raw value."""
    return F.array_compact(F.array(*[F.when(value.isNull(), F.lit(label)) for label, value in reported.items()]))


def estimate(text: Column) -> Column:
    """About four characters per token, at least one for any text."""
    size = F.length(text)
    return F.when(F.coalesce(size, F.lit(0)) == 0, F.lit(0)).otherwise(
        F.greatest(F.lit(1), F.floor((size + 3) / 4))
    ).cast("bigint")


def window_limit(text: Column) -> Column:
    """'128k', '1.2m', '200,000' -> tokens; anything else null."""
    flat = F.lower(F.regexp_replace(F.trim(text), r"[,_\s]", ""))
    number = F.regexp_extract(flat, r"^([0-9]+(?:\.[0-9]+)?)([km]?)$", 1)
    unit = F.regexp_extract(flat, r"^([0-9]+(?:\.[0-9]+)?)([km]?)$", 2)
    factor = F.when(unit == "k", 1_000).when(unit == "m", 1_000_000).otherwise(1)
    value = F.when(number != "", number).cast("double") * factor
    return F.when(value >= 1, value.cast("bigint"))
