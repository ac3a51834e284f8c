"""Scalar functions whose results follow ECMAScript's rules rather than Java's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that `\\s` and trim() treat as white space.
SPACE = r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Any character but a line terminator.
DOT = r"[^\n\r\x{2028}\x{2029}]"


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body's lambdas use it.

    The optimizer may copy a projected expression into a lambda, where it would run for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def locale_key(c: Column) -> Column:
    """A string that sorts in the root locale's order: a, A, b, not A, a, b."""
    return F.collate(c, "UNICODE")


def in_locale_order(df: DataFrame, *columns: str, between: str | None = None) -> list[Column]:
    """What to sort by: strings in the root locale's order, other columns as they are; equal keys by the bytes.

    between: the columns are compared as one string with that between them."""
    strings = [isinstance(df.schema[c].dataType, T.StringType) for c in columns]
    if between is not None and all(strings):
        return [locale_key(F.concat_ws(between, *columns)), *map(F.col, columns)]
    return [*(locale_key(F.col(c)) if s else F.col(c) for c, s in zip(columns, strings, strict=True)), *(F.col(c) for c, s in zip(columns, strings, strict=True) if s)]


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def lines(c: Column) -> Column:
    """The parts between line feeds; a trailing one gives an empty last part."""
    return F.split(c, "\n", -1)


def round_half_up(c: Column, digits: int) -> Column:
    """Rounds halves up, in binary floating point."""
    scale = 10**digits
    return F.floor(c * scale + 0.5) / scale


def extension(path: Column) -> Column:
    """The last dot of the file name and what follows; none for a name that starts with its only dot."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)\z", 1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """The folder of a path; empty at the top."""
    return F.regexp_extract(path, r"\A([\s\S]*)/[^/]*\z", 1)


def ancestors(path: Column) -> Column:
    """All folders above a path, shallowest first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def dir_label(path: Column) -> Column:
    """The folder of a path with its slash, as views show it; empty at the top."""
    return F.regexp_extract(path, r"\A([\s\S]*/)[^/]*\z", 1)


def to_fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, rounded by its exact binary value; a tie goes away from zero."""
    scaled = F.abs(x) * 10**digits
    # only multiples of a power of 1/2 are ties; format_number rounds those to even, anything else exactly
    tie = (F.abs(x) * 2 ** (digits + 1) == F.floor(F.abs(x) * 2 ** (digits + 1))) & (scaled - F.floor(scaled) == 0.5)
    up = F.signum(x) * F.floor(scaled + 0.5) / 10**digits
    return F.replace(F.format_number(F.when(tie, up).otherwise(x), digits), F.lit(","), F.lit(""))


NONE = "\u2014"


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def compact_number(n: Column) -> Column:
    """1240 as 1.2k, 12400 as 12k, 2000000000 as 2.0B: one decimal below 10 units.  A dash for what isn't a number."""
    x = n.cast("double")
    whole = F.floor(x + 0.5)

    def short(limit: int, unit: str) -> Column:
        scaled = whole / limit
        return F.concat(F.when(F.abs(scaled) < 10, to_fixed(scaled, 1)).otherwise(to_fixed(scaled, 0)), F.lit(unit))

    size = F.abs(whole)
    out = F.when(size < 1_000, whole.cast("string")).when(size >= 10**9, short(10**9, "B")).when(size >= 10**6, short(10**6, "M")).otherwise(short(10**3, "k"))
    return F.when(_finite(x), out).otherwise(NONE)


def duration(ms: Column) -> Column:
    """Milliseconds as `12 ms`, `1.5 s`, `2 m` or `2 m 5 s`; a dash for what is none."""
    x = ms.cast("double")
    whole = F.floor(x / 1000 + 0.5)
    minutes, rest = F.concat(F.floor(whole / 60).cast("string"), F.lit(" m")), whole % 60
    out = (
        F.when(x < 1000, F.concat(F.floor(x + 0.5).cast("string"), F.lit(" ms")))
        .when(x / 1000 < 60, F.concat(to_fixed(x / 1000, 1), F.lit(" s")))
        .otherwise(F.when(rest == 0, minutes).otherwise(F.concat(minutes, F.lit(" "), rest.cast("string"), F.lit(" s"))))
    )
    return F.when(_finite(x) & (x >= 0), out).otherwise(NONE)


def relative_age(at: Column, now: Column) -> Column:
    """How long before `now` a time was: `just now`, `5 min ago`, up to weeks; a dash for no time."""
    elapsed = F.unix_millis(now) - F.unix_millis(at)
    ago = lambda unit, name: F.concat(F.floor(elapsed / unit).cast("string"), F.lit(f" {name} ago"))
    minute = 60_000
    out = F.when(elapsed < minute, "just now").when(elapsed < 60 * minute, ago(minute, "min")).when(elapsed < 1440 * minute, ago(60 * minute, "h"))
    return F.when(at.isNull(), NONE).otherwise(out.when(elapsed < 7 * 1440 * minute, ago(1440 * minute, "d")).otherwise(ago(7 * 1440 * minute, "w")))
