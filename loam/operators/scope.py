"""Which files a run looks at: globs, scopes, extensions and lists of names."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import js

# What a test file and a tool's configuration are called.
TEST_FILE = r"(^|/)__tests__/|\.(test|spec)\.[cm]?[jt]sx?\z"
TOOL_CONFIG = r"(^|/)[\w.-]*\.config\.[cm]?[jt]sx?\z"


def normal_path(path: str) -> str:
    """Without blanks around it, a leading `./` or `/`, and trailing slashes."""
    return re.sub(r"/+$", "", re.sub(r"^\.?/+", "", path.strip()))


def glob_regex(glob: str) -> str:
    """A glob as an anchored pattern: `?`, `*` and `**`; a folder covers what is below it."""
    out, rest = "", normal_path(glob)
    while rest:
        for token, pattern in (("**/", "(?:[^/]*/)*"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if rest.startswith(token):
                out, rest = out + pattern, rest[len(token) :]
                break
        else:
            out, rest = out + re.sub(r"([\\^$.|+()\[\]{}*?])", r"\\\1", rest[0]), rest[1:]
    return rf"\A{out}(?:/.*)?\z"


def matches_any(path: Column, globs: Iterable[str]) -> Column | None:
    """Whether a path fits one of the globs, both in one form; None, which is no constraint, for none but blank globs."""
    patterns = [glob_regex(g) for g in globs if normal_path(g)]
    plain = F.regexp_replace(F.regexp_replace(js.trim(path), r"\A\.?/+", ""), r"/+\z", "")
    return plain.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else None


def in_scope(path: Column, paths: Iterable[str] = (), ignore: Iterable[str] = ()) -> Column:
    """Inside paths, if there are any, and not ignored: ignore wins."""
    inside, out = matches_any(path, paths), matches_any(path, ignore)
    keep = F.lit(True) if inside is None else inside
    return keep if out is None else keep & ~out


def has_extension(path: Column, extensions: Iterable[str]) -> Column:
    """By the name's last dot, in the same case; dot files have no extension."""
    return js.extension(path).isin(*[f".{e}" for e in extensions])


class MissingNames(ValueError):
    """Names that were asked for but aren't there."""


def allowed(loaded: list[str], named: list[str] | None) -> list[str]:
    """All for None, none for an empty list, else the named ones in loaded order; an unknown name is an error."""
    if named is None:
        return list(loaded)
    missing = [n for n in named if n not in loaded]
    if missing:
        raise MissingNames(f"not loaded: {', '.join(missing)}")
    return [n for n in loaded if n in named]


def convention(loaded: list[str], named: str | None) -> str | None:
    """The named convention, else the first one."""
    return allowed(loaded, [named])[0] if named else next(iter(loaded), None)


def missing_names(named: DataFrame, loaded: DataFrame) -> DataFrame:
    return named.join(loaded, "name", "left_anti")


def within(path: Column, roots: Iterable[str]) -> Column:
    """Equal to a root or below it."""
    out = F.lit(False)
    for r in roots:
        out = out | (path == r) | path.startswith(r + "/")
    return out


def is_manifest(path: Column) -> Column:
    return path.rlike(r"(^|/)package\.json\z") & ~path.contains("node_modules/")


def is_config(path: Column) -> Column:
    return path.rlike(r"(^|/)(ts|js)config(\.[^/]*)?\.json\z") & ~path.contains("node_modules/")
