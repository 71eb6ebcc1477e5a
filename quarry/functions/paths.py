"""Names and paths of entries: globs, safety, reserved names, sizes. Pure column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Device names that a file must not have, by stem.
RESERVED = r"(?i)^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"


def glob_regex(pattern: str) -> str | None:
    """A glob as an anchored regex, None if it is not valid. ``*`` and ``?`` match ``/`` as well;
    ``**`` must be a whole path component."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            run = len(pattern[i:]) - len(pattern[i:].lstrip("*"))
            if run > 2:
                return None
            if run == 2:
                before, after = pattern[:i], pattern[i + 2 :]
                if before and not before.endswith("/") or after and not after.startswith("/"):
                    return None
                if after:
                    out.append("(?:.*/)?")
                    i += 3
                    continue
            out.append(".*")
            i += run
            continue
        if c == "?":
            out.append(".")
        elif c == "[":
            negate = pattern[i + 1 : i + 2] == "!"
            start = i + 1 + negate
            end = pattern.find("]", start + 1)
            if end < 0:
                return None
            body = re.sub(r"([\\\[\]^&~|])", r"\\\1", pattern[start:end])
            out.append(f"[{'^' if negate else ''}{body}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def matches_any(name: Column, patterns: Iterable[str]) -> Column:
    """Invalid patterns are skipped."""
    known = [r for r in map(glob_regex, patterns) if r]
    out = F.lit(False)
    for r in known:
        out = out | name.rlike(r)
    return out


def matches_filters(name: Column, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    """Exclusion wins; no inclusion means all."""
    include, exclude = list(include), list(exclude)
    kept = matches_any(name, include) if include else F.lit(True)
    return ~matches_any(name, exclude) & kept


def in_file_list(name: Column, files: Iterable[str]) -> Column:
    """Exact names, or anything under one of them as a directory; an empty list takes all."""
    files = list(files)
    if not files:
        return F.lit(True)
    out = name.isin(files)
    for f in files:
        out = out | name.startswith(f.rstrip("/") + "/")
    return out


def is_safe_path(name: Column) -> Column:
    """Not absolute, no parent reference, no NUL."""
    return ~name.rlike(r"^/|(^|/)\.\.(/|$)|\x00")


def sanitise_path(name: Column) -> Column:
    """Root, empty, ``.`` and ``..`` components go; NUL becomes ``_``."""
    parts = F.filter(F.split(F.replace(name, F.lit("\0"), F.lit("_")), "/"), lambda p: ~p.isin("", ".", ".."))
    return F.array_join(parts, "/")


def is_reserved(base: Column) -> Column:
    return F.substring_index(base, ".", 1).rlike(RESERVED)


def rewrite_reserved(base: Column, strict: bool = False) -> Column:
    """``CON.txt`` -> ``CON_.txt``; strict raises instead."""
    stem = F.substring_index(base, ".", 1)
    changed = F.raise_error(F.concat(F.lit("reserved filename: "), base)) if strict else F.concat(stem, F.lit("_"), F.substring(base, F.length(stem) + 1, F.length(base)))
    return F.when(is_reserved(base), changed).otherwise(base)


def rewrite_path(path: Column, strict: bool = False) -> Column:
    """rewrite_reserved of every component; a trailing slash stays."""
    return F.array_join(F.transform(F.split(path, "/"), lambda p: rewrite_reserved(p, strict)), "/")


def parse_size(text: Column) -> Column:
    """Bytes with an optional decimal k, m or g; null where it is not a size."""
    found = r"^\s*\+?([0-9]+)([kKmMgG]?)\s*$"
    unit = F.lower(F.regexp_extract(text, found, 2))
    scale = F.when(unit == "k", 1_000).when(unit == "m", 1_000_000).when(unit == "g", 1_000_000_000).otherwise(1)
    return F.when(text.rlike(found), F.regexp_extract(text, found, 1).try_cast("bigint") * scale.cast("bigint"))


def format_size(size: Column) -> Column:
    """1024-based with one decimal, exact ties to even."""
    unit = lambda power, name: F.format_string(f"%.1f {name}", F.bround(size.cast("double") / F.lit(float(1024**power)), 1))
    return F.when(size >= 1024**3, unit(3, "GB")).when(size >= 1024**2, unit(2, "MB")).when(size >= 1024, unit(1, "KB")).otherwise(F.concat(size.cast("string"), F.lit(" B")))


def tree_prefixes(name: Column) -> Column:
    """Every prefix path of a name, the name itself last."""
    parts = F.filter(F.split(name, "/"), lambda p: p != "")
    return F.transform(F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>")), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
