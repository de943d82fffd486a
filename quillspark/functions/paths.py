"""Path functions for POSIX paths, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The base name without its last extension; a leading dot begins no extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def components(path: Column) -> Column:
    return F.split(path, "/", -1)


def normalized(path: Column) -> Column:
    """``path`` without ``.``, ``..`` and empty parts, as far as they can be resolved."""

    def step(held: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(held) > 0) & (F.coalesce(F.get(held, F.size(held) - 1), F.lit("")) != "..")
        return F.when(part.isin("", "."), held).when(up, F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.array_append(held, part))

    parts = F.aggregate(components(path), F.expr("cast(array() as array<string>)"), step)
    return F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))


def relative(path: Column, root: str) -> Column:
    """``path`` as seen from the folder ``root``."""
    root = root.rstrip("/")
    if not root:
        return path
    depth = F.lit(root)
    inside = F.when(path == depth, F.lit("")).when(path.startswith(root + "/"), F.substr(path, F.lit(len(root) + 2)))
    # outside: up from root to the common folder, then down
    here = F.lit(root.split("/"))
    there = components(path)
    n = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(there), F.size(here))), lambda k: F.slice(there, 1, k) == F.slice(here, 1, k)))
    outside = F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(here) - n), F.slice(there, n + 1, F.greatest(F.size(there) - n, F.lit(0)))), "/")
    return F.coalesce(inside, outside)


def is_source(path: Column, suffixes: tuple[str, ...]) -> Column:
    """Whether the path ends in one of the suffixes."""
    return F.coalesce(F.array_max(F.array(*[path.endswith(s) for s in suffixes])), F.lit(False))


def is_below(path: Column, names: tuple[str, ...]) -> Column:
    """Whether one of the path's folders has one of the names."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda c: c.isin(*names))
