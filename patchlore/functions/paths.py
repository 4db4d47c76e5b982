"""Module path arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Endings tried, in this order, when a specifier names a module.
MODULE_ENDINGS = ["", ".ts", ".tsx", "/index.ts", "/index.tsx"]


def normalize_path(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; a ``..`` above the root is kept."""
    def push(stack: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(stack) > 0) & (F.element_at(stack, -1) != "..")
        return (F.when(part.isin("", "."), stack)
                .when(up, F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
                .otherwise(F.concat(stack, F.array(part))))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), push)
    return F.concat_ws("/", parts)


def module_candidates(from_file: Column, spec: Column) -> Column:
    """Paths a relative specifier may mean, best first; null for a bare specifier."""
    folder = F.regexp_extract(from_file, r"^(.*)/[^/]*$", 1)
    base = normalize_path(F.concat(folder, F.lit("/"), spec))
    tries = F.array(*[F.concat(base, F.lit(e)) for e in MODULE_ENDINGS])
    return F.when(spec.startswith("."), tries)
