"""Extents, header rows and recovery measures of extracted tables, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extent(cells: Column, at: str, span: str) -> Column:
    """Rows (or columns) a table covers: the largest place plus span; 0 without cells."""
    return F.coalesce(F.array_max(F.transform(cells, lambda c: c[at] + F.coalesce(c[span], F.lit(1)))), F.lit(0))


def leading(flags: Column) -> Column:
    """How many flags from the first on are true; null flags count as false."""
    first = F.array_position(F.transform(flags, lambda x: F.coalesce(x, F.lit(False))), F.lit(False))
    return F.when(flags.isNull(), 0).when(first == 0, F.size(flags)).otherwise(first.cast("int") - 1)


def well_formed(cells: Column, rows: Column, columns: Column) -> Column:
    """Whether every cell lies within the table."""
    return F.forall(cells, lambda c: (c["row"] >= 0) & (c["col"] >= 0) & (c["row"] < rows) & (c["col"] < columns))


def lineage(seen: Column, core: list[str]) -> Column:
    """Share of the core steps that are seen."""
    wanted = F.array(*[F.lit(c) for c in core])
    return F.size(F.array_intersect(wanted, F.coalesce(seen, F.array().cast("array<string>")))) / F.lit(float(len(core)))
