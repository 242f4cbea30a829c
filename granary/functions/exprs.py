"""Column functions shared by the operators. All compile to built-in expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


#: White space of any script.
WHITE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def normalized(x: Column, collapse: bool = False) -> Column:
    """Upper case without white space (of any script) around it, and with single spaces inside if asked; blank is null."""
    bare = F.btrim(F.upper(x), F.lit(WHITE))
    if collapse:
        spaced = F.translate(bare, WHITE, " " * len(WHITE))
        bare = F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, " +", " ")).otherwise(spaced)
    return F.nullif(bare, F.lit(""))


def trimmed(x: Column) -> Column:
    """Without ASCII spaces around it; blank is null."""
    return F.nullif(F.trim(x), F.lit(""))


def truth(x: Column) -> Column:
    """A condition with unknown as false."""
    return F.coalesce(x, F.lit(False))


def compact_flags(named: Iterable[tuple[str, Column]]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in named]))


def first_match(choices: Iterable[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first condition that holds."""
    (condition, value), *rest = choices
    out = F.when(condition, value)
    for condition, value in rest:
        out = out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def money(quantity: Column, price: Column) -> Column:
    """Line amount: exact product of four-place decimals; sums are rounded, lines are not."""
    return quantity.cast("decimal(18,4)") * price.cast("decimal(18,4)")
