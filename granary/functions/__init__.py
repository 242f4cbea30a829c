"""Column functions of the engine."""

from granary.functions.exprs import compact_flags, finite, first_match, money, normalized, trimmed

__all__ = ["compact_flags", "finite", "first_match", "money", "normalized", "trimmed"]
