"""Small result tables as Markdown or CSV text; each is bounded by a limit, which is told where it cuts."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from granary.sources.storage import Files

LIMIT = 200


def _shown(value: object) -> str:
    if value is None:
        return "-"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, int):
        return f"{value:,}"
    if isinstance(value, float):
        return f"{value:,.2f}"
    return str(value).replace("\\", "\\\\").replace("|", "\\|").replace("\r", " ").replace("\n", " ")


def _rows(df: DataFrame, limit: int) -> tuple[list, bool]:
    found = df.limit(limit + 1).collect()
    return found[:limit], len(found) > limit


def markdown(df: DataFrame, limit: int = LIMIT) -> str:
    """A table of df's rows in df's order."""
    rows, cut = _rows(df, limit)
    line = lambda cells: f"| {' | '.join(cells)} |"
    lines = [line(map(_shown, df.columns)), line(["---"] * len(df.columns)), *(line(map(_shown, r)) for r in rows)]
    return "\n".join([*lines, f"\nThe first {limit} rows."] if cut else lines)


def document(sections: Iterable[tuple[str, DataFrame]], title: str, limit: int = LIMIT) -> str:
    """Titled tables, one after the other."""
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown(df, limit)}" for name, df in sections)]) + "\n"


def comma_separated(df: DataFrame, limit: int = LIMIT) -> str:
    """A header and df's rows; more rows than the limit are an error, as a file would not tell that it was cut."""
    rows, cut = _rows(df, limit)
    if cut:
        raise ValueError(f"more than {limit} rows: write it with Spark")
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([df.columns, *rows])
    return out.getvalue()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Whole or not at all, on any file system; an existing file is an error."""
    Files(spark, path.rsplit("/", 1)[0]).write_text(path, text)
