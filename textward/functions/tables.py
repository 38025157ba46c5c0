"""Rule, phrase and weight tables that come with the package; every operator also takes tables of the caller's own."""

from __future__ import annotations

import functools
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

RULES = Path(__file__).resolve().parent.parent / "rules"


@functools.lru_cache(None)
def rows(name: str) -> tuple[tuple[str, ...], ...]:
    """Rows of rules/<name>.tsv, without its comment line."""
    lines = (RULES / f"{name}.tsv").read_text(encoding="utf-8").split("\n")
    return tuple(tuple(x.split("\t")) for x in lines[1:] if x)


def grouped(name: str) -> dict[str, list[str]]:
    """{group: phrases} of a phrase table."""
    out: dict[str, list[str]] = {}
    for group, phrase in rows(f"phrases_{name}"):
        out.setdefault(group, []).append(phrase)
    return out


def frame(spark: SparkSession, name: str, columns: str) -> DataFrame:
    """A table as a DataFrame, with `ord` first; columns is a schema of strings, cast as stated."""
    names = [x.split()[0] for x in columns.split(", ")]
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(rows(name))], "ord int, " + ", ".join(f"{n} string" for n in names))
    return raw.selectExpr("ord", *(f"cast({n} as {x.split()[1]}) as {n}" for n, x in zip(names, columns.split(", "))))


def sql_values(table: list | tuple) -> str:
    """Rows as the body of VALUES."""

    def one(x) -> str:
        return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in table)
