"""All registered queries of the library with their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NUDGE = 2.3717e-8
FLAGSHIP = "governor_summary"
#: Named subqueries that SQL texts may use: name -> (names it uses, text).
VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, text: str, uses: list[str] | None = None) -> None:
    VIEWS[name] = (uses or [], text)


def with_views(text: str, uses: list[str]) -> str:
    """text behind a WITH clause of the views in uses and all that they use."""
    found: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in found:
            needs, body = VIEWS[name]
            for n in needs:
                add(n)
            found[name] = body

    for name in uses:
        add(name)
    return ("with " + ",\n".join(f"{n} as ({b})" for n, b in found.items()) + "\n" if found else "") + text


def query(name: str, sql: str | None = None, uses: list[str] | None = None, rounds: str = "", digits: int = 6):
    """Register the decorated (spark, sf_dir) function under name, with its SQL. rounds: columns rounded on both sides,
    so that the order of a sum does not matter; the nudge keeps decimal halves off the bound."""
    names = rounds.split()

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.round(F.col(c).cast("double") + NUDGE, digits) for c in names})

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql is not None:
            replaced = f" replace ({', '.join(f'round({c}::double + {NUDGE}, {digits}) as {c}' for c in names)})" if names else ""
            ORACLES[name] = f"select *{replaced} from (\n{with_views(sql, uses or [])}\n) as result"
        return f

    return put
