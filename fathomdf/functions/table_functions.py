"""Table-valued functions for SQL: registered by name, called in FROM, also laterally."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class Windows:
    """windows(text, size, step): (pos, words), the runs of `size` white-space words, a step apart; a shorter text is one."""

    def eval(self, text: str, size: int, step: int) -> Iterator[tuple[int, str]]:
        words = [w for w in (text or "").replace("\n", " ").split(" ") if w]
        at = 0
        while at < len(words):
            yield at, " ".join(words[at : at + size])
            if at + size >= len(words):
                break
            at += step


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    from fathomdf.session import ship

    ship(spark)
    spark.udtf.register("windows", udtf(Windows, returnType="pos int, words string"))
