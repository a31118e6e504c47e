"""Joins of many rows to a table of keys, some of which very many rows have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_by_frequency(rows: DataFrame, keys: DataFrame, key: str, uses: str, share: float = 0.001) -> DataFrame:
    """Inner join of ``rows`` to ``keys`` (one row a key; ``uses``: how many rows have it), without a hot task.

    Keys that more than ``share`` of all uses fall to are at most 1 / share, so they are
    sent to all tasks and their rows are not shuffled; the rest meet by a shuffle, of
    which no key has more than ``share``. ``rows`` is read twice: give a written table.
    """
    total = keys.agg(F.sum(uses)).first()[0] or 0
    hot = F.col(uses) > share * total
    frequent, rare = keys.where(hot), keys.where(~hot)
    left = rows.join(F.broadcast(frequent.select(key)), key, "left_anti")
    return rows.join(F.broadcast(frequent), key).unionByName(left.join(rare, key))


#: Keys that are sent to all tasks: some 10 MB of short terms.
MOST_SENT = 200_000


def most_frequent(keys: DataFrame, uses: str, fit: Column, most: int = MOST_SENT) -> tuple[DataFrame, DataFrame]:
    """``keys`` (one row a key) that have the most ``uses``, ``most`` at most and only such as are ``fit`` to be sent, and the others.

    Words and the like are so uneven that these are nearly all uses, however many keys there are. ``keys`` is read several times: give a written table.
    """
    first = keys.where(fit).select(uses).orderBy(F.desc(uses)).limit(most + 1).agg(F.count("*").alias("n"), F.min(uses).alias("cut")).first()
    sent = fit if first["n"] <= most else fit & (F.col(uses) > first["cut"])
    return keys.where(sent), keys.where(~sent)
