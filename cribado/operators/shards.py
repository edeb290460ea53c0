"""Which shards are still to be processed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending_shards(shards: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """Shards whose key is not among the finished ones."""
    return shards.join(finished.select(key), key, "left_anti")


def completed_shards(listed: DataFrame, log: DataFrame) -> DataFrame:
    """Names from the commit log (`name`, `length`, `modified`) whose file is there as it was committed.

    `listed` has `path`, `length` and `modified` of the files that are there. A file that is missing, cut, or was
    changed later is not complete; neither is one without an entry. A name that was committed several times needs to agree with
    one of the entries.
    """
    there = listed.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modified")
    return there.join(log.select("name", "length", "modified").distinct(), ["name", "length", "modified"], "left_semi").select("name")
