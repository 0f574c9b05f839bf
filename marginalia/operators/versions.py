"""The versions of a taxonomy as a tree: a log of events, each version the child of another.

A version holds what its own events leave of its parent. To restore a version is to append
a child of it, so nothing is ever rewritten, and any version can be read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.sources.scratch import saved

EVENTS = "version long, parent long, step int, action string, code_name string, definition string"

_PATHS = """
WITH RECURSIVE path(version, at, parent, depth) MAX RECURSION LEVEL {most} AS (
    SELECT v.version, v.version, v.parent, 0 FROM {{versions}} v LEFT SEMI JOIN {{wanted}} w ON v.version = w.version
    UNION ALL
    SELECT p.version, v.version, v.parent, p.depth + 1 FROM path p JOIN {{versions}} v ON v.version = p.parent
)
SELECT version, at, depth FROM path
"""


def ancestors(events: DataFrame, wanted: DataFrame, most: int = 1_000) -> DataFrame:
    """(version, at, depth): each of the versions ``wanted(version)`` with itself (0), its parent (1) and so on up to its root. A level of all ways is a step; a way longer than ``most`` is an error, as is a circle."""
    versions = saved(events.select("version", "parent").distinct(), "versions")
    return events.sparkSession.sql(_PATHS.format(most=int(most)), versions=versions, wanted=saved(wanted.select("version").distinct(), "wanted"))


def codebooks(events: DataFrame, wanted: DataFrame, most: int = 1_000) -> DataFrame:
    """(version, code_idx, code_name, definition) of the versions ``wanted(version)`` from ``events``.

    Of all events on the way to the root that name a code, the nearest to the version, then
    the one of the highest step counts: after ``put`` the code is there with its definition, at the
    place of this event; after ``remove`` it is gone. A version may have an event without a code: it equals its parent.
    """
    on_the_way = events.where("code_name IS NOT NULL").select(F.col("version").alias("at"), "step", "action", "code_name", "definition")
    found = ancestors(events, wanted, most).join(on_the_way.hint("shuffle_merge"), "at")
    last = found.groupBy("version", "code_name").agg(F.max_by(F.struct("depth", "step", "action", "definition"), F.struct(-F.col("depth"), F.col("step"))).alias("last"))
    place = F.row_number().over(Window.partitionBy("version").orderBy(F.desc("last.depth"), "last.step", "code_name")) - 1  # one taxonomy
    return last.where("last.action = 'put'").select("version", place.alias("code_idx"), "code_name", F.col("last.definition").alias("definition"))


def leaves(events: DataFrame) -> DataFrame:
    """(version): those without a child."""
    return events.select("version").distinct().join(events.select(F.col("parent").alias("version")).distinct().hint("shuffle_merge"), "version", "left_anti")
