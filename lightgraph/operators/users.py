"""Users: interaction history, sessions, affinities, access, boosts and feed seeds, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import BINS, UserContext

SESSION = 100
COUNT_WEIGHT, RECENCY_WEIGHT = 0.1, 0.2


def history(interactions: DataFrame) -> DataFrame:
    """(user_id, node_id, times, last): interactions (user_id, node_id, at) counted; `at` orders them."""
    return interactions.groupBy("user_id", "node_id").agg(F.count("*").alias("times"), F.max("at").alias("last"))


def sessions(seen: DataFrame, most: int = SESSION) -> DataFrame:
    """(user_id, node_id, pos): the most recent distinct nodes of each user, latest first, from a history."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last"), "node_id"))
    return seen.withColumn("rank", rank).where(F.col("rank") <= most).select("user_id", "node_id", (F.col("rank") - 1).alias("pos"))


def affinities(values: DataFrame) -> DataFrame:
    """(user_id, bin, affinity) between 0 and 1; other bins are dropped."""
    return values.where(F.col("bin").between(0, BINS - 1)).select("user_id", "bin", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("affinity"))).alias("affinity"))


def all_affinities(users: DataFrame, given: DataFrame) -> DataFrame:
    """Every user's every bin; 1 where nothing is given."""
    every = users.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"))
    return every.join(given, ["user_id", "bin"], "left").select("user_id", "bin", F.coalesce("affinity", F.lit(1.0)).alias("affinity"))


def preferred_bins(full: DataFrame) -> DataFrame:
    """(user_id, bin, affinity, rank): by affinity, ties to the smaller bin."""
    return full.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("affinity"), "bin")))


def accessible(rows: DataFrame, acl: DataFrame) -> DataFrame:
    """Rows (user_id, room, ...) whose room the user may enter. A user without any row in the acl may enter all."""
    bound = acl.select("user_id").distinct().withColumn("bound", F.lit(True))
    free = rows.join(bound, "user_id", "left_anti")
    return free.unionByName(rows.join(acl.select("user_id", "room"), ["user_id", "room"], "left_semi").select(rows.columns))


def boost(times: Column, pos: Column, decay: float = 0.9) -> Column:
    """1 + 0.1 ln(1 + times) + 0.2 decay^pos; null times or pos add nothing."""
    return F.lit(1.0) + F.lit(COUNT_WEIGHT) * F.log1p(F.coalesce(times, F.lit(0)).cast("double")) + F.coalesce(F.lit(RECENCY_WEIGHT) * F.pow(F.lit(decay), pos.cast("double")), F.lit(0.0))


def boosts(rows: DataFrame, seen: DataFrame, session: DataFrame, acl: DataFrame | None = None, decay: float = 0.9) -> DataFrame:
    """(user_id, node_id, boost) for rows (user_id, node_id[, room]); 0 where the room is closed to the user."""
    joined = rows.join(seen.select("user_id", "node_id", "times"), ["user_id", "node_id"], "left").join(session, ["user_id", "node_id"], "left")
    value = boost(F.col("times"), F.col("pos"), decay)
    if acl is not None:
        open_ = accessible(rows.select("user_id", "room").distinct(), acl).withColumn("open", F.lit(True))
        joined = joined.join(open_, ["user_id", "room"], "left")
        value = F.when(F.col("open").isNotNull(), value).otherwise(F.lit(0.0))
    return joined.select("user_id", "node_id", value.alias("boost"))


def modulated(dir_lum: Column, affinity: Column) -> Column:
    return F.zip_with(dir_lum, affinity, lambda a, b: a * b)


def feed_seeds(seen: DataFrame, session: DataFrame, most: int) -> DataFrame:
    """(user_id, node_id, rank): half of the seeds from the session, then the nodes with the highest counts."""
    recent = session.where(F.col("pos") < most // 2).select("user_id", "node_id", F.lit(0).alias("part"), F.col("pos").cast("long").alias("key"))
    others = seen.join(recent, ["user_id", "node_id"], "left_anti").select("user_id", "node_id", F.lit(1).alias("part"), (-F.col("times")).cast("long").alias("key"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("part", "key", "node_id"))
    return recent.unionByName(others).withColumn("rank", rank).where(F.col("rank") <= most).select("user_id", "node_id", "rank")


def without_session(session: DataFrame, user_id) -> DataFrame:
    return session.where(F.col("user_id") != user_id)


def without_user(table: DataFrame, user_id) -> DataFrame:
    """A history, session, affinity or access table with all of a user's rows removed."""
    return table.where(F.col("user_id") != user_id)


def context(user_id, seen: DataFrame, session: DataFrame, full: DataFrame | None = None, acl: DataFrame | None = None, decay: float = 0.9) -> UserContext:
    """One user's state as plain values: a session has 100 nodes, a history as many as the user visited."""
    mine = lambda df: df.where(F.col("user_id") == user_id)
    out = UserContext(str(user_id), decay=decay)
    out.interactions = {r.node_id: r.times for r in mine(seen).collect()}
    out.session = [r.node_id for r in mine(session).orderBy("pos").collect()]
    if full is not None:
        for r in mine(full).collect():
            out.topic_affinities[r.bin] = r.affinity
    if acl is not None:
        out.rooms = {r.room for r in mine(acl).collect()}
    return out
