"""Model versions as an event log; the state is a fold over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENTS = "seq bigint, action string, version_id string"


#: Rows of a log that are put in order at once, and the most parts that it is cut into.
PART_ROWS, MOST_PARTS = 200_000, 1024


def _part(seq: Column, bounds: list, lo: int = 0, hi: int | None = None) -> Column:
    """How many of the sorted bounds a number reaches, by halving."""
    hi = len(bounds) if hi is None else hi
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(seq < F.lit(bounds[mid]), _part(seq, bounds, lo, mid)).otherwise(_part(seq, bounds, mid + 1, hi))


def next_version(n_versions: int, taken: set[str]) -> str:
    """``v`` and six digits: one more than there are, or the first free number after it."""
    n = n_versions + 1
    while (name := f"v{n:06d}") in taken:
        n += 1
    return name


def states(events: DataFrame) -> DataFrame:
    """Status of each version from register / promote / reject / start_ab / stop_ab events: version_id, status, parent.

    The first registered version is promoted at once.  Promotion retires the
    version before it and ends a running comparison; a version's parent is the
    current one at its registration.  The log is read in parts by number, so
    that no task puts all of it in order.
    """
    told = events.agg(F.count("*").alias("n"), F.min(F.when(F.col("action") == "register", F.col("seq"))).alias("first")).first()
    n_parts = max(1, min(MOST_PARTS, -(-told["n"] // PART_ROWS)))
    bounds = []
    if n_parts > 1:
        bounds = sorted(set(events.agg(F.percentile_approx("seq", [i / n_parts for i in range(1, n_parts)])).first()[0] or []))
    promoted = (F.col("action") == "promote") | ((F.col("action") == "register") & (F.col("seq") == F.lit(told["first"])))
    log = events.withColumns({"is_promotion": promoted, "part": F.when(F.col("seq").isNull(), -1).otherwise(_part(F.col("seq"), bounds))})
    version = F.when(F.col("is_promotion"), F.col("version_id"))
    # what a part of the log hands on is one row; a part goes on from the last promotion of those before it
    last = log.where(F.col("is_promotion") & F.col("version_id").isNotNull()).groupBy("part").agg(F.max_by("version_id", "seq").alias("last"))
    parts = events.sparkSession.range(-1, len(bounds) + 1).select(F.col("id").cast("int").alias("part")).join(F.broadcast(last), "part", "left")
    carried = parts.select("part", F.last("last", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    so_far = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    log = log.withColumn("before", F.last(version, ignorenulls=True).over(so_far)).join(F.broadcast(carried), "part")
    log = log.withColumn("parent", F.when(F.col("action") == "register", F.coalesce("before", "carried")))
    end = events.withColumn("is_promotion", promoted).agg(
        F.max_by(F.col("version_id"), F.when(F.col("is_promotion") & F.col("version_id").isNotNull(), F.col("seq"))).alias("now"),
        F.max(F.when(F.col("is_promotion") | (F.col("action") == "stop_ab"), F.col("seq"))).alias("ended"),
    )
    own = log.groupBy("version_id").agg(
        F.max("parent").alias("parent"),
        F.max(F.when(F.col("is_promotion"), F.col("seq"))).alias("promoted_at"),
        F.max(F.when(F.col("action") == "reject", F.col("seq"))).alias("rejected_at"),
        F.max(F.when(F.col("action") == "start_ab", F.col("seq"))).alias("compared_at"),
    )
    status = (
        F.when(F.col("version_id") == F.col("now"), "current")
        .when(F.col("rejected_at") > F.coalesce("promoted_at", F.lit(-1)), "rejected")
        .when(F.col("compared_at") > F.coalesce("ended", F.lit(-1)), "challenger")
        .when(F.col("promoted_at").isNotNull() | F.col("compared_at").isNotNull(), "retired")
        .otherwise("candidate")
    )
    return own.crossJoin(F.broadcast(end)).select("version_id", status.alias("status"), "parent")


def rollback_target(states_of: DataFrame) -> DataFrame:
    """The version that a rollback promotes: the parent of the current one."""
    return states_of.where("status = 'current'").select(F.col("parent").alias("version_id"))


def listed(versions: DataFrame) -> DataFrame:
    """Versions in the order of their ids."""
    return versions.orderBy("version_id")


def write_back(events: DataFrame, versions: DataFrame, path: str) -> None:
    """The registry as tables: the log, and each version's state and facts; a single writer overwrites both."""
    events.write.mode("overwrite").parquet(f"{path}/events")
    states(events).join(versions, "version_id", "left").write.mode("overwrite").parquet(f"{path}/versions")


def weights_of(configured: Column, registered: Column, version: Column, exists: Column, use_registry: bool = True) -> tuple[Column, Column]:
    """Path and origin of the weights: the configured ones, else those of the current version if they are there, else none."""
    set_by_hand = F.coalesce(configured, F.lit("")) != ""
    current = F.lit(use_registry) & registered.isNotNull() & F.coalesce(exists, F.lit(False))
    return (
        F.when(set_by_hand, configured).when(current, registered),
        F.when(set_by_hand, "config").when(current, F.concat(F.lit("registry "), version)).otherwise("none"),
    )
