"""Users and sessions with a time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import now
from ..schema import SESSION_DAYS


def find(table: DataFrame, column: str, value: str | None) -> DataFrame:
    """The first row with this value; none for an empty one."""
    return table.where(F.col(column) == value).limit(1) if value else table.limit(0)


def remove(sessions: DataFrame, session_id: str) -> DataFrame:
    return sessions.where(F.col("session_id") != session_id)


def expired(at: Column, days: int = SESSION_DAYS) -> Column:
    """Whether a session has run out at a time; one whose creation can't be read has."""
    created = F.try_to_timestamp("created_at", F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(at >= created + F.expr(f"INTERVAL {days} DAYS"), F.lit(True))


def active(sessions: DataFrame, at: str) -> DataFrame:
    return sessions.where(~expired(F.lit(at).cast("timestamp")))


def with_users(sessions: DataFrame, users: DataFrame, at: str) -> DataFrame:
    """Active sessions with their users; expired ones and those of unknown users are left out."""
    return active(sessions, at).join(users, "username")


def login(sessions: DataFrame, username: str, at: str | None = None) -> DataFrame:
    """Add a session with a new id."""
    new = sessions.sparkSession.range(1).select(F.replace(F.uuid(), F.lit("-"), F.lit("")).alias("session_id"), F.lit(username).alias("username"), now(at).alias("created_at"))
    return sessions.unionByName(new)
