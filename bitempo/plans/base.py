"""The graph that the driver's tables make, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitempo.session import table

#: Instants that queries ask about.
AT, UNTIL, AS_OF, NOW = "2024-01-01 00:00:00", "2024-04-01 00:00:00", "2024-02-01 00:00:00", "2026-06-01 00:00:00"


def ts(text: str):
    return F.lit(text).cast("timestamp")


def facts(spark: SparkSession, d: str) -> DataFrame:
    """One row per fact: of redelivered rows the one observed last."""
    e = table(spark, d, "edge").where("fact_uid is not null")
    rest = [c for c in e.columns if c != "fact_uid"]
    one = e.groupBy("fact_uid").agg(F.max_by(F.struct(*rest), F.struct("observed_at", "assertion_status", "to_uid")).alias("s")).select("fact_uid", "s.*")
    at = lambda c: F.col(c).cast("timestamp").alias(c)
    kinds = {"valid_at", "invalid_at", "observed_at"}
    return one.select(*[at(c) if c in kinds else F.col(c) for c in e.columns])


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """``(uid, label)`` of both ends of all facts."""
    f = facts(spark, d)
    ends = f.select(F.col("from_uid").alias("uid"), F.col("from_label").alias("label")).unionByName(f.select(F.col("to_uid").alias("uid"), F.col("to_label").alias("label")))
    return ends.where("uid is not null").groupBy("uid").agg(F.min("label").alias("label"))


def issues(spark: SparkSession, d: str) -> DataFrame:
    """One row per issue: the state updated last."""
    j = table(spark, d, "jira_issue").where("issue_id is not null").drop("labels", "blocks")
    rest = [c for c in j.columns if c != "issue_id"]
    return j.groupBy("issue_id").agg(F.max_by(F.struct(*rest), F.struct("updated_at", "ingested_at")).alias("s")).select("issue_id", "s.*")


FACTS = """facts AS (SELECT DISTINCT ON (fact_uid) * FROM edge WHERE fact_uid IS NOT NULL ORDER BY fact_uid, observed_at DESC NULLS LAST, assertion_status DESC NULLS LAST, to_uid DESC NULLS LAST)"""
NODES = """ends AS (SELECT from_uid AS uid, from_label AS label FROM facts UNION ALL SELECT to_uid, to_label FROM facts),
nodes AS (SELECT uid, min(label) AS label FROM ends WHERE uid IS NOT NULL GROUP BY uid)"""
ISSUES = "issues AS (SELECT DISTINCT ON (issue_id) * FROM jira_issue WHERE issue_id IS NOT NULL ORDER BY issue_id, updated_at DESC NULLS LAST, ingested_at DESC NULLS LAST)"
LIVE = "(invalid_at IS NULL AND coalesce(assertion_status, 'live') <> 'corrected')"
