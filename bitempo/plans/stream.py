"""Queries that run as streams over files until these are read, and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitempo.operators import export, history
from bitempo.operators.store import Store
from bitempo.plans import base
from bitempo.plans.base import FACTS, NODES
from bitempo.plans.history import EDGES, VERSIONS
from bitempo.session import Cut, checkpoint_dir, table
from bitempo.streaming import incremental


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/bitempo-stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The table as a file stream: a folder of files, or the one file of that name."""
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 1).parquet(d) if not _is_folder(spark, f"{d}/{name}.parquet") else spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/{name}.parquet")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


#: Batches that a table of one file is landed in.
FEED = 4


def streamed_history(spark: SparkSession, d: str) -> DataFrame:
    """The history of functional edges, merged from a stream of their snapshots in several batches.

    A table of one file is landed as a feed first, in order of delivery; one of
    many files is a feed already.
    """
    folder = _folder(spark)
    store = Store(spark, f"{folder}/tables")
    if _is_folder(spark, f"{d}/edge.parquet"):
        events = history.edge_events(_stream(spark, d, "edge"))
    else:
        feed = Cut(history.edge_events(table(spark, d, "edge")).repartitionByRange(FEED, "seen_ms"))
        events = spark.readStream.schema(feed.df.schema).option("maxFilesPerTrigger", 1).parquet(feed.path)
    incremental.sync_history(events, store, f"{folder}/checkpoint").awaitTermination()
    return history.held(store.read("history")).select("entity_id", "attribute", "valid_from_ms", "valid_to_ms")


def streamed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and type, counted by a stream with a watermark that no event misses."""
    folder = _folder(spark)
    events = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = incremental.windowed_counts(events, "ts", ["event_type"], "1 day", "4000 days")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/counts")

    counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/counts")
    return out.select("event_type", F.unix_seconds("start").alias("start_s"), "n")


def streamed_actions(spark: SparkSession, d: str) -> DataFrame:
    """How often records of a file stream were inserted, updated and kept."""
    folder = _folder(spark)
    rows = _stream(spark, d, "bitbucket_file").where("path is not null")
    states = rows.select(F.concat_ws(":", "repository_full_name", "path", "commit_hash").alias("record_key"), F.md5(F.coalesce("content", F.lit(""))).alias("content_hash"))

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(f"{folder}/actions")

    incremental.record_actions(states).writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/actions").where("action = 'insert'").agg(F.count(F.lit(1)).alias("records"))


def skos_lines(spark: SparkSession, d: str) -> DataFrame:
    named = base.nodes(spark, d).withColumn("name", F.concat_ws(" ", "label", F.substring("uid", 1, 8)))
    return export.skos(named, base.facts(spark, d).where("from_uid is not null and to_uid is not null"))


def nquads_size(spark: SparkSession, d: str) -> DataFrame:
    named = base.nodes(spark, d).withColumn("name", F.concat_ws(" ", "label", F.substring("uid", 1, 8)))
    return export.checksum(export.nquads(named, base.facts(spark, d).where("from_uid is not null and to_uid is not null"))).select("lines")


QUERIES = {f.__name__: f for f in (streamed_history, streamed_windows, streamed_actions, skos_lines, nquads_size)}
_LIVE = "(invalid_at IS NULL AND coalesce(assertion_status, 'live') <> 'corrected')"
ORACLES = {
    "streamed_history": "WITH " + EDGES.strip() + ", events AS (FROM edge_events)," + VERSIONS,
    "streamed_windows": "SELECT event_type, CAST(floor(epoch(date_trunc('day', ts))) AS BIGINT) AS start_s, count(*) AS n FROM events GROUP BY ALL",
    "streamed_actions": "SELECT count(DISTINCT repository_full_name || ':' || path || ':' || commit_hash) AS records FROM bitbucket_file WHERE path IS NOT NULL",
    "skos_lines": f"""WITH {FACTS}, {NODES} SELECT '<urn:bitempo:' || uid || '> a skos:Concept ; skos:prefLabel "' || label || ' ' || substr(uid, 1, 8) || '" ; skos:inScheme <urn:bitempo:scheme:' || label || '> .' AS line FROM nodes
UNION ALL SELECT DISTINCT '<urn:bitempo:' || from_uid || '> ' || CASE rel_type WHEN 'PARENT_OF' THEN 'skos:broader' ELSE 'skos:related' END || ' <urn:bitempo:' || to_uid || '> .' FROM facts WHERE {_LIVE} AND from_uid IS NOT NULL AND to_uid IS NOT NULL""",
    "nquads_size": f"WITH {FACTS}, {NODES} SELECT (SELECT 2 * count(*) FROM nodes) + (SELECT count(*) FROM (SELECT DISTINCT from_uid, rel_type, to_uid FROM facts WHERE from_uid IS NOT NULL AND to_uid IS NOT NULL)) AS lines",
}
