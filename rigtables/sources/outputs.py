"""Results of jobs, published by recording.

    path/data/run=<run>/...      rows of a run, however far it came
    path/recordings/run=<run>/   the recordings that a whole run wrote, with their row counts
    path/runs/                   one file a run, written last: it makes the run count

A run that is lost before its last file leaves nothing that is read. Of a recording written by several runs the latest counts.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from rigtables.durable import kept

RUNS = "run string, at_us long, kind string, fields string"
#: Recordings that are named in a message.
NAMED = 5


def _runs(spark: SparkSession, path: str) -> DataFrame | None:
    """The whole runs; none if nothing was ever published."""
    try:
        runs = spark.read.schema(RUNS).parquet(f"{path}/runs")
        return runs if runs.take(1) else None
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """(recording_id, run, n_rows): what counts for each recording; none if nothing is there."""
    runs = _runs(spark, path)
    if runs is None:
        return None
    kind = runs.select("kind").first()[0]
    entries = spark.read.schema(f"recording_id {kind}, n_rows long, run string").parquet(f"{path}/recordings")
    whole = entries.join(F.broadcast(runs.select("run", "at_us")), "run")  # a row for each run
    return whole.groupBy("recording_id").agg(F.max_by(F.struct("run", "n_rows"), F.struct("at_us", "run")).alias("r")).select("recording_id", "r.run", "r.n_rows")


def _names(recordings: DataFrame) -> str:
    some = [str(r[0]) for r in recordings.orderBy("recording_id").limit(NAMED + 1).collect()]
    return ", ".join(some[:NAMED]) + (" and more" if len(some) > NAMED else "")


def write_outputs(df: DataFrame, path: str, existing: str = "refuse") -> None:
    """Publishes the rows of df by recording_id; all recordings or none become visible, when the run's last file is there.

    existing: what becomes of recordings that are published already. `refuse`: if df has any, FileExistsError names the first of
    them and nothing is written. `overwrite`: those in df replace them. `keep`: they stay as they are, and only the others are written.
    Rows without recording_id are refused. No rows publish nothing. All runs of a path have the same columns.
    """
    if existing not in ("refuse", "overwrite", "keep"):
        raise ValueError(f"existing is refuse, overwrite or keep, not {existing}")
    spark, run = df.sparkSession, uuid.uuid4().hex
    before = published(spark, path)
    if before is not None:
        have, want = _runs(spark, path).select("fields").first()[0], _fields(df)
        if have != want:
            raise ValueError(f"the outputs there have the columns {have}, not {want}")
        there = kept(before.select("recording_id"))
        if existing == "keep":
            df = df.join(there, "recording_id", "left_anti").select(*df.columns)
        elif existing == "refuse":
            again = df.select("recording_id").distinct().join(there, "recording_id", "left_semi")
            if names := _names(again):
                raise FileExistsError(f"outputs of recordings {names} are published in {path}")
    named = df.withColumn("recording_id", F.coalesce("recording_id", F.raise_error(F.lit("a row without recording_id")).cast(df.schema["recording_id"].dataType)))
    named.write.parquet(f"{path}/data/run={run}")
    rows = spark.read.schema(df.schema).parquet(f"{path}/data/run={run}")
    entries = rows.groupBy("recording_id").agg(F.count("*").alias("n_rows"))
    if not rows.take(1):
        return
    entries.write.parquet(f"{path}/recordings/run={run}")
    last = [(run, time.time_ns() // 1000, df.schema["recording_id"].dataType.simpleString(), _fields(df))]
    spark.createDataFrame(last, RUNS).coalesce(1).write.mode("append").parquet(f"{path}/runs")


def _fields(df: DataFrame) -> str:
    """Names and types, whatever may be null."""
    return StructType([StructField(f.name, f.dataType) for f in df.schema]).json()


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """The published rows of all recordings."""
    current = published(spark, path)
    if current is None:
        raise FileNotFoundError(f"nothing is published in {path}")
    schema = StructType.fromJson(json.loads(_runs(spark, path).select("fields").first()[0]))
    rows = spark.read.schema(StructType([*schema.fields, StructField("run", StringType())])).parquet(f"{path}/data")
    return rows.join(current.select("recording_id", "run"), ["recording_id", "run"]).select(*schema.names)


def reuse_outputs(spark: SparkSession, path: str, recordings: DataFrame) -> DataFrame:
    """The published rows of `recordings` (recording_id), to go on from; FileNotFoundError names those that have none."""
    current = published(spark, path)
    asked = recordings.select("recording_id").distinct()
    lost = asked if current is None else asked.join(current, "recording_id", "left_anti")
    if names := _names(lost):
        raise FileNotFoundError(f"no outputs of recordings {names} are published in {path}")
    return read_outputs(spark, path).join(asked, "recording_id", "left_semi")
