"""Post-processing jobs: new trials, conflicts, states, heartbeats, copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigtables.operators.quality import TERMINAL_STATES

#: Names that show that a target has been written before; seconds without a heartbeat after which a job is given up.
OUTPUT_NAMES, HEARTBEAT_TIMEOUT_S = ("metadata", "stage_position", "processed"), 120


def new_trials(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Trials (trial, mtime) under the local base and not under the remote one, by modification time, then name."""
    return local.join(remote.select("trial"), "trial", "left_anti").orderBy("mtime", "trial")


def trial_diff_set(local: DataFrame, remote: DataFrame) -> DataFrame:
    """The same as a set of names."""
    return local.select("trial").subtract(remote.select("trial"))


def output_conflicts(trials: DataFrame, entries: DataFrame) -> DataFrame:
    """Trials whose target holds an output already; entries: (trial, name)."""
    return trials.join(entries.where(F.col("name").isin(*OUTPUT_NAMES)).select("trial"), "trial", "left_semi")


def verify_copy(source: DataFrame, destination: DataFrame) -> DataFrame:
    """(path, state): identical, differs, missing (only in the source) or extra, from manifests (path, checksum)."""
    a, b = source.select("path", F.col("checksum").alias("_a"), F.lit(True).alias("_in_a")), destination.select("path", F.col("checksum").alias("_b"), F.lit(True).alias("_in_b"))
    state = F.when(F.col("_in_b").isNull(), "missing").when(F.col("_in_a").isNull(), "extra").when(F.col("_a").eqNullSafe(F.col("_b")), "identical").otherwise("differs")
    return a.join(b, "path", "full").select("path", state.alias("state"))


def job_rollup(trials: DataFrame) -> DataFrame:
    """(job_id, n_trials, n_failed, job_status) from trials (job_id, status)."""
    done, failed = F.count_if(F.col("status").isin(*TERMINAL_STATES)), F.count_if(F.col("status") == "failed")
    status = F.when(F.col("done") < F.col("n_trials"), "running").when(F.col("n_failed") == F.col("n_trials"), "all_fail").when(F.col("n_failed") > 0, "partial_fail").otherwise("complete")
    counted = trials.groupBy("job_id").agg(F.count("*").alias("n_trials"), failed.alias("n_failed"), done.alias("done"))
    return counted.select("job_id", "n_trials", "n_failed", status.alias("job_status"))


def latest_job(jobs: DataFrame) -> DataFrame:
    """The job submitted last; of several the highest id. No jobs: no row."""
    return jobs.orderBy(F.desc("submission_time"), F.desc("job_id")).limit(1)


def job_status_report(trials: DataFrame) -> DataFrame:
    """Trials of each job by id, the error shown only where one failed."""
    return trials.select("job_id", "trial_id", "status", F.when(F.col("status") == "failed", F.col("error")).alias("error")).orderBy("job_id", "trial_id")


def stale_jobs(beats: DataFrame, now: str, timeout_s: int = HEARTBEAT_TIMEOUT_S) -> DataFrame:
    """(job_id, last_beat, stale) at the timestamp `now`: stale if the last beat is older than the timeout; never without one."""
    last = beats.groupBy("job_id").agg(F.max("beat").alias("last_beat"))
    age = F.timestamp_diff("MICROSECOND", F.col("last_beat"), F.lit(now).cast("timestamp_ntz"))
    return last.select("job_id", "last_beat", F.coalesce(age > timeout_s * 1_000_000, F.lit(False)).alias("stale"))


def trial_lifecycle(events: DataFrame, aborted: DataFrame | None = None) -> DataFrame:
    """(job_id, trial_id, status) from events (job_id, trial_id, status, at, event_id).

    The first terminal state stands; before one, the latest state by time, then event. Trials of `aborted` jobs
    (job_id) that are not at an end have failed.
    """
    place = F.struct("at", "event_id")
    end = F.col("status").isin(*TERMINAL_STATES)
    now = events.groupBy("job_id", "trial_id").agg(F.coalesce(F.min_by("status", F.when(end, place)), F.max_by("status", place)).alias("status"))
    if aborted is None:
        return now
    gone = aborted.select("job_id").distinct().withColumn("_gone", F.lit(True))
    failed = F.col("_gone").isNotNull() & ~F.col("status").isin(*TERMINAL_STATES)
    return now.join(gone, "job_id", "left").select("job_id", "trial_id", F.when(failed, "failed").otherwise(F.col("status")).alias("status"))
