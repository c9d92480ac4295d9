"""Per-application and per-stage summaries of Spark event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _is(kind: str):
    return F.col("Event") == F.lit(f"SparkListener{kind}")


def app_summary(events: DataFrame) -> DataFrame:
    """One row per application (log file): id, name, start, end, duration,
    job/stage/task counts, failures and executor run time. A single
    aggregation over all log lines."""
    task_failed = _is("TaskEnd") & (F.col("`Task End Reason`.Reason") != F.lit("Success"))
    job_failed = _is("JobEnd") & (F.col("`Job Result`.Result") != F.lit("JobSucceeded"))
    stage_failed = _is("StageCompleted") & F.col("`Stage Info`.`Failure Reason`").isNotNull()
    start = F.max(F.when(_is("ApplicationStart"), F.col("Timestamp")))
    end = F.max(F.when(_is("ApplicationEnd"), F.col("Timestamp")))
    return (events.filter(F.col("Event").isNotNull())
            .groupBy("log_file")
            .agg(F.max(F.when(_is("ApplicationStart"), F.col("`App ID`"))).alias("app_id"),
                 F.max(F.when(_is("ApplicationStart"), F.col("`App Name`"))).alias("name"),
                 start.alias("start_ms"),
                 end.alias("end_ms"),
                 F.count_if(_is("JobStart")).alias("n_jobs"),
                 F.count_if(job_failed).alias("n_failed_jobs"),
                 F.count_if(_is("StageCompleted")).alias("n_stages"),
                 F.count_if(stage_failed).alias("n_failed_stages"),
                 F.count_if(_is("TaskEnd")).alias("n_tasks"),
                 F.count_if(task_failed).alias("n_failed_tasks"),
                 F.coalesce(F.sum(F.when(_is("TaskEnd"),
                                         F.col("`Task Metrics`.`Executor Run Time`"))),
                            F.lit(0)).alias("executor_run_ms"))
            .withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
            .withColumn("start", F.timestamp_millis("start_ms"))
            .withColumn("end", F.timestamp_millis("end_ms")))


def stage_summary(events: DataFrame) -> DataFrame:
    """One row per (application, stage, attempt): name, declared task count,
    tasks seen, failed tasks, run time, records read, shuffle bytes written,
    wall time of the stage."""
    stage_id = F.coalesce(F.col("`Stage ID`"), F.col("`Stage Info`.`Stage ID`"))
    attempt = F.coalesce(F.col("`Stage Attempt ID`"), F.col("`Stage Info`.`Stage Attempt ID`"))
    rows = (events.filter(_is("TaskEnd") | _is("StageCompleted"))
            .select("log_file", "Event", stage_id.alias("stage_id"), attempt.alias("attempt"),
                    "`Stage Info`", "`Task End Reason`", "`Task Metrics`"))
    done = _is("StageCompleted")
    task = _is("TaskEnd")
    return (rows.groupBy("log_file", "stage_id", "attempt")
            .agg(F.max(F.when(done, F.col("`Stage Info`.`Stage Name`"))).alias("stage_name"),
                 F.max(F.when(done, F.col("`Stage Info`.`Number of Tasks`"))).alias("n_tasks_declared"),
                 F.count_if(task).alias("n_tasks"),
                 F.count_if(task & (F.col("`Task End Reason`.Reason") != "Success")).alias("n_failed_tasks"),
                 F.coalesce(F.sum(F.when(task, F.col("`Task Metrics`.`Executor Run Time`"))),
                            F.lit(0)).alias("executor_run_ms"),
                 F.coalesce(F.sum(F.when(task, F.col("`Task Metrics`.`Input Metrics`.`Records Read`"))),
                            F.lit(0)).alias("records_read"),
                 F.coalesce(F.sum(F.when(task, F.col("`Task Metrics`.`Shuffle Write Metrics`.`Shuffle Bytes Written`"))),
                            F.lit(0)).alias("shuffle_bytes_written"),
                 (F.max(F.when(done, F.col("`Stage Info`.`Completion Time`")))
                  - F.max(F.when(done, F.col("`Stage Info`.`Submission Time`")))).alias("wall_ms")))
