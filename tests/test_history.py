import json
import os

from tidewater.operators import app_summary, stage_summary
from tidewater.session import shared_dir
from tidewater.sources import read_event_log

LOG = [
    {"Event": "SparkListenerApplicationStart", "App Name": "counter", "App ID": "app-1", "Timestamp": 1000},
    {"Event": "SparkListenerJobStart", "Job ID": 0, "Submission Time": 1100},
    {"Event": "SparkListenerTaskEnd", "Stage ID": 0, "Stage Attempt ID": 0, "Task End Reason": {"Reason": "Success"},
     "Task Metrics": {"Executor Run Time": 70, "Input Metrics": {"Records Read": 9}}},
    {"Event": "SparkListenerTaskEnd", "Stage ID": 0, "Stage Attempt ID": 0, "Task End Reason": {"Reason": "ExceptionFailure"},
     "Task Metrics": {"Executor Run Time": 30}},
    {"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 0, "Stage Attempt ID": 0, "Stage Name": "sum",
     "Number of Tasks": 2, "Submission Time": 1100, "Completion Time": 1300}},
    {"Event": "SparkListenerJobEnd", "Job ID": 0, "Job Result": {"Result": "JobSucceeded"}},
    {"Event": "SparkListenerApplicationEnd", "Timestamp": 1500},
]


def write_log(spark, folder, parts=("app-1",)):
    """The log above, cut into the given files."""
    local = folder[len("file:"):] if folder.startswith("file:") else folder
    size = -(-len(LOG) // len(parts))
    for i, part in enumerate(parts):
        path = os.path.join(local, part)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write("".join(json.dumps(e) + "\n" for e in LOG[i * size:(i + 1) * size]) + "cut line\n")


def test_event_log_summaries(spark):
    logs = shared_dir(spark, "test-log")
    write_log(spark, logs)
    events = read_event_log(spark, logs)
    (a,) = app_summary(events).collect()
    assert (a.app_id, a.name, a.duration_ms, a.n_jobs, a.n_failed_jobs) == ("app-1", "counter", 500, 1, 0)
    assert (a.n_tasks, a.n_failed_tasks, a.executor_run_ms, a.n_stages) == (2, 1, 100, 1)
    (s,) = stage_summary(events).collect()
    assert (s.stage_name, s.n_tasks_declared, s.n_tasks, s.records_read, s.wall_ms) == ("sum", 2, 2, 9, 200)


def test_rolling_log_is_one_application(spark):
    logs = shared_dir(spark, "test-rolling-log")
    write_log(spark, logs, ("eventlog_v2_app-1/events_1_app-1", "eventlog_v2_app-1/events_2_app-1"))
    (a,) = app_summary(read_event_log(spark, logs)).collect()
    assert a.n_tasks == 2 and a.log_file.endswith("eventlog_v2_app-1")
