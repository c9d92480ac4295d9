"""Nested JSON records flattened with defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field names of the application record of the cluster API, as
# far as they are shown.
APP_RECORD_SCHEMA = """
    metadata STRUCT<name: STRING, namespace: STRING, creationTimestamp: STRING>,
    spec STRUCT<type: STRING, image: STRING>,
    status STRUCT<applicationState: STRUCT<state: STRING, errorMessage: STRING>>
"""


def flatten_app_record(json_text) -> Column:
    """Struct of name, namespace, state (``UNKNOWN`` when missing), message
    (empty when missing), type, image, created (NULL when missing)."""
    c = F.col(json_text) if isinstance(json_text, str) else json_text
    r = F.from_json(c, APP_RECORD_SCHEMA)
    state = r["status"]["applicationState"]
    return F.struct(
        r["metadata"]["name"].alias("name"),
        r["metadata"]["namespace"].alias("namespace"),
        F.coalesce(state["state"], F.lit("UNKNOWN")).alias("state"),
        F.coalesce(state["errorMessage"], F.lit("")).alias("message"),
        r["spec"]["type"].alias("type"),
        r["spec"]["image"].alias("image"),
        r["metadata"]["creationTimestamp"].alias("created"),
    )
