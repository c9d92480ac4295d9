"""Readers: configured file sources, the event stream, file inventory,
catalog tables and application event logs."""

from tidewater.sources.files import SourceSpec, load_source, read_table, register_tables
from tidewater.sources.events import EVENTS_SCHEMA, EventSourceSpec, event_source
from tidewater.sources.inventory import file_inventory
from tidewater.sources.catalog import (append_table, ensure_database, read_catalog_table,
                                       save_table)
from tidewater.sources.eventlog import read_event_log

__all__ = [
    "SourceSpec", "load_source", "read_table", "register_tables",
    "EVENTS_SCHEMA", "EventSourceSpec", "event_source", "file_inventory",
    "ensure_database", "save_table", "append_table", "read_catalog_table", "read_event_log",
]
