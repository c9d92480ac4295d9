"""Structured Streaming jobs: decode, bronze ingest, validation, running
aggregates. All take a streaming DataFrame and a shared checkpoint folder."""

from tidewater.streaming.decode import decode_events, encode_events
from tidewater.streaming.jobs import (bronze_ingest, compact_running, finished_epochs, read_running_result,
                                      read_running_updates, running_aggregate, running_updates, validate_stream)
from tidewater.streaming.stateful import (ROCKSDB, append_stream, first_deliveries, interval_join, missed_rows,
                                          session_totals, silent_keys, stream_counts, window_totals)

__all__ = ["ROCKSDB", "append_stream", "first_deliveries", "interval_join", "missed_rows", "session_totals",
           "silent_keys", "stream_counts", "window_totals", "decode_events", "encode_events", "bronze_ingest", "read_running_result", "running_aggregate", "running_updates",
           "read_running_updates", "compact_running", "finished_epochs",
           "validate_stream"]
