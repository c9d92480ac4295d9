"""DataFrame -> DataFrame operators."""

from tidewater.operators.stats import (agg_by_map, conditional_counts, exact_sum, format_stats,
                                       one_pass_stats, range_stats, rollup_totals,
                                       status_metrics)
from tidewater.operators.relations import (delete_by_key, dependent_rows, insert_if_absent,
                                           latest_by_key, order_parts, range_join, reconcile, split_by_class, stale_rows,
                                           tail_n_per_key, union_parts, upsert_by_key)
from tidewater.operators.filters import filter_eq, filter_in, filter_not_contains
from tidewater.operators.text import split_explode, word_count
from tidewater.operators.quality import (REJECT_REASONS, retention_filter, tag_rejects,
                                         validated, quarantined, write_validated)
from tidewater.operators.history import app_summary, stage_summary
from tidewater.operators.schema import describe_schema, head_n
from tidewater.operators.ranking import (ntile_from, ntile_within_key, rank_within_key,
                                         row_number_within_key)
from tidewater.operators.frames import (frame_sum, neighbours_within_key, range_count_within_key,
                                        rows_frame_sum)
from tidewater.operators.hotkeys import by_key_size, hot_keys
from tidewater.operators.names import unused_name, unused_names
from tidewater.operators.slices import asof_join, quantiles_by_key

__all__ = [
    "agg_by_map", "conditional_counts", "format_stats", "one_pass_stats", "range_stats",
    "rollup_totals", "status_metrics", "dependent_rows", "insert_if_absent",
    "latest_by_key", "order_parts", "reconcile", "split_by_class", "stale_rows", "tail_n_per_key",
    "union_parts", "upsert_by_key", "filter_eq", "filter_in", "filter_not_contains",
    "split_explode", "word_count", "REJECT_REASONS", "retention_filter", "tag_rejects",
    "validated", "quarantined", "write_validated", "app_summary", "stage_summary",
    "describe_schema", "head_n", "ntile_from", "ntile_within_key", "rank_within_key",
    "row_number_within_key", "neighbours_within_key", "range_count_within_key",
    "rows_frame_sum", "frame_sum", "delete_by_key", "range_join", "exact_sum",
    "asof_join", "quantiles_by_key", "by_key_size", "hot_keys", "unused_name", "unused_names",
]
