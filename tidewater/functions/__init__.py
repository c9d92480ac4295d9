"""Column builders: pure expressions, evaluated inside whole-stage codegen."""

from tidewater.functions.labels import (STATUS_CLASSES, TYPE_CLASSES, classify_by_keys,
                                        display_or_dash,
                                        first_label, has_any_key, lookup_default,
                                        status_class, status_text)
from tidewater.functions.strings import (content_type_for, derive_key, file_extension,
                                         parse_cpu_millis, parse_mem_mib, rewrite_links,
                                         valid_key)
from tidewater.functions.times import display_ts, iso_ts
from tidewater.functions.records import APP_RECORD_SCHEMA, flatten_app_record

__all__ = [
    "STATUS_CLASSES", "TYPE_CLASSES", "classify_by_keys", "display_or_dash", "first_label", "has_any_key",
    "lookup_default", "status_class", "status_text", "content_type_for", "derive_key",
    "file_extension", "parse_cpu_millis", "parse_mem_mib", "rewrite_links", "valid_key",
    "display_ts", "iso_ts", "APP_RECORD_SCHEMA", "flatten_app_record",
]
