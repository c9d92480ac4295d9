"""Label maps and status words."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label keys that mark a record as one of the engine's own.
SPARK_KEYS = ("spark-role", "spark-app-name")

# Raw status (lower-cased) -> display class, as the job dashboard
# shows them. Anything else is "unknown".
STATUS_CLASSES = {
    "running": "running",
    "completed": "completed",
    "succeeded": "completed",
    "pending": "pending",
    "containercreating": "pending",
    "failed": "failed",
    "error": "failed",
}

# Application type -> display class. Anything else is "unknown".
TYPE_CLASSES = {
    "Scala": "scala",
    "Python": "python",
    "Java": "java",
}

DASH = "—"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _literal_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def lookup_default(c, mapping: Mapping[str, str], default: str = "unknown") -> Column:
    """``mapping[c]`` or ``default`` (also for NULL). A literal map: no join."""
    return F.coalesce(F.try_element_at(_literal_map(mapping), _col(c)), F.lit(default))


def display_or_dash(c) -> Column:
    """The value as shown, a dash when NULL or empty."""
    return F.coalesce(F.nullif(_col(c), F.lit("")), F.lit(DASH))


def status_text(c) -> Column:
    """The status as shown: lower-cased, ``unknown`` when NULL or empty."""
    return F.coalesce(F.nullif(F.lower(_col(c)), F.lit("")), F.lit("unknown"))


def status_class(c) -> Column:
    """Lower-case the raw status and map it to one of four classes."""
    lowered = F.lower(F.coalesce(_col(c), F.lit("")))
    return lookup_default(lowered, STATUS_CLASSES, "unknown")


def has_any_key(labels, keys: Sequence[str]) -> Column:
    """True when the map has any of ``keys`` (value may be empty). NULL map
    counts as an empty map."""
    m = F.coalesce(_col(labels), F.create_map().cast("map<string,string>"))
    test = F.lit(False)
    for k in keys:
        test = test | F.map_contains_key(m, F.lit(k))
    return test


def classify_by_keys(labels, keys: Sequence[str], yes: str = "spark",
                     no: str = "infra") -> Column:
    return F.when(has_any_key(labels, keys), F.lit(yes)).otherwise(F.lit(no))


def first_label(labels, keys: Sequence[str], default: str = DASH) -> Column:
    """First non-empty value among ``keys``, else the first value of the map,
    else ``default``."""
    m = _col(labels)
    picks = [F.nullif(F.try_element_at(m, F.lit(k)), F.lit("")) for k in keys]
    first_value = F.nullif(F.try_element_at(F.map_values(m), F.lit(1)), F.lit(""))
    return F.coalesce(*picks, first_value, F.lit(default))
