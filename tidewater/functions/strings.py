"""String columns: keys, file names, links, resource quantities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Content type per allowed upload suffix.
CONTENT_TYPES = {
    ".py": "text/x-python",
    ".jar": "application/octet-stream",
}

# The three link attributes rewritten in proxied HTML, in order.
LINK_ATTRIBUTES = ("href", "src", "action")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def valid_key(c, is_string: bool = True) -> Column:
    """Key is usable: not NULL and (for text keys) not the empty string."""
    k = _col(c)
    if not is_string:
        return k.isNotNull()
    return k.isNotNull() & (k != F.lit(""))


def derive_key(selector, name, marker: str = "-driver") -> Column:
    """``selector`` when non-empty, else ``name`` cut before the LAST
    ``marker`` (``a-driver-driver`` -> ``a-driver``; no marker -> name)."""
    import re
    cut = F.regexp_replace(_col(name), "(?s)^(.*)" + re.escape(marker) + ".*$", "$1")
    return F.coalesce(F.nullif(_col(selector), F.lit("")), cut)


def file_extension(name) -> Column:
    """Lower-cased extension of the last path part, with the dot, like
    ``os.path.splitext``: leading dots of a name do not start an extension."""
    base = F.element_at(F.split(_col(name), "/"), -1)
    return F.lower(F.regexp_extract(base, r"^\.*[^.].*?(\.[^.]*)$", 1))


def content_type_for(ext) -> Column:
    """Content type for an allowed suffix, NULL for others."""
    m = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])
    return F.try_element_at(m, _col(ext))


def rewrite_links(html, prefix: str, content_type=None) -> Column:
    """Prefix root-relative links (``href="/``, ``src="/``, ``action="/``) with
    ``prefix``; only when ``content_type`` mentions text/html (if given). A
    NULL content type counts as text/html."""
    out = _col(html)
    for attr in LINK_ATTRIBUTES:
        out = F.replace(out, F.lit(f'{attr}="/'), F.lit(f'{attr}="{prefix}'))
    if content_type is None:
        return out
    kind = F.coalesce(_col(content_type), F.lit("text/html"))
    return F.when(F.contains(kind, F.lit("text/html")), out).otherwise(_col(html))


_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _number_and_factor(c, factors: dict) -> Column:
    """number * factor[unit] for a quantity text; NULL for unknown units or
    malformed text. The unit is the run of trailing letters, the number is
    the rest (no regex: trim and slice only); the unit lookup is a literal
    map."""
    text = F.trim(_col(c))
    number_text = F.rtrim(text, F.lit(_LETTERS))
    unit = F.substring(text, F.length(number_text) + 1, 1 << 20)
    num = F.trim(number_text).try_cast("double")
    table = F.create_map(*[F.lit(x) for kv in factors.items() for x in kv])
    return num * F.try_element_at(table, unit)


# CPU unit -> millicores per unit.
CPU_FACTORS = {"n": 1e-6, "u": 1e-3, "m": 1.0, "": 1000.0}

# Memory unit -> MiB per unit (binary Ki to Ei, decimal k to E, bytes).
MEM_FACTORS = {
    "Ki": 1.0 / 1024, "Mi": 1.0, "Gi": 1024.0, "Ti": 1024.0 * 1024.0,
    "Pi": 1024.0 ** 3, "Ei": 1024.0 ** 4,
    "k": 1e3 / (1024.0 * 1024.0), "M": 1e6 / (1024.0 * 1024.0), "G": 1e9 / (1024.0 * 1024.0),
    "T": 1e12 / (1024.0 * 1024.0), "P": 1e15 / (1024.0 * 1024.0), "E": 1e18 / (1024.0 * 1024.0),
    "": 1.0 / (1024.0 * 1024.0),
}


def parse_cpu_millis(c) -> Column:
    """Kubernetes CPU quantity -> millicores: ``250m`` -> 250, ``2`` -> 2000."""
    return _number_and_factor(c, CPU_FACTORS)


def parse_mem_mib(c) -> Column:
    """Kubernetes memory quantity -> MiB: ``512Mi`` -> 512, ``1Gi`` -> 1024,
    decimal ``M``/``G`` in bytes of 10^6/10^9."""
    return _number_and_factor(c, MEM_FACTORS)
