"""Masking of secrets by the name of their key and by the shape of their value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of key names whose values are masked whole, counters that only look like them, and value shapes.
SENSITIVE_KEYS = "(?i)token|key|secret|password|passwd|authorization|cookie|credential"
COUNTERS = ("context_tokens_loaded", "result_tokens")
MASK = "***"
VALUE_SHAPES = (
    r"\bsk-[A-Za-z0-9_\-]{8,}",
    r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{16,}",
    r"\bgithub_pat_[A-Za-z0-9_]{20,}",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bxox[baprs]-[A-Za-z0-9\-]{10,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"(?i)\bbearer\s+[A-Za-z0-9._\-]{8,}",
)
#: A long run of base64 signs counts as a secret only with capitals, small letters and digits or signs; digests do not.
_RUN = "[A-Za-z0-9+/]"
LONG_CODE = rf"(?<!{_RUN})(?={_RUN}*[A-Z])(?={_RUN}*[a-z])(?={_RUN}*[0-9+/=]){_RUN}{{40,}}={{0,2}}"


def is_sensitive(key: Column) -> Column:
    return key.rlike(SENSITIVE_KEYS) & ~key.isin(*COUNTERS)


def masked_values(text: Column) -> Column:
    for shape in (*VALUE_SHAPES, LONG_CODE):
        text = F.regexp_replace(text, shape, MASK)
    return text


def _masked(key: Column, value: Column, by_key: bool) -> Column:
    return F.when(F.lit(by_key) & is_sensitive(key), MASK).otherwise(masked_values(value))


def masked_fields(fields: Column, by_key: bool = True) -> Column:
    """A map with the values of sensitive keys masked whole and secrets in other values masked by shape; value shapes are
    masked even where key names are not looked at."""
    return F.transform_values(fields, lambda k, v: _masked(k, v, by_key))


def touched_keys(fields: Column) -> Column:
    """The keys whose values :func:`masked_fields` changes, sorted."""
    changed = F.filter(F.map_entries(fields), lambda e: ~_masked(e["key"], e["value"], True).eqNullSafe(e["value"]))
    return F.array_sort(F.transform(changed, lambda e: e["key"]))
