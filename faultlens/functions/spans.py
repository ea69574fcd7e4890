"""Span field extraction (X2-X8) on the nested span schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag keys that carry the pod / node name of a span's process.
POD_TAG_KEYS = ("name", "podName")
NODE_TAG_KEYS = ("node_name", "nodeName")
STATUS_CODE_KEY = "status.code"
STATUS_MESSAGE_KEY = "status.message"
OK_STATUS_CODE = "0"
MISSING = "N/A"
# Service renamed in the status report.
SERVICE_RENAMES = {"redis": "redis-cart"}


def _first_tag(tags: Column, keys) -> Column:
    hit = F.filter(tags, lambda t: t["key"].isin(*keys))
    return F.get(hit, 0)["value"]


def pod_of(process: Column) -> Column:
    """First process tag keyed ``name`` or ``podName``."""
    return _first_tag(process["tags"], POD_TAG_KEYS)


def service_of(process: Column) -> Column:
    """X3"""
    return process["serviceName"]


def node_of(process: Column) -> Column:
    """First process tag keyed ``node_name`` or ``nodeName``."""
    return _first_tag(process["tags"], NODE_TAG_KEYS)


def parent_span_id(references: Column) -> Column:
    """The parent only when there is exactly one reference."""
    return F.when(F.size(references) == 1, F.get(references, 0)["spanID"])


def last_tag_value(tags: Column, key: str) -> Column:
    """Value of the last tag with exactly this key (duplicate key -> last wins)."""
    return F.get(F.reverse(F.filter(tags, lambda t: t["key"] == key)), 0)["value"]


def has_tag(tags: Column, key: str) -> Column:
    return F.exists(tags, lambda t: t["key"] == key)


def has_status_tag(tags: Column) -> Column:
    """any tag whose key mentions ``status`` (any case)."""
    return F.coalesce(F.exists(tags, lambda t: F.lower(t["key"]).contains("status")), F.lit(False))


def na(c: Column) -> Column:
    """Null -> ``N/A``."""
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def renamed_service(c: Column) -> Column:
    """Service renames used in the status report."""
    out = c
    for a, b in SERVICE_RENAMES.items():
        out = F.when(c == a, F.lit(b)).otherwise(out)
    return out


def edge_name(parent_pod: Column, child_pod: Column, node: Column, op: Column) -> Column:
    """Display form of the edge key (the engine keys on the 4 columns)."""
    return F.concat_ws("_", na(parent_pod), na(child_pod), na(node), na(op))
