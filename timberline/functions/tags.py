"""Tag arrays: add, remove, membership, failure marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions.extract import FAILURE_TAG

# Source type -> tags.  ``syslog`` is added next to the
# operating-system tag because the shipped dashboard filters on it.
TYPE_TAGS = {
    "syslog": ["redhat", "syslog"],
    "firewall": ["cisco-asa"],
    "VMware": ["VMware"],
    "vCenter": ["vCenter"],
    "eventlog": ["WindowsEventLog"],
    "apache": ["apache"],
    "iis": ["IIS"],
}


def no_tags() -> Column:
    return F.array().cast("array<string>")


def add_tags(tags: Column, *names: str, when: Column | None = None) -> Column:
    extra = F.array(*[F.lit(n) for n in names])
    base = F.coalesce(tags, no_tags())
    if when is None:
        return F.array_union(base, extra)
    return F.when(when, F.array_union(base, extra)).otherwise(base)


def remove_tag(tags: Column, name: str, when: Column | None = None) -> Column:
    out = F.array_remove(tags, name)
    return out if when is None else F.when(when, out).otherwise(tags)


def has_tag(tags: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(tags, name), F.lit(False))


def failed(tags: Column, ok: Column) -> Column:
    return add_tags(tags, FAILURE_TAG, when=~ok)


def tags_by_type(source_type: Column, tags: Column) -> Column:
    """The type's tags added, and ``Ready`` removed from syslog events."""
    extra = F.lit(None).cast("array<string>")
    for name, values in TYPE_TAGS.items():
        extra = F.when(source_type == name, F.array(*[F.lit(v) for v in values])).otherwise(extra)
    tags = remove_tag(F.coalesce(tags, no_tags()), "Ready", when=source_type == "syslog")
    return F.array_union(tags, F.coalesce(extra, no_tags()))
