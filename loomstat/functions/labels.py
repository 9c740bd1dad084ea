"""Label expressions. A label list may be NULL or empty (benign) and hold NULLs (passed over)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstat.functions.fixed import BENIGN, LABEL_GROUPS, MONITORED


def label_list(labels: Column) -> Column:
    """The list without NULLs; NULL gives an empty list."""
    return F.coalesce(F.array_compact(labels), F.array().cast("array<string>"))


def split_labels(joined: Column) -> Column:
    """The list of a ``;``-joined string."""
    return F.filter(F.split(F.coalesce(joined, F.lit("")), ";"), lambda x: x != "")


def label_group(label: Column) -> Column:
    """The group of a label: ``benign`` for the benign one, ``unknown`` for one that isn't listed."""
    out = F.when(label == BENIGN, "benign")
    for group, members in LABEL_GROUPS.items():
        out = out.when(label.isin(*members), group)
    return out.otherwise("unknown")


def is_positive(labels: Column) -> Column:
    return F.exists(label_list(labels), lambda x: x != BENIGN)


def all_benign(labels: Column) -> Column:
    return F.forall(label_list(labels), lambda x: x == BENIGN)


def in_scope(labels: Column, group: str = MONITORED) -> Column:
    """The labels that count for a monitor of ``group``; '' takes every label but the benign one."""
    scoped = lambda x: (x != BENIGN) & (F.lit(True) if not group else label_group(x) == group)
    return F.filter(label_list(labels), scoped)


def scope_or_benign(labels: Column, name: str = "benign", group: str = MONITORED) -> Column:
    """``in_scope``, or one bucket ``name`` where it is empty: also for a positive out of scope."""
    scoped = in_scope(labels, group)
    return F.when(F.size(scoped) > 0, scoped).otherwise(F.array(F.lit(name)))


def groups(labels: Column) -> Column:
    """The sorted distinct groups of the labels that aren't benign."""
    named = F.transform(in_scope(labels, ""), label_group)
    return F.array_sort(F.array_distinct(named))


def primary_label(labels: Column, name: str = "benign") -> Column:
    """The first label in scope by name, else ``name``."""
    return F.coalesce(F.array_min(in_scope(labels)), F.lit(name))
