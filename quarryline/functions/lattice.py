"""The three-value classification lattice: exact, candidate_set, unresolved."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rank of each class; a larger rank is stronger.
RANKS = {"exact": 2, "candidate_set": 1, "unresolved": 0}
#: Confidence that goes with a class.
CONFIDENCE = {"exact": "high", "candidate_set": "medium", "unresolved": "low"}


def rank(label: Column) -> Column:
    """2, 1 or 0; NULL for anything that is not a class."""
    return F.when(label == "exact", 2).when(label == "candidate_set", 1).when(label == "unresolved", 0)


def label(ranks: Column) -> Column:
    return F.when(ranks == 2, "exact").when(ranks == 1, "candidate_set").when(ranks == 0, "unresolved")


def meet_lenient(labels: Column) -> Column:
    """K1, an aggregate: the weakest valid class; invalid values do not count, none at all is exact."""
    return label(F.coalesce(F.min(rank(labels)), F.lit(2)))


def meet_strict(labels: Column) -> Column:
    """K2, an aggregate: the weakest class; an invalid value or no value at all is unresolved."""
    return label(F.coalesce(F.min(F.coalesce(rank(labels), F.lit(0))), F.lit(0)))


def demote(labels: Column) -> Column:
    """K3: exact becomes candidate_set."""
    return F.when(labels == "exact", "candidate_set").otherwise(labels)


def confidence(labels: Column) -> Column:
    """K4."""
    return F.when(labels == "exact", "high").when(labels == "candidate_set", "medium").otherwise("low")


def by_cardinality(n: Column) -> Column:
    """K5: none, one or several candidates."""
    return F.when(n == 0, "unresolved").when(n == 1, "exact").otherwise("candidate_set")
