"""Named scalar predicates and transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two definitions of a coding consequence.
CODING_PATTERN = "missense|synonymous|stop|frameshift|splice|inframe|start_lost"
CODING_TERMS = ("missense_variant", "synonymous_variant", "stop_gained", "stop_lost", "start_lost", "frameshift_variant", "inframe_insertion", "inframe_deletion", "splice_acceptor_variant", "splice_donor_variant")


def matches_any(text: Column, pattern: str) -> Column:
    """Whether any alternative occurs, whatever the case; null text does not match."""
    return F.coalesce(text, F.lit("")).rlike(f"(?i){pattern}")


def is_snv(ref: Column, alt: Column) -> Column:
    return (F.length(ref) == 1) & (F.length(alt) == 1)


def is_common(af: Column, least: float) -> Column:
    return F.coalesce(af, F.lit(0.0)) >= least


def covers(lo, hi, start, end) -> Column:
    """Whether the window [lo, hi] holds the whole of [start, end]."""
    return (F.lit(lo) <= F.lit(start)) & (F.lit(hi) >= F.lit(end))


def log_distance(d: Column, floor_at_one: bool = False) -> Column:
    return F.log10(F.greatest(d, F.lit(1))) if floor_at_one else F.log10(d + 1)


def extreme(percentile: Column, above: float = 95.0) -> Column:
    return percentile > above
