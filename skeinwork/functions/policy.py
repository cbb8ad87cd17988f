"""Availability policy: enum defaults and the delivery decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ORIGINS = ("iranian", "foreign", "unknown")
POLICIES = ("global", "iran_only", "blocked_copyright", "unknown")


def one_of(value: Column, allowed: tuple[str, ...], default: str = "unknown") -> Column:
    """The value in lower case if it is allowed, else ``default``."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(*allowed), v).otherwise(F.lit(default))


def availability(origin: Column, policy: Column, foreign_default: str = "iran_only") -> Column:
    """The stated policy, or the default of the origin."""
    o, p = one_of(origin, ORIGINS), one_of(policy, POLICIES)
    return F.when(p != "unknown", p).when(o == "foreign", foreign_default).when(o == "iranian", "global").otherwise("unknown")


def delivery(policy: Column, region: Column, enforced: bool = True) -> tuple[Column, Column]:
    """(allowed, reason); the first rule that holds decides."""
    reason = (
        F.when(policy == "blocked_copyright", "copyright")
        .when(F.lit(not enforced), "enforcement_disabled")
        .when(policy != "iran_only", "not_region_restricted")
        .when(F.upper(region) == "IR", "iran_verified")
        .otherwise("iran_only")
    )
    return ~reason.isin("copyright", "iran_only"), reason
