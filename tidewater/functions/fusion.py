"""Fusion of rule scores with model probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fuse(rule: Column, floor: Column, dangerous: Column, suspicious: Column, hard: Column) -> dict[str, Column]:
    """`ml` and `risk` of a message, in single precision as the scores are; risk is cut to an integer.

    A very likely danger lifts to 90; a likely one blends 40:60 where it exceeds the rules. Without a hard
    threat the risk stays at 60; near the border a likely danger lifts to 70, a likely suspicion to 40.
    """
    real = lambda c: c.cast("float")
    ml = F.least(F.greatest(real(dangerous) * real(F.lit(100)) + real(suspicious) * real(F.lit(50)), real(F.lit(0))), real(F.lit(100)))
    base = real(F.greatest(rule, floor))
    likely = (dangerous >= 0.5) | (suspicious >= 0.7)
    blended = base * F.lit(0.4).cast("float") + ml * F.lit(0.6).cast("float")
    lifted = (
        F.when(dangerous >= 0.9, F.greatest(base, real(F.lit(90)))).when(likely & (ml > base), F.greatest(base, blended)).otherwise(base)
    )
    capped = F.when(~hard & (lifted > 60), real(F.lit(60))).otherwise(lifted)
    bordering = (capped >= 55) & (capped < 70) & ((dangerous >= 0.5) | (ml >= 65))
    raised = F.when(bordering, real(F.lit(70))).otherwise(capped)
    final = F.when((suspicious > 0.5) & ~hard & (raised < 40), real(F.lit(40))).otherwise(raised)
    return {"ml": ml, "risk": F.least(F.greatest(final, real(F.lit(0))), real(F.lit(100))).cast("int")}


def model_label(dangerous: Column, suspicious: Column, safe: Column) -> Column:
    """Label of three probabilities: danger from 0.6 on, else the largest, ties to the graver one."""
    return (
        F.when(dangerous >= 0.6, "DANGEROUS")
        .when((dangerous >= suspicious) & (dangerous >= safe), "DANGEROUS")
        .when(suspicious >= safe, "SUSPICIOUS")
        .otherwise("SAFE")
    )
