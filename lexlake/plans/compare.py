"""One policy against every regulation (P10), end to end."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from lexlake.functions import rules as R
from lexlake.operators import compliance as P


class Comparison(NamedTuple):
    edges: DataFrame
    summary: DataFrame
    areas: DataFrame
    heatmap: DataFrame
    totals: DataFrame


def compare_all(gold: DataFrame, policy: DataFrame, regulations: DataFrame,
                threshold: float = R.COVERED_AT) -> Comparison:
    """All regulations in one job.  The policy vectors are computed once; call
    ``edges.persist()`` first when several of the results are wanted."""
    edges = P.coverage(P.obligations(gold), policy, threshold)
    summary = P.regulation_summary(edges, regulations)
    return Comparison(
        edges=edges,
        summary=P.regulation_order(summary),
        areas=P.area_coverage(edges),
        heatmap=P.heatmap(edges, regulations),
        totals=P.assessment_totals(summary),
    )
