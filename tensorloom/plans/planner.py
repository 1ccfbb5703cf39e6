"""Which way to contract: chosen from counts of the tensor, not from its rows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.operators.contract import rank, ttmc
from tensorloom.operators.coo import modes


@dataclass(frozen=True)
class Plan:
    strategy: str
    order: tuple[int, ...]
    why: str


#: Share of the non-zeros in one slice from which its sums are split.
HOT_SLICE = 0.05
#: Non-zeros per fiber from which sums over fibers pay.
LONG_FIBER = 1.2


def plan_ttmc(x: DataFrame, factors: Mapping[int, DataFrame], keep: int) -> Plan:
    """The strategy and mode order of a TTMc.

    Modes are summed away in the order that leaves fewest fibers first. Fibers of hardly more than
    one non-zero make sums between the joins a waste; a slice with much of the tensor is split.
    """
    gone = [m for m in sorted(factors) if m != keep]
    counts = x.agg(F.count(F.lit(1)).alias("n"), *(F.approx_count_distinct(F.struct(*(c for c in modes(x) if c != f"i{m}"))).alias(f"f{m}") for m in gone)).first()
    if not counts["n"]:
        return Plan("aao", tuple(gone), "empty")
    order = tuple(sorted(gone, key=lambda m: (counts[f"f{m}"] * rank(factors[m]), m)))
    largest = x.groupBy(f"i{keep}").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if largest > HOT_SLICE * counts["n"]:
        return Plan("salted", order, f"a slice has {largest} of {counts['n']} non-zeros")
    length = counts["n"] / max(1, counts[f"f{order[0]}"])
    if length < LONG_FIBER:
        return Plan("aao", order, f"{length:.2f} non-zeros per fiber")
    return Plan("fused", order, f"{length:.2f} non-zeros per fiber")


def ttmc_auto(x: DataFrame, factors: Mapping[int, DataFrame], keep: int) -> DataFrame:
    """ttmc() as plan_ttmc() has it."""
    plan = plan_ttmc(x, factors, keep)
    return ttmc(x, factors, keep, plan.strategy, plan.order)
