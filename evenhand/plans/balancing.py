"""Balancing job: deficits, candidate pairs, gate, acceptance, manifest and report."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from evenhand.functions.hashing import SEED
from evenhand.operators import balance
from evenhand.session import reliable_checkpoint


@dataclass(frozen=True)
class BalancedClasses:
    """Result tables of one job; all ratios are rows of the same tables."""

    deficits: DataFrame
    quotas: DataFrame
    gated: DataFrame
    accepted: DataFrame
    manifest: DataFrame
    reasons: DataFrame
    report: DataFrame


def balance_classes(
    items: DataFrame,
    references: DataFrame,
    label: str,
    item: str,
    gate: Callable[[DataFrame], DataFrame],
    ratios: Sequence[float],
    target: int | None = None,
    methods: tuple[str, str] = ("reinhard", "deep_blend"),
    oversample: float = 1.5,
    cycles: int = 4,
    seed: int = SEED,
) -> BalancedClasses:
    """Fill every class up to ``target`` (or the largest class) with synthetic items.

    ``gate`` takes the attempts (target, attempt, cycle, source_id, source_class,
    reference_id), does the expensive per-pair work and adds ``reason``. Its slim
    result is written once to the shared folder, because acceptance reads it
    several times; so neither the pixels nor the pairing are ever redone.
    """
    deficits = reliable_checkpoint(balance.class_deficits(items, label, target), "deficits")
    sources = balance.source_pool(items, label, item, deficits)
    pool = balance.reference_pool(references, items, label, item, deficits)
    attempts = balance.candidate_attempts(sources, pool, deficits, oversample, cycles, seed=seed)
    judged = reliable_checkpoint(gate(attempts), "gated")
    gated = balance.assign_methods(judged, ratios, methods, seed)
    quotas = balance.method_quotas(deficits, ratios, methods)
    accepted = reliable_checkpoint(balance.accept_attempts(gated, quotas), "accepted")
    return BalancedClasses(
        deficits, quotas, gated, accepted,
        balance.lineage_manifest(accepted, ["ratio"]),
        balance.rejection_reasons(gated, accepted, quotas),
        balance.balance_report(accepted, deficits, ratios, methods[0]),
    )
