"""Detectors: one module per finding type, listed in a registry.

A detector names the tables it reads and maps ``(tables, thresholds)`` to findings.
To add one, write a module with ``NAME``, ``INPUTS`` and ``detect`` and register it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from fleet_audit import fixed_values
from fleet_audit.operators.detectors import (
    bad_broadcast,
    exploding_join,
    ineffective_dynamic_filter,
    missing_stats,
    no_partition_pruning,
    not_the_querys_fault,
    skew,
    small_files,
    spilling,
)
from fleet_audit.operators.references import REFERENCES
from fleet_audit.operators.thresholds import Thresholds


@dataclass(frozen=True)
class Detector:
    name: str
    inputs: tuple[str, ...]
    detect: Callable[[Mapping[str, DataFrame], DataFrame | Thresholds], DataFrame]
    #: Reference tables of which a missing row is judged as well.
    absent_counts: tuple[str, ...] = ()

    @property
    def references(self) -> tuple[str, ...]:
        """Inputs that describe tables and not queries."""
        return tuple(i for i in self.inputs if i in REFERENCES)


def registry() -> dict[str, Detector]:
    modules = (
        no_partition_pruning,
        exploding_join,
        bad_broadcast,
        missing_stats,
        skew,
        small_files,
        spilling,
        not_the_querys_fault,
        ineffective_dynamic_filter,
    )
    found = {m.NAME: Detector(m.NAME, m.INPUTS, m.detect, getattr(m, "ABSENT_COUNTS", ())) for m in modules}
    return {name: found[name] for name in fixed_values.DETECTORS}
