"""The checks that an engine runs. A check is a function from papers to check results; plug-ins register the same way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Check = Callable[[DataFrame], DataFrame]
CHECKS: dict[str, Check] = {}
EXTRA_WEIGHTS: dict[str, float] = {}


def check(check_id: str, weight: float | None = None) -> Callable[[Check], Check]:
    """Register a check; ``weight`` (0 to 1) is its share in the risk score where the table of weights has none."""

    def register(function: Check) -> Check:
        CHECKS[check_id] = function
        if weight is not None:
            EXTRA_WEIGHTS[check_id] = weight
        return function

    return register
