"""The metrics by name: what each is measured on and whether it can be computed from situations.

Names, grains and what is computable are fixed; a metric that is not computable
is named so that nobody takes its absence for a zero.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

_COMPUTED = {
    "observation": "information_volume information_visibility hidden_information self_knowledge_asymmetry",
    "state": "information_asymmetry information_ownership decision_branching_factor",
    "trajectory": "information_gain information_loss",
    "game": "legal_action_type_count structural_interaction",
    "player": "available_decision_count decision_constraint",
}
_NAMED_ONLY = {
    "observation": "information_uncertainty",
    "state": "legal_decision_count reversibility consequence",
    "trajectory": "information_flow state_complexity_trajectory decision_space_trajectory information_trajectory information_convergence tension_trajectory behavioral_interaction",
    "game": "randomness outcome_rating outcome_rating_count outcome_playtest_rating",
    "player": "decision_diversity agency strategic_dominance meaningful_action_count",
}


@dataclass(frozen=True)
class MetricSpec:
    name: str
    grain: str
    computable: bool


CATALOG: dict[str, MetricSpec] = {n: MetricSpec(n, grain, computable) for table, computable in ((_COMPUTED, True), (_NAMED_ONLY, False)) for grain, names in table.items() for n in names.split()}


class Registry:
    """Functions by name, for metrics and encoders that callers add; a name stands for one function."""

    def __init__(self, what: str) -> None:
        self.what, self._known = what, {}

    def register(self, name: str, function: Callable) -> None:
        if name in self._known:
            raise ValueError(f"{self.what} {name!r} is there already")
        self._known[name] = function

    def __getitem__(self, name: str) -> Callable:
        if name not in self._known:
            raise ValueError(f"no {self.what} {name!r}; there are: {', '.join(sorted(self._known)) or 'none'}")
        return self._known[name]

    def names(self) -> list[str]:
        return sorted(self._known)


def require_known(names: list[str]) -> None:
    """Raise for names that are no metric, and for metrics that cannot be computed."""
    unknown = [n for n in names if n not in CATALOG]
    if unknown:
        raise ValueError(f"no metric {', '.join(unknown)}")
    unable = [n for n in names if not CATALOG[n].computable]
    if unable:
        raise ValueError(f"not computable: {', '.join(unable)}")
