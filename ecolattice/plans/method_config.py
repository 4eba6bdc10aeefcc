"""How impact categories, normalizations and weightings belong together."""

from __future__ import annotations

from collections.abc import Sequence

from pydantic import BaseModel, model_validator

from ..errors import InconsistentLCIA
from ..schema import label

Label = str | tuple[str, ...]


class MethodConfig(BaseModel):
    """Impact categories; normalizations {name: [categories]}; weightings {name: [normalizations or categories]}.

    Names are strings or tuples of strings, and unique over all three kinds.
    With normalizations every category needs one; with weightings every
    category, or every normalization, needs one, and the two are not mixed.
    """

    impact_categories: Sequence[Label]
    normalizations: dict[Label, list[Label]] | None = None
    weightings: dict[Label, list[Label]] | None = None

    @model_validator(mode="after")
    def _consistent(self):
        categories = set(self.impact_categories)
        norms = self.normalizations or {}
        weights = self.weightings or {}
        targets = {x for many in norms.values() for x in many}
        if targets - categories:
            raise ValueError(f"normalizations of unknown impact categories: {targets - categories}")
        if categories & set(norms):
            raise ValueError(f"normalizations named like impact categories: {categories & set(norms)}")
        if norms and categories - targets:
            raise InconsistentLCIA(f"impact categories without normalization: {categories - targets}")
        goals = {x for many in weights.values() for x in many}
        if goals - categories - set(norms):
            raise ValueError(f"weightings of unknown names: {goals - categories - set(norms)}")
        if categories & set(weights):
            raise ValueError(f"weightings named like impact categories: {categories & set(weights)}")
        if set(norms) & set(weights):
            raise ValueError(f"weightings named like normalizations: {set(norms) & set(weights)}")
        if goals & categories and goals & set(norms):
            raise InconsistentLCIA("weightings refer to both impact categories and normalizations")
        if goals & categories and categories - goals:
            raise InconsistentLCIA(f"impact categories without weighting: {categories - goals}")
        if goals & set(norms) and set(norms) - goals:
            raise InconsistentLCIA(f"normalizations without weighting: {set(norms) - goals}")
        return self

    def texts(self, kind: str) -> dict[str, list[str]] | None:
        """{outer: [inner]} of normalizations or weightings as label texts."""
        found = getattr(self, kind)
        return None if found is None else {label(k): [label(x) for x in v] for k, v in found.items()}

    @property
    def weights_norms(self) -> bool:
        """Whether weightings refer to normalizations."""
        return bool(self.weightings) and bool(self.normalizations) and any(x in self.normalizations for v in self.weightings.values() for x in v)
