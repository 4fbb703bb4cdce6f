"""Parameters of the operators, as plain frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field


# fixed values: how much more or less a contest counts, by event level and by the least margin in sets
LEVEL_WEIGHTS = {"G": 1.25, "M": 1.10, "A": 1.00, "B": 0.90, "D": 0.85, "F": 0.85}
MARGIN_WEIGHTS = {2: 1.20, 3: 1.30}


@dataclass(frozen=True)
class StepRule:
    """How far one contest may move a rating; an empty table weighs all alike."""

    base: float = 24.0
    by_margin: dict[int, float] = field(default_factory=MARGIN_WEIGHTS.copy)
    by_level: dict[str, float] = field(default_factory=LEVEL_WEIGHTS.copy)


@dataclass(frozen=True)
class RatingConfig:
    """Where ratings start, how they move, and on which surfaces they are kept apart.

    A rating on a surface starts ``surface_share`` of the way from ``start`` to
    the overall one. Other surfaces count as the first. A task rates at most
    ``turn_rows`` contests of a pool.
    """

    step: StepRule = field(default_factory=StepRule)
    surfaces: tuple[str, ...] = ("Hard", "Clay", "Grass")
    surface_share: float = 0.70
    start: float = 1500.0
    turn_rows: int = 1_000_000

    def surface_start(self, overall):
        """Start on a surface of a player rated ``overall``, a number or a column."""
        return self.surface_share * overall + (1.0 - self.surface_share) * self.start


@dataclass(frozen=True)
class SplitConfig:
    """Names of the splits in order of time, each with its last day; what is later belongs to ``rest``."""

    bounds: tuple[tuple[str, str], ...] = (("train", "2022-12-31"), ("validation", "2023-12-31"))
    rest: str = "test"
    date: str = "tourney_date"

    @classmethod
    def until(cls, train: str, validation: str, date: str = "tourney_date") -> SplitConfig:
        return cls((("train", train), ("validation", validation)), date=date)

    @property
    def names(self) -> list[str]:
        return [*(name for name, _ in self.bounds), self.rest]


@dataclass(frozen=True)
class LogisticConfig:
    """Strength of the data against the penalty, and whether classes weigh the same."""

    C: float = 1.0
    balanced: bool = False


@dataclass(frozen=True)
class TreeConfig:
    """A histogram learner: its bins, the shape of its trees, the penalties on leaves, what each tree sees, and when it stops."""

    bins: int = 256
    depth: int = 4
    leaf_hessian: float = 5.0
    ridge: float = 1.0
    lasso: float = 0.0
    least_gain: float = 0.0
    row_share: float = 0.8
    input_share: float = 0.8
    seed: int = 42
    rate: float = 0.03
    rounds: int = 1000
    patience: int | None = 50
