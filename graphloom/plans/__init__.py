"""Planning: which vertices go where."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class DiffusiveInput:
    """[X1] Parameters of diffusive balancing.  ``priorities``: (dimension, tolerance), first
    one first; dimension -1 are vertices.  A tolerance of None is 1.1."""

    priorities: tuple[tuple[int, float | None], ...] = ((-1, None),)
    max_iterations: int = 1000
    max_iterations_per_type: int = 100
    step_factor: float = 0.1
    sides_type: int = 0
    selection_type: int = 0
    distance_queue: bool | None = None  # None: for hypergraphs
    min_connectivity: int = 1
    connectivity_type: int = 0
    count_ghosts: bool = False
    part_weight_balancer: bool = False
    limit_cut_growth: float = 0.0


@dataclass(frozen=True)
class WeightInput:
    """[X1] Parameters of weight diffusion."""

    tolerance: float = 1.1
    max_iterations: int = 100
    step_factor: float = 0.1
    sides_type: int = 0
    integral: bool = True


@dataclass(frozen=True)
class SplitInput:
    """[X1] Parameters of splitting."""

    tolerance: float = 1.05
    edge_type: int = 0


@dataclass
class Stagnation:
    """[X2] The last three values of a measure; it stagnates once a stencil over them is above 0.

    The stencil weighs them oldest, newest, middle, as the method has it (quirk Q9)."""

    values: list[float] = field(default_factory=list)

    def push(self, value: float) -> None:
        self.values = [*self.values, value][-3:]

    def slope(self) -> float:
        if len(self.values) < 3:
            return 0.0
        oldest, middle, newest = self.values
        return -1.5 * oldest + 2 * newest - 0.5 * middle

    def stagnated(self) -> bool:
        return len(self.values) == 3 and self.slope() > 0
