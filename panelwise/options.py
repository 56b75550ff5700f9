"""Settings of the transforms, as frozen dataclasses that check themselves."""

from __future__ import annotations

from dataclasses import dataclass


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class Thresholds:
    """Cut-offs of the feature and quality rules."""

    sensitized_at: float = 0.35
    poly_count: int = 3
    elevated_total: float = 100.0
    missing_share: float = 0.3
    imbalance_ratio: float = 3.0
    low_income: float = 1.3
    middle_income: float = 3.5
    high_school: int = 3

    def __post_init__(self) -> None:
        _need(self.sensitized_at > 0, "sensitized_at must be positive")
        _need(0 <= self.missing_share <= 1, "missing_share must be between 0 and 1")
        _need(self.imbalance_ratio >= 1, "imbalance_ratio must be at least 1")


@dataclass(frozen=True)
class Training:
    """Split, model and validation settings. ``max_depth`` None is no limit: forests then grow on
    exact split points; with a limit they are MLlib's, on binned ones."""

    test_size: float = 0.2
    seed: int = 42
    folds: int = 5
    trees: int = 100
    max_depth: int | None = None
    min_split: int = 2
    min_leaf: int = 1
    boost_rounds: int = 100
    boost_depth: int = 5
    logistic_iterations: int = 1000
    ridge_alpha: float = 1.0
    hidden: tuple[int, ...] = (256, 128, 64)
    network_iterations: int = 50
    dropout: float = 0.3
    network_rate: float = 0.001
    network_batch: int = 64
    network_patience: int = 5
    scale: bool = True
    polynomial_degree: int = 2
    interactions: bool = True
    neighbors: int = 5
    synthetic_share: float = 0.5

    def __post_init__(self) -> None:
        _need(0 < self.test_size < 1, "test_size must be between 0 and 1")
        _need(self.trees > 0, "trees must be positive")
        _need(self.folds >= 2, "folds must be at least 2")
        _need(self.max_depth is None or self.max_depth > 0, "max_depth must be positive, or None")
        _need(self.min_split >= 2, "min_split must be at least 2")
        _need(0 <= self.dropout < 1, "dropout must be between 0 and 1")


@dataclass(frozen=True)
class Explaining:
    """Sizes of the explanation step."""

    background: int = 100
    rows: int = 500
    top: int = 20
    strong_correlation: float = 0.5
    top_pairs: int = 10

    def __post_init__(self) -> None:
        _need(self.background > 0, "background must be positive")
        _need(self.rows > 0, "rows must be positive")


DEFAULT = Thresholds()
