"""Frozen settings with the checks applied on construction."""

from __future__ import annotations

from dataclasses import dataclass, field

VARIANTS = ("dt", "knn", "rf", "svm", "mlp", "gbt")
EVALUATOR_MODELS = ("classifier", "svm", "mlp")
EVALUATORS = ("ice", "cce", "approx_cce", "approx_tce", "none")


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class ChunkConfig:
    """Bounds and pace of the adaptive chunk size."""

    init_size: int = 10
    min_size: int = 1
    max_size: int = 1000
    ema_decay: float = 0.9
    cooldown: int = 0
    step: int = 5
    shrink_above: float = 0.2
    grow_below: float = 0.05

    def __post_init__(self) -> None:
        for name in ("init_size", "min_size", "max_size", "cooldown", "step"):
            _check(getattr(self, name) >= 0, f"{name} must not be negative")
        _check(0.0 <= self.ema_decay <= 1.0, "ema_decay must lie in [0, 1]")
        _check(self.min_size >= 1, "min_size must be at least 1")
        _check(self.max_size >= self.min_size, "max_size must not be below min_size")
        _check(self.min_size <= self.init_size <= self.max_size, "init_size must lie within the bounds")


@dataclass(frozen=True)
class SignificanceConfig:
    """Limits of the adaptive significance level."""

    window: int = 100
    min_alpha: float = 0.05
    max_alpha: float = 0.3
    step: float = 0.02
    increase_above: float = 0.3
    decrease_below: float = 0.05

    def __post_init__(self) -> None:
        _check(self.window > 0, "window must be positive")
        _check(0.0 < self.min_alpha <= self.max_alpha < 1.0, "alphas must satisfy 0 < min <= max < 1")
        _check(self.step > 0, "step must be positive")


@dataclass(frozen=True)
class ConformalConfig:
    """How an evaluator is calibrated."""

    evaluator: str = "ice"
    folds: int = 10
    significance: float = 0.05
    calibration_split: float = 0.2
    rule: str = "score_quantile"
    mode: str = "first"
    rate: float = 0.0

    def __post_init__(self) -> None:
        _check(self.evaluator in EVALUATORS, f"unknown evaluator type: {self.evaluator}")
        _check(self.folds >= 2, "folds must be >= 2")
        _check(0.0 < self.significance < 1.0, "significance must lie in (0, 1)")
        _check(0.0 < self.calibration_split < 1.0, "calibration_split must lie in (0, 1)")
        _check(self.rule in ("score_quantile", "epsilon"), f"unknown rule: {self.rule}")
        _check(self.mode in ("first", "any", "rate"), f"unknown mode: {self.mode}")


@dataclass(frozen=True)
class DriftConfig:
    """Settings of a drift replay or a live drift stream.

    The evaluator is calibrated with a model like the classifier, or with one of its own:
    a linear SVM or a net of three hidden layers. ``evaluator_params`` go to that model.
    """

    variant: str = "rf"
    task: str = "binary"
    conformal: ConformalConfig = field(default_factory=ConformalConfig)
    significance: SignificanceConfig | None = None
    threshold: float = 0.5
    chunk_size: int = 1000
    max_rows: int = 10000
    use_pca: bool = False
    scope: str = "model"
    adaptive_chunks: ChunkConfig | None = None
    evaluator_model: str = "classifier"
    evaluator_params: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        _check(self.variant in VARIANTS, f"unknown model variant: {self.variant}")
        _check(self.task in ("binary", "multi"), f"unknown task: {self.task}")
        _check(0.0 <= self.threshold <= 1.0, "threshold must lie in [0, 1]")
        _check(self.chunk_size > 0, "chunk_size must be positive")
        _check(self.max_rows > 0, "max_rows must be positive")
        _check(self.evaluator_model in EVALUATOR_MODELS, f"unknown evaluator model: {self.evaluator_model}")
        _check(self.evaluator_model != "classifier" or not self.evaluator_params, "evaluator_params need an evaluator model of its own")
        _check(self.scope in ("model", "evaluator_only"), f"unknown retrain scope: {self.scope}")
        # The level is adapted from the first row of each chunk, so only that row can be tested at it.
        _check(self.significance is None or self.conformal.mode == "first", "an adaptive significance needs the mode first")
