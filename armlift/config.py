"""Column roles and analysis options."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

METRIC_TYPES = ("auto", "continuous", "binary", "count", "heavy_tail")


def parse_covariates(raw: Any) -> tuple[str, ...]:
    """Comma-separated text or a sequence of names, without repeats."""
    if raw is None:
        return ()
    names = raw.split(",") if isinstance(raw, str) else raw
    if not isinstance(names, Sequence):
        return ()
    return tuple(dict.fromkeys(str(n).strip() for n in names if str(n).strip()))


@dataclass(frozen=True)
class Roles:
    """Which columns play which part, and the two arm labels."""

    group: str
    effect_value: str
    treatment: Any = None
    control: Any = None
    post_effect: str | None = None
    pre_effect: str | None = None
    segment: str | None = None
    customer_id: str | None = None
    duration: str | None = None
    covariates: tuple[str, ...] = ()

    @property
    def outcome(self) -> str:
        return self.post_effect or self.effect_value

    @classmethod
    def from_mapping(cls, mapping: Mapping[str, Any], treatment: Any = None, control: Any = None) -> "Roles":
        for key in ("group", "effect_value"):
            if not mapping.get(key):
                raise ValueError(f"Column mapping for '{key}' not set")
        names = ("group", "effect_value", "post_effect", "pre_effect", "segment", "customer_id", "duration")
        return cls(
            **{n: mapping[n] for n in names if mapping.get(n)},
            covariates=parse_covariates(mapping.get("covariates")),
            treatment=treatment,
            control=control,
        )

    def with_labels(self, treatment: Any, control: Any) -> "Roles":
        return replace(self, treatment=treatment, control=control)

    def check(self, df: DataFrame) -> "Roles":
        if self.treatment is None or self.control is None:
            raise ValueError("Treatment/control labels not set")
        needed = [self.group, self.outcome, self.segment, self.customer_id]
        missing = [c for c in needed if c and c not in df.columns]
        if missing:
            raise ValueError(f"Columns not found: {', '.join(missing)}")
        return self

    def usable_pre(self, df: DataFrame) -> str | None:
        return self.pre_effect if self.pre_effect in df.columns else None


def resolve_covariates(df: DataFrame, roles: Roles) -> tuple[str, ...]:
    """Numeric covariates that exist, plus the pre-period column; schema only."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    wanted = dict.fromkeys(roles.covariates)
    if roles.usable_pre(df):
        wanted.setdefault(roles.pre_effect)
    excluded = {roles.group, roles.outcome, roles.segment}
    return tuple(c for c in wanted if c in numeric and c not in excluded)


# Accepted spellings of the two sequential option names.
LOOK_KEYS = ("look_index", "current_look", "interim_look")
MAX_LOOK_KEYS = ("max_looks", "total_looks", "planned_looks")
FUTILITY_INFORMATION = 0.75
FUTILITY_P = 0.5


@dataclass(frozen=True)
class Sequential:
    """Group-sequential settings; disabled unless asked for."""

    enabled: bool = False
    look_index: int = 1
    max_looks: int = 1
    method: str = "obrien_fleming"
    futility_information: float = FUTILITY_INFORMATION
    futility_p: float = FUTILITY_P

    @classmethod
    def resolve(cls, raw: Any) -> "Sequential":
        if isinstance(raw, cls):
            return raw
        if raw is True:
            raw = {}
        elif not isinstance(raw, Mapping) or not raw.get("enabled", True):
            return cls()

        def first(keys, default):
            return next((raw[k] for k in keys if k in raw), default)

        look = _whole(first(LOOK_KEYS, 1), 1)
        most = _whole(first(MAX_LOOK_KEYS, look), look)
        method = str(first(("spending_method", "method"), "obrien_fleming")).strip().lower()
        return cls(
            True,
            min(look, most),
            most,
            method if method == "pocock" else "obrien_fleming",
            _fraction(raw.get("futility_min_information_fraction"), FUTILITY_INFORMATION),
            _fraction(raw.get("futility_p_value_threshold"), FUTILITY_P),
        )


def _whole(value: Any, default: int) -> int:
    try:
        return max(int(value), 1)
    except (TypeError, ValueError):
        return max(default, 1)


def _fraction(value: Any, default: float) -> float:
    try:
        return min(max(float(value), 0.0), 1.0)
    except (TypeError, ValueError):
        return default


@dataclass(frozen=True)
class Options:
    """Analysis options, with the defaults of the statistics layer we follow."""

    alpha: float = 0.05
    power: float = 0.8
    metric_type: str = "auto"
    count_model: str = "auto"
    heavy_tail_strategy: str = "robust"
    primary_test: str = "hc3"          # or "welch"
    proportion_method: str = "score"   # or "wald"
    expected_treatment_ratio: float = 0.5
    cuped: bool = False
    rebalance: bool = False
    rebalance_iterations: int = 1000
    scope: str = "segments"            # "overall", "segments" or "both"
    diagnostics: bool = True
    covariates: bool = True
    posterior: str = "by_size"         # "normal", "t", or t where an arm is small
    normality: str = "by_size"         # "shapiro", "dagostino_k2", or the latter where an arm is large
    seed: int = 42
    sequential: Sequential = field(default_factory=Sequential)

    def __post_init__(self):
        if self.metric_type not in METRIC_TYPES:
            object.__setattr__(self, "metric_type", "auto")
        if self.posterior not in ("by_size", "normal", "t"):
            raise ValueError("posterior must be 'by_size', 'normal' or 't'")
        if self.normality not in ("by_size", "shapiro", "dagostino_k2"):
            raise ValueError("normality must be 'by_size', 'shapiro' or 'dagostino_k2'")
        if self.scope not in ("overall", "segments", "both"):
            raise ValueError("scope must be 'overall', 'segments' or 'both'")
        object.__setattr__(self, "sequential", Sequential.resolve(self.sequential))
