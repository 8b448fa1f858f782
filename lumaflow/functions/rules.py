"""Rule books: validated when loaded, compiled to columns when a plan is built."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import all_of, any_of, clamp01

OPS = ("gte", "gt", "lte", "lt", "between")
TRIGGERS = ("always", "ambiguous_multi_hit")
STATUSES = ("provisional", "calibrated", "deprecated")
CALIBRATED_SAMPLES, MOST_NESTING = 30, 2


class RuleBookError(ValueError):
    pass


@dataclass(frozen=True)
class Condition:
    signal: str
    op: str
    value: float | None = None
    low: float | None = None
    high: float | None = None

    def column(self, at: Column | None = None) -> Column:
        """Null signals satisfy nothing."""
        c = F.col(self.signal) if at is None else at[self.signal]
        made = {"gte": lambda: c >= self.value, "gt": lambda: c > self.value, "lte": lambda: c <= self.value, "lt": lambda: c < self.value, "between": lambda: c.between(self.low, self.high)}[self.op]()
        return F.coalesce(made, F.lit(False))


@dataclass(frozen=True)
class Block:
    all: tuple = ()
    any: tuple = ()

    def column(self, at: Column | None = None) -> Column:
        parts = [fold([x.column(at) for x in items]) for fold, items in ((all_of, self.all), (any_of, self.any)) if items]
        return all_of(parts) if parts else F.lit(True)

    def conditions(self) -> list[Condition]:
        return [c for x in (*self.all, *self.any) for c in (x.conditions() if isinstance(x, Block) else [x])]

    def notes(self) -> Column:
        return F.array_compact(F.array(*[F.when(F.col(c.signal).isNull(), F.lit(f"signal '{c.signal}' missing; condition treated as not satisfied")) for c in self.conditions()])) if self.conditions() else F.array().cast("array<string>")


@dataclass(frozen=True)
class Feature:
    direction: str
    anchor: float
    scale: float

    def column(self, signal: str) -> Column:
        margin = (F.col(signal) - self.anchor) / self.scale
        return clamp01(margin if self.direction == "higher" else -margin)


@dataclass(frozen=True)
class Fallback:
    prompt_ref: str
    trigger: str
    max_windows: int


@dataclass(frozen=True)
class Profile:
    profile_id: str
    conditions: Block
    enabled: bool = True
    weights: dict[str, float] = field(default_factory=dict)
    features: dict[str, Feature] = field(default_factory=dict)
    hooks: tuple[str, ...] = ()
    fallback: Fallback | None = None
    display_name: str = ""

    def score(self, digits: int = 4) -> Column:
        """Weighted mean of the features whose signal is there; 1 where none is, or none weighs."""
        if not self.weights:
            return F.lit(1.0)
        there = [(F.col(k).isNotNull(), w, self.features[k].column(k)) for k, w in self.weights.items()]
        top = sum((F.when(t, w * x).otherwise(0.0) for t, w, x in there), F.lit(0.0))
        weight = sum((F.when(t, F.lit(float(w))).otherwise(0.0) for t, w, _ in there), F.lit(0.0))
        return F.when(weight > 0, F.round(F.try_divide(top, weight), digits)).otherwise(1.0)


@dataclass(frozen=True)
class RuleBook:
    profiles: tuple[Profile, ...]
    status: str
    gate: dict[str, dict[str, tuple[str, ...]]]
    signals: tuple[str, ...]

    def check_production(self, production: bool) -> None:
        if production and self.status != "calibrated":
            raise RuleBookError(f"production needs a calibrated rule book; this one is {self.status}")

    def match(self, digits: int = 4) -> Column:
        """Matches of enabled profiles in the book's order: array of (position, profile_id, style_score, notes)."""
        made = [F.when(p.conditions.column(), F.struct(F.lit(k).alias("position"), F.lit(p.profile_id).alias("profile_id"), p.score(digits).alias("style_score"), p.conditions.notes().alias("notes"))) for k, p in enumerate(self.profiles) if p.enabled]
        return F.array_compact(F.array(*made))


def _number(x: Any, what: str) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise RuleBookError(f"{what} must be a number")
    return float(x)


def condition(raw: dict, signals: tuple[str, ...], ops: tuple[str, ...] = OPS) -> Condition:
    if raw.get("signal") not in signals:
        raise RuleBookError(f"unknown signal: {raw.get('signal')}")
    if raw.get("op") not in ops:
        raise RuleBookError(f"unknown op: {raw.get('op')}")
    if raw["op"] == "between":
        low, high = _number(raw.get("low"), "low"), _number(raw.get("high"), "high")
        if low > high:
            raise RuleBookError("low is above high")
        return Condition(raw["signal"], "between", None, low, high)
    return Condition(raw["signal"], raw["op"], _number(raw.get("value"), "value"))


def block(raw: dict, signals: tuple[str, ...], depth: int = 1) -> Block:
    if depth > MOST_NESTING:
        raise RuleBookError("conditions nest too deep")
    if not isinstance(raw, dict) or not raw or set(raw) - {"all", "any"}:
        raise RuleBookError("a block has 'all', 'any' or both")
    def items(name: str) -> tuple:
        return tuple(condition(x, signals) if "signal" in x else block(x, signals, depth + 1) for x in raw.get(name) or [])
    return Block(items("all"), items("any"))


def profile(raw: dict, signals: tuple[str, ...]) -> Profile:
    if unknown := set(raw) - {"id", "display_name", "enabled", "conditions", "score_weights", "score_features", "hooks", "l2_fallback", "clip_strategy", "notes"}:
        raise RuleBookError(f"unknown keys: {sorted(unknown)}")
    weights = {k: _number(v, "weight") for k, v in (raw.get("score_weights") or {}).items()}
    features = {}
    for k, v in (raw.get("score_features") or {}).items():
        if v.get("direction") not in ("higher", "lower") or _number(v.get("scale"), "scale") <= 0:
            raise RuleBookError("a feature has a direction and a positive scale")
        features[k] = Feature(v["direction"], _number(v.get("anchor"), "anchor"), float(v["scale"]))
    if set(weights) != set(features) or any(w < 0 for w in weights.values()) or set(weights) - set(signals):
        raise RuleBookError("weights are non-negative and have a feature each, on known signals")
    fallback = None
    if f := raw.get("l2_fallback"):
        n = f.get("max_windows")
        if f.get("trigger") not in TRIGGERS or isinstance(n, bool) or not isinstance(n, int) or n < 1 or not f.get("prompt_ref"):
            raise RuleBookError("a fallback has a prompt, a trigger and max_windows of 1 or more")
        fallback = Fallback(f["prompt_ref"], f["trigger"], n)
    return Profile(raw["id"], block(raw["conditions"], signals), bool(raw.get("enabled", True)), weights, features, tuple(raw.get("hooks") or ()), fallback, raw.get("display_name", ""))


def rule_book(raw: dict) -> RuleBook:
    """A rule book from its parsed file; whatever it can't mean is an error."""
    calibration, signals = raw.get("calibration") or {}, tuple((raw.get("signal_schema") or {}).get("fields") or ())
    status = calibration.get("status")
    if status not in STATUSES:
        raise RuleBookError(f"unknown status: {status}")
    if status == "calibrated" and int(calibration.get("sample_count") or 0) < CALIBRATED_SAMPLES:
        raise RuleBookError("calibrated with too few samples")
    profiles = tuple(profile(p, signals) for p in raw.get("profiles") or [])
    if len({p.profile_id for p in profiles}) != len(profiles):
        raise RuleBookError("a profile id is there twice")
    gate = {k: {n: tuple(v.get(n) or ()) for n in ("block", "review")} for k, v in (raw.get("gatekeeper") or {}).items() if isinstance(v, dict)}
    return RuleBook(profiles, status, gate, signals)


@dataclass(frozen=True)
class Target:
    target_id: str
    styles: tuple[str, ...]
    match: str
    conditions: tuple[Condition, ...] = ()
    first: tuple[Condition, ...] = ()
    second: tuple[Condition, ...] = ()
    gap: float = 0.0


@dataclass(frozen=True)
class Narrative:
    targets: tuple[Target, ...]
    templates: dict[str, str]
    min_shot_seconds: float
    allow_flash_runs: bool
    flash_run_min_count: int
    interleave: bool
    max_pairs: int

    def chosen(self, style_id: str | None) -> list[tuple[int, Target]]:
        """Targets for a style: all if none is given, and those without styles always."""
        return [(k, t) for k, t in enumerate(self.targets) if not style_id or not t.styles or style_id in t.styles]


#: What targets may ask of a shot, and the seconds between a pair's shots where a target doesn't say.
SHOT_FIELDS, PAIR_GAP = ("duration_seconds", "mean_motion_intensity", "peak_motion_intensity", "luminance_spike_ratio", "luminance_delta_max"), 0.5


def narrative(raw: dict) -> Narrative:
    signals, ops = tuple((raw.get("shot_signal_schema") or {}).get("fields") or SHOT_FIELDS), OPS[:4]
    targets = []
    for t in raw.get("targets") or []:
        t = {"match": "all", **t}
        if t["match"] not in ("all", "any", "pair"):
            raise RuleBookError(f"unknown match: {t['match']}")
        made = lambda xs: tuple(condition(x, signals, ops) for x in xs or [])
        pair = t.get("pair_conditions") or {}
        targets.append(Target(t["id"], tuple(t.get("styles") or ()), t["match"], made(t.get("conditions")), made(pair.get("first")), made(pair.get("second")), float(t.get("pair_gap_seconds", PAIR_GAP))))
        if t["match"] == "pair" and not (targets[-1].first and targets[-1].second) or t["match"] != "pair" and not targets[-1].conditions:
            raise RuleBookError(f"{t['id']} has no conditions")
    if len({t.target_id for t in targets}) != len(targets):
        raise RuleBookError("a target id is there twice")
    templates = {t["id"]: t["strategy"] for t in raw.get("templates") or []}
    if set(templates.values()) - {"chronological", "peak_first", "contrast_open"}:
        raise RuleBookError("unknown strategy")
    r, i = raw.get("rhythm") or {}, raw.get("interleave") or {}
    return Narrative(tuple(targets), templates, float(r.get("min_shot_seconds", 1.0)), bool(r.get("allow_flash_runs", True)), int(r.get("flash_run_min_count", 2)), bool(i.get("enabled", False)), int(i.get("max_pairs", 3)))
