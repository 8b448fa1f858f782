"""What a book's file must look like, said as shapes, and everything in a file that departs from it."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from ..schemas import VERSIONS
from .rules import OPS, RuleBookError


class Shape:
    def problems(self, x: Any, at: str) -> Iterator[str]:
        """What is wrong with x, which stands at this path."""
        yield from ()


@dataclass(frozen=True)
class Text(Shape):
    empty: bool = False

    def problems(self, x, at):
        if not isinstance(x, str) or not (x or self.empty):
            yield f"{at}: not a text"


@dataclass(frozen=True)
class Number(Shape):
    low: float = -math.inf
    high: float = math.inf
    above: float = -math.inf
    whole: bool = False

    def problems(self, x, at):
        if isinstance(x, bool) or not isinstance(x, int if self.whole else (int, float)) or not math.isfinite(x):
            yield f"{at}: not a {'whole ' if self.whole else ''}number"
        elif not (self.low <= x <= self.high and x > self.above):
            yield f"{at}: {x} is out of range"


@dataclass(frozen=True)
class Flag(Shape):
    def problems(self, x, at):
        if not isinstance(x, bool):
            yield f"{at}: not true or false"


@dataclass(frozen=True)
class OneOf(Shape):
    values: tuple

    def problems(self, x, at):
        if isinstance(x, (list, dict)) or x not in self.values:
            yield f"{at}: {x!r} isn't one of {list(self.values)}"


@dataclass(frozen=True)
class ListOf(Shape):
    item: Shape
    least: int = 0
    unique: str = ""  # a key that no two items share

    def problems(self, x, at):
        if not isinstance(x, list) or len(x) < self.least:
            yield f"{at}: not a list" + (f" of {self.least} or more" if self.least else "")
            return
        for k, y in enumerate(x):
            yield from self.item.problems(y, f"{at}[{k}]")
        if self.unique:
            keys = [y[self.unique] for y in x if isinstance(y, dict) and isinstance(y.get(self.unique), str)]
            yield from (f"{at}: {self.unique} {k!r} is there twice" for k in sorted({k for k in keys if keys.count(k) > 1}))


@dataclass(frozen=True)
class MapOf(Shape):
    item: Shape
    least: int = 0
    key: Callable[[Any], bool] = lambda k: isinstance(k, str) and bool(k)

    def problems(self, x, at):
        if not isinstance(x, dict) or len(x) < self.least:
            yield f"{at}: not a mapping" + (f" of {self.least} or more" if self.least else "")
            return
        for k, y in x.items():
            if not self.key(k):
                yield f"{at}: {k!r} can't be a key"
            yield from self.item.problems(y, f"{at}.{k}")


@dataclass(frozen=True)
class Record(Shape):
    """A mapping with the keys that must be and those that may; others are unknown, unless it is open."""

    must: dict[str, Shape]
    may: dict[str, Shape] = field(default_factory=dict)
    open: bool = False

    def problems(self, x, at):
        if not isinstance(x, dict):
            yield f"{at}: not a mapping"
            return
        yield from (f"{at}: {k} is missing" for k in self.must if x.get(k) is None)
        if not self.open and (unknown := set(x) - set(self.must) - set(self.may)):
            yield f"{at}: unknown keys: {sorted(map(str, unknown))}"
        for k, shape in {**self.must, **self.may}.items():
            if x.get(k) is not None:
                yield from shape.problems(x[k], f"{at}.{k}")


@dataclass(frozen=True)
class Either(Shape):
    """The shape that a value's own ``kind`` names."""

    key: str
    by: dict[str, Shape]
    default: str

    def problems(self, x, at):
        kind = x.get(self.key, self.default) if isinstance(x, dict) else self.default
        if isinstance(kind, str) and kind in self.by:
            yield from self.by[kind].problems(x, at)
        else:
            yield f"{at}.{self.key}: {kind!r} isn't one of {sorted(self.by)}"


def check(book: Any, shape: Shape, rules: list[tuple[str, Callable[[dict], bool]]], name: str) -> dict:
    """The book, or an error that names all that is wrong with it: its shape first, then the rules between its parts."""
    wrong = list(shape.problems(book, name)) or [f"{name}: {said}" for said, holds in rules if not holds(book)]
    if wrong:
        raise RuleBookError("; ".join(wrong))
    return book


ANY, TEXTS = Shape(), ListOf(Text())
_SHARE = Number(0, 1)
_FIELDS = ("duration_seconds", "mean_motion_intensity", "peak_motion_intensity", "luminance_spike_ratio", "luminance_delta_max")

PLATFORMS = Record(
    {
        "schema_version": OneOf((VERSIONS["platform_profiles"],)), "status": OneOf(("provisional", "validated")),
        "taxonomy": Record(
            {
                "unified_categories": ListOf(Record({"id": Text(), "platforms": MapOf(ANY, 1)}, open=True), 1, "id"),
                "platform_specs": MapOf(Record({"aspect": Text(), "max_seconds": Number(above=0), "recommend_seconds": Number(above=0)}, open=True), 1),
            },
            {"bilibili_tid_reference": MapOf(Text(), key=lambda k: str(k).isdigit())}, open=True,
        ),
        "dedup_rules": Record(
            {
                "common_stages": ListOf(ANY, 1), "platforms": MapOf(Record({}, {"window_days": Number(above=0, whole=True)}, open=True), 1),
                "thresholds": Record({k: _SHARE for k in ("similarity_review", "similarity_block", "corner_static_watermark", "black_bar_ratio_review")}, open=True),
            },
            open=True,
        ),
    },
    {"updated_at": ANY, "sources": ListOf(ANY), "notes": ANY},
)
PLATFORM_RULES = [
    ("similarity_review must be below similarity_block", lambda b: b["dedup_rules"]["thresholds"]["similarity_review"] < b["dedup_rules"]["thresholds"]["similarity_block"]),
    ("every threshold must be in 0..1", lambda b: not any(True for k, v in b["dedup_rules"]["thresholds"].items() for _ in _SHARE.problems(v, k))),
]

_CONDITIONS = ListOf(Record({"signal": OneOf(_FIELDS), "op": OneOf(OPS[:4]), "value": Number()}), 1)
_TARGET = {"id": Text()}
_TARGET_MAY = {"match": ANY, "display_name": Text(), "description": Text(True), "styles": TEXTS, "l2_hint": ANY, "prompt_ref": Text()}
_SINGLE = Record(_TARGET | {"conditions": _CONDITIONS}, _TARGET_MAY)
_PAIR = Record(_TARGET | {"pair_conditions": Record({"first": _CONDITIONS, "second": _CONDITIONS})}, _TARGET_MAY | {"pair_gap_seconds": Number(0)})
NARRATIVES = Record(
    {
        "schema_version": OneOf((VERSIONS["narrative_targets"],)), "calibration": Record({"status": OneOf(("provisional", "calibrated", "deprecated"))}, open=True),
        "targets": ListOf(Either("match", {"all": _SINGLE, "any": _SINGLE, "pair": _PAIR}, "all"), 1, "id"),
        "templates": ListOf(Record({"id": Text(), "strategy": OneOf(("chronological", "peak_first", "contrast_open"))}, {"display_name": Text(), "description": Text(True)}), 1, "id"),
    },
    {
        "shot_signal_schema": Record({}, {"fields": TEXTS, "notes": ANY}), "notes": ANY, "sources": ANY, "updated_at": ANY,
        "interleave": Record({}, {"enabled": Flag(), "max_pairs": Number(0, whole=True), "min_pair_seconds": Number(0)}),
        "rhythm": Record({}, {"min_shot_seconds": Number(0), "allow_flash_runs": Flag(), "flash_run_min_count": Number(2, whole=True)}),
    },
)


def styles_known(story: dict, profiles: set[str]) -> list[tuple[str, Callable[[dict], bool]]]:
    """A rule between two books: the styles that targets name are profiles of the style book."""
    named = {s for t in story.get("targets") or [] if isinstance(t, dict) for s in t.get("styles") or [] if isinstance(s, str)}
    return [(f"unknown styles: {sorted(named - profiles)}", lambda _: not named - profiles)]


def platform_book(raw: Any) -> dict:
    return check(raw, PLATFORMS, PLATFORM_RULES, "platforms")


def narrative_book(raw: Any, profiles: set[str] | None = None) -> dict:
    return check(raw, NARRATIVES, styles_known(raw, profiles) if profiles is not None and isinstance(raw, dict) else [], "narratives")
