"""Book files: what is refused, and that what is shipped and what a file says give the same tables."""

import copy
import json

import pytest

from lumaflow.functions import books, checks
from lumaflow.functions.rules import RuleBookError
from lumaflow.operators import platforms

PLATFORM = books.platforms()
STORY = {"schema_version": "narrative-targets-1.0", "calibration": {"status": "provisional", "sample_count": 1}, **copy.deepcopy(books.NARRATIVE)}


def put(raw, path, value):
    raw = copy.deepcopy(raw)
    *way, last = path
    x = raw
    for k in way:
        x = x[k]
    if value is ...:
        del x[last]
    else:
        x[last] = value
    return raw


T = ("dedup_rules", "thresholds")
C = ("taxonomy", "unified_categories")
PLATFORM_FAULTS = [
    (("schema_version",), "platform-profiles-9", "isn't one of"), (("status",), "calibrated", "isn't one of"), (("taxonomy",), [], "not a mapping"), (("taxonomy",), ..., "taxonomy is missing"),
    (C, [], "1 or more"), (C, {}, "not a list"), ((*C, 0), "x", "not a mapping"), ((*C, 0, "id"), ..., "id is missing"), ((*C, 0, "id"), "", "not a text"), ((*C, 1, "id"), PLATFORM["taxonomy"]["unified_categories"][0]["id"], "there twice"),
    ((*C, 0, "platforms"), {}, "1 or more"), ((*C, 0, "platforms"), ..., "platforms is missing"), (("taxonomy", "platform_specs"), {}, "1 or more"), (("taxonomy", "platform_specs", "douyin"), 3, "not a mapping"),
    (("taxonomy", "platform_specs", "douyin", "aspect"), ..., "aspect is missing"), (("taxonomy", "platform_specs", "douyin", "max_seconds"), 0, "out of range"), (("taxonomy", "platform_specs", "douyin", "recommend_seconds"), -1, "out of range"),
    (("taxonomy", "bilibili_tid_reference"), {"x": "y"}, "can't be a key"), (("dedup_rules",), 1, "not a mapping"), (("dedup_rules", "common_stages"), [], "1 or more"), (("dedup_rules", "platforms"), {}, "1 or more"),
    ((*T, "similarity_review"), 0.95, "similarity_review must be below"), ((*T, "black_bar_ratio_review"), ..., "black_bar_ratio_review is missing"), ((*T, "corner_static_watermark"), 1.5, "out of range"), ((*T, "similarity_block"), True, "not a number"),
    ((*T, "own"), 2, "every threshold"), (("extra",), 1, "unknown keys"),
]
STORY_FAULTS = [
    (("schema_version",), "x", "isn't one of"), (("calibration", "status"), "validated", "isn't one of"), (("calibration",), ..., "calibration is missing"), (("targets",), [], "1 or more"), (("targets", 0), [], "not a mapping"), (("targets", 0, "id"), ..., "id is missing"),
    (("targets", 1, "id"), "battle_effects", "there twice"), (("targets", 0, "match"), "some", "isn't one of"), (("targets", 0, "match"), [], "isn't one of"), (("targets", 0, "styles"), "ran_xiang", "not a list"), (("targets", 0, "styles"), [1], "not a text"), (("targets", 0, "conditions"), [], "1 or more"), (("targets", 0, "conditions"), ..., "conditions is missing"),
    (("targets", 0, "conditions", 0, "signal"), "fps", "isn't one of"), (("targets", 0, "conditions", 0, "op"), "between", "isn't one of"), (("targets", 0, "conditions", 0, "value"), "1", "not a number"), (("targets", 0, "conditions", 0, "more"), 1, "unknown keys"),
    (("targets", 3, "pair_conditions"), ..., "pair_conditions is missing"), (("targets", 3, "pair_conditions", "second"), ..., "second is missing"), (("targets", 3, "pair_conditions", "first"), [], "1 or more"), (("targets", 0, "unheard"), 1, "unknown keys"),
    (("templates",), ..., "templates is missing"), (("templates", 0, "strategy"), "random", "isn't one of"), (("templates", 0, "id"), ..., "id is missing"), (("templates", 1, "id"), "linear", "there twice"), (("rhythm", "min_shot_seconds"), -1, "out of range"), (("rhythm", "flash_run_min_count"), 1, "out of range"), (("interleave", "enabled"), "yes", "not true or false"), (("other",), {}, "unknown keys"),
]


@pytest.mark.parametrize("path, value, said", PLATFORM_FAULTS)
def test_platform_faults(tmp_path, path, value, said):
    (f := tmp_path / "p.json").write_text(json.dumps(put(PLATFORM, path, value)), encoding="utf-8")
    with pytest.raises(RuleBookError, match=said):
        books.platforms(f)


@pytest.mark.parametrize("path, value, said", STORY_FAULTS)
def test_narrative_faults(tmp_path, path, value, said):
    (f := tmp_path / "n.json").write_text(json.dumps(put(STORY, path, value)), encoding="utf-8")
    with pytest.raises(RuleBookError, match=said):
        books.narratives(f)


def test_every_fault_is_told():
    with pytest.raises(RuleBookError) as e:
        checks.platform_book(put(put(PLATFORM, ("status",), "x"), (*T, "similarity_block"), 7))
    assert "status" in str(e.value) and "similarity_block" in str(e.value)


def test_styles_of_targets_are_profiles(tmp_path):
    (f := tmp_path / "n.json").write_text(json.dumps(STORY), encoding="utf-8")
    assert books.narratives(f, {p.profile_id for p in books.styles().profiles}).templates
    with pytest.raises(RuleBookError, match="unknown styles.*ran_xiang"):
        books.narratives(f, {"fast_dialogue"})


def test_files_say_what_is_shipped(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    (f := tmp_path / "p.yaml").write_text(yaml.safe_dump(PLATFORM, allow_unicode=True), encoding="utf-8")
    book = books.platforms(f)
    for table in (platforms.categories, platforms.specs, platforms.dedup_rules, platforms.tids):
        assert sorted(map(str, table(spark, book).collect())) == sorted(map(str, table(spark).collect())) != []
    assert platforms.thresholds(book) == books.DEDUP_THRESHOLDS
    (g := tmp_path / "n.yaml").write_text(yaml.safe_dump(STORY, allow_unicode=True), encoding="utf-8")
    assert books.narratives(g) == books.narratives()


def test_a_book_of_ones_own(spark):
    own = put(put(PLATFORM, (*C,), [{"id": "clip", "platforms": {"douyin": ["a", "b"], "bilibili": {"name": "c", "tid": 9}}}]), ("taxonomy", "platform_specs"), {"douyin": {"aspect": "1:1", "max_seconds": 5, "recommend_seconds": 4}})
    df = spark.createDataFrame([(1, "clip"), (2, "none")], "id int, category string")
    rows = {r["platform"]: (r["id"], r["names"], r["tid"], r["aspect"]) for r in platforms.mapped(df, book=checks.platform_book(own)).collect()}
    assert rows == {"douyin": (1, ["a", "b"], None, "1:1"), "bilibili": (1, ["c"], 9, None)}


def test_files_that_are_not_there(tmp_path):
    for load in (books.platforms, books.narratives, books.styles):
        with pytest.raises(RuleBookError, match="not found"):
            load(tmp_path / "none.json")
        (f := tmp_path / "list.json").write_text("[1]", encoding="utf-8")
        with pytest.raises(RuleBookError, match="not a mapping"):
            load(f)
