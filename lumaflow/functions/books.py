"""The rule books and tables that ship with the engine, and loaders for others.

All numbers, ids and names in this file are fixed values: results depend on them.
"""

from __future__ import annotations

import json
from pathlib import Path

from ..schemas import VERSIONS
from .rules import Narrative, RuleBook, RuleBookError, narrative, rule_book

STYLE = {
    "calibration": {"status": "provisional", "sample_count": 9},
    "signal_schema": {"fields": ["shot_cut_rate_per_min", "mean_motion_intensity", "peak_motion_intensity", "continuous_motion_window_ratio", "audio_mean_volume_db", "luminance_spike_ratio"]},
    "profiles": [
        {
            "id": "ran_xiang",
            "conditions": {"all": [{"signal": "mean_motion_intensity", "op": "gte", "value": 0.42}, {"signal": "peak_motion_intensity", "op": "gte", "value": 0.60}, {"signal": "shot_cut_rate_per_min", "op": "gte", "value": 18}]},
            "score_weights": {"mean_motion_intensity": 0.5, "luminance_spike_ratio": 0.3, "audio_mean_volume_db": 0.2},
            "score_features": {"mean_motion_intensity": {"direction": "higher", "anchor": 0.42, "scale": 0.30}, "luminance_spike_ratio": {"direction": "higher", "anchor": 0.08, "scale": 0.12}, "audio_mean_volume_db": {"direction": "higher", "anchor": -30, "scale": 15}},
            "hooks": ["C_visual_tension", "D_emotional_outburst"],
            "l2_fallback": {"prompt_ref": "prompts/style_ran_xiang.md", "trigger": "ambiguous_multi_hit", "max_windows": 3},
        },
        {
            "id": "fast_dialogue",
            "conditions": {"all": [{"signal": "shot_cut_rate_per_min", "op": "gte", "value": 25}, {"signal": "mean_motion_intensity", "op": "lt", "value": 0.40}]},
            "hooks": ["E_suspense_front"],
            "l2_fallback": {"prompt_ref": "prompts/style_dialogue.md", "trigger": "always", "max_windows": 2},
        },
        {
            "id": "shang_gan",
            "enabled": False,
            "conditions": {"all": [{"signal": "mean_motion_intensity", "op": "lte", "value": 0.20}, {"signal": "shot_cut_rate_per_min", "op": "lte", "value": 12}]},
            "hooks": ["A_emotional_conflict", "D_emotional_outburst"],
        },
        {
            "id": "quality_flag",
            "conditions": {"any": [{"signal": "continuous_motion_window_ratio", "op": "lte", "value": 0.5}, {"signal": "luminance_spike_ratio", "op": "gte", "value": 0.14}]},
            "l2_fallback": {"prompt_ref": "prompts/quality_review.md", "trigger": "always", "max_windows": 2},
        },
    ],
    "gatekeeper": {"violence": {"block": ["violence_moderate", "violence_graphic"], "review": ["violence_light"]}},
}

NARRATIVE = {
    "shot_signal_schema": {"fields": ["duration_seconds", "mean_motion_intensity", "peak_motion_intensity", "luminance_spike_ratio", "luminance_delta_max"]},
    "targets": [
        {"id": "battle_effects", "styles": ["ran_xiang"], "match": "all", "conditions": [{"signal": "mean_motion_intensity", "op": "gte", "value": 0.30}, {"signal": "luminance_spike_ratio", "op": "gte", "value": 0.10}]},
        {"id": "blood_intensity", "styles": ["ran_xiang"], "match": "all", "conditions": [{"signal": "luminance_delta_max", "op": "gte", "value": 0.25}]},
        {"id": "romance_intimacy", "styles": ["fast_dialogue"], "match": "all", "conditions": [{"signal": "mean_motion_intensity", "op": "lte", "value": 0.18}, {"signal": "duration_seconds", "op": "gte", "value": 1.0}]},
        {"id": "daily_turbulence", "styles": ["fast_dialogue", "ran_xiang"], "match": "pair", "pair_conditions": {"first": [{"signal": "mean_motion_intensity", "op": "lte", "value": 0.15}], "second": [{"signal": "mean_motion_intensity", "op": "gte", "value": 0.30}]}, "pair_gap_seconds": 0.5},
        {"id": "group_action", "styles": ["ran_xiang", "fast_dialogue"], "match": "all", "conditions": [{"signal": "mean_motion_intensity", "op": "gte", "value": 0.20}, {"signal": "duration_seconds", "op": "gte", "value": 0.8}]},
    ],
    "templates": [{"id": "linear", "strategy": "chronological"}, {"id": "hook_first", "strategy": "peak_first"}, {"id": "climax_first", "strategy": "peak_first"}, {"id": "twist_bridge", "strategy": "contrast_open"}],
    "rhythm": {"min_shot_seconds": 1.0, "allow_flash_runs": True, "flash_run_min_count": 2},
    "interleave": {"enabled": True, "max_pairs": 3},
}

DEDUP_THRESHOLDS = {"similarity_review": 0.75, "similarity_block": 0.90, "corner_static_watermark": 0.55, "black_bar_ratio_review": 0.12}

#: platform, aspect, most seconds, recommended seconds
PLATFORM_SPECS = [
    ("douyin", "9:16", 900, 15), ("kuaishou", "9:16", 600, 15), ("bilibili", "16:9", 14400, 15), ("xiaohongshu", "9:16", 900, 15),
    ("instagram", "9:16", 90, 15), ("x", "16:9", 140, 15), ("youtube_shorts", "9:16", 60, 15),
]

#: category, platform, names there
PLATFORM_CATEGORIES = [
    ("drama_clip", {"douyin": ["短剧", "剧情"], "kuaishou": ["剧情", "短剧"], "bilibili": ["影视剪辑"], "xiaohongshu": ["影视综", "追剧"], "instagram": ["Entertainment", "Drama"], "x": ["entertainment"], "youtube": ["Entertainment"]}, 183),
    ("hype_mashup", {"douyin": ["影视剪辑", "燃向"], "kuaishou": ["影视", "混剪"], "bilibili": ["影视剪辑"], "xiaohongshu": ["影视综"], "instagram": ["Entertainment"], "x": ["entertainment"], "youtube": ["Entertainment"]}, 183),
    ("fast_dialogue", {"douyin": ["剧情", "短剧"], "kuaishou": ["剧情"], "bilibili": ["短片"], "xiaohongshu": ["影视综"], "instagram": ["Entertainment"], "x": ["entertainment"], "youtube": ["Entertainment"]}, 85),
    ("emotional", {"douyin": ["情感", "剧情"], "kuaishou": ["情感", "剧情"], "bilibili": ["影视杂谈"], "xiaohongshu": ["情感", "影视综"], "instagram": ["Entertainment"], "x": ["entertainment"], "youtube": ["Entertainment"]}, 182),
    ("comedy", {"douyin": ["搞笑"], "kuaishou": ["搞笑"], "bilibili": ["搞笑"], "xiaohongshu": ["搞笑"], "instagram": ["Comedy"], "x": ["comedy"], "youtube": ["Comedy"]}, 138),
]
BILIBILI_TIDS = {1: "动画", 3: "音乐", 4: "游戏", 5: "娱乐", 11: "电视剧", 13: "番剧", 23: "电影", 36: "知识", 119: "鬼畜", 129: "舞蹈", 155: "时尚", 160: "生活", 167: "国创", 177: "纪录片", 181: "影视", 188: "科技", 211: "美食", 217: "动物圈", 223: "汽车", 234: "运动"}

#: platform, stages of its duplicate check, days of its window
DEDUP_RULES = [
    ("douyin", ["file_hash", "frame_fingerprint", "ai_homogenization"], None), ("kuaishou", ["file_hash", "frame_fingerprint"], None), ("xiaohongshu", ["frame_fingerprint", "ai_homogenization"], 90),
    ("bilibili", ["file_hash", "frame_fingerprint"], None), ("instagram", ["frame_fingerprint", "ai_homogenization"], None), ("x", ["content_fingerprint"], None), ("youtube", ["file_hash", "frame_fingerprint", "content_id"], None),
]

#: question: value: prompt
CATALOG = {
    "time_of_day": {"night": "a video frame filmed at night", "dusk": "a video frame at dusk or in the evening", "daytime": "a video frame in daylight"},
    "action": {"fighting": "people are fighting", "riding_horse": "people are riding horses", "walking_away": "a person is walking away from the camera", "no_listed_action": "none of the listed actions is visible"},
    "object": {"car": "a car is clearly visible", "helmet": "a person wearing a helmet", "no_listed_object": "none of the listed objects is visible"},
    "shot_size": {"close_up": "a close-up shot of a person's face", "medium_shot": "a medium shot of people from the waist up", "wide_shot": "a wide shot showing a large scene or landscape"},
    "visual_effect": {"explosion": "a large explosion or fire burst is visible", "magic_energy": "glowing magical energy or light beams", "speed_lines": "fast motion blur suggesting high speed", "no_effect": "no obvious special effect is visible"},
    "mood": {"sad": "a melancholic scene, dim light, a sad person", "tense": "a tense confrontational scene", "warm": "a warm cozy scene with soft light", "neutral": "none of the listed moods clearly applies"},
}

TITLE_POOLS = {
    "ran_xiang": ["全程高燃！{seconds}秒肾上腺素拉满", "当雷霆落下，谁敢接这一击", "这爆发力直接封神！", "【高燃踩点】力量感拉满的名场面", "看好了！这一击会很帅"],
    "daily_turbulence": ["平静不过三秒，反转说来就来", "上一秒岁月静好，下一秒直接起飞", "这剧情反转我给满分"],
    "battle_effects": ["特效炸裂！每一帧都在燃烧经费", "雷电糊脸的一击，隔着屏幕都觉得疼", "【特效混剪】这就是经费燃烧的声音"],
    "romance_intimacy": ["甜度超标警告！这一幕心动了", "这个眼神我先磕为敬"],
    "fast_dialogue": ["台词快到截图都来不及！", "全程无尿点，对白密度拉满"],
    "group_action": ["{subject}出手的瞬间，全场安静了", "一人一个名场面，群像的压迫感", "{subject}：{action}，就这么简单"],
    "generic": ["看到最后才懂这个镜头的含金量", "这条片子后劲太大了", "第3秒开始就不想划走了"],
}
TITLE_ROUTES = {"battle_effects": ["battle_effects", "ran_xiang"], "blood_intensity": ["battle_effects", "ran_xiang"], "daily_turbulence": ["daily_turbulence"], "romance_intimacy": ["romance_intimacy"], "group_action": ["group_action"]}


def read(path: str | Path) -> dict:
    """A book's file: JSON, or YAML where PyYAML is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def found(path: str | Path) -> dict:
    """A book's file, which must be there and must hold a mapping."""
    if not Path(path).is_file():
        raise RuleBookError(f"not found: {path}")
    raw = read(path)
    if not isinstance(raw, dict):
        raise RuleBookError(f"{path}: not a mapping")
    return raw


def platforms(path: str | Path | None = None) -> dict:
    """The platform book, checked: a file's, or the shipped one in the same form."""
    from .checks import platform_book

    if path:
        return platform_book(found(path))
    categories = [{"id": c, "platforms": {p: {"name": names[0], "tid": tid} if p == "bilibili" and len(names) == 1 else names for p, names in by.items()}} for c, by, tid in PLATFORM_CATEGORIES]
    specs = {p: {"aspect": a, "max_seconds": most, "recommend_seconds": rather} for p, a, most, rather in PLATFORM_SPECS}
    rules = {p: {"detection": how} | ({"window_days": days} if days else {}) for p, how, days in DEDUP_RULES}
    return platform_book({
        "schema_version": VERSIONS["platform_profiles"], "status": "provisional",
        "taxonomy": {"unified_categories": categories, "platform_specs": specs, "bilibili_tid_reference": BILIBILI_TIDS},
        "dedup_rules": {"common_stages": ["file digest", "frame fingerprints", "likeness of content"], "platforms": rules, "thresholds": DEDUP_THRESHOLDS},
    })


def styles(path: str | Path | None = None) -> RuleBook:
    return rule_book(found(path) if path else STYLE)


def narratives(path: str | Path | None = None, profiles: set[str] | None = None) -> Narrative:
    """The narrative book; a file's is checked whole, also against the profiles of a style book if they are given."""
    from .checks import narrative_book

    return narrative(narrative_book(found(path), profiles) if path else NARRATIVE)


def catalog(request: dict[str, dict[str, str]] | None = None) -> dict[str, dict[str, str]]:
    """The default groups with a request's put in or over; 2 to 12 values a group, at most 8 groups, no empty strings."""
    merged = CATALOG | (request or {})
    if len(merged) > 8:
        raise ValueError("at most 8 groups")
    for name, values in (request or {}).items():
        if not name or not 2 <= len(values) <= 12 or not all(k.strip() and v.strip() for k, v in values.items()):
            raise ValueError(f"group {name!r} needs 2 to 12 non-empty values")
    return merged
