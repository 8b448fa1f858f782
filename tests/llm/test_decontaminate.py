"""Operator 13 against a plain version, with automata of any size."""

import hashlib
import random
import re

import pytest

from lumaflow.llm import decontaminate

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(text, items, size=10):
    """(number of words, hit words, ids of items) by comparing every window with every place."""
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for k in range(max(1, len(v) - size + 1) if v else 0):
            win = v[k : k + size]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= {*range(i, i + len(win))}
                    ids.add("null" if item is None else str(item))
    return len(w), sorted(hit), sorted(ids)


def check(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "n", 1) for i, t in docs], "doc_id long, text string, runs string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.found(d.select("doc_id", "text"), b, **more).collect()
    size = more.get("size", 10)
    mine = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "", r["n_words"], [k for x in r["runs"] for k in range(x["first"], x["last"] + 1)], r["items"]) for r in got)
    assert mine == sorted((-1 if i is None else i, t or "", *plain(t, items, size)) for i, t in docs)
    return d, b


def random_case(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "A", "é", "x1", "the", "漢字"]
    some = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", " - ", "."]) for _ in range(rng.randrange(n)))
    items = [(k, some(20)) for k in range(12)]
    docs = [(k, some(60) + (rng.choice(items)[1] if rng.random() < 0.5 else "") + some(20)) for k in range(40)]
    return docs, items


@pytest.mark.parametrize("size", [1, 3, 10])
@pytest.mark.parametrize("characters", [40, 2_000_000])
def test_random(spark, size, characters):
    check(spark, *random_case(size), size=size, characters=characters)


def test_edges(spark):
    ten = "one two three four five six seven eight nine ten"
    items = [(1, ten), (1, ten), (2, "ONE, two; three-four five six seven eight nine ten eleven"), (3, None), (4, ""), (5, "..."), (6, "lone"), (None, "no id here"), (70, "x " + ten)]
    docs = [(1, ten), (1, ten), (2, None), (3, ""), (None, f"- {ten.upper()}!"), (4, " ".join([ten] * 4000)), (5, "alone lonely lone"), (6, "no id  here"), (7, ten[4:]), (8, f"{ten[:-1]}"), (9, "\x00lone\x7flone")]
    d, b = check(spark, docs, items)
    at = {r["doc_id"]: r for r in decontaminate.contaminated(d, b).collect()}
    assert at[5]["text"][slice(*at[5]["spans"][0])] == "lone" and at[5]["items"] == ["6"]
    assert at[None]["text"][slice(*at[None]["spans"][0])] == ten.upper() and 8 not in at and 7 not in at
    assert [c for c in decontaminate.contaminated(d, b).columns] == ["doc_id", "text", "runs", "n_words", "items", "spans"]


def test_spans_are_of_the_original():
    text = "🙂 Ünï, ONE--two\n\nThree! é"
    assert [text[a:b] for a, b in decontaminate.spans(text, [(0, 1), (2, 4)])] == ["🙂 Ünï", "ONE--two\n\nThree"]


def test_hot_window(spark):
    """One window of many items, and a document made of it: items are dealt to several automata."""
    items = [(k, "a b c d e f g h i j") for k in range(500)]
    docs = [(1, "a b c d e f g h i j " * 50), (2, "a b c d e f g h i")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.found(d, b, characters=2_000).collect()}
    assert len(rows[1]["items"]) == 500 and rows[1]["runs"] == [(0, 499)] and rows[2]["runs"] == []


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    (row,) = decontaminate.found(docs, none).collect()
    assert (row["n_words"], row["runs"], row["items"]) == (2, [], [])
    assert decontaminate.found(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).collect() == []
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
