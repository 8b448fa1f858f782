"""Operator 12 against a plain version, byte by byte."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumaflow.llm import align, packing

SMALL = "/root/testdata/sf0.001"
PATHS = packing.tokenizer_path(align.BYTES_FILE), packing.tokenizer_path(align.PIECES_FILE)
ODD = ["", " ", "a", "a b", " a", "a ", "a  b", "a\n b", "a b\n", "\n\n", "naïve café", "漢字 かな", "🙂🙂 🙂", "don't 'S", "x" * 500, "a▁b", "▁", "<|endoftext|> <s> </s> <unk> <0x41>", "  a b", "é é", "12 3.14", "\t\ttab\tbed", "a 　b", "\x00 \x7f", " " * 50, "ﬁ Å"]


def plain(texts):
    """(n_a, n_b, groups as text, links) of each text, by walking over its bytes."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATHS[0])
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    out = []
    for text in texts:
        if not text:
            out.append((0, 0, "", []))
            continue
        a, b = t.encode(" " + text, add_special_tokens=False).ids, m.encode(text)
        a_bytes = [bytes(byte[c] for c in t.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in b]
        raw = (" " + text).encode()
        if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            out.append((0, 0, "", []))
            continue
        ends = lambda x: [sum(map(len, x[: k + 1])) for k in range(len(x))] if len(x) < 300 else running(x)
        a_end, b_end = dict(zip(ends(a_bytes), a)), dict(zip(ends(b_bytes), b))
        groups, links, ga, gb = [], [], [], []
        for at in sorted({*a_end, *b_end}):
            ga += [a_end[at]] if at in a_end else []
            gb += [b_end[at]] if at in b_end else []
            if at in a_end and at in b_end:
                groups.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
                links.append((a_end[at], b_end[at]))
                ga, gb = [], []
        out.append((len(a), len(b), ";".join(groups), links))
    return out


def running(x):
    out, n = [], 0
    for t in x:
        out.append(n := n + len(t))
    return out


def expected(ids, texts):
    found = plain(texts)
    count = Counter(l for *_, links in found for l in links)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return sorted(((i, n_a, n_b, g.count(";") + bool(g), len(links), sum(count[l] == most[l[1]] for l in links), sum(count[l] for l in links), hashlib.sha256(g.encode()).hexdigest() if n_a else "") for i, (n_a, n_b, g, links) in zip(ids, found)), key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_all_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = align.op12_alignment(spark, SMALL)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == expected(*zip(*docs))


@pytest.mark.parametrize("links", [1, 40, 1_000_000])
def test_odd_texts_in_chunks_of_any_size(spark, links, monkeypatch):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "a b"), (None, "a b"), (99, None), (100, " ".join(ODD) * 30)]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n long, chunk string").repartition(3)
    got = align.aligned(df, *PATHS, ["doc_id"], links)
    assert sorted(map(tuple, got.collect()), key=str) == expected([i for i, _ in rows], [t for _, t in rows])


def test_words_are_forgotten():
    """Results don't depend on what a worker has met before."""
    aligner = align.Aligner(*PATHS)
    first = aligner(ODD)
    aligner.forget()
    again = [aligner([t])[0] for t in reversed(ODD)][::-1]
    assert [k[:4] for k in first] == [k[:4] for k in again]
    assert [len(k.links) for k in first] == [len(k.links) for k in again]


def test_groups(spark):
    df = spark.createDataFrame([(1, "naïve x"), (2, None), (3, "a▁")], "doc_id long, text string")
    by = {r["doc_id"]: r["groups"] for r in align.groups(df, *PATHS).collect()}
    assert by[2] == [] == by[3]
    assert by[1][0]["start"] == 0 and by[1][-1]["end"] == len(" naïve x".encode()) and all(x["end"] == y["start"] for x, y in zip(by[1], by[1][1:]))
    text = ";".join(f"{','.join(map(str, g['a']))}|{','.join(map(str, g['b']))}" for g in by[1])
    assert text == plain(["naïve x"])[0][2]


def test_empty_tokens_expand():
    import numpy as np

    a, b, end = align.products(np.array([2, 2, 3]), np.array([2, 3, 3]), np.array([2, 3]))
    assert list(zip(a, b, end)) == [(0, 0, 0), (1, 0, 0), (2, 1, 1), (2, 2, 1)]


def test_no_documents(spark):
    assert align.aligned(spark.createDataFrame([], "doc_id long, text string"), *PATHS, ["doc_id"]).collect() == []
    assert align.aligned(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), *PATHS, ["doc_id"]).where(F.col("n_a") > 0).count() == 0
