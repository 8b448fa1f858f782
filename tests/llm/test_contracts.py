"""The operators' queries on the smallest tables, against plain versions of the contracts or their SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from lumaflow.llm import fingerprints, html_extract, licenses, line_dedup, mixing, ngram_join, packing, registry, sharding, toxicity

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def docs(duck):
    return duck.sql("SELECT doc_id, text, source FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df, q = registry.QUERIES[name](spark, SMALL), duck.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(q.columns)
    cols = sorted(df.columns)
    key = lambda r: tuple(repr(round(float(x), 6)) if isinstance(x, (int, float)) else str(x) for x in r)
    want = sorted(key(r) for r in q.project(", ".join(cols)).fetchall())
    assert sorted(key(r) for r in df.select(cols).collect()) == want


def test_op2(spark, docs):
    got = {r["doc_id"]: r for r in fingerprints.op2_fingerprints(spark, SMALL).collect()}
    ordered = sorted(docs, key=lambda r: -r[0])
    h = fingerprints.MinHasher()
    for k, (d, t, _) in enumerate(ordered):
        other = ordered[(k + 1) % len(ordered)][1]
        edited = t[: len(t) - len(t) // 3] + other[: len(t) // 3]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == h(t).astype(">u4").tobytes().hex() and r["near_edited"] == fingerprints.likeness(h(t), h(edited)) and r["near_next"] == fingerprints.likeness(h(t), h(other))


def test_op3_sums(spark, docs):
    got = mixing.op3_mixing(spark, SMALL).collect()
    size = defaultdict(int)
    for _, t, s in docs:
        size[s] += len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    # shared by weight again and again until none is above three times its size
    goal, full = dict.fromkeys(names, 0.0), set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        goal = {s: 3.0 * size[s] if s in full else left * weight[s] / w for s in names}
        over = {s for s in names if s not in full and goal[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    taken, by = defaultdict(int), {d: s for d, _, s in docs}
    for r in got:
        s = by[r["doc_id"]]
        taken[s] += r["taken"]
        assert abs(r["target"] - goal[s]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in names)


def test_op4(spark, docs):
    got = sharding.op4_sharding(spark, SMALL).collect()
    text = {d: t or "" for d, t, _ in docs}
    slots = defaultdict(list)
    for r in got:
        b = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(b) + 16, zlib.crc32(b), "key")
        assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_tree_moves_only_into_what_grows(spark):
    from pyspark.sql import functions as F

    d = spark.range(20_000).withColumn("k", F.col("id").cast("string"))
    a, b = sharding.tree(40), sharding.tree(41)
    heavier, lighter = sharding.tree(40, {7: 3.0}), sharding.tree(40, {7: 0.25})
    r = d.select(sharding.shard_of(F.col("k"), a).alias("a"), sharding.shard_of(F.col("k"), b).alias("b"), sharding.shard_of(F.col("k"), heavier).alias("h"), sharding.shard_of(F.col("k"), lighter).alias("l")).collect()
    assert all(x["b"] in (x["a"], 40) for x in r)
    n = Counter(x["a"] for x in r)
    assert len(n) == 40 and max(n.values()) < 1.3 * 500 and min(n.values()) > 0.7 * 500
    assert 0.7 < sum(x["b"] == 40 for x in r) / (20_000 / 41) < 1.3
    # a shard that gains weight only takes rows, one that loses weight only gives rows, about in proportion
    assert all(x["h"] in (x["a"], 7) for x in r) and all(x["l"] == x["a"] for x in r if x["a"] != 7)
    assert 0.7 < sum(x["h"] == 7 for x in r) / (20_000 * 3 / 42) < 1.3 and 0.7 < sum(x["l"] == 7 for x in r) / (20_000 * 0.25 / 39.25) < 1.3


def test_law_at_every_count(spark):
    """One more shard takes rows only into itself, for each count from 1 to 100; draws recomputed plainly."""
    import xxhash
    from pyspark.sql import functions as F

    keys = [str(k) for k in range(400)]
    d = spark.createDataFrame([(k,) for k in keys], "k string").repartition(4)
    rows = d.select("k", F.array(*[sharding.shard_of(F.col("k"), sharding.tree(n)) for n in range(1, 101)]).alias("at")).collect()

    def signed(x, bits):
        return x - (1 << bits) if x >> (bits - 1) else x

    for r in rows:
        assert all(b in (a, n) for n, (a, b) in enumerate(zip(r["at"], r["at"][1:]), 1))
        # xxhash64(key, shard) chains: the key's hash seeds that of the shard
        h = xxhash.xxh64_intdigest(r["k"].encode(), 42)
        u = [((xxhash.xxh64_intdigest(s.to_bytes(4, "little"), h) >> 11) + 0.5) / 2**53 for s in range(100)]
        for n in (1, 7, 40, 41, 100):
            assert r["at"][n - 1] == min(range(n), key=lambda s: -math.log(u[s]))


def brute_components(docs, sets, percent=75):
    held = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            held[x].append(d)
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, s in sets.items():
        for e, k in Counter(e for x in s for e in held[x] if e < d).items():
            if 100 * k >= percent * (len(s) + len(sets[e]) - k):
                a, b = top(d), top(e)
                up[max(a, b)] = min(a, b)
    return {d: top(d) for d in sets}


def shingle_set(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_op5(spark, docs):
    sets = {d: shingle_set(t) for d, t, _ in docs}
    want = brute_components(docs, sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.op5_ngram_join(spark, SMALL).collect()}
    assert got == {d: (len(s), want[d]) for d, s in sets.items()}
    near = {r["doc_id"]: r["component_id"] for r in fingerprints.near_duplicates(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    pairs = {d for d in want if want[d] != d}
    assert sum(near[d] == want[d] for d in pairs) >= 0.9 * len(pairs) and all(near[d] == d or want[d] != d for d in near)


def test_near_copies_of_a_hub(spark):
    """Many edits of one text, at all distances from it, and edits of edits: as brute force has it."""
    import random

    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(80)]
    rows = [(0, " ".join(base))]
    for k in range(1, 160):
        w = list(rng.choice([base, rows[rng.randrange(len(rows))][1].split()]))
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((k, " ".join(w)))
    sets = {d: shingle_set(t) for d, t in rows}
    want = brute_components(rows, sets)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) > 3


def line_shingles(line):
    x = line.lower()
    return {x[i : i + 8] for i in range(len(x) - 7)}


def test_op6(spark, docs):
    """What stays, against all pairs of lines; and the share of linked pairs of lines that end up together."""
    occurrences = [(d, k, x) for d, t, _ in sorted(docs) for k, x in enumerate(t.split("\n")) if x.strip(" \t\x0b\f\r")]
    lines = list(dict.fromkeys(x for *_, x in occurrences))
    number = {x: k for k, x in enumerate(lines)}
    sets = {k: line_shingles(x) for x, k in number.items()}
    group = brute_components(None, sets)
    first = {}
    for d, k, x in occurrences:
        first.setdefault(group[number[x]], (d, k))
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r["doc_id"]: r["_kept"] for r in line_dedup.deduplicate(table).collect()}
    same = 0
    for d, t, _ in docs:
        want = "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip(" \t\x0b\f\r") or first[group[number[x]]] == (d, k))
        same += got[d] == want
    assert same >= 0.99 * len(docs)


def test_line_pairs_recall(spark):
    """Thousands of lines of a few templates, likenesses from 0.4 to 1: of the pairs that link at least 0.95 are in one component, and no others are tied."""
    import random

    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz     "
    bases = ["".join(rng.choice(letters) for _ in range(90)) for _ in range(12)]
    lines = []
    for _ in range(1500):
        x = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2, 4, 6])):
            x[rng.randrange(len(x))] = rng.choice(letters)
        lines.append("".join(x))
    lines = [*dict.fromkeys(lines), "abcd efg", "abcd efh", "short", "漢字" * 20, "漢字" * 19 + "漢", "x"]
    sets = [line_shingles(x) for x in lines]
    held = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            held[x].append(k)
    pairs = []
    for k, s in enumerate(sets):
        for e, n in Counter(e for x in s for e in held[x] if e < k).items():
            if 100 * n >= 75 * (len(s) + len(sets[e]) - n):
                pairs.append((e, k))
    want = brute_components(None, dict(enumerate(sets)))
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    of = {r["lid"]: r["component"] for r in line_dedup.alike(docs).collect()}
    lid = {r["line"]: r["lid"] for r in line_dedup.lines(docs).collect()}
    comp = [of.get(lid[x], lid[x]) for x in lines]
    assert sum(comp[a] == comp[b] for a, b in pairs) >= 0.95 * len(pairs) and len(pairs) > 2000
    inside = defaultdict(set)
    for k, c in enumerate(comp):
        inside[c].add(want[k])
    assert all(len(v) == 1 for v in inside.values())


def test_op7(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.op7_packing(spark, SMALL).collect()
    pieces, bins = defaultdict(dict), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]][r["piece"]] = r
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, t, _ in docs:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for k in range(len(pieces[d])):
            r = pieces[d][k]
            assert r["start"] == at and (k == 0 or r["length"] == 1024)
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids) and (len(pieces[d]) == 1) == (len(ids) <= 1024)
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 1024
    assert len(bins) == plain_best_fit([r["length"] for r in got], 1024)


def plain_best_fit(lengths, capacity):
    from bisect import bisect_left, insort

    left = []
    for n in sorted(lengths, reverse=True):
        k = bisect_left(left, n)
        insort(left, (left.pop(k) if k < len(left) else capacity) - n)
    return len(left)


def test_plan_is_best_fit():
    import random

    rng = random.Random(3)
    for _ in range(100):
        capacity = rng.choice([5, 16, 100, 1024])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(300))]
        items, ends = Counter(), {}
        places = sorted((b + i // per, at + i % per * n, n) for n, f, k, per, b, at in packing.plan(Counter(lengths), capacity) for i in range(k))
        for b, at, n in places:
            assert ends.get(b, 0) == at and at + n <= capacity
            ends[b] = at + n
            items[n] += 1
        assert items == Counter(lengths) and len(ends) == plain_best_fit(lengths, capacity)


@pytest.mark.parametrize("text", ["", " ", "a  b\n\n c'll  x <|endoftext|> 12a_b\t\tz ", "\r\n x", "x　y z", "don't İ ſ 'S", " a", "a ", "a\n b", "a b\n", "é  b", "🙂 🙂a", "hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext|", " <|endoftext|>\n x"])
def test_encoder(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = b"".join(i.to_bytes(4, "little") for i in tok.encode(text, add_special_tokens=False).ids)
    e = packing.Encoder(packing.tokenizer_path())
    assert e(text) == want and e(text) == want


def test_encoder_on_random_texts(monkeypatch):
    """Words, signs and white space of all kinds in any order, with a cache that starts anew again and again."""
    import random

    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE", 2_000)
    tok, e, rng = Tokenizer.from_file(packing.tokenizer_path()), packing.Encoder(packing.tokenizer_path()), random.Random(7)
    parts = ["a", "the", "naïve", "漢字", "🙂", "don't", "12", "x" * 40, "...", "<|endoftext|>", "<|", "'s", " ", " ", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\r\n", "\u200b", "\x00", "\u2028", "e\u0301"]
    for _ in range(2_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert e(text) == b"".join(i.to_bytes(4, "little") for i in tok.encode(text, add_special_tokens=False).ids), repr(text)


@pytest.mark.parametrize("blank", [" ", "\n", "\t", " \u3000"])
def test_encoder_on_long_blanks(blank):
    """Two million spaces, or 600,000 others, within a word; thousands alone, at either end, and beside an added token."""
    from tokenizers import Tokenizer

    tok, e, run = Tokenizer.from_file(packing.tokenizer_path()), packing.Encoder(packing.tokenizer_path()), blank * ((2_000_000 if blank == " " else 600_000) // len(blank))
    short = blank * 5000
    for text in (f"x{run}y", short, f"x {short}", f"{short}\n{short} y", f"a b{short}<|endoftext|>{short}c d", f"{short}<|{short}'s {short}12"):
        assert e(text) == b"".join(i.to_bytes(4, "little") for i in tok.encode(text, add_special_tokens=False).ids)


def test_op7_packs_long_blanks(spark):
    rows = packing.pack(packing.tokenized(spark.createDataFrame([(1, "x" + " " * 1_000_000 + "y"), (2, "z")], "doc_id long, text string"), packing.tokenizer_path())).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 1_000_002


def test_op8(spark, duck):
    import html

    got = {r["page_id"]: r for r in html_extract.op8_html(spark, SMALL).collect()}
    for p, u, h in duck.sql("SELECT page_id, url, html FROM pages").fetchall():
        a = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        text = " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", a))).split())
        assert (got[p]["url"], got[p]["text"], got[p]["n_chars"]) == (u, text, len(text))


def test_op9(spark, docs):
    got = {r["doc_id"]: r for r in licenses.op9_licenses(spark, SMALL).collect()}
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    for d, t, _ in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, x) for p, x in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        r = got[d]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == (min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and {x for _, x in at} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_op10(spark, docs):
    got = toxicity.op10_toxicity(spark, SMALL).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and not math.isnan(r["score"])
    assert len(got) == len(docs)


def test_toxicity_is_learned(spark):
    """Held-out accuracy on words that only the labels know."""
    import random

    rng = random.Random(5)
    rows, labels = [], []
    for k in range(600):
        w = [f"word{rng.randrange(300)}" for _ in range(60)]
        bad = k % 6 == 0
        if bad:
            w[rng.randrange(60)] = rng.choice(["blorgen", "blorgish", "blorgo"])
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(bad)))
    docs, labelled = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = toxicity.train(docs, labelled)
    got = {r["doc_id"]: r["_predicted"] for r in toxicity.score(docs, lexicon, ["doc_id"]).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum(got[k] == (k % 6 == 0) for k in held) >= 0.98 * len(held)


def plain_evidence(lexicon, text):
    """Each word by itself, against every entry."""
    folded = toxicity.fold(text)
    padded, spared = f"{folded} ", set()
    starts = [k for k in range(len(folded)) if k == 0 or folded[k - 1] == " "]
    for k in starts:
        for e in lexicon.exceptions:
            if padded.startswith(e + " ", k):
                spared |= set(range(k, k + len(e) + 1))
    hits = {k: max(w for entry, w in lexicon.weights.items() if padded.startswith(entry, k)) for k in starts if any(padded.startswith(entry, k) for entry in lexicon.weights)}
    hits = {k: w for k, w in hits.items() if k not in spared}
    return sum(hits.values()), len(hits), len(starts)


def test_op10_is_what_the_lexicon_says(spark, docs):
    table, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    lexicon = toxicity.train(table, labels)
    got = {r["doc_id"]: r for r in toxicity.op10_toxicity(spark, SMALL).collect()}
    extra = ["the trash can is full", "class clown, you 1d10t", "i\u200bdiot idiots IDIOT", "", "trash trash can trash"]
    for t in extra:
        assert lexicon.evidence(t) == pytest.approx(plain_evidence(lexicon, t))
    for d, t, _ in docs:
        w, n, words = plain_evidence(lexicon, t or "")
        assert got[d]["n_hits"] == n and got[d]["score"] == pytest.approx(lexicon.score(w, words))


def test_pipeline_stages(spark):
    """Each stage on its own input against a plain version of what it decides."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    first = spark.read.parquet(f"{SMALL}/documents.parquet")
    lexicon = toxicity.train(first, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = first.collect()
    kept = stages["toxicity"](spark, first, SMALL)
    assert kept.columns == first.columns
    plain = [r for r in rows if lexicon.score(*plain_evidence(lexicon, r["text"] or "")[::2]) < 0.3]
    assert sorted(map(str, kept.collect())) == sorted(map(str, plain)) and len(plain) < len(rows)

    occurrences = [(r["doc_id"], k, x) for r in sorted(plain, key=lambda r: r["doc_id"]) for k, x in enumerate((r["text"] or "").split("\n")) if x.strip(" \t\x0b\f\r")]
    lines = list(dict.fromkeys(x for *_, x in occurrences))
    group = brute_components(None, {k: line_shingles(x) for k, x in enumerate(lines)})
    number, stays = {x: k for k, x in enumerate(lines)}, {}
    for d, k, x in occurrences:
        stays.setdefault(group[number[x]], (d, k))
    cleaned = stages["line_dedup"](spark, spark.createDataFrame(plain, first.schema), SMALL)
    assert cleaned.columns == first.columns
    got, same = {r["doc_id"]: r for r in cleaned.collect()}, 0
    for r in plain:
        left = [x for k, x in enumerate((r["text"] or "").split("\n")) if not x.strip(" \t\x0b\f\r") or stays[group[number[x]]] == (r["doc_id"], k)]
        want = "\n".join(left) if any(x.strip(" \t\x0b\f\r") for x in left) or not WORD.search(r["text"] or "") else None
        same += (got[r["doc_id"]]["text"] if r["doc_id"] in got else None) == want
    assert same >= 0.99 * len(plain)

    linked = brute_components(None, {r["doc_id"]: shingle_set(r["text"]) for r in got.values()})
    single = stages["ngram_join"](spark, spark.createDataFrame(list(got.values()), first.schema), SMALL)
    assert single.columns == first.columns
    one = sorted(single.collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in one] == sorted(d for d in got if linked[d] == d)

    mixed = stages["mixing"](spark, spark.createDataFrame(one, first.schema), SMALL)
    assert mixed.columns == first.columns
    words, size, text = defaultdict(int), defaultdict(int), {r["doc_id"]: r["text"] or "" for r in one}
    for r in one:
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    out = mixed.collect()
    for r in out:
        words[r["source"]] += len(WORD.findall(r["text"] or ""))
        assert text[r["doc_id"]].lstrip(" \t\n\x0b\f\r").startswith(r["text"].strip(" \t\n\x0b\f\r")) and r["n_chars"] == len(r["text"])
    assert sum(words.values()) <= sum(size.values()) and all(words[s] <= 3 * size[s] for s in size)

    pieces = stages["packing"](spark, spark.createDataFrame(out, first.schema), SMALL).collect()
    bins = defaultdict(list)
    for r in pieces:
        bins[r["sequence_id"]].append(r["length"])
    assert all(sum(x) <= 1024 for x in bins.values()) and len(bins) == plain_best_fit([r["length"] for r in pieces], 1024)
