"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and columns with clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lumaflow.llm import common, fingerprints, html_extract, licenses, line_dedup, mixing, ngram_join, packing, quality, sharding, toxicity

DDL = "doc_id long, text string, lang string, source string, n_chars long, size long, component string, token string, lid string, taken string, h string"
LONG = " ".join(f"w{k % 977}" for k in range(60_000))
ROWS = [
    (1, "one two three four five six seven", "en", "a"), (1, "one two three four five six seven", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (None, "one two three four five six seven", "en", "b"),
    (4, " \n\t ", "en", "b"), (5, LONG, "en", "b"), (6, "x", None, None), (None, None, None, None), (7, "one two three four five six seven\nlast line of it here", "en", "b"), (8, "é ü 漢字\n漢字\n漢字", "de", "c"),
]
HOST = "http://h.example/p"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), 9, "c", "t", "l", "k", "h") for r in ROWS], DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


LABELS = "doc_id long, quality int, toxic int"
RUNS = {
    "quality": lambda d, l: quality.judge(d, quality.fit(d, l.where("quality = 1"))),
    "fingerprints": lambda d, l: fingerprints.fingerprints(d),
    "near": lambda d, l: fingerprints.near_duplicates(d),
    "mixing": lambda d, l: mixing.mix(d),
    "sharding": lambda d, l: sharding.assign(d, sharding.tree(40), sharding.tree(41)),
    "join": lambda d, l: ngram_join.join(d),
    "lines": lambda d, l: line_dedup.deduplicate(d),
    "packing": lambda d, l: packing.pack(packing.tokenized(d, packing.tokenizer_path())),
    "licenses": lambda d, l: licenses.scan(d, ["doc_id"]),
    "toxicity": lambda d, l: toxicity.score(d, toxicity.train(d, l), ["doc_id"]),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_every_row_has_a_result(spark, docs, name):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 1, 1), (7, None, None), (99, 0, 1)], LABELS)
    out = RUNS[name](docs, labels).collect()
    assert len(out) >= len(ROWS) if name == "packing" else len(out) == len(ROWS)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_empty_tables(spark, empty, name):
    assert RUNS[name](empty, spark.createDataFrame([], LABELS)).collect() == []


def test_quality_values(spark, docs):
    out = quality.judge(docs, [0] * quality.BUCKETS).collect()
    by = {r["doc_id"]: r for r in out}
    assert by[8]["n_dup_lines"] == 1 and by[2]["n_words"] == 0 and by[2]["base_failed"] and not by[2]["kept"]
    assert by[5]["n_words"] == 60_000 and by[5]["n_repeat_words"] == 60_000 and by[5]["base_failed"]


def test_join_values(docs):
    out = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs).collect()), key=str)
    assert out.count((1, 3, 1)) == 2 and (None, 3, 1) in out and (2, 0, 2) in out and (None, 0, None) in out and (6, 1, 6) in out
    kept = ngram_join.representatives(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept if r["text"] == ROWS[0][1]) == ["1"]
    assert len(kept) == len(ROWS) - 2


def test_line_values(docs):
    out = {r["doc_id"]: r for r in line_dedup.deduplicate(docs).collect() if r["doc_id"] is not None}
    assert out[1]["_kept"] == ROWS[0][1] and out[7]["_kept"] == "last line of it here" and out[8]["_kept"] == "é ü 漢字\n漢字"
    assert out[2]["_kept"] is None and out[3]["_kept"] == "" and out[4]["_kept"] == " \n\t "
    left = line_dedup.cleaned(docs)
    assert left.columns == docs.columns and left.where("doc_id = 8").first()["n_chars"] == len("é ü 漢字\n漢字")


def test_mixture_values(docs):
    taken = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) < 1 for r in taken)
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    got = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(common.word_count(F.col("text"))).alias("n")).collect()}
    assert all(got.get(r["source"], 0) == r["t"] for r in taken)


def test_fingerprint_values(spark):
    alone = fingerprints.fingerprints(spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    same = fingerprints.fingerprints(spark.createDataFrame([(k, "a b c d e f g") for k in range(9)], "doc_id long, text string")).collect()
    assert len({r["fingerprint"] for r in same}) == 1 and all(r["near_next"] == 1.0 for r in same)


def test_license_values(spark):
    near = "Licensed under the Apache Licence, Version 2.0; CC BY cc-by CC BY"
    r = licenses.scan(spark.createDataFrame([(1, near), (2, None)], "doc_id long, text string"), ["doc_id"]).orderBy("doc_id").collect()
    assert r[0]["labels"] == "apache-2.0,cc-by" and r[0]["n_base"] == 3 and r[0]["spans"][0]["edits"] == 1
    assert r[1]["n_words"] == 0 and r[1]["labels"] == "" and r[1]["score"] == 0 and r[1]["first_word"] is None


@pytest.mark.parametrize(
    "text, label",
    [
        ("released under the terms of the bsd license", ""), ("released under the terms of the mit license", "mit"), ("Released under the term of the MIT licence", "mit"),
        ("Licensed under the Apache License, Version 1.1", ""), ("Licensed under the Apache License, Version 2.1", ""), ("licensd under the Apache License, Version 2.0", "apache-2.0"),
        ("under the terms of the GNU Lesser General Public License", "gpl,lgpl"), ("Redistribution and use in source and binary form", "bsd"), ("subject to the terms of the motorola public license", ""),
    ],
)
def test_telling_words(spark, text, label):
    r = licenses.scan(spark.createDataFrame([(1, f"some words. {text}; and more of them")], "doc_id long, text string"), ["doc_id"]).first()
    assert r["labels"] == label
    assert all(s["first_word"] >= 2 and s["last_word"] < r["n_words"] for s in r["spans"])


def test_many_licence_matches():
    """Time follows the text's length: a hundred times the matches may take some hundred times as long, not its square."""
    import time

    def took(n):
        folded, t = licenses.fold("cc by " * n), time.perf_counter()
        assert licenses.base_places(folded, b"cc by") == [2 * k for k in range(n)]
        return time.perf_counter() - t

    took(10)
    assert took(100_000) < 2
    assert licenses.base_places(licenses.fold("cc by cc by x cc cc by"), b"cc by") == [0, 2, 6]


def test_neighbours_of_large_ids(spark):
    """Above 2^53, with a null, repeated and negative ids: every next document is the right one."""
    ids = [None, -5, 3, *[(1 << 60) + k for k in range(40)], (1 << 63) - 1, (1 << 60) + 7]
    rows = [(i, f"text {k} " + "of some length " * 3) for k, i in enumerate(ids)]
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = []
    for k, (d, t) in enumerate(ordered):
        other = ordered[(k + 1) % len(ordered)][1]
        want.append((str(d), hashlib.sha256((t[: len(t) - len(t) // 3] + other[: len(t) // 3]).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in got) == sorted(want)


def test_toxicity_values():
    lexicon = toxicity.Lexicon({"idiot ": 4.0, "trash ": 4.0})
    assert lexicon.evidence("You 1d10t!")[1] == 1 and lexicon.evidence("іdiоt")[1] == 1  # the letters are Cyrillic
    assert lexicon.evidence("i\u200bd\u0301iot")[1] == 1 and lexicon.evidence("ＩＤＩＯＴ")[1] == 1
    assert lexicon.evidence("the trash can")[1] == 0 and lexicon.evidence("idiots")[1] == 0 and lexicon.evidence("")[0] == 0


def test_template_and_slots(spark):
    """Pages of one template without article, nav or telling classes: the template's texts go, and only by the template."""
    page = lambda k: f"<html><body class='has-sidebar'><div class=x1><p>Welcome to the site of all sites, read on</p><p>Home of the best news</p></div><div class=x2><h1>Title {k}</h1><p>Body number {k} with a text of its own, {'long and ' * (10 + k)} done.</p><p>Print this text</p></div><div class=x3>Copyright by the owner of the site</div></body></html>"
    rows = [(k, f"http://one.example/{k}", page(k)) for k in range(8)]
    want = {k: f"Title {k} Body number {k} with a text of its own, {'long and ' * (10 + k)}done." for k in range(8)}
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    assert all("Print this text" in html_extract.main_text(h) for *_, h in rows)  # a page alone doesn't tell


def test_two_templates_of_a_host(spark):
    """Each template is measured on its own pages, though neither is on half of the host's."""
    page = lambda k, c: f"<body><div class={c}a><p>Top line of kind {c} for all</p></div><div class={c}b><p>Own words {k} {'and more ' * (12 + k % 5)}</p><p>Shared line of kind {c}</p></div></body>"
    rows = [(k, f"http://two.example/{k}", page(k, "uvw"[k % 3])) for k in range(15)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == " ".join(f"Own words {k} {'and more ' * (12 + k % 5)}".split()) for k in range(15))


def test_marks_never_empty_a_page(spark):
    text = "The article's own words are here, as many as it takes."
    for html in (f"<body class='has-sidebar'><p>{text}</p></body>", f"<article class='post no-comments'><p>{text}</p></article>", f"<div class=search><div class=share><p>{text}</p></div></div>", f"<div id=related><h1>Head</h1><p>{text}</p></div>", f"<main class='notice'><p>{text}</p></main>"):
        assert text in html_extract.main_text(html), html
    assert html_extract.main_text(f"<article><p>{text}</p></article><div class=comments><article><p>I say so</p></article></div>") == text


def test_deep_and_long_pages():
    import time

    t = time.perf_counter()
    assert html_extract.main_text("<div>" * 5_000 + "deep" + "</div>" * 5_000) == "deep"
    assert len(html_extract.main_text("<p>word " * 50_000)) == 5 * 50_000 - 1
    assert time.perf_counter() - t < 20


def test_pages(spark):
    page = "<html><body><nav>menu</nav><header><p>top</p></header><main><article><h1>T &amp; t</h1><p>a <b>b</b>c<p>d\n e<aside>x</aside><div class='comments'>no</div><form>f</form></article></main><footer>z</footer><script>var a='<p>';</script></body></html>"
    soup = lambda k: f"<div class=wrap><div class=top>Same words on every page here</div><div class=body><p>Own text number {k} which is much longer than the rest of the page, by far and {'more ' * k}</p></div></div>"
    rows = [(1, HOST, page), (2, HOST, None), (3, None, ""), (4, HOST, "no tags at all"), (4, HOST, "no tags at all")] + [(10 + k, f"http://soup.example/{k}", soup(k + 30)) for k in range(5)]
    got = {}
    for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect():
        got[r["page_id"]] = r
    assert got[1]["text"] == "T & t a bc d e" and got[1]["n_chars"] == len("T & t a bc d e")
    assert got[2]["text"] == "" and got[3]["text"] == "" and got[4]["text"] == "no tags at all"
    assert all(got[10 + k]["text"].startswith("Own text") for k in range(5))
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 180)] + [(1, k) for k in range(2, 40)] + [(50, 50), (60, 61), (61, 60)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 100 for k in range(100, 181)) and all(got[k] == 1 for k in range(1, 40)) and got[61] == 60 and 50 not in got


def test_links_take_few_tables(spark, monkeypatch):
    """Each table that a turn or a round writes costs its stages' tasks, their events and files, at any size (F1)."""
    written, cut = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df: written.append(df) or cut(df))
    # stars: the links as they are, and no turn to find that nothing changes
    got = common.components(spark.createDataFrame([(k % 5, k) for k in range(5, 60)], "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {k: k % 5 for k in range(60)} and len(written) == 1
    # two numbers link if they are of one ten; bands 0 to 9 have two members, one each of tens k and k + 1
    marks = lambda nodes: nodes.select("node", F.lit(1).alias("size"), *[F.lit(0).cast("long").alias(f"w{i}") for i in range(common.WORDS)])
    alike = lambda pairs: pairs.where("a DIV 10 = b DIV 10")

    def linked(bands):
        written.clear()
        posts = spark.createDataFrame([(band, node, 1) for band, nodes in enumerate(bands) for node in nodes], "band long, node long, n long")
        ranked = common.ranked_in_bands(posts)
        return {(r["a"], r["b"]) for r in common.linked_in_bands(ranked, marks, alike, 75).collect()}, len(written)

    assert linked([[10 * k, 10 * k + j] for k in range(5) for j in (1, 2)]) == ({(10 * k, 10 * k + j) for k in range(5) for j in (1, 2)}, 3)
    # later rounds: a band of several tens, whose members meet hubs of the second round, and one of more than GROWTH, which needs a third
    found, n = linked([[0, 10, 11, 20, 21, 22]])
    assert found == {(10, 11), (20, 21), (20, 22), (21, 22)} and n == 8
    many = [10 * k for k in range(20)] + [10 * k + 1 for k in range(20)]
    found, n = linked([many, [*range(5)], [5, 7]])
    tied = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(sorted(found), "a long, b long")).collect()}
    assert all(tied[x] == tied[x - x % 10] for x in many) and tied[4] == tied[3] == tied[0] and tied[7] == 5 and n == 12


def test_pipeline(spark):
    import corpus_pipeline

    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mixing", "packing"]
    out = corpus_pipeline.run(spark, small)
    got = out.collect()
    assert {r["doc_id"] for r in got} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 1024


def test_templated_lines_between_strangers(spark):
    """Thousands of lines of one template: every two lines that share a band are compared, whatever the band's ends are."""
    import random

    rng = random.Random(8)
    template = [f"c{k:02d}ommon" for k in range(40)]
    rows = []
    for k in range(1500):
        own = [f"own{rng.randrange(10**6):06d}" for _ in range(9)]
        for edit in (own, [*own[:-1], f"own{rng.randrange(10**6):06d}"]):
            rows.append((len(rows), " ".join(template + edit)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = dict(line_dedup.alike(docs).collect())
    # the bands as alike makes them
    h = line_dedup.lines(docs).select("doc_id", "lid", F.explode(line_dedup.shingles(F.col("line"))).alias("h"))
    sig = h.groupBy("doc_id", "lid").agg(*[F.min(F.col("h").bitwiseXOR(F.lit(x))).alias(f"m{i}") for i, x in enumerate(line_dedup.ORDERS)]).collect()
    by = {r["doc_id"]: (r["lid"], [tuple(r[f"m{j}"] for j in x) for x in line_dedup.TRIPLES]) for r in sig}
    share = [(by[k][0], by[k + 1][0]) for k in range(0, len(rows), 2) if any(x == y for x, y in zip(by[k][1], by[k + 1][1]))]
    assert len(share) > 1400
    assert all(found.get(a, a) == found.get(b, b) for a, b in share)
    assert len({found.get(a, a) for a, _ in share}) == len(share)


def test_lines_without_blanks_are_compared(spark):
    """Near copies without blanks, of few words, or edited past a word's eighth character; surrogate pairs stay whole."""
    han = "".join(chr(0x4E00 + 37 * k % 5000) for k in range(80))
    url = "https://host.example/" + "/".join(f"part{k}" for k in range(20))
    short = "internationalisation of characterisations everywhere"
    face = "".join(chr(0x1F600 + 7 * k % 64) for k in range(60))
    rows = [(0, han), (1, han[:-1] + "x"), (2, url), (3, url + "?a=1"), (4, short), (5, short + "s"), (6, face), (7, face + "!"), (8, "tiny"), (9, "tiny!")]
    got = {r["doc_id"]: r["_kept_lines"] for r in line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: int(k % 2 == 0 or k == 9) for k in range(10)}
    n = spark.createDataFrame([(x,) for x in (face, "12345678", "1234567", "a\r\u2028b345678")], "x string").select(F.size(line_dedup.shingles(F.col("x")))).collect()
    assert [r[0] for r in n] == [53, 1, 0, 3]


def test_marks_are_whole_names_and_tokens():
    """Values of other attributes, words of compounds, and marks on body, article or headings exclude nothing."""
    page = '<body class="no-sidebar has-banner search"><article class="share"><h2 id="related-work">Related work</h2><h2 id="search">Search</h2><p title="the hidden truth">One <a href="/hidden-valley">valley</a></p><p data-class="ad" data-hidden="x">two</p>{}</article></body>'
    gone = '<p hidden>a</p><p class="big ad">b</p><div id=comments>c</div><p HIDDEN="">d</p><p aria-hidden="true">e</p><p style="display: none">f</p><div role="search">g</div>'
    assert html_extract.main_text(page.format(gone)) == "Related work Search One valley two"


def test_shingles_of_a_row_share_an_update(spark):
    """A long line makes a row for TOGETHER shingles, and as many of the last row count as the line has (F2)."""
    lines = [(k, "".join(chr(97 + (7 * i + i * i // 3) % 26) for i in range(7 + k))) for k in range(1, 14)]
    t = spark.createDataFrame(lines, "lid long, line string").select("lid", line_dedup.code_points(F.col("line")).alias("points"))
    s = line_dedup.signatures(t)
    assert {r["lid"]: r["n"] for r in s.collect()} == {k: k for k, _ in lines}
    assert line_dedup.TOGETHER == 4 and f"{line_dedup.TOGETHER * line_dedup.WIDE})" in s._jdf.queryExecution().optimizedPlan().toString().split("explode(sequence(")[1].split("\n")[0]


def test_line_signatures_and_likeness_by_plain_sets(spark):
    """Odd and even numbers of shingles, one alone, and lines that repeat theirs; a pair's shingles are hashed once for each line."""
    lines = ["x" * 8, "abcdefghi", "abcdefghij", "ab" * 30, "ab" * 30 + "c", "ab" * 300, "abcdefgh" * 9, "abcdefgh" * 9 + "0", "abcdefgh" * 9 + "012", "abcdefgh" * 9 + "0123", "漢字かな交じり文の行です" * 2]
    t = spark.createDataFrame(list(enumerate(lines)), "lid long, line string")
    hashes = {r["lid"]: r["h"] for r in t.select("lid", line_dedup.shingles(F.col("line")).alias("h")).collect()}
    got = line_dedup.signatures(t.select("lid", line_dedup.code_points(F.col("line")).alias("points"))).collect()
    assert {r["lid"]: [r["n"], *[r[f"m{i}"] for i in range(line_dedup.VALUES)]] for r in got} == {k: [len(h), *[min(x ^ y for x in h) for y in line_dedup.ORDERS]] for k, h in hashes.items()}
    pairs = [(a, b) for b in hashes for a in range(b)]
    linked = line_dedup.verified(spark.createDataFrame(pairs, "a long, b long"), t, 75)
    alike = lambda s, t: 100 * len(s & t) >= 75 * len(s | t)
    want = {(a, b) for a, b in pairs if alike({*hashes[a]}, {*hashes[b]})}
    assert {(r["a"], r["b"]) for r in linked.collect()} == want and 3 < len(want) < len(pairs)
    assert linked._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(") == 2


def test_blank_lines_and_lone_bands_cost_little(spark, monkeypatch):
    """Lines are trimmed from the left only, and bands of one member go before the order of members is made; the same lines and ranks (F1)."""
    blanks = ["", " ", "\t\x0b\f\r ", "\r", " x", "x ", "\xa0", "\u2028", " \u3000 ", "\x1c", "\x00"]
    found = line_dedup.lines(spark.createDataFrame([(1, "\n".join(blanks))], "doc_id long, text string"))
    assert {r["place"] for r in found.where("lid IS NULL").collect()} == {k for k, x in enumerate(blanks) if not x.strip(" \t\x0b\f\r")} == {0, 1, 2, 3}
    assert "trim(both" not in (plan := found._jdf.queryExecution().optimizedPlan().toString().lower()) and "ltrim(" in plan or "trim(leading" in plan

    cut, written = common.cut, []
    monkeypatch.setattr(common, "cut", lambda df: written.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    posts = [(band, node, node % 3) for band in range(9) for node in range(1, 1 + (band % 3) * band)] + [(100 + k, k, 1) for k in range(20)]
    ranked = common.ranked_in_bands(spark.createDataFrame(posts, "band long, node long, n long")).collect()
    want = set()
    for band in range(9):
        order = sorted((x for b, x, _ in posts if b == band), key=lambda x: (-(x % 3), x))
        want |= {(band, x, k, order[0]) for k, x in enumerate(order, 1) if len(order) > 1}
    assert {tuple(r) for r in ranked} == want and len(ranked) == len(want) > 20
    lone, ordered = written[0].split("Filter (members", 1)[1], written[0].split("Filter (members", 1)[0]
    assert "DESC" in ordered and "DESC" not in lone
