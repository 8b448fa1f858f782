"""Main text of web pages by equivalence-class template deduction (operator 8)."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, texts_of

#: Elements whose text is never main text, and those that end a block.
NEVER = set("head title nav footer aside form script style noscript template iframe object svg math canvas button select option textarea input label dialog menu audio video".split())
BLOCKS = set("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the left closes an open element of the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Whole tokens of class or id, and roles, that mark what isn't main text; elements that no class or id excludes.
MARKS = set("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer dsq disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: Of these the ones that mark an element also as one word of a longer token: ``comment-list``, ``user_comment``, ``adSlot``.
PARTS = set("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer masthead nav navbar newsletter pagination popup promo sidebar social sponsor sponsored subscribe".split())
UNMARKED = set("html body article main h1 h2 h3 h4 h5 h6".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: A class is on so many pages of the host at least; texts alone also on this share of the pages that have the element around them.
LEAST_PAGES, LEAST_SHARE = 3, 0.5
#: The slot with the main text holds this share of the text of the pages that have it; one that is named article or main, this.
SLOT_SHARE, NAMED_SHARE = 0.8, 0.3
#: An element that its class or id marks is main text after all if it holds this share of the page's text, or a main heading.
OVERRULED = 0.9
#: Template texts inside the main slot go if at least this share of the slot's text is left on the page.
LEAST_LEFT = 0.5
INLINE = set("a abbr b bdi bdo cite code em font i kbd mark q s samp small span strike strong sub sup tt u var".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[/!?]?[a-z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|<[/!?]?[a-z][^>]*>?|<!\[CDATA\[.*?(?:\]\]>|\Z)|[^<]+|<", re.S | re.I)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


def attributes(attrs: str) -> dict[str, str]:
    """Name (in lower case) to value of a start tag's attributes; of a repeated name the first counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTR.findall(attrs) if attrs else ():
        out.setdefault(name.lower(), "".join(values))
    return out


_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _never(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether an element can't be main text, by its tag, role or by being hidden; ``inside``: in an article or main."""
    if tag in NEVER or tag == "header" and not inside:
        return True
    if not attrs:
        return False
    return attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(_UNSEEN.search(attrs.get("style", "").lower()))


_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _marked(tag: str, attrs: dict[str, str]) -> bool:
    if not attrs or tag in UNMARKED:
        return False
    for token in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        if token.lower() in MARKS or any(x.lower() in PARTS for x in _PART.findall(token)):
            return True
    return False


class Page:
    """A page's elements in document order and its blocks of text.

    Element 0 stands for the document. Of each element: parent (an element), path (64-bit hash of the tags and first
    classes from the root down), tag, depth, named (the path of the innermost article or main that holds it, itself
    included, or None). A block is (element, text). Hashed paths keep deep pages linear.
    """

    def __init__(self, page: str):
        self.parent, self.path, self.tag, self.depth, self.named = [0], [0], [""], [0], [None]
        self.blocks: list[tuple[int, str]] = []
        self._parse(page)

    def _parse(self, page: str) -> None:
        import xxhash

        stack, buffer = [0], []
        # hard: an element that can't be main text; marked: the outermost element that a class or id excludes
        hard, marked, heads = [False], [None], set()

        def flush() -> None:
            if buffer:
                at = stack[-1]
                if not hard[at] and (text := " ".join("".join(buffer).split())):
                    self.blocks.append((at, text))
                buffer.clear()

        def close(k: int) -> None:
            del stack[k:]

        for m in _TOKEN.finditer(page):
            t = m[0]
            if t[0] != "<" or len(t) == 1:
                buffer.append(entities.unescape(t))
                continue
            if m[1] or t[1] in "!?":
                if m[1]:
                    buffer.append(" ")
                continue
            name = _NAME.match(t)[1].lower()
            if t[1] == "/":
                k = next((i for i in range(len(stack) - 1, 0, -1) if self.tag[stack[i]] == name), None)
                if k is None:
                    if name in BLOCKS:
                        flush()
                    continue
                if any(self.tag[e] in BLOCKS or hard[e] != hard[self.parent[e]] or marked[e] != marked[self.parent[e]] for e in stack[k:]):
                    flush()
                close(k)
                continue
            if name in BLOCKS:
                flush()
                closing = CLOSES.get(name, set()) | {"p"}
                for i in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[i]] in closing:
                        close(i)
                        break
                    if self.tag[stack[i]] in BLOCKS:
                        break
            if name in VOID or t.endswith("/>") and name not in BLOCKS:
                continue
            attrs = attributes(t[1 + len(name) : -1])
            up, e = stack[-1], len(self.parent)
            bad = hard[up] or _never(name, attrs, self.named[up] is not None)
            soft = marked[up] if marked[up] is not None else e if _marked(name, attrs) else None
            if bad != hard[up] or soft != marked[up]:
                flush()
            if name == "h1" and soft is not None:
                heads.add(soft)
            kind = attrs.get("class", "").split()[:1]
            self.parent.append(up), self.tag.append(name), self.depth.append(self.depth[up] + 1)
            self.path.append(xxhash.xxh64_intdigest(f"{self.path[up]}/{name}.{'.'.join(kind)}") >> 1)
            self.named.append(self.path[e] if name in ("article", "main") else self.named[up])
            hard.append(bad), marked.append(soft)
            stack.append(e)
        flush()
        held, total = {}, 0
        for e, text in self.blocks:
            total += len(text)
            if marked[e] is not None:
                held[marked[e]] = held.get(marked[e], 0) + len(text)
        out = {e for e, n in held.items() if e not in heads and n < OVERRULED * total}
        self.blocks = [(e, text) for e, text in self.blocks if marked[e] not in out]

    def sizes(self) -> list[int]:
        """For each element the length of the texts that it holds."""
        n = [0] * len(self.parent)
        for e, text in self.blocks:
            n[e] += len(text)
        for e in range(len(n) - 1, 0, -1):
            n[self.parent[e]] += n[e]
        return n

    def inside(self, path: int) -> list[bool]:
        """Which elements are one of the path or in one."""
        out = [self.path[0] == path]
        for e in range(1, len(self.parent)):
            out.append(out[self.parent[e]] or self.path[e] == path)
        return out


def text_token(path: int, text: str) -> int:
    """Name of a text in an element of a path."""
    import xxhash

    return xxhash.xxh64_intdigest(f"{path} {text}") >> 1


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct token of a page: host, kind (element, text), token, parent, depth, tag, named, occurrences,
    a hash of page and occurrences, text size, the page's text size."""
    import xxhash

    for b in batches:
        out: list[list] = [[] for _ in range(11)]
        for key, url, host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), texts_of(b.column(3))):
            page = Page(html)
            sizes = page.sizes()
            tokens: dict[tuple[str, int], list] = {}
            for e in range(1, len(sizes)):
                if sizes[e]:
                    t = tokens.setdefault(("element", page.path[e]), [page.path[page.parent[e]], page.depth[e], page.tag[e], page.named[e], 0, 0])
                    t[4] += 1
                    t[5] += sizes[e]
            for e, text in page.blocks:
                t = tokens.setdefault(("text", text_token(page.path[e], text)), [page.path[e], page.depth[e], "", page.named[e], 0, 0])
                t[4] += 1
                t[5] += len(text)
            for (kind, token), (parent, depth, tag, named, n, size) in tokens.items():
                for column, v in zip(out, (host, kind, token, parent, depth, tag, named, n, xxhash.xxh64_intdigest(f"{key}|{url}|{n}") >> 33, size, sizes[0])):
                    column.append(v)
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["host", "kind", "token", "parent", "depth", "tag", "named", "n", "h", "size", "total"])


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; none: empty."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)", 1))


def templates(pages: DataFrame) -> DataFrame:
    """(host, slots, texts): for each host the slots that may hold the main text, best first, and the template's own texts.

    Tokens are element paths and texts in their element. A token's occurrence vector over the host's pages is held as the
    sum of hashes of (page, occurrences), so vectors are summed before the shuffle and a hot host costs a row for each
    token and task. Tokens with equal vectors are an equivalence class. Classes nest by their elements: a class stands in
    the one of its outermost token's parent. A class is valid if it is on enough pages and has an element, or else, being
    texts alone, if it is on enough of the pages of the element around it: texts that some pages happen to share are no
    part of the template, and each template of a host is measured on its own pages. An element of a valid class that
    is once on each of its pages opens a slot. Slots hold what varies, the texts of valid classes are the template's own.
    The main text's slot is the innermost one that holds most of the text of its pages.
    """
    tokens = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    tokens = tokens.mapInArrow(_tokens, "host string, kind string, token long, parent long, depth int, tag string, named long, n long, h long, size long, total long")
    first = [F.min(c).alias(c) for c in ("parent", "depth", "tag", "named")]
    by = tokens.groupBy("host", "kind", "token").agg(*first, F.count("*").alias("pages"), F.sum("n").alias("n"), F.sum("h").alias("vector"), F.sum("size").alias("size"), F.sum("total").alias("total"))
    by = cut(by.where(F.col("pages") >= LEAST_PAGES))
    classes = by.groupBy("host", "vector", "pages").agg(F.bool_or(F.col("kind") == "element").alias("structural"), F.min(F.struct("depth", "parent"))["parent"].alias("around"))
    around = by.where("kind = 'element'").select("host", F.col("token").alias("around"), F.col("pages").alias("pages_around"))
    valid = classes.join(around.hint("merge"), ["host", "around"], "left").where(F.col("structural") | (F.col("pages") >= LEAST_SHARE * F.col("pages_around")))
    inside = by.join(valid.select("host", "vector", "pages").hint("merge"), ["host", "vector", "pages"], "left_semi")
    named = F.col("tag").isin("article", "main")
    opens = (F.col("kind") == "element") & (F.col("n") == F.col("pages")) & ~F.col("tag").isin(*sorted(INLINE), "p", "html") & (F.col("size") >= F.when(named, NAMED_SHARE).otherwise(SLOT_SHARE) * F.col("total"))
    slot = F.struct(named.alias("is_named"), "depth", F.col("token").alias("path"), F.coalesce("named", "token").alias("use"))
    of = inside.groupBy("host").agg(F.collect_list(F.when(opens, slot)).alias("slots"), F.collect_list(F.when(F.col("kind") == "text", F.col("token"))).alias("texts"))
    return of.select("host", F.transform(F.sort_array("slots", False), lambda s: F.struct(s["path"].alias("path"), s["use"].alias("use"))).alias("slots"), "texts")


def main_text(html: str, slots: list[tuple[int, int]] = (), texts: set[int] = frozenset()) -> str:
    """The text of the page's best slot without the template's own texts; of a page without any of the slots, the text of
    the element that the page alone suggests by the same measure."""
    page = Page(html)
    sizes = page.sizes()
    there = {p for p, n in zip(page.path, sizes) if n}
    use = next((u for p, u in slots if p in there), None)
    if use is None:
        share = lambda e: NAMED_SHARE if page.tag[e] in ("article", "main") else SLOT_SHARE
        own = [e for e in range(1, len(sizes)) if sizes[e] and sizes[e] >= share(e) * sizes[0] and page.tag[e] not in INLINE and page.tag[e] != "p"]
        best = max(own, key=lambda e: (page.tag[e] in ("article", "main"), page.depth[e], sizes[e], -e), default=0)
        use = page.named[best] or page.path[best]
    held = page.inside(use)
    whole = [(e, t) for e, t in page.blocks if held[e]]
    kept = [t for e, t in whole if text_token(page.path[e], t) not in texts] if texts else [t for _, t in whole]
    if sum(map(len, kept)) < LEAST_LEFT * sum(len(t) for _, t in whole):
        kept = [t for _, t in whole]
    return " ".join(kept)


#: Pages of a group that meets its host's template at once, at most on average.
GROUP = 500


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every page.

    A host's pages are dealt to groups by hash, so many that no group has more than some hundred even if all pages are
    of one host; each group meets the template once, in one task. Null or empty html: empty text. Null urls form a host
    of their own. Repeated rows are pages of their own with equal texts. Other columns have no effect. A host with few
    pages has no template; its pages are read by themselves.
    """
    found = cut(templates(pages))
    src = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    groups = F.lit(-(-max(1, src.count()) // GROUP))
    src = src.withColumn("part", F.pmod(F.xxhash64("page_id", "url", "html"), groups))
    told = src.select(F.col("host").alias("of"), F.col("part").alias("of_part")).distinct().join(found.withColumnRenamed("host", "of").hint("merge"), "of")
    kind = src.schema["page_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = ((), frozenset())
        if right.num_rows:
            known = [(s["path"], s["use"]) for s in right["slots"][0].as_py() or ()], frozenset(right["texts"][0].as_py() or ())
        out = [main_text(html, *known) for html in texts_of(left["html"].combine_chunks())]
        return pa.table([left["page_id"], left["url"], pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return src.groupBy("host", "part").cogroup(told.groupBy("of", "of_part")).applyInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
