"""Main text of web pages by consensus paths of their hosts.

Every page scores its containers by the characters of the article that they hold. Scores are votes for the
container's generalised tag-class path, summed over a host in Spark. Pages are then extracted again with
the path that won on their host, or with their own best container if they lack it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spread_join

#: Hosts' paths are sent to all tasks up to this size, otherwise pages meet them in a join.
BROADCAST_BYTES = 64 << 20
#: The share of a host's text that a path must hold to be the article as a whole, and that an <article> must hold.
WHOLE, ARTICLE = 1.0, 0.5

#: A quote opens a value only after "=", so one elsewhere (title=it's) doesn't swallow what follows.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?""")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in "script style title textarea iframe noembed noframes xmp".split()}
BLOCK = set(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main nav ol option p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
#: What may be the root of an article; lists, tables and quotations are parts of one.
CONTAINER = set("article center div main section td".split())
SKIPPED = set("nav footer aside button menu dialog input head noscript template svg math object select canvas video audio search".split())
#: Words of class and id names that mark what is not the article.
BOILERPLATE = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner banners sponsor sponsored sponsors promo promos promotion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay sidebar sidebars aside menu menus nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager share sharing social comment comments commentlist disqus reply replies respond footer "
    "masthead newsletter subscribe subscription signup login related recommended recommendations widget widgets toolbar adsbygoogle".split()
)
#: Words that may stand beside those in the name of an element that is nothing else.
NEUTRAL = set(
    "area article articles author bar block body bottom box button buttons column container content entry form group inner item items left link links list media meta post posts right "
    "section slot stories story text thread top unit wrap wrapper".split()
)
#: Elements of running text: a name that says anything else of them speaks of their subject (id="related-work").
TEXTUAL = set("article blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 li p pre section table tbody td th tr".split())
ROLES = {"navigation", "banner", "complementary", "contentinfo", "search"}
KEEPS = re.compile(r"(?:no|without|has|with)[-_]?(?:ads?|sidebars?|nav|comments?)|comments?[-_](?:open|closed)", re.I)
#: For a start tag: the open elements that it ends, and those in which it looks no further up.
_TABLE_PARTS = ("tbody", "thead", "tfoot")
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr", "td", "th"), (*_TABLE_PARTS, "table")),
    **{t: ((*_TABLE_PARTS, "tr", "td", "th"), ("table",)) for t in _TABLE_PARTS},
}
TABLE = set("table caption tbody thead tfoot tr td th".split())
P_ENDS = (("p",), ("td", "th", "table", "button", "li", "dd", "dt"))
ROOT = 0


def _names(attributes: str) -> tuple[list[str], bool]:
    """(words of class, id and role; whether the element is hidden)"""
    words, hidden = [], False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style":
            hidden |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
        elif name in ("class", "id", "role"):
            words += [name[0] + w for w in value.split()]
    return words, hidden


def _is_boilerplate(words: list[str], strict: bool) -> bool:
    """Whether an element's names mark it as no part of the article: its id, its role and its first class by any
    of their parts, further classes (if ``strict``, all names) if they say nothing else."""
    for i, w in enumerate(words):
        if w[0] == "r" and w[1:].lower() in ROLES:
            return True
        parts = [p for p in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", KEEPS.sub("", w[1:])).lower()) if p]
        later = strict or w[0] == "c" and any(x[0] == "c" for x in words[:i])
        if not BOILERPLATE.isdisjoint(parts) and (not later or all(p in BOILERPLATE or p in NEUTRAL for p in parts)):
            return True
    return False


def _step(tag: str, words: list[str]) -> str:
    """A generalised step of a path: the tag with its first class, numbers and generated parts left out."""
    for w in words:
        if w[0] == "c":
            name = re.sub(r"\d+", "#", w[1:].lower())
            if name.count("#") < 2:
                return f"{tag}.{name}"
    return tag


class Page:
    """The elements that matter of a page and its runs of text, by one pass in linear time.

    ``runs`` are (node, text) in page order; a node of -1 is the end or beginning of a block. Nodes are
    numbered from the root, 0; a node's parent has a smaller number.
    """

    def __init__(self, page: str | None) -> None:
        self.tag, self.parent, self.path, self.kind, self.link = [""], [-1], [ROOT], [0], [False]
        self.runs: list[tuple[int, str]] = []
        self._open: list[int] = [0]
        self._at: dict[str, list[int]] = {}  # places of open elements in self._open
        self._read(page or "")
        self._settle()

    def _read(self, text: str) -> None:
        at = done = 0
        while (at := text.find("<", at)) >= 0:
            c = text[at + 1 : at + 2]
            letter = c.isascii() and c.isalpha()
            if c == "!" or c == "?":
                if text.startswith("<!--", at):
                    end = text.find("-->", at + 2 if text.startswith("<!-->", at) else at + 4)
                    end = end + 3 if end >= 0 else -1
                elif text.startswith("<![CDATA[", at):
                    end = text.find("]]>", at)
                    end = end + 3 if end >= 0 else -1
                else:
                    end = text.find(">", at) + 1 or -1
                self._text(text[done:at])
                if end < 0:
                    return
                at = done = end
                continue
            m = TAG.match(text, at) if c == "/" or letter else None
            if m is None:
                if letter and text.find(">", at) < 0:  # a tag that the page's end cuts off
                    break
                at += 1
                continue
            self._text(text[done:at])
            tag, at = m[2].lower(), m.end()
            if m[1]:
                self._end(tag)
            else:
                self._start(tag, m[3])
                if tag in RAW:
                    if (end := RAW[tag].search(text, at)) is not None:
                        at = end.end()
                    elif not m[3].endswith("/"):
                        return
            done = at
        else:
            at = len(text)
        self._text(text[done:at])

    def _text(self, text: str) -> None:
        if text:
            self.runs.append((self._open[-1], text))

    def _break(self) -> None:
        if self.runs and self.runs[-1][0] >= 0:
            self.runs.append((-1, ""))

    def _pop_to(self, place: int) -> None:
        while len(self._open) > place:
            self._at[self.tag[self._open.pop()]].pop()

    def _last(self, tags) -> int:
        return max((at[-1] for t in tags if (at := self._at.get(t))), default=0)

    def _end(self, tag: str) -> None:
        if places := self._at.get(tag):
            scope = ("table",) if tag in TABLE else ("td", "th", "caption") if tag in BLOCK or tag in SKIPPED else CONTAINER
            if places[-1] >= self._last(scope):
                self._pop_to(places[-1])
        if tag in BLOCK:
            self._break()

    def _start(self, tag: str, attributes: str) -> None:
        block = tag in BLOCK
        for ends, scopes in filter(None, (ENDS.get(tag), P_ENDS if block and tag != "br" else None)):
            low = self._last(scopes)
            place = min((p for t in ends for p in self._at.get(t, ())[-1:] if p > low), default=0)
            if place:
                self._pop_to(place)
        if block:
            self._break()
        if tag in VOID or tag in RAW or attributes.endswith("/") and tag not in BLOCK:
            return
        words, hidden = _names(attributes) if attributes else ([], False)
        up = self._open[-1]
        inside = self.kind[up]
        kind = inside & 3  # 1: never part of the article; 2: inside an <article>; 4: only its names speak against it
        if tag in SKIPPED or hidden or tag == "header" and not inside & 2:
            kind |= 1
        elif tag == "form" or words and tag not in ("body", "html", "main") and _is_boilerplate(words, bool(inside & 2) or tag in TEXTUAL):
            kind |= 4
        if not (block or tag == "a" or kind & 5 and not inside & 1 or self._at.get(tag)):
            return  # an inline element changes nothing
        if tag in ("article", "main") and not kind & 5:
            kind |= 2
        if tag == "a" and self.link[up]:
            return
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(up)
        step = _step(tag, words)
        self.path.append(xxhash.xxh3_64_intdigest(step.encode("utf-8", "surrogatepass"), self.path[up]) if tag in CONTAINER else self.path[up])
        self.kind.append(kind)
        self.link.append(self.link[up] or tag == "a")
        self._at.setdefault(tag, []).append(len(self._open))
        self._open.append(node)

    def _settle(self) -> None:
        """skipped: elements that are no part of the article. One that only its names speak against stays if
        it holds an <article> or <main> that nothing speaks against."""
        n = len(self.tag)
        holds = [self.tag[i] in ("article", "main") and not self.kind[i] & 5 for i in range(n)]
        for i in range(n - 1, 0, -1):
            if holds[i]:
                holds[self.parent[i]] = True
        self.skipped = [False] * n
        for heed in (5, 1):  # names that speak against all that the page has are not heeded
            for i in range(1, n):
                k = self.kind[i] & heed
                self.skipped[i] = self.skipped[self.parent[i]] or bool(k & 1) or bool(k & 4) and not holds[i]
            if any(i >= 0 and not self.skipped[i] and text.strip() for i, text in self.runs):
                break

    def scores(self, links: bool = False) -> dict[int, list]:
        """Path of each container: [characters that it holds, of these in no smaller container, depth, tag, path above]."""
        n = len(self.tag)
        size, own = [0] * n, [0] * n
        near, depth = [0] * n, [0] * n  # the nearest container, and how many are around it
        for i in range(1, n):
            up = near[self.parent[i]]
            near[i], depth[i] = (i, depth[up] + 1) if self.tag[i] in CONTAINER else (up, depth[up])
        for i, text in self.runs:
            if i >= 0 and not self.skipped[i] and (links or not self.link[i]):
                own[near[i]] += len(text) - sum(map(text.count, " \n\t\r"))
        for i in range(n - 1, -1, -1):
            size[i] += own[i]
            if i and near[i] == i:
                size[near[self.parent[i]]] += size[i]
        out: dict[int, list] = {}
        for i in range(n):
            if near[i] == i and size[i]:
                got = out.get(self.path[i])
                if got is None:
                    out[self.path[i]] = got = [0, 0, depth[i], self.tag[i], self.path[near[self.parent[i]]] if i else ROOT]
                got[0] += size[i]
                got[1] += own[i]
        return out

    def text(self, path: int | None) -> str:
        """The text in containers of the path, blocks joined by one space."""
        n = len(self.tag)
        inside = [False] * n
        for i in range(n):
            inside[i] = self.path[i] == path or i > 0 and inside[self.parent[i]]
        out = []
        for i, text in self.runs:
            if i < 0:
                out.append(" ")
            elif inside[i] and not self.skipped[i]:
                out.append(html.unescape(text) if "&" in text else text)
        return " ".join("".join(out).split())

    def best(self) -> int | None:
        """The path of the page's own article; None if it has no text."""
        score = self.scores() or self.scores(links=True)
        return pick([(s[2], p, s[3], s[0], s[1]) for p, s in score.items()], score[ROOT][0]) if score else None


def pick(paths, total: int) -> int:
    """The path of the article, of rows (depth, path, tag, characters, of these in no smaller container).

    An <article>, else a <main>, with half of the text is it. Otherwise it is the innermost path that holds
    all of it, or the one around it if that has text of its own (a heading over sections, say).
    """
    rows = sorted((tuple(r) for r in paths), key=lambda r: (r[0], r[1]))
    for tag in ("article", "main"):
        if named := [r for r in rows if r[2] == tag and r[3] >= ARTICLE * total]:
            return max(named, key=lambda r: (r[3], -r[0], r[1]))[1]
    chain = [r for r in rows if r[3] >= WHOLE * total]
    at = len(chain) - 1
    while at > 0 and chain[at - 1][4] > 0 and chain[at - 1][2]:
        at -= 1
    return chain[at][1]


def extract(page: str | None, path: int | None = None) -> str:
    """The text inside containers of the path; of the page's best container if there is none."""
    read = Page(page)
    found = read.text(path) if path is not None else ""
    if not found and (own := read.best()) is not None:
        found = read.text(own)
    return found


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


VOTES = "host string, path long, depth int, tag string, votes long, own long"


def vote(pages: DataFrame, *, url: str = "url", page: str = "html") -> DataFrame:
    """(host, path): the path that wins on each host.

    A page gives each of its containers' paths as many votes as it holds characters of running text. Only
    paths with ARTICLE of a host's votes are compared; since any two of those share text, they lie within
    each other, and a host has no more of them than its pages are deep.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, int], list] = {}
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for path, (size, own, depth, tag, _) in Page(t.as_py()).scores().items():
                    v = votes.setdefault((h, path), [depth, tag, 0, 0])
                    v[2] += size
                    v[3] += own
            if votes:
                rows = [(h, p - (p >> 63 << 64), *v) for (h, p), v in votes.items()]
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["host", "path", "depth", "tag", "votes", "own"])

    counted = pages.select(host_of(F.col(url)).alias("host"), F.col(page).cast("string").alias("page")).mapInArrow(run, VOTES)
    counted = counted.groupBy("host", "path").agg(*[f(c).alias(c) for f, c in ((F.min, "depth"), (F.min, "tag"), (F.sum, "votes"), (F.sum, "own"))])
    counted = Scratch(pages.sparkSession, "votes").save(counted, "votes")
    total = counted.where(F.col("path") == ROOT).select("host", F.col("votes").alias("total"))
    leading = counted.join(total, "host").where(F.col("votes") >= F.least(F.lit(ARTICLE), F.lit(WHOLE)) * F.col("total"))
    rows = F.collect_list(F.struct("depth", "path", "tag", "votes", "own"))
    chains = leading.groupBy("host").agg(rows.alias("rows"), F.first("total").alias("total"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [pick([tuple(r.values()) for r in rows], n) for rows, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.int64())], ["host", "path"])

    return chains.mapInArrow(chosen, "host string, path long")


def extract_pages(pages: DataFrame, *, url: str = "url", page: str = "html") -> DataFrame:
    """pages (without the html) with host, text and n_chars, one row for each row.

    Null and empty pages and pages without text give an empty text; pages with a null url or without a host
    vote among themselves. Pages are read whole, in time proportional to their length whatever their depth.
    Repeated rows vote and are returned as often as they occur. Of paths with equally many votes the outer one
    wins. An empty table gives an empty one. Other columns pass through; those named host, text or n_chars (in
    any case) are replaced. The html is shuffled only if the hosts' paths are too large to send to every
    task; a host with many pages is then dealt to several tasks.
    """
    scratch = Scratch(pages.sparkSession, "html")
    paths = scratch.save(vote(pages, url=url, page=page), "paths").toDF("__host", "__path")
    size = paths.agg(F.sum(F.length("__host") + 80)).first()[0] or 0
    named = pages.withColumn("__host", host_of(F.col(url)))
    if size <= BROADCAST_BYTES:
        joined = named.join(F.broadcast(paths), "__host", "left")
    else:
        joined = spread_join(named, paths, "__host", by=[page])

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, wanted in batches:
            yield pd.Series([extract(t, None if pd.isna(w) else int(w) & (1 << 64) - 1) for t, w in zip(texts, wanted, strict=True)], dtype=object)

    own = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in (page.lower(), "host", "text", "n_chars")]
    out = joined.select(*own, F.col("__host").alias("host"), run(F.col(page).cast("string"), "__path").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
