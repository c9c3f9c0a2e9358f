"""Main text of web pages by consensus of each host's pages.

Every page is parsed and its containers are scored; the best ones' generalised path (tags and classes
from the root, digits folded) is the page's vote. Votes are counted by host in Spark, and each page is
extracted again from all its containers on the winning path, or from its own best ones if it has none
there, or if plain text would be lost that stands where most pages with that vote have nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from hashlib import blake2b
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_map, materialize, only, table

#: Hosts up to which the winning paths are broadcast; more are joined by shuffle.
FEW_HOSTS = 20_000
#: Plain lines up to this length, and of this share of a page's plain text, may be left behind.
STUB, FEW = 40, 0.05

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile(r"""[>"']""")
#: A whole tag in which no other may begin, so a vain try ends at the next one.
_WHOLE = re.compile(r"""</?([a-zA-Z][^\s/><"']*+)[^<>"']*+(?:"[^<"]*+"[^<>"']*+|'[^<']*+'[^<>"']*+)*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup, and not text of the page.
RAW = frozenset("script style textarea title xmp noframes".split())
DROPPED = frozenset(
    "nav aside footer form noscript template iframe object button select svg math canvas dialog menu audio video map "
    "datalist".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol optgroup option p pre section summary table tbody td tfoot "
    "th thead tr ul caption head".split()
)
CONTAINERS = frozenset("html body main article section div td center blockquote table tbody tr header figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag that closes an open element of these tags, unless one of the others stands between them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert menu menubar form".split())
BOILERPLATE = frozenset(
    "ad ads adslot adbox advert adverts advertisement advertising sponsor sponsored promo promoted promotion dfp banner "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager topbar toolbar masthead header footer colophon "
    "copyright sidebar aside rail widget widgets related recommended recommendations trending popular cookie cookies "
    "consent gdpr notice notices notification popup modal overlay paywall newsletter subscribe subscription signup login "
    "comment comments commentlist disqus reply replies respond responses discussion share sharing social follow skip "
    "search form".split()
)
LAYOUT = frozenset("has with no without layout is js page wrap wrapper".split())


def _parts(name: str) -> list[str]:
    return [x.lower() for x in _PART.findall(name)]


def _unwanted(tag: str, attrs: dict[str, str]) -> bool:
    if tag in DROPPED or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if attrs.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    if tag in ("html", "body", "main", "article") or tag in HEADINGS:
        names = attrs.get("class", "").split() if tag == "article" else []
    else:
        names = (attrs.get("class", "") + " " + attrs.get("id", "")).split()
    for name in names:
        parts = [x for x in _parts(name) if not x.isdigit()]
        if parts and parts[0] not in LAYOUT and (parts[0] in BOILERPLATE or parts[-1] in BOILERPLATE):
            return True
    return False


def _step(tag: str, attrs: dict[str, str]) -> str:
    """One step of a generalised path: the tag and its classes, digits folded."""
    names = sorted({re.sub(r"\d+", "#", x) for x in attrs.get("class", "").split()})
    return ".".join((tag, *names)) if names else tag


class Markup:
    """Ends of tags and comments, found in one pass over the whole text whatever is broken in it."""

    def __init__(self, html: str):
        self.html, self.size = html, len(html)
        self.last = {c: html.rfind(c) for c in (">", '"', "'")}
        #: Once no end of a tag is found but within quotes, quotes hide no more ends.
        self.quotes = True

    def next(self, at: int) -> tuple[int, int, re.Match | None]:
        """Start and end of the next markup from ``at`` on, and the match of its name if it is a tag.

        What isn't closed is text, but for comments, which run to the end.
        """
        html, size = self.html, self.size
        start = html.find("<", at)
        while start >= 0:
            if self.quotes and (whole := _WHOLE.match(html, start)):
                return start, whole.end(), whole
            if html.startswith("<!--", start) or html.startswith("<![CDATA[", start):
                close = "-->" if html[start + 2] == "-" else "]]>"
                end = html.find(close, start + (4 if close == "-->" else 9))
                return start, end + 3 if end >= 0 else size, None
            if start < self.last[">"]:
                if html[start + 1] in "!?":
                    return start, html.index(">", start) + 1, None
                name = _TAG.match(html, start)
                if name:
                    return start, self._end(name.end()), name
            start = html.find("<", start + 1)
        return size, size, None

    def _end(self, at: int) -> int:
        """End of the tag whose name ends at ``at``."""
        first = at
        while self.quotes:
            m = _SPECIAL.search(self.html, at)
            if not m:
                self.quotes = False
            elif m[0] == ">":
                return m.end()
            elif m.start() == self.last[m[0]]:
                at = m.end()  # a quote that nothing closes is a character like others
            else:
                at = self.html.index(m[0], m.end()) + 1
        return self.html.index(">", first) + 1


class Page:
    """Blocks of text and the containers that hold them.

    ``containers``: (parent, path, tag), where a path is a digest of the steps from the root, so that deep
    pages don't hold long ones; ``blocks``: (container, text, characters in links, is a heading).
    """

    def __init__(self, html: str):
        self.containers: list[tuple[int, str, str]] = [(-1, "", "")]
        self.blocks: list[tuple[int, str, int, bool]] = []
        self._paths: dict[tuple[str, str], str] = {}
        self._parse(html)

    def _path(self, above: str, step: str) -> str:
        path = self._paths.get((above, step))
        if path is None:
            path = self._paths[above, step] = blake2b(f"{above}>{step}".encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
        return path

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, int, bool, bool]] = []  # tag, container, unwanted, within a site header
        opened: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag
        here, unwanted, header, links, heading = 0, False, False, 0, 0
        pieces: list[str] = []
        linked = 0

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = " ".join("".join(pieces).split())
                pieces.clear()
                if text:
                    self.blocks.append((here, text, min(linked, len(text)), heading > 0))
            linked = 0

        def restore() -> None:
            nonlocal here, unwanted, header
            _, here, unwanted, header = stack[-1] if stack else ("", 0, False, False)

        def pop_to(i: int) -> None:
            nonlocal links, heading
            if any(x[0] in BLOCKS for x in stack[i:]):
                flush()
            for x in stack[i:]:
                links -= x[0] == "a"
                heading -= x[0] in HEADINGS
                opened[x[0]].pop()
            del stack[i:]
            restore()

        def nearest(tags: Iterable[str]) -> int:
            return max((opened[t][-1] for t in tags if opened[t]), default=-1)

        def say(text: str) -> None:
            nonlocal linked
            if text and not unwanted and (not header or heading):
                pieces.append(unescape(text) if "&" in text else text)
                if links:
                    linked += len(text.strip())

        at, size, markup = 0, len(html), Markup(html)
        while at < size:
            start, end, name = markup.next(at)
            say(html[at:start])
            at = end
            if name is None:
                continue
            tag, inner = name[1].lower(), html[name.end(1) : end - 1]
            if html[start + 1] == "/":
                if opened[tag]:
                    pop_to(opened[tag][-1])
                elif tag in BLOCKS:
                    flush()
                continue
            if tag in VOID:
                if tag == "br":
                    say(" ")
                elif tag == "hr":
                    flush()
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else size
                continue
            if tag in BLOCKS:
                if opened["p"]:
                    pop_to(opened["p"][-1])
                if tag in CLOSES:
                    closed, walls = CLOSES[tag]
                    if (i := nearest(closed)) > nearest(walls):
                        pop_to(i)
                flush()
            if inner and not inner.isspace():
                attrs = {
                    a[1].lower(): unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(inner)
                }
            else:
                attrs = {}
            # A site's header goes; that of an article keeps its headings.
            bad = unwanted or tag in DROPPED or bool(attrs) and _unwanted(tag, attrs)
            if tag == "header" and not (opened["article"] or opened["main"]):
                bad = True
            inside = header or tag == "header"
            if tag in CONTAINERS and not bad:
                self.containers.append((here, self._path(self.containers[here][1], _step(tag, attrs)), tag))
                here = len(self.containers) - 1
            if tag not in BLOCKS and inner.endswith("/"):
                continue
            links += tag == "a"
            heading += tag in HEADINGS
            opened[tag].append(len(stack))
            stack.append((tag, here, bad, inside))
            unwanted, header = bad, inside
        flush()

    def weights(self) -> tuple[list[float], list[float]]:
        """For each container, of all that it holds: text weight, and that of what isn't a heading."""
        every, plain = [0.0] * len(self.containers), [0.0] * len(self.containers)
        for at, text, linked, heading in self.blocks:
            weight = len(text) if linked * 2 < len(text) else 0.1 * (len(text) - linked)
            every[at] += weight
            plain[at] += 0 if heading else weight
        for i in range(len(self.containers) - 1, 0, -1):
            every[self.containers[i][0]] += every[i]
            plain[self.containers[i][0]] += plain[i]
        return every, plain

    def within(self, chosen: list[int]) -> list[bool]:
        """For each container, whether it is or lies in one of the chosen."""
        held = [False] * len(self.containers)
        for i in chosen:
            held[i] = True
        for i, (parent, _, _) in enumerate(self.containers):
            held[i] = held[i] or parent >= 0 and held[parent]
        return held

    def outside(self, chosen: list[int]) -> list[tuple[str, int]]:
        """(path, length) of each block of plain text, no heading and not mostly links, outside the chosen."""
        held = self.within(chosen)
        return [(self.containers[at][1], len(text)) for at, text, linked, heading in self.blocks if not (held[at] or heading or linked * 2 >= len(text))]

    def best(self, share: float = 0.6) -> list[int]:
        """From the root down, all children of one path at a time, while they hold most of the text.

        What is left behind is more than headings, and is mostly links but for a few ``STUB`` lines.
        """
        every, plain = self.weights()
        below: dict[int, list[int]] = defaultdict(list)
        for i, (parent, _, _) in enumerate(self.containers):
            below[parent].append(i)
        # Of the plain text that each container holds itself and all that it holds: sum and longest line.
        own = [(0, 0)] * len(self.containers)
        for at, text, linked, heading in self.blocks:
            if not (heading or linked * 2 >= len(text)):
                own[at] = (own[at][0] + len(text), max(own[at][1], len(text)))
        held = list(own)
        for i in range(len(held) - 1, 0, -1):
            up = self.containers[i][0]
            held[up] = (held[up][0] + held[i][0], max(held[up][1], held[i][1]))
        at, left, longest = [0], 0, 0
        while self.containers[at[0]][2] != "article":
            alike: dict[str, list[int]] = {}
            for i in sorted(c for x in at for c in below.get(x, ())):
                alike.setdefault(self.containers[i][1], []).append(i)
            if not alike:
                break
            total = lambda of, chosen: sum(of[i] for i in chosen)
            children = max(alike.values(), key=lambda x: (total(every, x), -x[0]))
            most = total(every, children)
            if not most or most < share * total(every, at):
                break
            if total(plain, children) == total(plain, at) and most < total(every, at):
                break
            behind = [own[i] for i in at] + [held[i] for same in alike.values() if same is not children for i in same]
            left, longest = left + sum(n for n, _ in behind), max(longest, *(n for _, n in behind))
            if longest > STUB or left > FEW * plain[0]:
                break
            at = children
        return at

    def text(self, path: str | None, known: Iterable[str] = ()) -> str:
        """The text under all containers on the path, if they lose nothing; else under the best ones.

        Plain text outside them that stands on no ``known`` path is text that they would lose.
        """
        voted = [i for i, c in enumerate(self.containers) if c[1] == path] if path is not None else []
        lost = {p for p, _ in self.outside(voted)} - set(known) if voted else True
        held = self.within(self.best() if lost else voted)
        return "\n".join(text for at, text, _, _ in self.blocks if held[at])


HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url="url"):
    """Lower-case host; empty for a null url or one without a host."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), HOST, 1), F.lit("")))


def winning_paths(pages: DataFrame) -> DataFrame:
    """``host, path, known``: the path that most pages of a host vote for; the smallest digest among equals.

    ``known`` are the paths on which at least half of the pages with that vote have plain text outside
    it. Pages without text don't vote.
    """

    def make():
        def run(c):
            paths, left = [], []
            for html in c["html"]:
                page = Page(html or "")
                best = page.best()
                paths.append(page.containers[best[0]][1] if page.blocks else None)
                left.append(sorted({p for p, _ in page.outside(best)}))
            return {"host": c["host"], "path": paths, "left": left}

        return run

    voted = arrow_map(pages.select(host_of().alias("host"), "html"), make, "host string, path string, left array<string>")
    # A row without a left path is the vote itself.
    each = voted.where("path is not null").select("host", "path", F.explode(F.concat(F.array(F.lit(None).cast("string")), "left")).alias("left"))
    counts = materialize(each.groupBy("host", "path", "left").agg(F.count("*").alias("n")), "host-votes")
    best = counts.where("left is null").groupBy("host").agg(F.min_by(F.struct("path", F.col("n").alias("votes")), F.struct(-F.col("n"), "path")).alias("w"))
    best = best.select("host", "w.path", "w.votes")
    often = counts.where("left is not null").join(best, ["host", "path"]).where("2 * n >= votes").groupBy("host").agg(F.sort_array(F.collect_list("left")).alias("known"))
    return best.join(often, "host", "left").select("host", "path", F.coalesce("known", F.array().cast("array<string>")).alias("known"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` for every row of ``pages`` (``page_id, url, html``).

    Null html counts as empty and gives empty text. Pages with null urls or urls without a host vote
    together. Rows stay one to one, repeated rows included; extra columns are left out.

    Broken markup costs no more than whole markup: time and memory follow the page's length. A tag that is
    never closed is text, an open comment runs to the end, a quote that nothing closes hides nothing, an
    end tag that nothing opened only ends a block, and elements may be nested as deep as a page has them.
    """
    pages = only(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    winners = materialize(winning_paths(pages), "host-paths").withColumnRenamed("host", "won_by")
    if winners.limit(FEW_HOSTS + 1).count() <= FEW_HOSTS:
        winners = F.broadcast(winners)
    both = pages.withColumn("host", host_of()).join(winners, F.col("host") == F.col("won_by"), "left")

    def make():
        def run(c):
            text = [Page(h or "").text(p, k or ()) for h, p, k in zip(c["html"], c["path"], c["known"], strict=True)]
            return {"page_id": c["page_id"], "url": c["url"], "text": text}

        return run

    return arrow_map(both.select("page_id", "url", "html", "path", "known"), make, "page_id bigint, url string, text string")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))
