"""Main text of web pages by consensus paths of their hosts.

1. Each page is parsed leniently; text outside boilerplate (by tag, role or class) scores the containers above it,
   less what stands in links. A page votes for its best VOTES containers by their generalised paths: tags and
   classes from the root, digits replaced. It also reports the texts of suspects: blocks whose class has a weak word of
   boilerplate among others (social-history, widget-theory), which are not scored.
2. Votes are summed by host and path in Spark; a host's path of most votes wins (ties: the first by code point), and
   texts of suspects that two of its pages report are boilerplate. Winners are broadcast if they are at most
   BROADCAST_HOSTS of BROADCAST_BYTES, else joined by host.
3. Pages are read again: the containers at the winning path give the text, widened to the article or main above them and to
   the block that several of them share; a page without that path gives its own best container, and one without
   containers everything outside boilerplate. A suspect inside is text if it has SENTENCE words, stands mostly outside
   links and isn't repeated on the host.

A block's text is decoded, its white space turned into single spaces and trimmed; blocks stand in page order, one
a line. Null and empty pages give an empty text. A null address is a host of its own. Repeated rows each get their
row, and vote as one page; other columns are ignored, whatever their names. Parsing takes time in proportion to the page.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

VOTES = 3
BROADCAST_HOSTS, BROADCAST_BYTES = 100_000, 32 << 20
#: Words that a suspect must have to be text, and characters of a path that are spelled out behind its hash.
SENTENCE, SPELLED = 12, 200
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"""|<(/?)([A-Za-z][A-Za-z0-9:_-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:_-]*)([^>]*)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-A-Za-z0-9_:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea xmp noframes title svg".split())
CONTAINERS = frozenset("article main section div td body blockquote".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span"
    " strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder"
    " mstyle mfenced semantics annotation object canvas".split()
)
BOILER_TAGS = frozenset("nav footer aside form button select menu dialog head".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu form".split())
#: Words of class names: boilerplate wherever they begin or end a name, and only if all of a name is of such words.
STRONG_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo sidebar nav navbar navigation footer"
    " masthead cookie cookies consent gdpr newsletter disqus breadcrumb breadcrumbs pagination pager toolbar comments".split()
)
WEAK_WORDS = frozenset(
    "promotion menu header notice notices banner subscribe subscription signup login comment respond replies share sharing"
    " social related recommended popup modal overlay widget skip".split()
)
#: Blocks that hold a sentence or a cell are not judged by a part of their class.
_WHOLE_ONLY = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figure figcaption table ul ol dl".split()) | INLINE
_CLOSES = {
    "li": ("li", frozenset("ul ol menu".split())), "dt": ("dd dt", frozenset(["dl"])), "dd": ("dd dt", frozenset(["dl"])),
    "tr": ("tr td th", frozenset(["table"])), "td": ("td th", frozenset("tr table".split())),
    "th": ("td th", frozenset("tr table".split())), "option": ("option", frozenset(["select"])),
}
_CLOSES = {tag: (tuple(names.split()), bounds) for tag, (names, bounds) in _CLOSES.items()}
_SCOPE = CONTAINERS | frozenset("table tr th ul ol dl form html".split())
PLAIN, BOILER, SUSPECT = 0, 1, 2


def _kind(tag: str, attributes: dict[str, str], in_article: bool) -> int:
    """Whether an element is boilerplate by its tag, role or class, or suspect of it."""
    if tag in BOILER_TAGS or (tag == "header" and not in_article):
        return BOILER
    if tag in ("html", "body", "article", "main"):
        return PLAIN
    if "hidden" in attributes or attributes.get("role", "") in BOILER_ROLES:
        return BOILER
    if re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return BOILER
    found = PLAIN
    for name in (attributes.get("class", "") + " " + attributes.get("id", "")).lower().split():
        parts = [x for x in re.split(r"[-_]+|\d+", name) if x]
        if not parts or {"with", "has", "no"} & set(parts):
            continue
        known = [x for x in parts if x in STRONG_WORDS or x in WEAK_WORDS]
        if len(known) == len(parts) and not (in_article and known == ["header"]):
            return BOILER
        if tag not in _WHOLE_ONLY and {parts[0], parts[-1]} & STRONG_WORDS:
            return BOILER
        if tag not in _WHOLE_ONLY and {parts[0], parts[-1]} & WEAK_WORDS:
            found = SUSPECT
    return found


class Page:
    """Nodes (tag, key, parent, path hash, kind, suspect above) and text pieces (node, block number, text, in a link) of a page."""

    def __init__(self, html: str):
        self.tag, self.key, self.parent, self.hash, self.kind, self.suspect = ["#"], [""], [0], [0], [PLAIN], [0]
        self.pieces: list[tuple[int, int, str, bool]] = []
        self._stack: list[int] = [0]
        #: Places on the stack, by tag, and of elements that bound a scope or aren't inline.
        self._open: dict[str, list[int]] = {}
        self._scopes: list[int] = [0]
        self._blocks: list[int] = [0]
        self._read(html)

    def _last(self, *tags: str) -> int:
        """The highest place on the stack of one of the tags; 0 if none is open."""
        return max((places[-1] for t in tags if (places := self._open.get(t))), default=0)

    def _push(self, node: int) -> None:
        tag, at = self.tag[node], len(self._stack)
        self._stack.append(node)
        self._open.setdefault(tag, []).append(at)
        if tag in _SCOPE:
            self._scopes.append(at)
        if tag not in INLINE:
            self._blocks.append(at)

    def _cut(self, at: int) -> None:
        """Closes what stands at this place of the stack and above."""
        while len(self._stack) > at:
            tag = self.tag[self._stack.pop()]
            self._open[tag].pop()
            if tag in _SCOPE:
                self._scopes.pop()
            if tag not in INLINE:
                self._blocks.pop()

    def _end(self, tag: str) -> None:
        at = self._last(tag)
        bound = self._blocks[-1] if tag in INLINE else 0 if tag in _SCOPE else self._scopes[-1]
        if at and at >= bound:
            self._cut(at)

    def _begin(self, tag: str, given: str) -> None:
        if tag not in INLINE and (at := self._last("p")) > self._scopes[-1]:
            self._cut(at)
        if tag in _CLOSES:
            names, bounds = _CLOSES[tag]
            if (at := self._last(*names)) > self._last(*bounds):
                # the lowest of the elements that the new one closes
                floor = self._last(*bounds)
                self._cut(min(x for t in names for x in self._open.get(t, ())[-2:] if x > floor))
        attributes = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(given)} if given else {}
        up = self._stack[-1]
        inside = bool(self._open.get("article") or self._open.get("main"))
        names = re.sub(r"\d+", "0", ".".join(sorted(set(attributes.get("class", "").lower().split()))))
        node = len(self.tag)
        self.tag.append(tag)
        self.key.append(f"{tag}.{names}" if names else tag)
        self.parent.append(up)
        self.hash.append(xxhash.xxh3_64_intdigest(self.key[node].encode("utf-8", "surrogatepass"), self.hash[up]))
        kind = BOILER if self.kind[up] == BOILER else _kind(tag, attributes, inside)
        self.kind.append(kind)
        self.suspect.append(self.suspect[up] or (node if kind == SUSPECT else 0))
        if not given.endswith("/") or tag not in INLINE:
            self._push(node)

    def _read(self, html: str) -> None:
        block, at, end = 0, 0, len(html)
        while at < end:
            m = _TAG.search(html, at)
            stop = m.start() if m else end
            in_link = bool(self._open.get("a"))
            if stop > at:
                self.pieces.append((self._stack[-1], block, html[at:stop], in_link))
            if not m:
                break
            at = m.end()
            tag, given = (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
            if not tag:
                if m[0].startswith("<![CDATA["):
                    self.pieces.append((self._stack[-1], block, entities.escape(m[0][9:].removesuffix("]]>")), in_link))
            elif m[1] or m[4]:
                self._end(tag)
                block += tag not in INLINE and tag not in RAW
            elif tag in VOID:
                if tag == "br":
                    self.pieces.append((self._stack[-1], block, " ", False))
                block += tag == "hr"
            elif tag in RAW:
                if not given.endswith("/"):
                    close = _raw_end(tag).search(html, at)
                    at = close.end() if close else end
            else:
                block += tag not in INLINE
                self._begin(tag, given)

    def path(self, node: int) -> str:
        """The hash of a node's generalised path, and its last parts."""
        names, size, at = [], 0, node
        while at and size < SPELLED:
            names.append(self.key[at])
            size += len(self.key[at]) + 1
            at = self.parent[at]
        return f"{self.hash[node]:016x} " + ">".join(reversed(names))[-SPELLED:]

    def scored(self) -> list[tuple[float, int]]:
        """(score, container) of containers with text outside boilerplate, best first."""
        score: dict[int, float] = {}
        above = [0] * len(self.tag)  # the nearest container, itself included
        for x in range(1, len(self.tag)):
            above[x] = x if self.tag[x] in CONTAINERS else above[self.parent[x]]
        for node, _, text, link in self.pieces:
            if self.kind[node] == BOILER or self.suspect[node] or not (n := len(text.strip())):
                continue
            share, up = -0.5 * n if link else float(n), above[node]
            for _ in range(3):
                if not up:
                    break
                bonus = 1.5 if self.tag[up] in ("article", "main") else 1.0
                score[up] = score.get(up, 0.0) + share * bonus
                share, up = share / 2, above[self.parent[up]]
        return sorted(((s, x) for x, s in score.items() if s > 0), key=lambda x: (-x[0], x[1]))

    def suspects(self) -> dict[int, tuple[str, bool]]:
        """Of each suspect block a mark of its text, and whether it may be text by itself."""
        parts: dict[int, list[tuple[str, bool]]] = {}
        for node, _, text, link in self.pieces:
            if self.suspect[node] and self.kind[node] != BOILER:
                parts.setdefault(self.suspect[node], []).append((entities.unescape(text), link))
        found = {}
        for node, held in parts.items():
            words = " ".join(t for t, _ in held).split()
            linked = sum(len(t.strip()) for t, link in held if link)
            mark = xxhash.xxh3_64_hexdigest(" ".join(words).encode("utf-8", "surrogatepass"))
            found[node] = mark, len(words) >= SENTENCE and 2 * linked <= sum(len(t.strip()) for t, _ in held)
        return found

    def widened(self, roots: set[int]) -> set[int]:
        """roots, or the articles or mains above them, or the blocks that several of them stand in side by side."""
        out = set()
        side: dict[int, int] = {}
        for x in roots:
            side[self.parent[x]] = side.get(self.parent[x], 0) + 1
        home = [0] * len(self.tag)
        for x in range(1, len(self.tag)):
            home[x] = home[self.parent[x]] or (x if self.tag[x] in ("article", "main") else 0)
        for x in roots:
            up = self.parent[x]
            out.add(home[x] or (up if side[up] > 1 and self.tag[up] not in ("#", "html", "body") else x))
        return out

    def text(self, roots: set[int] | None, repeated=frozenset()) -> str:
        """Text of the blocks under roots (None: of the page), without boilerplate and repeated suspects."""
        inside = [roots is None]
        for x in range(1, len(self.tag)):
            inside.append(inside[self.parent[x]] or (roots is not None and x in roots))
        kept = {x for x, (mark, may) in self.suspects().items() if may and mark not in repeated}
        blocks: dict[int, list[str]] = {}
        for node, block, text, _ in self.pieces:
            if inside[node] and self.kind[node] != BOILER and (not self.suspect[node] or self.suspect[node] in kept):
                blocks.setdefault(block, []).append(entities.unescape(text))
        lines = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n".join(x for x in lines if x)


@lru_cache(64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I)


def votes(html: str | None) -> list[tuple[str, float]]:
    """Paths and shares of a page's vote; and "!" with the mark of each suspect that may be text."""
    page = Page(html or "")
    best: dict[int, float] = {}
    where: dict[int, int] = {}
    for s, node in page.scored():
        best[page.hash[node]] = best.get(page.hash[node], 0.0) + s
        where.setdefault(page.hash[node], node)
    top = sorted(((-s, page.path(where[h])) for h, s in sorted(best.items(), key=lambda x: -x[1])[: 4 * VOTES]))[:VOTES]
    total = -sum(s for s, _ in top)
    marks = {mark for mark, may in page.suspects().values() if may}
    return [(p, -s / total) for s, p in top] + [(f"!{m}", 1.0) for m in sorted(marks)]


def main_text(html: str | None, path: str | None, repeated=frozenset()) -> str:
    """Text at the path, else of the page's best container, else of the page; repeated: marks of boilerplate."""
    page = Page(html or "")
    if path:
        wanted = path.partition(" ")[0]
        roots = {x for x in range(1, len(page.tag)) if f"{page.hash[x]:016x}" == wanted}
        if roots and (text := page.text(page.widened(roots), repeated)):
            return text
    ranked = page.scored()
    return page.text(page.widened({ranked[0][1]}) if ranked else None, repeated)


def host(url):
    """Host of an address, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def winning_paths(pages: DataFrame) -> DataFrame:
    """host, path, repeated: the consensus of each host, from the columns id, host and html; repeated holds marks."""

    def vote(batches):
        import pyarrow as pa

        for batch in batches:
            hosts, paths, shares = [], [], []
            for name, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                for path, share in votes(html):
                    hosts.append(name)
                    paths.append(path)
                    shares.append(share)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(shares, pa.float64())],
                ["host", "path", "share"],
            )

    cast = pages.select("host", "html").mapInArrow(vote, "host string, path string, share double")
    # whole numbers add up alike in any order
    sums = cast.groupBy("host", "path").agg(F.sum(F.round(F.col("share") * 1_000_000).cast("long")).alias("votes"))
    is_mark = F.col("path").startswith("!")
    best = F.min(F.when(~is_mark, F.struct((-F.col("votes")).alias("v"), "path"))).alias("best")
    marks = F.sort_array(F.collect_set(F.when(is_mark & (F.col("votes") > 1_000_000), F.substring("path", 2, 16)))).alias("repeated")
    return sums.groupBy("host").agg(best, marks).select("host", F.col("best.path").alias("path"), "repeated")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars for each page."""
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host")
    )
    winners = cut(winning_paths(rows))
    size = F.length("host") + F.coalesce(F.length("path"), F.lit(0)) + 24 * F.size("repeated") + 64
    n, held = winners.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if n <= BROADCAST_HOSTS and held <= BROADCAST_BYTES:
        winners = F.broadcast(winners)
    joined = rows.join(winners, "host", "left").select("id", "url", "html", "path", "repeated")

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("html", "path", "repeated"))
            texts = [main_text(h, p, frozenset(marks or ())) for h, p, marks in zip(*columns)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["id", "url", "text", "n_chars"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(read, f"id {kind}, url string, text string, n_chars long").select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars"
    )
