"""Main text of web pages by composite text density.

Every node of a page's tree gets its characters per tag, adjusted by how much of it is
link text.  The subtree whose children's densities have the largest sum is the core of
the page; the smallest density on the way from it to the body is the threshold, and
the other parts that reach it are kept too.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that hold other blocks; the core of a page is one of these or its body.
_CONTAINERS = frozenset("article blockquote body center dd details div dl figure li main ol section table tbody td ul".split())
#: Blocks whose content stays on one line with their siblings'.
_CELLS = frozenset(("td", "th"))
#: A start tag ends these open elements, up to the ones after the bar.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Never text of an article.
_DROPPED = frozenset(
    "head script style noscript template nav footer aside form iframe object embed applet svg math canvas audio video map select"
    " button textarea input label fieldset dialog menu noembed noframes search".split()
)
#: Of these, elements that stay where they hold the article; so do those that class, id or role name.
_MAY_HOLD = frozenset("nav header footer aside form fieldset dialog menu search".split())
#: Names of boilerplate: whole words of a class or id, or the first or last part of a compound one.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr popup modal overlay"
    " sidebar menu navbar nav navigation breadcrumb breadcrumbs masthead footer share sharing newsletter subscribe signup toolbar pagination pager login".split()
)
#: The same for what readers write.
_READERS = frozenset("comment comments commentlist disqus respond reply replies discussion discussions reviews".split())
#: Names of adverts, which tell as much in the middle of a compound name.
_ADVERTS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsored".split())
#: Names with an everyday sense: at the beginning of a compound name ("menu-description") they tell a topic.
_TOPICS = frozenset(("menu",))
#: Names that articles' own parts have as well: in a compound name they count only where links abound.
_DOUBTFUL = frozenset("promo promotion banner header social related recommended notice notices alert widget".split())
#: With one of these a compound name tells about a layout and not what the element is.
_STATES = frozenset("has with without no is show hide open closed on off enabled disabled wrap wrapper layout container".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_NEVER = frozenset(("html", "body", "main", "article"))
#: Elements nest up to this depth, as in browsers; deeper ones are siblings.
_DEPTH = 512


class _Page:
    """The tree as parallel lists; node 0 is the root. A node's number is above its parent's."""

    def __init__(self, source: str):
        self.tags, self.parents, self.dropped = ["body"], [-1], [False]
        #: What a node's name or attributes tell: "" or one of the kinds of boilerplate that _drop_named weighs.
        self.named = [""]
        #: (node, text) in page order; None as text ends a block there, " " parts words.
        self.parts: list[tuple[int, str | None]] = []
        self._read(source)
        if any(self.named):
            self._drop_named()

    def _read(self, source: str) -> None:
        stack, at = [0], 0
        while at < len(source):
            m = _TAG.search(source, at)
            if m is None:
                self._text(stack[-1], source[at:])
                break
            if m.start() > at:
                self._text(stack[-1], source[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                self._end(stack, name)
                continue
            node = self._start(stack, name, m[3] or m[6] or "")
            if name in _RAW:
                closing = _RAW[name].search(source, at)
                if name == "xmp":
                    self.parts.append((node, source[at : closing.start() if closing else len(source)]))
                at = closing.end() if closing else len(source)
                self._end(stack, name)

    def _text(self, node: int, text: str) -> None:
        if not self.dropped[node]:
            self.parts.append((node, html.unescape(text)))

    def _start(self, stack: list[int], name: str, attributes: str) -> int:
        tags = self.tags
        if name in ("html", "body"):
            return stack[-1]
        if name in _BLOCKS and tags[stack[0]] == "body":
            if name in _ENDS:
                ends, limits = _ENDS[name]
                for i in range(len(stack) - 1, 0, -1):
                    if tags[stack[i]] in limits:
                        break
                    if tags[stack[i]] in ends:
                        self._close(stack, i)
                        break
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                tag = tags[stack[i]]
                if tag == "p":
                    self._close(stack, i)
                if tag in _BLOCKS:
                    break
            if name != "head" and tags[stack[-1]] == "head":
                self._close(stack, len(stack) - 1)
        parent, node = stack[-1], len(tags)
        hidden, named = False, ""
        if attributes and name not in _NEVER:
            hidden, named = self._boilerplate(attributes)
        tags.append(name)
        self.parents.append(parent)
        self.dropped.append(self.dropped[parent] or hidden or name in _DROPPED and name not in _MAY_HOLD)
        own = not self._inside(stack, ("article", "main")) if name == "header" else name in _MAY_HOLD
        self.named.append(named or "named" * own)
        if name in _CELLS or name == "br":
            self.parts.append((node, " "))
        elif name in _BLOCKS:
            self.parts.append((node, None))
        if name not in _VOID and len(stack) < _DEPTH:
            stack.append(node)
        return node

    def _inside(self, stack: list[int], names: tuple[str, ...]) -> bool:
        return any(self.tags[i] in names for i in stack)

    @staticmethod
    def _kind(word: str) -> str:
        """What a word of a class or id tells of its element."""
        parts = [x for x in re.split(r"[^a-z]+", word) if x]
        ends = {parts[0], parts[-1]} if parts else set()
        if len(parts) > 1 and ends & _STATES:
            return "holder" if ends & (_NAMES | _READERS | _DOUBTFUL) else ""
        if len(parts) > 1 and ends & _NAMES == ends & _TOPICS == {parts[0]} and not ends & (_READERS | _DOUBTFUL):
            return "doubtful"
        if len(parts) > 2 and _ADVERTS.intersection(parts):
            return "named"
        for names, kind in ((_READERS, "readers"), (_NAMES, "named"), (_DOUBTFUL, "named" if len(parts) == 1 else "doubtful")):
            if ends & names:
                return kind
        return ""

    @classmethod
    def _boilerplate(cls, attributes: str) -> tuple[bool, str]:
        """Whether attributes hide an element, and what kind of boilerplate they name it."""
        named = ""
        for m in _ATTRIBUTE.finditer(attributes):
            if m[5]:
                return True, named
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                named = max([named, *map(cls._kind, value.split())], key=("", "holder", "doubtful", "named", "readers").index)
            if key == "role" and value in _ROLES:
                named = named if named == "readers" else "named"
            if key == "aria-hidden" and value == "true":
                return True, named
            if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True, named
        return False, named

    def _drop_named(self) -> None:
        """Drop what is named boilerplate, unless it holds the article.

        Where markup names the article, elements around it stay; elsewhere those that hold most
        unlinked text, and readers' words only where hardly any text is outside of them.
        Doubtful names drop elements with links in at least a quarter of their text.
        """
        n = len(self.tags)
        chars, linked, in_link = [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            in_link[i] = self.tags[i] == "a" or in_link[self.parents[i]]
        for node, text in self.parts:
            if text and not self.dropped[node]:
                (linked if in_link[node] else chars)[node] += len("".join(text.split()))
        for i in range(n - 1, 0, -1):
            chars[self.parents[i]] += chars[i]
            linked[self.parents[i]] += linked[i]
        core = {tag: max((i for i in range(n) if self.tags[i] == tag), key=chars.__getitem__, default=0) for tag in ("main", "article")}
        cores = [i for i in core.values() if i and chars[i]]
        if len(cores) == 2 and 2 * chars[core["article"]] < chars[core["main"]]:
            cores = [core["main"]]
        around = set()
        for i in cores:
            while i > 0:
                around.add(i)
                i = self.parents[i]
        for i in range(1, n):
            kind = self.named[i]
            if kind == "holder" or kind == "doubtful" and 3 * linked[i] < chars[i]:
                kind = ""
            if cores:
                holds = i in around
            else:
                holds = 10 * chars[i] > 9 * chars[0] if kind == "readers" else 2 * chars[i] > chars[0]
            self.dropped[i] = self.dropped[i] or self.dropped[self.parents[i]] or bool(kind) and not holds

    def _end(self, stack: list[int], name: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[i]]
            if tag == name:
                return self._close(stack, i)
            if tag in _BLOCKS and name not in _BLOCKS:
                return None
        return None

    def _close(self, stack: list[int], i: int) -> None:
        if any(self.tags[n] in _BLOCKS and self.tags[n] not in _CELLS for n in stack[i:]):
            self.parts.append((stack[i], None))
        elif self.tags[stack[i]] in _CELLS:
            self.parts.append((stack[i], " "))
        del stack[i:]

    def densities(self) -> tuple[list[float], list[float]]:
        """Of each node: composite text density, and its children's sum (its own for a leaf)."""
        n = len(self.tags)
        chars, links, tags, link_tags = [0] * n, [0] * n, [1] * n, [0] * n
        for node, text in self.parts:
            if text and not self.dropped[node]:
                chars[node] += len("".join(text.split()))
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = self.tags[i] == "a" or in_link[self.parents[i]]
            if in_link[i]:
                links[i], link_tags[i] = chars[i], 1
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            if not self.dropped[i]:
                chars[p] += chars[i]
                links[p] += links[i]
                tags[p] += tags[i]
                link_tags[p] += link_tags[i]
        density, sums, leaf = [0.0] * n, [0.0] * n, [True] * n
        for i in range(n - 1, -1, -1):
            if chars[i] and not self.dropped[i]:
                density[i] = chars[i] / tags[i]
                y = chars[i] * links[i] / max(1, chars[i] - links[i]) + links[0] * chars[i] / chars[0]
                if y > 0:
                    x = chars[i] / max(1, links[i]) * tags[i] / max(1, link_tags[i])
                    density[i] *= math.log(max(x, 1.0)) / math.log(math.log(y + math.e))
            if leaf[i]:
                sums[i] = density[i]
            if i and not self.dropped[i]:
                p = self.parents[i]
                leaf[p] = False
                sums[p] += density[i]
        return density, sums

    def content(self) -> list[bool]:
        """Whether each node belongs to the main text."""
        density, sums = self.densities()
        n = len(self.tags)
        sums = [s if t in _CONTAINERS else 0.0 for s, t in zip(sums, self.tags)]
        core = max(range(n), key=sums.__getitem__)
        # Where the markup itself names the article around the core, that is the subtree.
        above = [core]
        while above[-1] > 0:
            above.append(self.parents[above[-1]])
        core = next((i for tag in ("article", "main") for i in above if self.tags[i] == tag), core)
        sums[core] = math.inf
        threshold, i = density[core], core
        while i >= 0:
            threshold = min(threshold, density[i])
            i = self.parents[i]
        # Below a node that reaches the threshold, the child with the largest sum is content.
        best = list(range(n))
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            if not self.dropped[i] and sums[best[i]] > sums[best[p]]:
                best[p] = best[i]
        inside = [False] * n
        inside[best[0]] = True
        for i in range(1, n):
            p = self.parents[i]
            if self.dropped[i]:
                inside[i] = False
            elif inside[p] or inside[i]:
                inside[i] = True
            elif density[i] >= threshold and density[i] > 0 and not self._holds(i, best[0]):
                inside[best[i]] = True
        return inside

    def _holds(self, node: int, other: int) -> bool:
        while other > node:
            other = self.parents[other]
        return other == node

    def blocks(self) -> list[str]:
        inside, blocks, now = self.content(), [], []
        for node, text in self.parts:
            if text is None:
                if now:
                    blocks.append("".join(now))
                    now = []
            elif inside[node]:
                now.append(text)
        if now:
            blocks.append("".join(now))
        return [b for x in blocks if (b := " ".join(x.split()))]


def main_text(source: str | None) -> str:
    """The main text of one page: its blocks, parted by an empty line."""
    return "\n\n".join(_Page(source).blocks()) if source else ""


def extract_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each page in ``out_col``, from its whole HTML.

    Null and empty HTML give an empty text.  All rows stay, repeated ones too, as do all
    columns, of whatever names, but the HTML and one named ``out_col``.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in (html_col, out_col)])
    rows = pages.select(row.alias("_row"), F.col(html_col).alias("_html"))
    schema = T.StructType([rows.schema["_row"]]).add("_text", "string")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(extract, schema).select("_row.*", F.col("_text").alias(out_col))
