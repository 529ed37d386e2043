"""HTML extraction by consensus host paths.

Each page is parsed once to score its containers: text of blocks counts for the block's
container and half for the one above, less what is in links. A container's path is its chain of
tag names and classes with digits folded. Pages vote for their best paths with their
shares of the page's score; votes are summed per host and path (partial aggregation, so a
host with very many pages is combined before the shuffle). A second parse takes the text of the
page's best container on its host's winning path, or of its own best container where the page
has none on it.

Menus, headers, footers, side bars, notices, adverts, forms, scripts, styles and comments are
left out by element and by class or id words, inside the container too. A container named by its
layout (``sidebar``, ``share``), or a form, stays if it holds more than half of the page's
unlinked text and the article's own marks; one named by comments stays if it holds more than half
and all titles there are, or is named as content too and no text stands beside it. A header
inside an article keeps its headings and paragraphs of ``LEAD_CHARS`` characters. Class names that
say what a container has (``has-sidebar``) or its state (``comments-open``) count for nothing.

Elements nested deeper than ``MAX_DEPTH`` belong to the container at that depth, so memory grows with
a page's length and not with its nesting.

The container found is widened: to the enclosing article or named content container, whose
further blocks come along unless most of their text is in links, and by what stands beside it.

Defined results: null or empty html gives an empty text. A null URL, or one without ``://``, votes
under the empty host. Pages of one host tie-break by path text. Repeated rows are extracted
alike. Broken markup is read as far as it goes. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_side, trimmed
from .url_filter import host_of

#: Paths a page votes for.
VOTES = 3
RAW = frozenset("script style noscript template title textarea iframe svg math object canvas".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img nobr acronym picture source".split()
)
DROPPED_TAGS = frozenset("nav footer aside head menu dialog button select fieldset audio video".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
#: Words of a class or id that mark reader comments, which never stay.
COMMENT_WORDS = frozenset("comment comments respond reply replies discussion disqus".split())
#: Words that mark what is not part of the article, unless an article, main element or title is inside.
ASIDE_WORDS = frozenset(
    """nav navbar navigation menu topbar footer foot cookie cookies consent gdpr notice alert banner ad ads adv advert adverts
    advertisement advertising sponsor sponsored promo promotion breadcrumb breadcrumbs pagination pager subscribe subscription
    newsletter signup login popup modal overlay""".split()
)
#: Words that also name the layout around an article.
LAYOUT_WORDS = frozenset("sidebar side aside rail widget share sharing social related recommended form search hidden".split())
HEADER_WORDS = frozenset("header head masthead".split())
#: First parts of class names that tell what a container has or how it looks, not what it is.
MODIFIERS = ("has-", "with-", "no-", "without-", "is-", "not-", "hide-", "show-", "js-")
#: Class names that tell whether comments are open, not that these are comments.
STATES = re.compile(r"(?:comment|reply|replie|discussion|respond|ping)s?[-_]?(?:open(?:ed)?|closed?|enabled|disabled|allowed|on|off|status.*|count.*)")
#: Nesting up to which containers are told apart.
MAX_DEPTH = 200
#: Unlinked characters from which a paragraph in an article's own header is part of the text.
LEAD_CHARS = 80
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
GOOD_WORDS = frozenset("article content post entry story main body text".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table td th tr ul dt dd".split()
)
SAME_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIST_OF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",)}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(?=[/a-zA-Z])[^<>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    """An open element that can hold blocks.

    ``dropped``: left out whatever it holds. ``doubt``: left out unless it proves to hold the article.
    ``cores``: titles, articles and main elements inside; ``titles``: titles and main elements in no header or aside.
    ``chain``: numbers of the containers from the root down to it.
    """

    tag: str
    path: str
    dropped: bool
    doubt: str = ""
    good: bool = False
    number: int = 0
    headings_only: bool = False
    in_article: bool = False
    in_heading: bool = False
    shaded: bool = False
    cores: int = 0
    titles: int = 0
    chain: tuple[int, ...] = (0,)


@dataclass
class Block:
    text: str
    chain: tuple[int, ...]
    linked: int


def _attributes(raw: str) -> tuple[str, set[str], str, bool]:
    """(first class, class and id words, role, hidden)."""
    names, words, role = "", set(), ""
    for name, value in _ATTR.findall(raw):
        value = value.strip("\"'")
        low = name.lower()
        if low in ("class", "id"):
            if low == "class":
                names = " ".join(sorted(value.split()))
            words.update(w.lower() for one in value.split() if not one.lower().startswith(MODIFIERS) and not STATES.fullmatch(one.lower()) for w in _SPLIT.split(one) if w)
        elif low == "role":
            role = value.lower()
    return re.sub(r"\d+", "#", names), words, role, bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", raw) or "display:none" in raw.replace(" ", ""))


def _article_in_comments(nodes: list[Node], blocks: list[Block]) -> set[int]:
    """Numbers of the containers named by comments that hold the article for all that."""
    held: dict[int, int] = {}
    total = beside = 0
    for b in blocks:
        inside = [i for i in b.chain if nodes[i].doubt == "comment"]
        if len(inside) > 1:  # comments within it
            continue
        worth = len(b.text) - b.linked
        total += worth
        if inside:
            held[inside[0]] = held.get(inside[0], 0) + worth
        elif not any(nodes[i].doubt for i in b.chain):
            beside += worth
    titles = nodes[0].titles
    proves = lambda n: nodes[n].titles == titles > 0 or (nodes[n].good and beside < LEAD_CHARS)
    return {n for n, worth in held.items() if 2 * worth > total and proves(n)}


def _settled(nodes: list[Node], blocks: list[Block]) -> list[Block]:
    """``blocks`` without those in containers of doubt that do not hold the article."""
    doubtful = {n.number for n in nodes if n.doubt}
    if not doubtful:
        return blocks
    fine = _article_in_comments(nodes, blocks)
    comments = {i for i in doubtful if nodes[i].doubt == "comment"}
    blocks = [b for b in blocks if not (comments - fine).intersection(b.chain)] if comments - fine else blocks
    doubtful -= comments
    held: dict[int, int] = {}
    total = 0
    for b in blocks:
        worth = len(b.text) - b.linked
        total += worth
        for i in doubtful.intersection(b.chain):
            held[i] = held.get(i, 0) + worth
    out = {n for n in doubtful if not (2 * held.get(n, 0) > total and (nodes[n].cores or (nodes[n].doubt == "layout" and nodes[n].good)))}
    return [b for b in blocks if not out.intersection(b.chain)]


def _doubt(tag: str, words: set[str], role: str, nested: bool) -> str:
    """Why an element may be no part of the article: ``comment``, ``aside``, ``header``, ``layout`` or nothing."""
    if tag in ("html", "body", "main") or (tag == "article" and not nested):
        return ""
    if words & COMMENT_WORDS:
        return "comment"
    if tag == "article":
        return ""
    if words & ASIDE_WORDS:
        return "aside"
    if tag == "header" or words & HEADER_WORDS:
        return "header"
    return "layout" if tag == "form" or role == "form" or words & LAYOUT_WORDS else ""


def parse(html: str | None) -> tuple[list[Node], list[Block]]:
    """All containers and, in page order, the blocks of text that are not left out."""
    root = Node("", "", False)
    nodes, stack, blocks = [root], [root], []
    still_open: dict[str, int] = {}
    text: list[str] = []
    linked, in_link, at, size = 0, False, 0, len(html or "")

    def flush() -> None:
        nonlocal linked, in_link
        if text:
            joined = _SPACE.sub(" ", "".join(text)).strip()
            top = stack[-1]
            if joined and not top.dropped and (not top.headings_only or top.in_heading or len(joined) - linked >= LEAD_CHARS):
                blocks.append(Block(joined, top.chain, min(linked, len(joined))))
            text.clear()
        linked = 0

    def close(depth: int) -> None:
        """Take elements from the stack until it is ``depth`` long."""
        while len(stack) > depth:
            node = stack.pop()
            still_open[node.tag] -= 1
            stack[-1].cores += node.cores
            stack[-1].titles += node.titles

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1].dropped:
            piece = unescape(raw)
            text.append(piece)
            if in_link:
                linked += len(piece.strip())

    while at < size:
        m = _TOKEN.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                in_link = False
            elif tag in INLINE or tag in VOID:
                if tag == "br":
                    add(" ")
            elif still_open.get(tag):
                flush()
                in_link = False
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                close(depth)
            elif tag == "p":
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if tag == "a":
            in_link = True
        elif tag == "br":
            add(" ")
        elif tag in VOID:
            if tag == "hr":
                flush()
        elif tag in INLINE:
            pass
        else:
            flush()
            in_link = False
            if tag in CLOSES_P and stack[-1].tag == "p":
                close(len(stack) - 1)
            for kind in SAME_KIND.get(tag, ()):
                for i in range(len(stack) - 1, max(0, len(stack) - MAX_DEPTH), -1):
                    if stack[i].tag in LIST_OF.get(tag, ()):
                        break
                    if stack[i].tag == kind:
                        close(i)
                        break
            names, words, role, hidden = _attributes(m[3] or "")
            up = stack[-1]
            doubt = _doubt(tag, words, role, up.in_article)
            # a header of the article itself keeps its headings
            own = doubt == "header" and (up.in_article or bool(words & GOOD_WORDS))
            deep = len(up.chain) > MAX_DEPTH
            node = Node(
                tag,
                up.path if deep else f"{up.path}>{tag}{'.' + names if names else ''}",
                up.dropped or tag in DROPPED_TAGS or role in DROPPED_ROLES or hidden or bool(deep and doubt and not own),
                "" if own or deep else doubt,
                tag in ("article", "main") or bool(words & GOOD_WORDS),
                len(nodes),
                up.headings_only or own,
                up.in_article or tag == "article",
                up.in_heading or tag in HEADINGS,
                up.shaded or doubt in ("header", "aside"),
                chain=up.chain if deep else (*up.chain, len(nodes)),
            )
            if tag in ("h1", "article", "main") and not doubt and not node.dropped:
                up.cores += 1
                up.titles += tag != "article" and not up.shaded
            nodes.append(node)
            if not (m[3] or "").rstrip().endswith("/"):
                stack.append(node)
                still_open[tag] = still_open.get(tag, 0) + 1
    flush()
    close(1)
    return nodes, _settled(nodes, blocks)


BLOCK_TAGS = HEADINGS | frozenset("p li ul ol blockquote pre dl dt dd td th tr thead tbody tfoot table figure figcaption".split())
#: Unlinked characters at which a container beside the one found is taken for a part of the article.
SIBLING_CHARS = 80


def _containers(nodes: list[Node], block: Block) -> tuple[int, ...]:
    """The block's chain up to the innermost element that is not itself a block of text."""
    end = len(block.chain)
    while end > 1 and nodes[block.chain[end - 1]].tag in BLOCK_TAGS:
        end -= 1
    return block.chain[:end]


def _link_heavy(blocks: list[Block]) -> bool:
    return 2 * sum(b.linked for b in blocks) > sum(len(b.text) for b in blocks)


def widened(nodes: list[Node], blocks: list[Block], pick: int, taken: set[int]) -> set[int]:
    """Numbers of the article's blocks, from ``taken``, the blocks of container ``pick`` and of its like."""
    up: tuple[int, ...] = ()
    for i in taken:
        if pick in blocks[i].chain:
            up = blocks[i].chain[: blocks[i].chain.index(pick) + 1]
            break
    # no further out than the outermost article
    first = next((at for at, n in enumerate(up) if nodes[n].tag == "article"), 0)
    for depth in range(len(up) - 2, first - 1, -1):
        outer = up[depth]
        immediate = depth == len(up) - 2
        if not (nodes[outer].good or immediate):
            continue
        more = [i for i, b in enumerate(blocks) if i not in taken and len(b.chain) > depth and b.chain[depth] == outer]
        if not more:
            continue
        if nodes[outer].good and not _link_heavy([blocks[i] for i in more]):
            taken = taken | set(more)
            continue
        # else part by part: the container's own blocks, and containers in it with text enough
        parts: dict[int, list[int]] = {}
        for i in more:
            chain = _containers(nodes, blocks[i])
            parts.setdefault(chain[depth + 1] if len(chain) > depth + 1 else -1 - i, []).append(i)
        for part, inside in parts.items():
            group = [blocks[i] for i in inside]
            unlinked = sum(len(b.text) - b.linked for b in group)
            if not _link_heavy(group) and (part < 0 or unlinked >= SIBLING_CHARS):
                taken = taken | set(inside)
    return taken


def container_scores(nodes: list[Node], blocks: list[Block]) -> dict[int, float]:
    """Score of every container that holds blocks; a block element itself is no container."""
    out: dict[int, float] = {}
    for b in blocks:
        chain = _containers(nodes, b)
        worth = max(len(b.text) - 2 * b.linked, 0)
        for number, share in zip(reversed(chain), (1.0, 0.5), strict=False):
            out[number] = out.get(number, 0.0) + worth * share * (1.5 if nodes[number].good else 1.0)
    return out


def best_paths(html: str | None) -> list[tuple[str, float]]:
    """The page's best paths and their shares of its whole score."""
    nodes, blocks = parse(html)
    scores: dict[str, float] = {}
    for number, score in container_scores(nodes, blocks).items():
        path = nodes[number].path
        scores[path] = max(score, scores.get(path, 0.0))
    total = sum(scores.values())
    top = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:VOTES]
    return [(p, s / total) for p, s in top if total]


def extract(html: str | None, path: str | None) -> str:
    """The text of the best container on ``path``, or else of the page's best one, widened to its article."""
    nodes, blocks = parse(html)
    scores = container_scores(nodes, blocks)
    if not scores:
        return ""
    on_path = {n: s for n, s in scores.items() if nodes[n].path == path and s > 0} or scores
    pick = min(on_path, key=lambda n: (-on_path[n], n))
    # containers on the same path side by side make up one text
    same = {n for n in on_path if nodes[n].path == nodes[pick].path}
    taken = widened(nodes, blocks, pick, {i for i, b in enumerate(blocks) if same.intersection(b.chain)})
    return "\n\n".join(blocks[i].text for i in sorted(taken))


def path_votes(pages: DataFrame) -> DataFrame:
    """(host, path, share) rows of every page of ``pages`` (url, html)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            hosts = batch.column(0).to_pylist()
            rows = [(h, p, s) for h, html in zip(hosts, batch.column(1).to_pylist(), strict=True) for p, s in best_paths(html)]
            if rows:
                a, b, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], ["host", "path", "share"])

    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(trimmed(run), "host string, path string, share double")


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with the most votes of each host."""
    # votes in whole millionths, so sums do not depend on their order
    votes = path_votes(pages).groupBy("host", "path").agg(F.sum(F.round(F.col("share") * 1e6).cast("long")).alias("votes"))
    best = Window.partitionBy("host").orderBy(F.col("votes").desc(), "path")
    return votes.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("host", "path")


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, path) for every row of ``pages`` (page_id, url, html)."""
    winners = materialize(host_paths(pages), "host-paths")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(small_side(winners, 200_000), "host", "left")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [extract(h, p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column(3)],
                ["page_id", "url", "text", "n_chars", "path"],
            )

    schema = T.StructType([pages.schema["page_id"], pages.schema["url"]]).add("text", "string").add("n_chars", "long").add("path", "string")
    return rows.select("page_id", "url", "html", "path").mapInArrow(trimmed(run), schema)
