"""HTML extraction with removal of site templates.

A page's element subtrees are hashed, and Spark counts on how many different pages of its host each
hash stands; subtrees that recur on many of them are the site's template and are deleted. A subtree
has two hashes:

* its text hash covers tags, attributes (runs of digits count alike) and text;
* its shape hash covers tags, class, id and role alone, equal neighbours counting once, so that a
  menu of five links and one of six, or a footer whose wording rotates, are one shape.

A text hash may delete anywhere; within ``article`` or ``main`` only lists, tables, figures and blocks
with a link or a form's control, counted once per different article, so that sentences which
many articles share stay. A shape hash says nothing of the text, so it deletes only outside the article, only
blocks that are short or hold no more text than the page's articles do (what a page says at length is its own), and on pages
without an article only blocks whose whole text is links; no subtree that holds an article is ever a template.

What counting cannot know (hosts of few pages, boxes met once) is left to the elements' names:
``NAMING`` tags and ``BOILERPLATE`` classes go as well, inside an article only where the name is a whole class and
the element has a link or a form's control or is named by one of the ``SURE`` words, and scripts and the like
(``UNSEEN``) always do. Of the rest the article is taken, or the body
where a page has no article or the article holds little of what is left.

Pages are parsed twice, once to count and once to extract, and their html is never shuffled unless
the list of templates is too long to send to every task (``BROADCAST_TEMPLATES``).

Cases: a null or empty html gives an empty text; unclosed and stray tags are closed or skipped, in
time that grows with the page's length only; a tag that is never ended is text from the last
``<`` on; a page without a host has its templates counted among all such pages; repeated rows keep a
row each and count as one page.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outways.llm.store import written

#: A subtree is a template from so many pages of a host on, however large the host.
LEAST_PAGES = 5
#: An article with a smaller share of the page's remaining characters isn't the page's text.
LEAST_ARTICLE = 0.25
#: A recurring shape beside an article goes with up to so many characters, or with as many as the article has.
SHORT_BOX = 140
#: Up to so many templates (8 bytes each) are sent to every task; beyond, deletions are joined by page.
BROADCAST_TEMPLATES = 4_000_000

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)", re.S)
#: The rest of a tag; quotes count only after an equals sign. Possessive: it never backs up.
TAG_REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
ATTRIBUTE = re.compile(r"([^\s=>/\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
DIGITS = re.compile(r"\d+")
#: A slash before the end of a tag that isn't the end of an unquoted value.
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noframes".split())
UNSEEN = frozenset("head script style noscript template iframe svg select textarea input object embed audio video title xmp noframes".split())
NAMING = frozenset("nav header footer aside form button menu".split())
BLOCKS = frozenset(
    "html body p h1 h2 h3 h4 h5 h6 div section article main ul ol li dl dt dd table thead tbody tfoot tr blockquote pre figure figcaption address hr fieldset details summary nav header footer aside form center".split()
)
WHOLE = frozenset("#root html head body article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Inside an article these are counted only with a link or a form's control in them.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre figcaption dd dt td th tr tbody thead".split())
LINKING = frozenset("a button input form select textarea".split())
#: Closed by the next of their kind or by a block, unless one of ``BARRIERS`` was opened since.
CLOSES = {"p": BLOCKS, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}
CLOSED_BY = {tag: [kind for kind, closers in CLOSES.items() if tag in closers] for tag in BLOCKS | set(CLOSES)}
BARRIERS = frozenset("table ul ol dl td div section article main body".split())
#: Words of class, id or role that name what isn't the article.
WORDS = (
    "ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|"
    "header|masthead|footer|sidebar|aside|cookie|cookies|consent|notice|notices|popup|modal|overlay|subscribe|newsletter|signup|social|share|sharing|"
    "related|recommended|comment|comments|respond|reply|replies|discussion|pagination|pager|widget|toolbar|login|contentinfo|complementary|alert|disclaimer|copyright|skip-link"
)
BOILERPLATE = re.compile(rf"(?:^|[\s_-])(?:{WORDS})(?:$|[\s_-])", re.I)
#: The same as one whole class, which names an article or main as well.
BOILERPLATE_CLASS = re.compile(rf"(?:^|\s)(?:{WORDS})(?:$|\s)", re.I)
#: Words that name no part of an article, whatever stands in it.
SURE = re.compile(r"(?:^|\s)(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|banner|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|masthead|footer|sidebar|cookie|cookies|consent|notices|popup|modal|overlay|subscribe|newsletter|signup|share|sharing|comment|comments|respond|pagination|pager|widget|toolbar|login|copyright|skip-link)(?:$|\s)", re.I)
HIDING = re.compile(r"display\s*:\s*none", re.I)
OPEN, TEXT, CLOSE = 0, 1, 2


def attributes_of(source: str) -> dict[str, str]:
    """Names (lower case) and values; the first of a repeated name holds."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), next((v for v in values if v), ""))
    return found


class Page:
    """A page as events in page order: (OPEN, element), (TEXT, string), (CLOSE, element). Elements are
    numbered in page order from 0, the root."""

    __slots__ = ("attributes", "events", "sources", "tags")

    def __init__(self, page: str):
        self.tags, self.sources, self.attributes = ["#root"], [""], [{}]
        self.events: list[tuple[int, int | str]] = [(OPEN, 0)]
        self._read(page)

    def _read(self, page: str) -> None:
        events, stack = self.events, [0]
        open_at: dict[str, list[int]] = defaultdict(list)  # depths of the open elements of a tag
        blocks, barriers = [0], [0]
        at, size, quotes = 0, len(page), True

        def close(depth: int) -> None:
            while len(stack) > depth:
                element = stack.pop()
                tag = self.tags[element]
                open_at[tag].pop()
                if tag in BLOCKS:
                    blocks.pop()
                if tag in BARRIERS:
                    barriers.pop()
                events.append((CLOSE, element))

        while at < size:
            m = MARKUP.search(page, at)
            if (m.start() if m else size) > at:
                events.append((TEXT, page[at : m.start() if m else size]))
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag, rest = m[2].lower(), TAG_REST.match(page, at) if quotes else None
            if rest:
                source, at = rest[1], rest.end()
            else:
                # A quotation mark is never closed: from here on any ``>`` ends a tag.
                quotes, end = False, page.find(">", at)
                if end < 0:
                    break
                source, at = page[at:end], end + 1
            if m[1]:
                held = open_at.get(tag)
                if held and (tag in BLOCKS or held[-1] > blocks[-1]):
                    close(held[-1])
                continue
            for _ in range(len(stack)):
                depth = max((open_at[k][-1] for k in CLOSED_BY.get(tag, ()) if open_at.get(k)), default=0)
                # An element may be a barrier itself (td): only later ones protect it.
                since = next((b for b in reversed(barriers) if b != depth), 0)
                if depth == 0 or since > depth:
                    break
                close(depth)
            element = len(self.tags)
            self.tags.append(tag)
            self.sources.append(source)
            self.attributes.append(attributes_of(source) if source else {})
            events.append((OPEN, element))
            if tag in VOID or SELF_CLOSED.search(source):
                events.append((CLOSE, element))
                continue
            if tag in RAW:
                ended = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
                stop = ended.start() if ended else size
                events += [(TEXT, page[at:stop]), (CLOSE, element)]
                after = page.find(">", stop)
                at = after + 1 if ended and after >= 0 else size
                continue
            open_at[tag].append(len(stack))
            if tag in BLOCKS:
                blocks.append(len(stack))
            if tag in BARRIERS:
                barriers.append(len(stack))
            stack.append(element)
        close(1)
        events.append((CLOSE, 0))

    def linking(self) -> list[bool]:
        """Whether each element has a link or a form's control in it."""
        found, stack = [tag in LINKING for tag in self.tags], []
        for kind, what in self.events:
            if kind == OPEN:
                stack.append(what)
            elif kind == CLOSE:
                stack.pop()
                if found[what] and stack:
                    found[stack[-1]] = True
        return found

    def named(self, element: int, inside: bool = False, linked: bool = True) -> bool:
        """Whether the element's tag or attributes say that it isn't the article's; ``inside`` an article, and
        whether it is ``linked``."""
        tag, attributes = self.tags[element], self.attributes[element]
        if tag in NAMING:
            return True
        if not attributes or tag in ("html", "body"):
            return False
        if "hidden" in attributes or HIDING.search(attributes.get("style", "")):
            return True
        words = BOILERPLATE_CLASS if inside or tag in ("article", "main") else BOILERPLATE
        if inside and not linked:
            words = SURE
        return tag not in HEADINGS and any(words.search(attributes.get(key, "")) for key in ("class", "id", "role"))


def _number(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)))


def subtree_hashes(page: Page) -> list[tuple[int, int, int]]:
    """(element, hash, article): the subtrees that may be templates, in page order, with the hash of
    the outermost article around them, else of the page. Text and shape hashes are numbers of
    one space."""
    tags = page.tags
    inside, linked, plain = [0] * len(tags), [False] * len(tags), [False] * len(tags)  # plain: text outside of links
    holds = [False] * len(tags)  # an article or main
    chars = [0] * len(tags)  # of text, white space left out
    text_hash: list[int] = [0] * len(tags)
    shape_hash: list[int] = [0] * len(tags)
    parts: list[list] = []
    shapes: list[list] = []
    stack: list[int] = []
    for kind, what in page.events:
        if kind == TEXT:
            words = what.split()
            if words:
                parts[-1].append(" ".join(words))
                if tags[stack[-1]] not in UNSEEN:
                    chars[stack[-1]] += sum(map(len, words))
                plain[stack[-1]] = plain[stack[-1]] or tags[stack[-1]] not in RAW
        elif kind == OPEN:
            own = tags[what] in ("article", "main")
            if stack:
                outer = stack[-1]
                inside[what] = inside[outer] or (outer if tags[outer] in ("article", "main") else 0)
            holds[what] = own
            stack.append(what)
            parts.append([tags[what], DIGITS.sub("0", page.sources[what]).strip()])
            attributes = page.attributes[what]
            shapes.append([tags[what], DIGITS.sub("0", "|".join(attributes.get(k, "") for k in ("class", "id", "role")))])
        else:
            stack.pop()
            text_hash[what], shape_hash[what] = _number(*parts.pop()), _number("shape", *shapes.pop())
            tag = tags[what]
            linked[what] = linked[what] or tag in LINKING
            if stack:
                outer = stack[-1]
                parts[-1].append(text_hash[what])
                chars[outer] += chars[what]
                if len(shapes[-1]) == 2 or shapes[-1][-1] != shape_hash[what]:
                    shapes[-1].append(shape_hash[what])
                linked[outer] = linked[outer] or linked[what]
                plain[outer] = plain[outer] or (plain[what] and tag != "a")
                holds[outer] = holds[outer] or holds[what]
    found = []
    article_chars = max(SHORT_BOX, sum(chars[i] for i, tag in enumerate(tags) if tag in ("article", "main") and not inside[i]))
    for i, tag in enumerate(tags):
        if holds[i] or tag in WHOLE or tag in VOID or tag not in BLOCKS:
            continue
        if inside[i]:
            if tag not in RUNNING or linked[i]:
                found.append((i, text_hash[i], text_hash[inside[i]]))
            continue
        found.append((i, text_hash[i], text_hash[0]))
        if (holds[0] and chars[i] <= article_chars) or (linked[i] and not plain[i]):
            found.append((i, shape_hash[i], text_hash[0]))
    return found


def blocks(page: Page, deleted: Callable[[int], bool] = lambda element: False, by_name: bool = True) -> list[str]:
    """The blocks of text of a page's article, or of its body where it has none or a small one."""
    everything: list[tuple[bool, str]] = []  # (in an article, text)
    open_text: list[str] = []
    skipped, depth, articles = 0, 0, 0
    linked = page.linking()

    def end() -> None:
        text = " ".join(entities.unescape("".join(open_text)).split())
        open_text.clear()
        if text:
            everything.append((depth > 0, text))

    for kind, what in page.events:
        if kind == TEXT:
            if not skipped:
                open_text.append(what)
            continue
        tag = page.tags[what]
        if kind == OPEN:
            if skipped or tag in UNSEEN or deleted(what) or (by_name and page.named(what, depth > 0, linked[what])):
                if not skipped and tag in BLOCKS:
                    end()
                skipped += 1
                continue
            if tag in BLOCKS:
                end()
            elif tag == "br":
                open_text.append(" ")
            if tag in ("article", "main"):
                depth += 1
                articles += 1
        elif skipped:
            skipped -= 1
        else:
            if tag in ("td", "th"):
                open_text.append(" ")
            if tag in BLOCKS:
                end()
            if tag in ("article", "main"):
                depth -= 1
    end()
    held, left = (sum(len(text) for inside, text in everything if inside or own) for own in (False, True))
    article = articles and held >= LEAST_ARTICLE * left
    return [text for inside, text in everything if inside or not article]


def main_text(page: str | None, deleted: frozenset[int] = frozenset()) -> str:
    """A page's text; ``deleted`` are elements, numbered in page order, to leave out."""
    return "\n\n".join(blocks(Page(page or ""), deleted.__contains__))


def host_column():
    return F.coalesce(F.lower(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def _rows(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host and ``row``, which is equal for pages of equal url and html."""
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", html.alias("html"), host_column().alias("host")).withColumn("row", F.xxhash64("url", "html"))


def subtrees(pages: DataFrame) -> DataFrame:
    """(host, row, element, hash, around): the subtrees of each page that may be templates."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(h, r, i, x, around) for h, r, page in zip(batch["host"], batch["row"], batch["html"], strict=True) for i, x, around in subtree_hashes(Page(page))]
            out = pd.DataFrame(rows, columns=["host", "row", "element", "hash", "around"])
            for name in ("hash", "around"):
                out[name] = out[name].to_numpy("u8").view("i8") if len(out) else out[name].astype("i8")
            yield out

    return _rows(pages).select("host", "row", "html").mapInPandas(hashed, "host string, row long, element int, hash long, around long")


def templates(found: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, hash, pages): subtrees on at least so many pages of a host."""
    # One row per different page (inside an article: per different article) and hash before counting: copies count once.
    return found.groupBy("host", "hash", "around").agg(F.lit(1).alias("one")).groupBy("host", "hash").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least_pages)


def extracted(pages: DataFrame, least_pages: int = LEAST_PAGES, broadcast: int = BROADCAST_TEMPLATES) -> DataFrame:
    """page_id, url, text, n_chars, templates_removed (subtrees deleted by their counts, outermost
    ones) for each page."""
    spark = pages.sparkSession
    schema = "page_id long, url string, text string, templates_removed int"

    def read(page: Page, recurring) -> tuple[str, int]:
        removed = 0

        def deleted(element: int) -> bool:
            nonlocal removed
            removed += element in recurring
            return element in recurring

        return "\n\n".join(blocks(page, deleted)), removed

    recurring = written(templates(subtrees(pages), least_pages).select("host", "hash"), "templates")
    rows = _rows(pages)
    if recurring.count() <= broadcast:
        # Checked: at most ``broadcast`` numbers, one for each template of a host.
        keys = recurring.select(F.col("hash").bitwiseXOR(F.xxhash64("host")).alias("key")).toPandas()["key"]
        known = spark.sparkContext.broadcast(np.sort(keys.to_numpy("i8").view("u8")))

        def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            table = known.value
            for batch in batches:
                found = []
                for seed, source in zip(batch["seed"].to_numpy("i8").view("u8"), batch["html"], strict=True):
                    page = Page(source)
                    mine = subtree_hashes(page)
                    keys = np.array([x for _, x, _ in mine], "u8") ^ seed
                    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
                    hit = table[at] == keys if len(table) and len(keys) else np.zeros(len(keys), bool)
                    found.append(read(page, {mine[i][0] for i in np.flatnonzero(hit)}))
                yield batch[["page_id", "url"]].assign(text=[t for t, _ in found], templates_removed=[n for _, n in found])

        out = rows.select("page_id", "url", "html", F.xxhash64("host").alias("seed")).mapInPandas(texts, schema)
    else:
        # Too many: each page's deletions go to it by a join.
        doomed = subtrees(pages).join(recurring, ["host", "hash"], "left_semi").groupBy("row").agg(F.collect_set("element").alias("doomed"))

        def joined_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [read(Page(page), frozenset() if d is None else frozenset(map(int, d))) for page, d in zip(batch["html"], batch["doomed"], strict=True)]
                yield batch[["page_id", "url"]].assign(text=[t for t, _ in found], templates_removed=[n for _, n in found])

        out = rows.join(doomed, "row", "left").select("page_id", "url", "html", "doomed").mapInPandas(joined_texts, schema)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "templates_removed")
