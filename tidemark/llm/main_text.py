"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import table, text_batches
from tidemark.llm.registry import query

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table caption colgroup tbody td tfoot th thead tr ul br".split())
# A start tag that ends an open element, unless one of the fences lies between.
_CLOSES = {
    **{t: (("p",), ()) for t in _BLOCK - {"br", "body", "html", "head", "option", "optgroup", "td", "th", "tr", "caption",
                                         "tbody", "thead", "tfoot", "colgroup", "legend", "summary"}},
    "li": (("li", "p"), ("ul", "ol", "menu")), "dt": (("dt", "dd", "p"), ("dl",)), "dd": (("dt", "dd", "p"), ("dl",)),
    "tr": (("tr", "td", "th", "p"), ("table",)), "td": (("td", "th", "p"), ("tr", "table")),
    "th": (("td", "th", "p"), ("tr", "table")), "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)), "option": (("option",), ("select",)),
    "body": (("head",), ()),
}
_NOISE_TAGS = frozenset(
    "script style noscript template head title nav footer aside form button select option textarea iframe object embed "
    "svg canvas menu dialog input label search noembed noframes audio video map xmp".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar tablist "
    "status marquee".split())
_NOISE_WORDS = frozenset(
    "nav navbar navigation navigations menu menus breadcrumb breadcrumbs sidebar sidebars aside footer foot header masthead "
    "topbar banner banners ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos "
    "promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay comment comments commentlist "
    "disqus respond reply replies share sharing social related recommended recommendations newsletter subscribe subscription "
    "signup login register search searchbox searchform widget widgets pagination pager paging copyright legal disclaimer "
    "skip toolbar tags tagcloud byline-share toc outbrain taboola hidden".split())
# Words of the page's layout that may stand before and after them: "site-footer", "comment-list".
_SCOPES = frozenset("site global main top bottom left right primary secondary mobile desktop sticky fixed floating".split())
_LAYOUT = frozenset(
    "list lists item items links link button buttons btn icon icons bar box panel wrapper wrap inner outer container holder "
    "section row col column columns content primary secondary main top bottom left right mobile desktop sticky fixed floating "
    "slot toggle dropdown".split())
# Further names that say noise as a whole.
_NOISE_NAMES = frozenset(
    "related-posts related-articles related-stories related-news related-topics social-media-links "
    "social-media-icons social-icons search-form comment-form comments-area comment-body comment-meta comment-author "
    "newsletter-form signup-form login-form widget-area ad-unit ad-space ad-label ad-banner sign-up skip-to-content "
    "back-to-top tag-cloud".split()
) | frozenset(f"{a}-{b}" for a in ("post", "entry", "article") for b in (
    "nav", "navigation", "footer", "comments", "share", "sharing", "tags", "related", "pagination"))
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NAMED = ("class", "id", "role", "hidden", "aria-hidden", "style", "itemprop")


class Page:
    """A page's elements in page order, with their texts, as parallel lists."""

    def __init__(self, source: str):
        self.tag, self.parent, self.attributes = ["#root"], [-1], [{}]
        # What an element holds, in order: numbers of elements and strings.
        self.content: list[list] = [[]]
        self._open, self._count = [0], {}
        self._read(source)

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            less = source.find("<", at)
            if less < 0:
                self._text(source[at:])
                return
            if less > at:
                self._text(source[at:less])
            if source.startswith("<!--", less):
                end = source.find("-->", less + 4)
                # An open comment ends with its tag rather than with the page.
                at = end + 3 if end >= 0 else self._behind(source, less)
            elif source.startswith(("<!", "<?"), less):
                at = self._behind(source, less)
            else:
                found = _TAG.match(source, less) or _LOOSE_TAG.match(source, less)
                if not found:
                    after = source[less + 1:less + 2]
                    if after == "/" and source.find(">", less) >= 0:
                        at = self._behind(source, less)  # no name: browsers take it for a comment
                        continue
                    if after == "/" or after.isascii() and after.isalpha():
                        return  # a tag cut off by the end of the page
                    self._text("<")
                    at = less + 1
                    continue
                at = found.end()
                name = found[2].lower()
                if found[1]:
                    self._end(name)
                    continue
                self._start(name, found[3])
                if name in _RAW:
                    closing = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                    end = closing.start() if closing else n
                    self._end(name)
                    at = self._behind(source, end) if closing else n

    @staticmethod
    def _behind(source: str, at: int) -> int:
        end = source.find(">", at)
        return end + 1 if end >= 0 else len(source)

    def _text(self, text: str) -> None:
        self.content[self._open[-1]].append(text)

    def _start(self, name: str, rest: str) -> None:
        closes, fences = _CLOSES.get(name, ((), ()))
        if any(self._count.get(c) for c in closes):
            for k in range(len(self._open) - 1, 0, -1):
                tag = self.tag[self._open[k]]
                if tag in closes:
                    self._close(k)
                    if name in ("li", "dt", "dd", "tr", "td", "th", "tbody", "tfoot") and tag == "p":
                        continue
                    if tag in ("td", "th") and name in ("tr", "tbody", "tfoot") or tag == "tr" and name in ("tbody", "tfoot"):
                        continue
                    break
                if tag in fences or (not fences and tag in _BLOCK) or (fences and tag in ("div", "section", "article")):
                    break
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(self._open[-1])
        own = {}
        if rest.strip(" /"):
            for key, value in _ATTRIBUTE.findall(rest):
                key = key.lower()
                if key in _NAMED and key not in own:
                    own[key] = html.unescape(value.strip("\"'"))
        self.attributes.append(own)
        self.content.append([])
        self.content[self._open[-1]].append(node)
        if name not in _VOID:
            self._open.append(node)
            self._count[name] = self._count.get(name, 0) + 1

    def _end(self, name: str) -> None:
        if not self._count.get(name):
            return
        for k in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[k]]
            if tag == name:
                self._close(k)
                return
            if name not in _BLOCK and tag in _BLOCK:
                return  # an inline end tag does not end the blocks inside

    def _close(self, k: int) -> None:
        for node in self._open[k:]:
            self._count[self.tag[node]] -= 1
        del self._open[k:]


def _noise_name(value: str) -> bool:
    """Whether one of the names says noise as a whole; a title's slug that only begins or ends like that does not."""
    for name in value.lower().split():
        words = [w for w in re.split(r"[-_]+", name) if w]
        if not words or words[0] in ("has", "with", "no", "is", "js", "page", "body", "single", "template"):
            continue
        if name in _NOISE_WORDS or "-".join(words) in _NOISE_NAMES:
            return True
        start = next((k for k, w in enumerate(words) if w not in _SCOPES), len(words))
        end = next((k for k in range(start, len(words)) if words[k] not in _NOISE_WORDS), len(words))
        if end > start and all(w in _LAYOUT or w[0].isdigit() for w in words[end:]):
            return True
    return False


def _noise(page: Page, node: int, holds_title: list[bool], in_article: list[bool], titled: list[bool]) -> bool:
    tag, own = page.tag[node], page.attributes[node]
    if tag in _NOISE_TAGS:
        return True
    if tag == "header":  # of the site; an article's own header holds its title
        return not (in_article[node] and holds_title[node])
    if not own:
        return False
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or own.get("role", "").lower() in _NOISE_ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", ""), re.I):
        return True
    if tag in ("html", "body", "main") or tag in ("h1", "article") and not _noise_name(own.get("class", "")):
        return False
    # Ids of headings, and of an article's sections with headings, are slugs of the titles.
    slug = tag in _HEADINGS or tag == "section" and in_article[node] and titled[node]
    return not holds_title[node] and (_noise_name(own.get("class", "")) or not slug and _noise_name(own.get("id", "")))


# A block outside the core belongs to the text if its density sum is this share of the core's.
PART = 0.1


def kept_texts(page: Page) -> tuple[list[bool], list[list]]:
    """(dropped, texts): which elements say that they are noise, or lie in one that does; what the others hold, decoded."""
    n = len(page.tag)
    holds_title, in_article, titled = [False] * n, [False] * n, [False] * n
    for k in range(n - 1, 0, -1):
        if page.tag[k] in ("h1", "main"):
            holds_title[k] = True
        if holds_title[k]:
            holds_title[page.parent[k]] = True
        if titled[k] or page.tag[k] in _HEADINGS:
            titled[page.parent[k]] = True
    dropped = [False] * n
    for k in range(1, n):
        up = page.parent[k]
        in_article[k] = in_article[up] or page.tag[up] in ("article", "main")
        dropped[k] = dropped[up] or _noise(page, k, holds_title, in_article, titled)
    return dropped, [[x if isinstance(x, int) else html.unescape(x) for x in c] if not d else []
                     for c, d in zip(page.content, dropped)]


class Densities:
    """Characters, tags and links below every kept node; its composite density, and the sum over its children."""

    def __init__(self, page: Page, dropped: list[bool], texts: list[list]):
        n = len(page.tag)
        self.chars, self.tags, self.link_chars, self.link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        linked = [False] * n
        for k in range(1, n):
            linked[k] = linked[page.parent[k]] or page.tag[k] == "a"
        for k in range(n - 1, -1, -1):
            self.chars[k] += sum(len(" ".join(x.split())) for x in texts[k] if not isinstance(x, int))
            if linked[k]:
                self.link_chars[k] = self.chars[k]
            if k and not dropped[k]:
                up = page.parent[k]
                self.chars[up] += self.chars[k]
                self.tags[up] += self.tags[k] + 1
                self.link_chars[up] += self.link_chars[k]
                self.link_tags[up] += self.link_tags[k] + (page.tag[k] == "a")
        self.body = next((k for k in range(n) if page.tag[k] == "body" and self.chars[k]), 0)
        self.share = self.link_chars[self.body] / max(self.chars[self.body], 1)
        self.dense = [0.0 if dropped[k] else self.of(self.chars[k], self.tags[k], self.link_chars[k], self.link_tags[k]) for k in range(n)]
        self.sums = [0.0] * n
        for k in range(n):
            for x in texts[k]:
                if isinstance(x, int):
                    self.sums[k] += self.dense[x]
                elif x.strip():  # a text of its own counts as a child
                    c = len(" ".join(x.split()))
                    self.sums[k] += self.of(c, 1, c if linked[k] else 0, int(linked[k]))
        self.inside = [False] * n
        self.inside[self.body] = True
        for k in range(self.body + 1, n):
            self.inside[k] = self.inside[page.parent[k]] and not dropped[k]

    def of(self, chars: int, tags: int, link_chars: int, link_tags: int) -> float:
        """Characters per tag, less for those in links."""
        if not chars:
            return 0.0
        base = math.log(chars / max(chars - link_chars, 1) * link_chars + self.share * chars + math.e)
        odd = max(chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1), 1.0)
        return chars / max(tags, 1) * (math.log(odd) / math.log(base) if base > 1.0 else math.log(odd + 1))


def select(page: Page, d: Densities) -> tuple[int, list[int], list[bool]]:
    """(core, roots, thin): the node of largest density sum, the subtrees that make up the text, and blocks in them that do not.

    The least density on the path from body to the core is the threshold.  Blocks beside the
    path that reach half of it, and in sum a PART of the core, belong to the text.  Blocks
    inside with three quarters of their characters in links do not if they are below it.
    """
    n = len(page.tag)
    core = max((k for k in range(n) if d.inside[k]), key=lambda k: (d.sums[k], -k))
    path = [core]
    while path[-1] != d.body and page.parent[path[-1]] >= 0:
        path.append(page.parent[path[-1]])
    root = next((k for k in path if page.tag[k] in ("article", "main") or page.attributes[k].get("role") == "main"
                 or "articlebody" in page.attributes[k].get("itemprop", "").lower()), core)
    threshold = min(d.dense[k] for k in path)
    beside = set(path[path.index(root) + 1:])
    roots = sorted([root, *(
        k for k in range(n) if d.inside[k] and page.parent[k] in beside and k not in path and page.tag[k] in _BLOCK
        and d.dense[k] >= threshold / 2 and d.sums[k] >= PART * d.sums[core] and d.link_chars[k] * 2 < d.chars[k])])
    thin = [d.inside[k] and k not in path and page.tag[k] in _BLOCK and d.link_tags[k] > 1
            and d.link_chars[k] * 4 > d.chars[k] * 3 and d.dense[k] < threshold for k in range(n)]
    return core, roots, thin


def main_text(source: str | None) -> str:
    """The main text of a page, "" if there is none.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts and comments that say
    what they are are dropped.  Of every other node the characters per tag are taken,
    less where they lie in links; the node whose children's densities have the largest
    sum is the core of the text.  The text is that of the article around the core, or the
    core, and of other blocks dense enough, without link lists (``select``).
    """
    if not source:
        return ""
    page = Page(source)
    dropped, texts = kept_texts(page)
    d = Densities(page, dropped, texts)
    if not d.chars[d.body]:
        return ""
    _, roots, thin = select(page, d)
    parts: list[str] = []
    for root in roots:
        todo: list = [root]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts.append(x)
            elif not dropped[x] and not thin[x]:
                edge = page.tag[x] in _BLOCK
                if edge:
                    todo.append(" ")
                todo.extend(reversed(texts[x]))
                if edge:
                    todo.append(" ")
        parts.append(" ")
    return " ".join("".join(parts).split())


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``; a null html is an empty page.

    Pages are read where they lie; nothing is shuffled.  Repeated rows give a row each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 128):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    ).mapInArrow(run, "page_id long, url string, text string, n_chars long")


@query("op8_text_density")
def text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
