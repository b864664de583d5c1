"""Main text of web pages by two passes over text blocks: densities decide, short undecided blocks follow their neighbours."""
from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import table
from touchline.llm.registry import query

#: Frequent function words of English, German, French and Spanish.
STOP = frozenset("""the of and to in is it that this for on with as was are be by an at from or not have has he she they you we his her but
der die das und ist ein eine den dem des zu von mit auf für nicht sich im auch als an bei er sie es wir ich war
le la les un une des du de et est en que qui dans pour par sur pas au aux avec ce il elle ne se nous vous
el los las una y del al es que en por con para no se su lo como más pero sus o""".split())
LONG_WORDS, STOP_SHARE, LINK_SHARE = 12, 0.15, 0.5

BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5
h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object canvas math textarea select button title head audio video".split())
ASIDE = frozenset("nav menu aside footer form dialog search".split())
HOLDS = frozenset(("article", "main"))
#: An open element of the first kind is ended by a new one of the second.
ENDS = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
OFF = re.compile(r"""^(?:nav(?:bar|igation)?|menus?|header|footer|masthead|topbar|sidebars?|aside|ads?|advert\w*|adverts?|sponsor\w*|promo\w*|banner|cookies?|notices?|alerts?
|consent|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|comments?|commentlist|commenters?|disqus|replies|reply|respond|discussion|social|shar(?:e|ing)
|related|recommend\w*|breadcrumbs?|pag(?:er|ination)|widgets?|toolbar|copyright|legal|disclaimer|search|form|paywall|skip)$""".replace("\n", ""))
BODY = frozenset("content article main post entry story body text".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>|<[!?][^>]*+>""", re.S)
#: Every name with its value is consumed, so names are never found inside values or longer names.
_ATTR = re.compile(r"""([^\s"'>/=][^\s"'>/=]*+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
COMMENT = re.compile(r"^comment(?:s|ers?|ing|s?(?:area|author|block|body|box|container|count|form|list|meta|reply|section|text|thread|wrap(?:per)?)s?)?$")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


class Block(NamedTuple):
    text: str
    linked: int  # characters inside links
    aside: bool  # inside a menu, header, footer, sidebar, notice, advert, form or comments
    held: bool  # inside article or main


def _off(tag: str, attrs: str, held: bool) -> bool:
    if tag in ASIDE or (tag == "header" and not held):
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id"):
            for one in value.split():
                parts = [p.lower() for p in _PART.findall(one)]
                if any(COMMENT.match(p) for p in parts) or (any(OFF.match(p) for p in parts) and not BODY & set(parts)):
                    return True
    return False


def blocks(page: str) -> list[Block]:
    """Text blocks in page order. Comments, scripts, styles and the head are left out; end tags may be missing."""
    out, buf, linked = [], [], 0
    stack: list[tuple[str, bool, bool]] = []  # tag, aside, held
    link, at, n = 0, 0, len(page)

    def flush():
        nonlocal linked
        text = " ".join("".join(buf).split())
        if text:
            out.append(Block(text, linked, bool(stack) and stack[-1][1], bool(stack) and stack[-1][2]))
        buf.clear()
        linked = 0

    def add(raw: str):
        nonlocal linked
        if raw:
            text = entities.unescape(raw)
            buf.append(text)
            linked += len(text.strip()) if link else 0

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not closing and not m[3].endswith("/"):
                end = _END[tag].search(page, at)
                if end is not None:
                    at = end.end()
                elif tag != "head":  # an open head ends at the body
                    at = n
            continue
        if tag == "a":
            link = 0 if closing else 1
        elif tag == "br":
            buf.append(" ")
        elif tag in BLOCK:
            flush()
            link = 0
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            elif tag not in VOID:
                while stack and tag in ENDS.get(stack[-1][0], ()):
                    stack.pop()
                _, aside, held = stack[-1] if stack else ("", False, False)
                stack.append((tag, aside or _off(tag, m[3], held), held or tag in HOLDS))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article of a page: kept blocks joined by two newlines; empty if none.

    Blocks inside menus, headers, footers, sidebars, notices, adverts, forms and comments are out by their place. If the page has an article (or
    main) element, only blocks inside it remain. First pass: mostly linked text is out; long text is in if it has function words or stands in an
    article. Second pass: each other block takes the label of the nearest decided block, in if two are equally near or none is decided.
    """
    found = [b for b in blocks(page or "") if not b.aside]
    if any(b.held for b in found):
        found = [b for b in found if b.held]
    label = []
    for b in found:
        words = b.text.lower().split()
        stops = sum(w.strip(".,;:!?\"'()|") in STOP for w in words) / len(words)
        if b.linked > LINK_SHARE * len(b.text):
            label.append(False)
        elif len(words) >= LONG_WORDS and (b.held or stops >= STOP_SHARE):
            label.append(True)
        else:
            label.append(None)
    return "\n\n".join(b.text for b, keep in zip(found, _inherit(label)) if keep)


def _inherit(label: list[bool | None]) -> list[bool]:
    n = len(label)
    before, after = [None] * n, [None] * n
    last = None
    for i in range(n):
        last = i if label[i] is not None else last
        before[i] = last
    last = None
    for i in range(n - 1, -1, -1):
        last = i if label[i] is not None else last
        after[i] = last
    out = []
    for i, x in enumerate(label):
        if x is None:
            near = [j for j in (before[i], after[i]) if j is not None]
            least = min((abs(j - i) for j in near), default=0)
            x = not near or any(label[j] for j in near if abs(j - i) == least)
        out.append(x)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages (page_id, url, html). A null or empty html gives an empty text; repeated rows stay."""
    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return html.map(main_text)

    return pages.select("page_id", "url", text(F.coalesce("html", F.lit(""))).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


@query("op10_html_text")
def op10_html_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
