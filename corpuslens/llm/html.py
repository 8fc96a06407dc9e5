"""Main text of web pages, by removing the templates of their sites.

Each page is parsed once into blocks of text. A block knows the hashes of the element subtrees around it. Spark counts
each subtree once per distinct content of a host's pages, so copies of a page are one; a block goes if a subtree around it
recurs. Menus, footers, forms, scripts, notices, comments and the like are left out by their element or by their class,
id or role. If a page marks its content (``article`` if that holds most of the text in both, else ``main``), only that
counts, and there a subtree must be on most pages to go, since articles may share paragraphs; one that holds all marked
content of a page never goes from that page.

Defined results: null or empty html has an empty text; a null url has the host "" with all others like it; broken markup
is read as far as it goes; repeated rows get equal texts and count once; an empty table gives an empty table.
Only the id, url and html columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import pieces
from corpuslens.session import written

# A subtree is of the template from this share of a host's contents and this number on; inside marked content the second.
# Few contents must agree by a large share, many by a far lower one. Articles of one host have been seen to share real
# paragraphs at 12 %, so the lower share is higher there.
SHARE, PAGES = 0.3, 5
MANY_SHARE, MANY_PAGES = 0.01, 50
INNER_SHARE, INNER_PAGES = 0.6, 10
INNER_MANY_SHARE, INNER_MANY_PAGES = 0.25, 100

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|[^<]+|<", re.DOTALL
)
MARK = re.compile(r"""(?<![\w-])(class|id|role|aria-label|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = set(
    "head nav footer aside form button select option datalist input label fieldset svg canvas object template dialog menu "
    "video audio map".split()
) | set(RAW)
# Elements that stand in a line of text; all others begin and end a block.
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
# An open element of the first kind ends where one of the second begins.
CLOSED_BY = {
    "p": None,
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
    "option": {"option", "optgroup"},
}
BOILERPLATE = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar "
    "navigation menu submenu breadcrumb breadcrumbs pagination pager masthead topbar toolbar footer sidebar sidebars widget "
    "widgets related recommended recommendations share sharing social cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login search comment comments commentlist disqus reply replies "
    "respond copyright contentinfo complementary dialog skip".split()
)
PAGE_HEAD = {"header", "head", "heading"}


class Element:
    __slots__ = ("tag", "parts", "blocks")

    def __init__(self, tag: str):
        self.tag, self.parts, self.blocks = tag, [tag], []


def left_out(tag: str, attributes: str, level: int) -> bool:
    """Whether an element is outside the main text by its name or marks; ``level`` > 0 is inside marked content."""
    if tag in LEFT_OUT or (tag == "header" and not level):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, value in MARK.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        elif name in ("class", "id", "role"):
            words = set(re.split(r"[\s_-]+", value))
            if words & BOILERPLATE or (not level and tag not in ("article", "main") and words & PAGE_HEAD):
                return True
    return False


def blocks(html: str) -> list[tuple[str, list[int], int]]:
    """Text blocks in page order: text, hashes of the subtrees around it, and 2 in an article, 1 in main, else 0."""
    root = Element("#")
    stack, levels = [root], [0]
    found: list[list] = []
    line: list[str] = []
    skipped = 0  # depth of the stack at which text began to be left out

    def end_block() -> None:
        text = " ".join(unescape("".join(line)).split()) if line else ""
        line.clear()
        if text:
            block = [text, [], levels[-1]]
            found.append(block)
            stack[-1].parts.append(text)
            stack[-1].blocks.append(block)

    def close(depth: int) -> None:
        nonlocal skipped
        while len(stack) > depth:
            element = stack.pop()
            levels.pop()
            if skipped and len(stack) <= skipped:
                skipped = 0
                continue
            if element.blocks:
                value = xxhash.xxh64_intdigest("\0".join(element.parts)) >> 1
                for block in element.blocks:
                    block[1].append(value)
                stack[-1].blocks += element.blocks
                stack[-1].parts.append(str(value))

    at = 0
    while match := TOKEN.match(html, at):
        at = match.end()
        closing, tag, attributes = match.groups()
        if tag is None:
            text = match[0]
            if not skipped and (text[0] != "<" or text == "<"):
                line.append(text)
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br" and not skipped:
                line.append(" ")
            elif not closing and not skipped and attributes and left_out(tag, attributes, levels[-1]):
                at = _after(html, tag, at)
            continue
        if not skipped:
            end_block()
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                close(depth)
            continue
        if tag in RAW and not attributes.endswith("/"):
            at = _after(html, tag, at)
            continue
        if tag in VOID:
            continue
        top = stack[-1].tag
        if len(stack) > 1 and top in CLOSED_BY and (CLOSED_BY[top] is None or tag in CLOSED_BY[top]):
            close(len(stack) - 1)
        level = max(levels[-1], 2 if tag == "article" else 1 if tag == "main" or 'role="main"' in attributes else 0)
        if not skipped and left_out(tag, attributes, levels[-1]):
            skipped = len(stack)
        if not attributes.endswith("/"):
            stack.append(Element(tag))
            levels.append(level)
        elif skipped == len(stack):
            skipped = 0
    if not skipped:
        end_block()
    close(1)
    return [tuple(block) for block in found]


def main_blocks(found: list[tuple[str, list[int], int]]) -> list[tuple[str, list[int], int]]:
    """The blocks of the page's marked content, or all: articles alone only if they hold most of the marked text."""
    level = max((b[2] for b in found), default=0)
    if level == 2:
        marked, articles = (sum(len(b[0]) for b in found if b[2] >= k) for k in (1, 2))
        level = 2 if 2 * articles > marked else 1
    return [b for b in found if b[2] >= level]


def _after(html: str, tag: str, at: int) -> int:
    """Place after the end tag that follows, or the end of the page."""
    end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(html, at)
    return end.end() if end else len(html)


def parse(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, host, blocks`` with only the blocks of the page's marked content."""
    entry = pa.list_(pa.struct([("text", pa.string()), ("subtrees", pa.list_(pa.int64())), ("inner", pa.bool_())]))

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                rows = []
                for html in part.column(2).to_pylist():
                    kept = main_blocks(blocks(html))
                    marked = any(k for *_, k in kept)
                    # Around all marked content: neither counted nor looked up.
                    whole = set.intersection(*(set(s) for _, s, _ in kept)) if marked else set()
                    rows.append([{"text": t, "subtrees": [x for x in s if x not in whole], "inner": marked} for t, s, _ in kept])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, entry)], names=["page_id", "url", "blocks"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.mapInArrow(run, "page_id long, url string, blocks array<struct<text:string,subtrees:array<long>,inner:boolean>>")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1))
    return rows.select("page_id", "url", host.alias("host"), "blocks")


def distinct_contents(parsed: DataFrame) -> DataFrame:
    """``host, content, subtrees``: one row for all pages of a host with equal texts."""
    # Equal texts in other markup are one content, with the subtrees that sort first.
    subtrees = F.array_sort(F.array_distinct(F.flatten("blocks.subtrees"))).alias("subtrees")
    contents = parsed.select("host", F.sha2(F.to_json("blocks.text"), 256).alias("content"), subtrees)
    return contents.groupBy("host", "content").agg(F.min("subtrees").alias("subtrees"))


def templates(contents: DataFrame) -> DataFrame:
    """``host, subtree, inner``: the recurring subtrees of each host, and whether they recur enough for marked content."""
    pages = contents.groupBy("host").agg(F.count("*").alias("pages"))
    counts = contents.select("host", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree")
    counts = counts.agg(F.count("*").alias("n")).where(f"n >= {PAGES}").join(pages, "host")
    outer = f"n >= {SHARE} * pages OR (n >= {MANY_PAGES} AND n >= {MANY_SHARE} * pages)"
    inner = (
        f"(n >= {INNER_PAGES} AND n >= {INNER_SHARE} * pages)"
        f" OR (n >= {INNER_MANY_PAGES} AND n >= {INNER_MANY_SHARE} * pages)"
    )
    return counts.where(outer).select("host", "subtree", F.expr(inner).alias("inner"))


def template_parts(parsed: DataFrame, recurring: DataFrame) -> DataFrame:
    """``row, template``: the recurring subtrees of every page that has any."""
    parts = parsed.select(
        "row", "host", F.exists("blocks", lambda block: block["inner"]).alias("marked"),
        F.explode(F.array_distinct(F.flatten("blocks.subtrees"))).alias("subtree"),
    )
    parts = parts.join(recurring, ["host", "subtree"]).where("inner OR NOT marked")
    return parts.groupBy("row").agg(F.collect_list("subtree").alias("template"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every page; blocks of the text are joined by line ends."""
    # The number of a row is written with it, so it stays the same whenever it is read.
    rows = parse(pages, id_col, url_col, html_col).withColumn("row", F.monotonically_increasing_id())
    parsed = written(rows, "blocks")
    recurring = written(templates(written(distinct_contents(parsed), "contents")), "templates")
    rows = parsed.join(written(template_parts(parsed, recurring), "parts"), "row", "left")

    def stays(block):
        return ~F.coalesce(F.arrays_overlap(block["subtrees"], F.col("template")), F.lit(False))

    kept = F.transform(F.filter("blocks", stays), lambda block: block["text"])
    text = F.array_join(kept, "\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
