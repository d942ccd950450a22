"""Main text of web pages by two-pass block rules.

First pass: every block is judged alone by link density, length and stop-word density, and by what it stands
in (menus, page headers and footers, sidebars, forms, adverts, notices and reader comments are never main text).
Second pass: blocks that are too short to tell take the label of the nearest decided neighbours, first
among the blocks of their own section, then of the page.
"""

from __future__ import annotations

import html as references
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrforge.llm.runtime import small_batches

#: Common words by language; the density of the best-fitting list counts.
STOP_WORDS = [
    frozenset(words.split())
    for words in (
        "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all we her she there would their has been if will can more no what when who so",
        "de la le les et des en un une du que est pour qui dans a par plus pas au sur ne se ce il sont la mais ou avec son ont cette elle on nous vous leur été aux sa comme tout fait",
        "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis",
        "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde",
    )
]
#: A block with so many letters is judged by its stop words; a shorter one asks its neighbours.
LONG, LINKED, STOPPED = 70, 0.33, 0.12

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video noembed noframes xmp".split())
NEVER = frozenset("nav footer aside button select menu dialog head search fieldset optgroup option legend".split())
SECTIONS = frozenset("article main section body div aside nav header footer form td".split())
#: Words of class, id and role that mark what is no main text, alone or with words that only say where or what kind of box.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs consent contentinfo cookie cookies "
    "copyright dialog footer form gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination paywall popup "
    "promo promoted promotion recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar topbar widget".split()
)
PLACES = frozenset("area aside bar bottom box block buttons col column container fixed global group inner items left links list main mobile outer page panel primary right row secondary section site sticky top wrap wrapper".split())
#: Words that mark reader comments with any other word beside them but those that deny.
COMMENTS = frozenset("comment comments comentarios commentaires kommentare disqus replies reply respond".split())
DENIALS = frozenset("no not without with has hide off".split())
#: A marked element with more of the page's text than this, or with the article in it, is the page's frame.
FRAME = 0.8
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)""", re.DOTALL)
_HINTS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")


def _marked(attributes: str, article: bool) -> bool:
    if not attributes.strip():
        return False
    if _HIDDEN.search(attributes):
        return True
    for groups in _HINTS.findall(attributes):
        for token in "".join(groups).split():
            parts = set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower())) - {""}
            marks = parts & (MARKS - {"header", "masthead"} if article else MARKS)
            if (marks and parts <= marks | PLACES) or (parts & COMMENTS and not parts & DENIALS):
                return True
    return False


def blocks(page: str) -> list[dict]:
    """Blocks with text in page order: text, linked letters, section number, inside article or main, never main text."""
    out: list[dict] = []
    # open elements: (name, number, in article, never main text, numbers of the marked ones around)
    stack: list[tuple[str, int, bool, bool, tuple[int, ...]]] = [("", 0, False, False, ())]
    frames: set[int] = set()  # marked elements that hold the article
    number, at, links, link_depth = 0, 0, 0, 0
    parts: list[tuple[str, bool]] = []

    def flush() -> None:
        if parts:
            text = " ".join(references.unescape("".join(t for t, _ in parts)).split())
            if text:
                linked = len("".join(references.unescape("".join(t for t, is_link in parts if is_link)).split()))
                section = next((x[1] for x in reversed(stack) if x[0] in SECTIONS), 0)
                out.append({"text": text, "linked": linked, "section": section, "article": stack[-1][2], "never": stack[-1][3], "marks": stack[-1][4]})
            parts.clear()

    def close(name: str) -> None:
        if any(x[0] == name for x in stack[1:]):
            while stack.pop()[0] != name:
                pass

    size = len(page)
    while at < size:
        found = _TAG.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            parts.append((text, links > 0))
        if not found:
            break
        at = found.end()
        name = (found[2] or found[6] or "").lower()
        if not name:
            continue
        closing, attributes = (found[1] or found[5]) == "/", found[3] or found[7] or ""
        if name == "a":
            links, link_depth = (0, 0) if closing else (1, len(stack))
            continue
        if name in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)|\Z", re.IGNORECASE).search(page, at)
                at = end.end()
            continue
        if name == "br":
            parts.append((" ", False))
            continue
        if name not in BLOCKS:
            continue
        flush()
        if closing:
            close(name)
        else:
            if stack[-1][0] == "p":
                stack.pop()
            if name == "li" and stack[-1][0] == "li":
                stack.pop()
        if len(stack) < link_depth:  # the element that the link was opened in is closed
            links = 0
        if closing or name in VOID:
            continue
        _, _, article, never, marks = stack[-1]
        number += 1
        if name in ("article", "main") and not article:
            article = True
            frames.update(marks)
        never = never or name in NEVER or (name == "header" and not article)
        if name == "form" or (name not in ("body", "html", "main", "article") and _marked(attributes, article)):
            marks = (*marks, number)
        stack.append((name, number, article, never, marks))
    flush()
    total = sum(len(b["text"]) for b in out if not b["never"])
    held: dict[int, int] = {}
    for b in out:
        for mark in b["marks"] if not b["never"] else ():
            held[mark] = held.get(mark, 0) + len(b["text"])
    frames.update(mark for mark, n in held.items() if n > FRAME * total)
    for b in out:
        b["never"] = b["never"] or not frames.issuperset(b["marks"])
    return out


def _stops(text: str) -> tuple[int, int]:
    """Words of a block, and those on the list that fits it best."""
    words = _WORD.findall(text.lower())
    return len(words), max(sum(map(listed.__contains__, words)) for listed in STOP_WORDS)


def _first_pass(block: dict, listed: bool) -> bool | None:
    """True: main text. False: not. None: too short to tell. Stop words count only if the page's language is listed."""
    if block["never"] or block["linked"] and block["linked"] > LINKED * len(block["text"].replace(" ", "")):
        return False
    if len(block["text"]) < LONG:
        return None
    n, stops = _stops(block["text"])
    return True if not listed or stops >= STOPPED * max(1, n) else None


def classify(found: list[dict]) -> list[bool]:
    counted = [_stops(b["text"]) for b in found if len(b["text"]) >= LONG and not b["never"]]
    listed = sum(stops for _, stops in counted) >= STOPPED / 2 * sum(n for n, _ in counted)
    first = [_first_pass(b, listed) for b in found]
    in_section: dict[int, list[int]] = {}
    for k, b in enumerate(found):
        in_section.setdefault(b["section"], []).append(k)
    # runs of undecided blocks settle in one sweep: nearest decided neighbours by section, then by page
    out: list[bool] = [bool(x) for x in first]
    page = _nearest_labels(first, list(range(len(found))))
    article_good = any(good for good, b in zip(first, found, strict=True) if b["article"])
    for where in in_section.values():
        section_good = any(first[k] for k in where)
        own = _nearest_labels([first[k] for k in where], list(range(len(where))))
        for i, k in enumerate(where):
            if first[k] is None:
                near = own[i]
                if near is None:
                    near = True if found[k]["article"] else page[k]
                elif not near and found[k]["article"]:
                    near = section_good or not article_good
                out[k] = bool(near)
    return out


def _nearest_labels(labels: list[bool | None], where: list[int]) -> list[bool | None]:
    """For each place, the label of the nearest decided one (of two as near, main text wins)."""
    before: list[tuple[int, bool] | None] = []
    held = None
    for i in where:
        if labels[i] is not None:
            held = (i, bool(labels[i]))
        before.append(held)
    out: list[bool | None] = [None] * len(where)
    held = None
    for i in reversed(where):
        if labels[i] is not None:
            held = (i, bool(labels[i]))
        near = [(abs(x[0] - i), not x[1]) for x in (before[i], held) if x]
        out[i] = not min(near)[1] if near else None
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    return "\n".join(b["text"] for b, good in zip(found, classify(found), strict=True) if good)


def _extract(batches):
    for batch in batches:
        text = [main_text(x or "") for x in batch.column("html").to_pylist()]
        keep = [c for c in batch.schema.names if c != "html"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, keep), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], [*keep, "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id long, url string, html string, ...) -> page_id, url, text, n_chars, one row per input row.

    Null, empty and textless pages give the empty text. Unclosed elements, comments and tags end with the page. Rows
    repeat as they come; other columns are ignored; pages are read whole.
    """
    small_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
