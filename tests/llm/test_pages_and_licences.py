"""Page extraction as a table and on marked frames; licence scans against a plain search for the base phrases."""

import re

import pytest

from addrforge.llm import html_text, license_scan

LONG = "The first of the paragraphs is long enough for it to be told by the words that are in it, and so it is kept."


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="content with-sidebar"><p>{LONG}</p></div>', f'<div class="no-comments"><p>{LONG}</p></div>', f'<div id="social-history"><p>{LONG}</p></div>', f'<div class="market share"><p>{LONG}</p></div>',
        f'<form id="aspnetForm"><div><p>{LONG}</p></div><div class="menu"><p>x y</p></div></form>', f'<div class="ad"><article><p>{LONG}</p></article></div>', f'<div class="page"><p>{LONG}</p></div><form><p>Your name and all of the other things that we ask of you here</p></form>',
    ],
)
def test_frames_and_compounds_are_no_marks(page):
    assert html_text.main_text(page) == LONG


def test_headers_of_articles_stay_and_links_around_blocks_count():
    assert html_text.main_text(f'<article><div class="post-header"><h1>A title</h1></div><p>{LONG}</p></article>') == f"A title\n{LONG}"
    assert html_text.main_text(f'<article><header class="header"><h1>A title</h1></header><p>{LONG}</p></article>') == f"A title\n{LONG}"
    assert html_text.main_text(f'<div><p>{LONG}</p></div><div><a href="x"><div>{LONG}</div></a></div>') == LONG
    assert html_text.main_text(f'<div><p>{LONG}</p></div><div class="post-comments"><p>{LONG} I say.</p></div>') == LONG


def test_languages_without_a_list():
    text = "Pitkät kappaleet ilman linkkejä kuuluvat sivun varsinaiseen tekstiin, vaikka yksikään sanalista ei tunne niitä lainkaan."
    assert html_text.main_text(f"<nav>Etusivu</nav><div><p>{text}</p></div><footer>Yhteys</footer>") == text


def test_pages_as_a_table(spark):
    page = f"<p>{LONG}</p>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (None, None, page, None), (2, None, None, "y"), (3, "v", "", "z"), (4, "w", "<p>" + f"{LONG} " * 3000, "z")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((repr(r["page_id"]), r["url"], r["text"], r["n_chars"]) for r in html_text.extract(table).collect())
    want = [(repr(i), u, html_text.main_text(h or ""), len(html_text.main_text(h or ""))) for i, u, h, _ in rows]
    assert got == sorted(want, key=repr) or sorted(got, key=repr) == sorted(want, key=repr)
    assert html_text.extract(table.limit(0)).count() == 0


def test_base_phrases_equal_a_plain_search(spark):
    texts = ["cc by cc by CC-BY", "all rights reserved all rights reserved.", "General   Public\nLicense", "acc by cc byte", "ccé by", "cc by " * 5000, "", None, "cc\x1cby ünï cc by", "all rights all rights reserved"]
    table = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, labels string, n_words int")
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in license_scan.scan(table).collect()}
    for i, t in enumerate(texts):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
        hits = [(k, label) for phrase, label in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        places = [k for k, _ in hits]
        assert got[i] == (len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits})))


def test_names_and_bare_words():
    scanner = license_scan.Scanner()
    labels = lambda text: {d[2] for d in scanner.scan(text)[2]}
    assert "mit" in labels("MIT License") & labels("it is MIT licensed") & labels("license: MIT")
    assert not labels("Der Aal schwimmt") and "aal" in labels("SPDX-License-Identifier: AAL") and "wtfpl" in labels("the WTFPL license")
