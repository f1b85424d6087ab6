"""What the main text of a page must keep."""

import pytest

from ripplegraph.llm import htmltext

P = [f"Paragraph {i} says a good deal more than a line of a menu does. " * 5 for i in range(18)]
TEXTS = [p.strip() for p in P]


def page(blocks):
    return "".join(f"<p>{b}</p>" for b in blocks)


def test_a_list_and_a_table_within_the_text_do_not_end_it():
    items, cells = [f"short item {i}" for i in range(7)], [f"cell {i}" for i in range(9)]
    rows = "".join(f"<tr><td>{c}</td></tr>" for c in cells)
    html = f"<div>{page(P[:8])}<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>{page(P[8:12])}<table>{rows}</table>{page(P[12:])}</div>"
    assert htmltext.main_text(html).split("\n\n") == [*TEXTS[:8], *items, *TEXTS[8:12], *cells, *TEXTS[12:]]


def test_a_list_of_links_still_ends_the_text():
    links = "".join(f"<li><a href=x>link {i}</a></li>" for i in range(9))
    assert htmltext.main_text(f"{page(P[:8])}<ul>{links}</ul>{page(P[8:10])}").split("\n\n") == TEXTS[:8]


def test_a_marked_article_widens_the_text_and_does_not_replace_it():
    html = f"<div><article><p>Lead.</p>{page(P[:7])}</article>{page(P[7:])}</div>"
    assert htmltext.main_text(html).split("\n\n") == ["Lead.", *TEXTS]
    html = f"<div>{page(P[:9])}<article>{page(P[9:])}<p>End.</p><p><a href=x>Source</a></p></article></div>"
    assert htmltext.main_text(html).split("\n\n") == [*TEXTS, "End.", "Source"]


def test_classes_that_describe_the_layout_are_not_noise():
    for name in ("post type-post category-news tag-travel", "layout has-sidebar", "content no-sidebar", "content with-comments", "wrapper fixed-header"):
        assert htmltext.main_text(f"<div class='{name}'>{page(P)}</div>").split("\n\n") == TEXTS


def test_a_noise_class_does_not_take_the_article_with_it():
    for html in (f"<article>{page(P)}</article>", f"<h1>Title</h1>{page(P)}", page(P)):
        assert htmltext.main_text(f"<div class='sidebar'>{html}</div><p>x</p>").removeprefix("Title\n\n").removesuffix("\n\nx").split("\n\n") == TEXTS
    for name in ("sidebar", "site-footer", "comment-list", "widget", "related-posts", "ad-slot-1"):
        assert htmltext.main_text(f"<h1>Title</h1>{page(P[:9])}<div class='{name}'>{page(P[9:])}</div>").split("\n\n") == ["Title", *TEXTS[:9]]


def test_single_class_words_within_an_article_are_no_noise():
    for name in ("legal", "notice", "side", "tags", "search", "header"):
        assert htmltext.main_text(f"<article>{page(P[:6])}<section class='{name}'>{page(P[6:9])}</section>{page(P[9:])}</article>").split("\n\n") == TEXTS
    for name in ("ad", "comments", "related", "share-buttons", "newsletter-signup"):
        assert htmltext.main_text(f"<article>{page(P[:6])}<div class='{name}'>{page(P[6:9])}</div>{page(P[9:])}</article>").split("\n\n") == TEXTS[:6] + TEXTS[9:]


def test_a_paragraph_that_is_one_link_stays_within_the_text():
    html = f"<div>{page(P[:5])}<p><a href=x>A whole paragraph that is a link</a></p>{page(P[5:])}</div>"
    assert htmltext.main_text(html).split("\n\n") == [*TEXTS[:5], "A whole paragraph that is a link", *TEXTS[5:]]


def test_every_page_is_cut_by_its_windows(monkeypatch):
    """Surge and dive decide every page of the test data, and they are where a plain search over the windows finds them."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.1/pages.parquet").column("html").to_pylist()
    some, spans = htmltext.surge_and_dive, []

    def counted(weights, links=None, prose=None):
        got = some(weights, links, prose)
        spans.append((weights, links, got))
        return got

    monkeypatch.setattr(htmltext, "surge_and_dive", counted)
    texts = [htmltext.main_text(p) for p in pages]
    assert len(spans) == sum(bool(htmltext.lines(p or "")) for p in pages) == len(pages) and all(texts)
    for weights, _, (begin, stop) in spans:
        sums = [sum(weights[j] for j in range(i, min(i + 3, len(weights)))) for i in range(len(weights))]
        heaviest = max(range(len(sums)), key=lambda i: sums[i])
        assert begin <= heaviest + 2 and heaviest < stop
        assert begin == 0 or stop - begin == 1 or max(sums[begin : begin + 1] + sums[max(begin - 2, 0) : begin]) >= htmltext.SURGE
        assert all(sums[i] < htmltext.SURGE or 10 * sums[i] < sum(weights[begin:stop]) for i in [*range(begin - 2), *range(stop, len(sums))])
    for p, t in zip(pages, texts, strict=True):
        inside = p[p.index("<article") : p.index("</article>")]
        assert t == "\n\n".join(x.text for x in htmltext.lines(inside))


def test_time_is_linear_in_broken_markup():
    import time

    for piece in ("<b>x</i>", "<div class='menu'>x", "<a \"x' <p>", "<li><p><b>x</div></ul>", "<h1>x<p></b>"):
        began = time.perf_counter()
        htmltext.main_text(piece * (5_000_000 // len(piece)))
        assert time.perf_counter() - began < 60, piece
    began = time.perf_counter()
    htmltext.main_text("<a" * 500_000 + "\"")
    htmltext.main_text("<a '" * 300_000 + "\"")
    assert time.perf_counter() - began < 30


LONG_P = "A sentence of some length stands here, and another one follows it. " * 3
NAV = "<ul><li><a href=/>Home</a></li><li><a href=/news>News</a></li><li><a href=/about>About us</a></li></ul>"


def p(*texts, tag="p"):
    return "".join(f"<{tag}>{t}</{tag}>" for t in texts)


FORMS = {
    "short paragraphs": (NAV + p(*[f"short line {i}" for i in range(30)]), [f"short line {i}" for i in range(30)]),
    "a poem": ("<h1>Poem</h1>" + p(*[f"verse number {i}" for i in range(12)]) + NAV, ["Poem", *[f"verse number {i}" for i in range(12)]]),
    "a poem in loose blocks": (NAV + p(*[f"verse {i}" for i in range(12)], tag="div") + NAV, [f"verse {i}" for i in range(12)]),
    "lead and end": (NAV + p("Short lead.", *[LONG_P] * 4, "The end.") + NAV, ["Short lead.", *[LONG_P.strip()] * 4, "The end."]),
    "several short ones at the end": (NAV + p(*[LONG_P] * 3, "One.", "Two.", "Three.", "Four."), [*[LONG_P.strip()] * 3, "One.", "Two.", "Three.", "Four."]),
    "several short ones at the beginning": (NAV + p("One.", "Two.", "Three.", "Four.", *[LONG_P] * 3), ["One.", "Two.", "Three.", "Four.", *[LONG_P.strip()] * 3]),
    "a form around the page": (f"<form id=aspnetForm>{NAV}{p(*[LONG_P] * 3)}</form>", [LONG_P.strip()] * 3),
    "a form beside the text": (p(*[LONG_P] * 3) + f"<form>{p('Your name', 'Your mail')}<button>Send</button></form>", [LONG_P.strip()] * 3),
    "a fieldset around the page": (f"<fieldset>{p(*[LONG_P] * 3)}</fieldset>", [LONG_P.strip()] * 3),
    "a header within the article": (f"<header><p>Site name</p></header><article><header><h1>Title</h1></header>{p(*[LONG_P] * 2)}</article>", ["Title", *[LONG_P.strip()] * 2]),
    "a header of the page": (f"<header><h2>Site</h2>{p('The motto of the site')}</header>{p(*[LONG_P] * 2)}", [LONG_P.strip()] * 2),
    "a header around the text": (f"<header><h1>Title</h1>{p(*[LONG_P] * 2)}</header>", ["Title", *[LONG_P.strip()] * 2]),
    "one linked paragraph": (f"<body><p><a href=/x>{LONG_P}</a></p></body>", [LONG_P.strip()]),
    "links only": (NAV, []),
    "hidden by style": (p(*[LONG_P] * 2) + f'<div style="color:red; display : none">{p(LONG_P + "hidden")}</div>', [LONG_P.strip()] * 2),
    "hidden by attribute": (p(*[LONG_P] * 2) + f"<div hidden>{p(LONG_P + 'hidden')}</div>", [LONG_P.strip()] * 2),
    "a discussion": (p(*[LONG_P] * 3) + f'<section class="discussion">{p("I agree with all of that, thanks.", "Me too, and so does my neighbour.")}</section>', [LONG_P.strip()] * 3),
    "a section named discussion of an article": (f'<article>{p(LONG_P)}<section id="discussion"><h2>Discussion</h2>{p(LONG_P)}</section></article>', [LONG_P.strip(), "Discussion", LONG_P.strip()]),
    "a short remark between links": (NAV + p(*[LONG_P] * 2, "See also the other one.") + NAV + NAV, [*[LONG_P.strip()] * 2, "See also the other one."]),
    "a list as the text": (p(LONG_P) + "<ul>" + p("first point", "second point", "third point", "fourth point", tag="li") + "</ul>" + NAV, [LONG_P.strip(), "first point", "second point", "third point", "fourth point"]),
    "headings between short paragraphs": (NAV + "".join(f"<h3>Day {i}</h3><p>Rain and wind.</p>" for i in range(5)) + p(LONG_P), [*[x for i in range(5) for x in (f"Day {i}", "Rain and wind.")], LONG_P.strip()]),
}


@pytest.mark.parametrize("form", FORMS)
def test_forms_of_pages_without_an_article(form):
    page, want = FORMS[form]
    assert htmltext.main_text(f"<html><head><title>T</title></head><body>{page}</body></html>").split("\n\n") == (want or [""])
