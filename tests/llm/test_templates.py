"""Main text of pages: what the article element holds, and made-up sites without one."""

import html
import random
import re

import pytest

from helioframe.llm import queries, templates

INLINE = r"</?(?:a|b|i|em|strong|span)\b[^>]*>"


def plainly(page):
    """The text of the page's <article>, by patterns."""
    found = re.search(r"<article>(.*?)</article>", page or "", re.DOTALL)
    if not found:
        return ""
    parts = re.split(r"<[^>]*>", re.sub(r"<br>", " ", re.sub(INLINE, "", found[1])))
    return " ".join(" ".join(html.unescape(p).split()) for p in parts if p.strip())


def test_over_all_pages(spark, sf):
    want = {i: plainly(page) for i, page in queries.table(spark, sf, "pages").select("page_id", "html").collect()}
    found = queries.op11_html_extraction(spark, sf).collect()
    assert len(found) == len(want)
    assert {r["page_id"]: r["text"] for r in found} == want
    assert all(r["n_chars"] == len(r["text"]) for r in found) and any(want.values())


def words(r, n):
    return " ".join("".join(r.choice("abcdefghiklmnorstu") for _ in range(r.randrange(2, 9))) for _ in range(n))


def site(kind, n, seed):
    """(url, html, main text) of the pages of a host."""
    r, made = random.Random(seed), []
    about = "About this site and those who write it, in a passage that is long enough to look like prose to anybody."
    for i in range(n):
        title, body = words(r, 6), [words(r, r.randrange(15, 60)) for _ in range(r.randrange(2, 7))]
        comments = [words(r, r.randrange(5, 80)) for _ in range(r.randrange(0, 6))]
        paragraphs = "".join(f"<p>{b[:9]}<i>{b[9:14]}</i>{b[14:]}</p>\n" for b in body)
        said = "".join(f"<article class='comment'><p>{c}</p></article>" for c in comments)
        menu = "".join(f'<li><a href="/{w}">{w}</a>' for w in ("home", "news", "about", "contact"))
        related = "".join(f'<li><a href="/{k}">{words(r, 8)}</a></li>' for k in range(5))
        if kind == "div":  # no element marks the article, no name tells; only the template does
            page = (f"<body><div id=a1><ul>{menu}</ul></div><div class=x><div class=y><h1>{title}</h1>{paragraphs}</div>"
                    f"<div class=z><ul>{related}</ul></div></div><div class=w><p>{about}</p><p>Printed {i}</p></div></body>")
        elif kind == "main":
            page = (f"<html><body class='with-sidebar'><header><h2>The Site</h2></header><nav><ul>{menu}</ul></nav>"
                    f"<main><h1>{title}</h1>{paragraphs}<section id='comments'>{said}</section></main>"
                    f"<aside><p>{about}</p></aside><div class='cookie-notice'>We use <b>cookies</b></div><footer>{about}</footer>")
        else:  # a form around all, an advert never closed, furniture within the article
            page = (f"<form id=all><div class='ad'><p>{about}<article id='post-{i}'><header><h1>{title}</h1></header>"
                    f"<div class='share-buttons'>Tell others</div>{paragraphs}<script>var x = '<p>no</p>';</script>"
                    f"<form><input value=1>Subscribe now<button>Go</button></form><!-- <p>hidden</p> -->"
                    f"<div class=comments>{said}</div></article><div class=related><article><p>{words(r, 12)}</p></article></div></form>")
        made.append((f"http://{kind}{seed}.example/{i}", page, " ".join([title, *body])))
    return made


@pytest.mark.parametrize("kind", ["div", "main", "form"])
def test_sites(spark, kind):
    pages = site(kind, 30, 1) + site(kind, 7, 2)
    frame = spark.createDataFrame([(i, u, h, "a", "b", "c") for i, (u, h, _) in enumerate(pages)],
                                  "page_id long, url string, html string, host string, tokens string, row string")
    found = templates.main_text(frame, ["page_id", "host", "tokens", "row"])
    assert found.columns == ["page_id", "host", "tokens", "row", "text", "n_chars"]
    assert {r["page_id"]: r["text"] for r in found.collect()} == {i: t for i, (_, _, t) in enumerate(pages)}


def test_copies_are_no_template(spark):
    """Most pages of the host are copies of one: their text stays."""
    pages = site("div", 8, 3)
    pages += [(f"{pages[0][0]}?{i}", pages[0][1], pages[0][2]) for i in range(40)]
    frame = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in templates.main_text(frame, ["page_id"]).collect()}
    assert got == {i: t for i, (_, _, t) in enumerate(pages)}


def test_odd_pages(spark):
    long = "word " * 200_000
    rows = [(1, None, None, ""), (2, "", "", ""), (None, "http://[", "<p>", ""), (3, "http://a/", "no markup &amp; no end &lt;", "no markup & no end <"),
            (4, "x", "<article>a<b>b</b>c <br>d&nbsp;&#x41;</article>", "abc d A"), (5, None, "a < b <3 <", "a < b <3 <"),
            (6, "http://A.example", f"<article><p>{long}</article>", long.strip()), (7, "http://a.example", "<!-- <p>x", ""),
            (8, "u", "<script>never closed <p>x", ""), (9, "u", "<article>\n one\ttwo <li>x<li>y</ul></article></nav>", "one two x y"),
            (9, "u", "<article>\n one\ttwo <li>x<li>y</ul></article></nav>", "one two x y"), (10, "u", "<a b='c", ""),
            (11, "u", "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), (12, "u", "\U0001f600 <main>\U0001f600</main>", "\U0001f600")]
    frame = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    found = templates.main_text(frame, ["page_id"]).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted(((r["page_id"], r["text"]) for r in found), key=key) == sorted(((r[0], r[3]) for r in rows), key=key)
    assert templates.main_text(frame.limit(0), ["page_id"]).collect() == []


def test_classes_and_order():
    """Tokens are read in the order of their class; a class that crosses a larger one is broken."""
    t = templates.Template([{"class": 1, "tokens": [10, 11, 12]}, {"class": 2, "tokens": [20, 21]}])
    block = lambda at: {"at": at}
    slots, broken = t.read([10, 20, 21, 11, 20, 21, 12, 99], [block(0), block(2), block(3), block(4), block(8)])
    assert slots == [None, (2, 0), (1, 0), (1, 1), None] and not broken
    assert t.read([10, 20, 11, 21, 12], [])[1] == {2}
    assert t.read([10, 12, 11], [])[1] == {1}
    assert t.read([10, 11], [])[1] == {1} and t.read([], []) == ([], set())
