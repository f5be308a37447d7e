"""Pages made of a known article and known furniture, with and without telling names: the scores find the article."""

import random

import pytest

from strophe.llm import html_extract

RNG = random.Random(4)


def sentence(n):
    return " ".join(RNG.choice("river cloud, silver tiger garden; winter copper bridge falcon, orange stone".split()) for _ in range(n)).capitalize() + "."


def page(outer, nav, ad, foot, seed, paragraphs):
    RNG.seed(seed)
    title, texts = sentence(5), [sentence(RNG.randrange(12, 60)) for _ in range(paragraphs)]
    links = "".join(f'<li><a href="/{i}">{sentence(2)}</a></li>' for i in range(6))
    html = (
        f"<html><head><title>x</title><style>p{{}}</style><script>var t='</p>';</script></head><body><{nav}><ul>{links}</ul></{nav.split()[0]}>"
        f"<{ad}>{sentence(6)}</{ad.split()[0]}><{outer}><h1>{title}</h1>" + "".join(f"<p>{t.replace('river', '<b>river</b>')}</p>" for t in texts)
        + f"<ul>{links}</ul></{outer.split()[0]}><{foot}>&copy; {sentence(7)}</{foot.split()[0]}></body></html>"
    )
    return html, "\n".join([title, *texts])


FORMS = {
    "elements": ("article", "nav", 'div class="ad"', "footer"),
    "names": ('div class="content"', 'div class="menu"', 'div id="ad-1"', 'div class="site footer"'),
    "no names": ("div", "div", "div", "div"),
    "misleading name": ('div class="related notice rail"', "div", "div", "div"),
    "sections": ("section", "section", "section", "section"),
}


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("paragraphs", [3, 12, 300])
def test_article_is_found(form, paragraphs):
    for seed in range(20):
        html, want = page(*FORMS[form], seed, paragraphs)
        assert html_extract.extract(html) == want


def test_points_fall_off_by_level():
    root = html_extract.parse("<div><div><div><div><p>" + "word, " * 20 + "</p></div></div></div></div>")
    nodes = html_extract._order(root)
    html_extract.score(nodes)
    found = [n.score for n in nodes if n.tag == "div"][::-1]
    own = found[0]
    assert found == pytest.approx([own, own / 2, own / 6, own / 18])


def test_comments_go_and_articles_in_them_stay():
    words = "Long words, many of them, to be scored well by length and commas. " * 3
    assert html_extract.extract(f"<body><div><p>{words}</p></div><div class='comments'>" + f"<p>{words}{words}</p>" * 9 + "</div></body>") == " ".join(words.split())
    assert html_extract.extract(f"<body><div class='discussion'><article><p>{words}</p></article></div></body>") == " ".join(words.split())


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + "<p>" + "deep words, here. " * 10 + "</p>"
    assert html_extract.extract(deep) == " ".join(("deep words, here. " * 10).split())
    long = "<p>" + "many words, in one. " * 200_000 + "</p>"
    assert len(html_extract.extract(long)) == 20 * 200_000 - 1


def test_pages_keep_their_columns(spark):
    pages = spark.createDataFrame([(1, "<p>x</p>", "old", "s"), (1, None, "old", None)], "page_id long, html string, text string, score string")
    out = html_extract.extract_pages(pages)
    assert out.columns == ["page_id", "score", "text"]
    assert sorted(tuple(r) for r in out.fillna("-").collect()) == [(1, "-", ""), (1, "s", "x")]
