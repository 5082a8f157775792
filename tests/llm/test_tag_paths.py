"""HTML extraction: the thresholded paths decide, against a plain version of the method."""

import resource
from html.parser import HTMLParser

import pytest

from graniteq.llm import html_extract

SMALL = "/root/testdata/sf0.01"
LONG = "<p>A long sentence, with commas, and more of it; it goes on, and on, to its end.</p>"
SHORT = "<p>A short one, here.</p>"


class Plain(HTMLParser):
    """A tree of (tag, label, children) with text; only for pages whose tags are closed, but for p and b."""

    def __init__(self):
        super().__init__()
        self.root = self.at = {"tag": "", "label": "", "up": None, "below": [], "skip": False}

    def handle_starttag(self, tag, attrs):
        if tag in html_extract.VOID:
            self.at["below"] += [" "] * (tag == "br")
            return
        if tag not in html_extract.INLINE:
            self.close("p")
        cls = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
        label = ".".join([tag, *sorted(cls.split())]) if cls and tag not in html_extract.PROSE else tag
        skip = tag in ("head", "nav", "footer", "script", "style", "title", "form", "aside") or "ad" in cls.split()
        node = {"tag": tag, "label": label, "up": self.at, "below": [], "skip": skip}
        self.at["below"].append(node)
        self.at = node

    def close(self, tag):
        x = self.at
        while x and x["tag"] != tag:
            x = x["up"]
        if x:
            self.at = x["up"]

    def handle_endtag(self, tag):
        self.close(tag)

    def handle_data(self, data):
        self.at["below"].append(data)


def plain_blocks(html):
    """(path of labels, ancestors, text, link characters, banned) of each block."""
    parser = Plain()
    parser.feed(html)
    parser.close("")
    out, held = [], []

    def flush(chain):
        text = " ".join("".join(t for t, _ in held).split())
        links = sum(len(t.strip()) for t, link in held if link)
        held.clear()
        if text:
            out.append(("/".join(n["label"] for n in chain), list(chain), text, min(links, len(text)), any(n["skip"] for n in chain)))

    def walk(node, chain, link):
        for x in node["below"]:
            if isinstance(x, str):
                held.append((x, link))
            elif x["tag"] in html_extract.INLINE:
                walk(x, chain, link or x["tag"] == "a")
            else:
                flush(chain)
                walk(x, [*chain, x], link)
                flush([*chain, x])

    walk(parser.root, [parser.root], False)
    flush([parser.root])
    return out


def plain_text(html, threshold):
    blocks = plain_blocks(html)
    allowed = [b for b in blocks if not b[4]]
    if not allowed:
        return ""
    ratio = {}
    for path in {b[0] for b in allowed}:
        own = [b for b in allowed if b[0] == path]
        ratio[path] = (sum(len(b[2]) - b[3] for b in own) / len(own), sum(c in ".,;:!?¡¿…。，、；：！？" for b in own for c in b[2]) / len(own))
    raw = [(0, 0) if b[4] else ratio[b[0]] for b in blocks]
    score = []
    for i, b in enumerate(blocks):
        length, marks = (0.25 * raw[max(i - 1, 0)][k] + 0.5 * raw[i][k] + 0.25 * raw[min(i + 1, len(raw) - 1)][k] for k in (0, 1))
        score.append(length * (1 + marks) if raw[i][0] else 0)
    mean = sum(score) / len(allowed)
    content = set()
    for path in ratio:
        own = [s for b, s in zip(blocks, score, strict=True) if b[0] == path and not b[4]]
        if sum(own) / len(own) >= threshold * mean > 0:
            content.add(path)
    chosen = [b[1] for b in allowed if b[0] in content]
    shared = [n for n in chosen[0] if all(any(n is m for m in c) for c in chosen)]
    area = next((n for n in reversed(shared) if n["tag"] == "article"), None) or next(n for n in reversed(shared) if n["tag"] not in html_extract.PARTS)
    return " ".join(b[2] for b in allowed if any(n is area for n in b[1]))


def test_pages_of_the_tables_equal_the_plain_method(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    for r in pages:
        # Without the article element too, where only the scores tell what the article is.
        for html in (r.html, r.html.replace("<article>", "<div class=x>").replace("</article>", "</div>")):
            for threshold in (0.5, 0.2):
                assert html_extract.extract_text(html, threshold) == plain_text(html, threshold)
        assert html_extract.extract_text(r.html) == html_extract.extract_text(r.html.replace("<article>", "<div class=x>").replace("</article>", "</div>"))


def test_the_threshold_decides():
    html = f"<body><div class=a><h2>One</h2>{LONG * 3}</div><div class=b><h2>Two</h2>{SHORT * 2}</div><div class=c><a href=x>menu, here</a></div></body>"
    strict, loose = html_extract.extract_text(html, 0.5), html_extract.extract_text(html, 0.01)
    assert strict.startswith("One A long") and "Two" not in strict
    assert "Two A short one, here." in loose and "menu" not in loose


def test_scores_follow_text_and_punctuation_outside_links():
    html = f"<body><div class=a>{LONG * 3}</div><div class=b><p><a href=x>{'A linked sentence, of the same kind. ' * 4}</a></p></div></body>"
    page = html_extract.Page(html)
    scores, by_path = html_extract.path_scores(page, page.banned())
    assert sorted(by_path.values())[0] < 0.5 * sorted(by_path.values())[1]
    assert "linked" not in html_extract.extract_text(html)


@pytest.mark.parametrize(
    ("part", "text"),
    [
        ("<p><span class='share'>Share</span> The text, kept.</p>", "The text, kept."),
        ("<pre><code><span class='hljs-comment'># note</span> x = 1</code></pre>", "# note x = 1"),
        ("<p class='notice'>A remark, kept.</p>", "A remark, kept."),
        ("<p>Thus <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p>", "Thus x = 1 holds."),
        ("<p>Before <span class='advert'>BUY <span>NOW</span> all</span> after.</p>", "Before after."),
        ("<p class='ad'>Buy this, now.</p>", ""),
        ("<div class='notice'>We use cookies, always.</div>", ""),
        ("<p>one<img src=x>two &am<b>p; three</b></p>", "onetwo &amp; three"),
        ("<ul><li>first</li><li>second</li></ul><table><tr><td>cell</td></tr></table><blockquote>quoted</blockquote>", "first second cell quoted"),
        ("<header><h2>Own head</h2></header>", "Own head"),
        ("<p>x<a href=y>link <b>in</a> text</b></p>", "xlink in text"),
    ],
)
@pytest.mark.parametrize("wrap", ["<article><h1>T</h1>{}</article>", "<div id=content><h1>T</h1>{}</div>"])
def test_parts_of_an_article(part, text, wrap):
    if "<header>" in part and "article" not in wrap:
        return
    html = "<body><nav><a href=x>m</a></nav><div class='ad'>Buy, now.</div>" + wrap.format(LONG + part + LONG) + "<footer>f</footer></body>"
    plain = "A long sentence, with commas, and more of it; it goes on, and on, to its end."
    assert html_extract.extract_text(html) == " ".join(filter(None, ["T", plain, text, plain])).replace("&amp;", "&am" + "p;")


def test_marks_around_the_whole_page_count_for_nothing():
    html = f"<body class='x'><form id=f><div class='social page comments'><h1>T</h1>{LONG * 2}</div></form><div class='comments'>{LONG}</div></body>"
    assert html_extract.extract_text(html).count("long sentence") == 2 and html_extract.extract_text(html).startswith("T ")


PAGES = {
    "articles side by side": (f"<main><article><h2>A</h2>{LONG}</article><article><h2>B</h2>{LONG * 2}</article></main>", "A L B L L"),
    "teasers below": (f"<main><article><h1>A</h1>{LONG * 4}</article><section><h2>More</h2><article><h3>x</h3><p>Teaser, short.</p></article></section></main>", "A L L L L"),
    "flat, links around": (f"<p><a href=x>Up, there</a></p><h1>T</h1>{LONG}<p><a href=x>a linked one</a></p>{LONG}<hr><p><a href=x>Back to index</a></p>", "T L a linked one L"),
    "flat, list at the end": (f"<h1>T</h1>{LONG * 2}<ul><li>first</li></ul><div>Login</div>", "T L L first"),
    "columns": (f"<div class=wrap><div class=left><ul><li><a href=x>a</a></li></ul><p>Sign up, please.</p></div><div class=story><h1>T</h1><div class=byline>By Me</div>{LONG * 3}<div class=caption>c</div>{LONG}</div><div class=sidebar>{LONG}</div></div>", "T By Me L L L c L"),
    "table layout": (f"<table><tr><td><ul><li><a href=x>a</a></li></ul></td><td><h1>T</h1>{LONG * 2}<p>Short.</p></td></tr></table><div>foot</div>", "T L L Short."),
    "line breaks": ("<div class=menu><a href=x>A</a></div><div id=text><h1>T</h1>One sentence, of a text.<br><br>Two.</div>", "T One sentence, of a text. Two."),
    "sections": (f"<div class=doc><section><h2>One</h2>{LONG * 2}</section><section><h2>Two</h2><p>Tiny.</p></section></div>", "One L L Two Tiny."),
    "title outside": (f"<header>Site</header><h1>T</h1><div class=text>{LONG * 3}</div><div class=related>{LONG}</div>", "T L L L"),
    "noise inside": (f"<article><h1>T</h1><div class=sidebar>{LONG}</div>{LONG}<div class='newsletter-signup'><p>Join, now.</p></div>{LONG}</article>", "T L L"),
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(name):
    html, text = PAGES[name]
    plain = "A long sentence, with commas, and more of it; it goes on, and on, to its end."
    assert html_extract.extract_text(f"<body><nav><a href=x>m</a></nav>{html}<footer>f</footer></body>") == " ".join(plain if w == "L" else w for w in text.split(" "))


def test_edges():
    assert html_extract.extract_text("<div><a href=x>only, links.</a></div>") == ""
    assert html_extract.extract_text("<article><a href=x>a linked story</a></article>") == "a linked story"
    assert html_extract.extract_text("<title>t</title>") == html_extract.extract_text("<p></p>") == html_extract.extract_text("<p") == ""
    assert html_extract.extract_text("<p>Equal, texts.</p>" * 3) == "Equal, texts. Equal, texts. Equal, texts."
    assert html_extract.extract_text("word, " * 200_000) == ("word, " * 200_000).strip()


@pytest.mark.parametrize("unit", ["<div>", "<b>", "<span class=ad>", "<ul><li>", "<p>", "<div><b></i>", "<a href=x>"])
def test_deep_nesting_takes_linear_memory(unit):
    n = 200_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    html_extract.extract_text(unit * n + "<p>word, word." + "</div></b>" * n)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # KB


def test_clashing_and_repeated_columns(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{LONG}"), (1, "u", f"<p>{LONG}")], "page_id long, url string, html string").selectExpr("*", "1 as HTML", "2 as text", "3 as Page_Id", "4 as id")
    out = html_extract.extract(df).collect()
    assert len(out) == 2 and out[0] == out[1] and out[0].text.startswith("A long")
