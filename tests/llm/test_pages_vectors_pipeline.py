"""Pages, embeddings and the pipeline against brute force and SQL."""

import math
import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
import public_tokenizers
from graniteq.llm import catalogue, embedding_dedup, html_extract, url_filter
from test_text_operators import plain_prediction, plain_profiles, spans_of
from tokenizers import Tokenizer

SMALL = "/root/testdata/sf0.01"

# Vectors.


def linked(rows, least=0.98):
    """(n_links, component_id) by comparing all pairs."""
    usable = lambda r: r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])
    links, parent = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(rows):
        for b in rows[k + 1 :]:
            if usable(a) and usable(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                    links[a[0]] += 1
                    links[b[0]] += 1
                    i, j = sorted((root(a[0]), root(b[0])))
                    parent[j] = i
    return {i: (links[i], root(i), root(i) == i) for i in links}


def vectors(seed, groups=6, copies=20, dims=16):
    r, out = np.random.default_rng(seed), []
    for g in range(groups):
        c = r.normal(size=dims)
        for _ in range(copies):
            out.append((c * r.uniform(0.1, 9) + r.normal(size=dims) * r.choice([0, 0.02, 0.1, 0.6])).astype(np.float32).tolist())
    return out


@pytest.mark.parametrize("cell_rows", [3, 2048])
def test_links_equal_brute_force(spark, cell_rows):
    r = random.Random(8)
    own = vectors(1) + vectors(2, dims=5)
    rows = [(i, v, r.choice([1, 1, 1, 2, None])) for i, v in enumerate(own)]
    rows += [(1000 + i, own[0], 1) for i in range(40)]
    odd = [None, [], [0.0] * 16, [math.nan] * 16, [math.inf, *[1.0] * 15], [None, *[1.0] * 15], [1.0] * 16]
    rows += [(2000 + i, v, 1) for i, v in enumerate(odd)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as n_links", "2 as Label2", "3 as key")
    out = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_dedup.link_vectors(df, cell_rows=cell_rows).collect()}
    assert out == linked(rows)


def test_no_vectors_and_null_ids(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.link_vectors(spark.createDataFrame([], schema)).count() == 0
    out = embedding_dedup.link_vectors(spark.createDataFrame([(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1)], schema)).collect()
    assert sorted(map(tuple, out), key=str) == [(3, 0, 3, True), (None, 0, None, True)]


def test_decoding_finds_the_nearest_lattice_point():
    x = np.random.default_rng(3).normal(size=(300, 8)) * 2
    near = embedding_dedup.decode(x)
    halves = 2 * near
    assert (halves == np.rint(halves)).all() and (halves.astype(int) % 2 == halves[:, :1].astype(int) % 2).all() and (near.sum(1) % 2 == 0).all()
    assert len(embedding_dedup.neighbours()) == 240
    own = ((x - near) ** 2).sum(1)
    assert all(own[i] <= ((x[i] - near[i] - embedding_dedup.neighbours()) ** 2).sum(1).min() + 1e-9 for i in range(300)) and own.max() <= 1 + 1e-9


# URLs.

URLS = [
    None, "", "no scheme/en/1", "https://www.a.example.com/en/712", "https://example.com/en/8", "HTTP://WWW.Example.NET/de/8?x", "http://x.net/de/1", "http://notexample.com/en/7", "http://xnet/de/1",
    "http://x.org/es/#a", "http://x.org?q=/es/", "http://casino.x.info/", "http://casinox.x.info/free", "http://free.x.info/free-free", "http://x.info/free/bets", "http://x.info/FREE?ads=1", "ads free bets", "http://x.com#/en/",
    "http://user@x.de:80/a?b#c", "://", "http://", "a://b://c/d", "http://xxxx.de/xxx",
]


def test_urls(spark, tmp_path):
    spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    ours = catalogue.QUERIES["op8_url_filter"](spark, str(tmp_path))
    rows = sorted(map(tuple, ours.collect()))
    assert rows == sorted(con.sql(f"select {', '.join(ours.columns)} from ({catalogue.ORACLES['op8_url_filter']})").fetchall())
    got = {i: (host, path, rule, verdict) for i, host, path, rule, verdict, *_ in rows}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow") and got[16] == ("", "", None, "block")
    assert got[3] == ("www.a.example.com", "/en/712", "example.com/en/7", "allow") and got[4][2:] == ("com/en/", "block")
    assert got[5] == ("www.example.net", "/de/8", "example.net/de/8", "block") and got[6][2:] == ("net/de/", "allow")
    assert got[7][2:] == ("com/en/", "block") and got[8][2:] == (None, "allow")
    assert got[9] == ("x.org", "/es/", "org/es/", "block") and got[10] == ("x.org", "", None, "allow")
    assert [got[i][3] for i in (11, 12, 13, 14, 15)] == ["block", "allow", "allow", "block", "block"]
    assert got[18][:2] == ("user@x.de:80", "/a") and got[21][:2] == ("b:", "//c/d") and got[22][3] == "block"
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_vocabulary_rejects_and_leaves_alone():
    strict, soft = url_filter.STRICT, url_filter.SOFT
    assert len(strict) + len(soft) > 300 and not set(strict) & set(soft) and all(t == t.lower() and t.isalnum() for t in (*strict, *soft))
    rejected = lambda u: (h := url_filter.hits(u))[0] > 0 or h[1] >= 2
    for u in ["https://a.com/porn", "http://casino.x.org", "https://spam-farm.example.org/en/1", "http://x.com/free-poker", "http://x.com/warez?x=1", "https://CHEAP.x.com/Loans", "http://x.net/a_xxx_b"]:
        assert rejected(u), u
    for u in [
        "https://www.essex.ac.uk/study", "https://sussex.edu/adulthood/2020", "https://x.org/sex-education", "https://arxiv.org/abs/1706.03762", "https://shop.x.com/deals", "https://en.example.org/wiki/Trojan_War",
        "https://x.com/escorting-children", "https://x.com/analytics/assassin", "https://credit.union.org/about", "https://x.com/therapist", "https://alphabet.x.com/", "https://x.org/classic-cockpit", "https://news.x.com/free-speech",
        "https://x.com/pornography-law".replace("pornography", "obscenity"), "https://scunthorpe.gov.uk/council", "https://x.com/winter/winners-circle",
    ]:
        assert not rejected(u), u


def test_url_rows_of_all_kinds(spark):
    long = "http://x.de/" + "a/" * 200_000 + "casino"
    rows = [(1, long, 1), (1, long, 1), (None, None, None), (2, "http://x.de/" + "casino" * 50_000, 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, Url int").selectExpr("*", "1 as id", "2 as host", "3 as n", "4 as PATH")
    out = url_filter.judge_urls(df).collect()
    assert [r.verdict for r in sorted(out, key=lambda r: (r.page_id is None, r.page_id))] == ["block", "block", "allow", "allow"]
    assert all(len(r.path) > 200_000 for r in out if r.page_id)


# Pages.


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


ARTICLE = "<article><h1>A title</h1><p>First &amp; <b>bold</b>\n text, that goes on.<br>Then <p>second, unclosed <i>one</i>; yes.</article>"
ARTICLE_TEXT = "A title First & bold text, that goes on. Then second, unclosed one; yes."
NOISE = (
    "<header>Site</header><nav><ul><li><a href='/x'>menu, one.</a></ul></nav><div class='ad'>Buy now, really. Long advert text that goes on and on, and on.</div>{}"
    "<aside>More, here.</aside><div id=\"cookie-notice\">We use cookies, always.</div><form>Name: <input></form><section class='comments'><article><p>A reader, who writes very much, and more.</p></article></section>"
    "<footer>&copy; me</footer><script>var a='<p>no</p>';</script><style>p{{}}</style><!-- <p>hidden</p> -->"
)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain words, nothing else.", "plain words, nothing else."),
        (page(ARTICLE), ARTICLE_TEXT),
        (page(NOISE.format(ARTICLE), "<script>if (a < b) { x('</p>') }</script>"), ARTICLE_TEXT),
        (page(NOISE.format("<div id='content'><h2>A title</h2><p>One sentence, and more of it, to read.</p><p>Short.</p><p>The last one, which is long, too.</p></div>")), "A title One sentence, and more of it, to read. Short. The last one, which is long, too."),
        (page(f"<div class='layout has-sidebar no-ads'><div id=sideNav><p>Go here, or there, at once.</p></div><div id='mainMenu'>menu</div>{ARTICLE}</div>"), ARTICLE_TEXT),
        (page(f"<main>{ARTICLE}<ol id='Replies'><li><p>A reader, who has much to say, and more.</p></li></ol><div class='widget_box'>Top, now.</div></main>"), ARTICLE_TEXT),
        (page("<nav>only</nav><footer>noise</footer>"), ""),
        (page("<article><p>cut in the mid &am"), "cut in the mid &am"),
        (page("<article><p a=\"x>y\">quoted</p><P>caf&eacute; &#x1F642; &lt;b&gt;</p></ARTICLE>after"), "quoted café 🙂 <b>"),
    ],
)
def test_pages(html, text):
    assert html_extract.extract_text(html) == text


def test_broken_tags_take_linear_time():
    html = page("<article><p>" + "<a \"x' word. " * 20_000 + "</article>")
    assert "word." in html_extract.extract_text(html) or not html_extract.extract_text(html)


def test_extract_keeps_every_page(spark):
    rows = [(1, "u", page(ARTICLE)), (2, None, None), (None, "v", ""), (1, "u", page(ARTICLE)), (4, "w", page("<article>" + "<p>word, word. " * 20_000))]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")).collect()
    assert sorted(((r.page_id, r.url, r.n_chars) for r in out), key=str) == sorted([(1, "u", len(ARTICLE_TEXT))] * 2 + [(2, None, 0), (None, "v", 0), (4, "w", 11 * 20_000 - 1 + 20_000)], key=str)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_of_the_tables(spark):
    """The article element of a generated page holds its text."""
    import re
    from html import unescape

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    texts = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        assert texts[r.page_id] == " ".join(unescape(re.sub(r"<[^>]+>", " ", inner)).split())


# The pipeline.


def fingerprint(text, k):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(len(words) - k + 1, 1))] if words else []
    ones = sum((np.array([h >> b & 1 for b in range(64)]) for h in hashes), np.zeros(64, int))
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(hashes))


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(300)
    extra = [(5000, "12 !!", "en", "s", 5), (5001, None, None, None, None), (5002, "clean words with a token = abcdefgh12345 inside", "en", "s", 46), (5003, "clean words with a token = abcdefgh12345 inside", "en", "s", 46)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "secret_scan", "packing"]
    rows = {r.doc_id: r for r in docs.collect()}

    known = stages["language_id"](spark, docs, SMALL)
    assert known.columns == docs.columns
    learned = plain_profiles((r.text, r.lang) for i, r in rows.items() if r.text is not None and r.lang is not None and zlib.crc32(str(i).encode()) % 3 != 1)
    kept = {i for i, r in rows.items() if plain_prediction(r.text, learned)[1] > 0}
    assert {r.doc_id for r in known.collect()} == kept == set(rows) - {5000, 5001}

    one = stages["simhash_dedup"](spark, known, SMALL)
    (prints, checks), ids, parent = ({i: fingerprint(rows[i].text, k) for i in kept} for k in (2, 5)), sorted(kept), {i: i for i in kept}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if prints[i] == prints[j] or (prints[i] ^ prints[j]).bit_count() <= 5 and (checks[i] ^ checks[j]).bit_count() <= 12:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    singles = {i for i in ids if root(i) == i}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == singles and 5003 not in singles

    clean = {r.doc_id: r for r in stages["secret_scan"](spark, one, SMALL).collect()}
    assert set(clean) == singles
    for i, r in clean.items():
        text, out, at = rows[i].text, [], 0
        spans = []
        for lo, _, hi, kind in spans_of(text)[1]:
            if spans and lo < spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi, kind])
        for start, end, kind in spans:
            out += [text[at:start], f"[{kind}]"]
            at = end
        assert r.text == "".join([*out, text[at:]]) and r.n_chars == len(r.text)
    assert clean[5002].text == "clean words with a [assign] inside"

    cleaned = spark.createDataFrame(list(clean.values()), docs.schema)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    pieces = sorted(stages["packing"](spark, cleaned, SMALL).collect(), key=lambda p: (p.doc_id, p.start))
    for i, r in clean.items():
        own = [p for p in pieces if p.doc_id == i]
        assert [t for p in own for t in p.ids] == [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in own)


def test_near_copies_of_the_tables_go_and_others_stay(spark):
    """Pairs of texts by their exact similarity over five-word shingles."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("text is not null")
    texts = {r.doc_id: r.text.lower().split() for r in docs.collect()}
    shingles = {i: {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} for i, w in texts.items()}
    by = {}
    for i, own in shingles.items():
        for x in own:
            by.setdefault(x, []).append(i)
    shared = {}
    for ids in by.values():
        for a in ids if len(ids) <= 60 else ():
            for b in ids:
                if a < b:
                    shared[a, b] = shared.get((a, b), 0) + 1
    alike = {p: n / (len(shingles[p[0]]) + len(shingles[p[1]]) - n) for p, n in shared.items()}
    near = {p for p, j in alike.items() if j >= 0.8}
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, SMALL).collect()}
    caught = sum(not (a in kept and b in kept) for a, b in near)
    assert caught >= 0.9 * len(near) > 0
    some = {i for p, j in alike.items() if j >= 0.4 for i in p} | {i for i, w in texts.items() if len(w) < 5}
    assert set(texts) - some <= kept


def test_stages_with_clashing_columns_long_texts_and_ties(spark):
    long = "the same words of a very long text, and more of it again " * 20_000
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([long, long, long + "tail", "short text of the day", "short text of the day", "password = hunter2hunter2 of the day"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wide = docs.selectExpr("1 as Text", "2 as DOC_ID", "*", "'x' as Lang", "3 as id", "4 as fp", "5 as component_id")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("language_id", "simhash_dedup", "secret_scan"):
        out = stages[name](spark, wide, SMALL)
        assert out.columns == docs.columns
        got = {r.doc_id: r for r in out.collect()}
        assert set(got) == ({0, 3, 5} if name == "simhash_dedup" else {0, 1, 2, 3, 4, 5})
        assert got[0].text == long and got[5].text == ("[assign] of the day" if name == "secret_scan" else rows[5][1])
    pieces = stages["packing"](spark, wide, SMALL).collect()
    assert {p.doc_id for p in pieces} == set(range(6)) and max(p.offset + p.length for p in pieces) == 2048


def test_pipeline_on_edges(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in {"none": [], "nulls": [(None, None, None, None, None)], "unlabelled": [(1, "some words here", None, None, 15), (2, "", None, None, 0)]}.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert {r.doc_id for r in out.collect()} == ({1} if name == "unlabelled" else set())
