"""Phrases, HTML, chat, licenses: brute force on small fixtures and edge rows."""

import hashlib
import math
import os
import random
import re
import time

import duckdb
import pandas as pd
import pyarrow.parquet as pq
import pytest
from shelfline.llm import chat, html, licenses, phrases

DOCS = "doc_id bigint, text string"


def lz(text):
    known, w = set(), ""
    for c in text:
        w += c
        if w not in known:
            known.add(w)
            w = ""
    return known | ({w} if w else set())


def test_phrase_fingerprints_and_next_documents(spark):
    rng = random.Random(2)
    rows = [(i * 7, "".join(rng.choices("ab cdeé", k=rng.randrange(400)))) for i in range(60)] + [(1, None), (2, ""), (3, rng.choice("xy") * 5000)]
    rows.append((500, rows[5][1]))
    got = {r.doc_id: r for r in phrases.with_next(spark.createDataFrame(rows, DOCS)).collect()}
    down = sorted(((d, t or "") for d, t in rows), reverse=True)
    maker = phrases.Fingerprints()
    for (doc, text), (_, after) in zip(down, down[1:] + down[:1], strict=True):
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for made, of in ((r.fingerprint, text), (r.edited_fingerprint, edited)):
            assert made == phrases.written(maker.low(sorted(lz(of))), of)
        assert r.near_next == phrases.likeness(r.fingerprint, got[doc].fingerprint if len(down) == 1 else phrases.written(maker.low(sorted(lz(after))), after))
        assert r.near_edited == phrases.likeness(r.fingerprint, r.edited_fingerprint)
    assert got[500].fingerprint == got[35].fingerprint and got[1].fingerprint == ""


def test_phrases_of_odd_tables(spark):
    assert phrases.with_next(spark.createDataFrame([], DOCS)).count() == 0
    one = phrases.with_next(spark.createDataFrame([(4, "abcabc")], DOCS)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcaab").hexdigest() and one.near_next == 1.0
    rows = phrases.with_next(spark.createDataFrame([(4, "a"), (4, "a"), (None, "bcd")], DOCS)).collect()
    assert len(rows) == 3
    assert phrases.fingerprints(spark.createDataFrame([(1, "ab", "x")], DOCS + ", fingerprint string")).columns == ["doc_id", "fingerprint"]


PAGES = [
    (None, ""),
    ("", ""),
    ("just text &amp; more", "just text & more"),
    ("<p>a<br>b\n c</p><p></p><p>d &lt;e&gt;", "a b c\nd <e>"),
    ("<html><body><nav><a href=x>Home</a></nav><div class='ad'>Buy</div><article><h1>T</h1><p><b>One two.<br><p>Three <i>four</i>.</p>"
     "<div class='comments'><p>nice</p></div></article><footer>&copy; me</footer></body></html>", "T\nOne two.\nThree four."),
    ("<script>var a='</p><p>x';</script><style>p{}</style><main><header><h1>H</h1></header><p>Long enough text.</p><form>name</form></main>", "H\nLong enough text."),
    ("<p>1 < 2 and <unclosed", "1 < 2 and <unclosed"),
    ("<!-- no --><article><ul><li>one<li>two</ul><table><tr><td>c<td>d</table></article>", "one\ntwo\nc\nd"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_text_without_an_article():
    body = "".join(f"<p>Paragraph number {i} of the story, with a good many words in it.</p>" for i in range(6))
    links = "".join(f"<li><a href='{i}'>link {i}</a></li>" for i in range(30))
    page = f"<body><div id=top><ul>{links}</ul></div><div><h1>Story</h1><div>{body}</div></div><div class='cookie notice'>We use cookies</div></body>"
    assert html.main_text(page).split("\n") == ["Story"] + [f"Paragraph number {i} of the story, with a good many words in it." for i in range(6)]
    assert len(html.main_text("<div>" * 5000 + "deep")) == 4


PAGES_FILE = "/root/testdata/sf0.01/pages.parquet"


@pytest.mark.skipif(not os.path.exists(PAGES_FILE), reason="no test tables")
def test_density_decides_without_names():
    """The given pages without the names of their elements and classes keep their texts."""
    pages = pq.read_table(PAGES_FILE).column("html").to_pylist()
    for page in pages:
        bare = re.sub(r"<(/?)article\b", r"<\1div", page or "").replace('class="ad"', 'class="x91"')
        assert html.main_text(bare) == html.main_text(page)


def test_densities_by_plain_counts():
    page = "<div><h1>Title of it</h1><p>Some <a href=x>linked words</a> and more text here.</p><ul><li><a href=y>one</a><li><a href=z>two</a></ul></div><p>Beside it.</p>"
    order = html.measure(html.tree(page))
    body = order[0]

    def inside(node):
        return [y for x in node.items if isinstance(x, html.Node) for y in [x, *inside(x)]]

    def chars(node):
        return sum(len(x.strip()) if isinstance(x, str) else chars(x) for x in node.items)

    for n in order:
        links = [x for x in inside(n) if x.tag == "a"]
        c, t, lc, lt = chars(n), max(1, len(inside(n))), chars(n) if n.tag == "a" else sum(map(chars, links)), max(1, len(links))
        whole = sum(chars(x) for x in inside(body) if x.tag == "a") / chars(body)
        want = c / t * math.log(max(1, c / max(1, lc) * t / lt)) / math.log(math.log(c / max(1, c - lc) * lc + whole * c + math.e)) if c else 0
        assert n.chars == c and (n.tag == "a" or abs(n.density - want) < 1e-9 * max(1, abs(want)))
    blocks = [sum(x.density for x in n.items if isinstance(x, html.Node) and x.tag in html.BLOCK) for n in order]
    assert [html.density_sum(n) for n in order] == blocks


def test_titles_menus_and_adverts():
    story = "<p>Soup and bread, and more of it for all of us.</p><p>And a long dessert to follow.</p>"
    page = f'<body><div class="post-header"><h1>Title</h1></div><div><h2 class="menu">Menu of the day</h2>{story}</div><div class="q7">Buy now</div></body>'
    assert html.main_text(page).split("\n")[:2] == ["Title", "Menu of the day"] and "Buy" not in html.main_text(page)


@pytest.mark.parametrize("page", ["<p>x</p>" + "<a " * 350_000, "<div>" * 3000 + "</i>" * 100_000 + "<p>x", "<a \"'>" * 100_000, "<!--" * 200_000, "<div>" * 100_000], ids=["no end", "stray ends", "quotes", "comments", "depth"])
def test_hostile_pages_take_linear_time(page):
    began = time.time()
    html.main_text(page)
    assert time.time() - began < 5


def test_pages_frame(spark):
    assert html.extracted(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0
    pages = spark.createDataFrame([(1, "u", "<p>x", "old")], "page_id int, url string, html string, text string")
    assert [tuple(r) for r in html.extracted(pages).collect()] == [(1, "u", "x")]


BITS = ["</s>", "[INST]", "[/INST]", "\\", "<", "s>", "[", " ", "\n", "ok", "[SYS]", "[ROLE=", "]", "<s>", "[/ROLE]", "<\\/s>"]


def test_chat_round_trip(spark):
    rng, rows = random.Random(1), []
    for conv in range(60):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice([None, "".join(rng.choices(BITS, k=rng.randrange(6)))])))
    rows += [(100, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(300)] + [(None, 0, "user", "x")]
    said = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumnRenamed("none", "none")
    t = chat.Instruct()
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(said, t, block=16), t).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((x[1], x[2] or "user", x[3] or "") for x in rows if x[0] == conv)
        learned = "".join(x for _, r, x in turns if r == "assistant")
        want = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].rewritten) == (len(turns), want, len(learned), -1)
        assert got[conv].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert chat.formatted(said.limit(0), t).count() == 0


def test_templates_that_rewrite_history():
    def shorten(turns):
        return "".join(f"<{r}>{x if i == len(turns) - 1 else x[:1]}" for i, (r, x) in enumerate(turns))

    assert chat.spans(shorten, [("user", "q"), ("assistant", "long"), ("user", "q")])[2] == 2
    numbered = lambda turns: "".join(f"{i}:{x}|" for i, (_, x) in enumerate(turns))
    turns = [("user", str(i)) for i in range(50)]
    whole, found, first = chat.spans(numbered, turns, block=8)
    assert first == -1 and whole == numbered(turns) and [whole[b:e] for _, _, b, e in found] == [x for _, x in turns]


def test_rewritten_conversations_keep_their_loss(spark):
    """A template that strips earlier reasoning: texts are found in what is returned."""

    def strip(turns):
        return "".join(f"<{r}>{x if i == len(turns) - 1 else x.split('~')[-1]}|" for i, (r, x) in enumerate(turns))

    turns = [(1, i, "assistant" if i % 2 else "user", f"why{i}~said{i}") for i in range(150)]
    row = chat.formatted(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"), strip).first()
    want = [f"said{i}" for i in range(1, 149, 2)] + ["why149~said149"]
    assert row.formatted == strip([t[2:] for t in turns]) and row.rewritten == 1 and row.spans is None
    assert [row.formatted[s.begin : s.end] for s in row.loss] == want
    dropped = lambda turns: "".join(f"<{x}>" for _, x in turns[-2:])
    whole, found, first = chat.spans(dropped, [("user", "q"), ("assistant", "a"), ("user", "a")])
    assert (whole, first, [f[2:] for f in found]) == ("<a><a>", 2, [(None, None), (1, 2), (4, 5)])


def test_licenses_against_sql(spark):
    lines = [*licenses.BASE, *(t for _, t, _ in licenses.TEMPLATES), *(k for _, _, k in licenses.TEMPLATES), "gnu general", "license mit", "by cc by cc by", "été"]
    rng = random.Random(4)
    rows = [(i, rng.choice([" ", ", ", "-\n"]).join(rng.choices(lines, k=rng.randrange(5))).upper()) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "MIT-License " * 3000), (None, "cc by"), (5, "cc by")]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    want = duckdb.sql(licenses.sql("documents")).fetchall()
    got = [tuple(r) for r in licenses.scanned(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert licenses.scanned(spark.createDataFrame([], DOCS)).count() == 0 and len(documents) == len(rows)


def test_html_wrappers_named_like_furniture():
    body = "<p>" + "A sentence of the story, long enough to be read. " * 6 + "</p>"
    said = " ".join(("A sentence of the story, long enough to be read. " * 6).split())
    menu, related = "<div class='menu'><a href=x>Home</a></div>", "<div class='related'><article><a href=y>More</a></article></div>"
    ad = "<div class='widget ad'>Buy now</div>"
    for page in (
        f"<div class='layout has-sidebar'>{menu}<article><p>{said}</p>{ad}</article></div>",
        f"<div id=page class='header-fixed'>{menu}<div>{body}</div>{ad}</div>",
        f"<div class='layout has-sidebar'>{menu}<div>{body}</div></div>",
        f"{menu}<article class='post category-social'>{body}{ad}</article>{related}",
    ):
        assert html.main_text(f"<html><body>{page}</body></html>") == said
    for head in ("<div class='article-header'><h1>Title</h1></div>", "<header class='entry-header'><h1>Title</h1></header>"):
        assert html.main_text(f"<body><article>{head}{body}</article></body>") == "Title\n" + said
