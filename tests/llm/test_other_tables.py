"""Operators on pages, conversations and vectors against brute force, and on odd rows."""

from __future__ import annotations

import math
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import reply_trees, tag_paths, voronoi


def test_main_text(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><div id="header">Site</div><ul class="menu"><li>x<li>y</ul>
      <div class="content"><h2>Head line</h2><p>First long paragraph, with commas, and words. More sentences, too.<p>Second &amp;
      <i>more</i> text; it goes on, and on.</p><ul><li>point one<li>point two</ul></div><div class="cookie-notice">We use cookies.</div>
      <div id="comments"><p>Great post, thanks, really, I mean it!</p></div><form><p>Name, mail, and so on.</p></form></body>"""
    assert tag_paths.main_text(page) == ("Head line\n\nFirst long paragraph, with commas, and words. More sentences, too.\n\n"
                                         "Second & more text; it goes on, and on.")
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<div"), (5, "u", "plain"), (None, "u", "<p>a<p>b"),
            (6, "u", "<script>x"), (7, "u", "<article><h1>A</h1><p>b &lt; c&nbsp;d<br>e</p><aside>no</aside></article><p>Other, text, here.</p>"),
            (8, "u", "<p>" + "long text, " * 50_000)]
    got = {r.page_id: r for r in tag_paths.extract(spark.createDataFrame(rows, "page_id long, url string, html string")
                                                   .withColumn("text", F.lit(1))).collect()}
    assert len(got) == 9 and got[7].text == "A\n\nb < c d e" and got[None].text == "a\n\nb" and got[5].text == "plain"
    assert all(got[i].text == "" and got[i].n_chars == 0 for i in (2, 3, 4, 6)) and got[8].n_chars == 50_000 * 11 - 1
    assert tag_paths.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_inside_named_elements():
    """Names that hold a page part's name, and named elements around the main text, take no text away."""
    text = "The tide came in before noon, and the boats were late. Nobody on the quay had seen them leave, or return."
    for page in (f'<div id="page" class="has-sidebar"><p>{text}</p></div>', f'<form action="/"><div><p>{text}</p></div></form>',
                 f'<section class="search-results"><p>{text}</p></section>', f'<div><p class="form-note">{text}</p></div>',
                 f'<div class="sidebar"><article><p>{text}</p></article></div>', f'<div class="page-with-header"><p>{text}</p></div>',
                 f'<div class="content"><p>{text}</p></div><div class="ad"><p>Buy now, today.</p></div>'):
        assert tag_paths.main_text(f"<html><body>{page}</body></html>") == text


LONG = "A paragraph of the post, with commas, and several words. It goes on, as they do, for a while."
NOISE = "Great post, thanks for sharing this with all of us here, I really liked it, see you soon!"


def paragraphs(n, text=LONG):
    return "".join(f"<p>{text} {i}.</p>" for i in range(n)), "\n\n".join(f"{text} {i}." for i in range(n))


@pytest.mark.parametrize(("before", "after", "n"), [
    ("<div class=post>", f"</div><div id=comments>{paragraphs(8, NOISE)[0]}</div>", 1),
    ("<article>", f"<section class='comments'>{paragraphs(8, NOISE)[0]}</section></article>", 2),
    ("<article>", f"<ol class='comment-list'>{paragraphs(8, NOISE)[0]}</ol></article>", 2),
    ("<div class=post>", f"</div><div class=cookie-notice><p>{NOISE}</p></div><div class=site-footer><p>{NOISE}</p></div>", 3),
    ("<article>", f"</article><article><p>{NOISE}</p></article>", 6),
    ("<main><article>", f"</article><section id=comments><article class=comment>{paragraphs(9, NOISE)[0]}</article></section></main>", 3),
    (f"<div class=comments-area><article>{paragraphs(4, NOISE)[0]}</article></div><article>", "</article>", 4),
    ("<div id=page class='has-sidebar comments-open'><div class='page-with-header'>", "</div></div>", 3),
    ("<div class='no-sidebar'><form action=/><div class=content>", f"</div></form><div class='sidebar'>{paragraphs(2, NOISE)[0]}</div></div>", 4),
    ("<div class='sidebar-layout'><main>", f"</main><div class=sidebar><p>{NOISE}</p></div></div>", 2),
    ("<section class='search-results'>", f"</section><div class='related-posts'><p>{NOISE}</p></div>", 4),
    ("<div class='comment-section'><main>", f"</main><p>{NOISE}</p></div>", 8),
    ("<article class='post category-social tag-cookies'>", "</article>", 2),
])
def test_page_parts_by_name(before, after, n):
    body, text = paragraphs(n)
    assert tag_paths.main_text(f"<html><body class='comments-open'><nav>Home</nav>{before}{body}{after}</body></html>") == text


def test_pages_against_plain_ratios(spark):
    """The given pages, parsed by the standard library: the text of blocks whose tag path passes the fused ratio, path by path."""
    def tree(page):
        found, path, pieces, skip = [], [], [], []

        def flush():
            text = " ".join("".join(pieces).split())
            if text:
                found.append((tuple(path), text))
            pieces.clear()

        class Reader(HTMLParser):
            def handle_starttag(self, tag, attrs):
                if tag in ("b", "a", "br", "i", "em"):
                    pieces.append(" " if tag == "br" else "")
                    return
                flush()
                if tag == "p" and path and path[-1] == "p":
                    path.pop()
                if tag not in ("meta", "link"):
                    path.append(tag)
                    if tag in ("head", "nav", "footer", "script", "style") or dict(attrs).get("class") == "ad":
                        skip.append(len(path))

            def handle_endtag(self, tag):
                if tag in path:
                    flush()
                    while path.pop() != tag:
                        pass
                    while skip and len(path) < skip[-1]:
                        skip.pop()

            def handle_data(self, data):
                if not skip:
                    pieces.append(data)
        reader = Reader(convert_charrefs=True)
        reader.feed(page)
        reader.close()
        flush()
        return found
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r.page_id: r.text for r in tag_paths.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    for r in rows:
        found = tree(r.html or "")
        ratios = {}
        for path, text in found:
            n, size, points = ratios.get(path, (0, 0, 0))
            ratios[path] = (n + 1, size + len(text), points + sum(text.count(c) for c in ".,;:!?"))
        best = max((size / n * (1 + points) / n for n, size, points in ratios.values()), default=0)
        chosen = {p[:-1] for p, (n, size, points) in ratios.items() if size / n * (1 + points) / n >= 0.2 * best}
        assert got[r.page_id] == "\n\n".join(t for p, t in found if p[:-1] in chosen or p in chosen)


def test_conversations_read_back(spark):
    hard = "\\### Assistant: </turn> ok \\s\\h\\t\\\\ ####</turn></turn>\n"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (1, 1, "assistant", hard), (1, None, None, None), (2, 5, "odd: role\n###", "x"),
            (2, 3, "User", ""), (None, 1, "user", "nobody"), (3, 1, "assistant", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("leaf", F.lit(1))
    out = reply_trees.conversations(reply_trees.as_tree(table))
    got = {r.conv_id: r for r in out.select("conv_id", reply_trees.read_back(F.col("formatted")).alias("turns"), "formatted", "loss",
                                            reply_trees.learned(F.col("formatted"), F.col("loss")).alias("learned")).collect()}
    assert [tuple(t) for t in got[1].turns] == [("", ""), ("user", hard), ("assistant", hard), ("assistant", hard)]
    assert [tuple(t) for t in got[2].turns] == [("User", ""), ("odd: role\n###", "x")] and got[2].learned == ""
    assert got[1].learned == hard * 2 and set(got) == {1, 2, 3} and got[3].learned == ""
    assert all("###" not in got[1].formatted[s["begin"]:s["end"]] for s in got[1].loss)
    assert reply_trees.conversations(reply_trees.as_tree(table.limit(0))).count() == 0


def test_branches_by_rank(spark):
    # 1 -> 2 -> 4, 1 -> 3 -> 5 -> 6, 7 answers a message that is not there, 8 and 9 answer each other
    rows = [(1, None, 1.0), (2, 1, 5.0), (3, 1, 0.0), (4, 2, 0.0), (5, 3, None), (6, 5, 1.0), (7, 99, 0.0), (8, 9, 1.0), (9, 8, 1.0)]
    tree = spark.createDataFrame([(1, m, p, "user", f"t{m}", s) for m, p, s in rows],
                                 "conv long, msg long, parent long, role string, text string, score double")
    out = {r.leaf: (r.rank, r.formatted) for r in reply_trees.conversations(tree).collect()}
    assert {k: v[0] for k, v in out.items()} == {4: 1, 6: 2, 7: 3}
    assert [t in out[6][1] for t in ("t1", "t3", "t5", "t6", "t2")] == [True, True, True, True, False]
    assert out[6][1].index("t1") < out[6][1].index("t3") < out[6][1].index("t5") < out[6][1].index("t6")
    assert [r.leaf for r in reply_trees.conversations(tree, best=1).collect()] == [4]


def test_repeated_messages_count_once(spark):
    rows = [(1, 1, None, "user", "a", 1.0), (1, 1, 2, "user", "b", 1.0), (1, 2, 1, "assistant", "c", 1.0), (1, 2, 1, "assistant", "c", 1.0)]
    messages = spark.createDataFrame(rows, "conv long, msg long, parent long, role string, text string, score double")
    got = reply_trees.conversations(reply_trees.once(messages)).collect()
    assert [r.formatted for r in got] == ["### User:\na</turn>\n### Assistant:\nc</turn>\n"]
    assert reply_trees.once(messages.limit(0)).count() == 0


def test_long_conversation(spark):
    rows = spark.range(300).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    r = reply_trees.conversations(reply_trees.as_tree(rows)).first()
    assert r.formatted == "".join(f"### {('User', 'Assistant')[i % 2]}:\nt{i}</turn>\n" for i in range(300)) and len(r.loss) == 150


def test_top_k_equals_brute_force(spark):
    import random
    rng = random.Random(5)
    same = [rng.gauss(0, 1) for _ in range(8)]
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)] if i % 3 else same) for i in range(400)]
    rows += [(1000, None), (1020, []), (1040, [1.0, None]), (1060, [float("nan")] * 8), (1080, [float("inf")] * 8), (None, same),
             (1100, [0.5] * 5), (20, same), (3, same), (1120, [0.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    usable = [(i, [math.floor(64 * x) for x in v]) for i, v in ((r.vec_id, r.embedding) for r in table.collect())
              if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for at, (i, q) in enumerate(usable):
        if i % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for n, (j, v) in enumerate(usable) if n != at)[:20]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near)]
    got = sorted(tuple(r) for r in voronoi.top_k(table).collect())
    assert got == sorted(want)
    assert voronoi.top_k(table.limit(0)).count() == 0
    assert voronoi.top_k(table.where("vec_id in (20, 21)").limit(2), k=5).count() <= 2
