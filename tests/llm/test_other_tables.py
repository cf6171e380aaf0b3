"""Operators on embeddings, conversations and pages, and the pipeline."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import same_rows
from kinfold.llm import chat_tree, embedding_dedup, html_text, mixing, ngram_join, queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    same_rows(queries.queries()[name](spark, sf_dir), duck, queries.oracle_sql()[name])


# --- embeddings


def brute_links(rows, cosine=0.93):
    up = {i: i for i, _, _ in rows}
    find = lambda x: x if up[x] == x else find(up[x])
    n = dict.fromkeys(up, 0)
    ok = [(i, np.array(v, float), l) for i, v, l in rows if v and l is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    for k, (i, x, l) in enumerate(ok):
        for j, y, m in ok[:k]:
            if l == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (n[i], find(i), find(i) == i) for i in up}


@pytest.mark.parametrize("dim,seed", [(64, 1), (7, 2), (3, 3)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, dim, seed):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 4)
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(60):
        c = r.normal(size=dim)
        for _ in range(r.integers(1, 12)):
            v = c if r.random() < 0.3 else c + r.normal(size=dim) * r.choice([0.05, 0.2, 0.35, 1]) * np.linalg.norm(c) / np.sqrt(dim)
            rows.append((len(rows), [float(x) for x in np.float32(v * r.uniform(0.5, 2))], int(r.integers(0, 2))))
    rows += [(len(rows) + i, v, l) for i, (v, l) in enumerate([(None, 1), ([], 1), ([0.0] * dim, 1), ([float("nan")] * dim, 1), ([float("inf")] + [0.0] * (dim - 1), 1), ([None] + [1.0] * (dim - 1), 1), ([1.0] * dim, None), ([1.0] * (dim + 1), 0), ([2.0] * (dim + 1), 0)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"node": F.lit(1), "kept": F.lit("x"), "copies": F.lit(2)})
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_dedup.near_duplicates(df, sigmas=None).collect()}
    want = brute_links(rows)
    assert got == want
    most = {x.vec_id: x.n_links for x in embedding_dedup.near_duplicates(df).collect()}
    assert all(most[i] <= want[i][0] for i in want)
    assert sum(most.values()) >= 0.99 * sum(n for n, _, _ in want.values())


def planted(seed=11, table="/root/testdata/sf0.1/embeddings.parquet", each=10):
    """The table's vectors, ``each`` times with noise, and near copies of them: pairs, groups and chains of several spreads.

    Gives ids, unit vectors, labels, and for each planted vector the cosine that it was given with its base.
    """
    import pyarrow.parquet as pq

    r = np.random.default_rng(seed)
    base = np.array(pq.read_table(table)["embedding"].to_pylist(), np.float64)
    base = np.concatenate([base + r.normal(size=base.shape) * 0.12 for _ in range(each)])
    base /= np.linalg.norm(base, axis=1)[:, None]
    rows, labels = [base], [r.integers(0, 2, len(base)) * (r.random(len(base)) < 0.1)]  # label 0 has most

    def near(x, cosine):
        side = r.normal(size=x.shape)
        side -= (side * x).sum(axis=1)[:, None] * x
        side /= np.linalg.norm(side, axis=1)[:, None]
        return cosine * x + (1 - cosine**2) ** 0.5 * side

    for cosine in (0.932, 0.94, 0.96, 0.98, 0.999):
        at = r.choice(len(base), 500, replace=False)
        rows.append(near(base[at], cosine))
        labels.append(labels[0][at])
    at = r.choice(len(base), 60, replace=False)
    link = base[at]
    for _ in range(8):  # chains that leave their list
        link = near(link, 0.95)
        rows.append(link)
        labels.append(labels[0][at])
    x = np.concatenate(rows).astype(np.float32)
    return x, np.concatenate(labels)


def brute_pairs(x, labels, cosine=0.93):
    """(a, b) rows, a < b, of equal labels at the cosine or over."""
    u = x.astype(np.float64)
    u /= np.sqrt((u * u).sum(axis=1))[:, None]
    out = []
    for at in range(0, len(u), 2000):
        i, j = np.nonzero((u[at : at + 2000] @ u.T >= cosine) & (labels[at : at + 2000, None] == labels))
        out.append(np.stack([i + at, j])[:, i + at < j])
    return np.concatenate(out, axis=1)


def test_recall_with_planted_links(spark):
    """Over 20,000 vectors a label with thousands of links: the default probes find at least 0.99 of them, and of every spread 0.98."""
    x, labels = planted()
    assert np.bincount(labels)[0] > 20_000
    a, b = brute_pairs(x, labels)
    assert len(a) > 2500
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels))], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    want = np.bincount(np.concatenate((a, b)), minlength=len(x))
    n = np.array([got[i].n_links for i in range(len(x))])
    assert (n <= want).all() and n.sum() >= 0.99 * want.sum()
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    cosine = (u[a] * u[b]).sum(axis=1)
    joined = np.array([got[int(i)].component_id == got[int(j)].component_id for i, j in zip(a, b)])
    for low, high in ((0.93, 0.935), (0.935, 0.95), (0.95, 0.97), (0.97, 1.01)):
        band = (cosine >= low) & (cosine < high)
        assert band.sum() > 100 and joined[band].mean() >= 0.98, (low, joined[band].mean())


def test_links_found_from_one_end_count_for_both(spark, monkeypatch):
    """With too few probes some links are found from one end only; counts still agree: their sum is even and no link is half."""
    monkeypatch.setattr(embedding_dedup, "LEAST_LISTS", 64)
    monkeypatch.setattr(embedding_dedup, "PER_LIST", 4)
    r = np.random.default_rng(8)
    rows = []
    for _ in range(150):
        c = r.normal(size=8)
        rows += [(len(rows) + k, [float(x) for x in np.float32(c + r.normal(size=8) * 0.3 * k * np.linalg.norm(c) / 8**0.5)], 1) for k in range(2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute_links(rows)
    for sigmas in (0.0, 0.5, None):
        got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dedup.near_duplicates(df, sigmas=sigmas).collect()}
        linked = {i for i in got if got[i][0]}
        assert linked == {i for i in got if list(c for _, c in got.values()).count(got[i][1]) > 1}
        assert sum(n for n, _ in got.values()) % 2 == 0
    assert got == {i: w[:2] for i, w in want.items()}


def test_directed_differences_lose_no_link(spark):
    """Vectors on a circle: neighbours lie straight towards other lists' centroids."""
    turn = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    plane = np.linalg.qr(np.random.default_rng(4).normal(size=(64, 2)))[0]
    rows = [(i, [float(x) for x in np.float32(plane @ (np.cos(t), np.sin(t)))], 1) for i, t in enumerate(turn)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_dedup.near_duplicates(df).collect()} == brute_links(rows)


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, None, 1), (None, [1.0], 1), (2, [1.0], 1), (2, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()), key=repr)
    assert got == [(1, 0, 1, True), (2, 1, 2, True), (2, 1, 2, True), (None, 0, None, True)]


# --- conversations


def test_probe_conversation_and_sharing(spark, sf_dir):
    rows = {r.conv_id: r for r in queries.queries()["op5_chat"](spark, sf_dir).collect()}
    p = chat_tree.PROBE
    assert rows[-7].n_turns == 2 and rows[-7].loss_chars == len(p) and rows[-7].loss_sha256 == hashlib.sha256(p.encode()).hexdigest()
    assert rows[-7].turns_sha256 == hashlib.sha256(f"user\n{p}\nassistant\n{p}\n".encode()).hexdigest()


def test_escapes_are_reversible():
    for role, text in [("a:b", "x"), ("", ""), ("### x: ", "\\### Assistant: </turn>\n### y: z </turn>\n"), ("\\", "\\\\#<\\"), ("r", "é😀\n\n")]:
        segment, low, high = chat_tree.render(role, text)
        assert chat_tree.parse(segment * 2) == [(role, text)] * 2 and chat_tree.unescape(segment[low:high]) == text
    with pytest.raises(ValueError):
        chat_tree.parse("### a: b")


@pytest.mark.parametrize("hot", [1000, 8, 1])  # all keys are hot, some, none
def test_forest_shares_turns_and_attends_to_ancestors(spark, monkeypatch, hot):
    monkeypatch.setattr(chat_tree, "HOT", hot)
    r = random.Random(1)
    rows = []
    for c in range(40):
        for t in range(r.randint(1, 6)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"t{r.randint(0, 1)}" if t < 4 else f"{c}"))
    rows += [(90, None, None, None), (90, 1, "assistant", "a"), (90, 1, "assistant", "a"), (None, 0, "user", "t0")] + [(91, i, "user", "u") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("clash"))
    nodes, own = chat_tree.build(df, spark)
    stream, paths = {}, set()
    by = {}
    for c, t, role, text in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, x[1] or 0)):
        by.setdefault(c, []).append((role or "", text or ""))
    for c, turns in by.items():
        paths |= {tuple(turns[: i + 1]) for i in range(len(turns))}
    held = nodes.orderBy("start").collect()
    assert len(held) == len(paths)  # each shared turn once
    at = 0
    for n in held:
        assert n.start == at and n.n == len(n.segment)
        stream[n.start] = n.segment
        at += n.n
    text = "".join(stream[s] for s in sorted(stream))
    for c in chat_tree.read_back(nodes, own).collect():
        seen = "".join(text[a:b] for a, b in c.intervals)
        assert chat_tree.parse(seen) == by[c.conv_id] and c.formatted_chars == len(seen)
    position = {n.start: n.position for n in held}
    for c in chat_tree.read_back(nodes, own).collect():
        assert position[c.intervals[0][0]] == 0
    assert chat_tree.read_back(*chat_tree.build(df.limit(0), spark)).count() == 0


# --- pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>menu</a></ul></nav><div class="cookie notice">We use cookies.</div><aside>side</aside>
<article class="post"><h1>Head &amp; line</h1><p>First  para&nbsp;graph,<br>with <b>bold</b> &lt;tags&gt;.<p>Second one, unclosed.
<div class="ad">Buy now!</div><ul><li>one, two<li>three</ul><form><input>Mail</form><blockquote>Quoted, too.</blockquote></article>
<section id="comments"><p>First comment, a long one, with marks.</p></section><footer>(c) us</footer></body></html>"""


def test_main_text_of_a_page():
    want = ["Head & line", "First para graph, with bold <tags>.", "Second one, unclosed.", "one, two", "three", "Quoted, too."]
    assert html_text.main_text(PAGE) == "\n\n".join(want)


def test_pages_without_an_article_are_told_by_paths():
    menu = "".join(f"<div class=x><a href=#>link {i}</a></div>" for i in range(30))
    body = "".join(f"<p>A sentence, number {i}, with words enough to count as text; more follows here.</p>" for i in range(6))
    page = f"<html><body><div>{menu}</div><div class=c1><h2>Title</h2>{body}<p>Short.</p></div><div class=z>Terms</div></body></html>"
    got = html_text.main_text(page).split("\n\n")
    assert got[0] == "Title" and got[-1] == "Short." and len(got) == 8


LONG = "A sentence, with words enough to count as text; more follows here. " * 20


def test_nested_articles_are_whole():
    text = lambda inner: html_text.main_text(f"<html><body><div><a href=m>menu</a></div>{inner}<div>Terms</div></body></html>").split("\n\n")
    long = LONG.strip()
    assert text(f'<article><h1>Title</h1><p>Lead</p><div class="body"><p>{LONG}</p></div></article>') == ["Title", "Lead", long]
    assert text(f"<main><h1>Title</h1><article><p>Lead</p><blockquote><p>{LONG}</p></blockquote></article><ul><li><a href=n>next page</a></ul></main>") == ["Title", "Lead", long]
    for kind, cell in (("ul", "li"), ("table", "td")):
        assert text(f"<article><p>Before</p><{kind}><{cell}>{LONG}</{cell}></{kind}></article>") == ["Before", long]
    assert text(f"<article><h2><a href=x>Linked heading</a></h2><p>{LONG}</p><ol><li><a href=r>Reference</a></ol></article>") == ["Linked heading", long, "Reference"]
    assert text(f"<article class=a><p>Short one.</p></article><article class=b><p>{LONG}</p></article>") == ["Short one.", long]
    assert text(f'<div class=c><h1>Title</h1><p>Lead.</p><div class=d><p>{LONG}</p></div></div>') == ["Title", "Lead.", long]


def test_text_before_the_first_block():
    assert html_text.main_text(f"x<ul><li><a href=l>link</a></ul><p>{LONG}</p>").endswith(LONG.strip())


def test_links_end_with_their_block():
    for a in ("<a name=top>", "<p><a href=x>link</p>"):
        found = html_text.blocks(f"<div>{a}<p>One, two.</p><p>Three.</p></div>")
        assert [b.links for b in found if b.text != "link"] == [0, 0]
    assert all(b.links for b in html_text.blocks("<div><a href=x><h3>Card</h3><p>Teaser</p></a></div>"))


def test_names_do_not_rule_out_the_content():
    long = LONG.strip()
    for outer, inner in (
        ('main class="content has-sidebar"', "section"), ('div class="site no-sidebar"', "article"), ("div", 'article class="post has-comments tag-social"'),
        ('div id="search-results"', "article"), ("div class=widget", "article"), ("div class=overlay", "main"), ("form id=aspnetForm", "div"), ("div class=widget", "div"),
        ("div", 'article class="comments"'), ("div", "div title='the hidden truth'"), ("div", "div data-x='class=ad'"),
    ):
        assert html_text.main_text(f"<body><{outer}><{inner}><p>{LONG}</p></{inner.split()[0]}></{outer.split()[0]}></body>") == long, (outer, inner)


def test_names_rule_out_boilerplate():
    long = LONG.strip()
    for what in ("class=ad", "class='cookie-banner'", "class='x site-footer'", "id=comments", "class=share-buttons", "role=navigation", "hidden", "aria-hidden=true", "style='display: none'"):
        assert html_text.main_text(f"<body><article><p>{LONG}</p><div {what}><p>Something else.</p></div></article></body>") == long, what
    thread = f"<div id=comments><article class=comment><p>{LONG}</p></article></div>"
    assert html_text.main_text(f"<body><article><p>{LONG}</p></article>{thread}</body>") == long


def test_ids_that_headings_and_sections_have_by_chance():
    long = LONG.strip()
    text = lambda inner: html_text.main_text(f"<body><nav><a href=m>menu</a></nav><article><p>{LONG}</p>{inner}</article></body>").split("\n\n")
    for name in ("discussion", "search", "related"):
        assert text(f'<h2 id="{name}">Discussion</h2><p>More.</p>') == [long, "Discussion", "More."]
        assert text(f'<section id="{name}"><h2>Discussion</h2><p>{LONG}</p></section>') == [long, "Discussion", long]
    for name in ("follow", "tags", "rating"):
        assert text(f'<div class="{name}"><p>{LONG}</p></div>') == [long, long]
        assert text(f'<div class="{name}"><a href=x>one</a> <a href=y>two</a></div>') == [long]
    assert text('<section id="comments"><p>A reader. Says this, and that. ' + LONG + "</p></section>") == [long]


def test_headers_of_articles_are_told_by_their_paths():
    page = f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1><p>By J. Doe</p></header><p>{LONG}</p><footer>(c)</footer></article></body>"
    assert html_text.main_text(page) == f"Title\n\n{LONG.strip()}"


def test_text_of_formulas_objects_and_fallbacks_stays():
    page = f"<body><article><p>Let <math><mi>x</mi></math> be. <object>Plan B.</object></p><noscript><p>{LONG}</p></noscript></article><noscript>Turn scripts on.</noscript></body>"
    assert html_text.main_text(page) == f"Let x be. Plan B.\n\n{LONG.strip()}"


def test_an_article_beside_a_main_of_one_line():
    assert html_text.main_text(f"<body><main><p>Welcome, reader.</p></main><article><h1>T</h1><p>{LONG}</p></article></body>") == f"Welcome, reader.\n\nT\n\n{LONG.strip()}"


@pytest.mark.parametrize("attrs", ["", " class=ad", " class=x"])
def test_deep_pages_take_linear_time(attrs):
    deep = f"<div{attrs}>" * 600 + "<p>x y.</p>" * 90_000  # 1 MB
    began = time.process_time()
    assert html_text.main_text(deep).count("x y.") == 90_000
    nested = "".join(f"<div class=c{i}><p>Text, number {i}.</p>" for i in range(20_000))
    assert html_text.main_text(nested)
    assert time.process_time() - began < 10


def test_articles_named_otherwise_are_found_by_their_paths(spark):
    """The table's articles as plain divs: path scores alone find all of their text, and no menu, advert or footer."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    same = short = 0
    for page in pages:
        want, got = html_text.main_blocks(page), html_text.main_blocks(page.replace("article>", "div>"))
        assert not set(got) - set(want)
        same += got == want
        short += sum(map(len, want)) - sum(map(len, got))
    assert same >= 0.97 * len(pages) and short <= 0.01 * sum(len(p) for p in pages)


def brute_scores(page):
    """Smoothed ratios by root-to-leaf paths as strings, from the blocks' own texts."""
    whole = html_text.read(page)

    def path(e):
        return (path(whole.holder[e]) if e else "") + "/" + " ".join(whole.part[whole.path[e]])

    rows = [(path(b.element), b.text, b.links) for b in whole.blocks]
    ratio = {}
    for p in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == p]
        chars, marks, links = sum(len(t) for _, t, _ in own), sum(t.count(c) for _, t, _ in own for c in ".,;:!?…。、，；：！？"), sum(x for _, _, x in own)
        ratio[p] = chars / len(own) * (0.25 + marks / len(own)) ** 0.5 * (1 - links / chars)
    raw = [ratio[r[0]] for r in rows]
    score = {}
    for i, (p, _, _) in enumerate(rows):
        near = raw[max(0, i - 1) : i + 2]
        score.setdefault(p, []).append((raw[i] + sum(near)) / (1 + len(near)))
    return rows, {p: sum(s) / len(s) for p, s in score.items()}


def test_paths_over_the_threshold_are_content(spark):
    """On the table's pages without marks, a block whose path scores a tenth of the best is kept, if it stands where nine tenths of the weight are."""
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()[:60]:
        page = r.html.replace("article>", "div>").replace('<div class="ad">', "<div>")
        rows, score = brute_scores(page)
        body = next(p for p, t, _ in rows if t == max((t for _, t, _ in rows), key=len)).rsplit("/", 1)[0]
        most = max(score[p] for p, _, _ in rows if p.startswith(body))
        must = [t for p, t, _ in rows if p.startswith(body + "/") and score[p] >= 0.1 * most]
        got = html_text.main_blocks(page)
        assert must and [t for t in got if t in set(must)] == must


def test_markup_that_never_ends_takes_linear_time():
    n = 300_000
    for page in ("<p>x</p><p>" + "<a " * n, "<p>x</p>" + "<div>" * n + "y" + "</ul>" * n, "<p>x" + "<a '>" * n + '"', "<svg/>" * n + "<p>x</p>", "<p>x</p>" + "<!--" * n, "<p>x</p>" + "<b title=\"x' " * n, "<p>x</p>" + "<b title= 'x" * n + ">"):
        began = time.process_time()
        assert "x" in html_text.main_text(page)
        assert time.process_time() - began < 10


def test_quotes_delimit_values_only():
    page = "<article><p title='a > b'>One.</p><p title=don't>It's two.</p><p a\"b>Three \"3\".</p></article>"
    assert html_text.main_text(page) == "One.\n\nIt's two.\n\nThree \"3\"."


def test_odd_pages(spark):
    pages = [None, "", "plain text", "<", "<p", "<script>", "<!-- only", "<p>a", "</p></div>x", "<article></article>", "&amp;lt;", "<p>" + "word, " * 50_000]
    df = spark.createDataFrame([(i, f"u{i}", h, "x", 1) for i, h in enumerate(pages)], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert len(got) == len(pages) and got[0].text == got[1].text == got[9].text == "" and got[2].text == "plain text"
    assert got[10].text == "&lt;" and got[11].n_chars == 6 * 50_000 - 1 and all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.extract(df.limit(0)).count() == 0


def test_articles_of_the_table(spark, sf_dir):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.queries()["op8_html"](spark, sf_dir).collect():
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n\n".join(p for p in parts if p)


# --- pipeline


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{sf_dir}/labels.parquet").dropDuplicates(["doc_id"])
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "source_mix", "tokens"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.shared(stage(spark, kept, sf_dir), name)
        assert out.columns == columns
        before, after = kept.count(), out.count()
        if name == "quality":
            share = {r.quality: r.n for r in out.join(labels, "doc_id").groupBy("quality").agg(F.count("*").alias("n")).collect()}
            total = {r.quality: r.n for r in kept.join(labels, "doc_id").groupBy("quality").agg(F.count("*").alias("n")).collect()}
            assert share[1] >= 0.97 * total[1] and share.get(0, 0) <= 0.1 * total[0] and after < before
        elif name == "language":
            assert after >= 0.99 * before
            blank = spark.createDataFrame([(-1, "12 ##", "en", "src0", 5), (-2, None, None, None, None)], docs.select(columns).schema)
            assert stage(spark, kept.unionByName(blank), sf_dir).where("doc_id < 0").count() == 0
        elif name == "near_duplicates":
            groups = ngram_join.jaccard_components(kept).select("component_id").distinct().count()
            assert after == groups
        else:
            times = {r.doc_id: r.taken // r.size for r in mixing.mix(kept).collect() if r.size}
            assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {i: n for i, n in times.items() if n}
        kept = out
    last = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert last.count() == kept.count()


def test_pipeline_of_nothing(spark, tmp_path, sf_dir):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
