import random
import re

from pyspark.sql import functions as F

from lumenframe.llm import pagetext as P


def test_markup_blocks_and_references():
    html = """<html><head><title>T</title><style>p{}</style></head><body class="nav-open"><header>Site</header><div id="cookie-notice">We use</div><main><article>
    <header><h1>Head &amp; line</h1></header><p>One <b>two</b>\n three<p>Four<br>five<ul><li>a<li>b</ul><div class="comments"><article>c1</article></div><form>x</form>
    <script>var a="</p>";</script><!-- no --><p>1 &lt; 2 &eacute;</p></article></main><aside>s</aside><footer>f</footer>"""
    assert P.main_text(html) == "Head & line\nOne two three\nFour five\na\nb\n1 < 2 é"


def test_broken_pages():
    assert P.main_text(None) == P.main_text("") == ""
    assert P.main_text("plain < text") == "plain < text"
    assert P.main_text("<p>open<p>next") == "open\nnext"
    assert P.main_text("<article><p>a</article><p>b") == "a"
    assert P.main_text("<!-- never closed <p>x") == ""
    for bad in ("<" * 20_000, "<a '" * 5_000, "<div>" * 20_000 + "deep", "<p>x" * 5_000):
        P.main_text(bad)


def page(k, body):
    return f"<html><body><div><p>Daily Site</p><p>Home News Mail</p></div><div><h1>Title {k}</h1>{body}<p>All rights with the editors.</p></div></body></html>"


def induced(pages):
    wrapper, constant = P.induce(pages)
    return wrapper, frozenset(constant)


def test_constant_nodes_are_template_and_varying_slots_content():
    pages = [page(k, "".join(f"<p>story {k} part {j} goes on.</p>" for j in range(k + 1))) for k in range(5)]
    assert P.main_text(pages[2], *induced(pages)) == "Title 2\nstory 2 part 0 goes on.\nstory 2 part 1 goes on.\nstory 2 part 2 goes on."
    assert P.induce(pages[:2]) == (None, []) and P.induce([pages[0]] * 9) == (None, [])


def test_tree_matching_is_the_largest_ordered_mapping():
    leaf = lambda x: P.Shape("l", x, [])
    a, b = P.Shape("r", "", [leaf("1"), leaf("2"), leaf("3")]), P.Shape("r", "", [leaf("2"), leaf("3")])
    score, pairs = P.tree_match(a, b)
    assert score == 4.0 and [(x.text, y.text) for x, y in pairs if x.text] in ([("2", "2"), ("3", "3")], [("3", "3"), ("2", "2")])
    assert P.tree_match(a, P.Shape("other", "", [])) == (0.0, [])


def test_query_over_hosts(spark, monkeypatch):
    rows = [(k, f"http://a.example/{k}", page(k, f"<p>text {k} and its own long words.</p>"), "c") for k in range(8)]
    rows += [(20, None, page(9, "<p>alone</p>"), "c"), (21, "http://b.example/", None, "c"), (22, "http://a.example/x", "", "c"), (3, rows[3][1], rows[3][2], "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    want = {k: f"Title {k}\ntext {k} and its own long words." for k in range(8)}
    for limit in (P.BROADCAST_BYTES, 0):
        monkeypatch.setattr(P, "BROADCAST_BYTES", limit)
        got = P.extract_pages(df).collect()
        assert len(got) == len(rows) and all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in got if r.page_id in want)
        by = {r.page_id: r.text for r in got}
        assert by[20].startswith("Daily Site") and by[21] == by[22] == ""
    assert P.extract_pages(df.limit(0)).collect() == []


def test_one_odd_page_hides_no_template_block():
    pages = [page(k, f"<p>story {k} goes on.</p>") for k in range(4)]
    for odd in range(5):
        template = induced([*pages[:odd], "<p>moved away</p>", *pages[odd:]])
        assert P.main_text(pages[2], *template) == "Title 2\nstory 2 goes on."


def test_copies_do_not_hide_the_unlike_pages_of_a_host(spark):
    body = lambda k: "".join(f"<p>text {k} part {j} with its own words.</p>" for j in range(40))
    rows = [(k, "http://a.example/", page(k % 4, body(k % 4))) for k in range(60)]  # 15 copies of each
    rows += [(100 + k, "http://b.example/", page(9, body(9) + f"<p>n{k}</p>")) for k in range(60)]  # near copies
    rows += [(200 + k, "http://b.example/", page(k, body(k))) for k in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in P.extract_pages(df).collect()}
    assert len(got) == len(rows) and all("part 39" in t and "Daily Site" not in t and "All rights" not in t for t in got.values())


def test_template_blocks_after_long_lists_are_matched():
    pages = [page(k, "".join(f"<p>story {k} part {j} goes on.</p><p>again</p>" for j in range(700 if k < 2 else 2))) for k in range(5)]
    template = induced(pages)
    for k in range(5):
        text = P.main_text(pages[k], *template)
        assert "All rights" not in text and "Daily Site" not in text and f"story {k} part 1 goes on." in text
    few, many = ([P.shape(P.parse("<body>" + "".join(f"<div>own {k} {j}</div>" for j in range(n)) + f"<div>the end</div><div>date {k}</div>")) for k in (1, 2)] for n in (3, 900))
    for a, b in (few, many):
        assert ("the end", "the end") in [(x.text, y.text) for x, y in P.tree_match(a, b)[1]]


def test_all_articles_and_main_around_them_are_content():
    html = "<p>top</p><main><h1>Title</h1><p>Intro</p><article><p>one is the longest</p></article><article hidden><p>no</p></article><article><p>two</p></article></main><article><p>three</p></article><p>end</p>"
    assert P.main_text(html) == "Title\nIntro\none is the longest\ntwo\nthree"
    assert P.main_text("<article></article><main> </main><p>page") == "page"


def brute_match(a, b):
    """Simple tree matching by its definition: every order-preserving pairing of the children, tried one by one."""
    if a.label != b.label:
        return 0.0

    def lists(xs, ys):
        if not xs or not ys:
            return 0.0
        took = brute_match(xs[0], ys[0])
        return max(lists(xs[1:], ys), lists(xs, ys[1:]), took + lists(xs[1:], ys[1:]) if took else 0.0)

    return 1.0 + (0.5 if a.text and a.text == b.text else 0.0) + lists(a.children, b.children)


def test_tree_matching_equals_brute_force_on_random_trees(monkeypatch):
    rng = random.Random(4)

    def tree(depth):
        kids = [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []
        return P.Shape(rng.choice("ab"), "" if kids else rng.choice(["", "x", "y"]), kids)

    for _ in range(300):
        a, b = tree(3), tree(3)
        b.label = a.label
        score, pairs = P.tree_match(a, b)
        assert score == brute_match(a, b)
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs) and all(x.label == y.label for x, y in pairs)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))


def plain_page(rng, k):
    """No telling tag or name; menu, advert and footer differ from page to page."""
    menu = "".join(f'<div><a href="/{j}">{words(rng, 1)}</a></div>' for j in range(rng.randint(4, 9)))
    advert = f"<div>{words(rng, 8)}</div>" * (1 + k % 2)
    body = "".join(f"<p>{words(rng, rng.randint(10, 60))}</p>" for _ in range(rng.randint(1, 9)))
    text = f"Title {k}\n" + "\n".join(re.findall("<p>(.*?)</p>", body))
    return f"<html><body><div>{menu}</div>{advert}<div><h1>Title {k}</h1>{body}</div><div>{words(rng, 9)}</div></body></html>", text


def test_wrapper_finds_the_article_among_plain_elements():
    rng = random.Random(8)
    made = [plain_page(rng, k) for k in range(30)]
    template = induced([p for p, _ in made])
    for page_, text in made:
        assert P.extract(page_, *template) == (text, True)
        assert P.main_text(page_) != text  # no rule could
    assert P.main_text("<div>another layout</div>", *template) == "another layout"


def test_wrapper_agrees_with_one_from_all_pages():
    rng = random.Random(9)
    made = [plain_page(rng, k) for k in range(24)]
    few, every = induced([p for p, _ in made]), (lambda w, c: (w, frozenset(c)))(*P.induce([p for p, _ in made], 24))
    assert sum(P.main_text(p, *few) == P.main_text(p, *every) for p, _ in made) >= 0.9 * len(made)


def test_every_host_with_enough_pages_has_a_wrapper(spark):
    got = P.extract_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    by = got.select("by_wrapper", F.regexp_extract("url", "://([^/]+)", 1).alias("host"), "text").toPandas()
    hosts = by.groupby("host").by_wrapper.agg(["size", "mean"])
    assert (hosts[hosts["size"] >= 8]["mean"] == 1).all() and not by.text.str.contains("<").any()


def test_names_and_attributes_take_out_no_article():
    for html, want in {
        '<article><div style="overflow:hidden"><p>text</div></article>': "text",
        '<p title="the hidden valley">text</p>': "text",
        '<div data-hidden="false"><p>text</div>': "text",
        '<div class="layout with-sidebar"><p>text</div>': "text",
        '<div class="post comments-open"><p>text</div>': "text",
        '<p class="search-tips">text</p><p>more</p>': "text\nmore",
        '<div class="comments"><p>the whole page hangs below this name</div><p>more</p>': "the whole page hangs below this name\nmore",
        '<div class="site-header">a</div><p hidden>b</p><p>more and more text</p><div id="post-comments">c</div><div role="navigation">d</div><div class="ad-container">e</div>': "more and more text",
    }.items():
        assert P.main_text(html) == want, html
