from collections import defaultdict

from lumenframe.llm import linededup


def brute(rows, ratio, least, keep_repeated=False):
    pages, df = defaultdict(int), defaultdict(int)
    for _, text, host in rows:
        pages[host] += 1
        for line in {x.strip(" ") for x in (text or "").split("\n") if x.strip(" ")}:
            df[host, line] += 1
    out = []
    for i, text, host in rows:
        if text is None:
            out.append((i, None))
            continue
        lines = text.split("\n")
        bad = [x.strip(" ") != "" and df[host, x.strip(" ")] >= least and df[host, x.strip(" ")] > ratio * pages[host] for x in lines]
        kept = [x for x, b in zip(lines, bad) if not b]
        out.append((i, text if keep_repeated and not any(x.strip(" ") for x in kept) else "\n".join(kept)))
    return out


def test_drops_lines_over_the_ratio_only_on_that_site(spark):
    rows = [(i, f"menu\nbody {i}\n\n  footer  ", "a") for i in range(20)]
    rows += [(100 + i, f"body {i}\nrare" if i < 4 else f"menu {i}", "b") for i in range(20)]
    rows += [(200, None, "a"), (201, "", None), (202, "x\nx\nx", None), (203, "menu\nbody", None), (204, "menu", "a"), (204, "menu", "a"), (205, "line\n" * 30_000, "a")]
    df = spark.createDataFrame([(i, t, s, 0) for i, t, s in rows], "doc_id long, text string, source string, bad int")
    for ratio, least in ((0.5, 2), (0.1, 3), (0.15, 5)):
        for keep in (False, True):
            got = linededup.site_line_dedup(df, max_ratio=ratio, min_pages=least, keep_repeated=keep)
            assert got.columns == ["doc_id", "text", "source", "bad", "n_lines", "n_dropped"]
            key = lambda r: (r[0], r[1] or "")
            assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted(brute(rows, ratio, least, keep), key=key)


def test_columns_named_like_the_counts_are_replaced(spark):
    df = spark.createDataFrame([(1, "a\nb", "s", "x", "y")], "doc_id long, text string, source string, n_lines string, n_dropped string")
    assert linededup.site_line_dedup(df).collect() == [(1, "a\nb", "s", 2, 0)]
    assert linededup.site_line_dedup(df).columns == ["doc_id", "text", "source", "n_lines", "n_dropped"]


def test_salted_join_beyond_the_broadcast_limit_gives_the_same(spark, monkeypatch):
    rows = [(i, f"menu\nbody {i}\nfooter", f"s{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(linededup.site_line_dedup(df).collect())
    monkeypatch.setattr(linededup, "BROADCAST_BYTES", 0)
    assert sorted(linededup.site_line_dedup(df).collect()) == want
    assert want[0].text == "body 0" and want[0].n_dropped == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert linededup.site_line_dedup(df).collect() == []


def test_long_passages_go_across_sites_but_copies_stay(spark, monkeypatch):
    said = lambda tag, n=60: " ".join(f"{tag}w{j}" for j in range(n))
    rows = [(i, f"{said(f'own{i}')}\n{said('notice')}\n{said('second')}\n{said('third')}\n{said(f'end{i}')}\nshort line", f"s{i}") for i in range(8)]
    rows += [(20 + i, f"{said('head')}\n{said('copied')}\n{said('tail')}", f"s{i}") for i in range(8)]  # copies
    rows += [(40 + i, f"{said('a')}\n{said('b')}\n{said('c')}\n{said('d')}\nedit {i if i < 2 else 9}", f"s{i}") for i in range(8)]  # near copies
    rows += [(60 + i, f"{said('rare')}\nbody {i}", f"s{i}") for i in range(4)] + [(70, None, "s0"), (71, said("notice"), "s1"), (72, "", None)]
    rows += [(80, "\n".join(f"{said('again')}\nx{j}" for j in range(9)), "s0")]  # often, but on one page
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planted = {said(x) for x in ("notice", "second", "third")}
    want = {i: t if i == 71 or t is None else "\n".join(x for x in t.split("\n") if x not in planted) for i, t, _ in rows}
    for limit in (linededup.BROADCAST_BYTES, 0):
        monkeypatch.setattr(linededup, "BROADCAST_BYTES", limit)
        got = linededup.site_line_dedup(df, passages=True, keep_repeated=True).collect()
        assert len(got) == len(rows) and {r.doc_id: r.text for r in got} == want
        assert {r.n_dropped for r in got if r.doc_id < 8} == {3}
