import os
import random

from shoalspark.llm import html

PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li>Home<li>News</ul></nav><!-- c <p>x</p> --><div class=\"ad\">Buy</div>{}<footer>&copy; me</footer></body></html>"


def rows(spark, pages):
    return spark.createDataFrame([(i, u, h, "z") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, lines string").repartition(2)


def texts(spark, pages, **kw):
    return {r["page_id"]: r["text"] for r in html.extract(rows(spark, pages), **kw).collect()}


def test_article_only(spark):
    pages = [
        ("http://a.com/x/1", PAGE.format("<article><h1>Head &amp; tail</h1><p><b>One<br><p>two\n  <i>three</i>&nbsp;&#233;</p><aside>side</aside><section id=comments><p>me too</p></section><form>f<input></form><p>end</article>")),
        ("http://a.com/x/2", "<article><p>open <div>inner</div> tail"),
        ("http://a.com/x/3", None),
        (None, ""),
        ("http://a.com/x/4", "1 < 2 &lt;b&gt; <p>a<script>x<y</script>b"),
        ("http://a.com/x/5", PAGE.format("<main><div class='cookie-notice'>ok?</div><p>body</p></main>")),
    ]
    got = texts(spark, pages)
    assert got[0] == "Head & tail\nOne\ntwo three é\nend"
    assert got[1] == "open\ninner\ntail" and got[2] == "" and got[3] == ""
    assert got[4] == "1 < 2 <b>\nab" and got[5] == "body"


def test_differencing_decides_without_an_article(spark):
    body = "<div>Our site</div><div>Story {0}</div><div>Contact us</div><p>More {0}</p><div>All rights</div>"
    pages = [(f"http://b.com/news/{i}?q=1", f"<body>{body.format(i)}</body>") for i in range(6)]
    got = texts(spark, pages)
    assert all(got[i] == f"Story {i}\nMore {i}" for i in range(6))
    lone = texts(spark, [("http://c.com/a/1", f"<body>{body.format(1)}</body>")])
    assert lone[0] == "Our site\nStory 1\nContact us\nMore 1\nAll rights"


def test_hot_host_is_split(spark):
    pages = [(f"http://b.com/n/{i}", f"<div>Top</div><p>s{i}</p>") for i in range(60)]
    got = texts(spark, pages, group=10)
    assert len(got) == 60 and all(got[i] == f"s{i}" for i in range(60))


def test_lcs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert sum(html.shared(a, b)) == best[-1][-1]


def test_empty_and_code_points(spark):
    assert html.extract(rows(spark, [])).count() == 0
    r = html.extract(rows(spark, [("http://a.com/", "<article>\U0001f600é</article>")])).first()
    assert r["n_chars"] == 2


def brute(pages):
    """The docstring, page by page: different pages of a host in URL order, the nearer neighbour, a plain LCS table."""
    import re
    from collections import defaultdict

    read = [html.read_lines(h) if h else [] for _, h in pages]
    rest = [tuple(x for z, x in r if z != html.ARTICLE) for r in read]
    hosts, place = defaultdict(dict), []
    for (url, _), lines in zip(pages, rest):
        bare = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", re.sub(r"[?#].*$", "", url or ""))
        host, path = bare.split("/")[0].lower(), re.sub(r"^[^/]*", "", bare)
        place.append((host, path))
        if url is not None and lines:
            hosts[host][lines] = min(hosts[host].get(lines, (path, url)), (path, url))
    out = []
    for (url, _), lines, r, (host, _) in zip(pages, rest, read, place):
        if len(lines) < len(r):
            out.append("\n".join(x for z, x in r if z == html.ARTICLE))
            continue
        order = sorted(hosts[host], key=lambda x: hosts[host][x])
        other = ()
        if url is not None and lines:
            k, mine = order.index(lines), hosts[host][lines][0]
            near = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order)]
            if near:
                other = max(near, key=lambda x: len(os.path.commonprefix([mine, hosts[host][x][0]])))
        best = [[0] * (len(other) + 1) for _ in range(len(lines) + 1)]
        for i, x in enumerate(lines):
            for j, y in enumerate(other):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        gone, i, j = set(), len(lines), len(other)
        while i and j:
            if lines[i - 1] == other[j - 1]:
                i, j = i - 1, j - 1
                gone.add(i)
            elif best[i - 1][j] >= best[i][j - 1]:
                i -= 1
            else:
                j -= 1
        out.append("\n".join(x for i, (z, x) in enumerate(r) if z == html.PAGE and i not in gone))
    return out


def crawl():
    rng = random.Random(3)
    pages = []
    for host in ("a.org", "b.org"):
        for k in range(40):
            body = "".join(f"<div>{x}</div>" for x in ("Site", "Top", f"Part {k % 4}"))
            story = "".join(f"<p>s{rng.randrange(10**6)}</p>" for _ in range(3))
            wrapped = f"<article>{story}</article>" if k % 5 == 0 else story
            pages.append((f"http://{host}/{'ab'[k % 2]}/{rng.randrange(1000)}?x={k}", f"<body>{body}{wrapped}<div>End</div><footer>f</footer></body>"))
    pages += [pages[2]] * 5 + [(f"http://a.org/a/copy{k}", pages[2][1]) for k in range(6)] + [(None, pages[3][1]), ("http://b.org/z", None), ("http://c.org/", pages[4][1])]
    return pages


def test_whole_query_as_brute_force_whatever_the_ranges(spark):
    pages = crawl()
    want = brute(pages)
    for group in (1, 7, html.GROUP):
        assert texts(spark, pages, group=group) == dict(enumerate(want))


def test_equal_pages_give_equal_texts(spark):
    body = "<div>Our site</div><p>Story {}</p><div>All rights</div>"
    got = texts(spark, [(f"http://b.com/n/{i}", body.format(i // 4)) for i in range(12)])
    assert all(got[i] == f"Story {i // 4}" for i in range(12))


def test_broken_and_very_long_markup():
    import time

    start = time.time()
    assert html.read_lines('<p class="x>Hello</p>') == [(html.PAGE, "Hello")]
    assert html.read_lines("a<b c") == [(html.PAGE, "a")] and html.read_lines("<p title=don't>x</p>") == [(html.PAGE, "x")]
    assert html.read_lines("<p a='>' b=\">\">x<!-- > --> y<!-- never") == [(html.PAGE, "x y")]
    for piece in ("<a ", "<a b=", '<a b="', "<", "<!", "</x>", "<div>", "<li><b>", "&amp", "<p>x", '<a ="', "<a b='\""):
        html.read_lines("<b>" * 1000 + piece * 200_000)
        html.read_lines("<div>" * 50_000 + piece * 50_000)
    a, b = ["same"] * 30_000, ["same"] * 20_000 + ["x"] * 10_000
    assert sum(html.shared(a, b)) == 20_000
    rng = random.Random(2)
    a, b = ([rng.choice("abcdefgh") for _ in range(20_000)] for _ in range(2))
    one = sum(html.shared(a, b))
    assert 10_000 < one < 20_000 and time.time() - start < 60


def test_repeated_rows_have_a_result_each(spark):
    df = rows(spark, [(f"http://a.com/x/{i}", f"<div>Top</div><p>s{i}</p>") for i in range(4)] + [(None, None)])
    got = html.extract(df.unionByName(df)).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted([(0, "s0"), (1, "s1"), (2, "s2"), (3, "s3"), (4, "")] * 2)


STORY = "<article><h1>Title {0}</h1><div class=body><p>First {0}</p><p>As ever.</p><div class=title><h2>Results</h2></div><p>Second {0}</p><p>Third {0}</p><p>Last {0}</p></div><div class='x7'><p>Tell a friend</p><p>Follow us</p></div></article>"


def test_differencing_decides_in_articles_too(spark):
    pages = [(f"http://d.com/n/{i}", f"<p>Top</p>{STORY.format(i)}<p>End</p>") for i in range(8)]
    pages += [(f"http://e.com/n/{i}", f"<p>Top {i}</p>{STORY.format('x').replace('Second', f'{i}')}") for i in range(8)]  # one story, told again
    pages += [("http://f.com/n/1", STORY.format(1))] + [(f"http://g.com/n/{i}", STORY.format(i)) for i in range(4)]
    df = rows(spark, pages)
    got = {r["page_id"]: r for r in html.extract(df).collect()}
    for i in range(8):
        assert got[i]["text"] == f"Title {i}\nFirst {i}\nAs ever.\nResults\nSecond {i}\nThird {i}\nLast {i}" and got[i]["n_shared"] == 4
        assert got[8 + i]["text"].endswith("Tell a friend\nFollow us") and "As ever." in got[8 + i]["text"] and got[8 + i]["n_shared"] == 0
    for i in range(16, 21):  # a lone page, and too few
        assert got[i]["text"].endswith("Tell a friend\nFollow us") and got[i]["n_shared"] == 0


def test_given_pages_are_all_differenced(spark):
    """Each page of the smallest table against its partner, one by one; articles come out whole, as they hold no container."""
    import re

    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    hosts, want = {}, {}
    for r in df.collect():
        lines = html.read_lines(r["html"])
        host, _, path = re.sub(r"[?#].*$", "", r["url"]).split("://")[1].partition("/")
        hosts.setdefault(host.lower(), []).append(("/" + path, r["url"], r["page_id"], lines))
    for order in map(sorted, hosts.values()):
        for k, (path, _, i, lines) in enumerate(order):
            near = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order)]
            other = max(near, key=lambda x: len(os.path.commonprefix([path, x[0]])))[3] if near else []
            cut = html.shared([x for _, x in lines], [x for _, x in other])
            want[i] = ("\n".join(x for z, x in lines if z == html.ARTICLE), sum(c for (z, _), c in zip(lines, cut) if z != html.ARTICLE))
    assert {r["page_id"]: (r["text"], r["n_shared"]) for r in html.extract(df).collect()} == want
    assert sum(n for _, n in want.values()) > 0


def test_many_copies_are_dealt(spark, monkeypatch):
    pages = [(f"http://d.com/n/{i // 7}", f"<p>Top</p>{STORY.format(i // 7)}") for i in range(56)] + [(None, STORY)] * 5 + [("http://d.com/n/z", None)] * 9
    pages += [(f"http://d.com/m/{i // 7}", f"<div>Top</div><nav>n{i // 7}</nav><p>Body {i // 7}</p>") for i in range(28)]
    df = rows(spark, pages)
    once = sorted(map(tuple, html.extract(df).collect()), key=str)
    monkeypatch.setattr(html, "HOT", 2)
    assert sorted(map(tuple, html.extract(df).collect()), key=str) == once and len(once) == len(pages)
    assert all(t == f"Body {(i - 70) // 7}" for i, _, t, *_ in once if i >= 70) and not any("friend" in t for i, _, t, *_ in once if i < 56)
