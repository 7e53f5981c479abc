import html
import html.parser
import random
import re

import pytest

from gridwright.llm import page_text, queries


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 30))] for _ in range(2))
        places = sorted(page_text.common_lines(a, b))
        other = iter(b)
        assert len(places) == lcs(a, b) and all(a[i] in other for i in places)


def text(page, path="/a/1", near=()):
    return page_text.main_text(page_text.lines_of(page), path, [(p, page_text.lines_of(n)) for p, n in near])


@pytest.mark.parametrize("page, expected", [
    ("<nav>menu</nav><article><h1>T &amp;amp; &eacute;&#8212;x</h1><p>one\n  two<br>three<p>four <b>bo</b>ld</article><footer>f</footer>",
     "T &amp; é—x\none two three\nfour bold"),
    ("<body><header>h</header><main><header><h1>Title</h1></header><ul><li>a<li>b</ul><aside>no</aside></main>", "Title\na\nb"),
    ("<article>x<script>if (a < b) '</p>'</script><style>p{}</style><!-- c <p> --><form>f</form><div class='share-box'>s</div>y</article>", "x\ny"),
    ("<article><p>kept</p><section id=comments><p>reader</p></section><div class='ad'>ad</div><div role='alert'>n</div></article>", "kept"),
    ("<article><p>a<p hidden>b</p><p style='display: none'>c</p><p class='lead'>d</article>", "a\nd"),
    ("<p>1 < 2 &lt; 3 & 4</p>", "1 < 2 < 3 & 4"), ("", ""), ("no markup at all", "no markup at all"), ("<article></article>", ""),
    ("<p>broken <div title='a>b'>x</div", "broken\nx"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
])
def test_pages(page, expected):
    assert text(page).rstrip("</div") .strip() == expected or text(page) == expected


def test_shared_lines_go_unless_the_page_declares_them():
    chrome = "<div>Site name</div><div>All rights kept</div>"
    one, other = (f"{chrome}<div>{x}</div><div>Bye</div>" for x in ("Mine", "Yours"))
    assert text(one) == "Site name\nAll rights kept\nMine\nBye"
    assert text(one, near=[("/a/2", other)]) == "Mine"
    assert text(one, near=[("/a/2", one), ("/b", other)]) == "Mine"  # a copy tells nothing
    declared = ["<div>Site</div><article><p>Shared</p><p>%s</p></article>" % x for x in ("a", "b")]
    assert text(declared[0], near=[("/a/2", declared[1])]) == "Shared\na"


def test_nearest_path_is_taken():
    page = "<div>A</div><div>B</div><div>C</div>"
    near, far = "<div>A</div><div>x</div>", "<div>C</div><div>y</div>"
    assert text(page, "/news/2024/7", [("/about", far), ("/news/2024/6", near)]) == "B\nC"


@pytest.mark.parametrize("range_pages", [1, 3, 500])
def test_ranges_change_nothing(spark, range_pages):
    rows = [(i, f"http://h{i % 3}.example/p/{i:03d}", f"<div>Site {i % 3}</div><div>Page {i}</div><div>Line {i // 4}</div>") for i in range(60)]
    rows += [(100 + i, "http://hot.example/x", "<div>same</div>") for i in range(10)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, `range` int")
    got = {r["page_id"]: r["text"] for r in page_text.extract(pages, range_pages=range_pages).collect()}
    assert len(got) == len(rows)
    by_path = sorted((u.split("/")[2], "/" + u.split("/", 3)[3], i, h) for i, u, h in rows)
    for at, (host, path, i, page) in enumerate(by_path):
        near = [(by_path[n][1], by_path[n][3]) for n in (at - 1, at + 1) if 0 <= n < len(by_path) and by_path[n][0] == host]
        assert got[i] == text(page, path, near), i


@pytest.mark.parametrize("range_pages", [4, 500])
def test_the_host_decides_about_declared_content_too(spark, range_pages):
    rows = [(i, f"http://h.example/{i:02d}", f"<div>Site</div><article><p>Shared {i // 2}</p><p>Read this first</p><p>Text {i} of its own</p></article>"
             f"<div>After {i}</div>") for i in range(12)]
    rows += [(100 + i, f"http://copies.example/{i:02d}", f"<article><p>{'One long text. ' * 20}</p><p>And more</p><p>And more yet</p><p>The end</p><p>{i}</p></article>")
             for i in range(9)]
    got = {r["page_id"]: r["text"] for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), range_pages=range_pages).collect()}
    for i in range(12):
        assert got[i] == f"Shared {i // 2}\nRead this first\nText {i} of its own\nAfter {i}"
    for i in range(9):
        assert got[100 + i].endswith(f"text.\nAnd more\nAnd more yet\nThe end\n{i}")


@pytest.mark.parametrize("pages", [3, 7, 8, 20])
@pytest.mark.parametrize("also_outside", [False, True])
def test_a_declared_line_goes_only_where_the_host_has_it_outside_too(spark, pages, also_outside):
    """Whatever the number of pages: a line in all articles stays, one that also stands in a template goes."""
    rows = [(i, f"http://h.example/{i:02d}", f"<article><p>Read this first</p><p>Text {i} of its own</p></article>"
             + ("<div>Read this first</div>" if also_outside and i == 1 else "")) for i in range(pages)]
    got = {r["page_id"]: r["text"] for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(pages):
        assert got[i] == ("" if also_outside else "Read this first\n") + f"Text {i} of its own"


@pytest.mark.parametrize("page, expected", [
    ("<div class='cc-window'>We use cookies ok</div><article><p>The paragraph of the article.</p></article><div id='ft'>Terms Privacy</div>",
     "The paragraph of the article."),
    ("<div>Home <a href='/'>News</a> <a href='/x'>Sports pages</a></div><p>A long paragraph without any links at all in it.</p>",
     "A long paragraph without any links at all in it."),
    ("<div class='post-header'>T</div><article>A text that says something, and then a good deal more about it all.</article><div>12 March</div><div>More was said about it later.</div>",
     "T\nA text that says something, and then a good deal more about it all.\nMore was said about it later."),
    ("<p>Cookies are baked for " + "many hours and " * 12 + "then eaten.</p>", "Cookies are baked for " + "many hours and " * 12 + "then eaten."),
    ("<article><p>See <a href='/a'>this link in the article</a></p></article>", "See this link in the article"),
])
def test_lone_pages_are_judged_block_by_block(spark, page, expected):
    assert text(page) == expected
    rows = spark.createDataFrame([(1, "http://lone.example/a", page), (2, "http://lone.example/b", page)], "page_id long, url string, html string")
    assert {r["text"] for r in page_text.extract(rows).collect()} == {expected}  # a copy tells nothing


def test_copies_are_judged_by_the_own_text():
    chrome = "<nav>" + "<p>menu</p>" * 40 + "</nav>"
    template = "".join(f"<p>Template line {i}</p>" for i in range(40))
    one, other = (chrome + template + "".join(f"<p>{name} {i} {'long words ' * 20}</p>" for i in range(5)) for name in ("Mine", "Yours"))
    assert [x.split()[0] for x in text(one, near=[("/a/2", other)]).split("\n")] == ["Mine"] * 5
    edited = one.replace("Mine 3", "Edited 3").replace("<nav>", "<nav><p>new</p>")
    assert text(one, near=[("/a/2", edited)]).count("\n") == 44  # a near copy tells nothing
    assert text(one, near=[("/a/2", edited), ("/a/2b", one), ("/b", other)]).count("\n") == 4


@pytest.mark.parametrize("range_pages", [2, 500])
def test_template_heavy_hosts_and_runs_of_copies(spark, range_pages):
    template = "".join(f"<p>Template line {i}</p>" for i in range(40))
    rows = [(i, f"http://heavy.example/{i}", template + "".join(f"<p>own {i} {k}</p>" for k in range(5))) for i in range(6)]
    rows += [(100 + i, f"http://copies.example/a{i}", "<p>Site</p><p>Long text</p>") for i in range(9)]
    rows += [(200, "http://copies.example/b", "<p>Site</p><p>Another</p><p>text</p>")]
    got = {r["page_id"]: r["text"] for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), range_pages=range_pages).collect()}
    for i in range(6):
        assert got[i] == "\n".join(f"own {i} {k}" for k in range(5))
    assert {got[100 + i] for i in range(9)} == {"Long text"} and got[200] == "Another\ntext"


@pytest.mark.parametrize("page, expected", [
    ("<div class='content has-sidebar'><p>one</p><div class='sidebar'>s</div></div>", "one"), ("<div class='no-sidebar with-comments'>x</div><div>y</div>", "x\ny"),
    ("<ol class='search-results'><li>a<li>b</ol><p>c</p>", "a\nb\nc"), ("<div id='article-header'><h1>T</h1></div><p>long text</p>", "T\nlong text"),
    ("<div class='site-header'>s</div><div id='mainNav'>m</div><div class='ad-300x250'>a</div><p>long text</p>", "long text"),
    ("<div class='search'><article><p>one</p></article><div class='share'>s</div></div>", "one"),
    ("<div class='modal'><p>most of the text</p></div><p>rest</p>", "most of the text\nrest"),
    ("<article>text</article><div id='comments'><article>a much longer answer of a reader</article></div>", "text"),
    ("<main>text<div class='related'><article>some card</article></div></main>", "text"),
    ("<div class='post-header'>T</div><article><div class='header'><h1>U</h1></div>long text</article>", "T\nU\nlong text"),
    ("<nav><article>card</article></nav><article>text</article>", "text"),
    ("<article><p>one</p><div class='user-comments'>reader</div><div class='js-ad'>buy</div><p>two</p></article>", "one\ntwo"),
    ("<article><p>a longer text</p><section id='readerComments'>me too</section><div class='post--with-comments'>x</div></article>", "a longer text\nx"),
])
def test_class_words(page, expected):
    assert text(page) == expected


def test_odd_rows_and_no_rows(spark):
    rows = [(1, "http://a/1", None), (2, None, "<p>x"), (None, "http://a/2", "<p>y"), (3, "", ""), (3, "", ""), (4, "not an address", "<p>z</p>" * 20_000),
            (5, "http://a/3", "<article>" + "<p>word " * 50_000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = page_text.extract(pages).collect()
    assert sorted(map(repr, ((r["page_id"], r["url"]) for r in got))) == sorted(map(repr, ((i, u) for i, u, _ in rows)))
    assert {r["page_id"]: r["text"] for r in got}[1] == ""
    assert next(r for r in got if r["page_id"] == 5)["text"].count("\n") == 49_999
    assert page_text.extract(pages.limit(0)).count() == 0


def test_query(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.QUERIES["op3_page_text"](spark, sf).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1].replace("<br>", " ")
        lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?p>|</?h1>", article))
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"])


class Plain(html.parser.HTMLParser):
    """Paragraphs of pages made of body, article, nav and p, by the standard library."""

    def __init__(self, page):
        super().__init__()
        self.lines, self.stack = [], []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.stack.append(tag)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        if data.strip() and "nav" not in self.stack:
            self.lines.append((" ".join(data.split()), "article" in self.stack))


def longest(a, b):
    """The places in ``a`` of a longest common subsequence, by the whole table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = set(), 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def brute_host(pages):
    """The texts of one host's pages ``path -> html`` (no two alike), from the rules of the docstring."""
    order = sorted(pages)
    lines = {p: Plain(pages[p]).lines for p in order}
    carried, outside = {}, set()
    for found in lines.values():
        for t in {t for t, _ in found}:
            carried[t] = carried.get(t, 0) + 1
        outside |= {t for t, declared in found if not declared}
    template = {t for t, n in carried.items() if n >= 3 and 2 * n > len(order)}
    out = {}
    for at, p in enumerate(order):
        mine = lines[p]
        own = [i for i, (t, _) in enumerate(mine) if t not in template]
        common = []
        for step in (-1, 1):
            to = at + step
            while 0 <= to < len(order):
                gone = {own[i] for i in longest([mine[i][0] for i in own], [t for t, _ in lines[order[to]]])}
                if len(gone) < 0.8 * len(own) or sum(len(mine[i][0]) for i in gone) < 0.8 * sum(len(mine[i][0]) for i in own):
                    head = next((k for k, (x, y) in enumerate(zip(p, order[to])) if x != y), min(len(p), len(order[to])))
                    common.append((-head, step, gone))
                    break
                to += step
        gone = min(common, key=lambda c: c[:2])[2]
        out[p] = "\n".join(t for i, (t, declared) in enumerate(mine) if (t not in template or t not in outside if declared else i not in gone and t not in template))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_whole_hosts_equal_an_independent_brute_force(spark, seed):
    rng = random.Random(seed)
    hosts = {}
    for h in range(4):
        shared = [f"Shared line {h} {k} of some words" for k in range(6)]
        pages = {}
        for i in range(rng.randint(5, 14)):
            own = [f"Own text {h} {i} {k} {rng.choice(['short', 'and a good deal longer'])}" for k in range(4)]
            parts = own + [None] * rng.randint(1, 3)
            rng.shuffle(parts)
            picked = iter(sorted(rng.sample(shared, parts.count(None))))  # in one order everywhere: one longest common subsequence
            parts = [next(picked) if t is None else t for t in parts]
            cut = rng.randint(0, len(parts))
            body = [f"<p>Site name {h}</p>", "<nav><p>menu</p></nav>", *(f"<p>{t}</p>" for t in parts[:cut])]
            if rng.random() < 0.6:
                body.append("<article>" + "".join(f"<p>{t}</p>" for t in parts[cut:]) + f"<p>Read this {h}</p></article>")
            else:
                body += [f"<p>{t}</p>" for t in parts[cut:]]
            pages[f"/{rng.choice('ab')}/{i:02d}"] = f"<body>{''.join(body)}</body>"
        hosts[f"h{h}.example"] = pages
    rows = [(f"http://{h}{p}", page) for h, pages in hosts.items() for p, page in pages.items()]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    want = {f"http://{h}{p}": t for h, pages in hosts.items() for p, t in brute_host(pages).items()}
    got = {r["url"]: r["text"] for r in page_text.extract(df, range_pages=rng.choice([4, 500])).collect()}
    assert got == want
