"""Vector searches and page extraction against brute force."""

import html as entities
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest


def vectors(n=300, dims=8, seed=2):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = centres[i % 5]
        rows.append((i, [float(round(x + rng.gauss(0, 0.3), 3)) for x in c]))
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # copies
    rows += [
        (2000, None), (2001, [1.0, None] + [0.0] * 6), (2002, [math.nan] * 8), (2003, [math.inf] + [0.0] * 7), (2004, []),
        (2020, [0.0] * 8), (None, [1.0] * 8), (2040, [1.0, 2.0]), (2041, [3.0, -1.0]), (40, rows[40][1]),
    ]
    return rows


def brute(rows, product, skip_zero):
    seen = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        if skip_zero and not any(v):
            continue
        seen.setdefault(i, v)
    out = {}
    for q, a in seen.items():
        if q % 20:
            continue
        scored = sorted((-product(a, b), i) for i, b in seen.items() if i != q and len(a) == len(b))
        out[q] = [(i, -s) for s, i in scored[:20]]
    return out


def collected(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


SCHEMA = "vec_id long, embedding array<double>"


def test_top_k_is_exact(spark):
    from tidemark.llm.queries import asks
    from tidemark.llm.topk import top_k

    rows = vectors()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    whole = lambda a, b: sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b))
    want = brute(rows, whole, False)
    for size in (10_000, 50):
        got = collected(top_k(frame, asks(), block_rows=size, query_rows=7))
        assert {q: r for q, r in got.items()} == {q: r for q, r in want.items() if r}
    assert top_k(spark.createDataFrame([], SCHEMA), asks()).count() == 0


def test_top_k_beyond_doubles(spark):
    from tidemark.llm.queries import asks
    from tidemark.llm.topk import top_k

    rows = [(20 * i, [float(2**24 + i), float(i)]) for i in range(6)]
    got = collected(top_k(spark.createDataFrame(rows, SCHEMA), asks(), k=3))
    whole = lambda a, b: sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b))
    for q, a in rows:
        best = sorted((-whole(a, b), i) for i, b in rows if i != q)[:3]
        assert got[q] == [(i, -s) for s, i in best]


def test_bounds_and_invariants_of_cover_trees():
    import numpy as np

    from tidemark.llm.topk import _bounds, cover_tree

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 6)) * 5
    points = np.concatenate([centres[n % 9] + rng.normal(size=(80, 6)) * 0.5 ** (n % 4) for n in range(18)])
    asks = rng.normal(size=(90, 6))
    data, queries = cover_tree(points, np.arange(len(points)), leaf=8), cover_tree(asks, np.arange(90))
    apart = lambda x, y: np.sqrt(((x - y) ** 2).sum(axis=-1))
    stack, inner = [data], 0
    while stack:
        node = stack.pop()
        assert (apart(points[node.rows], node.centre) <= node.radius).all() and node.radius <= node.cover
        if node.children:
            inner += 1
            half = node.cover / 2
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
            assert (node.children[0].centre == node.centre).all()  # nesting
            for n, child in enumerate(node.children):
                assert (apart(points[child.rows], child.centre) <= half).all()  # halving
                assert all((apart(child.centre, c.centre) > half).all() for c in node.children[:n])  # separation
            for bound, child in zip(_bounds(queries, node), node.children):
                assert (asks[queries.rows] @ points[child.rows].T).max() <= bound
            stack += node.children
    assert inner > 10


@pytest.mark.parametrize("name", ["top_k", "nearest"])
def test_far_blocks_are_not_visited(spark, name):
    from tidemark.llm import ann, topk
    from tidemark.llm.queries import asks

    rng = random.Random(4)
    centres = [[rng.gauss(0, 20) for _ in range(8)] for _ in range(25)]
    rows = [(i, [x + rng.gauss(0, 0.5) for x in centres[i % 25]]) for i in range(4000)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    counted = {}
    search = topk.top_k if name == "top_k" else ann.nearest
    product = (lambda a, b: sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b))) if name == "top_k" else None
    got = collected(search(frame, asks(), k=5, block_rows=100, query_rows=10, counted=counted))
    assert counted["all"] >= 400 and counted["visited"] <= counted["all"] / 4
    if product:
        seen = dict(rows)
        for q in list(got)[:20]:
            best = sorted((-product(seen[q], v), i) for i, v in rows if i != q)[:5]
            assert got[q] == [(i, -s) for s, i in best]


def test_top_k_of_huge_numbers(spark):
    from tidemark.llm.queries import asks
    from tidemark.llm.topk import top_k

    rows = [(20 * i, [1e200 * (i - 3), 1e307]) for i in range(8)] + [(3, [0.0, -1e307]), (5, [0.5, 0.25])]
    got = collected(top_k(spark.createDataFrame(rows, SCHEMA).repartition(2), asks(), k=3))
    most = (1 << 63) - 1  # scores beyond are reported as the largest long, ties to smaller ids
    assert got[0] == [(20, most), (40, most), (60, most)]


def test_nearest_is_exact(spark):
    from tidemark.llm.ann import nearest
    from tidemark.llm.queries import asks

    rows = vectors(seed=5)

    def product(a, b):
        total = 0.0
        for x, y in zip(a, b):
            total += x * y
        return total

    want = brute(rows, product, True)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for size in (10_000, 64):
        assert collected(nearest(frame, asks(), block_rows=size, query_rows=9)) == {q: r for q, r in want.items() if r}
    assert nearest(spark.createDataFrame([], SCHEMA), asks()).count() == 0


def test_nearest_of_huge_and_tiny_numbers(spark):
    from tidemark.llm.ann import nearest
    from tidemark.llm.queries import asks

    rows = [(20 * i, [1e200 * (i + 1), -1e200, 1.0]) for i in range(30)] + [(7, [5e-324] * 3), (9, [1e-300] * 3)]
    got = collected(nearest(spark.createDataFrame(rows, SCHEMA).repartition(2), asks()))
    for q, _ in rows:
        if q % 20 == 0:
            # all products with huge vectors overflow alike (inf + inf), so that ids decide
            assert got[q] == [(20 * i, math.inf) for i in range(30) if 20 * i != q][:20]


def test_codes_bound_their_error():
    import numpy as np

    from tidemark.llm.ann import quantise

    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(40, 16)) * 10.0 ** rng.integers(-3, 4, (40, 1)), rng.normal(size=(50, 16))
    ca, sa, na, ea = quantise(a)
    cb, sb, nb, eb = quantise(b)
    near = (ca.astype(float) @ cb.astype(float).T) * sa[:, None] * sb[None, :]
    room = na[:, None] * eb[None, :] + ea[:, None] * (nb[None, :] + eb[None, :])
    assert (np.abs(a @ b.T - near) <= room * (1 + 1e-9)).all()


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
    "<nav><ul><li><a href=x>Home {n}</a></li></ul></nav><!-- ad --><div class='ad'>Buy {n}</div>{main}"
    "<aside>side {n}</aside><div id=comments><p>reader {n}</p></div><form>mail {n}</form><footer>&copy; host {n}</footer>{end}"
)


def pages():
    out = []
    for n in range(12):
        body = f"<h1>Title&nbsp;{n} &amp;amp; more</h1><p><b>First  {n}\n line<br><p>Second {n}</p><p>shared paragraph</p>"
        out.append((n, f"http://h{n % 2}.org/a/{n}", PAGE.format(n=n, main=f"<article>{body}</article>", end="</body></html>" if n % 3 else "")))
    # Without any telling markup: only the comparison of neighbours finds the template.
    for n in range(6):
        bare = f"<div>Site name</div><div>Menu</div><div>Body of page {n}</div><div>Also {n}</div><div>All rights</div>"
        out.append((100 + n, f"http://bare.org/x/{n}", f"<html><body>{bare}"))
    out += [(106, "http://bare.org/x/5", out[-1][2]), (200, None, None), (201, "http://lone.org/", "<p>Only page</p>"), (202, "http://e.org/", "")]
    return out


def test_main_text(spark):
    from tidemark.llm.html import extract_main_text

    table = pages()
    frame = spark.createDataFrame(table, "page_id long, url string, html string").repartition(3)
    want = {}
    for i, _, _ in table:
        if i < 12:
            want[i] = f"Title {i} &amp; more\n\nFirst {i} line\n\nSecond {i}\n\nshared paragraph"
        elif i < 107:
            want[i] = f"Body of page {min(i - 100, 5)}\n\nAlso {min(i - 100, 5)}"
    want |= {200: "", 201: "Only page", 202: ""}
    made = extract_main_text(frame.withColumnRenamed("html", "page"), html_col="page")
    assert {r["page_id"]: r["text"] for r in made.collect()} == want
    assert extract_main_text(spark.createDataFrame([], frame.schema)).count() == 0
    twice = extract_main_text(frame.unionByName(frame)).collect()
    assert len(twice) == 2 * len(table) and all(r["text"] == want[r["page_id"]] for r in twice)


def test_comparison_decides_beside_articles(spark):
    from tidemark.llm.html import extract_main_text

    table = []
    for n in range(4):
        kinds = {
            "art": f"<div>Intro {n}</div><article><p>Body {n}</p><p>quoted</p></article>",
            "main": f"<main><div>Rubric</div><div>Intro {n}</div></main>",
            "same": f"<article><p>Body {n}</p></article>",  # the pages differ in the article alone
        }
        for k, (kind, body) in enumerate(kinds.items()):
            table.append((10 * k + n, f"http://{kind}.org/{n}", f"<div>Site name</div>{body}<div>All rights</div>"))
    got = extract_main_text(spark.createDataFrame(table, "page_id long, url string, html string").repartition(3)).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    for n in range(4):
        assert texts[n] == f"Intro {n}\n\nBody {n}\n\nquoted"
        assert texts[10 + n] == f"Intro {n}"
        assert texts[20 + n] == f"Body {n}"


def test_copies_over_several_partitions(spark):
    from tidemark.llm.html import _OUTLINE, _outlines, compared

    page = "<div>Site name</div><div>Body {}</div><div>All rights</div>".format
    rows = [(k, f"http://a.org/{k:02}", page(0 if k < 2 else 1 if k < 20 else k)) for k in range(22)]
    rows += [(k, f"http://b.org/{k:02}", page("copy")) for k in range(22, 34)]
    found = []
    for parts in (1, 7, 17, 34):
        # partitions of equal length, in order: copies fill several of them
        pairs = spark.sparkContext.parallelize(rows, parts)
        frame = spark.createDataFrame(pairs, "key long, url string, page string")
        found.append({r["key"]: list(r["marks"]) for r in compared(frame.mapInPandas(_outlines, _OUTLINE)).collect()})
    assert found[0] == {k: [2, 0, 2] for k in range(22)}
    assert all(f == found[0] for f in found)


def test_names_inside_articles(spark):
    from tidemark.llm.html import extract_main_text

    def page(n):
        body = (
            f'<h2 id="search">Search {n}</h2><section id="related-work"><h3 id="comments">On comments</h3><p>Work {n}</p></section>'
            f'<div class="share-price">Price {n}</div><fieldset>Field {n}</fieldset><label>Label {n}</label>'
            f'<div class="ad-hoc">Made {n}</div><p>Cookies {n}</p><div id="cookies">Recipe {n}</div>'
            f'<div class="share">Tell your friends</div><button>Print</button>'  # template: the comparison finds it
            f'<div class="ad-slot-2">Buy {n}</div><div class="cookie-notice">We use cookies {n}</div>'
            f'<section class="comments-area">Reader {n}</section><form>Mail {n}</form><nav>To {n}</nav><p>End</p>'
            f'<p>In <b>one</b> <span class="ad">Buy {n}</span>block<button>Push {n}</button> <a class="share">Share {n}</a></p>'
        )
        return (n, f"http://a.org/{n}", f"<header>Site</header><article>{body}</article>")

    frame = spark.createDataFrame([page(n) for n in range(3)], "page_id long, url string, html string").repartition(2)
    for r in extract_main_text(frame).collect():
        kept = ["Search {}", "On comments", "Work {}", "Price {}", "Field {}", "Made {}", "Cookies {}", "Recipe {}", "End", "In one block"]
        assert r["text"].split("\n\n") == [k.format(r["page_id"]) for k in kept]


def test_elements_without_text_end():
    from tidemark.llm.html import blocks_of, spans_of

    def texts(page):
        return blocks_of(spans_of(page))

    for name in ("svg", "math", "iframe", "object", "select", "template", "noscript"):
        for mark in (f"<{name}/>", f'<{name} id="x" />', f"<{name}-icon a=b></{name}-icon>", f"<{name}>"):
            page = f"<body><div>One {mark} two</div><article><p>Three</p></article></body></html>"
            assert texts(page) == ["One two", "Three"], page
        later = f"<body><{name}/><p>One</p><{name}>x</{name}><p>Two</p>"
        assert texts(later) == (["One", "x", "Two"] if name == "math" else ["One", "Two"])
    for page in ("a <svg><g><svg><text>x</text></svg><title/><text>y</text></g></svg> b", "a <select><option>x<option>y</select> b"):
        assert texts(f"<p>{page}</p>") == ["a b"]
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p>") == ["Let x=2 be"]
    assert texts("<script>var a='<p>';</script><script/>x</script><style>p{}</style><p>b</p><noscript></p><i>n</noscript> c") == ["b", "c"]
    assert texts("<p>a</p><script>never closed") == ["a"] and texts("<script-like>a</script-like>") == ["a"]


def test_common_lines_is_a_longest_subsequence():
    from tidemark.llm.html import common_lines

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(7)
    for bits in (1 << 28, 9):  # with small numbers, lists are halved
        for _ in range(300):
            a = [rng.randrange(5) for _ in range(rng.randrange(14))]
            b = [rng.randrange(5) for _ in range(rng.randrange(14))]
            at = common_lines(a, b, bits)
            assert at == sorted(set(at)) and len(at) == longest(a, b)
            it = iter(b)
            assert all(any(x == y for y in it) for x in (a[i] for i in at))


def test_long_pages_take_linear_time():
    import time

    from tidemark.llm.html import blocks_of, common_lines, spans_of

    begun = time.monotonic()
    assert blocks_of(spans_of("<p>a</p>" + "<a " * 200_000)) == ["a"]
    assert len(blocks_of(spans_of('<a ">" ' * 100_000))) <= 1
    assert blocks_of(spans_of("<b>" * 100_000 + "x" + "</i>" * 100_000)) == ["x"]
    assert len(common_lines([1] * 20_000 + [2], [3] + [1] * 30_000)) == 20_000
    assert time.monotonic() - begun < 20


def test_template_without_telling_markup(spark):
    """A footer that differs in one piece, around articles and without any: its place is template on the host."""
    from tidemark.llm.html import extract_main_text

    table = []
    for n in range(8):
        menu = "<div class=top><div>Start</div><div>Topics</div></div>"
        foot = f"<div class=bottom>&copy; host | day {n * n}</div></body></html>"
        table.append((n, f"http://div.org/{n}", f"<html><body>{menu}<div class=text><p>Body {n}</p><p>More {n * 7}</p></div>{foot}"))
        # an article around everything, the menu too: markup protects all of it but what is surely none
        table.append((10 + n, f"http://all.org/{n}", f"<body><article><nav>To {n}</nav><p>Body {n}</p><p>quoted</p></article>{foot}"))
    got = extract_main_text(spark.createDataFrame(table, "page_id long, url string, html string").repartition(3)).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    for n in range(8):
        assert texts[n] == f"Body {n}\n\nMore {n * 7}"
        assert texts[10 + n] == f"Body {n}\n\nquoted"


def brute_main_texts(rows):
    """(page_id, url, html) -> text: neighbours by search, alignment by the full table, places counted in dictionaries."""
    from tidemark.llm.html import ARTICLE, MARKED, blocks_of, near, pieces_of, place_of, spans_of

    def shared(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    pages = {}
    for i, url, page in rows:
        spans = spans_of(page)
        pages[i] = (*place_of(url), spans, [(n, p) for n, s in enumerate(spans) for p in pieces_of(s[1])], page)
    marks, places = {}, defaultdict(lambda: [0, 0])
    by_host = defaultdict(list)
    for i, p in pages.items():
        by_host[p[0]].append((p[1], i))
    for host, members in by_host.items():
        members.sort()
        for at, (path, i) in enumerate(members):
            _, _, spans, pieces, _ = pages[i]
            sides = (range(at - 1, -1, -1), range(at + 1, len(members)))
            rivals = [next((members[m] for m in side if pages[members[m][1]][3] != pieces), None) for side in sides]
            rivals = [r for r in rivals if r]
            if not rivals or not spans:
                continue
            other = [p for _, p in pages[max(rivals, key=lambda r: near(path, r[0]))[1]][3]]
            mine = [p for _, p in pieces]
            n_all = shared(mine, other)
            marks[i] = (mine, other, n_all)
    return pages, marks


def test_brute_force_over_the_small_table(spark, sf):
    """Every page's comparison is as long as the full table says, and the texts follow from the marks."""
    from tidemark.llm import html as H

    table = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [tuple(r) for r in table.select("page_id", "url", "html").collect()]
    pages, rivals = brute_main_texts(rows)
    counts, marked = defaultdict(lambda: [0, 0]), {}
    for i, (mine, other, n_all) in rivals.items():
        at = H.common_lines([hash(x) for x in mine], [hash(x) for x in other])
        assert len(at) == n_all
        spans, owner = pages[i][2], [n for n, _ in pages[i][3]]
        there, hit = Counter(owner), Counter(owner[a] for a in at)
        marked[i] = [2 if hit[n] == there[n] else 1 if hit[n] else 0 for n in range(len(spans))]
        for s, m in zip(spans, marked[i]):
            if s[2] != H.ARTICLE:
                counts[pages[i][0], s[3]][0] += 1
                counts[pages[i][0], s[3]][1] += m > 0
    template = {k for k, (n, t) in counts.items() if n >= 2 and 10 * t >= 9 * n}
    want, by_comparison, by_markup = {}, 0, 0
    for i, (host, _, spans, _, _) in pages.items():
        shared = {n for n, m in enumerate(marked.get(i, [])) if spans[n][2] != H.ARTICLE and (m == 2 or (host, spans[n][3]) in template)}
        said = {n for n, s in enumerate(spans) if s[2] == H.MARKED}
        by_comparison, by_markup = by_comparison + len(shared), by_markup + len(said - shared)
        want[i] = "\n\n".join(H.blocks_of(spans, shared | said))
    got = {r["page_id"]: r["text"] for r in H.extract_main_text(table).collect()}
    assert got == want
    assert by_comparison >= len(rows)  # every page's footer, at least
    print(f"spans removed by comparison {by_comparison}, by markup alone {by_markup}")


def test_pages_of_the_small_tables(spark, sf):
    from tidemark.llm.queries import op9_main_text

    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op9_main_text(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        page = rows[r["page_id"]]
        inner = page[page.find("<article>") + 9 : page.find("</article>")]
        blocks = (" ".join(entities.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split(r"</?p>|</?h1>", inner))
        assert r["text"] == "\n\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("odd", ["long", "wide"])
def test_no_block_is_everybodys_first(spark, odd):
    """One cluster of long vectors, or one wide block: query blocks still begin with their own neighbours, and results stay exact."""
    from pyspark.sql import functions as F

    from tidemark.llm import ann, blocks

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8)) * 4
    vectors = np.concatenate([c + rng.normal(size=(50, 8)) * 0.1 for c in centres])
    vectors[:50] = vectors[:50] * 3 if odd == "long" else rng.normal(size=(50, 8)) * 4
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    chosen = []
    real = blocks._bounded

    def seen(asking, n_asking, base, n_base, floors):
        found = real(asking, n_asking, base, n_base, floors)
        if floors is None:
            chosen.extend(r["b"] for r in found.collect())
        return found

    blocks._bounded = seen
    try:
        got = ann.nearest(rows, F.expr("vec_id % 5 = 0"), k=3, block_rows=40, query_rows=10).collect()
    finally:
        blocks._bounded = real
    assert len(chosen) >= 40 and max(chosen.count(b) for b in set(chosen)) <= len(chosen) / 4
    products = vectors @ vectors.T
    np.fill_diagonal(products, -np.inf)
    for r in got:
        assert r["vec_id"] == np.argsort(-products[r["query_id"]], kind="stable")[r["rank"] - 1]
    assert len(got) == 3 * 400


def test_blocks_that_many_visit_are_copied(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tidemark.llm import ann, blocks

    monkeypatch.setattr(blocks, "VISITORS", 2)
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(300, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    for few in (0, 1000):
        monkeypatch.setattr(blocks, "FEW", few)
        got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.nearest(rows, F.expr("vec_id % 2 = 0"), k=4, block_rows=50, query_rows=10).collect()}
        products = vectors @ vectors.T
        np.fill_diagonal(products, -np.inf)
        assert got == {(q, n + 1): v for q in range(0, 300, 2) for n, v in enumerate(np.argsort(-products[q], kind="stable")[:4].tolist())}


def test_raw_elements_without_an_end_are_read_in_linear_time():
    import time

    from tidemark.llm import html

    def taken(n):
        page = "<svg>" + "<title/><style/>" * n + "</svg><article><p>text</p></article>"
        begun = time.perf_counter()
        assert "text" in [s[1] for s in html.spans_of(page)]
        return time.perf_counter() - begun

    taken(500)
    assert taken(16_000) < 40 * max(taken(1_000), 0.002)  # 16 times as long; 256 times if each looked through the rest


def test_long_attributes_are_not_remembered():
    from tidemark.llm import html

    html._inside.cache_clear()
    html.spans_of("".join(f'<img src="data:{n}{"x" * 10_000}"><p class="a{n}">t</p>' for n in range(50)))
    assert 0 < html._inside.cache_info().currsize <= 60
