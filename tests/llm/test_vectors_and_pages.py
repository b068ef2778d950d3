"""Nearest neighbours against brute force; page text against hand-made pages."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import ann, pages
from tests.conftest import SF_CHECK

VECTORS = "vec_id bigint, embedding array<float>, label string"


def vectors(n, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    return [(i, [float(c) for c in v], "x") for i, v in enumerate(x)]


def brute(data, k, wanted):
    good = [
        (i, np.array(v, dtype=np.float64)) for i, v, _ in data
        if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)
    ]
    out = {}
    for q, x in good:
        if wanted(q):
            others = [(-float(x @ y), i) for i, y in good if i != q and len(y) == len(x)]
            out[q] = [i for _, i in sorted(others)[:k]]
    return out


@pytest.fixture(scope="module")
def found(spark):
    data = vectors(400)
    data[3] = (3, [10.0] * 8, "x")
    data += [(1000 + i, data[3][1], "copy") for i in range(60)]  # a vector that many hold
    data += [(2000, None, ""), (2001, [0.0] * 8, ""), (2020, [1.0, None] * 4, ""), (2040, [float("nan")] * 8, ""),
             (2060, [float("inf")] + [1.0] * 7, ""), (None, data[0][1], ""), (2080, [1.0, 2.0], ""),
             (2081, [3.0, 4.0], ""), (2100, [], "")]
    df = spark.createDataFrame(data, VECTORS).withColumns({n: F.lit(1) for n in ("node", "v", "shard", "dim")})
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, 5).collect()
    return data, got


def test_nearest_equal_brute_force(found):
    data, got = found
    want = brute(data, 5, lambda i: i % 20 == 0)
    lists = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        lists.setdefault(r.query_id, []).append(r)
    assert set(lists) == {q for q, w in want.items() if w}
    x = {i: np.array(v, dtype=np.float64) for i, v, _ in data if i is not None and v and None not in v}
    hits = 0
    for q, rs in lists.items():
        assert [r.rank for r in rs] == list(range(1, len(want[q]) + 1))
        assert all(math.isclose(r.score, float(x[q] @ x[r.vec_id]), rel_tol=1e-12) for r in rs)
        order = [(-r.score, r.vec_id) for r in rs]
        assert order == sorted(order)
        hits += len({r.vec_id for r in rs} & set(want[q]))
    assert hits >= 0.98 * sum(map(len, want.values()))
    assert lists[2080][0].vec_id == 2081 and len(lists[2080]) == 1


def test_copies_come_by_smallest_id(found):
    _, got = found
    own = sorted((r.rank, r.vec_id) for r in got if r.query_id == 1000)
    assert [i for _, i in own] == [3, 1001, 1002, 1003, 1004]


def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet")
    data = [(r.vec_id, r.embedding, None) for r in rows.collect()]
    got = ann.nearest(rows, F.col("vec_id") % 20 == 0, 20).collect()
    want = brute(data, 20, lambda i: i % 20 == 0)
    hits = sum(r.vec_id in want[r.query_id] for r in got)
    assert len(got) == 20 * len(want) and hits >= 0.9 * len(got)


def test_nearest_in_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert ann.nearest(none, F.col("vec_id") % 20 == 0, 5).count() == 0
    one = spark.createDataFrame(vectors(1), VECTORS)
    assert ann.nearest(one, F.col("vec_id") % 20 == 0, 5).count() == 0


def test_graph_survives_its_flat_arrays():
    import pandas as pd

    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=(500, 6)), np.zeros(500)])
    ids = np.arange(500) * 3
    g = ann.Graph.build(x, ann.levels(ids))
    flat = np.concatenate([k[g.level >= i].ravel() for i, k in enumerate(g.links)]).astype(np.int32)
    row = pd.Series({
        "nodes": ids.astype(np.int64).tobytes(), "vectors": g.x.tobytes(), "entry": g.entry,
        "levels": g.level.astype(np.int8).tobytes(), "neighbours": flat.tobytes(),
    })
    again, nodes = ann.load(row)
    assert (nodes == ids).all() and all((a == b).all() for a, b in zip(g.links, again.links, strict=True))


PAGE = "page_id bigint, url string, html string, text string"


def template(body, i):
    return (
        f"<html><head><title>t{i}</title><style>p{{}}</style></head><body><div>Site name</div><p>Welcome, reader</p>"
        f"{body}<div>All rights kept</div><script>var a = '<p>no</p>';</script></body>"
    )


def texts(spark, data):
    df = spark.createDataFrame(data, PAGE).withColumns({n: F.lit(1) for n in ("path", "lines", "shared", "part")})
    return {r.page_id: r.text for r in pages.main_text(df).collect()}


def test_lines_that_near_pages_share_are_deleted(spark):
    data = [(i, f"http://h.example/a/{i}?x=1", template(f"<p>Story {i} first.</p><p>Then {i}.</p>", i), "x") for i in range(40)]
    data += [(100, "http://alone.example/", template("<p>Only one.</p>", 100), None)]
    got = texts(spark, data)
    assert all(got[i] == f"Story {i} first. Then {i}." for i in range(40))
    assert got[100] == "Site name Welcome, reader Only one. All rights kept"


def test_article_keeps_what_other_articles_quote(spark):
    body = "<nav>menu</nav><article><h1>Title</h1><p>A quote that all have.</p><p>Own {0} &amp; only&nbsp;one.</article><footer>f</footer>"
    got = texts(spark, [(i, f"http://h.example/{i}", f"<body>{body.format(i)}", None) for i in range(5)])
    assert all(got[i] == f"Title A quote that all have. Own {i} & only one." for i in range(5))


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("   ", ""), ("plain &lt;text&gt;", "plain <text>"),
        ("<article>a<br>b <b>c</b>d</article>", "a b cd"),
        ("<article><p>a<aside>side</aside><div class='ad'>buy</div><div id=comments>c</div><p>b", "a b"),
        ("<article><header><h1>T</h1></header><form><input>x</form><p>b</p></article>", "T b"),
        ("<main><p>m</p></main><p>out</p>", "m"), ("<div class='cookie-notice'>n</div><p>text</p>", "text"),
        ("<article>x<!-- no --><script>if (a < b) '</p>'</script>y</article>", "xy"),
        ("<article>1 < 2 &copy &#8364; &bogus;</article>", "1 < 2 © € &bogus;"), ("<nav>only menu", ""),
    ],
)
def test_markup(page, want):
    lines, _ = pages.text_lines(page or "")
    assert " ".join(lines) == want


def test_repeated_and_null_rows(spark):
    row = (1, "http://h.example/1", "<article>same</article>", None)
    data = [row, row, (2, None, "<p>x</p>", None), (None, None, None, None), (3, "", "<p>y</p>", None)]
    df = spark.createDataFrame(data, PAGE)
    got = sorted((r.page_id or 0, r.text) for r in pages.main_text(df).collect())
    assert got == [(0, ""), (1, "same"), (1, "same"), (2, "x"), (3, "y")]
    assert pages.main_text(spark.createDataFrame([], PAGE)).count() == 0


def test_copies_do_not_delete_each_other(spark):
    def page(i):
        return template(f"<p>Story {i} first.</p><p>Then {i}.</p>", i)

    data = [(i, f"http://h.example/a/{i}", page(i), None) for i in range(4)]
    data += [(10 + i, f"http://h.example/a/1?utm_source={i}", page(1), None) for i in range(5)]
    data += [(2, "http://h.example/a/2", page(2), None)] * 3
    data += [(20, "http://h.example/z/9", page(1), None), (30, "http://h.example/a/0", page(7), None)]
    df = spark.createDataFrame(data, PAGE)
    got = sorted((r.page_id, r.text) for r in pages.main_text(df).collect())
    story = {**{i: i for i in range(4)}, **{10 + i: 1 for i in range(5)}, 20: 1, 30: 7}
    assert got == sorted((r[0], f"Story {story[r[0]]} first. Then {story[r[0]]}.") for r in data)


def test_markup_checks_the_difference_of_all_pages(spark):
    body = (
        "<div>Site name</div><nav>menu {0}</nav><main><h1>Head {0}</h1><p>Story {0}.</p>"
        "<article>Card</article></main><p>Note {0}.</p><div>All rights kept</div>"
    )
    got = texts(spark, [(i, f"http://h.example/{i}", body.format(i), None) for i in range(5)])
    assert all(got[i] == f"Head {i} Story {i}. Card Note {i}." for i in range(5))


def test_common_lines_are_a_longest_common_subsequence():
    import random

    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = pages.common_lines(a, b)
        assert len(got) == best[-1][-1] and got == sorted(set(got))
        left = iter(b)
        assert all(a[i] in left for i in got)
