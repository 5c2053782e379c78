"""Periodic runs, page extraction and whitening against brute force, hand-made pages and a dense eigensolver."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from cloakline.llm import extraction, periodic, whitening
from llm_rows import SCHEMA, documents, empty

WORD = re.compile("[^\x20\x09-\x0d]+")


# ------------------------------------------------------------------ op11
def brute_runs(w):
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(24, 3 * q) and not any(w[i:i + size - p] == w[i + p:i + size] for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_periodic(i, text, edit):
    w = WORD.findall(text or "")
    n, h = len(w), 1 if i is None else zlib.crc32(str(i).encode())
    if edit and h % 10 == 0 and n:
        a, g = h // 10 % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
    runs = brute_runs(w)
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    told = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    left = " ".join(x for k, x in enumerate(w) if k not in gone)
    return (len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def repeating(seed):
    rng = random.Random(seed)
    w = []
    for _ in range(rng.randint(1, 5)):
        unit = [rng.choice("ab cd é ef gh".split()) for _ in range(rng.randint(1, 20))]
        w += [rng.choice("xyz") for _ in range(rng.randint(0, 12))] + (unit * 40)[:rng.randint(1, 6 * len(unit) + 30)]
    return "\n ".join(w)


@pytest.mark.parametrize("edit", [True, False])
def test_periodic_runs_match_brute_force(spark, edit):
    docs = documents(spark, extra=[repeating(s) for s in range(60)] + ["a " * 23, "a " * 24, "a b " * 12, "a b c d e f g h i " * 3])
    got = {r.doc_id: tuple(r)[2:9] for r in periodic.periodic_runs(docs, edit).collect()}
    want = {r.doc_id: brute_periodic(r.doc_id, r.text, edit) for r in docs.collect()}
    assert got == want and sum(v[0] for v in want.values()) > 40


def test_periodic_runs_edges(spark):
    rows = [(None, "a b " * 20), (1, None), (1, " \n"), (2, "a b " * 20), (2, "a b " * 20)]
    df = spark.createDataFrame([(i, t, *[None] * 9) for i, t in rows], SCHEMA)
    got = periodic.periodic_runs(df, edit=True).collect()
    assert sorted((r.n_words, r.n_runs) for r in got) == [(0, 0), (0, 0), (40, 1), (40, 1), (40, 1)]
    assert {r.collapsed for r in got if r.n_runs} == {"a b"}
    assert all(r.start is r.length is r.period is r.exponent_milli is None for r in got if not r.n_runs)
    assert periodic.periodic_runs(empty(spark)).count() == 0


def test_frequency_splitting_keeps_every_run_and_drops_rare_words():
    rng = np.random.default_rng(2)
    words = np.concatenate([rng.integers(0, 5000, 3000), np.tile(np.arange(6000, 6040), 4), rng.integers(0, 5000, 3000)])
    place, _ = periodic.survivors(words, np.zeros(len(words), int))
    assert set(range(3000, 3160)) <= set(place.tolist()) and len(place) < 400
    own, runs = periodic.runs_of(np.array([0, len(words)]), words)
    assert runs.tolist() == [[3000, 160, 40]]


def test_periodic_runs_of_one_very_long_text():
    words = np.tile(np.random.default_rng(1).integers(0, 30, 40_000), 4)[:150_000]
    assert periodic.runs_of(np.array([0, len(words)]), words)[1][-1].tolist() == [0, 150_000, 40_000]


# ------------------------------------------------------------------ op12
P = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore."
PAGES = {
    "article": (f"<body><nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p><b>{P}<br><p>Short.</article><footer>{P}</footer>", ["T & U", P, "Short."]),
    "no home": (f"<body><h1>Title</h1><p>{P}</p><p>x &lt; y &nbsp;\n z</p><p>{P}</p></body>", ["Title", P, "x < y z", P]),
    "by density": (f"<body><div><a href=1>One</a> <a href=2>Two</a></div><div><h2>T</h2><div><p>{P}</p><p>{P}</p><p>end</p></div></div>"
                   "<div><a href=x>Imprint</a> (c)</div></body>", ["T", P, P, "end"]),
    "sections": (f"<body><div><div><p>{P}</p><p>{P}</p></div><div><p>{P}</p></div></div><ul><li><a href=1>More</a></ul></body>", [P, P, P]),
    "all parts": (f'<body class="has-sidebar"><div class="cookie-notice">{P}</div><header><h1>Site</h1></header><main><article><header><h1>T</h1></header>'
                  f'<p>{P}</p><aside>{P}</aside><form>{P}</form><ul><li>a<li>b</ul></article><section id="comments"><article class="comment"><p>{P}{P}{P}</p>'
                  f'</article></section></main><div class="ad-container">{P}</div><script>"</p>{P}"</script></body>', ["T", P, "a", "b"]),
    "named": (f'<body><div class="menu">{P}</div><div class="post"><div class="article-header"><h1>T</h1></div><div><p>{P}</p><p>{P}</p></div><p>End.</p>'
              f'</div><div>{P} {P} {P}</div></body>', ["T", P, P, "End."]),
    "named within": (f'<body><div id="topnav"><a href=/>x</a> y</div><div class="post"><h1>T</h1><div class="post-body"><p>{P}</p><p>{P}</p><p>ok</p></div></div>'
                     f'<div class="usercomments"><p>{P} {P} {P} {P}</p></div><div id="sitefooter">{P}</div></body>', ["T", P, P, "ok"]),
    "text": ("just text &amp; more", ["just text & more"]),
    "cut in a tag": ('<body><article><p>abc</p><p class="x', ["abc"]),
    "cut in a comment": ("<p>abc<!-- def", ["abc"]),
    "layout table": (f"<body><table><tr><td><a href=1>One</a><tr><td>{P}<td>b<tr><td>z</table></body>", [P, "b"]),
    "only advert": ('<body><div class="ad">buy</div></body>', []),
    "deep": ("<div>" * 5000 + "x" + "</div>" * 5000, ["x"]),
    "empty": ("", []),
}


def test_extraction_of_handmade_pages(spark):
    rows = [(k, f"http://a/{name}", page, 1) for k, (name, (page, _)) in enumerate(PAGES.items())] + [(None, None, None, 2), (0, None, PAGES["article"][0], 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = extraction.extracted(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    got = got.collect()
    want = ["\n\n".join(w) for _, w in PAGES.values()]
    assert sorted((r.page_id, r.text) for r in got if r.page_id is not None) == sorted([*enumerate(want), (0, want[0])])
    assert [(r.url, r.text, r.n_chars) for r in got if r.page_id is None] == [(None, "", 0)]
    assert all(r.n_chars == len(r.text) for r in got)
    assert extraction.extracted(df.limit(0)).count() == 0


def test_extraction_equals_the_marked_articles(spark):
    import html
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for p in pages:
        article = re.search("<article>(.*)</article>", p.html, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        assert extraction.main_text(p.html) == "\n\n".join(b for b in blocks if b)


def test_extraction_time_grows_with_the_page():
    import time
    before = time.perf_counter()
    extraction.main_text("<i>" * 50_000 + "<div>x</div>" * 50_000)
    extraction.main_text("<p title='a\"" * 50_000)
    assert time.perf_counter() - before < 20


# ------------------------------------------------------------------ op13
def truth(rows, k=16):
    """Whole vectors of the usable rows, their exact sums, and the eigenpairs of a dense solver."""
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    whole = [(i, tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v)) for i, v in usable]
    u = np.array(sorted({x for _, x in whole}), dtype=object)
    n, s = len(u), u.sum(axis=0)
    c = (n * u - s).astype(float) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    return whole, n, s, e[::-1][:k], q[:, ::-1][:, :k], e.sum()


def assert_whitened(rows, got, k=16):
    whole, n, s, e, q, trace = truth(rows, k)
    m = int((e > 1e-12 * e[0]).sum())
    assert len(got) == len(whole) * m
    by = {(r.vec_id, r.component): r for r in got}
    values = np.array([[by[i, c + 1].whitened for c in range(m)] for i, _ in whole])
    expected = np.array([(n * np.array(x, object) - s).astype(float) / n for _, x in whole]) @ q[:, :m] / np.sqrt(e[:m])
    assert np.abs(values - expected * np.sign((values * expected).sum(axis=0))).max() < 1e-8
    assert all(r.n == n and abs(r.explained * trace / e[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9 for r in got)
    assert all(by[i, 1].deviation == sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)) for i, x in whole)


def test_whitening_matches_a_dense_solver(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert_whitened(rows, whitening.whitened(df).collect())


def test_whitening_of_few_rows_and_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(30)]) for i in range(10)]
    rows += [(20, rows[0][1]), (21, None), (22, [None] + [1.0] * 29), (23, [float("nan")] * 30), (24, [float("inf")] + [0.0] * 29)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in [*rows, (25, [1.0, 2.0]), (26, [])]], "vec_id long, embedding array<float>, n int, x string")
    got = whitening.whitened(df).collect()
    assert_whitened(rows, got)
    assert max(r.component for r in got) == 9 and {r.n for r in got} == {10}


def test_whitening_finds_equal_eigenvalues_and_nothing_in_one_vector(spark):
    rows = [(i, [3.0 * (-1) ** i if j == i // 2 else 0.0 for j in range(6)]) for i in range(12)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == set(range(1, 7)) and all(abs(r.explained - 1 / 6) < 1e-9 and r.identity_error < 1e-9 for r in got)
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whitened(one).count() == 0 and whitening.whitened(one.limit(0)).count() == 0


def test_early_end_gives_the_same_leading_components(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 40)) * (4.0 * 0.5 ** np.arange(40) + 0.05)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, early=True).collect()
    assert_whitened(rows, got, 3)


def test_deviations_stay_exact_and_null_beyond_a_long():
    w = whitening.Whitening(10 ** 9, np.array([5, 7]), np.array([3, 999_999_999]), np.zeros((2, 0)), np.zeros(0), 0.0)
    x = np.array([[6, 8], [9, 7], [1 << 40, 0]])
    exact = [sum((10 ** 9 * (a - c) - r) ** 2 for a, c, r in zip(row, (5, 7), (3, 999_999_999))) for row in x.tolist()]
    assert whitening.deviations(x, w) == [v if v < 1 << 63 else None for v in exact] and None in whitening.deviations(x, w)
