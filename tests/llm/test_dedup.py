"""Exact dedup, byte-level dedup and near-dedup against brute force over a small table."""

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from cloakline.llm import bloom, byte_names, components, exact_dedup, near_dedup, suffix_dedup
from llm_rows import SCHEMA, documents, empty


def table(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, extra=["one two three"] * 5).cache()


def test_filter_never_misses_a_repeat():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    size = bloom.filter_size(5000)
    at, count = np.unique(bloom.positions(np.concatenate([h, h[:700]]), size), return_counts=True)
    twice = np.zeros(size, bool)
    twice[at[count > 1].astype(np.int64)] = True
    hit = bloom.reported(h, np.packbits(twice))
    assert hit[:700].all() and hit[700:].mean() < 0.1


def test_exact_dedup_matches_brute_force(docs):
    groups = {}
    for i, t in table(docs):
        groups.setdefault(hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", t).encode()).hexdigest(), []).append((-len(t), i))
    want = {}
    for h, g in groups.items():
        stays = min(g)[1]
        want |= {i: (stays, len(g), i == stays, h) for _, i in g}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.duplicates(docs).collect()}
    assert got == want
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, w in want.items() if w[2])


def test_exact_dedup_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b")] * 3 + [(None, "ab"), (2, None), (2, "")]
    df = spark.createDataFrame([(i, t, *[None] * 9) for i, t in rows], SCHEMA)
    out = exact_dedup.duplicates(df).collect()
    assert len(out) == 6 and sum(r.kept for r in out) == 2
    assert {(r.doc_id, r.keep_id) for r in out} == {(1, 1), (None, 1), (2, 2)}
    assert exact_dedup.deduplicated(df).count() == 2
    assert exact_dedup.duplicates(empty(spark)).count() == 0


def test_exact_dedup_takes_every_id(spark):
    least, most = -(1 << 63), (1 << 63) - 1
    df = spark.createDataFrame([(least, "a b"), (most, "ab "), (0, "c"), (least, "c "), (most, "d")], "doc_id long, text string")
    got = {(r.doc_id, r.text_sha256[:4]): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.duplicates(df).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()[:4]
    assert got == {(least, sha("ab")): (least, 2, True), (most, sha("ab")): (least, 2, False), (0, sha("c")): (least, 2, False),
                   (least, sha("c")): (least, 2, True), (most, sha("d")): (most, 1, True)}
    assert {(r.doc_id, r.text) for r in exact_dedup.deduplicated(df).collect()} == {(least, "a b"), (least, "c "), (most, "d")}


def brute_bytes(rows):
    seen, out = {}, {}
    for i, t in sorted(rows):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if seen.setdefault(b[k:k + 100], (i, k)) != (i, k):
                gone[k:k + 100] = True
        spans = len([1 for on, _ in itertools.groupby(gone) if on])
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def test_suffix_dedup_matches_brute_force(docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(docs).collect()}
    assert got == brute_bytes(table(docs))


def test_suffix_dedup_edges(spark):
    passage = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(150))
    df = spark.createDataFrame([(3, passage), (3, passage), (None, passage), (7, passage[:99]), (8, "a" * 1000)], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.removed(df).collect()}
    # null sorts first; of "a" * 1000 every string but the first starts earlier too
    assert got == {(None, 150): 0, (3, 150): 150, (7, 99): 0, (8, 1000): 999}
    assert suffix_dedup.removed(empty(spark)).count() == 0


def common_line(n):
    """Texts around one line; every seventh takes 120 bytes over from an earlier one, every ninth is a copy."""
    rng, line = np.random.default_rng(9), "".join(chr(97 + (k * k + k // 5) % 26) for k in range(70))
    word = lambda m: bytes(rng.integers(97, 123, m).astype(np.uint8)).decode()
    out = []
    for k in range(n):
        out.append(word(150) + line + word(int(rng.integers(20, 160))))
        if k % 7 == 6:
            out[k] += out[k // 2][90:210]
        if k % 9 == 8:
            out[k] = out[k // 3]
    return out


def test_suffix_dedup_builds_no_filter_of_all_names(docs, monkeypatch):
    asked, before = [], bloom.counted
    monkeypatch.setattr(bloom, "counted", lambda rows, n, least, *a, **b: asked.append(least) or before(rows, n, least, *a, **b))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(docs, kept=False).collect()}
    assert got == brute_bytes(table(docs))
    assert asked and set(asked) == {1}  # of what is open only; one of all names fills as the table grows


def test_suffix_dedup_deals_the_runs_of_a_common_line(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY", 4)
    monkeypatch.setattr(suffix_dedup, "BATCH", 10)
    met, before = [], suffix_dedup._met
    monkeypatch.setattr(suffix_dedup, "_met", lambda rows: met.append(rows.count()) or before(rows))
    rows = list(enumerate(common_line(120)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(df).collect()}
    assert got == brute_bytes(rows)
    assert met and min(met) > 0


def test_a_bucket_gets_few_runs_of_a_common_line():
    texts, buckets = common_line(400), {}
    for k in range(0, 400, 100):
        ids = pa.array(range(k, k + 100), pa.int64())
        batch = pa.record_batch([ids, pa.array(texts[k:k + 100]), ids], names=["doc_id", "text", "tie"])
        for bucket, blob in zip(*suffix_dedup._packed(suffix_dedup.ranked(batch, []), np.zeros(100, bool), 64), strict=True):
            buckets.setdefault(int(bucket), []).append(blob)
    sizes = [len(suffix_dedup._unpacked(b)["name"]) for b in buckets.values()]
    assert max(sizes) < 3 * np.mean(sizes)


def test_repeats_in_a_bucket_are_settled_wherever_they_were_sent():
    u, z = (lambda *x: np.array(x, np.uint64)), np.zeros(7, np.int64)
    rows = {"name": u(1, 1, 2, 2, 3, 4, 4), "region": u(5, 5, 6, 7, 8, 9, 0), "doc_id": np.array([2, 1, 1, 1, 1, 1, 0]), "tie": z, "at": z,
            "flags": np.array([0, 0, 0, 0, suffix_dedup.DEALT, 0, suffix_dedup.MARKED], np.uint8)}
    at, state = suffix_dedup.sorted_bucket(rows)
    assert dict(zip(at.tolist(), state.tolist(), strict=True)) == {0: 0, 2: 1, 3: 1, 4: 2, 5: 2}


def test_runs_are_the_same_wherever_a_string_stands(monkeypatch):
    rng = np.random.default_rng(5)
    text = rng.integers(97, 101, 700).astype(np.uint8)
    moved = np.concatenate([rng.integers(97, 101, 333).astype(np.uint8), text, rng.integers(97, 101, 50).astype(np.uint8)])
    one = lambda d, a, n: set(zip(*(x.tolist() for x in byte_names.runs(d, np.array([a]), np.array([n]), 32)[:2]), strict=True))
    assert one(text, 0, 601) == one(moved, 333, 601)
    whole = byte_names.runs(moved, np.array([0]), np.array([len(moved) - 99]), 100)
    monkeypatch.setattr(byte_names, "SEGMENT", 300)
    cut = byte_names.runs(moved, np.array([0]), np.array([len(moved) - 99]), 100)
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def shingles(text, width):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
    return {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute_near(rows, width):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


def test_near_dedup_matches_brute_force(docs, monkeypatch):
    want = brute_near(table(docs), 4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, 4).collect()}
    assert got == want
    kept = near_dedup.deduplicated(docs, 5)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, w in brute_near(table(docs), 5).items() if w[2])


def test_near_dedup_of_groups_larger_than_a_block(spark, monkeypatch):
    """A chain of near copies, most of which are not near each other, split over many blocks."""
    import random

    rng = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(60):
        own = list(base)
        for _ in range(k // 2):
            own[rng.randrange(200)] = f"v{k}x{rng.randrange(10**6)}"
        rows.append((100 - k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_near(rows, 4)
    assert 2 < len({w[1] for w in want.values()}) < 60
    monkeypatch.setattr(near_dedup, "BLOCK", 1500)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, 4).collect()}
    assert got == want


def test_near_dedup_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (9, None), (8, " "), (2, "a b c")],
                               "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, 4).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (9, 0, 9, True), (8, 0, 8, True), (2, 1, 2, True)], key=str)
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 200), (300, 200), (300, 400), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {200: 100, 300: 100, 400: 100}


def block_rows(sets, cluster=None, side=None):
    return [{"node": k, "cluster": k if cluster is None else cluster[k], "side": 0 if side is None else side[k],
             "shingles": np.array(sorted(s), np.uint64).tobytes()} for k, s in enumerate(sets)]


def test_components_of_hubs(spark):
    rng = np.random.default_rng(5)
    links = [(7, int(b)) for b in rng.integers(100, 9000, 3000)] + [(9500, int(b)) for b in rng.integers(8990, 12000, 3000)] + [(20000, 20001)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect())
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert got == {x: find(x) for x in root if find(x) != x}


def test_a_block_of_many_short_rows_stays_small():
    """Templated texts: few shingles each, so a block bounded by shingles alone holds very many rows."""
    import tracemalloc

    far = block_rows([{*range(4), 10 + 3 * k, 11 + 3 * k, 12 + 3 * k} for k in range(6000)])
    near = block_rows([{*range(30), 100 + k} for k in range(6000)])
    for rows, want in ((far, 0), (near, 5999)):
        tracemalloc.start()
        links = near_dedup._links(rows)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(links) == want and peak < 150 << 20


@pytest.mark.parametrize("seed", range(6))
def test_links_connect_what_all_pairs_connect(seed, monkeypatch):
    import random

    monkeypatch.setattr(near_dedup, "STRIPE", 3)
    monkeypatch.setattr(near_dedup, "TILE", 5)
    monkeypatch.setattr(near_dedup, "COLUMNS", 7)
    rng = random.Random(seed)
    sets = [set(rng.sample(range(24), 20)) | {100 + k % 9} for k in range(40)]
    side = [rng.randrange(2) for _ in sets] if seed % 2 else None
    cluster = [rng.randrange(30) for _ in sets]

    def joined(pairs):
        root = list(cluster)
        for a, b in pairs:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
        return root

    pairs = [(a, b) for a in range(40) for b in range(40) if (side[a] < side[b] if side else a < b)
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    links = near_dedup._links(block_rows(sets, cluster, side))
    assert {tuple(sorted(x)) for x in links} <= {tuple(sorted(x)) for x in pairs}
    assert joined(links) == joined(pairs) and len(links) < 30


def test_near_dedup_of_groups_with_more_rows_than_a_block(spark, monkeypatch):
    rows = [(k, "the order of the client with the number " + str(k // 2) + " was sent on the day" + " x" * (k % 2) + " and paid in full")
            for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(near_dedup, "MEMBERS", 7, raising=False)
    seen = []
    pieces = near_dedup._pieces
    monkeypatch.setattr(near_dedup, "_pieces", lambda *a: seen.append(a) or pieces(*a))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, 4).collect()}
    assert got == brute_near(rows, 4)
    assert len(seen) > 1  # the group was dealt over several blocks
