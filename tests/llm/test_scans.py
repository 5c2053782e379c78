"""License and secret scans, packing and fingerprints against brute force over a small table."""

import hashlib
import re
import struct
import zlib

import pytest

from cloakline.llm import credentials, fingerprints, licenses, packing
from llm_rows import documents, empty


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


def table(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def test_licenses_match_brute_force(docs):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, t in table(docs).items():
        w = re.findall(licenses.WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        places = [(k, label) for label, p in licenses.PHRASES for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert {x for _, x in places} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_notices_are_found_with_small_changes(spark):
    notice = dict(licenses.NOTICES)["mit"].split()
    rows = [(0, " ".join(notice)), (1, "so " + " ".join(notice[:6] + ["now"] + notice[6:])), (2, " ".join(notice[:7])),
            (3, " ".join(reversed(notice))), (4, ("filler " * 500) + " ".join(notice[:5] + notice[6:]) + " filler" * 500)]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: "mit", 1: "mit", 2: "", 3: "", 4: "mit"}


def test_license_edges(spark):
    df = spark.createDataFrame([(1, "cc by"), (1, "cc by"), (None, None)], "doc_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_base, r.labels) for r in licenses.scan(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 2, 1, "cc-by"), (1, 2, 1, "cc-by"), (None, 0, 0, "")], key=str)
    assert licenses.scan(empty(spark)).count() == 0


ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_spans(t):
    s = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(s)


def test_secrets_match_brute_force(spark, docs):
    hard = ["Token='abc' token: abcdef", "ſecret = abcdefgh", "apiKEY=\"abc.def-\"", "AKIA" + "A1" * 8 + "z", "0123456789abcdef" * 2 + "G",
            "passwd = \npassword=secret=tokens", "é password = abcdefé", "token=token=abcdef"]
    df = documents(spark, extra=hard)
    got = {r.doc_id: r for r in credentials.scan(df).collect()}
    for i, t in table(df).items():
        s = brute_spans(t)
        told = ",".join(f"{credentials.KINDS[k]}:{a}:{b}" for a, k, b in s)
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in s) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(r.spans.split(","))


def test_grammar_learns_a_format(spark):
    import random

    rng = random.Random(2)
    key = lambda: "sk-" + "".join(rng.choice("GHJKMNPQ0123456789") for _ in range(32))
    rows = [(k, f"token = {key()}") for k in range(200)]
    rows += [(1000, f"see {key()} here"), (1001, "see internationalisation2024plans here"), (1002, "an ordinary line of words")]
    got = {r.doc_id: r.spans for r in credentials.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "format:4:39" in got[1000].split(",")
    assert got[1001] == "" and got[1002] == ""


def test_every_run_is_scored_whatever_its_form(spark):
    """Formats that are short, dotted, all digits or all letters are found without a name; words and numbers are not."""
    import random

    rng = random.Random(3)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    forms = [lambda: "q7" + pick("XKWVZ", 2) + pick("0123456789", 6),
             lambda: pick("GHJKMNPQ", 8) + "." + pick("GHJKMNPQ", 8) + "." + pick("0123456789", 6),
             lambda: "771" + pick("0123456789", 15), lambda: pick("XKWVZQJ", 18)]
    words = ["".join(rng.choice(["an", "der", "tion", "heit", "ou", "re"]) for _ in range(rng.randrange(2, 5))) for _ in range(3000)]
    plain = [" ".join(rng.sample(words, 20)) + f" {rng.randrange(10**8)} 10.{rng.randrange(255)}.7.{rng.randrange(255)}. Done." for _ in range(300)]
    rows = [(k, f"token = {forms[k % 4]()}") for k in range(1200)] + [(2000 + k, t) for k, t in enumerate(plain)]
    alone = [(3000 + k, f"see {forms[k % 4]()}. Then {rng.choice(words)}") for k in range(200)]
    docs = spark.createDataFrame(rows + alone, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in credentials.scan(docs, credentials.train(*credentials.labelled(
        spark.createDataFrame(rows, "doc_id long, text string")))).collect()}
    for f in range(4):
        found = [got[i] == f"format:4:{t.index('. Then')}" for i, t in alone if i % 4 == f]
        assert sum(found) >= 45, (f, sum(found))
    assert sum(got[2000 + k] != "" for k in range(300)) <= 1


def test_training_runs_are_those_of_smallest_hash(spark, monkeypatch):
    """The bottom-k of the tasks holds the bottom-k of the corpus, by Spark's own hash."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(credentials, "WORDS", 50)
    rows = [(k, " ".join(f"run{(7 * k + j) % 900:05d}x" for j in range(30)) + " " + "y" * 300) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    runs = docs.select(F.explode(F.split("text", " ")).alias("v")).where("length(v) <= 256").distinct().orderBy(F.xxhash64("v")).limit(50)
    assert credentials.labelled(docs)[1] == [r.v for r in runs.collect()]


def test_automaton_folds_equal_states():
    values = [f"ab{k:04d}" for k in range(300)]
    states = credentials.moves(credentials.Automaton(values).states)
    assert credentials.score(states, "ab1234") > credentials.score(states, "1234ab") + 1
    assert credentials.score(states, "ab1234") > credentials.score(states, "zz--zz") + 1


def test_secret_edges(spark):
    assert credentials.scan(empty(spark)).count() == 0
    got = credentials.scan(spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string")).collect()
    assert len(got) == 3 and all(r.spans == "" for r in got)


# ------------------------------------------------------------------ packing
def test_packing_matches_whole_text_ids(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    window = 64
    rows = packing.pack(docs, window=window).collect()
    want = {}
    for i, t in table(docs).items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        first, at = (len(ids) - 1) % window + 1, 0
        for k in range(-(-len(ids) // window)):
            to = first + k * window
            want[i, k] = (at, to - at, zlib.crc32(struct.pack(f"<{to - at}I", *ids[at:to])))
            at = to
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    filled = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= window


def test_packing_keeps_the_added_token(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    mark = "<|endoftext|>"
    texts = [mark, f"a {mark} b", f"a{mark}b c", f"a  {mark}  b", f" {mark} ", f"a\n {mark}\n\n b", f"{mark}{mark} x", "a <|endof text|> b"]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    ids = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}
    assert sum(50256 in x for x in ids.values()) == len(texts) - 1
    assert {r.doc_id: (r.length, r.ids_crc32) for r in rows} == {k: (len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for k, x in ids.items()}


def one_by_one(lengths, window):
    free = []
    for n in sorted(lengths, reverse=True):
        fit = [f for f in range(len(free)) if free[f] >= n]
        if fit:
            free[min(fit, key=lambda f: free[f])] -= n
        else:
            free.append(window - n)
    return sorted(free)


def test_plan_is_best_fit_decreasing():
    import random
    from collections import Counter

    rng = random.Random(4)
    for _ in range(60):
        window = rng.choice([7, 20, 64])
        lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 120))]
        free, placed = {}, Counter()
        for length, first, each, sequence, offset in packing.best_fit(Counter(lengths), window):
            nxt = min((p[1] for p in packing.best_fit(Counter(lengths), window) if p[0] == length and p[1] > first), default=Counter(lengths)[length])
            for k in range(nxt - first):
                at = sequence + k // each
                assert free.get(at, window) == window - offset - k % each * length
                free[at] = free.get(at, window) - length
                placed[length] += 1
        assert placed == Counter(lengths)
        assert sorted(free.values()) == one_by_one(lengths, window)


def test_ids_of_odd_texts_equal_the_tokenizers():
    import random

    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tokenizer, encode, rng = Tokenizer.from_file(path), packing.encoder(path), random.Random(8)
    parts = ["a", "'s", "'ll", "12", "\u00e9", "<|endoftext|>", "\u4f60\u597d", "!", "_", "\u0663", "\u2167", "\u0301", " ", " ", " ", "\t", "\n", "\x0b", "\x1c",
             "\x85", "\xa0", "\u3000", "\u200b"]
    names = {b: c for c, b in packing.byte_names().items()}
    words = [t for t in tokenizer.get_vocab() if all(c in names.values() for c in t)]
    back = {c: b for b, c in names.items()}
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        glued = bytes(back[c] for t in rng.choices(words, k=rng.randint(0, 6)) for c in t).decode(errors="ignore")
        for x in (text, glued):
            assert encode(x).tolist() == tokenizer.encode(x, add_special_tokens=False).ids


def test_other_tokenizer_files_go_to_their_own_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(packing.tokenizer_path(), encoding="utf-8") as f:
        told = json.load(f)
    told["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "spaced.json").write_text(json.dumps(told), encoding="utf-8")
    path = str(tmp_path / "spaced.json")
    assert packing.encoder(path)("hello you").tolist() == Tokenizer.from_file(path).encode("hello you", add_special_tokens=False).ids


def test_packing_edges(spark):
    assert packing.pack(empty(spark)).count() == 0
    got = packing.pack(spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string")).collect()
    assert [(r.length, r.piece, r.start) for r in got] == [(1, 0, 0)] * 3 and len({r.sequence_id for r in got}) == 1


# ------------------------------------------------------------------ fingerprints
def test_fingerprints(docs):
    rows = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    texts = table(docs)
    order = sorted(texts)
    sets = {}
    for i in order:
        sets.setdefault(rows[i].fingerprint, set()).add(texts[i].lower() if texts[i].split() else "")
    part = lambda s: set(filter(None, s.split(",")))
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / max(len(a | b), 1)
    for i, nxt in zip(order, order[1:] + order[:1], strict=True):
        t, half = texts[i], len(texts[i]) // 2
        edited = t[:len(t) - half] + texts[nxt][:half]
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        mine, other = part(r.fingerprint), part(r.edited_fingerprint)
        assert r.near_edited == pytest.approx(like(mine, other))
        assert r.near_next == pytest.approx(like(mine, part(rows[nxt].fingerprint)))
        assert bool(mine) == bool(t.strip(" \t\n\x0b\x0c\r"))
    assert rows[0].fingerprint == rows[3].fingerprint == rows[4].fingerprint != rows[2].fingerprint


def test_sketches_match_brute_force_and_merge(spark, docs):
    import xxhash

    from pyspark.sql import functions as F

    def chained(words):
        h = 42
        for w in words:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        return h - (1 << 64) if h >> 63 else h

    def brute(*texts):
        found = set()
        for t in texts:
            w = [x for x in re.split("[ \t-\r]+", t.lower()) if x]
            found |= {chained(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
        low = {h for h in found if h < -(1 << 63) + (1 << 61)}
        return sorted(low or ([min(found)] if found else []))

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("s", fingerprints.sketch(F.col("t"))).collect()
    assert all(r.s == brute(r.t) for r in rows)
    pairs = spark.createDataFrame([(a.s, b.s, a.t, b.t) for a, b in zip(rows, rows[7:])], "a array<long>, b array<long>, t string, u string")
    got = pairs.select(fingerprints.merged(F.col("a"), F.col("b")).alias("m"), "t", "u").collect()
    assert all(r.m == brute(r.t, r.u) for r in got)


def test_sketch_estimates_containment(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(6)
    w = [f"{rng.randrange(10**9)}" for _ in range(8000)]
    df = spark.createDataFrame([(" ".join(w[:2000]), " ".join(w[1000:]))], "a string, b string")
    df = df.select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    r = df.select(fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.likeness(F.col("a"), F.col("b")).alias("j")).first()
    assert abs(r.c - 0.5) < 0.1 and abs(r.j - 1000 / 8000) < 0.04


def test_fingerprint_edges(spark):
    assert fingerprints.fingerprints(empty(spark)).count() == 0
    one = fingerprints.fingerprints(spark.createDataFrame([(7, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    ids = [(-5, "a b"), (10**15, "c d"), (None, "e f"), (3, "g h"), (3, "g h")]
    got = {(r.doc_id, r.edited_sha256) for r in fingerprints.fingerprints(spark.createDataFrame(ids, "doc_id long, text string")).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {(None, sha("e a")), (-5, sha("a g")), (3, sha("g g")), (3, sha("g c")), (10**15, sha("c e"))}
