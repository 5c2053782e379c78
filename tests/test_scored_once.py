"""The comparison at size: systems run once, rows with few spans are matched in the JVM, texts are split only where that is needed."""

import random
import re

from pyspark.sql import functions as F

from cloakline.operators import matching
from cloakline.operators import metrics as MT
from cloakline.operators import scan as SC
from cloakline.plans import catalog
from cloakline.plans import evaluate as EV
from cloakline.sources.patterns import InlinePattern, seed_inline
from mask_samples import samples
from test_bruteforce import matched


def test_benchmark_tables_run_the_systems_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def mask(text: str) -> str:
        seen.add(1)
        return text.replace("ANN", "X")

    def counted(df, names):
        pred = F.array(F.struct(F.lit("ANN").alias("span"), F.lit("PERSON").alias("phi_type")))
        return df.select(F.lit(names[0]).alias("system"), "doc_id", F.udf(mask, "string")("text").alias("masked"), pred.cast(EV.PRED_T).alias("pred"),
                         F.lit(0).alias("cache_hits"), F.lit(0).alias("cache_misses"))

    data = samples(spark, [(k, f"ANN met BOB {k}", [("ANN", "PERSON"), ("BOB", None)]) for k in range(6)])
    tables = EV.benchmark_tables(EV.Comparison().register(("own",), counted).outputs({"a": data}, ("a",)))
    assert {(r.phi_type, r.tp, r.fp, r.fn) for r in tables["per_type"].collect()} == {("PERSON", 6, 0, 0), ("UNKNOWN", 0, 0, 6)}
    (row,) = tables["detection"].collect()
    assert (row.precision, row.recall, row.n) == (1.0, 0.5, 6)
    assert [r.exact_leakage for r in tables["security"].collect()] == [1.0] and tables["latency"].count() == 1
    assert seen.value == 6


def test_match_in_the_row_equals_the_plain_one(spark):
    rnd = random.Random(8)
    vocab = ["John Smith", "Smith", "john", "NY", "ny city", "a b", "B", "", "x y z", "Y", "Joanna", "ann", "12-34", "2-3", "ß É"]
    sizes = {i: 9 if i < 300 else 30 for i in range(330)}  # the last rows go through the index
    cases = {i: tuple([rnd.choice(vocab) + ("" if n < 10 else rnd.choice("  qv")) for _ in range(rnd.randint(n - 9, n))] for _ in "gp") for i, n in sizes.items()}
    rows = [(i, *c) for i, c in cases.items()] + [(900, None, ["a"]), (901, ["a", None], [None, "a"]), (902, [], []), (903, ["a"], None)]
    base = spark.createDataFrame(rows, "i int, gt array<string>, pred array<string>").select(
        "i", F.expr(MT.with_tokens_sql("gt")).alias("g"), F.expr(MT.with_tokens_sql("pred")).alias("p"))
    base = base.withColumn("pairs", F.expr(MT.pairs_sql("g", "p")))
    expected = {i: matched(*c) for i, c in cases.items()} | {900: 0, 901: 1, 902: 0, 903: 0}
    both = {r.i: (r.few, r.many) for r in base.select("i", matching.matched_few("pairs").alias("few"), matching.matched_many("pairs").alias("many")).collect()}
    assert {i: many[0] for i, (_, many) in both.items()} == expected
    few = {i: few[0] for i, (few, _) in both.items() if few is not None}
    assert few == {i: expected[i] for i in few} and {*range(300), 901, 902} <= set(few) and len(few) < len(expected) - 10


def test_records_of_few_and_many_spans(spark):
    spans = {1: (["ab", "cd"], ["ab x", "q"]), 2: ([f"t{k}" for k in range(40)], [f"T{k} z" for k in range(20)] + ["t39"])}
    rows = [("s", 3, 3, "a b", "a", None, [("ab", "A")], 0)] + [("s", k, k, "a b", "a", [(x, "A" if x != "cd" else None) for x in g], [(x, "A") for x in p], 0) for k, (g, p) in spans.items()]
    kind = "array<struct<span:string,phi_type:string>>"
    out = spark.createDataFrame(rows, f"system string, doc_id long, seq long, text string, masked string, phi_spans {kind}, pred {kind}, cache_hits int")
    got = {r.doc_id: r for r in EV.records(out, types=True).collect()}
    assert [(got[k].tp, got[k].fp, got[k].fn) for k in (1, 2)] == [(1, 1, 1), (21, 0, 19)]
    assert (got[3].tp, got[3].fp, got[3].by_type) in ((0, 1, []), (0, 1, None))
    assert {tuple(x) for x in got[1].by_type} == {("A", 1, 1, 0), ("UNKNOWN", 0, 0, 1)} and [tuple(x) for x in got[2].by_type] == [("A", 21, 0, 19)]
    assert {(r.phi_type, r.tp, r.fp, r.fn) for r in EV.per_type_overlap(out).collect()} == {("A", 22, 1, 19), ("UNKNOWN", 0, 0, 1)}


def test_tokens_are_those_of_a_plain_split(spark):
    texts = ["", " ", "A b\tC\n\nd\x0be\x0cf\rg\x1ch\x1di\x1ej\x1fk ", "fan xf u00 f", "É ß\x85x Y  z　", None, "a\\t'b"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.expr(MT.tokens_sql("t")).alias("k"))
    assert {r.i: r.k for r in rows.collect()} == {i: None if t is None else t.lower().split() for i, t in enumerate(texts)}


def test_offsets_split_only_texts_with_matches_and_once(spark):
    patterns = [InlinePattern(k, f"p{k}", rx, "X", None, False, 1.0) for k, rx in enumerate([r"\d+", r"\b[a-z]+\b", "é", r"^a|z$"])]
    sql = SC.offsets_sql("text", patterns, False)
    assert sql.count("split(") == len(patterns) == sql.count("size(ms) = 0")
    texts = ["", "a1é22 bz", "éé 7", "12", "zzz", "none a"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, text string")
    got = {r.i: r.hits and [(h.label, h.span, h.start, h.end) for h in r.hits] for r in SC.scan(rows, patterns, offsets=True).collect()}
    told = {i: [(p.label, m.group(), *m.span()) for p in patterns for m in re.finditer(p.regex, t)] for i, t in enumerate(texts)}
    assert {i: x or [] for i, x in got.items() if i < len(texts)} == told


def test_systems_without_regex_need_no_offsets(spark, secret):
    data = samples(spark, [(1, "call 555-123-4567", [])])
    plan = lambda *names: EV.systems_wide(data, secret, names, seed_inline(None))._jdf.queryExecution().analyzed().toString()
    assert "split(text" in plan("cold", "regex") and "split(text" not in plan("cold")
    (row,) = EV.systems_wide(data, secret, ("cold",), seed_inline(None)).collect()
    assert [p.span for p in row.pred] == ["555-123-4567"]


def test_cold_and_warm_run_once(spark, tmp_path):
    customers = spark.createDataFrame([(k, f"Customer#{k:09d}") for k in range(40)], "c_custkey long, c_name string")
    customers.write.parquet(str(tmp_path / "customer.parquet"))
    out = catalog.cold_warm_detection(spark, str(tmp_path))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()  # all columns from one run of the systems
    rows = {r.system: r for r in out.collect()}
    assert set(rows) == {"cold", "warm"} and rows["cold"].n == rows["warm"].n == 40
    assert rows["warm"].cache_hits > 0 and rows["cold"].cache_misses >= rows["warm"].cache_misses
