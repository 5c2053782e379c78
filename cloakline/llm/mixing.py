"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

Documents form a tree domain > language > source.  A token budget is handed
down the tree in proportion to the weights of siblings.  A node can take at
most what its leaves hold times ``epochs``; what it cannot take goes to its
siblings first, and only what all of them together cannot take had already
gone to the siblings of the parent (capacities are summed up the tree before
budgets go down).  Each leaf then reads whole epochs of its documents and a
prefix of one more: its documents in the order of a seeded hash, as long as
the tokens before a document are fewer than what is left of the budget.

The prefix is found in two steps, so that a source with a third of all rows
never meets in one task: token sums per leaf and hash bucket give the bucket
in which the prefix ends, and only documents of that bucket are sorted.

Defined cases: tokens are runs of ``[^\\x20\\x09-\\x0D]``; null and empty texts
have none; a null language or source is the value ''; a null ``doc_id`` hashes
as 'null'; rows that share a ``doc_id`` within a leaf are taken or left
together; nodes of weight 0 get nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakline.llm.common import documents, written

PATH = ["_domain", "_lang", "_source"]


@dataclass(frozen=True)
class Mix:
    """Production parameters: integer weights (1 where not given), budget and seed."""

    domains: dict[str, int] = field(default_factory=dict)
    langs: dict[str, int] = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2})
    sources: dict[str, int] = field(default_factory=dict)
    percent: int = 60       # of all tokens are the budget
    epochs: int = 2         # a leaf is read at most so many times
    seed: int = 17
    bucket_digits: int = 3  # hexadecimal digits: 16**3 hash buckets for each leaf


def domain_of(source: Column) -> Column:
    """The domain that a source belongs to: its number modulo 4, or ``other``."""
    number = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.when(number == "", "other").otherwise(F.concat(F.lit("d"), F.substring(number, -1, 1).cast("int") % 4))


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def leaves(docs: DataFrame) -> list[Column]:
    source = F.coalesce(F.col("source"), F.lit(""))
    return [domain_of(source).alias("_domain"), F.coalesce("lang", F.lit("")).alias("_lang"), source.alias("_source"),
            token_count(F.col("text")).alias("_tokens"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id")]


def _weight(name: str, weights: dict[str, int]) -> Column:
    out = F.lit(1).cast("long")
    for value, weight in weights.items():
        out = F.when(F.col(name) == value, F.lit(weight).cast("long")).otherwise(out)
    return out


def water_fill(nodes: DataFrame, parent: list[str], key: str) -> DataFrame:
    """``given`` for siblings with ``cap``, ``weight`` and their parent's ``budget``: proportional to the
    weights, at most the capacity, what a full one leaves going to the others (whole numbers)."""
    whole = Window.partitionBy(*parent)
    order = whole.orderBy(F.col("cap") / F.col("weight"), key)
    full_before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    nodes = nodes.where("weight > 0").select("*", F.row_number().over(order).alias("_n"),
                                             (F.col("budget") - full_before).alias("_left"), rest.alias("_rest"))
    part = F.expr("(_left * weight) div _rest")
    first = F.min(F.when(F.col("cap") > part, F.struct("_n", "_left", "_rest"))).over(whole)
    nodes = nodes.select("*", first.alias("_first"))
    given = F.when(F.col("_first").isNull() | (F.col("_n") < F.col("_first._n")), F.col("cap")).otherwise(
        F.expr("(_first._left * weight) div _first._rest"))
    return nodes.select("*", given.alias("given")).drop("_n", "_left", "_rest", "_first")


def budgets(sums: DataFrame, mix: Mix) -> DataFrame:
    """Per leaf ``given`` tokens, from ``sums`` of ``tokens`` per leaf (as many rows as there are leaves)."""
    leaf = sums.withColumn("cap", F.col("tokens") * mix.epochs)
    budget = sums.agg(F.expr(f"sum(tokens) * {mix.percent} div 100").alias("budget"))
    above: DataFrame | None = None
    for level, weights in enumerate((mix.domains, mix.langs, mix.sources)):
        key, parent = PATH[level], PATH[:level]
        nodes = leaf.groupBy(*PATH[:level + 1]).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", _weight(key, weights))
        if above is None:
            nodes = nodes.withColumn("_root", F.lit(0)).join(budget.withColumn("_root", F.lit(0)), "_root")
            above = water_fill(nodes, ["_root"], key)
        else:
            over = above.select(*parent, F.col("given").alias("budget"))
            above = water_fill(nodes.join(over, parent), parent, key)
    return above.select(*PATH, "tokens", "given")


def _hash(mix: Mix) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("_full").cast("string"), F.col("_id")).cast("binary"))


def plan(rows: DataFrame, mix: Mix) -> DataFrame:
    """Per leaf: whole epochs ``_full``, tokens left ``_rest``, the bucket the prefix ends in and the tokens before it."""
    sums = rows.groupBy(*PATH).agg(F.sum("_tokens").alias("tokens"))
    given = budgets(written(sums, "leaves"), mix)
    whole = F.expr("if(tokens > 0, given div tokens, 0)")
    given = written(given.select(*PATH, whole.alias("_full"), (F.col("given") - whole * F.col("tokens")).alias("_rest")), "budgets")
    bucket = F.substring(_hash(mix), 1, mix.bucket_digits)
    held = rows.join(given, PATH).groupBy(*PATH, "_full", "_rest", bucket.alias("_bucket")).agg(F.sum("_tokens").alias("_sum"))
    by_bucket = Window.partitionBy(*PATH).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("*", F.coalesce(F.sum("_sum").over(by_bucket), F.lit(0)).alias("_base"))
    last = held.where("_base < _rest").groupBy(*PATH, "_full", "_rest").agg(
        F.max(F.struct("_bucket", "_base")).alias("_cut"))
    return given.join(last, [*PATH, "_full", "_rest"], "left").select(
        *PATH, "_full", "_rest", F.coalesce("_cut._bucket", F.lit("")).alias("_cut"), F.coalesce("_cut._base", F.lit(0)).alias("_base"))


def mixed(docs: DataFrame, mix: Mix | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Rows of ``docs`` as ``_row`` with their leaf, ``_tokens`` and ``copies`` (0 where not taken).

    Rows whose bucket lies before or after the one in which the prefix ends are
    decided where they are; only the others are sorted.
    """
    mix = mix or Mix()
    if rows is None:
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *leaves(docs))
    leaf = written(plan(rows.select(*PATH, "_tokens", "_id"), mix), "mixture")
    rows = rows.join(leaf, PATH).withColumn("_h", _hash(mix))
    bucket = F.substring("_h", 1, mix.bucket_digits)
    keep = ["_row", *PATH, "_tokens"]
    clear = rows.where(bucket != F.col("_cut")).select(
        *keep, (F.col("_full") + F.when(bucket < F.col("_cut"), 1).otherwise(0)).alias("copies"))
    same = Window.partitionBy(*PATH, "_h")
    upto = Window.partitionBy(*PATH).orderBy("_h").rangeBetween(Window.unboundedPreceding, 0)
    before = F.col("_base") + F.sum("_tokens").over(upto) - F.sum("_tokens").over(same)
    last = rows.where(bucket == F.col("_cut")).select("*", before.alias("_before")).select(
        *keep, (F.col("_full") + F.when(F.col("_before") < F.col("_rest"), 1).otherwise(0)).alias("copies"))
    return clear.unionByName(last)


def chosen(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, as often as it takes them, all columns kept as they are."""
    out = mixed(docs, mix).where("copies > 0")
    if mix.epochs > 1:
        out = out.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("_row.*")


def op7_mix_sources(spark: SparkSession, sf_dir: str, mix: Mix | None = None) -> DataFrame:
    """Per chosen document and epoch: doc_id, domain, lang, source, tokens, epoch."""
    docs = documents(spark, sf_dir)
    narrow = written(docs.select(F.struct("doc_id").alias("_row"), *leaves(docs)), "mix-rows")
    out = mixed(docs, mix, narrow)
    return out.where("copies > 0").select(
        "_row.doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"),
        F.col("_tokens").alias("tokens"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("epoch"))


def _fill_sql(nodes: str, parent: str, key: str, name: str) -> str:
    p = f"PARTITION BY {parent}" if parent else ""
    return f"""
{name}_o AS (
  SELECT *, row_number() OVER o AS n,
         budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lft,
         (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rst
  FROM ({nodes}) WINDOW o AS ({p} ORDER BY cap::DOUBLE / weight, {key})),
{name} AS (
  SELECT *, CASE WHEN f IS NULL OR n < f.n THEN cap ELSE (f.lft * weight) // f.rst END AS given
  FROM (SELECT *, min(CASE WHEN cap > (lft * weight) // rst THEN {{'n': n, 'lft': lft, 'rst': rst}} END)
               OVER ({p}) AS f FROM {name}_o))"""


def _sum_sql(keys: str) -> str:
    return f"SELECT {keys}, sum(tokens)::BIGINT AS tokens, 2 * sum(tokens)::BIGINT AS cap FROM d GROUP BY {keys}"


#: The same mixture with plain windows over all rows (parameters as in ``Mix()``).
SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) = '' THEN 'other'
              ELSE 'd' || (right(regexp_extract(source, '([0-9]+)$', 1), 1)::INT % 4) END AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens
  FROM documents),
{_fill_sql("SELECT s.*, 1::BIGINT AS weight, (SELECT (sum(tokens)::BIGINT * 60) // 100 FROM d) AS budget FROM ("
           + _sum_sql("domain") + ") s", "", "domain", "a")},
{_fill_sql("SELECT s.*, CASE s.lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END::BIGINT AS weight, "
           "a.given AS budget FROM (" + _sum_sql("domain, lang") + ") s JOIN a USING (domain)", "domain", "lang", "b")},
{_fill_sql("SELECT s.*, 1::BIGINT AS weight, b.given AS budget FROM (" + _sum_sql("domain, lang, source")
           + ") s JOIN b USING (domain, lang)", "domain, lang", "source", "c")},
l AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS fl,
             given - CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END * tokens AS rest FROM c),
h AS (SELECT d.*, fl, rest, md5('17:' || fl || ':' || coalesce(doc_id::VARCHAR, 'null')) AS h
      FROM d JOIN l USING (domain, lang, source)),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h RANGE UNBOUNDED PRECEDING)
             - sum(tokens) OVER (PARTITION BY domain, lang, source, h) AS before FROM h),
k AS (SELECT *, fl + CASE WHEN before < rest THEN 1 ELSE 0 END AS copies FROM r)
SELECT doc_id, domain, lang, source, tokens, unnest(range(copies))::BIGINT AS epoch FROM k WHERE copies > 0
"""
