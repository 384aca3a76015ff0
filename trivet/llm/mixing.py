"""Mixing sources to target weights by temperature (DataFrame functions only).

A source's weight is its token share to the power of an exponent between 0 (uniform) and 1 (as found), normalised. The
exponent is bisected: the largest one that reaches the target entropy, raised where that would repeat a source more often
than allowed. A source's budget is then realised as whole permutations of its documents and one part of a permutation:
blocks of documents in permuted order, and documents in permuted order inside the one block that the budget cuts.

What a document gets follows from one small row of its source, so documents are never sorted or moved for it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivet.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
DEPTH, ROUNDS = 8, 5  # bisection steps a job, and jobs: 40 bits of the exponent


@dataclass(frozen=True)
class Mixture:
    """``entropy``: the least entropy of the weights, as a share of that of uniform weights. ``repetition``: the most
    passes over any source (it wins over ``entropy``). ``budget``: tokens in all, ``"total"`` for as many as there are,
    ``"cover"`` for the fewest that hold every document once. ``block_docs``: documents a block, about."""

    entropy: float = 0.97
    repetition: float = 4.0
    budget: int | str = "total"
    block_docs: int = 1000
    seed: int = 42


def _key(*parts: Column) -> Column:
    """60 bits of a digest; SQL engines agree on it."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _budget(total: Column, w: Column, share: Column, budget: int | str, least: Column) -> Column:
    """Tokens for a source of weight ``w``; ``least``: the smallest weight to share ratio."""
    if budget == "cover":
        return F.greatest(F.floor(w * total / least), F.floor(share * total + 0.5))
    # A weight times the whole may fall short of a whole number by rounding, and differently with the order of addition.
    return F.floor(w * (total if budget == "total" else F.lit(budget)) + 1e-6)


def measure(sources: DataFrame, alphas: list[float], mix: Mixture) -> dict[float, tuple[float, float]]:
    """Entropy and greatest repetition at each exponent: one aggregation over the table of sources."""
    p = F.col("share")
    powers = sources.filter("share > 0").withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
    powers = powers.withColumn("x", F.pow(p, F.col("alpha")))
    z = F.sum("x")
    entropy = F.log(z) - F.col("alpha") * F.sum(F.col("x") * F.log(p)) / z
    ratio = F.max(F.pow(p, F.col("alpha") - 1))
    if mix.budget == "cover":
        repeats = ratio / F.min(F.pow(p, F.col("alpha") - 1))
    else:
        repeats = ratio / z * (F.lit(1.0) if mix.budget == "total" else F.lit(mix.budget) / F.max("total"))
    rows = powers.groupBy("alpha").agg(entropy.alias("h"), repeats.alias("r")).collect()
    return {row.alpha: (row.h, row.r) for row in rows}


def exponent(sources: DataFrame, mix: Mixture) -> float:
    """Bisect both conditions together; a job measures every midpoint that its next ``DEPTH`` steps can reach."""
    n = sources.filter("share > 0").count()
    if n < 2:
        return 1.0
    enough = lambda m: m[0] >= mix.entropy * math.log(n)  # noqa: E731  holds below some exponent
    within = lambda m: m[1] <= mix.repetition  # noqa: E731  holds above some exponent
    ends = measure(sources, [0.0, 1.0], mix)
    spans = {"entropy": [0.0, 1.0], "repetition": [0.0, 1.0]}
    for _ in range(ROUNDS):
        mids = {lo + (hi - lo) * k / 2**DEPTH for lo, hi in spans.values() for k in range(1, 2**DEPTH)}
        found = measure(sources, sorted(mids), mix)
        for name, holds_low in (("entropy", enough), ("repetition", lambda m: not within(m))):
            lo, hi = spans[name]
            for _ in range(DEPTH):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if holds_low(found[mid]) else (lo, mid)
            spans[name] = [lo, hi]
    by_entropy = 1.0 if enough(ends[1.0]) else spans["entropy"][0]
    by_repetition = 0.0 if within(ends[0.0]) else spans["repetition"][1]
    return max(by_entropy, by_repetition)


def plan(docs: DataFrame, mix: Mixture, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """A small row for each source (weight, budget, where its last permutation is cut), and the measured documents."""
    base = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"),
        )
    )
    sums = cut(base.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    sources = cut(sums.crossJoin(total).withColumn("share", F.when(F.col("total") > 0, F.col("tokens") / F.col("total")).otherwise(F.lit(0.0))))
    alpha = exponent(sources, mix)
    live = F.col("share") > 0
    power = F.when(live, F.pow("share", F.lit(alpha))).otherwise(F.lit(0.0))
    norm = sources.agg(
        F.sum(power).alias("z"),
        F.min(F.when(live, F.pow("share", F.lit(alpha - 1)))).alias("least"),
    )
    w = power / F.col("z")
    want = _budget(F.col("total"), w, F.col("share"), mix.budget, F.col("least") / F.col("z"))
    budgets = sources.crossJoin(norm).select(
        "source",
        "tokens",
        "docs",
        F.when(live, w).otherwise(F.lit(0.0)).alias("weight"),
        F.when(live, want).otherwise(F.lit(0)).cast("long").alias("target"),
    )
    # A source without tokens costs nothing: its documents are taken once.
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.greatest(F.col("tokens"), F.lit(1)))).otherwise(F.lit(1)).cast("long")
    budgets = cut(
        budgets.withColumn("whole", whole)
        .withColumn("rest", F.when(F.col("tokens") > 0, F.col("target") - F.col("whole") * F.col("tokens")).otherwise(F.lit(0)))
        .withColumn("blocks", F.greatest(F.lit(1), F.floor(F.col("docs") / mix.block_docs)).cast("long"))
    )
    placed = _placed(base, budgets, mix)
    by_block = placed.groupBy("source", "rest", "block", "block_key").agg(F.sum("n_tokens").alias("block_tokens"))
    upto = F.sum("block_tokens").over(Window.partitionBy("source").orderBy("block_key", "block").rowsBetween(Window.unboundedPreceding, 0))
    cuts = cut(
        by_block.withColumn("upto", upto)
        .filter("upto > rest")
        .groupBy("source")
        .agg(F.min(F.struct("upto", "block_key", "block", "block_tokens")).alias("c"))
        .select(F.col("source"), F.col("c.block_key").alias("cut_key"), F.col("c.block").alias("cut_block"), (F.col("c.upto") - F.col("c.block_tokens")).alias("before"))
    )
    inside = placed.join(cuts.withColumnRenamed("source", "cut_source"), F.expr("source <=> cut_source AND block = cut_block"))
    spent = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("doc_key").rangeBetween(Window.unboundedPreceding, 0))
    last = (
        inside.withColumn("spent", F.col("before") + spent)
        .filter("spent <= rest")
        .groupBy(F.col("source").alias("last_source"))
        .agg(F.max("doc_key").alias("last_doc"))
    )
    cuts = cuts.withColumnRenamed("source", "cut_source").join(last, F.expr("cut_source <=> last_source"), "left").drop("last_source", "before")
    return cut(budgets.join(cuts, F.expr("source <=> cut_source"), "left").drop("cut_source")), base


def _placed(base: DataFrame, budgets: DataFrame, mix: Mixture) -> DataFrame:
    """Each document's block and its place in its source's last permutation."""
    small = budgets.withColumnRenamed("source", "plan_source")
    seed = F.lit(mix.seed)
    joined = base.join(small, F.expr("source <=> plan_source"))
    joined = joined.withColumn("block", F.pmod(_key(seed, F.lit("block"), F.col("doc_id")), F.col("blocks")))
    return joined.withColumn("block_key", _key(seed, F.col("whole"), F.col("source"), F.col("block"))).withColumn("doc_key", _key(seed, F.col("whole"), F.col("doc_id")))


def _copies() -> Column:
    before = (F.col("block_key") < F.col("cut_key")) | ((F.col("block_key") == F.col("cut_key")) & (F.col("block") < F.col("cut_block")))
    at = (F.col("block_key") == F.col("cut_key")) & (F.col("block") == F.col("cut_block")) & (F.col("doc_key") <= F.col("last_doc"))
    return F.col("whole") + F.when(F.coalesce(before | at, F.lit(False)), F.lit(1)).otherwise(F.lit(0))


def mix_sources(docs: DataFrame, mix: Mixture = Mixture(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Return ``doc_id, source, n_tokens long, weight double, copies long`` for every row, also for rows taken 0 times.

    * tokens are words; null and empty texts have none and cost nothing; a null source is a source of its own.
    * rows with one id (repeated rows, null ids) share their place in the permutation and are taken or left together.
    * a source without any token has weight 0 and is taken once; an empty table gives no rows.
    * a source's taken tokens never exceed its budget and stay below it by less than its next document's length.
    * very long texts count whole; other columns of the input are not read.
    """
    sources, base = plan(docs, mix, id_col, text_col, source_col)
    return _placed(base, sources, mix).select("doc_id", "source", "n_tokens", "weight", _copies().alias("copies"))


def realise(docs: DataFrame, mix: Mixture, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, each as often as :func:`mix_sources` takes it."""
    sources, _ = plan(docs, mix, id_col, text_col, source_col)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"))
    taken = _placed(rows, sources, mix).select("row", F.explode(F.array_repeat(F.lit(1), _copies().cast("int"))).alias("n"))
    return taken.select("row.*")


def oracle(mix: Mixture = Mixture()) -> str:
    """DuckDB SQL of :func:`mix_sources` for a ``"total"`` budget."""
    key = "('0x' || substr(md5({}), 1, 15))::BIGINT"
    return f"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
sums AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS docs FROM base GROUP BY source),
shares AS (SELECT *, tokens::DOUBLE / (SELECT sum(tokens) FROM sums)::DOUBLE AS share FROM sums),
ps AS (SELECT list(share) AS p, len(list(share)) AS n FROM shares WHERE share > 0),
bis AS (
  SELECT 0 AS i, 0.0::DOUBLE AS elo, 1.0::DOUBLE AS ehi, 0.0::DOUBLE AS rlo, 1.0::DOUBLE AS rhi
  UNION ALL
  SELECT i + 1,
    CASE WHEN h >= {mix.entropy} * ln(n) THEN (elo + ehi) / 2 ELSE elo END, CASE WHEN h >= {mix.entropy} * ln(n) THEN ehi ELSE (elo + ehi) / 2 END,
    CASE WHEN r > {mix.repetition} THEN (rlo + rhi) / 2 ELSE rlo END, CASE WHEN r > {mix.repetition} THEN rhi ELSE (rlo + rhi) / 2 END
  FROM (SELECT *, ln(list_sum(list_transform(p, lambda x: pow(x, (elo + ehi) / 2))))
            - (elo + ehi) / 2 * list_sum(list_transform(p, lambda x: pow(x, (elo + ehi) / 2) * ln(x))) / list_sum(list_transform(p, lambda x: pow(x, (elo + ehi) / 2))) AS h,
          list_max(list_transform(p, lambda x: pow(x, (rlo + rhi) / 2 - 1))) / list_sum(list_transform(p, lambda x: pow(x, (rlo + rhi) / 2))) AS r
        FROM bis, ps) WHERE i < {DEPTH * ROUNDS}),
ends AS (SELECT -list_sum(list_transform(p, lambda x: x * ln(x))) >= {mix.entropy} * ln(n) AS as_found,
                1 / list_min(p) / n <= {mix.repetition} AS flat FROM ps),
alpha AS (SELECT greatest(CASE WHEN as_found THEN 1.0 ELSE elo END, CASE WHEN flat THEN 0.0 ELSE rhi END) AS a
          FROM bis, ends WHERE i = {DEPTH * ROUNDS}),
budgets AS (
  SELECT source, tokens, docs, weight, CASE WHEN tokens > 0 THEN floor(weight * (SELECT sum(tokens) FROM sums)::DOUBLE + 1e-6)::BIGINT ELSE 0 END AS target
  FROM (SELECT *, CASE WHEN share > 0 THEN pow(share, a) / (SELECT sum(pow(share, a)) FROM shares WHERE share > 0) ELSE 0.0 END AS weight FROM shares, alpha)),
goals AS (
  SELECT *, target - whole * tokens AS rest, greatest(1, docs // {mix.block_docs}) AS blocks
  FROM (SELECT *, CASE WHEN tokens > 0 THEN target // greatest(tokens, 1) ELSE 1 END AS whole FROM budgets)),
placed AS (
  SELECT *, {key.format(f"'{mix.seed}:' || whole || ':' || coalesce(source, '') || ':' || block")} AS block_key,
         {key.format(f"'{mix.seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')")} AS doc_key
  FROM (SELECT b.doc_id, b.n_tokens, g.*, {key.format(f"'{mix.seed}:block:' || coalesce(doc_id::VARCHAR, '')")} % blocks AS block
        FROM base b JOIN goals g ON b.source IS NOT DISTINCT FROM g.source)),
spent AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY block_key, block, doc_key) AS upto FROM placed)
SELECT doc_id, source, n_tokens, round(weight, 6) AS weight, (whole + CASE WHEN tokens > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM spent
"""


ORACLE = oracle()
