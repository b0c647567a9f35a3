"""Mixing sources to target weights (operator 9, native): temperature mixing.

Weights are source token shares raised to an exponent and normalised.  The
exponent lies between 0 (all sources alike) and 1 (as they come); it is the
largest one whose weights have ``target_entropy`` (a share of the entropy of
equal weights), raised again where the most repeated source would be repeated
more than ``max_repeats`` times as often as the least repeated one.  With a
limit alone weights are as even as it allows.  Both curves are monotone, and the exponent is bracketed by evaluating a grid of
exponents in one aggregate over the source table, again and again within the
bracket: no list of sources reaches the driver.

``budget`` is the number of tokens to emit; by default the smallest one that
emits every document at least once.  A source gets whole epochs and one partial
epoch.  Its documents are hashed into at most ``blocks`` blocks; every epoch
has its own permutation of the blocks, and the partial epoch takes blocks in
that order while they come nearest to the budget.  Which blocks are taken is one
number per source (a cut on the permuted rank), so documents only meet the
source table, and a source with a third of all rows is spread over tasks like
any other.

All expressions are built-in SQL functions.

Defined results: a null source is a source of its own; documents without a word
weigh nothing, and a source without any word is emitted once; repeated rows are
rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprism.llm.common import materialise

#: Columns that the mix adds; columns of the input with these names give way.
RESULTS = ["mix_tokens", "mix_weight", "mix_epochs", "mix_epoch", "mix_position"]
GRID = 17
ROUNDS = 5


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; the tokens of the shares."""
    words = F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+")
    return (F.size(words) - (F.element_at(words, 1) == "").cast("int")
            - ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")).cast("long")


def _source_key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def source_table(docs: DataFrame, source: str, tokens: Column) -> DataFrame:
    """(_src, tokens, share) per source, written once."""
    sums = docs.select(_source_key(F.col(source)).alias("_src"), tokens.alias("t")).groupBy("_src").agg(F.sum("t").alias("tokens"))
    table = materialise(sums, "sources")
    total = table.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    return table.withColumn("share", F.col("tokens") / F.lit(float(max(1, total))))


def _curves(table: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy, ratio of the most to the least repetition) for each exponent; one aggregate."""
    p = F.col("share")
    w = F.pow(p, F.col("a"))
    grid = table.where(p > 0).select("share", F.posexplode(F.array(*[F.lit(a) for a in exponents])).alias("i", "a"))
    rows = grid.groupBy("i").agg(F.sum(w).alias("z"), F.sum(w * F.col("a") * F.log(p)).alias("l"),
                                 F.max(w / p).alias("h"), F.min(w / p).alias("k")).orderBy("i").collect()
    return [(math.log(r["z"]) - r["l"] / r["z"], r["h"] / r["k"]) for r in rows]


def solve_exponent(table: DataFrame, target_entropy: float | None, max_repeats: float | None) -> float:
    """Largest exponent in [0, 1] that reaches the entropy, and no smaller than the repetition limit allows."""
    n = table.where(F.col("share") > 0).count()
    if n < 2:
        return 1.0

    def largest(good, grid_lo=0.0, grid_hi=1.0):
        # good holds from 0 up to the answer
        for _ in range(ROUNDS):
            step = (grid_hi - grid_lo) / (GRID - 1)
            grid = [grid_lo + i * step for i in range(GRID)]
            flags = [good(c) for c in _curves(table, grid)]
            if flags[-1]:
                return grid_hi
            at = max((i for i, f in enumerate(flags) if f), default=0)
            grid_lo, grid_hi = grid[at], grid[min(at + 1, GRID - 1)]
        return grid_lo

    if target_entropy is None:
        exponent = 1.0 if max_repeats is None else 0.0
    else:
        exponent = largest(lambda c: c[0] >= target_entropy * math.log(n) - 1e-12)
    if max_repeats is not None:
        # repetition falls as the exponent rises: the limit fails below its bound
        def over(c):
            return c[1] > max_repeats * (1 + 1e-12)
        if over(_curves(table, [exponent])[0]):
            exponent = largest(over) + 16.0 ** -ROUNDS
    return min(1.0, exponent)


def plan_mix(docs: DataFrame, key: str, source: str, tokens: Column, target_entropy: float | None,
             max_repeats: float | None, budget: int | None, blocks: int, seed: int) -> DataFrame:
    """Per source: tokens, weight, epochs, whole epochs, and the cut of the partial epoch's permutation."""
    table = source_table(docs, source, tokens)
    a = solve_exponent(table, target_entropy, max_repeats)
    w = F.when(F.col("share") > 0, F.pow("share", F.lit(a))).otherwise(0.0)
    sums = table.agg(F.sum(w).alias("z"), F.max(F.when(F.col("share") > 0, F.col("tokens") / w)).alias("b")).first()
    z, least = float(sums["z"] or 1.0), float(sums["b"] or 0.0)
    emit = float(budget) if budget is not None else least * z
    quota = w / F.lit(z) * F.lit(emit)
    plan = table.select("_src", "tokens", (w / F.lit(z)).alias("weight"), F.lit(a).alias("exponent"),
                        F.when(F.col("tokens") > 0, F.round(quota / F.col("tokens"), 9)).otherwise(1.0).alias("epochs"))
    plan = plan.withColumn("whole", F.floor("epochs")).withColumn(
        "rest", ((F.col("epochs") - F.col("whole")) * F.col("tokens")))
    sizes = (docs.select(_source_key(F.col(source)).alias("_src"), _block(key, blocks, seed).alias("_block"), tokens.alias("t"))
             .groupBy("_src", "_block").agg(F.sum("t").alias("t")))
    # at most `blocks` rows per source meet in a window
    order = Window.partitionBy("_src").orderBy("_rank", "_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = (sizes.join(plan.where(F.col("rest") > 0).select("_src", "whole", "rest"), "_src")
             .withColumn("_rank", _rank(F.col("_src"), F.col("_block"), F.col("whole"), seed))
             .withColumn("_sum", F.sum("t").over(order))
             .where(F.col("_sum") - F.col("t") / 2 <= F.col("rest"))
             .groupBy("_src").agg(F.max("_rank").alias("cut")))
    return plan.join(taken, "_src", "left").drop("rest")


def _block(key: str, blocks: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(blocks))


def _rank(src: Column, block: Column, epoch: Column, seed: int) -> Column:
    """A block's place in the permutation of one epoch of its source."""
    return F.xxhash64(F.lit(seed), src, block, epoch.cast("long"))


def mix_sources(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
                target_entropy: float | None = 0.98, max_repeats: float | None = 2.0, budget: int | None = None,
                blocks: int = 4096, seed: int = 17) -> DataFrame:
    """All columns of ``docs``, one row per emitted copy, and mix_weight, mix_epochs, mix_epoch and mix_position.

    Sorting by (mix_epoch, mix_position) gives each epoch's block permutation.
    """
    columns = [c for c in docs.columns if c not in RESULTS]
    plan = materialise(plan_mix(docs, key, source, word_count(F.col(text)), target_entropy, max_repeats, budget, blocks, seed),
                       "mix-plan")
    # the columns of docs travel in a struct, so their names clash with nothing here
    rows = (docs.select(F.struct(*columns).alias("_row"), word_count(F.col(text)).alias("_words"),
                        _source_key(F.col(source)).alias("_src"), _block(key, blocks, seed).alias("_block"))
            .join(plan.drop("tokens"), "_src"))
    partial = _rank(F.col("_src"), F.col("_block"), F.col("whole"), seed) <= F.col("cut")
    copies = (F.col("whole") + F.coalesce(partial, F.lit(False)).cast("int")).cast("int")
    return (rows.withColumn("_copies", copies).where(F.col("_copies") > 0)
            .withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
            .select(*[F.col("_row")[c].alias(c) for c in columns], F.col("_words").alias("mix_tokens"),
                    F.col("weight").alias("mix_weight"), F.col("epochs").alias("mix_epochs"), F.col("_epoch").alias("mix_epoch"),
                    _rank(F.col("_src"), F.col("_block"), F.col("_epoch"), seed).alias("mix_position")))
