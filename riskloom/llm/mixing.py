"""Mixing sources to target weights.

Temperature mixing: the token shares of the sources are raised to an exponent in
[0, 1] and normalised. The exponent is found by bisection: the largest one whose
entropy reaches a target, or the largest one under which no source has to repeat
more often than a limit. The weights are then realised as block permutations with a
token budget: each source's documents are dealt by a keyed hash into blocks, whole
passes repeat every block, and the last pass takes blocks in order until the
source's budget is used, cutting inside one block only.

With budget=None the budget is the smallest that uses every document at least
once, so mixing raises scarce sources and drops nothing.

Where the budget ends is found from the top down: sums of runs of blocks, then the
blocks of one run, then the keys of one block, each summed before it is put in order,
so no group holds more than a run's, and equal keys are one row. Documents themselves
are never shuffled: a source's plan (passes, cut) is joined to them, by broadcast while
there are at most max_broadcast sources and by a join that adaptive execution may
split beyond that. What the bisection sees of the sources is a fixed number of sums.

Edge cases: a null source is a source of its own; documents without tokens (null or
empty text) weigh nothing and are passed on once; one source keeps weight 1;
equal hash keys (repeated rows) are taken or left together; an empty table gives no
rows. Input columns named mix_* are replaced, those named __mix_* are dropped, all others
pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import materialize, release, table

BLOCK_DOCS = 1024
MAX_BROADCAST_SOURCES = 20_000
#: Blocks that are summed as one run before the run with the cut is looked into.
RUN_BLOCKS = 1024
#: Halvings of [0, 1]; with a target entropy each is a job over the sources' sums.
ROUNDS = 30


def _entropy_at(stats: DataFrame, total: float, exponent: float) -> float:
    """Entropy of the weights for an exponent: two sums over the sources."""
    p = F.col("tokens") / F.lit(total)
    z, s = stats.where("tokens > 0").agg(F.sum(F.pow(p, F.lit(exponent))), F.sum(F.pow(p, F.lit(exponent)) * F.log(p))).first()
    return math.log(z) - exponent * s / z


def _bisect(ok, lo: float, hi: float, rounds: int) -> float:
    """The largest exponent in [lo, hi] for which ok holds, given that ok holds up to some point."""
    if ok(hi):
        return hi
    for _ in range(rounds):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if ok(mid) else (lo, mid)
    return lo


def find_exponent(stats: DataFrame, target_entropy: float | None = None, max_repeat: float | None = None) -> float:
    """The exponent for stats(source, tokens); target_entropy is a share (0 to 1) of the highest entropy possible."""
    row = stats.where("tokens > 0").agg(F.count(F.lit(1)), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    n, total, low, high = row
    if not n or n == 1 or low == high:
        return 1.0
    if max_repeat is not None:
        # the most repeated source is the smallest: (high / low) ** (1 - a) passes
        return 1 - _bisect(lambda t: (high / low) ** t <= max_repeat, 0.0, 1.0, 60)
    if target_entropy is None or target_entropy >= 1:
        return 0.0
    want = target_entropy * math.log(n)
    # entropy falls as the exponent grows
    return _bisect(lambda a: _entropy_at(stats, total, a) >= want - 1e-12, 0.0, 1.0, ROUNDS)


def mix_sources(
    spark: SparkSession,
    docs: DataFrame,
    target_entropy: float | None = None,
    max_repeat: float | None = None,
    budget: float | None = None,
    seed: int = 17,
    max_broadcast: int = MAX_BROADCAST_SOURCES,
) -> DataFrame:
    """docs, one row for each use, with mix_epoch, mix_block, mix_key (the order in the block), mix_tokens and mix_weight."""
    names = [c for c in docs.columns if not c.startswith(("mix_", "__mix_"))]
    base = docs.select(
        *[F.col(f"`{c}`") for c in names],
        F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long").alias("__mix_tokens"),
        F.xxhash64("doc_id", "text").alias("__mix_id"),
    )
    slim = materialize(spark, base.select("source", F.col("__mix_id").alias("id"), F.col("__mix_tokens").alias("n")), "mix")
    stats = materialize(spark, slim.groupBy("source").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mix-sources")
    alpha = find_exponent(stats, target_entropy, max_repeat)
    n, total, high = stats.where("tokens > 0").agg(F.count(F.lit(1)), F.sum("tokens"), F.max("tokens")).first()
    total, high = float(total or 1), float(high or 1)
    z = stats.where("tokens > 0").agg(F.sum(F.pow(F.col("tokens") / total, F.lit(alpha)))).first()[0] or 1.0
    weight = F.pow(F.col("tokens") / total, F.lit(alpha)) / F.lit(z)
    spend = budget if budget is not None else total * z * (high / total) ** (1 - alpha)
    goal = weight * F.lit(float(spend))
    some = F.col("tokens") > 0
    plan = stats.select(
        "source",
        F.when(some, weight).otherwise(0.0).alias("weight"),
        F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_DOCS)).cast("long").alias("blocks"),
        F.when(some, F.floor(goal / F.col("tokens") + 1e-9)).otherwise(1).cast("long").alias("passes"),
        F.when(some, goal).otherwise(0.0).alias("goal"),
        "tokens",
    ).withColumn("rest", F.when(some, F.greatest(F.lit(0.0), F.col("goal") - F.col("passes") * F.col("tokens"))).otherwise(0.0))
    small = (n or 0) <= max_broadcast

    def with_plan(df: DataFrame, p: DataFrame) -> DataFrame:
        """df joined to p by source; p's other columns get the prefix __mix_."""
        p = p.select(*[F.col(c).alias(f"__mix_{c}") for c in p.columns])
        p = F.broadcast(p) if small else p
        return df.join(p, df["source"].eqNullSafe(F.col("__mix_source"))).drop("__mix_source")

    def key(epoch, row):
        return F.xxhash64(F.lit(seed), epoch, row)

    def up_to(df: DataFrame, by: str, left: str) -> DataFrame:
        """df(source, by, n, left), sorted by ``by`` in each source, with the sum before each row, where that is below left."""
        before = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < F.col(left))

    # the last pass: the run of blocks in which the budget ends, the block of the run, the key of the block
    last = with_plan(slim, plan.select("source", "blocks", "passes", "rest")).where("__mix_rest > 0")
    last = last.withColumn("k", key(F.col("__mix_passes"), F.col("id"))).withColumn("block", F.pmod(F.xxhash64("k"), F.col("__mix_blocks")))
    sums = last.groupBy("source", "block").agg(F.sum("n").alias("n"), F.first("__mix_rest").alias("rest"))
    sums = materialize(spark, sums.withColumn("run", F.floor(F.col("block") / RUN_BLOCKS)), "mix-blocks")
    runs = up_to(sums.groupBy("source", "run").agg(F.sum("n").alias("n"), F.first("rest").alias("rest")), "run", "rest")
    cut_run = runs.where("before + n >= rest").select("source", "run", (F.col("rest") - F.col("before")).alias("left"))
    inner = with_plan(sums.drop("rest"), cut_run).where("run = __mix_run").select("source", "block", "n", F.col("__mix_left").alias("left"))
    cut = up_to(inner, "block", "left").where("before + n >= left").select("source", F.col("block").alias("cut_block"), (F.col("left") - F.col("before")).alias("left"))
    inside = with_plan(last.select("source", "block", "k", "n"), cut).where("block = __mix_cut_block")
    inside = inside.groupBy("source", "k").agg(F.sum("n").alias("n"), F.first("__mix_left").alias("left"), F.first("block").alias("cut_block"))
    cut_key = up_to(inside, "k", "left").groupBy("source", "cut_block").agg(F.max("k").alias("cut_key"))
    cut_key = cut_key.withColumnRenamed("source", "cut_source")
    full = plan.join(cut_key, plan["source"].eqNullSafe(F.col("cut_source")), "left").select("source", "weight", "blocks", "passes", "cut_block", "cut_key")
    full = materialize(spark, full, "mix-plan")
    release(spark, slim, stats, sums)

    rows = with_plan(base, full)
    rows = rows.withColumn("__mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("__mix_passes")))))
    rows = rows.withColumn("__mix_key", key(F.col("__mix_epoch"), F.col("__mix_id"))).withColumn("__mix_block", F.pmod(F.xxhash64("__mix_key"), F.col("__mix_blocks")))
    before_cut = (F.col("__mix_block") < F.col("__mix_cut_block")) | ((F.col("__mix_block") == F.col("__mix_cut_block")) & (F.col("__mix_key") <= F.col("__mix_cut_key")))
    whole = F.col("__mix_epoch") < F.col("__mix_passes")
    taken = F.when(F.col("__mix_tokens") == 0, F.col("__mix_epoch") == 0).otherwise(whole | F.coalesce(before_cut, F.lit(False)))
    return rows.where(taken).select(*[F.col(f"`{c}`") for c in names], *[F.col(f"__{c}").alias(c) for c in ("mix_epoch", "mix_block", "mix_key", "mix_tokens", "mix_weight")])


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each use of a document, under the lowest exponent with at most two passes over any source."""
    out = mix_sources(spark, table(spark, sf_dir, "documents"), max_repeat=2.0)
    return out.select("doc_id", "source", "mix_epoch", "mix_block", "mix_key", "mix_tokens", "mix_weight")
