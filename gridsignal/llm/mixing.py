"""Temperature mixing of sources, with built-in functions only.

Source token shares are raised to an exponent between 0 (all sources alike) and 1 (as they are). Bisection finds the
exponent that meets a target: a least entropy of the weights, or a limit on how often a source is repeated. The
normalised weights become token budgets, and each source fills its budget with one permutation of its blocks after
another. A block holds the documents of a source whose hash falls into its range, about ``BLOCK_TOKENS`` tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridsignal.session import settle

BLOCK_TOKENS = 1 << 18
STEPS = 21  # halvings of the exponent's interval
STEPS_AT_ONCE = 7
CHUNK_DIGITS = 3


def word_tokens(text: Column) -> Column:
    """Words between white space, and one for the end of the document; null is empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x09-\x0D\x20]+")).cast("long") + 1


def digest(*parts: Column | str) -> Column:
    """Hex digest of values; null is an empty one."""
    return F.md5(F.concat_ws(":", *[F.coalesce((F.lit(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]))


def source_shares(rows: DataFrame) -> DataFrame:
    """``source, total, share`` from ``source, tokens``; one settled row per source, null being a source of its own."""
    totals = settle(rows.groupBy("source").agg(F.sum("tokens").alias("total")))
    every = totals.agg(F.sum("total")).first()[0] or 0
    return totals.withColumn("share", F.col("total") / F.lit(float(every or 1)))


def bisect(shares: DataFrame, fits: Callable[..., Column], rising: bool) -> float:
    """The last exponent of a grid of ``2 ** STEPS`` steps over [0, 1] for which ``fits`` holds, counted from the end
    where it holds (``rising``: from 0), or that end itself.

    ``fits`` gets the exponent ``a``, the sums over sources of ``s^a`` and ``s^a ln s``, and the largest ``s^(1-a)`` and ``s^(a-1)``. One
    pass makes ``STEPS_AT_ONCE`` halvings at once: it evaluates all exponents that they could ask for.
    """
    low, span = 0, 1 << STEPS
    while span > 1:
        step = max(1, span >> STEPS_AT_ONCE)
        inner = [low + step * i for i in range(1, span // step)]
        grid = shares.withColumn("at", F.explode(F.array(*[F.lit(i) for i in inner])))
        a, s = F.col("at") / F.lit(float(1 << STEPS)), F.col("share")
        sums = grid.groupBy("at").agg(
            F.sum(F.pow(s, a)).alias("mass"), F.sum(F.pow(s, a) * F.ln(s)).alias("logs"),
            F.max(F.pow(s, 1 - a)).alias("up"), F.max(F.pow(s, a - 1)).alias("down"),
        )
        judged = sums.select("at", fits(a, *map(F.col, ("mass", "logs", "up", "down"))).alias("good"))
        good = {r["at"]: r["good"] for r in judged.limit(len(inner)).collect()}
        if rising:
            low = max([low, *(i for i in inner if good.get(i))])
        else:
            low = max([low, *(i for i in inner if not good.get(i, True))])
        span = step
    return (low if rising else low + 1) / (1 << STEPS)


def exponent_for_entropy(shares: DataFrame, share_of_most: float) -> float:
    """The largest exponent whose weights have at least ``share_of_most`` of the entropy of equal weights."""
    sources = shares.count()
    target = share_of_most * F.ln(F.lit(float(max(1, sources))))
    return bisect(shares, lambda a, mass, logs, up, down: F.ln(mass) - a * logs / mass >= target, rising=True)


def exponent_for_repeats(shares: DataFrame, most: float) -> float:
    """The smallest exponent for which no source is read more than ``most`` times when every source is read in full."""
    if shares.agg(F.max("share") / F.min("share")).first()[0] in (None, 1.0):
        return 0.0
    return bisect(shares, lambda a, mass, logs, up, down: up * down <= F.lit(float(most)), rising=False)


def budgets(shares: DataFrame, exponent: float, tokens: int | None) -> DataFrame:
    """``source, total, weight, budget``. Without ``tokens`` the mixture is the smallest that reads every source in full."""
    mass = F.pow(F.col("share"), F.lit(exponent))
    facts = shares.agg(F.sum(mass).alias("mass"), F.max(F.col("total") / mass).alias("most")).first()
    weight = mass / F.lit(facts["mass"] or 1.0)
    if tokens is None:
        every = (facts["most"] or 0.0) * (facts["mass"] or 0.0)
        budget = F.greatest("total", F.floor(weight * F.lit(every) + 0.5))
    else:
        budget = F.floor(weight * F.lit(float(tokens)) + 0.5)
    return shares.select("source", "total", weight.alias("weight"), budget.cast("long").alias("budget"))


def mix(
    docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", entropy: float | None = None,
    repeats: float | None = None, tokens: int | None = None, seed: str = "mix", keep: list[str] | None = None,
) -> DataFrame:
    """One row per copy of a document in the mixture: ``doc_id, source, tokens, epoch, block, mix_order``.

    Give ``entropy`` (share of the entropy of equal weights) or ``repeats`` (how often a source may be read at most);
    with neither, shares stay as they are. ``tokens`` is the size of the mixture; without it, it is the smallest one
    that reads every document at least once. ``keep`` returns these columns of ``docs`` as well.

    Sorting by ``mix_order`` (from 0 to 1) interleaves the sources by weight. A source's last document may exceed its
    budget. Tokens are words plus one, so null and empty texts count 1; a null source is a source; null ids share one
    place in the permutation; repeated rows are documents of their own; no documents give no rows. Columns of ``docs``
    that are called like a result are only read as what the parameters name.
    """
    extra = [F.col(f"`{c}`").alias(f"kept_{c}") for c in keep or []]
    given = docs.select(
        F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_tokens(F.col(f"`{text}`")).alias("tokens"), *extra
    )
    slim = settle(given.select("doc_id", "source", "tokens"))
    shares = source_shares(slim)
    if entropy is not None:
        exponent = exponent_for_entropy(shares, entropy)
    else:
        exponent = 1.0 if repeats is None else exponent_for_repeats(shares, repeats)
    plan = settle(budgets(shares, exponent, tokens))
    place = F.conv(F.substring(digest(seed, F.col("doc_id")), 1, 8), 16, 10).cast("long")
    blocks = F.ceil(F.col("total") / BLOCK_TOKENS)

    def in_blocks(rows: DataFrame) -> DataFrame:
        of_source = plan.select(F.col("source").alias("of"), blocks.alias("blocks"))
        return (
            rows.join(of_source, F.col("source").eqNullSafe(F.col("of"))).withColumn("block", F.shiftright(place * F.col("blocks"), 32)).drop("of", "blocks")
        )

    sizes = in_blocks(slim).groupBy("source", "block").agg(F.sum("tokens").alias("size"))
    order = settle(block_order(sizes, plan, seed))
    here = [F.col("source").eqNullSafe(F.col("of")), F.col("block") == F.col("at")]
    copies = in_blocks(given).join(order.withColumnsRenamed({"source": "of", "block": "at"}), here).drop("of", "at")
    inside = W.partitionBy("source", "block", "epoch").orderBy(digest(seed, F.col("doc_id"), F.col("epoch")), "tokens")
    before = F.col("before") + F.sum("tokens").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("tokens")
    placed = copies.withColumn("before", before).where(F.col("before") < F.col("budget"))
    return placed.select(
        "doc_id", "source", "tokens", "epoch", "block", (F.col("before") / F.col("budget")).alias("mix_order"),
        *[F.col(f"kept_{c}") for c in keep or []],
    )


def block_order(sizes: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """Blocks of every started epoch with the tokens ``before`` them in their source's stream.

    The order of an epoch is that of a hash. Running totals are taken inside ranges of the hash and over the totals of
    the ranges, so that no task holds all blocks of a source.
    """
    of_plan = plan.select(F.col("source").alias("of"), "total", "budget")
    epochs = F.ceil(F.col("budget") / F.col("total")).cast("int")
    rows = (
        sizes.join(of_plan, F.col("source").eqNullSafe(F.col("of"))).drop("of").where("budget > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
        .withColumn("key", digest(seed, F.col("source"), F.col("block"), F.col("epoch")))
        .withColumn("chunk", F.substring("key", 1, CHUNK_DIGITS))
    )
    over = W.partitionBy("source", "epoch").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)
    chunks = rows.groupBy("source", "epoch", "chunk").agg(F.sum("size").alias("chunk_size"))
    chunks = chunks.withColumn("chunk_before", F.sum("chunk_size").over(over) - F.col("chunk_size"))
    chunks = chunks.select(F.col("source").alias("of"), F.col("epoch").alias("in_epoch"), F.col("chunk").alias("in_chunk"), "chunk_before")
    inside = W.partitionBy("source", "epoch", "chunk").orderBy("key", "block").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("inner", F.sum("size").over(inside) - F.col("size"))
    match = [F.col("source").eqNullSafe(F.col("of")), F.col("epoch") == F.col("in_epoch"), F.col("chunk") == F.col("in_chunk")]
    placed = rows.join(chunks, match).withColumn("before", F.col("epoch") * F.col("total") + F.col("chunk_before") + F.col("inner"))
    return placed.where(F.col("before") < F.col("budget")).select("source", "block", "epoch", "before", "budget")


def mixed_documents(docs: DataFrame, repeats: float, seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, each at least once, with small sources repeated up to ``repeats`` times."""
    rows = mix(docs, repeats=repeats, seed=seed, keep=docs.columns)
    return rows.select(*[F.col(f"kept_{c}").alias(c) for c in docs.columns])
