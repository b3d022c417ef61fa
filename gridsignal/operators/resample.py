"""Splits, folds, class balancing and replicate tests.

Random choices are keyed hashes of (seed, row, replicate), so they do not depend on partitioning, retries or engine.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridsignal.operators.groups import attach, join_groups
from gridsignal.operators.metrics import ranking_metrics
from gridsignal.operators.neighbours import nearest
from gridsignal.operators.ordering import BLOCK_ROWS, HASH_SPAN, hash_draw, range_chunks, running_totals, smallest_draws, with_position
from gridsignal.session import settle

# Seed, test share, folds, neighbours, replicates.
SEED = 42
TEST_SHARE = 0.3
FOLDS = 5
SMOTE_K = 5
BOOTSTRAPS = 200
PERMUTATIONS = 1000


def stratified_split(
    df: DataFrame, label: str = "y", row_id: str = "row_id", test: float = TEST_SHARE, seed: int = SEED,
    out: str = "split",
) -> DataFrame:
    """Mark rows ``train`` or ``test`` with equal class shares; ``ceil(test * n)`` test rows in total.

    The rows of a class with the smallest keyed hashes are the test rows; the class quota is the rounded-down share, and
    the classes with the largest remainders give one more row until the total is reached. A missing class is a class.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    exact = F.col("_n") * F.lit(test)
    order = W.orderBy(F.col("_rest").desc(), F.col(label).asc())  # one row per class
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    quota = (
        sizes.withColumns({"_base": F.floor(exact), "_rest": F.round(exact - F.floor(exact), 9)})
        .withColumn("_extra", F.ceil(F.round(F.sum("_n").over(everything) * F.lit(test), 9)) - F.sum("_base").over(everything))
        .withColumn("_quota", F.col("_base") + (F.row_number().over(order) <= F.col("_extra")).cast("long"))
        .select(label, "_quota")
    )
    drawn = df.withColumn("_draw", hash_draw(seed, F.col(row_id)))
    chosen = smallest_draws(drawn, [label], "_draw", [row_id], quota, "_chosen")
    return chosen.withColumn(out, F.when(F.col("_chosen"), "test").otherwise("train")).drop("_draw", "_chosen")


def reassemble(train: DataFrame, test: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Full set in its original order from the two splits."""
    return train.unionByName(test).orderBy(row_id)


def time_series_folds(
    df: DataFrame, k: int = FOLDS, pos: str = "pos", by: Sequence[str] = (), n: int | None = None
) -> DataFrame:
    """Expanding splits: ``(fold, role)`` copies of the rows, each fold trained on everything before its test block."""
    size = F.lit(n) if n is not None else None
    sized = df.withColumn("_n", size) if n is not None else attach(df, by, {"_n": F.count(F.lit(1))})
    block = F.floor(F.col("_n") / (k + 1))
    folds = F.array(*[F.lit(i) for i in range(k)])
    fanned = sized.withColumn("fold", F.explode(folds)).withColumn("_from", F.col("_n") - block * (k - F.col("fold")))
    role = F.when(F.col(pos) < F.col("_from"), "train").when(F.col(pos) < F.col("_from") + block, "test")
    return fanned.withColumn("role", role).where(F.col("role").isNotNull()).drop("_n", "_from")


def with_class_weight(df: DataFrame, label: str = "y", by: Sequence[str] = (), out: str = "weight") -> DataFrame:
    """Weight of the positive class: negatives over positives; 1 for the others."""
    counted = attach(df, by, {"_p": F.count_if(F.col(label) == 1), "_n": F.count_if(F.col(label) == 0)})
    return counted.withColumn(out, F.when(F.col(label) == 1, F.col("_n") / F.col("_p")).otherwise(F.lit(1.0))).drop(
        "_p", "_n"
    )


def smote(
    df: DataFrame, label: str = "y", row_id: str = "row_id", features: str = "features", k: int = SMOTE_K,
    seed: int = SEED, id_grain: int = 1 << 16,
) -> DataFrame:
    """Oversample the smaller class to parity with points between a row and one of its ``k`` nearest class mates.

    ``features`` is an array of doubles. New rows have ``synthetic = true`` and count up from 0 in ``row_id``. A smaller
    class of fewer than two rows has no neighbours: the rows then stay as they are, without new ones.
    """
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    small, large = sorted((0, 1), key=lambda c: (counts.get(c, 0), c))
    have, need = counts.get(small, 0), counts.get(large, 0) - counts.get(small, 0)
    real = df.select(row_id, label, F.col(features).cast("array<double>").alias(features), F.lit(False).alias("synthetic"))
    if need == 0 or have < 2:
        return real
    k = min(k, have - 1)
    members = real.where(F.col(label) == small).select(F.col(row_id).alias("id"), F.col(features).alias("x"))
    near = nearest(members, k, seed)
    placed = with_position(members, (), "id", float(id_grain), "_base")
    draws = df.sparkSession.range(need).select(
        F.col("id").alias("_j"),
        F.pmod(hash_draw(seed, "base", F.col("id")), F.lit(have)).alias("_base"),
        (F.pmod(hash_draw(seed, "near", F.col("id")), F.lit(k)) + 1).cast("int").alias("rank"),
        (hash_draw(seed, "gap", F.col("id")) / F.lit(float(HASH_SPAN))).alias("_u"),
    )
    # Each draw meets one row, one neighbour entry and one neighbour row.
    with_base = draws.join(placed, "_base").join(near.select("id", "rank", "neighbour"), ["id", "rank"])
    with_both = with_base.join(members.select(F.col("id").alias("neighbour"), F.col("x").alias("_nx")), "neighbour")
    point = F.zip_with("x", "_nx", lambda a, b: a + F.col("_u") * (b - a))
    new = with_both.select(
        F.col("_j").alias(row_id), F.lit(small).cast(df.schema[label].dataType).alias(label), point.alias(features),
        F.lit(True).alias("synthetic"),
    )
    return real.unionByName(new)


def bootstrap_auc(
    df: DataFrame, score: str = "p", label: str = "y", pos: str = "pos", replicates: int = BOOTSTRAPS,
    seed: int = SEED, mode: str = "model",
) -> DataFrame:
    """AUC of ``replicates`` resamples with replacement: ``(replicate, auc)``.

    ``mode="random"`` scores the drawn rows at random, the no-skill case. Draws are generated, not collected: draw
    ``j`` of replicate ``b`` takes the row at a hashed position, met by an equi-join on the dense position.
    """
    rows = settle(df.select(pos, F.col(score).cast("double").alias("_score"), F.col(label).alias("_label")))
    n = rows.count()
    draws = df.sparkSession.range(n * replicates).select(
        F.floor(F.col("id") / n).cast("int").alias("replicate"),
        F.pmod(hash_draw(seed, "boot", F.col("id")), F.lit(n)).alias(pos),
        F.col("id").alias("_draw"),
    )
    if mode == "random":
        noise = draws.withColumn("_score", hash_draw(seed, "noise", F.col("_draw")))
        drawn = noise.join(rows.select(pos, "_label"), pos).withColumn("_times", F.lit(1).cast("long"))
    else:
        # Repeated draws of one row in a replicate are folded and stay folded: the row counts that often.
        drawn = draws.groupBy("replicate", pos).agg(F.count(F.lit(1)).alias("_times")).join(rows, pos)
    return ranking_metrics(drawn, "_score", "_label", ["replicate"], "_times").select("replicate", "auc")


def draw_cuts(fanned: Callable[[], DataFrame], row_id: str, n: int, rows: int, quota: int, sigmas: float = 8.0) -> DataFrame:
    """``permutation, cut``: the ``quota``-th smallest ``(draw, row_id)`` of each permutation, settled.

    Draws are uniform, so it lies near the same share of their span: what is below a band around it is counted, and only the
    draws in the band, some multiples of the square root of ``rows``, are put in order. A band that misses is widened.
    """
    share = quota / rows
    spread = sigmas * (rows * share * (1 - share)) ** 0.5 / rows + 16.0 / rows
    low, high = int(max(0.0, share - spread) * HASH_SPAN), int(min(1.0, share + spread) * HASH_SPAN)
    draw = F.col("_draw")
    counted = fanned().where(draw <= high).groupBy("permutation").agg(
        F.count_if(draw < low).alias("_below"),
        F.array_sort(F.collect_list(F.when(draw >= low, F.struct("_draw", row_id)))).alias("_band"),
    )
    cuts = settle(counted.select("permutation", F.when(F.col("_below") < quota, F.get("_band", (F.lit(quota - 1) - F.col("_below")).cast("int"))).alias("cut")))
    whole = cuts.agg(F.count("cut")).first()[0] == n
    return cuts if whole or spread >= 1 else draw_cuts(fanned, row_id, n, rows, quota, 8 * sigmas)


def permutation_metrics(
    df: DataFrame, score: str = "p", label: str = "y", row_id: str = "row_id", n: int = PERMUTATIONS, seed: int = SEED
) -> DataFrame:
    """AUC and AP under ``n`` label permutations: ``(permutation, auc, ap)``.

    A permutation gives the positive label to as many rows as have it now, those with the smallest hash draws. The order of
    the scores is the same in all of them: it is worked out once, and a permutation only adds up its positive rows. Rows
    are multiplied twice, to find the last of these draws and to label, and never sorted.
    """
    spark = df.sparkSession
    rows = settle(df.select(row_id, F.col(score).alias("_score"), F.col(label).cast("long").alias("_y")))
    facts = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("_y"), F.lit(0)).alias("quota"), F.count("_score").alias("scored")).first()
    every = spark.range(n).select(F.col("id").cast("int").alias("permutation"))
    if not facts.quota:
        return every.select("permutation", F.lit(None).cast("double").alias("auc"), F.lit(None).cast("double").alias("ap"))
    folded = range_chunks(rows.where("_score IS NOT NULL").groupBy("_score").agg(F.count(F.lit(1)).alias("_same")), ["_score"])
    ranks = running_totals(folded, (), "_chunk", ["_score"], {"_upto": F.col("_same")}, descending=True)
    # rows are spread before they are multiplied: a small table would otherwise be fanned out by one task
    tasks = max(spark.sparkContext.defaultParallelism, -(-facts.rows // BLOCK_ROWS))
    placed = settle(join_groups(rows.select(row_id, "_score"), ranks, ["_score"], "left").repartition(tasks, row_id))

    def fanned() -> DataFrame:
        many = placed.withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return many.withColumn("_draw", hash_draw(seed, F.col("permutation"), F.col(row_id)))

    cuts = draw_cuts(fanned, row_id, n, facts.rows, facts.quota)
    chosen = fanned().join(cuts, "permutation").where((F.struct("_draw", row_id) <= F.col("cut")) & F.col("_upto").isNotNull())
    table = settle(chosen.groupBy("permutation", "_chunk", "_score", "_upto", "_same").agg(F.count(F.lit(1)).alias("_pos")))
    ranked = running_totals(table, ["permutation"], "_chunk", ["_score"], {"_tp": F.col("_pos")}, descending=True)
    positives = F.sum("_pos")
    negatives = F.lit(facts.scored) - positives
    # negatives at higher scores and half of those at the same one
    ahead = F.col("_upto") - F.col("_tp") - (F.col("_same") - F.col("_pos")) / 2.0
    metrics = ranked.groupBy("permutation").agg(
        F.when(negatives > 0, 1.0 - F.sum(F.col("_pos") * ahead) / (positives.cast("double") * negatives)).alias("auc"),
        (F.sum(F.col("_pos") * F.col("_tp") / F.col("_upto")) / positives).alias("ap"),
    )
    return every.join(metrics, "permutation", "left")


def permutation_test(
    df: DataFrame, score: str = "p", label: str = "y", row_id: str = "row_id", n: int = PERMUTATIONS, seed: int = SEED
) -> DataFrame:
    """``(metric, observed, null_mean, p_value)`` for AUC and AP, right-tailed."""
    seen = ranking_metrics(df, score, label).agg(F.first(F.struct("auc", "ap"))).scalar()
    null = permutation_metrics(df, score, label, row_id, n, seed).withColumn("_seen", seen)
    long = null.select(
        F.explode(
            F.array(
                F.struct(F.lit("AUC").alias("metric"), F.col("auc").alias("null"), F.col("_seen.auc").alias("observed")),
                F.struct(F.lit("AP").alias("metric"), F.col("ap").alias("null"), F.col("_seen.ap").alias("observed")),
            )
        ).alias("_m")
    ).select("_m.*")
    tolerance = F.lit(1e-12)  # equal values computed in another order still count as reached
    return long.groupBy("metric").agg(
        F.max("observed").alias("observed"),
        F.avg("null").alias("null_mean"),
        F.avg((F.col("null") >= F.col("observed") - tolerance).cast("int")).alias("p_value"),
    )
