"""Problem 8: a mixture of sources with target shares of all tokens, by thresholds on hash histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithocube.llm.tokens import VOCABULARY, token_counts
from lithocube.session import cut, small

#: Bits of the hash that one histogram resolves, and histograms, each within the bucket where the last one broke off.
BITS, ROUNDS = 12, 4


def source_budgets(tokens: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """source, target_share, share (scaled to those that can take part), tokens, max_repeats, budget.

    A source takes part if it has tokens, a share above 0 and may be used at least once. Several rows of one source
    count as the greatest of each column. Without `total` the mixture is the largest in which every share is met:
    no source needs more than max_repeats times its tokens.
    """
    t = targets.where("source is not null and target_share > 0 and not isnan(target_share) and max_repeats >= 1")
    t = t.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = tokens.where("source is not null and n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    t = cut(t.join(have, "source"))
    whole = t.agg(F.sum("target_share").alias("sum_share"))
    t = t.join(F.broadcast(whole)).withColumn("share", F.col("target_share") / F.col("sum_share"))  # one row
    most = t.agg(F.min(F.col("max_repeats") * F.col("tokens") / F.col("share")).alias("most"))
    size = F.col("most") if total is None else F.lit(float(total))
    t = t.join(F.broadcast(most))  # one row
    budget = F.least(F.col("share") * size, F.col("max_repeats") * F.col("tokens"))
    return cut(t.select("source", "target_share", "share", "tokens", "max_repeats", budget.alias("budget")))


def mix_sources(
    documents: DataFrame, targets: DataFrame, total: int | None = None, vocabulary: str = VOCABULARY, seed: int = 11
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, uses) of every document used, and the report of shares reached.

    A source whose budget is r times its tokens and a rest uses all its documents r times and, once more, those whose
    hash lies below a threshold. The threshold comes from a histogram of tokens by source and hash bucket; only the
    bucket in which the rest is used up is resolved further, four times, until single documents decide. Nothing is
    sorted; larger budgets use a superset of smaller ones.
    Report, one row per source of either table: target_share, share (target scaled to the sources taking part),
    tokens in the corpus, tokens used, share reached, documents, most uses of a document, max_repeats, longest document
    (a share is met to within half of it).
    - Sources without target, with a null share, a share of 0, or without tokens are not used, and the report says so.
    - Null and empty texts have no tokens and are not used. Null source is no source. Repeated doc_ids are decided
      alike. Empty tables give empty results.
    """
    d = token_counts(documents, "doc_id", "source", vocabulary=vocabulary)
    d = cut(d.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 64 - BITS * ROUNDS)))
    b = source_budgets(d, targets, total)
    full = F.floor(F.col("budget") / F.col("tokens") + 1e-9)
    plan = b.withColumn("full", full.cast("long")).withColumn("rest", F.greatest(F.lit(0.0), F.col("budget") - full * F.col("tokens")))
    # Level by level: `prefix` is the bucket within which the threshold lies, `rest` what is still to be filled in it.
    level = plan.select("source", F.lit(0).cast("long").alias("prefix"), "rest")
    for k in range(ROUNDS):
        shift = BITS * (ROUNDS - 1 - k)
        bucket = F.shiftrightunsigned("h", shift)
        rows = d.where("n_tokens > 0").join(small(level), "source")
        if k:
            rows = rows.where(F.shiftrightunsigned("h", shift + BITS) == F.col("prefix"))
        histogram = rows.groupBy("source", "rest", bucket.alias("bucket")).agg(F.sum("n_tokens").alias("n"))
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        histogram = histogram.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        # The last bucket that begins within the budget; on the last level it is used if that comes nearer to it.
        at = histogram.where(F.col("before") <= F.col("rest")).groupBy("source").agg(F.max(F.struct("bucket", "before", "rest", "n")).alias("b"))
        nearer = F.when(F.abs(F.col("b.before") + F.col("b.n") - F.col("b.rest")) < F.abs(F.col("b.before") - F.col("b.rest")), 1).otherwise(0)
        prefix = F.col("b.bucket") + (nearer if k == ROUNDS - 1 else 0)
        level = cut(at.select("source", prefix.alias("prefix"), (F.col("b.rest") - F.col("b.before")).alias("rest")))
    plan = cut(plan.join(level.select("source", F.col("prefix").alias("below")), "source"))
    uses = F.least(F.col("max_repeats").cast("long"), F.col("full") + F.when(F.col("h") < F.col("below"), 1).otherwise(0))
    mixed = d.where("n_tokens > 0").join(small(plan.select("source", "full", "below", "max_repeats")), "source").withColumn("uses", uses)
    mixed = mixed.where("uses > 0").select("doc_id", "source", "n_tokens", "uses")
    used = mixed.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens_used"), F.count(F.lit(1)).alias("documents_used"), F.max("uses").alias("most_uses")
    )
    everything = d.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"))
    asked = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    scaled = b.select("source", "share")
    report = asked.join(everything, "source", "full").join(scaled, "source", "left").join(used, "source", "left")
    whole = used.agg(F.sum("tokens_used").alias("all_used"))
    report = report.join(F.broadcast(whole))  # one row
    return mixed, report.select(
        "source", "target_share", "share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
        F.coalesce(F.try_divide("tokens_used", "all_used"), F.lit(0.0)).alias("share_reached"), F.coalesce("documents_used", F.lit(0)).alias("documents_used"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats", F.coalesce("longest", F.lit(0)).alias("longest"),
    )
