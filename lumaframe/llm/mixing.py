"""Mixing sources to target shares of all tokens."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.tokens import VOCABULARY, count_tokens
from lumaframe.session import shared_folder, stage

def source_name(source: Column) -> Column:
    """The source behind its spelling: case, outer blanks, and blank, dash or underscore don't count."""
    return F.nullif(F.regexp_replace(F.trim(F.lower(F.regexp_replace(source, r"[\s_-]+", " "))), " ", "_"), F.lit(""))


def rates(sources: DataFrame, total: float | None = None, least_epoch: float = 0.5) -> DataFrame:
    """source, rate: how often each document of a source is used on average, at most its cap.

    sources: source, available (tokens), share, cap, in any number. total: tokens of the mix. By default the largest total at
    which every source that has tokens reaches its share, but at least `least_epoch` of the eligible tokens, even if a source
    then falls short of its share; with 0 all shares are reached. Where caps bind, what they leave is shared among the other
    sources in proportion to their targets: every source gets its share times one scale, or its cap. The scale rises until it
    fits, in as many rounds as there are steps at which sources reach their caps; sums of the sources are all that is gathered.
    """
    usable = sources.filter("share > 0 AND cap > 0 AND available > 0").select("source", "available", F.col("share").cast("double").alias("share"), (F.col("available") * F.col("cap")).cast("double").alias("most"))
    usable = usable.withColumn("full_at", F.col("most") / F.col("share"))
    whole = usable.agg(F.min("full_at"), F.sum("share"), F.sum("available"), F.sum("most")).first()
    if whole[0] is None:
        return sources.sparkSession.createDataFrame([], "source string, rate double")
    least, shares, available, most = map(float, whole)
    total = min(max(least * shares, least_epoch * available) if total is None else total, most)
    scale = total / shares
    while True:
        full = F.col("full_at") <= scale * (1 + 1e-12)
        given, open_ = usable.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("share")))).first()
        raised = (total - (given or 0.0)) / open_ if open_ else math.inf
        if raised <= scale * (1 + 1e-12):
            break
        scale = raised
    given = F.least(F.col("most"), F.col("share") * scale) if scale < math.inf else F.col("most")
    return usable.select("source", (given / F.col("available")).alias("rate"))


def mix(documents: DataFrame, source_targets: DataFrame, total: float | None = None, seed: int = 11, least_epoch: float = 0.5, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The chosen documents (doc_id, source, tokens, copies) and the shares reached, one row per source of either table.

    A document is used floor(rate) times, and once more if its hash-seeded draw falls below the rate's fraction; so never
    more than max_repeats times. Only tokens per source are gathered; no document is moved. Sources are compared by
    source_name; targets of one source in several spellings add up, with the least cap. A null share or cap is 0. A
    document without source, or of a source without target, isn't used; a text without tokens carries nothing and isn't
    either. The report: source, target_share, max_repeats, n_documents, available_tokens, rate, mixed_tokens,
    actual_share. Repeated rows of a document are drawn alike. least_epoch: see rates. Empty tables give empty results.
    """
    spark = documents.sparkSession
    sized = count_tokens(documents.select("doc_id", source_name(F.col("source")).alias("source"), "text"), vocabulary=vocabulary)
    of_text = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("of_text")  # so that documents without id don't share one draw
    sized = stage(sized.select("doc_id", "source", "tokens", of_text), shared_folder(spark), "sized")
    named = source_targets.select(source_name(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("cap"))
    goals = named.filter("source IS NOT NULL").groupBy("source").agg(F.sum("share").alias("target_share"), F.min("cap").alias("max_repeats"))
    sums = sized.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("tokens").alias("available_tokens"))
    asked = goals.join(sums, "source").select("source", F.col("available_tokens").alias("available"), F.col("target_share").alias("share"), F.col("max_repeats").alias("cap"))
    folder = shared_folder(spark)
    table = stage(rates(stage(asked, folder, "asked"), total, least_epoch), folder, "rates")
    draw = (F.pmod(F.xxhash64("doc_id", "of_text", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    copies = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    chosen = sized.filter("tokens > 0").join(table, "source").select("doc_id", "source", "tokens", copies.alias("copies")).filter("copies > 0")
    reached = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies").cast("bigint")).alias("mixed_tokens"))
    whole = reached.agg(F.sum("mixed_tokens").alias("whole"))
    report = sums.join(goals, "source", "full").join(table, "source", "left").join(reached, "source", "left").crossJoin(F.broadcast(whole)).select(
        "source",
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
        F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"),
        F.coalesce("rate", F.lit(0.0)).alias("rate"),
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        (F.coalesce("mixed_tokens", F.lit(0)) / F.nullif("whole", F.lit(0))).alias("actual_share"),
    )
    return chosen, report
