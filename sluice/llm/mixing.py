"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis, 2006)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import join_small, let, n_words, written

#: Buckets of the key range in which sizes are pre-summed: BUCKETS, or more so that one holds about ROWS rows at most.
BUCKETS, ROWS = 4096, 50_000


def quality_weight(text: Column, words: Column) -> Column:
    """0.5 to 1.5: half plus the product of three shares that prose has high and junk low. How many of the text's code points are
    lower-case letters or spaces; how near the mean of its `words` is to 3 to 10 code points; how many of its lines are no repeats."""
    n = F.char_length(text)
    plain = (n - F.char_length(F.regexp_replace(text, r"[\p{Ll} ]++", ""))) / n
    mean = (n - words + 1) / F.greatest(words, F.lit(1))
    length = F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean / 3, 2 - mean / 10))
    fresh = let(F.split(text, "\n", -1), lambda lines: F.size(F.array_distinct(lines)) / F.size(lines))
    return F.when(n > 0, F.lit(0.5) + plain * length * fresh).otherwise(F.lit(0.5))


def sampling_key(id_col: Column, text: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight, with u in (0, 1) hashed from id, text and seed: the same in every run."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col, text), 11).cast("double") + 0.5) / float(2**53)
    return -F.log(u) / weight


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """sizes (source, source_size) plus target. Sources in code point order, null last, weigh `weights` in turn and
    share `share` of all sizes; a target stops at cap * source_size and the excess goes to the others by weight.

    The fixed point is min(cap * size, level * weight) with one level for all; it is read off prefix sums over the
    sources in order of cap * size / weight. One row per source: a table of labels, sorted whole.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    fill = W.orderBy("_full_at", "_rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = sizes.withColumns({"_w": weight, "_rank": F.row_number().over(order)}).withColumn("_cap", F.col("source_size") * float(cap)).withColumn("_full_at", F.col("_cap") / F.col("_w"))
    everything = W.partitionBy()
    t = t.withColumns({"_caps": F.sum("_cap").over(fill), "_ws": F.sum("_w").over(fill), "_all": F.sum("source_size").over(everything) * float(share), "_all_w": F.sum("_w").over(everything)})
    level = (F.col("_all") - (F.col("_caps") - F.col("_cap"))) / (F.col("_all_w") - (F.col("_ws") - F.col("_w")))
    t = t.withColumn("_level", F.when(level <= F.col("_full_at"), level)).withColumn("_level", F.max("_level").over(everything))
    return t.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))


def thresholds(keyed: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per source (_sluice_of) of keyed (_id, _source, _size, _key, _th): its size, target and whole epochs, and the last
    row of its fractional epoch, _sluice_cut (key, id, hash); null where none is taken.

    Sizes are summed per source and key bucket first (one partial row per source, bucket and task, so a hot source
    spreads), prefix sums run over one row per source and bucket, and only the bucket in which the budget ends, of about
    ROWS rows at most, is sorted row by row.
    """
    buckets = max(BUCKETS, keyed.count() // ROWS)
    bucket = F.least(F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * buckets), F.lit(buckets - 1)).cast("int")
    keyed = keyed.withColumn("_bucket", bucket)
    sums = written(keyed.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum"), F.max(F.struct("_key", "_id", "_th")).alias("_last")))
    size = sums.groupBy(F.col("_source").alias("source")).agg(F.sum("_sum").alias("source_size"))
    plan = targets(size, weights, share, cap).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    plan = written(plan.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")))
    up_to = W.partitionBy("_source").orderBy("_bucket")
    b = sums.withColumn("_cum", F.sum("_sum").over(up_to))
    b = join_small(b, plan.select("source", "budget"), "_source", "source")
    whole = b.where(F.col("_cum") <= F.col("budget")).groupBy("_source").agg(F.max("_bucket").alias("_b"), F.max("_cum").alias("_taken"), F.max("_last").alias("_whole_last"))
    ends = b.where(F.col("_cum") > F.col("budget")).groupBy("_source").agg(F.min("_bucket").alias("_end"), F.first("budget").alias("budget"))
    ends = written(ends.join(whole, ends["_source"].eqNullSafe(whole["_source"]), "left").select(ends["_source"].alias("_src"), "_end", "budget", F.coalesce("_taken", F.lit(0)).alias("_taken")))
    inside = join_small(keyed, ends, "_source", "_src").where(F.col("_bucket") == F.col("_end"))
    run = W.partitionBy("_source").orderBy("_key", "_id", "_th").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = inside.withColumn("_cum", F.sum("_size").over(run) + F.col("_taken")).where(F.col("_cum") - F.col("_size") / 2.0 <= F.col("budget"))
    last = inside.groupBy("_source").agg(F.max(F.struct("_key", "_id", "_th")).alias("_cut")).unionByName(whole.select("_source", F.col("_whole_last").alias("_cut"))).groupBy("_source").agg(F.max("_cut").alias("_cut"))
    met = plan.join(last, plan["source"].eqNullSafe(last["_source"]), "left")
    return met.select(F.col("source").alias("_sluice_of"), F.col("source_size").alias("_sluice_size"), F.col("target").alias("_sluice_target"), F.col("epochs").alias("_sluice_epochs"), F.when(F.col("budget") > 0, F.col("_cut")).alias("_sluice_cut"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11, to: str = "_sluice_mix") -> DataFrame:
    """docs plus a struct `to` of _id, _source, _size, _key and _th. Two steps, so that words are counted once."""
    text, size = F.col(text_col), F.col(f"{to}_size")
    sized = docs.withColumn(f"{to}_size", n_words(text))
    parts = [F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), size.alias("_size"), sampling_key(F.col(id_col), text, quality_weight(text, size), seed).alias("_key"), F.xxhash64(text).alias("_th")]
    return sized.withColumn(to, F.struct(*parts)).drop(f"{to}_size")


def times(row: DataFrame, cut: DataFrame, source_col: str, at: Column) -> DataFrame:
    """row plus the columns of thresholds and _sluice_times, how often the mix takes a row whose (key, id, hash) is at."""
    met = join_small(row, cut, source_col, "_sluice_of")
    return met.withColumn("_sluice_times", (F.col("_sluice_epochs") + F.coalesce(at <= F.col("_sluice_cut"), F.lit(False)).cast("long")).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11) -> DataFrame:
    """docs as mixed: every row as often as the mix takes it. Sizes are words.

    Each source's taken words come within half a document of its target: whole epochs come first, then documents in
    order of their exponential keys, scaled by quality_weight, up to the budget. Null texts have size 0; documents of
    size 0 are taken with the whole epochs and those within the fraction. A null source is a source, last in order.
    Rows alike in id and text have one key and are decided together. An empty table gives an empty table. Columns of
    other names pass through.
    """
    table = written(keyed(docs, id_col, text_col, source_col, seed))  # with the texts, so that no text is weighed twice
    cut = written(thresholds(table.select("_sluice_mix.*")))
    out = times(table, cut, source_col, F.struct(*[F.col("_sluice_mix")[c].alias(c) for c in ("_key", "_id", "_th")])).where(F.col("_sluice_times") > 0)
    own = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*own, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_sluice_times"))).alias("_sluice_copy")).drop("_sluice_copy")


def query(spark, docs: DataFrame) -> DataFrame:
    row = written(keyed(docs).select("_sluice_mix.*"))
    out = times(row, written(thresholds(row)), "_source", F.struct("_key", "_id", "_th"))
    return out.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_sluice_size").alias("source_size"), F.col("_sluice_target").alias("target"), (F.col("_size") * F.col("_sluice_times")).alias("taken"))
