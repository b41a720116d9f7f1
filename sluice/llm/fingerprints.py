"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import let

#: 32-bit lanes that tell multisets of paragraphs apart, and lanes that hold sums of signs hashed from word runs.
EXACT, SKETCH = 8, 128
RUN = 3
PAIR = 0x0000000100000001
LOW = 0xFFFFFFFF


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def features(paragraph: Column) -> Column:
    """Hashes of the runs of RUN words of a paragraph; of the whole paragraph where it has fewer."""
    return let(
        F.split(paragraph, " ", -1),
        lambda w: F.when(F.size(w) < RUN, F.array(F.xxhash64(F.lit(RUN), paragraph))).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - RUN), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(RUN)]))),
    )


def lane_sums(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys plus `lanes`, the fingerprint of each row's text: EXACT + SKETCH sums modulo 2**32.

    A paragraph's vector is its hash under EXACT / 2 seeds, as 32-bit numbers, then for each of SKETCH signs the
    number of its features that have it, then the number of its features. Vectors of paragraphs are summed; so a
    text's vector doesn't depend on their order, and paragraphs can be added and taken away (see combine).
    Every sum is one row per text and task before any shuffle; where texts is already dealt by one of keys, none follows.
    """
    p = texts.select(*keys, F.explode(paragraphs(F.col(text_col))).alias("_p"))
    p = p.select(*keys, *[F.xxhash64(F.lit(100 + i), "_p").alias(f"_e{i}") for i in range(EXACT // 2)], F.posexplode(features(F.col("_p"))).alias("_pos", "_h"))
    p = p.withColumn("_g", F.xxhash64("_h"))
    once = lambda c: F.when(F.col("_pos") == 0, c).otherwise(F.lit(0))
    exact = [F.sum(once(part)).alias(f"x{2 * i + k}") for i in range(EXACT // 2) for k, part in enumerate((F.col(f"_e{i}").bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(F.col(f"_e{i}"), 32)))]
    sketch = [F.sum(F.shiftrightunsigned(F.col(h), j).bitwiseAND(F.lit(PAIR))).alias(f"s{h}{j}") for h in ("_h", "_g") for j in range(32)]
    sums = p.groupBy(*keys).agg(*exact, *sketch, F.count(F.lit(1)).alias("_features"))
    lanes = [F.col(f"x{i}") for i in range(EXACT)] + [f(F.col(f"s{h}{j}")) for h in ("_h", "_g") for j in range(32) for f in (lambda c: c, lambda c: F.shiftrightunsigned(c, 32))] + [F.col("_features")]
    return sums.select(*keys, F.array(*[c.bitwiseAND(F.lit(LOW)) for c in lanes]).alias("lanes"))


def to_hex(lanes: Column) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def from_hex(fingerprint: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), (F.length(fingerprint) / 8).cast("int") - 1), lambda i: F.conv(F.substring(fingerprint, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of the paragraphs of a and b together; with sign -1, of a without those of b."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda s: (s["a"] + sign * s["b"]).bitwiseAND(F.lit(LOW)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the cosine of the two vectors of signed sums, none below 0; 1 just where the fingerprints are equal."""
    signs = lambda x: F.transform(F.slice(x, EXACT + 1, SKETCH), lambda v: (2 * v - F.element_at(x, -1)).cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
    cos = let(F.struct(signs(a).alias("a"), signs(b).alias("b")), lambda s: dot(s["a"], s["b"]) / F.sqrt(F.greatest(dot(s["a"], s["a"]) * dot(s["b"], s["b"]), F.lit(1.0))))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.999999), cos)))


def _bucketed(docs: DataFrame, n: int) -> tuple[DataFrame, list[int], list[int]]:
    """docs (_k, ...) plus _bucket, ascending in _k, cut at n quantiles of _k; the buckets' numbers and largest _k, ascending."""
    q = docs.agg(F.percentile_approx("_k", [i / n for i in range(1, n)], 10 * n).alias("q")).first()["q"] if n > 1 else None
    cuts = sorted(set(q or []))
    step = max(1, int(len(cuts) ** 0.5))
    coarse = cuts[step - 1 :: step]
    # two short searches over the cuts instead of one long one
    at = F.size(F.filter(F.array(*map(F.lit, coarse)).cast("array<bigint>"), lambda c: c <= F.col("_k"))) if coarse else F.lit(0)
    fine = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    bucket = at * step + F.size(F.filter(F.slice(fine, at * step + 1, F.lit(step)), lambda c: c <= F.col("_k")))
    out = docs.withColumn("_bucket", bucket.cast("int"))
    heads = sorted((r["_bucket"], r["m"]) for r in out.groupBy("_bucket").agg(F.max("_k").alias("m")).collect())  # one row a bucket
    return out, [b for b, _ in heads], [m for _, m in heads]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs plus `_next`, the text of the document with the next smaller id; after the smallest, of the largest.

    Rows are dealt by range of id into a number of buckets that follows the cluster's partitions. Each bucket also
    gets the first rows of the bucket after it, so one shuffle serves, and no task sees more than its range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_k"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows, buckets, heads = _bucketed(rows, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not buckets:
        return rows.select("_id", "_k", "_text", F.lit(0).alias("_bucket"), F.lit(0).alias("_guest"), F.lit("").alias("_next"), F.lit(0).alias("_rn"))
    guests = [(heads[i - 1], buckets[i], 1) for i in range(1, len(buckets))] + [(heads[-1], buckets[0], 2)]
    to = F.broadcast(spark.createDataFrame(guests, "_head bigint, _to int, _guest int"))
    guest = rows.where(F.col("_k").isin(sorted(set(heads)))).join(to, F.col("_k") == F.col("_head")).select("_id", "_k", "_text", F.col("_to").alias("_bucket"), "_guest")
    both = rows.select("_id", "_k", "_text", "_bucket", F.lit(0).alias("_guest")).unionByName(guest)
    order = W.partitionBy("_bucket").orderBy("_guest", F.col("_k").desc(), "_text")
    return both.withColumns({"_next": F.lead("_text").over(order), "_rn": F.row_number().over(order)})


def fingerprint(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys plus `fingerprint`, lower-case hex of the lanes, per row of docs; keys tell rows apart. A null text is an
    empty one, and an empty one has one empty paragraph. Equal multisets of paragraphs have equal fingerprints."""
    return lane_sums(docs.select(*keys, text_col), keys, text_col).select(*keys, to_hex(F.col("lanes")).alias("fingerprint"))


def edits_and_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its fingerprint, that of its edited text (the last third of its code points replaced by the
    first as many of the next document), and the likeness to both the edited text and the next document.

    Rows alike in id follow each other in order of text; a null id counts as below every other; a single row is its
    own next. Null texts are empty. An empty table gives an empty table.
    """
    rows = with_next(docs, id_col, text_col)
    n = F.char_length("_text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumns({"_n": n.cast("long"), "_edited": F.concat(F.substring("_text", F.lit(1), n - cut), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), cut))})
    # guests give their fingerprint to the row before them, and have no edited text
    own = F.array(F.struct(F.lit(0).alias("w"), F.col("_text").alias("t"), F.lit(None).cast("string").alias("sha")))
    pair = F.concat(own, F.array(F.struct(F.lit(1).alias("w"), F.col("_edited").alias("t"), F.sha2("_edited", 256).alias("sha"))))
    each = rows.select("_bucket", "_rn", "_guest", "_id", "_n", F.explode(F.when(F.col("_guest") == 0, pair).otherwise(own)).alias("_v"))
    keys = ["_bucket", "_rn", "_guest", "_id", "_n", "_w", "_sha"]
    each = each.select(*keys[:5], F.col("_v.w").alias("_w"), F.col("_v.sha").alias("_sha"), F.col("_v.t").alias("_t"))
    order = W.partitionBy("_bucket").orderBy("_rn", "_w")
    met = lane_sums(each, keys, "_t").withColumns({"_e": F.lead("lanes", 1).over(order), "_x": F.lead("lanes", 2).over(order), "_esha": F.lead("_sha", 1).over(order)})
    return met.where((F.col("_w") == 0) & (F.col("_guest") == 0)).select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_chars"), F.col("_esha").alias("edited_sha256"), to_hex(F.col("lanes")).alias("fingerprint"), to_hex(F.col("_e")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("_e")).alias("near_edited"), likeness(F.col("lanes"), F.col("_x")).alias("near_next"),
    )


def query(spark, docs: DataFrame) -> DataFrame:
    return edits_and_neighbours(docs)
