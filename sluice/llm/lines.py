"""Line dedup: lines that many documents share stay in one document only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import SPACE, ascii_lower, join_salted, let, written


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _keys(lines: Column, min_chars: int) -> Column:
    """(place, 128 bits of hash) of every line whose key is long enough."""
    keyed = F.transform(lines, lambda x, i: let(line_key(x), lambda k: F.struct(i.alias("pos"), F.char_length(k).alias("n"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"))))
    return F.filter(keyed, lambda s: s["n"] >= min_chars)


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, found: str = "_found") -> DataFrame:
    """docs plus a struct `found` of `n_lines`, `n_dropped` and `kept`, the text without the lines whose key has at least min_chars code
    points and is in at least min_docs documents; the document with the largest id that holds a key keeps its lines.

    A null or empty text is one empty line. A null id counts as below every other. Rows alike in id are one
    document when documents are counted; rows alike in id and text get the same result, and each stays. An empty
    table gives an empty table. Other columns pass through untouched; one that is called as `found` says is an error.

    Only hashes are shuffled for counting, dealt by (key, id) first, so that a line in every document spreads, then
    counted per key with partial sums. One more shuffle moves the texts, to meet the places to drop.
    """
    if found in docs.columns:
        raise ValueError(f"there is a column {found} already")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    row = [F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"), F.octet_length(F.col(text_col)).alias("_tn")]
    own = docs.select(*row, F.explode(_keys(lines, min_chars)).alias("_k")).select("_id", "_th", "_tn", "_k.pos", "_k.h1", "_k.h2")
    per_doc = docs.select(row[0], F.explode(F.array_distinct(F.transform(_keys(lines, min_chars), lambda s: F.struct(s["h1"].alias("h1"), s["h2"].alias("h2"))))).alias("_k")).select("_id", "_k.h1", "_k.h2")
    counted = per_doc.distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("_id").alias("keeper")).where(F.col("n_docs") >= min_docs)
    counted = written(counted)
    total = counted.agg(F.sum("n_docs")).first()[0] or 0
    places = (
        join_salted(own, counted, ["h1", "h2"], "n_docs", total)
        .where(~F.col("_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("_id").alias("_m_id"), F.col("_th").alias("_m_th"), F.col("_tn").alias("_m_tn"))
        .agg(F.array_sort(F.collect_set("pos")).alias("_drop"))
    )
    texts = docs.withColumns({"_sluice_th": row[1], "_sluice_tn": row[2]})
    places = places.withColumnsRenamed({"_m_id": "_sluice_id", "_m_th": "_sluice_mth", "_m_tn": "_sluice_mtn", "_drop": "_sluice_drop"})
    on = texts[id_col].eqNullSafe(places["_sluice_id"]) & texts["_sluice_th"].eqNullSafe(places["_sluice_mth"]) & texts["_sluice_tn"].eqNullSafe(places["_sluice_mtn"])
    met = texts.join(places, on, "left").drop("_sluice_id", "_sluice_mth", "_sluice_mtn", "_sluice_th", "_sluice_tn")
    gaps = lambda s: F.transform(  # noqa: E731  the runs of lines between two dropped ones
        F.sequence(F.lit(0), F.size(s["cut"]) - 2),
        lambda j: F.slice(s["lines"], F.get(s["cut"], j) + 2, F.get(s["cut"], j + 1) - F.get(s["cut"], j) - 1),
    )
    cut = F.concat(F.array(F.lit(-1)), F.col("_sluice_drop"), F.array(F.size(lines)))
    kept = F.when(F.col("_sluice_drop").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(let(F.struct(lines.alias("lines"), cut.alias("cut")), lambda s: F.array_join(F.flatten(gaps(s)), "\n")))
    return met.withColumn(found, F.struct(F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("_sluice_drop"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))).drop("_sluice_drop")


def query(spark, docs: DataFrame) -> DataFrame:
    out = drop_shared_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "_found.n_lines", "_found.n_dropped", F.sha2("_found.kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.line, k.pos, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
