"""Toxicity: a linear classifier whose scores are held still when identity terms are swapped (counterfactual logit pairing)."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import mapped, written
from sluice.llm.words import ODD, Runs, mixed, split

#: Hash buckets of word parts; those the classifier keeps; labelled rows that it learns from, at most.
BUCKETS, KEEP, LEARN_FROM = 1 << 20, 4096, 20_000
#: Weights of the penalties on score changes under swaps, and on squared weights.
FAIR, RIDGE = 1.0, 1e-4
#: The score from which a text is called toxic.
CUT = 0.7
#: Words of one list are swapped for each other.
IDENTITIES = (
    ("women", "men", "girls", "boys", "trans"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "refugees", "foreigners", "citizens", "locals"),
    ("disabled", "deaf", "blind", "autistic", "elderly", "young"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("frauen", "männer"), ("muslime", "christen", "juden"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
_GROUP = {w: (g, k) for g, ws in enumerate(IDENTITIES) for k, w in enumerate(ws)}
_TERM = re.compile(r"\b(" + "|".join(sorted(map(re.escape, _GROUP), key=len, reverse=True)) + r")\b", re.I)


def swapped(text: str) -> str | None:
    """text with each identity term replaced by the next of its list; None where it names none."""
    out, n = _TERM.subn(lambda m: IDENTITIES[(g := _GROUP[m[0].lower()])[0]][(g[1] + 1) % len(IDENTITIES[g[0]])], text)
    return out if n else None


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def _features(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word's place) of every run of letters in the words and of its beginnings of 3 to 6 letters."""
    runs = Runs(distinct)
    at, size = runs.start, runs.size
    buckets, owners = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), np.uint64)
        for k in range(6):
            more = size > k
            h = np.where(more, mixed(h * ODD + runs.codes[np.minimum(at + k, len(runs.codes) - 1)]), h)
            if k >= 2:
                keep = size > k
                buckets.append(mixed(h[keep] + np.uint64(k + 1)))
                owners.append(runs.owner[keep])
        if len(at):
            inside = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(runs.letter, mixed(runs.codes + ODD * _places(runs)), np.uint64(0)), dtype=np.uint64)])
            whole = mixed(h + (inside[at + size] - inside[at]) * ODD + size.astype(np.uint64))
            buckets.append(whole)
            owners.append(runs.owner)
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (np.concatenate(buckets) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owners)


def _places(runs: Runs) -> np.ndarray:
    """Of every code point, how far it is into its run."""
    n = np.zeros(len(runs.codes) + 1, np.int64)
    n[runs.start] = 1
    run = np.cumsum(n[:-1]) - 1
    return (np.arange(len(runs.codes)) - runs.start[np.maximum(run, 0)]).astype(np.uint64)


def _in_rows(texts, chosen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) for each row and feature in it, once; only features chosen (place by bucket, -1: none), all if None."""
    import pyarrow as pa
    import pyarrow.compute as pc

    distinct, place, at = split(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    if not distinct:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bucket, owner = _features(distinct)
    feature = bucket if chosen is None else chosen[bucket]
    keep = feature >= 0
    feature, owner = feature[keep], owner[keep]
    order = np.argsort(owner, kind="stable")
    feature, n = feature[order], np.bincount(owner, minlength=len(distinct))
    first = np.cumsum(n) - n
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    hit = np.flatnonzero(n[place])
    rows, place = rows[hit], place[hit]
    k = n[place]
    upto = np.cumsum(k) - k
    flat = feature[np.repeat(first[place] - upto, k) + np.arange(k.sum())]
    both = np.unique(np.repeat(rows, k) * BUCKETS + flat)
    return both // BUCKETS, both % BUCKETS


def _sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str) -> DataFrame:
    marks = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_lid")).agg(F.max("toxic").cast("int").alias("_toxic"))
    marks = marks.orderBy(F.xxhash64(F.lit(3), "_lid"), "_lid").limit(most)  # the documented bound of the sample
    return docs.join(F.broadcast(marks), docs[id_col] == marks["_lid"]).select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"), "_toxic")


def fit(x: list[np.ndarray], y: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], n: int, rounds: int = 1500) -> tuple[np.ndarray, float]:
    """Weights of n features and a bias: logistic loss with both labels weighed alike, plus FAIR times the squared
    change of the logit in each pair (a row's features, those of its swapped text), plus RIDGE times squared weights.
    By gradient steps with momentum; the loss is convex, so the result does not depend on the start."""
    rows, cols = np.repeat(np.arange(len(x)), [len(r) for r in x]), np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    d_row = np.concatenate([np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs]), np.zeros(0)]).astype(np.int64) if pairs else np.zeros(0, np.int64)
    d_col = np.concatenate([np.concatenate(p) for p in pairs]).astype(np.int64) if pairs else np.zeros(0, np.int64)
    d_val = np.concatenate([np.concatenate([np.ones(len(a)), -np.ones(len(b))]) for a, b in pairs]) if pairs else np.zeros(0)
    w, b, vw, vb, lr = np.zeros(n), 0.0, np.zeros(n), 0.0, 0.5
    for _ in range(rounds):
        z = np.bincount(rows, w[cols], len(x)) + b
        g = (1 / (1 + np.exp(-z)) - y) * share
        gw = np.bincount(cols, g[rows], n) + RIDGE * w
        if pairs:
            change = np.bincount(d_row, w[d_col] * d_val, len(pairs))
            gw += FAIR * np.bincount(d_col, change[d_row] * d_val, n) / len(pairs)
        vw, vb = 0.9 * vw - lr * gw, 0.9 * vb - lr * g.sum()
        w, b = w + vw, b + vb
    return w, float(b + _shift(np.bincount(rows, w[cols], len(x)) + b, y))


def _shift(z: np.ndarray, y: np.ndarray, at: float = CUT) -> float:
    """What to add to logits so that those learned from are told apart best at the score `at`, by F2, as a toxic text
    that stays does more harm than a clean one that goes: texts with one toxic word are rarer in them than they are
    elsewhere, and lie nearer to the others than to the middle."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    above = np.cumsum(y[::-1])[::-1]  # toxic rows from each place on
    f2 = 5 * above / (np.arange(len(z), 0, -1) + 4 * y.sum())
    f2[1:][z[1:] == z[:-1]] = -1  # equal logits can't be parted
    best = np.flatnonzero(f2 >= f2.max() - 1e-12)
    low = np.where(best > 0, z[best - 1], z[best] - 2)
    k = np.argmax(z[best] - low)
    return float(np.log(at / (1 - at)) - (z[best[k]] + low[k]) / 2)


def learn(docs: DataFrame, labels: DataFrame, most: int = LEARN_FROM, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, float]:
    """(place of each bucket among the features, weights, bias), from at most `most` labelled rows that are not held out.

    Features are parts of words, present or not; kept are the KEEP whose presence tells most between the labels (by
    the log-likelihood ratio of their counts). Per text, a few features come to the driver, `most` texts at most.
    """
    sample = written(_sample(docs, labels, most, id_col, text_col))

    def count(batches):
        import pyarrow as pa

        bad, all_ = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            row, feature = _in_rows(b.column("_text"), None)
            toxic = np.asarray(b.column("_toxic"))[row] == 1
            np.add.at(all_, feature, 1)
            np.add.at(bad, feature[toxic], 1)
        at = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bad[at]), pa.array(all_[at])], names=["feature", "bad", "n"])

    totals = sample.agg(F.sum("_toxic").alias("bad"), F.count(F.lit(1)).alias("n")).first()
    place = np.full(BUCKETS, -1, np.int64)
    bad, n = int(totals["bad"] or 0), int(totals["n"])
    if not bad or bad == n:
        return place, np.zeros(0), -10.0 if not bad else 10.0
    c = mapped(sample, count, "feature long, bad long, n long").groupBy("feature").agg(F.sum("bad").cast("double").alias("b"), F.sum("n").cast("double").alias("a")).where("a >= 3")
    good, p, q = F.col("a") - F.col("b"), F.col("b") / F.col("a"), bad / n
    log = lambda x: F.when(x > 0, F.log(x)).otherwise(F.lit(0.0))
    tells = F.col("b") * (log(p) - float(np.log(q))) + good * (log(1 - p) - float(np.log(1 - q)))
    kept = [r["feature"] for r in c.withColumn("t", tells).where("t > 5").orderBy(F.col("t").desc(), "feature").limit(KEEP).collect()]
    place[kept] = np.arange(len(kept))
    known = sample.sparkSession.sparkContext.broadcast(place)

    def mark(batches):
        import pyarrow as pa

        for b in batches:
            other = [swapped(t) for t in b.column("_text").to_pylist()]
            out = []
            for texts in (b.column("_text"), pa.array(other, pa.string())):
                row, feature = _in_rows(texts, known.value)
                out.append([r.tolist() for r in np.split(feature, np.searchsorted(row, np.arange(1, b.num_rows)))])
            yield pa.RecordBatch.from_arrays([b.column("_toxic"), *(pa.array(o, pa.list_(pa.int64())) for o in out), pa.array([o is not None for o in other])], names=["_toxic", "x", "other", "has"])

    rows = mapped(sample, mark, "_toxic int, x array<long>, other array<long>, has boolean").toPandas()
    x = [np.asarray(v, np.int64) for v in rows["x"]]
    pairs = [(a, np.asarray(o, np.int64)) for a, o, h in zip(x, rows["other"], rows["has"], strict=True) if h]
    return place, *fit(x, rows["_toxic"].to_numpy().astype(float), pairs, len(kept))


def score(docs: DataFrame, place: np.ndarray, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _score) of every row's whole text; an empty or null text gets the score of no features."""
    model = docs.sparkSession.sparkContext.broadcast((place.astype(np.int32), weights))  # BUCKETS + KEEP numbers

    def run(batches):
        import pyarrow as pa

        place, weights = model.value
        for b in batches:
            row, feature = _in_rows(b.column("_text"), place) if len(weights) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            z = np.bincount(row, weights[feature], b.num_rows) + bias if len(weights) else np.full(b.num_rows, bias)
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["_id", "_score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run, f"_id {kind}, _score double")


def detect(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _score) of every row of docs, learned from the labels of ids whose CRC32 as text leaves a rest other than
    1 when divided by 3. Labels with a null id or mark are left out; of several for one id the higher counts. With no
    toxic label every score is near 0. Repeated rows stay; an empty table gives an empty table."""
    return score(docs, *learn(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)


def query(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = detect(docs, labels)
    return out.select(F.col("_id").alias("doc_id"), F.coalesce(held_out("_id"), F.lit(True)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= CUT).cast("int").alias("predicted"))
