"""Language ID: each document is a mixture of languages, fitted by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import mapped, written
from sluice.llm.words import ODD, Runs, mixed, split

#: Hash buckets of letter trigrams; rounds of expectation-maximisation; the prior's weight per language, in words.
BUCKETS, ROUNDS, PRIOR = 1 << 16, 8, 0.5
#: Labelled rows that are learned from, at most about: rows are chosen by a hash of their id.
LEARN_FROM = 20_000
UNKNOWN = "und"


def held_out(id_col: str, mod: int = 5, rest: int = 0):
    return F.crc32(F.col(id_col).cast("string")) % mod == rest


def _grams(runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the word of every letter with its two neighbours; what is not a letter counts as one edge."""
    codes = np.where(runs.letter, runs.codes, np.uint64(0))
    at = np.flatnonzero(runs.letter)
    with np.errstate(over="ignore"):
        left = codes[np.maximum(at - 1, 0)] * (at > 0).astype(np.uint64)
        right = codes[np.minimum(at + 1, len(codes) - 1)]
        h = mixed((left * np.uint64(0x110000) + codes[at]) * ODD + right)
    return (h % np.uint64(BUCKETS)).astype(np.int64), np.repeat(runs.owner, runs.size)


def _lower(column):
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def learn(docs: DataFrame, most: int = LEARN_FROM, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages, and log probabilities (BUCKETS, languages) of trigrams, from rows with a language.

    At most about `most` rows are used, chosen by a hash of their id: a documented bound, so that learning costs the
    same at any size. Counts are summed per task before they are shuffled; languages x BUCKETS sums reach the driver.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = rows.count()
    share = 1 << 20 if n <= most else int((1 << 20) * most / n)
    rows = rows.where(F.pmod(F.xxhash64(F.lit(5), id_col), F.lit(1 << 20)) < share).select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))

    def count(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("_lang").to_pylist(), object)
            for lang in set(langs.tolist()):
                pick = pa.array(np.flatnonzero(langs == lang))
                distinct, place, _ = split(_lower(batch.column("_text").take(pick)))
                if distinct:
                    bucket, owner = _grams(Runs(distinct))
                    sums.setdefault(lang, np.zeros(BUCKETS))
                    sums[lang] += np.bincount(bucket, np.bincount(place, minlength=len(distinct))[owner], BUCKETS)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(s[at].astype(np.int64))], names=["lang", "bucket", "n"])

    found = mapped(rows, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique().tolist())
    counts = np.full((BUCKETS, len(langs)), 0.1)
    for k, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        counts[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
    return langs, np.log(counts / counts.sum(0)) if langs else counts


def mixture(likelihood: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Language proportions (texts, languages) of texts whose words, from at[i] to at[i + 1], have these likelihoods.

    Proportions are fitted with all languages; a language stays if taking it out costs more log likelihood than half
    the log of the number of words (the penalty per parameter of the Bayesian information criterion), and the best
    one always; then the proportions are fitted again within the set.
    """
    n = np.diff(at)
    out = np.zeros((len(n), likelihood.shape[1]))
    some = np.flatnonzero(n)
    if not len(some):
        return out
    starts, n = at[:-1][some], n[some]
    own = np.repeat(np.arange(len(some)), n)
    lik = likelihood.astype(np.float32)
    allowed = np.ones((len(some), lik.shape[1]))

    def fit(rounds: int) -> np.ndarray:
        pi = allowed / allowed.sum(1, keepdims=True)
        for _ in range(rounds):
            r = lik * pi.astype(np.float32)[own]
            r /= np.maximum(r.sum(1, keepdims=True), np.float32(1e-30))
            pi = (np.add.reduceat(r, starts, axis=0, dtype=np.float64) + PRIOR) * allowed
            pi /= pi.sum(1, keepdims=True)
        return pi

    pi = fit(ROUNDS)
    parts = (lik * pi[own]).astype(np.float64)
    whole = parts.sum(1)
    cost = np.stack([np.add.reduceat(np.log(np.maximum(whole, 1e-300)) - np.log(np.maximum((whole - parts[:, k]) / np.maximum(1 - pi[own, k], 1e-9), 1e-300)), starts) for k in range(lik.shape[1])], 1)
    allowed = (cost > 0.5 * np.log(n)[:, None]).astype(float)
    allowed[np.arange(len(some)), pi.argmax(1)] = 1
    out[some] = fit(3)
    shrink = (n / (n + PRIOR * lik.shape[1]))[:, None]  # a few words are weak evidence
    out[some] = out[some] * shrink + (1 - shrink) / lik.shape[1]
    return out


def levels(logs: np.ndarray) -> np.ndarray:
    """Per language the mean log likelihood of a trigram from which a word fits it: half way between what the language's
    own trigrams have by expectation and what a uniform background gives any."""
    return ((np.exp(logs) * logs).sum(0) - np.log(BUCKETS)) / 2


def predict(docs: DataFrame, langs: list[str], logs: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id and text columns plus `_lang_pred`, the language with the largest proportion in the whole text, and
    `_score`, that proportion, drawn towards equal shares where there are few words, and `_fits`, the share of its
    letters in words that fit any language by levels(). A text that is null or has no letter is `und` with score 0; so
    is every text if no language was learned."""
    table = docs.sparkSession.sparkContext.broadcast((langs, logs.astype(np.float32)))  # languages x BUCKETS numbers

    def run(batches):
        import pyarrow as pa

        langs, logs = table.value
        level = levels(logs.astype(np.float64)) if langs else None
        for b in batches:
            distinct, place, at = split(_lower(b.column("_text")))
            best, score, has, fits = np.zeros(b.num_rows, int), np.zeros(b.num_rows), np.zeros(b.num_rows, bool), np.zeros(b.num_rows)
            if distinct and langs:
                bucket, owner = _grams(Runs(distinct))
                logp = np.stack([np.bincount(owner, logs[bucket, k], len(distinct)) for k in range(len(langs))], 1)
                n = np.bincount(owner, minlength=len(distinct))
                real = n > 0
                text = np.repeat(np.arange(b.num_rows), np.diff(at))
                fit = np.bincount(text, ((logp >= n[:, None] * level).any(1) * n)[place], b.num_rows)
                fits = fit / np.maximum(1, np.bincount(text, n[place], b.num_rows))
                lik = np.exp(logp - logp.max(1, keepdims=True)).astype(np.float32)
                keep = real[place]
                at = np.concatenate([[0], np.cumsum(keep)])[at]
                pi = mixture(lik[place[keep]], at)
                best, score, has = pi.argmax(1), pi.max(1), np.diff(at) > 0
            names = [langs[k] if h else UNKNOWN for k, h in zip(best, has, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_id", "_th")), pa.array(names, pa.string()), pa.array(np.where(has, score, 0.0)), pa.array(fits)], names=["_id", "_th", "_lang_pred", "_score", "_fits"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))
    return mapped(rows, run, f"_id {kind}, _th bigint, _lang_pred string, _score double, _fits double", 1 << 20)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(_id, _th, _lang_pred, _score, _fits) of every row of docs, learned from those with a language that are not held out.

    Held out are ids whose CRC32 as text is divisible by 5, and rows without an id. Repeated rows stay. An empty
    table gives an empty table. Columns beyond the three named are ignored.
    """
    return predict(docs, *learn(docs.where(~held_out(id_col)), id_col=id_col, text_col=text_col, lang_col=lang_col), id_col, text_col)


def recognised(docs: DataFrame, least: float = 0.4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows in no language, with no language of at least the share `least`, or with less than that share
    of letters in words that fit a learned language."""
    found = written(detect(docs, id_col, text_col, lang_col).where((F.col("_lang_pred") == UNKNOWN) | (F.col("_score") < least) | (F.col("_fits") < least)).select(F.col("_id").alias("_gone"), F.col("_th").alias("_gone_th")).distinct())
    texts = docs.withColumn("_sluice_th", F.xxhash64(text_col))
    return texts.join(found, texts[id_col].eqNullSafe(found["_gone"]) & (texts["_sluice_th"] == found["_gone_th"]), "left_anti").drop("_sluice_th")


def query(spark, docs: DataFrame) -> DataFrame:
    return detect(docs).select(F.col("_id").alias("doc_id"), F.coalesce(held_out("_id"), F.lit(True)).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))
