"""Substring dedup by recompression: runs and pairs of symbols get names that depend on content alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import dropped, join_salted, mapped, written
from sluice.llm.words import ODD, hashes, mixed, split

#: Words of a window; rounds of naming; words that a symbol may span; words on either side that go into an anchor's name.
WINDOW, ROUNDS, SPAN, AROUND = 35, 2, 8, 6
#: Words that are worked on at a time: what a text of any length takes in memory.
STEP = 1 << 18
#: A name with more than one HOTth of all anchors is dealt over many partitions; so there are at most HOT of these.
HOT = 1000
BASES = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))


class Spans:
    """64-bit hashes of any span of words in constant time, from sums of word hashes times powers of an odd base."""

    def __init__(self, words: np.ndarray, base: np.uint64):
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), base)]), dtype=np.uint64)
            self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), np.uint64(pow(int(base), -1, 1 << 64)))]), dtype=np.uint64)
            self.upto = np.concatenate([[np.uint64(0)], np.cumsum(words * powers[:-1], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.upto[end] - self.upto[start]) * self.back[start] + (end - start).astype(np.uint64) * ODD)


def _coin(symbols: np.ndarray, turn: int) -> np.ndarray:
    return (mixed(symbols + np.uint64(turn) * ODD) >> np.uint64(17)) & np.uint64(1) == 1


def anchors(words: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each window of words, the start of its anchor and the anchor's name; start -1 where it has none, and the
    name is then that of the window itself.

    Recompression: in each round a run of one symbol becomes one symbol, then two neighbours whose coins are 1 and 0
    become one, if together they span SPAN words or fewer. A name is a hash of what it stands for and the round, so
    equal content has equal names everywhere, with no table to share. From inside a window alone, all of its symbols
    are certain but those at its edges, which may go on outside: the first and last run, a first symbol with coin 0,
    a last one with coin 1. Of the certain symbols at least AROUND words from the edges, the anchor is the first with
    the least name; its own name takes in the AROUND words on each side. Equal windows so have equal anchors at one
    offset.
    """
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        symbol, start = words, np.arange(len(words) + 1)  # start has the end too
        first, last = np.arange(n), np.arange(n) + window  # certain symbols [first, last)
        for turn in range(1, ROUNDS + 1):
            new = np.concatenate([[True], symbol[1:] != symbol[:-1]])
            run = np.cumsum(new) - 1
            heads = np.flatnonzero(new)
            size = np.diff(np.concatenate([heads, [len(symbol)]])).astype(np.uint64)
            symbol = np.where(size > 1, mixed(symbol[heads] * ODD + size + np.uint64(turn << 32)), symbol[heads])
            start = np.concatenate([start[heads], start[-1:]])
            first, last = run[np.minimum(first, len(run) - 1)] + 1, run[np.maximum(last - 1, 0)]

            coin = _coin(symbol, turn)
            span = np.diff(start)
            second = np.zeros(len(symbol), bool)
            second[1:] = coin[:-1] & ~coin[1:] & (span[:-1] + span[1:] <= SPAN)
            top = len(symbol) - 1
            first = first + ~coin[np.minimum(first, top)]
            last = last - coin[np.clip(last - 1, 0, top)]
            heads = np.flatnonzero(~second)
            group = np.cumsum(~second) - 1
            paired = np.concatenate([second[1:], [False]])[heads]
            follower = symbol[np.minimum(heads + 1, top)]
            symbol = np.where(paired, mixed(symbol[heads] + mixed(follower + np.uint64(turn) * ODD)), symbol[heads])
            start = np.concatenate([start[heads], start[-1:]])
            empty = first >= last
            first, last = group[np.minimum(first, top)], group[np.clip(last - 1, 0, top)] + 1
            last[empty] = first[empty]
        # inside by AROUND words
        at = np.searchsorted(start[:-1], np.arange(n) + AROUND)
        upto = np.searchsorted(start[1:], np.arange(n) + window - AROUND, side="right")
        first, last = np.maximum(first, at), np.minimum(last, upto)
        none = first >= last
        rank = mixed(symbol ^ ODD)
        best = [np.arange(len(symbol))]  # of 1, 2, 4, ... symbols from each
        width = max(1, int((last - first).max(initial=1)))
        while (1 << len(best)) <= width:
            half = 1 << (len(best) - 1)
            a = best[-1]
            b = a[np.minimum(np.arange(len(a)) + half, len(a) - 1)]
            best.append(np.where(rank[b] < rank[a], b, a))
        level = np.maximum(0, np.frexp(np.maximum(last - first, 1).astype(np.float64))[1] - 1)
        table = np.stack(best)
        top = len(symbol) - 1
        a = table[level, np.minimum(first, top)]
        b = table[level, np.clip(last - (1 << level), 0, top)]
        chosen = np.where(rank[b] < rank[a], b, a)
        begin, end = start[chosen], start[chosen + 1]
        hashed = Spans(words, BASES[0])
        lo, hi = np.where(none, np.arange(n), begin - AROUND), np.where(none, np.arange(n) + window, end + AROUND)
        name = hashed(np.clip(lo, 0, len(words)), np.clip(hi, 0, len(words)))
        return np.where(none, -1, begin), np.where(none, mixed(name + np.uint64(1)), name)


def _windows(batch, window: int):
    """(row, place of its first word, start of its anchor or -1, anchor's name, two hashes) of a batch's windows, a step at a time."""
    distinct, place, at = split(batch.column("_text"))
    words = hashes(distinct)[place]
    row_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for lo in range(0, len(words), STEP):
        part = words[lo : lo + STEP + window - 1]
        begin, name = anchors(part, window)
        p = np.arange(len(begin)) + lo
        row = row_of[p]
        inside = p + window <= at[row + 1]
        p, row, begin, name = p[inside], row[inside], begin[inside], name[inside]
        where = np.where(begin < 0, -1 - (p - at[row]), begin + lo - at[row])
        spans = [Spans(part, b) for b in BASES]
        yield row, p - at[row], where, name, lambda keep, q=p - lo, s=spans: [s[0](q[keep], q[keep] + window).view(np.int64), s[1](q[keep], q[keep] + window).astype(np.uint32).view(np.int32)]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(_id, _th, _starts): per row of docs (by id and hash of text), the first words of all windows that start elsewhere too."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _rows(docs, id_col, text_col)

    def name_all(batches):
        import pyarrow as pa

        for b in batches:
            for row, _, where, name, _ in _windows(b, window):
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (where[1:] != where[:-1])]) if len(row) else np.zeros(0, bool)
                _, one = np.unique(row[new] * (1 << 40) + where[new] + (1 << 39), return_index=True)
                pick = np.flatnonzero(new)[one]
                take = pa.array(row[pick])
                yield pa.RecordBatch.from_arrays([b.column("_id").take(take), b.column("_th").take(take), pa.array(where[pick]), pa.array(name[pick].view(np.int64))], names=["_id", "_th", "_where", "_name"])

    named = written(mapped(rows, name_all, f"_id {kind}, _th bigint, _where bigint, _name bigint"))
    total = named.count()
    shared = written(named.groupBy("_name").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    hot = (F.col("_n") * HOT > total).alias("hot")  # a name that is so frequent has frequent windows
    likely = join_salted(named, shared, ["_name"], "_n", total, HOT).groupBy("_id", "_th").agg(F.collect_set(F.struct("_where", hot)).alias("_wheres"))
    likely = written(likely)
    dropped(named)
    dropped(shared)

    def open_up(batches):
        import pyarrow as pa

        for b in batches:
            wheres = b.column("_wheres")
            owner = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(wheres.offsets)))
            flat = wheres.flatten()
            wanted = owner * (1 << 40) + np.asarray(flat.field(0)) + (1 << 39)
            order = np.argsort(wanted)
            wanted, often = wanted[order], np.asarray(flat.field(1).cast(pa.int32()))[order]
            for row, p, where, _, spans in _windows(b, window):
                key = row * (1 << 40) + where + (1 << 39)
                found = np.searchsorted(wanted, key)
                found = np.minimum(found, len(wanted) - 1)
                keep = np.flatnonzero(wanted[found] == key)
                take = pa.array(row[keep])
                h1, h2 = spans(keep)  # the last bit of h2 says that the anchor's name is hot
                yield pa.RecordBatch.from_arrays([b.column("_id").take(take), b.column("_th").take(take), pa.array(p[keep].astype(np.int32)), pa.array(h1), pa.array(h2 & ~1 | often[found[keep]])], names=["_id", "_th", "_start", "_h1", "_h2"])

    on = rows["_id"].eqNullSafe(likely["_id"]) & rows["_th"].eqNullSafe(likely["_th"])
    opened = rows.join(likely.hint("shuffle_hash"), on).select(rows["_id"], rows["_th"], "_text", "_wheres")
    opened = written(mapped(opened, open_up, f"_id {kind}, _th bigint, _start int, _h1 bigint, _h2 int"))
    dropped(likely)
    twice = opened.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # equal windows have one anchor's name, so they agree on being hot; a salt within h2 deals hot ones over 64 partitions
    hot, h2 = F.col("_h2").bitwiseAND(F.lit(1)) == 1, F.col("_h2")
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(126), F.lit(2))).otherwise(F.array(F.lit(0)))
    twice = twice.select("_h1", h2, F.explode(salts).alias("_salt")).select("_h1", h2.bitwiseXOR(F.col("_salt")).alias("_h2"))
    salt = F.when(hot, (F.pmod(F.xxhash64("_id", "_start"), F.lit(64)) * 2).cast("int")).otherwise(F.lit(0))
    met = opened.select("_id", "_th", "_start", "_h1", h2.bitwiseXOR(salt).alias("_h2")).join(twice, ["_h1", "_h2"])
    out = written(met.groupBy("_id", "_th").agg(F.collect_set("_start").alias("_starts")))
    dropped(opened)
    return out


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of docs: its id, `n_words`, `n_removed` and `kept`, its words without those covered by a window of
    `window` words that starts anywhere else too, joined by one space. Windows are judged on the input.

    Null and empty texts have no words. Rows alike in id and text are two places, and so remove each other's windows.
    A text is worked on in steps of STEP words. An empty table gives an empty table. Other columns are ignored.

    Shuffled are: a name per anchor (one in some 12 words), then the texts that share a name, then two hashes for
    each of their windows that has a shared anchor, then the texts again, to lose their words. Windows are equal just
    if both hashes are, 95 bits in all.
    """
    found = repeats(docs, id_col, text_col, window)
    rows = _rows(docs, id_col, text_col)
    on = rows["_id"].eqNullSafe(found["_id"]) & rows["_th"].eqNullSafe(found["_th"])
    met = rows.join(found.hint("shuffle_hash"), on, "left").select(rows["_id"], "_text", "_starts")

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            out: list[list] = [[], [], []]
            for text, starts in zip(b.column("_text").cast(pa.binary()).to_pylist(), b.column("_starts"), strict=True):
                words = (text or b"").split()
                n, gone = len(words), 0
                if starts.is_valid:
                    edge = np.zeros(n + 1, np.int64)
                    s = np.asarray(starts.values)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + window, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    gone = n - int(keep.sum())
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                for to, v in zip(out, (n, gone, b" ".join(words)), strict=True):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()).cast(pa.string())], names=[id_col, "n_words", "n_removed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(met, cut, f"`{id_col}` {kind}, n_words long, n_removed long, kept string")


def query(spark, docs: DataFrame) -> DataFrame:
    return drop_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS g FROM p),
r AS (SELECT g FROM k GROUP BY g HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS pos FROM k JOIN r USING (g)),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
m AS (SELECT t.doc_id, count(*) AS n_words, count(c.pos) AS n_removed, string_agg(word, ' ' ORDER BY t.pos) FILTER (c.pos IS NULL) AS kept
      FROM t LEFT JOIN c ON t.doc_id = c.doc_id AND t.pos = c.pos GROUP BY t.doc_id)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN m ON w.doc_id = m.doc_id
"""
