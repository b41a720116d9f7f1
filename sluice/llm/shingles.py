"""Near copies by word shingles: SimHash and its grid find pairs, each verified on its words; an exact join by prefixes adds what these miss."""

from __future__ import annotations

from fractions import Fraction
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import dropped, join_salted, kept, mapped, written
from sluice.llm.components import components
from sluice.llm.simhash import grouped, simhash, wide_links
from sluice.llm.words import ODD, hashes, mixed, split

#: Words of a shingle, and the least Jaccard similarity of two texts' sets of shingles.
RUN, SIMILARITY = 5, Fraction(4, 5)
#: Bits at which SimHashes of texts are taken for those of near copies: such texts lie about 10 apart at SIMILARITY.
RADIUS = 11
#: Rows (at most about) whose shingles are counted, the count that makes a shingle common, and how many are told to the
#: tasks at most. They set the order of the shingles alone, so only the time taken.
COUNT_FROM, COMMON, MOST_COMMON = 20_000, 4, 100_000
#: Sets in a cell of which all pairs are verified at once.
FEW = 64
#: Sets of a cell that are verified in one task.
BLOCK = 128


def shingles(words: list[bytes], run: int = RUN) -> set[tuple[bytes, ...]]:
    """The runs of `run` words; all words as one run where there are fewer."""
    return set(zip(*(words[k:] for k in range(run)))) if len(words) >= run else {tuple(words)} if words else set()


def _hashed(texts, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle of every text, repeats included, in the order of the texts."""
    distinct, place, at = split(texts)
    if not distinct:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = np.diff(at)
    owner = np.repeat(np.arange(len(size)), size)
    end = at[1:][owner]
    where = np.arange(len(place))
    real = (where + run <= end) | ((where == at[:-1][owner]) & (size[owner] < run))
    word = hashes([w.encode().lower() for w in distinct])[place]  # A-Z alone
    start, end = where[real], end[real]
    h = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(run):
            p = start + k
            h = h * ODD + np.where(p < end, word[np.minimum(p, len(word) - 1)], np.uint64(0))
    return owner[real], mixed(h)


def _common(docs: DataFrame, run: int, id_col: str, text_col: str) -> np.ndarray:
    """Hashes of shingles that many of about COUNT_FROM rows hold, from the rarest to the commonest."""
    n = docs.count()
    share = 1 << 20 if n <= COUNT_FROM else int((1 << 20) * COUNT_FROM / n)
    rows = docs.where(F.pmod(F.xxhash64(F.lit(7), id_col, text_col), F.lit(1 << 20)) < share).select(F.col(text_col).alias("_text"))

    def count(batches):
        import pyarrow as pa

        for b in batches:
            owner, h = _hashed(b.column("_text"), run)
            order = np.lexsort((h, owner))
            owner, h = owner[order], h[order]
            h = h[np.concatenate([[True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])])] if len(h) else h
            h, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["_h", "_n"])

    found = mapped(rows, count, "_h bigint, _n bigint").groupBy("_h").agg(F.sum("_n").alias("_n")).where(F.col("_n") >= COMMON)
    found = found.orderBy(F.desc("_n"), "_h").limit(MOST_COMMON).toPandas()
    return found["_h"].to_numpy(np.int64)[::-1].copy().view(np.uint64)


def _sketches(owner: np.ndarray, h: np.ndarray, n: np.ndarray):
    """Per set a bitmap of 64 bits or about half as many as it has members, a power of two, as an Arrow list of longs: each
    member flips one bit. So two sets differ in at least as many members as their bitmaps, one folded to the other's
    size, do in bits."""
    import pyarrow as pa

    bits = 64 << np.ceil(np.log2(np.maximum(1, n / 128))).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(bits)])
    place = upto[owner] + (mixed(h + ODD) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    flipped = np.packbits((np.bincount(place, minlength=upto[-1]) & 1).astype(np.uint8), bitorder="little").view("<i8")
    return pa.ListArray.from_arrays(pa.array((upto // 64).astype(np.int32)), pa.array(flipped))


def prefixes(docs: DataFrame, run: int, least: Fraction, id_col: str, text_col: str) -> DataFrame:
    """(_id, _th, _fp, _n, _prefix, _sketch, _sim) per row of docs: its id, a hash of its text, a hash and the size of its set of shingles, and the first
    n - ceil(least * n) + 1 of its n shingles in one order for all rows, the common ones last; its sketch, and its SimHash."""
    common = _common(docs, run, id_col, text_col)
    table = docs.sparkSession.sparkContext.broadcast((np.sort(common), np.argsort(common).astype(np.uint64)))

    def own(batches):
        import pyarrow as pa

        hot, rank = table.value
        for b in batches:
            owner, h = _hashed(b.column("_text"), run)
            key = h >> np.uint64(1)
            if len(hot) and len(h):
                near = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                key = np.where(hot[near] == h, np.uint64(1 << 63) + rank[near], key)
            order = np.lexsort((h, key, owner))
            owner, h = owner[order], h[order]
            if len(h):
                new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])])
                owner, h = owner[new], h[new]
            n = np.bincount(owner, minlength=b.num_rows)
            at = np.concatenate([[0], np.cumsum(n)])
            total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(h ^ ODD), dtype=np.uint64)])
            with np.errstate(over="ignore"):
                fp = mixed(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64))
            first = np.where(n > 0, n - -(-n * least.numerator // least.denominator) + 1, 0)
            keep = np.arange(len(h)) - at[owner] < first[owner]
            sketch = _sketches(owner, h, n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(first)]).astype(np.int32)), pa.array(h[keep].view(np.int64)))
            sim = pa.array([simhash(t.as_py(), run) for t in b.column("_text").cast(pa.binary())], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_th"), pa.array(fp.view(np.int64)), pa.array(n.astype(np.int32)), lists, sketch, sim], names=["_id", "_th", "_fp", "_n", "_prefix", "_sketch", "_sim"])

    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))
    return mapped(rows, own, f"_id {docs.schema[id_col].dataType.simpleString()}, _th bigint, _fp bigint, _n int, _prefix array<bigint>, _sketch array<bigint>, _sim bigint")


def by_simhash(sets: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of sets (a written table, one row per `_fp`) to verify: of those with one SimHash the least with each
    other, of those with SimHashes that wide_links() links the least ones."""
    of = written(sets.groupBy("_sim").agg(F.min("_fp").alias("_least"), F.count(F.lit(1)).alias("_many")))
    same = join_salted(sets.select("_sim", "_fp"), of, ["_sim"], "_many", sets.count()).select(F.col("_least").alias("a"), F.col("_fp").alias("b"))
    near = written(wide_links(of.select(F.col("_sim").alias("_fp")), radius))
    near = near.join(of.select(F.col("_sim").alias("a"), F.col("_least").alias("x")), "a").join(of.select(F.col("_sim").alias("b"), F.col("_least").alias("y")), "b")
    return same.where("a <> b").unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b")))


def cells(sets: DataFrame) -> DataFrame:
    """(_cell, _fp, _n, _i, _c, _lead, _bits): of sets (a written table, one row per `_fp`) those of `_n` shingles whose prefixes hold a shingle
    that another's holds too, its place there, how many do, the least `_fp` of these, and the sketch folded to one long.
    Every pair that is similar enough shares a cell."""
    all_ = sets.select("_fp", "_n", F.posexplode("_prefix").alias("_i", "_cell"))
    shared = written(all_.groupBy("_cell").agg(F.count(F.lit(1)).alias("_c"), F.min("_fp").alias("_lead")).where("_c > 1"))
    met = join_salted(all_, shared, ["_cell"], "_c", sets.agg(F.sum(F.size("_prefix"))).first()[0] or 0)
    bits = F.aggregate("_sketch", F.lit(0).cast("long"), lambda t, x: t.bitwiseXOR(x)).alias("_bits")
    out = written(met.join(sets.select("_fp", bits), "_fp"))  # few entries meet, so the long is joined to these alone
    dropped(shared)
    return out


def _is_leader(quota: int) -> Column:
    """Of the sets in a cell: the least alone for a quota of 1; then all of them where they are FEW, else about `quota`
    more, the same ones in cells of like size."""
    least = F.col("_fp") == F.col("_lead")
    width = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("_c").cast("double")))).cast("long")
    return least if quota == 1 else least | (F.col("_c") <= FEW) | (F.pmod(F.col("_fp"), width) < quota)


def _met(now: DataFrame, leader: Column, done: Column, least: Fraction) -> DataFrame:
    """Pairs (a, b) of a leader and another set of its cell, in different components (_root), of which b has been no leader
    before, that can be similar enough. By size; and by their places: if the cell is the first shingle that both hold, what
    comes before it is in one of them alone, so they share no more than the shorter rest. A similar pair passes in that
    cell. And by the bits of their folded sketches, as in possible(). The sets of a cell are
    dealt over as many tasks as they make BLOCKs, so its leaders are copied as often as the pairs to look at ask for."""
    blocks = F.ceil(F.col("_c") / BLOCK).cast("int")
    lead = now.where(leader & ~done).select("_cell", F.col("_fp").alias("a"), F.col("_n").alias("_na"), F.col("_i").alias("_ia"), F.col("_bits").alias("_ba"), F.col("_root").alias("_ra"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_salt"))
    rest = now.where(~done).select("_cell", "_fp", "_n", "_i", "_bits", "_root", leader.alias("_too"), F.pmod(F.xxhash64("_fp"), blocks).cast("int").alias("_salt"))
    met = lead.join(rest, ["_cell", "_salt"]).where((F.col("_ra") != F.col("_root")) & (~F.col("_too") | (F.col("a") < F.col("_fp"))))
    small, large = F.least("_na", "_n"), F.greatest("_na", "_n")
    shared = F.least(F.col("_na") - F.col("_ia"), F.col("_n") - F.col("_i"))
    up, down = least.denominator + least.numerator, least.denominator - least.numerator
    met = met.where((shared * up >= (small + large) * least.numerator) & (F.bit_count(F.col("_ba").bitwiseXOR(F.col("_bits"))) * up <= (small + large) * down))
    return met.where(small * least.denominator >= large * least.numerator).select("a", F.col("_fp").alias("b")).distinct()


def _both(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """pairs (a, b) (a written table) plus _ta and _tb, what values (_fp, name) has for each. One value a pair is shuffled;
    the pairs of an `a` that has very many spread over partitions."""
    often = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_pairs"))
    first = written(values.select(F.col("_fp").alias("a"), F.col(name).alias("_ta")).join(often, "a"))
    with_b = pairs.join(values.select(F.col("_fp").alias("b"), F.col(name).alias("_tb")), "b")
    return join_salted(with_b, first, ["a"], "_pairs", pairs.count())


def possible(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """Of pairs (a, b) (a written table), those whose sketches do not differ in more bits than sets can that are as similar:
    of nx and ny members, (nx + ny) * (1 - least) / (1 + least)."""
    both = _both(pairs, sets.select("_fp", F.struct("_n", "_sketch").alias("_s")), "_s")
    x, y = F.col("_ta._sketch"), F.col("_tb._sketch")
    m = F.least(F.size(x), F.size(y))
    at = lambda v, i: F.get(v, i).bitwiseXOR(F.when(F.size(v) > m, F.get(v, i + m)).otherwise(F.lit(0).cast("long")))  # noqa: E731  folded; sizes differ by one power of two at most
    differ = F.aggregate(F.sequence(F.lit(0), m - 1), F.lit(0), lambda t, i: t + F.bit_count(at(x, i).bitwiseXOR(at(y, i))))
    up, down = least.denominator + least.numerator, least.denominator - least.numerator
    return both.where((F.size(x) > 2 * m) | (F.size(y) > 2 * m) | (differ * up <= (F.col("_ta._n") + F.col("_tb._n")) * down)).select("a", "b")


def alike(pairs: DataFrame, texts: DataFrame, run: int, least: Fraction) -> DataFrame:
    """Of pairs (a, b) (a written table), those whose texts (_fp, _text) have shingles of at least that similarity, by
    their words."""
    both = _both(pairs, texts, "_text")

    def verify(batches):
        import pyarrow as pa

        for b in batches:
            keep = []
            last, x = None, set()
            for t, y in zip(b.column("_ta").cast(pa.binary()).to_pylist(), b.column("_tb").cast(pa.binary()).to_pylist(), strict=True):
                if t != last:  # rows come by `a`
                    last, x = t, shingles(t.lower().split(), run)
                y = shingles(y.lower().split(), run)
                small, large = sorted((len(x), len(y)))
                met = len(x & y) if small * least.denominator >= large * least.numerator else 0
                keep.append(met * least.denominator >= (small + large - met) * least.numerator)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return mapped(both.select("a", "b", "_ta", "_tb"), verify, "a bigint, b bigint")


def near_copies(docs: DataFrame, run: int = RUN, least: Fraction = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _th, _fp, _component) per row of docs, as simhash.near_duplicates gives them: here texts link whose sets of
    shingles of `run` words have a Jaccard similarity of `least` or more.

    First SimHash: fingerprints of the texts' shingles meet in its grid at RADIUS or fewer bits, and the pairs are verified.
    64 bits can't bring all pairs of that similarity together, so an exact search follows among the sets that are still apart.
    Two sets that similar share one of their prefixes' shingles, a cell. It goes by rounds: in each, leaders
    are verified against all others of their cell that are not in their component by then. First one set of a cell
    leads; then all of it where they are FEW, else eight times as many in each round. Cells are done when all sets that
    have not led are in one component. So a group of copies costs its leaders times its size, not all its pairs, and yet no component
    is missed. Pairs whose sketches differ too much are not verified. Shingles are told apart by 64 bits of hash in finding pairs and equal sets, by their words in verifying.
    Words are as in simhash; texts without a word are alike.
    """
    rows = written(prefixes(docs, run, least, id_col, text_col))
    sets = rows.groupBy("_fp").agg(F.min("_th").alias("_th"), F.count(F.lit(1)).alias("_copies"), F.min("_sim").alias("_sim"), *[F.first(c).alias(c) for c in ("_n", "_prefix", "_sketch")])
    sets = written(sets)
    n_rows = rows.count()

    def verified(pairs: DataFrame) -> DataFrame:
        near = written(possible(pairs, sets, least))
        ends = near.select(F.explode(F.array("a", "b")).alias("_fp")).distinct()
        reps = written(sets.join(ends, "_fp", "left_semi").select("_fp", "_th", "_copies"))
        texts = docs.select(F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))
        texts = written(join_salted(texts, reps, ["_th"], "_copies", n_rows).select("_fp", "_text").dropDuplicates(["_fp"]))
        return alike(near, texts, run, least)

    pairs = written(by_simhash(sets))
    edges = kept(partial(verified, pairs))
    dropped(pairs)
    now, quota, done = cells(sets), 1, F.lit(False)
    while total := now.count():
        label = components(edges).select(F.col("node").alias("_fp"), F.col("root").alias("_to"))
        edges = label.select(F.col("_fp").alias("a"), F.col("_to").alias("b")).where("a <> b")  # they join the same sets, with one link a set
        now = written(now.join(label, "_fp", "left").select("_cell", "_fp", "_n", "_i", "_c", "_lead", "_bits", F.coalesce("_to", "_fp").alias("_root")))
        open_ = now.where(~done).groupBy("_cell").agg(F.min("_root").alias("x"), F.max("_root").alias("y"), F.first("_c").alias("_c")).where("x <> y")
        now = written(join_salted(now, written(open_.select("_cell", F.col("_c").alias("_all"))), ["_cell"], "_all", total).drop("_all"))
        leader = _is_leader(quota)
        pairs = written(_met(now, leader, done, least))
        found = kept(partial(verified, pairs))
        dropped(pairs)
        edges = written(edges.unionByName(found))
        done, quota = leader, 8 * quota
        now = now.where(F.col("_c") > (2 if quota == 8 else FEW))
    dropped(sets)
    return grouped(rows.select("_id", "_th", "_fp"), lambda _: edges)
