"""Best-fit packing: patterns of few documents fitted to the length histogram, residuals packed best-fit."""

from __future__ import annotations

import bisect
import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import mapped, written
from sluice.llm.words import split_arrow

WINDOW, END = 4096, 1
#: Words whose ids a Python worker keeps between batches and tasks.
CACHED = 150_000
#: Marks that end a word and are a token run of their own after a letter or number.
TAIL = ".,;:!?"


def _gather(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches flat[start : start + n] end to end, and where each begins, plus the end."""
    upto = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(start - upto[:-1], n) + np.arange(upto[-1])], upto


class Ids:
    """Token ids of texts by a tokenizer of whole words: white space separates pre-tokens, so each distinct word is
    tokenized once, and a text's ids are those of its words in turn. The words met first are kept, CACHED at most."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.at: dict[str, int] = {"": 0}
        self.known = 1
        self.flat, self.upto = np.zeros(1 << 18, np.uint32), np.zeros(CACHED + 2, np.int32)  # word k's ids: flat[upto[k] : upto[k + 1]]

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words end to end, and how many each has. Words of letters alone go as one text, cut where tokens end words."""
        flat, sizes = [], []
        for i in range(0, len(words), 5000):
            part = words[i : i + 5000]
            if all(map(str.isalpha, part)):
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) == len(part) and cuts[-1] == len(ids):
                    flat.append(ids)
                    sizes.append(np.diff(np.concatenate([[0], cuts])))
                    continue
            each = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            flat.append(np.array([x for e in each for x in e], np.uint32))
            sizes.append(np.array([len(e) for e in each], np.int64))
        return (np.concatenate(flat), np.concatenate(sizes)) if words else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, start, how many) of each of the words; one that is there twice is tokenized twice, to no harm."""
        known, find = self.known, self.at.get
        used = int(self.upto[known])
        place = np.fromiter((find(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(place < 0)
        start, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        there = place >= 0
        start[there], n[there] = self.upto[place[there]], np.diff(self.upto)[place[there]]
        if not len(missing):
            return self.flat, start, n
        new = [words[i] for i in missing.tolist()]
        plain = np.fromiter(map(str.isalpha, new), bool, len(new))
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])  # letters alone first
        missing, new = missing[order], [new[i] for i in order.tolist()]
        ids, sizes = self.encoded(new)
        start[missing], n[missing] = used + np.cumsum(sizes) - sizes, sizes
        if known + len(new) > CACHED:  # these are not kept
            return np.concatenate([self.flat[:used], ids]), start, n
        if used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[used : used + len(ids)] = ids
        self.upto[known + 1 : known + len(new) + 1] = used + np.cumsum(sizes)
        self.at.update(zip(new, range(known, known + len(new)), strict=True))
        self.known += len(new)
        return self.flat, start, n

    def batch(self, texts):
        """texts (an Arrow string array) -> ids of all texts end to end, and where each text starts, plus the end."""
        import pyarrow as pa
        import pyarrow.compute as pc

        words, place, at = split_arrow(texts)
        base = pc.utf8_rtrim(words, TAIL)
        cut = pc.utf8_is_alnum(pc.utf8_slice_codeunits(base, -1))  # of an empty base: false
        base = pc.if_else(cut, base, words)
        lower = pc.and_(pc.string_is_ascii(base), pc.invert(pc.match_substring(base, "<|")))
        base = pc.if_else(lower, pc.ascii_lower(base), base)  # the tokenizer lower-cases ASCII anyway
        # the mark at the end: what rtrim took, as a place in a list of the few there are
        sizes = np.asarray(pc.subtract(pc.binary_length(words), pc.binary_length(base)))
        at_end = np.flatnonzero(sizes)
        tails = {"": 0}
        tail_of = np.zeros(len(words), np.int64)
        for i, w in zip(at_end.tolist(), words.take(pa.array(at_end)).to_pylist(), strict=True):
            tail = w[-int(sizes[i]) :]  # marks are one byte each
            tail_of[i] = tails.setdefault(tail, len(tails))
        coded = base.dictionary_encode()
        bases = coded.dictionary.to_pylist()
        flat, start, n = self.look_up(bases + list(tails))
        own = np.arange(len(bases), len(bases) + len(tails))
        order = np.stack([np.asarray(coded.indices).astype(np.int64), own[tail_of]], 1).ravel()  # each base, then its tail
        flat, upto = _gather(flat, start[order], n[order])
        starts, sizes = upto[:-1:2], n[order].reshape(-1, 2).sum(1)
        out, upto = _gather(flat, starts[place], sizes[place])
        return out, upto[at]


_KEPT: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """This worker's Ids for a tokenizer."""
    if path not in _KEPT:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        _KEPT[path] = Ids(path)
    return _KEPT[path]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """Per piece of each row's ids (with `end` after them): _id, piece, start, length, crc, and ids if asked for;
    _part and _nth number the pieces of one length within a task, for pack(). A null text has the end id alone."""

    def run(batches):
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        tokens, part, seen = ids_of(tokenizer_path), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        names = ["_id", "piece", "start", "length", "crc", "_part", "_nth"] + ["ids"] * with_ids
        for rows in batches:
            flat, at = tokens.batch(rows.column("_text"))
            out: list[list] = [[] for _ in names[1:]]
            take = []
            for i in range(rows.num_rows):
                ids = np.append(flat[at[i] : at[i + 1]], np.uint32(end)).astype("<u4")
                for p, s in enumerate(range(0, len(ids), window)):
                    own = ids[s : s + window]
                    take.append(i)
                    for to, v in zip(out, (p, s, len(own), zlib.crc32(own.tobytes()), part, int(seen[len(own)])) + ((own.tolist(),) if with_ids else ()), strict=True):
                        to.append(v)
                    seen[len(own)] += 1
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([rows.column("_id").take(pa.array(take, pa.int64()))] + [pa.array(x, k) for x, k in zip(out, kinds, strict=False)], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return mapped(rows, run, f"_id {kind}, piece int, start long, length long, crc long, _part int, _nth long" + ", ids array<long>" * with_ids, 2 << 20)


def nnls(a: np.ndarray, b: np.ndarray, most: int = 2000) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by active sets (Lawson and Hanson, 1974)."""
    x, on = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slack = 1e-10 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(most):
        w = np.where(on, -np.inf, a.T @ (b - a @ x))
        if on.all() or w.max() <= slack:
            break
        on[w.argmax()] = True
        while True:
            z = np.zeros_like(x)
            z[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (z[on] > 0).all():
                break
            bad = on & (z <= 0)
            step = (x[bad] / np.maximum(x[bad] - z[bad], 1e-300)).min()
            x = x + step * (z - x)
            on &= x > 1e-12 * max(1.0, x.max())
            x[~on] = 0
        x = z
    return x


def patterns(bins: int, least: int) -> list[tuple[int, ...]]:
    """All ways to fill `bins` with one, two or three parts of at least `least`, largest first."""
    two = [(bins - i, i) for i in range(least, bins // 2 + 1)]
    three = [(bins - i - j, j, i) for i in range(least, bins // 3 + 1) for j in range(i, (bins - i) // 2 + 1)]
    return [(bins,), *two, *three]


def plan(histogram: dict[int, int], window: int = WINDOW, width: int = 128, filler: int = 512) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, repeats, first sequence, offset) of every slot, and the number of sequences.

    Lengths are counted in bins of `width` tokens, rounded up. Patterns of up to three bins that fill the window are
    fitted to the histogram by non-negative least squares and their repeat counts rounded down; lengths of up to
    `filler` tokens are left out of the fit, to fill what rounding leaves free. All that remains is packed in
    descending length to the fullest sequence that has room. Works on runs of equal lengths: the cost depends on the
    number of distinct lengths, not on that of documents.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    bins = window // width
    of = lambda n: -(-n // width)
    count = np.zeros(bins + 1)
    for n, c in left.items():
        if filler < n < window:
            count[of(n)] += c
    shapes = patterns(bins, of(filler) + 1)
    a = np.zeros((bins + 1, len(shapes)))
    for j, shape in enumerate(shapes):
        for s in shape:
            a[s, j] += 1
    total = count.sum()
    repeats = np.floor(nnls(a, count / total) * total + 1e-6).astype(np.int64) if total else np.zeros(len(shapes), np.int64)

    groups: list[list] = []  # [slots ((length, how many), ...), repeats, free]
    by_bin: dict[int, list[int]] = {}
    for n in sorted(left):
        if filler < n < window:
            by_bin.setdefault(of(n), []).append(n)  # the largest is at the end
    if window in left:
        groups.append([((window, 1),), left.pop(window), 0])

    def draw(shape: tuple[int, ...], most: int) -> tuple[tuple[int, ...], int] | None:
        """The largest lengths of the shape's bins, and how often they are there together."""
        chosen: dict[int, int] = {}
        got = []
        for s in shape:
            n = next((n for n in reversed(by_bin.get(s, [])) if left.get(n, 0) > chosen.get(n, 0)), None)
            if n is None:
                return None
            chosen[n] = chosen.get(n, 0) + 1
            got.append(n)
        times = min(most, *(left[n] // k for n, k in chosen.items()))
        for n, k in chosen.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
                by_bin[of(n)].remove(n)
        return tuple(got), times

    for j in np.argsort(-repeats, kind="stable"):
        todo = int(repeats[j])
        while todo and (got := draw(shapes[j], todo)):
            groups.append([tuple((n, 1) for n in got[0]), got[1], window - sum(got[0])])
            todo -= got[1]

    free: dict[int, list[int]] = {}
    gaps: list[int] = []

    def offer(g: int) -> None:
        gap = groups[g][2]
        if gap:
            if not free.get(gap):
                bisect.insort(gaps, gap)
            free.setdefault(gap, []).append(g)

    for g in range(len(groups)):
        offer(g)
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            k = bisect.bisect_left(gaps, n)
            if k == len(gaps):
                each = min(window // n, c)
                groups.append([((n, each),), c // each, window - each * n])
                c -= each * (c // each)
                offer(len(groups) - 1)
                continue
            gap = gaps[k]
            g = free[gap].pop()
            if not free[gap]:
                gaps.pop(k)
            slots, times, _ = groups[g]
            each = min(gap // n, max(1, c // times))
            used = min(times, c // each)
            if used < times:  # the rest of the group stays as it was
                groups.append([slots, times - used, gap])
                offer(len(groups) - 1)
            groups[g] = [(*slots, (n, each)), used, gap - each * n]
            offer(g)
            c -= each * used

    out, taken, first = [], {}, 0
    for slots, times, _ in groups:
        at = 0
        for n, each in slots:
            rank = taken.get(n, 0)
            out.append((n, rank, times, first, at))
            taken[n] = rank + each * times
            at += n * each
        first += times
    return out, first


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """pieces (a written table, as from pieces()) plus sequence_id and offset. No sequence exceeds the window; offsets
    are gapless from 0. Which of the pieces of one length goes where follows their order in the input's tasks.

    Only the histogram, at most `window` counts, comes to the driver. Pieces of one length are ranked by counts per
    task of the input, so that a length that many share is never sorted in one place.
    """
    counts = pieces.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_c"))
    counts = written(counts.withColumn("_base", F.sum("_c").over(W.partitionBy("length").orderBy("_part")) - F.col("_c")).withColumnsRenamed({"length": "_l", "_part": "_p"}))
    histogram = {r["_l"]: r["n"] for r in counts.groupBy("_l").agg(F.sum("_c").alias("n")).collect()}
    slots, _ = plan(histogram, window)
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 5)
    ranked = pieces.join(counts.hint("merge"), (pieces["length"] == counts["_l"]) & (pieces["_part"] == counts["_p"])).withColumn("_rank", F.col("_base") + F.col("_nth")).drop("_l", "_p", "_c", "_base", "_part", "_nth")

    def place(batches):
        import pyarrow as pa

        key = table[:, 0] * (1 << 48) + table[:, 1]
        for b in batches:
            n, rank = (np.asarray(b.column(c), np.int64) for c in ("length", "_rank"))
            t = table[np.searchsorted(key, n * (1 << 48) + rank, side="right") - 1] if len(n) else np.zeros((0, 5), np.int64)
            at = rank - t[:, 1]
            keep = [c for c in b.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(t[:, 3] + at % np.maximum(t[:, 2], 1)), pa.array(t[:, 4] + at // np.maximum(t[:, 2], 1) * n)], names=[*keep, "sequence_id", "offset"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank"]
    return mapped(ranked, place, ", ".join([*kept, "sequence_id long", "offset long"]))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece of every row of docs: its id, place in the document and in its sequence, and CRC32 of its ids.

    A null or empty text is one piece of the end id. Rows alike stay apart. A text of any length is cut into windows.
    An empty table gives an empty table. Columns beyond the two named are ignored.
    """
    out = pack(written(pieces(docs, path or tokenizer_path(), id_col, text_col, with_ids=with_ids)))
    return out.select(F.col("_id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset", *(["ids"] * with_ids))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pack_documents(..., with_ids=True): each sequence's ids end to end, at most a window."""
    own = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_all"))
    return own.select("sequence_id", F.flatten("_all.ids").alias("ids"))


def query(spark, docs: DataFrame) -> DataFrame:
    return pack_documents(docs)
