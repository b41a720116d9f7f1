"""Exact top-k inner products over a bit-sliced index of quantised vectors (O'Neil and Quass, 1997)."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import mapped, written

#: Rows of an index block, queries of a query block: what one task holds.
ROWS, QUERIES = 1 << 16, 128
#: In place of the number of slices: a block of rows with components too large for slices, kept as doubles.
WIDE = -1


def slices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values (rows, dims) of integers -> lows (dims) and bitmaps (dims, bits, words) of values - lows, low bit first."""
    lows = values.min(0)
    rest = (values - lows).astype(np.uint64)
    bits = max(1, int(rest.max(initial=0)).bit_length())
    out = np.zeros((values.shape[1], bits, -(-len(values) // 64) * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((rest >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little")
        out[:, b, : packed.shape[1]] = packed
    return lows, out.view("<u8")


def signed_digits(v: int) -> list[tuple[int, int]]:
    """(place, +1 or -1) with v = sum of sign * 2**place, no two places adjacent."""
    out, place = [], 0
    while v:
        if v & 1:
            d = 2 - (v & 3)
            out.append((place, d))
            v -= d
        v >>= 1
        place += 1
    return out


def score_slices(bitmaps: np.ndarray, inverse: np.ndarray, query: np.ndarray) -> tuple[list[np.ndarray | None], int]:
    """Bitmaps of sum(query * value) + constant, low bit first, and that constant, by adding the attributes' slices:
    one addend per nonzero signed digit of the query, a negative one as the complement; columns are summed three
    bitmaps to two."""
    bits, constant = bitmaps.shape[1], 0
    columns: list[list[np.ndarray]] = [[] for _ in range(bits)]
    for d, v in enumerate(query.tolist()):
        for place, sign in signed_digits(v):
            while len(columns) < place + bits:
                columns.append([])
            own = bitmaps[d] if sign > 0 else inverse[d]
            constant += 0 if sign > 0 else ((1 << bits) - 1) << place
            for b in range(bits):
                columns[place + b].append(own[b])
    out: list[np.ndarray | None] = []
    w = 0
    while w < len(columns):
        column = columns[w]
        if len(column) > 1 and w + 1 == len(columns):
            columns.append([])
        while len(column) > 2:
            x, y, z = column.pop(), column.pop(), column.pop()
            xy = x ^ y
            column.append(xy ^ z)
            xy &= z
            x = x & y
            x |= xy
            columns[w + 1].append(x)
        if len(column) == 2:
            x, y = column
            columns[w + 1].append(x & y)
            column = [x ^ y]
        out.append(column[0] if column else None)
        w += 1
    return out, constant


def top_rows(score: list[np.ndarray | None], among: np.ndarray, k: int, ids: np.ndarray) -> np.ndarray:
    """The rows of `among` (a bitmap) with the k highest scores, ties to the smaller id, from the top slice down."""
    sure, edge = np.zeros_like(among), among.copy()
    for plane in reversed(score):
        if plane is None:
            continue
        up = edge & plane
        n = int(np.bitwise_count(sure | up).sum())
        if n > k:
            edge = up
        else:
            sure |= up
            edge &= ~plane
            if n == k:
                edge[:] = 0
                break
    rows = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    first, tied = rows(sure), rows(edge)
    room = k - len(first)
    if len(tied) > room:  # the boundary rows: alike in score
        tied = tied[np.lexsort((tied, ids[tied]))[:room]]
    return np.concatenate([first, tied])


def narrow(values: np.ndarray) -> np.ndarray:
    """Which rows of whole numbers (rows, dims) are so small that no inner product of two of them leaves 62 bits."""
    return (np.abs(values) < 2.0 ** ((62 - max(1, values.shape[1]).bit_length()) // 2)).all(1)


def exact_top(values: np.ndarray, query: np.ndarray, ids: np.ndarray, k: int, but: int | None) -> list[tuple[int, int]]:
    """(row, score) of the k best rows of doubles that are whole numbers of any size, in unbounded integers."""
    whole = lambda x: np.array([int(v) for v in x.ravel()], object).reshape(x.shape)
    scores = whole(values) @ whole(query)
    return [(r, scores[r]) for r in heapq.nsmallest(k, (r for r in range(len(ids)) if r != but), key=lambda r: (-scores[r], ids[r], r))]


def beyond(score: int) -> tuple[int, int, bytes | None]:
    """(how far beyond 64 bits, the nearest long, bytes that sort as the score does); 0 and no bytes where it fits."""
    if -(1 << 63) <= score < 1 << 63:
        return 0, score, None
    size = score.bit_length()
    return (size if score > 0 else -size), (1 << 63) - 1 if score > 0 else -(1 << 63), (score + (1 << 2399)).to_bytes(300, "big")


def _opened(maps: np.ndarray, lows: np.ndarray, n: int) -> np.ndarray:
    """The rows of an index block as doubles: the way back from slices()."""
    bits = np.unpackbits(maps.view(np.uint8), axis=2, bitorder="little")[:, :, :n].astype(np.int64)
    return ((bits << np.arange(maps.shape[1])[None, :, None]).sum(1) + lows[:, None]).T.astype(np.float64)


def _blocks(vectors: DataFrame, id_col: str, vec_col: str, scale: float, every: int, n: int) -> DataFrame:
    """One row per index block (kind 0: ids, lows, bitmaps) and per query block (kind 1: place of each query's own row, vectors)."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId() << 24, 0
        held: dict[tuple[int, bool], list] = {}

        def block(dims: int, small: bool, ids: np.ndarray, values: np.ndarray):
            nonlocal made
            name = part + made
            made += 1
            lows, maps = slices(values.astype(np.int64)) if small else (np.zeros(0), None)
            out = [(0, dims, name, ids.tobytes(), lows.astype("<i8").tobytes(), maps.shape[1] if small else WIDE, (maps if small else values).tobytes())]
            asked = np.flatnonzero(ids % every == 0)
            for i in range(0, len(asked), QUERIES):
                own = asked[i : i + QUERIES]
                out.append((1, dims, name, ids[own].tobytes(), own.astype("<i8").tobytes(), i, values[own].tobytes()))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds, strict=True)], names=["kind", "dims", "block", "ids", "a", "b", "data"])

        for batch in batches:
            vec = batch.column("_v")
            ids = np.asarray(batch.column("_id"))
            sizes = np.diff(np.asarray(vec.offsets))
            flat = vec.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for dims in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == dims)
                x = flat[starts[rows][:, None] + np.arange(dims)]
                good = np.isfinite(x).all(1)
                with np.errstate(over="ignore"):
                    v, own = np.floor(scale * x[good]), ids[rows][good]
                real = np.isfinite(v).all(1)
                v, own = v[real], own[real]
                small = narrow(v)
                for kind in (True, False):
                    pick = small == kind
                    parts = held.setdefault((int(dims), kind), [])
                    parts.append((own[pick], v[pick]))
                    while sum(len(i) for i, _ in parts) >= ROWS:
                        i, w = (np.concatenate(y) for y in zip(*parts, strict=True))
                        yield block(int(dims), kind, i[:ROWS], w[:ROWS])
                        parts[:] = [(i[ROWS:], w[ROWS:])]
        for key, parts in held.items():
            i, w = (np.concatenate(y) for y in zip(*parts, strict=True))
            if len(i):
                yield block(*key, i, w)

    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_v")).where("_id IS NOT NULL AND _v IS NOT NULL")
    return mapped(rows.repartition(n), run, "kind int, dims int, block long, ids binary, a binary, b int, data binary")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k rows with the highest
    inner product of components taken as floor(scale * x), ties to the smaller id; every row but the query's own.

    Rows whose vector is null or empty, or holds a null or non-finite component, and rows without an id take no part.
    Vectors of different lengths don't meet. Repeated ids are separate rows, as queries too. Components may have
    any size: rows with such that a product could leave 62 bits are kept apart, as whole doubles, and multiplied in
    unbounded integers. Ranks go by the exact score; a score beyond 64 bits is given as the nearest long. A component
    whose scaled value is no finite double counts as non-finite. An empty table gives an empty table.

    Rows are dealt into index blocks of at most ROWS, query rows into blocks of QUERIES; each query block meets each
    index block once, and a task holds one of both. Every row is indexed and every slice added, so recall is 1.
    """
    spark = vectors.sparkSession
    n = max(1, -(-vectors.count() // ROWS))
    made = written(_blocks(vectors, id_col, vec_col, scale, every, n))
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = made.where("kind = 0").select("dims", "block", "ids", F.col("a").alias("lows"), F.col("b").alias("bits"), "data")
    asked = made.where("kind = 1").select(F.col("dims").alias("q_dims"), F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("a").alias("q_rows"), (F.col("b") / QUERIES).cast("long").alias("q_nth"), F.col("data").alias("queries"))
    # a grid of tasks: an index block is copied to the columns of its row, a query block to the rows of its column
    across = min(8, spread)
    down = max(1, spread // across)
    index = index.withColumns({"_i": F.pmod("block", F.lit(down)).cast("int"), "_q": F.explode(F.sequence(F.lit(0), F.lit(across - 1)))})
    asked = asked.withColumns({"_i": F.explode(F.sequence(F.lit(0), F.lit(down - 1))), "_q": F.pmod(F.col("q_block") + F.col("q_nth"), F.lit(across)).cast("int")})
    pairs = index.join(asked, ["_i", "_q"]).where("dims = q_dims").drop("_i", "_q", "q_dims", "q_nth")

    def run(batches):
        import pyarrow as pa

        held, maps, inverse, ids = None, None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                if held != r["block"]:
                    held, ids, small = r["block"], np.frombuffer(r["ids"], np.int64), r["bits"] != WIDE
                    maps = np.frombuffer(r["data"], "<u8" if small else "<f8").reshape(r["dims"], r["bits"], -1) if small else np.frombuffer(r["data"], "<f8").reshape(-1, r["dims"])
                    inverse = ~maps if small else None
                    lows = np.frombuffer(r["lows"], "<i8")
                    every_row = np.packbits(np.arange(maps.shape[2] * 64) < len(ids), bitorder="little").view("<u8") if small else None
                queries, own = np.frombuffer(r["queries"], "<f8").reshape(-1, r["dims"]), np.frombuffer(r["q_rows"], "<i8")
                out = []
                for q, fits, row, name in zip(queries, narrow(queries), own.tolist(), np.frombuffer(r["q_ids"], np.int64).tolist(), strict=True):
                    but = row if r["q_block"] == held else None
                    if not (small and fits):
                        table = maps if small is False else _opened(maps, lows, len(ids))
                        best = exact_top(table, q, ids, k, but)
                    else:
                        q = q.astype(np.int64)
                        score, constant = score_slices(maps, inverse, q)
                        among = every_row.copy()
                        if but is not None:
                            among[row // 64] &= ~(np.uint64(1) << np.uint64(row % 64))
                        base = int(q @ lows) - constant
                        best = [(t, base + sum(((int(p[t // 64]) >> (t % 64)) & 1) << w for w, p in enumerate(score) if p is not None)) for t in top_rows(score, among, k, ids).tolist()]
                    for t, s in best:
                        over, score_, tail = beyond(s)
                        out.append((r["q_block"], row, name, int(ids[t]), score_, over, tail))
                columns = list(zip(*out)) or [[]] * 7
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["q_block", "q_row", "query_id", "vec_id", "score", "over", "tail"])

    found = mapped(pairs, run, "q_block long, q_row long, query_id long, vec_id long, score long, over int, tail binary")
    order = W.partitionBy("q_block", "q_row").orderBy(F.col("over").desc(), F.col("tail").desc(), F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, vectors: DataFrame) -> DataFrame:
    return top_k(vectors)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
