"""SimHash near-dedup: fingerprints, a grid join over segment bit counts, and exact verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import dropped, join_salted, mapped, written
from sluice.llm.components import components

BITS, SEGMENT, RADIUS = 64, 4, 2
#: Place and size of each third of the bits; fingerprints that are verified against each other in one place, at most.
THIRDS, MANY = ((0, 21), (21, 21), (42, 22)), 64
#: Fingerprints that one is compared with in a bucket of a cell of one third's grid, at most.
AHEAD = 2048


def simhash(text: bytes | None, run: int = 3, step: int = 1 << 18) -> int:
    """The 64-bit SimHash of a text's runs of `run` words, as a signed number; 0 where there is no word."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # of bytes: A-Z and ASCII white space alone
    n = max(len(words) - run + 1, min(1, len(words)))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, step):  # a long text takes memory for one step only
        part = words[i : i + step + run - 1]
        runs = zip(*(part[k:] for k in range(run))) if len(words) >= run else [words]
        h = np.fromiter((xxh64_intdigest(b" ".join(x), 42) for x in runs), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _th, _fp) per row of docs: its id, a hash of its text, its SimHash."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fps = [simhash(t) for t in b.column("_text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_th"), pa.array(fps, pa.int64())], names=["_id", "_th", "_fp"])

    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))
    return mapped(rows, run, f"_id {docs.schema[id_col].dataType.simpleString()}, _th bigint, _fp bigint")


def _cells(fp: Column, first: int = 0, bits: int = BITS) -> Column:
    """The grid cells within Manhattan distance 1 of fp's vector of segment bit counts, three bits a coordinate; the
    segments are those of the `bits` bits from `first` on, which is told above 48 bits."""
    sizes = [min(SEGMENT, bits - i) for i in range(0, bits, SEGMENT)]
    counts = [F.bit_count(F.shiftrightunsigned(fp, first + SEGMENT * i).bitwiseAND(F.lit((1 << size) - 1))).cast("long") for i, size in enumerate(sizes)]
    at = sum((F.shiftleft(c, 3 * i) for i, c in enumerate(counts[1:], 1)), counts[0] + F.lit(first << 48) if first else counts[0])
    up = [F.when(c < sizes[i], at + (1 << 3 * i)) for i, c in enumerate(counts)]
    down = [F.when(c > 0, at - (1 << 3 * i)) for i, c in enumerate(counts)]
    return F.array_compact(F.array(at, *up, *down))


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) that join the same fingerprints, of the distinct ones in fps (_fp), as all pairs at RADIUS or fewer bits do.

    Two fingerprints at 2 or fewer bits have segment counts at Manhattan distance 2 or less, and so a cell of the grid
    at distance 1 or less from both. A cell that holds just two fingerprints gives them as a pair to verify. A fuller
    cell is cut into buckets by each third of the bits, as two fingerprints at 2 or fewer bits are alike in one third;
    the fingerprints of a bucket are verified against each other where they are MANY or fewer. Where they are more, a
    bucket's fingerprints meet with one bit changed: two share such a value just if they are at 2 or fewer bits, and no
    value has more than 65 about it. So a dense group yields stars, not all its pairs, and no task holds all of it.
    """
    # few bytes a row become many rows: dealt evenly first
    fps = fps.select("_fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_fp")
    cells = fps.select("_fp", F.explode(_cells(F.col("_fp"))).alias("_cell"))
    few = [F.count(F.lit(1)).alias("n"), F.min("_fp").alias("a"), F.max("_fp").alias("b")]
    met = written(cells.groupBy("_cell").agg(*few).where("n > 1"))
    full = cells.join(met.where("n > 2").select("_cell"), "_cell", "left_semi")
    thirds = F.array(*[F.shiftrightunsigned("_fp", at).bitwiseAND(F.lit((1 << size) - 1)) for at, size in THIRDS])
    bucket = ["_cell", "_third", "_bits"]
    full = written(full.select("_fp", "_cell", F.posexplode(thirds).alias("_third", "_bits")))
    deep = written(full.groupBy(*bucket).agg(*few).where("n > 1"))
    is_near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    pairs = met.where("n = 2").select("a", "b").unionByName(deep.where("n = 2").select("a", "b")).where(is_near)

    some = full.join(deep.where((F.col("n") > 2) & (F.col("n") <= MANY)).select(*bucket), bucket, "left_semi")
    some = some.groupBy(*bucket).agg(F.array_sort(F.collect_list("_fp")).alias("_all"))  # MANY at most
    some = some.select("_all", F.posexplode("_all").alias("_at", "a")).select("a", F.explode(F.filter(F.slice("_all", F.col("_at") + 2, F.lit(MANY)), lambda y: F.bit_count(F.col("a").bitwiseXOR(y)) <= RADIUS)).alias("b"))

    crowd = full.join(deep.where(F.col("n") > MANY).select(*bucket), bucket, "left_semi").select("_fp").distinct()
    near = crowd.select("_fp", F.explode(F.array(F.col("_fp"), *[F.col("_fp").bitwiseXOR(F.lit(v - (1 << BITS) if v >= 1 << BITS - 1 else v)) for v in (1 << i for i in range(BITS))])).alias("_near"))
    stars = near.groupBy("_near").agg(F.collect_set("_fp").alias("_all")).where(F.size("_all") > 1)  # 65 at most
    stars = stars.select(F.array_min("_all").alias("a"), F.explode("_all").alias("b")).where("a <> b")
    return pairs.unionByName(some).unionByName(stars).distinct()


def _linked(cell, fp, radius: int):
    """Of fingerprints `fp` in cells `cell` of a third's grid: per bucket each with the next one at
    `radius` or fewer bits, as arrays a < b. A bucket holds those of a cell alike in one third of the cell's third of the bits."""
    import numpy as np

    first = cell >> 48
    own = (fp >> first) & np.select([first == x for x, _ in THIRDS], [(1 << size) - 1 for _, size in THIRDS])
    pairs = [np.zeros((2, 0), np.int64)]
    for k in range(3):
        bits = own >> 7 * k if k == 2 else (own >> 7 * k) & 127
        order = np.lexsort((fp, bits, cell))
        f = fp[order]
        new = np.flatnonzero((np.diff(cell[order]) != 0) | (np.diff(bits[order]) != 0)) + 1
        edge = np.concatenate([[0], new, [len(f)]])
        end = np.repeat(edge[1:], np.diff(edge))
        i = np.arange(len(f))
        for ahead in range(1, AHEAD + 1):
            i = i[i + ahead < end[i]]
            if not len(i):
                break
            near = np.bitwise_count((f[i] ^ f[i + ahead]).view(np.uint64)) <= radius
            pairs.append(np.stack([f[i[near]], f[i[near] + ahead]]))
            i = i[~near]
    return np.unique(np.concatenate(pairs, axis=1), axis=1)


def wide_links(fps: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b), a < b, at `radius` or fewer bits of the distinct fingerprints in fps (_fp), by the grid of each third of the bits.

    Two fingerprints at 8 or fewer bits have 2 or fewer of them in one third, and so a cell of this third's grid at
    distance 1 or less from both, and one of three buckets of it; most of those at a few bits more have so too. In each bucket a
    fingerprint is linked to the next one within the radius, among the AHEAD that follow, so a dense group gives chains
    and not all its pairs. Fingerprints beyond 8 bits, or linked elsewhere in their buckets, can stay apart: what must
    miss no pair has to look for the rest by other means.
    """
    cells = F.concat(*[_cells(F.col("_fp"), first, size) for first, size in THIRDS])
    cells = fps.select("_fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_fp").select("_fp", F.explode(cells).alias("_cell"))

    def link(batches):
        import numpy as np
        import pyarrow as pa

        def done(cell, fp):
            a, b = _linked(cell, fp, radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        cell, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                cell = np.concatenate([cell, batch.column("_cell").to_numpy()])
                fp = np.concatenate([fp, batch.column("_fp").to_numpy()])
                last = int(np.searchsorted(cell, cell[-1]))  # rows come by cell; the last one can go on in the next batch
                if last:
                    yield done(cell[:last], fp[:last])
                    cell, fp = cell[last:], fp[last:]
        if len(cell):
            yield done(cell, fp)

    return mapped(cells.repartition("_cell").sortWithinPartitions("_cell"), link, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _th, _fp, _component) per row of docs: fingerprints at RADIUS or fewer bits link, and `_component` is the
    smallest id reachable, itself included.

    Null and empty texts have fingerprint 0 and link like others. A null id is in a component without naming it; a
    component with no other id has null. Repeated rows stay, in one component. An empty table gives an empty table.
    Copies meet once, as one fingerprint. All columns but the two named are ignored.
    """
    return grouped(written(fingerprints(docs, id_col, text_col)), links)


def grouped(rows: DataFrame, link) -> DataFrame:
    """rows (a written table of _id, _th, _fp) plus `_component` by the pairs (a, b) of `_fp` that link(fps) gives."""
    fps = written(rows.groupBy("_fp").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")))
    root = components(link(fps))
    root = written(root.join(fps, root["node"] == fps["_fp"]).select("_fp", "root", "_first"))
    least = written(root.groupBy("root").agg(F.min("_first").alias("_least"), F.count(F.lit(1)).alias("_many")))
    of = join_salted(root, least, ["root"], "_many", root.count()).select("_fp", "_least")
    component = written(fps.join(of, "_fp", "left").select("_fp", "_n", F.coalesce("_least", "_first").alias("_component")))
    dropped(root)
    dropped(least)
    dropped(fps)
    return join_salted(rows, component, ["_fp"], "_n", rows.count()).select("_id", "_th", "_fp", "_component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: DataFrame | None = None) -> DataFrame:
    """docs with one row of each component, of near_duplicates or as `found` says: that with the smallest id, of these that with the smallest hash of its
    text, of repeated rows any. Rows without an id stay only where the whole component has none."""
    rows = near_duplicates(docs, id_col, text_col) if found is None else found
    rows = written(rows.withColumn("_c", F.coalesce(F.col("_component").cast("string"), F.concat(F.lit("fp"), F.col("_fp").cast("string")))))
    keep = rows.groupBy("_c").agg(F.min(F.struct(F.col("_id").isNull().alias("z"), "_id", "_th")).alias("_k")).select(F.col("_k._id").alias("_kid"), F.col("_k._th").alias("_kth"))
    keep = keep.withColumnsRenamed({"_kid": "_sluice_id", "_kth": "_sluice_kept"})
    texts = docs.withColumn("_sluice_th", F.xxhash64(text_col))
    met = texts.join(keep, texts[id_col].eqNullSafe(keep["_sluice_id"]) & (texts["_sluice_th"] == keep["_sluice_kept"]))
    if rows.groupBy("_id", "_th").count().where("count > 1").isEmpty():
        return met.select(*docs.columns)
    return met.dropDuplicates([id_col, "_sluice_th"]).select(*docs.columns)


def query(spark, docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))
