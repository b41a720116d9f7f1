import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import components, fingerprints, lines, mixing, packing, simhash, substrings
from sluice.llm.common import join_small, shared_dir, written
from tests.llm.corpora import DOCS, clashing, docs, duck, rows

MODULES = {"fingerprints": fingerprints, "lines": lines, "mixing": mixing, "packing": packing, "simhash": simhash, "substrings": substrings}


@pytest.mark.parametrize("name", MODULES)
def test_empty_tables_and_clashing_columns(spark, name):
    empty = docs(spark, [])
    assert MODULES[name].query(spark, empty).count() == 0
    own = docs(spark, rows()[:12])
    a, b = MODULES[name].query(spark, own), MODULES[name].query(spark, clashing(own))
    assert a.columns == b.columns and a.count() == b.count() == (12 if name != "packing" else a.count())


@pytest.mark.parametrize("name", MODULES)
def test_repeated_rows_and_null_ids(spark, name):
    own = [*rows()[:8], rows()[2], rows()[2], (None, "x y z", None, None, 5), (None, None, None, None, None)]
    out = MODULES[name].query(spark, docs(spark, own))
    assert out.count() == len(own)
    assert out.where("doc_id = 6").count() == 3 and out.where("doc_id IS NULL").count() == 2


def test_fingerprints(spark):
    own = rows()
    got = {r["doc_id"]: r for r in fingerprints.query(spark, docs(spark, own)).collect()}
    order = sorted(own, key=lambda r: -r[0])
    for r, nxt in zip(order, [*order[1:], order[0]], strict=True):
        t, u = r[1] or "", nxt[1] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + u[:k]
        g = got[r[0]]
        assert (g["n_chars"], g["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (g["fingerprint"] == got[nxt[0]]["fingerprint"]) == (sorted(t.split("\n")) == sorted(u.split("\n")))
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
        assert (g["near_edited"] == 1) == (sorted(edited.split("\n")) == sorted(t.split("\n")))
    long = [r[0] for r in own if r[1] and len(r[1]) > 300 and r[0] != 51]
    assert np.mean([got[i]["near_edited"] for i in long]) > 0.5 > 0.4 > np.mean([got[i]["near_next"] for i in long])


def test_fingerprints_are_homomorphic(spark):
    df = spark.createDataFrame([(1, "a b c d\nsecond line here\n"), (2, "\nsecond line here\na b c d"), (3, "a b c d"), (4, "second line here"), (5, "")], "k int, text string")
    lanes = {r["k"]: r["lanes"] for r in fingerprints.lane_sums(df, ["k"], "text").collect()}
    assert lanes[1] == lanes[2] != lanes[3]
    t = spark.createDataFrame([(lanes[3], lanes[4], lanes[5], lanes[1])], "a array<long>, b array<long>, c array<long>, all array<long>")
    got = t.select(fingerprints.combine(fingerprints.combine(F.col("a"), F.col("b")), F.col("c")).alias("sum"), fingerprints.combine(F.col("all"), F.col("b"), -1).alias("less"), fingerprints.combine(F.col("a"), F.col("c")).alias("rest"), fingerprints.from_hex(fingerprints.to_hex(F.col("all"))).alias("back")).first()
    assert got["sum"] == got["back"] == lanes[1] and got["less"] == got["rest"]


def test_line_dedup_is_what_its_sql_says(spark):
    own = rows()
    got = sorted(map(tuple, lines.query(spark, docs(spark, own)).collect()))
    assert got == sorted(duck(own).sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({lines.ORACLE})").fetchall())
    assert sum(g[2] for g in got) > 5


def test_line_dedup_of_many_lines(spark):
    text = "\n".join(f"this line number {k} is long enough to count as one" for k in range(3000))
    own = [(i, text + f"\nown {i}", None, None, 0) for i in range(6)]
    got = {r["doc_id"]: (r["_found"]["n_dropped"], r["_found"]["kept"]) for r in lines.drop_shared_lines(docs(spark, own)).collect()}
    assert got[5] == (0, text + "\nown 5") and all(got[i] == (3000, f"own {i}") for i in range(5))


def brute_simhash(own):
    from xxhash import xxh64_intdigest

    fp = {}
    for i, t, *_ in own:
        w = (t or "").encode().lower().split()
        h = [xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        fp[i] = sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))
    least = {}
    todo = set(fp)
    while todo:
        group, edge = set(), [min(todo)]
        while edge:
            i = edge.pop()
            if i not in group:
                group.add(i)
                edge += [j for j in todo if (fp[i] ^ fp[j]).bit_count() <= 2]
        least |= dict.fromkeys(group, min(group))
        todo -= group
    return {i: (f"{fp[i]:016x}", least[i]) for i in fp}


def test_simhash(spark):
    own = rows()
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.query(spark, docs(spark, own)).collect()}
    assert got == brute_simhash(own)
    kept = simhash.one_of_each(docs(spark, own))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in got.values()}) and kept.columns == DOCS.names
    twice = docs(spark, [own[2], own[2], own[5]])
    assert sorted(r["doc_id"] for r in simhash.one_of_each(twice).collect()) == [6, 15]


def test_simhash_links_in_a_dense_group(spark):
    rnd = np.random.default_rng(3)
    base = int(rnd.integers(1 << 62))
    fps = {base}
    while len(fps) < 400:
        x = base
        for b in rnd.integers(0, 20, rnd.integers(1, 5)):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {int(x) for x in rnd.integers(0, 1 << 62, 200)}
    df = spark.createDataFrame([(f,) for f in fps], "_fp long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(df)).collect()}
    parent = {f: f for f in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    all_ = sorted(fps)
    for i, a in enumerate(all_):
        for b in all_[:i]:
            if (a ^ b).bit_count() <= 2:
                lo, hi = sorted((top(a), top(b)))
                parent[hi] = lo
    assert all(roots.get(f, f) == top(f) for f in fps)


def test_components_of_a_chain(spark):
    n = 200
    order = np.random.default_rng(1).permutation(n).tolist()
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1001)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(n), 0) | {1000: 1000, 1001: 1000}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_substrings(own, window):
    words = {i: (t or "").encode().split() for i, t, *_ in own}
    count = Counter(tuple(w[k : k + window]) for w in words.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = bytearray(len(w))
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = b"\1" * window
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("step", [1 << 18, 700])
def test_substring_dedup(spark, step, monkeypatch):
    own = rows()
    monkeypatch.setattr(substrings, "STEP", step)
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.query(spark, docs(spark, own)).collect()}
    assert got == brute_substrings(own, 35)


def test_anchors_depend_on_the_window_alone():
    rnd = np.random.default_rng(5)
    for vocabulary in (2, 5, 1000):
        words = rnd.integers(0, vocabulary, 400).astype(np.uint64)
        words[100:180] = words[250:330]
        begin, name = substrings.anchors(words)
        for p in range(100, 145):
            q = p + 150
            assert name[p] == name[q] and (begin[p] < 0) == (begin[q] < 0) and (begin[p] < 0 or begin[q] - begin[p] == 150)
        inside = begin >= 0
        at = np.arange(len(begin))
        assert (begin[inside] >= at[inside] + substrings.AROUND).all() and (begin[inside] < at[inside] + 35).all()
        if vocabulary == 1000:
            assert inside.mean() > 0.99 and len(np.unique(begin)) < len(words) / 8


def test_mixing(spark):
    own = [(i, "w " * (1 + i % 50), None, ["a", "b", "c", None][0 if i % 3 else i % 4], 0) for i in range(3000)]
    out = [r.asDict() for r in mixing.query(spark, docs(spark, own)).collect()]
    again = [r.asDict() for r in mixing.query(spark, docs(spark, own).repartition(7)).collect()]
    key = lambda r: r["doc_id"]
    assert sorted(out, key=key) == sorted(again, key=key)
    source = {i: s for i, _, _, s, _ in own}
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        s = source[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["size"] == 1 + r["doc_id"] % 50 and r["taken"] <= 2 * r["size"]
    names = [*sorted(s for s in size if s is not None), None]
    weight, goal, left = dict(zip(names, [3, 1, 2, 3], strict=True)), {}, 1.5 * sum(size.values())
    free = set(names)
    while True:  # the excess reshared until none is above
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * size[s]}
        if not full:
            break
        goal |= {s: 2 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        free -= full
    goal |= {s: level * weight[s] for s in free}
    for s in names:
        assert target[s] == pytest.approx(goal[s]) and abs(taken[s] - goal[s]) <= 25
    mixed = mixing.mix(docs(spark, own))
    assert mixed.columns == DOCS.names
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert all(times[r["doc_id"]] * r["size"] == r["taken"] for r in out)


def test_mixing_prefers_quality(spark):
    own = [(i, ("good words here " if i % 2 else "1234 5678 9012 ") * 5, None, "abc"[i // 2000], 0) for i in range(6000)]
    out = mixing.query(spark, docs(spark, own)).where("doc_id >= 2000 AND doc_id < 4000 AND taken > 0").select((F.col("doc_id") % 2).alias("good")).groupBy("good").count().collect()
    n = {r["good"]: r["count"] for r in out}
    assert n[1] > 1.05 * n[0]


def test_packing(spark):
    from tokenizers import Tokenizer

    own = [*rows(), (999, "Don't <|endoftext|>.STOP <|ENDOFTEXT|> ﬁ Å Å İx 12ab, ..., a.b.c x y 한국어 \U0001d538!?", None, None, 0)]
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = set()
    for i, t, *_ in own:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), 4096)):
            want.add((i, p, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())))
    out = packing.query(spark, docs(spark, own)).collect()
    assert {tuple(r)[:5] for r in out} == want and len(out) == len(want)
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 4096
    assert len(by) <= np.ceil(sum(r["length"] for r in out) / 4096) + 1


def test_packing_of_no_words(spark):
    out = packing.query(spark, docs(spark, [(1, None, None, None, None), (2, " ", None, None, 1), (3, "...", None, None, 3), (4, "a...", None, None, 4)])).collect()
    assert sorted((r["doc_id"], r["length"]) for r in out) == [(1, 1), (2, 1), (3, 2), (4, 3)]


def test_packed_sequences_hold_the_ids(spark):
    packed = packing.pack_documents(docs(spark, rows()[:10]), with_ids=True)
    seqs = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert seqs[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_document_once(seed):
    rnd = np.random.default_rng(seed)
    n = [5, 300, 5000, 40_000][seed]
    sizes = np.clip(np.exp(rnd.normal(6 + seed / 2, 1.2, n)).astype(int) + 1, 1, 4096)
    histogram = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))
    slots, total = packing.plan(histogram)
    used, fill = Counter(), Counter()
    for length, rank, times, first, at in sorted(slots):
        assert rank == used[length]
        own = [s for s in slots if s[0] == length and s[1] > rank]
        end = min((s[1] for s in own), default=histogram[length])
        used[length] += end - rank
        for k in range((end - rank) // times):
            for s in range(first, first + times):
                fill[s] += length
    assert used == histogram and max(fill.values()) <= 4096 and len(fill) == total
    assert total <= 1.02 * np.ceil(sizes.sum() / 4096) + 1 or sizes.min() > 1365


def test_nnls():
    a, b = np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([1.0, -1.0])
    assert packing.nnls(a, b) == pytest.approx([1.0, 0.0])
    rnd = np.random.default_rng(0)
    a, x = rnd.random((20, 8)), np.maximum(0, rnd.normal(size=8))
    assert packing.nnls(a, a @ x) == pytest.approx(x, abs=1e-6)


def test_tables_are_cut_in_the_shared_folder(spark):
    df = written(spark.range(3))
    assert df.sluice_path.startswith(shared_dir(spark)) and os.path.isdir(df.sluice_path)
    big, small = spark.createDataFrame([("a", 1), (None, 2), ("a", 3), ("z", 4)], "k string, v int"), spark.createDataFrame([("a", 10), (None, 20)], "s string, w int")
    for most in (100, 1):
        assert sorted(map(tuple, join_small(big, small, "k", "s", most=most).collect()), key=str) == sorted([("a", 1, 10), (None, 2, 20), ("a", 3, 10), ("z", 4, None)], key=str)


def test_ids_of_words_met_again(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    for most in (150_000, 5):
        monkeypatch.setattr(packing, "CACHED", most)
        ids = packing.Ids(packing.tokenizer_path())
        for texts in (["...", "a... b!", "x."], ["new words, here... now", "a x b ...", ""], ["here now words!", ". ! ?"]):
            flat, at = ids.batch(pa.array(texts))
            assert [flat[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
