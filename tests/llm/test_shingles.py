import random

import pytest

import corpus_pipeline
from sluice.llm import shingles
from tests.llm.corpora import docs, rows


def planted():
    """Texts, with copies of some in which one to twelve words are changed, and a passage that many share."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(30)]
    out = []
    for i in range(40):
        words = [word() for _ in range(rnd.choice([3, 5, 30, 90, 300]))]
        out.append(words + (passage if i % 2 else []))
        for changes in (1, 2, 4, 12):
            copy = list(out[-1])
            for _ in range(changes):
                copy[rnd.randrange(len(copy))] = word()
            out.append(copy)
    return [(i, " ".join(w).upper() if i % 7 == 0 else "  ".join(w), "en", "s", 0) for i, w in enumerate(out)]


def brute(own):
    """The least id of each row's group, by all pairs."""
    sets = {r[0]: shingles.shingles((r[1] or "").encode().lower().split()) for r in own}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] | sets[b])
            if a < b and (10 * len(sets[a] & sets[b]) >= 8 * both):
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    return root


@pytest.mark.parametrize("few", [64, 3])
def test_near_copies_are_all_found(spark, few, monkeypatch):
    monkeypatch.setattr(shingles, "FEW", few)  # with few, most cells go by rounds of leaders
    for own in (planted(), rows()):
        got = {r["_id"]: r["_component"] for r in shingles.near_copies(docs(spark, own)).collect()}
        assert got == brute(own)


def test_pipeline_drops_near_copies(spark):
    own = planted()
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs(spark, own), "").collect()}
    assert kept == set(brute(own).values())
    assert len(kept) < len(own)


def test_near_copies_of_an_empty_table(spark):
    assert shingles.near_copies(docs(spark, [])).count() == 0


def test_sketches_differ_in_no_more_bits_than_sets_do(spark):
    from fractions import Fraction

    import numpy as np
    from pyspark.sql import functions as F

    rnd = np.random.default_rng(8)
    rows, want = [], {}
    for k in range(60):
        base = rnd.integers(0, 1 << 62, int(rnd.integers(5, 3000)))
        gone = int(len(base) * rnd.choice([0, 0.05, 0.1, 0.3, 1]))
        pair = [np.unique(base), np.unique(np.concatenate([base[gone:], rnd.integers(0, 1 << 62, gone)]))]
        for side, x in enumerate(pair):
            sketch = shingles._sketches(np.zeros(len(x), int), x.astype(np.uint64), np.array([len(x)]))
            rows.append((2 * k + side, len(x), sketch[0].as_py()))
        met = len(np.intersect1d(*pair))
        want[2 * k] = met / (len(pair[0]) + len(pair[1]) - met)
    sets = spark.createDataFrame(rows, "_fp long, _n int, _sketch array<long>")
    pairs = shingles.written(spark.range(60).select((F.col("id") * 2).alias("a"), (F.col("id") * 2 + 1).alias("b")))
    got = {r["a"] for r in shingles.possible(pairs, sets, Fraction(4, 5)).collect()}
    assert {k for k, j in want.items() if j >= 0.8} <= got and not {k for k, j in want.items() if j < 0.05} & got


def one_word_changed():
    """Texts of 300 words, each with a copy that has another word in one place, and some unlike all others."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    out = []
    for _ in range(30):
        words = [word() for _ in range(300)]
        copy = list(words)
        copy[rnd.randrange(300)] = word()
        out += [words, copy, [word() for _ in range(200)]]
    return [(i, " ".join(w), "en", "s", 0) for i, w in enumerate(out)]


def test_stage_finds_near_copies_by_simhash(spark, monkeypatch):
    exact = shingles.cells
    monkeypatch.setattr(shingles, "cells", lambda sets: exact(sets).limit(0))  # without the exact search that follows
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs(spark, one_word_changed()), "").collect()}
    assert kept == {i for i in range(90) if i % 3 != 1}


def test_exact_search_adds_what_simhash_misses(spark, monkeypatch):
    found = []
    monkeypatch.setattr(shingles, "by_simhash", lambda sets, real=shingles.by_simhash: found.append(real(sets).collect()) or real(sets))
    own = planted()
    exact = shingles.cells
    want = brute(own)
    assert {r["_id"]: r["_component"] for r in shingles.near_copies(docs(spark, own)).collect()} == want
    monkeypatch.setattr(shingles, "cells", lambda sets: exact(sets).limit(0))
    by_sim = {r["_id"]: r["_component"] for r in shingles.near_copies(docs(spark, own)).collect()}
    assert found[0] and len(set(want.values())) < len(set(by_sim.values())) < len(own)


@pytest.mark.parametrize("n", [0, 1, 400])
def test_wide_links_join_all_within_eight_bits(spark, n):
    from sluice.llm import simhash

    rnd = random.Random(n)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    far = [rnd.getrandbits(64) for _ in range(n)]
    flips = {x: rnd.sample(range(64), 1 + i % 16) for i, x in enumerate(far)}
    fps = far + [x ^ sum(1 << k for k in flips[x]) for x in far]
    got = {(r["a"], r["b"]) for r in simhash.wide_links(spark.createDataFrame([(signed(x),) for x in fps], "_fp long"), 11).collect()}
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert all(a < b and apart(a, b) <= 11 for a, b in got)
    for x, y in zip(fps, fps[n:], strict=False):
        if apart(x, y) <= 8:
            assert (min(signed(x), signed(y)), max(signed(x), signed(y))) in got
