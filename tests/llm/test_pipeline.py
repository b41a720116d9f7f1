import corpus_pipeline
from tests.llm.corpora import DOCS, docs, rows
from tests.llm.test_learned_operators import two_languages


def test_stages_follow_each_other(spark, tmp_path):
    own, _ = two_languages(200)
    line = "this very line is in many of the documents of the corpus"
    own = [(i, t + ("\n" + line if i % 9 == 0 else ""), lang, f"s{i % 4}", len(t)) for i, t, lang, _, _ in own]
    own += [(900, None, None, None, None), (901, "123 456", None, "s1", 7), (902, own[5][1], "en", "s2", 5), (903, own[5][1], "en", "s2", 5)]
    now, kept = docs(spark, own), []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept.append(now)
        assert name == "packing" or now.columns == DOCS.names
    ids = [{r["doc_id"] for r in k.collect()} for k in kept]
    assert ids[0] == {r[0] for r in own} - {900, 901}
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept[1].collect()}
    assert ids[1] == ids[0] and sum(line in t for t, _ in texts.values()) == 1 and all(len(t) == n for t, n in texts.values())
    assert len({5, 902, 903} & ids[2]) == 1 and ids[2] < ids[1]
    words = lambda k: sum(len((r["text"] or "").split()) for r in k.collect())
    assert abs(words(kept[3]) - 1.5 * words(kept[2])) < 0.1 * words(kept[2])
    assert ids[4] == ids[3] and kept[4].where("offset + length > 4096").count() == 0


def test_run_reads_documents(spark, tmp_path):
    docs(spark, rows()).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and "sequence_id" in out.columns


def test_stages_keep_clashing_columns(spark, tmp_path):
    own, _ = two_languages(60)
    names = ["_id", "_th", "_kept", "_n_lines", "_n_dropped", "_found", "_key", "source_size", "target", "epochs", "cut", "_drop", "length", "pos", "_fp"]
    df = docs(spark, own).selectExpr("*", *[f"'extra {n}' AS `{n}`" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and out.count() > 0, name
        assert all(r[n] == f"extra {n}" for r in out.limit(5).collect() for n in names)
