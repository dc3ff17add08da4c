"""The stages against brute force, each on what its predecessor returned."""

import re

import numpy as np

import corpus_pipeline
from twinmark.llm import quality_rules

from test_operators import covered_words

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_stages(spark, tmp_path):
    d = tmp_path / "sf"
    d.mkdir()
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    source.write.parquet(str(d / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(str(d / "labels.parquet"))
    docs, kept = spark.read.parquet(str(d / "documents.parquet")), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(d))
        if i < 4:
            assert out.columns == source.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append({r.doc_id: r.asDict().get("text") for r in docs.collect()})
    before = {r.doc_id: r.text for r in source.collect()}
    rules = quality_rules.fit(source, spark.read.parquet(str(d / "labels.parquet")))
    assert kept[0] == {r.doc["doc_id"]: r.doc["text"] for r in quality_rules.judge(source, rules).filter("kept").collect()}
    assert kept[1].items() <= kept[0].items() <= before.items()
    norm = {re.sub("[\x20\x09-\x0d]", "", t or "") for t in kept[0].values()}
    assert len(kept[1]) == len(norm) == len({re.sub("[\x20\x09-\x0d]", "", t or "") for t in kept[1].values()})

    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in kept[1].items()}
    like = lambda a, b: bool(a) and 100 * len(a & b) >= 75 * len(a | b)
    assert kept[2].items() <= kept[1].items()
    stay = list(kept[2])
    assert not any(like(sets[a], sets[b]) for k, a in enumerate(stay) for b in stay[:k])
    assert all(any(like(sets[i], sets[j]) for j in sets if j != i) for i in sets if i not in kept[2])
    assert set(kept[3]) == set(kept[2]) == set(kept[4])
    # passages of over 50 words that the input has several times go, all else stays
    ids = list(kept[2])
    masks = covered_words([(kept[2][i] or "").encode() for i in ids], 51)
    assert any(m.any() for m in masks)
    for i, m in zip(ids, masks):
        raw = (kept[2][i] or "").encode()
        assert (kept[3][i] or "") == (bytes(np.frombuffer(raw, np.uint8)[~m]).decode("utf-8", "ignore") if m.any() else kept[2][i] or "")
    got = corpus_pipeline.run(spark, str(d)).collect()
    assert {r.doc_id for r in got} == set(kept[4])


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
