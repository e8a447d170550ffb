"""The pipeline on the smallest tables: each stage against a plain version of its decision."""

import corpus_pipeline as P
from crewlens.llm import bpe, quality
from crewlens.llm.queries import queries

from ..conftest import MIDDLE, SMALL


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    tables = [docs]
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, tables[-1], SMALL).write.parquet(str(tmp_path / str(i)))
        tables.append(spark.read.parquet(str(tmp_path / str(i))))
    raw, good, distinct, private, mixed, encoded = tables
    assert all(t.columns == docs.columns for t in tables[:-1])
    model = quality.fit(raw, spark.read.parquet(f"{SMALL}/labels.parquet"), "quality", ~quality.held_out())
    scores = {r.doc_id: r.score for r in quality.score(raw, model).collect()}
    assert {r.doc_id for r in good.select("doc_id").collect()} == {d for d, s in scores.items() if s >= 0.5}
    # Five-word shingles with a similarity of 0.8 or more, as the contract of the stage has it: of each group the least doc_id stays.
    sets = {r.doc_id: shingles(r.text) for r in good.collect()}
    root = {d: d for d in sets}
    for d in sets:
        for e in sets:
            if e < d and similar(sets[d], sets[e]):
                low, high = sorted((root[d], root[e]))
                root = {k: low if r == high else r for k, r in root.items()}
    kept = {r.doc_id for r in distinct.collect()}
    assert kept == {d for d in root if root[d] == d}
    assert {r.doc_id for r in private.collect()} == kept
    texts = {r.doc_id: r.text for r in private.collect()}
    assert not any("@mail" in t for t in texts.values())
    assert all(r.text == texts[r.doc_id] for r in mixed.collect())
    vocab = bpe.vocabulary(P.tokenizer_path())
    assert sorted((r.doc_id, bpe.decode_ids(r.ids, vocab)) for r in encoded.collect()) == sorted((r.doc_id, r.text) for r in mixed.collect())


def test_held_out_accuracy(spark):
    """Labels that no fit read: accuracy and order of the scores."""
    docs, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    found = queries()["op2_quality"](spark, MIDDLE).where("held_out").join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert docs.count() > len(found) > 100
    assert sum(r.predicted == r.quality for r in found) >= 0.95 * len(found)
    ones, zeros = ([r.score for r in found if r.quality == k] for k in (1, 0))
    assert sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) >= 0.98 * len(ones) * len(zeros)


def test_run_and_registry(spark):
    assert P.run(spark, SMALL).columns == ["doc_id", "n_tokens", "ids"]
    assert {f"op{n}_" for n in range(1, 11) if n != 5} <= {q.split("_")[0] + "_" for q in queries()}
