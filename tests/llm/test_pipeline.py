"""The pipeline's stages on their own input, against what each must keep."""

from __future__ import annotations

import corpus_pipeline
import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output, as ``run`` makes them."""
    from orrery.llm.common import materialise, table

    docs, out = table(spark, SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        kept = materialise(stage(spark, docs, SMALL), name)
        out.append((name, docs, kept))
        docs = kept
    return out


def test_stages_are_the_five_in_order(stages):
    assert [name for name, _, _ in stages] == ["toxicity", "simhash-near-dedup", "decontamination", "secret-scans", "best-fit-packing"]
    assert all(kept.columns == docs.columns for _, docs, kept in stages[:-1])


def test_near_dedup_keeps_one_of_each_group(stages):
    from orrery.llm.simhash import fingerprint

    _, docs, kept = stages[1]
    rows = {r["doc_id"]: fingerprint((r["text"] or "").encode()) for r in docs.collect()}
    parent = {i: i for i in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(rows)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if ((rows[a] ^ rows[b]) & (1 << 64) - 1).bit_count() <= 3:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in ids if top(i) == i}


def test_decontamination_drops_documents_with_items_and_no_others(spark, stages):
    _, docs, kept = stages[2]
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    holding = {r["doc_id"] for r in docs.collect() if any(t in r["text"] for t in items)}
    left = {r["doc_id"] for r in kept.collect()}
    assert not holding & left
    assert len(left) >= docs.count() - len(holding) - 2


def test_secrets_go_and_documents_stay(stages):
    import re

    _, docs, kept = stages[3]
    assert kept.count() == docs.count()
    assert not any(re.search("[0-9a-f]{16}", r["text"]) for r in kept.collect())


def test_packing_covers_every_document_left(stages):
    _, docs, packed = stages[4]
    rows = packed.collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 1024


def test_toxicity_keeps_the_rows_that_are_not_predicted_toxic(spark, stages):
    from orrery.llm.toxicity import score_documents

    _, docs, kept = stages[0]
    scores = score_documents(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in scores if not r["predicted"]}
    assert len(scores) == docs.count()


def test_stages_bear_nulls_repeats_clashing_columns_and_nothing(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    rows = [(None, None), (None, "no id at all here"), (None, "no id at all here"), (5, "one two three four"), (5, "one two three four"), (5, f"other words {item}"), (6, "one two three four"), (7, ""), (8, "x" * 30_000), (9, "secret = abcdefghijklmnop0")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", "p") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, secrets string, best string")
    for table in (docs, docs.limit(0)):
        left = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, left, SMALL)
            assert left.columns == docs.columns
        texts = [(r["doc_id"], r["text"]) for r in left.collect()]
        packed = corpus_pipeline.STAGES[-1][1](spark, left, SMALL).collect()
        assert len({r["piece"] for r in packed if r["doc_id"] == 8}) == len([r for r in packed if r["doc_id"] == 8])
    everything = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        everything = stage(spark, everything, SMALL)
    texts = sorted(((r["doc_id"], r["text"]) for r in everything.collect()), key=str)
    assert (5, "one two three four") in texts and not any(i == 6 for i, _ in texts)
    assert not any(item in (t or "") for _, t in texts) and not any("abcdefghijklmnop0" in (t or "") for _, t in texts)
