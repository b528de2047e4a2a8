"""Op 9 against SQL and by hand; the pipeline's stages; the guard of the entry module."""

import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tessera.llm import chat, decontam, quality
from tessera.llm.runtime import fold
from tests.llm.test_duplicates import benchmark_overlap, components, held_oracle, shingle_set

SF = "/root/testdata/sf0.01"


def test_chat_by_hand(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", None), (1, 70, None, "späť"), (2, None, "ann", "x"), (2, None, "ann", "x"), (None, 0, "ann", "y"), (3, 0, "system", "z")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, mask string")
    got = {(r["conv_id"], r["segment"], r["participant"]): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, s, p) for s in (0, 1) for p in ("ann", "bob", "unknown")} | {(2, -1, "ann"), (None, 0, "ann")}
    r = got[1, 0, "ann"]
    assert r["rendered"] == "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
    a, b = map(int, r["mask"].split("-"))
    assert r["rendered"][a:b] == "Hi<|im_end|>"
    assert got[1, 1, "ann"]["mask"] == "" and got[1, 1, "unknown"]["n_masked_chars"] == 14
    assert got[2, -1, "ann"]["n_turns"] == 2
    assert chat.rotate(df.limit(0)).count() == 0


def brute(spark, rows, sf):
    """The pipeline's rows by plain Python: {doc_id: (text, ids)}; only the quality scores come from the fitted ranker."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ranker = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), fold("doc_id", 5) != 0)
    good = {d: t for d, t in rows.items() if ranker.score(quality.features(pa.array([t])))[0] >= quality.CUT}
    cut = held_oracle(good, 8)
    cut = {d: t for d, t in cut.items() if t == good[d] or t.strip()}
    group = components({d: shingle_set(t, 5) for d, t in cut.items()}, 80)
    left = {d: t for d, t in cut.items() if group[d] == d}
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {d: t for d, t in left.items() if not any(benchmark_overlap(t, x, decontam.Params()) for x in items)}
    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {d: (t, hf.encode(t, add_special_tokens=False).ids) for d, t in left.items()}


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = brute(spark, rows, sf)
    assert 0 < len(want) < len(rows)
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert {d: r["ids"] for d, r in out.items()} == {d: ids for d, (_, ids) in want.items()}
    assert {d: r["decoded_sha256"] for d, r in out.items()} == {d: hashlib.sha256(t.encode()).hexdigest() for d, (t, _) in want.items()}


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_at_the_edges(spark, odd, stage):
    sf = "/root/testdata/sf0.001"
    out = stage(spark, odd, sf)
    left = out.collect()
    assert len(left) <= odd.count()
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.columns == odd.columns
        assert {(r["doc_id"], r["source"]) for r in left} <= {(r["doc_id"], r["source"]) for r in odd.collect()}
    else:
        assert len(left) == odd.count()
    assert stage(spark, odd.limit(0), sf).count() == 0


def test_stages_keep_columns_and_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        after = docs.count()
        assert 0 < after <= before
        before = after
        assert docs.filter("n_chars <> length(text)").count() == 0


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


@pytest.mark.parametrize("n", range(1, 11))
def test_registered(n):
    assert sum(k.startswith(f"op{n}_") for k in __spark_entry__.queries()) == 1
    assert "pipeline" in __spark_entry__.queries()
