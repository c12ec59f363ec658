import hashlib
import random

import public_tokenizers
import tokenizers
from tables import documents  # noqa: F401

import corpus_pipeline


def prose(rng, n=90):
    return " ".join("".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def some_rows():
    rng = random.Random(9)
    own = [prose(rng) for _ in range(8)]
    shared = prose(rng, 60)
    near = own[0].split(" ")
    near[40] = "changed"
    rows = [(k, f"{text}\n{shared}" if k < 3 else text, f"s{k % 2}") for k, text in enumerate(own)]
    return [*rows, (20, own[5], "s0"), (21, " ".join(near), "s1"), (22, "too short", "s0"), (23, None, None), (24, "", "s0"), (5, own[5], "s1")], shared


def test_stages_one_after_another(spark, documents):
    """Every stage works on what the one before has left and hands on the columns of documents."""
    rows, shared = some_rows()
    docs = documents(rows)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "source_mixing", "bpe"]
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, "")
        assert done.columns == docs.columns and done.dtypes == docs.dtypes
        docs = corpus_pipeline.cut_lineage(done)
        left[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {d for d, _ in left["quality_rules"]} == {0, 1, 2, 3, 4, 5, 6, 7, 20, 21}
    assert sum(shared in t for _, t in left["line_dedup"]) == 1
    # of an exact copy line dedup has left nothing, of repeated rows one stays
    assert dict(left["line_dedup"])[20] == "" and [d for d, t in left["near_dedup"] if t == rows[5][1]] == [5]
    assert {d for d, _ in left["near_dedup"]} >= {1, 2, 3, 4, 6, 7}
    assert {d for d, _ in left["source_mixing"]} <= {d for d, _ in left["near_dedup"]}
    model = tokenizers.Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    model.no_truncation(), model.no_padding()
    texts = sorted(t for _, t in left["source_mixing"])
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted(digest(",".join(map(str, model.encode(t, add_special_tokens=False).ids))) for t in texts)
    assert sorted(r["ids_sha256"] for r in encoded) == want
    assert sorted(r["decoded_sha256"] for r in encoded) == sorted(map(digest, texts))


def test_empty_table_goes_through_all_stages(spark, documents):
    docs = documents([(1, "x")]).where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
