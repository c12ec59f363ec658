"""Toxicity scores of whole texts by a bidirectional gated recurrent network with attention pooling.

The network is fitted to a bounded sample of labelled documents outside the held-out fold, on the driver; every window of
every text is scored on the executors. Inputs are words and their character trigrams alone.

Defined cases: null and blank texts get the score of an empty window; a null doc_id is not held out; repeated rows are
scored one by one; without labelled rows every score is that of an untrained network; an empty table gives an empty
result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .shipping import ship

FOLDS = 5
#: Labelled documents that the network is fitted to, at most so many of each label.
SAMPLE = {1: 800, 0: 1600}
#: Longest labelled text that is learnt from, in characters.
LONGEST = 12_000

_SCORERS: dict[str, gru.Scorer] = {}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, sizes: dict[int, int] = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Texts and labels to learn from: per label those of the lowest hash of doc_id, none of the held-out fold."""
    usable = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for label, n in sizes.items():
        some = usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most sum(sizes) ids are sent out
    texts = docs.select("doc_id", "text").where(F.length("text") <= LONGEST).join(F.broadcast(chosen), "doc_id")
    rows = sorted((r["doc_id"], r["text"], r["toxic"]) for r in texts.limit(2 * sum(sizes.values())).collect())
    return [r[1] for r in rows], np.array([r[2] for r in rows], np.float32)


def fit(docs: DataFrame, labels: DataFrame, sizes: dict[int, int] = SAMPLE) -> gru.Network:
    texts, y = sample(docs, labels, sizes)
    return gru.train([[gru.plain(w) for w in t.split()] for t in texts], y)


def score(docs: DataFrame, net: gru.Network) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per document."""
    spark = docs.sparkSession
    ship(spark)
    shared, key = spark.sparkContext.broadcast((net.known, net.p)), uuid.uuid4().hex

    def scorer() -> gru.Scorer:
        if key not in _SCORERS:
            _SCORERS.clear()
            known, p = shared.value
            copy = gru.Network.__new__(gru.Network)
            copy.known, copy.p = known, p
            _SCORERS[key] = gru.Scorer(copy)
        return _SCORERS[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer()
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                values = own.scores([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values)], ["doc_id", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
