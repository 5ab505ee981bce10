"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyloom.llm.bpe import MergeCounter, read_vocabulary
from tallyloom.llm.columns import as_id, in_small_batches, worker_value
from tallyloom.llm.shingles import in_groups

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, n_bytes, n_tokens, over_limit).

    vocabulary_path: a byte-level BPE file of the tokenizers library. Its bytes (bounded by bpe.MAX_VOCABULARY_BYTES)
    are broadcast. The step is a narrow map: no shuffle, and a lost task is simply run again.

    Nulls: a null text counts as empty (0 bytes, 0 tokens, within the limit); a null id stays null. Empty text: 0 and
    0. Very long text: O(n log n) merges, memory in proportion to one text. Ties and repeated rows: each row gets its
    own result. Empty table: no rows. Other columns, whatever their names, are ignored.
    """
    data = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_value(("MergeCounter", hash(data.value)), lambda: MergeCounter(data.value))
        for b in in_groups(batches):
            texts = b.column(1).to_pylist()
            n = [counter.count(t) if t else 0 for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return in_small_batches(docs).select(as_id(docs, id_col), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)
