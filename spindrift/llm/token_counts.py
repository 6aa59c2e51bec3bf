"""Token counts by a tokenizer compiled into a finite-state transducer (see bpe_transducer)."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import bpe_transducer

LIMIT = 2048


def count_tokens(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; one narrow pass, no shuffle.

    A null text counts as empty: 0 bytes and tokens.  Repeated rows are counted each; a null doc_id
    stays null; an empty table gives no rows.  Columns other than doc_id and
    text are not read.
    """
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                n = pa.array([bpe_transducer.token_count(t, path) for t in part["text"].to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part["doc_id"], pc.binary_length(part["text"]).cast(pa.int64()), n, pc.greater(n, limit)], names=names)

    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
