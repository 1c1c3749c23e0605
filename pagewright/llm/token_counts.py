"""Operator 4, token counts: lengths only leave the Arrow function."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import map_arrow, spread, steps
from pagewright.llm.encoding import counter, tokenizer_path

#: Bytes of text that are encoded together: batches are balanced by bytes, not by rows.
BATCH_BYTES = 4 << 20


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``n_bytes``, ``n_tokens`` and ``over_limit`` of every whole text, one row for each row of ``docs``.

    No shuffle. Rows are cut into batches of about ``batch_bytes``; a longer text is cut at
    safe boundaries (see :mod:`pagewright.llm.encoding`), so its units are encoded in strings of
    bounded size, whatever its length. Null and empty texts count 0 tokens; null ids stay null;
    repeated rows give repeated results; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path(tokenizer)).counts
        for b in steps(batches, "text", batch_bytes):
            text = b.column(1)
            n = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(count(text), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return map_arrow(spread(narrow), run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
