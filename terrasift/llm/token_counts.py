"""Token counts: batch encoding in Arrow tasks that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from terrasift.llm.pieces import encoder
from terrasift.llm.tables import by_bytes, texts_of


def token_lengths(
    docs: DataFrame,
    tokenizer: str,
    pieces: str = "words",
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: int = 2048,
    batch_bytes: int = 4 << 20,
) -> DataFrame:
    """One row for each input row: id, UTF-8 bytes, tokens, and whether they exceed ``limit``.

    ``tokenizer`` is the path of a tokenizers JSON file, ``pieces`` how its texts may be cut:
    "words" where white space is dropped, "bytes" for byte-level vocabularies. Batches hold
    about ``batch_bytes`` of text, longer texts are cut before spaces, and a batch's distinct
    pieces are encoded once. Ids never leave the task. A null text has 0 bytes and 0 tokens,
    a null id stays null, repeated rows stay repeated, an empty table gives no rows, and other
    columns are ignored.
    """
    columns = docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, pieces, ids=False)
        for batch in batches:
            for part in by_bytes(batch, "text", batch_bytes):
                n = own.count(texts_of(part, "text"))
                size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                over = pa.array(np.asarray(n > limit))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), size, pa.array(n), over], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
                )

    id_type = docs.schema[id_column].dataType.simpleString()
    return columns.mapInArrow(count, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")
