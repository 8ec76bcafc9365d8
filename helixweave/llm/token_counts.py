"""Op 1, token counts: the whole-token shortcut.

Offline, on the driver, every vocabulary string is encoded alone; those that give one token are proven.
On the executors a text's pre-tokens among the proven count one each and only the rest are merged. One
narrow pass, no shuffle; the proven strings are broadcast, bounded by the vocabulary.

Null and empty texts have 0 bytes and 0 tokens; repeated rows and ids are kept as they are; columns other
than the ones named are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordbpe
from .shared import tokenizer_path


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    path = path or tokenizer_path("word_bpe_49k.json")
    whole = docs.sparkSession.sparkContext.broadcast(wordbpe.load(path).proven_whole())

    def count(batches):
        bpe, proven = wordbpe.load(path), whole.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            n = [bpe.count(t, proven) if t else 0 for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
