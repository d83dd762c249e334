"""Token counts: the exact count at every prefix of every text, stored once.

`prefix_counts` runs a dynamic program over each text and stores the number of
tokens of each of its prefixes.  Truncation and budget questions are then array
look-ups on the stored column (`tokens_of_prefix`, `longest_within`), without
encoding anything again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.textops import by_chunk, lists
from quillon.llm.workdir import mapped


@lru_cache(2)
def _program(path: str):
    from quillon.llm.pretokens import PrefixCounts

    return PrefixCounts(path)


def prefix_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), prefix_tokens (array<int>).

    prefix_tokens has an entry for 0, 1, ... all code points of the text: the
    number of tokens the tokenizer library gives for that prefix alone.  A null
    text counts as empty (one entry, 0); repeated rows give repeated rows; other
    columns of docs are not read, so their names can't clash.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = _program(tokenizer)

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            import pyarrow.compute as pc

            text = b.column(1)
            counts, per = program.of(text)
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            return pa.RecordBatch.from_arrays([b.column(0), size, lists(counts, per, pa.int32())], ["doc_id", "n_bytes", "prefix_tokens"])

        return by_chunk(one)(batches)

    return mapped(rows, run, schema)


def tokens_of_prefix(prefix_tokens: Column, n_chars: Column | int) -> Column:
    """Tokens of the first n_chars code points (of the whole text if it has fewer)."""
    n = F.lit(n_chars) if isinstance(n_chars, int) else n_chars
    return F.element_at(prefix_tokens, F.least(n.cast("int") + 1, F.size(prefix_tokens)))


def total_tokens(prefix_tokens: Column) -> Column:
    return F.element_at(prefix_tokens, -1).cast("long")


def longest_within(prefix_tokens: Column, budget: int) -> Column:
    """Code points of the longest prefix of at most `budget` tokens. Counts can fall as a word completes, so all of them are looked at."""
    last = F.aggregate(prefix_tokens, F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("best")), lambda a, n: F.struct((a["i"] + 1).alias("i"), F.when(n <= budget, a["i"] + 1).otherwise(a["best"]).alias("best")))
    return F.when(F.element_at(prefix_tokens, -1) <= budget, F.size(prefix_tokens) - 1).otherwise(last["best"]).cast("long")
