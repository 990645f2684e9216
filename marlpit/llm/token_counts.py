"""Token counts: Arrow functions that encode a batch and return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.llm import arrow, tokenizer


def token_count(text: Column | str, vocabulary: str = "word_bpe_49k.json", batch_bytes: int = arrow.BATCH_BYTES) -> Column:
    """Tokens of each whole text as the tokenizers library counts them, without added special tokens.

    The column's batches are cut again into ranges of about ``batch_bytes`` text bytes, so that a few very
    long texts don't make one batch much heavier than the others. Texts are split at ASCII white space, a
    safe boundary for a tokenizer that drops white space; each distinct word of a range is encoded once and
    only its length is kept. Null and empty texts have 0 tokens; rows are neither lost nor reordered, equal ones get equal counts, an
    empty table gives no rows. A very long text is a range of its own, held whole in one task.
    """

    @F.arrow_udf("bigint")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            texts = arrow.texts_of(column)
            parts = [pa.array([], pa.int64())]
            for _, part in arrow.by_bytes(pa.record_batch([texts], ["text"]), texts, batch_bytes):
                found = arrow.split_words(part)
                _, lengths = tokenizer.encode_distinct(vocabulary, found.words)
                parts.append(pa.array(arrow.ragged_sums(lengths[found.codes], found.offsets)))
            yield pa.concat_arrays(parts)

    return counted(F.col(text) if isinstance(text, str) else text)


def count_tokens(docs: DataFrame, text_col: str = "text", out_col: str = "n_tokens", vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """``docs`` with its tokens counted in ``out_col``, which replaces a column of that name; all other columns stay."""
    return docs.withColumn(out_col, token_count(F.col(f"`{text_col}`"), vocabulary))
