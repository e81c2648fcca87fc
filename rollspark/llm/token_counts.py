"""Token counts: lengths only, from Arrow batches balanced by bytes.

A task sends the tokenizer batches of about ``BATCH`` bytes; a text longer than
``PIECE`` is split at safe boundaries first, so neither one long text nor a
batch of many decides the memory. A boundary is safe where a single space stands
between two characters that are neither white space nor the tokenizer's own
space mark: no piece of the vocabulary reaches across a space into a word
(checked when the model is loaded), and the piece after the cut gets the same
leading space mark from the model's dummy prefix.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollspark.llm.common import kept, table

BATCH, PIECE = 1 << 20, 1 << 15
MARK = "▁"
_SAFE = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text cut at safe single spaces into parts of about ``size`` characters; the spaces at the cuts go."""
    out, start = [], 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        if not m:
            break
        out.append(text[start:m.start()])
        start = m.end()
    out.append(text[start:])
    return out


class Counter:
    """Counts tokens as sentencepiece gives them, without begin and end."""

    def __init__(self, model: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        across = any(MARK in self.model.id_to_piece(i).lstrip(MARK) for i in range(self.model.get_piece_size()))
        one, two = self.model.encode("a"), self.model.encode("a a")
        self.splits = not across and two == one + one

    def lengths(self, texts: list[str]) -> list[int]:
        out, parts, owner, held = [0] * len(texts), [], [], 0

        def flush():
            for i, ids in zip(owner, self.model.encode(parts, num_threads=1), strict=True):
                out[i] += len(ids)
            parts.clear()
            owner.clear()

        for i, x in enumerate(texts):
            for p in pieces(x) if self.splits and len(x) > PIECE else [x]:
                parts.append(p)
                owner.append(i)
                held += len(p)
                if held >= BATCH:
                    flush()
                    held = 0
        if parts:
            flush()
        return out


def counter(model: str) -> Counter:
    return kept(("counter", model), lambda: Counter(model))


def token_counts(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row with ``n_bytes`` (UTF-8) and ``n_tokens`` of the whole text.

    A null text counts as empty: 0 and 0. Rows stay as they are, repeated ones
    included; other columns are not read.
    """
    src = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = src.drop("__text").schema.add("n_bytes", "long").add("n_tokens", "long")

    def run(batches):
        import pyarrow.compute as pc
        count = counter(model)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*cols, pc.binary_length(texts.cast(pa.large_string())).cast(pa.int64()), pa.array(count.lengths(texts.to_pylist()), pa.int64())],
                schema.names)

    return src.mapInArrow(run, schema)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)
