"""Best-two-fit packing of token sequences.

A sequence is filled greedily with the longest piece that still fits. If a gap
is left, the sequence's smallest piece is exchanged for the two unpacked pieces
that fit the gap plus its place most tightly, if they fill more of it. Then the
sequence is closed. Packing works on counts of pieces by length, so a step
costs the number of different lengths, not of pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollspark.llm.common import forget, kept, lean, table, trim, write_once

CACHED, LONGEST_CACHED = 200_000, 48
_LETTERS = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)\Z")


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length (all from 1 to ``capacity``)."""
    lengths = np.asarray(lengths, np.int64)
    order = np.argsort(lengths, kind="stable")
    count = np.bincount(lengths, minlength=capacity + 1)
    end = np.cumsum(count)  # the next piece of a length is taken from the end of its run
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left, number = len(lengths), 0
    while left:
        gap, chosen = capacity, []
        while gap:
            fit = np.flatnonzero(count[:gap + 1])
            if not len(fit):
                break
            chosen.append(int(fit[-1]))
            count[chosen[-1]] -= 1
            gap -= chosen[-1]
        if gap and len(chosen) > 1:
            room = gap + chosen[-1]
            a = np.flatnonzero(count[:room])
            if len(a):
                at = np.searchsorted(a, np.minimum(room - a, a), "right") - 1
                at -= (at >= 0) & (a[at] == a) & (count[a] < 2)  # the same length twice needs two pieces
                both = np.where(at >= 0, a + a[at], 0)
                i = int(both.argmax())
                if both[i] > chosen[-1]:
                    count[chosen.pop()] += 1
                    chosen += [int(a[i]), int(a[at[i]])]
                    count[chosen[-1]] -= 1
                    count[chosen[-2]] -= 1
        at = 0
        for x in chosen:
            end[x] -= 1
            i = order[end[x]]
            bins[i], offsets[i] = number, at
            at += x
        left -= len(chosen)
        number += 1
    return bins, offsets


class Known(dict):
    """Ids of words (UTF-8) as little-endian unsigned 32-bit bytes, encoded when first asked for.

    A word of letters and closing ASCII signs is its letters' ids and its
    signs', as the vocabulary's pattern parts them there; letters of Latin-1
    have the ids of their small ones, as it ignores case. So fewer are encoded,
    and small letters of Latin-1, which the vocabulary's normalizer leaves as
    they are and its pattern whole, go to its model at once.
    """

    def __init__(self, tokenizer, before: dict[bytes, bytes]):
        super().__init__({b"": b""})
        self.tokenizer, self.before, self.model = tokenizer, before, tokenizer.model
        self.letters = {i: tokenizer.pre_tokenizer.pre_tokenize_str(chr(i))[0][0] for i in range(256) if chr(i).isalpha()}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            text = word.decode()
            m = _LETTERS.match(text)
            if m and m[1].isalpha() and ord(max(m[1])) < 256:
                small = m[1].lower()
                if m[2] or m[1] != small:
                    ids = self[small.encode()] + self[m[2].encode()]
                else:
                    ids = array("I", [x.id for x in self.model.tokenize(small.translate(self.letters))]).tobytes()
            else:
                ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(word) <= LONGEST_CACHED:
            self[word] = ids
        return ids


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space, so a space or line feed is a boundary that
    no token crosses: words between them are encoded once and remembered, within
    a bound on the number of words and their length.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.known = Known(self.tokenizer, {})

    def encode(self, text: str) -> bytes:
        if len(self.known) > CACHED:  # words not asked for lately are forgotten
            self.known.before = {}
            self.known = Known(self.tokenizer, self.known)
        return b"".join(map(self.known.__getitem__, text.encode().replace(b"\n", b" ").split(b" ")))


def encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(("encoder", path), lambda: Encoder(path))


def token_pieces(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """The pieces of every row: ``keep`` columns, piece, start, length, ids_crc32.

    A row's ids are those of its whole text (null: empty) and one ``end_id``;
    only rows with more than ``capacity`` ids give more than one piece.
    """
    src = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = src.drop("__text").schema
    for name in ("piece:integer", "start:long", "length:long", "ids_crc32:long"):
        schema = schema.add(*name.split(":"))
    last = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            rows, cols = [], ([], [], [], [])
            for i, x in enumerate(batch.column(batch.num_columns - 1)):  # one text at a time, not a batch of them
                ids = memoryview(enc.encode(x.as_py()) + last)
                for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[s:s + 4 * capacity]
                    rows.append(i)
                    for c, v in zip(cols, (k, s // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(v)
            take = pa.array(rows, pa.int64())
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(take) for i in range(batch.num_columns - 1)),
                 *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], schema.names)

    return src.mapInArrow(lean(run), schema)


def pack(pieces: DataFrame, capacity: int = 4096, group_rows: int = 32_768) -> DataFrame:
    """``pieces`` (with a column ``length``) with sequence_id and offset.

    Rows are dealt by hash, salted by a random number of the write-once input, into groups of
    about ``group_rows`` whatever their keys, each packed in one task: a group
    loses at most a part of its last sequences, one in thousands, and memory
    stays a few columns of one group. Rows of one length, source or text spread
    over all groups.
    """
    held = write_once(pieces.withColumn("__deal", F.rand(7)), "pieces")
    groups = max(1, -(-held.count() // group_rows))
    names = [c for c in held.columns if c != "__deal"]
    dealt = held.withColumn("__group", F.least(F.floor(F.col("__deal") * groups), F.lit(groups - 1)).cast("long")).drop("__deal")
    schema = held.select(*names).schema.add("sequence_id", "long").add("offset", "long")

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        forget()  # the words' ids
        trim()
        bins, offsets = best_two_fit(rows["length"].to_numpy(), capacity)
        return rows[names].assign(sequence_id=bins + (int(key[0]) << 32), offset=offsets)

    return dealt.groupBy("__group").applyInPandas(run, schema)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, sf_dir, "documents")
    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
