"""Packing documents into fixed-length sequences by first-fit decreasing.

Documents are tokenised and cut into pieces of at most one sequence. Pieces are dealt to
groups at random; each group places its pieces, longest first, into the first sequence with
room. A tournament tree over the free room of all sequences finds it in a few steps.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import parts
from veilframe.plans.scale import written

LENGTH = 4_096
END = 2
GROUP = 20_000
"""Pieces per group. A group needs a few sequences more than an optimal packing."""

MEMO = 700_000
"""Words that a worker remembers; all are forgotten when it is full."""


# The letters, numbers and white space of Latin-1 as Unicode has them, and the
# contractions that the tokenizer splits off.
LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
BLANKS = "\t-\r \x85\xa0"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

WORDS = re.compile(f"{CONTRACTIONS}|[{LETTERS}]+|[{NUMBERS}]|[^{BLANKS}{LETTERS}{NUMBERS}]+")


class WordTokenizer:
    """Token ids of whole texts for a tokenizer that lower-cases and encodes word by word.

    Each different word of Latin-1 texts is encoded once and remembered. Other texts, and
    those that may hold a special token, are encoded as a whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def words(self, text: str) -> list[str] | None:
        """The words, or None if they cannot be told from here."""
        if "<|" in text:
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return WORDS.findall(text.lower())

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        # ids of all known words in one array; word i has flat[ends[i - 1] : ends[i]]
        self.flat, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, words: list[str]) -> None:
        coded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        ids = [c.ids for c in coded]
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, sizes.sum())])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def places(self, words: list[str]) -> np.ndarray:
        """The number of each word; unknown ones are learned."""
        place = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = [words[i] for i in new]
            self.learn(list(dict.fromkeys(fresh)))
            place[new] = np.fromiter(map(self.known.__getitem__, fresh), np.int64, len(fresh))
        return place

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > MEMO:
            self.forget()
        words = [self.words(t) for t in texts]
        counts = np.array([len(ws or ()) for ws in words], np.int64)
        place = self.places(list(chain.from_iterable(ws for ws in words if ws)))
        start = self.ends[place]
        size = self.ends[place + 1] - start
        until = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(start - until[:-1], size) + np.arange(until[-1])]
        cut_at = until[np.concatenate([[0], np.cumsum(counts)])]
        out = []
        for i, text in enumerate(texts):
            if words[i] is None:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
            else:
                out.append(ids[cut_at[i] : cut_at[i + 1]])
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process and file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def cut(ids: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    return [(at, ids[at : at + length]) for at in range(0, len(ids), length)]


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each row's ids and `end`, cut every `length`."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = tokenizer(path)
        for batch in batches:
            for at in range(0, len(batch), 500):
                some = batch.iloc[at : at + 500]
                coded = coder.encode([t or "" for t in some["text"]])
                rows = [
                    (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(full))
                    for doc, full in zip(some["doc_id"], (np.append(c, np.uint32(end)) for c in coded), strict=True)
                    for start, ids in cut(full, length)
                ]
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInPandas(
        run, f"doc_id {types[doc_id]}, start long, length long, ids_crc32 long, doc_tokens long"
    )


def first_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, placed in the given order into the first bin with room.

    Leaves of the tree are the free room of bins, inner nodes the larger of their two
    children. A walk from the root to the left whenever that side has room ends in the first fit.
    """
    leaves = 1 << max(0, int(len(lengths) - 1).bit_length())
    tree = [room] * (2 * leaves)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, need in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, room - tree[node]
        tree[node] -= need
        node //= 2
        while node:
            larger = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == larger:
                break
            tree[node] = larger
            node //= 2
    return bins, offsets


def pack(made: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """`made` (pieces) with sequence_id, offset and sequence_length (after padding).

    Groups are drawn by a hash of document and start, and have `group` pieces on average
    whatever the documents are. Sequence ids are unique, not gapless. A sequence is padded
    to `length` unless it holds a power of two.
    """
    made = written(made)
    n = parts(made.count(), group)
    copies = F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id())
    dealt = made.withColumn("_group", F.pmod(copies, F.lit(n)).cast("int"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema)

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "ids_crc32", "start"], ascending=[False, True, True], kind="stable")
        bins, offsets = first_fit(rows["length"].to_numpy(), length)
        filled = np.bincount(bins, rows["length"].to_numpy()).astype(np.int64)
        padded = np.where(filled & (filled - 1), length, filled)
        number = int(rows["_group"].iloc[0])
        return rows.drop(columns="_group").assign(
            sequence_id=bins * n + number, offset=offsets, sequence_length=padded[bins]
        )

    return dealt.groupBy("_group").applyInPandas(
        place, f"{fields}, sequence_id long, offset long, sequence_length long"
    )


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, group: int = GROUP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of each row of `docs`; see `pieces` and `pack`.

    A null or empty text is the end id alone. Rows that repeat an id, or have none, are
    packed each. An empty table gives no rows.
    """
    return pack(pieces(docs, path, length, end, doc_id, text), length, group)
