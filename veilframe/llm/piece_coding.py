"""Encoding and decoding with SentencePiece vocabularies: Viterbi over an Aho-Corasick automaton.

The automaton holds all pieces. One pass over the characters follows its transitions; at
each position the output links list the pieces that end there, longest first, and relax
the best score of that position.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_COST = 10.0
"""A character without a piece costs so much more than the worst piece."""

UNUSED = -1e8
"""Pieces with a lower score are never used."""

MEMO = 300_000
"""Words that a worker remembers; all are forgotten when it is full."""

# a run of spaces and what follows it: no piece has a space after another character
WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class PieceCoder:
    """Encodes words to the segmentation with the highest sum of scores.

    Ties go to the longer last piece. `pieces` has (text, id, score); `byte_ids` the ids of
    the 256 byte pieces that stand for characters without a piece.
    """

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: list[int]) -> None:
        used = [p for p in pieces if p[2] > UNUSED and p[0]]
        self.byte_ids = byte_ids
        self.raw = {i: t.replace(SPACE, " ").encode("utf-8", "surrogatepass") for t, i, _ in used}
        self.raw |= {n: bytes([b]) for b, n in enumerate(byte_ids)}
        self.unknown = min((s for _, _, s in used), default=0.0) - UNKNOWN_COST
        self.build(used)
        self.memo: dict[str, bytes] = {}  # ids as little-endian unsigned 32-bit numbers

    def build(self, pieces: list[tuple[str, int, float]]) -> None:
        self.next: list[dict[str, int]] = [{}]
        # per state: the piece that ends there, or None, and the next shorter state with one
        self.ends: list[tuple[int, int, float] | None] = [None]
        for text, number, score in pieces:
            state = 0
            for char in text:
                if char not in self.next[state]:
                    self.next[state][char] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                state = self.next[state][char]
            self.ends[state] = (len(text), number, score)
        self.fail = [0] * len(self.next)
        self.output = [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            state = queue.popleft()
            back = self.fail[state]
            self.output[state] = back if self.ends[back] else self.output[back]
            for char, child in self.next[state].items():
                self.fail[child] = self.step(back, char)
                queue.append(child)

    def step(self, state: int, char: str) -> int:
        while True:
            after = self.next[state].get(char)
            if after is not None:
                return after
            if not state:
                return 0
            state = self.fail[state]

    def word(self, text: str) -> list[int]:
        """Ids of one word, by a single pass."""
        best = [0.0] * (len(text) + 1)
        size = [0] * (len(text) + 1)
        piece = [-1] * (len(text) + 1)
        state, ends, output = 0, self.ends, self.output
        for at, char in enumerate(text, 1):
            state = self.step(state, char)
            top, length, number = best[at - 1] + self.unknown, 1, -1
            node = state if ends[state] else output[state]
            while node:
                n, piece_id, score = ends[node]
                if best[at - n] + score > top or (number < 0 and best[at - n] + score == top):
                    top, length, number = best[at - n] + score, n, piece_id
                node = output[node]
            best[at], size[at], piece[at] = top, length, number
        out: list[int] = []
        at = len(text)
        while at:
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                char = " " if text[at - 1] == SPACE else text[at - 1]
                raw = char.encode("utf-8", "surrogatepass")
                out += [self.byte_ids[b] for b in reversed(raw)]
            at -= size[at]
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text. A space is put before it, as the vocabulary has words with one.

        The character that stands for spaces is itself written as bytes, so decoding is exact.
        """
        known = self.memo
        if len(known) > MEMO:
            known.clear()
        coded: list[bytes] = []
        for n, part in enumerate(text.split(SPACE)):
            if n:
                coded.append(np.array([self.byte_ids[b] for b in SPACE.encode()], "<u4").tobytes())
            elif text:
                part = f" {part}"
            for found in WORDS.findall(part.replace(" ", SPACE)):
                ids = known.get(found)
                if ids is None:
                    ids = np.array(self.word(found), "<u4").tobytes()
                    if len(found) <= 64:
                        known[found] = ids
                coded.append(ids)
        return np.frombuffer(b"".join(coded), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        try:
            text = raw.decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            text = raw.decode("utf-8", "replace")
        return text.removeprefix(" ")


_coders: dict[str, PieceCoder] = {}


def load(path: str) -> PieceCoder:
    """The pieces and scores of a SentencePiece model file; one coder per worker process."""
    if path not in _coders:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = [
            i for i in range(len(model)) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        ]
        byte = [i for i in range(len(model)) if model.is_byte(i)]
        plain = sorted(set(range(len(model))) - set(special) - set(byte))
        order = {model.id_to_piece(i): i for i in byte}
        _coders[path] = PieceCoder(
            [(model.id_to_piece(i), i, model.get_score(i)) for i in plain],
            [order[f"<0x{b:02X}>"] for b in range(256)],
        )
    return _coders[path]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "piece_ids") -> DataFrame:
    """`df` with an array of ids. A null text has null ids, an empty one an empty array."""

    @F.pandas_udf("array<int>")
    def coded(texts: pd.Series) -> pd.Series:
        coder = load(path)
        return pd.Series([None if t is None else coder.encode(t) for t in texts], dtype=object)

    kept = [F.col(f"`{c}`") for c in df.columns if c != ids]
    return df.select(*kept, coded(F.col(text)).alias(ids))


def decode(df: DataFrame, path: str, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """`df` with the text of an array of ids; null ids have a null text."""

    @F.pandas_udf("string")
    def plain(values: pd.Series) -> pd.Series:
        coder = load(path)
        return pd.Series([None if v is None else coder.decode(v) for v in values], dtype=object)

    kept = [F.col(f"`{c}`") for c in df.columns if c != text]
    return df.select(*kept, plain(F.col(ids)).alias(text))


def digest(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pieces, n_bytes (byte pieces), ids_hash and whether decoding gives the text back.

    Ids are neither sent to the JVM nor kept. A null text counts as an empty one.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = load(path)
        for batch in batches:
            rows = []
            for doc, value in zip(batch["doc_id"], batch["text"], strict=True):
                ids = coder.encode(value or "")
                exact = coder.decode(ids) == (value or "")
                n_bytes = int(np.isin(ids, coder.byte_ids).sum())
                rows.append((doc, len(ids), n_bytes, xxhash.xxh64_hexdigest(ids.tobytes()), exact))
            yield pd.DataFrame(rows, columns=["doc_id", "n_pieces", "n_bytes", "ids_hash", "exact"])

    chosen = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInPandas(
        run, f"doc_id {types[doc_id]}, n_pieces long, n_bytes long, ids_hash string, exact boolean"
    )
