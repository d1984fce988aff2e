"""Byte-level BPE: exact encoding by backtracking over longest matches, and decoding."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.hashing import tidy

VOCABULARY = "byte_bpe_50k.tiktoken"
# Entries of a worker's memo tables, to bound its memory.
MEMO, PAIRS = 150_000, 450_000
# Ids per batch that goes back to Spark.
BATCH_IDS = 1_000_000


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    return {base64.b64decode(a): int(b) for a, b in pairs}


@cache
def token_bytes(path: str) -> dict[int, bytes]:
    return {number: token for token, number in ranks(path).items()}


class _Memo(dict):
    """Results by piece, in two generations of MEMO entries: what is used again stays."""

    def __init__(self, work) -> None:
        self.work, self.old = work, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        value = self.old.get(piece) or self.work(piece)
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = value
        return value


class Encoder:
    """Encodes one piece at a time. Bytes are handled as Latin-1 strings, one character each."""

    def __init__(self, path: str, pattern: str) -> None:
        self.pieces = regex.compile(pattern).findall
        self.ids = {token.decode("latin-1"): number for token, number in ranks(path).items()}
        most = max(self.ids.values()) + 1
        self.texts = [""] * most
        for text, number in self.ids.items():
            self.texts[number] = text
        self.sizes = list(map(len, self.texts))
        self.width = max(self.sizes)
        self.matcher = ahocorasick.Automaton()
        for text, number in self.ids.items():
            self.matcher.add_word(text, number)
        self.shorter = [self._next_shorter(text) for text in self.texts]
        self.whole: list[bool | None] = [None] * most  # whether merging a token's bytes gives it
        self.fits: dict[int, bool] = {}
        self.memo = _Memo(self.piece)

    def _next_shorter(self, text: str) -> int:
        """The longest token that is a proper beginning of this one; -1 if there is none."""
        for n in range(len(text) - 1, 0, -1):
            if (token := self.ids.get(text[:n], -1)) >= 0:
                return token
        return -1

    def merged(self, text: str) -> list[int]:
        """The merges as defined: again and again the adjacent pair of lowest rank, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.ids.get(a + b, -1) for a, b in zip(parts, parts[1:], strict=False)]
            usable = [r for r in ranks if r >= 0]
            if not usable:
                break
            k = ranks.index(min(usable))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ids[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives just these two tokens; -1 is no token."""
        if self.whole[right] is None:
            self.whole[right] = self.merged(self.texts[right]) == [right]
        fit = self.whole[right] and (
            left < 0 or self.merged(self.texts[left] + self.texts[right]) == [left, right]
        )
        if len(self.fits) > PAIRS:
            self.fits.clear()
        self.fits[left << 32 | right] = fit
        return fit

    def longest(self, text: str, at: int) -> int:
        """The longest token that the text has at this place; every single byte is a token."""
        window = text[at : at + self.width]
        n = self.matcher.longest_prefix(window)
        while (token := self.ids.get(window[:n], -1)) < 0:
            n -= 1
        return token

    def backtrack(self, text: str) -> list[int]:
        """The only split of the text into reachable tokens of which all neighbours are compatible.

        From each place the longest token is tried first, then shorter ones. A place from which
        nothing leads on is marked and never entered again, so the work is linear in the text.
        """
        n, at, out, last = len(text), 0, [], -1
        sizes, shorter, fits, longest = self.sizes, self.shorter, self.fits, self.longest
        dead = bytearray(n + 1)
        token = longest(text, 0)
        while True:
            while token >= 0:
                end = at + sizes[token]
                if not dead[end]:
                    fit = fits.get(last << 32 | token)
                    if self.compatible(last, token) if fit is None else fit:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                at, last = end, token
                token = longest(text, at)
            else:
                dead[at] = 1
                token = shorter[out.pop()]
                at -= sizes[last]
                last = out[-1] if out else -1

    def piece(self, piece: str) -> tuple[int, ...]:
        text = piece.encode("utf-8").decode("latin-1")
        whole = self.ids.get(text)
        return (whole,) if whole is not None else tuple(self.backtrack(text))

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.memo.__getitem__, self.pieces(text))), np.int32)


@cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(
    docs: DataFrame,
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id and ids (array<int>) of every row's whole text, without special tokens.

    Each match of ``pattern`` is encoded on its own, as the rank file's merges prescribe. A null
    text counts as an empty one and has no ids. Bytes that are not UTF-8 become replacement
    characters. Rows are independent: no shuffle, repeated rows and null ids stay as they are,
    and a long text only makes its own batch larger. Other columns are ignored.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    chosen = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            names, first, held, parts = batch.column(0), 0, 0, []
            for k, raw in enumerate(batch.column(1)):
                text = raw.as_py() or b""
                parts.append(coder.encode(text.decode("utf-8", "replace")))
                held += len(parts[-1])
                if held >= BATCH_IDS or k == batch.num_rows - 1:
                    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
                    yield pa.RecordBatch.from_arrays(
                        [names.slice(first, k + 1 - first), ids], ["doc_id", "ids"]
                    )
                    first, held, parts = k + 1, 0, []
        del coder
        encoder.cache_clear()  # workers outlive their tasks, and its memo with them
        tidy()

    return chosen.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Add decoded (binary) to rows of doc_id and ids. Null ids decode to no bytes."""
    path = path or public_tokenizers.path(VOCABULARY)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            column = batch.column(1)
            decoded = [
                b"".join(map(table.__getitem__, (ids.values.to_numpy().tolist() if ids.is_valid else ())))
                for ids in column
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), column, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"]
            )
        del table
        token_bytes.cache_clear()
        tidy()

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")
