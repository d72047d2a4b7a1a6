"""Exact encoding with a byte-level BPE vocabulary by dynamic programming over prefixes.

For every prefix of a piece there is exactly one last token of its encoding. An automaton over the vocabulary
gives all tokens that end at each position; the last token is the one that is compatible with the last token of
the prefix before it, that is, whose concatenation the merges would leave as those two tokens. Following the
stored tokens back from the end gives the exact ids in time linear in the piece for a fixed vocabulary, however
long the piece is; nothing is merged step by step.

Scale: one narrow Arrow stage without a shuffle. Each worker keeps the ids of pieces it has met (at most MEMORY of
them), so the program runs once per distinct piece and not once per occurrence.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces whose ids a worker remembers before it starts afresh.
MEMORY = 400_000
_NEVER = 1 << 60


def default_vocabulary() -> str:
    """Path of byte_bpe_50k among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PrefixEncoder:
    """Encodes pieces of text with the ranks of a vocabulary file (base64 token and rank on each line)."""

    def __init__(self, vocabulary: str, pattern: str) -> None:
        import ahocorasick
        import regex

        self.split = regex.compile(pattern).findall
        with open(vocabulary, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = {r: t for t, r in self.rank.items()}
        self.automaton = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), r))
        self.automaton.make_automaton()
        self.spines: tuple[dict, dict] = ({}, {})
        self.pairs: dict[tuple[int, int], bool] = {}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of ``token`` joins; None for a single byte."""
        piece = self.token[token]
        if len(piece) < 2:
            return None
        best = None
        # The halves are the tokens' own encodings, and the merge comes after both of them.
        for i in range(1, len(piece)):
            a, b = self.rank.get(piece[:i]), self.rank.get(piece[i:])
            if a is not None and b is not None and a < token and b < token and self.compatible_below(a, b, token):
                best = (a, b)
                break
        return best

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that stand at the token's right (side 0) or left (side 1) edge in the course of its merges, the
        whole token first, each with the rank of the merge that takes it up."""
        known = self.spines[side]
        if token not in known:
            halves = self.parts(token)
            known[token] = [(token, _NEVER)] + ([] if halves is None else [(t, min(until, token)) for t, until in self.spine(halves[1 - side], side)])
        return known[token]

    def compatible_below(self, a: int, b: int, limit: int) -> bool:
        """Whether a and b, side by side, stay two tokens through all merges of a rank below ``limit``.

        A crossing merge takes place as soon as both edge tokens stand and neither is taken up sooner; of two equal
        merges the left one is first.
        """
        left, right = self.spine(a, 0), self.spine(b, 1)
        for x, x_until in left:
            x_from = -1 if len(self.token[x]) == 1 else x
            for y, y_until in right:
                y_from = -1 if len(self.token[y]) == 1 else y
                if x_from > y_until or y_from > x_until:
                    continue
                joined = self.rank.get(self.token[x] + self.token[y])
                if joined is None:
                    continue
                at = max(joined, x_from, y_from)
                if at < limit and at < x_until and at <= y_until:
                    return False
        return True

    def compatible(self, a: int, b: int) -> bool:
        key = (a, b)
        if key not in self.pairs:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[key] = self.compatible_below(a, b, _NEVER)
        return self.pairs[key]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.rank.get(data)
        if whole is not None:
            return (whole,)
        n = len(data)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        compatible = self.compatible
        for end, (length, token) in self.automaton.iter(data.decode("latin-1")):
            at = end + 1
            if last[at] >= 0:
                continue
            start = at - length
            if start == 0 or compatible(last[start], token):
                last[at], size[at] = token, length
        out = []
        at = n
        while at:
            out.append(last[at])
            at -= size[at]
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_piece(p) for p in self.split(text)))


class _Remembered(dict):
    """Piece to ids (or their number); a new piece is encoded when first asked for."""

    def __init__(self, encoder: PrefixEncoder, count: bool) -> None:
        super().__init__()
        self.encoder, self.count = encoder, count

    def __missing__(self, piece: str):
        ids = self.encoder.encode_piece(piece)
        value = len(ids) if self.count else ids
        if len(piece) <= 64:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = value
        return value


_WORKER: dict[tuple, _Remembered] = {}


def _remembered(vocabulary: str, pattern: str, count: bool) -> _Remembered:
    key = (vocabulary, pattern, count)
    if key not in _WORKER:
        encoder = next((m.encoder for (v, p, _), m in _WORKER.items() if (v, p) == (vocabulary, pattern)), None) or PrefixEncoder(vocabulary, pattern)
        _WORKER[key] = _Remembered(encoder, count)
    return _WORKER[key]


def encode_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """id_col, ids: the token ids of each row's whole text, without special tokens.

    Null and empty texts have the empty list. Strings that name special tokens are ordinary text. Rows are kept as
    they are, repeated ones included; other columns are dropped. ``vocabulary`` is a path that every worker can
    read.
    """
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _remembered(vocabulary, pattern, False)
        look, split = known.__getitem__, known.encoder.split
        for batch in batches:
            flat: list[np.ndarray] = []
            sizes = np.zeros(batch.num_rows + 1, dtype=np.int64)
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                if text:
                    ids = np.fromiter(chain.from_iterable(map(look, split(text))), dtype=np.int32)
                    flat.append(ids)
                    sizes[i + 1] = len(ids)
            values = np.concatenate(flat) if flat else np.empty(0, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "ids"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """id_col, n_tokens: the length of each row's ids; 0 for null and empty texts."""
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _remembered(vocabulary, pattern, True)
        look, split = known.__getitem__, known.encoder.split
        for batch in batches:
            sizes = [sum(map(look, split(t))) if (t := text.as_py()) else 0 for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[id_col, "n_tokens"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long")
