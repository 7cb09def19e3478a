"""Token counts of a byte-fallback piece model by heap-and-linked-list merging.

The text is cut where no piece of the vocabulary can cross: before each run of spaces and around
line feeds (if no piece holds one). Within such a unit the symbols form a doubly linked list; a
heap gives the best adjacent pair, that is the one whose joined piece has the best score,
leftmost first. The count is the number of initial symbols less the merges, plus the further
bytes of characters the vocabulary lacks. No identifiers are made.

Nulls and empty texts have no tokens. Very long texts and units take memory in proportion to
themselves. Repeated rows give repeated rows, an empty table an empty one.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

MARK = "▁"  # stands for a space in the model's pieces
CACHED_UNITS = 100_000
CACHED_LENGTH = 64


class PieceModel:
    """Ranks of the mergeable pieces of a model file; rank 0 merges first."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [
            i
            for i in range(model.vocab_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        ]
        pieces = [model.id_to_piece(i) for i in sorted(plain, key=lambda i: -model.get_score(i))]
        self.rank = {piece: k for k, piece in enumerate(pieces)}
        long = [p for p in pieces if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in long):
            raise ValueError("pieces cross word starts: units can't be cut at spaces")
        self.lines = not any("\n" in p for p in long)
        self.marked = _Units(self, MARK)
        self.bare = _Units(self, "")

    def merged(self, unit: str) -> int:
        """Tokens of one unit."""
        rank = self.rank
        symbols: list[str | None] = list(unit)
        n = len(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(unit[i : i + 2])
            if r is not None:
                heap.append((r, i, unit[i], unit[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, left, a, b = heapq.heappop(heap)
            right = after[left]
            if symbols[left] != a or right >= n or symbols[right] != b:
                continue  # one of the two has merged meanwhile
            joined = a + b
            symbols[left], symbols[right] = joined, None
            merges += 1
            nxt = after[left] = after[right]
            if nxt < n:
                before[nxt] = left
                r = rank.get(joined + symbols[nxt])
                if r is not None:
                    heapq.heappush(heap, (r, left, joined, symbols[nxt]))
            prev = before[left]
            if prev >= 0:
                r = rank.get(symbols[prev] + joined)
                if r is not None:
                    heapq.heappush(heap, (r, prev, symbols[prev], joined))
        more = sum(len(c.encode()) - 1 for c in symbols if c and len(c) == 1 and c not in rank)
        return n - merges + more

    def count(self, text: str) -> int:
        """Tokens of a text."""
        if not text:
            return 0
        total = 0
        text = text.replace(MARK, " ")
        lines = text.split("\n") if self.lines else [text]
        for k, line in enumerate(lines):
            words = line.split(" ")
            if k:  # only the text's start is preceded by a mark
                if words[0]:
                    total += self.bare[words[0]]
                del words[0]
            if "" in words:  # runs of spaces belong to the word after them, or stand alone at the end
                run = MARK + MARK.join(words)
                total += sum(map(self.bare.__getitem__, re.findall(f"{MARK}+[^{MARK}]*", run)))
            else:
                total += sum(map(self.marked.__getitem__, words))
        return total + len(lines) - 1


class _Units(dict):
    """Counts of units met lately: a full table becomes the older one, which is asked first."""

    def __init__(self, model: PieceModel, prefix: str):
        super().__init__()
        self.model, self.prefix = model, prefix
        self.older: dict[str, int] = {}

    def __missing__(self, unit: str) -> int:
        n = self.older.get(unit)
        if n is None:
            n = self.model.merged(self.prefix + unit)
        if len(unit) <= CACHED_LENGTH:
            if len(self) >= CACHED_UNITS:
                self.older = dict(self)
                self.clear()
            self[unit] = n
        return n


@lru_cache(maxsize=2)
def _model(path: str) -> PieceModel:
    return PieceModel(path)


def token_count(text: str | Column, model_path: str) -> Column:
    """Number of tokens of ``text``; ``model_path`` must exist on every executor."""

    @F.arrow_udf(LongType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _model(model_path)
        for batch in batches:
            yield pa.array([model.count(t.as_py() or "") for t in batch], pa.int64())

    return count(F.col(text) if isinstance(text, str) else text)
