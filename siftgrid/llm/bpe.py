"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse.

The encoder reads text in pieces of any size and emits a token as soon as nothing that may follow can change it. Two
bounds make that possible in constant memory. The pattern that splits text before the merges needs at most a few
characters beyond a split. Inside one unsplit stretch, the merge list has a sufficient lookahead: appended bytes can
change a token only through a chain of merges of falling priority, each of which overlaps its right neighbour, so a token
that ends further from the end of what has been read than the longest such chain is stable.
"""

from __future__ import annotations

import base64
import codecs
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex

# The split pattern of the tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_WORD_MEMO, _PIECE_MEMO, _MEMO_BYTES = 300_000, 300_000, 64
#: Characters after a split that the pattern may look at: a contraction has two letters, white space looks one further.
_PATTERN_AHEAD = 4


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a file with one base64 token and its number a line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def sufficient_lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes beyond the end of a token after which nothing that follows can change it.

    Before any merge, what has been read is certain up to its end. A merge (u, v) whose right part may lie beyond the
    certain part makes u uncertain, and only merges of a later rank whose right part begins with u carry that on.
    ``reach[u]`` is the longest chain that ends in left part u; merges are visited by rank. Every split of a token
    into two tokens is taken for a merge, and every prefix for a possible right part, which can only lengthen the result.
    """
    reach: dict[bytes, int] = {}
    most = 0
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__):
        for cut in range(1, len(token)):
            left, right = token[:cut], token[cut:]
            if left in ranks and right in ranks:
                chain = cut + max((reach.get(right[:k], 0) for k in range(1, len(right) + 1)), default=0)
                if chain > reach.get(left, 0):
                    reach[left] = chain
                    most = max(most, chain)
    return most + max(map(len, ranks), default=1)


def merge(stretch: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Start offsets of the tokens of one unsplit stretch: always the pair of the lowest rank next, leftmost first."""
    n = len(stretch)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if (j := after[i]) < n and (rank := ranks.get(stretch[i : after[j]])) is not None:
            heapq.heappush(heap, (rank, i, after[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or after[j] != end:
            continue
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(i)
        i = after[i]
    return out


class _Memo(dict):
    """A dictionary that computes what it lacks and is emptied when full, so its size stays bounded."""

    def __init__(self, make, limit: int):
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= _MEMO_BYTES:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class Vocabulary:
    """Ranks with what encoding needs: the lookahead, the split pattern and bounded memories of what was encoded.

    Ids travel as packed 32-bit integers, so whole texts are put together by joining bytes.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, lookahead: int | None = None):
        self.ranks, self.lookahead = ranks, lookahead or sufficient_lookahead(ranks)
        self.window = max(2 * self.lookahead, 1024)
        self.splits = regex.compile(pattern)
        self.odd_space = regex.compile(r"\s \s")
        self.space = regex.compile(r"(?<!\s) | (?!\s)")
        self.pieces = _Memo(self._piece, _PIECE_MEMO)
        self.words = _Memo(self._word, _WORD_MEMO)
        self.spaced = _Memo(lambda w: self.words[" " + w], _WORD_MEMO)
        self.tokens = {i: t for t, i in ranks.items()}

    def _piece(self, piece: str) -> bytes:
        return b"".join(self._stretch([piece.encode("utf-8", "replace")]))

    def _stretch(self, parts: Iterable[bytes]) -> Iterator[bytes]:
        """Packed ids of one unsplit stretch that arrives in parts; holds no more than a window and one part."""
        held = b""
        for part in parts:
            for at in range(0, len(part), self.window):
                held += part[at : at + self.window]
                while len(held) > 2 * self.window:
                    ids, held = self._stable(held)
                    yield ids
        if held:
            if (rank := self.ranks.get(held)) is not None and len(held) > 1:
                yield np.int32(rank).tobytes()
            else:
                starts = merge(held, self.ranks)
                yield np.fromiter((self.ranks[held[a:b]] for a, b in zip(starts, [*starts[1:], len(held)], strict=True)), np.int32).tobytes()

    def _stable(self, held: bytes) -> tuple[bytes, bytes]:
        """The ids of a long stretch's beginning that can't change any more, and the rest."""
        head = held[: 2 * self.window]
        starts = merge(head, self.ranks)
        end = next(s for s in reversed(starts) if s <= len(head) - self.lookahead)
        ids = np.fromiter((self.ranks[head[a:b]] for a, b in zip(starts, starts[1:], strict=False) if b <= end), np.int32)
        return ids.tobytes(), held[end:]

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.splits.findall(word)))

    def encode(self, text: str) -> bytes:
        """Packed ids of text that is whole, or ends where a split is certain.

        A space with something other than white space on one side at least always begins or ends a split, so the text
        falls into words there, most of which were met before.
        """
        first, *rest = text.split(" ") if self.odd_space.search(text) is None else self.space.split(text)
        return self.words[first] + b"".join(map(self.spaced.__getitem__, rest))


class Encoder:
    """feed(text) returns the packed ids that have become certain; finish() the rest."""

    def __init__(self, vocabulary: Vocabulary, hold: int = 1 << 16):
        self.vocabulary, self.hold, self.text = vocabulary, max(hold, 2 * vocabulary.lookahead), ""

    def feed(self, text: str) -> bytes:
        self.text += text
        out = []
        while len(self.text) > self.hold:
            chunk = self.text[: self.hold]
            # the last place where a space follows and precedes other characters: a split whatever comes later
            cut = next((m.start() for m in regex.finditer(r"(?r)(?<=\S) (?=\S)", chunk)), 0)
            if not cut:
                # no space in all that: split by the pattern, but not within the last splits, which may still grow,
                # nor after white space, which is split differently where a text ends
                ends = [m.end() for m in self.vocabulary.splits.finditer(chunk)]
                cut = next((e for e in reversed(ends[:-1]) if e <= len(chunk) - _PATTERN_AHEAD and not chunk[e - 1].isspace()), 0)
            if not cut:
                out.append(self._one_stretch(chunk))
                continue
            out.append(self.vocabulary.encode(self.text[:cut]))
            self.text = self.text[cut:]
        return b"".join(out)

    def _one_stretch(self, chunk: str) -> bytes:
        """All that is held is one stretch without a split: emit its stable tokens, as far as they end a character."""
        held = chunk.encode("utf-8", "replace")
        starts = merge(held, self.vocabulary.ranks)
        whole = {0}
        at = 0
        for c in chunk:
            at += len(c.encode("utf-8", "replace"))
            whole.add(at)
        end = next((s for s in reversed(starts) if s <= len(held) - self.vocabulary.lookahead - 4 * _PATTERN_AHEAD and s in whole), 0)
        if not end:
            self.hold *= 2  # not met with any real vocabulary: no token ends with a character in all that
            return b""
        ranks = self.vocabulary.ranks
        ids = np.fromiter((ranks[held[a:b]] for a, b in zip(starts, starts[1:], strict=False) if b <= end), np.int32)
        self.text = held[end:].decode() + self.text[len(chunk) :]
        return ids.tobytes()

    def finish(self) -> bytes:
        out, self.text = self.vocabulary.encode(self.text), ""
        return out


class Decoder:
    """feed(ids) returns the text that is certain so far; finish() what is left of a cut character, as U+FFFD.

    A state machine over bytes: what it keeps between calls is the beginning of at most one character.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.tokens, self.state = vocabulary.tokens, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.tokens.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=4)
def vocabulary(data: bytes, lookahead: int) -> Vocabulary:
    """The vocabulary of a rank file's content; kept by the worker that built it."""
    return Vocabulary(read_ranks(data), lookahead=lookahead)
