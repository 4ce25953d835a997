"""Counting tokens by byte-pair merges over a vocabulary that the caller names.

A text is cut into pieces by the public o200k pattern; a piece's bytes are merged, the pair of the lowest rank first,
until no pair is in the vocabulary. A vocabulary is a file of lines `base64 rank`. Where none can be read, the heuristic
of four bytes a token stands in.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import regex

#: Fixed: the public o200k pre-tokenizer, its alternatives in order.
PIECE = regex.compile(
    r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
    r"|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
    r"|\p{N}{1,3}"
    r"| ?[^\s\p{L}\p{N}]+[\r\n/]*"
    r"|\s*[\r\n]+"
    r"|\s+(?!\S)"
    r"|\s+"
)


#: Halves of surrogate pairs, which no UTF-8 text holds.
HALVES = regex.compile("[\ud800-\udfff]")


def heuristic(text: str) -> int:
    return (len(text.encode("utf-8", "replace")) + 3) // 4


def pieces(text: str) -> Iterator[str]:
    return (m[0] for m in PIECE.finditer(text))


def merged(piece: bytes, ranks: dict[bytes, int]) -> int:
    """The number of tokens of a piece."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return len(parts)


class BytePairCounter:
    """Counts by a vocabulary file; each worker reads it once. Pieces' counts are kept, as most come again."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, text: str) -> int:
        count = _counter(self.path)
        return heuristic(text) if count is None else sum(count(p) for p in pieces(HALVES.sub("\ufffd", text)))


@lru_cache(maxsize=4)
def _counter(path: str):
    try:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in f if line.strip())}
    except (OSError, ValueError):
        return None
    try:
        import tiktoken

        library = tiktoken.Encoding("own", pat_str=PIECE.pattern, mergeable_ranks=ranks, special_tokens={})
        one = lambda piece: len(library._encode_single_piece(piece))
    except (ImportError, ValueError):
        one = lambda piece: merged(piece, ranks)
    return lru_cache(maxsize=1 << 16)(lambda piece: one(piece.encode()))
