"""Token counts of a public byte-level BPE vocabulary, for whole texts, in Arrow batches.

Byte-level BPE never merges across the pieces of its split pattern, and a piece never spans a
single blank between two visible characters. Counts are therefore cached per blank-separated
chunk; texts in which a blank touches other white space are encoded as a whole. Both ways give
exactly the counts of the tokenizer.
"""

from __future__ import annotations

import base64
import re
from pathlib import Path

#: Default vocabulary: byte-level BPE for many languages.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of the chunk cache before it is emptied (bounds a worker's memory, not the result).
CACHE = 500_000

_mixed_blank = re.compile(r"  |[^\S ] | [^\S ]")
_loaded: dict[str, Tokenizer] = {}


class Tokenizer:
    """Counts and cuts by tokens."""

    def __init__(self, vocabulary: str = VOCABULARY, pattern: str = SPLIT) -> None:
        import regex
        import tiktoken

        lines = Path(vocabulary).read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self._encoding = tiktoken.Encoding(Path(vocabulary).stem, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._pieces = regex.compile(pattern)
        self._cache: dict[str, int] = {}

    def _one(self, s: str) -> int:
        return len(self._encoding.encode_ordinary(s))

    def count(self, text: str | None) -> int:
        """Tokens of the whole text; 0 for NULL and ''."""
        if not text:
            return 0
        if _mixed_blank.search(text):
            return self._one(text)
        first, *rest = text.split(" ")
        cache = self._cache
        try:
            return (self._one(first) if first else 0) + sum(map(cache.__getitem__, rest))
        except KeyError:
            if len(cache) > CACHE:
                cache.clear()
            for w in rest:
                if w not in cache:
                    cache[w] = self._one(" " + w)
            return (self._one(first) if first else 0) + sum(map(cache.__getitem__, rest))

    def divide(self, text: str, capacity: int) -> list[tuple[int, int, int]]:
        """(start, stop, tokens) of consecutive parts of at most ``capacity`` tokens.

        Parts end between pieces of the split pattern; a single piece beyond the capacity is
        halved until its parts fit, and a character of several tokens is never divided.
        """
        out: list[tuple[int, int, int]] = []
        start, used = 0, 0
        todo = [m.span() for m in self._pieces.finditer(text)][::-1]
        while todo:
            a, b = todo.pop()
            n = self._one(text[a:b])
            if n > capacity and b - a > 1:
                todo += [((a + b) // 2, b), (a, (a + b) // 2)]
                continue
            if used + n > capacity and used:
                out.append((start, a, used))
                start, used = a, 0
            used += n
        if used:
            out.append((start, len(text), used))
        return out


def tokenizer(vocabulary: str = VOCABULARY, pattern: str = SPLIT) -> Tokenizer:
    """One tokenizer per worker process and vocabulary."""
    if vocabulary not in _loaded:
        _loaded[vocabulary] = Tokenizer(vocabulary, pattern)
    return _loaded[vocabulary]
