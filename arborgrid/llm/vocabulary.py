"""A public byte-level BPE vocabulary, loaded once per Python worker, and exact joins of its pieces.

Two facts make joins exact:

* Text: the splitting pattern looks ahead only, so every piece of a left part that ends before the
  part's end is also a piece of the whole text, and scanning on from any such border gives the
  whole text's pieces. Where a non-space is followed by white space there is always a border.
* Merges: a token sequence is the encoding of its bytes if and only if every two neighbours are
  the encoding of their own bytes. So a re-encoded window whose first and last tokens equal the
  tokens that stood there can replace the tokens between.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
#: Texts longer than so many code points are encoded in parts.
PART_CHARS = 8192
#: Pieces (by the pattern) of more than so many bytes are joined by windows, not encoded anew.
LONG_PIECE = 512


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """File of a vocabulary: a path is taken as it is, a bare name is looked up in the public package."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Encoder of one rank file. Ids are those of ordinary text: no string is special."""

    def __init__(self, path: str, pattern: str | None = None):
        import regex
        import tiktoken

        if pattern is None:
            from public_tokenizers import PATTERN as pattern
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.bytes_of[r] = b
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)

    def encode_part(self, text: str) -> list[int]:
        """Ids of a short text, in one go."""
        try:
            return self.encoding.encode_ordinary(text)
        except UnicodeEncodeError:  # lone surrogates
            return self.encoding.encode_ordinary(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Ids of one piece (merges only, no splitting)."""
        return self.encoding._core_bpe.encode_single_piece(piece)

    def encode(self, text: str | None) -> list[int]:
        """Ids of any text; none for a null or empty one. Long texts go by parts and joins."""
        if not text:
            return []
        if len(text) <= PART_CHARS:
            return self.encode_part(text)
        return self.join_all([(t, self.encode_part(t)) for t in cut_parts(text)])[1]

    def join_all(self, parts: list[tuple[str, list[int]]]) -> tuple[str, list[int]]:
        """Neighbours are joined two by two until one (text, ids) is left, as in a tree."""
        while len(parts) > 1:
            joined = [self.join(parts[i], parts[i + 1]) for i in range(0, len(parts) - 1, 2)]
            parts = joined + parts[len(parts) - len(parts) % 2 :]
        return parts[0] if parts else ("", [])

    def join(self, left: tuple[str, list[int]], right: tuple[str, list[int]]) -> tuple[str, list[int]]:
        """The encoding of left text + right text from the encodings of both."""
        (a, ids_a), (b, ids_b) = left, right
        if not a or not b:
            return a + b, ids_a + ids_b
        if _plain(a[-1]) and b[0] in " \n":
            return a + b, ids_a + ids_b
        start = self._last_piece(a)
        borders, until = self._sync(a[start:], b)
        keep = len(ids_a) - self._count_back(ids_a, len(a[start:].encode("utf-8", "surrogatepass")))
        drop = self._count_front(ids_b, len(b[:until].encode("utf-8", "surrogatepass")))
        middle = self._middle(a[start:], b[:until], borders, ids_a[keep:], ids_b[:drop])
        return a + b, ids_a[:keep] + middle + ids_b[drop:]

    def _middle(self, a: str, b: str, borders: list[int], ids_a: list[int], ids_b: list[int]) -> list[int]:
        whole = a + b
        if len(borders) == 1 and len(whole) > LONG_PIECE:
            first = self.pieces.match(b)
            if first and first.end() == len(b) and len(a) and self.pieces.match(a).end() == len(a):
                return self.join_merges(ids_a, ids_b)
        out, at = [], 0
        for end in borders:
            out += self.encode_bytes(whole[at:end].encode("utf-8", "replace"))
            at = end
        return out

    def join_merges(self, a: list[int], b: list[int]) -> list[int]:
        """Join within one piece: re-encode growing windows until both sides agree."""
        k = 8
        while True:
            left, right = a[-k:], b[:k]
            window = self.encode_bytes(b"".join(self.bytes_of[t] for t in left + right))
            if (k >= len(a) or window[0] == left[0]) and (k >= len(b) or window[-1] == right[-1]):
                return a[:-k] + window + b[k:]
            k *= 2

    def _last_piece(self, text: str) -> int:
        """Where the last piece of ``text`` starts."""
        look = 256
        while True:
            tail = max(0, len(text) - look)
            safe = 0 if tail == 0 else -1
            for i in range(max(1, tail), len(text)):
                if text[i] in " \n" and _plain(text[i - 1]):
                    safe = i
                    break
            if safe >= 0:
                break
            look *= 4
        last = safe
        for m in self.pieces.finditer(text, safe):
            last = m.start()
        return last

    def _sync(self, a: str, b: str) -> tuple[list[int], int]:
        """Borders of the pieces of a + b from a's start until one is also a border of b's own pieces.

        Returns the borders (offsets in a + b) and the last one's offset in b.
        """
        look = 256
        while True:
            head = b[:look]
            whole = len(head) == len(b)
            own = {m.end() for m in self.pieces.finditer(head)}
            ends = [m.end() for m in self.pieces.finditer(a + head)]
            if not whole:  # the last piece may go on
                own.discard(len(head))
                own -= {max(own, default=0)}
                ends = ends[:-2]
            borders = []
            for e in ends:
                borders.append(e)
                if e > len(a) and (e - len(a)) in own or e == len(a):
                    return borders, e - len(a)
            if whole:
                return borders, len(b)
            look *= 4

    def _count_back(self, ids: list[int], n_bytes: int) -> int:
        got = k = 0
        while got < n_bytes:
            k += 1
            got += len(self.bytes_of[ids[-k]])
        return k

    def _count_front(self, ids: list[int], n_bytes: int) -> int:
        got = k = 0
        while got < n_bytes:
            got += len(self.bytes_of[ids[k]])
            k += 1
        return k


def _plain(c: str) -> bool:
    return c.isascii() and c.isalnum()


def cut_parts(text: str, size: int = PART_CHARS) -> list[str]:
    """Cut a long text into parts of ``size`` to 1.5 times ``size`` code points, at a border of words
    where one lies in reach, else anywhere (the join repairs it)."""
    out, at = [], 0
    while len(text) - at > size * 3 // 2:
        end = at + size
        for i in range(end, end + size // 2):
            if text[i] in " \n" and _plain(text[i - 1]):
                end = i
                break
        out.append(text[at:end])
        at = end
    out.append(text[at:])
    return out


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)
