"""Problem 8: oversized texts cut into pieces of at most ``limit`` tokens at natural boundaries.

Balanced targets: the smallest number of pieces k = ceil((n - overlap) / (limit - overlap)) is
tried first. Cuts are aimed at equal lengths of what is left, and each snaps to the strongest
boundary near its target: paragraph (blank line), line, sentence, word; where none lies in reach,
to a border between tokens that is no part of a character. Where the limit can't be kept, or no
cut but a bare one is in reach and one more piece would bring a boundary into it, a piece is
added; the cuts before it stay. A piece starts up to ``overlap`` tokens before the cut that ended the piece before, at the
farthest word border in reach.

Cuts lie where a non-space is followed by white space or after ideographic full stops; both are
borders of the splitting pattern, so a piece has exactly its share of the text's tokens. Pieces
with a bare cut are encoded anew and the text is cut again if one exceeds the limit.

Texts of at most ``limit`` bytes are skipped before Python sees them: a token has a byte at least.

Defined cases: null, empty and short texts give no rows; repeated rows are cut each; a null id is
kept; the pieces without their overlaps, put together, are the text; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborgrid.llm import vocabulary as V

LIMIT = 512
OVERLAP = 48
#: Strengths of cuts.
BARE, WORD, SENTENCE, LINE, PARAGRAPH = range(5)
KINDS = ["bare", "word", "sentence", "line", "paragraph", "end"]


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Offsets (code points) of natural cuts in ascending order, and their strengths."""
    import regex

    at, strength = [], []
    for m in _pattern(regex).finditer(text):
        gap = m.group()
        if gap[0].isspace():
            if gap.count("\n") > 1:
                s = PARAGRAPH
            elif "\n" in gap:
                s = LINE
            else:
                before = text[max(0, m.start() - 4) : m.start()].rstrip("\"')]}»”’*_")
                s = SENTENCE if before[-1:] in ".!?…" and before else WORD
            at.append(m.start())
            strength.append(s)
        else:
            at.append(m.end())
            strength.append(SENTENCE)
    return at, strength


def _pattern(regex, kept: dict = {}):  # noqa: B006
    if not kept:
        kept["p"] = regex.compile(r"(?<=\S)\s+(?=\S)|[。！？]+(?=[\p{L}\p{N}])")
    return kept["p"]


def _char_of_token(voc: V.Vocabulary, text: str, ids: list[int]) -> np.ndarray:
    """Code point offset before each token and at the end; -1 where it lies within a character."""
    ends = np.concatenate([[0], np.cumsum(voc.lengths[np.asarray(ids)])])
    if text.isascii():
        return ends
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    starts = (raw & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(starts)])
    ok = np.concatenate([starts, [True]])
    return np.where(ok[ends], before[ends], -1)


def _cuts(n: int, k: int, limit: int, overlap: int, at: np.ndarray, strength: np.ndarray, bare: np.ndarray) -> list[tuple[int, int]] | None:
    """Cuts (token index, strength) of about k pieces, more where the limit or a boundary takes more; None
    if the limit is smaller than a character. A piece is added where it is needed: what lies before stays."""
    room = limit - overlap
    cuts: list[tuple[int, int]] = []
    last, left = 0, k
    while True:
        most = last + (limit if not cuts else room)
        if left <= 1 and n <= most:
            return cuts
        left = max(left, 2)
        least = max(last + 1, n - (left - 1) * room)
        if least > most:  # too few pieces are left for the limit
            left += 1
            continue
        target = last + (n - last) / left
        reach = room / 4
        lo, hi = max(least, int(target - reach)), min(most, int(target + reach))
        if lo > hi:
            lo, hi = least, most
        i, j = np.searchsorted(at, lo), np.searchsorted(at, hi, side="right")
        if i == j:
            lo, hi = least, most
            i, j = np.searchsorted(at, lo), np.searchsorted(at, hi, side="right")
        if i < j:
            score = strength[i:j] * (4.0 * limit) - np.abs(at[i:j] - target)
            b = i + int(np.argmax(score))
            cut = (int(at[b]), int(strength[b]))
        else:
            if np.searchsorted(at, last + 1) < np.searchsorted(at, most, side="right"):  # one more piece brings a boundary into reach
                left += 1
                continue
            i, j = np.searchsorted(bare, lo), np.searchsorted(bare, hi, side="right")
            if i == j:
                i, j = np.searchsorted(bare, last + 1), np.searchsorted(bare, most, side="right")
                if i == j:
                    return None
            cut = (int(bare[i + int(np.argmin(np.abs(bare[i:j] - target)))]), BARE)
        cuts.append(cut)
        last = cut[0]
        left = min(left - 1, max(1, -(-(n - last) // room)))  # no more pieces than the rest takes


def split_text(voc: V.Vocabulary, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, int]]:
    """Pieces of a text as (start, end, tokens, tokens shared with the piece before, strength of the
    cut at the end; 5 at the text's end), offsets in code points. Empty if the text fits the limit."""
    ids = voc.encode(text)
    n = len(ids)
    if n <= limit:
        return []
    chars = _char_of_token(voc, text, ids)
    usable = np.flatnonzero(chars >= 0)
    pos, strength = boundaries(text)
    where = np.searchsorted(chars[usable], pos)
    where = np.minimum(where, len(usable) - 1)
    exact = chars[usable][where] == np.asarray(pos, dtype=np.int64) if len(pos) else np.zeros(0, dtype=bool)
    at = usable[where][exact] if len(pos) else np.zeros(0, dtype=np.int64)
    strength = np.asarray(strength, dtype=np.int64)[exact] if len(pos) else np.zeros(0, dtype=np.int64)
    natural = set(at.tolist())
    tight = limit
    k = -(-(n - overlap) // (limit - overlap))
    while True:
        cuts = _cuts(n, k, tight, overlap, at, strength, usable)
        if cuts is None:
            raise ValueError("the limit is smaller than a character")
        edges = [0, *[c for c, _ in cuts], n]
        kinds = [*[s for _, s in cuts], len(KINDS) - 1]
        out, fits = [], True
        for i in range(len(edges) - 1):
            begin = edges[i]
            if i:
                low = max(edges[i - 1] + 1, edges[i] - overlap)
                a, b = np.searchsorted(at, low), np.searchsorted(at, edges[i])
                if a < b:
                    begin = int(at[a])
                elif edges[i] not in natural:
                    a = int(np.searchsorted(usable, low))
                    begin = int(usable[a])
            end = edges[i + 1]
            tokens = end - begin
            if (begin and begin not in natural) or (end != n and end not in natural):
                tokens = len(voc.encode(text[chars[begin] : chars[end]]))
            fits &= tokens <= limit
            out.append((int(chars[begin]), int(chars[end]), tokens, edges[i] - begin, kinds[i]))
        if fits:
            return out
        tight = max(overlap + 1, tight - 8)
        k = max(k, -(-(n - overlap) // (tight - overlap)))


def _splitter(path: str, id_col: str, text_col: str, limit: int, overlap: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = V.load(path)
        for b in batches:
            keys, texts = b.column(id_col), b.column(text_col)
            for at in range(0, b.num_rows, 500):
                rows: list[list] = [[] for _ in range(9)]
                for i, text in enumerate(texts.slice(at, 500).to_pylist(), at):
                    pieces = split_text(voc, text, limit, overlap)
                    for p, (start, end, tokens, shared, kind) in enumerate(pieces):
                        for col, v in zip(rows, (i, p, len(pieces), start, end, tokens, shared, KINDS[kind], text[start:end])):
                            col.append(v)
                if rows[0]:
                    cols = [keys.take(pa.array(rows[0])), *[pa.array(r, pa.int32()) for r in rows[1:7]], pa.array(rows[7]), pa.array(rows[8], pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, names)

    return run


def split_oversized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = V.DEFAULT_VOCABULARY) -> DataFrame:
    """id, piece, n_pieces, start_char, end_char, n_tokens, overlap_tokens, cut, piece_text of each text over ``limit`` tokens."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be from 0 to below limit")
    fields = [T.StructField(c, T.IntegerType()) for c in ("piece", "n_pieces", "start_char", "end_char", "n_tokens", "overlap_tokens")]
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *fields, T.StructField("cut", T.StringType()), T.StructField("piece_text", T.StringType())])
    over = df.select(id_col, text_col).where(F.octet_length(text_col) > limit)
    return over.mapInArrow(_splitter(V.vocabulary_path(vocabulary), id_col, text_col, limit, overlap, schema.names), schema)
