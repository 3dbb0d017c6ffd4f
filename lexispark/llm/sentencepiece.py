"""Piece encoding by streaming Viterbi, and exact decoding.

The best segmentation of a text into pieces maximises the sum of piece
scores. The recurrence looks back at most the longest piece, so only a window
of that many positions is kept. Ids are committed whenever the backpointer
paths of all positions in the window run through one common boundary:
nothing that follows can change what lies before it. Where no piece holds two
neighbouring characters, every path has a boundary between them; such runs of
the text converge at once and are remembered.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, map_texts

SPACE = "▁"
#: Stands for a literal SPACE of a text while it is encoded; no decoded text holds a lone surrogate.
LITERAL = "\udc81"
#: Words, and segments between certain boundaries, that are remembered, and their greatest length.
_CACHE, _CACHED_CHARS = 400_000, 48


class Pieces:
    """A vocabulary: pieces with scores, and 256 byte pieces for characters that no piece holds.

    The model's own scores are kept if it has log-probabilities (unigram). A
    BPE model has merge ranks instead; ``zipf`` turns rank r into the
    log-probability -log(r + 2), up to a constant per piece.
    """

    def __init__(self, path: str, zipf: bool = True):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = [-1] * 256
        self.score: dict[str, tuple[float, int]] = {}
        rank = 0
        top = np.log(len(self.text) + 2.0)
        for i, piece in enumerate(self.text):
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.score[piece] = (-float(np.log(rank + 2.0) + top if zipf else -sp.get_score(i)), i)
                rank += 1
        self.unknown = sp.unk_id()
        self.byte_score = min(s for s, _ in self.score.values()) - 10.0
        self.longest = max(map(len, self.score))
        # a word takes the marks before it; a line break stands alone if no longer piece holds one
        apart = not any(p[k] != SPACE == p[k + 1] for p in self.score for k in range(len(p) - 1))
        lines = not any("\n" in p and len(p) > 1 for p in self.score)
        self.cut = re.compile({(True, True): f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+", (True, False): f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"}
                              .get((apart, lines), "(?s:.+)"))
        self.bigrams = {p[k:k + 2] for p in self.score for k in range(len(p) - 1)}
        # every ending of a piece, with its score and id if it is a piece itself: where none matches, no longer one can
        self.ending: dict[str, tuple[float, int]] = {p[k:]: (-np.inf, -1) for p in self.score for k in range(1, len(p))} | self.score
        # a piece that scores more than two of the best beats every other path over its characters
        self.sure = 2 * max(s for s, _ in self.score.values())
        self.raw = [piece.replace(SPACE, " ").encode() for piece in self.text]
        self.is_byte = {i: b for b, i in enumerate(self.bytes) if i >= 0}
        for i, b in self.is_byte.items():
            self.raw[i] = bytes((b,))
        self.words: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in (SPACE if char == LITERAL else char).encode("utf-8", "surrogatepass")]

    def viterbi(self, chars: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a character stream, committed part by part; the window holds ``longest`` positions."""
        longest, ending = self.longest, self.ending
        check = 4 * longest
        base, window = 0, ""  # window[i] is the character at base + i
        best: list[float] = [0.0]  # best[i]: score of the best path to base + i
        back: list[tuple[int, list[int]]] = [(0, [])]  # where it came from, and the ids of its last step
        for c in chars:
            window += c
            end = len(window)
            top = best[end - 1] + self.byte_score * (1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass")))
            came: tuple[int, list[int] | None] = (base + end - 1, None)
            for start in range(end - 1, max(0, end - longest) - 1, -1):
                known = ending.get(window[start:end])
                if known is None:
                    break
                if known[1] >= 0 and best[start] + known[0] >= top:  # of equal paths that with the longer last piece
                    top, came = best[start] + known[0], (base + start, [known[1]])
            best.append(top)
            back.append(came if came[1] is not None else (came[0], self.fallback(c)))
            if end >= check:
                cut = self._converged(base, back)
                if cut > base:
                    yield self._path(base, back, cut)
                    k = cut - base
                    window, best, back, base = window[k:], best[k:], back[k:], cut
                check = max(4 * longest, 2 * len(window))
        yield self._path(base, back, base + len(window))

    def _converged(self, base: int, back: list) -> int:
        """The last boundary on the paths of all positions that a later piece can start from."""
        live = set(range(base + max(0, len(back) - self.longest), base + len(back)))
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(back[last - base][0] if last > base else base)
        return live.pop()

    @staticmethod
    def _path(base: int, back: list, end: int) -> list[int]:
        steps = []
        while end > base:
            end, ids = back[end - base]
            steps.append(ids)
        return [i for ids in reversed(steps) for i in ids]

    def segments(self, text: str) -> Iterator[str]:
        """The text cut where no piece holds both neighbours, so that every path has a boundary."""
        at = 0
        bigrams = self.bigrams
        for i in range(1, len(text)):
            if text[i - 1:i + 1] not in bigrams:
                yield text[at:i]
                at = i
        yield text[at:]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; the empty text has none."""
        if not text:
            return []
        out: list[int] = []
        words = self.words
        for word in self.cut.findall(SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)):
            ids = words.get(word)
            if ids is None:
                ids = tuple(i for s in self.segments(word) for i in self._segment(s))
                self._remember(words, word, ids)
            out += ids
        return out

    def _segment(self, chars: str) -> tuple[int, ...]:
        ids = self.parts.get(chars)
        if ids is None:
            known = self.score.get(chars)
            if known is not None and known[0] > self.sure:
                ids = (known[1],)
            else:
                ids = tuple(i for part in self.viterbi(chars) for i in part)
            self._remember(self.parts, chars, ids)
        return ids

    @staticmethod
    def _remember(cache: dict[str, tuple[int, ...]], chars: str, ids: tuple[int, ...]) -> None:
        if len(chars) <= _CACHED_CHARS:
            if len(cache) >= _CACHE:
                cache.clear()
            cache[chars] = ids

    def decode(self, ids: Iterable[int]) -> str:
        """The text that ``ids`` encode: pieces with spaces for their marks, bytes as they are, less the leading space."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


_LOADED: dict[tuple[str, bool], Pieces] = {}


def pieces(path: str, zipf: bool = True) -> Pieces:
    if (path, zipf) not in _LOADED:
        _LOADED[path, zipf] = Pieces(path, zipf)
    return _LOADED[path, zipf]


def encode_texts(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", zipf: bool = True) -> DataFrame:
    """doc_id, ids array<int>: each whole text's pieces. Null and empty texts have no ids; rows are independent."""
    def run(texts: list[str | None]) -> dict:
        p = pieces(model, zipf)
        return {"ids": [p.encode(t or "") for t in texts]}

    return map_texts(df, id_col, text_col, run, "ids array<int>")


def decode_ids(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids", zipf: bool = True) -> DataFrame:
    """doc_id, text. Null ids decode to the empty text."""
    def run(b: pa.RecordBatch) -> dict:
        p = pieces(model, zipf)
        return {"text": [p.decode(i or []) for i in b.column("ids").to_pylist()]}

    return map_columns(df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")), ["doc_id"], run, "text string")


def round_trips(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", zipf: bool = True) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256, exact: each text encoded, its ids decoded, and compared."""
    def run(texts: list[str | None]) -> dict:
        p = pieces(model, zipf)
        out: dict = {"n_ids": [], "ids_crc32": [], "decoded_sha256": [], "exact": []}
        for t in texts:
            ids = p.encode(t or "")
            back = p.decode(ids)
            out["n_ids"].append(len(ids))
            out["ids_crc32"].append(zlib.crc32(np.array(ids, "<u4").tobytes()))
            out["decoded_sha256"].append(hashlib.sha256(back.encode("utf-8", "replace")).hexdigest())
            out["exact"].append(back == (t or ""))
        return out

    return map_texts(df, id_col, text_col, run, "n_ids long, ids_crc32 long, decoded_sha256 string, exact boolean")
