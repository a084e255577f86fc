"""SentencePiece encoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi search, and decoding joins pieces and bytes again.

The segmentation has the largest sum of log-probabilities, the objective of unigram models, over the pieces of the given
model file. A unigram model's scores are such logarithms. A merge model's are minus the rank of each merge: their sum would
take early merges apart from common words, so a rank r counts as the logarithm of 1 / (r + RANK_OFFSET), scaled to add up to
one over all pieces (the law of Zipf and Mandelbrot). Nothing is trained.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Callable
from functools import cache

import ahocorasick
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from tidemark.llm.common import map_texts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Added to the ranks of a merge model.
RANK_OFFSET = 30.0
LETTER = re.compile(r"[^\W_]")
#: Words and segmented units that a Python worker keeps, and the longest that it keeps.
MOST_WORDS, MOST_UNITS, LONGEST_KEPT = 800_000, 400_000, 100


class Coded(dict):
    """The ids of the strings met last, as bytes; one that is not there is coded anew."""

    def __init__(self, code: Callable[[str], bytes], most: int):
        super().__init__()
        self.code, self.most = code, most

    def __missing__(self, key: str) -> bytes:
        ids = self.code(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.clear()
            self[key] = ids
        return ids


class PieceCoder:
    def __init__(self, model_file: str = MODEL, model_proto: bytes | None = None):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model_proto) if model_proto else sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        self.scores = self.log_probabilities([None if x else sp.get_score(i) for i, x in enumerate(special)])
        self.automaton, least, inner, chars, pairs = ahocorasick.Automaton(), 0.0, False, set(), set()
        for i, p in enumerate(self.pieces):
            if not special[i]:
                s = self.scores[i]
                self.automaton.add_word(p, (len(p), s, i))
                least = min(least, s)
                inner |= SPACE in p.lstrip(SPACE)
                chars.update(p)
                pairs.update(zip(p, p[1:]))
        self.automaton.make_automaton()
        self.unknown_score = least - UNKNOWN_PENALTY
        self.single = {p for i, p in enumerate(self.pieces) if len(p) == 1 and not special[i]}
        # no piece spans the end of a word or a line break, or has a letter before one of these marks, so each such unit can be segmented alone
        marks = chars - {SPACE, "\n"} - {b for a, b in pairs if LETTER.fullmatch(a)} - set(filter(LETTER.fullmatch, chars))
        word = f"{SPACE}*{LETTER.pattern}+(?=[{re.escape(''.join(sorted(marks)))}])|" if marks else ""
        self.units = None if inner else re.compile(word + (f"\n+|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if "\n" not in chars else f"{SPACE}*[^{SPACE}]+|{SPACE}+"))
        self.unit_ids = Coded(lambda unit: array("i", self.segment(unit)).tobytes(), MOST_UNITS)
        self.word_ids = Coded(lambda word: self.joined_units(SPACE + word), MOST_WORDS)
        utf8 = [p.encode("utf-8", "surrogatepass") for p in self.pieces]
        self.utf8 = [bytes([self.byte_of[i]]) if i in self.byte_of else " ⁇ ".encode() if i == self.unknown else u for i, u in enumerate(utf8)]

    @staticmethod
    def log_probabilities(scores: list[float | None]) -> list[float | None]:
        """The scores themselves, or where all are whole numbers, which are the ranks of a merge model with a minus, the logarithms that stand for those."""
        ranks = [-s for s in scores if s is not None]
        if not all(r >= 0 and r == int(r) for r in ranks):
            return scores
        total = math.log(sum(1 / (r + RANK_OFFSET) for r in ranks))
        return [None if s is None else -math.log(RANK_OFFSET - s) - total for s in scores]

    def segment(self, unit: str) -> list[int]:
        """At each end position the automaton gives all pieces that end there, the longest first; each relaxes the best score. A character without a piece of its own may be unknown."""
        n = len(unit)
        best, back, ids = [0.0] + [-1e300] * n, [0] * (n + 1), [-1] * (n + 1)
        lone = [] if self.single.issuperset(unit) else [p for p, c in enumerate(unit) if c not in self.single]
        done = 0  # of the lone characters, those before this one are relaxed

        def unknown(p: int) -> None:
            if best[p] + self.unknown_score > best[p + 1]:
                best[p + 1], back[p + 1], ids[p + 1] = best[p] + self.unknown_score, p, -1

        for end, (size, score, piece) in self.automaton.iter(unit):
            while done < len(lone) and lone[done] < end:
                unknown(lone[done])
                done += 1
            start = end + 1 - size
            if (s := best[start] + score) > best[end + 1]:
                best[end + 1], back[end + 1], ids[end + 1] = s, start, piece
        for p in lone[done:]:
            unknown(p)
        out, p = [], n
        while p:
            out.append((ids[p], back[p], p))
            p = back[p]
        found: list[int] = []
        for piece, a, b in reversed(out):
            if piece >= 0:
                found.append(piece)
            elif self.bytes:
                found += [self.bytes[x] for x in unit[a:b].encode("utf-8", "surrogatepass")]
            elif not found or found[-1] != self.unknown:
                found.append(self.unknown)
        return found

    def joined_units(self, normal: str) -> bytes:
        return b"".join(map(self.unit_ids.__getitem__, self.units.findall(normal)))

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids as 32-bit integers in the machine's (little-endian) order."""
        normal = self.sp.normalize(text or "")
        if self.units is None:
            return array("i", self.segment(normal)).tobytes()
        if normal[:1] != SPACE or SPACE * 2 in normal:
            return self.joined_units(normal)
        return b"".join(map(self.word_ids.__getitem__, normal[1:].split(SPACE)))  # a unit begins at every single space, so words can be looked up whole

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.encode_bytes(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        """Runs of byte pieces are read as UTF-8, bad ones replaced; the space that encoding puts first goes again."""
        if self.silent.isdisjoint(ids):  # nothing but pieces ends a run of bytes, and they are valid themselves
            whole = b"".join(map(self.utf8.__getitem__, ids)).decode("utf-8", "replace")
            return whole.replace(SPACE, " ").removeprefix(" ")
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.silent:
                out.append(self.pieces[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ").removeprefix(" ")


@cache
def coder(model_file: str) -> PieceCoder:
    """One a worker process."""
    return PieceCoder(model_file)


def encode(docs: DataFrame, keep: list[str], text_col: str = "text", model_file: str = MODEL) -> DataFrame:
    """The kept columns and ids of every whole text. Null and empty texts have no ids; null ids and repeated rows are coded like any other row; an empty table gives no rows."""
    return map_texts(docs, keep, text_col, {"ids": "array<int>"}, lambda texts: [[coder(model_file).encode(t) for t in texts]])


def digest(docs: DataFrame, keep: list[str], text_col: str = "text", model_file: str = MODEL) -> DataFrame:
    """The kept columns, number and checksum of the ids, and whether they decode to the text. Null counts as empty: no ids, 0, true. Null ids and repeated rows are coded like any other row; an empty table gives no rows."""

    def one(c: PieceCoder, t: str | None) -> tuple:
        raw = c.encode_bytes(t)
        return len(raw) // 4, zlib.crc32(raw), c.decode(array("i", raw).tolist()) == (t or "")

    fields = {"n_ids": "bigint", "ids_crc32": "bigint", "decoded": "boolean"}
    return map_texts(docs, keep, text_col, fields, lambda texts: [list(x) for x in zip(*(one(coder(model_file), t) for t in texts))])
