"""Cost-balanced packing of token sequences.

Each task packs the documents of its own input split: nothing is shuffled, and a window of pieces is held at a time.
Descending pieces go to the open sequence of lowest cost (linear plus quadratic attention cost) with room for them; what
fits nowhere is cut to fill the gaps, so that only a task's last sequences are padded.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from dataclasses import dataclass
from functools import cache
from itertools import chain, filterfalse

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ARROW, fresh, hold, importable, slices

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CAPACITY, END_ID = 4096, 2
#: Tokens in a window, about.
WINDOW = 1 << 20
#: Cost of a piece of n tokens: n + n * n / QUADRATIC.
QUADRATIC = 4096.0
#: Chunks whose ids a Python worker keeps, some 200 bytes each.
MOST_CACHED = 1_000_000
#: Documents and characters that are split into chunks at once.
SPLIT_ROWS, SPLIT_CHARS = 500, 2_000_000


#: A full stop or comma that follows another mark belongs to it.
_MARKS = re.compile(r"[.,](?=\s)(?<=[\W_].)(?<!\s.)")


class WordTokenizer:
    """Ids of whole texts, the same as the library's. White space bounds every token, so chunks between white space are encoded once and kept."""

    def __init__(self, path: str = TOKENIZER):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        vocab = self.own.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for word, i in vocab.items():
            self.ends[i] = word.endswith("</w>")
        self.chunks: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """Of words of letters only: each is one unit that ends with an end-of-word id."""
        out: list[bytes] = []
        for at in range(0, len(words), 4000):
            part = words[at : at + 4000]
            ids = np.array(self.own.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                out += map(self.whole, part)
                continue
            raw, cuts = ids.tobytes(), (cuts * 4).tolist()
            out += [raw[a:b] for a, b in zip([0, *cuts], cuts)]
        return out

    def _learn(self, chunks: list[str]) -> None:
        words = [c for c in chunks if c.isalpha() and c.lower().isalpha()]
        self.chunks.update(zip(words, self._words(words)))
        rest = [c for c in chunks if c not in self.chunks]
        for at in range(0, len(rest), 4000):
            part = rest[at : at + 4000]
            for c, e in zip(part, self.own.encode_batch_fast(part, add_special_tokens=False)):
                self.chunks[c] = np.array(e.ids, "<u4").tobytes()

    @staticmethod
    def split(text: str) -> list[str]:
        """Chunks whose ids joined are the text's. Case, which the tokenizer drops, and marks after a word go first, so that there are fewer different chunks."""
        if unicodedata.is_normalized("NFC", text) and "\u03a3" not in text:  # a capital sigma depends on its context
            text = text.lower()
        if not _MARKS.search(text):
            for mark in ",.":
                text = text.replace(f"{mark} ", f" {mark} ").replace(f"{mark}\n", f" {mark}\n")
        return text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids."""
        odd = {i for i, t in enumerate(texts) if "<|" in t or any(x in t for x in "\x1c\x1d\x1e\x1f\u0130")}  # added tokens; what str.split alone takes for white space; a letter that becomes two, the second a mark
        split = [[] if i in odd else self.split(t) for i, t in enumerate(texts)]
        new = set(filterfalse(self.chunks.__contains__, chain.from_iterable(split)))
        if len(self.chunks) + len(new) > MOST_CACHED:
            stay = {c: self.chunks[c] for c in set(chain.from_iterable(split)) if c not in new}
            self.chunks.clear()
            self.chunks.update(stay)
        self._learn(list(new))
        get = self.chunks.__getitem__
        return [self.whole(texts[i]) if i in odd else b"".join(map(get, s)) for i, s in enumerate(split)]


@cache
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@dataclass(slots=True)
class Piece:
    row: int  # of the document
    start: int
    ids: bytes

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.row, self.start, self.ids[: 4 * n]), Piece(self.row, self.start + n, self.ids[4 * n :])


def cost(n: int) -> float:
    return n + n * n / QUADRATIC


def pack(pieces: list[Piece], capacity: int, last: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences and the pieces left over. Unless it is the last call, all sequences are full; the last leaves nothing."""
    total = sum(map(len, pieces))
    n = -(-total // capacity) if last else total // capacity
    bins: list[list[Piece]] = [[] for _ in range(n)]
    room, spent, left = np.full(n, capacity), np.zeros(n), []
    for p in sorted(pieces, key=lambda p: (-len(p), p.row, p.start)):
        fits = np.flatnonzero(room >= len(p))
        if len(fits):
            i = fits[spent[fits].argmin()]
            bins[i].append(p)
            room[i] -= len(p)
            spent[i] += cost(len(p))
        else:
            left.append(p)
    for i in range(n):
        while room[i] and left:
            p = left.pop()
            if len(p) > room[i]:
                p, rest = p.cut(room[i])
                left.append(rest)
            bins[i].append(p)
            room[i] -= len(p)
    return bins, left


FIELDS = {"start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint", "sequence_length": "bigint"}


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer_file: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """One row a piece: id, where it starts in its document's ids, its sequence and the offset there; with_ids adds the ids themselves.

    Every id lies in one piece. A null or empty text has the end id alone. Repeated rows and rows with a null id are packed
    each for itself; an empty table gives no rows. Sequence numbers are unique: the task's number times 2**40 and a count.
    """
    importable(docs.sparkSession)
    text = fresh(docs, "__text")
    source = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(text))
    fields = FIELDS | ({"ids": "array<int>"} if with_ids else {})
    schema = T.StructType([source.schema[id_col], *[T.StructField(n, T._parse_datatype_string(k)) for n, k in fields.items()]])
    kinds = list(fields.values())

    def run(batches):
        coder, end = tokenizer(tokenizer_file), np.array([end_id], "<u4").tobytes()
        hold("packing", coder.chunks.clear)
        number, base = 0, TaskContext.get().partitionId() << 40
        waiting: list[Piece] = []
        held, row, known = 0, 0, {}  # known: row -> (id, tokens) of documents with waiting pieces

        def batch(sequences):
            nonlocal number
            rows = []
            for s in sequences:
                at = 0
                size = sum(map(len, s))
                for p in s:
                    doc_id, n = known[p.row]
                    rows.append((doc_id, p.start, len(p), zlib.crc32(p.ids), n, base + number, at, size, *([np.frombuffer(p.ids, "<u4").tolist()] if with_ids else [])))
                    at += len(p)
                number += 1
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *[pa.array(c, ARROW[k]) for c, k in zip(columns[1:], kinds)]], names=schema.names)

        id_type = pa.int64()
        for b in batches:
            id_type = b.schema.field(0).type
            for part in slices(b, 1, SPLIT_ROWS, SPLIT_CHARS):
                full = []
                for doc_id, ids in zip(part.column(0).to_pylist(), coder.encode(part.column(1).to_pylist())):
                    p = Piece(row, 0, ids + end)
                    known[row] = (doc_id, len(p))
                    row += 1
                    while len(p) >= capacity:
                        one, p = p.cut(capacity)
                        full.append([one])
                    if len(p):
                        waiting.append(p)
                        held += len(p)
                if full:
                    yield batch(full)
                if held >= WINDOW:
                    sequences, waiting = pack(waiting, capacity, False)
                    held = sum(map(len, waiting))
                    if sequences:
                        yield batch(sequences)
                rows = {p.row for p in waiting}
                known = {r: v for r, v in known.items() if r in rows}
        if waiting:
            yield batch(pack(waiting, capacity, True)[0])

    return source.mapInArrow(run, schema)
