"""Language identification by bit-sliced Bloom filters: each slot holds a bit for every language, so one look-up returns all languages that contain an n-gram."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts

SIZES = (2, 3, 4)
#: Texts of each language that the fit takes at most, about; the n-grams of each.
MOST_TEXTS, MOST_GRAMS = 2000, 20_000
#: An n-gram counts for a language when it is in this share of its texts, and in that share of the most of any language.
LEAST_SHARE, LEAST_OF_BEST = 0.01, 0.3
#: Slots for each n-gram of the language that has most; all languages share them, each with a bit of its own.
SLOTS_PER_GRAM, HASHES = 48, 2

_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def grams(text: str | None) -> np.ndarray:
    """64-bit hashes of the n-grams of lower-cased letters; what is no letter is a space, and no gram spans two words or holds two spaces."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(letters()[codes], codes, 0)
    if not codes.any():
        return np.zeros(0, np.uint64)
    codes = np.concatenate(([0], codes, [0])).astype(np.uint64)
    space, out = codes == 0, []
    for n in SIZES:
        if len(codes) < n:
            continue
        size = len(codes) - n + 1
        h, inner = np.full(size, n, np.uint64), np.zeros(size, bool)
        for i in range(n):
            h = (h ^ codes[i : i + size]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if 0 < i < n - 1:
                inner |= space[i : i + size]
        inner |= space[:size] & space[n - 1 :]
        out.append(h[~inner])
    return np.concatenate(out)


@dataclass(frozen=True)
class BitmaskFilter:
    languages: tuple[str, ...]
    slots: np.ndarray  # one mask of languages a slot; beyond 64 languages as many words as it takes
    false_rate: np.ndarray  # of each language

    @classmethod
    def build(cls, languages: tuple[str, ...], members: list[np.ndarray]) -> BitmaskFilter:
        size = 1 << int(np.ceil(np.log2(SLOTS_PER_GRAM * max([1, *map(len, members)]))))
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        words = -(-len(languages) // 64)
        slots = np.zeros((size, words) if words > 1 else size, kind)
        for bit, own in enumerate(members):
            for k in range(HASHES):
                at = cls.place(own, k, size)
                slots[(at, bit // 64) if words > 1 else at] |= kind(1 << bit % 64)
        filled = np.array([np.count_nonzero((slots[:, b // 64] if words > 1 else slots) & kind(1 << b % 64)) / size for b in range(len(languages))])
        return cls(languages, slots, filled**HASHES)

    @staticmethod
    def place(h: np.ndarray, k: int, size: int) -> np.ndarray:
        mixed = (h ^ np.uint64(0xD6E8FEB86659FD93 * (k + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
        return (mixed >> np.uint64(33)) & np.uint64(size - 1)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """The languages that hold each n-gram, some falsely."""
        out = self.slots[self.place(h, 0, len(self.slots))]
        for k in range(1, HASHES):
            out = out & self.slots[self.place(h, k, len(self.slots))]
        return out

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Expected true hits of each language: its population count less what false positives add."""
        masks = self.masks(h)
        if masks.dtype == np.uint8:
            by_mask = np.bincount(masks, minlength=256)
            found = np.array([by_mask[(np.arange(256) >> b) & 1 == 1].sum() for b in range(len(self.languages))], float)
        else:
            found = np.array([np.count_nonzero((masks[:, b // 64] if masks.ndim > 1 else masks) & np.uint64(1 << b % 64)) for b in range(len(self.languages))], float)
        return np.maximum(0, (found - len(h) * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and share of the hits; "und" and 0.0 for a text without letters, or where nothing was learned. No hits at all: the first language, 0.0."""
        h = grams(text)
        if not self.languages or not len(h) and not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        found = self.hits(h)
        best, total = int(np.argmax(found)), found.sum()
        return self.languages[best], float(found[best] / total) if total else 0.0


def fit(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST_TEXTS) -> BitmaskFilter:
    """Learns from about `most` texts of each language, chosen by the hash of their id and text, and of their n-grams from the MOST_GRAMS that most texts have.

    Two passes over the table, whatever the number of languages: one counts the texts, one the n-grams on the executors.
    Rows without language or text teach nothing; a null id counts like any other; an empty table gives a filter without languages.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if learn is not None:
        rows = rows.filter(learn)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    languages = tuple(counts)
    if not languages:
        return BitmaskFilter.build((), [])
    rate = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, most / n)))])
    picked = rows.filter(F.col("lang").isin(list(languages))).filter(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < F.lit(1_000_000.0) * rate[F.col("lang")])

    def own_grams(texts):
        return [[np.unique(grams(t)).view(np.int64).tolist() for t in texts]]

    listed = map_texts(picked, ["lang"], "text", {"grams": "array<bigint>"}, own_grams)
    in_texts = listed.select("lang", F.explode("grams").alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    floors = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(max(2.0, LEAST_SHARE * min(most, n))))])
    frequent = in_texts.filter(F.col("n") >= floors[F.col("lang")])
    best_first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = frequent.withColumn("k", F.row_number().over(best_first)).filter(F.col("k") <= MOST_GRAMS).select("lang", "gram", "n").toPandas()  # MOST_GRAMS rows a language
    shares: list[dict[int, float]] = []
    for k, n in counts.items():
        own = top[top["lang"] == k]
        shares.append(dict(zip(own["gram"].tolist(), (own["n"] / min(most, n)).tolist())))
    best: dict[int, float] = {}
    for own in shares:
        for g, s in own.items():
            best[g] = max(best.get(g, 0), s)
    members = [np.array([g for g, s in own.items() if s >= LEAST_OF_BEST * best[g]], np.int64).view(np.uint64) for own in shares]
    return BitmaskFilter.build(languages, members)


def identify(docs: DataFrame, model: BitmaskFilter, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns, lang_pred and score of every whole text. Null and letterless texts are "und"; equal texts, repeated rows among them, get equal results; null ids are kept; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 20,000 n-grams x 48 slots at most, rounded up to a power of two, of 8 bytes for every 64 languages: 8 MB

    def step(texts):
        m = shared.value
        return [list(c) for c in zip(*map(m.predict, texts))]

    return map_texts(docs, keep, text_col, {"lang_pred": "string", "score": "double"}, step)
