"""Sparse rule ensemble: paths of shallow boosted trees become conjunctive rules over text statistics, a lasso logistic fit weighs them, and the score is a Spark column."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, map_texts

#: Labelled rows that the fit takes at most, those of the lowest hash of their id.
MOST_LABELLED = 20_000
TREES, DEPTH, SHRINK, BINS, LEAST_LEAF = 30, 3, 0.3, 32, 20
L1 = 0.002
THRESHOLD = 0.7


FEATURES = ("words", "word_length", "symbols", "bars", "capitals", "digits", "doubled_marks", "stops", "commas", "line_words", "distinct", "echoes")


def statistics(text: str | None) -> tuple[float, ...]:
    """FEATURES of a whole text, from one count of its bytes and one pass over its words; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=128)
    words = raw.split()
    n, w = max(1, len(raw)), max(1, len(words))

    def of(marks: bytes) -> float:
        return float(by_byte[list(marks)].sum())

    return (
        float(len(words)),
        len(raw) / w,
        of(b"#*$%&<>") / w,
        of(b"|") / w,
        float(by_byte[65:91].sum()) / n,
        float(by_byte[48:58].sum()) / n,
        (raw.count(b"!!") + raw.count(b"??")) / w,
        of(b".!?") / w,
        of(b",") / w,
        len(words) / (by_byte[10] + 1),
        len(set(words)) / w,
        sum(map(bytes.__eq__, words, words[1:])) / w,
    )


Condition = tuple[int, bool, float]  # feature, whether its value is over the cut, cut


@dataclass(frozen=True)
class RuleModel:
    features: tuple[str, ...]
    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]  # conditions that all hold, weight

    def column(self, value: dict[str, Column]) -> Column:
        """The score from the columns of the statistics."""
        terms = [F.lit(self.intercept)]
        for conditions, weight in self.rules:
            held = F.lit(True)
            for f, over, cut in conditions:
                c = value[self.features[f]]
                held = held & (c > cut if over else c <= cut)
            terms.append(F.when(held, F.lit(weight)).otherwise(F.lit(0.0)))
        while len(terms) > 1:  # in pairs: a chain as deep as there are rules overflows the driver's stack
            terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) & ~1 :]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-terms[0]))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for conditions, weight in self.rules:
            z += weight * holds(x, conditions)
        return 1 / (1 + np.exp(-z))


def holds(x: np.ndarray, conditions) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, over, cut in conditions:
        out &= x[:, f] > cut if over else x[:, f] <= cut
    return out


def tree_paths(x: np.ndarray, y: np.ndarray) -> list[tuple[Condition, ...]]:
    """The paths to all nodes but the roots of boosted regression trees on the logistic loss."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)  # bin b: c[b-1] < value <= c[b]
    z, paths = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), {}

    def grow(rows: np.ndarray, path: tuple[Condition, ...], g: np.ndarray, h: np.ndarray) -> None:
        if path:
            paths.setdefault(path)
        best = (1e-6, None)
        if len(path) < DEPTH and len(rows) >= 2 * LEAST_LEAF:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, f]
                sums = [np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows)))]
                gain = sums[0] ** 2 / (sums[1] + 1) + (total_g - sums[0]) ** 2 / (total_h - sums[1] + 1) - total_g**2 / (total_h + 1)
                gain[(sums[2] < LEAST_LEAF) | (len(rows) - sums[2] < LEAST_LEAF)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k))
        if best[1] is None:
            z[rows] += SHRINK * np.clip(g[rows].sum() / (h[rows].sum() + 1), -4, 4)
            return
        f, k = best[1]
        over = binned[rows, f] > k
        for side in (False, True):
            grow(rows[over == side], (*path, (f, side, float(cuts[f][k]))), g, h)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        grow(np.arange(len(y)), (), y - p, p * (1 - p))
    return list(paths)


def lasso(a: np.ndarray, y: np.ndarray, l1: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Intercept and weights of the logistic loss's mean plus l1 times the weights' absolute sum, by accelerated proximal steps."""
    n, k = a.shape
    b0, w, v0, v, t = float(np.log((y.sum() + 1) / (n - y.sum() + 1))), np.zeros(k), 0.0, np.zeros(k), 1.0
    v0 = b0
    rate = 4 / (1 + float((a**2).sum(1).max() if k else 0))
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(v0 + a @ v))) - y
        new0 = v0 - rate * r.mean()
        new = v - rate * (a.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v0, v = new0 + (t - 1) / nt * (new0 - b0), new + (t - 1) / nt * (new - w)
        b0, w, t = new0, new, nt
    return b0, w


def fit_rules(x: np.ndarray, y: np.ndarray, features: tuple[str, ...]) -> RuleModel:
    """With one class only, or no rows, the score is the smoothed rate of label 1."""
    if len(y) < 2 * LEAST_LEAF or y.min() == y.max():
        return RuleModel(features, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), ())
    paths = tree_paths(x, y)
    columns, seen = [], {}
    for p in paths:
        c = holds(x, p)
        seen.setdefault(c.tobytes(), p)
    paths = [p for p in seen.values() if 0 < holds(x, p).mean() < 1]
    columns = np.stack([holds(x, p) for p in paths], 1).astype(float) if paths else np.zeros((len(y), 0))
    scale = np.maximum(columns.std(0), 0.05)
    b0, w = lasso((columns - columns.mean(0)) / scale, y, L1)
    w = w / scale
    return RuleModel(features, float(b0 - columns.mean(0) @ w), tuple((p, float(v)) for p, v in zip(paths, w) if v))


def with_statistics(docs: DataFrame, keep: list[str], text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """The kept columns and one of each statistic, under names that clash with none."""
    names = {k: fresh(docs, f"__{k}") for k in FEATURES}
    return map_texts(docs, keep, text_col, {v: "double" for v in names.values()}, lambda texts: [list(c) for c in zip(*map(statistics, texts))]), names


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> RuleModel:
    """From the documents that have a label of 0 or 1 and for which learn holds; at most `most` rows. Null ids have no label; an id with several labels counts with each; without labels the model is a constant."""
    own = labels.select(F.col(id_col), F.col(label_col).alias("__y")).filter(F.col("__y").isin(0, 1))
    if learn is not None:
        own = own.filter(learn)
    own = own.orderBy(F.xxhash64(id_col), id_col, "__y").limit(most)  # a top-k of bounded size, `most` rows of two numbers
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text")).join(F.broadcast(own), id_col)
    frame, names = with_statistics(rows, ["__y"], "__text")
    got = frame.select("__y", *names.values()).orderBy(*names.values(), "__y").limit(2 * most).toPandas()
    x = got[list(names.values())].to_numpy(float) if len(got) else np.zeros((0, len(names)))
    return fit_rules(x, got["__y"].to_numpy(float), FEATURES)


def score(docs: DataFrame, model: RuleModel, keep: list[str], text_col: str = "text", into: str = "score") -> DataFrame:
    """The kept columns and the score; an empty or null text has the statistics of no words. Equal texts, repeated rows among them, score alike; null ids are kept; an empty table gives no rows."""
    frame, names = with_statistics(docs, keep, text_col)
    made = model.column({k: F.col(v) for k, v in names.items()})
    return frame.select(*[F.col(f"`{c}`") for c in keep], made.alias(into))


def accepted(docs: DataFrame, model: RuleModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score the threshold or more, with their own columns."""
    into = fresh(docs, "__score")
    return score(docs, model, docs.columns, text_col, into).filter(F.col(into) >= threshold).drop(into)
