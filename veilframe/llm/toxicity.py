"""Toxicity scores from a counterfactually regularised linear classifier.

A logistic regression over the words of a text and their beginnings, each as marks for one,
two, four or eight occurrences. In each labelled text, identity terms are swapped for others
of their group; the squared change of the logit, over all marks that change, is part of the loss, so that naming a group
does not move the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import id_crc, packed, unpacked
from veilframe.plans.scale import written

IDENTITY_GROUPS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("disabled", "blind", "deaf"),
    ("old", "young", "elderly"),
)

WORD = re.compile(r"\w+")

STEMS = (4, 5, 6)
"""Lengths of the beginnings of longer words that count as features, marked by `-`."""

TIMES = (1, 2, 4, 8)
"""A feature that occurs so many times has its mark, with the number behind it if over 1."""

MEMO = 150_000
"""Words whose features a worker remembers; all are forgotten when it is full."""


@dataclass(frozen=True)
class Settings:
    """`sample` bounds the labelled rows per class that a model is fitted to."""

    sample: int = 6_000
    vocabulary: int = 4_096
    min_rows: int = 3
    ridge: float = 1e-3
    swap_weight: float = 1.0
    steps: int = 400
    identity_groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS


@dataclass
class Model:
    """Weights of marks. Only features that have one are looked for in a text."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0

    def __post_init__(self) -> None:
        known = {mark.partition("*")[0] for mark in self.weights}
        self.levels = {f: [(n, self.weights.get(mark(f, n), 0.0)) for n in TIMES] for f in known}
        self.memo: dict[str, list[str]] = {}

    def logit(self, text: str | None) -> float:
        counts: Counter[str] = Counter()
        if len(self.memo) > MEMO:
            self.memo.clear()
        for word, n in Counter(WORD.findall(text.lower()) if text else ()).items():
            known = self.memo.get(word)
            if known is None:
                known = self.memo[word] = [f for f in word_features(word) if f in self.levels]
            for f in known:
                counts[f] += n
        return self.bias + sum(w for f in sorted(counts) for n, w in self.levels[f] if counts[f] >= n)


def mark(feature: str, times: int) -> str:
    return feature if times == 1 else f"{feature}*{times}"


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in STEMS if len(word) > n)]


def marks_of(text: str | None) -> set[str]:
    counts: Counter[str] = Counter()
    for word, n in Counter(WORD.findall(text.lower()) if text else ()).items():
        for f in word_features(word):
            counts[f] += n
    return {mark(f, n) for f, c in counts.items() for n in TIMES if c >= n}


def swaps(words: set[str], groups: tuple[tuple[str, ...], ...]) -> list[tuple[str, str]]:
    """(term, other term) for each identity term in a text and each other term of its group."""
    return [(a, b) for group in groups for a in group if a in words for b in group if b not in words]


def swapped_marks(text: str | None, groups: tuple[tuple[str, ...], ...]) -> list[tuple[set[str], set[str]]]:
    """For each swap in a text, the marks that the swapped text no longer has, and those it has anew."""
    words = Counter(WORD.findall(text.lower()) if text else ())
    counts: Counter[str] = Counter()
    for word, n in words.items():
        for f in word_features(word):
            counts[f] += n
    out = []
    for a, b in swaps(set(words), groups):
        change = Counter(dict.fromkeys(word_features(b), words[a]))
        change.subtract(dict.fromkeys(word_features(a), words[a]))
        gone = {mark(f, n) for f, c in change.items() for n in TIMES if counts[f] + c < n <= counts[f]}
        come = {mark(f, n) for f, c in change.items() for n in TIMES if counts[f] < n <= counts[f] + c}
        out.append((gone, come))
    return out


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, float]:
    """doc_id, y, text, marks of up to `sample` labelled rows per class, and the share of class 1 among all.

    The rows with the smallest hashes are taken. An id with several labels has the largest.
    """
    known = labels.where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    known = known.where(id_crc(F.col("doc_id"), 5) != 0)
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = [known.where(F.col("y") == y).orderBy(*order).limit(sample) for y in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # two times `sample` rows at most

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(marks_of(t)))

    return written(docs.select("doc_id", "text").join(ids, "doc_id").select("doc_id", "y", "text", words("text").alias("words"))), share


def choose_words(rows: DataFrame, settings: Settings) -> list[str]:
    """The marks whose presence tells most about the label (chi-squared), and all identity terms."""
    n = rows.agg(F.count(F.lit(1)).alias("all"), F.sum("y").alias("ones")).first()
    total, ones = float(n["all"]), float(n["ones"] or 0)
    counts = rows.select("y", F.explode("words").alias("word")).groupBy("word")
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    both = a + b
    gap = a * F.lit(total) - both * F.lit(ones)
    tell = gap * gap / (both * (F.lit(total) - both) + F.lit(1.0))
    best = (
        counts.agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
        .where(both >= settings.min_rows)
        .orderBy(F.desc(tell), "word")
        .limit(settings.vocabulary)
    )
    chosen = {r["word"] for r in best.select("word").collect()}
    return sorted(chosen | {w for group in settings.identity_groups for w in group})


def fit(present: list[list[int]], y: np.ndarray, pairs: list[tuple[int | list[int], int | list[int]]], size: int, settings: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on log loss, ridge and the squared logit change of `pairs` (marks gone, marks come)."""
    row = np.repeat(np.arange(len(present)), [len(p) for p in present])
    col = np.array([c for p in present for c in p], np.int64)
    pairs = [tuple(np.array(x, np.int64).reshape(-1) for x in pair) for pair in pairs]
    swap = np.repeat(np.arange(len(pairs)), [len(gone) + len(come) for gone, come in pairs])
    moved = np.array([c for gone, come in pairs for c in (*gone, *come)], np.int64)
    sign = np.array([x for gone, come in pairs for x in (*[1.0] * len(gone), *[-1.0] * len(come))], float)
    w = np.zeros(size + 1)  # the last one is the bias
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, settings.steps + 1):
        logit = np.bincount(row, w[col], len(present)) + w[-1]
        miss = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) / max(1, len(y))
        grad = np.append(np.bincount(col, miss[row], size), miss.sum())
        grad[:-1] += settings.ridge * w[:-1]
        if len(pairs):
            change = np.bincount(swap, sign * w[moved], len(pairs)) * (2 * settings.swap_weight / len(pairs))
            grad[:-1] += np.bincount(moved, sign * change[swap], size)
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        w -= 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:  # noqa: B008
    """Fit a model on labelled rows whose crc32(doc_id) mod 5 is not 0.

    At most 2 x `sample` rows of word numbers reach the driver. Without labels of both
    classes the model says the share of class 1 for every text (0 without labels).
    """
    rows, share = sample_rows(docs, labels, settings.sample)
    vocabulary = choose_words(rows, settings)
    number = {w: i for i, w in enumerate(vocabulary)}
    groups = settings.identity_groups
    numbered = rows.select("y", "text", "words").mapInPandas(
        lambda batches: number_words(batches, number, groups),
        "y int, words array<int>, gone array<array<int>>, come array<array<int>>",
    )
    data = numbered.toPandas()
    prior = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if data["y"].nunique() < 2:
        return Model({}, prior)
    present = [sorted(w) for w in data["words"]]
    y = data["y"].to_numpy(float)
    pairs = [
        (list(gone), list(come))
        for row in zip(data["gone"], data["come"], strict=True)
        for gone, come in zip(*row, strict=True)
    ]
    weights, bias = fit(present, y, pairs, len(vocabulary), settings)
    # the sample has other class shares than the labels
    bias += prior - float(np.log(y.mean() / (1 - y.mean())))
    return Model({w: float(x) for w, x in zip(vocabulary, weights, strict=True) if x}, bias)


def number_words(
    batches: Iterator[pd.DataFrame], number: dict[str, int], groups: tuple[tuple[str, ...], ...]
) -> Iterator[pd.DataFrame]:
    def numbers(marks: Iterable[str]) -> list[int]:
        return sorted(number[m] for m in marks if m in number)

    for batch in batches:
        swapped = [swapped_marks(t, groups) for t in batch["text"]]
        yield pd.DataFrame(
            {
                "y": batch["y"],
                "words": batch["words"].map(numbers),
                "gone": pd.Series([[numbers(g) for g, _ in s] for s in swapped], batch.index, object),
                "come": pd.Series([[numbers(c) for _, c in s] for s in swapped], batch.index, object),
            }
        )


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 if score >= 0.5).

    Only the text is looked at, all of it. Null and empty texts have no words: their score is
    that of the bias. Rows are kept; columns with the two names are replaced.
    """

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        logits = np.array([model.logit(t) for t in texts], float)
        return pd.Series(1 / (1 + np.exp(-np.clip(logits, -40, 40))))

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    scored = docs.select(*kept, score(F.col(text)).alias("score"))
    names = [F.col(f"`{c}`") for c in scored.columns]
    return scored.select(*names, (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of `docs` that are not predicted to be toxic, with their columns only."""
    rows = packed(docs, _text=F.col(text))
    return unpacked(score_toxicity(rows, model, "_text").where("predicted = 0"), docs.columns)
