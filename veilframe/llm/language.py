"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent letter n-grams of a language by rank. A document is
compared through the ranks of its own n-grams: each one costs the difference between the
two ranks, or a fixed penalty when the profile lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 400
"""Ranks of a profile, and of a document, that are compared."""

ORDERS = (1, 2, 3)
BITS = 21
GAP = 0
"""Code of everything between two words."""

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point: itself if it is a letter, else GAP."""
    global _letters
    if _letters is None:
        points = np.arange(0x110000)
        _letters = np.where([chr(p).isalpha() for p in points], points, GAP)
    return _letters


def gram_codes(text: str) -> np.ndarray:
    """All n-grams of the lower-cased words as numbers; words are padded with one gap on each side."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    code = letter_table()[points]
    code = code[np.concatenate([[True], (code[1:] != GAP) | (code[:-1] != GAP)])]
    single = code[code != GAP]
    pair = code[:-1] << BITS | code[1:]
    triple = pair[:-1] << BITS | code[2:]
    # a gap inside a triple would join two words
    return np.concatenate([single, pair, triple[code[1:-1] != GAP]])


def ranked_grams(text: str, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, best first; ties go to the smaller code."""
    grams, counts = np.unique(gram_codes(text), return_counts=True)
    return grams[np.lexsort((grams, -counts))[:most]]


def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts per language and n-gram; one table per task, as n-grams of letters are few."""
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            for at in range(0, len(texts), 500):
                codes = np.concatenate([gram_codes(t) for t in texts.iloc[at : at + 500]])
                grams, counts = np.unique(codes, return_counts=True)
                if lang in total:
                    grams = np.concatenate([total[lang][0], grams])
                    counts = np.concatenate([total[lang][1], counts])
                    grams, place = np.unique(grams, return_inverse=True)
                    counts = np.bincount(place, weights=counts).astype(np.int64)
                total[lang] = grams, counts
    for lang, (grams, counts) in total.items():
        yield pd.DataFrame({"lang": lang, "gram": grams, "n": counts})


def learn_profiles(docs: DataFrame, most: int = PROFILE) -> DataFrame:
    """lang, gram, rank (from 0) over all rows of `docs` (text, lang) with both values.

    At most `most` rows per language, however large the corpus.
    """
    known = docs.where("text is not null and lang is not null").select("lang", "text")
    counts = known.mapInPandas(count_grams, "lang string, gram long, n long")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = total.withColumn("rank", F.row_number().over(order) - 1)
    return ranked.where(F.col("rank") < most).select("lang", "gram", "rank")


def predict_language(docs: DataFrame, profiles: DataFrame, text: str = "text", most: int = PROFILE) -> DataFrame:
    """`docs` with lang_pred and score (0 to 1: share of the largest possible distance not reached).

    Ties go to the language that sorts first. Null texts and texts without a letter, and all
    texts when no language was learned, get `und` and 0. Rows are kept; columns with the two
    names are replaced. The profiles, `most` rows per language, are read into the plan.
    """
    rows = profiles.collect()
    langs = sorted({r["lang"] for r in rows})
    grams = np.unique(np.array([r["gram"] for r in rows], np.int64))
    place = {lang: i for i, lang in enumerate(langs)}
    ranks = np.full((len(langs), len(grams) + 1), -1, np.int32)  # the last column stands for unknown ones
    for r in rows:
        ranks[place[r["lang"]], np.searchsorted(grams, r["gram"])] = r["rank"]

    def judge(value: str | None) -> tuple[str, float]:
        own = ranked_grams(value, most) if value and langs else []
        if not len(own):
            return "und", 0.0
        at = np.searchsorted(grams, own)
        at = np.where(grams[np.minimum(at, len(grams) - 1)] == own, at, len(grams))
        theirs = ranks[:, at]
        cost = np.where(theirs < 0, most, np.abs(theirs - np.arange(len(own))))
        far = cost.sum(axis=1)
        best = int(far.argmin())
        return langs[best], 1.0 - float(far[best]) / (most * len(own))

    @F.pandas_udf("lang_pred string, score double")
    def label(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(t) for t in texts], columns=["lang_pred", "score"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    judged = docs.select(*kept, label(F.col(text)).alias("_label"))
    names = [F.col(f"`{c}`") for c in judged.columns if c != "_label"]
    return judged.select(*names, "_label.lang_pred", "_label.score")
