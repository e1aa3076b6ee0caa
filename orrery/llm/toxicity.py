"""Operator 1: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are lexicon densities, second-person proximity, capitals, punctuation and obfuscation rates of
the whole text.  The lexicon has a fixed base list and terms (words and word beginnings) learned from
the labelled sample; lexicon, trees and calibration are cross-fitted over folds of it.

Defined results: a null or empty text has zero features and gets the score that these give; a null
``doc_id`` is scored and not held out; repeated rows get equal results; without usable labels of both
classes every score is 0; an empty table gives an empty result; other columns are ignored by
``score_toxicity`` and left as they are by ``score_rows``, but for ``score``, which is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.arrow import slices
from orrery.llm.boosting import Isotonic, Trees, fit_isotonic, fit_trees
from orrery.llm.labelled import training_rows
from orrery.llm.text import held_out
from orrery.session import intermediate, written

#: Labelled documents that are used for fitting at most.
MAX_TRAIN = 12_000
#: Learned terms at most, and labelled documents that must hold one.
MAX_TERMS, MIN_DOCS = 400, 3
#: Parts of the sample for cross-fitting.
FOLDS = 5
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os".split())
INSULTS = frozenset("idiot idiots stupid moron morons scum trash worthless pathetic disgusting loser losers clown dumb fool filthy garbage vermin idiota estúpido basura imbécil idiote stupide ordure crétin dumm dummkopf abschaum müll trottel widerlich".split())
LEET = str.maketrans("013457@$!|", "oieastasil")
WORD = re.compile(r"[^\W_]+")
RAW = re.compile(r"\S+")
STEMS = (4, 5, 6)
#: Words between a lexicon hit and a pronoun that still count as near.
NEAR = 5
MIXED = re.compile(r"[A-Za-z][0-9@$!*|]+[A-Za-z]")
SPACED = re.compile(r"\b(?:[A-Za-z][.\-_* ]){3,}[A-Za-z]\b")
LONG_RUN = re.compile(r"(.)\1{3,}")
NAMES = (
    "log_words", "base_density", "term_density", "term_hits", "term_kinds", "term_weight", "stem_density", "stem_hits", "stem_weight", "hidden_hits", "hidden_density",
    "second_rate", "near_second", "near_share", "upper_rate", "capital_words", "exclaim_rate", "question_rate", "punct_rate", "symbol_rate", "digit_rate", "mixed_rate", "spaced_rate", "run_rate", "word_length",
)


@dataclass
class Lexicon:
    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


def candidate_terms(text: str) -> set[str]:
    """Words, and word beginnings marked by a final hyphen."""
    seen = set(WORD.findall(text.lower()))
    return seen | {f"{w[:n]}-" for w in seen for n in STEMS if len(w) > n}


def features(text: str, lexicon: Lexicon) -> list[float]:
    w = WORD.findall(text.lower())
    n, chars = len(w) or 1, len(text) or 1
    counts = Counter(w)
    base = sum(c for x, c in counts.items() if x in INSULTS)
    terms = {x: c for x, c in counts.items() if x in lexicon.terms}
    stems = {x: c for x, c in counts.items() if any(x[:k] in lexicon.stems for k in STEMS if len(x) > k)}
    hits = terms.keys() | stems.keys() | (INSULTS & counts.keys())
    near = total = 0
    if hits:
        you = [i for i, x in enumerate(w) if x in SECOND]
        at = [i for i, x in enumerate(w) if x in hits]
        total = len(at)
        if you:
            k = np.searchsorted(you, at)
            y = np.array([-(10**9), *you, 10**9])
            near = int((np.minimum(np.abs(y[k] - at), np.abs(y[k + 1] - at)) <= NEAR).sum())
    raw = RAW.findall(text)
    mixed = [r for r in raw if MIXED.search(r)]
    hidden = sum(1 for r in mixed for x in WORD.findall(r.lower().translate(LEET)) if x in INSULTS or x in lexicon.terms)
    spaced = SPACED.findall(text)
    upper, marks = sum(map(str.isupper, text)), sum(text.count(c) for c in ".,;:!?")
    symbols = sum(text.count(c) for c in "#*$%&|<>@~^")
    return [
        math.log1p(len(w)), base / n, sum(terms.values()) / n, sum(terms.values()), len(terms), sum(lexicon.terms[x] for x in terms),
        sum(stems.values()) / n, sum(stems.values()), sum(max(lexicon.stems.get(x[:k], 0.0) for k in STEMS) for x in stems), hidden, hidden / n,
        sum(c for x, c in counts.items() if x in SECOND) / n, near, near / (total or 1), upper / chars, sum(1 for r in raw if len(r) > 1 and r.isupper()) / (len(raw) or 1),
        text.count("!") / n, text.count("?") / n, marks / chars, symbols / chars, sum(map(str.isdigit, text)) / chars, len(mixed) / (len(raw) or 1), len(spaced) / n, sum(1 for _ in LONG_RUN.finditer(text)) / n, sum(map(len, w)) / n,
    ]


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    calibrate: Isotonic

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.array([features(t, self.lexicon) for t in texts])
        return np.clip(self.calibrate(self.trees.margin(x)), 0, 1)


def learn_lexicons(rows: DataFrame, most: int = MAX_TERMS, min_docs: int = MIN_DOCS) -> list[Lexicon]:
    """For each fold the terms of the other folds, and last those of all rows.

    Terms whose documents are toxic far more often than others, by smoothed log odds.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):  # partial counts of some documents at a time
            seen: Counter = Counter()
            for text, y, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen.update((t, fold, y) for t in candidate_terms(text))
            terms = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in terms], pa.string()), pa.array([t[1] for t in terms], pa.int32()), pa.array([t[2] for t in terms], pa.int32()), pa.array([seen[t] for t in terms], pa.int64())], ["term", "fold", "y", "n"])

    sizes = {(r["fold"], r["y"]): r["count"] for r in rows.groupBy("fold", "y").count().collect()}
    without = lambda k, what: F.coalesce(F.sum(F.when(what & (F.col("fold") != k), F.col("n"))), F.lit(0))
    counted = rows.select("text", "y", "fold").mapInArrow(count, "term string, fold int, y int, n long").groupBy("term")
    toxic = F.col("y") == 1
    counted = written(counted.agg(*[without(k, toxic).alias(f"t{k}") for k in range(FOLDS + 1)], *[without(k, ~toxic).alias(f"c{k}") for k in range(FOLDS + 1)]).where(F.col(f"t{FOLDS}") >= min_docs), "terms")
    found = []
    for k in range(FOLDS + 1):
        n_t, n_c = (sum(n for (fold, y), n in sizes.items() if fold != k and y == want) for want in (1, 0))
        t, c = F.col(f"t{k}"), F.col(f"c{k}")
        odds = F.log((t + 0.5) / (n_t + 1)) - F.log((c + 0.5) / (n_c + 1))
        best = counted.where(t >= min_docs).withColumn("odds", odds).where(F.col("odds") > 2.5).orderBy(F.desc(F.col("odds") * F.log1p(t)), "term").limit(most).collect()
        found.append(Lexicon({r["term"]: r["odds"] for r in best if r["term"][-1] != "-"}, {r["term"][:-1]: r["odds"] for r in best if r["term"][-1] == "-"}))
    return found


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, seed: int = 5) -> Model | None:
    """The model, or None if the sample lacks a class.

    Cross-fitted, so that every labelled row serves every part: a row's features use the lexicon of the
    other folds, and calibration uses the margins of trees that have not seen the row.
    """
    rows = training_rows(docs, labels, "toxic", most, seed)
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(FOLDS)).cast("int"))
    lexicons = learn_lexicons(rows)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [features(t, lexicons[k]) for t, k in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64())), batch.column(3)], ["doc_id", "y", "x", "fold"])

    got = rows.select("doc_id", "y", "text", "fold").mapInArrow(dense, "doc_id long, y int, x array<double>, fold int").toPandas().sort_values("doc_id")
    if got.empty or got["y"].nunique() < 2:
        return None
    x, y, fold = np.stack(got["x"].to_numpy()), got["y"].to_numpy(float), got["fold"].to_numpy()
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        margin[fold == k] = fit_trees(x[fold != k], y[fold != k]).margin(x[fold == k])
    return Model(lexicons[FOLDS], fit_trees(x, y), fit_isotonic(margin, y))


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, threshold: float = 0.5, seed: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text)."""
    with intermediate():
        model = fit(docs, labels, most, seed)
    scored = score_rows(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_rows(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``score``; one pass by partition.  The model (a few hundred KB) travels by broadcast."""
    docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield batch.append_column("score", pa.array(m.score(texts) if m else np.zeros(len(texts)), pa.float64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(score, f"{fields}, score double")
