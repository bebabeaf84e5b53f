"""Operator 8, toxicity by weak supervision.

1. Lexicon: words, and beginnings of words, that occur in many more toxic than other
   documents, among a bounded sample of labelled rows (`MAX_LABELLED`, by hash of
   doc_id; one of equal texts). Each is a voter; so is each of a few patterns of the text.
2. Votes: one pass over every whole text leaves the numbers of the voters that fire
   and two counts.
3. Label model: a two-class generative model gives each voter a rate of firing in
   either class. It is fitted by expectation-maximisation over the vote patterns of
   all documents, started from and anchored by the labelled rows. Correlation of two
   voters within the classes, from the same sums, lowers the weight of both.
4. A logistic model on votes and counts is trained on the posterior labels of all
   documents by Newton steps, whose sums are taken by task.

Only rows with crc32(doc_id as text) mod 4 other than 2 are learned from. What reaches
the driver is as large as the number of voters squared.

Defined cases: null text is the empty text, and is scored; null labels are not learned
from; several labels of one doc_id count as their greatest; a null doc_id has no label and
held_out false; without labels every score is 0; repeated rows get equal scores; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, saved, text_or_empty
from .quality import row_batch, summed_rows

#: Labelled rows that the lexicon is chosen from.
MAX_LABELLED = 20_000
LEXICON = 200
#: Lengths of word beginnings that may be lexicon entries (written with a final *).
STEMS = (3, 4, 5, 6, 7)
#: A term is a candidate from so many toxic rows on, and an entry if, by chance alone,
#: at most MAX_CHANCE of all terms would be as toxic.
MIN_TOXIC, MAX_CHANCE = 4, 4.0
#: Candidates that the lexicon is picked from, and terms that a task counts before it hands them on.
CANDIDATES, HELD_TERMS = 4_000, 400_000
FOLDS, HELD_OUT = 4, 2
EM_STEPS, NEWTON_STEPS = 6, 6
#: Weight of a labelled row against an unlabelled one in the label model.
ANCHOR = 5.0
#: Correlation within a class below which voters count as independent.
LEAST_CORRELATION = 0.1

_WORD = re.compile(r"[^\W\d_]+")
PATTERNS = ("one_hit", "two_hits", "three_hits", "two_words", "three_words", "dense", "very_dense", "shouting", "exclaiming")
N_VOTERS = LEXICON + len(PATTERNS)


class Lexicon:
    """Entries are whole words, or beginnings that end in *; entry i is voter i."""

    def __init__(self, entries: list[str]):
        self.entries = entries
        self.number = {e: i for i, e in enumerate(entries)}
        # Most words are passed over by their first letters.
        self.heads = {e.rstrip("*")[: min(STEMS)] for e in entries}

    def found(self, word: str) -> list[int]:
        keys = [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]
        return [self.number[k] for k in keys if k in self.number]


def votes_of(text: str, lexicon: Lexicon) -> tuple[list[int], int, int]:
    """(voters, hits, words) of a text: the entries it has, then the patterns."""
    words = _WORD.findall(text.lower())
    heads, n_head = lexicon.heads, min(STEMS)
    voters: set[int] = set()
    hits = 0
    for w in [w for w in words if w[:n_head] in heads]:
        found = lexicon.found(w)
        hits += bool(found)
        voters.update(found)
    distinct, n = len(voters), max(1, len(words))
    capitals = sum(map(str.isupper, text.split()))
    tests = (hits >= 1, hits >= 2, hits >= 3, distinct >= 2, distinct >= 3, hits / n > 0.01, hits / n > 0.03, capitals > 0.3 * n, text.count("!") > n / 20)
    return sorted(voters) + [LEXICON + i for i, fires in enumerate(tests) if fires], hits, len(words)


def tail_chance(k: int, n: int, p: float) -> float:
    """P(X >= k) of n draws of chance p."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, min(n, k + 400) + 1)]
    return min(1.0, sum(map(math.exp, logs)))


def term_counts(texts: DataFrame) -> DataFrame:
    """(term, n, k) of (text, toxic): documents with the term, and toxic ones. Terms
    are distinct words and beginnings; tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def flushed() -> pa.RecordBatch:
            n, k = zip(*counts.values(), strict=True) if counts else ([], [])
            out = pa.record_batch([pa.array(list(counts), pa.string()), pa.array(n, pa.int64()), pa.array(k, pa.int64())], names=["term", "n", "k"])
            counts.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = set(_WORD.findall(text.as_py().lower()))
                terms = words.union(*({w[:n] + "*" for w in words if len(w) >= n} for n in STEMS))
                for t in terms:
                    c = counts.setdefault(t, [0, 0])
                    c[0] += 1
                    c[1] += toxic
                if len(counts) > HELD_TERMS:
                    yield flushed()
        yield flushed()

    return texts.select("text", "toxic").mapInArrow(run, "term string, n long, k long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def choose_lexicon(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """The terms that speak most for toxicity, by the sampled labelled rows; of equal
    ones the most particular."""
    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    # At most MAX_LABELLED rows of two numbers are broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")
    texts = saved(texts.groupBy(F.xxhash64("text").alias("key")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "op8-sample")
    n, toxic = texts.agg(F.count("*"), F.sum("toxic")).first()
    if not toxic:
        return Lexicon([])
    base = min(toxic / n, 0.999)
    z = (F.col("k") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    counted = saved(term_counts(texts).where(F.col("n") >= MIN_TOXIC), "op8-terms")
    n_terms = counted.count()
    top = counted.where(F.col("k") >= MIN_TOXIC).withColumn("z", z).where("z > 3").orderBy(F.desc("z"), F.desc(F.length(F.rtrim("term", F.lit("*")))), F.col("term").endswith("*"), "term").limit(CANDIDATES).collect()
    top = [r for r in top if tail_chance(r.k, r.n, base) * n_terms <= MAX_CHANCE]
    chosen: dict[str, int] = {}
    for r in top:
        stem = r.term.rstrip("*")
        if any(c.endswith("*") and stem.startswith(c[:-1]) for c in chosen):
            continue  # a chosen beginning covers it
        if r.term.endswith("*") and sum(k for c, k in chosen.items() if c.startswith(stem)) >= 0.7 * r.k:
            continue  # chosen words cover it
        chosen[r.term] = r.k
        if len(chosen) == LEXICON:
            break
    return Lexicon(list(chosen))


def vote_table(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, votes, hits, words) for each row; votes lists the voters that fire."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [votes_of(t.as_py(), shared.value) for t in batch.column(1)]
            votes, hits, words = zip(*got, strict=True) if got else ([], [], [])
            yield pa.record_batch([batch.column(0), pa.array(votes, pa.list_(pa.int32())), pa.array(hits, pa.int64()), pa.array(words, pa.int64())], names=["doc_id", "votes", "hits", "words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, votes array<int>, hits long, words long")


def bits_of(votes: pa.Array) -> np.ndarray:
    """A 0/1 row of all voters for each list."""
    out = np.zeros((len(votes), N_VOTERS))
    sizes = votes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out[np.repeat(np.arange(len(votes)), sizes), votes.flatten().to_numpy()] = 1
    return out


class LabelModel:
    """P(toxic), and each voter's rate of firing among others and among toxic rows."""

    def __init__(self, prior: float, rates: np.ndarray, weights: np.ndarray):
        self.prior, self.rates, self.weights = prior, rates, weights

    def posterior(self, bits: np.ndarray) -> np.ndarray:
        low, high = self.rates
        fires, silent = np.log(high / low), np.log((1 - high) / (1 - low))
        odds = np.log(self.prior / (1 - self.prior)) + (bits * fires + (1 - bits) * silent) @ self.weights
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def independence(pairs: np.ndarray, sums: np.ndarray, total: float) -> np.ndarray:
    """Sum over other voters of the correlation within one class."""
    rate = sums / max(total, 1e-9)
    cov = pairs / max(total, 1e-9) - np.outer(rate, rate)
    sd = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
    corr = cov / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    return np.where(corr > LEAST_CORRELATION, corr, 0).sum(1)


def fit_label_model(votes: DataFrame, labels: DataFrame) -> LabelModel | None:
    spark = votes.sparkSession
    m = N_VOTERS
    patterns = saved(votes.groupBy("votes").agg(F.count("*").alias("n")), "op8-patterns")
    known = votes.join(labels, "doc_id").groupBy("votes", "toxic").agg(F.count("*").alias("n"))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, m + 1))
        for batch in batches:
            bits, toxic, n = bits_of(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            full = np.hstack([bits, np.ones((len(bits), 1))]) * n[:, None]
            total += np.stack([full[toxic == 0].sum(0), full[toxic == 1].sum(0)])
        if total.any():
            yield row_batch(total)

    anchor = summed_rows(known.mapInArrow(labelled, "i int, values binary"))
    if not len(anchor) or not anchor[0, -1] or not anchor[1, -1]:
        return None
    rates = (anchor[:, :-1] + 0.5) / (anchor[:, -1:] + 1)
    model = LabelModel(anchor[1, -1] / anchor[:, -1].sum(), np.clip(rates, 1e-4, 1 - 1e-4), np.ones(m) * 0.5)
    for _ in range(EM_STEPS):
        shared = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2 * (m + 1), m + 1))
            for batch in batches:
                bits = bits_of(batch.column(0))
                q, n = shared.value.posterior(bits), batch.column(1).to_numpy()
                full = np.hstack([bits, np.ones((len(bits), 1))])
                total += np.vstack([(full * (n * (1 - q))[:, None]).T @ full, (full * (n * q)[:, None]).T @ full])
            yield row_batch(total)

        sums = summed_rows(patterns.mapInArrow(expect, "i int, values binary")).reshape(2, m + 1, m + 1)
        n = sums[:, -1, -1] + ANCHOR * anchor[:, -1]
        rates = (sums[:, -1, :-1] + ANCHOR * anchor[:, :-1] + 0.5) / (n[:, None] + 1)
        doubled = sum(independence(s[:-1, :-1], s[-1, :-1], s[-1, -1]) for s in sums) / 2
        model = LabelModel(n[1] / n.sum(), np.clip(rates, 1e-4, 1 - 1e-4), 1 / (1 + doubled))
    return model


def inputs(bits: np.ndarray, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    n = np.maximum(words, 1)
    return np.column_stack([bits, np.log1p(hits), np.minimum(100 * hits / n, 20), np.log1p(words), np.ones(len(n))])


def fit_linear(votes: DataFrame, model: LabelModel) -> np.ndarray:
    """Logistic regression on the posterior labels, by Newton steps over all documents."""
    spark = votes.sparkSession
    d = N_VOTERS + 4
    weights = np.zeros(d)
    groups = saved(votes.groupBy("votes", "hits", "words").agg(F.count("*").alias("n")), "op8-inputs")
    for _ in range(NEWTON_STEPS):
        shared = spark.sparkContext.broadcast((model, weights))

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            label_model, w = shared.value
            total = np.zeros((d + 1, d))
            for batch in batches:
                bits, (hits, words, n) = bits_of(batch.column(0)), (c.to_numpy() for c in batch.columns[1:])
                x, q = inputs(bits, hits, words), label_model.posterior(bits)
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                total[:-1] += (x * (n * p * (1 - p))[:, None]).T @ x
                total[-1] += x.T @ (n * (q - p))
            yield row_batch(total)

        total = summed_rows(groups.mapInArrow(sums, "i int, values binary"))
        weights = weights + np.linalg.solve(total[:-1] + np.eye(d), total[-1] - weights)
    return weights


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.3 on) for each row."""
    known = labels.where(F.col("toxic").isNotNull() & (crc_mod("doc_id", FOLDS) != HELD_OUT))
    known = saved(known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")), "op8-labels")
    votes = saved(vote_table(docs, choose_lexicon(docs, known)), "op8-votes")
    model = fit_label_model(votes, known)
    weights = fit_linear(votes, model) if model else None
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            hits, words = (c.to_numpy() for c in batch.columns[2:])
            score = np.zeros(len(hits)) if w is None else 1 / (1 + np.exp(-np.clip(inputs(bits_of(batch.column(1)), hits, words) @ w, -30, 30)))
            yield pa.record_batch([batch.column(0), pa.array(score), pa.array((score >= 0.3).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = votes.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
