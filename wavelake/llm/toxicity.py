"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

From a bounded, documented sample of labelled training rows (SAMPLE rows, those of least hash), words and word beginnings
of 4 to 6 letters that toxic texts have far more often make a lexicon. It is dealt to VOTERS voters by its entries' first
four letters, so that no two voters see the same word: each has its own evidence; a few patterns (kinds, number and density of hits) vote too, and texts without a hit get a vote for clean. The generative
model estimates by EM how often each voter fires on toxic and on clean texts, and, from the correlations that remain
given the label, how much of each vote is independent evidence. Its posterior labels train a logistic regression on
lexicon hits and patterns, which scores every document from its text alone.

Null and empty texts get the score of a text without any hit. Labels that are null are no labels; a doc_id labelled
twice counts twice. Without labelled rows of both classes, or where fewer than LEAST_TOXIC toxic texts share any word,
every score is the sample's rate, or 0. Repeated rows stay rows; an empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelake.llm.common import bounded, fold_of, texts, with_field

SAMPLE, LEXICON, VOTERS, FOLDS = 20_000, 600, 24, 5
LEAST_TOXIC, LEAST_ODDS, LABEL_ACCURACY = 5, 3.0, 0.9
#: Both fits end when nothing changes by more than CLOSE. The label model's weights of evidence are fixed after SHARE_ROUNDS
#: rounds, as a correlation that crosses its threshold to and fro would keep it from an end; after MOST_ROUNDS it raises.
CLOSE, SHARE_ROUNDS, MOST_ROUNDS = 1e-6, 30, 10_000
WORD = re.compile(r"[^\W\d_]{3,}")
PATTERNS = ("any", "two", "four", "dense", "whole_word", "beginning", "none")


def entries_of(word: str) -> list[str]:
    """The lexicon keys that a word can match: itself (marked by a closing `$`) and its beginnings."""
    return [word + "$", *(word[:n] for n in (4, 5, 6) if len(word) > n)]


def text_entries(text: bytes) -> set[str]:
    return {e for w in set(WORD.findall(text.decode("utf-8", "replace").lower())) for e in entries_of(w)}


def sample_of(documents: DataFrame, labels: DataFrame, held_out: int, size: int) -> DataFrame:
    """text, toxic: at most `size` labelled documents outside the held-out fold, chosen by their ids' hash."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(fold_of(F.col("doc_id"), FOLDS) != held_out)
    plain = documents.select(F.col("doc_id").cast("long"), "text")
    present = known.join(plain.select("doc_id"), "doc_id", "left_semi")
    chosen = present.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(size)
    return plain.join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def entry_counts(sample: DataFrame) -> DataFrame:
    """entry, n0, n1: clean and toxic sample texts that have it, summed within tasks first."""

    def count(batches):
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist(), strict=True):
                seen[toxic > 0].update(text_entries(text))
        keys = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in seen)], ["entry", "n0", "n1"])

    return sample.mapInArrow(count, "entry string, n0 bigint, n1 bigint").groupBy("entry").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def mine_lexicon(sample: DataFrame, totals: dict[int, int], size: int = LEXICON) -> list[str]:
    """The entries with the highest smoothed log odds, of those that LEAST_TOXIC toxic texts have; at most `size`."""
    odds = F.log((F.col("n1") + 0.5) / (totals.get(1, 0) + 1.0)) - F.log((F.col("n0") + 0.5) / (totals.get(0, 0) + 1.0))
    best = entry_counts(sample).where(F.col("n1") >= LEAST_TOXIC).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    return [r.entry for r in best.orderBy(F.desc(F.col("odds") * F.sqrt("n1")), "entry").limit(size).collect()]


def features(text: bytes, number: dict[str, int]) -> tuple[list[int], np.ndarray]:
    """The lexicon entries in a text, and its patterns."""
    words = WORD.findall(text.decode("utf-8", "replace").lower())
    hit_words = [w for w in words if any(e in number for e in entries_of(w))] if number else []
    hits = sorted({number[e] for w in set(hit_words) for e in entries_of(w) if e in number})
    n = len(hit_words)
    whole = any(w + "$" in number for w in hit_words)
    return hits, np.array([n > 0, n > 1, n > 3, n * 50 > len(words), whole, n > 0 and not whole, n == 0], float)


def voter_of(entry: str) -> int:
    """All entries that one word can match begin alike, so they belong to one voter, and voters see different words."""
    return zlib.crc32(entry.rstrip("$")[:4].encode()) % VOTERS


def votes_of(hits: list[int], patterns: np.ndarray, voters: np.ndarray) -> np.ndarray:
    votes = np.zeros(VOTERS + len(PATTERNS))
    votes[voters[hits]] = 1
    votes[VOTERS:] = patterns
    return votes


def label_model(votes: np.ndarray, weight: np.ndarray, rate: float, rounds: int | None = None, labels: np.ndarray | None = None) -> tuple[np.ndarray, dict]:
    """Posterior probability of toxic for each row of votes (0 or 1), and the model: firing rates by class, evidence weights.

    Given labels are one more voter, of the fixed accuracy LABEL_ACCURACY: they keep the model's two classes toxic and clean.
    The model goes on to its fixed point, or for a stated number of rounds.
    """
    said = 0.0 if labels is None else np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY)) * (2 * labels - 1)
    toxic = np.clip(votes[:, VOTERS], 0.05, 0.95)  # begins with the vote of any hit
    share = np.ones(votes.shape[1])
    for turn in range(MOST_ROUNDS if rounds is None else rounds):
        p = {}
        for y, belief in ((1, toxic), (0, 1 - toxic)):
            w = weight * belief
            p[y] = np.clip((w @ votes + 0.5) / (w.sum() + 1), 1e-4, 1 - 1e-4)
        prior = np.clip((weight @ toxic + rate * 10) / (weight.sum() + 10), 1e-3, 1 - 1e-3)
        if rounds is not None or turn < SHARE_ROUNDS:
            residual = [(votes - p[y]) * np.sqrt(weight * b)[:, None] for y, b in ((1, toxic), (0, 1 - toxic))]
            cov = sum(r.T @ r for r in residual) / weight.sum()
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            correlation = np.abs(cov / scale[:, None] / scale)
            share = 1 / np.maximum(1.0, np.where(correlation > 0.1, correlation, 0).sum(axis=1))
        odds = said + np.log(prior / (1 - prior)) + (votes * (np.log(p[1]) - np.log(p[0])) + (1 - votes) * (np.log1p(-p[1]) - np.log1p(-p[0]))) @ share
        belief, before = 1 / (1 + np.exp(-np.clip(odds, -30, 30))), toxic
        # with fixed weights, steps of half the way can't swing between two states
        toxic = belief if rounds is not None or turn < SHARE_ROUNDS else (belief + before) / 2
        if rounds is None and turn >= SHARE_ROUNDS and np.abs(belief - before).max(initial=0) < CLOSE:
            break
    else:
        if rounds is None:
            raise ArithmeticError(f"the label model has no fixed point within {MOST_ROUNDS} rounds")
    return toxic, {"prior": prior, "fires": p, "share": share, "correlation": correlation}


@bounded
def fit(documents: DataFrame, labels: DataFrame, held_out: int = 0, size: int = SAMPLE) -> tuple[dict[str, int], np.ndarray]:
    """The lexicon (entry -> number) and the classifier's weights (entries, patterns, constant)."""
    sample = sample_of(documents, labels, held_out, size)
    totals = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    lexicon = mine_lexicon(sample, totals) if totals.get(1) and totals.get(0) else []
    number = {e: i for i, e in enumerate(lexicon)}
    weights = np.zeros(len(lexicon) + len(PATTERNS) + 1)
    rate = totals.get(1, 0) / max(1, sum(totals.values()))
    if not lexicon:
        weights[-1] = np.log(max(rate, 1e-4) / max(1 - rate, 1e-4))
        return number, weights
    sent = documents.sparkSession.sparkContext.broadcast(number)

    def describe(batches):
        for batch in batches:
            made = [features(t, sent.value) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in made], pa.list_(pa.int32())), pa.array([p.tolist() for _, p in made], pa.list_(pa.float64())), batch.column("toxic")], ["hits", "patterns", "toxic"])

    described = sample.mapInArrow(describe, "hits array<int>, patterns array<double>, toxic int")
    rows = described.groupBy("hits", "patterns", "toxic").count().orderBy("hits", "patterns", "toxic").collect()  # at most `size`
    voters = np.array([voter_of(e) for e in lexicon])
    patterns, weight = np.array([r["patterns"] for r in rows]), np.array([float(r["count"]) for r in rows])
    posterior, _ = label_model(np.array([votes_of(r["hits"], p, voters) for r, p in zip(rows, patterns, strict=True)]), weight, rate, labels=np.array([float(r["toxic"] > 0) for r in rows]))
    x = np.zeros((len(rows), len(lexicon)), np.float32)
    for i, r in enumerate(rows):
        x[i, r["hits"]] = 1
    return number, linear_classifier(np.hstack([x, patterns]), posterior, weight)


def linear_classifier(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Logistic regression on soft labels and weighted rows by Newton steps, each halved until the loss falls; the last
    weight is the constant. The loss is strictly convex, so the steps go to nothing."""
    x = np.hstack([x, np.ones((len(x), 1))])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return weight @ (np.logaddexp(0, z) - y * z) + ridge / 2 * w @ w

    w = np.zeros(x.shape[1])
    while True:
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        while np.abs(step).max() >= CLOSE and loss(w - step) >= loss(w):
            step /= 2
        w = w - step
        if np.abs(step).max() < CLOSE:
            return w


@bounded
def score(documents: DataFrame, labels: DataFrame, held_out: int = 0, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """kept (a struct of the columns in keep, of any names), and toxicity: the classifier's probability for the whole text."""
    number, weights = fit(documents, labels, held_out)
    sent = documents.sparkSession.sparkContext.broadcast((number, weights))
    plain = documents.select(F.struct(*keep).alias("kept"), "text")
    out = with_field(plain, "toxicity", T.DoubleType())

    def judge(batches):
        lexicon, w = sent.value
        of_patterns, constant = w[len(lexicon) : -1], w[-1]
        for batch in batches:
            made = []
            for text in texts(batch):
                hits, patterns = features(text, lexicon)
                made.append(1 / (1 + np.exp(-np.clip(w[hits].sum() + patterns @ of_patterns + constant, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], [*batch.schema.names, "toxicity"])

    return plain.mapInArrow(judge, out).select("kept", "toxicity")


def toxicity_report(documents: DataFrame, labels: DataFrame, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5)."""
    scored = score(documents.withColumn("doc_id", F.col("doc_id").cast("long")), labels, held_out).select("kept.doc_id", "toxicity")
    return scored.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == held_out).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is under 0.5, with all their columns."""
    return score(documents, labels, keep=tuple(documents.columns)).where("toxicity < 0.5").select("kept.*")
