"""Toxicity scores by a factorization machine over hashed terms.

    score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

``x`` marks the hashed terms that a text contains: words and their leading four
to six letters, so inflected forms share a term. The pair factors learn what
additive weights cannot, such as an insult next to the mention of a group.

Training reads a sample of labelled rows on the driver, bounded in rows and in
bytes (``Settings``); scoring is one pass over the whole texts with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkb.session import table
from loomkb.storage import materialize

WORD = regex.compile(r"\w+")
PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class Settings:
    #: Hash space of the terms.
    bits: int = 20
    #: At most so many labelled rows, and so many bytes of their hashed terms, are used for fitting; hashes pick them.
    sample: int = 20_000
    sample_bytes: int = 128 << 20
    #: The least sampled rows with a term, and the standard errors that make a term matter by itself.
    least: int = 5
    clear: float = 3.0
    #: Labelled rows for each term kept for what it says by itself, and for what it says in pairs; so many terms may be kept of any sample.
    rows_per_term: int = 8
    rows_per_pair: int = 32
    any_sample: int = 64
    #: How much farther than the median term's its factors must move for a term to matter in pairs.
    far: float = 4.0
    factors: int = 4
    #: Spread of the first pair factors, passes over the sample in the first and the last fit, rows of a step.
    spread: float = 0.02
    first_epochs: int = 3
    epochs: int = 12
    batch: int = 8
    rate: float = 0.05
    decay: float = 1e-3
    seed: int = 7


@dataclass(frozen=True)
class Model:
    bits: int
    bias: float
    index: np.ndarray  # sorted hashed terms
    weights: np.ndarray
    factors: np.ndarray  # one row per term

    @cached_property
    def slots(self) -> np.ndarray:
        """Row of each hashed term; those outside the model have the last one, which is all zeros."""
        out = np.full(1 << self.bits, len(self.index), np.int32)
        out[self.index] = np.arange(len(self.index), dtype=np.int32)
        return out

    @cached_property
    def rows(self) -> np.ndarray:
        """Weight and factors of each term side by side."""
        return np.vstack([np.column_stack([self.weights, self.factors]), np.zeros(1 + self.factors.shape[1])])

    def score(self, terms: np.ndarray) -> float:
        found = self.rows[self.slots[terms]]
        total = found.sum(axis=0)
        v = found[:, 1:]
        pairs = 0.5 * float((total[1:] ** 2).sum() - (v * v).sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(self.bias + total[0] + pairs, -30, 30))))


class Terms:
    """Distinct hashed terms of texts; remembers the first ``remember`` words."""

    def __init__(self, bits: int, remember: int = 100_000):
        self.mask, self.remember, self.known = (1 << bits) - 1, remember, {}

    def of_word(self, word: str) -> bytes:
        forms = [word] + [word[:k] + "*" for k in PREFIXES if len(word) > k]
        return b"".join((xxhash.xxh3_64_intdigest(f.encode("utf-8", "surrogatepass")) & self.mask).to_bytes(4, "little") for f in forms)

    def __call__(self, text: str | None) -> np.ndarray:
        found: list[bytes] = []
        known = self.known
        for word in set(WORD.findall((text or "").lower())):
            ids = known.get(word)
            if ids is None:
                ids = self.of_word(word)
                if len(known) < self.remember and len(word) < 64:
                    known[word] = ids
            found.append(ids)
        return np.unique(np.frombuffer(b"".join(found), "<i4"))


def fit(rows: list[tuple[np.ndarray, int]], settings: Settings) -> Model:
    """Fit on (distinct hashed terms, label 0/1) rows; with one label only, a constant score, without rows one below a half.

    A first fit has every term of at least ``least`` rows. The model is fitted
    again on the terms that matter by themselves (their shares in the two
    labels differ by ``clear`` standard errors) or by their pairs (their
    factors moved most in the first fit), the clearest ones first, one for each
    ``rows_per_term`` and ``rows_per_pair`` rows: more than the rows can tell
    apart is noise, which would add up in long texts.
    """
    y = np.array([label for _, label in rows], dtype=np.float64)
    positive, empty = int(y.sum()), np.zeros(0, np.int64)
    prior = float(np.log((positive + 0.5) / (len(y) - positive + 0.5))) if rows else -1.0
    constant = Model(settings.bits, prior, empty, np.zeros(0), np.zeros((0, settings.factors)))
    if not 0 < positive < len(y):
        return constant
    n0, n1 = (np.zeros(1 << settings.bits, np.int32) for _ in range(2))
    for terms, label in rows:
        (n1 if label else n0)[terms] += 1
    everything = np.flatnonzero(n0 + n1 >= settings.least)
    if not len(everything):
        return constant
    n0, n1 = n0[everything], n1[everything]
    share = (n0 + n1) / len(y)
    spread = np.sqrt(share * (1 - share) * (1 / positive + 1 / (len(y) - positive))) + 1e-12
    strength = np.abs(n1 / positive - n0 / (len(y) - positive)) / spread
    docs = slots_of([t for t, _ in rows], everything, 1 << settings.bits)
    del rows
    _, p = learn(docs, y, len(everything), settings, settings.first_epochs)
    moved = np.linalg.norm(p[:, 1:], axis=1) * np.sqrt(share * (1 - share))
    by_itself = np.argsort(-strength, kind="stable")[: max(settings.any_sample, len(y) // settings.rows_per_term)]
    by_itself = by_itself[strength[by_itself] > settings.clear]
    in_pairs = np.argsort(-moved, kind="stable")[: max(settings.any_sample, len(y) // settings.rows_per_pair)]
    in_pairs = in_pairs[moved[in_pairs] > settings.far * np.median(moved)]
    chosen = np.union1d(by_itself, in_pairs)
    if not len(chosen):
        return constant
    bias, p = learn(slots_of(docs, chosen, len(everything)), y, len(chosen), settings, settings.epochs)
    return Model(settings.bits, bias, everything[chosen], p[:, 0], p[:, 1:])


def slots_of(docs: list[np.ndarray], index: np.ndarray, size: int) -> list[np.ndarray]:
    """Places in ``index`` of each document's numbers below ``size``; those outside the index are left out."""
    slot = np.full(size, -1, np.int32)
    slot[index] = np.arange(len(index), dtype=np.int32)
    return [s[s >= 0] for s in (slot[d] for d in docs)]


def learn(docs: list[np.ndarray], y: np.ndarray, k: int, settings: Settings, epochs: int) -> tuple[float, np.ndarray]:
    """Bias, and weight and factors of ``k`` terms, of a factorization machine fitted by adaptive gradient steps of ``batch`` rows."""
    f, rng = settings.factors, np.random.default_rng(settings.seed)
    bias, seen_bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), 1e-8
    # a row of p: the term's weight, then its factors
    p, seen = np.column_stack([np.zeros(k), rng.normal(0, settings.spread, (k, f))]), np.full((k, 1 + f), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for start in range(0, len(order), settings.batch):
            part = [i for i in order[start : start + settings.batch] if len(docs[i])]
            if not part:
                continue
            at, lengths = np.concatenate([docs[i] for i in part]), [len(docs[i]) for i in part]
            first = np.r_[0, np.cumsum(lengths)[:-1]]
            rows_at = p[at]
            total = np.add.reduceat(rows_at, first)
            squares = np.add.reduceat((rows_at[:, 1:] ** 2).sum(axis=1), first)
            z = bias + total[:, 0] + 0.5 * ((total[:, 1:] ** 2).sum(axis=1) - squares)
            g = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y[part]
            seen_bias += float(g.sum()) ** 2
            bias -= settings.rate * float(g.sum()) / np.sqrt(seen_bias)
            own = np.repeat(g, lengths)
            step = own[:, None] * np.column_stack([np.ones(len(at)), np.repeat(total[:, 1:], lengths, axis=0) - rows_at[:, 1:]])
            met, which = np.unique(at, return_inverse=True)
            d = np.column_stack([np.bincount(which, step[:, j], len(met)) for j in range(1 + f)]) + settings.decay * p[met]
            seen[met] += d * d
            p[met] -= settings.rate * d / np.sqrt(seen[met])
    return float(bias), p.astype(np.float32)


def held_out(id_col: str | Column) -> Column:
    """Rows never learnt from: crc32 of the id as text is divisible by 5. Null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``sample`` labelled rows and ``sample_bytes`` of hashed terms, none of them held out.

    The ids of the sample are few and bounded, so they are broadcast to the
    scan of the texts; only hashed terms of sampled rows reach the driver, in
    order of their hashes until the bytes are used up. An id with several
    labels counts as toxic if one of them says so; null labels and null ids
    teach nothing, and equal rows of an id teach once. Without labelled rows
    every score is the same.
    """
    usable = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
    usable = usable.where("__id IS NOT NULL AND __label IN (0, 1)").where(~held_out(F.col("__id")))
    usable = usable.groupBy("__id").agg(F.max("__label").alias("__label"))
    picked = usable.orderBy(F.xxhash64("__id"), "__id").limit(settings.sample)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    sampled = texts.join(F.broadcast(picked), "__id").select("__id", "__label", "__text")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms(settings.bits)
        for batch in batches:
            yield pd.DataFrame({"id": batch["__id"], "label": batch["__label"], "terms": [terms(t).tobytes() for t in batch["__text"]]})

    rows = sampled.mapInPandas(hashed, "id long, label int, terms binary")
    rows = rows.select(F.xxhash64("id").alias("h"), "id", F.xxhash64("terms").alias("t"), "label", "terms").dropDuplicates(["id", "t"])
    rows = materialize(rows, "sample")
    sizes = rows.select("h", "id", "t", F.length("terms").alias("size")).orderBy("h", "id", "t").limit(settings.sample).collect()
    held, last = 0, None
    for r in sizes:  # at most ``sample`` rows of four numbers
        if held + r["size"] > settings.sample_bytes:
            break
        held, last = held + r["size"], r
    if last is None:
        return fit([], settings)
    place, end = F.struct("h", "id", "t"), F.struct(*[F.lit(last[c]).alias(c) for c in ("h", "id", "t")])
    return fit(_read(rows.where(place <= end), held), settings)


def _read(rows: DataFrame, size: int) -> list[tuple[np.ndarray, int]]:
    """(terms, label) in order of the rows' hashes; the terms, at most ``size`` bytes, stay in one array and come partition by partition."""
    everything, at, found = np.empty(size // 4, "<i4"), 0, []
    for r in rows.select("h", "id", "t", "label", "terms").toLocalIterator(prefetchPartitions=True):
        n = len(r["terms"]) // 4
        everything[at : at + n] = np.frombuffer(r["terms"], "<i4")
        found.append(((r["h"], r["id"], r["t"]), at, n, r["label"]))
        at += n
    return [(everything[start : start + n], label) for _, start, n, label in sorted(found)]


def score_column(model: Model, text: Column) -> Column:
    """Score of a text column; one Arrow batch at a time, no shuffle."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = Terms(model.bits)
        for batch in batches:
            yield pd.Series([model.score(terms(t)) for t in batch], dtype="float64")

    return scores(text)


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Null and empty texts get the model's constant score; a text of any length
    is scored whole. Ids may be null or repeat; each row is scored by itself,
    so equal texts get equal scores. An empty table gives an empty result.
    Other columns are not looked at.
    """
    out = docs.select(F.col(id_col).alias("doc_id"), score_column(model, F.col(text_col)).alias("score"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns.

    Null and empty texts have the model's constant score, below the threshold
    unless most labelled rows are toxic. Equal texts stay or go together; an
    empty table stays empty.
    """
    return docs.where(score_column(model, F.col(text_col)) < threshold)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(documents, train(documents, table(spark, sf_dir, "labels")))
