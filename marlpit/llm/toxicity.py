"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts and unlabelled texts are learnt from; with the class prior p, the risk of a classifier is
p * (loss of positives as positive) + max(0, (loss of unlabelled as negative) - p * (loss of positives as negative)).
A text's features are its distinct words, hashed; those that tell positives from unlabelled
texts apart, by counts over the training texts, get a weight.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.llm import arrow

BUCKETS = 1 << 20
PUNCTUATION = ".,;:!?\"'()#$%&*|<>[]{}-"
#: Lengths of word beginnings that are features too; none, as they met clean texts of some languages.
BEGINNINGS: tuple[int, ...] = ()


class Model(NamedTuple):
    """Weights of the chosen buckets (sorted), and the constant."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def word_buckets(words: pa.Array) -> np.ndarray:
    """Buckets of each distinct word: one for the word, one for each beginning; -1 where it has none."""
    out = np.full((len(words), 1 + len(BEGINNINGS)), -1, np.int64)
    for k, word in enumerate(pc.utf8_trim(words, PUNCTUATION).to_pylist()):
        raw = word.encode()
        if raw:
            out[k, 0] = zlib.crc32(raw) % BUCKETS
            for j, n in enumerate(BEGINNINGS, 1):
                if len(raw) >= n:
                    out[k, j] = zlib.crc32(raw[:n], n) % BUCKETS
    return out


def features(texts: pa.Array, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of each distinct feature of each text; with ``chosen``, its place there and no others."""
    found = arrow.split_words(texts, lower=True)
    own = word_buckets(found.words)
    size = BUCKETS
    if chosen is not None:
        size = max(1, len(chosen))
        place = np.searchsorted(chosen, own)
        own = np.where((own >= 0) & (place < len(chosen)) & (chosen[np.minimum(place, len(chosen) - 1)] == own), place, -1) if len(chosen) else np.full_like(own, -1)
    row = np.repeat(np.arange(len(texts)), np.diff(found.offsets))
    # of each text its distinct words first, then their features
    code = np.sort(row * (len(found.words) + 1) + found.codes)
    code = code[np.concatenate([[True], code[1:] != code[:-1]])] if len(code) else code
    row, word = code // (len(found.words) + 1), code % (len(found.words) + 1)
    pairs = [(row * size + own[word, j])[own[word, j] >= 0] for j in range(own.shape[1])]
    keys = np.sort(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return keys // size, keys % size


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    """From 0 to 1; a text without chosen features, as the empty one, gets the constant's."""
    row, place = features(texts, model.buckets)
    total = model.bias + np.bincount(row, weights=model.weights[place], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def train(row: np.ndarray, place: np.ndarray, positive: np.ndarray, n_features: int, prior: float, steps: int = 400, rate: float = 0.05, ridge: float = 2e-5) -> tuple[np.ndarray, float]:
    """Logistic weights of least non-negative risk, by Adam on all rows."""
    n = len(positive)
    to_pos, to_unl = positive / max(1, positive.sum()), ~positive / max(1, (~positive).sum())
    w, m, v = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        g = np.bincount(row, weights=w[place], minlength=n) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(g, -60, 60)))
        loss_neg = np.logaddexp(0, g)
        rest = to_unl @ loss_neg - prior * (to_pos @ loss_neg)
        pull = (to_unl - prior * to_pos) * p  # of the part that must not fall below 0
        pull = prior * to_pos * (p - 1) + pull if rest >= 0 else -pull
        slope = np.append(np.bincount(place, weights=pull[row], minlength=n_features), pull.sum())
        slope[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = 20_000, max_unlabelled: int = 40_000, max_features: int = 4_000, least_z: float = 6.0, least_positive: int = 6) -> Model:
    """Learns from at most ``max_positive`` confirmed toxic texts and about ``max_unlabelled`` others.

    ``may_learn`` (a condition on ``id_col``) says which rows labels may be learnt from; no other row is used at
    all. The class prior is the share of 1 among its labels. Both samples are those of lowest hash of the id,
    a bound on what is fitted only: scoring covers every row. Without positives or texts the model is a constant.
    Null ids and labels are left out, an id with several labels is positive if one of them is; repeated rows count each. Null texts are empty;
    very long ones are read whole, in one task. Other columns play no part, whatever their names.
    """
    allowed = F.lit(True) if may_learn is None else may_learn
    own = labels.filter(allowed).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").alias("label")).filter("doc_id is not null and label is not null")
    n, n_pos = own.agg(F.count("*"), F.count_if(F.col("label") == 1)).first()
    if not n_pos:
        return Model(np.zeros(0, np.int64), np.zeros(0), -3.0)
    prior = min(0.9, n_pos / n)
    positives = own.filter("label = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive)
    usable = docs.filter(allowed).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter("doc_id is not null")
    n_docs = usable.select("doc_id").count()
    share = min(1.0, max_unlabelled / max(1, n_docs))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000) if share < 1 else F.lit(True)
    # at most max_positive ids: a bound that holds for any table
    marked = usable.join(F.broadcast(positives.withColumn("positive", F.lit(True))), "doc_id", "left").filter(F.col("positive").isNotNull() | drawn)
    marked = marked.select("doc_id", "text", F.coalesce("positive", F.lit(False)).alias("positive"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in arrow.by_bytes(batch, arrow.texts_of(batch.column(1))):
                row, bucket = features(texts)
                yes = rows.column(2).to_numpy(zero_copy_only=False)
                pos, all_ = np.bincount(bucket[yes[row]], minlength=BUCKETS), np.bincount(bucket, minlength=BUCKETS)
                some = np.flatnonzero(all_)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (np.append(some, -1), np.append(pos[some], yes.sum()), np.append((all_ - pos)[some], (~yes).sum()))], ["bucket", "pos", "unl"])

    counts = marked.mapInArrow(counted, "bucket bigint, pos bigint, unl bigint").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl"))
    found = counts.filter("bucket < 0 or pos + unl >= 8").toPandas()  # a row for each of the fixed number of buckets at most
    total = found[found.bucket < 0]
    if not len(total) or not total.pos.sum() or not total.unl.sum():
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    np_, nu = float(total.pos.iloc[0]), float(total.unl.iloc[0])
    found = found[found.bucket >= 0].sort_values("bucket")
    pos, unl = found.pos.to_numpy(float), found.unl.to_numpy(float)
    even = (pos + unl) / (np_ + nu)
    z = (pos / np_ - unl / nu) / np.sqrt(even * (1 - even) * (1 / np_ + 1 / nu) + 1e-12)
    z = np.where((pos >= least_positive) | (z < 0), z, 0.0)  # a few positives by chance tell nothing
    best = np.argsort(-np.abs(z), kind="stable")[:max_features]
    chosen = np.sort(found.bucket.to_numpy(np.int64)[best[np.abs(z[best]) >= least_z]])

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in arrow.by_bytes(batch, arrow.texts_of(batch.column(1))):
                row, place = features(texts, chosen)
                at = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.ListArray.from_arrays(pa.array(at), pa.array(place.astype(np.int32)))], ["doc_id", "positive", "places"])

    # bounded: max_positive + max_unlabelled rows of places among max_features
    rows = marked.mapInArrow(reduced, "doc_id bigint, positive boolean, places array<int>").toPandas().sort_values("doc_id", kind="stable")
    sizes = rows.places.map(len).to_numpy(np.int64)
    row = np.repeat(np.arange(len(rows)), sizes)
    place = np.concatenate([np.zeros(0, np.int64), *rows.places.tolist()]).astype(np.int64)
    weights, bias = train(row, place, rows.positive.to_numpy(bool), len(chosen), prior)
    return Model(chosen, weights, bias)


def score(text: Column, model: Model) -> Column:
    """The model's score of each whole text, from 0 to 1; null counts as the empty text, equal texts score alike, an empty table gives no rows.

    A column's batches are cut by bytes; a very long text stands alone.
    """

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        texts = arrow.texts_of(column)
        parts = [scores(part, model) for _, part in arrow.by_bytes(pa.record_batch([texts], ["text"]), texts)]
        return pa.array(np.concatenate([np.zeros(0), *parts]))

    return scored(text)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Rows whose score is below ``threshold``, with all their columns as they were. Null and empty texts, which score as the constant
    does, and repeated rows are rows like any; an empty table stays empty."""
    return docs.filter(score(F.col(f"`{text_col}`"), model) < threshold)
