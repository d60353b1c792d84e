"""Quality classifier by co-training.

Two views see a document: its text (hashed words, word pairs and byte trigrams, byte classes and their bigrams, word
repetition) and its page metadata (language, source, length). Each view is a logistic regression. Over rounds, each view labels the unlabelled documents that it is
most sure of and hands them to the other view. Then both are calibrated on a held-out fold (Platt) and combined; every
document is scored in one pass without moving rows.

Fitting uses at most `sample` labelled and `sample` unlabelled documents, those with the smallest hashes of their ids;
the bound is a parameter and the same at every size, and one row stands for an id, however often it repeats. Scoring
covers all documents and whole texts.

Defined cases: a null or empty text is not kept (score 0); null metadata is a value of its own; labels other than 0 and
1 are ignored, as are those of a document whose labels disagree; of rows that share an id the smallest is fitted on;
rows without an id are scored but not fitted on; without labels of both kinds every document with a word is kept and its
score is null; extra columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.llm.bytesx import BASE, IS_SPACE, chunks, strings, word_hashes
from lakequill.llm.common import small_batches

SAMPLE = 4000
ROUNDS = 4
CLASSES = 9
#: Buckets for the values of source and of lang.
SOURCE_BUCKETS, LANG_BUCKETS = 64, 16

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[IS_SPACE] = 4
_CLASS[ord("\n")] = 5
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 6
_CLASS[ord("!")] = 7
_CLASS[128:] = 8

#: Buckets for words, for pairs of words and for byte trigrams, and the place of the number of words among the rest.
GRAM_BUCKETS, REST = 96, CLASSES + CLASSES * CLASSES
TEXT_SIZE = REST + 6 + 3 * GRAM_BUCKETS
META_SIZE = SOURCE_BUCKETS + LANG_BUCKETS + 3


def _trigrams(data: np.ndarray) -> np.ndarray:
    """A hash of every three neighbouring bytes."""
    wide = data.astype(np.uint64)
    return wide[2:] | wide[1:-1] << np.uint64(8) | wide[:-2] << np.uint64(16)


def _shares(row: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows, the root of the share of its keys that falls into each bucket."""
    bucket = ((keys * np.uint64(BASE)) >> np.uint64(40)).astype(np.int64) % GRAM_BUCKETS
    many = np.bincount(row * GRAM_BUCKETS + bucket, minlength=n * GRAM_BUCKETS).reshape(n, GRAM_BUCKETS)
    return np.sqrt(many / np.maximum(many.sum(axis=1), 1)[:, None])


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of TEXT_SIZE numbers for each text."""
    n, out = len(offsets) - 1, np.zeros((len(offsets) - 1, TEXT_SIZE))
    for lo, hi in chunks(offsets, 1 << 18):
        begin, end = offsets[lo], offsets[hi]
        part, at = data[begin:end], offsets[lo : hi + 1] - begin
        size = np.diff(at)
        row = np.repeat(np.arange(hi - lo), size)
        kind = _CLASS[part].astype(np.int64)
        single = np.bincount(row * CLASSES + kind, minlength=(hi - lo) * CLASSES).reshape(-1, CLASSES)
        same = row[1:] == row[:-1]
        pair = np.bincount((row[1:] * CLASSES + kind[:-1])[same] * CLASSES + kind[1:][same], minlength=(hi - lo) * CLASSES * CLASSES).reshape(-1, CLASSES * CLASSES)
        words, first = word_hashes(part, at)
        count = np.diff(first)
        wrow = np.repeat(np.arange(hi - lo), count)
        again = np.bincount(wrow[1:][(words[1:] == words[:-1]) & (wrow[1:] == wrow[:-1])], minlength=hi - lo)
        order = np.lexsort((words, wrow))
        w, r = words[order], wrow[order]
        kinds = np.bincount(r[1:][(w[1:] == w[:-1]) & (r[1:] == r[:-1])], minlength=hi - lo)
        third = np.bincount(wrow[2:][(words[2:] == words[:-2]) & (wrow[2:] == wrow[:-2])], minlength=hi - lo)
        per_byte, per_word = np.maximum(size, 1)[:, None], np.maximum(count, 1)
        rest = np.stack([again / per_word, third / per_word, kinds / per_word, np.log1p(count) / 10, np.minimum(size / per_word, 40) / 10, np.log1p(kinds) / 10], axis=1)
        grams = [_shares(row[2:][same[1:] & same[:-1]], _trigrams(part)[same[1:] & same[:-1]], hi - lo)]
        near = wrow[1:] == wrow[:-1]
        grams += [_shares(wrow, words, hi - lo), _shares(wrow[1:][near], (words[1:] + words[:-1] * np.uint64(BASE))[near], hi - lo)]
        out[lo:hi] = np.concatenate([single / per_byte, pair / per_byte * 2, rest, *grams], axis=1)
    return out if n else np.zeros((0, TEXT_SIZE))


def _bucket(value: str | None, n: int) -> int:
    if value is None:
        return 0
    h = 2166136261
    for b in value.encode():
        h = (h ^ b) * 16777619 % (1 << 32)
    return 1 + h % (n - 1)


def meta_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    out = np.zeros((len(lang), META_SIZE))
    known: dict = {}
    for i, (a, b, c) in enumerate(zip(lang, source, n_chars, strict=True)):
        for at, v, n in ((0, b, SOURCE_BUCKETS), (SOURCE_BUCKETS, a, LANG_BUCKETS)):
            k = known.get((at, v))
            if k is None:
                k = known[at, v] = at + _bucket(v, n)
            out[i, k] = 1
        if c is None:
            out[i, -1] = 1
        else:
            size = np.log1p(max(float(c), 0.0)) / 10
            out[i, -3:-1] = size, size * size
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights and intercept, by Newton steps on the ridge-penalised likelihood."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    weight = np.ones(len(x)) if weight is None else weight
    w, scale = np.zeros(x.shape[1]), ridge * weight.sum()
    penalty = np.full(x.shape[1], scale)
    penalty[-1] = scale * 1e-3
    for _ in range(steps):
        p = _sigmoid(x @ w)
        grad = x.T @ (weight * (p - y)) + penalty * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    platt_text: np.ndarray
    platt_meta: np.ndarray
    combine: np.ndarray
    threshold: float

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The calibrated probability of good quality by text, by metadata, and by both."""
        a = margin(margin(text, self.text)[:, None], self.platt_text)
        b = margin(margin(meta, self.meta)[:, None], self.platt_meta)
        both = margin(np.clip(np.stack([a, b], axis=1), -30, 30), self.combine)
        return _sigmoid(a), _sigmoid(b), _sigmoid(both)


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, more_text: np.ndarray, more_meta: np.ndarray, rounds: int = ROUNDS, share: float = 0.05, sure: float = 0.9) -> Model:
    """Labelled rows (text, meta, y) and unlabelled ones (more_*). A third of the labelled rows calibrates.

    In each round each view hands the other at most `share` of the pool for each class, the surest first, and none below
    `sure`. A pseudo-label weighs 0.3 of a label. Documents are kept from a combined probability of one half.
    """
    fold = np.arange(len(y)) % 3 == 0
    if len(set(y[fold])) < 2 or len(set(y[~fold])) < 2:
        fold = np.zeros(len(y), dtype=bool)
    hold = fold if fold.any() else ~fold
    views, pools = [text, meta], [more_text, more_meta]
    given: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
    free = [np.ones(len(more_text), dtype=bool), np.ones(len(more_text), dtype=bool)]

    def fit(v: int) -> np.ndarray:
        x = np.concatenate([views[v][~fold], *[a for a, _ in given[v]]])
        t = np.concatenate([y[~fold], *[b for _, b in given[v]]])
        return fit_logistic(x, t, np.concatenate([np.ones((~fold).sum()), np.full(len(t) - (~fold).sum(), 0.3)]))

    fitted = [fit(0), fit(1)]
    for _ in range(rounds if len(more_text) else 0):
        for v in (0, 1):
            p, most = _sigmoid(margin(pools[v], fitted[v])), max(1, int(share * len(more_text)))
            for label, q in ((1.0, p), (0.0, 1 - p)):
                best = np.argsort(-q, kind="stable")
                best = [i for i in best[: 4 * most] if q[i] >= sure and free[1 - v][i]][:most]
                if best:
                    free[1 - v][best] = False
                    given[1 - v].append((pools[1 - v][best], np.full(len(best), label)))
        fitted = [fit(0), fit(1)]
    platt = [fit_logistic(margin(views[v][hold], fitted[v])[:, None], y[hold], ridge=1e-4) for v in (0, 1)]
    logits = np.clip(np.stack([margin(margin(views[v][hold], fitted[v])[:, None], platt[v]) for v in (0, 1)], axis=1), -30, 30)
    return Model(*fitted, *platt, fit_logistic(logits, y[hold], ridge=1e-4), 0.5)


def _fit_rows(docs: DataFrame, labels: DataFrame, sample: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and metadata features and labels (NaN where there is none) of at most `sample` labelled and `sample` unlabelled
    documents, by id."""
    order = F.xxhash64("doc_id", F.lit(seed))
    marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"), F.max("quality").alias("most"))
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    told = ids.join(marks.where("y = most").select("doc_id", "y"), "doc_id").orderBy(order, "doc_id").limit(sample)
    rest = ids.join(marks.select("doc_id"), "doc_id", "left_anti").orderBy(order, "doc_id").limit(sample).select("doc_id", F.lit(None).cast("double").alias("y"))
    picked = docs.select("doc_id", "text", "lang", "source", "n_chars").join(F.broadcast(told.union(rest)), "doc_id")
    # Rows that share an id become one before they move: a minimum is taken where they lie.
    single = picked.groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")).select("doc_id", "y", "row.*")
    found = small_batches(single).mapInArrow(_features, "doc_id long, y double, text binary, meta binary").toArrow().sort_by("doc_id")
    assert len(found) <= 2 * sample
    matrix = lambda name, k: np.frombuffer(b"".join(found[name].to_pylist()), dtype=np.float64).reshape(-1, k)
    return matrix("text", TEXT_SIZE), matrix("meta", META_SIZE), found["y"].to_numpy().astype(float)


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    take = lambda n: batch.column(batch.schema.get_field_index(n))
    text = text_features(*strings(take("text")))
    return text, meta_features(take("lang").to_pylist(), take("source").to_pylist(), take("n_chars").to_pylist())


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, meta = _views(batch)
        take = lambda n, b=batch: b.column(b.schema.get_field_index(n))
        yield pa.RecordBatch.from_arrays([take("doc_id").cast(pa.int64()), take("y"), pa.array([r.tobytes() for r in text], pa.binary()), pa.array([r.tobytes() for r in meta], pa.binary())], ["doc_id", "y", "text", "meta"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, seed: int = 7) -> Model | None:
    """A model, or None where the labels do not hold both classes."""
    text, meta, y = _fit_rows(docs, labels, sample, seed)
    told = ~np.isnan(y)
    if len(set(y[told])) < 2:
        return None
    return co_train(text[told], meta[told], y[told], text[~told], meta[~told], rounds)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, text_score, meta_score, score, keep for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([doc, *_scored(batch, model)], ["doc_id", "text_score", "meta_score", "score", "keep"])

    return small_batches(docs.select("doc_id", "text", "lang", "source", "n_chars")).mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, keep boolean")


def _scored(batch: pa.RecordBatch, model: Model | None) -> list[pa.Array]:
    text, meta = _views(batch)
    worded = text[:, REST + 3] > 0
    if model is None:
        blank = pa.nulls(len(batch), pa.float64())
        return [blank, blank, blank, pa.array(worded)]
    a, b, both = model.scores(text, meta)
    both = np.where(worded, both, 0.0)
    return [pa.array(a), pa.array(b), pa.array(both), pa.array(both >= model.threshold)]


def kept_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(_scored(batch, model)[3])

    return small_batches(docs).mapInArrow(run, docs.schema)
