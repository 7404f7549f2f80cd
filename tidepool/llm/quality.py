"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by class log-count ratios.

Indicators of a text are n-grams: its words, pairs of neighbouring words, the
last two bytes of its words, and runs of four repeat marks (a mark says whether
a word equals the one so many words before it), which show repetition in any
language. Every indicator is scaled by the logarithm of the ratio of its
smoothed shares in the two classes, rows are brought to length 1, and the
weights come from dual coordinate descent. A logistic curve fitted on rows held
back from the descent turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .features import Fitting, Lookup, gather, labelled_sample, platt
from .words import Hasher, Slice, mix, slices, words
from .workers import freed

#: Bounds of the fit: labelled rows used, indicators kept, documents that an indicator must be in.
SAMPLE_ROWS = 20_000
MOST_TERMS = 200_000
LEAST_DOCS = 3

_PAIR = np.uint64(0xA0761D6478BD642F)
_END = np.uint64(0xE7037ED1A0B428DB)
#: How far back repeat marks look, and how many neighbouring marks make an indicator.
_BACK, _MARKS = (1, 2, 3, 4, 6), 4


def terms(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every indicator of a slice's documents."""
    found = words(part)
    owner = found.owner()
    hasher = Hasher(part.data)
    own = hasher.spans(found.begin, found.end)
    place = np.arange(len(own)) - found.low[owner] if len(own) else np.zeros(0, np.int64)
    second = np.flatnonzero(place >= 1)
    docs = [owner, owner[second], owner]
    hashes = [own, mix(own[second - 1] * _PAIR + own[second]), mix(hasher.spans(np.maximum(found.begin, found.end - 2), found.end) + _END)]
    for back in _BACK:
        mark = np.zeros(len(own), np.uint64)
        mark[back:] = own[back:] == own[: max(0, len(own) - back)]
        run = np.zeros(len(own), np.uint64)
        for k in range(min(_MARKS, len(own))):
            run[k:] = run[k:] * np.uint64(2) + mark[: len(own) - k]
        at = np.flatnonzero(place >= back + _MARKS - 1)
        docs.append(owner[at])
        hashes.append(mix((run[at] + np.uint64(back << 8)) * np.uint64(0x8EBC6AF09C88C6E3) + np.uint64(13)))
    return np.concatenate(docs), np.concatenate(hashes)


@dataclass
class NbSvm:
    """known: ascending indicator hashes; ratio, weight: of each; a, b: the logistic curve."""

    known: np.ndarray
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    a: float
    b: float

    def margins(self, docs: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        length = np.sqrt(np.bincount(docs, weights=self.ratio[at] ** 2, minlength=n)) if len(at) else np.zeros(n)
        dots = np.bincount(docs, weights=self.ratio[at] * self.weight[at], minlength=n) if len(at) else np.zeros(n)
        return dots / np.maximum(length, 1e-9) + self.bias

    def scores(self, docs: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margins(docs, at, n) + self.b, -30, 30)))


def _descend(rows: list[np.ndarray], ratio: np.ndarray, labels: np.ndarray, cost: float, rounds: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; classes weigh alike. The bias is one more indicator of value 1."""
    signs = np.where(labels == 1, 1.0, -1.0)
    share = {s: max(1, (signs == s).sum()) / len(signs) for s in (1.0, -1.0)}
    upper = np.array([cost * 0.5 / share[s] for s in signs])
    values = []
    for r in rows:
        v = ratio[r]
        values.append(v / max(1e-9, float(np.sqrt(v @ v))))
    square = np.array([float(v @ v) + 1.0 for v in values])
    weight, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    random = np.random.default_rng(7)
    for _ in range(rounds):
        for i in random.permutation(len(rows)).tolist():
            r, v, s = rows[i], values[i], signs[i]
            gradient = s * (float(weight[r] @ v) + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * s
                weight[r] += step * v
                bias += step
                alpha[i] = new
    return weight, bias


def fit(seen: Fitting, cost: float = 1.0, rounds: int = 12) -> NbSvm:
    """Fit on the indicators and 0/1 labels of documents. Without rows, or with one class only, every text scores the smoothed share of ones."""
    known, positive, negative, at, labels = seen.known, seen.positive, seen.negative, seen.rows, seen.labels
    p, q = labels.sum(), len(labels) - labels.sum()
    if not p or not q or not len(known):
        return NbSvm(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 0.0, 0.0, float(np.log((p + 1) / (q + 1))))
    ratio = np.log((positive + 1) / (positive + 1).sum()) - np.log((negative + 1) / (negative + 1).sum())
    held = np.arange(len(at)) % 5 == 4
    some = [r for r, h in zip(at, held) if not h]
    weight, bias = _descend(some, ratio, labels[~held], cost, rounds)
    model = NbSvm(known, ratio, weight, bias, 1.0, 0.0)
    rest = [r for r, h in zip(at, held) if h]
    margins = model.margins(np.repeat(np.arange(len(rest)), [len(r) for r in rest]), np.concatenate([*rest, np.zeros(0, np.int64)]).astype(np.int64), len(rest))
    model.a, model.b = platt(margins, labels[held])
    return model


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> NbSvm:
    """Fit on at most sample_rows labelled documents for which train_rows holds."""
    sample = labelled_sample(labels, id_col, label_col, train_rows, sample_rows)
    return fit(gather(docs, sample, id_col=id_col, text_col=text_col, terms=terms, least=LEAST_DOCS, most=MOST_TERMS))


def score(docs: DataFrame, model: NbSvm, text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """Add out_col: the score (0 to 1, higher: label 1 likelier) of each whole text.

    Null and empty texts are scored as texts without words. Every row keeps
    its other columns; a column named out_col is replaced.
    """
    base = docs.drop(out_col) if out_col in docs.columns else docs
    return with_scores(base, lambda: _scorer(model), text_col, out_col)


def _scorer(model: NbSvm):
    lookup = Lookup(model.known)

    def run(part: Slice) -> np.ndarray:
        return model.scores(*lookup.hits(*terms(part)), part.last - part.first)

    return run


def with_scores(base: DataFrame, make, text_col: str, out_col: str) -> DataFrame:
    """Add a double column computed from slices of the text column; a slice goes out when it is scored."""
    from pyspark.sql import types as T

    schema = T.StructType([*base.schema.fields, T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            for part in slices(batch.column(batch.schema.get_field_index(text_col))):
                rows = batch.slice(part.first, part.last - part.first)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(of(part), pa.float64())], names=[*batch.schema.names, out_col])

    return base.mapInArrow(freed(run), schema)
