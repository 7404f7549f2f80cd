"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its lower-case words and the prefixes of four to eight
bytes of its words (inflected and decorated forms share them). Every kept term
has a weight and a short vector; the product of two vectors is the weight of
the pair, so the model learns what two terms mean together, such as an insult
beside the mention of a group, which weights alone cannot.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame

from .features import Fitting, Lookup, gather, labelled_sample, platt
from .quality import with_scores
from .words import Hasher, Slice, words

#: Bounds of the fit: labelled rows used, terms read, documents that a term must be in.
SAMPLE_ROWS = 30_000
MOST_TERMS = 200_000
LEAST_DOCS = 3
#: Terms in a share of FREQUENT of the documents are read whatever they tell alone, since a pair of them may tell more; rarer ones from this chi-squared with the label on.
FREQUENT = 0.15
LEAST_STRENGTH = 4.0
FACTORS = 6
PREFIXES = (4, 5, 6, 7, 8)
_BATCH = 128


def terms(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word and word prefix; a word as long as a prefix is the same term."""
    found = words(part)
    owner, hasher = found.owner(), Hasher(part.data, lower=True)
    docs, hashes = [owner], [hasher.spans(found.begin, found.end)]
    size = found.end - found.begin
    for k in PREFIXES:
        at = np.flatnonzero(size > k)
        docs.append(owner[at])
        hashes.append(hasher.spans(found.begin[at], found.begin[at] + k))
    return np.concatenate(docs), np.concatenate(hashes)


@dataclass
class Machine:
    known: np.ndarray
    weight: np.ndarray
    vectors: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0
    losses: np.ndarray | None = None

    def margins(self, docs: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.bias)
        if len(at):
            out += np.bincount(docs, weights=self.weight[at], minlength=n)
            for f in range(self.vectors.shape[1]):
                v = self.vectors[at, f]
                out += 0.5 * (np.bincount(docs, weights=v, minlength=n) ** 2 - np.bincount(docs, weights=v * v, minlength=n))
        return out

    def scores(self, docs: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margins(docs, at, n) + self.b, -30, 30)))


def fit(seen: Fitting, *, factors: int = FACTORS, steps: int = 2000, rate: float = 0.1, decay: float = 0.02) -> Machine:
    """Adaptive stochastic gradient descent on the logistic loss, in fixed order: `steps` batches at least, and twelve rounds. With one class only, every text scores the smoothed share of ones."""
    known, at, labels = seen.known, seen.rows, seen.labels
    p, q = int(labels.sum()), int(len(labels) - labels.sum())
    if not p or not q or not len(known):
        return Machine(np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, factors)), float(np.log((p + 1) / (q + 1))))
    random = np.random.default_rng(11)
    model = Machine(known, np.zeros(len(known)), random.normal(0, 0.01, (len(known), factors)), float(np.log((p + 1) / (q + 1))))
    held = np.arange(len(at)) % 5 == 4
    train_rows = np.flatnonzero(~held)
    seen_w, seen_v = np.full(len(known), 1e-8), np.full((len(known), factors), 1e-8)
    for _ in range(max(12, -(-steps * _BATCH // max(1, len(train_rows))))):
        order = random.permutation(train_rows)
        for low in range(0, len(order), _BATCH):
            batch = order[low : low + _BATCH]
            n = len(batch)
            docs = np.repeat(np.arange(n), [len(at[i]) for i in batch])
            ids = np.concatenate([at[i] for i in batch])
            if not len(ids):
                continue
            margin = np.clip(model.margins(docs, ids, n), -30, 30)
            error = 1 / (1 + np.exp(-margin)) - labels[batch]
            model.bias -= 0.05 * float(error.mean())
            touched, local = np.unique(ids, return_inverse=True)
            g = np.bincount(local, weights=error[docs]) + decay * model.weight[touched]
            seen_w[touched] += g * g
            model.weight[touched] -= rate * g / np.sqrt(seen_w[touched])
            for f in range(factors):
                v = model.vectors[ids, f]
                sums = np.bincount(docs, weights=v, minlength=n)
                gv = np.bincount(local, weights=error[docs] * (sums[docs] - v)) + 10 * decay * model.vectors[touched, f]
                seen_v[touched, f] += gv * gv
                model.vectors[touched, f] -= 0.3 * rate * gv / np.sqrt(seen_v[touched, f])
    rest = [at[i] for i in np.flatnonzero(held)]
    margins = model.margins(np.repeat(np.arange(len(rest)), [len(r) for r in rest]), np.concatenate([*rest, np.zeros(0, np.int64)]).astype(np.int64), len(rest))
    if labels[held].sum() >= 8:  # too few rows don't fix a curve
        model.a, model.b = platt(np.clip(margins, -30, 30), labels[held])
    if held.any():
        z = model.a * np.clip(margins, -30, 30) + model.b
        model.losses = np.logaddexp(0, z) - labels[held] * z
    return model


def _telling(seen: Fitting) -> Fitting:
    """The fitting with those terms alone that tell LEAST_STRENGTH of the label by themselves."""
    total, share = seen.positive + seen.negative, seen.labels.mean()
    expected = total * share
    keep = (seen.positive - expected) ** 2 >= LEAST_STRENGTH * np.maximum(expected * (1 - share), 1e-9)
    place = np.cumsum(keep) - 1
    return Fitting(seen.known[keep], seen.positive[keep], seen.negative[keep], [place[r[keep[r]]].astype(np.int32) for r in seen.rows], seen.labels)


def choose(seen: Fitting) -> Machine:
    """The machine of the telling terms, or that of all terms read if its loss on the rows that neither is fitted to is smaller by more than three standard errors of the difference: pairs of terms that tell nothing alone count where the labels turn on them, and add no noise where they don't."""
    few = _telling(seen)
    plain = fit(few)
    if len(few.known) == len(seen.known):
        return plain
    whole = fit(seen)
    if plain.losses is None or whole.losses is None:
        return plain
    gain = plain.losses - whole.losses
    return whole if gain.mean() > 3 * gain.std() / np.sqrt(len(gain)) else plain


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fit on at most sample_rows labelled documents for which train_rows holds."""
    sample = labelled_sample(labels, id_col, label_col, train_rows, sample_rows)
    return choose(gather(docs, sample, id_col=id_col, text_col=text_col, terms=terms, least=LEAST_DOCS, most=MOST_TERMS, strength=LEAST_STRENGTH, frequent=FREQUENT))


def _scorer(model: Machine):
    lookup = Lookup(model.known)

    def run(part: Slice) -> np.ndarray:
        return model.scores(*lookup.hits(*terms(part)), part.last - part.first)

    return run


def score(docs: DataFrame, model: Machine, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """Add out_col: the score (0 to 1, higher: label 1 likelier) of each whole text.

    Null and empty texts are scored as texts without terms. Every row keeps
    its other columns; a column named out_col is replaced.
    """
    base = docs.drop(out_col) if out_col in docs.columns else docs
    return with_scores(base, lambda: _scorer(model), text_col, out_col)
