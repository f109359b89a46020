"""Mixing documents of uncertain domain to target token shares.

* A classifier of the labelled table's domains (here its pairs of labels) is trained on a
  bounded sample: multinomial logistic regression over hashed words and a few shape
  statistics. It gives each document a posterior, a soft membership in every domain.
* Rates r of all documents are fitted by projected gradient on the least-squares distance
  between expected domain totals, sum of r * tokens * posterior, and the targets; they
  start at one and stay between zero and ``MOST``. A gradient step needs only the totals of all
  documents, so each round is one pass over a narrow table and one small sum; a row's
  rate follows from the rounds' errors (``rounds`` short vectors), hence nothing of
  the documents is held or rewritten between rounds. Distances are weighted by a domain's
  own total and steps scaled by a document's tokens; then a step of one never overshoots,
  however long a document or rare a domain is. If the rounds do not reach the tolerance
  (posteriors that overlap), ``CLOSING`` more take the domains' overlap into account.
* Rates above one are realised as repeated copies: ``copies`` is the whole part of a rate, and
  one more with the rest as probability, drawn by a hash of the key. So the expected totals
  are the fitted ones, and a domain in short supply is repeated. ``taken`` are the documents
  of at least one copy; ``drawn`` gives the copies as rows.
* No document has more than ``MOST`` copies: else a few chance documents would stand for an
  absent domain thousands of times. A target out of their reach is missed, and a warning
  names the domain.

Defined results: null and empty texts have no tokens and a posterior like any other;
repeated rows are rated alike; without labels all posteriors are equal; domains that no
text can supply keep their distance to the target; an empty table gives an empty table;
input columns named like an added one are replaced.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeline.llm import bytescan
from lifeline.llm.columns import without
from lifeline.llm.store import Scratch

SLOTS = 1 << 13          # hashed words
SHAPES = 6
SAMPLE = 3000
CLOSING = 40
MOST = 4                 # copies of a document
ADDED = ("n_tokens", "posterior", "rate", "taken", "copies")

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b"#*$%&|<>")] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[33] = 4


@dataclass
class Rows:
    """Sparse rows: hashed words with weights, and dense shape statistics."""

    row: np.ndarray
    slot: np.ndarray
    weight: np.ndarray
    shape: np.ndarray
    tokens: np.ndarray


def described(piece: bytescan.Piece) -> Rows:
    found = bytescan.words(piece, bytescan.ALPHANUMERIC)
    tokens = bytescan.word_counts(piece, bytescan.NOT_SPACE)
    code = found.row.astype(np.int64) * SLOTS + (found.hash & np.uint64(SLOTS - 1)).astype(np.int64)
    code, times = np.unique(code, return_counts=True)
    row = code // SLOTS
    size = np.sqrt(np.bincount(row, weights=np.ones(len(row)), minlength=piece.rows))
    kind = _CLASS[piece.data]
    at = np.flatnonzero(kind)
    owner = np.searchsorted(piece.cuts, at, "right") - 1
    kinds = np.bincount(owner * 5 + kind[at], minlength=piece.rows * 5).reshape(-1, 5)
    bytes_ = np.maximum(np.diff(piece.cuts), 1)
    words_ = np.maximum(np.diff(found.first), 1)
    shape = np.stack([*(np.sqrt(kinds[:, k] / bytes_) for k in (1, 2, 3, 4)),
                      np.bincount(row, minlength=piece.rows) / words_, np.log1p(words_) / 10], axis=1)
    return Rows(row, code % SLOTS, 1 / np.maximum(size[row], 1), shape, tokens)


class Classifier:
    """Multinomial logistic weights: hashed words, then shapes, then the bias."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights           # (SLOTS + SHAPES + 1, domains)

    def posterior(self, x: Rows) -> np.ndarray:
        k = self.weights.shape[1]
        score = x.shape @ self.weights[SLOTS:SLOTS + SHAPES] + self.weights[-1]
        part = self.weights[x.slot] * x.weight[:, None]
        for c in range(k):
            score[:, c] += np.bincount(x.row, weights=part[:, c], minlength=len(score))
        score = np.exp(score - score.max(axis=1, keepdims=True)) if len(score) else score
        return score / score.sum(axis=1, keepdims=True)


def fit(x: Rows, y: np.ndarray, domains: int, rounds: int = 300, rate: float = 0.3, decay: float = 1e-5) -> Classifier:
    model = Classifier(np.zeros((SLOTS + SHAPES + 1, domains)))
    if not len(y):
        return model
    wanted = np.eye(domains)[y]
    seen = np.full_like(model.weights, 1e-8)
    for _ in range(rounds):
        error = (model.posterior(x) - wanted) / len(y)
        g = decay * model.weights
        for c in range(domains):
            g[:SLOTS, c] += np.bincount(x.slot, weights=error[x.row, c] * x.weight, minlength=SLOTS)
        g[SLOTS:SLOTS + SHAPES] += x.shape.T @ error
        g[-1] += error.sum(axis=0)
        seen += g * g
        model.weights -= rate * g / np.sqrt(seen)
    return model


def train(docs: DataFrame, labels: DataFrame, label_columns: Sequence[str], domains: Sequence[tuple],
          key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Classifier:
    """Fit on at most ``sample`` labelled rows, the first by a hash of the key. Domains are
    tuples of label values; rows with other values do not train."""
    chosen = labels.select(F.col(f"`{key}`").alias("_key"), *[F.col(f"`{c}`").cast("string").alias(f"_l{i}") for i, c in enumerate(label_columns)]
                           ).dropna().orderBy(F.xxhash64("_key"), "_key", *[f"_l{i}" for i in range(len(label_columns))]).limit(sample)
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "_key").select(
        "text", *[f"_l{i}" for i in range(len(label_columns))])
    names = {tuple(map(str, d)): i for i, d in enumerate(domains)}
    of = F.create_map(*[F.lit(v) for k, i in names.items() for v in ("\t".join(k), i)])[F.concat_ws("\t", *[f"_l{i}" for i in range(len(label_columns))])]

    # The tasks turn texts into sparse vectors; the driver gets those of the bounded sample.
    def vectors(batches):
        for piece in bytescan.pieces(batches, "text"):
            x = described(piece)
            cut = np.searchsorted(x.row, np.arange(piece.rows + 1))
            yield pa.RecordBatch.from_arrays([
                piece.batch.column(1),
                pa.array([x.slot[cut[r]:cut[r + 1]].astype(np.int16).tobytes() for r in range(piece.rows)], pa.binary()),
                pa.array([x.weight[cut[r]:cut[r + 1]].astype(np.float32).tobytes() for r in range(piece.rows)], pa.binary()),
                pa.array([x.shape[r].tobytes() for r in range(piece.rows)], pa.binary())], ["y", "slot", "weight", "shape"])

    got = sorted(rows.select("text", of.alias("y")).where("y IS NOT NULL").mapInArrow(
        vectors, "y int, slot binary, weight binary, shape binary").collect())
    if not got:
        return fit(Rows(*[np.zeros(0, np.int64)] * 2, np.zeros(0), np.zeros((0, SHAPES)), np.zeros(0)), np.zeros(0, np.int64), len(domains))
    slots = [np.frombuffer(r.slot, np.int16).astype(np.int64) for r in got]
    x = Rows(np.repeat(np.arange(len(got)), [len(s) for s in slots]), np.concatenate(slots),
             np.concatenate([np.frombuffer(r.weight, np.float32) for r in got]).astype(float),
             np.stack([np.frombuffer(r.shape, float) for r in got]), np.zeros(len(got)))
    return fit(x, np.array([r.y for r in got]), len(domains))


def replayed(posterior: np.ndarray, errors: np.ndarray) -> np.ndarray:
    """Rates after the given rounds."""
    rate = np.ones(len(posterior))
    for e in errors:
        rate = np.clip(rate - posterior @ e, 0.0, MOST)
    return rate


def posteriors(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """Add n_tokens and posterior."""
    shipped = docs.sparkSession.sparkContext.broadcast(model.weights)
    raw = without(docs, *ADDED)

    def read(batches):
        held = Classifier(shipped.value)
        for piece in bytescan.pieces(batches, text):
            x = described(piece)
            p = held.posterior(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(piece.rows + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*piece.batch.columns, pa.array(x.tokens, pa.int64()), lists], [*piece.batch.schema.names, "n_tokens", "posterior"])

    rows = raw.select("*", F.lit(0).cast("long").alias("n_tokens"), F.array().cast("array<double>").alias("posterior"))
    return raw.mapInArrow(read, rows.schema)


def totals(rows: DataFrame, errors: np.ndarray, domains: int) -> np.ndarray:
    """Tokens of all rows, then their expected totals by domain after these rounds."""
    shipped = rows.sparkSession.sparkContext.broadcast(errors)

    def add(batches):
        out = np.zeros(domains + 1)
        for batch in batches:
            tokens = batch.column(0).to_numpy().astype(float)
            p = batch.column(1).flatten().to_numpy().reshape(-1, domains)
            out[0] += tokens.sum()
            out[1:] += (tokens * replayed(p, shipped.value)) @ p
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in out], [f"t{i}" for i in range(domains + 1)])

    parts = rows.select("n_tokens", "posterior").mapInArrow(add, ", ".join(f"t{i} double" for i in range(domains + 1)))
    return np.array([v or 0.0 for v in parts.agg(*[F.sum(f"t{i}") for i in range(domains + 1)]).first()])


def overlap(rows: DataFrame, domains: int) -> np.ndarray:
    """Sums over all rows of tokens times posterior times posterior, by pairs of domains."""
    def add(batches):
        out = np.zeros((domains, domains))
        for batch in batches:
            p = batch.column(1).flatten().to_numpy().reshape(-1, domains)
            out += (p * batch.column(0).to_numpy().astype(float)[:, None]).T @ p
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in out.ravel()], [f"t{i}" for i in range(domains ** 2)])

    parts = rows.select("n_tokens", "posterior").mapInArrow(add, ", ".join(f"t{i} double" for i in range(domains ** 2)))
    return np.array([v or 0.0 for v in parts.agg(*[F.sum(f"t{i}") for i in range(domains ** 2)]).first()]).reshape(domains, domains)


def fit_rates(rows: DataFrame, shares: Sequence[float], rounds: int = 40, tolerance: float = 1e-4,
              headroom: float = 1.0) -> np.ndarray:
    """Weighted errors of the rounds. The wanted totals are ``shares`` of a mixture in which the
    domain of the largest share is wanted ``headroom`` times as often as it is there; others
    are wanted in proportion. A domain out of reach of ``MOST`` copies is wanted ``headroom`` times
    as often as it is there, with a warning."""
    target = np.array(shares, float) / sum(shares)
    domains, errors = len(target), np.zeros((0, len(target)))
    start = totals(rows, errors, domains)
    if not start[0]:
        return errors
    there = start[1:] / start[0]
    stated = headroom * there[target.argmax()] / target.max() * target
    wanted = np.where(stated <= MOST * there, stated, np.minimum(stated, headroom * there))
    if (short := np.flatnonzero(wanted < stated)).size:
        warnings.warn("mixing: targets out of reach, as (domain, stated, wanted) in all tokens: " + ", ".join(
            f"({c}, {stated[c]:.4g}, {wanted[c]:.4g})" for c in short), stacklevel=2)
    weight = None
    for k in range(rounds + CLOSING):
        error = totals(rows, errors, domains)[1:] / start[0] - wanted
        if np.abs(error).max() <= tolerance:
            break
        if k < rounds:
            step = np.where(there > 1e-12, error / np.maximum(there, 1e-12), 0.0)
        else:
            # Rows at zero only shorten such a step, so it never overshoots either.
            if weight is None:
                weight = np.linalg.pinv(overlap(rows, domains) / start[0], rcond=1e-6, hermitian=True)
            step = weight @ error
        errors = np.vstack([errors, step])
    return errors


def mix(docs: DataFrame, model: Classifier, shares: Sequence[float], key: str = "doc_id", text: str = "text",
        rounds: int = 40, headroom: float = 1.0, keep_text: bool = False) -> DataFrame:
    """Add n_tokens, posterior, rate, taken and copies; the text stays only if asked for."""
    scratch = Scratch(docs.sparkSession, "mixing")
    scored = posteriors(docs, model, text)
    rows = scratch.keep(scored if keep_text else scored.drop(text), "rows")
    errors = fit_rates(rows, shares, rounds, headroom=headroom)
    shipped = docs.sparkSession.sparkContext.broadcast(errors)
    done = rows.select("*", F.lit(0.0).alias("rate"))

    def rate(batches):
        for batch in batches:
            p = batch.column(batch.schema.get_field_index("posterior")).flatten().to_numpy().reshape(-1, len(shares))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replayed(p, shipped.value))], [*batch.schema.names, "rate"])

    draw = F.pmod(F.xxhash64(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.lit(11)), F.lit(1 << 30)) / F.lit(1 << 30)
    copies = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return rows.mapInArrow(rate, done.schema).withColumn("taken", copies > 0).withColumn("copies", copies)


def drawn(mixed: DataFrame) -> DataFrame:
    """The mixture's rows: each document as often as it has copies."""
    return mixed.where("taken").withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop(*ADDED)
