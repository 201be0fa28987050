"""Language identification by error-correcting output codes.

Each language has a codeword; one binary n-gram classifier per bit predicts that
bit; the codeword with the least loss-weighted distance to the predictions wins,
and a small margin to the next flags the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling
from .common import drop_scratch, in_one_task, map_batches, pack_row, row_texts, unpack_row

TRIGRAM_BITS = 12
DIMS = 256 + (1 << TRIGRAM_BITS)
#: Bound on the texts that the classifiers are fitted on, all languages together, and
#: what each language gets at least where there are very many.
SAMPLE_ROWS = 2400
SAMPLE_LEAST = 8
WINDOW = 60
#: Margins of posterior probability below this are flagged.
AMBIGUOUS = 0.05

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(raw: bytes) -> np.ndarray:
    """Square roots of the shares of letters and of hashed trigrams, each group
    of unit length; runs of other ASCII characters count as one blank."""
    b = _FOLD[np.frombuffer(raw, dtype=np.uint8)]
    if len(b):
        b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]
    b = np.concatenate([[np.uint8(32)], b, [np.uint8(32)]])
    one = np.bincount(b, minlength=256).astype(np.float32)
    one[32] = 0
    w = b.astype(np.uint32)
    code = (w[:-2] << np.uint32(16) | w[1:-1] << np.uint32(8) | w[2:]) * np.uint32(2654435761)
    three = np.bincount(code >> np.uint32(32 - TRIGRAM_BITS), minlength=1 << TRIGRAM_BITS).astype(np.float32)
    return np.concatenate([np.sqrt(one / max(one.sum(), 1)), np.sqrt(three / max(three.sum(), 1))])


def codewords(n: int) -> np.ndarray:
    """(n, bits) of -1 and 1: all distinct splits up to five languages, beyond
    that the best of many random codes by least distance between rows."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        splits = np.arange(1, 1 << (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, -1.0, 1.0)
    rng = np.random.default_rng(3)
    bits = max(15, int(np.ceil(10 * np.log2(n))))
    best, least = None, -1.0
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], size=(n, bits))
        apart = (bits - m @ m.T) / 2 + np.eye(n) * bits
        if (np.abs(m.sum(axis=0)) < n).all() and apart.min() > least:
            best, least = m, apart.min()
    return best


@dataclass
class LanguageModel:
    langs: list[str] = field(default_factory=list)
    code: np.ndarray = field(default_factory=lambda: np.ones((0, 1)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((DIMS, 1), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    #: How far each bit's classifier is to be trusted for each language.
    trust: np.ndarray = field(default_factory=lambda: np.ones((0, 1)))

    def posterior(self, x: np.ndarray) -> np.ndarray:
        f = x @ self.weights + self.bias
        loss = np.logaddexp(0, -self.code[None, :, :] * f[:, None, :])
        total = (self.trust[None] * loss).sum(axis=2)
        p = np.exp(total.min(axis=1, keepdims=True) - total)
        return p / p.sum(axis=1, keepdims=True)


def fit_codes(x: np.ndarray, y: np.ndarray, langs: list[str], steps: int = 120) -> LanguageModel:
    """One logistic classifier per bit, all at once, by Adam on the full sample."""
    code = codewords(len(langs))
    target = (code[y] > 0).astype(np.float32)
    share = np.bincount(y, minlength=len(langs))
    weight = (len(y) / (len(langs) * np.maximum(share, 1)))[y].astype(np.float32)[:, None] / len(y)
    w, bias = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(bias), np.zeros_like(bias)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(x @ w + bias)))
        err = (p - target) * weight
        gw, gb = x.T @ err + 1e-5 * w, err.sum(axis=0)
        mw, mb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb
        vw, vb = 0.99 * vw + 0.01 * gw * gw, 0.99 * vb + 0.01 * gb * gb
        fix = np.sqrt(1 - 0.99**t) / (1 - 0.9**t) * 0.3
        w -= (fix * mw / (np.sqrt(vw) + 1e-7)).astype(np.float32)
        bias -= (fix * mb / (np.sqrt(vb) + 1e-7)).astype(np.float32)
    right = np.sign(x @ w + bias) == np.sign(target - 0.5)
    trust = np.array([right[y == k].mean(axis=0) if (y == k).any() else np.ones(code.shape[1]) for k in range(len(langs))])
    trust = trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9) * code.shape[1]
    return LanguageModel(langs, code, w, bias, trust)


def _fit(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The whole model in one row.  Each text is learnt whole and by a short window of
    it, so that short texts are learnt too."""
    names: list[str] = []
    x = np.empty((2 * rows, DIMS), dtype=np.float32)
    for b in batches:
        for lang, text in zip(b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True):
            raw = text.lower().encode()
            at = (len(raw) - WINDOW) // 2
            for part in (raw, raw[max(at, 0) : max(at, 0) + WINDOW]):
                x[len(names)] = grams(part)
                names.append(lang)
    langs = sorted(set(names))
    m = fit_codes(x[: len(names)], np.array([langs.index(n) for n in names]), langs) if names else LanguageModel()
    del x
    parts = [pa.array([a.tobytes()], pa.binary()) for a in (m.code, m.weights, m.bias, m.trust)]
    yield pa.RecordBatch.from_arrays([pa.array([m.langs], pa.list_(pa.string())), *parts], ["langs", "code", "weights", "bias", "trust"])


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on at most ``sample_rows`` distinct texts with a language (SAMPLE_LEAST of each
    language where that is more), as many of each as possible.

    Copies of a text count once, and the sample is drawn by a hash of the text, so
    neither a large group of copies nor the order of rows or partitions changes the
    model.  No such text gives a model without languages.  The fit runs in one task of
    an executor, on the sample alone; only the weights come back.
    """
    rows = docs.filter("text is not null and lang is not null").select(F.col("lang").alias("label"), "text")
    sample, counts = sampling.draw(rows.select("label", sampling.text_hash().alias("h")), rows.select("text"), sample_rows, SAMPLE_LEAST, "language")
    if not counts:
        drop_scratch(sample)
        return LanguageModel()
    bound = max(sample_rows, SAMPLE_LEAST * len(counts))
    r = in_one_task(sample, lambda it: _fit(it, bound), "langs array<string>, code binary, weights binary, bias binary, trust binary", "label", "h").first()
    drop_scratch(sample)
    n = len(r["langs"])
    array = lambda name, kind, *shape: np.frombuffer(bytes(r[name]), dtype=kind).reshape(shape)
    return LanguageModel(list(r["langs"]), array("code", np.float64, n, -1), array("weights", np.float32, DIMS, -1), array("bias", np.float32, -1), array("trust", np.float64, n, -1))


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m: LanguageModel = model.value
    for b in batches:
        preds, scores, unsure = [], [], []
        texts = row_texts(b)
        for i in range(0, len(texts), 256):
            part = texts[i : i + 256]
            known = [t is not None and bool(m.langs) and any(map(str.isalpha, t)) for t in part]
            x = np.zeros((len(part), DIMS), dtype=np.float32)
            for j, t in enumerate(part):
                if known[j]:
                    x[j] = grams(t.lower().encode())
            p = m.posterior(x) if m.langs else np.zeros((len(part), 1))
            best = p.argmax(axis=1)
            top = np.sort(p, axis=1)
            margin = top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)
            for j, k in enumerate(known):
                preds.append(m.langs[best[j]] if k else "und")
                scores.append(float(top[j, -1]) if k else 0.0)
                unsure.append(bool(margin[j] < AMBIGUOUS) if k else True)
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(preds), pa.array(scores, pa.float64()), pa.array(unsure)], ["row", "lang_pred", "score", "ambiguous"])


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred, score (posterior of the codeword, 0 to
    1) and ambiguous, from the whole text alone.

    Null text and text without a letter give `und` with score 0, and so does
    every text where the model knows no language.  Where two languages are equally
    near, the one first by name wins, and the text is ambiguous.  Repeated rows and
    null ids pass through; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = pack_row(docs, keep, text_col)
    kind = packed.schema["row"].dataType.simpleString()
    out = map_batches(packed, lambda it: _predict(it, shared), f"row {kind}, lang_pred string, score double, ambiguous boolean")
    return unpack_row(out, keep, text_col, "lang_pred", "score", "ambiguous")


def held_out(doc_id: str = "doc_id"):
    """Rows whose crc32 of the id as text leaves no rest by 5 are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
