"""Toxicity by cumulative-link ordinal regression.

P(grade <= k) = s(theta_k - w.x) with one weight vector for all thresholds; x are
densities of words and of word beginnings.  Grades are 0 for clean texts and 1
to 3 for toxic ones: the labels tell only toxic from clean, so the thirds of
the toxic sample by density of indicative features give the order within.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sampling, textvec
from .common import drop_scratch, in_one_task, map_batches, pack_row, row_texts, unpack_row

#: Lengths in bytes of word beginnings; 0 is the whole word.
LENGTHS = (0, 4, 5, 6, 7, 8, 10)
HASH_BITS = 22
FEATURES = 4096
#: Bounds on the labelled rows that the model is fitted on.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 3000
GRADES = 3
#: Densities are per this many words, and texts count as having this many at least.
PER_WORDS = 30.0

_STRIP = np.zeros(256, dtype=bool)
_STRIP[:128] = True
_STRIP[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def slots(text: str) -> tuple[np.ndarray, int]:
    """Hashed feature numbers, one per occurrence, and the number of words; case is
    folded."""
    h, kind, n = textvec.prefix_hashes(np.frombuffer(text.lower().encode(), dtype=np.uint8), LENGTHS, _STRIP)
    h = textvec.mix(h + (kind.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return (h >> np.uint64(64 - HASH_BITS)).astype(np.int64), n


@dataclass
class OrdinalModel:
    slots: np.ndarray
    weights: np.ndarray
    theta: np.ndarray
    cut: float = 0.5

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0, 1, ..."""
        return 1 / (1 + np.exp(np.clip(self.theta[None, :] - score[:, None], -60, 60)))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, steps: int = 400, ridge: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the cumulative-link likelihood.
    The gaps between thresholds are exponentials, so their order holds."""
    n, k = x.shape[1], int(GRADES)
    ridge = 0.03 / len(x) if ridge is None else ridge
    params = np.zeros(n + k)
    params[n] = 1.0
    m, v = np.zeros_like(params), np.zeros_like(params)
    sample = weight / weight.sum()
    for t in range(1, steps + 1):
        w = params[:n].astype(np.float32)
        gaps = np.exp(params[n + 1 :])
        theta = params[n] + np.concatenate([[0.0], np.cumsum(gaps)])
        eta = (x @ w).astype(np.float64)
        above = 1 / (1 + np.exp(np.clip(theta[None, :] - eta[:, None], -40, 40)))
        edge = np.concatenate([np.ones((len(x), 1)), above, np.zeros((len(x), 1))], axis=1)
        p = np.maximum(np.take_along_axis(edge, grade[:, None], 1) - np.take_along_axis(edge, grade[:, None] + 1, 1), 1e-12)[:, 0]
        slope = above * (1 - above)
        # P(grade) = above[grade-1] - above[grade]; d above / d eta = slope.
        upper = np.where(np.arange(k)[None, :] == grade[:, None] - 1, slope, 0)
        lower = np.where(np.arange(k)[None, :] == grade[:, None], slope, 0)
        d_eta = -(upper - lower).sum(axis=1) / p * sample
        d_theta = (((upper - lower) / p[:, None]) * sample[:, None]).sum(axis=0)
        g = np.empty_like(params)
        g[:n] = x.T @ d_eta.astype(np.float32) + ridge * w
        tail = np.cumsum(d_theta[::-1])[::-1]
        g[n] = tail[0]
        g[n + 1 :] = tail[1:] * gaps
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params -= 0.1 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-8)
    theta = params[n] + np.concatenate([[0.0], np.cumsum(np.exp(params[n + 1 :]))])
    return params[:n].astype(np.float32), theta


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        toxic = b.column("toxic").to_numpy(zero_copy_only=False)
        found = [np.unique(slots(t)[0]) for t in b.column("text").to_pylist()]
        for want in (0, 1):
            mine = [f for f, y in zip(found, toxic, strict=True) if y == want]
            if mine:
                s, n = np.unique(np.concatenate(mine), return_counts=True)
                out.append((s, n * (want == 1), n * (want == 0)))
        for s, pos, neg in out:
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(pos, pa.int64()), pa.array(neg, pa.int64())], ["slot", "pos", "neg"])


def _densities(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        xs = []
        for t in b.column("text").to_pylist():
            s, n = slots(t)
            at = np.minimum(np.searchsorted(wanted, s), len(wanted) - 1)
            hit = at[wanted[at] == s]
            x = np.bincount(hit, minlength=len(wanted)) * (PER_WORDS / max(n, PER_WORDS))
            xs.append(x.astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("h"), pa.array(xs, pa.binary())], ["toxic", "h", "x"])


def _fit(batches: Iterator[pa.RecordBatch], wanted: np.ndarray, odds: np.ndarray, rows: int, prior: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Weights and thresholds in one row, from (toxic, x)."""
    x, known = np.empty((rows, len(wanted)), dtype=np.float32), []
    for b in batches:
        for y, raw in zip(b.column("toxic").to_pylist(), b.column("x"), strict=True):
            x[len(known)] = np.frombuffer(raw.as_buffer(), dtype=np.float16)
            known.append(y)
    x, toxic = x[: len(known)], np.array(known)
    lexical = x @ np.where(odds > 1.0, odds, 0).astype(np.float32)
    cuts = np.quantile(lexical[toxic == 1], [i / GRADES for i in range(1, GRADES)])
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, lexical, side="right"), 0)
    weight = np.where(toxic == 1, prior[1] / max((toxic == 1).sum(), 1), prior[0] / max((toxic == 0).sum(), 1))
    w, theta = fit_ordinal(x, grade, weight)
    yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([theta.tobytes()], pa.binary())], ["weights", "theta"])


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = SAMPLE_TOXIC, clean_rows: int = SAMPLE_CLEAN) -> OrdinalModel | None:
    """Fit on at most ``toxic_rows`` + ``clean_rows`` distinct labelled texts of both
    kinds, drawn by a hash of the text.  None where either kind is missing.

    The features are chosen by grouped counts over the sample; the fit runs in one task
    of an executor, on the sample alone, and only the weights come back.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    labelled = texts.select("doc_id", sampling.text_hash().alias("h")).join(known, "doc_id").select("label", "h")
    bound = toxic_rows + clean_rows
    drawn, counts = sampling.draw(labelled, texts.select("text"), 2 * max(toxic_rows, clean_rows), 1, "toxicity")
    try:
        if len(counts) < 2:
            return None
        order = Window.partitionBy("label").orderBy(F.xxhash64("h"), "h")
        most = F.when(F.col("label") == 1, toxic_rows).otherwise(clean_rows)
        sample = drawn.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select(F.col("label").alias("toxic"), "h", "text")
        n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
        seen = map_batches(sample.select("toxic", "text"), _presence, "slot long, pos long, neg long").groupBy("slot").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        p, q, both = F.col("pos") / n[1], F.col("neg") / n[0], (F.col("pos") + F.col("neg")) / (n[0] + n[1])
        chi = (p - q) * (p - q) / (both * (1 - both) + 1e-3)
        best = seen.filter("pos + neg >= 3").select("slot", p.alias("p"), q.alias("q"), chi.alias("chi")).orderBy(F.desc("chi"), "slot").limit(FEATURES).collect()
        if not best:
            return None
        best = sorted(best, key=lambda r: r["slot"])
        wanted = np.array([r["slot"] for r in best])
        odds = np.log((np.array([r["p"] for r in best]) + 0.01) / (np.array([r["q"] for r in best]) + 0.01))
        x = map_batches(sample, lambda it: _densities(it, wanted), "toxic int, h long, x binary")
        r = in_one_task(x, lambda it: _fit(it, wanted, odds, bound, (counts[0], counts[1])), "weights binary, theta binary", "toxic", "h").first()
        return OrdinalModel(wanted, np.frombuffer(bytes(r["weights"]), np.float32), np.frombuffer(bytes(r["theta"])))
    finally:
        drop_scratch(drawn)


def _grade(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model: OrdinalModel = shared.value
    table = np.zeros(1 << HASH_BITS, dtype=np.float32)
    if model is not None:
        table[model.slots] = model.weights
    for b in batches:
        scores = []
        for t in row_texts(b):
            s, n = slots(t or "")
            scores.append(float(table[s].sum(dtype=np.float64)) * PER_WORDS / max(n, PER_WORDS))
        if model is None:
            above = np.zeros((len(scores), GRADES))
        else:
            above = model.above(np.array(scores, dtype=np.float64))
        grades = (above >= 0.5).sum(axis=1)
        cut = 0.5 if model is None else model.cut
        yield pa.RecordBatch.from_arrays(
            [b.column("row"), pa.array(above.sum(axis=1), pa.float64()), pa.array(grades, pa.int32()), pa.array(above[:, 0], pa.float64()), pa.array(above[:, 0] >= cut)],
            ["row", "severity", "grade", "p_toxic", "toxic"],
        )


def grade(docs: DataFrame, model: OrdinalModel | None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with severity (expected grade), grade (median), p_toxic
    and toxic.

    What the grades mean: the labels tell only toxic from clean, so grades 1 to 3 are
    thirds of the toxic sample by density of the very features that the model is fitted
    on.  Within toxic texts severity therefore says how dense indicative words are; it
    is no outside judgement of harm.  That toxic is told from clean is tested on rows
    held out.

    Null text counts as empty; a text without words scores 0.  Without a model
    (no labels of both kinds) nothing is toxic.  Repeated rows and null ids pass
    through; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = pack_row(docs, keep, text_col)
    kind = packed.schema["row"].dataType.simpleString()
    out = map_batches(packed, lambda it: _grade(it, shared), f"row {kind}, severity double, grade int, p_toxic double, toxic boolean")
    return unpack_row(out, keep, text_col, "severity", "grade", "p_toxic", "toxic")
