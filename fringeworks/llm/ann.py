"""Nearest neighbours from randomly rotated one-bit codes.

Unit vectors, padded with zeros to ``CODE_BITS_PER_DIM`` times their dimension,
are rotated by a random orthogonal matrix; the signs are the code, packed to
bits, and the inner product of a vector with its own code is its correction
scalar (RaBitQ, SIGMOD 2024).  A query is rotated alike and its components are
quantised to a few bits, so that its product with a code is a weighted sum of
population counts of packed words.  From that and the correction scalar follow an
unbiased estimate of the cosine and its error bound.

1. Equal vectors form a class, so that a very common vector is coded, estimated and
   compared once.
2. The index holds codes and scalars only, in blocks; each block of queries meets each
   block of codes.  A task keeps, for each of its queries, what may reach the k-th best
   lower bound among all that it has seen.
3. Over all tasks, vectors whose upper bound reaches the k-th best lower bound are
   fetched and compared exactly, in double precision.

Rows between the steps are linear in the queries of a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import counted, drop_scratch, map_batches, materialize

BLOCK_VECTORS, BLOCK_QUERIES = 4096, 512
CODE_BITS_PER_DIM, QUERY_BITS = 8, 4
#: Width of the error bounds in standard deviations of the estimate.
EPSILON = 1.9
_rotations: dict[int, np.ndarray] = {}


def code_bits(dim: int) -> int:
    return -(-dim * CODE_BITS_PER_DIM // 64) * 64


def rotation(dim: int) -> np.ndarray:
    """The first ``dim`` rows of a random orthogonal matrix of the code's size."""
    if dim not in _rotations:
        bits = code_bits(dim)
        q, r = np.linalg.qr(np.random.default_rng(5).standard_normal((bits, bits)))
        _rotations[dim] = np.ascontiguousarray((q * np.sign(np.diag(r)))[:dim])
    return _rotations[dim]


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits as 64-bit words, and correction scalars, of unit vectors."""
    turned = unit @ rotation(unit.shape[1])
    own = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    return np.packbits(turned >= 0, axis=1).view(np.uint64), own


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each query: its bit planes as words (query, plane, word), the least component,
    the step of the quantised components, and their sum."""
    turned = unit @ rotation(unit.shape[1])
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum(turned.max(axis=1, keepdims=True) - low, 1e-12) / ((1 << QUERY_BITS) - 1)
    level = np.rint((turned - low) / step).astype(np.uint8)
    planes = np.stack([np.packbits(level >> j & 1, axis=1).view(np.uint64) for j in range(QUERY_BITS)], axis=1)
    total = (low * turned.shape[1] + step * level.sum(axis=1, keepdims=True))[:, 0]
    return planes, low[:, 0], step[:, 0], total


def estimate(planes: np.ndarray, low: float, step: float, total: float, codes: np.ndarray, ones: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of one query's cosines and their error bounds; ``codes`` is (word, vector),
    ``ones`` the number of set bits of each code."""
    bits = len(codes) * 64
    summed = np.zeros(codes.shape[1], np.uint32)
    for j, plane in enumerate(planes):
        part = np.zeros(codes.shape[1], np.uint32)
        for word, wanted in zip(codes, plane, strict=True):
            part += np.bitwise_count(word & wanted)
        summed += part << np.uint32(j)
    raw = (2 * (low * ones + step * summed) - total) / np.sqrt(bits)
    spread = np.sqrt(np.maximum(1 - own * own, 0) / (bits - 1) + step * step / 12)
    return raw / own, EPSILON * spread / own


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dim, digest, vector, code, own) of the vectors that take part."""
    for b in batches:
        by: dict[int, tuple[list, list]] = {}
        for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if i is None or not v or any(x is None for x in v):
                continue
            a = np.array(v, dtype=np.float64) + 0.0
            if np.isfinite(a).all() and np.any(a):
                ids, rows = by.setdefault(len(a), ([], []))
                ids.append(i)
                rows.append(a)
        for dim, (ids, rows) in by.items():
            m = np.stack(rows)
            # Scaled first, so that no norm over- or underflows.
            scaled = m / np.abs(m).max(axis=1, keepdims=True)
            codes, own = encode(scaled / np.linalg.norm(scaled, axis=1, keepdims=True))
            raw = [x.tobytes() for x in m]
            columns = [pa.array(ids, pa.int64()), pa.array(np.full(len(ids), dim), pa.int32()), pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary()), pa.array(raw, pa.binary()), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(own)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "dim", "digest", "vector", "code", "own"])


USABLE = "id long, dim int, digest binary, vector binary, code binary, own double"


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """One row for up to ``size`` rows (dim, id, payload, own) of one dimension."""
    held: dict[int, list] = {}

    def row(dim: int, rows: list) -> pa.RecordBatch:
        ids, payloads, own = zip(*rows, strict=True)
        parts = (np.array(ids, np.int64).tobytes(), b"".join(payloads), np.array(own).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *[pa.array([x], pa.binary()) for x in parts]], ["dim", "ids", "payload", "own"])

    for b in batches:
        for dim, *rest in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            rows = held.setdefault(dim, [])
            rows.append(rest)
            if len(rows) == size:
                yield row(dim, rows)
                rows.clear()
    for dim, rows in held.items():
        if rows:
            yield row(dim, rows)


BLOCK = "dim int, ids binary, payload binary, own binary"


def _reach(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(query, id, low, high) of what may be among a query's ``k`` nearest of this task."""
    best: dict[int, np.ndarray] = {}
    found: dict[int, list] = {}
    ready: dict[bytes, tuple] = {}
    for b in batches:
        for r in b.to_pylist():
            dim, ids = r["dim"], np.frombuffer(r["ids"], np.int64)
            codes = np.ascontiguousarray(np.frombuffer(r["payload"], np.uint64).reshape(len(ids), -1).T)
            own, ones = np.frombuffer(r["own"]), np.bitwise_count(codes).sum(axis=0, dtype=np.int64)
            if r["q_ids"] not in ready:
                ready.clear()
                q = np.frombuffer(r["q_payload"]).reshape(-1, dim)
                q = q / np.abs(q).max(axis=1, keepdims=True)
                ready[r["q_ids"]] = (np.frombuffer(r["q_ids"], np.int64).tolist(), *quantise(q / np.linalg.norm(q, axis=1, keepdims=True)))
            for qid, planes, least, step, total in zip(*ready[r["q_ids"]], strict=True):
                guess, bound = estimate(planes, least, step, total, codes, ones, own)
                low = guess - bound
                top = np.concatenate([best.get(qid, np.zeros(0)), np.partition(low, -k)[-k:] if len(low) > k else low])
                best[qid] = top = np.sort(top)[-k:]
                near = np.flatnonzero(guess + bound >= (top[0] if len(top) == k else -np.inf))
                found.setdefault(qid, []).append(np.stack([ids[near].view(np.float64), low[near], (guess + bound)[near]]))
    for qid, parts in found.items():
        ids, low, high = np.concatenate(parts, axis=1)
        keep = high >= best[qid][0] if len(best[qid]) == k else np.ones(len(low), bool)
        n = int(keep.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, qid)), pa.array(np.ascontiguousarray(ids[keep]).view(np.int64)), pa.array(low[keep]), pa.array(high[keep])], ["query", "id", "low", "high"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        scores = np.zeros(b.num_rows)
        for i, (v, q) in enumerate(zip(b.column("vector"), b.column("q_vector"), strict=True)):
            x, y = np.frombuffer(v.as_buffer()), np.frombuffer(q.as_buffer())
            scores[i] = (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))
        yield pa.RecordBatch.from_arrays([b.column("query"), b.column("class"), b.column("id"), pa.array(scores)], ["query", "class", "id", "score"])


def _classes(rows: DataFrame, label: str, members: int | None) -> tuple[DataFrame, DataFrame, int]:
    """Stored classes of equal vectors (class, id, dim, vector, code, own), id the least of
    the class; (class, id) of the ``members`` least ids of each, or of all; and the number of
    classes."""
    coded = materialize(map_batches(rows, _usable, USABLE), f"ann-{label}")
    least = coded.groupBy("digest").agg(F.min("id").alias("id"))
    first = coded.join(least.hint("merge"), ["digest", "id"], "left_semi").dropDuplicates(["digest"])
    # Stored, so the numbers stay.
    first, n = counted(first.withColumn("class", F.monotonically_increasing_id()), f"ann-{label}-classes")
    ids = coded.select("digest", "id").distinct()
    if members is not None:
        ids = ids.withColumn("place", F.row_number().over(Window.partitionBy("digest").orderBy("id"))).filter(F.col("place") <= members)
    ids = materialize(ids.join(first.select("digest", "class").hint("merge"), "digest").select("class", "id"), f"ann-{label}-ids")
    drop_scratch(coded)
    return first.drop("digest"), ids, n


def _block_table(classes: DataFrame, payload: str, size: int, n: int) -> DataFrame:
    """Blocks of ``size`` classes, as full as their number allows."""
    rows = classes.select("dim", F.col("class").alias("id"), F.col(payload).alias("payload"), "own").repartition(max(1, -(-n // size)))
    return map_batches(rows, lambda it: _blocks(it, size), BLOCK)


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest by cosine in
    double precision, ties to the smaller id; all candidates where fewer.

    A query's candidates are the rows with another id and as many components.
    Null or zero vectors, and vectors with a null or non-finite component, take
    no part, nor do rows without an id.  A query without any candidate has no
    row.  Rows that repeat an id with its vector count once; an id with two vectors is
    two candidates and two queries, whose rows stand under that one id.  Empty tables give
    an empty result; columns besides the two named are not read.
    """
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    # Of a class only its k + 1 least ids can be among a query's k nearest.
    base, members, n = _classes(pick(vectors), "vectors", k + 1)
    asked, askers, n_asked = _classes(pick(queries), "queries", None)
    groups = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BLOCK_VECTORS)))
    index = materialize(_block_table(base, "code", BLOCK_VECTORS, n).withColumn("group", F.spark_partition_id() % groups), "ann-index")
    blocks = _block_table(asked, "vector", BLOCK_QUERIES, n_asked).select("dim", F.col("ids").alias("q_ids"), F.col("payload").alias("q_payload"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    met = index.join(blocks.hint("merge"), ["group", "dim"]).select("dim", "ids", "payload", "own", "q_ids", "q_payload")
    # One class more than asked for, since one may be the query's own.
    most = k + 1
    reach = map_batches(met, lambda it: _reach(it, most), "query long, id long, low double, high double")
    order = Window.partitionBy("query").orderBy(F.desc("low"), "id")
    bar = F.nth_value("low", most).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = reach.withColumn("bar", bar).filter(F.coalesce(F.col("high") >= F.col("bar"), F.lit(True))).select("query", F.col("id").alias("class"))
    to = asked.select(F.col("class").alias("query"), F.col("vector").alias("q_vector")).hint("merge")
    pairs = near.join(to, "query").join(base.select("class", "id", "vector").hint("merge"), "class")
    exact = map_batches(pairs.select("query", "class", "id", "vector", "q_vector"), _exact, "query long, class long, id long, score double")
    nearest = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    found = materialize(exact.withColumn("place", nearest).filter(F.col("place") <= most).select(F.col("query").alias("class"), F.col("class").alias("near"), "score"), "ann-found")
    drop_scratch(base, asked, index)
    each = askers.withColumnRenamed("id", "query_id").join(found.hint("merge"), "class").drop("class")
    each = each.join(members.select(F.col("class").alias("near"), F.col("id").alias("vec_id")).hint("merge"), "near").filter("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
