"""Packing along a space-filling curve.

1. Each text is encoded once; its words, hashed into ``BUCKETS`` signed buckets,
   give a vector that a fixed Gaussian matrix projects to ``DIMS`` coordinates.
   The Hilbert key of the quantised coordinates, the length and the ids (two
   bytes each where the vocabulary allows) are written to a shared table.
2. The narrow columns alone are range-sorted by (key, doc_id, row); running sums
   within each range plus one total per range give every text its place on
   the curve, counted in tokens.  Ties, such as a large group of copies with one
   key, are spread by the later sort columns.
3. Places join the ids by row; the token stream is cut every ``length`` tokens.
   Only the last sequence is shorter.

The ids cross the network once.  No window or task sees more than its range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks, textvec
from .common import map_batches, materialize, text_column, worker_state
from .wordtable import WordTable

BUCKETS, DIMS, BITS = 256, 4, 10
LENGTH = 4096
#: Bounds of a worker's table of pre-tokens and of its cache of other chunks.
TABLE_ENTRIES, CACHE_ENTRIES = 1_200_000, 200_000
#: Texts encoded at a time.
GROUP = 256


def hilbert(coords: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of unsigned coordinates below 2**bits, by
    Skilling's transposed form (AIP Conf. Proc. 707, 2004), all rows at once."""
    x = [coords[:, i].astype(np.int64) for i in range(coords.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x = [c ^ t for c in x]
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | ((c >> b) & 1)
    return key


def curve_keys(texts: list[str]) -> np.ndarray:
    """The Hilbert key of each text's hashed word vector; no word gives the
    centre's key."""
    coded = [t.encode() for t in texts]
    starts = np.cumsum([0, *(len(c) + 1 for c in coded)])
    vectors = np.zeros(len(texts) * BUCKETS)
    joined = np.frombuffer(b"\n".join(coded), dtype=np.uint8)
    for at, block in textvec.blocks(joined):
        s, _, h, _ = textvec._scan(block)
        doc = np.searchsorted(starts, s + at, side="right") - 1
        slot = doc * BUCKETS + (h & np.uint64(BUCKETS - 1)).astype(np.int64)
        sign = 1.0 - 2.0 * ((h >> np.uint64(32)) & np.uint64(1)).astype(np.float64)
        if len(slot):
            low = int(slot[0]) // BUCKETS * BUCKETS
            part = np.bincount(slot - low, weights=sign)
            vectors[low : low + len(part)] += part
    v = vectors.reshape(len(texts), BUCKETS)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    v = v / np.where(norm > 0, norm, 1)
    gauss = np.random.default_rng(7).standard_normal((BUCKETS, DIMS))
    squashed = 0.5 + np.arctan(v @ gauss) / np.pi
    top = (1 << BITS) - 1
    return hilbert(np.minimum((squashed * (top + 1)).astype(np.int64), top), BITS)


def latin(text: str) -> bool:
    """Only Latin-1 characters and no apostrophe."""
    if "'" in text:
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class IdEncoder:
    """Ids of texts as bytes of 16 or 32 bits each, without special tokens."""

    def __init__(self, path: str):
        self.tok = chunks.load_tokenizer(path)
        self.kind = np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32
        self.special = chunks.special_strings(self.tok)
        self.ends = np.zeros(self.tok.get_vocab_size(), dtype=bool)
        for piece, i in self.tok.get_vocab(with_added_tokens=False).items():
            self.ends[i] = piece.endswith("</w>")
        self.table = WordTable(self.encode_words, self.kind, entries=TABLE_ENTRIES)
        self.cache = chunks.ChunkCache(self.each, entries=CACHE_ENTRIES)

    def each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Pre-tokens go to the library as one text; the ids are parted at word ends.
        For Latin-1 text without apostrophes folding case by character is what the
        tokenizer does, and each run of letters, each numeral and each run of other
        characters is one pre-token."""
        out: list[bytes] = []
        for i in range(0, len(words), 1000):
            part = words[i : i + 1000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                raw, edges = ids.tobytes(), [0, *(cuts * ids.itemsize).tolist()]
                out += [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]
            else:
                out += self.each(part)
        return out

    def texts(self, texts: list[str]) -> list[bytes]:
        """Texts of Latin-1 characters by the table, others by white-space chunks,
        and those of which neither is certain by the library, whole."""
        out: list[bytes] = [b""] * len(texts)
        for i in range(0, len(texts), GROUP):
            plain, cut = [], []
            for j in range(i, min(i + GROUP, len(texts))):
                t = texts[j]
                if chunks.unsure(t) or (self.special and self.special.search(t)):
                    out[j] = self.each([t])[0]
                elif latin(t):
                    plain.append(j)
                else:
                    cut.append(j)
            for j, x in zip(plain, self.table.ids([texts[j].lower().encode("latin-1") for j in plain]), strict=True):
                out[j] = x
            for j, v in zip(cut, self.cache.many([texts[j].split() for j in cut]), strict=True):
                out[j] = b"".join(v)
        return out


def _encoder(path: str) -> IdEncoder:
    return worker_state(("packing", path), lambda: IdEncoder(path))


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    coder = _encoder(path)
    end = np.array([end_id], dtype=coder.kind).tobytes()
    for b in batches:
        texts = b.column("text").to_pylist()
        out = [x + end for x in coder.texts(texts)]
        n = [len(x) // coder.kind().itemsize for x in out]
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(curve_keys(texts), pa.int64()), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["row", "doc_id", "key", "n", "ids"])


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.column("n").to_numpy()
        end = at + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.full(len(n), part), pa.int32()), pa.array(end - n, pa.int64()), pa.array(end, pa.int64())], ["row", "part", "begin", "done"])
        at = int(end[-1]) if len(end) else at


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        doc, start, size, total, seq, off, ids = [], [], [], [], [], [], []
        for d, place, n, raw in zip(b.column("doc_id").to_pylist(), b.column("place").to_pylist(), b.column("n").to_pylist(), b.column("ids"), strict=True):
            x = np.frombuffer(raw.as_buffer(), dtype=f"<u{len(raw.as_buffer()) // n}")
            at = 0
            while at < len(x):
                s, o = divmod(place + at, length)
                k = min(length - o, len(x) - at)
                doc.append(d)
                start.append(at)
                size.append(k)
                total.append(len(x))
                seq.append(s)
                off.append(o)
                ids.append(x[at : at + k].astype("<u4").tobytes())
                at += k
        arrays = [pa.array(v, pa.int64()) for v in (doc, start, size, total, seq, off)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(ids, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "token_ids"])


PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, token_ids binary"


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of sequences of ``length`` tokens: (doc_id, start, length,
    doc_tokens, sequence_id, offset, token_ids as little-endian unsigned 32-bit).

    Null or empty text is the end id alone.  Rows are told apart by position, so
    repeated rows and ids, and null ids, are each packed once per row.  An empty
    table gives no piece.  Columns besides the two named are not read.
    """
    spark = docs.sparkSession
    picked = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text"))
    coded = materialize(map_batches(picked, lambda it: _encode(it, tokenizer_path, end_id), "row long, doc_id long, key long, n long, ids binary", ("packing", tokenizer_path)), "pack-ids")
    curve = coded.select("key", "doc_id", "row", "n").repartitionByRange("key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row")
    placed = materialize(map_batches(curve, _running, "row long, part int, begin long, done long"), "pack-places")
    # One row per range: as many as shuffle partitions, whatever the input.
    totals = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.max("done").alias("n")).collect())
    bases, at = [], 0
    for part, n in totals:
        bases.append((part, at))
        at += n
    base = spark.createDataFrame(bases, "part int, base long")
    places = placed.join(F.broadcast(base), "part").select("row", (F.col("begin") + F.col("base")).alias("place"))
    joined = coded.select("row", "doc_id", "n", "ids").join(places.hint("shuffle_hash"), "row").select("doc_id", "place", "n", "ids")
    return map_batches(joined, lambda it: _cut(it, length), PIECES)
