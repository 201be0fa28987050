"""Token counts by a two-tier lookup on the map side.

1. One pass over every text gives each task's most frequent chunks (runs of
   pre-tokens).  These summaries go straight to the driver, which adds them up: all
   tasks' together hold SUMMARY_ENTRIES, or LEAST_ENTRIES a task where that is more.
   The ``table_entries`` heaviest chunks with their token counts are broadcast as one
   block of text and two arrays.
2. The counting pass looks each chunk up in the table, then in the worker's own
   bounded cache, and encodes what neither has.  No pre-token is shuffled.

The table only saves time: a count never depends on what is in it.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from .common import map_batches, text_column, worker_state

#: A blank belongs to the word after it; other white space stands alone; a word
#: before a stop is cut off.  Each boundary of this cut is a boundary between
#: pre-tokens.
CUT = re.compile(r" ?[^\W\d_]+(?=[.,!?;:\s]|\Z)| ?\S+|\s+(?!\S)|\s+")
TABLE_ENTRIES = 1 << 15
SUMMARY_ENTRIES, LEAST_ENTRIES = 1 << 17, 64
#: A task's counter is cut back to its heavier half beyond this many chunks.
COUNTER_ENTRIES = 1 << 17


def _frequent_of_task(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            seen.update(CUT.findall(text))
            if len(seen) > COUNTER_ENTRIES:
                seen = Counter(dict(seen.most_common(COUNTER_ENTRIES // 2)))
    best = [(c, n) for c, n in seen.most_common(top) if n > 1 and len(c) <= chunks.MAX_KEY]
    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["chunk", "n"])


def frequent_chunks(texts: DataFrame, table_entries: int = TABLE_ENTRIES) -> list[str]:
    """At most ``table_entries`` chunks, most frequent first, from every text."""
    each = max(LEAST_ENTRIES, min(table_entries, SUMMARY_ENTRIES // max(1, texts.rdd.getNumPartitions())))
    found = map_batches(texts, lambda it: _frequent_of_task(it, each), "chunk string, n long").toArrow()
    sums: Counter = Counter()
    for b in found.to_batches(max_chunksize=1 << 14):
        for c, n in zip(b.column("chunk").to_pylist(), b.column("n").to_pylist(), strict=True):
            sums[c] += n
    return [c for c, _ in sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:table_entries]]


class FrequentTable:
    """Chunks with their numbers of tokens: one block of UTF-8 and two arrays."""

    def __init__(self, names: list[str], counts: list[int]):
        coded = [c.encode() for c in names]
        self.text = b"".join(coded)
        self.ends = np.cumsum([len(c) for c in coded], dtype=np.uint32)
        self.counts = np.array(counts, dtype=np.uint16)

    def as_dict(self) -> dict[str, int]:
        ends = self.ends.tolist()
        return {self.text[a:b].decode(): n for a, b, n in zip([0, *ends], ends, self.counts.tolist(), strict=False)}


def _build(path: str, table) -> tuple:
    tok = chunks.load_tokenizer(path)

    def encode(xs: list[str]) -> list[int]:
        return [len(e) for e in tok.encode_batch_fast(xs, add_special_tokens=False)]

    return tok, chunks.special_strings(tok), chunks.ChunkCache(encode, table.value.as_dict())


def _count(batches: Iterator[pa.RecordBatch], path: str, table, key: tuple) -> Iterator[pa.RecordBatch]:
    tok, special, cache = worker_state(key, lambda: _build(path, table))
    for b in batches:
        counts, sizes = [], []
        for text in b.column("text").to_pylist():
            sizes.append(len(text.encode()))
            if chunks.unsure(text) or (special and special.search(text)):
                counts.append(len(tok.encode(text, add_special_tokens=False)))
            else:
                counts.append(sum(cache.values(CUT.findall(text))))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", table_entries: int = TABLE_ENTRIES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of ``docs``.

    Null text counts as empty: 0 bytes, 0 tokens.  A null id stays null, repeated
    rows give repeated results, an empty table an empty result; other columns of
    ``docs`` are not read, whatever their names.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text"))
    names = frequent_chunks(picked.select("text"), table_entries)
    tok = chunks.load_tokenizer(tokenizer_path)
    lengths = [len(e) for e in tok.encode_batch_fast(names, add_special_tokens=False)] if names else []
    table = spark.sparkContext.broadcast(FrequentTable(names, lengths))
    key = ("token_counts", tokenizer_path, uuid.uuid4().hex)
    return map_batches(picked, lambda it: _count(it, tokenizer_path, table, key), "doc_id long, n_bytes long, n_tokens long", key)
