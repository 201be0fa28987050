"""Exact encoding with a merge-type piece model by backtracking.

An Aho-Corasick automaton gives the longest piece at each position.  The encoder
walks left to right with the longest piece first and accepts a piece only if
it is compatible with the one before it: merging the two pieces' characters anew
gives exactly these two pieces.  Where no piece fits, the position is marked as
failed in a bitfield and the last piece gives way to its next shorter prefix.
Characters that no piece holds end a run; they become byte pieces.

Compatibility of neighbours settles an encoding only where merges differ in score.  The
pieces of a run of blanks share one score, and the model's rule for ties, the
leftmost pair first, then depends on the whole run; so such a run is merged by that
rule.  All else, however long, is encoded by backtracking.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from .common import map_batches, text_column, worker_state

BLANK = "▁"
PAIR_ENTRIES = 1 << 20


class PieceEncoder:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.ids = {sp.id_to_piece(i): i for i in range(n) if not special[i]}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = {}
        for i in range(n):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[3:5], 16)] = i
        self.chars = {c for p in self.ids for c in p}
        self.pairs: dict[tuple[int, int], bool] = {}
        reachable = {p for p in self.ids if self.merge(p) == [p]}
        self.piece = {i: p for p, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for p in reachable:
            self.automaton.add_word(p, (len(p), self.ids[p]))
        self.automaton.make_automaton()
        #: The longest shorter piece with which a piece begins.
        self.shorter = {self.ids[p]: next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in reachable), None) for p in reachable}
        self.size = {i: len(p) for i, p in self.piece.items()}
        self.unknown = re.compile("[^" + re.escape("".join(sorted(self.chars))) + "]")
        #: Where a new line is no part of a piece, it also ends a chunk.
        end = "" if "\n" in self.chars else "\n"
        #: A word before a stop is a chunk of its own if no piece joins the two.
        joined = any(re.search(r"[^\W\d_²³¹¼-¾][.,!?;:]", p) for p in self.ids)
        alone = "" if joined else rf"{BLANK}*[^\W\d_²³¹¼-¾]+(?=[.,!?;:{BLANK}]|\Z)|"
        self.cut = re.compile(rf"{alone}{BLANK}*[^{BLANK}{end}]+|{BLANK}+" + (f"|{end}+" if end else ""))
        assert not any(BLANK in p.lstrip(BLANK) for p in self.ids), "a piece spans two words"

    def merge(self, text: str) -> list[str]:
        """Pieces by merging the best pair again and again, leftmost first among equals."""
        parts: list[str | None] = list(text)
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list = []

        def offer(a: int) -> None:
            b = after[a]
            if b >= 0 and (s := self.score.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-s, a, b, len(parts[a]) + len(parts[b])))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or after[a] != b or len(parts[a]) + len(parts[b]) != size:
                continue
            parts[a] += parts[b]
            parts[b] = None
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [p for p in parts if p is not None]

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            a, b = self.piece[left], self.piece[right]
            known = self.pairs[key] = self.merge(a + b) == [a, b]
        return known

    def backtrack(self, text: str) -> list[int]:
        longest: list[int] = [0] * len(text)
        for end, (size, i) in self.automaton.iter(text):
            longest[end - size + 1] = i
        n, at = len(text), 0
        failed = bytearray(n // 8 + 1)
        out: list[int] = []
        token: int | None = longest[0]
        while at < n:
            last = out[-1] if out else None
            while True:
                end = at + self.size[token]
                if not failed[end >> 3] >> (end & 7) & 1 and (last is None or self.compatible(last, token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else None
                    break
                if (token := self.shorter[token]) is None:
                    failed[at >> 3] |= 1 << (at & 7)
                    token = out.pop()
                    at -= self.size[token]
                    break
        return out

    def known_run(self, text: str) -> list[int]:
        if len(text) > 1 and text[1] == BLANK and text[0] == BLANK:
            return [self.ids[p] for p in self.merge(text)]
        return self.backtrack(text)

    def chunk(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for m in self.unknown.finditer(text):
            if m.start() > at:
                out += self.known_run(text[at : m.start()])
            out += [self.bytes[x] for x in m[0].encode()] if self.bytes else [self.sp.unk_id()]
            at = m.end()
        if at < len(text):
            out += self.known_run(text[at:])
        return out

    def split(self, text: str) -> list[str]:
        return self.cut.findall(BLANK + text.replace(" ", BLANK)) if text else []


def _build(path: str) -> tuple[PieceEncoder, chunks.ChunkCache]:
    e = PieceEncoder(path)
    return e, chunks.ChunkCache(lambda xs: [tuple(e.chunk(x)) for x in xs])


def encoder(path: str) -> tuple[PieceEncoder, chunks.ChunkCache]:
    return worker_state(("pieces", path), lambda: _build(path))


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    e, cache = encoder(path)
    end = e.sp.eos_id()
    for b in batches:
        ids = [[*chain.from_iterable(cache.values(e.split(t))), end] for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text with an end id.

    Null text counts as empty: the end id alone.  Null ids, repeated rows and
    empty tables pass through; columns besides the two named are not read.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text"))
    return map_batches(picked, lambda it: _encode(it, model_path), "doc_id long, ids array<int>", ("pieces", model_path))


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    sp = encoder(path)[0].sp
    for b in batches:
        texts = [sp.decode(x) if x else "" for x in b.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null or no ids give the empty text."""
    return map_batches(encoded.select("doc_id", "ids"), lambda it: _decode(it, model_path), "doc_id long, text string", ("pieces", model_path))


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    e, cache = encoder(path)
    end = e.sp.eos_id()
    decimal = [str(i) for i in range(e.sp.get_piece_size())]
    for b in batches:
        counts, coded, plain = [], [], []
        for t in b.column("text").to_pylist():
            ids = [*chain.from_iterable(cache.values(e.split(t))), end]
            counts.append(len(ids))
            coded.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
            plain.append(hashlib.sha256(e.sp.decode(ids).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(coded), pa.array(plain)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass, keeping digests of both instead of the
    lists of ids, so nothing large leaves the worker.  Rows as in ``encode``."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text"))
    return map_batches(picked, lambda it: _digests(it, model_path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", ("pieces", model_path))
