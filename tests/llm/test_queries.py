"""The registered queries over whole tables, against the libraries, hashlib and brute force."""

import hashlib
import io
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fringeworks.llm import media, queries

from ..conftest import SF
from .test_documents import words_of

LARGER = SF.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_packing_query(spark, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in queries.op1_curve_packing(spark, SF).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id]) and len(part) == r.length > 0
        pieces[r.doc_id].append((r.start, r.length))
        filled[r.sequence_id].append((r.offset, r.length))
    for parts, whole in [(pieces[i], len(x)) for i, x in ids.items()] + [(v, None) for v in filled.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == whole if whole is not None else at <= 4096
    total = sum(map(len, ids.values()))
    assert len(filled) == -(-total // 4096)


def plain_image(data: bytes) -> np.ndarray:
    """Pixels of a P6 or a 24-bit BMP file, one by one."""
    if data[:2] == b"P6":
        _, size, top, rest = data.split(b"\n", 3)
        w, h = map(int, size.split())
        assert top == b"255"
        return np.array(list(rest), np.uint8).reshape(h, w, 3)
    at, (w, h) = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<ii", data, 18)
    stride = (w * 3 + 3) // 4 * 4
    return np.array([[[data[at + (h - 1 - y) * stride + x * 3 + 2 - c] for c in range(3)] for x in range(w)] for y in range(h)], np.uint8)


def test_media_query(spark, texts):
    stored = {r.doc_id: r for r in media.store_texts(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    kinds = set()
    rows = queries.op4_media_columns(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        data = stored[r.doc_id].media
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
        kinds.add(bytes(data[:2]))
        tile = np.load(io.BytesIO(r.tile_npy))
        assert tile.shape == (8, 9, 3) and r.tile_sha256 == hashlib.sha256(r.tile_npy).hexdigest()
        grey = [[299 * int(p[0]) + 587 * int(p[1]) + 114 * int(p[2]) for p in row] for row in tile]
        bits = "".join("1" if row[x + 1] < row[x] else "0" for row in grey for x in range(8))
        assert r.feature == f"{int(bits, 2):016x}"
        if len(payload) <= 192 * 20:
            image = plain_image(data)
            assert image.tobytes() == payload
            fine = np.kron(image.astype(float), np.ones((8, 9, 1)))
            mean = fine.reshape(8, image.shape[0], 9, image.shape[1], 3).mean(axis=(1, 3))
            assert (np.abs(mean - tile) <= 0.5 + 1e-6).all()
    assert kinds == {b"P6", b"BM"}


def test_media_without_bytes(spark):
    df = spark.createDataFrame([(1, None, None), (None, 3, None)], "doc_id long, n_bytes long, media binary")
    assert {tuple(r)[2:] for r in media.features(df).collect()} == {(None,) * 8}
    assert media.features(df.limit(0)).count() == 0


def test_token_count_query(spark, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op8_token_counts(spark, SF).collect()}
    want = {i: (len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)) for i, t in texts.items()}
    assert got == {i: (b, n, n > 512) for i, (b, n) in want.items()}


def test_sentence_piece_query(spark, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op10_sentence_pieces(spark, SF).collect()}
    want = {}
    for i, t in texts.items():
        ids = sp.encode(t, add_eos=True)
        want[i] = (len(ids), digest(" ".join(map(str, ids))), digest(sp.decode(ids)))
    assert got == want


def test_near_duplicate_query(spark):
    """Every pair of the larger table, by sets of word pairs."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    sets, label = {}, {}
    for i, t in texts.items():
        w = [x.lower() for x in words_of(t)]
        sets[i] = {(*w[j : j + 2],) for j in range(max(1, len(w) - 1))} if w else set()
        label[i] = i

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    order = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if 100 * len(sets[a]) < 80 * len(sets[b]):
                break
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op6_circulant_minhash(spark, LARGER).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_toxicity_query(spark, texts):
    """Severity rises with the grade and with the share of toxic labels, on all rows."""
    rows = queries.op7_ordinal_toxicity(spark, LARGER).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    by = defaultdict(list)
    for r in rows:
        by[r.grade].append(r.severity)
    grades = sorted(by)
    assert all(max(by[a]) <= min(by[b]) for a, b in zip(grades, grades[1:], strict=False))
    known = [(r.severity, labels[r.doc_id]) for r in rows if r.doc_id in labels]
    toxic, clean = ([s for s, y in known if y == want] for want in (1, 0))
    assert sum(a > b for a in toxic for b in clean) >= 0.98 * len(toxic) * len(clean)
