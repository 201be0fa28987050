"""Packing, token counts and sentence pieces against the libraries."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from fringeworks.llm import chunks, packing, sentencepieces, token_counts

WORD, BYTE, PIECE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    "", " ", "  ", "   a  b   ", "a\n\nb\t c", "日本語テキスト ▁ x▁▁y", "<s> </s> <unk> <0x0A>", "naïve café ☃ 😀 é", "x" * 3000, " " * 777, "don't can't we'll  's", "a \n b",
    " hello x​", "<|endoftext|> a", "１２３ ½ ² ①", "ﷺ ﬁ", "\x1c\x1d a", "ab  " * 50, "for(i=0; i<10; i++) {\n\t\treturn x[i];\n}   // c", "İSTANBUL ΟΔΟΣ", "́a ́b", "--- === *** ```", "'Tis I'LL", "a_b__c 12½3 ²x", "ÿÀµ",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    alphabets = ["abc ▁ ,.\n\t'é日😀  <|endoftext|>1²", "abcABC ÉßªºµÀ,.\n\t1²½_-$\xa0\xad¿«", "abc Éß ªº,.\n\t'ſéμİ日😀  1²½½̶éͅ_-$$x_1"]
    return ODD + ["".join(rng.choice(a) for _ in range(rng.randint(0, 60))) for a in alphabets for _ in range(300)] + ["the and of to " * 20_000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(len(texts), None, 0), (None, "null id", 0), (0, "again", 0), (0, "again", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n long")


def given(docs):
    out = defaultdict(list)
    for r in docs.collect():
        out[r.doc_id].append(r.text or "")
    return out


def test_counts(docs):
    tok = chunks.load_tokenizer(BYTE)
    got = defaultdict(list)
    for r in token_counts.count_tokens(docs, BYTE).collect():
        got[r.doc_id].append((r.n_bytes, r.n_tokens))
    want = {k: [(len(t.encode()), len(tok.encode(t, add_special_tokens=False))) for t in ts] for k, ts in given(docs).items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_counts_do_not_depend_on_the_table(docs):
    some = docs.limit(50)
    a = token_counts.count_tokens(some, BYTE, table_entries=1).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, token_counts.count_tokens(some, BYTE).collect()))


def test_pieces(docs):
    sp = sentencepieces.PieceEncoder(PIECE).sp
    coded = sentencepieces.encode(docs, PIECE)
    got = defaultdict(list)
    for r in coded.collect():
        got[r.doc_id].append(r.ids)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(sp.encode(t) + [2] for t in ts) for k, ts in given(docs).items()}
    plain = {r.doc_id: r.text for r in sentencepieces.decode(coded.filter("doc_id between 1 and 30"), PIECE).collect()}
    assert all(plain[i] == sp.decode(got[i][0]) for i in plain)


def test_empty_tables(docs):
    none = docs.limit(0)
    assert token_counts.count_tokens(none, BYTE).count() == 0 and sentencepieces.encode(none, PIECE).count() == 0
    assert sentencepieces.round_trip_digests(none, PIECE).count() == 0 and sentencepieces.decode(sentencepieces.encode(none, PIECE), PIECE).count() == 0


def test_long_runs_without_a_blank():
    """Runs of any length go the same way."""
    e = sentencepieces.PieceEncoder(PIECE)
    rng = random.Random(2)
    for n in (511, 512, 513, 5000, 120_000):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz.") for _ in range(n))
        assert e.backtrack(word) == [e.ids[p] for p in e.merge(word)] and e.backtrack("▁" + word) == e.sp.encode(word)


def test_backtracking_gives_up_pieces():
    """Runs of letters whose longest first piece is wrong."""
    e = sentencepieces.PieceEncoder(PIECE)
    rng = random.Random(1)
    for _ in range(3000):
        word = "▁" * rng.randint(0, 1) + "".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 24)))
        assert [e.piece[i] for i in e.backtrack(word)] == e.merge(word)


def check_pieces(pieces, ids_of, length):
    sequences, whole = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length == len(p.token_ids) // 4 > 0
        sequences[p.sequence_id].append((p.offset, p.length))
        whole[p.doc_id].append(p)
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    assert sum(len(x) and sum(n for _, n in x) < length for x in sequences.values()) <= 1
    for doc, ps in whole.items():
        assert b"".join(p.token_ids for p in sorted(ps, key=lambda p: p.start)) in ids_of[doc]


@pytest.mark.parametrize("length", [64, 4096])
def test_packing(docs, texts, length):
    tok = chunks.load_tokenizer(WORD)
    plain = docs.filter("doc_id > 0")
    ids = {i: [np.array([*e.ids, 2], "<u4").tobytes()] for i, e in enumerate(tok.encode_batch([*texts, ""], add_special_tokens=False))}
    pieces = packing.pack(plain, WORD, length=length).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in plain.collect()}
    check_pieces(pieces, ids, length)
    assert all(p.doc_tokens * 4 == len(ids[p.doc_id][0]) for p in pieces)


def test_packing_repeated_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    pieces = packing.pack(df, WORD).collect()
    assert sorted(p.length for p in pieces) == [1, 3, 3] and len({p.sequence_id for p in pieces}) == 1
    assert packing.pack(df.limit(0), WORD).count() == 0


def test_hilbert_is_a_curve():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = packing.hilbert(grid, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_neighbours_on_the_curve():
    """Copies share a key; texts of like words lie nearer along the curve than others."""
    rng = random.Random(8)
    topics = [[f"t{k}w{i}" for i in range(30)] for k in range(12)]
    texts = [(k, " ".join(rng.choice(topics[k]) for _ in range(200))) for k in range(12) for _ in range(20)]
    key = packing.curve_keys([t for _, t in texts])
    ranked = [texts[i][0] for i in np.argsort(key, kind="stable")]
    same = sum(a == b for a, b in zip(ranked, ranked[1:], strict=False))
    assert same > 4 * 20  # by chance about 20 of 239
    again = packing.curve_keys([texts[0][1], texts[0][1], ""])
    assert again[0] == again[1] == key[0] and len(packing.curve_keys([])) == 0


def test_word_table_starts_anew():
    """More words than the table takes, long runs, and numerals one by one."""
    e = packing.IdEncoder(WORD)
    e.table.entries = 50
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdé12½.,!- ") for _ in range(9)) for _ in range(30)) for _ in range(300)] + ["x" * 300_000, "1" * 5000, "." * 5000, "", " "]
    want = [np.array(x.ids, np.uint16).tobytes() for x in e.tok.encode_batch_fast(texts, add_special_tokens=False)]
    assert e.texts(texts) == want and e.texts(texts[::-1]) == want[::-1]
