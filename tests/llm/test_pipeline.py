"""The pipeline's stages, each against a plain version on its own input."""

import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fringeworks.llm import chunks, pii

from ..conftest import SF
from .test_documents import brute_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """Input and output of each stage, read again as the next one's input."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(root / name))
        out[name] = (docs, spark.read.parquet(str(root / name)))
        docs = out[name][1]
    return out


def test_columns(staged):
    assert all(staged[n][1].columns == COLUMNS for n in list(staged)[:-1])


def test_language_keeps_letters(staged):
    before, after = staged["language_id"]
    gone = before.join(after, "doc_id", "left_anti").collect()
    assert len(gone) <= 0.02 * before.count()


def test_toxicity(staged, spark):
    before, after = staged["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = before.join(labels, "doc_id").join(after.select("doc_id", F.lit(True).alias("kept")), "doc_id", "left").collect()
    right = sum(bool(r.kept) == (r.toxic == 0) for r in kept)
    assert right >= 0.9 * len(kept)


def test_one_of_each_group_stays(staged):
    before, after = staged["near_duplicates"]
    texts = {r.doc_id: r.text or "" for r in before.collect()}
    want = {i for i, (_, c) in brute_components(texts, 5).items() if c == i}
    assert {r.doc_id for r in after.collect()} == want


def test_personal_data(staged):
    before, after = staged["pii"]
    old, new = ({r.doc_id: r for r in df.collect()} for df in (before, after))
    assert old.keys() == new.keys()
    plain = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+\w|\+\d+ \(\d+\) \d+-\d+|\b\d{16}\b|\b\d+\.\d+\.\d+\.\d+\b")
    for i in old:
        hits = set(plain.findall(old[i].text or ""))
        assert not any(h in new[i].text for h in hits)
        assert bool(hits) <= (old[i].text != new[i].text) and new[i].n_chars == len(new[i].text)


def test_packing(staged):
    before, after = staged["packing"]
    tok = chunks.load_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    n = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect()}
    rows = after.collect()
    got = {}
    for r in rows:
        assert r.doc_tokens == n[r.doc_id]
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == n
    parts = {}
    for r in rows:
        parts.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) == max(o + n for o, n in v) <= 4096 for v in parts.values())


def test_odd_tables(spark):
    """Nulls, repeats, no rows, and columns named as the operators name theirs."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    odd = docs.union(spark.createDataFrame([(900, None, None, None, None), (901, "", "en", "s", 0), (902, "Mr John Smith", "en", "s", 13), (902, "Mr John Smith", "en", "s", 13)], docs.schema))
    odd = odd.withColumns({c: F.lit(7) for c in ("row", "score", "lang_pred", "toxic", "kept", "n_entities", "_found", "doc", "severity", "n")})
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, odd.limit(0)):
            out = stage(spark, df, SF)
            assert name == "packing" or out.columns == odd.columns
            rows = out.collect()
            assert name == "packing" or all(r.score == 7 and r["_found"] == 7 and r.n_entities == 7 for r in rows)
    assert "n_entities" in pii.pseudonymize(odd).columns


def test_rows_of_repeated_ids(spark):
    """A unique text is never lost with its id, and of repeated rows one stays."""
    rows = [(0, "same words in this text"), (1, "same words in this text"), (1, "a text that is nowhere else"), (2, "twice the very same row"), (2, "twice the very same row"), (None, "same words in this text"), (3, "w " * 200_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert got == sorted([("0", rows[0][1]), ("1", rows[2][1]), ("2", rows[3][1]), ("None", rows[5][1]), ("3", rows[6][1])])


def test_run_equals_stages(spark, staged):
    a = corpus_pipeline.run(spark, SF).collect()
    assert sorted(a) == sorted(staged["packing"][1].collect())
