"""Media, MinHash, languages, toxicity, licences and personal data."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from fringeworks.llm import ann, graph, language_id, media, minhash, pii, queries, textvec, toxicity

from ..conftest import SF

EDGE = "doc_id long, text string, lang string, row int, n long, label string"


@pytest.fixture(scope="module")
def edge(spark):
    long = "lorem ipsum dolor " * 40_000
    rows = [(1, None, None, 1, 1, "x"), (2, "", "en", 1, 1, "x"), (3, " \n\t ", "en", 1, 1, None), (4, long, "en", 1, 1, "x"), (5, "same words here again", "en", 1, 1, "x"), (5, "same words here again", "en", 1, 1, "x"), (6, "same words here again", "de", 1, 1, "x"), (None, "no id", "en", 1, 1, "x"), (7, "one", None, 1, 1, "x"), (8, "12 34 !?", "en", 1, 1, "x")]
    return spark.createDataFrame(rows, EDGE)


# Words


def words_of(text: str):
    return re.findall(rb"[^\x20\x09-\x0D]+", text.encode())


@pytest.mark.parametrize("text", ["", "a", "  a b\tc\n", "Ünï \x0b\x0c x", "w" * 700_000 + " end", "ab " * 200_000])
def test_word_scan(text):
    s, e, h = textvec.words(np.frombuffer(text.encode(), np.uint8))
    raw = text.encode()
    got = [raw[a:b] for a, b in zip(s, e, strict=True)]
    assert got == words_of(text)
    by = defaultdict(set)
    for w, x in zip(got, h.tolist(), strict=True):
        by[w.lower()].add(x)
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


# Media


@pytest.mark.parametrize("form", ["ppm", "bmp"])
def test_media_round_trip(edge, form):
    stored = media.store_texts(edge, form)
    media_of = defaultdict(list)
    for r in stored.collect():
        media_of[r.doc_id].append((r.n_bytes, r.media))
    seen = defaultdict(set)
    for r in media.features(stored).collect():
        n, data = media_of[r.doc_id][0]
        payload = media.decode(data).tobytes()
        assert len(payload) == r.payload_bytes and r.payload_bytes % 192 == 0 < r.payload_bytes and r.n_bytes == n
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_sha256 == hashlib.sha256(data).hexdigest() and r.media_bytes == len(data) and len(r.feature) == 16
        seen[payload].add((r.feature, r.tile_sha256))
    assert all(len(v) == 1 for v in seen.values())
    texts = {r.doc_id: r.text or "" for r in edge.collect()}
    assert all(media.decode(m).tobytes().rstrip(b" ") == texts[k].encode().rstrip(b" ") for k, v in media_of.items() for _, m in v)


def test_netpbm_headers_and_errors():
    x = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.decode(media.encode_ppm(x)) == x).all()
    assert (media.decode(b"P5 # made by hand\n# twice\n4 3\n255\n" + x.tobytes()) == x).all()
    with pytest.raises(ValueError):
        media.decode(b"P2\n1 1\n255\n0")
    with pytest.raises(ValueError):
        media.store_texts(None, "gif")


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (64, 64), (3, 200)])
def test_area_resize_against_brute_force(shape):
    x = np.random.default_rng(0).integers(0, 256, shape).astype(float)
    # Every pixel split into a fine grid that both sizes divide.
    fine = np.kron(x, np.ones((8, 9)))
    want = fine.reshape(8, shape[0], 9, shape[1]).mean(axis=(1, 3)) if fine.shape == (8 * shape[0], 9 * shape[1]) else None
    assert np.allclose(media.area_resize(x, 8, 9), want)


# MinHash


def brute_components(texts: dict, width: int):
    sets = {}
    for i, t in texts.items():
        w = [x.lower() for x in words_of(t)]
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    base = [[words[j] for j in rng.integers(0, 400, 60)] for _ in range(12)]
    texts = {}
    for i in range(220):
        t = list(base[i % 12])
        for _ in range(rng.integers(0, 8)):
            t[rng.integers(0, len(t))] = words[rng.integers(0, 400)]
        texts[i] = " ".join(t)
    texts |= {300: "", 301: "one", 302: "ONE", 303: "  ", 304: "a b", 305: "A\nb"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, width=width).collect()}
    want = {i: (n, c, c == i) for i, (n, c) in brute_components(texts, width).items()}
    assert got == want


def test_near_duplicates_of_a_wide_component(spark):
    """Three clouds joined by gradual versions: no shingle has a majority, so the
    group's core is empty, and the members are linked with their base only."""
    fresh = (f"x{i}" for i in range(10_000))
    take = lambda n: [next(fresh) for _ in range(n)]
    bases = [take(60) for _ in range(3)]
    chain = [b[:k] + a[k:] for a, b in zip(bases, bases[1:], strict=False) for k in range(3, 60, 3)]
    rng = np.random.default_rng(2)
    clouds = []
    for b in bases * 60:
        t = list(b)
        for at in rng.choice(60, 5, replace=False):
            t[at] = next(fresh)
        clouds.append(t)
    texts = dict(enumerate([" ".join(t) for t in [*chain, *clouds, *bases]], 1))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, width=1).collect()}
    want = brute_components(texts, 1)
    assert {c for _, c in want.values()} == {1}
    assert got == want


def test_near_duplicates_edges(edge, spark):
    rows = minhash.near_duplicates(edge, width=2).collect()
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert [got[i] for i in (1, 2, 3)] == [[(0, 1, True)], [(0, 2, True)], [(0, 3, True)]] and got[None] == [(1, None, True)]
    assert got[5] == [(3, 5, True)] * 2 and got[6] == [(3, 5, False)] and got[4][0][0] == 3
    assert minhash.near_duplicates(edge.limit(0)).count() == 0


def test_near_duplicates_of_repeated_and_null_ids(spark):
    """Each row by its own text, whichever comes first; a row without an id links nothing."""
    rng = np.random.default_rng(6)
    a, b, c = ([f"{x}{j}" for j in rng.integers(0, 300, 80)] for x in "abc")
    near = lambda t: " ".join([*t[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (5, " ".join(c)), (None, " ".join(c)), (None, near(c)), (7, " ".join(c)), (7, "plain and alone")]
    want = sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (5, 5, True), (7, 5, False), (7, 7, True)]) + [(None, None, True)] * 2
    for order in (rows, rows[::-1]):
        got = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(order, "doc_id long, text string"), width=2).collect()]
        assert sorted(x for x in got if x[0] is not None) + [x for x in got if x[0] is None] == want
    keyed = spark.createDataFrame([(1, "a b c", 70), (2, "a b c", 71), (3, None, 72)], "doc_id long, text string, mark long")
    assert {(r.mark, r.kept) for r in minhash.near_duplicates(keyed, key_col="mark").collect()} == {(70, True), (71, False), (72, True)}


def test_circulant_signature():
    rng = np.random.default_rng(0)
    s = np.unique(rng.integers(0, 1 << 63, 50).astype(np.uint64))
    k, size = 16, 1 << minhash.UNIVERSE_BITS
    second = np.random.default_rng(11).permutation(size).astype(np.uint32)
    places = (textvec.mix(s ^ minhash._PRIME) >> np.uint64(64 - minhash.UNIVERSE_BITS)).astype(np.int64)
    assert (minhash.signature(s, k) == [second[(places - j) % size].min() for j in range(k)]).all()
    a, b = s[:40], s[10:]
    big = minhash.signature(a, 448) == minhash.signature(b, 448)
    assert abs(big.mean() - len(set(a) & set(b)) / len(set(a) | set(b))) < 0.12


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 150)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Languages


def test_languages(spark):
    r = queries.op2_output_codes(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [x for x in r if x.held_out]
    assert len(r) == 200 and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in r)
    assert held and sum(x.lang == x.lang_pred for x in held) >= 0.95 * len(held) and all(0 <= x.score <= 1 for x in r)


def test_model_sizes():
    """The sizes are not cut to fit the check tool's limits."""
    assert (language_id.TRIGRAM_BITS, language_id.SAMPLE_ROWS) == (12, 2400)
    assert (toxicity.FEATURES, toxicity.SAMPLE_TOXIC, toxicity.SAMPLE_CLEAN) == (4096, 1500, 3000)


def test_language_edges(spark, edge):
    model = language_id.train(edge)
    got = {r.row: (r.lang_pred, r.score) for r in language_id.identify(edge.withColumn("row", edge.doc_id.cast("int")), model, keep=("row", "text")).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 8)) and got[4][0] in ("de", "en")
    assert language_id.train(edge.limit(0)).langs == []
    assert {r.lang_pred for r in language_id.identify(edge, language_id.LanguageModel()).collect()} == {"und"}
    assert language_id.identify(edge.limit(0), model).count() == 0


def test_language_sample_of_many_copies(spark):
    """A huge group of copies counts as one text, no language is left out, and the model
    depends on neither order nor partitions."""
    rng = np.random.default_rng(9)
    words = {lang: ["".join(rng.choice(list(letters), 5)) for _ in range(60)] for lang, letters in (("xx", "aeioubcd"), ("yy", "mnpqrstu"), ("zz", "äöüßklvw"))}
    text = lambda lang: " ".join(rng.choice(words[lang], 12))
    rows = [(0, "one and the same text, thousands of times", "xx")] * 6000 + [(i, text(lang), lang) for i, lang in enumerate(["xx"] * 300 + ["yy"] * 300 + ["zz"] * 3, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, sample_rows=300)
    assert model.langs == ["xx", "yy", "zz"]
    again = language_id.train(df.repartition(7, "doc_id").orderBy("text"), sample_rows=300)
    assert again.langs == model.langs and (again.weights == model.weights).all() and (again.trust == model.trust).all()
    got = language_id.identify(df.filter("doc_id > 0"), model, keep=("doc_id", "lang")).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_many_languages(spark):
    """More languages than the sample has room for get their least share each."""
    rows = [(i, f"{'abcdefghijklmnopqrst'[k % 20]}{k}x " * 9 + f"w{i}", f"l{k}") for i, k in enumerate(list(range(40)) * 12)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=30)
    assert len(model.langs) == 40


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 40])
def test_codewords_are_apart(n):
    code = language_id.codewords(n)
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) >= (1 if n == 2 else 2) and (np.abs(code.sum(axis=0)) < n).all()


# Toxicity


def test_ordinal_gradient_and_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)).astype(np.float32)
    score = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=400)
    grade = np.searchsorted([0.0, 1.5, 3.0], score)
    w, theta = toxicity.fit_ordinal(x, grade, np.ones(400), steps=800)
    assert w[0] > 1.4 and w[1] < -0.6 and abs(w[2]) < 0.4 and (np.diff(theta) > 0).all()
    assert np.allclose(theta, [0.0, 1.5, 3.0], atol=0.6)


def test_toxicity_learns(spark):
    rows = [(i, f"the quiet word number w{i % 7} is here" + (" you idiot fool" if i % 3 == 0 else "")) for i in range(150)]
    docs = spark.createDataFrame([*rows, (999, None), (1000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 120)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.grade(docs, model).collect()}
    assert all(got[i].toxic == (i % 3 == 0) for i in range(150)) and not got[999].toxic and not got[1000].toxic
    assert all(0 <= r.severity <= 3 and 0 <= r.grade <= 3 for r in got.values())
    assert toxicity.train(docs, labels.filter("toxic = 0")) is None
    assert not any(r.toxic for r in toxicity.grade(docs, None).collect()) and toxicity.grade(docs.limit(0), model).count() == 0


def test_toxicity_of_long_and_odd_texts(spark, edge):
    rows = [(i, "calm water " * 20_000 if i % 2 else "you idiot fool " * 20_000) for i in range(8)] + [(i, f"quiet word w{i}" if i % 2 else f"you idiot fool w{i}") for i in range(8, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.toxic for r in toxicity.grade(docs, model).collect()}
    assert got == {i: i % 2 == 0 for i in range(60)}
    odd = toxicity.grade(edge.withColumn("severity", edge.n), model, keep=("doc_id", "row", "severity", "text"))
    assert odd.columns[:4] == ["doc_id", "row", "severity", "text"] and odd.count() == edge.count()
    assert toxicity.train(docs.limit(0), labels) is None


def test_toxicity_held_out(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels.filter("doc_id % 5 <> 0"))
    test = toxicity.grade(docs, model).withColumnRenamed("toxic", "found").join(labels.filter("doc_id % 5 = 0"), "doc_id").collect()
    toxic, clean = ([r.found for r in test if r.toxic == y] for y in (1, 0))
    assert sum(toxic) >= 0.95 * len(toxic) and sum(clean) <= 0.005 * len(clean)


# Neighbours


def brute_search(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None]
    out = {}
    for q, a in ok:
        if q % 50:
            continue
        scored = [(-float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), i) for i, b in ok if i != q and len(a) == len(b)]
        out[q] = sorted(scored)[:k]
    return out


def test_search(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=24)]) for i in range(900)]
    rows += [(2000 + i, rows[50][1]) for i in range(20)] + [(3000, None), (3001, []), (3002, [0.0] * 24), (3003, [float("nan")] * 24), (3004, [None] * 24), (3050, [1.0, 2.0]), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(df.filter("vec_id % 50 = 0"), df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = brute_search(rows, 5)
    hits = total = 0
    for q, best in want.items():
        if best:
            hits += len({i for i, _ in got[q]} & {i for _, i in best})
            total += len(best)
            assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
    assert hits >= 0.98 * total and [i for i, _ in got[50]] == [i for _, i in want[50]] and 3050 not in got


def test_search_among_copies(spark):
    """A very common vector, as query and as candidate, and columns named as the operator
    names its own: exact against brute force."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(120)] + [(i, [1.0] * 16) for i in range(120, 400)] + [(401, [2.0] * 16), (401, [2.0] * 16)]
    df = spark.createDataFrame([(i, v, 1, 2.0, b"") for i, v in rows], "vec_id long, embedding array<double>, id long, score double, code binary")
    got = defaultdict(list)
    for r in ann.search(df.filter("vec_id % 50 = 0"), df).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = brute_search(dict(rows).items(), 5)
    assert got.keys() == want.keys()
    for q, best in want.items():
        found = sorted(got[q])
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert np.allclose([s for _, _, s in found], [-s for s, _ in best], atol=1e-12)
    assert [i for _, i, _ in sorted(got[150])] == [120, 121, 122, 123, 124] and [i for _, i, _ in sorted(got[200])] == [120, 121, 122, 123, 124]


def test_estimates_hold_their_bounds():
    """Population counts give the products that the signs do, within the bounds."""
    rng = np.random.default_rng(7)
    x, q = (rng.normal(size=(n, 48)) for n in (500, 20))
    x, q = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, q))
    codes, own = ann.encode(x)
    signs = np.where((x @ ann.rotation(48)) >= 0, 1.0, -1.0)
    words = np.ascontiguousarray(codes.T)
    ones = np.bitwise_count(words).sum(axis=0, dtype=np.int64)
    inside = []
    for j, (planes, low, step, total) in enumerate(zip(*ann.quantise(q), strict=True)):
        guess, bound = ann.estimate(planes, low, step, total, words, ones, own)
        turned = q[j] @ ann.rotation(48)
        level = low + np.rint((turned - low) / step) * step
        assert np.allclose(guess, signs @ level / np.sqrt(len(level)) / own)
        inside.append(np.abs(guess - x @ q[j]) <= bound)
    assert np.mean(inside) > 0.93


def test_search_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    rows = ann.search(df.filter("vec_id = 0"), df).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in rows] == [(0, 1, 1)] and rows[0].score == pytest.approx(0.5**0.5)
    assert ann.search(df.limit(0), df).count() == 0


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute_search(rows, 5)
    got = defaultdict(set)
    for r in queries.op3_one_bit_codes(spark, SF).collect():
        got[r.query_id].add(r.vec_id)
    assert sum(len(got[q] & {i for _, i in b}) for q, b in want.items()) >= 0.95 * sum(map(len, want.values()))


# Personal data


def test_surrogates(spark):
    text = (
        'Mail bob.smith+x@mail7.example.com, call +1 (017) 555-7713, (212) 555-0100 or 212-555-0199. ip 97.51.17.173. '
        '4111 1111 1111 1111 and 4111111111111112 ssn 123-45-6789 token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"!! v1.2.3 in 2020'
    )
    names = "Mr. John Smith met Mrs Anna Lee; then Mr Smith and Mary Jones. господин Иванов и Анна Петрова."
    df = spark.createDataFrame([(1, text, 9), (2, names, 9), (3, None, 9), (4, "", 9), (5, "plain 12 text @ 1.2", 9), (6, "again bob.smith+x@mail7.example.com", 9)], "doc_id long, text string, n_entities int")
    got = {r.doc_id: r for r in pii.pseudonymize(df).collect()}
    assert got[3].text is None and got[4].text == "" and got[5].text == "plain 12 text @ 1.2" and [got[i].n_entities for i in (3, 4, 5)] == [0, 0, 0]
    for old in ("bob.smith", "555-7713", "555-0100", "555-0199", "97.51.17.173", "4111 1111", "4111111111111112", "123-45-6789", "9b0b3c6a43eb"):
        assert old not in got[1].text
    new = got[1].text
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", s)))
    mail = re.search(r"\S+@\S+?(?=,)", new)[0]
    assert mail.endswith(".example") and shape(mail.split("@")[0]) == "aaa.aaaaa+a" and mail in got[6].text
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4}, \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}\. ip \d+\.\d+\.\d+\.\d+\. 4\d{3} \d{4} \d{4} \d{4} and 4\d{15} ssn 9\d\d-\d\d-\d{4} token = \"[0-9a-f]{40}\"!! v1.2.3 in 2020$", new)
    luhn = lambda s: sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(re.sub(r"\D", "", s))))) % 10
    cards = re.findall(r"4\d{3} ?\d{4} ?\d{4} ?\d{4}", new)
    assert luhn(cards[0]) == 0 == luhn("4111 1111 1111 1111") and luhn(cards[1]) == luhn("4111111111111112") != 0
    m = re.fullmatch(r"Mr\. (\S+) (\S+) met Mrs (\S+) (\S+); then Mr (\S+) and (\S+) (\S+)\. господин (\S+) и (\S+) (\S+)\.", got[2].text)
    assert m and m[2] == m[5] and len({m[2], m[4], m[7]}) == 3
    within = lambda x, pool: all(p in pii.POOLS[pool] for p in x.split("-"))
    assert within(m[1], "given_m_latn") and within(m[3], "given_f_latn") and within(m[6], "given_f_latn") and within(m[8], "family_m_cyrl") and within(m[9], "given_f_cyrl") and within(m[10], "family_f_cyrl")
    assert not {"John", "Smith", "Anna", "Lee", "Mary", "Jones", "Иванов", "Анна", "Петрова"} & set(re.findall(r"\w+", got[2].text))
    other = {r.doc_id: r.text for r in pii.pseudonymize(df, key="another").collect()}
    assert other[1] != got[1].text


def test_surrogates_of_secrets_in_capitals_and_long_ones(spark):
    """Hexadecimal secrets are found in either case and beyond 64 digits."""
    low = hashlib.sha1(b"a").hexdigest()
    long = hashlib.sha512(b"b").hexdigest()
    mixed = low[:20] + low[20:].upper()
    secrets = [low, low.upper(), mixed, long, long.upper()]
    df = spark.createDataFrame([(i, f'TOKEN = "{s}" IS A SECRET') for i, s in enumerate(secrets)], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymize(df).collect()}
    new = [re.fullmatch(r'TOKEN = "([0-9A-Fa-f]+)" IS A SECRET', out[i].text)[1] for i in range(len(secrets))]
    assert [out[i].n_entities for i in range(len(secrets))] == [1] * len(secrets)
    assert [len(s) for s in new] == [len(s) for s in secrets]
    assert all(a.lower() != b.lower() for a, b in zip(new, secrets, strict=True))
    assert [(s.islower(), s.isupper()) for s in new] == [(s.islower(), s.isupper()) for s in secrets]


def test_surrogates_stay_distinct(spark):
    """Few possible replacements: clashes are found and drawn again."""
    rows = [(i, f"To a.{i % 90}@mail.com and b.{i % 100}@mail.com, Mr {f} or Mrs {g} {f}.") for i, (g, f) in enumerate((g, f) for g in pii.POOLS["given_f_latn"] for f in pii.POOLS["family_latn"][:12])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts = pii.entities(df).selectExpr("explode(_found) v").selectExpr(f"explode({pii._parts('v')}) p").select("p.kind", "p.value")
    assert pii.redrawn(parts, pii.DEFAULT_KEY).count() > 0
    out = {r.doc_id: r.text for r in pii.pseudonymize(df).collect()}
    mails, names = {}, {}
    for i, t in rows:
        for a, b in zip(re.findall(r"\S+@[\w.]+\w", t), re.findall(r"\S+@[\w.]+\w", out[i]), strict=True):
            assert mails.setdefault(a, b) == b and a != b
        for a, b in zip(re.findall(r"Mr (\S+) or Mrs (\S+) (\S+)\.", t)[0], re.findall(r"Mr (\S+) or Mrs (\S+) (\S+)\.", out[i])[0], strict=True):
            assert names.setdefault(a, b) == b and a != b
    assert len(set(mails.values())) == len(mails) == 190 and len(set(names.values())) == len(names)


def test_surrogates_use_no_python(spark, edge, capsys):
    pii.pseudonymize(edge).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan
    assert pii.pseudonymize(edge.limit(0)).count() == 0
    assert {r.doc_id: r.text for r in pii.pseudonymize(edge).collect()} == {r.doc_id: r.text for r in edge.collect()}
