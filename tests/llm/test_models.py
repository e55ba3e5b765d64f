"""Language identification, toxicity, language-model scoring and quality rules."""

from __future__ import annotations

import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import langid, lm, pieces, quality, toxicity, words

from .conftest import prose

LANGS = {"aa": ["ka", "to", "mi", "ra"], "bb": ["schl", "ung", "eit", "ver"], "cc": ["ción", "os", "ña", "que"]}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, prose(i, 40, LANGS[k]), k) for i in range(90) for k in [list(LANGS)[i % 3]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_words_and_shingles_against_python():
    texts = ["A b\x0bC", "", None, "  x  ", "one two three four five six one two three four five six", "é" * 30]
    flat, counts = words.split(pa.array(texts), lower=True)
    want = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    assert counts.tolist() == [len(w) for w in want] and flat.to_pylist() == [x for w in want for x in w]
    hashes, counts = words.word_hashes(pa.array(texts), lower=True)
    assert len(set(hashes.tolist())) == len({x for w in want for x in w})
    _, sizes = words.shingle_hashes(hashes, counts, 4)
    assert sizes.tolist() == [len({tuple(w[i : i + 4]) for i in range(len(w) - 3)}) if len(w) >= 4 else min(1, len(w)) for w in want]


def test_slice_hashes_depend_on_bytes_alone():
    a = words.string_hashes(pa.array(["abc", "x" * 9, "abc", "abd", "", "x" * 17]))
    b = words.string_hashes(pa.array(["zz", "abc", "", "x" * 17, "x" * 9])[1:])
    assert a[0] == a[2] == b[0] and a[0] != a[3] and a[4] == b[1] and a[5] == b[2] and a[1] == b[3]


def test_forward_sums_all_segmentations():
    p = pieces.Pieces(["▁a", "▁", "a", "b", "ab"], np.zeros(5), np.arange(5), np.arange(256), np.zeros(256))
    model = langid.fit_words(p, ["x"], np.array([1.0]), pa.array(["ab", "a"]), np.array([[3.0], [1.0]]), rounds=2)
    prob = {t: model.prob[i, 0] / 16.0 ** len(t) for i, t in enumerate(p.texts)}

    def total(s):
        return 1.0 if not s else sum(q * total(s[len(t) :]) for t, q in prob.items() if s.startswith(t))

    got = langid.word_log_probs(model, pa.array(["ab", "aab", "b"]))[:, 0]
    assert got == pytest.approx([math.log(total("▁ab")), math.log(total("▁aab")), math.log(total("▁b"))])
    assert sum(prob.values()) == pytest.approx(1.0)


def test_language_held_out(spark, labelled):
    model = langid.fit(labelled.where("doc_id < 60"), per_language=15)
    got = langid.identify(labelled.where("doc_id >= 60").withColumnRenamed("lang", "truth"), model).collect()
    assert all(r["lang_pred"] == r["truth"] and r["score"] > 0.9 for r in got) and len(got) == 30


def test_language_edges(labelled, odd, none):
    model = langid.fit(labelled)
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and got[5]["lang_pred"] in LANGS and got[4]["label"] == "clash"
    assert langid.identify(odd, model).count() == 11 and langid.identify(none, model).count() == 0
    nothing = langid.fit(odd)  # no known language
    assert {r["lang_pred"] for r in langid.identify(odd, nothing).collect()} == {"und"}


def test_language_of_mostly_copies(spark, labelled):
    copies = spark.range(100, 40_100).selectExpr("id as doc_id", f"'{prose(999, 5, ['zu', 'wo'])}' as text", "'dd' as lang")
    own = spark.createDataFrame([(i, prose(i, 40, ["pfa", "ndl", "gri"]), "dd") for i in range(200, 212)], "doc_id long, text string, lang string")
    model = langid.fit(labelled.unionByName(copies).unionByName(own), per_language=15)
    got = langid.identify(spark.createDataFrame([(i, prose(i, 40, ["pfa", "ndl", "gri"])) for i in range(300, 320)], "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] for r in got] == ["dd"] * 20


def test_toxicity_held_out(spark, odd, none):
    bad = ["scum", "idiot"]
    rows = [(i, prose(i, 60) + (f" {bad[i % 2]}, and more" if i % 5 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs.where("doc_id >= 400"), model).collect()}
    assert all(r["predicted"] == int(k % 5 == 0) and 0 <= r["score"] <= 1 for k, r in got.items())
    assert len(model.index) < 500
    edge = toxicity.score(odd, model).collect()
    assert len(edge) == 11 and len({r["score"] for r in edge if r["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity.score(none, model).count() == 0
    empty = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(odd, empty).collect()} == {0.0}


def test_features_against_python():
    found, counts = toxicity.features(pa.array(["a b c b", None]), 1 << 20, order=2, skip=1)
    assert counts.tolist() == [3 + 3 + 2, 0]  # a b c; ab bc cb; a_c b_b
    alone, _ = toxicity.features(pa.array(["a b c b"]), 1 << 20)
    assert sorted(alone.tolist()) == sorted(found.tolist())


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [" "]


def test_lm_base_and_order(spark, odd, none):
    rows = [(i, prose(i % 30, 30)) for i in range(60)] + [(100, "of the of the"), (101, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = docs.where("doc_id % 3 <> 2")
    counts = collections.Counter(t for i, x in rows if i % 3 != 2 for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in lm.score(docs, train, chunk_bytes=2000).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[t] > 0 for t in own), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] >= base - 0.31
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())
    edge = lm.score(odd, train).collect()
    assert len(edge) == 11 and {r["n_tokens"] for r in edge if r["doc_id"] in (1, 2, 3)} == {1}
    assert lm.score(none, train).count() == 0
    assert {r["n_known"] for r in lm.score(odd, none).collect()} == {0}


def test_filter_never_forgets_and_is_bounded():
    r = np.random.default_rng(1)
    key = r.integers(0, 1 << 63, 5000, dtype=np.uint64)
    count = r.integers(1, 300, 5000)
    raw, size = lm.filter_slice(key, count)
    want = [int(math.log2(c)) + 1 for c in count.tolist()]
    assert lm.levels(count).tolist() == want and lm.probe(raw, size, key).tolist() == want
    other = r.integers(0, 1 << 63, 50_000, dtype=np.uint64)
    assert (lm.probe(raw, size, other) > 0).sum() == 0
    few, bits = lm.filter_slice(key, count, 4)
    assert (lm.probe(few, bits, key, 4) >= want).all() and 0 < (lm.probe(few, bits, other, 4) > 0).mean() < 0.1


def test_packed_keys_come_back():
    r = np.random.default_rng(2)
    for keys in (np.zeros(0, np.uint64), np.unique(r.integers(0, 1 << 64, 1000, dtype=np.uint64)), np.array([0, (1 << 64) - 1], np.uint64)):
        assert lm._unpack(lm._pack(keys)).tolist() == keys.tolist()


def brute_scores(rows, train):
    """Scores of the model with exact pair levels, one text after another."""
    own = [tokens(t) for _, t in train]
    single = collections.Counter(t for x in own for t in x)
    double = collections.Counter(p for x in own for p in zip([None, *x], x, strict=False))
    n, v = sum(single.values()), len(single)
    out = {}
    for i, text in rows:
        x = tokens(text)
        logs = []
        for weight, prior in zip(lm.WEIGHTS, lm.PRIOR, strict=True):
            total = math.log10(prior)
            for before, token in zip([None, *x], x, strict=False):
                count = 2 ** int(math.log2(double[before, token])) if double[before, token] else 0
                context = len(train) if before is None else single[before]
                ratio = min(count, single[token], context) / context if count else 0.0
                total += math.log10((1 - weight) * (single[token] + 1) / (n + v + 1) + weight * ratio)
            logs.append(total)
        top = max(logs)
        out[i] = top + math.log10(sum(10 ** (a - top) for a in logs))
    return out


def test_lm_score_against_brute_force_and_any_number_of_partitions(spark):
    rows = [(i, prose(i % 50, 30 + i % 7, ["ka", "to", "mi", "ra"])) for i in range(90)] + [(200, "of the of the of the"), (201, None), (202, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_scores(rows, [r for r in rows if r[0] % 3 != 2])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("3", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            got = {r["doc_id"]: r["score"] for r in lm.score(docs, docs.where("doc_id % 3 <> 2"), chunk_bytes=1500).collect()}
            assert got == pytest.approx(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_lm_rows_repeated_beyond_a_chunk(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h")] * 300 + [(None, None)] * 500 + [(2, "a b"), (3, "c d e")], "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_tokens"], round(r["score"], 9)) for r in lm.score(docs, docs, chunk_bytes=2000).collect())
    assert sorted(got.values()) == [1, 1, 300, 500] and {k[0]: k[1] for k in got} == {1: 9, None: 1, 2: 3, 3: 4}


def test_lm_pairs_of_any_count_are_scored(spark):
    words_ = [f"w{i}" for i in range(40)]
    rows = [(0, " ".join(words_)), (1, " ".join(words_[::-1])), (2, " ".join(words_[::2] + words_[1::2]))]  # no pair occurs twice
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.score(docs, docs.where("doc_id < 2")).collect()}
    assert (got[0]["train_tokens"], got[0]["n_tokens"]) == (82, 41)

    def mixed(ratios):
        per = [math.log10(p) + sum(math.log10((1 - x) * 3 / 124 + x * r) for r in ratios) for x, p in zip(lm.WEIGHTS, lm.PRIOR, strict=True)]
        return math.log10(sum(10.0**x for x in per))

    for i in (0, 1):  # each pair once after a token that occurs twice
        assert got[i]["score"] == pytest.approx(mixed([0.5] * 41)) and got[i]["score"] > got[i]["base_score"] + 20
    assert got[2]["score"] < got[2]["base_score"] + 5


def measured(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_quality_measures(spark, odd):
    texts = ["a b c a b c", "#x $y | z <>", "one\ntwo\none\n\n \none", "x x x x", prose(3, 80), "a b a b a b " * 30]
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + list(enumerate(texts, 100))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.measures(df).collect()
    assert sorted((r["doc_id"] or -1, *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]) for r in got) == sorted((i or -1, *measured(t)) for i, t in rows)
    assert quality.measures(odd).select("_s", "_w").distinct().collect() == [("clash", "clash")]


def test_quality_tail_is_exact(spark):
    def tail(k, n, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    for k, n in [(0, 50), (1, 300), (7, 2000)]:
        got = spark.sql(f"select {quality.binomial_tail('k', 'n', 0.01)} as v from (select cast({k} as bigint) k, cast({n} as bigint) n)").first()["v"]
        assert got == pytest.approx(tail(k, n, 0.01), rel=1e-9)


def test_quality_keeps_good_documents(spark, odd, none):
    rows = [(i, prose(i, 60) + (" # " * 40 if i % 4 == 0 else ""), "aa" if i < 1600 else "bb") for i in range(1700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(1700)], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality.filtered(docs, labels).collect()}
    assert all(got[i] == (i % 4 != 0) for i in range(1600))
    assert all(got[i] for i in range(1600, 1700))  # too few labels to certify a cutoff
    assert {r["kept"] for r in quality.filtered(odd.withColumnRenamed("label", "l2"), labels.limit(0)).collect() if r["doc_id"] in (1, 2, 3)} == {False}
    assert quality.filtered(none, labels).count() == 0


def test_long_words_are_summed_whole():
    texts = ["▁a", "▁", "a", "b", "ab", "ba", "aab", "c" * 20]
    p = pieces.Pieces(texts, np.zeros(len(texts)), np.arange(len(texts)), np.arange(256), np.zeros(256))
    strings = pa.array(["ab" * 40, "a" * 60 + "z" + "b" * 9, "c" * 45, "aab"])
    counts = np.array([[2.0, 1.0], [1.0, 0.0], [1.0, 3.0], [0.0, 2.0]])
    model = langid.fit_words(p, ["x", "y"], np.array([1.0, 1.0]), strings, counts, rounds=2)

    def forward(model, s, k):
        """Plain sums over all places, and the expected count of each piece by leaving out one edge at a time."""
        s, sums = "▁" + s, [1.0]
        edges = []
        for end in range(1, len(s) + 1):
            own = [(end - len(t), i, model.prob[i, k] / 16.0 ** len(t)) for i, t in enumerate(texts) if s[:end].endswith(t)]
            if not any(end - a == 1 for a, _, _ in own):
                own.append((end - 1, None, model.unknown[k] / 16.0))
            sums.append(sum(sums[a] * q for a, _, q in own))
            edges.append(own)
        back = [0.0] * len(s) + [1.0]
        expected = np.zeros(len(texts))
        for end in range(len(s), 0, -1):
            for a, i, q in edges[end - 1]:
                back[a] += q * back[end]
                if i is not None:
                    expected[i] += sums[a] * q * back[end]
        return math.log(sums[-1]), expected / sums[-1]

    logs = langid.word_log_probs(model, strings)
    total = langid._expected(model, strings, counts)
    for k in range(2):
        each = [forward(model, x, k) for x in strings.to_pylist()]
        assert logs[:, k] == pytest.approx([x for x, _ in each])
        assert total[:, k] == pytest.approx(sum(c * x for c, (_, x) in zip(counts[:, k], each, strict=True)))


def test_ftrl_against_the_plain_recursion():
    r = np.random.default_rng(4)
    dims, alpha, beta, l1 = 16, 0.5, 1.0, 2.5
    rows = [np.unique(r.integers(0, dims, 5)).astype(np.uint32) for _ in range(60)]
    labels = np.array([float(3 in x) for x in rows])
    z, n = [0.0] * (dims + 1), [0.0] * (dims + 1)

    def weight(i):
        penalty = 0.0 if i == dims else l1
        return 0.0 if abs(z[i]) <= penalty else -(z[i] - math.copysign(penalty, z[i])) / ((beta + math.sqrt(n[i])) / alpha)

    for _ in range(2):
        for row, label in zip(rows, labels, strict=True):
            own = [*row.tolist(), dims]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in own:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    model = toxicity.fit_features(rows, labels, dims, 2, 1, epochs=2, alpha=alpha, beta=beta, l1=l1)
    want = {i: weight(i) for i in range(dims) if weight(i)}
    assert dict(zip(model.index.tolist(), model.weight.tolist(), strict=True)) == pytest.approx(want) and 0 < len(want) < dims
    assert model.bias == pytest.approx(weight(dims))
    texts = pa.array(["a b c", "", "idiot a", None])
    found, counts = toxicity.features(texts, dims)
    ends = np.cumsum(counts)
    want_scores = [1 / (1 + math.exp(-(weight(dims) + sum(weight(i) for i in found[e - c : e].tolist())))) for e, c in zip(ends, counts, strict=True)]
    assert toxicity.score_texts(model, texts).tolist() == pytest.approx(want_scores)


def test_toxicity_sample_is_of_training_documents(spark):
    docs = spark.createDataFrame([(i, prose(i, 20) + (" scum" if i % 2 else "")) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, max_rows=40)
    got = toxicity.score(docs, model).collect()
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in got]) > 0.9
