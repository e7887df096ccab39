"""Near-duplicates, components, vectors, classifiers and the pipeline against brute force and on odd rows."""

from __future__ import annotations

import re
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from portfolia.llm import crosspolytope, minhash, quality, toxicity, vectors
from portfolia.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def groups_of(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    links = [tuple(map(int, p)) for p in rng.integers(0, 300, (160, 2))] + [(400, k) for k in range(401, 600)]
    links += [(k, k + 1) for k in range(700, 740)] + [(9, 9), (900, 900)]
    got = {r["node"]: r["component"] for r in components(
        spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    assert got == groups_of({n for p in links for n in p}, links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text, k):
    w = WORDS.findall((text or "").translate(LOWER))
    if len(w) < k:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def check_near(docs, k):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    sets = {i: shingle_set(t, k) for i, t in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups_of(sets, links)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, k).collect()}
    own = {i: r for i, r in got.items() if i is not None}
    assert {i: r["component_id"] for i, r in own.items()} == want
    assert {i: r["n_shingles"] for i, r in own.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (i == want[i]) for i, r in own.items())
    return got, links


def test_code_length_follows_the_rows():
    assert [vectors.code_length(n, 64) for n in (0, 10**4, 10**6, 10**8, 10**10, 10**12)] == [1, 1, 1, 2, 3, 4]


def test_text_labels(spark):
    rows = [(i, [1.0, 0.01 * i], "a" if i < 3 else "b" if i < 5 else None) for i in range(7)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got.collect()} == {
        0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (0, 6)}


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    got, links = check_near(odd_docs, 4)
    assert got[None]["component_id"] is None and len(links) == 3
    assert minhash.near_duplicates(no_docs).count() == 0


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A family of near copies around the threshold, short texts, in small blocks and parts."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "PART_SHINGLES", 300)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(70):
        words = list(base)
        for at in rng.integers(0, 60, int(rng.integers(0, 4))):
            words[at] = f"e{rng.integers(1000)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"s{j}" for j in range(i % 7))) for i in range(20)]
    _, links = check_near(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    assert len(links) > 100


def test_batches_of_few_words(spark):
    """All texts of a batch together hold fewer words than a shingle, or hardly more."""
    for k in (4, 5):
        for n in range(7):
            for texts in ([" ".join("abcdef"[:n])], [" ".join("abcdef"[:n]), None, ""], ["", "x", " ".join("abcdef"[:n])]):
                sets, ends = minhash.shingle_sets(pa.array(texts, pa.string()), k)
                assert np.diff(ends).tolist() == [len(shingle_set(t, k)) for t in texts] and ends[-1] == len(sets)
    check_near(spark.createDataFrame([(1, "a b"), (2, ""), (3, "a b")], "doc_id long, text string").coalesce(1), 5)


def test_tiny_sets_are_not_filtered(spark, monkeypatch):
    """Pairs of 4 and 5 shingles lie right at the threshold: each is found whatever its bins say."""
    monkeypatch.setattr(minhash, "AGREE", minhash.BINS + 1)
    rows = [(3 * i + j, f"a{i} b{i} c{i} d{i} e{i} f{i} g{i}" + (f" h{i}" if j == 1 else f" k{i}" if j == 2 else ""))
            for i in range(200) for j in range(3)]
    _, links = check_near(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    assert len(links) == 400


def test_one_of_each(odd_docs):
    kept = minhash.one_of_each(odd_docs, k=4)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and None in ids and {6, 7} & set(ids) == set() and 5 in ids


def test_optimal_densification_keeps_similarity():
    rng, agree = np.random.default_rng(1), []
    for _ in range(300):
        both = rng.integers(0, 2**63, 24, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        a, b = np.sort(both[:22]), np.sort(both[2:])  # similarity 20 / 24
        agree.append((minhash.densified(a) == minhash.densified(b)).mean())
    assert abs(np.mean(agree) - 20 / 24) < 0.03


# --- vectors ---


def cluster_table(spark, odd=True):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(12):
        centre = rng.normal(size=24)
        for _ in range(20):
            rows.append((centre + rng.normal(size=24) * 0.28).tolist())
    rows += [rows[0]] * 5
    table = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(rows)]
    if odd:
        table += [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 24, 0), (1003, [float("nan")] * 24, 0),
                  (1004, [None] * 24, 0), (1005, [float("inf")] + [1.0] * 23, 1), (1006, [1.0, 2.0], 0),
                  (1007, rows[0], None), (None, rows[0], 0), table[3]]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")
    return table, df.select("*", *[F.lit("clash").alias(c) for c in ("id", "v", "bucket", "n", "rep", "score")])


@pytest.mark.parametrize("length", [None, 2])
def test_near_vectors(spark, monkeypatch, length):
    """In small blocks, with codes of the length that the rows ask for and with longer ones."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "ROWS_AT_ONCE", 5)
    if length:
        monkeypatch.setattr(vectors, "code_length", lambda rows, dim: length)
    table, df = cluster_table(spark)
    fit = {i: (np.array(v), k) for i, v, k in table if i is not None and k is not None and i not in range(1000, 1006)}
    links = [(a, b) for a in fit for b in fit if a < b and fit[a][1] == fit[b][1] and len(fit[a][0]) == len(fit[b][0])
             and fit[a][0] @ fit[b][0] / np.linalg.norm(fit[a][0]) / np.linalg.norm(fit[b][0]) >= 0.93]
    ids = {i for i, _, _ in table if i is not None}
    want, count = groups_of(ids, links), dict.fromkeys(ids, 0)
    for a, b in links:
        count[a], count[b] = count[a] + 1, count[b] + 1
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df).collect() if r["vec_id"] is not None}
    assert len(links) > 200
    assert {i: r["n_links"] for i, r in got.items()} == count
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert vectors.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [False, True])
def test_nearest(spark, scale):
    _, df = cluster_table(spark)
    df = df.where("vec_id is null or vec_id not in (1006, 1007)")
    if scale:
        df = df.withColumn("embedding", F.transform("embedding", lambda x: x * (1 + F.col("vec_id") % 7)))
    fit = {r["vec_id"]: np.array(r["embedding"]) for r in df.where("vec_id < 1000").collect()}
    got = {}
    for r in vectors.nearest(df, F.col("id") % 20 == 0, k=5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    found = total = 0
    for q in (i for i in fit if i % 20 == 0):
        best = sorted(((-float(fit[q] @ v), i) for i, v in fit.items() if i != q and len(v) == len(fit[q])))[:5]
        own = [got[q][k] for k in range(1, 6)]
        assert all(abs(s - float(fit[q] @ fit[i])) < 1e-9 for i, s in own)
        assert [(-s, i) for i, s in own] == sorted((-s, i) for i, s in own)
        found, total = found + len({i for _, i in best} & {i for i, _ in own}), total + 5
    assert found / total >= 0.9
    assert 1000 not in got and vectors.nearest(df.limit(0), F.lit(True)).count() == 0


def test_nearest_returns_all_of_few(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(4)], "vec_id long, embedding array<float>")
    rows = vectors.nearest(df, F.col("id") == 0, k=20).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in rows] == [(1, 3), (2, 2), (3, 1)]


def test_rotations_keep_lengths_and_meet():
    x = np.random.default_rng(1).normal(size=(50, 64))
    assert np.allclose(np.linalg.norm(crosspolytope.rotated(x, 3), axis=1), np.linalg.norm(x, axis=1))
    h = crosspolytope.hadamard(np.eye(8)) * np.sqrt(8)
    assert np.allclose(h @ h.T, 8 * np.eye(8)) and set(np.unique(h.round())) == {-1.0, 1.0}
    assert crosspolytope.meeting_chance(64, 1, 4, 0.93) > 0.9 > 0.2 > crosspolytope.meeting_chance(64, 1, 4, 0.0)


# --- classifiers ---


def test_quality_learns_outside_the_held_out_rows(small_docs, labels, odd_docs, no_docs):
    rows = quality.classify(small_docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.85
    odd = quality.classify(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.classify(no_docs, labels).count() == 0
    assert {r["score"] for r in quality.classify(odd_docs, labels.limit(0)).collect()} == {0.5}


def test_quality_density_is_the_mahalanobis_one():
    rng = np.random.default_rng(0)
    d = len(quality.NAMES)
    x, s = rng.normal(size=(4, d)), np.cov(rng.normal(size=(d, 200)))
    factor = np.linalg.inv(np.linalg.cholesky(s))
    model = quality.Model([np.zeros(d), np.ones(d)], [factor] * 2, [0.0] * 2, 0.0, 0.5)
    margin = [(-0.5 * (v - 1) @ np.linalg.solve(s, v - 1) + 0.5 * v @ np.linalg.solve(s, v)) / d for v in x]
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(-np.array(margin))))


def test_network_gradients():
    net = toxicity.Network(["ab", "cd"], 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    gates, ids = rng.normal(size=(9, 6 * toxicity.HIDDEN)), rng.integers(0, 9, (5, toxicity.WINDOW))
    y = np.array([0, 1, 1, 0, 1.0])

    def loss():
        z = net.forward(gates, ids)
        return np.mean(np.logaddexp(0, z) - y * z)

    trace: dict = {}
    z = net.forward(gates, ids, trace)
    grad, _ = net.backward((1 / (1 + np.exp(-z)) - y) / 5, trace)
    for name, g in grad.items():
        flat, at = net.p[name].reshape(-1), net.p[name].size // 2
        kept = flat[at]
        flat[at] = kept + 1e-3
        up = loss()
        flat[at] = kept - 1e-3
        down, flat[at] = loss(), kept
        assert abs((up - down) / 2e-3 - np.asarray(g).reshape(-1)[at]) < 1e-5, name


def test_windows_cover_every_word():
    for n in (0, 1, toxicity.WINDOW, toxicity.WINDOW + 1, 333):
        rows = toxicity.window_rows(list(range(1, n + 1)))
        assert rows.shape[1] == toxicity.WINDOW and set(rows.ravel()) - {0} == set(range(1, n + 1))


@pytest.fixture(scope="module")
def toxic_corpus(spark):
    rng, rows = np.random.default_rng(8), []
    for i in range(400):
        words = ["".join(rng.choice(["an", "er", "th", "on", "li"], 3)) for _ in range(int(rng.integers(5, 120)))]
        if i % 2:
            words[int(rng.integers(len(words)))] = f"zorgl{'abcdef'[i % 6]}{i % 7}"
        rows.append((i, " ".join(words), i % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def test_toxicity_learns_outside_the_held_out_rows(toxic_corpus, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 60)
    docs, marks = toxic_corpus
    rows = toxicity.classify(docs, marks).join(marks, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.9
    odd = toxicity.classify(odd_docs, marks.limit(0)).collect()
    assert len(odd) == odd_docs.count() and {r["score"] for r in odd} == {0.5}
    assert toxicity.classify(no_docs, marks).count() == 0


def test_network_scores_odd_texts(odd_docs):
    scorer = toxicity.Scorer(toxicity.Network(["one"], 1))
    texts = [r["text"] or "" for r in odd_docs.collect()]
    both = scorer.score(texts)
    assert both.shape == (len(texts),) and ((both > 0) & (both < 1)).all()
    assert np.allclose(both, [scorer.score([t])[0] for t in texts], atol=1e-5)


@pytest.mark.parametrize("sign", ["", "_", "/", "\u3002"])
def test_toxic_word_late_in_a_run_without_spaces(toxic_corpus, monkeypatch, sign):
    monkeypatch.setattr(toxicity, "STEPS", 60)
    rows = toxic_corpus[0].join(toxic_corpus[1], "doc_id").orderBy("doc_id").collect()
    scorer = toxicity.Scorer(toxicity.train([r["text"] for r in rows], [r["toxic"] for r in rows]))
    calm = ["aneron", "therli", "onanth", "lilian", "ererth", "thonan"] * 4
    for at in (2, 14, 23):
        harsh = [*calm[:at], "zorgla3", *calm[at + 1 :]]
        low, high = scorer.score([sign.join(calm), sign.join(harsh)])
        assert low < 0.5 < high, (sign, at, low, high)


def test_every_character_of_a_long_run_is_in_a_place():
    for n in (65, 71, 72, 73, 500):
        run = "".join(chr(0x4E00 + i) for i in range(n))
        places = toxicity.places_of(run)
        assert set("".join(places)) == set(run) and max(map(len, places)) <= toxicity.LONGEST
        assert len(toxicity.Words().ids(f"a {run} b")) == len(places) + 2


# --- pipeline ---


def test_pipeline_stages_take_effect(spark, small_docs, sf_dir, labels):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "minhash_near_dedup", "best_fit_packing"]
    docs = small_docs
    calm = corpus_pipeline.not_toxic(spark, docs, sf_dir)
    want = {r["doc_id"] for r in toxicity.classify(docs, labels).where("predicted = 0").collect()}
    assert calm.columns == docs.columns and {r["doc_id"] for r in calm.collect()} == want
    good = corpus_pipeline.of_quality(spark, docs, sf_dir)
    want = {r["doc_id"] for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == want
    sole = corpus_pipeline.without_near_copies(spark, docs, sf_dir)
    _, links = check_near(docs, 5)
    want = {i for i, c in groups_of({r["doc_id"] for r in docs.collect()}, links).items() if i == c}
    assert sole.columns == docs.columns and {r["doc_id"] for r in sole.collect()} == want
    out = corpus_pipeline.packed(spark, sole, sf_dir)
    assert {r["doc_id"] for r in out.collect()} == want


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item string, label string, block int"


def run_on(spark, folder, rows, labelled=()):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labelled), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_pipeline_on_odd_rows_without_labels(spark, odd_docs, tmp_path):
    """Nulls, ties, copies and clashing columns; without labels no classifier rejects anything."""
    rows = [(r["doc_id"], r["text"], None, "s", None, "clash", "clash", 1) for r in odd_docs.collect()]
    out = run_on(spark, tmp_path, rows)
    sets = {i: shingle_set(t, 5) for i, t, *_ in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = {i for i, c in groups_of(sets, links).items() if i == c} | {None}
    assert {r["doc_id"] for r in out} == want
    used = {}
    for r in out:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        ends = [0, *np.cumsum([n for _, n in sorted(places)]).tolist()]
        assert [at for at, _ in sorted(places)] == ends[:-1] and ends[-1] <= 1024


def test_pipeline_on_an_empty_table(spark, tmp_path):
    assert run_on(spark, tmp_path, []) == []
