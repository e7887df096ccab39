"""Merkle manifest, quality rules and importance resampling against plain Python on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from portfolia.llm import common, merkle, resample, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- importance resampling ---


def features(text, order):
    w = FEATURE.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + n]).encode() for n in range(1, order + 1) for i in range(len(w) - n + 1)], len(w)


@pytest.mark.parametrize("order", [1, 3])
def test_table_of_ngrams(order):
    """Spans, hashes, slots, buckets and counts of short, long, odd and equal n-grams; and colliding keys."""
    rng = random.Random(3)
    sizes = [1, 3, 4, 7, 8, 9, 15, 16, 31, 32, 33, 64, 65, 255, 256, 257, 400]
    words = ["".join(rng.choices("abcXYZ09éß漢 ", k=rng.choice(sizes))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) + rng.choice(["", "-", "\x00z"]) for _ in range(90)]
    texts += [None, "", "...", "A", "x" * 3000]
    spans = resample.spans_of(pa.array(texts, pa.string()), order)
    table = resample.Table(spans, 10_000)
    raw = spans.data.tobytes()
    grams = [raw[a : a + n] for a, n in zip(spans.start, spans.size, strict=True)]
    for i, t in enumerate(texts):
        want, n_words = features(t, order)
        own = grams[spans.ends[i] : spans.ends[i + 1]]
        assert sorted(own) == sorted(want) and spans.n_words[i] == n_words
    assert resample.xxhash64(spans.data, spans.start, spans.size).tolist() == [xxhash.xxh64_intdigest(g) for g in grams]
    slots = dict(zip(grams, table.slots.tolist(), strict=True))
    assert len(set(slots.values())) == len(slots)
    count = Counter(grams)
    assert all(table.bucket[s] == zlib.crc32(g) % 10_000 and table.count[s] == count[g] for g, s in slots.items())


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    monkeypatch.setattr(resample, "xxhash64", lambda data, start, size: size.astype("uint64") * 0 + 7)
    spans = resample.spans_of(pa.array(["a b c a", "b dd c ee"]), 1)
    table = resample.Table(spans, 100)
    assert [table.count[s] for s in table.slots] == [2, 2, 2, 2, 2, 1, 2, 1]


def check_resample(docs, target, order=1, least=3, percent=40, buckets=50):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    source = Counter(zlib.crc32(f) % buckets for _, t in rows for f in features(t, order)[0])
    wanted = Counter(zlib.crc32(f) % buckets for r in target.collect() for f in features(r["text"], order)[0])
    big_s, big_t = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log(((wanted[b] + 1) * (big_s + buckets)) / ((source[b] + 1) * (big_t + buckets))))
            for b in range(buckets)]
    out = []
    for i, t in rows:
        own, n_words = features(t, order)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in own) // len(own) if own else 0
        h = int(sha(f"2024:{'' if i is None else i}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(own), weight, score, None, n_words >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for n, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = n
    got = resample.resample(docs, target, order, buckets, percent, least)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[:5])) for r in out)
    return out


def test_resampling(spark, odd_docs, no_docs):
    target = spark.createDataFrame([(None, 1), ("a b c word", 2), ("two Three", 3)], "text string, doc_id int")
    for order in (1, 2):
        assert sum(r[4] is not None for r in check_resample(odd_docs, target, order)) == 4
    check_resample(odd_docs, target.limit(0))
    assert resample.resample(no_docs, target).count() == 0
    assert {r["rank"] for r in resample.resample(odd_docs, target, percent=0).collect()} == {None}


def test_many_copies_are_drawn_at_ranks_of_their_own(spark):
    docs = spark.createDataFrame([(7, "a b c d")] * 60 + [(i, f"a b c {i}") for i in range(40)], "doc_id long, text string")
    out = check_resample(docs, docs.limit(1), percent=70)
    assert sorted(r[4] for r in out if r[4]) == list(range(1, 71))


def test_numbering_over_tasks(spark):
    df = spark.range(0, 2000, 1, 7).selectExpr("id % 13 as k", "id % 3 as _tie", "id")
    got = common.numbered(df, [F.desc("k")], "place").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(2000)) and [r["k"] for r in got] == sorted((r["k"] for r in got), reverse=True)


# --- manifest ---


def tree(nodes, arity):
    """Levels of a tree of digests, from the leaves to the one root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + arity])) for i in range(0, len(last), arity)])
    return levels


def fold(levels, i, h, arity, proof):
    for level in levels[:-1]:
        run = level[i - i % arity : i - i % arity + arity]
        proof += run[: i % arity] + run[i % arity + 1 :]
        h = sha("".join([*run[: i % arity], h, *run[i % arity + 1 :]]))
        i //= arity
    return h


def leaf(row, text):
    values = [*row[:4], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def check_manifest(df, arity):
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    rows = [tuple(r) for r in df.select(*names).collect()]
    groups: dict = {}
    for r in rows:
        harmed = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0
        now = leaf(r, r[4].replace("\n", "") if harmed and r[4] is not None else r[4])
        groups.setdefault(r[1], []).append((-1 if r[0] is None else r[0], leaf(r, r[4]), r[0], now))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[1] for x in sorted(groups[g], key=lambda x: x[:2])], arity) for g in order}
    top = tree([trees[g][-1][0] for g in order], arity) if order else None
    want = []
    for at, g in enumerate(order):
        for i, (_, own, doc, now) in enumerate(sorted(groups[g], key=lambda x: x[:2])):
            proof: list[str] = []
            h = fold(top, at, fold(trees[g], i, now, arity, proof), arity, proof)
            want.append((doc, own, trees[g][-1][0], top[-1][0], sha("".join(proof)), h, h == top[-1][0]))
    got = merkle.manifest(df, arity)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    return want


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest(spark, odd_docs, arity):
    """Groups of 1 to 30 rows, a null group, null and repeated ids, equal rows, columns that clash."""
    extra = spark.createDataFrame([(i, f"line {i}\nnext\n") for i in range(100, 150)] + [(100, "line 100\nnext\n")] * 2,
                                  "doc_id long, text string")
    df = odd_docs.unionByName(extra, allowMissingColumns=True).withColumns({
        "source": F.when(F.col("doc_id") < 4, "é").when(F.col("doc_id") < 8, "z").when(F.col("doc_id") == 9, "alone")
                   .when(F.col("doc_id") < 130, "big").when(F.col("doc_id") == 140, ""),
        "lang": F.when(F.col("doc_id") % 2 == 0, "en"), "n_chars": F.length("text"),
        **{c: F.lit("clash") for c in ("i", "h", "tree", "path", "leaf", "now", "g", "_tie", "place")}})
    want = check_manifest(df, arity)
    assert {r[6] for r in want} == {True, False}


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    for rows in ([], [(1, "s", None, 3, "a\nb")], [(1, "s", None, 3, "a\nb"), (2, None, "en", None, None)],
                 [(i, "s", "x", i, "t") for i in range(4)]):
        check_manifest(spark.createDataFrame(rows, schema), 3)


# --- rules ---


def check_rules(df):
    got = {}
    for r in rules.judge(df).collect():
        got.setdefault((r["doc_id"], r["n_words"], r["word_chars"]), r)
    n = 0
    for r in df.select("doc_id", "text").collect():
        t = r["text"] or ""
        w = WORD.findall(t)
        windows = list(zip(w, w[1:], w[2:], strict=False))
        often = Counter(windows)
        repeated = {i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        g = got[(r["doc_id"], len(w), sum(map(len, w)))]
        assert g["n_symbols"] == sum(t.count(c) for c in "#*$%&|<>")
        assert g["n_dup_lines"] == len(lines) - len(set(lines)) and g["n_lines"] == len(lines)
        assert g["n_repeat_words"] == len(repeated)
        assert g["base_failed"] == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert not (g["kept"] and g["base_failed"])
        n += 1
    assert rules.judge(df).count() == n


def test_rules(spark, odd_docs, no_docs):
    rng = random.Random(5)
    words = ["the", "of", "le", "und", "a", "#", "b|c", "x y", "\U0001F600", "...", "Long"]
    rows = [(100 + i, "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", "\r\n"])
                              for _ in range(rng.randint(0, 130)))) for i in range(60)]
    rows += [(200, "same line\n" * 70), (201, "a b " * 30), (202, " ".join(f"w{i}" for i in range(5000)) + " w0 w1 w2")]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    check_rules(odd_docs.unionByName(more, allowMissingColumns=True))
    assert rules.judge(no_docs).count() == 0


def test_each_rule_alone_rejects(spark):
    good = " ".join(f"the word{chr(97 + i % 26)}{chr(97 + i // 26)} of" for i in range(40))
    lines = [f"u{chr(97 + i % 26)}{i // 26} {'the' if i % 2 else 'of'} v{chr(97 + i % 26)}{i // 26}" for i in range(40)]
    bad = {
        "symbols to words": good + " #" * 20, "mean word length": good + " " + "x" * 2000,
        "stop words": " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(99)),
        "words with a letter": good + "".join(f" {i}" for i in range(100, 150)),
        "repeated lines": "\n".join(f"{line}\nsome\nsome" for line in lines),
        "lines that end in an ellipsis": "\n".join(line + "..." for line in lines),
        "lines that begin with a bullet": "\n".join("-" + line for line in lines)}
    df = spark.createDataFrame([("good", good), *bad.items()], "doc_id string, text string")
    got = {r["doc_id"]: r for r in rules.judge(df).collect()}
    assert got["good"]["kept"] and not any(got[k]["kept"] or got[k]["base_failed"] for k in bad)
