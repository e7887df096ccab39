"""Chat, BPE, packing, license scans and language model against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from portfolia.llm import bpe, chat, license, lm, packing, queries
from portfolia.llm.common import remainder

WORD_BPE, BYTE_BPE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# --- chat ---


@pytest.mark.parametrize("text", ["plain", "", "</s>[INST] ok [/INST]", "<s>", "\\", "\\<s>\\\\", "[/INST]", " [/INST]",
                                  "a</s", "<<s>", "line\nbreak </s>\n<s>[INST] 1 user [/INST]x"])
def test_chat_round_trip(spark, text):
    rows = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text), (1, 2, text, "after")],
                                 "conv_id long, turn long, role string, text string")
    got = chat.read_chat(chat.format_chat(rows)).first()
    assert [(t["role"], t["text"]) for t in got["turns"]] == [("user", text), ("assistant", text), (text, "after")]
    assert got["masked"] == [text]


def test_chat_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, block string, turns string"
    rows = [(1, None, "user", "first", "x", "y"), (1, 0, None, None, "x", "y"), (1, 0, "assistant", "b", "x", "y"),
            (1, 0, "assistant", "b", "x", "y"), (1, 500, "assistant", "far", "x", "y"), (None, 0, "user", "z", "x", "y")]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chat(spark.createDataFrame(rows, schema))).collect()}
    said = "user\nfirst\n" + "\n\n" + "assistant\nb\n" * 2 + "assistant\nfar\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[None]["n_turns"]) == (5, 5, 1)
    assert chat.digests(chat.format_chat(spark.createDataFrame([], schema))).count() == 0


# --- BPE ---


@pytest.fixture(scope="module")
def word_bpe():
    with open(WORD_BPE, "rb") as f:
        return bpe.ForcedBoundaryBPE(f.read()), Tokenizer.from_file(WORD_BPE)


@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.characters(max_codepoint=0x24F) | st.sampled_from("'s漢字é\U0001F600 \n\t"), max_size=40))
def test_bpe_equals_library(word_bpe, text):
    own, library = word_bpe
    want = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want
    assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_bpe_equals_library_on_all_code_points(word_bpe):
    """Every code point beside its neighbours, and random strings of marks and letters, assigned or not."""
    own, library = word_bpe
    rng = random.Random(7)
    points = [c for c in range(0x20, 0x32000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, points[i : i + 24])) for i in range(0, len(points), 24)]
    marks = [c for c in points if unicodedata.combining(chr(c))]
    texts += ["".join(chr(rng.choice(rng.choice((points, marks, range(0x41, 0x250))))) for _ in range(8)) for _ in range(4000)]
    for text in texts:
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_bpe_cuts_change_nothing(word_bpe):
    own, _ = word_bpe
    for word in ("strength", "ääßbc", "x" * 500, "naïveté"):
        symbols = [own.alphabet[b] for b in word.encode()]
        symbols[-1] += own.suffix
        assert [i for f in own.cuts(symbols) for i in own._merge(f)] == own._merge(symbols)


def test_bpe_odd_rows(odd_docs, no_docs, word_bpe):
    _, library = word_bpe
    got = bpe.encode_texts(odd_docs, WORD_BPE).join(odd_docs.select("doc_id", "text").distinct(), "doc_id").collect()
    for r in got:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_texts(odd_docs, WORD_BPE, digests_only=True).count() == odd_docs.count()
    assert bpe.encode_texts(no_docs, WORD_BPE).count() == 0


# --- packing ---


@settings(max_examples=80, deadline=None)
@given(text=st.lists(st.sampled_from([*"aB1é#漢'. ", "\t", " ", "\n", "'s", " x", " y"]), max_size=30).map("".join))
def test_chunk_tokenizer_equals_library(byte_bpe, text):
    own, library = byte_bpe
    assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def byte_bpe():
    with open(BYTE_BPE, "rb") as f:
        return packing.ChunkTokenizer(f.read()), Tokenizer.from_file(BYTE_BPE)


def check_packing(rows, texts, library, capacity=1024):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc_id, own in by_doc.items():
        if texts.count((doc_id, dict(texts)[doc_id])) > 1:
            continue
        ids = library.encode(dict(texts)[doc_id] or "", add_special_tokens=False).ids + [2]
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r["piece"])):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part))
            assert r["length"] == capacity or k == 0
            at += r["length"]
        assert at == len(ids)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_is_whole_and_tight(small_docs, byte_bpe):
    rows = packing.pack(packing.pieces_of(small_docs, BYTE_BPE)).collect()
    n = check_packing(rows, [(r["doc_id"], r["text"]) for r in small_docs.collect()], byte_bpe[1])
    least = math.ceil(sum(r["length"] for r in rows) / 1024)
    half = sum(r["length"] > 512 for r in rows)
    assert n <= max(least, half) * 1.02 + 1


def test_packing_odd_rows(odd_docs, no_docs, byte_bpe):
    rows = packing.pack(packing.pieces_of(odd_docs, BYTE_BPE)).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in odd_docs.collect()], byte_bpe[1])
    assert sum(r["piece"] == 0 for r in rows) == odd_docs.count()
    assert packing.pack(packing.pieces_of(no_docs, BYTE_BPE)).count() == 0


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(3)
    length = rng.integers(1, 1024, 400)
    a, b = (packing.greedy(length, rng.permutation(400), 1024) for _ in range(2))
    child = packing.crossover(a, b, length, rng, 1024)
    assert len(child) == 400 and child.min() >= 0 and packing.fills(child, length).max() <= 1024
    best = packing.evolve(length, [a, b], 1, 1024)
    assert packing.fitness(best, length, 1024) >= max(packing.fitness(x, length, 1024) for x in (a, b))


# --- licenses ---


def test_patience_is_an_alignment():
    a, b = "the quick brown fox jumps over the dog".split(), "a quick red fox the jumps over over the dog".split()
    got = license.patience(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
    assert [a[i] for i, _ in got] == "quick fox jumps over the dog".split()


def test_license_scan_against_plain_search(small_docs):
    want = Counter()
    for r in small_docs.collect():
        for name, notice in license.TEMPLATES.items():
            want[name] += (r["text"] or "").lower().count(notice.lower().rstrip("."))
    got = Counter(r["license"] for r in license.scan_texts(small_docs).where("license is not null").collect())
    assert got == +want and sum(got.values()) > 0


def test_license_scan_odd_rows(spark, odd_docs, no_docs):
    got = license.scan_texts(odd_docs)
    assert got.count() == odd_docs.count() and got.where("license is not null").count() == 0
    assert license.scan_texts(no_docs).count() == 0
    mit = license.TEMPLATES["MIT-text"]
    texts = ["x " * 5000 + mit.upper().replace(",", "") + " y" * 5000, mit.replace("free of charge", "gratis"),
             "Released under the MIT License. Released under the MIT License.", "under the license " * 2000,
             "Released under the BSD License."]
    rows = license.scan_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["license"]) for r in rows) == Counter(
        {(0, "MIT-text"): 1, (1, "MIT-text"): 1, (2, "MIT"): 2, (3, None): 1, (4, None): 1})
    assert next(r for r in rows if r["doc_id"] == 0)["coverage"] == 1


def test_adjoining_notices_are_told_apart():
    """Every ordered pair of the longer texts, one right after the other, and three in a row."""
    long = [n for n, t in license.TEMPLATES.items() if len(license.words_of(t)[0]) >= license.LONG]
    for a, b in itertools.permutations(long, 2):
        text = license.TEMPLATES[a] + "\n" + license.TEMPLATES[b]
        assert [h[0] for h in license.scan(text, license.TEMPLATES)] == [a, b]
    row = ["MIT-full", "ISC", "BSD-2-Clause"]
    assert [h[0] for h in license.scan("\n".join(license.TEMPLATES[n] for n in row), license.TEMPLATES)] == row


@pytest.mark.parametrize("text", ["Released under the BSD License, unlike the MIT License.", "All other rights are reserved.",
                                  "Licensed under the old terms of the Apache foundation, not its License, Version 2.0."])
def test_strange_words_count_against_a_notice(text):
    assert license.scan(text, license.TEMPLATES) == []


def test_license_scan_knows_common_texts():
    head = "Copyright (c) 2019, Jane Doe.\nAll rights reserved.\n\n"
    for name, text in license.TEMPLATES.items():
        if len(license.words_of(text)[0]) >= license.LONG:
            found = license.scan("word " * 300 + head + text + " word" * 300, license.TEMPLATES)
            assert [(h[0], h[4]) for h in found] == [(name, 1.0)]
    for name in ("BSD-2-Clause", "BSD-3-Clause", "GPL-3.0-or-later", "GPL-3.0-only"):
        altered = license.TEMPLATES[name].replace("the copyright holder nor", "Acme Inc nor").replace(
            "HOLDER OR", "OWNER OR").replace("This program is free", "Acme is free")
        assert [h[0] for h in license.scan(head + altered, license.TEMPLATES)] == [name]
    far = "All rights reserved." + " word" * 50 + license.TEMPLATES["ISC"]
    assert [h[0] for h in license.scan(far, license.TEMPLATES)] == ["proprietary", "ISC"]


# --- language model ---


def reference_scores(rows, mu, order):
    """Dirichlet-smoothed n-grams by their formula, every probability from the counts of its whole histories."""
    tokens = [(i, WORDS.findall((t or "").translate(LOWER)) + ["\0"]) for i, t in rows]
    kept = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for i, _ in rows]
    pad = ("\1",) * (order - 1)
    c = Counter()
    for (_, w), k in zip(tokens, kept, strict=True):
        if k:
            padded = [*pad, *w]
            c.update(tuple(padded[i - n : i + 1]) for i in range(len(pad), len(padded)) for n in range(order))
    single = {g[0]: x for g, x in c.items() if len(g) == 1}
    n, v, docs = sum(single.values()), len(single), sum(kept)
    out = []
    for i, w in tokens:
        base = score = 0.0
        padded = (*pad, *w)
        for at in range(len(pad), len(padded)):
            p = (single.get(padded[at], 0) + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            for k in range(1, order):
                history = padded[at - k : at]
                seen = docs if set(history) == {"\1"} else c[history]
                p = (c[padded[at - k : at + 1]] + mu * p) / (seen + mu)
            score += math.log10(p)
        out.append((-1 if i is None else i, len(w), sum(x in single for x in w), n, round(base, 6), round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize(("kind", "order"), [("odd", 1), ("odd", 2), ("odd", 4), ("small", 2), ("small", 3)])
def test_lm_against_brute_force(kind, order, odd_docs, small_docs, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 50_000)
    monkeypatch.setattr(lm, "PART_BYTES", 90_000)
    docs = odd_docs if kind == "odd" else small_docs
    got = lm.score(docs, remainder("doc_id", 5) != 1, order=order).collect()
    own = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"],
                  round(r["base_score"], 6), round(r["score"], 6)) for r in got)
    want = reference_scores([(r["doc_id"], r["text"]) for r in docs.collect()], lm.MU, order)
    assert [r[:4] for r in own] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in own], [r[4:] for r in want], rtol=1e-9, atol=1e-5)


def test_automaton_has_states_failure_arcs_and_one_walk():
    """Order 3: the failure arcs of every state lead to the root, and a walk visits the states told by its arcs."""
    texts = pa.array(["a b c a b d", "a b", "x a b c"], pa.string())
    grams = lm.Grams(texts, 3)
    totals = grams.counts(np.array([1, 1, 0]))
    machine = lm.Automaton(grams, totals, 9, 5, 2, 10.0)
    for state in range(len(machine.fail)):
        steps = 0
        while state:
            assert machine.length[machine.fail[state]] == machine.length[state] - 1
            state, steps = machine.fail[state], steps + 1
        assert steps <= 2
    assert np.isnan(machine.arc_weight[2]).sum() == 4 and not np.isnan(machine.arc_weight[0]).any()
    assert len(machine.traverse()) == 3 and (machine.traverse() < 0).all()


def test_lm_without_rows_or_training(odd_docs, no_docs):
    assert lm.score(no_docs, F.lit(True)).count() == 0
    none = lm.score(odd_docs, F.lit(False)).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in none} == {(0, 0, 0.0, 0.0)}


def test_registered_names():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
