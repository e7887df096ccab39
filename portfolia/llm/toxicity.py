"""Toxicity by a bidirectional gated recurrent network with attention pooling, written in numpy.

Input of a place: the embedding of its word (lower case, outer signs stripped; words outside the learnt
vocabulary have none) plus the mean embedding of its character 3- to 5-grams, which are hashed. A run of more
than ``LONGEST`` characters without white space is no single place: its parts between signs, where it has any,
and pieces of ``PIECE`` characters of all of it, one every ``STEP``, are places of their own. Two gated recurrent passes run over a window of ``WINDOW`` words, attention pools their states, and one output unit
gives the window's log-odds. Windows start every ``STRIDE`` words, half a window, until the last word is covered, so
every passage of up to as many words is whole in one; the text's score is that of its highest window.

Training is multiple-instance: a toxic document answers for its highest window, another one for its highest
and for a random window. It reads at most ``TRAIN_DOCS`` labelled documents of each class, those with the
smallest id hash among labelled texts of up to ``TRAIN_CHARS`` characters; scoring has no such bounds.

Rows: null text counts as empty; an empty text is one window without words and gets a defined score; repeated
rows are scored alike; a null id meets no label. With no labels of one class, every score is the share of
label 1 (0.5 without labels). Other columns are unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portfolia.llm import common
from portfolia.llm.quality import training_rows

WINDOW, STRIDE = 32, 16
TRAIN_DOCS, TRAIN_CHARS = {0: 5000, 1: 2500}, 8000
SIZE, HIDDEN, ATTEND = 12, 8, 8
GRAM_BUCKETS, VOCABULARY, LEAST_DOCS = 1 << 15, 8000, 4
STEPS, BATCH, RATE, DROPPED = 160, 256, 0.01, 0.5
KNOWN_WORDS = 200_000
BLOCK = 4096
LONGEST, PIECE, STEP = 64, 8, 2
_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_BETWEEN = re.compile(r"[\W_]+")


def spelling(word: str) -> str:
    return word.strip(_SIGNS) or word


def places_of(run: str) -> list[str]:
    """The places of a run longer than ``LONGEST``; every ``PIECE - STEP + 1`` neighbouring characters share one."""
    parts = [p for p in _BETWEEN.split(run) if 0 < len(p) <= LONGEST]
    return parts + [run[i : i + PIECE] for i in range(0, len(run) - PIECE + STEP, STEP)]


def gram_lists(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character 3- to 5-grams (bytes, with word bounds) of many words, and their n + 1 offsets."""
    raw = np.frombuffer(b"".join(b"<" + w.encode() + b">" for w in words), np.uint8).astype(np.uint64)
    size = np.array([len(w.encode()) + 2 for w in words], np.int64)
    ends = np.cumsum(size)
    left = np.repeat(ends, size) - np.arange(len(raw))
    three = np.zeros(len(raw), np.uint64)
    for k in range(3):
        three += np.roll(raw, -k) * common._POWERS[k + 1]
    four = three + np.roll(raw, -3) * common._POWERS[7]
    five = four + np.roll(raw, -4) * common._POWERS[11]
    both = np.stack([common.mix(three), common.mix(four), common.mix(five)], axis=1) % np.uint64(GRAM_BUCKETS)
    keep = np.stack([left >= 3, left >= 4, left >= 5], axis=1)
    keep[ends - size, 0] |= size < 3
    counts = np.add.reduceat(keep.sum(axis=1), ends - size) if len(words) else np.zeros(0, np.int64)
    return both[keep].astype(np.int64), np.concatenate([[0], np.cumsum(counts)])


def starts_of(n: int) -> list[int]:
    """Where the windows of a text of n words start; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


class Words:
    """Numbers for words as they come, and what a model computes once for each of them."""

    def __init__(self):
        self.number = _Numbers()

    def ids(self, text: str) -> list[int]:
        words = text.lower().split()
        ids = [*map(self.number.__getitem__, words)]
        if _TOO_LONG in ids:
            places = (places_of(w) if n == _TOO_LONG else [w] for w, n in zip(words, ids, strict=True))
            ids = [self.number[p] for own in places for p in own]
        return ids


_TOO_LONG = -1


class _Numbers(dict):
    """Number 0 stands for no word. ``spelt`` lists the spelling of each number; longer runs have none."""

    def __init__(self):
        super().__init__()
        self.spelt = [""]

    def __missing__(self, word: str) -> int:
        if len(word) > LONGEST:
            return _TOO_LONG
        self[word] = n = len(self.spelt)
        self.spelt.append(spelling(word))
        return n


def window_rows(ids: list[int]) -> np.ndarray:
    """The windows of one text as rows of word numbers, padded with 0."""
    if len(ids) <= WINDOW:
        return np.array([ids + [0] * (WINDOW - len(ids))], np.int32)
    flat = np.array(ids, np.int32)
    return flat[np.array(starts_of(len(ids)))[:, None] + np.arange(WINDOW)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters and passes. Gate order in every 3 x HIDDEN block: update, reset, candidate."""

    def __init__(self, vocabulary: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        def normal(*shape):
            return (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.row = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.p = {
            "word": 0.1 * rng.normal(size=(len(vocabulary) + 1, SIZE)).astype(np.float32),
            "gram": 0.1 * rng.normal(size=(GRAM_BUCKETS, SIZE)).astype(np.float32),
            "in_f": normal(SIZE, 3 * HIDDEN), "in_b": normal(SIZE, 3 * HIDDEN),
            "bias_f": np.zeros(3 * HIDDEN, np.float32), "bias_b": np.zeros(3 * HIDDEN, np.float32),
            "up_f": normal(HIDDEN, 3 * HIDDEN), "up_b": normal(HIDDEN, 3 * HIDDEN),
            "att": normal(2 * HIDDEN, ATTEND), "att_bias": np.zeros(ATTEND, np.float32), "att_out": normal(ATTEND),
            "out": normal(2 * HIDDEN), "out_bias": np.zeros(1, np.float32)}
        self.p["word"][0] = 0

    # --- inputs ----------------------------------------------------------------------------------

    def features(self, words: list[str], piece: int = 50_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vocabulary rows, grams and the offsets of each word's grams; made piece by piece to bound memory."""
        rows = np.array([self.row.get(w, 0) for w in words], np.int64)
        parts = [gram_lists(words[i : i + piece]) for i in range(0, len(words), piece)]
        sizes = np.concatenate([np.diff(ends) for _, ends in parts])
        return rows, np.concatenate([g.astype(np.int32) for g, _ in parts]), np.concatenate([[0], np.cumsum(sizes)])

    def inputs(self, rows: np.ndarray, grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One input vector per word, from its features."""
        x = self.p["word"][rows]
        for i in range(0, len(rows), 20_000):
            own = ends[i : i + 20_001]
            total = np.add.reduceat(self.p["gram"][grams[own[0] : own[-1]]], own[:-1] - own[0], axis=0)
            x[i : i + 20_000] += total / np.diff(own)[:, None]
        return x

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What the words give to the gates of both passes; row 0 of the numbering has no word."""
        p = self.p
        return np.concatenate([x @ p["in_f"] + p["bias_f"], x @ p["in_b"] + p["bias_b"]], axis=1)

    # --- passes ----------------------------------------------------------------------------------

    def _pass(self, g: np.ndarray, u: np.ndarray, here: np.ndarray, order, keep: list | None) -> np.ndarray:
        n, h = len(g), HIDDEN
        state = np.zeros((n, h), np.float32)
        out = np.empty((n, WINDOW, h), np.float32)
        for t in order:
            gt, back = g[:, t], state @ u
            zr = _sigmoid(gt[:, : 2 * h] + back[:, : 2 * h])
            z, r, c = zr[:, :h], zr[:, h:], back[:, 2 * h :]
            new = np.tanh(gt[:, 2 * h :] + r * c)
            z = z + (1 - z) * (1 - here[:, t, None])  # a place without a word leaves the state
            if keep is not None:
                keep.append((t, state, z, r, c, new))
            state = new + z * (state - new)
            out[:, t] = state
        return out

    def forward(self, gates: np.ndarray, ids: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """Log-odds of windows, given the gate table and the word numbers."""
        p, h = self.p, HIDDEN
        here = (ids > 0).astype(np.float32)
        keeps = ([], []) if trace is not None else (None, None)
        g = gates[ids]
        states = np.concatenate([
            self._pass(g[:, :, : 3 * h], p["up_f"], here, range(WINDOW), keeps[0]),
            self._pass(g[:, :, 3 * h :], p["up_b"], here, range(WINDOW - 1, -1, -1), keeps[1])], axis=2)
        seen = np.tanh(states @ p["att"] + p["att_bias"])
        weight = seen @ p["att_out"] - 1e4 * (1 - here)
        weight = np.exp(weight - weight.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", weight, states)
        if trace is not None:
            trace |= {"here": here, "states": states, "seen": seen, "weight": weight, "pooled": pooled, "keeps": keeps}
        return pooled @ p["out"] + p["out_bias"][0]

    def backward(self, d: np.ndarray, t: dict) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters behind the gate table, and of the gates of every place."""
        p, h, grad = self.p, HIDDEN, {}
        grad["out"], grad["out_bias"] = t["pooled"].T @ d, np.array([d.sum()], np.float32)
        d_pool = d[:, None] * p["out"]
        d_states = t["weight"][:, :, None] * d_pool[:, None]
        d_weight = np.einsum("nh,nth->nt", d_pool, t["states"])
        d_weight = t["weight"] * (d_weight - (t["weight"] * d_weight).sum(axis=1, keepdims=True))
        grad["att_out"] = np.einsum("nt,nta->a", d_weight, t["seen"])
        d_seen = d_weight[:, :, None] * p["att_out"] * (1 - t["seen"] ** 2)
        grad["att"] = np.einsum("nth,nta->ha", t["states"], d_seen)
        grad["att_bias"] = d_seen.sum(axis=(0, 1))
        d_states += d_seen @ p["att"].T
        d_gates = np.zeros((*t["here"].shape, 6 * h), np.float32)
        for side, (name, keep) in enumerate(zip(("up_f", "up_b"), t["keeps"], strict=True)):
            u, g_u, carry = p[name], np.zeros_like(p[name]), np.zeros((len(d), h), np.float32)
            for at, before, z, r, c, new in reversed(keep):
                dh = carry + d_states[:, at, side * h : (side + 1) * h]
                live = t["here"][:, at, None]
                d_new = dh * (1 - z) * (1 - new**2)
                raw_z = np.where(live > 0, z, 0)
                d_z = dh * (before - new) * raw_z * (1 - raw_z) * live
                d_r = d_new * c * r * (1 - r)
                d_up = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g_u += before.T @ d_up
                d_gates[:, at, side * 3 * h : (side + 1) * 3 * h] = np.concatenate([d_z, d_r, d_new], axis=1)
                carry = dh * z + d_up @ u.T
            grad[name] = g_u
        return grad, d_gates

    def update(self, grad: dict, sparse: dict, moments: dict, step: int) -> None:
        """One Adam step; ``sparse`` holds gradients of single rows, which may repeat."""
        for k, g in grad.items():
            _adam(moments[k], slice(None), self.p[k], g, step, RATE)
        for k, (rows, g) in sparse.items():
            at, back = np.unique(rows, return_inverse=True)
            total = np.zeros((len(at), SIZE), np.float32)
            np.add.at(total, back, g)
            _adam(moments[k], at, self.p[k], total, step, RATE / 2)
        self.p["word"][0] = 0


def _adam(moments: tuple, at, value: np.ndarray, g: np.ndarray, step: int, rate: float) -> None:
    m, v = moments
    m[at] = 0.9 * m[at] + 0.1 * g
    v[at] = 0.99 * v[at] + 0.01 * g * g
    value[at] -= rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-6)


def _log_odds(features: list[np.ndarray], label: np.ndarray, size: int) -> np.ndarray:
    """Smoothed log-odds of a document's being toxic per feature, given the distinct features of each document."""
    count = np.zeros((2, size), np.float32)
    for own, k in zip(features, label.astype(int), strict=True):
        count[k, own] += 1
    total = [max(float((label == k).sum()), 1.0) for k in (0, 1)]
    odds = np.log((count[1] + 1) / (total[1] + 2)) - np.log((count[0] + 1) / (total[0] + 2))
    return np.clip(odds, -4, 4) / 2


def train(texts: list[str], labels: list[int], seed: int = 7) -> Network:
    """Fit by Adam on the windows that answer for their documents, chosen anew in each epoch."""
    rng, words, label = np.random.default_rng(seed), Words(), np.array(labels, np.float32)
    rows = [window_rows(words.ids(t)) for t in texts]
    n_docs = len(rows)
    owner = np.repeat(np.arange(n_docs), [len(r) for r in rows])
    ids = np.concatenate(rows)
    spelt, kinds = np.unique(words.number.spelt, return_inverse=True)
    ids = (kinds + 1).astype(np.int32)[ids] * (ids > 0)  # one number per spelling
    spelt = ["", *spelt.tolist()]
    del words, rows[:]
    of_doc = [np.unique(r) for r in np.split(ids, np.flatnonzero(np.diff(owner)) + 1)]
    in_docs = np.bincount(np.concatenate(of_doc), minlength=len(spelt))
    often = [i for i in np.argsort(-in_docs, kind="stable")[: VOCABULARY + 1] if in_docs[i] >= LEAST_DOCS and spelt[i]]
    net = Network([spelt[i] for i in often], seed)
    net.p["word"][1:, 0] += _log_odds(of_doc, label, len(spelt))[often]
    row, grams, ends = net.features(spelt)
    per_word = np.diff(ends)
    in_doc = (np.unique(np.concatenate([grams[ends[w] : ends[w + 1]] for w in own])) for own in of_doc)
    net.p["gram"][:, 1] += 2 * _log_odds(in_doc, label, GRAM_BUCKETS)
    del in_doc, of_doc

    def inputs_of(pick: np.ndarray) -> tuple:
        """What a set of windows reads: its words, their grams, their numbers in the set, and mean gram vectors."""
        used, local = np.unique(ids[pick], return_inverse=True)
        at = np.concatenate([np.arange(ends[w], ends[w + 1]) for w in used])
        sizes = per_word[used]
        mean = np.add.reduceat(net.p["gram"][grams[at]], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        number = np.where(ids[pick] > 0, local.reshape(len(pick), WINDOW) + 1, 0)
        return used, at, sizes, number, mean

    def table_of(x: np.ndarray) -> np.ndarray:
        return net.gates(np.concatenate([np.zeros((1, SIZE), np.float32), x]).astype(np.float32))

    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    doc_start = np.searchsorted(owner, np.arange(n_docs))
    while step < STEPS:
        found = []
        for i in range(0, len(ids), BLOCK):
            used, _, _, number, mean = inputs_of(np.arange(i, min(i + BLOCK, len(ids))))
            found.append(net.forward(table_of(net.p["word"][row[used]] + mean), number))
        found = np.concatenate(found)
        order = np.lexsort((-found, owner))
        best = order[doc_start]
        extra = rng.integers(0, len(ids), n_docs)
        chosen = np.concatenate([best, extra[label[owner[extra]] == 0]])
        chosen = chosen[rng.permutation(len(chosen))]
        for i in range(0, len(chosen), BATCH):
            pick = chosen[i : i + BATCH]
            used, g_at, sizes, number, mean = inputs_of(pick)
            by_word = (rng.random(len(used)) >= DROPPED).astype(np.float32)[:, None]
            x = net.p["word"][row[used]] * by_word + mean
            x[used == 0] = 0
            trace: dict = {}
            z = net.forward(table_of(x), number, trace)
            y = label[owner[pick]]
            d = ((_sigmoid(z) - y) / len(pick)).astype(np.float32)
            grad, d_gates = net.backward(d, trace)
            per_row = np.zeros((len(used) + 1, d_gates.shape[2]), np.float32)
            np.add.at(per_row, number.ravel(), d_gates.reshape(-1, d_gates.shape[2]))
            d_word, h3 = per_row[1:], 3 * HIDDEN
            grad["in_f"], grad["in_b"] = x.T @ d_word[:, :h3], x.T @ d_word[:, h3:]
            grad["bias_f"], grad["bias_b"] = d_word[:, :h3].sum(axis=0), d_word[:, h3:].sum(axis=0)
            d_x = d_word[:, :h3] @ net.p["in_f"].T + d_word[:, h3:] @ net.p["in_b"].T
            d_x[used == 0] = 0
            d_gram = np.repeat(d_x / sizes[:, None], sizes, axis=0)
            sparse = {"word": (row[used], d_x * by_word), "gram": (grams[g_at], d_gram)}
            step += 1
            net.update(grad, sparse, moments, step)
    return net


class Scorer:
    """A network with its gate table for the words met so far; bounded, and begun anew when full."""

    def __init__(self, net: Network):
        self.net = net
        self.reset()

    def reset(self) -> None:
        self.words = Words()
        self.table = self.net.gates(np.zeros((1, SIZE), np.float32))

    def _fill(self) -> None:
        done, spelt = len(self.table), self.words.number.spelt
        if done < len(spelt):
            more = self.net.gates(self.net.inputs(*self.net.features(spelt[done:])))
            self.table = np.concatenate([self.table, more]).astype(np.float32)

    def score(self, texts: Iterator[str]) -> np.ndarray:
        """The highest window's probability of each text."""
        out: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        held = 0
        def flush():
            nonlocal rows, held
            if rows:
                self._fill()
                ids = np.concatenate(rows)
                z = np.concatenate([
                    self.net.forward(self.table, ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)])
                first = np.cumsum([0, *(len(r) for r in rows[:-1])])
                out.append(np.maximum.reduceat(z, first))
                rows, held = [], 0
            if len(self.words.number) > KNOWN_WORDS:
                self.reset()
        for text in texts:
            rows.append(window_rows(self.words.ids(text)))
            held += len(rows[-1])
            if held >= 4 * BLOCK:
                flush()
        flush()
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-z.astype(np.float64)))


def sample(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> list[tuple[str, int]]:
    """At most ``TRAIN_DOCS`` whole labelled texts of each class, those with the smallest id hash."""
    small = (docs.select(id_col, F.length(text_col).alias("chars")).where(F.col("chars") <= TRAIN_CHARS)
             .join(rows, id_col).select(id_col, "label", F.xxhash64(id_col).alias("h")).dropDuplicates([id_col]))
    ids = [small.where(F.col("label") == k).orderBy("h", id_col).limit(TRAIN_DOCS[k]) for k in (0, 1)]
    chosen = F.broadcast(ids[0].unionByName(ids[1]).select(id_col, "label", "h"))
    got = (docs.select(id_col, text_col).join(chosen, id_col)
           .groupBy(id_col).agg(F.min(text_col).alias("text"), F.first("label").alias("label"), F.first("h").alias("h"))
           .select("text", "label", "h").collect())
    return [(r["text"], r["label"]) for r in sorted(got, key=lambda r: (r["h"], r["text"]))]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0,
        id_col: str = "doc_id", text_col: str = "text") -> Network | float:
    """A trained network, or the share of label 1 where one class is missing."""
    rows = training_rows(labels, label, common.remainder(id_col, folds) != held, id_col)
    got = sample(docs, rows.where(F.col("label").isin(0, 1)), id_col, text_col)
    y = [k for _, k in got]
    if len(set(y)) < 2:
        return float(y[0]) if y else 0.5
    return train([t for t, _ in got], y)


def scores_of(model, state: dict):
    """A function from texts to scores; the network's word table lives as long as the task."""
    if isinstance(model, float):
        return lambda texts: np.array([model for _ in texts])
    if "scorer" not in state:
        state["scorer"] = Scorer(model)
    return state["scorer"].score


def accepted(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that a network learnt from them scores below one half.

    Without labels of both classes nothing can be told, and all documents stay.
    """
    model = fit(docs, labels, label, folds, held, id_col, text_col)
    if isinstance(model, float):
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep():
        state: dict = {}
        return lambda texts: scores_of(sent.value, state)(texts) < 0.5

    return common.rows_where(docs, text_col, keep)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every document; rows whose crc32 remainder is ``held`` lend no label."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, folds, held, id_col, text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            s = scores_of(sent.value, state)(t.as_py() or "" for t in batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))],
                names=[id_col, "score", "predicted"])

    scored = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
    return scored.select(
        id_col, (common.remainder(id_col, folds) == held).alias("held_out"), "score", "predicted")
