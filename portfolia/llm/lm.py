"""Language-model scores from smoothed n-grams read as a weighted backoff automaton.

States are histories, arcs are the words seen after them, and every state has a failure arc to the state of its
shorter history (:class:`Automaton`). With Dirichlet smoothing the weights are

    arc      log10((c(h w) + MU * P(w | h')) / (c(h) + MU))
    failure  log10(MU / (c(h) + MU)),

and the root gives a word log10((c + 0.5) / (N + 0.5 * (V + 1))). One left-to-right traversal carries the state,
takes the arc or the failure arcs, and adds their weights. The distribution is proper: no count is cut off.

Texts are dealt to blocks of about ``BLOCK_BYTES``. A block lists each n-gram of its texts once with its training
count; the lists are cut by the n-gram's hash into parts, a part sums each n-gram over all blocks and sends the
totals back in the order in which they came. So a block holds exactly that part of the automaton that its own
texts can reach, whatever the size of the model, and a frequent n-gram is one entry per block, not per occurrence.

Words are known by 64-bit hashes. Rows: null text counts as empty and has the end token alone; a null id counts
as empty text in the fold; repeated rows are counted and scored as often as they occur; an empty table gives no
rows. Without training texts N and V are 0 and every token has probability 1. Other columns are unread.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portfolia.llm import common

ORDER, MU = 2, 500.0
BLOCK_BYTES, PART_BYTES = 12 << 20, 16 << 20
_START, _END = np.uint64(0x5D1C7A8E9B3F2461), np.uint64(0xC0FFEE1234567891)
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """The n-grams of a block's texts: for each order the distinct keys, in order, and each token's place there.

    ``sample`` is a token at which each n-gram ends.
    """

    def __init__(self, texts: pa.Array, order: int):
        words, ends = common.word_hashes(texts)
        n = len(ends) - 1
        self.sizes = np.diff(ends) + 1
        last = np.cumsum(self.sizes) - 1
        token = np.empty(len(words) + n, np.uint64)
        token[last] = _END
        inner = np.ones(len(token), bool)
        inner[last] = False
        token[inner] = words
        self.first = last - self.sizes + 1
        key, self.keys, self.place, self.sample = token, [], [], []
        for k in range(order):
            if k:
                before = np.empty_like(key)
                before[1:] = key[:-1]
                before[self.first] = _START + np.uint64(k)
                key = common.mix(before * _MULTIPLY + token)
            found, sample, place = np.unique(key, return_index=True, return_inverse=True)
            self.keys.append(found)
            self.sample.append(sample.astype(np.int32))
            self.place.append(place.astype(np.int32))

    def counts(self, trained: np.ndarray) -> list[np.ndarray]:
        """Training count of every distinct n-gram of the block."""
        weight = np.repeat(trained, self.sizes).astype(np.float64)
        return [np.bincount(p, weights=weight, minlength=len(k)).astype(np.int64)
                for p, k in zip(self.place, self.keys, strict=True)]


class Automaton:
    """The part of the model that a block's texts can reach, as states with arcs and failure arcs.

    State 0 is the root, without a history; states 1 to order - 1 are the beginnings of a text, padded to as many
    words; then every n-gram shorter than the order that was seen in training is the state of that history.

    * ``fail`` and ``fail_weight`` of a state: the state of the history without its first word, and what that costs;
    * ``arc_weight[k]`` and ``arc_to[k]`` of an n-gram of k + 1 words: from the state of its first k words the arc of its
      last one, NaN where it was not seen; the root has arcs for all words.
    """

    def __init__(self, grams: Grams, totals: list[np.ndarray], tokens: int, words: int, documents: int, mu: float):
        self.grams, order = grams, len(totals)
        whole = tokens + 0.5 * (words + 1)
        offsets = np.cumsum([order, *(len(t) for t in totals[:-1])])  # where the states of each length begin
        self.length = np.concatenate([np.arange(order), *(np.full(len(t), k + 1) for k, t in enumerate(totals[:-1]))])
        self.fail = np.zeros(offsets[-1], np.int64)
        self.fail_weight = np.zeros(offsets[-1])
        below = math.log10(mu / (documents + mu))
        self.fail[1:order], self.fail_weight[1:order] = np.arange(order - 1), below
        self.arc_weight, self.arc_to = [np.log10((totals[0] + 0.5) / whole)], []
        first = np.zeros(int(grams.sizes.sum()), bool)
        first[grams.first] = True
        for k, count in enumerate(totals):
            at = grams.sample[k]  # the n-gram of k + 1 words ends at this token
            shorter = grams.place[k - 1][at] if k else None
            if k:
                history = np.where(first[at], documents, totals[k - 1][grams.place[k - 1][at - 1]])
                below = history + mu
                with np.errstate(divide="ignore"):
                    weight = np.log10((count + mu * 10.0 ** self.arc_weight[k - 1][shorter]) / below)
                self.arc_weight.append(np.where(count > 0, weight, np.nan))
            if k + 1 < order:  # the n-gram is a history itself
                own = slice(offsets[k], offsets[k] + len(count))
                self.fail[own] = offsets[k - 1] + shorter if k else 0
                self.fail_weight[own] = np.log10(mu / (count + mu))
                self.arc_to.append(self._known(offsets[k] + np.arange(len(count)), count, totals, offsets))
            else:
                self.arc_to.append(self._known(offsets[k - 1] + shorter, count, totals, offsets) if k else np.zeros(
                    len(count), np.int64))
        self.start = order - 1

    def _known(self, state: np.ndarray, count: np.ndarray, totals: list[np.ndarray], offsets: np.ndarray) -> np.ndarray:
        """The states, or, where one was not seen in training, the longest part of its history that was."""
        seen = np.concatenate([np.ones(offsets[0], bool), *(t > 0 for t in totals[:-1])])
        state = state.copy()
        while not (ok := seen[state]).all():
            state[~ok] = self.fail[state[~ok]]
        return state

    def traverse(self) -> np.ndarray:
        """Log-probability of every text: one walk from left to right that carries a state and adds weights.

        All texts of the block walk in step, the longest first, so that those still on the way are a leading run.
        """
        sizes, order = self.grams.sizes, np.argsort(-self.grams.sizes, kind="stable")
        begin, left = self.grams.first[order], -sizes[order]
        state, total = np.full(len(order), self.start), np.zeros(len(order))
        for step in range(int(sizes.max(initial=0))):
            here = int(np.searchsorted(left, -step, "left"))  # texts with more than ``step`` tokens
            at, now, sum_ = begin[:here] + step, state[:here], total[:here]
            open_ = np.arange(here)
            while len(open_):
                length = self.length[now[open_]]
                took = np.zeros(len(open_), bool)
                for k in range(len(self.arc_weight)):
                    some = np.flatnonzero(length == k)
                    if len(some):
                        gram = self.grams.place[k][at[open_[some]]]
                        weight = self.arc_weight[k][gram]
                        ok = ~np.isnan(weight)
                        took[some[ok]] = True
                        who = open_[some[ok]]
                        sum_[who] += weight[ok]
                        now[who] = self.arc_to[k][gram[ok]]
                open_ = open_[~took]
                sum_[open_] += self.fail_weight[now[open_]]
                now[open_] = self.fail[now[open_]]
        out = np.empty(len(order))
        out[order] = total
        return out


def _slices(keys: np.ndarray, parts: int) -> np.ndarray:
    bounds = np.arange(1, parts, dtype=np.uint64) * np.uint64((2**64 - 1) // parts)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def score(docs: DataFrame, trained: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
          mu: float = MU) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    ``trained`` says which rows the model is learnt from; the others are held out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(trained, F.lit(False)).alias("trained"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, parts = math.ceil(size / BLOCK_BYTES) or 1, 1 << max(0, math.ceil(math.log2(size / PART_BYTES or 1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))

    def count(key: tuple, table: pa.Table) -> pa.Table:
        grams = Grams(table.column("text"), order)
        out = {"block": [], "kind": [], "part": [], "grams": [], "counts": []}
        for kind, (keys, counts) in enumerate(zip(
                grams.keys, grams.counts(table.column("trained").to_numpy()), strict=True)):
            at = _slices(keys, parts)
            for part in range(parts):
                own = slice(at[part], at[part + 1])
                out["block"].append(key[0].as_py())
                out["kind"].append(kind)
                out["part"].append(part)
                out["grams"].append(keys[own].view(np.int64))
                out["counts"].append(counts[own].astype(np.int32))
        return pa.table({
            "block": pa.array(out["block"], pa.int64()), "kind": pa.array(out["kind"], pa.int32()),
            "part": pa.array(out["part"], pa.int32()), "grams": pa.array(out["grams"], pa.list_(pa.int64())),
            "counts": pa.array(out["counts"], pa.list_(pa.int32()))})

    def total(key: tuple, table: pa.Table) -> pa.Table:
        grams, counts = table.column("grams").combine_chunks(), table.column("counts").combine_chunks()
        values, own = grams.flatten().to_numpy(), counts.flatten().to_numpy()
        keys, place = np.unique(values, return_inverse=True)
        sums = np.bincount(place, weights=own, minlength=len(keys)).astype(np.int64)
        n = table.num_rows
        back = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(
            grams.value_lengths().to_numpy())]).astype(np.int32)), pa.array(sums[place]))
        return pa.table({
            "block": table.column("block"), "kind": table.column("kind"), "part": table.column("part"),
            "totals": back, "tokens": pa.array([int(sums.sum())] * n, pa.int64()),
            "words": pa.array([int((sums > 0).sum())] * n, pa.int64())})

    def apply(key: tuple, table: pa.Table, model: pa.Table) -> pa.Table:
        grams = Grams(table.column("text"), order)
        model = model.sort_by([("kind", "ascending"), ("part", "ascending")])
        kind = model.column("kind").to_numpy()
        lists = model.column("totals").combine_chunks()
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        flat = lists.flatten().to_numpy()
        at = np.searchsorted(kind, np.arange(order + 1))
        totals = [flat[ends[at[k]] : ends[at[k + 1]]] for k in range(order)]
        tokens, words = (int(model.column(c).to_numpy()[kind == 0].sum()) for c in ("tokens", "words"))
        documents = int(totals[0][np.searchsorted(grams.keys[0], _END)])
        first, count = grams.first, totals[0][grams.place[0]]
        if tokens:
            machine = Automaton(grams, totals, tokens, words, documents, mu)
            base, result = np.add.reduceat(machine.arc_weight[0][grams.place[0]], first), machine.traverse()
        else:
            base = result = np.zeros(len(first))
        return pa.table({
            "id": table.column("id"), "trained": table.column("trained"), "n_tokens": pa.array(grams.sizes),
            "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64), first)),
            "train_tokens": pa.array([tokens] * len(first), pa.int64()),
            "base_score": pa.array(base), "score": pa.array(result)})

    lists = rows.groupBy("block").applyInArrow(
        count, "block long, kind int, part int, grams array<long>, counts array<int>")
    totals = lists.groupBy("kind", "part").applyInArrow(
        total, "block long, kind int, part int, totals array<long>, tokens long, words long")
    kind_of = docs.schema[id_col].dataType.simpleString()
    scored = rows.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(
        apply, f"id {kind_of}, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double,"
               " score double")
    return scored.select(F.col("id").alias(id_col), (~F.col("trained")).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")
