"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents are tokenised, closed with an end id and cut into pieces of at most ``capacity`` tokens; only longer
documents are cut, so that every piece but the first is full. Full pieces are sequences of their own. All other
pieces are dealt to shards of about ``SHARD`` pieces, and every shard is solved on ``ISLANDS`` islands:

* an individual is a packing of the shard's pieces into bins; its fitness is the mean squared fill;
* crossover injects whole well-filled bins of one parent into the other, removes the bins that hold the same
  pieces, and puts the displaced pieces back by best fit, longest first;
* after each epoch the elite of every island migrates to the next island of its shard.

The best island's packing counts. Bins that stay below ``capacity - SLACK`` are dissolved and their pieces are
dealt anew in the next round, so remainders of all shards meet; the last round keeps every bin.

Rows: null text counts as empty, an empty document is the end id alone; repeated rows and null ids are packed
like any other row; an empty table gives no piece. Other columns are unread.
"""

from __future__ import annotations

import json
import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portfolia.llm import common
from portfolia.llm.bpe import Recent, byte_alphabet

SHARD, ISLANDS, EPOCHS, ROUNDS, SLACK = 20_000, 2, 2, 3, 2
POPULATION, GENERATIONS, INJECTED = 4, 8, 0.35
KEPT_CHUNKS = 250_000

# --- token ids -------------------------------------------------------------------------------------


class ChunkTokenizer:
    """Ids of a byte-level BPE file as bytes, remembered per run of characters between single spaces.

    A run and the one space before it are always tokens of their own in this pattern, whatever stands around
    them, so a text whose white space is single spaces and single line breaks is the concatenation of its runs.
    Any other text is encoded in one piece; one that spells a special token goes to the tokenizers library.
    """

    def __init__(self, raw: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(raw)
        vocab, back = spec["model"]["vocab"], {c: b for b, c in enumerate(byte_alphabet())}
        self.library = Tokenizer.from_str(raw.decode())
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        at = [vocab[m] for m in made]
        assert at == sorted(at), "ids do not follow the order of merges"
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.spaced = Recent(lambda run: self._encode(" " + run), KEPT_CHUNKS)
        self.plain = Recent(self._encode, KEPT_CHUNKS // 4)
        self.line_break = self._encode("\n")

    def _encode(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if (not text or text[0].isspace() or text[-1].isspace() or "  " in text or "\n\n" in text
                or " \n" in text or "\n " in text):
            return self._encode(text)
        lines = text.split("\n")
        runs = [line.split(" ") for line in lines]
        if sum(map(len, runs)) != len(text.split()):  # some other white space
            return self._encode(text)
        return self.line_break.join(
            self.plain[own[0]] + b"".join(map(self.spaced.__getitem__, own[1:])) for own in runs)


_LOADED: dict[int, ChunkTokenizer] = {}


def pieces_of(df: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """Id, piece, start, length and ids_crc32 of every piece of every document."""
    file = df.sparkSession.sparkContext.broadcast(common.tokenizer_json(tokenizer_path))
    kind = df.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(file.value)
        if key not in _LOADED:
            _LOADED[key] = ChunkTokenizer(file.value)
        tokens = _LOADED[key]
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = tokens.ids(text.as_py() or "") + end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                for k, at in enumerate([0, *range(first, n, capacity)]):
                    size = capacity if k else first
                    row.append(i), piece.append(k), start.append(at), length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                 *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=[id_col, "piece", "start", "length", "ids_crc32"])

    return df.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


# --- one island ------------------------------------------------------------------------------------


def best_fit(order: list[int], length: list[int], bin_of: np.ndarray, gaps: list[int], next_bin: int,
             capacity: int) -> int:
    """Put pieces, in the given order, where the least room is left; ``gaps`` is sorted gap * 2**32 + bin."""
    for i in order:
        size = length[i]
        at = bisect_left(gaps, size << 32)
        if at < len(gaps):
            gap = gaps.pop(at)
            b, left = gap & 0xFFFFFFFF, (gap >> 32) - size
        else:
            b, left, next_bin = next_bin, capacity - size, next_bin + 1
        bin_of[i] = b
        if left:
            insort(gaps, (left << 32) | b)
    return next_bin


def fills(bin_of: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.bincount(bin_of, weights=length).astype(np.int64)


def tidy(bin_of: np.ndarray) -> np.ndarray:
    """Bins numbered from 0 without holes."""
    return np.unique(bin_of, return_inverse=True)[1].astype(np.int64)


def fitness(bin_of: np.ndarray, length: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then a higher mean squared fill."""
    f = fills(bin_of, length) / capacity
    return -len(f), float((f * f).mean())


def greedy(length: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    bin_of = np.zeros(len(length), np.int64)
    best_fit(order.tolist(), length.tolist(), bin_of, [], 0, capacity)
    return bin_of


def crossover(a: np.ndarray, b: np.ndarray, length: np.ndarray, rng: np.random.Generator,
              capacity: int) -> np.ndarray:
    """Inject a random part of the well-filled bins of ``b`` into ``a`` and best-fit what they displace."""
    full = fills(b, length)
    good = full >= np.quantile(full, 0.25)
    injected = good & (rng.random(len(full)) < INJECTED)
    moved = injected[b]
    hit = np.zeros(a.max() + 1, bool)
    hit[a[moved]] = True
    hit |= rng.random(len(hit)) < 0.02  # a few more bins are opened
    displaced = np.flatnonzero(hit[a] & ~moved)
    child = a.copy()
    child[moved] = b[moved] + len(hit)
    taken = child.copy()
    taken[displaced] = -1
    held = taken >= 0
    load = np.bincount(taken[held], weights=length[held], minlength=1).astype(np.int64)
    used = np.bincount(taken[held], minlength=1) > 0
    open_bins = np.flatnonzero(used & (load < capacity))
    gaps = sorted(((capacity - load[open_bins]) << 32 | open_bins).tolist())
    order = displaced[np.argsort(-length[displaced], kind="stable")]
    best_fit(order.tolist(), length.tolist(), child, gaps, int(max(child.max(), taken.max())) + 1, capacity)
    return tidy(child)


def evolve(length: np.ndarray, elites: list[np.ndarray], seed: int, capacity: int) -> np.ndarray:
    """The best packing after ``GENERATIONS`` of steady-state evolution from the elites and greedy packings."""
    rng = np.random.default_rng(seed)
    population = [tidy(e) for e in elites]
    while len(population) < POPULATION:
        noise = rng.normal(0, 0 if not population else 40, len(length))
        population.append(greedy(length, np.argsort(-(length + noise), kind="stable"), capacity))
    scored = sorted(((fitness(x, length, capacity), i, x) for i, x in enumerate(population)), reverse=True)
    least = math.ceil(length.sum() / capacity)
    for g in range(GENERATIONS):
        if -scored[0][0][0] <= least:
            break
        i, j = rng.choice(len(scored), 2, replace=False)
        child = crossover(scored[min(i, j)][2], scored[max(i, j)][2], length, rng, capacity)
        scored[-1] = (fitness(child, length, capacity), len(population) + g, child)
        scored.sort(reverse=True)
    return scored[0][2]


# --- islands over the cluster ----------------------------------------------------------------------


def solve(items: DataFrame, round_no: int, shards: int, capacity: int, last: bool) -> DataFrame:
    """Pack (item, length) rows: item, length, sequence_id, offset; sequence_id is null for dissolved bins."""
    dealt = items.select("item", "length", F.pmod(F.xxhash64("item", F.lit(round_no)), F.lit(shards)).alias("shard"))
    state = dealt.select("*", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"),
                         F.lit(-1).cast("long").alias("bin"), F.lit(0).alias("source"))
    schema = "shard long, island int, item long, length long, bin long"

    def epoch(no: int):
        def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            first = rows[rows["source"] == rows["source"].iloc[0]].sort_values("item")
            length = first["length"].to_numpy()
            elites = [own.sort_values("item")["bin"].to_numpy() for _, own in rows.groupby("source")
                      if own["bin"].iloc[0] >= 0]
            seed = int(key[0]) * 1009 + int(key[1]) * 31 + no
            return pd.DataFrame({
                "shard": key[0], "island": key[1], "item": first["item"].to_numpy(), "length": length,
                "bin": evolve(length, elites, seed, capacity)})
        return grow

    for no in range(EPOCHS):
        state = state.groupBy("shard", "island").applyInPandas(epoch(no), schema)
        if no + 1 < EPOCHS:  # the elite stays and also migrates to the next island
            state = state.withColumn("source", F.col("island")).withColumn(
                "island", F.explode(F.array("source", (F.col("source") + 1) % ISLANDS)))

    def settle(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        best = max((fitness(tidy(own["bin"].to_numpy()), own["length"].to_numpy(), capacity), -island, island)
                   for island, own in rows.groupby("island"))[2]
        own = rows[rows["island"] == best].sort_values(["bin", "item"])
        size = own.groupby("bin")["length"]
        kept = size.transform("sum") >= (0 if last else capacity - SLACK)
        return pd.DataFrame({
            "item": own["item"], "length": own["length"],
            "sequence_id": (own["bin"] + int(key[0]) * 2**24 + round_no * 2**58).astype("Int64").where(kept),
            "offset": size.cumsum() - own["length"]})

    return state.groupBy("shard").applyInPandas(settle, "item long, length long, sequence_id long, offset long")


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """All pieces with sequence_id and offset."""
    table = common.stored(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    whole = table.where(F.col("length") == capacity)
    rest, placed = table.where(F.col("length") < capacity).select("item", "length"), None
    for no in range(ROUNDS):
        n = rest.count()
        if not n:
            break
        last = no == ROUNDS - 1
        out = common.stored(solve(rest, no, math.ceil(n / SHARD), capacity, last), "packed")
        kept = out.where(F.col("sequence_id").isNotNull()).drop("length")
        placed = kept if placed is None else placed.unionByName(kept)
        rest = out.where(F.col("sequence_id").isNull()).select("item", "length")
    alone = whole.withColumn("sequence_id", -1 - F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    if placed is None:
        return alone.drop("item")
    return table.join(placed, "item").unionByName(alone).drop("item")
