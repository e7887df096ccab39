"""Byte-pair encoding with forced boundaries.

A pair of neighbouring symbols that occurs inside no token of the vocabulary can never be joined by a
merge, nor can anything be joined across it. Every word is cut at such pairs, the fragments are encoded
independently, and their ids are concatenated. The result equals merging the whole word.

Rows: null text counts as empty; an empty text has no ids and decodes to the empty text. Repeated rows give
repeated results; columns other than the named two are not read. Texts are taken whole; a word of any length
is merged in O(n log n).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from portfolia.llm import common

#: White space as the tokenizer's pattern sees it; Python's own split also cuts at 0x1C-0x1F.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = re.compile("[\x1c-\x1f]")
#: Words of at most this many characters are remembered, so many of them in each of two generations.
KEPT_LENGTH, KEPT_WORDS = 48, 350_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Recent(dict):
    """A lookup that computes what it misses and keeps at most two generations of ``size`` entries."""

    def __init__(self, compute, size: int = KEPT_WORDS, length: int = KEPT_LENGTH):
        super().__init__()
        self.compute, self.size, self.length, self.old = compute, size, length, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.length:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


#: Up to here Python's tables of letters and of composed characters are those of the tokenizer library, whose tables
#: are of another Unicode version: chunks with other characters are normalised and split by the library itself.
FAMILIAR = "\u024f"


class ForcedBoundaryBPE:
    """An encoder read from a tokenizer file: BPE over byte symbols, optionally with a word-end suffix."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        self.library = Tokenizer.from_str(raw.decode())
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        steps = (spec.get("normalizer") or {}).get("normalizers") or [spec.get("normalizer") or {}]
        self.lower = any(s.get("type") == "Lowercase" for s in steps)
        self.nfc = any(s.get("type") == "NFC" for s in steps)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.inside = {pair for token in self.vocab for pair in self._pairs(self._symbols_of(token))}
        self.special_at = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.words = Recent(self._word)

    def _symbols_of(self, token: str) -> tuple[str, ...]:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return (*body[:-1], body[-1] + self.suffix)
        return tuple(token)

    @staticmethod
    def _pairs(symbols):
        return zip(symbols, symbols[1:], strict=False)

    def cuts(self, symbols: list[str]) -> list[list[str]]:
        """The fragments between forced boundaries."""
        inside = self.inside
        at = [i for i, pair in enumerate(self._pairs(symbols), 1) if pair not in inside]
        if not at:
            return [symbols]
        return [symbols[i:j] for i, j in zip([0, *at], [*at, len(symbols)], strict=True)]

    def _merge(self, symbols: list[str]) -> list[int]:
        """Merge the lowest-ranked pair, leftmost first, until none is left; unknown symbols are dropped."""
        s = list(symbols)
        if len(s) > 40:
            s = self._merge_long(s)
        elif len(s) > 1:
            get, none = self.rank.get, len(self.rank)
            ranks = [get(p, none) for p in self._pairs(s)]
            while ranks:
                best = min(ranks)
                if best == none:
                    break
                i = ranks.index(best)
                s[i] += s.pop(i + 1)
                del ranks[i]
                if i:
                    ranks[i - 1] = get((s[i - 1], s[i]), none)
                if i < len(ranks):
                    ranks[i] = get((s[i], s[i + 1]), none)
        vocab = self.vocab
        return [vocab[x] for x in s if x in vocab]

    def _merge_long(self, s: list[str]) -> list[str]:
        rank, n = self.rank, len(s)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(rank[p], i, *p) for i, p in enumerate(self._pairs(s)) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or s[i] != a or s[j] != b:
                continue
            s[i], alive[j], after[i] = a + b, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (s[left], s[right]) in rank:
                    heapq.heappush(heap, (rank[s[left], s[right]], left, s[left], s[right]))
        return [x for x, keep in zip(s, alive, strict=True) if keep]

    def _word(self, chunk: str) -> tuple[int, str, str]:
        """Number of ids, the ids and the decoded text of a run without white space."""
        ids = self.chunk_ids(chunk)
        return len(ids), " ".join(map(str, ids)), " ".join(self.text_of[i] for i in ids)

    def chunk_ids(self, chunk: str) -> list[int]:
        """The ids of a run without white space."""
        if not chunk.isascii() and max(chunk) > FAMILIAR:
            known = self.library.normalizer.normalize_str(chunk) if self.library.normalizer else chunk
            return self._ids(list(piece) for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(known))
        if self.nfc and not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
        if self.lower:
            chunk = chunk.replace("Σ", "σ").lower()
        alphabet = self.alphabet
        return self._ids([alphabet[b] for b in piece.encode()]
                         for piece in ([chunk] if chunk.isalpha() else self.pattern.findall(chunk)))

    def _ids(self, pieces: Iterable[list[str]]) -> list[int]:
        ids: list[int] = []
        for symbols in pieces:
            symbols[-1] += self.suffix
            for fragment in self.cuts(symbols):
                ids += self._merge(fragment)
        return ids

    def pieces(self, text: str) -> Iterator[tuple[int, str, str]]:
        """Words and special tokens of a text, in order, each with its count, ids and decoded text."""
        at = 0
        if self.special_at:
            for m in self.special_at.finditer(text):
                yield from self._plain(text[at : m.start()])
                yield 1, str(self.special[m[0]]), m[0]
                at = m.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, text: str):
        chunks = [c for c in _SPACE.split(text) if c] if _ODD.search(text) else text.split()
        return map(self.words.__getitem__, chunks)

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.pieces(text) if ids for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's own strings joined by a space, as the file names no decoder."""
        return " ".join(self.text_of[i] for i in ids)


_LOADED: dict[int, ForcedBoundaryBPE] = {}


def loaded(raw: bytes) -> ForcedBoundaryBPE:
    """The encoder of a file, built once per worker process."""
    key = hash(raw)
    if key not in _LOADED:
        _LOADED[key] = ForcedBoundaryBPE(raw)
    return _LOADED[key]


def encode_texts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 digests_only: bool = False) -> DataFrame:
    """Encode every text and decode it again: id, n_tokens, ids and decoded text.

    With ``digests_only`` the last two are sha256 digests (of the decimal ids joined by a space, and of
    the decoded text in UTF-8), so that no long column leaves the task.
    """
    file = df.sparkSession.sparkContext.broadcast(common.tokenizer_json(tokenizer_path))
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, " + (
        "ids_sha256 string, decoded_sha256 string" if digests_only else "ids array<int>, decoded string")

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(file.value)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column(1):
                parts = [p for p in bpe.pieces(text.as_py() or "") if p[0]]
                counts.append(sum(p[0] for p in parts))
                joined, shown = " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])
                ids.append(digest(joined) if digests_only else [int(i) for i in joined.split()])
                decoded.append(digest(shown) if digests_only else shown)
            last = [pa.array(ids), pa.array(decoded)] if digests_only else [
                pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            names = [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests_only else ("ids", "decoded"))]
            if digests_only:
                last = [a.cast(pa.string()) for a in last]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *last], names=names)

    return df.select(id_col, text_col).mapInArrow(run, schema)
