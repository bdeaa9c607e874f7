"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch lie end to end in one numpy array of symbol ids. Each round finds every sequence's
pair of lowest rank, replaces that pair wherever it stands in the sequence, and closes the gaps; sequences without a
mergeable pair are done, and the symbols they have left are counted. A sequence of many symbols would be gone through
once a round: its pairs are held by rank instead, and a round touches the places of its rank and what is beside them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Pre-tokens whose counts a task keeps, and symbols merged at once: bounds on memory, not on what is counted.
KEPT_COUNTS, SYMBOLS_AT_ONCE, WORDS_AT_ONCE, LONG_TEXT = 400_000, 1 << 20, 200_000, 1 << 20
#: Symbols from which a sequence is merged by places held by rank.
LONG_SEQUENCE = 128
_NO_RANK = np.iinfo(np.int64).max
#: The pattern that byte-level pre-tokenizers of this kind split by: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if it can be seen, else the next free one."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in seen else next(free)) for b in range(256)]


class ByteLevelCounter:
    """Counts the tokens of texts as a tokenizer.json of kind byte-level BPE gives them."""

    def __init__(self, definition: dict) -> None:
        model, splitter = definition["model"], definition.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True) or definition.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("not a byte-level BPE tokenizer of the supported kind")
        vocab = model["vocab"]
        self.byte_ids = np.array([vocab[c] for c in byte_letters()], np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.base = max(vocab.values()) + 1
        ranked = {vocab[a] * self.base + vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in reversed([*enumerate(merges)])}
        self.pairs = np.array(sorted(ranked), np.int64)
        self.ranks = np.array([ranked[k][0] for k in self.pairs.tolist()], np.int64)
        self.merged = np.array([ranked[k][1] for k in self.pairs.tolist()], np.int64)
        added = [t["content"] for t in definition.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.words = regex.compile(PATTERN)
        self.by_pair = {}
        self.known: dict[str, int] = {}

    def _long_left(self, sequence: bytes) -> int:
        """The number of symbols that one long sequence ends with, in about the time of a sort of it."""
        if not self.by_pair:
            self.by_pair = dict(zip(self.pairs.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))
        pairs, base = self.by_pair, self.base
        symbols = self.byte_ids[np.frombuffer(sequence, np.uint8)].tolist()
        n = left = len(symbols)
        before, after = [*range(-1, n - 1)], [*range(1, n), -1]
        places: dict[int, list[int]] = {}
        for at in range(n - 1):
            if known := pairs.get(symbols[at] * base + symbols[at + 1]):
                places.setdefault(known[0], []).append(at)
        ranks = [*places]
        heapify(ranks)
        while ranks:
            rank = heappop(ranks)
            for at in sorted(places.pop(rank)):
                to = after[at] if symbols[at] >= 0 else -1
                known = pairs.get(symbols[at] * base + symbols[to]) if to >= 0 else None
                if known is None or known[0] != rank:
                    continue  # a merge beside it has changed the pair
                symbols[at], symbols[to], left = known[1], -1, left - 1
                after[at] = onward = after[to]
                if onward >= 0:
                    before[onward] = at
                for start, end in ((before[at], at), (at, onward)):
                    if start >= 0 and end >= 0 and (new := pairs.get(symbols[start] * base + symbols[end])):
                        if new[0] not in places:
                            places[new[0]] = []
                            heappush(ranks, new[0])
                        places[new[0]].append(start)
        return left

    def symbols_left(self, sequences: list[bytes]) -> np.ndarray:
        """The number of symbols that each sequence ends with."""
        long = [i for i, s in enumerate(sequences) if len(s) >= LONG_SEQUENCE]
        if long:
            out = self._rounds([b"" if len(s) >= LONG_SEQUENCE else s for s in sequences])
            out[long] = [self._long_left(sequences[i]) for i in long]
            return out
        return self._rounds(sequences)

    def _rounds(self, sequences: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(len, sequences), np.int64, len(sequences))
        flat = self.byte_ids[np.frombuffer(b"".join(sequences), np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), out)
        while len(flat) > 1:
            pair = flat[:-1] * self.base + flat[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            rank = np.where((self.pairs[at] == pair) & (owner[:-1] == owner[1:]), self.ranks[at], _NO_RANK)
            rank = np.append(rank, _NO_RANK)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lengths = np.diff(np.append(starts, len(flat)))
            least = np.minimum.reduceat(rank, starts)
            hit = np.flatnonzero((rank == np.repeat(least, lengths)) & (rank < _NO_RANK))
            if not len(hit):
                break
            # Of overlapping pairs (a a a), every other one from the left is replaced.
            run = np.maximum.accumulate(np.where(np.append(True, np.diff(hit) != 1), hit, 0))
            hit = hit[(hit - run) % 2 == 0]
            flat[hit] = self.merged[at[hit]]
            out -= np.bincount(owner[hit], minlength=len(out))
            stay = np.repeat(least < _NO_RANK, lengths)
            stay[hit + 1] = False
            flat, owner = flat[stay], owner[stay]
        return out

    def _learn(self, words: set[str]) -> None:
        todo, size = [], 0
        for word in words:
            todo.append(word)
            size += len(word)
            if size >= SYMBOLS_AT_ONCE:
                self.known.update(zip(todo, self.symbols_left([w.encode("utf-8", "replace") for w in todo]).tolist(), strict=True))
                todo, size = [], 0
        if todo:
            self.known.update(zip(todo, self.symbols_left([w.encode("utf-8", "replace") for w in todo]).tolist(), strict=True))

    def _pieces(self, text: str) -> tuple[int, list[str]]:
        if self.special is None:
            return 0, [text]
        pieces = self.special.split(text)
        return len(pieces) - 1, pieces

    def counts(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each text, 0 for null."""
        out, waiting, unknown, held = [0] * len(texts), [], set(), 0

        def settle() -> None:
            nonlocal held
            if len(self.known) + len(unknown) > KEPT_COUNTS:
                self.known.clear()
                unknown.update(*(words for _, words in waiting))
            self._learn(unknown - self.known.keys())
            for i, words in waiting:
                out[i] += sum(map(self.known.__getitem__, words))
            waiting.clear()
            unknown.clear()
            held = 0

        for i, text in enumerate(texts):
            specials, pieces = self._pieces(text or "")
            out[i] += specials
            for piece in pieces:
                for words in self._split(piece):
                    waiting.append((i, words))
                    unknown.update(words)
                    held += len(words)
                    if held >= WORDS_AT_ONCE:
                        settle()
        settle()
        return out

    def _split(self, piece: str) -> Iterator[list[str]]:
        if len(piece) < LONG_TEXT:
            yield self.words.findall(piece)
            return
        found = (m[0] for m in self.words.finditer(piece))
        while words := [*islice(found, WORDS_AT_ONCE)]:
            yield words


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs (doc_id, text, ...).

    A null or empty text has no bytes and no tokens. Repeated rows are counted each; texts of any length are counted
    whole, a piece at a time; other columns are ignored, whatever their names; an empty table gives an empty result.
    The tokenizer's file is read by the driver and broadcast (its size is that of a vocabulary)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in pieces(batches):
            counter = counter or ByteLevelCounter(json.loads(definition.value))
            counts = counter.counts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), batch.column(2)], ["doc_id", "n_tokens", "n_bytes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"))
    counted = rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_bytes bigint")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
