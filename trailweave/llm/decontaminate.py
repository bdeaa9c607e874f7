"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of the test items make one automaton; each text is streamed through it word by word, keeping the
length of the longest match that ends at the word. A match of at least `window` words hits its last `window` words.
Items are dealt to tasks, which make an automaton of every `block_words` words (it has two states a word at most) and
write it to the shared folder. A task over the texts holds a bounded number of texts and one automaton at a time: the
texts go through all automata, loaded one after another. Nothing is broadcast, and the driver sees file names only."""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import new_path
from .common import byte_blocks, file_system, fresh, pieces

#: Words of one automaton, and bytes of the texts that a task takes through the automata together.
BLOCK_WORDS, HELD_BYTES = 100_000, 16 << 20

_KEPT = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)}
#: A-Z to lower case, all that isn't in a word to a space; one byte for one byte, so that offsets stay.
_NORMAL = bytes(b if b in _KEPT else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_NORMAL).split()


@dataclass
class Automaton:
    """A suffix automaton of many word sequences. states: by number, the next state by word."""

    window: int
    states: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    longest: list[int] = field(default_factory=lambda: [0])
    #: By state: items with a window that ends there, and (length, item) of shorter items that end there.
    items: dict[int, set[str | None]] = field(default_factory=dict)
    short: dict[int, list[tuple[int, str | None]]] = field(default_factory=dict)

    def _state(self, nxt: dict[bytes, int], link: int, longest: int) -> int:
        self.states.append(nxt)
        self.link.append(link)
        self.longest.append(longest)
        return len(self.states) - 1

    def _split(self, at: int, word: bytes, to: int) -> int:
        """A state for what `to` and the suffixes of `at` plus word have in common."""
        clone = self._state(dict(self.states[to]), self.link[to], self.longest[at] + 1)
        self.link[to] = clone
        while at >= 0 and self.states[at].get(word) == to:
            self.states[at][word] = clone
            at = self.link[at]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        known = self.states[last].get(word)
        if known is not None:
            return known if self.longest[known] == self.longest[last] + 1 else self._split(last, word, known)
        new = self._state({}, 0, self.longest[last] + 1)
        at = last
        while at >= 0 and word not in self.states[at]:
            self.states[at][word] = new
            at = self.link[at]
        if at >= 0:
            to = self.states[at][word]
            self.link[new] = to if self.longest[to] == self.longest[at] + 1 else self._split(at, word, to)
        return new

    @classmethod
    def of(cls, items: list[tuple[str | None, list[bytes]]], window: int) -> Automaton:
        auto = cls(window)
        for _, words in items:
            last = 0
            for word in words:
                last = auto._extend(last, word)
        marked: dict[int, set[str | None]] = {}
        ends: dict[int, list[tuple[int, str | None]]] = {}
        for item, words in items:
            at = 0
            for word in words:
                at = auto.states[at][word]
                up = at
                while up > 0 and item not in marked.setdefault(up, set()):
                    marked[up].add(item)
                    up = auto.link[up]
            if 0 < len(words) < window:
                ends.setdefault(at, []).append((len(words), item))
        # A state has what its link has: links are shorter, so in order of length each is looked at once.
        for state in sorted(range(1, len(auto.states)), key=auto.longest.__getitem__):
            link = auto.link[state]
            if auto.longest[state] >= window:
                auto.items[state] = marked[state] if auto.longest[link] < window else auto.items[link]
            if state in ends or link in auto.short:
                auto.short[state] = ends[state] + auto.short.get(link, []) if state in ends else auto.short[link]
        return auto

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """The number of words, the spans (first, beyond the last) of words that are hit, and the numbered items."""
        states, link, longest, window, short = self.states, self.link, self.longest, self.window, self.short
        spans: list[tuple[int, int]] = []
        found: set[str | None] = set()
        state = length = count = 0
        for block in byte_blocks((text or "").encode("utf-8", "replace").translate(_NORMAL)):
            for word in block.split():
                count += 1
                to = states[state].get(word)
                while to is None and state:
                    state = link[state]
                    length = longest[state]
                    to = states[state].get(word)
                if to is None:
                    continue
                state = to
                length += 1
                reach = 0
                if length >= window:
                    reach = window
                    found |= self.items[state]
                if state in short:
                    for size, item in short[state]:
                        if size <= length:
                            reach = max(reach, size)
                            found.add(item)
                if reach:
                    start = count - reach
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, count))
        found.discard(None)
        return count, spans, found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _sequences(items: Iterator[tuple[str | None, str]], window: int, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The word sequences of items in blocks of `block_words` words at most. A longer item is cut into parts that have
    all but one word of a window in common."""
    block, words = [], 0
    part = max(block_words, window)
    for item, text in items:
        every = normal_words(text)
        for start in range(0, max(1, len(every) - window + 1), part - window + 1):
            some = every[start : start + part]
            if block and words + len(some) > block_words:
                yield block
                block, words = [], 0
            block.append((item, some))
            words += len(some)
    if block:
        yield block


def _automata(benchmark: DataFrame, window: int, block_words: int) -> list[str]:
    """The files of the automata that benchmark (item_id, text) gives."""
    spark = benchmark.sparkSession
    root = new_path(spark, "automata")
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string")).filter("text is not null")
    n = items.agg(F.sum(F.regexp_count("text", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")))).first()[0] or 0

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in pieces(batches) for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        fs, folder = file_system(root)
        fs.create_dir(folder, recursive=True)
        for block in _sequences(rows, window, block_words):
            auto, name = Automaton.of(block, window), uuid.uuid4().hex
            with fs.open_output_stream(f"{folder}/{name}") as out:
                out.write(pickle.dumps((auto.window, auto.states, auto.link, auto.longest, auto.items, auto.short), 5))
            yield pa.RecordBatch.from_pydict({"name": [f"{root}/{name}"]})

    dealt = items.repartition(-(-n // block_words) or 1, F.xxhash64("item", "text"))
    return sorted(r["name"] for r in dealt.mapInArrow(build, "name string").collect())


def _through(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, finish: Callable[[pa.RecordBatch, list[dict]], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """docs (text, ...) after all automata of the benchmark: what finish, with the result `schema`, makes of each batch
    and of its rows' n_words, spans (as pairs) and items."""
    names = _automata(benchmark, window, block_words)
    held_bytes = HELD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, Automaton] = {}

        def automaton(name: str) -> Automaton:
            if name not in loaded:
                loaded.clear()
                fs, path = file_system(name)
                with fs.open_input_file(path) as f:
                    loaded[name] = Automaton(*pickle.loads(f.read()))
            return loaded[name]

        def settled(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts = [batch.column("text").to_pylist() for batch in held]
            made = [[{"n_words": 0, "spans": [], "items": set()} for _ in some] for some in texts]
            for name in names or [None]:
                auto = automaton(name) if name else Automaton(window)
                for some, rows in zip(texts, made, strict=True):
                    for text, row in zip(some, rows, strict=True):
                        row["n_words"], spans, found = auto.hits(text)
                        row["spans"] = _merged(row["spans"] + spans) if row["spans"] else spans
                        row["items"] |= found
            for batch, rows in zip(held, made, strict=True):
                for row in rows:
                    row["items"] = sorted(row["items"])
                yield finish(batch, rows)

        held, size = [], 0
        for batch in pieces(batches):
            held.append(batch)
            size += batch.nbytes
            if size >= held_bytes:
                yield from settled(held)
                held, size = [], 0
        yield from settled(held)

    return docs.mapInArrow(run, schema)


def _hit(x: dict) -> int:
    return sum(beyond - first for first, beyond in x["spans"])


def judged(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs (doc_id, text, ...).

    A null or empty text has no words and is clean. Items that are null or without words never match; items under
    one number count as one. Items without a number hit words, but are not among those that are counted and named.
    Repeated rows of docs keep their number; texts and items of any length are taken whole; columns other than these
    are ignored, whatever their names. With an empty benchmark all is clean; no documents give no rows."""

    def digest(batch: pa.RecordBatch, seen: list[dict]) -> pa.RecordBatch:
        hit = [_hit(x) for x in seen]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([x["n_words"] for x in seen], pa.int64()),
                pa.array(hit, pa.int64()),
                pa.array([len(x["items"]) for x in seen], pa.int64()),
                pa.array([hashlib.sha256(",".join(x["items"]).encode()).hexdigest() for x in seen], pa.string()),
                pa.array([n > 0 and coverage * n >= x["n_words"] for n, x in zip(hit, seen, strict=True)], pa.bool_()),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    return _through(docs.select("doc_id", F.col("text").cast("string")), benchmark, window, block_words, digest, schema)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and what stands between them."""
    data = text.encode("utf-8", "replace")
    kept, at, number, words = [], 0, -1, _WORD.finditer(data.translate(_NORMAL))
    for first, beyond in spans:
        for word in words:
            number += 1
            if number == first:
                kept.append(data[at : word.start()])
            if number == beyond - 1:
                at = word.end()
                break
    return b"".join([*kept, data[at:]]).decode("utf-8", "replace")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs, all columns, without what the benchmark contaminates.

    Where the words that are hit reach one in `coverage`, the row goes; else the hit spans, each a whole window or
    item at least, are cut from the text, and n_chars, if there is one, is counted anew. Rows without a hit stay as
    they are, null texts too; repeated rows share their fate; other columns pass through, whatever their names."""
    columns, typed = docs.columns, docs.withColumn("text", F.col("text").cast("string"))

    def cut(batch: pa.RecordBatch, seen: list[dict]) -> pa.RecordBatch:
        texts, stays = batch.column("text").to_pylist(), []
        for i, x in enumerate(seen):
            hit = _hit(x)
            stays.append(not (hit and coverage * hit >= x["n_words"]))
            if hit and stays[-1]:
                texts[i] = without_spans(texts[i], x["spans"])
        at = batch.schema.get_field_index("text")
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).select(columns).filter(pa.array(stays, pa.bool_()))

    return _recount(_through(typed, benchmark, window, block_words, cut, typed.schema))


def _recount(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The same by joining all windows of the texts with those of the items, for DuckDB.
ORACLE = f"""
with worded as (select doc_id, coalesce({_WORDS}, []) as words from documents),
items as (select item_id, {_WORDS} as words from benchmark where text is not null),
item_windows as (
  select distinct item_id, least(13, len(words)) as size, array_to_string(words[s + 1 : s + least(13, len(words))], ' ') as gram
  from items, lateral (select unnest(range(0, greatest(len(words) - 12, 1))) as s) where len(words) > 0),
sizes as (select distinct size from item_windows),
doc_windows as (
  select doc_id, size, s, array_to_string(words[s + 1 : s + size], ' ') as gram
  from worded, sizes, lateral (select unnest(range(0, len(words) - size + 1)) as s) where len(words) >= size),
found as (select distinct doc_id, item_id, d.size, s from doc_windows d join item_windows i on i.size = d.size and i.gram = d.gram),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + size)) as p from found) group by 1),
named as (select doc_id, count(item) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item_id::varchar as item from found) group by 1)
select w.doc_id, len(w.words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w.words) as contaminated
from worded w left join hit h on h.doc_id = w.doc_id left join named n on n.doc_id = w.doc_id
"""
