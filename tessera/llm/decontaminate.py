"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of all benchmark items.

The automaton's alphabet is the benchmark's vocabulary, so a text is scanned once, word by word; words outside
the vocabulary reset it. Hits are mapped back to code-point spans of the original text. A benchmark that is too large
for one automaton in a worker's memory is scanned for in passes, each with the next part of its windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.kit import Tables, arrow, fresh, texts
from tessera.shipping import ship

#: Bytes that part words, after A-Z are lower-cased: all of ASCII but digits and a-z.
_PARTS = bytes(b if b >= 0x80 or chr(b).isalnum() and not 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_built: dict[str, Automaton] = {}

OUT = pa.schema(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))]
    + [("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)
OUT_SQL = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"
#: What passes hand on: runs of hit words, from, to, from, to, ..., and the items found.
STATE = pa.schema([("runs", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
STATE_TYPE = T.StructType([T.StructField("runs", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])


@dataclass(frozen=True)
class Decontaminate:
    window: int = 10
    #: Benchmark words of one automaton, which every worker holds: some 700 bytes each. More words take more passes.
    most_words: int = 500_000


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().translate(_PARTS).split() if text else []


class Automaton:
    def __init__(self, known: Windows):
        self.vocabulary = {w: i for i, w in enumerate(known.vocabulary, 1)}
        self.found: list[tuple[int, tuple[str, ...]]] = []  # words and items of each window
        self.built = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for item, ids in known.runs:
            ids = ids.tolist()
            for i in range(max(1, len(ids) - known.window + 1)):
                w = tuple(ids[i : i + known.window])
                at = self.built.get(w, -1)
                if at < 0:
                    self.built.add_word(w, len(self.found))
                    self.found.append((len(w), (item,)))
                elif item not in self.found[at][1]:
                    self.found[at] = len(w), (*self.found[at][1], item)
        if self.found:
            self.built.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(from, to) of each occurrence of a window, and the items."""
        out, items = [], set()
        if self.found and words:
            for end, at in self.built.iter(tuple(map(self.vocabulary.get, words, repeat(0)))):
                size, who = self.found[at]
                out.append((end + 1 - size, end + 1))
                items.update(who)
        return out, items


@dataclass
class Windows:
    """A part of the benchmark: its vocabulary, and runs of an item's words, as numbers from 1, whose windows count."""

    key: str
    window: int
    vocabulary: list[bytes]
    runs: list[tuple[str, np.ndarray]]

    def automaton(self) -> Automaton:
        if self.key not in _built:
            _built.clear()
            _built[self.key] = Automaton(self)
        return _built[self.key]


def parts_of(rows, window: int, most: int) -> Iterator[Windows]:
    """rows: (item_id, text as bytes or None). An item of fewer words than a window, but not none, is one window.

    Parts have at most so many words, beyond the overlap of a cut item's pieces, whose windows are those of the item.
    """
    numbers: dict[bytes, int] = {}
    runs: list[tuple[str, np.ndarray]] = []
    room = most
    for item, text in rows:
        words, at = words_of(text), 0
        while words and (at == 0 or at + window <= len(words)):
            if room <= 0:
                yield Windows(uuid.uuid4().hex, window, list(numbers), runs)
                numbers, runs, room = {}, [], most
            piece = words[at : at + max(room, 1) + window - 1]
            runs.append((item, np.array([numbers.setdefault(w, len(numbers) + 1) for w in piece], np.int32)))
            step = len(piece) - window + 1
            room -= max(step, len(piece) if step < 1 else 1)
            at += max(step, 1)
    yield Windows(uuid.uuid4().hex, window, list(numbers), runs)


def windows_of(rows, window: int) -> Windows:
    return next(parts_of(rows, window, 1 << 60))


def _runs(hits) -> list[tuple[int, int]]:
    """Overlapping and touching (from, to) as one."""
    out: list[list[int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _spans(text: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """Runs of words as code points of the original text."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.frombuffer(text.lower().translate(_PARTS), np.uint8) != 0x20
    edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [{"start": int(points[starts[a]]), "end": int(points[stops[b - 1]])} for a, b in runs]


def scan(text: bytes | None, known: Windows, before: tuple = ((), ())) -> tuple[int, int, list[str], list[dict]]:
    """(n_words, n_hit, items, spans of hit words as code points of the original text); before: what other parts hit."""
    words = words_of(text)
    hits, items = known.automaton().hits(words)
    runs = _runs([*hits, *before[0]])
    return len(words), sum(b - a for a, b in runs), sorted(items.union(before[1])), _spans(text, runs) if runs else []


def _pairs(flat: list[int]) -> list[tuple[int, int]]:
    return list(zip(flat[::2], flat[1::2]))


def _states(said: pa.Array, state: pa.Array | None):
    """(text, what earlier passes hit) of each row"""
    found = state.to_pylist() if state is not None else repeat(None)
    for text, was in zip(texts(said), found):
        yield text, (_pairs(was["runs"]), was["items"]) if was else ((), ())


def _found(docs: DataFrame, benchmark: DataFrame, conf: Decontaminate, tables: Tables, given, schema) -> DataFrame:
    """The last pass over docs, after the others: given(slice, the OUT of its rows) makes its batches."""
    spark, columns, state = docs.sparkSession, docs.columns, fresh(docs, "state")
    ship(spark)
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    parts = parts_of(((item, text.encode()) for item, text in items.toLocalIterator()), conf.window, conf.most_words)
    at = columns.index("text")

    def slices(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                yield part, part.column(len(columns)) if part.num_columns > len(columns) else None

    part, turn = next(parts), 0
    while (after := next(parts, None)) is not None:
        shared = spark.sparkContext.broadcast(part)

        def run(batches, shared=shared):
            for rows, was in slices(batches):
                runs, who = [], []
                for text, (old, items) in _states(rows.column(at), was):
                    hits, new = shared.value.automaton().hits(words_of(text))
                    runs.append([x for r in _runs([*hits, *old]) for x in r])
                    who.append(sorted(new.union(items)))
                states = pa.StructArray.from_arrays([pa.array(runs, STATE.field(0).type), pa.array(who, STATE.field(1).type)], fields=list(STATE))
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(columns)], states], names=[*columns, state])

        kept = docs.select(*columns).schema.add(state, STATE_TYPE)
        docs = tables.keep(docs.mapInArrow(run, kept), f"pass-{turn}")
        shared.unpersist()
        if turn:
            tables.drop(f"pass-{turn - 1}")
        part, turn = after, turn + 1
    shared = spark.sparkContext.broadcast(part)

    def last(batches):
        for rows, was in slices(batches):
            got = list(zip(*(scan(text, shared.value, before) for text, before in _states(rows.column(at), was))))
            yield given(pa.RecordBatch.from_arrays(rows.columns[: len(columns)], names=columns), arrow(dict(zip(OUT.names, got)), OUT))

    return docs.mapInArrow(last, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, conf: Decontaminate = Decontaminate(), tables: Tables | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted), spans for each row of docs (doc_id, text).

    benchmark (item_id, text) is the stated query set; it is gathered item by item, and a part of at most
    ``most_words`` words at a time is held and broadcast. Null texts have no words; an item without an item_id or
    without words gives no window; without items nothing is hit. Repeated items count once by their item_id; repeated
    documents are scanned each by itself, a null doc_id stays null, an empty table gives no rows, other columns of
    docs don't matter, and texts and items of any length are read whole.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    given = lambda part, found: pa.RecordBatch.from_arrays([part.column(0), *found.columns], names=["doc_id", *OUT.names])
    return _found(rows, benchmark, conf, tables or Tables(docs.sparkSession), given, f"doc_id long, {OUT_SQL}")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, conf: Decontaminate = Decontaminate(), tables: Tables | None = None) -> DataFrame:
    """The rows of docs that hold no window of the benchmark, with all their columns as they are, whatever their names."""
    given = lambda part, found: part.filter(pc.equal(found.column("n_hit"), 0))
    return _found(docs, benchmark, conf, tables or Tables(docs.sparkSession), given, docs.schema)
