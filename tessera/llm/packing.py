"""Packing of tokenized documents into sequences of fixed capacity, by minimum bin slack.

A document fills whole sequences by itself; what is left of it (less than the capacity) is one of capacity - 1
possible lengths. The histogram of these lengths, whose size doesn't depend on the corpus, is packed on the
driver: with the largest length fixed, a subset-sum over bitsets finds the multiset of remaining lengths that
comes closest to the capacity, counts are traced back, and the pattern is used as often as the counts allow.
Lengths that no multiset completes are laid end to end and cut at sequence ends; the last partial sequence is
cut into powers of two, which need no padding. A document finds its place from its rank among equal lengths.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kit import Tables, arrow

#: Characters whose classes and white space the two tokenizer libraries hold alike; other texts take the slower one.
_PLAIN = re.compile("[^\\x00-\u024f\u2010-\u2027]")
#: White space that takes long to split.
_LONG_SPACE = re.compile(r"\s{1000}")
_tokenizers: dict[tuple, Ids] = {}


class Ids:
    """Token ids as little-endian 32-bit bytes.

    With the same vocabulary as a file of ranks, plain texts are encoded by tiktoken, which is faster on words it
    hasn't met; what could differ (special tokens, other scripts) is left to the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.fast = Tokenizer.from_file(path), None
        if ranks:
            from tiktoken import Encoding

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def raw(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.fast is None or "<|" in text or _PLAIN.search(text) or _LONG_SPACE.search(text):
            return self.raw(text)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def ids_of(*files: str | None) -> Ids:
    if files not in _tokenizers:
        _tokenizers[files] = Ids(*files)
    return _tokenizers[files]


@dataclass(frozen=True)
class Packing:
    #: A file of the tokenizers library; the same vocabulary as a file of ranks, with its pattern, if there is one.
    tokenizer: str
    ranks: str | None = None
    pattern: str | None = None
    capacity: int = 1024
    end_id: int = 0


@dataclass
class Run:
    """Ranks from ``start`` of one length: ``each`` to a sequence, side by side from ``offset``."""

    start: int
    each: int
    sequence: int
    offset: int


@dataclass
class Plan:
    capacity: int
    runs: dict[int, list[Run]] = field(default_factory=dict)
    #: length -> (first rank, position) of what is laid end to end
    tail: dict[int, tuple[int, int]] = field(default_factory=dict)
    sequences: int = 0
    tail_tokens: int = 0


    def tail_cut(self, at: int, length: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, length) of the pieces of positions at to at + length; nothing grows with the tail."""
        full, out = self.tail_tokens // self.capacity, []
        while length:
            if at < full * self.capacity:
                seq, offset = divmod(at, self.capacity)
                room = self.capacity - offset
            else:
                seq, begin, left = full, full * self.capacity, self.tail_tokens % self.capacity
                size = 1 << (left.bit_length() - 1)
                while at >= begin + size:
                    begin, left, seq = begin + size, left - size, seq + 1
                    size = 1 << (left.bit_length() - 1)
                offset, room = at - begin, begin + size - at
            take = min(room, length)
            out.append((self.sequences + seq, offset, take))
            at, length = at + take, length - take
        return out

    def tail_sequences(self) -> int:
        return self.tail_tokens // self.capacity + bin(self.tail_tokens % self.capacity).count("1")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths within counts whose sum is the largest up to room: {length: times}."""
    mask, steps = (1 << room + 1) - 1, []
    reach = 1
    for length in sorted((x for x in counts if counts[x] > 0 and x <= room), reverse=True):
        times, power = min(counts[length], room // length), 1
        while times > 0:
            part = min(power, times)
            steps.append((length, part, reach))
            reach |= reach << length * part & mask
            times, power = times - part, power * 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + part
            at -= length * part
    return out


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Minimum bin slack over a histogram of lengths below the capacity."""
    left, used, out = {x: n for x, n in counts.items() if n > 0}, dict.fromkeys(counts, 0), Plan(capacity)
    for largest in sorted(left, reverse=True):
        while left[largest] > 0:
            left[largest] -= 1
            chosen = fullest(left, capacity - largest)
            left[largest] += 1
            chosen[largest] = chosen.get(largest, 0) + 1
            if sum(x * n for x, n in chosen.items()) < capacity:
                break  # with fewer lengths left no later choice can complete it either
            times, offset = min(left[x] // n for x, n in chosen.items()), 0
            for x, n in sorted(chosen.items(), reverse=True):
                out.runs.setdefault(x, []).append(Run(used[x], n, out.sequences, offset))
                used[x], left[x], offset = used[x] + n * times, left[x] - n * times, offset + n * x
            out.sequences += times
        if left[largest] > 0:
            out.tail[largest] = (used[largest], out.tail_tokens)
            out.tail_tokens += left[largest] * largest
            left[largest] = 0
    return out


def place(p: Plan, length: int, rank: int) -> list[tuple[int, int, int]]:
    """(sequence, offset, length) of the pieces of the remainder with this rank among its equals."""
    first, position = p.tail.get(length, (None, 0))
    if first is not None and rank >= first:
        return p.tail_cut(position + (rank - first) * length, length)
    runs = p.runs[length]
    run = runs[bisect_right(runs, rank, key=lambda r: r.start) - 1]
    row, slot = divmod(rank - run.start, run.each)
    return [(run.sequence + row, run.offset + slot * length, length)]


TOKENS = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("crcs", pa.list_(pa.int64())), ("rest", pa.int32()), ("rest_ids", pa.binary())])
PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _tokens(conf: Packing):
    def run(batches):
        encode, end, wide = ids_of(conf.tokenizer, conf.ranks, conf.pattern), np.array([conf.end_id], "<u4").tobytes(), 4 * conf.capacity
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), {f.name: [] for f in TOKENS}
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = (encode(text) if text else b"") + end
                    full = len(ids) // wide
                    rest = ids[full * wide :]
                    for name, value in zip(TOKENS.names, (doc, len(ids) // 4, [zlib.crc32(ids[i * wide : (i + 1) * wide]) for i in range(full)], len(rest) // 4, rest)):
                        out[name].append(value)
                yield arrow(out, TOKENS)

    return run


def _placed(conf: Packing, shared):
    def run(batches):
        the_plan, offsets, fulls, first_full = shared.value
        for batch in batches:
            at = batch.schema.get_field_index
            out = {f.name: [] for f in PIECES}
            for doc, total, crcs, rest, ids, pid, row, full_before in zip(*(batch.column(at(c)).to_pylist() for c in ("doc_id", "doc_tokens", "crcs", "rest", "rest_ids", "pid", "row", "full_before"))):
                pieces = [(i * conf.capacity, conf.capacity, crc, first_full + fulls[pid] + full_before + i, 0) for i, crc in enumerate(crcs)]
                begin = done = len(crcs) * conf.capacity
                if rest:
                    for seq, offset, length in place(the_plan, rest, offsets[pid, rest] + row):
                        pieces.append((done, length, zlib.crc32(ids[4 * (done - begin) : 4 * (done - begin + length)]), seq, offset))
                        done += length
                for start, length, crc, seq, offset in pieces:
                    for name, value in zip(PIECES.names, (doc, start, length, crc, total, seq, offset)):
                        out[name].append(value)
            yield arrow(out, PIECES)

    return run


def packed(docs: DataFrame, conf: Packing, tables: Tables | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of docs (doc_id, text).

    A null or empty text is its end id alone. Rows are packed one by one, so a repeated row is packed again; a
    doc_id may be null. An empty table gives no pieces; texts of any length are read whole, as many pieces as it takes.
    Equal lengths take their places in an order that doesn't depend on their texts. Sequences that end full hold ``capacity`` ids; the rest
    of the corpus, less than one sequence, is in sequences of powers of two.
    """
    tables = tables or Tables(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = tables.keep(docs.mapInArrow(_tokens(conf), "doc_id long, doc_tokens long, crcs array<long>, rest int, rest_ids binary"), "tokens")
    # equal remainders stand together over as many partitions as they fill; ranks are counted by partition
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = found.repartitionByRange(parts, "rest", F.xxhash64("doc_id")).sortWithinPartitions("rest")
    ordered = tables.keep(ordered.mapInArrow(_numbered, "doc_id long, doc_tokens long, crcs array<long>, rest int, rest_ids binary, pid int, row long, full_before long"), "ordered")
    tables.drop("tokens")
    # a row for each partition and each length in it: at most the partitions and lengths together, plus one each
    counts = ordered.groupBy("pid", "rest").agg(F.count("*").alias("n"), F.sum(F.size("crcs")).alias("full")).orderBy("pid", "rest").collect()
    offsets, fulls, histogram, full = {}, {}, {}, 0
    for r in counts:
        offsets[r.pid, r.rest] = histogram.get(r.rest, 0)
        histogram[r.rest] = histogram.get(r.rest, 0) + r.n
        fulls.setdefault(r.pid, full)
        full += r.full
    the_plan = plan({x: n for x, n in histogram.items() if x}, conf.capacity)
    shared = spark.sparkContext.broadcast((the_plan, offsets, fulls, the_plan.sequences + the_plan.tail_sequences()))
    return ordered.mapInArrow(_placed(conf, shared), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _numbered(batches):
    """Adds the partition, the rank among equal remainders in it, and its whole sequences so far."""
    from pyspark import TaskContext

    pid, last, row, full = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        rows, before = [], []
        at = batch.schema.get_field_index
        lengths = np.diff(batch.column(at("crcs")).offsets.to_numpy()).tolist()
        for rest, n in zip(batch.column(at("rest")).to_pylist(), lengths):
            row, last = (row + 1 if rest == last else 0), rest
            rows.append(row), before.append(full)
            full += n
        if rows:
            more = {"pid": pa.array([pid] * len(rows), pa.int32()), "row": pa.array(rows, pa.int64()), "full_before": pa.array(before, pa.int64())}
            yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], names=[*batch.schema.names, *more])
