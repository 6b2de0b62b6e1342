"""Removal of word windows that occur in an earlier document, by super-k-mer partitioning.

Texts that repeat whole are settled by their digest. In the others every window of 50 words has a minimiser, the
smallest hash of its runs of a few words; consecutive windows with one minimiser form a super-k-mer. A minimiser
seen in one document only can't have repeated windows, so only the super-k-mers of shared minimisers travel, each
as one packed string, to their minimiser's bucket. There, in order of doc_id, the windows' word sequences
themselves are counted: a window known from a smaller doc_id is removed. Crowded buckets don't meet in one task:
their windows are counted by digest, with partial sums before the shuffle.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kit import Tables, arrow, gram_hashes, groups, texts, word_hashes


@dataclass(frozen=True)
class SubstringDedup:
    window: int = 50
    #: Words of the runs that minimisers are hashes of.
    seed_words: int = 6
    #: Buckets with more windows or rows are counted by digest.
    bucket_windows: int = 40_000
    bucket_rows: int = 1_000


def sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def super_kmers(words: list[bytes], conf: SubstringDedup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, windows) of each super-k-mer; none for fewer words than a window."""
    n = len(words) - conf.window + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    seeds = gram_hashes(word_hashes(words), conf.seed_words)
    span = conf.window - conf.seed_words + 1
    least, width = seeds, 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    least = least[:n].view(np.int64)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return least[first], first, np.diff(np.append(first, n))


WHOLE = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("mins", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
PACKED = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("tid", pa.int64()), ("first", pa.int32()), ("packed", pa.binary()), ("crowded", pa.bool_())])
GONE = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
DIGESTS = pa.schema([("digest", pa.binary()), ("doc_id", pa.int64()), ("tid", pa.int64()), ("starts", pa.list_(pa.int32()))])
LEFT = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _whole(conf: SubstringDedup):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = {f.name: [] for f in WHOLE}
                for doc, tid, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), texts(part.column(1))):
                    words = (text or b"").split()
                    got = super_kmers(words, conf)
                    for name, value in zip(WHOLE.names, (doc, tid, len(words), sha(words), *got)):
                        out[name].append(value)
                yield arrow(out, WHOLE)

    return run


def _packed(conf: SubstringDedup):
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            (doc, tid), runs = (batch.column(at(c)).to_pylist() for c in ("doc_id", "tid")), batch.column(at("runs"))
            for i, text in enumerate(texts(batch.column(at("text")))):
                words = (text or b"").split()
                out = {f.name: [] for f in PACKED}
                for r in runs[i].as_py():
                    out["bucket"].append(r["bucket"])
                    out["first"].append(r["first"])
                    out["packed"].append(b" ".join(words[r["first"] : r["first"] + r["count"] + conf.window - 1]))
                    out["crowded"].append(r["crowded"])
                out["doc_id"], out["tid"] = [doc[i]] * len(out["bucket"]), [tid[i]] * len(out["bucket"])
                yield arrow(out, PACKED)

    return run


def windows(packed: bytes, size: int) -> list[bytes]:
    """The word sequences of a packed string's windows, in order."""
    ends = np.flatnonzero(np.frombuffer(packed, np.uint8) == 0x20)
    starts = np.concatenate(([0], ends + 1)).tolist()
    stops = np.append(ends, len(packed)).tolist()
    return [packed[a:b] for a, b in zip(starts, stops[size - 1 :])]


def _runs(doc: int, tid: int, hits: list[int], size: int, out: dict) -> None:
    """Windows that go, as ranges of words."""
    if hits:
        hits = np.array(hits)
        cut = np.flatnonzero(np.diff(hits) > 1)
        for a, b in zip(hits[np.append(0, cut + 1)].tolist(), hits[np.append(cut, len(hits) - 1)].tolist()):
            out["doc_id"].append(doc), out["tid"].append(tid), out["start"].append(a), out["stop"].append(b + size)


def _counted(conf: SubstringDedup):
    """Buckets arrive whole, their rows by doc_id: the first document of a window is its smallest."""

    def run(batches):
        out = {f.name: [] for f in GONE}
        for _, slices in groups(batches, ("bucket",)):
            first_in: dict[bytes, int] = {}
            for part in slices:
                at = part.schema.get_field_index
                for doc, tid, start, packed in zip(*(part.column(at(c)).to_pylist() for c in ("doc_id", "tid", "first", "packed"))):
                    hits = [start + i for i, w in enumerate(windows(packed, conf.window)) if first_in.setdefault(w, doc) < doc]
                    _runs(doc, tid, hits, conf.window, out)
            if len(out["doc_id"]) > 5_000:
                yield arrow(out, GONE)
                out = {f.name: [] for f in GONE}
        yield arrow(out, GONE)

    return run


def _digests(conf: SubstringDedup):
    """A row for each distinct window of a super-k-mer, with its places: periodic texts repeat few windows often."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            for doc, tid, start, packed in zip(*(batch.column(at(c)).to_pylist() for c in ("doc_id", "tid", "first", "packed"))):
                found: dict[bytes, list[int]] = {}
                for i, w in enumerate(windows(packed, conf.window), start):
                    found.setdefault(xxhash.xxh3_128_digest(w), []).append(i)
                yield arrow({"digest": list(found), "doc_id": [doc] * len(found), "tid": [tid] * len(found), "starts": list(found.values())}, DIGESTS)

    return run


def _left(conf: SubstringDedup):
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            out = {f.name: [] for f in LEFT}
            for doc, tid, text, gone in zip(batch.column(at("doc_id")).to_pylist(), batch.column(at("tid")).to_pylist(), texts(batch.column(at("text"))), batch.column(at("gone")).to_pylist()):
                words = (text or b"").split()
                keep = np.ones(len(words), bool)
                for g in gone:
                    keep[g["start"] : g["stop"]] = False
                kept = [w for w, k in zip(words, keep.tolist()) if k]
                for name, value in zip(LEFT.names, (doc, tid, len(words) - len(kept), sha(kept), b" ".join(kept).decode())):
                    out[name].append(value)
            yield arrow(out, LEFT)

    return run


def removed(docs: DataFrame, conf: SubstringDedup = SubstringDedup(), tables: Tables | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text for each document of docs (doc_id, text).

    kept_text is null where nothing was removed (the text itself stands). A null or short text keeps all its
    words. Rows that share a doc_id don't remove words from each other. Rows without a doc_id remove nothing and
    lose nothing. Of documents with the same window the smallest doc_id keeps it. Texts of any length are read whole;
    an empty table gives no rows; other columns of docs don't matter.
    """
    tables = tables or Tables(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tid", F.xxhash64("text"))
    whole = tables.keep(docs.mapInArrow(_whole(conf), "doc_id long, tid long, n_words long, sha string, mins array<long>, firsts array<int>, counts array<int>"), "whole")
    known = F.col("doc_id").isNotNull() & (F.col("n_words") >= conf.window)
    first = tables.keep(whole.where(known).groupBy("sha").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last"), "repeats")
    base = whole.join(first.select("sha", "rep"), "sha", "left")
    base = base.withColumn("copy", F.coalesce(F.col("doc_id") > F.col("rep"), F.lit(False)))

    runs = base.where(~F.col("copy") & F.col("doc_id").isNotNull()).select("doc_id", "tid", F.explode(F.arrays_zip("mins", "firsts", "counts")).alias("r"))
    runs = tables.keep(runs.select(F.col("r.mins").alias("bucket"), "doc_id", "tid", F.col("r.firsts").alias("first"), F.col("r.counts").alias("count")), "runs")
    stats = runs.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"), F.sum("count").alias("w")).where("low < high")
    stats = tables.keep(stats.select("bucket", ((F.col("n") > conf.bucket_rows) | (F.col("w") > conf.bucket_windows)).alias("crowded")), "stats")
    shared = runs.join(stats, "bucket").groupBy("doc_id", "tid").agg(F.collect_list(F.struct("bucket", "first", "count", "crowded")).alias("runs"))
    marked = tables.keep(docs.join(shared, ["doc_id", "tid"]), "marked")
    tables.drop("runs")

    packed = tables.keep(marked.mapInArrow(_packed(conf), "bucket long, doc_id long, tid long, first int, packed binary, crowded boolean"), "packed")
    dealt = packed.where("not crowded").repartition("bucket").sortWithinPartitions("bucket", "doc_id", "first")
    gone = dealt.mapInArrow(_counted(conf), "doc_id long, tid long, start int, stop int")
    digests = packed.where("crowded").mapInArrow(_digests(conf), "digest binary, doc_id long, tid long, starts array<int>")
    # kept as tables: joins of two plain shuffles are those whose hot keys Spark can split
    digests = tables.keep(digests, "digests")
    least = tables.keep(digests.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("digest", "low"), "least")
    crowd = digests.join(least, "digest").where("doc_id > low").select("doc_id", "tid", F.explode("starts").alias("start")).withColumn("stop", F.col("start") + conf.window)
    ranges = gone.union(crowd).groupBy("doc_id", "tid").agg(F.collect_list(F.struct("start", "stop")).alias("gone"))
    left = marked.select("doc_id", "tid", "text").dropDuplicates(["doc_id", "tid"]).join(ranges, ["doc_id", "tid"]).mapInArrow(_left(conf), "doc_id long, tid long, n_removed long, kept_sha256 string, kept_text string")
    left = tables.keep(left, "left")
    tables.drop("packed", "marked", "digests", "least", "stats")
    none = F.lit(sha([]))
    out = base.join(left, ["doc_id", "tid"], "left")
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), none).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )
