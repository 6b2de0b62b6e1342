"""Near-duplicate documents by SuperMinHash.

Documents with the same shingle set form a class at once. Class representatives are banded by their signature, and
those that share a band's bucket may be linked. First each is confirmed, on the full sets, against the bucket's
smallest member that it shares most bands with; what is linked so is one component, and a bucket with a single
component is settled. Of the others, components that share a bucket form families. All pairs of a family's members
from different components, but for those both in its largest one, meet in blocks: with a common bucket and a
sufficient estimate they are confirmed on the full sets, until union-find shows them joined already. Components of all
confirmed links are the groups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.graph import EDGES, UnionFind, components
from tessera.llm.kit import Tables, arrow, gram_hashes, groups, texts, word_hashes
from tessera.llm.superminhash import bands, signatures

MEMBERS = pa.schema([("rep", pa.int64()), ("hashes", pa.binary()), ("sig", pa.binary())])
SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("bands", pa.list_(pa.int64()))])


@dataclass(frozen=True)
class NearDedup:
    """Parameters. A pair at the threshold is missed with probability (1 - 0.85**5)**24 = 8e-7 by the bands and
    with about 2e-6 by the estimate."""

    shingle_words: int = 5
    percent: int = 85
    slots: int = 120
    rows: int = 5
    #: Estimates that lie this far below the threshold aren't confirmed on the sets.
    slack: float = 0.15
    #: Members of a block; two blocks are in memory at a time.
    block: int = 512
    #: Families with more blocks beside their largest component are compared by bucket.
    most_blocks: int = 24


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Distinct hashed n-word shingles of the lower-cased (A-Z) text; the whole sequence if it has fewer words."""
    return np.unique(gram_hashes(word_hashes(text.lower().split()), n)) if text else np.empty(0, np.uint64)


def _sets(conf: NearDedup):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, conf.shingle_words) for t in texts(part.column(1))]
                sizes = [len(s) for s in sets]
                keys = bands(signatures(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets), conf.slots), conf.rows)
                yield arrow({"doc_id": part.column(0).to_pylist(), "n_shingles": sizes, "fp": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "bands": [k if n else [] for k, n in zip(keys, sizes)]}, SETS)

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    low, high = sorted((len(a), len(b)))
    if not low or 100 * low < percent * high:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def confirmed(comps: list, sets: list[np.ndarray], sig: np.ndarray, sides: list[int], conf: NearDedup) -> list[tuple]:
    """The links that join components of members; only pairs of different sides are compared if there are two."""
    sizes = np.array([len(s) for s in sets])
    keys = bands(sig, conf.rows)
    side, two, out, union = np.array(sides), len(set(sides)) > 1, [], UnionFind()
    buckets: dict[tuple[int, int], list[int]] = {}
    for i in range(len(sets)):
        near = set()
        for b, key in enumerate(keys[i].tolist()):
            mates = buckets.setdefault((b, key), [])
            near.update(mates)
            mates.append(i)
        if not near:
            continue
        near = np.fromiter(near, np.int64, len(near))
        near.sort()
        if two:
            near = near[side[near] != side[i]]
        low, high = np.minimum(sizes[near], sizes[i]), np.maximum(sizes[near], sizes[i])
        near = near[100 * low >= conf.percent * high]
        near = near[(sig[near] == sig[i]).mean(axis=1) >= conf.percent / 100 - conf.slack]
        for j in near.tolist():
            if union.root(comps[i]) != union.root(comps[j]) and similar(sets[i], sets[j], conf.percent):
                union.join(comps[i], comps[j])
                out.append((comps[i], comps[j]))
    return out


def _members(conf: NearDedup):
    """Hashed sets and signatures of texts (rep, text), for those that will be compared."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, conf.shingle_words) for t in texts(part.column(1))]
                sig = signatures(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets), conf.slots)
                yield arrow({"rep": part.column(0).to_pylist(), "hashes": [s.tobytes() for s in sets], "sig": [x.tobytes() for x in sig]}, MEMBERS)

    return run


def _led(conf: NearDedup):
    """Links of members with their lead; its rows come first in a group, so that only its sets are held."""

    def run(batches):
        for (lead, _), slices in groups(batches, ("lead", "part")):
            known: dict[bytes, np.ndarray] = {}
            found = set()
            for part in slices:
                at = part.schema.get_field_index
                for rep, raw in zip(part.column(at("rep")).to_pylist(), part.column(at("hashes")).to_pylist()):
                    own = np.frombuffer(raw, np.uint64)
                    if rep == lead:
                        known.setdefault(raw, own)
                    elif rep not in found and any(similar(own, x, conf.percent) for x in known.values()):
                        found.add(rep)
            if found:
                yield arrow({"a": [lead] * len(found), "b": list(found)}, EDGES)

    return run


def _links(conf: NearDedup):
    def run(batches):
        for (_, low, high), slices in groups(batches, ("grp", "low", "high")):
            comps, sets, sigs, sides, seen = [], [], [], [], set()
            for part in slices:
                at = part.schema.get_field_index
                for rep, comp, side, raw, sig in zip(*(part.column(at(c)).to_pylist() for c in ("rep", "comp", "side", "hashes", "sig"))):
                    mark = (rep, xxhash.xxh3_64_intdigest(raw))
                    if raw and mark not in seen:
                        seen.add(mark)
                        comps.append(comp), sets.append(np.frombuffer(raw, np.uint64)), sigs.append(np.frombuffer(sig, np.float64)), sides.append(side)
            if len(sets) > 1:
                found = confirmed(comps, sets, np.array(sigs), sides if low != high else [0] * len(sides), conf)
                if found:
                    yield arrow({"a": [a for a, _ in found], "b": [b for _, b in found]}, EDGES)

    return run


def _blocked(members: DataFrame, conf: NearDedup) -> DataFrame:
    """members (grp, rep, comp): one row for each pair of blocks that a member belongs to.

    The members of a group's largest component have blocks of their own, 0 to -n, which meet those of the others alone.
    """
    sizes = members.groupBy("grp", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("grp").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("mains"), F.sum("n").alias("size"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(conf.block)).cast("int"))
    rows = members.join(main, "grp").withColumns({"ours": F.col("comp") == F.col("main"), "heads": blocks(F.col("mains")), "rests": blocks(F.col("size") - F.col("mains"))})
    place = F.pmod(F.xxhash64("rep"), F.when(F.col("ours"), F.col("heads")).otherwise(F.col("rests"))).cast("int")
    rows = rows.withColumn("block", F.when(F.col("ours"), -place).otherwise(place + 1))
    others = F.sequence(F.lit(1), F.col("rests"))
    mates = F.when(F.col("ours"), others).otherwise(F.concat(others, F.sequence(-F.col("heads") + 1, F.lit(0))))
    rows = rows.select("grp", "rep", "comp", "block", F.explode(mates).alias("mate"))
    return rows.select("grp", "rep", "comp", F.col("block").alias("side"), F.least("block", "mate").alias("low"), F.greatest("block", "mate").alias("high"))


def near_groups(docs: DataFrame, conf: NearDedup = NearDedup(), tables: Tables | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text; more columns do no harm).

    A null or wordless text has no shingles and is linked with nothing. Rows that share a doc_id are one
    document, linked by each of its texts. A row without a doc_id is linked with nothing, has no component_id and is
    kept. Of equal texts the smallest doc_id stands for all. Texts of any length are read whole. An empty table gives
    no rows.
    """
    tables = tables or Tables(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = tables.keep(docs.mapInArrow(_sets(conf), "doc_id long, n_shingles long, fp binary, bands array<long>"), "sets")
    classes = tables.keep(own.where("n_shingles > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")

    entry = classes.select("rep", F.posexplode("bands").alias("band", "key")).select("rep", F.xxhash64("band", "key").alias("key"))
    buckets = entry.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last"), F.count("*").alias("n")).where("lead < last")
    entry = tables.keep(entry.join(buckets, "key").select("rep", "key", "lead", "n"), "entries")

    # each with one lead
    shared = entry.where("rep <> lead").groupBy("rep", "lead").agg(F.count("*").alias("n"))
    leads = tables.keep(shared.groupBy("rep").agg(F.max_by("lead", F.struct("n", -F.col("lead"))).alias("lead")), "leads")
    parts = leads.groupBy("lead").agg(F.ceil(F.count("*") / F.lit(conf.block)).cast("int").alias("parts"))
    led = leads.join(parts, "lead").select("rep", "lead", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"))
    heads = parts.select(F.col("lead").alias("rep"), "lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    led = tables.keep(led.union(heads), "led")
    ids = tables.keep(led.select("rep").distinct(), "ids")
    own_texts = docs.join(ids, docs.doc_id == ids.rep).select("rep", "text")
    members = tables.keep(own_texts.mapInArrow(_members(conf), "rep long, hashes binary, sig binary"), "member-sets")
    dealt = members.select("rep", "hashes").join(led, "rep").select("lead", "part", "rep", "hashes", (F.col("rep") != F.col("lead")).alias("later"))
    dealt = dealt.repartition("lead", "part").sortWithinPartitions("lead", "part", "later")
    first = tables.keep(dealt.mapInArrow(_led(conf), "a long, b long"), "first-links")
    joined = tables.keep(components(first, tables, "first"), "first-groups").select(F.col("node").alias("rep"), F.col("component").alias("comp"))

    # what shares a bucket and isn't joined yet
    known = tables.keep(entry.join(joined, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "known")
    open_ = tables.keep(known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key", "low"), "open")
    left = tables.keep(known.join(open_, "key").select("key", "rep", "comp", "low"), "left")
    named = classes.select("fp", "rep").join(joined, "rep", "left").select("fp", F.coalesce("comp", "rep").alias("comp"))
    if left.isEmpty():
        named = named.withColumnRenamed("comp", "component")
    else:
        family = components(left.select(F.col("low").alias("a"), F.col("comp").alias("b")), tables, "family").select(F.col("node").alias("comp"), F.col("component").alias("grp"))
        rows = tables.keep(left.select("rep", "comp").distinct().join(family, "comp").select("grp", "rep", "comp"), "members")
        rests = rows.groupBy("grp", "comp").agg(F.count("*").alias("n")).groupBy("grp").agg((F.sum("n") - F.max("n")).alias("rest"))
        wide = tables.keep(rests.where(F.col("rest") > conf.block * conf.most_blocks).select("grp"), "wide")
        pairs = _blocked(rows.join(wide, "grp", "left_anti"), conf)
        if not wide.isEmpty():
            crowd = rows.join(wide, "grp", "left_semi").select("rep", "comp")
            by_bucket = left.select("key", "rep").distinct().join(crowd, "rep").select(F.col("key").alias("grp"), "rep", "comp")
            pairs = pairs.union(_blocked(by_bucket, conf))
        dealt = members.join(pairs, "rep").repartition("grp", "low", "high").sortWithinPartitions("grp", "low", "high")
        links = tables.keep(dealt.mapInArrow(_links(conf), "a long, b long"), "links")
        more = components(links, tables, "groups").select(F.col("node").alias("comp"), "component")
        named = named.join(more, "comp", "left").select("fp", F.coalesce("component", "comp").alias("component"))
    out = own.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("fp")).alias("fp")).join(named, "fp", "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
