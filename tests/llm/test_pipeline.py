"""The stages by themselves, and the whole against the plain versions."""

from __future__ import annotations

import brute
import corpus_pipeline as pipeline
import public_tokenizers
import pytest

from test_operators import ITEMS, ROWS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in ROWS], SCHEMA).repartition(3).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place


def test_run(spark, sf_dir):
    from tokenizers import Tokenizer

    from tessera.llm.quality import quality

    kept = {r.doc_id for r in quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("kept").collect()}
    rows = [(d, t) for d, t in ROWS if d in kept]
    assert not any(brute.quality_base(t)[-1] for _, t in rows)
    lines = {}
    for d, t in rows:
        lines[d] = t
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(brute.LOWER)
    holders = {}
    for d, t in sorted(rows):
        for x in t.split("\n"):
            holders.setdefault(key(x), []).append(d)
    rows = [(d, "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or min(holders[key(x)]) == d)) for d, t in rows]
    groups = brute.near_groups(rows)
    rows = [(d, t) for d, t in rows if groups[d][1] == d]
    hit = brute.decontamination(rows, ITEMS)
    rows = [(d, t) for d, t in rows if hit[d][1] == 0]
    pieces = [tuple(r) for r in pipeline.run(spark, sf_dir).collect()]
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert brute.check_packing(pieces, rows, lambda t: model.encode(t, add_special_tokens=False).ids) == 0


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stages_take_awkward_rows(spark, sf_dir, name, stage):
    long = " ".join(f"word{i} the" for i in range(40))
    rows = [(None, long, None, None, None), (None, None, "en", "s", 0), (7, long, "en", "s", 1), (7, long, "en", "s", 1), (7, long + " more", "xx", "s", 1), (8, long, "en", "s", 1), (9, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = stage(spark, docs, sf_dir)
    if name != "packing":
        assert out.columns == docs.columns
    got = [str(r["doc_id"]) for r in out.collect() if name != "packing" or r["start"] == 0]
    assert got.count("None") >= 1 and got.count("7") == 3
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


CLASHING = "keep string, kept string, _keep string, _kept string, n_lines string, n_dropped string, _row string, _gone string, _doc string, _tid string, _dropped string, _state string, _text string, component string, rep string, a long, b long, grp string, low long, high long"


@pytest.mark.parametrize("name,stage", pipeline.STAGES[:-1])
def test_stages_keep_clashing_columns(spark, sf_dir, name, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [c.split(" ") for c in CLASHING.split(", ")]
    wide = docs.selectExpr("*", *[f"cast({7 if kind == 'long' else repr('v-' + column)} as {kind}) as `{column}`" for column, kind in names])
    out = stage(spark, wide, sf_dir)
    assert out.columns == wide.columns
    plain = sorted(map(str, (tuple(r) for r in stage(spark, docs, sf_dir).collect())))
    rows = out.collect()
    assert sorted(str(tuple(r)[: len(docs.columns)]) for r in rows) == plain and plain
    assert all(r[column] == (7 if kind == "long" else "v-" + column) for r in rows for column, kind in names)


def test_run_leaves_its_result_alone(spark, sf_dir):
    """Tables of the stages are dropped when the next stage is written."""
    import os

    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    place = place.removeprefix("file:")
    before = set(os.listdir(place))
    out = pipeline.run(spark, sf_dir)
    assert out.count() > 0
    made = set(os.listdir(place)) - before
    assert len(made) == 1 and os.listdir(f"{place}/{made.pop()}") == [f"stage-{len(pipeline.STAGES) - 1}-packing"]
