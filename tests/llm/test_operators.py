"""The operators against plain versions of their contracts, on small tables with awkward rows."""

from __future__ import annotations

import random

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm.decontaminate import contamination
from tessera.llm.licenses import licenses
from tessera.llm.line_dedup import without_repeats
from tessera.llm.near_dedup import NearDedup, near_groups
from tessera.llm.packing import Packing, packed
from tessera.llm.pii import personal_data
from tessera.llm.quality import quality
from tessera.llm.queries import PACKING
from tessera.llm.substring_dedup import SubstringDedup, removed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component string, keep string, bands string"


def corpus(seed: int = 1) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    vocab = ["the", "of", "and", "MIT", "Été", "straße", "x1", "a.b@c.org", "+49 (30) 555-1234", "10.0.0.255", "999.1.1.1", "4539 5787 6362 1486", "naïve", "日本", "de", "la", "–", "ok"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = [text(n) for n in (400, 120, 60, 49, 50, 51, 9, 5, 4, 1)]
    rows: list[str | None] = [*base, *base, None, "", " \t\n", "\n\n", "same line of text\nsame line of text\nother", "Same Line of TEXT  \nshort\nother", "a\r\n\x0b\x0cb"]
    for b in base[:3]:
        for k in (1, 2, 5, 20):
            w = b.split(" ")
            for _ in range(k):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(" ".join(w))
        rows.append(text(30) + " " + b + "\n" + text(30))
        rows.append(b[: len(b) // 2])
    rows += ["Released under the MIT License. Under the mit license, cc by nc", "Apache License, Version 2.0 apache license version 2", "word " * 3000, "x" * 50_000, "1" * 20_000, "@" * 3000, "a.b." * 3000, "\n" * 2000, "is onhe. " * 700]
    rows += ["one two three four five six seven eight nine ten " + text(8), "Only FOUR words here-and more"]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(10 * i + 3, rows[j]) for i, j in enumerate(order)]


ROWS = corpus()
ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "FOUR words, here"), (3, None), (4, "..."), (5, " ".join(t for t in (ROWS[0][1] or "x").split()[:30]))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en" if d % 2 else None, "s", 1, "x", "y", "z", "b") for d, t in ROWS], SCHEMA).repartition(3)


def by_id(df, *columns):
    return {r[0]: tuple(r)[1:] if len(columns) > 1 else r[1] for r in df.select("doc_id", *columns).collect()}


def test_near_groups(docs):
    got = by_id(near_groups(docs), "n_shingles", "component_id", "kept")
    want = {d: (n, c, d == c) for d, (n, c) in brute.near_groups(ROWS).items()}
    assert got == want


@pytest.mark.parametrize("conf", [NearDedup(block=3), NearDedup(block=2, most_blocks=2)])
def test_near_groups_in_blocks(docs, conf):
    assert by_id(near_groups(docs, conf), "component_id") == {d: c for d, (_, c) in brute.near_groups(ROWS).items()}


def drifting(seed: int, n: int = 24) -> list[tuple[int, str]]:
    """Texts that drift away word by word: neighbours are near copies, the first and the last have little in common;
    beside them a family of near copies of one text, and texts that are alike but not enough."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10_000)}"
    now = [word() for _ in range(120)]
    rows = []
    for _ in range(n):
        rows.append(" ".join(now))
        now[rng.randrange(len(now))] = word()
    base = [word() for _ in range(150)]
    for k in range(n):
        copy = list(base)
        for _ in range(1 + k % 7):
            copy[rng.randrange(len(copy))] = word()
        rows.append(" ".join(copy))
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(7 * i + 1, rows[j]) for i, j in enumerate(order)]


@pytest.mark.parametrize("conf", [NearDedup(), NearDedup(block=2), NearDedup(block=3, most_blocks=1)])
@pytest.mark.parametrize("seed", [1, 2])
def test_chains_of_near_copies(spark, conf, seed):
    rows = drifting(seed)
    got = by_id(near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), conf), "n_shingles", "component_id")
    want = brute.near_groups(rows)
    assert got == want
    assert max(sum(c == r for _, c in want.values()) for r in {c for _, c in want.values()}) > 10


def test_pii(docs):
    got = by_id(personal_data(docs), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    for d, t in ROWS:
        assert got[d][:5] == brute.pii(t)
        assert set(brute.base_spans(t)) <= set(got[d][5].split(","))


def test_lines(docs):
    out = without_repeats(docs)
    got = by_id(out.withColumn("sha", F.sha2("kept", 256)), "n_lines", "n_dropped", "sha")
    assert got == brute.line_dedup(ROWS)


def test_licences(docs):
    got = by_id(licenses(docs), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    for d, t in ROWS:
        assert got[d][:5] == brute.licence_base(t)
        assert set(filter(None, got[d][4].split(","))) <= set(got[d][5].split(","))
        assert 0 <= got[d][6] <= 1


def test_contamination(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = contamination(docs, items).withColumn("sha", F.sha2(F.array_join("items", ","), 256))
    got = by_id(out, "n_words", "n_hit", "items", "sha", "spans")
    for d, want in brute.decontamination(ROWS, ITEMS).items():
        n, hit, found, sha, spans = got[d]
        assert (n, hit, len(found), sha) == want
        text = dict(ROWS)[d] or ""
        assert sum(len(brute.PLAIN.findall(text[s.start : s.end].translate(brute.LOWER))) for s in spans) == hit


@pytest.mark.parametrize("most", [1, 7, 11, 30])
def test_contamination_in_passes(spark, docs, most):
    """A benchmark beyond one automaton: the same rows, in as many passes as it takes."""
    from tessera.llm.decontaminate import Decontaminate, parts_of, uncontaminated, windows_of

    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole, conf = contamination(docs, items), Decontaminate(most_words=most)
    assert sorted(map(str, contamination(docs, items, conf).collect())) == sorted(map(str, whole.collect()))
    clean = {r.doc_id for r in whole.where("n_hit = 0").collect()}
    assert {r.doc_id for r in uncontaminated(docs, items, conf).collect()} == clean
    raw = [(str(i), t.encode()) for i, t in ITEMS if t]
    spelled = lambda part: {(tuple(part.vocabulary[x - 1] for x in ids[i : i + 10]), item) for item, ids in part.runs for i in range(max(1, len(ids) - 9))}
    parts = list(parts_of(raw, 10, most))
    assert set().union(*map(spelled, parts)) == spelled(windows_of(raw, 10)) and len(parts) > 1


@pytest.mark.parametrize("crowd", [1, 2, 5])
def test_crowded_lines(docs, crowd):
    """Hashes that are settled from partial minima give what the stream gives."""
    from tessera.llm.line_dedup import LineDedup

    got = by_id(without_repeats(docs, LineDedup(crowd=crowd)).withColumn("sha", F.sha2("kept", 256)), "n_lines", "n_dropped", "sha")
    assert got == brute.line_dedup(ROWS)


def plain_kept(text, lang):
    """The verdict of the quality rules, from the definition of the Jensen-Shannon distance."""
    from math import log2, sqrt

    from tessera.llm import quality as q

    conf = q.Quality()
    n, *_, failed = brute.quality_base(text)
    words = brute.SPACED.findall(text or "")
    space = " \t\n\x0b\x0c\r"
    kind = lambda c: 6 if ord(c) > 127 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in space else 4 if c in ".,;:!?'\"()-" else 5
    chars = [sum(kind(c) == k for c in text or "") for k in range(7)]

    def distance(p, shares):
        p = [x / max(1, sum(p)) for x in p]
        part = lambda u: sum(x * log2(2 * x / (y + z)) for x, y, z in zip(u, p, shares) if x > 0)
        return sqrt(min(1, max(0, (part(p) + part(shares)) / 2)))

    by_char, by_word, rest = [], [], []
    for code, line in q.COMMON.items():
        own = line.split()
        share = [q.FIRST_SHARE / r for r in range(1, len(own) + 1)]
        every = own + sorted({w for x in q.COMMON.values() for w in x.split()} - set(own))
        count = [words.count(w) for w in every]
        rest.append(1 - sum(share))
        by_word.append(distance([*count, n - sum(count)], [*share, *[0] * (len(every) - len(own)), 1 - sum(share)]))
        by_char.append(distance(chars, [x / sum(q.CHAR_SHARES[code]) for x in q.CHAR_SHARES[code]]))
    common = distance([chars[0] + chars[1] + chars[6], *chars[2:6]], q.ANY_SHARES)
    d_char, d_word = min(by_char), min(by_word)
    if lang is None:
        d_char = min(d_char, common)
    elif lang not in q.COMMON:
        d_char, d_word = common, 0
    few = n - sum(count) > max(rest) * n
    odd = n >= conf.char_guard and d_char > conf.char_limit or n >= conf.word_guard and d_char > conf.both_char and d_word > conf.both_word and few
    return not failed and not odd


def test_verdicts_against_a_plain_version(spark):
    rng, rows = random.Random(11), []
    common = "the of and to in a is der die und de la que el".split()
    for i in range(250):
        alphabet = rng.choice(["abcdefghij", "ABCDEFGH", "абвгдежз", "#$%&*|<>", "0123456789", "aAbB1#é", "あいうえお"])
        word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7)))
        said = [rng.choice(common) if rng.random() < rng.choice([0, 0.2, 0.4]) else word() + rng.choice(["", "", ".", ",", "!!"]) for _ in range(rng.choice([5, 15, 25, 59, 60, 120]))]
        rows.append((i, " ".join(said), rng.choice(["en", "de", "ru", "ja", None])))
    rows += [(300, None, "en"), (301, "", None), (302, " \n", "ru")]
    got = {r.doc_id: r.kept for r in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {i: plain_kept(t, lang) for i, t, lang in rows}
    assert 30 < sum(got.values()) < 220


def test_verdicts_do_not_depend_on_neighbours(spark):
    from tessera.llm.quality import passing

    df = spark.createDataFrame([(d, t, "en" if d % 2 else None) for d, t in ROWS], "doc_id long, text string, lang string")
    whole = {r.doc_id: tuple(r) for r in quality(df).collect()}
    half = {r.doc_id: tuple(r) for r in quality(df.where("doc_id % 4 = 3")).collect()}
    assert half and all(whole[d] == row for d, row in half.items())
    assert {r.doc_id for r in passing(df).collect()} == {d for d, row in whole.items() if row[7]}


def test_fitted_references(spark):
    from tessera.llm.quality import Quality, fitted

    text = lambda i: ("Some words of the text, and more. " * 12) + f"n{i}"
    df = spark.createDataFrame([(i, text(i) if i % 3 else "### $$$ " * 40, "xx") for i in range(30)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(30)], "doc_id long, quality int")
    refs = fitted(df, labels, most=7)
    assert set(refs) == {"xx"} and all(abs(sum(x) - 1) < 1e-9 for x in refs["xx"])
    got = {r.doc_id: r.char_distance for r in quality(df, Quality(), refs).collect()}
    assert all((d < 0.05) == bool(i % 3) for i, d in got.items())
    assert fitted(df.limit(0), labels) == {}


@pytest.mark.parametrize("conf", [SubstringDedup(), SubstringDedup(bucket_rows=1)])
def test_substrings(docs, conf):
    assert by_id(removed(docs, conf), "n_words", "n_removed", "kept_sha256") == brute.substring_dedup(ROWS)


def test_packing(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    for conf in (Packing(path), PACKING):
        pieces = [tuple(r) for r in packed(docs, conf).collect()]
        assert brute.check_packing(pieces, ROWS, lambda t: model.encode(t, add_special_tokens=False).ids) == 0


def test_quality(docs):
    got = by_id(quality(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for d, t in ROWS:
        assert got[d][:6] == brute.quality_base(t)
        assert not (got[d][5] and got[d][6])


APPLY = {
    "near": lambda d, s: near_groups(d),
    "pii": lambda d, s: personal_data(d),
    "lines": lambda d, s: without_repeats(d),
    "licences": lambda d, s: licenses(d),
    "contamination": lambda d, s: contamination(d, s.createDataFrame(ITEMS, "item_id long, text string")),
    "substrings": lambda d, s: removed(d),
    "packing": lambda d, s: packed(d, Packing(public_tokenizers.path("byte_bpe_50k.json"))),
    "quality": lambda d, s: quality(d),
}


@pytest.mark.parametrize("name", APPLY)
def test_empty_table(spark, name):
    assert APPLY[name](spark.createDataFrame([], SCHEMA), spark).count() == 0


@pytest.mark.parametrize("name", APPLY)
def test_null_ids_and_repeated_rows(spark, name):
    """Each row gives one row (a piece at least, when packing), whatever its doc_id; repeated rows aren't lost."""
    long = " ".join(f"word{i}" for i in range(80)) + "\na line that comes again and again"
    rows = [(None, long), (None, None), (7, long), (7, long), (7, long + " more"), (8, long), (9, None)]
    out = APPLY[name](spark.createDataFrame([(d, t, None, None, None, None, None, None, None) for d, t in rows], SCHEMA), spark).collect()
    out = [r for r in out if "start" not in r or r["start"] == 0]
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(d) for d, _ in rows)


def test_null_ids_stay(spark):
    long = " ".join(f"word{i}" for i in range(80))
    df = spark.createDataFrame([(None, long), (None, long), (5, long), (6, long)], "doc_id long, text string")
    assert sorted(map(str, (tuple(r)[2:] for r in near_groups(df).collect()))) == sorted(["(None, True)", "(None, True)", "(5, True)", "(5, False)"])
    assert sorted(r.n_removed for r in removed(df).collect()) == [0, 0, 0, 80]
    assert sorted(r.n_dropped for r in without_repeats(df).collect()) == [0, 0, 0, 1]
