"""Parts of the operators by themselves."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import crf, gbt, licenses, packing, pii, quality, url_filter, wrapper
from tessera.llm.graph import UnionFind, components
from tessera.llm.kit import Tables
from tessera.llm.superminhash import bands, signatures


def sign(sets, m=120):
    sizes = [len(s) for s in sets]
    x = np.concatenate([np.array(sorted(s), np.uint64) for s in sets]) if sets else np.empty(0, np.uint64)
    return signatures(x, np.repeat(np.arange(len(sets)), sizes), len(sets), m)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for share in (0.2, 0.5, 0.85):
        for _ in range(60):
            n = 200
            both = int(round(2 * n * share / (1 + share)))
            pool = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            a, b = sign([set(pool[:n].tolist()), set(pool[n - both :].tolist())])
            errors.append((a == b).mean() - both / (2 * n - both))
    assert abs(np.mean(errors)) < 0.01
    assert np.std(errors) < 0.045


def test_signature_is_the_sequential_one():
    """Against the method's own loop, element by element with early stopping."""
    from tessera.llm.kit import GOLDEN, mix

    rng, m = np.random.default_rng(5), 16
    for n in (1, 3, 40):
        xs = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        h = np.full(m, np.inf)
        for x in xs:
            p, j = list(range(m)), 0
            while j < m and h.max() >= j:
                z = int(mix(np.array([int(x) + (2 * j + 1) * int(GOLDEN) & (1 << 64) - 1], np.uint64))[0])
                k = j + ((z & 0xFFFFFF) * (m - j) >> 24)
                p[j], p[k] = p[k], p[j]
                h[p[j]] = min(h[p[j]], (z >> 24) * 2.0**-40 + j)
                j += 1
        assert (sign([set(xs.tolist())], m)[0] == h).all()


def test_equal_sets_share_all_bands():
    a, b, c = bands(sign([{1, 2, 3}, {3, 2, 1}, {4, 5, 6}]), 5)
    assert (a == b).all() and not (a == c).any()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(159, 7), (500, 501), (501, 500), (9, 9)]
    want = UnionFind()
    for a, b in edges:
        want.join(a, b)
    df = spark.createDataFrame([*edges, (None, 1)], "a long, b long").repartition(7)
    got = {r.node: r.component for r in components(df, Tables(spark), "t").collect()}
    assert got == {x: want.root(x) for x in got} and set(got) == {x for e in edges if e[0] != e[1] for x in e}


def test_components_with_hubs(spark, monkeypatch):
    """Nodes of many edges take the broadcast side of the joins."""
    from tessera.llm import graph

    monkeypatch.setattr(graph, "HUB_ROWS", 3)
    rng = np.random.default_rng(9)
    edges = [(0, i) for i in range(1, 200)] + [(i, 999) for i in range(200, 300)] + [(int(a), int(b)) for a, b in rng.integers(300, 900, (400, 2))] + [(150, 250)]
    want = UnionFind()
    for a, b in edges:
        want.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(11), Tables(spark), "h").collect()}
    assert got == {x: want.root(x) for x in got} and set(got) == {x for e in edges if e[0] != e[1] for x in e}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 31), st.integers(1, 40), max_size=12))
def test_plan_places_every_piece(counts):
    capacity = 32
    p = packing.plan(counts, capacity)
    held: dict[int, list[tuple[int, int]]] = {}
    for length, n in counts.items():
        for rank in range(n):
            parts = packing.place(p, length, rank)
            assert sum(x[2] for x in parts) == length
            for seq, offset, size in parts:
                held.setdefault(seq, []).append((offset, size))
    assert set(held) == set(range(p.sequences + p.tail_sequences()))
    for parts in held.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at == capacity or at & (at - 1) == 0


@given(st.dictionaries(st.integers(1, 20), st.integers(1, 4), max_size=6), st.integers(0, 40))
def test_fullest_is_the_best(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * k for s in sums for k in range(n + 1)}
    chosen = packing.fullest(counts, room)
    assert sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= room)
    assert all(n <= counts[x] for x, n in chosen.items())


@settings(deadline=None, max_examples=400)
@given(st.one_of(st.text(alphabet="ab1 \n\té'<|>\x1c\x85\xa0.²ª", max_size=40), st.text(st.characters(max_codepoint=0x24F), max_size=30), st.text(max_size=20)))
def test_both_libraries_give_the_same_ids(text):
    from tessera.llm.queries import PACKING

    ids = packing.ids_of(PACKING.tokenizer, PACKING.ranks, PACKING.pattern)
    assert ids(text) == ids.raw(text)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_both_libraries_give_the_same_ids_for_every_document(sf):
    import os

    import pyarrow.parquet as pq

    from tessera.llm.queries import PACKING

    path = f"/root/testdata/{sf}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    ids, quick = packing.ids_of(PACKING.tokenizer, PACKING.ranks, PACKING.pattern), 0
    for text in pq.read_table(path, columns=["text"]).column(0).to_pylist():
        if text is not None:
            assert ids(text) == ids.raw(text)
            quick += not (packing._PLAIN.search(text) or packing._LONG_SPACE.search(text))
    assert quick > 500


def test_ids_of_long_and_special_texts():
    from tessera.llm.queries import PACKING

    ids = packing.ids_of(PACKING.tokenizer, PACKING.ranks, PACKING.pattern)
    for text in ("x" * 20_000, " " * 20_000, "\n" * 5_000 + "a", "a<|endoftext|>b", "ab " * 5_000, "日本語", "'s 've"):
        assert ids(text) == ids.raw(text)


@settings(deadline=None)
@given(st.text(alphabet="a@.+-1() %_", max_size=40))
def test_base_spans(text):
    import brute

    assert [f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in pii.base_spans(text)] == brute.base_spans(text)


def test_skip_chain_spreads_a_label():
    model = crf.trained()
    alone = "the number 7302264455 was seen".split()
    both = "phone 7302264455 and later on the number 7302264455 was seen".split()
    k = crf.LABELS.index("O")
    free, p = model.marginals(alone)
    free2, p2 = model.marginals(both)
    assert p2[free2.index(7)][k] < p[free.index(2)][k]


@pytest.mark.parametrize("n", [20, 60])
def test_long_skip_chains_converge(n):
    model = crf.trained()
    words = ("phone ab12-cd34-ef56-gh78-ij90 " * 3 + "and on then saw ab12-cd34-ef56-gh78-ij90 was seen " * n).split()
    assert np.abs(model.marginals(words)[1] - model.marginals(words, rounds=3_000)[1]).max() < 1e-3


def test_crf_held_out():
    import random

    rng, model, right, total = random.Random(99), crf.trained(), 0, 0
    for _ in range(300):
        said = crf._sentence(rng)
        free, p = model.marginals([w for w, _ in said])
        for i, row in zip(free, p):
            total += 1
            right += crf.LABELS[int(row.argmax())] == said[i][1]
    assert right / total > 0.9


def test_long_documents_of_numbers_end():
    text = "555-1234 " * 20_000
    assert pii.added_spans(text, crf.trained(), [], 0.9) is not None


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(["10.0.0.1", "@x.org", "+4930123456789", "4539578763621486", "0000000000000000.0.0.0", " ", "-", ".", "1", "a"]), max_size=8).map("".join))
def test_base_spans_that_start_together(text):
    import brute

    assert [f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in pii.base_spans(text)] == brute.base_spans(text)


def test_spans_are_in_order_of_start_and_kind(spark):
    texts = ["10.0.0.1@x.org", "+4930123456789@x.org", "4539578763621486@x.com", "0000000000000000.0.0.0"]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].spans == "email:0:14,ip:0:8"
    for i, text in enumerate(texts):
        import brute

        assert (got[i].spans, got[i].base_sha256) == (",".join(brute.base_spans(text)), brute.sha(",".join(brute.base_spans(text))))


#: A text and the values in it that are somebody's; those after the first say so by being said before.
TOLD = [
    ("please call phone 7302264455 and ask, as the report of 7302264455 was sent", ["7302264455", "7302264455"]),
    ("phone 415-555-0199 it was; the line 4155550199 was sent on", ["415-555-0199", "4155550199"]),
    ("secret = a9Xk29dk3lslw93kdls02kdl39s0 of it, and A9XK29DK3LSLW93KDLS02KDL39S0 was the value", ["a9Xk29dk3lslw93kdls02kdl39s0", "A9XK29DK3LSLW93KDLS02KDL39S0"]),
    ("secret = a9Xk29dk3lslw93kdls02kdl39s0 of it, and a9Xk29dk3lslw93kdls0 was cut off", ["a9Xk29dk3lslw93kdls02kdl39s0", "a9Xk29dk3lslw93kdls0"]),
    ("secret = a9Xk29dk3lslw93kdls02kdl39s0 of it, and a9Xk29dk3lslw9kdls02kdl39s0 was the value", ["a9Xk29dk3lslw93kdls02kdl39s0", "a9Xk29dk3lslw9kdls02kdl39s0"]),
    ("order 7302264455 was sent, and the line of 7302264455 was it", []),
    ("the value 2353820953013749 was sent, 2353820953013749 of 2353820953013749 card 2353820953013749", []),
    ("card 4539578763621486 2024 was sent", ["4539578763621486"]),
]


@pytest.mark.parametrize("text,values", TOLD)
def test_added_spans(text, values):
    assert [text[a:b] for a, b, _ in pii.added_spans(text, crf.trained(), pii.base_spans(text), 0.9)] == values


def test_skip_edges_find_what_the_chain_cannot():
    """Held-out documents: without the skip potentials right spans are lost, and none of the others is made wrong."""
    import random

    model, found = crf.trained(), []
    for field in (model, model.without_skips()):
        rng, right, wrong, lost = random.Random(4711), 0, 0, 0
        for _ in range(300):
            said = crf._document(rng)
            free, p = field.marginals([w for w, _ in said])
            for i, row in zip(free, p):
                k, sure = crf.LABELS[int(row.argmax())], row.max() >= 0.9
                right += sure and k == said[i][1] != "O"
                wrong += sure and k != "O" and k != said[i][1]
                lost += said[i][1] != "O" and not (sure and k == said[i][1])
        found.append((right, wrong, lost))
    (right, wrong, lost), (right0, _, lost0) = found
    assert right > right0 + 40 and lost < 0.6 * lost0 and wrong < 0.01 * right


def test_added_cards_have_a_check_digit():
    import random

    rng, model = random.Random(8), crf.trained()
    for _ in range(200):
        text = " ".join(w for _ in range(2) for w, _ in crf._document(rng))
        for a, b, k in pii.added_spans(text, model, [], 0.9):
            if pii.KINDS[k] == "card":
                digits = "".join(c for c in text[a:b] if c.isdigit())
                assert 13 <= len(digits) <= 19 and pii.luhn(digits)


@given(st.text("0123456789a", min_size=6, max_size=14), st.integers(0, 13), st.sampled_from(["drop", "put", "change", "cut"]))
def test_similar_forms_share_a_key(form, at, way):
    at %= len(form)
    other = {"drop": form[:at] + form[at + 1 :], "put": form[:at] + "b" + form[at:], "change": form[:at] + "b" + form[at + 1 :], "cut": form[:12]}[way]
    if len(other) >= 6 and crf._similar(form, other):
        assert set(crf._keys(form)) & set(crf._keys(other))
    assert way == "cut" or crf.one_edit(form, other)


def similar_edges(words):
    """crf's edges between similar forms, by comparing each with all before it."""
    first, out = {}, set()
    for i, w in enumerate(words):
        form = crf._FORM.sub("", w.lower())
        if len(form) < 6 or form in first or not crf._HAS.search(w):
            continue
        last = {}
        for other, at in first.items():
            a, b = sorted((form, other), key=len)
            ways = []
            digits = ["".join(c for c in f if c.isdigit()) for f in (form, other)]
            if len(digits[0]) >= 7 and digits[0] == digits[1]:
                ways.append("digits")
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1:
                ways.append(next(p for p in range(len(a)) if a[p] != b[p]))
            if len(a) >= 12 and b.startswith(a) or len(a) + 1 == len(b) and any(b[:p] + b[p + 1 :] == a for p in range(len(b))):
                ways.append(other)
            assert bool(ways) == crf._similar(form, other)
            last.update(dict.fromkeys(ways, at))
        out |= {(at, i) for at in last.values() if at + 1 < i}
        first[form] = i
    return out


_LONG = "7a" * 60


@settings(deadline=None, max_examples=300)
@given(st.lists(st.one_of(st.text("01a", min_size=5, max_size=8), st.text("1-", min_size=5, max_size=16), st.sampled_from(["the", "a1b2c3d4e5f6", "a1b2c3d4e5f6g7", "a1b2c3d4e5f6h8", _LONG[1:], _LONG, _LONG + "1", _LONG + "2", "b" + _LONG, _LONG + "1b", "2" + _LONG[1:] + "1"])), max_size=30))
def test_no_similar_form_is_left_out(words):
    edges = crf.graph(words)[4]
    assert len(edges) == len(set(edges)) and set(edges) == similar_edges(words)


def test_a_form_between_hides_no_similar_one():
    """All three begin alike; the last is a beginning of the first alone."""
    words = "secret = a9xk29dk3lslw93kdls02kdl39s0 of it, then a9xk29dk3lslm4 was sent on and a9xk29dk3lslw93kdls0 was cut off".split()
    assert crf.graph(words)[4] == [(2, 11)]
    text = " ".join(words)
    assert "a9xk29dk3lslw93kdls0" in [text[a:b] for a, b, _ in pii.added_spans(text, crf.trained(), [], 0.9)]


def test_long_documents_of_similar_numbers_end():
    words = [str(1_700_000_000 + i) for i in range(20_000)]
    free, p = crf.trained().marginals(words)
    assert len(free) == 20_000 and np.isfinite(p).all()


@pytest.mark.parametrize(
    ("said", "postfix"),
    [
        ("MIT", ["MIT"]),
        ("MIT OR Apache-2.0 AND ISC", ["MIT", "Apache-2.0", "ISC", "and", "or"]),
        ("(MIT or Apache-2.0) and ISC", ["MIT", "Apache-2.0", "or", "ISC", "and"]),
        ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT", ["GPL-2.0-only", "Classpath-exception-2.0", "with", "MIT", "or"]),
        ("MIT */ more", ["MIT"]),
        ("(MIT", []),
        ("OR MIT", []),
        ("", []),
    ],
)
def test_expressions(said, postfix):
    assert licenses.to_postfix(said) == postfix


def test_tags_are_evaluated():
    got = licenses.scan(b"// SPDX-License-Identifier: GPL-3.0-only OR MIT\ncode", licenses.Licenses())
    assert got[5] == "gpl-3,mit" and got[7] is True
    got = licenses.scan(b"# SPDX-License-Identifier: GPL-3.0-only AND MIT\n", licenses.Licenses())
    assert got[7] is False


def test_and_or_and_with_differ():
    scan = lambda x: licenses.scan(f"SPDX-License-Identifier: {x}\n".encode(), licenses.Licenses())
    both, either, one, excused = (scan(x) for x in ("MIT AND GPL-3.0-only", "MIT OR GPL-3.0-only", "GPL-3.0-only", "GPL-3.0-only WITH x-exception"))
    assert both[5] == either[5] == "gpl-3,mit" and excused[5] == "gpl-3-with-x-exception"
    assert (both[7], either[7], one[7], excused[7]) == (False, True, False, False)
    assert both[6] > either[6] == one[6] == excused[6]


def plain_value(tokens, allowed):
    """The value of an expression by recursive descent, over the same tokens: (labels, permitted, score)."""

    def term(level, at):
        if level == 3:
            if tokens[at] == "(":
                got, at = term(1, at + 1)
                return got, at + 1
            label = licenses.label_of(tokens[at])
            return ({label}, label in allowed, 0.95), at + 1
        got, at = term(level + 1, at)
        while at < len(tokens) and tokens[at] == ("or", "and")[level - 1]:
            more, at = term(level + 1, at + 1)
            got = (got[0] | more[0], got[1] or more[1], max(got[2], more[2])) if level == 1 else (got[0] | more[0], got[1] and more[1], 1 - (1 - got[2]) * (1 - more[2]))
        return got, at

    return term(1, 0)[0]


EXPRESSIONS = st.recursive(st.sampled_from([["MIT"], ["ISC"], ["GPL-3.0-only"], ["EPL-2.0"]]), lambda x: st.one_of(st.tuples(x, st.sampled_from(["or", "and"]), x).map(lambda t: [*t[0], t[1], *t[2]]), x.map(lambda t: ["(", *t, ")"])), max_leaves=12)


@given(EXPRESSIONS)
def test_evaluation_against_recursive_descent(tokens):
    labels, fine, score = licenses.evaluate(licenses.to_postfix(" ".join(tokens)), licenses.ALLOWED)
    want = plain_value(tokens, licenses.ALLOWED)
    assert (labels, fine) == want[:2] and abs(score - want[2]) < 1e-9


@pytest.mark.parametrize("text", ["Under the MIT License, GNU General Public License version 3. " * 100_000, "SPDX-License-Identifier: " + " OR ".join(f"L{i}" for i in range(100_000)), "SPDX-License-Identifier: " + "(" * 100_000 + "MIT" + ")" * 100_000, "SPDX-License-Identifier: MIT\n" * 50_000])
def test_long_licence_texts_take_linear_time(text):
    import time

    start = time.monotonic()
    got = licenses.scan(text.encode(), licenses.Licenses())
    assert got[5] and time.monotonic() - start < 10


WORDS = st.lists(st.sampled_from("gnu general public license version 3 2 cc by nc sa under the mit apache x".split()), max_size=30)


@given(WORDS)
def test_notice_labels_against_plain_search(words):
    phrases = {**licenses.BASE, **licenses.NOTICES}
    hits = [(i, i + len(p.split()), phrases[p], p in licenses.BASE) for p in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    want = {label for a, b, label, base in hits if base or not any(c <= a and b <= d and (c, d) != (a, b) for c, d, *_ in hits)}
    assert licenses.scan(" ".join(words).encode(), licenses.Licenses())[5] == ",".join(sorted(want))


def test_divergence():
    p = np.array([[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]])
    assert np.allclose(quality.divergence(p, np.array([1.0, 0.0])), [0, np.sqrt(0.311278), 1], atol=1e-5)


def test_boosting_and_its_sql():
    import duckdb

    rows = [{"a": i % 7, "b": i} for i in range(80)]
    labels = [int(r["a"] > 3) for r in rows]
    model = gbt.boost(rows, labels)
    assert all((model.log_odds(r) > 0) == bool(y) for r, y in zip(rows, labels))
    for r in rows[:9]:
        assert abs(duckdb.execute(f"SELECT {model.sql()} FROM (SELECT {r['a']} AS a, {r['b']} AS b)").fetchall()[0][0] - model.log_odds(r)) < 1e-9


def test_url_model_held_out():
    model = url_filter.default_model()
    fresh = url_filter.labelled_urls(400, seed=77)
    right = sum((model.trees.log_odds(url_filter.features(u, model.suffixes)) > 0) == bool(y) for u, y in fresh)
    assert right / len(fresh) > 0.95


def test_url_model_of_a_labelled_table(spark):
    rows = url_filter.labelled_urls(500, seed=5) + [("http://o'brien.it's/x", 1), ("http://back\\slash.a\\b/", 0), ("no scheme", 1)]
    df = spark.createDataFrame([*rows, (None, 1), ("http://x.org", None)], "url string, label int")
    model = url_filter.fit_table(df, most=300)
    assert model == url_filter.fit_table(df.repartition(5), most=300) and model != url_filter.fit_table(df, most=300, seed=1)
    whole = url_filter.fit_table(df)
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages, rules=(), model=whole).collect()}
    assert all(abs(got[i].block_score - whole.trees.log_odds(url_filter.features(u, whole.suffixes))) < 1e-6 for i, (u, _) in enumerate(rows))
    assert sum((got[i].verdict == "block") == bool(y) for i, (_, y) in enumerate(rows)) > 0.95 * len(rows)
    none = url_filter.fit_table(df.limit(0))
    assert {r.verdict for r in url_filter.judge(pages, rules=(), model=none).collect()} == {"allow"}


URLS = [
    "http://a.example.org/es/1", "http://example.org/en/12", "http://example.org/en/2", "https://x.com/fr/", "https://X.COM/de/9?q", "http://org/", "http://org", "http://notorg.xyz/", None, "", "no scheme/org/",
    "http://a.b.net/?x=1&y=2#z", "http://spam-farm-casino.example.net/en/1", "://host.org/a", "http://a://b.org/c",
]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "x", 1, "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, depth long, html string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert [got[i].rule for i in range(9)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", "org/", None, None, None]
    assert [got[i].verdict for i in range(6)] == ["block", "block", "allow", "allow", "block", "allow"]
    assert [(got[i].host, got[i].path) for i in (4, 6, 8, 9, 10, 11, 13, 14)] == [("x.com", "/de/9"), ("org", ""), ("", ""), ("", ""), ("", ""), ("a.b.net", "/"), ("host.org", "/a"), ("a:", "//b.org/c")]
    assert got[12].verdict == "block"
    assert url_filter.judge(df.limit(0)).count() == 0
    model = url_filter.default_model()
    for i, u in enumerate(URLS):
        if u:
            assert abs(got[i].block_score - model.trees.log_odds(url_filter.features(u, model.suffixes))) < 1e-6


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><header><h2>Site</h2></header>
<nav><ul><li><a href="/a">{0}</a></li><li><a href="/b">B</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use cookies</div><div class="ad">{1} buy</div>
<{2}><h1>{0} &amp; more</h1><p><b>Bold {1}<br><p>Second&nbsp;one &#233; <a href="x">link</a> end<script>var t="</p><p>bad";</script>
<div class="share">Tweet {0}</div><form><input value="x"><button>Go</button></form><blockquote>Quoted {1}</blockquote><section id="comments"><p>First! {0}</p></section></{2}>
<aside><p>Aside {0}</p></aside><footer>&copy; {1}</footer></body></html>"""
SAID = "{0} & more Bold {1} Second one é link end Quoted {1}"


@pytest.mark.parametrize("tag", ["article", "main", "div"])
@pytest.mark.parametrize("n", [1, 12])
def test_main_text(spark, tag, n):
    pages = [(i, f"http://h.example/{i}", PAGE.format(f"Title{i}", f"Word{i * 7}", tag)) for i in range(n)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {i: SAID.format(f"Title{i}", f"Word{i * 7}") for i in range(n)}


@pytest.mark.parametrize("n", [1, 12])
@pytest.mark.parametrize("page", [
    "<div class=content><h1>Head {0}</h1><p>{1}</p><p>{1}</p><ul><li>Item {0}</li></ul><blockquote>Quote {0}</blockquote></div>",
    "<header><h2>Site</h2></header><div class=title><h1>Head {0}</h1></div><div class=text><p>{1}</p><p>{1}</p></div><div class=end><ul><li>Item {0}</li></ul><blockquote>Quote {0}</blockquote></div>",
])
def test_unmarked_articles_are_whole(spark, page, n):
    long = [" ".join(f"long{i}" for _ in range(200)) for i in range(n)]
    pages = [(i, "http://h/", f"<body>{page.format(i, long[i])}</body>") for i in range(n)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Head {i} {long[i]} {long[i]} Item {i} Quote {i}" for i in range(n)}


@pytest.mark.parametrize("url", ["http://h/", None])
def test_pages_without_a_mark_beside_marked_ones(spark, url):
    kinds = ["<article><h1>Head {0}</h1><p>Text {0}</p></article>", "<main><h1>Head {0}</h1><p>Text {0}</p></main>", "<div class=old><h1>Head {0}</h1><p>Text {0}</p></div>"]
    pages = [(i, url, f"<body><nav>Menu {i}</nav>{kinds[i % 3].format(i)}<footer>Foot {i}</footer></body>") for i in range(30)] + [(30, url, "plain text")]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {i: f"Head {i} Text {i}" for i in range(30)} | {30: "plain text"}


@pytest.mark.parametrize("around", ["class='content has-sidebar'", "class=no-comments", "id=page class='with-banner'", "class=layout--without-footer", "class=pageNoComments", "class='content footer'"])
@pytest.mark.parametrize("tag", ["{0}", "<article>{0}</article>"])
def test_class_words_do_not_drop_the_article(spark, around, tag):
    inner = f"<div {around}><h1>Head {{0}}</h1><p>{'Some text ' * 20}{{0}}</p><div class=sidebar>Side {{0}}</div><div class='comments no-border'>First {{0}}</div></div>"
    pages = [(i, "http://h/", f"<body>{tag.format(inner).format(i)}<div class=footer>Foot {i}</div></body>") for i in range(12)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Head {i} {'Some text ' * 20}{i}" for i in range(12)}


def test_constant_slots_are_template(spark):
    page = "<body><div><p>Welcome to our site, dear reader</p><div><p>Text {0} of this page is long enough to be read</p><p>And more {0}</p></div></div></body>"
    pages = [(i, "http://h/", page.format(i)) for i in range(12)]
    got = wrapper.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Text {i} of this page is long enough to be read And more {i}" for i in range(12)}


def test_copies_of_an_article_stay(spark):
    pages = [(i, "http://h/", "<article><h1>Same</h1><p>Same text</p></article>") for i in range(20)]
    got = wrapper.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"Same Same text"}


def test_awkward_pages(spark):
    odd = [None, "", "plain text", "<", "<p", "<article>cut off <b", "<article><p a=\"x>y\">in</p>", "<div><article>" * 50 + "deep", "<article>" + "<p title=\"" * 2000, "<!-- never closed <article>x", "<article>1 < 2 &lt; 3</article>", "<script>x", "</p></div>"]
    df = spark.createDataFrame([(i, None, h, "x") for i, h in enumerate(odd)] * 2, "page_id long, url string, html string, host string")
    got = wrapper.extract(df).collect()
    assert len(got) == 2 * len(odd)
    by = {r.page_id: r.text for r in got}
    assert (by[0], by[1], by[5], by[6], by[10]) == ("", "", "cut off", "in", "1 < 2 < 3")
    assert all(r.n_chars == len(r.text) for r in got)
    assert wrapper.extract(df.limit(0)).count() == 0


def test_languages_beyond_ascii_are_kept(spark):
    rng = np.random.default_rng(5)
    text = lambda low, high: " ".join("".join(chr(c) for c in rng.integers(low, high, rng.integers(3, 9))) for _ in range(80))
    rows = [(i, text(97, 123), "en") for i in range(150)] + [(200 + i, text(0x430, 0x450), "ru") for i in range(150)] + [(400, text(0x3041, 0x3090), "ja"), (401, text(35, 48), "en"), (402, text(35, 48), "ru")]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {d for d, kept in got.items() if not kept} == {401, 402}


def test_matching_of_trees():
    a, b = (wrapper.template(wrapper.parse(x)) for x in ("<div><h1>a</h1><p>b</p><ul></ul></div>", "<div><p>c</p><ul></ul></div>"))
    assert wrapper.matched(a, b) == 5  # root, div, p, its text, ul
    wrapper.merge(a, b)
    assert [k[0] for k in a[wrapper.KIDS][0][wrapper.KIDS]] == ["h1", "p", "ul"]


def most_matched(a, b):
    """Simple tree matching straight from its recursion."""
    if a[0] != b[0]:
        return 0
    best = lambda x, y: 0 if not x or not y else max(best(x[1:], y), best(x, y[1:]), most_matched(x[0], y[0]) + best(x[1:], y[1:]))
    return 1 + best(a[wrapper.KIDS], b[wrapper.KIDS])


TREES = st.recursive(st.just([]), lambda kids: st.lists(st.tuples(st.sampled_from("ab"), kids), max_size=3), max_leaves=6).map(lambda kids: tree("r", kids))


def tree(sig, kids):
    return [sig, 1, 1, "", 0, 0, [tree(s, k) for s, k in kids], None]


@settings(deadline=None)
@given(TREES, TREES)
def test_matching_against_its_recursion(a, b):
    assert wrapper.matched(a, b) == most_matched(a, b)
    want = most_matched(a, b)
    nodes = len(wrapper.preorder(a, lambda t: t[wrapper.KIDS])) + len(wrapper.preorder(b, lambda t: t[wrapper.KIDS]))
    wrapper.merge(a, b)
    assert len(wrapper.preorder(a, lambda t: t[wrapper.KIDS])) == nodes - want


@given(st.lists(st.integers(0, 30), max_size=12, unique=True), st.permutations(range(12)))
def test_longest_common_order(a, b):
    from itertools import combinations

    node = lambda x: [str(x), 1, 1, "", 0, 0, [], None]
    pairs = wrapper._in_order([node(x) for x in a], [node(x) for x in b])
    assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and sorted(j for _, j in pairs) == [j for _, j in pairs]
    places = [b.index(x) for x in a if x < 12]
    assert len(pairs) == max(n for n in range(len(places) + 1) for c in combinations(places, n) if list(c) == sorted(c))


@given(TREES)
def test_flat_templates_come_back(t):
    assert wrapper.unpacked(wrapper.packed(t)) == t


HARD = {
    "deep": lambda i: "<body><article>" + "<div>" * 20_000 + f"deep {i}",
    "deep without a mark": lambda i: "<body>" + "<div class=x>" * 20_000 + f"deep {i}" + "</div>" * 20_000 + "<p>end</p>",
    "alternating": lambda i: "<body><article>" + f"<p>a {i}</p><h2>b</h2>" * 10_000,
    "irregular": lambda i: "<body><article>" + "".join(("<p>a</p>", "<h2>b</h2>", "<ul><li>c</ul>", "<table><tr><td>x</table>")[(j * j * 7 + j * (i + 3) + (j >> 3)) % 4] for j in range(20_000)),
    "many classes": lambda i: "<body><article>" + "".join(f"<p class={chr(97 + j * (i + 1) % 26) * (1 + j % 40)}>a</p>" for j in range(20_000)),
    "stray ends": lambda i: "<body>" + "<div>" * 20_000 + "</p></em></section>" * 20_000 + "<li>x" * 20_000,
    "attribute": lambda i: "<body><p " + "a" * 300_000 + " b=1>x</p>",
}


@pytest.mark.parametrize("name", HARD)
def test_hard_pages_take_linear_time(name):
    import time

    start, found = time.monotonic(), wrapper._Found(wrapper.Wrapper())
    pages = [HARD[name](i) for i in range(3)]
    for source in pages:
        page = wrapper.parse(source)
        found.add("h", wrapper.layout(page), wrapper.template(page))
    known = {kind: (t, wrapper.roles(t, wrapper.Wrapper())) for kind, t in found.hosts["h"].items()}
    got = [wrapper.main_text(source, known) for source in pages]
    assert all(got) and time.monotonic() - start < 40
    if name == "deep":
        assert got == [f"deep {i}" for i in range(3)]
    if name == "alternating":
        assert got[1] == " ".join(["a 1 b"] * 10_000)


def test_wrappers_are_bounded(spark):
    """Pages without anything in common: the wrapper stays small, and every page is read."""
    import json

    conf = wrapper.Wrapper(most_nodes=50)
    pages = [(i, None, f"<body><article>{''.join(f'<div class={chr(97 + i % 26) * (1 + j)}><p>t{i}x{j}</p></div>' for j in range(30))}</article></body>") for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    made = wrapper.wrappers(df, wrapper.host_of(df.url), conf, Tables(spark)).collect()
    assert len(made) == 1 and all(len(rows) <= 50 for rows in json.loads(made[0].wrapper).values())
    got = {r.page_id: r.text for r in wrapper.extract(df, conf).collect()}
    assert got == {i: " ".join(f"t{i}x{j}" for j in range(30)) for i in range(60)}


def host_pages(seed: int, n: int) -> list[tuple[str, str]]:
    """(html, article) of the pages of a made-up host without any mark or telling name: blocks that are the same on all
    its pages before, beside and after the article, lists of links, and the article in nested elements."""
    import random

    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    name = lambda: "x" + word()
    block = lambda: f"<div class={name()}><p>{words(rng.randint(5, 40))}</p></div>"
    links = lambda: f"<ul>{{links}}</ul>"
    before, after = ([rng.choice([block, block, links])() for _ in range(rng.randint(1, 3))] for _ in range(2))
    intro, outro = f"<h2>{words(4)}</h2>", f"<div class={name()}>{words(12)}</div>"
    kinds = [rng.choice(["p", "p", "p", "h3", "ul", "blockquote"]) for _ in range(rng.randint(3, 9))]
    shell = [name() for _ in range(rng.randint(1, 3))]
    out = []
    for _ in range(n):
        said, body = [], []
        for kind in ["h1", *kinds[: rng.randint(2, len(kinds))]]:
            text = words(rng.randint(3, 8) if kind in ("h1", "h3") else rng.randint(15, 60))
            said.append(text)
            body.append(f"<ul><li>{text}</li></ul>" if kind == "ul" else f"<{kind}>{text}</{kind}>")
        inner = "".join(f"<div class={c}>" for c in shell) + "".join(body) + "</div>" * len(shell)
        chrome = lambda parts: "".join(p.replace("{links}", "".join(f"<li><a href=/x>{words(2)}</a></li>" for _ in range(4))) for p in parts)
        out.append((f"<html><body>{intro}{chrome(before)}{inner}{outro}{chrome(after)}</body></html>", " ".join(said)))
    return out


def test_made_up_hosts(spark):
    """Against the known articles; a page by itself can't tell its article from the blocks around it."""
    pages, want = [], {}
    for host in range(40):
        for html, said in host_pages(host, 12):
            want[len(pages)] = said
            pages.append((len(pages), f"https://h{host}.example/{len(pages)}", html))
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in wrapper.extract(rows).collect()}
    alone = spark.createDataFrame([(i, f"https://p{i}.example/", h) for i, _, h in pages[::12]], "page_id long, url string, html string")
    lone = {r.page_id: r.text for r in wrapper.extract(alone).collect()}
    right = sum(got[i] == want[i] for i in want)
    assert right >= 0.97 * len(want), [i for i in want if got[i] != want[i]][:5]
    assert all(lone[i] != want[i] for i in lone)
