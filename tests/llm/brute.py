"""Plain versions of the operators' contracts, straight from their definitions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def near_groups(rows):
    """doc_id -> (n_shingles, component_id), comparing all pairs of documents that share a shingle."""
    sets, holders, up = {}, defaultdict(list), {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, t in rows:
        w = SPACED.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    shared = Counter()
    for d in sorted(sets):
        for s in sets[d]:
            holders[s].append(d)
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def base_spans(text):
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and not all(int(p) <= 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                total = 0
                for i, c in enumerate(digits[::-1]):
                    d = int(c) * (1 + i % 2)
                    total += d // 10 + d % 10
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), ("email", "ip", "card", "phone").index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def pii(text):
    base = base_spans(text)
    return *(sum(s.startswith(k + ":") for s in base) for k in ("email", "ip", "card", "phone")), sha(",".join(base))


def line_dedup(rows):
    """doc_id -> (n_lines, n_dropped, kept_sha256)"""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(holders[key(x)]) > 1 and d != min(holders[key(x)]))]
        out[d] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def licence_base(text):
    """(n_words, n_base, first_word, last_word, base_labels)"""
    w = PLAIN.findall((text or "").translate(LOWER))
    found = []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def decontamination(rows, items):
    """doc_id -> (n_words, n_hit, n_items, items_sha256)"""
    windows = defaultdict(set)
    for item, t in items:
        w = PLAIN.findall((t or "").translate(LOWER))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(item))
    sizes = {len(x) for x in windows}
    out = {}
    for d, t in rows:
        w = PLAIN.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                who = windows.get(tuple(w[i : i + n]))
                if who:
                    found |= who
                    hit |= set(range(i, i + n))
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))))
    return out


def substring_dedup(rows):
    """doc_id -> (n_words, n_removed, kept_sha256)"""
    words = {d: SPACED.findall(t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 49):
            first.setdefault(tuple(words[d][i : i + 50]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), sha(" ".join(kept)))
    return out


def check_packing(pieces, rows, encode, capacity=1024):
    """Asserts that pieces (doc_id, start, length, crc, doc_tokens, sequence, offset) hold each id of rows once; gives the padding."""
    import numpy as np

    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p[0]].append(p)
        by_seq[p[5]].append((p[6], p[2]))
    assert len(rows) == len(by_doc)
    for d, t in rows:
        ids = np.array([*encode(t or ""), 0], "<u4")
        at = 0
        for _, start, length, crc, total, *_ in sorted(by_doc[d], key=lambda p: p[1]):
            assert start == at and length > 0 and total == len(ids)
            assert crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    padding = 0
    for pieces_ in by_seq.values():
        at = 0
        for offset, length in sorted(pieces_):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def quality_base(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    w = SPACED.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(SPACED.search(line))
        seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n
