"""Licence scans: Aho-Corasick over normalised words for notices and identifier tags, and licence expressions.

An identifier tag's expression is parsed by the shunting-yard method (with binds before and, and before or) and
evaluated: its licences become labels, it is permitted if the allowed licences satisfy it, and it has a score. The
score of a text says how surely it is under licence terms: what binds together (and, and several notices) adds up, a
choice (or) counts as its surer side, an exception (with) leaves its licence's score. Scanning, parsing and evaluating
take time in proportion to the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kit import arrow, texts
from tessera.shipping import ship

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notice phrases that the method adds.
NOTICES = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu general public license": "gpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd 3 clause": "bsd-3-clause",
    "bsd 2 clause": "bsd-2-clause",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by": "cc-by",
    "cc0": "cc0",
    "public domain dedication": "public-domain",
    "the unlicense": "unlicense",
    "all rights reserved": "all-rights-reserved",
    "mit license": "mit",
    "apache license": "apache",
}
TAG = "spdx license identifier"
#: Identifiers whose label differs from the lower-cased identifier.
IDENTIFIERS = {"apache-2.0": "apache-2", "cc-by-nc-4.0": "cc-by-nc", "gpl-3.0-only": "gpl-3", "gpl-3.0-or-later": "gpl-3", "gpl-2.0-only": "gpl-2", "gpl-2.0-or-later": "gpl-2"}
ALLOWED = frozenset({"mit", "apache-2", "bsd-2-clause", "bsd-3-clause", "isc", "cc0", "cc0-1.0", "unlicense", "cc-by", "cc-by-4.0"})

_PARTS = bytes(b if b >= 0x80 or chr(b).isalnum() and not 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_TAGGED = re.compile(rb"spdx[^\x30-\x39\x41-\x5A\x61-\x7A\x80-\xFF]+license[^\x30-\x39\x41-\x5A\x61-\x7A\x80-\xFF]+identifier\s*:?[ \t]*([^\n\r]*)", re.I)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_BINDS = {"or": 1, "and": 2, "with": 3}


@dataclass(frozen=True)
class Licenses:
    allowed: frozenset = ALLOWED
    #: Confidence of a label by its source.
    base_weight: float = 0.9
    tag_weight: float = 0.95
    notice_weight: float = 0.6


def label_of(identifier: str) -> str:
    low = identifier.lower()
    return IDENTIFIERS.get(low, low)


def to_postfix(expression: str) -> list[str]:
    """The longest leading part of a text that is a licence expression, in postfix order (shunting-yard).

    Operators are and, or, with, in any case; an operand must stand between them, and with joins one licence and one
    exception. [] if none leads the text.
    """
    out: list[str] = []
    waiting: list[str] = []
    good: tuple[int, list[str]] = (0, [])
    want, depth, end, single = True, 0, 0, False
    for m in _TOKEN.finditer(expression):
        if expression[end : m.start()].strip():
            break
        token, end = m[0], m.end()
        low = token.lower()
        if token == "(":
            if not want or waiting and waiting[-1] == "with":
                break
            waiting.append(token)
            depth += 1
        elif token == ")":
            if want or not depth:
                break
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
            depth -= 1
            single = False
        elif low in _BINDS:
            if want or low == "with" and not single:
                break
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[low]:
                out.append(waiting.pop())
            waiting.append(low)
            want = True
            continue
        else:
            if not want:
                break
            out.append(token)
            want, single = False, not waiting or waiting[-1] != "with"
        if not want and not depth:
            good = len(out), waiting[::-1]  # outside parentheses no more wait than there are kinds of operators
    return out[: good[0]] + good[1]


def evaluate(postfix: list[str], allowed: frozenset, weight: float = 0.95) -> tuple[set[str], bool, float]:
    """(labels, whether the allowed licences satisfy the expression, score). An exception keeps its licence's standing."""
    stack: list[tuple[set[str], bool, float]] = []
    for token in postfix:
        if token in _BINDS:
            (right, fine, more), (left, good, score) = stack.pop(), stack.pop()
            if token == "with":
                stack.append(({f"{x}-with-{y}" for x in left for y in right}, good, score))
                continue
            if len(left) < len(right):
                left, right = right, left
            left |= right
            stack.append((left, good or fine, max(score, more)) if token == "or" else (left, good and fine, 1 - (1 - score) * (1 - more)))
        else:
            label = label_of(token)
            stack.append(({label}, label in allowed, weight))
    return stack[-1] if stack else (set(), False, 0.0)


def _automaton() -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        built.add_word(f" {phrase} ", phrase)
    built.make_automaton()
    return built


_BUILT: list = []


def scan(text: bytes | None, conf: Licenses) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, permitted) of a text."""
    if not text:
        return 0, 0, None, None, "", "", 0.0, None
    if not _BUILT:
        _BUILT.append(_automaton())
    plain = text.lower().translate(_PARTS)
    words = plain.split()
    line = " " + b" ".join(words).decode() + " "
    found: list[tuple[int, str]] = [(end - len(phrase) - 1, phrase) for end, phrase in _BUILT[0].iter(line)]
    if not found:
        return len(words), 0, None, None, "", "", 0.0, None
    base = [(at, p) for at, p in found if p in BASE]
    base_labels = {BASE[p] for _, p in base}
    weights: dict[str, float] = dict.fromkeys(base_labels, conf.base_weight)
    reach = 0
    for at, p in sorted(found, key=lambda x: (x[0], -len(x[1]))):
        if at + len(p) <= reach:  # a phrase within a longer one that was found adds nothing
            continue
        reach = at + len(p)
        if p in NOTICES:
            weights.setdefault(NOTICES[p], conf.notice_weight)
    tagged: set[str] = set()
    said: dict[str, float] = {}
    permitted = None
    if any(p == TAG for _, p in found):
        for m in _TAGGED.finditer(text):
            postfix = to_postfix(m[1].decode(errors="replace"))
            if postfix:
                labels, fine, sure = evaluate(postfix, conf.allowed, conf.tag_weight)
                permitted = fine if permitted is None else permitted and fine
                said[" ".join(postfix).lower()] = sure
                tagged |= labels
    if permitted is None and weights:
        permitted = all(x in conf.allowed for x in weights)
    score = 1.0
    for w in sorted([*said.values(), *(w for x, w in weights.items() if x not in tagged)]):
        score *= 1 - w
    every = tagged | set(weights)
    starts = np.cumsum(np.frombuffer(line.encode("utf-32-le"), "<u4") == 0x20) - 1  # words before each character
    places = [int(starts[at]) for at, _ in base]
    return len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(every)), round(1 - score, 6), permitted


OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("permitted", pa.bool_())]
)


def _scanned(conf: Licenses):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = zip(*(scan(t, conf) for t in texts(part.column(1))))
                yield arrow({"doc_id": part.column(0).to_pylist()} | dict(zip(OUT.names[1:], map(list, got))), OUT)

    return run


def licenses(docs: DataFrame, conf: Licenses = Licenses()) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, permitted per row of docs.

    A null or empty text has no words, no labels and score 0; permitted is null without labels, and false as soon as
    one expression isn't satisfied. Each row is judged by itself, so repeated rows and a null doc_id do no harm; an
    empty table gives no rows and other columns of docs are left out. Phrases that start together count each, and the
    longer one gives the label; an expression that is said again counts once.
    """
    ship(docs.sparkSession)
    kinds = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permitted boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scanned(conf), kinds)
