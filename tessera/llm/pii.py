"""Personal data in texts: exact base patterns, and further spans by a skip-chain conditional random field."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.crf import LABELS, Model, card_runs, cores, luhn, trained
from tessera.llm.kit import arrow
from tessera.shipping import ship

KINDS = ("email", "ip", "card", "phone", "secret")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number's first digit only: where the pattern fails there, it fails at the number's other digits as well.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9@]")
_BY_START = itemgetter(0, 2, 1)


@dataclass(frozen=True)
class Pii:
    #: Probability that a token must have to be added.
    certain: float = 0.9
    sentences: int = 1_500
    seed: int = 7


def _emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            start = at
            while start > done and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind's place in KINDS) of the base patterns, leftmost and not overlapping within a kind."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        out += [(a, b, 0) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    if text.count(".") >= 3:
        for m in _IP.finditer(text):
            if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=_BY_START)


def added_spans(text: str, model: Model, base: list[tuple[int, int, int]], certain: float) -> list[tuple[int, int, int]]:
    """Spans of tokens that the field is certain of, side by side tokens of a kind as one, beside the base spans.

    A card is a run of such tokens with a right check digit, a phone number has 7 to 15 digits.
    """
    if not _DIGIT.search(text):
        return []
    places = cores(text)
    words = [text[a:b] for a, b in places]
    free, p = model.marginals(words)
    sure = {i: k for i, row in zip(free, p) if (k := int(row.argmax())) and row[k] >= certain}
    out: list[tuple[int, int, int]] = []
    card, done = KINDS.index("card") + 1, 0
    for i, j in sorted(card_runs(words, [i for i in sure if sure[i] == card]), key=lambda r: (r[0], -r[1])):
        if i >= done:  # the longest run from the first token on
            out.append((places[i][0], places[j - 1][1], card - 1))
            done = j
    last = -2
    for i, k in sure.items():
        if k == card:
            continue
        a, b = places[i]
        if out and last == i - 1 and out[-1][2] == k - 1:
            out[-1] = (out[-1][0], b, k - 1)
        else:
            out.append((a, b, k - 1))
        last = i
    phone = KINDS.index("phone")
    out = [s for s in out if s[2] != phone or 7 <= sum("0" <= c <= "9" for c in text[s[0] : s[1]]) <= 15]
    taken: list[list[int]] = []  # base spans, overlapping ones as one
    for a, b, _ in sorted(base):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    before = lambda b: bisect_left(taken, [b, b]) - 1  # noqa: E731  the last that starts before b
    return [(a, b, k) for a, b, k in out if (i := before(b)) < 0 or taken[i][1] <= a]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


assert KINDS == LABELS[1:]
OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base_sha256", pa.string()), ("spans", pa.string())])


def _found(conf: Pii):
    def run(batches):
        model = trained(conf.sentences, conf.seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), {f.name: [] for f in OUT}
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    base = base_spans(text) if text else []
                    every = sorted(base + added_spans(text, model, base, conf.certain), key=_BY_START) if text else []
                    counts = [sum(s[2] == k for s in base) for k in range(4)]
                    for name, value in zip(OUT.names, (doc, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every))):
                        out[name].append(value)
                yield arrow(out, OUT)

    return run


def personal_data(docs: DataFrame, conf: Pii = Pii()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of docs (doc_id, text).

    A null or empty text has none. Rows are judged each by itself; a doc_id may be null or repeated. Spans are in
    code points, their end excluded.
    """
    ship(docs.sparkSession)
    kinds = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in OUT)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_found(conf), kinds)
