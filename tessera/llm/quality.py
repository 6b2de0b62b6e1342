"""Quality rules: base counts, and a verdict by distribution divergence.

A document's histograms of character classes and of common words are compared with language references by
Jensen-Shannon distance. The references don't come from the documents that are judged, so a verdict depends on its
text alone. Character shares were fitted once on a bounded sample of labelled documents; the share of a language's
r-th common word follows Zipf's law. ``fitted`` makes references from one's own labelled sample. Short documents have
noisy histograms: below the guards a test isn't made.
"""

from __future__ import annotations

from dataclasses import dataclass

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kit import arrow, gram_hashes, texts, word_hashes
from tessera.shipping import ship

#: Frequent function words by language.
COMMON = {
    "en": "the of and to in a is that it was for on with as by at from this be are an or have not",
    "fr": "de la le et les des en un du une que est pour dans qui sur pas par au il plus ne se ce",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden",
}
WORDS = sorted({w.encode() for line in COMMON.values() for w in line.split()})
_KEYS = word_hashes(WORDS)
_ORDER = np.argsort(_KEYS)
_SORTED = _KEYS[_ORDER]

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Character classes: lower, upper, digit, white space, sentence marks, symbols and other ASCII, beyond ASCII.
CLASSES = 7
#: Mean shares of the character classes, of 5,196 labelled good documents of 60 words and more.
CHAR_SHARES = {
    "en": (0.790, 0.015, 0.002, 0.165, 0.024, 0.001, 0.003),
    "fr": (0.710, 0.010, 0.002, 0.165, 0.024, 0.001, 0.088),
    "es": (0.720, 0.013, 0.002, 0.162, 0.024, 0.001, 0.078),
    "de": (0.770, 0.013, 0.002, 0.153, 0.022, 0.001, 0.039),
}
#: Share of a language's first common word; the r-th has 1/r of it.
FIRST_SHARE = 0.052
#: Classes of any language, whose letters may be of any kind: letters, digit, white space, sentence marks, the rest.
ANY = np.array([[1, 0, 0, 0, 0], [1, 0, 0, 0, 0], [0, 1, 0, 0, 0], [0, 0, 1, 0, 0], [0, 0, 0, 1, 0], [0, 0, 0, 0, 1], [1, 0, 0, 0, 0]])
ANY_SHARES = (0.808, 0.002, 0.165, 0.024, 0.001)


def _classes() -> np.ndarray:
    """Byte -> class, as a one-hot matrix; bytes that continue a code point belong to none."""
    hot = np.zeros((256, CLASSES), np.int64)
    for b in range(256):
        if 0x80 <= b < 0xC0:
            continue
        c = chr(b)
        k = 6 if b >= 0xC0 else 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if c.isdigit() else 3 if b in SPACES else 4 if c in ".,;:!?'\"()-" else 5
        hot[b, k] = 1
    return hot


_HOT = _classes()
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS)).astype(np.int64)


@dataclass(frozen=True)
class Quality:
    min_words: int = 10
    repeat_words: int = 5
    repeat_percent: int = 20
    #: Guards: the tests need so many words.
    char_guard: int = 20
    word_guard: int = 60
    #: Distances from the nearest reference (base 2, 0 to 1) beyond which a document goes: by its characters
    #: alone, or by characters and common words together if it has fewer common words than any reference.
    char_limit: float = 0.33
    both_char: float = 0.17
    both_word: float = 0.27

    def odd(self, n, d_char, d_word, few):
        """Which documents of n words diverge too far; few: they have few common words."""
        return (n >= self.char_guard) & (d_char > self.char_limit) | (n >= self.word_guard) & (d_char > self.both_char) & (d_word > self.both_word) & few


def measure(text: bytes | None, repeat: int) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, character classes, common words) of a text."""
    text = text or b""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = counts @ _HOT
    hashes = word_hashes(text.split())
    n = len(hashes)
    again = 0
    if n >= repeat:
        grams = gram_hashes(hashes, repeat)
        _, back, times = np.unique(grams, return_inverse=True, return_counts=True)
        twice = times[back] > 1
        if twice.any():
            hit = np.zeros(n, bool)
            for i in range(repeat):
                hit[i : i + len(twice)] |= twice
            again = int(hit.sum())
    at = np.minimum(np.searchsorted(_SORTED, hashes), len(_SORTED) - 1)
    words = np.bincount(at[_SORTED[at] == hashes], minlength=len(_SORTED))
    dup, lines = 0, text.split(b"\n")
    if len(lines) > 1:
        seen = set()
        for line in lines:
            if line in seen:
                dup += bool(line.strip())
            else:
                seen.add(line)
    return n, int(chars.sum() - chars[3]), int(counts @ _IS_SYMBOL), dup, again, chars, np.append(words, n - words.sum())


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the base-2 divergence) of each row of p from the distribution q."""
    mean = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / mean), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / mean), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


Shares = dict[str, tuple[np.ndarray, np.ndarray]]


@lru_cache(maxsize=1)
def references() -> Shares:
    """Character-class and common-word shares by language."""
    out = {}
    for lang, shares in CHAR_SHARES.items():
        words = np.zeros(len(WORDS) + 1)
        for rank, word in enumerate(COMMON[lang].split(), 1):
            words[np.flatnonzero(_ORDER == WORDS.index(word.encode()))] = FIRST_SHARE / rank
        words[-1] = 1 - words.sum()
        out[lang] = np.array(shares) / sum(shares), words
    return out


def fitted(docs: DataFrame, labels: DataFrame, conf: Quality = Quality(), most: int = 20_000) -> Shares:
    """Mean shares by language of labelled good documents: docs (doc_id, text, lang), labels (doc_id, quality).

    Of the labelled documents with quality 1 and a language, the most with the smallest hashed ids are read, which
    bounds what reaches the driver; those of fewer than word_guard words are left out.
    """
    good = labels.where("quality = 1").select("doc_id").distinct()
    rows = docs.where("lang is not null and text is not null").join(good, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most)
    sums: dict[str, list] = {}
    for r in rows.select("lang", "text").toLocalIterator():
        n, *_, chars, words = measure(r.text.encode(), conf.repeat_words)
        if n >= conf.word_guard:
            one = sums.setdefault(r.lang, [0, 0, 0])
            one[0] += chars / chars.sum()
            one[1] += words / words.sum()
            one[2] += 1
    return {lang: (chars / n, words / n) for lang, (chars, words, n) in sums.items()}


def distances(chars: np.ndarray, words: np.ndarray, refs: list) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each document from its nearest reference, by character classes and by common words."""
    p = chars / np.maximum(chars.sum(axis=1, keepdims=True), 1)
    w = words / np.maximum(words.sum(axis=1, keepdims=True), 1)
    return np.min([divergence(p, c) for c, _ in refs], axis=0), np.min([divergence(w, q) for _, q in refs], axis=0)


def from_any(chars: np.ndarray) -> np.ndarray:
    """Distance of each document from what texts of any language have in common."""
    p = chars @ ANY
    return divergence(p / np.maximum(p.sum(axis=1, keepdims=True), 1), np.array(ANY_SHARES))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
JUDGED = pa.schema([*((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("char_distance", pa.float64()), ("word_distance", pa.float64())])


def judge(said: pa.Array, langs: list, conf: Quality, refs: Shares) -> pa.RecordBatch:
    """Counts and verdict (JUDGED) of some texts and their languages."""
    *counts, chars, words = zip(*(measure(t, conf.repeat_words) for t in texts(said)))
    n, again, chars, words = np.array(counts[0]), np.array(counts[4]), np.array(chars), np.array(words)
    failed = (n < conf.min_words) | (100 * again > conf.repeat_percent * n)
    known, none = np.array([x in refs for x in langs]), np.array([x is None for x in langs])
    d_char, d_word = distances(chars, words, list(refs.values())) if refs else (np.ones(len(n)), np.ones(len(n)))
    common = from_any(chars)
    d_char = np.where(known, d_char, np.where(none, np.minimum(d_char, common), common))
    rare = max((w[-1] for _, w in refs.values()), default=1.0)
    odd = conf.odd(n, d_char, d_word, (known | none) & (words[:, -1] > rare * n))
    return arrow(dict(zip(COUNTS, counts)) | {"base_failed": failed, "kept": ~failed & ~odd, "char_distance": d_char, "word_distance": d_word}, JUDGED)


def _batches(batches, columns: list[str], conf: Quality, refs: Shares):
    """(slice, its JUDGED)"""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            langs = part.column(columns.index("lang")).to_pylist() if "lang" in columns else [None] * part.num_rows
            yield part, judge(part.column(columns.index("text")), langs, conf, refs)


def quality(docs: DataFrame, conf: Quality = Quality(), refs: Shares | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, char_distance, word_distance for each row of docs (doc_id, text, lang).

    A null text has no words and fails the base rules; so does an empty one. A text of a language with a reference is
    compared with all of them, and the nearest counts, for labels err. One of another language is compared with what
    texts of any language have in common, by its characters; one without a language with all of these. Each row is
    judged by its text and language alone, in one pass without a shuffle: repeated rows have the same verdict, a null
    doc_id stays null, an empty table gives no rows, other columns don't matter, and texts of any length are read
    whole. Limits are exclusive: a distance equal to one passes.
    """
    refs = references() if refs is None else refs
    ship(docs.sparkSession)

    def run(batches):
        for part, found in _batches(batches, ["doc_id", "text", "lang"], conf, refs):
            yield pa.RecordBatch.from_arrays([part.column(0), *found.columns], names=["doc_id", *JUDGED.names])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    kinds = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{f.name} {kinds[f.type]}" for f in JUDGED))


def passing(docs: DataFrame, conf: Quality = Quality(), refs: Shares | None = None) -> DataFrame:
    """The rows of docs that ``quality`` keeps, with all their columns as they are, whatever their names."""
    refs = references() if refs is None else refs
    columns = docs.columns
    ship(docs.sparkSession)

    def run(batches):
        for part, found in _batches(batches, columns, conf, refs):
            yield part.filter(found.column("kept"))

    return docs.mapInArrow(run, docs.schema)
