"""A skip-chain conditional random field over the tokens of a document.

Adjacent tokens share chain potentials. A token shares a skip potential with the last token before it, however far,
of equal normal form, and the first token of a form shares another one with the first tokens of the similar forms before
it: the last of the same digits, for each place the last that differs there alone, and all that are one removal away or
of which one is a beginning of the other. Like equal forms, those of the same digits or of one place are alike among
themselves, so the last one joins them all; no similar form is left out. Forms have six and more characters, of letters
A-Z, digits and @. So one clear occurrence settles the others. Marginals come from loopy sum-product messages, updated
for all edges at once. Tokens of letters and marks alone can't be personal data of these kinds: they are
clamped to O, which cuts the graph without changing the marginals of the others. Digits that no run of 13 to 19 with a
right check digit covers can't be a card, whatever their neighbours say.

Weights are learned by pseudo-likelihood on documents that a seeded generator labels: in many a value is clear once
and bare later, and numbers that are nobody's data repeat as well.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np

LABELS = ("O", "email", "ip", "card", "phone", "secret")
TOKEN = re.compile(r"\S+")
TRIM = "\"'`,;:!?()[]{}<>|#*%&$="
#: Words that announce a kind of data in the text before it.
CUES = {
    "email": "mail email e-mail contact",
    "ip": "ip address host server",
    "card": "card visa mastercard amex payment",
    "phone": "phone tel telephone mobile call fax",
    "secret": "token secret password passwd key apikey api_key pwd",
    "other": "order invoice ticket item ref id version commit checksum sha1 md5 page isbn total sum",
}
#: Score of a label that a token can't have.
NEVER = -30.0
_CUES = {w: k for k, line in CUES.items() for w in line.split()}
_HAS = re.compile(r"[0-9@]")
_FORM = re.compile(r"[^0-9a-z@]")
_DIGITS = re.compile(r"[^0-9]")
_GROUPS = re.compile(r"[0-9]+|[0-9]{4,}(?:[.-][0-9]{4,})+")
_SHAPES = [
    ("at", re.compile(r"[^@]+@[^@]+\.[A-Za-z]{2,}")),
    ("at_only", re.compile(r"[^@]*@[^@]*")),
    ("quad", re.compile(r"\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?")),
    ("hex", re.compile(r"(?=.*\d)(?:[0-9a-f]{24,}|[0-9A-F]{24,})")),
    ("mixed", re.compile(r"(?=.*\d)(?=.*[A-Za-z])[A-Za-z0-9_\-+/=]{20,}")),
    ("long_digits", re.compile(r"\d{13,19}")),
    ("four", re.compile(r"\d{4}")),
    ("plus", re.compile(r"\+\d{1,3}")),
    ("area", re.compile(r"\(?\d{2,4}\)?")),
    ("dashed", re.compile(r"\d{2,4}(?:[-.]\d{2,4}){1,3}")),
    ("number", re.compile(r"\d+(?:[.,]\d+)*")),
    ("word_digits", re.compile(r"[A-Za-z]+\d+[A-Za-z0-9]*")),
]
FEATURES = ["bias", *(n for n, _ in _SHAPES), "no_shape", *(f"cue_{k}" for k in CUES), "prev_shape_plus", "prev_shape_area", "next_dashed", "next_four", "prev_four", "checked", "again"]
_AT = {f: i for i, f in enumerate(FEATURES)}


def shape(core: str) -> str:
    return next((n for n, p in _SHAPES if p.fullmatch(core)), "no_shape")


def cores(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens without enclosing marks; a parenthesis that belongs to a number stays."""
    out = []
    for m in TOKEN.finditer(text):
        raw = m[0]
        core = raw.strip(TRIM).rstrip(".")
        if re.fullmatch(r"\(\d{2,4}\)", raw):
            core = raw
        at = m.start() + raw.find(core) if core else m.start()
        out.append((at, at + len(core)))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def card_runs(words: list[str], free: list[int]) -> list[tuple[int, int]]:
    """(first, end) of the runs of adjacent tokens, digits but for dots and dashes, that read as one card number."""
    digits = {}
    for i in free:
        w = words[i]
        if _GROUPS.fullmatch(w):
            digits[i] = _DIGITS.sub("", w)
    out = []
    for i in digits:
        run, j = "", i
        while len(run) <= 19 and j in digits:
            run += digits[j]
            j += 1
            if 13 <= len(run) <= 19 and luhn(run):
                out.append((i, j))
    return out


def features(words: list[str], shapes: list[str], free: list[int], skips: list[tuple[int, int]]) -> np.ndarray:
    x = np.zeros((len(free), len(FEATURES)))
    again = {i for edge in skips for i in edge}
    for row, i in enumerate(free):
        x[row, 0] = x[row, _AT[shapes[i]]] = 1
        x[row, _AT["again"]] = i in again
        for j in range(max(0, i - 3), i):
            kind = _CUES.get(words[j].lower())
            if kind:
                x[row, _AT[f"cue_{kind}"]] = 1
        if i and shapes[i - 1] in ("plus", "area"):
            x[row, _AT[f"prev_shape_{shapes[i - 1]}"]] = 1
        if i and shapes[i - 1] == "four":
            x[row, _AT["prev_four"]] = 1
        if i + 1 < len(words) and shapes[i + 1] in ("dashed", "four"):
            x[row, _AT[f"next_{shapes[i + 1]}"]] = 1
    x[_checked(words, free), _AT["checked"]] = 1
    return x


def _checked(words: list[str], free: list[int]) -> np.ndarray:
    """Which free tokens lie in a run that reads as a card number."""
    inside = {k for i, j in card_runs(words, free) for k in range(i, j)}
    return np.fromiter((i in inside for i in free), bool, len(free))


def _same(a: str, b: str) -> int:
    """How many characters a and b, a no longer than b, have in common at their beginning."""
    if b.startswith(a):
        return len(a)
    low, high = 0, len(a)
    while low < high - 1:  # the first low characters are equal, the first high ones aren't
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, removal or exchange of a character makes a of b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    at = _same(a, b)
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _similar(a: str, b: str) -> bool:
    """Forms of six and more characters: the same digits, a beginning of the other, or one edit away."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) >= 12 and b.startswith(a) or one_edit(a, b):
        return True
    digits = _DIGITS.sub("", a)
    return len(digits) >= 7 and digits == _DIGITS.sub("", b)


def _keys(form: str) -> list[tuple]:
    """Similar forms share one of these: digits, the first twelve characters, or either half of what an edit leaves."""
    digits, half = _DIGITS.sub("", form), len(form) // 2
    keys = [("first", half, form[:half]), ("last", half, form[-half:]), ("first", half - 1, form[: half - 1]), ("last", half - 1, form[1 - half :])]
    if len(form) >= 12:
        keys.append(("twelve", form[:12]))
    if len(digits) >= 7:
        keys.append(("digits", digits))
    return keys


def _edits(forms: list[str], shorter: list[str]):
    """Pairs one edit apart: of forms, all of one length, for each place the last before that differs there alone; and
    with the forms that are one character shorter, in the order of forms.

    By what each removal leaves, a place at a time, or where that takes longer by comparing all: the pairs are the same.
    """
    size = len(forms[0])
    if len(forms) / 2 + len(shorter) > size * (0.06 + size / 5_000):  # rough costs of a comparison and of a removal
        without = set(shorter)
        for at in range(size):
            left: dict[str, str] = {}
            for form in forms:
                rest = form[:at] + form[at + 1 :]
                if rest in without:
                    yield rest, form
                if rest in left:
                    yield left[rest], form
                left[rest] = form
        return
    for n, form in enumerate(forms):
        yield from ((other, form) for other in shorter if one_edit(other, form))
        last = {_same(other, form): other for other in forms[:n] if one_edit(other, form)}
        yield from ((other, form) for other in last.values())


def _relatives(first: dict[str, int]) -> list[tuple[int, int]]:
    """(earlier, later) first tokens of similar forms, as the module says; first: forms in the order of their tokens.

    There are at most a few edges for each character of a form.
    """
    pairs: list[tuple[str, str]] = []
    holders: dict[tuple, str] = {}
    shared: set[str] = set()  # similar forms share a key, so the others are alone
    for form in first:
        for key in _keys(form):
            other = holders.setdefault(key, form)
            if other != form:
                shared |= {other, form}
    above: list[str] = []  # the beginnings of one form are behind each other in order
    for form in sorted(form for form in shared if len(form) >= 12):
        while above and not form.startswith(above[-1]):
            above.pop()
        pairs += ((other, form) for other in above)
        above.append(form)
    digits: dict[str, str] = {}
    sizes: dict[int, list[str]] = {}
    for form in first:
        if form not in shared:
            continue
        number = _DIGITS.sub("", form)
        if len(number) >= 7:
            if number in digits:
                pairs.append((digits[number], form))
            digits[number] = form
        sizes.setdefault(len(form), []).append(form)
    for size, forms in sizes.items():
        pairs += _edits(forms, sizes.get(size - 1, []))
    out = {(min(first[a], first[b]), max(first[a], first[b])) for a, b in pairs}
    return sorted(((a, b) for a, b in out if a + 1 < b), key=lambda e: (e[1], e[0]))


def graph(words: list[str]) -> tuple[list[str], list[int], list[tuple[int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """(shapes, free tokens, chain edges, skip edges of equal forms, of similar ones); edges have a free token at either end."""
    shapes = [shape(w) if _HAS.search(w) else "" for w in words]
    free = [i for i, s in enumerate(shapes) if s]
    inside = set(free)
    chain = [(i, i + 1) for i in free if i + 1 in inside]
    last: dict[str, int] = {}
    first: dict[str, int] = {}
    equal = []
    for i in free:
        form = _FORM.sub("", words[i].lower())
        if len(form) < 6:
            continue
        first.setdefault(form, i)
        if last.get(form, i) + 1 < i:
            equal.append((last[form], i))
        last[form] = i
    return shapes, free, chain, equal, _relatives(first)


def _longest(skip: list[tuple[int, int]]) -> int:
    """Edges of the longest chain; edges come in the order of their ends."""
    length: dict[int, int] = {}
    for a, b in skip:
        length[b] = max(length.get(b, 0), length.get(a, 0) + 1)
    return max(length.values(), default=0)


class Model:
    def __init__(self, unary: np.ndarray, chain: np.ndarray, equal: np.ndarray, similar: np.ndarray):
        self.unary, self.chain, self.equal, self.similar = unary, chain, equal, similar

    def without_skips(self) -> Model:
        return Model(self.unary, self.chain, 0 * self.equal, 0 * self.similar)

    def marginals(self, words: list[str], rounds: int = 12) -> tuple[list[int], np.ndarray]:
        """(free tokens, their label probabilities), by loopy message passing until nothing changes.

        rounds is the bound without skip edges; it grows with the longest skip chain, so that messages reach its end.
        """
        shapes, free, chain, equal, similar = graph(words)
        if not free:
            return free, np.empty((0, len(LABELS)))
        x = features(words, shapes, free, equal + similar)
        scores = x @ self.unary
        scores[x[:, _AT["checked"]] == 0, LABELS.index("card")] = NEVER
        inside = set(free)
        for row, i in enumerate(free):  # clamped neighbours
            if i and i - 1 not in inside:
                scores[row] += self.chain[0]
            if i + 1 < len(words) and i + 1 not in inside:
                scores[row] += self.chain[:, 0]
        at = {i: row for row, i in enumerate(free)}
        pairs = [(at[a], at[b]) for a, b in chain + equal + similar]
        if pairs:
            source = np.array([a for a, _ in pairs] + [b for _, b in pairs])
            target = np.array([b for _, b in pairs] + [a for a, _ in pairs])
            ends = np.cumsum([0, *2 * [len(chain), len(equal), len(similar)]])
            weights = [np.exp(w) for w in (self.chain, self.equal, self.similar, self.chain.T, self.equal.T, self.similar.T)]
            back = np.concatenate((np.arange(len(pairs), 2 * len(pairs)), np.arange(len(pairs))))
            sent = np.zeros((len(source), len(LABELS)))
            for _ in range(rounds + 4 * _longest(sorted(equal + similar, key=lambda e: e[1]))):
                total = scores.copy()
                np.add.at(total, target, sent)
                cavity = total[source] - sent[back]
                told = np.exp(cavity - cavity.max(axis=1, keepdims=True))
                new = np.log(np.concatenate([told[a:b] @ w for a, b, w in zip(ends, ends[1:], weights)]) + 1e-300)
                new -= new.max(axis=1, keepdims=True)
                done = np.abs(new - sent).max() < 1e-4
                sent = 0.5 * sent + 0.5 * new if not done else new
                if done:
                    break
            scores = scores.copy()
            np.add.at(scores, target, sent)
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        return free, p / p.sum(axis=1, keepdims=True)


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng: random.Random, n: int = 16) -> str:
    """n digits whose last one is the check digit."""
    head = _digits(rng, n - 1)
    return next(head + d for d in "0123456789" if luhn(head + d))


_FILLER = ["the", "of", "it", "was", "sent", "on", "from", "report", "and", "line", "value", "room", "la", "und"]


def _values(rng: random.Random, kind: str, cue: bool) -> list[str]:
    """The words of a value; forms that say nothing by themselves come with a cue only."""
    digits = lambda n: _digits(rng, n)
    if kind == "email":
        return [f"u{digits(2)}.{rng.choice(_FILLER)}@{rng.choice(_FILLER)}.{rng.choice(['com', 'org', 'net'])}"]
    if kind == "ip":
        return [".".join(str(rng.randint(0, 255)) for _ in range(4))]
    if kind == "card":
        card = _card(rng)
        return [card] if rng.random() < 0.5 else [card[i : i + 4] for i in range(0, 16, 4)]
    if kind == "phone":
        form = rng.random()
        if form < 0.4:
            return [f"+{digits(rng.randint(1, 2))}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"]
        if cue:
            return [f"{digits(3)}-{digits(3)}-{digits(4)}" if form < 0.7 else digits(10)]
        return [f"+{digits(2)}-{digits(3)}-{digits(4)}"]
    if cue and rng.random() < 0.4:
        return ["".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFG") for _ in range(rng.randint(24, 40))) + digits(1)]
    said = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 64])))
    return [said.upper() if rng.random() < 0.2 else said]


def _plain(rng: random.Random) -> str:
    """A number or name that is nobody's data."""
    digits = lambda n: _digits(rng, n)
    mixed = "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(24, 40))) + digits(1)
    return rng.choice([digits(rng.randint(1, 5)), f"{digits(2)}.{digits(2)}", f"v{digits(1)}.{digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"a{digits(3)}", digits(8), digits(10), digits(16), f"{digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", mixed, f"@{rng.choice(_FILLER)}"])


def _sentence(rng: random.Random) -> list[tuple[str, str]]:
    """Labelled words."""
    word = lambda: (rng.choice(_FILLER), "O")
    out = [word() for _ in range(rng.randint(2, 6))]
    kind = rng.choice([*LABELS, "O", "O"])
    cue = rng.random() < (0.5 if kind != "O" else 0.3)
    if cue:
        out.append((rng.choice(CUES[kind if kind in CUES else "other"].split()), "O"))
        if rng.random() < 0.5:
            out.append((rng.choice(["=", ":", "is"]), "O"))
    out += [(w, kind) for w in (_values(rng, kind, cue) if kind != "O" else [_plain(rng)])]
    out += [word() for _ in range(rng.randint(2, 6))]
    if kind != "O" and rng.random() < 0.5:  # said again without its cue
        out += [x for x in out if x[1] != "O"] + [word()]
    return out


def _other_form(rng: random.Random, w: str) -> str:
    """The same value as people write it again: other case, other marks, cut off, a digit lost."""
    way = rng.random()
    if way < 0.25:
        return w.upper()
    if way < 0.5:
        return w.replace("-", rng.choice(["", ".", "/"]))
    if way < 0.75 and len(w) >= 24:
        return w[: rng.randint(12, len(w) - 1)]
    at = rng.randrange(len(w))
    return w[:at] + w[at + 1 :] if len(w) > 8 else w


def _document(rng: random.Random) -> list[tuple[str, str]]:
    """Labelled words of some sentences; values, and numbers that are none, come again with and without a cue."""
    word = lambda: (rng.choice(_FILLER), "O")
    out = [x for _ in range(rng.randint(0, 2)) for x in _sentence(rng)]
    kind = rng.choice(["phone", "secret", "card", "O", "O"])
    values = _values(rng, kind, True) if kind != "O" else [_plain(rng)]
    for turn in range(rng.randint(2, 4)):
        out += [word() for _ in range(rng.randint(2, 5))]
        if turn == 0 and (kind != "O" or rng.random() < 0.6) or rng.random() < 0.15:
            out.append((rng.choice(CUES[kind if kind != "O" else "other"].split()), "O"))
        again = [_other_form(rng, values[0])] if turn and kind != "card" and len(values) == 1 and rng.random() < 0.4 else values
        out += [(w, kind) for w in again]
        if rng.random() < 0.2:  # values side by side
            beside = rng.choice(LABELS[1:])
            out += [(w, beside) for w in _values(rng, beside, False)]
        out += [word() for _ in range(rng.randint(1, 3))]
        if rng.random() < 0.3:
            out += _sentence(rng)
    return out


@lru_cache(maxsize=2)
def trained(sentences: int = 1_500, seed: int = 7, steps: int = 400) -> Model:
    """Pseudo-likelihood: each free token given the true labels of its neighbours. Half as many documents as sentences."""
    rng, rows = random.Random(seed), []
    for n in range(sentences + sentences // 2):
        said = _sentence(rng) if n < sentences else _document(rng)
        words, truth = [w for w, _ in said], [LABELS.index(k) for _, k in said]
        shapes, free, _, equal, similar = graph(words)
        mates: list[dict[int, list[int]]] = [{}, {}]
        for kind, edges in zip(mates, (equal, similar)):
            for a, b in edges:
                kind.setdefault(a, []).append(truth[b])
                kind.setdefault(b, []).append(truth[a])
        for i, x in zip(free, features(words, shapes, free, equal + similar)):
            rows.append((x, truth[i], truth[i - 1] if i else 0, truth[i + 1] if i + 1 < len(words) else 0, mates[0].get(i, []), mates[1].get(i, [])))
    n, k = len(rows), len(LABELS)
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    before, after = np.eye(k)[[r[2] for r in rows]], np.eye(k)[[r[3] for r in rows]]
    mate = [np.array([np.bincount(r[c], minlength=k) for r in rows], float) for c in (4, 5)]
    goal = np.eye(k)[y]
    unary, chain, equal, similar = np.zeros((x.shape[1], k)), np.zeros((k, k)), np.zeros((k, k)), np.zeros((k, k))
    never = np.zeros((n, k))
    never[x[:, _AT["checked"]] == 0, LABELS.index("card")] = NEVER
    squares = [np.full_like(a, 1e-8) for a in (unary, chain, equal, similar)]
    for _ in range(steps):
        s = x @ unary + before @ chain + after @ chain.T + mate[0] @ equal + mate[1] @ similar + never
        p = np.exp(s - s.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - goal) / n
        both = lambda m: (m.T @ d + d.T @ m) / 2
        grads = (x.T @ d + 1e-4 * unary, before.T @ d + d.T @ after + 1e-4 * chain, both(mate[0]) + 1e-4 * equal, both(mate[1]) + 1e-4 * similar)
        for a, g, q in zip((unary, chain, equal, similar), grads, squares):  # AdaGrad
            q += g * g
            a -= 0.5 * g / np.sqrt(q)
    return Model(unary, chain, (equal + equal.T) / 2, (similar + similar.T) / 2)
