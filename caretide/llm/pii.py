"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

Base spans are the leftmost non-overlapping matches of four patterns, found by scans that stay linear on any text.  The
model then scores whole candidate spans (a phone number without a country code, a card number in odd groups, an address
spelt with "at" and "dot", a national number, an account number) by features of the span: its shape, its checksum, its
grouping, the words before it.  A dynamic program over bounded spans (``MAX_TOKENS``, ``MAX_CHARS``) chooses boundaries
and types together; what no candidate covers is no entity and scores 0.  Weights are fitted here by conditional
likelihood on sentences written by rule, and stored beside this module.  Added spans never overlap base spans, which always stay.

Only stretches that can hold a candidate are looked at: runs of digits and their separators with seven digits or more,
the letters and digits of an account number, and the neighbourhood of a written-out "at" or "dot".  Every candidate lies
within one of them, so the result is that of the program over the whole text, and its cost is linear in it.

Defined cases: a null or empty text has no spans, an empty table no rows; positions are code points, ends exclusive; of
segmentations that score the same the one whose spans end first in the scan stays; rows stand on their own, so repeated
rows give equal results; columns named as the results give way to them, other columns of any name stay.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
from bisect import bisect_left
from functools import lru_cache
from importlib.resources import files
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretide.llm import storage

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "national_id", "iban")
Span = tuple[int, int, int]  #: start, end, kind

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++").match
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
# A maximal run of digits with single separators; shorter ones than 12 digits can be passed over.
CARD = re.compile(r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,}+").finditer
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def digits_of(piece: str) -> str:
    return "".join(c for c in piece if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns, by start and then kind."""
    found: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN(text, at + 1)):
            free = m.end()
            found.append((start, free, 0))
        at = text.find("@", at + 1)
    for m in IP(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((*m.span(), 1))
    for m in CARD(text):
        digits = digits_of(m[0])
        if len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), 2))
    if "+" in text:
        for m in PHONE(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                found.append((*m.span(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


# The model ------------------------------------------------------------------------------------------------------------

TOKENS = re.compile(r"[A-Za-z]+|[0-9]+|\S").finditer
MAX_TOKENS = 32  #: longest span in tokens
MAX_CHARS = 320  #: and in characters: the longest address that mail standards allow
CONTEXT = 64  #: characters before a span that are read for cues
#: Stretches that can hold a candidate: of digits, of an account number, and what shows a written-out address.
DIGITS_AT = re.compile(r"[(0-9][0-9 ().\-/]{6,}+").finditer
IBAN_AT = re.compile(r"(?<![A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+").finditer
SPELT_AT = re.compile(r"[\[({<]\s?at\s?[\])}>]|\bdot\b", re.I)
DIGIT_SPAN = re.compile(r"\(?[0-9][0-9 ().\-/]*[0-9]").fullmatch
IBAN_SPAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}").fullmatch
LABEL = r"[A-Za-z0-9-]*[A-Za-z][A-Za-z0-9-]*"
SPELT = re.compile(rf"[A-Za-z0-9._+-]*[A-Za-z0-9]\s?(?:[\[({{<]\s?at\s?[\])}}>]|\bat\b|@)\s?{LABEL}(?:\s?(?:[\[({{<]\s?dot\s?[\])}}>]|\bdot\b|\.)\s?{LABEL})+", re.I).fullmatch
TOP_LEVEL = frozenset("com org net edu gov info io de fr es eu uk ch at it nl".split())
CUES = {
    "phone": frozenset("phone tel telephone call cell mobile fax whatsapp telefon handy anrufen rufnummer telephone portable appelez telefono movil llame".split()),
    "card": frozenset("card visa mastercard amex credit debit karte carte tarjeta".split()),
    "national_id": frozenset("ssn social security national insurance passport id ausweis".split()),
    "iban": frozenset("iban account konto compte cuenta".split()),
    "email": frozenset("email mail contact write reach adresse correo".split()),
}
#: Words before numbers that are none of a person.
OTHER_CUES = frozenset("version v release build part item order invoice ref reference serial model lot batch article sku isbn bestellung rechnung artikel commande facture pedido factura".split())
#: Words of measures and counts, whose numbers are no one's either.
OTHER_CUES |= frozenset("ratio rate score total sum count amount weight size length distance page pages line lines row rows step steps year years population budget revenue sales units".split())
#: Words before a spelt-out "at" that say where something is and name no one.
PLACED = frozenset("meet meets met meeting look looked looking see seen find found visit buy order sold arrive arrived stay stayed work works worked live start starts end ends begin shop read sign register online available now today us me you him her them it we they everyone all one open page site news more".split())


def mod97(account: str) -> bool:
    compact = account.replace(" ", "")
    moved = compact[4:] + compact[:4]
    return moved.isascii() and moved.isalnum() and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def groups_of(piece: str) -> str:
    return "-".join(str(len(g)) for g in re.findall(r"[0-9]+", piece))


STORED = "pii_weights.json"


@lru_cache(maxsize=4096)
def _shape(piece: str, kind: str) -> tuple[str, ...]:
    digits, out = digits_of(piece), []
    if kind in ("phone", "card", "national_id"):
        out += [f"{kind} digits {len(digits)}", f"{kind} groups {groups_of(piece)}", f"{kind} in {groups_of(piece).count('-') + 1}"]
        if re.fullmatch(r"\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}", piece):
            out.append(f"{kind} area number")
        if piece[0] == "(" and ")" in piece:
            out.append(f"{kind} brackets")
        if re.search(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}", piece):
            out.append(f"{kind} date")
        if piece.isdigit():
            out.append(f"{kind} bare")
        if piece.count("(") != piece.count(")"):
            out.append(f"{kind} unbalanced")
        if kind == "card":
            out.append("card luhn" if luhn(digits) else "card no luhn")
    elif kind == "iban":
        out.append("iban checked" if mod97(piece) else "iban unchecked")
    elif kind == "email":
        out.append("email bracket" if re.search(r"[\[({<]", piece) else "email words")
        if not piece[0].isdigit() and re.split(r"[^A-Za-z0-9._+-]", piece, maxsplit=1)[0].lower() in PLACED:
            out.append("email placed")
        out.append("email top" if re.split(r"[^A-Za-z0-9-]+", piece)[-1].lower() in TOP_LEVEL else "email no top")
    return tuple(out)


def features(text: str, start: int, end: int, kind: str, before: list[str]) -> list[str]:
    """Names of the features of a whole candidate span: its surroundings and its shape."""
    out = [kind, f"{kind} cue" if not CUES.get(kind, frozenset()).isdisjoint(before) else f"{kind} no cue"]
    if not OTHER_CUES.isdisjoint(before[-3:]):
        out.append(f"{kind} other cue")
    if start and (text[start - 1].isalnum() or text[start - 1] in "-./,#$€=_") or end < len(text) and (text[end].isalnum() or text[end] in "-/%€_" or text[end] in ".,:" and text[end + 1 : end + 2].isdigit()):
        out.append(f"{kind} stuck")
    return [*out, *_shape(text[start:end], kind)]


def stretches(text: str) -> list[tuple[int, int]]:
    """Stretches outside which no candidate lies, apart from one another and in order."""
    found = [m.span() for m in DIGITS_AT(text) if sum(map(m[0].count, "0123456789")) >= 7]
    found += [m.span() for m in IBAN_AT(text)]
    found += [(max(0, m.end() - MAX_CHARS), min(len(text), m.start() + MAX_CHARS)) for m in SPELT_AT.finditer(text)]
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(found):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _same(a: str, b: str) -> bool:
    """Whether two neighbouring characters belong to one token."""
    return a.isascii() and b.isascii() and (a.isalpha() and b.isalpha() or a.isdigit() and b.isdigit())


def candidates(text: str, lo: int = 0, hi: int | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, list[str]]]]:
    """Tokens of a stretch, and its candidate spans as (first token, end token, kind, features)."""
    hi = len(text) if hi is None else hi
    tokens = [m.span() for m in TOKENS(text, lo, hi)]
    if tokens and lo and _same(text[lo - 1], text[lo]):
        del tokens[0]  # the rest of a token that begins before the stretch
    if tokens and hi < len(text) and _same(text[hi - 1], text[hi]):
        del tokens[-1]
    found = []
    spelt = SPELT_AT.search(text, lo, hi) is not None
    for i, (start, _) in enumerate(tokens):
        first, before, n = text[start], None, 0
        number, account = first.isascii() and first.isdigit() or first == "(", "A" <= first <= "Z"
        if not (number or account or spelt and (first.isalnum() or first in "._+-")):
            continue
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            a, end = tokens[j]
            last = text[a]
            if end - start > MAX_CHARS:
                break
            if number and last in "0123456789":
                n += end - a
            elif number and last not in "().-/":
                number = False
            if not spelt and not (number and n <= 19 or account and end - start <= 42):
                break
            if not text[end - 1].isalnum():
                continue
            piece = text[start:end]
            if number and 7 <= n <= 19 and DIGIT_SPAN(piece):
                kinds = [k for k, fits in (("phone", n <= 15), ("card", n >= 12), ("national_id", n == 9 and groups_of(piece) == "3-2-4")) if fits]
            elif account and IBAN_SPAN(piece):
                kinds = ["iban"]
            elif spelt and j - i >= 4 and SPELT_AT.search(piece) and SPELT(piece):
                kinds = ["email"]
            else:
                continue
            if before is None:
                before = [m[0].lower() for m in TOKENS(text, max(0, start - CONTEXT), start)][-5:]
            found += [(i, j + 1, KINDS.index(k), features(text, start, end, k, before)) for k in kinds]
    return tokens, found


def viterbi(n: int, spans: list[tuple[int, int, int, float]]) -> list[int]:
    """Indices of the spans of the best segmentation of n tokens; tokens between spans score 0."""
    best, back = [0.0] * (n + 1), [-1] * (n + 1)
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (_, end, _, _) in enumerate(spans):
        ending[end].append(k)
    for at in range(1, n + 1):
        best[at] = best[at - 1]
        for k in ending[at]:
            score = best[spans[k][0]] + spans[k][3]
            if score > best[at]:
                best[at], back[at] = score, k
    out, at = [], n
    while at > 0:
        if back[at] >= 0:
            out.append(back[at])
            at = spans[back[at]][0]
        else:
            at -= 1
    return out[::-1]


def marginals(n: int, spans: list[tuple[int, int, int, float]]) -> np.ndarray:
    """Probability of each span over all segmentations."""
    at = {p: k for k, p in enumerate(sorted({0, n, *(s[0] for s in spans), *(s[1] for s in spans)}))}
    ends: list[list[tuple[int, float]]] = [[] for _ in at]
    starts: list[list[tuple[int, float]]] = [[] for _ in at]
    for a, b, _, score in spans:
        ends[at[b]].append((at[a], score))
        starts[at[a]].append((at[b], score))
    alpha, beta = [0.0] * len(at), [0.0] * len(at)
    for t in range(1, len(at)):
        alpha[t] = _log_sum([alpha[t - 1], *(alpha[a] + score for a, score in ends[t])])
    for t in range(len(at) - 2, -1, -1):
        beta[t] = _log_sum([beta[t + 1], *(beta[b] + score for b, score in starts[t])])
    return np.exp([alpha[at[a]] + score + beta[at[b]] - alpha[-1] for a, b, _, score in spans])


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top if len(values) == 1 else top + math.log(sum(math.exp(v - top) for v in values))


def sentences(n: int = 400, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Training sentences by rule: entities in many shapes among words, and numbers that are none."""
    rng, out = random.Random(seed), []
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        body = "4" + d(14)
        full = next(body + c for c in "0123456789" if luhn(body + c))
        return rng.choice([full, " ".join(full[k : k + 4] for k in range(0, 16, 4)), "-".join(full[k : k + 4] for k in range(0, 16, 4))])

    def account() -> str:
        rest = d(18)
        check = next(f"{c:02d}" for c in range(2, 99) if mod97(f"DE{c:02d}{rest}"))
        full = f"DE{check}{rest}"
        return rng.choice([full, " ".join(full[k : k + 4] for k in range(0, len(full), 4))])

    at, dot = [" at ", " [at] ", "[at]", " (at) ", "(at)"], {" at ": " dot ", " [at] ": " [dot] ", "[at]": "[dot]", " (at) ": " (dot) ", "(at)": "(dot)"}

    def address() -> str:
        how = rng.choice(at)
        local = f"{word()}{rng.choice(['', '.' + word(), d(2), f'.{word()}.{word()}{d(2)}'])}"
        spelt = f"{how}{word()}{rng.choice(['', '', dot[how] + word()])}{dot[how]}{rng.choice(['com', 'org', 'net', 'de'])}"
        return local + rng.choice([str, str, str.upper, str.title])(spelt)

    def unchecked(k: int) -> str:
        while luhn(out := d(k)):
            pass
        return rng.choice([out, " ".join(out[i : i + 4] for i in range(0, k, 4)), "-".join(out[i : i + 4] for i in range(0, k, 4))])

    def odd_card() -> str:
        full = digits_of(card())
        return rng.choice([".", "  ", "/"]).join(full[k : k + 4] for k in range(0, 16, 4))

    phones = [lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"{d(3)} {d(3)} {d(4)}"]
    cued = [lambda: f"0{d(3)} {d(7)}", lambda: f"0{d(2)}-{d(8)}", lambda: d(10), lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"{d(3)}-{d(4)}", lambda: f"0{d(4)}/{d(6)}"]
    nothing = [
        lambda: f"20{d(2)}-0{rng.randint(1, 9)}-1{d(1)}", lambda: f"1{d(1)}.0{rng.randint(1, 9)}.20{d(2)}", lambda: d(rng.randint(7, 11)), lambda: unchecked(rng.randint(12, 19)), lambda: unchecked(16), lambda: f"{d(4)}-{d(4)}", lambda: f"{d(1)}.{d(7)}",
        lambda: f"{d(2)} {d(3)} {d(3)}", lambda: f"20{d(2)}-1{d(1)}-0{rng.randint(1, 9)} 1{d(1)} 2{d(1)}", lambda: f"{d(4)} {d(4)} {d(4)}", lambda: f"19{d(2)}-20{d(2)}", lambda: f"978-{d(1)}-{d(3)}-{d(5)}-{d(1)}",
        lambda: f"{d(5)}-{d(5)}", lambda: f"{d(3)}/{d(4)}/{d(3)}", lambda: f"{word()} at {word()} dot {word()}", lambda: f"{rng.choice(sorted(PLACED))} at {word()} dot {rng.choice(['com', 'org', 'net', 'de'])}", lambda: f"AB{d(2)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(2)}-{d(2)}-{d(4)}-{d(3)}", lambda: f"{d(1)}-{d(3)}-{d(3)}", lambda: ".".join(d(rng.randint(1, 4)) for _ in range(rng.randint(3, 5))), lambda: "-".join(d(rng.randint(2, 5)) for _ in range(4)),
    ]
    make = {"phone": lambda: rng.choice(phones)(), "card": lambda: rng.choice([card, card, odd_card])(), "iban": account, "email": address, "national_id": lambda: f"{d(3)}-{d(2)}-{d(4)}"}
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(rng.randint(1, 5))), []
        for _ in range(rng.randint(1, 3)):
            kind = rng.choice([None, None, "phone", "phone", "cued", "card", "iban", "email", "national_id"])
            name = "phone" if kind == "cued" else kind
            if name and (kind == "cued" or rng.random() < 0.4):
                text += " " + rng.choice(sorted(CUES[name])) + rng.choice(["", ":", " is"])
            elif kind is None and rng.random() < 0.2:
                text += " " + rng.choice(sorted(CUES["card"])) + rng.choice(["", ":", " is"])
            numbered = kind is None and rng.random() < 0.4  # numbers of things, in any shape of a person's
            if numbered:
                text += " " + rng.choice(sorted(OTHER_CUES)) + rng.choice(["", ":", " no"])
            text += " "
            piece = rng.choice(nothing + phones * 2 if numbered else nothing)() if kind is None else rng.choice(cued)() if kind == "cued" else make[kind]()
            if name:
                spans.append((len(text), len(text) + len(piece), KINDS.index(name)))
            text += piece + rng.choice(["", ".", ",", ""]) + " " + " ".join(word() for _ in range(rng.randint(1, 4)))
        out.append((text, spans))
    return out


def fitted(rounds: int = 150, rate: float = 1.0, pull: float = 2e-3) -> dict[str, float]:
    """Weights by gradient ascent on the conditional likelihood of ``sentences()``, with a pull to 0."""
    names: dict[str, int] = {}
    data, flat, sizes, gold = [], [], [], []
    for text, truth in sentences():
        tokens, found = candidates(text)
        if found:
            data.append((len(tokens), [(a, b, k) for a, b, k, _ in found]))
        for a, b, k, fs in found:
            flat += [names.setdefault(f, len(names)) for f in fs]
            sizes.append(len(fs))
            gold.append(float((tokens[a][0], tokens[b - 1][1], k) in truth))
    flat, first, wanted = np.array(flat), np.cumsum([0, *sizes[:-1]]), np.array(gold)
    w, squares = np.zeros(len(names)), np.full(len(names), 1e-6)
    for _ in range(rounds):
        scores, at, p = np.add.reduceat(w[flat], first).tolist(), 0, []
        for n, spans in data:
            p.append(marginals(n, [(*s, score) for s, score in zip(spans, scores[at : at + len(spans)])]))
            at += len(spans)
        gradient = np.bincount(flat, np.repeat(wanted - np.concatenate(p), sizes), len(names)) - pull * len(data) * w / 10
        squares += gradient**2
        w += rate * gradient / np.sqrt(squares)
    return dict(zip(names, w.tolist()))


@lru_cache(maxsize=1)
def learned() -> dict[str, float]:
    """The weights that ``fitted()`` gave, as stored beside this module; ``python -m caretide.llm.pii`` writes them anew."""
    return json.loads((files(__package__) / STORED).read_text())


class Finder:
    def __init__(self, weights: dict[str, float]):
        self.weight = weights.get

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Spans that the model adds, clear of the base spans."""
        starts, longest = [s[0] for s in base], max((b - a for a, b, _ in base), default=0)

        def taken(lo: int, hi: int) -> bool:
            return any(s[1] > lo for s in base[bisect_left(starts, lo - longest) : bisect_left(starts, hi)])

        out = []
        for lo, hi in stretches(text):
            tokens, found = candidates(text, lo, hi)
            free = [f for f in found if not taken(tokens[f[0]][0], tokens[f[1] - 1][1])]
            scored = [(a, b, k, sum(self.weight(f, 0.0) for f in fs)) for a, b, k, fs in free]
            out += [(tokens[scored[k][0]][0], tokens[scored[k][1] - 1][1], scored[k][2]) for k in viterbi(len(tokens), scored)]
        return out

    def find(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans by start and kind."""
        if not text:
            return [], []
        base = base_spans(text)
        return base, sorted({*base, *self.added(text, base)}, key=lambda s: (s[0], s[2], s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span, or run of overlapping spans, replaced by the name of its first kind."""
    if not spans:
        return text
    out, at, open_ = [], 0, -1
    for a, b, k in spans:
        if a >= open_:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        open_ = max(open_, b)
        at = open_
    return "".join(out) + text[at:]


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, counts of base spans by kind, ``base_sha256`` and ``spans``."""
    storage.prepare(docs.sparkSession)
    added = [*[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"]
    kept = [f for f in docs.schema.fields if f.name != text and f.name not in added]
    schema = T.StructType([*kept, *[T.StructField(c, T.LongType() if c[:2] == "n_" else T.StringType()) for c in added]])
    source = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").alias("__text"))
    weights = learned()

    def run(batches):
        finder = Finder(weights)
        for batch in batches:
            rows = []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                base, every = finder.find(t)
                rows.append((*[sum(k == kind for _, _, k in base) for kind in range(len(BASE_KINDS))], hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            columns = list(zip(*rows)) or [()] * len(added)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, pa.int64() if n[:2] == "n_" else pa.string()) for n, c in zip(added, columns)]], schema.names)

    return storage.map_arrow(source, run, schema)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every found span of the text replaced; texts without any are untouched."""
    storage.prepare(docs.sparkSession)
    at = docs.columns.index(text)
    weights = learned()

    def run(batches):
        finder = Finder(weights)
        for batch in batches:
            texts = [redacted(t, finder.find(t)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return storage.map_arrow(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of ``documents``."""
    return find(storage.table(spark, sf_dir, "documents").select("doc_id", "text"))


if __name__ == "__main__":
    Path(__file__).with_name(STORED).write_text(json.dumps({n: round(w, 6) for n, w in sorted(fitted().items())}, indent=0) + "\n")
