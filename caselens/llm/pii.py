"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The patterns give the base spans. Around digits, @ and spelled-out addresses the
field scores candidate segments of up to ``LONGEST`` tokens by features of the
whole span (digits, grouping, checksum, what stands beside and before it). A
dynamic program over token positions chooses boundaries and kinds together;
tokens of base spans belong to no added one.

The field is trained here, by gradient ascent on the likelihood of made-up lines
that hold personal data in several notations, and look-alikes without any. They
are drawn from a fixed seed, so the weights are the same everywhere.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from caselens.llm.common import byte_slices, tidied

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Their runs are entered at the first character only, which changes no match but keeps long runs linear.
EMAIL_REST = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_START = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LONGEST = 28  # tokens of a segment: marks and runs of letters or digits; bounds the dynamic program
WINDOW = 48
SLICE_BYTES = 1 << 20  # of text that is searched at once
SPACE = re.compile(r"\s")
TOKEN = re.compile(r"[^\W_]+|\S")
TRIGGER = re.compile(r"[0-9@]|[\[({<]\s?(?:at|dot)\s?[\])}>]|\s(?:at|dot)\s(?=[\w-]+(?:\s(?:dot)\s|\.))|:[0-9a-f]{0,4}:[0-9a-f]", re.I)  # in any case, as MAIL_SHAPE and segments() read it
CUES = {"email": {"email", "mail", "contact", "write", "reach", "correo", "courriel", "adresse"}, "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "cell", "telefon", "téléphone", "teléfono", "móvil", "handy"},
        "card": {"card", "visa", "mastercard", "amex", "credit", "carte", "karte", "tarjeta"}, "ip": {"ip", "host", "server", "address", "gateway", "dns", "ping"}}
NOT_NAMES = {"me", "us", "you", "him", "her", "them", "it", "be", "is", "was", "are", "look", "meet", "arrive", "stay", "stop", "not", "only", "here", "there", "and", "or", "back", "home"}
AGAINST = {"version", "v", "ver", "order", "invoice", "isbn", "issn", "doi", "page", "pages", "rfc", "section", "chapter", "no", "nr", "id", "sku", "build", "release", "serial"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := (EMAIL_REST.match(text, at) if at else None) or EMAIL_START.search(text, at):
        yield m.span()
        at = m.end()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in the order of ``KINDS``."""
    found = [(*s, 0) for s in _emails(text)] if "@" in text else []
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    if re.search("[0-9]", text):
        found += [(*m.span(), 1) for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m.group().split("."))]
        found += [(*m.span(), 2) for m in CARD.finditer(text) if 12 <= len(d := digits(m)) <= 19 and luhn(d)]
        if "+" in text:
            found += [(*m.span(), 3) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


# --- segments and their features

MAIL_SHAPE = re.compile(r"[\w.%+-]+(?:(?:\s?@\s?|\s?[\[({<]\s?at\s?[\])}>]\s?)[\w-]+(?:\.[\w-]+|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?[\w-]+|\sdot\s[\w-]+)+|\sat\s[\w-]+(?:\sdot\s[\w-]+)+)", re.I)
MORE = re.compile(r"\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?\w|\.\w|\sdot\s\w", re.I)  # after an address: it may go on
TOPS = {"com", "org", "net", "edu", "gov", "info", "biz", "io", "eu", "de", "fr", "es", "it", "nl", "ch", "at", "uk", "us", "ca", "co"}
SHAPES = {
    "email": MAIL_SHAPE,
    "ip": re.compile(r"[0-9]{1,3}(?:\s?(?:\.|[\[({]\s?(?:\.|dot)\s?[\])}])\s?[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}", re.I),
    "card": re.compile(r"[0-9](?:[\s._/-]{0,2}[0-9]){11,18}"),
    "phone": re.compile(r"(?:\+|00)?\s?\(?[0-9](?:[\s().\-/‐-―]{0,3}[0-9]){6,14}"),
}

LEAST_DIGITS, MOST_DIGITS = {"email": 0, "ip": 0, "card": 12, "phone": 7}, {"email": 32, "ip": 32, "card": 19, "phone": 17}


class Line:
    """Tokens of a stretch of text; taken: a byte per character, 1 in base spans."""

    def __init__(self, text: str, taken: bytes = b"", before: str = "", after: str = ""):
        self.text, self.before, self.after = text, before, after
        self.tokens = [m.span() for m in TOKEN.finditer(text)]
        self.free = [not any(taken[s:e]) for s, e in self.tokens]


def features(line: Line, i: int, j: int, kind: str) -> tuple[str, ...] | None:
    """Features of tokens i to j - 1 as one segment of ``kind``; None if its shape is out of the question."""
    a, b = line.tokens[i][0], line.tokens[j - 1][1]
    s = line.text[a:b]
    if not SHAPES[kind].fullmatch(s):
        return None
    left = line.text[a - 1] if a else line.before
    right = line.text[b] if b < len(line.text) else line.after
    digits = re.sub("[^0-9]", "", s)
    words = [line.text[x:y].lower() for x, y in line.tokens[max(0, i - 4) : i]]
    out = [kind, f"{kind}:digits={min(len(digits), 20)}" if kind in ("card", "phone") else f"{kind}:tokens={min(j - i, 12)}"]
    if left.isalnum() or right.isalnum() or left in tuple("@_#=") or right in tuple("@_="):
        out.append(f"{kind}:inside")
    if right and right in "-/:" or left and left in "-/.,":
        out.append(f"{kind}:goes on")
    nxt = line.text[b : b + 2]
    if len(nxt) == 2 and nxt[0] in ".,-" and nxt[1].isdigit():
        out.append(f"{kind}:goes on")
    if CUES[kind] & set(words):
        out.append(f"{kind}:cue")
    elif any(CUES[k] & set(words) for k in KINDS):
        out.append(f"{kind}:other cue")
    if AGAINST & set(words[-2:]):
        out.append(f"{kind}:against")
    if words[-1:] and words[-1].isdigit() or line.tokens[j : j + 1] and line.text[slice(*line.tokens[j])].isdigit():
        out.append(f"{kind}:number beside")
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    if kind == "card":
        out += [f"card:luhn={luhn(digits)}", f"card:first={digits[0]}", f"card:fours={set(groups[:-1]) <= {4}}", f"card:groups={min(len(groups), 6)}"]
    elif kind == "phone":
        out += [f"phone:start={s[0] if s[0] in '+(' else '00' if s.startswith('00') else 'digit'}", f"phone:groups={min(len(groups), 6)}", f"phone:last={groups[-1] if groups[-1] < 6 else 6}",
                f"phone:closed={s.count('(') == s.count(')')}", f"phone:usual={groups[-3:] == [3, 3, 4]}", f"phone:dates={bool(re.fullmatch('[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}', s))}",
                f"phone:mixed={len(set(re.sub('[0-9+() ]', '', s))) > 1}"]
    elif kind == "ip":
        parts = groups if ":" not in s else []
        out += [f"ip:fits={all(int(p) <= 255 for p in re.findall('[0-9]+', s)) if parts else 'hex'}", f"ip:six={':' in s}", f"ip:two={s.count('::')}", f"ip:groups={len(re.split(':', s)) if ':' in s else len(groups)}",
                f"ip:small={bool(parts) and all(int(p) < 30 for p in re.findall('[0-9]+', s))}", f"ip:letters={bool(re.search('[A-Fa-f]', s))}"]
    else:
        last = re.findall(r"[^\W_]+", s)[-1].lower()
        mark = "at" if "@" in s else "bracket" if re.search(r"[][(){}<>]", s) else "word"
        name = s.split()[0].lower()
        if MORE.match(line.text, line.tokens[j - 1][1]):
            out.append("email:more")
        if mark == "word" and name in NOT_NAMES:
            out.append("email:no name")
        out += [f"email:mark={mark}", f"email:{mark},top={last in TOPS}", f"email:top={min(len(last), 7)}", f"email:spaced={bool(re.search(r'@\s|\s@', s))}", f"email:digits={bool(digits)}"]
    return tuple(out)


def segments(line: Line, longest: int = LONGEST) -> list[tuple[int, int, str, tuple[str, ...]]]:
    """Candidate segments of free tokens. A segment starts where a shape can: at a digit, +, ( or a word before an at-sign of some kind."""
    n, out = len(line.tokens), []
    text = [line.text[s:e] for s, e in line.tokens]
    digits = [0]
    for t in text:
        digits.append(digits[-1] + sum("0" <= c <= "9" for c in t))
    local = list(range(n))
    for i in range(n - 2, -1, -1):
        if line.tokens[i][1] == line.tokens[i + 1][0] and (text[i + 1].isalnum() or text[i + 1] in "._%+-") and (text[i].isalnum() or text[i] in "._%+-"):
            local[i] = local[i + 1]
    for i in range(n):
        kinds = ("ip", "card", "phone") if text[i][0].isdigit() else ("phone",) if text[i][0] in "+(" else ()
        near = text[i + 1 : i + 8]
        if text[i][0].isalnum() and (i == 0 or local[i - 1] != local[i] or not text[i - 1][-1].isalnum()):
            k = local[i]  # the last token of the run that a local part can be
            if any(t == "@" or t.lower() == "at" for t in text[k + 1 : k + 4]) or text[i].lower() != "at" and any(t.lower() == "at" for t in text[i + 1 : k + 1]):
                kinds += ("email",)
        if re.fullmatch("[0-9A-Fa-f]{1,4}|:", text[i]) and ":" in near[:4] and "ip" not in kinds:
            kinds += ("ip",)
        if not kinds:
            continue
        for j in range(i + 1, min(n, i + longest) + 1):
            if not line.free[j - 1]:
                break
            if not (text[j - 1][-1].isalnum()) or (j - i < 3 and not any(len(t) > 5 for t in text[i:j])):
                continue
            d = digits[j] - digits[i]
            if d > MOST_DIGITS["ip"]:
                break
            for kind in kinds:
                if LEAST_DIGITS[kind] <= d <= MOST_DIGITS[kind] and (f := features(line, i, j, kind)):
                    out.append((i, j, kind, f))
    return out


class Field:
    """Weights of features; a segment's score is the sum over its features, that of a token outside is 0."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.w = dict(weights or {})

    def score(self, f: tuple[str, ...]) -> float:
        return sum(self.w.get(x, 0.0) for x in f)

    def decode(self, line: Line) -> list[tuple[int, int, str]]:
        """Best set of segments that do not overlap, in tokens: for each position the best way to end there."""
        ends: dict[int, list] = {}
        for i, j, kind, f in segments(line):
            if (x := self.score(f)) > 0:
                ends.setdefault(j, []).append((x, i, kind))
        n = len(line.tokens)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for x, i, kind in ends.get(j, ()):
                if best[i] + x > best[j]:
                    best[j], back[j] = best[i] + x, (i, kind)
        out, j = [], n
        while j:
            if back[j]:
                i, kind = back[j]
                out.append((i, j, kind))
                j = i
            else:
                j -= 1
        return out[::-1]

    def gradient(self, n: int, segs: list, gold: set[tuple[int, int, str]]) -> tuple[float, dict[str, float]]:
        """Log-likelihood of the gold segmentation of n tokens and its gradient, by forward and backward sums over segmentations."""
        scores = [self.score(s[3]) for s in segs]
        by_end: dict[int, list[int]] = {}
        by_start: dict[int, list[int]] = {}
        for k, s in enumerate(segs):
            by_end.setdefault(s[1], []).append(k)
            by_start.setdefault(s[0], []).append(k)
        add = lambda xs: (m := max(xs)) + math.log(sum(math.exp(x - m) for x in xs))
        fwd, bwd = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            fwd[j] = add([fwd[j - 1], *(fwd[segs[k][0]] + scores[k] for k in by_end.get(j, ()))])
        for i in range(n - 1, -1, -1):
            bwd[i] = add([bwd[i + 1], *(bwd[segs[k][1]] + scores[k] for k in by_start.get(i, ()))])
        grad: dict[str, float] = {}
        like = -fwd[n]
        for s, x in zip(segs, scores):
            right = 1.0 if s[:3] in gold else 0.0
            like += right * x
            d = right - math.exp(fwd[s[0]] + x + bwd[s[1]] - fwd[n])
            if abs(d) > 1e-9:
                for f in s[3]:
                    grad[f] = grad.get(f, 0.0) + d
        return like, grad


# --- made-up training lines

def examples(n: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Lines with the places of personal data in them; about half hold look-alikes only."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvz") for _ in range(r.randint(2, 9)))

    def card() -> str:
        d = r.choice("3456") + digits(r.choice([13, 14, 14, 14]))
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(["", " ", "-", ".", "  "])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{r.randint(30, 49)} {digits(3)} {digits(7)}", f"+{r.randint(1, 49)} / {a} / {b}{c}", f"0{digits(2)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"({a}){b}-{c}"])

    def mail() -> str:
        user, host, top = word() + r.choice(["", "." + word(), digits(2)]), word(), r.choice(["com", "org", "net", "de", "fr", "es", "info"])
        at, dot = r.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), (" [at] ", "."), (" @ ", "."), (" at ", " dot ")])
        if r.random() < 0.2:
            user = ".".join(word() for _ in range(r.randint(3, 5)))
        if r.random() < 0.2:
            host += dot + word() if r.random() < 0.5 else dot + r.choice(["co", "ac", "gov"])
            top = r.choice(["uk", "nz", "jp"]) if r.random() < 0.5 else top
        return f"{user}{at}{host}{dot}{top}"

    def short6() -> str:
        part = lambda n: ":".join(f"{r.randint(0x10, 0xFFFF):x}" for _ in range(n))
        a = r.randint(1, 4)
        return f"200{r.choice('123')}:{part(a)}::{part(r.randint(1, 6 - a))}"

    def ip() -> str:
        return r.choice([".".join(str(r.randint(30, 255)) for _ in range(4)).replace(".", r.choice(["[.]", " . ", "(.)"])),
                         ":".join(f"{r.randint(0x1000, 0xFFFF):x}" for _ in range(8)), f"fe80::{r.randint(0x1000, 0xFFFF):x}:{r.randint(0x100, 0xFFFF):x}:{r.randint(1, 0xFFFF):x}", short6(), short6()])

    def like() -> str:
        y, m, d = r.randint(1900, 2030), r.randint(1, 12), r.randint(1, 28)
        bad = digits(15)
        bad += next(c for c in "0123456789" if not luhn(bad + c))
        return r.choice([f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{d:02}/{m:02}/{y} {r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}", f"version {r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", f"Version {r.randint(0, 9)}.{r.randint(0, 9)}.",
                         f"order {digits(10)}", f"no {digits(8)}", digits(r.randint(1, 11)), bad, " ".join(bad[i : i + 4] for i in range(0, 16, 4)), f"{digits(3)},{digits(3)},{digits(3)}", f"{r.randint(1, 99)}.{digits(6)}", f"ISBN 978-{digits(1)}-{digits(5)}-{digits(3)}-{digits(1)}",
                         f"{digits(2)} {digits(3)} {digits(2)} {digits(1)} {digits(3)}", f"{digits(3)} {digits(3)} {digits(4)}", f"{digits(4)} {digits(4)}", f"pages {digits(3)}-{digits(3)}", f"{word()} at {word()} {word()}", f"meet at {word()}. {word()} dot {word()}", f"look at the dot {word()}", f"{word()} {r.choice(sorted(NOT_NAMES))} at {word()} dot {r.choice(['com', word()])}", f"{r.choice(sorted(NOT_NAMES))} at {word()} dot com", f"{word()} at {word()}.com",
                         hashlib.md5(digits(5).encode()).hexdigest(), f"password={hashlib.md5(digits(5).encode()).hexdigest()[:18]}", f'token = "{hashlib.sha1(digits(5).encode()).hexdigest()}"', f"AKIA{digits(3)}{word().upper()}{digits(4)}", f"{y}-{y + 1}", f"{r.randint(1, 9)}:{digits(2)}:{digits(2)}", f"a @ {digits(3)}", digits(r.randint(20, 30)),
                         f"{digits(3)}.{digits(3)}.{digits(3)},{digits(2)}", f"{m}.{d}.{m}.{d}.{m}", f"0.{digits(12)}", f"{digits(3)}-{digits(4)}", f"{r.randint(100, 999)} {r.randint(100, 999)} {r.randint(100, 999)}"])

    makers = {"card": card, "phone": phone, "email": mail, "ip": ip}
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(r.randint(0, 4))), []
        for _ in range(r.randint(1, 3)):
            kind = r.choice(KINDS) if r.random() < 0.5 else None
            piece = makers[kind]() if kind else like()
            if kind and r.random() < 0.4:
                text += " " + r.choice(sorted(CUES[kind])) + r.choice(["", ":"])
            text += " " if text else ""
            if kind:
                spans.append((len(text), len(text) + len(piece), kind))
            text += piece + r.choice(["", ",", ".", ""]) + " " + " ".join(word() for _ in range(r.randint(1, 4)))
        out.append((text, spans))
    return out


def train(lines: int = 500, rounds: int = 25, rate: float = 0.5, keep: float = 1e-3) -> Field:
    """Adaptive gradient ascent on the regularised likelihood. ``lines`` bounds the training set."""
    data = []
    for text, spans in examples(lines):
        line = Line(text)
        at, to = {s: i for i, (s, _) in enumerate(line.tokens)}, {e: i + 1 for i, (_, e) in enumerate(line.tokens)}
        data.append((line, {(at[s], to[e], k) for s, e, k in spans}))
    parts = [(len(line.tokens), segments(line), gold) for line, gold in data]
    names = {f: i for i, f in enumerate(sorted({f for _, segs, _ in parts for s in segs for f in s[3]}))}
    w, seen = np.zeros(len(names)), np.full(len(names), 1e-6)
    field = Field()
    for _ in range(rounds):
        field.w = dict(zip(names, w.tolist()))
        total = -keep * len(data) * w
        for n, segs, gold in parts:
            for f, d in field.gradient(n, segs, gold)[1].items():
                total[names[f]] += d
        total /= len(data)
        seen = 0.9 * seen + 0.1 * total**2
        w += rate * total / np.sqrt(seen)
        rate *= 0.93
    return Field(dict(zip(names, w.tolist())))


@lru_cache(maxsize=1)
def trained() -> Field:
    return train()


# --- whole texts

def stretches(text: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """Parts of the text around what may be personal data, ``window`` characters to either side and on to white space; apart from each other."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        if out and m.end() + window <= out[-1][1]:
            continue
        s, e = max(0, m.start() - window), min(len(text), m.end() + window)
        while s and not text[s - 1].isspace() and not (out and s <= out[-1][1]):
            s -= 1
        gap = SPACE.search(text, e)
        e = gap.start() if gap else len(text)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def find(text: str | None, field: Field) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and base and added spans together, of a whole text (null: empty)."""
    text = text or ""
    base = base_spans(text)
    added = []
    taken = bytearray(len(text)) if base else b""
    for s, e, _ in base:
        taken[s:e] = b"\1" * (e - s)
    for s, e in stretches(text):
        line = Line(text[s:e], taken[s:e], text[s - 1] if s else "", text[e] if e < len(text) else "")
        for i, j, kind in field.decode(line):
            added.append((s + line.tokens[i][0], s + line.tokens[j - 1][1], kind))
    return base, sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def personal_data(docs: DataFrame, keep: list[str], field: Field | None = None, text_col: str = "text") -> DataFrame:
    """The kept columns with base_spans and pii_spans: arrays of (start, end, kind), code points, end exclusive.

    A null or empty text has none. Spans of different base kinds may overlap;
    added ones overlap nothing. Repeated rows each have theirs; an empty table
    stays empty.
    """
    from pyspark.sql import types as T

    if clash := {"base_spans", "pii_spans"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are made here")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))
    schema = docs.select(*keep).schema.add("base_spans", span).add("pii_spans", span)
    model = field or trained()
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "__text", SLICE_BYTES):
                both = [find(t, model) for t in part.column("__text").to_pylist()]
                cols = [pa.array([[dict(zip(("start", "end", "kind"), s)) for s in x[i]] for x in both], kind) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *cols], schema.names)

    return docs.select(docs[text_col].cast("string").alias("__text"), *[docs[c] for c in keep]).mapInArrow(tidied(run), schema)


def masked(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with every span replaced by its kind in brackets; spans that overlap become one, named after the first."""
    if not text or not spans:
        return text
    out, at, end = [], 0, 0
    for s, e, k in sorted(spans):
        if s >= end:
            out += [text[at:s], f"[{k.upper()}]"]
        end = max(end, e)
        at = end
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, field: Field | None = None, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows with personal data masked in the text, and the length column, if there is one, brought up to date."""
    model = field or trained()
    schema = docs.schema
    at = docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text_col, SLICE_BYTES):
                cols = list(part.columns)
                old = cols[at].to_pylist()
                new = [masked(t, find(t, model)[1]) for t in old]
                cols[at] = pa.array(new, cols[at].type)
                if size is not None:
                    cols[size] = pa.array([len(t) if t != o else n for t, o, n in zip(new, old, cols[size].to_pylist())], cols[size].type)
                yield pa.RecordBatch.from_arrays(cols, part.schema.names)

    return docs.mapInArrow(tidied(run), schema)
