"""Personal data by a semi-Markov conditional random field over whole spans.

Four patterns (email, ip, card, phone) give the base spans, which always stay. Between them a semi-Markov field scores candidate
segments of a line as wholes: their digits and groups, separators, checksum, shape, edges and the words before them, for each type. Dynamic
programming over bounded segments then chooses boundaries and types jointly; what it adds bears types of its own (email_like,
ip_like, card_like, phone_like, secret), so the base types stay what the patterns say. The field is trained here, by maximum
likelihood with forward-backward sums over all segmentations, on lines made from a seed: spans in many notations, and look-alikes (dates,
times, amounts, versions, plain numbers) that are none.

What a segment may hold bounds it, not a count of units: 19 digits with three marks between two at most, eight groups of hex digits, a unit
by itself, or an address written out, however long. Every pattern is matched from the ends of runs, so time follows the line's length
whatever it holds. No pattern crosses a line, so only lines that hold a digit, an at sign or its like are looked at.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import bound_batches

BASE = ("email", "ip", "card", "phone")
#: The base patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
ADDED = ("email_like", "ip_like", "card_like", "phone_like", "secret")
KINDS = (*BASE, *ADDED)
DIGIT = re.compile(r"[0-9]")
AT = re.compile(r"@|[\[({]\s?at\s?[\])}]|\bat\b.{1,60}?\bdot\b", re.I)
UNIT = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]")
#: Digits of a segment at most (the longest card number), marks between two of its digits, groups of hex digits.
DIGITS, MARKS, GROUPS = 19, 3, 8
#: The email and ip patterns, matched where a run begins; possessive, as no shorter run could match where the whole doesn't.
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]+"), re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
#: An address written out: name, at, and labels with dots between.
DOT = r"(?:\.|\s\.\s|\s?[\[({]\s?dot\s?[\])}]\s?|\s+dot\s+)"
WRITTEN = re.compile(rf"(?<![A-Za-z0-9])(?<![A-Za-z0-9][._%+-])[A-Za-z0-9]++(?:[._%+-][A-Za-z0-9]++)*+(?:\s?[\[({{]\s?at\s?[\])}}]\s?|\s+at\s+|\s?@\s?)(?P<domain>[A-Za-z0-9]++(?:-[A-Za-z0-9]++)*+(?:{DOT}[A-Za-z0-9]++(?:-[A-Za-z0-9]++)*+)++)", re.I)
#: Labels of a written address after which it may end; it may always end at its last.
ENDS = 4
CUES = {
    "email_like": {"email", "mail", "contact", "write", "correo", "courriel"},
    "ip_like": {"ip", "host", "server", "address", "addr"},
    "card_like": {"card", "visa", "mastercard", "credit", "amex", "karte", "carte", "tarjeta"},
    "phone_like": {"phone", "tel", "telephone", "call", "mobile", "fax", "cell", "handy", "telefon", "telefono", "sms"},
    "secret": {"token", "key", "secret", "password", "passwd", "pwd", "apikey", "auth", "bearer"},
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def passes(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found.split("."))
    digits = DIGIT.findall(found)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn("".join(digits))
    return kind == "email" or 8 <= len(digits) <= 15


def suspicious_lines(text: str) -> Iterator[tuple[int, str]]:
    """(start, line) of lines that can hold any span; the whole text is searched, by line only where something is found."""
    if not DIGIT.search(text) and not AT.search(text):
        return
    at = 0
    for line in text.split("\n"):
        if DIGIT.search(line) or AT.search(line):
            yield at, line
        at += len(line) + 1


def emails(line: str) -> Iterator[tuple[int, int]]:
    """The email pattern's matches: one begins where the run before an at sign does, or where the match before it ended."""
    done = 0
    for run in LOCAL.finditer(line):
        at, start = run.end(), max(run.start(), done)
        if start < at < len(line) and line[at] == "@" and (domain := DOMAIN.match(line, at + 1)):
            done = domain.end()
            yield start, done


def base_spans(line: str) -> list[tuple[str, int, int]]:
    """The patterns' spans in a line: leftmost, not overlapping within a type; matches that fail their check are dropped."""
    digits = DIGIT.search(line) is not None
    found = []
    if "@" in line:
        found += [("email", a, b) for a, b in emails(line)]
    for kind, pattern, needs in (("ip", QUAD, "."), ("card", PATTERNS["card"], ""), ("phone", PATTERNS["phone"], "+")):
        if digits and needs in line:
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(line) if passes(kind, m.group())]
    return found


# ---------------------------------------------------------------------------------------------- segments


def features(line: str, units: list[tuple[int, int]], i: int, j: int) -> list[str] | None:
    """Names of a segment's features (units i to j, both included); None where it can't be a span of any type."""
    start, end = units[i][0], units[j][1]
    span = line[start:end]
    words = [line[a:b] for a, b in units[i : j + 1]]
    digits = sum(c.isdigit() for c in span)
    low = [w.lower() for w in words]
    names = []
    if i == j:
        if len(span) < 16 or not span.isalnum() or not digits:
            return None
        names += ["one", "long unit", "hex" if re.fullmatch(r"[0-9a-fA-F]+", span) and not span.isdigit() else "digits only" if span.isdigit() else "mixed", f"length {min(len(span) // 8, 6)}"]
    elif "@" in span or "at" in low:
        where = low.index("@") if "@" in span else low.index("at")
        rest = low[where + 1 :]
        if not where or not rest or not (rest[0].isalnum() or rest[0] in "])}") or not words[-1].isalpha() or len(words[-1]) < 2 or not words[0].isalnum() or not (("dot" in rest) or "." in rest):
            return None
        if "@" not in span and any(line[a:b] == "." and c[0] > b for (a, b), c in zip(units[i:j], units[i + 1 : j + 1], strict=True)):
            return None  # a sentence ends here
        gaps = sum(b[0] - a[1] > 0 for a, b in zip(units[i:j], units[i + 1 : j + 1], strict=True))
        plain = sum(1 for a, b in zip(low, low[1:], strict=False) if a.isalnum() and b.isalnum() and not {a, b} & {"at", "dot", "@"})
        names += ["mail", "mail at sign" if "@" in span else "mail at word", f"mail brackets {min(sum(w in '[](){}' for w in words), 4)}", f"loose {min(plain, 3)}", f"gaps {min(gaps, 4)}", "dot word" if "dot" in rest else "dot sign", "tld" if len(words[-1]) <= 4 else "long end"]
    else:
        if not (words[0][0].isdigit() or (words[0] in "+(" and i < j)) or not words[-1].isdigit() or any(not w.isdigit() and w not in ".()-/+:" for w in words):
            if not (":" in words and re.fullmatch(r"(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}", span)):
                return None
            names.append("colon groups of hex")
        if not 7 <= digits <= 19 and "colon groups of hex" not in names:
            return None
        groups = [len(w) for w in words if w.isdigit()]
        kinds = "".join(sorted({w for w in words if not w.isdigit()} | ({" "} if any(b[0] > a[1] for a, b in zip(units[i:j], units[i + 1 : j + 1], strict=True)) else set())))
        amount = "7" if digits == 7 else "8-9" if digits < 10 else "10" if digits == 10 else "11-12" if digits < 13 else "13-15" if digits < 16 else "16-19"
        shape = "-".join(map(str, groups)) if len(groups) < 6 else "many"
        names += ["numbers", f"digits {amount}", f"shape {shape}", f"separators {kinds}", f"groups {min(len(groups), 6)}"]
        if len(groups) == 4 and set(words) - {w for w in words if w.isdigit()} == {"."}:
            names.append("quad")
        if digits >= 13:
            names.append("luhn" if luhn("".join(c for c in span if c.isdigit())) else "no luhn")
        if span.count("(") != span.count(")"):
            names.append("open bracket")
    if start and (line[start - 1].isalnum() or line[start - 1] in "@._-+/:$€£") or end < len(line) and (line[end].isalnum() or (line[end] in "@-/:%" and end + 1 < len(line) and line[end + 1].isalnum())):
        names.append("cut")
    before = re.findall(r"[a-z]+", line[max(0, start - 24) : start].lower())[-2:]
    cues = [f"cue {kind}" for kind, some in CUES.items() if some.intersection(before)]
    return [*names, *cues, "no cue"] if not cues else [*names, *cues]


def reaches(line: str, units: list[tuple[int, int]], i: int, covered: np.ndarray) -> Iterator[int]:
    """Last units that a number beginning with unit i may have."""
    digits = groups = marks = 0
    colons = line[units[i][1] : units[i][1] + 1] == ":"
    for j in range(i, len(units)):
        a, b = units[j]
        if covered[b] > covered[a] or (j > i and line[a] == "+"):
            return
        if not line[a].isalnum():
            marks += 1
            if marks > MARKS:
                return
            continue
        marks, groups = 0, groups + 1
        if not line[a:b].isdigit():
            if not colons or b - a > 4 or groups > GROUPS:
                return
            digits = DIGITS  # letters: only as groups of hex digits
        digits += b - a
        if digits > DIGITS and (not colons or groups > GROUPS):
            return
        if not (line[b : b + 1] in "-./:" and line[b + 1 : b + 2].isdigit()):  # else the number goes on
            yield j


def candidates(line: str, units: list[tuple[int, int]], fixed: list[tuple[int, int]]) -> list[tuple[int, int, list[str]]]:
    """Segments (first, last unit, features) that overlap no fixed span, by first and last unit."""
    taken = np.zeros(len(line) + 1, np.int64)
    for a, b in fixed:
        taken[a:b] = 1
    covered = np.append(0, np.cumsum(taken))
    starts, lasts = {a: k for k, (a, _) in enumerate(units)}, {b: k for k, (_, b) in enumerate(units)}
    places: set[tuple[int, int]] = set()
    for i, (a, b) in enumerate(units):
        first = line[a]
        if covered[b] > covered[a]:
            continue
        if first.isdigit() and a > 1 and line[a - 1] in "-./:" and line[a - 2].isalnum():
            continue  # inside a tight run: the number began before
        if first.isdigit() or (first in "+(" and i + 1 < len(units) and line[units[i + 1][0]].isdigit()) or (first.isalnum() and line[b : b + 1] == ":"):
            places.update((i, j) for j in reaches(line, units, i, covered))
        if b - a >= 16 and first.isalnum():
            places.add((i, i))
    if AT.search(line):
        for m in WRITTEN.finditer(line):
            labels = [u.end() for u in UNIT.finditer(line, m.start("domain"), m.end()) if u.group().isalpha() and u.group().lower() != "dot"]
            places.update((starts[m.start()], lasts[b]) for b in {*labels[1 : ENDS + 1], m.end()})
    found = []
    for i, j in sorted(places):
        if covered[units[i][0]] == covered[units[j][1]] and (names := features(line, units, i, j)) is not None:
            found.append((i, j, names))
    return found


class Field:
    """Weights of (type, feature); a unit outside any segment scores 0."""

    def __init__(self, weights: dict[tuple[str, str], float] | None = None):
        self.weights = weights or {}

    def scores(self, names: list[str]) -> list[float]:
        get = self.weights.get
        return [get((kind, "bias"), -1.0) + sum(get((kind, n), 0.0) for n in names) for kind in ADDED]

    def best(self, n: int, segments: list[tuple[int, int, list[str]]]) -> list[tuple[str, int, int]]:
        """The best segmentation of n units: types with first and last units."""
        ending: dict[int, list[tuple[int, int, float]]] = {}
        for i, j, names in segments:
            scores = self.scores(names)
            k = int(np.argmax(scores))
            if scores[k] > 0:
                ending.setdefault(j, []).append((i, k, scores[k]))
        if not ending:
            return []
        value, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(n):
            value[j + 1] = value[j]
            for i, k, s in ending.get(j, ()):
                if value[i] + s > value[j + 1]:
                    value[j + 1], back[j + 1] = value[i] + s, (i, k)
        chosen, at = [], n
        while at:
            if back[at] is None:
                at -= 1
            else:
                i, k = back[at]
                chosen.append((ADDED[k], i, at - 1))
                at = i
        return chosen[::-1]

    def expectations(self, n: int, segments: list[tuple[int, int, list[str]]]) -> Iterator[tuple[int, int, list[str], list[float]]]:
        """Each segment's probability for each type, over all segmentations."""
        by_end: dict[int, list[int]] = {}
        by_start: dict[int, list[int]] = {}
        weight = []
        for at, (i, j, names) in enumerate(segments):
            weight.append([math.exp(min(s, 30)) for s in self.scores(names)])
            by_end.setdefault(j, []).append(at)
            by_start.setdefault(i, []).append(at)
        ahead, behind = [1.0] * (n + 1), [1.0] * (n + 1)
        for j in range(n):
            ahead[j + 1] = ahead[j] + sum(ahead[segments[s][0]] * sum(weight[s]) for s in by_end.get(j, ()))
        for i in range(n - 1, -1, -1):
            behind[i] = behind[i + 1] + sum(behind[segments[s][1] + 1] * sum(weight[s]) for s in by_start.get(i, ()))
        for s, (i, j, names) in enumerate(segments):
            yield i, j, names, [ahead[i] * w * behind[j + 1] / ahead[n] for w in weight[s]]

    @classmethod
    def train(cls, lines: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 14, rate: float = 0.4, strength: float = 2e-4) -> Field:
        """Maximum likelihood by gradient steps, line by line. lines: (text, spans as (type, start, end))."""
        field = cls()
        ready = []
        for text, spans in lines:
            units = [m.span() for m in UNIT.finditer(text)]
            gold = {(a, b): kind for kind, a, b in spans}
            segments = candidates(text, units, [])
            ready.append((len(units), segments, [gold.get((units[i][0], units[j][1])) for i, j, _ in segments]))
        for epoch in range(epochs):
            step = rate / (1 + 0.3 * epoch)
            for n, segments, gold in ready:
                slope: dict[tuple[str, str], float] = {}
                for (_, _, names, p), own in zip(field.expectations(n, segments), gold, strict=True):
                    for kind, q in zip(ADDED, p, strict=True):
                        d = (kind == own) - q
                        if abs(d) > 1e-4:
                            for name in ("bias", *names):
                                slope[kind, name] = slope.get((kind, name), 0.0) + d
                for key, d in slope.items():
                    field.weights[key] = field.weights.get(key, -1.0 if key[1] == "bias" else 0.0) * (1 - step * strength) + step * max(-1.0, min(1.0, d))
        return field


# ---------------------------------------------------------------------------------------------- training lines


def made_lines(n: int, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Lines with spans in many notations and with look-alikes that are none."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))

    def card() -> str:
        body = rng.choice("3456") + digits(14)
        full = next(body + d for d in "0123456789" if luhn(body + d))
        return rng.choice(["{} {} {} {}", "{}-{}-{}-{}", "{}{}{}{}", "{}.{}.{}.{}", "{}/{}/{}/{}"]).format(full[:4], full[4:8], full[8:12], full[12:])

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"0{digits(3)} {digits(7)}", f"0{digits(2)}/{digits(8)}", f"00{digits(2)} {digits(3)} {digits(6)}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"+ {digits(2)} {digits(3)} {digits(6)}"])

    def mail() -> str:
        at = rng.choice([" at ", " (at) ", "(at)", "[at]", " [at] ", " AT ", " @ "])
        dot = rng.choice([" dot ", ".", " DOT "]) if at.strip() != "@" else rng.choice([" . ", "."])
        return f"{word()}{rng.choice(['', '.' + word(), digits(2)])}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io'])}"

    def secret() -> str:
        k = rng.choice([16, 20, 24, 32, 40, 48, 64])
        letters = rng.choice(["0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"])
        return "".join(rng.choice(letters) for _ in range(k - 2)) + "a7"

    def wrong(body: str) -> str:
        """The digits with a checksum that fails."""
        return body if not luhn(body) else body[:-1] + str((int(body[-1]) + 1) % 10)

    ip = lambda: ":".join("".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([4, 6, 8])))
    makers = {"email_like": mail, "ip_like": ip, "card_like": card, "phone_like": phone, "secret": secret}
    none = [
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
        lambda: f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/{rng.randint(1900, 2030)}",
        lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12):02d}.{rng.randint(1900, 2030)} {rng.randint(0, 23)}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}",
        lambda: digits(rng.randint(1, 15)),
        lambda: f"{rng.randint(1, 999)}.{digits(3)}.{digits(3)}",
        lambda: f"{rng.randint(1, 99)} {digits(3)} {digits(3)} {digits(3)}",
        lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 300)}.{rng.randint(256, 9999)}",
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1990, 2030)}",
        lambda: f"{digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
        lambda: f"{digits(4)} {digits(4)} {digits(4)} {digits(3)}",
        lambda: wrong(digits(rng.choice([16, 16, 16, 17, 18, 19]))),
        lambda: wrong(digits(16)),
        lambda: "{}{}{}{}{s}{}{}{}{}{s}{}{}{}{}{s}{}{}{}{}".format(*wrong(digits(16)), s=rng.choice(" -")),
        lambda: f"{word()} at. {word().title()}. {word().title()}",
        lambda: f"{word()} at {word()} {word()}. {word().title()}",
        lambda: f"{digits(5)}-{digits(4)}",
        lambda: word() + digits(4),
        lambda: " ".join(digits(rng.randint(1, 5)) for _ in range(rng.randint(2, 6))),
        lambda: "".join(word() for _ in range(8)),
    ]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(1, 5))) + " "
            if rng.random() < 0.55:
                kind = rng.choice(list(makers))
                if rng.random() < 0.5:
                    text += rng.choice(sorted(CUES[kind])) + rng.choice([" ", ": ", " = ", ' = "', " is "])
                found = makers[kind]()
                spans.append((kind, len(text), len(text) + len(found)))
                text += found + rng.choice([" ", ". ", ", ", '" '])
            else:
                text += rng.choice(none)() + rng.choice([" ", ". ", ", ", "%%% "])
        out.append((text, spans))
    return out


@functools.cache
def trained(n: int = 900, seed: int = 5) -> Field:
    return Field.train(made_lines(n, seed))


# ---------------------------------------------------------------------------------------------- documents


def find(text: str, field: Field) -> list[tuple[str, int, int]]:
    """All spans of a text (type, start, end in code points), by type and then place; base ones first."""
    found = []
    for at, line in suspicious_lines(text):
        own = base_spans(line)
        found += [(kind, at + a, at + b) for kind, a, b in own]
        units = [m.span() for m in UNIT.finditer(line)]
        segments = candidates(line, units, [(a, b) for _, a, b in own])
        found += [(kind, at + units[i][0], at + units[j][1]) for kind, i, j in field.best(len(units), segments)]
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or each stretch of overlapping spans, replaced by the type of its first."""
    out, at = [], 0
    stretches: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if stretches and a < stretches[-1][2]:
            stretches[-1][2] = max(stretches[-1][2], b)
        else:
            stretches.append([kind, a, b])
    for kind, a, b in stretches:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def find_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of docs, repeated ones too.

    Null text is empty: no spans. The counts are of the base types. No rows give no rows; other columns are left out, whatever their names.
    """
    bound_batches(docs.sparkSession)
    weights = trained().weights
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([slim.schema["doc_id"], *(T.StructField(f"n_{k}", T.LongType()) for k in BASE), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(weights)
        for batch in batches:
            spans = [find(t.as_py(), field) for t in batch.column(1)]
            counts = [pa.array([sum(kind == k for kind, _, _ in s) for s in spans], pa.int64()) for k in BASE]
            digests = [hashlib.sha256(joined([x for x in s if x[0] in BASE]).encode()).hexdigest() for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([joined(s) for s in spans], pa.string())], names=schema.names)

    return slim.mapInArrow(found, schema)


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in the text replaced by its type; null text stays null, other columns as they are."""
    bound_batches(docs.sparkSession)
    weights = trained().weights
    names = docs.columns
    at = names.index(text)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(weights)
        for batch in batches:
            texts = [None if t is None else masked(t, find(t, field)) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(made, docs.schema)
