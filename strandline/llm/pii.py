"""Personal data in text: plain matches, and those behind disguises.

A disguised text is rewritten by transducers, piece by piece: look-alike
characters, letters spaced out, spelled digits, written-out "at" and "dot".
Every piece remembers which source characters it came from, so a match in the
rewritten text gives a span of the source. All steps take time in proportion to
the text, whatever is in it.

Defined results: a null text is an empty one and has no spans. Plain spans of
one kind never overlap; those of different kinds may. A plain match stays as it
is; a disguised one is added unless it lies within a plain one of its kind, so
it may hold a plain one, as where a look-alike stands within an address.
Positions count code points. Rows and other columns are kept as they are,
repeated rows too; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, place in KINDS, end

#: What stands around the "@" of an email; the local part is looked for backwards from it.
LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# No match can begin inside a run of digits unless one began at its start.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        free = found.end() if found else at + 1
        if found:
            yield start, free
        at = text.find("@", free)


def plain_spans(text: str) -> list[Span]:
    """The matches in the text as it is, leftmost and not overlapping within a kind."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            for m in IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                    found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


# Letters that look like ASCII ones, and marks that do.
LOOK_ALIKES = dict(zip("АВЕЅІЈКМНОРСТХУаеѕіјорсхуһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορ", "ABESIJKMHOPCTXYaesijopcxyhdqwABEZHIKMNOPTYXavop", strict=True))
LOOK_ALIKES |= {"。": ".", "٫": ".", "‐": "-", "‒": "-", "–": "-", "−": "-"}
# The words for 0 to 9.
SPELLED = {
    "en": "zero one two three four five six seven eight nine",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
DIGIT_OF = {word: str(i) for words in SPELLED.values() for i, word in enumerate(words.split())}
# How "at", "dot" and "plus" are written out.
AT = frozenset({"at", "arroba", "chez", "ät"})
DOT = frozenset({"dot", "punto", "punkt", "point"})
PLUS = frozenset({"plus", "más"})
# Ends of domains that words without brackets are believed with.
TOP_LEVEL = frozenset(
    "com org net edu gov mil int info biz io dev app co ai me tv xyz online site shop cloud test example invalid "
    "ar at au be bg br ca ch cl cn co cz de dk ee es eu fi fr gr hk hr hu id ie il in ir is it jp kr lt lu lv ma mx my "
    "nl no nz pe ph pk pl pt ro rs ru sa se sg si sk th tr tw ua uk us uy ve vn za".split()
)
#: A place that is spoken of like this is none of the internet.
NO_HOST = frozenset({"the", "a", "an", "this", "that", "each", "every", "one", "its", "his", "her", "my", "your", "our", "their"})


class _AsciiOf(dict):
    """What a character beyond ASCII stands for: a look-alike, a digit of its script, its compatibility form, or nothing for marks without width."""

    def __missing__(self, c: str) -> str:
        found = LOOK_ALIKES.get(c)
        if found is None and unicodedata.category(c) == "Cf":
            found = ""
        if found is None and (digit := unicodedata.decimal(c, None)) is not None:
            found = str(digit)
        if found is None:
            plain = unicodedata.normalize("NFKC", c)
            plain = "".join(LOOK_ALIKES.get(x, x) for x in plain)
            found = plain if plain.isascii() and plain.strip() or c.isspace() and plain == " " else c
        self[c] = found
        return found


_ASCII_OF = _AsciiOf()

_DIGITS = "|".join(sorted(DIGIT_OF, key=len, reverse=True))
#: What numbers are spelled with, each by itself.
UNIT = re.compile(rf"(?i)(?<![^\W_])(?:{_DIGITS}|{'|'.join(sorted(PLUS))}|{'|'.join(sorted(DOT))}|[0-9]+(?:\.[0-9]+)*)(?![^\W_])")
BETWEEN_UNITS = re.compile(r"[ \t,-]{1,2}\Z")
#: A spelled digit and another unit after it, or a "dot" between digits: without them no number is spelled.
SPELLED_TWO = re.compile(rf"(?i)(?:\A|[\s,-])(?:{_DIGITS})[ \t,-]{{1,2}}(?:{_DIGITS}|{'|'.join(sorted(DOT))}|[0-9])|[0-9] (?:{'|'.join(sorted(DOT))}) ")
_MARK = rf"(?:(?P<at>{'|'.join(sorted(AT))}|@)|(?P<dot>{'|'.join(sorted(DOT))}|\.))"
BRACKETED = re.compile(rf"(?i)[(\[{{<]\s*{_MARK}\s*[)\]}}>]")
#: Single characters with a space between, which an "@" must be among.
SPACED = re.compile(r"(?<!\S)(?:[A-Za-z0-9@._+-] ){5,}[A-Za-z0-9](?!\S)")
TOKEN = re.compile(r"\S+")
NAME_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LABEL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
#: Words or marks that "at" and "dot" of a whole address are written as.
WRITTEN_OUT = re.compile(rf"(?i)\s(?:{'|'.join(sorted(DOT))}|\.)\s")


class Rewritten:
    """A text made of pieces, each of which knows its place in the text it came from."""

    def __init__(self, source: str):
        self.text = source
        #: Where pieces begin, and of each the source's start and end, whether it is as long there, and whether it is other text.
        self.starts, self.origin = [0], [(0, len(source), True, False)]

    def rewrite(self, pieces: list[tuple[int, int, str]]) -> None:
        """Put other text for spans of the present text; spans ascend and don't overlap."""
        parts, origin, at = [], [], 0
        for a, b, new in [*pieces, (len(self.text), len(self.text), "")]:
            if at < a:
                for k, lo, hi in self._runs(at, a):
                    parts.append(self.text[lo:hi])
                    origin.append((self.place(lo, False), self.place(hi, True), *self.origin[k][2:]))
            if a < b:
                parts.append(new)
                start, end = self.place(a, False), self.place(b, True)
                origin.append((start, end, len(new) == b - a == end - start, True))
            at = b
        self.text = "".join(parts)
        self.starts = [0, *accumulate(map(len, parts))][: len(parts)] or [0]
        self.origin = origin or [(0, 0, True, False)]

    def _runs(self, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """The span cut where pieces meet: the piece, and its part."""
        k = self._piece(a, False)
        while a < b:
            end = min(b, self.starts[k + 1] if k + 1 < len(self.starts) else b)
            if end > a:
                yield k, a, end
            a, k = end, k + 1

    def _piece(self, at: int, end: bool) -> int:
        return max(0, bisect_right(self.starts, at - 1 if end else at) - 1)

    def place(self, at: int, end: bool) -> int:
        """The source position of a start, or of an end, in the present text."""
        k = self._piece(at, end)
        a, b, same, _ = self.origin[k]
        if same:
            return a + at - self.starts[k]
        return b if end else a

    def changed(self, a: int, b: int) -> bool:
        return any(self.origin[k][3] for k in range(self._piece(a, False), self._piece(b, True) + 1))


Pieces = list[tuple[int, int, str]]


def _look_alikes(text: str) -> Pieces:
    other = {c: _ASCII_OF[c] for c in set(text) if c > "\x7f"}
    other = {c: x for c, x in other.items() if c != x}
    if not other:
        return []
    one = "".join(re.escape(c) for c, x in other.items() if len(x) == 1)
    rest = "".join(re.escape(c) for c, x in other.items() if len(x) != 1)
    either = "|".join([f"[{one}]+"] * bool(one) + [f"[{rest}]"] * bool(rest))
    # Neighbours that stay one character each are one piece.
    return [(m.start(), m.end(), "".join(map(other.__getitem__, m[0]))) for m in re.finditer(either, text)]


def _spaced(text: str) -> Pieces:
    return [(m.start(), m.end(), m[0].replace(" ", "")) for m in SPACED.finditer(text) if "@" in m[0]] if "@" in text else []


def _spelled(text: str) -> Pieces:
    """Runs of spelled digits, digits, "dot" and "plus", with at least two of them and one spelled."""
    found, run, spelled = [], [], False

    def done() -> None:
        if len(run) > 1 and spelled:
            words = [m[0].lower() for m in run]
            new = "".join("+" if w in PLUS else "." if w in DOT else DIGIT_OF.get(w, w) for w in words)
            found.append((run[0].start(), run[-1].end(), new))

    if not SPELLED_TWO.search(text):
        return found
    for m in UNIT.finditer(text):
        gap = m.start() - run[-1].end() if run else 0
        if run and not (gap <= 2 and BETWEEN_UNITS.match(text, run[-1].end(), m.start())):
            done()
            run, spelled = [], False
        run.append(m)
        spelled |= m[0][0] not in "0123456789"
    done()
    return found


def _bracketed(text: str) -> Pieces:
    found, free = [], 0
    for m in BRACKETED.finditer(text):
        a, b = m.span()
        # White space around belongs to the mark. Each run is looked at from one side only.
        while a > free and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        if a < b:
            found.append((max(a, free), b, "@" if m["at"] else "."))
            free = b
    return found


def _bare(text: str) -> Pieces:
    """Words or marks by themselves for "at" and "dot". They count together only, between names, with a usual end of a domain."""
    if not WRITTEN_OUT.search(text):
        return []
    tokens = list(TOKEN.finditer(text))
    words = [m[0].lower() if len(m[0]) < 8 else "" for m in tokens]
    is_at = [w in AT or w == "@" for w in words]
    is_dot = [w in DOT or w == "." for w in words]

    def whole(i: int, pattern: re.Pattern) -> bool:
        return 0 <= i < len(tokens) and not is_at[i] and not is_dot[i] and pattern.fullmatch(text, *tokens[i].span()) is not None

    found: dict[int, tuple[int, int, str]] = {}

    def mark(i: int, new: str) -> None:
        found[i] = (tokens[i - 1].end(), tokens[i + 1].start(), new)

    for i, token in enumerate(tokens):
        if is_at[i]:
            host = i + 1
            if not (0 < i < len(tokens) - 2 and NAME_END.search(text, max(token.start() - 70, tokens[i - 1].start()), tokens[i - 1].end())) or is_at[i - 1] or is_dot[i - 1]:
                continue
        elif "@" in token[0] and i + 2 < len(tokens) and is_dot[i + 1]:
            host = i  # the "at" is a sign, the "dot" a word
        else:
            continue
        if host == i + 1 and words[host] in NO_HOST:
            continue
        dots, last, at = [], None, host
        while at + 2 < len(tokens) and is_dot[at + 1] and (at == i == host or whole(at, LABEL)):
            label = LABEL.match(text, *tokens[at + 2].span())
            if not label or is_at[at + 2]:
                break
            dots.append(at + 1)
            if label[0].rsplit(".", 1)[-1].lower() in TOP_LEVEL:
                last = len(dots)
            at += 2
        if last is None:
            continue
        for k in dots[:last]:
            mark(k, ".")
        if host == i + 1:
            mark(i, "@")
            at = i - 1
            while at >= 2 and is_dot[at - 1] and whole(at, NAME_END) and NAME_END.search(text, max(tokens[at - 2].start(), tokens[at - 2].end() - 70), tokens[at - 2].end()):
                mark(at - 1, ".")
                at -= 2
    return [found[k] for k in sorted(found)]


TRANSDUCERS: tuple[Callable[[str], Pieces], ...] = (_look_alikes, _spaced, _spelled, _bracketed, _bare)


def spans_of(text: str | None) -> tuple[list[Span], list[Span]]:
    """The plain spans of a text, and all of them."""
    text = text or ""
    plain = plain_spans(text)
    new = Rewritten(text)
    for transducer in TRANSDUCERS:
        if transducer is _look_alikes and text.isascii():
            continue
        if pieces := transducer(new.text):
            new.rewrite(pieces)
    if not any(changed for *_, changed in new.origin):
        return plain, plain
    every = set(plain)
    ends: dict[int, list[tuple[int, int]]] = {k: [(a, b) for a, kind, b in plain if kind == k] for k in range(len(KINDS))}
    for a, kind, b in plain_spans(new.text):
        if new.changed(a, b):
            start, end = new.place(a, False), new.place(b, True)
            near = ends[kind]
            at = bisect_right(near, (start, len(text) + 1))
            if not (at and near[at - 1][1] >= end):
                every.add((start, kind, end))
    return plain, sorted(every)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


RESULT = "struct<n_email: long, n_ip: long, n_card: long, n_phone: long, base_sha256: string, spans: string>"


def detect(text: Column) -> Column:
    """A struct of the plain counts by kind, a digest of the plain spans, and all spans as ``kind:start:end``."""

    def udf(texts: pa.Array) -> pa.Array:
        columns: list[list] = [[] for _ in range(6)]
        for t in texts.to_pylist():
            plain, every = spans_of(t)
            for k in range(4):
                columns[k].append(sum(kind == k for _, kind, _ in plain))
            columns[4].append(hashlib.sha256(_joined(plain).encode()).hexdigest())
            columns[5].append(_joined(every))
        types = [pa.int64()] * 4 + [pa.string()] * 2
        names = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans"]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return F.arrow_udf(udf, RESULT)(text)


def redacted(text: str | None) -> str | None:
    """The text with ``[EMAIL]``, ``[IP]``, ``[CARD]`` or ``[PHONE]`` for each span; what overlaps goes as one, under the name of its longest."""
    every = spans_of(text)[1]
    if not every:
        return text
    groups: list[list[Span]] = []
    reach = -1
    for span in every:
        if span[0] >= reach:
            groups.append([])
        groups[-1].append(span)
        reach = max(reach, span[2])
    parts, at = [], 0
    for spans in groups:
        longest = max(spans, key=lambda x: (x[2] - x[0], -x[1]))
        parts += [text[at : spans[0][0]], f"[{KINDS[longest[1]].upper()}]"]
        at = max(end for *_, end in spans)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; ``n_chars``, where present, follows the new text."""

    def udf(texts: pa.Array) -> pa.Array:
        return pa.array([redacted(t) for t in texts.to_pylist()], pa.string())

    out = docs.withColumn("text", F.arrow_udf(udf, "string")(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind))
    return out.select(docs.columns)
