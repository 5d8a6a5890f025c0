"""Personal data by offset-preserving deobfuscation.

Identifiers are first found in the text as it stands. Then transducers rewrite it: homoglyphs to the
letters and digits they look like, spelled digits to digits, at/dot disguises to ``@`` and ``.``.
Each rewritten character keeps the source span it stands for, so what the same detectors find in the
rewritten text is mapped back to the source. A mapped span is added unless it touches one already
found of its kind.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import with_judgement

KINDS = ("email", "ip", "card", "phone")

# A run of local characters is entered only at an @ and walked back, and runs of digits only at their
# start, so that long runs without a match cost one pass.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = HOST.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(end, at + 1))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans [start, end) by kind, leftmost and non-overlapping; matches that fail a check are dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if not DIGIT.search(text):
        return out
    out["ip"] = [m.span() for m in IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g[-4:]) <= 255 for g in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


# Letters that look like Latin ones, of other scripts and with or without a dot.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝмткнвАВЕКМНОРСТХІЈЅαορνικτΑΒΕΖΗΙΚΜΝΟΡΤΥΧıİ", "aeopcyxijshdqwmtkhbABEKMHOPCTXIJSaopviktABEZHIKMNOPTYXiI"))
DIGITS = dict(zip("zero one two three four five six seven eight nine".split(), "0123456789"))
UNSEEN = frozenset("­​‌‍⁠﻿")
class Rewritten:
    """Text whose character i stands for source characters [start[i], end[i])."""

    def __init__(self, text: str, start: list[int], end: list[int]):
        self.text, self.start, self.end = text, start, end

    @classmethod
    def of(cls, source: str) -> Rewritten:
        return cls(source, list(range(len(source))), list(range(1, len(source) + 1)))

    def replace(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Ordered, disjoint edits (from, to, new text). New characters stand for all that they replace."""
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += (self.text[at:a], new)
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        return Rewritten("".join((*text, self.text[at:])), start + self.start[at:], end + self.end[at:])

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


def plain_char(c: str) -> str:
    """What a strange character looks like; nothing if it can't be seen."""
    if c in UNSEEN:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if "‐" <= c <= "―":
        return "-"
    if c in "․。﹒":
        return "."
    like = unicodedata.normalize("NFKC", c)
    if len(like) == 1 and like.isascii():
        return like
    return str(unicodedata.digit(c, c))


def _ranges(codes: list[int]) -> str:
    """The codes as the inside of a regular expression's character class."""
    out: list[list[int]] = []
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


#: Codes beyond ASCII that stand for an ASCII character or can't be seen; é, ß and the like stay as they are.
STRANGE = re.compile(f"[{_ranges([i for i in range(128, sys.maxunicode + 1) if plain_char(chr(i)).isascii()])}]")


def homoglyphs(r: Rewritten) -> Rewritten:
    return r.replace([(m.start(), m.end(), plain_char(m[0])) for m in STRANGE.finditer(r.text)])


_WORD = "|".join(DIGITS)
SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:{_WORD}|[0-9])(?:[ -](?:{_WORD}|[0-9])(?![A-Za-z0-9]))+", re.I)
ONE = re.compile(rf"{_WORD}", re.I)
PLUS = re.compile(r"(?<![A-Za-z0-9])plus (?=[0-9])", re.I)
DOT_NUMBER = re.compile(r"(?<=[0-9]) (?:dot|point) (?=[0-9])", re.I)


def spelled_digits(r: Rewritten) -> Rewritten:
    """Runs of spelled digits, alone or with figures between, become figures side by side."""
    edits = []
    for m in SPELLED.finditer(r.text):
        if len(ONE.findall(m[0])) >= 2:
            parts = re.finditer(rf"({_WORD})|[ -]", m[0], re.I)
            edits += [(m.start() + p.start(), m.start() + p.end(), DIGITS[p[0].lower()] if p[1] else "") for p in parts]
    r = r.replace(edits)
    for pattern, new in ((DOT_NUMBER, "."), (PLUS, "+")):
        r = r.replace([(*m.span(), new) for m in pattern.finditer(r.text)])
    return r


OPEN, CLOSE = r"[\[({<]", r"[\])}>]"
AT = re.compile(rf" ?{OPEN} ?(?:at|@) ?{CLOSE} ?", re.I)
DOT = re.compile(rf" ?{OPEN} ?(?:dot|\.) ?{CLOSE} ?", re.I)
SAID = re.compile(r"(?<=[A-Za-z0-9])( at |@| @ )([A-Za-z0-9-]+)((?: dot [A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+)(?![A-Za-z0-9])", re.I)
SAID_DOT = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]+(?: dot [A-Za-z0-9._-]+)+(?=@)", re.I)


def at_dot(r: Rewritten) -> Rewritten:
    for pattern, new in ((DOT, "."), (AT, "@")):
        r = r.replace([(*m.span(), new) for m in pattern.finditer(r.text)])
    edits = []
    for m in SAID.finditer(r.text):
        if m[1] != "@" or " dot " in m[3].lower():
            dots = [(m.start(3) + d.start(), m.start(3) + d.end(), ".") for d in re.finditer(" dot ", m[3], re.I)]
            if dots or m[1] == " @ ":  # " at " alone is ordinary prose
                edits += [(*m.span(1), "@"), *dots]
    r = r.replace(edits)
    return r.replace([(m.start() + d.start(), m.start() + d.end(), ".") for m in SAID_DOT.finditer(r.text) for d in re.finditer(" dot ", m[0], re.I)])


#: What each transducer needs, in a text without strange characters: one without any of these holds no disguise.
HINT = re.compile(rf"{OPEN} ?(?:at|dot|[@.]) ?{CLOSE}|(?<![A-Za-z0-9])dot(?![A-Za-z0-9])| @ |(?<![A-Za-z0-9])(?:{_WORD})[ -](?:{_WORD}|[0-9])(?![A-Za-z0-9])|(?<![A-Za-z0-9])plus (?:{_WORD}|[0-9])|[0-9] (?:dot|point) [0-9]", re.I)


def rewrite(text: str) -> Rewritten | None:
    """None if no transducer has anything to do."""
    strange = not text.isascii() and STRANGE.search(text)
    if not strange and not HINT.search(text):
        return None
    r = Rewritten.of(text)
    return at_dot(spelled_digits(homoglyphs(r) if strange else r))


def _merged(base: list[tuple[int, int]], more: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``base`` and those of ``more`` that overlap none before them; both lists are sorted, and ``base`` is disjoint."""
    out, last, k = list(base), -1, 0
    for start, end in more:
        while k < len(base) and base[k][1] <= start:
            k += 1
        if start >= last and (k == len(base) or end <= base[k][0]):
            out.append((start, end))
            last = end
    return out


def find(text: str | None) -> dict:
    """``base`` and ``spans``: lists of (kind, start, end) in code points of ``text``."""
    text = text or ""
    base = detect(text)
    spans = {k: list(v) for k, v in base.items()}
    if r := rewrite(text):
        for kind, found in detect(r.text).items():
            spans[kind] = _merged(base[kind], [r.span(a, b) for a, b in found])
    return {name: [{"kind": k, "start": a, "end": b} for k in KINDS for a, b in sorted(s[k])] for name, s in (("base", base), ("spans", spans))}


def _written(spans: list[dict]) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


_SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def find_pii(df: DataFrame, text_col: str = "text", columns: list[str] | None = None) -> tuple[DataFrame, str]:
    """``columns`` of ``df`` (default: all) and a struct column, whose name is the second result: base and
    spans, arrays of (kind, start, end) by kind in the order email, ip, card, phone, then start, and
    base_sha256, of the base spans written ``kind:start:end`` and comma-joined.

    Null and empty texts have no spans; whole texts are searched, however long; repeated rows are judged
    alike, and an empty table gives an empty result. Spans of one kind never overlap; an email and a
    number inside it may.
    """

    def judge(texts: list[str | None]) -> list[dict]:
        return [f | {"base_sha256": hashlib.sha256(_written(f["base"]).encode()).hexdigest()} for f in map(find, texts)]

    return with_judgement(df, text_col, f"struct<base:{_SPAN},spans:{_SPAN},base_sha256:string>", judge, columns, "pii")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with each found span replaced by ``[kind]``; of overlapping spans, their union by the first one's kind."""
    def judge(texts: list[str | None]) -> list[str | None]:
        return [None if t is None else _redacted(t, find(t)["spans"]) for t in texts]

    out, name = with_judgement(df, text_col, "string", judge, name="redacted")
    return out.select(*(F.col(name).alias(c) if c == text_col else F.col(c) for c in df.columns))


def _redacted(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += (text[at : s["start"]], f"[{s['kind']}]")
        at = max(at, s["end"])
    return "".join((*out, text[at:]))
