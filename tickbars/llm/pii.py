"""Personal data: regular expressions propose, checksums confirm, words nearby move the score.

Base kinds are decided by pattern and checksum alone and always stay. Further kinds need a score: an IBAN (mod 97)
and a US social security number start from a base score that words near the span raise or lower; a card number whose
check digit holds but whose length is outside the base range, and a local phone number, need such words.

Defined cases: a null text is empty; matches of one kind do not overlap, those of different base kinds may; every
pattern takes time in proportion to the text, also for a text of any length that is one run of letters or digits, and
whether a further span overlaps another is looked up by its place, however many there are.
Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickbars.llm.tools import map_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
_ORDER = {kind: i for i, kind in enumerate(KINDS)}

# Words that make a kind more or less likely; compared in lower case.
CONTEXT = {
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta", "kreditkarte"},
    "phone": {"phone", "tel", "telephone", "mobile", "call", "fax", "telefon", "téléphone", "teléfono", "handy"},
    "iban": {"iban", "account", "bank", "bic", "swift", "konto", "compte", "cuenta"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
}
AGAINST = {"isbn", "order", "invoice", "part", "serial", "version", "model", "sku", "tracking"}
NEAR_CHARS = 60
NEAR_BONUS = 0.35
NEAR_MALUS = 0.3
ACCEPT = 0.5
# What pattern and checksum alone are worth.
PRIOR = {"iban": 0.6, "ssn": 0.3, "card": 0.3, "phone": 0.2}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


# Domain parts of an address; the local part is found to the left of the sign.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
IBAN_LENGTHS = {
    country: int(n)
    for n, countries in (x.split(":") for x in (
        "15:NO", "16:BE", "18:DK FI FO GL NL", "19:MK SI", "20:AT BA EE KZ LT LU XK", "21:CH HR LI LV",
        "22:BG BH CR DE GB GE IE ME RS VA", "23:AE GI IL IQ TL", "24:AD CZ ES MD PK RO SA SE SK TN VG", "25:LY PT ST",
        "26:IS TR", "27:FR GR IT MC MR SM", "28:AL AZ BY CY DO GT HU LB PL SV", "29:BR EG PS QA UA", "30:JO KW MU", "31:MT SC",
        "32:LC",
    ))
    for country in countries.split()
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    """The check digit of card numbers."""
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        total += sum(divmod(2 * int(d), 10))
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check digits of an IBAN without spaces."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """As the leftmost matches of the pattern, without trying every start in a run of letters."""
    out, done = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            done = m.end()
    return out


def base_spans(text: str) -> list[Span]:
    """The spans of the four base kinds, each kind in order."""
    out = [Span("email", a, b, 1.0) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(Span("ip", m.start(), m.end(), 1.0))
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
            out.append(Span("card", m.start(), m.end(), 1.0))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_only_digits(m[0])) <= 15:
                out.append(Span("phone", m.start(), m.end(), 1.0))
    return out


def near_score(text: str, kind: str, start: int, end: int) -> float:
    """What the words within NEAR_CHARS of a span add to its score."""
    around = f"{text[max(0, start - NEAR_CHARS) : start]} | {text[end : end + NEAR_CHARS]}".lower()
    words = set(_WORD.findall(around))
    return NEAR_BONUS * bool(words & CONTEXT[kind]) - NEAR_MALUS * bool(words & AGAINST)


def _iban_length(found: str) -> int:
    """How much of a match of _IBAN is one: the length of its country, all of it, or up to a space; 0 if nothing is."""
    ends = [*(i for i, c in enumerate(found) if c == " "), len(found)]
    codes = [(end, found[:end].replace(" ", "")) for end in reversed(ends)]
    length = IBAN_LENGTHS.get(found[:2])
    # A country without a fixed length is tried from the longest end on.
    first = [x for x in codes if len(x[1]) == length]
    rest = codes[:1] if length else codes
    return next((end for end, code in first + rest if 15 <= len(code) <= 34 and mod97(code)), 0)


def _ibans(text: str) -> list[tuple[int, int]]:
    """Capitals and numbers that follow an IBAN or come before it take nothing from it."""
    out, pos = [], 0
    while m := _IBAN.search(text, pos):
        n = _iban_length(m[0])
        if n:
            out.append((m.start(), m.start() + n))
        pos = m.start() + (n or len(m[0].split(" ", 1)[0]))
    return out


def _proposed(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the further kinds, those of one kind in order and apart from each other."""
    out = {"iban": _ibans(text), "ssn": [], "card": [], "phone": []}
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            out["ssn"].append((m.start(), m.end()))
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 12 and len(d := _only_digits(m[0])) in (12, 13) and luhn(d):
            out["card"].append((m.start(), m.end()))
    out["phone"] = [(m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text)]
    return out


class _Taken:
    """Which part of a text spans cover."""

    def __init__(self, spans: list[Span]):
        placed = sorted((s.start, s.end) for s in spans)
        self.starts = [start for start, _ in placed]
        # How far the spans up to each one reach.
        self.reach = list(accumulate((end for _, end in placed), max))

    def overlaps(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.reach[before - 1] > start


def find_spans(text: str) -> list[Span]:
    """Base spans and further ones that pass, by start, then kind. A further one gives way to any found before it."""
    spans = base_spans(text)
    for kind, proposed in _proposed(text).items():
        if not proposed:
            continue
        taken = _Taken(spans)
        for start, end in proposed:
            if taken.overlaps(start, end):
                continue
            score = PRIOR[kind] + near_score(text, kind, start, end)
            if score >= ACCEPT:
                spans.append(Span(kind, start, end, round(score, 2)))
    return sorted(spans, key=lambda s: (s.start, _ORDER[s.kind], s.end))


def pii_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and `spans`: all personal data of the text, by start, then kind, as structs."""
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[s._asdict() for s in find_spans(t.as_py() or "")] for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(item))], names=[id_col, "spans"])

    id_type = df.schema[id_col].dataType.simpleString()
    plain = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return map_batches(plain, make, f"`{id_col}` {id_type}, spans array<struct<kind:string,start:int,end:int,score:double>>")


def masked(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The frame with every found span replaced by its kind in brackets; null stays null.

    Spans that overlap are replaced together by the kind of the first.
    """
    at = df.columns.index(text_col)

    def mask(text: str | None) -> str | None:
        if text is None:
            return None
        out, done = [], 0
        for s in find_spans(text):
            if s.start >= done:
                out += [text[done : s.start], f"[{s.kind.upper()}]"]
            done = max(done, s.end)
        return "".join([*out, text[done:]])

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = pa.array([mask(t.as_py()) for t in batch.column(at)], pa.string())
        columns = [new if i == at else c for i, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_batches(df, make, df.schema)


def pii_report(docs: DataFrame) -> DataFrame:
    """Per document the counts of the base kinds, the digest of base spans, and all spans as text."""
    spans = F.col("spans")
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    # What is in BASE_KINDS and has the full score was found by pattern and checksum alone.
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS) & (s["score"] == 1.0))
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    joined = lambda xs: F.array_join(F.transform(xs, shown), ",")
    return pii_spans(docs).select(
        "doc_id", *(count(k) for k in BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans")
    )
