"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lakescribe.llm.common import code_points, per_text, sha256, span_digest

#: Kinds in the order of their spans; the first four are the base kinds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

#: Words that speak for a kind when they stand up to CONTEXT_BYTES in front of a span.
CONTEXT = {
    "email": (b"mail", b"contact", b"write", b"kontakt", b"correo", b"courriel"),
    "ip": (b"ip", b"host", b"server", b"address", b"login"),
    "card": (b"card", b"visa", b"credit", b"karte", b"carte", b"tarjeta"),
    "phone": (b"phone", b"call", b"tel", b"mobile", b"fax", b"anruf", b"appel"),
    "iban": (b"iban", b"bank", b"account", b"konto", b"compte", b"cuenta"),
    "ssn": (b"ssn", b"social", b"security", b"insurance"),
}
CONTEXT_BYTES = 48
#: Score of a span that its pattern and checks have confirmed, and what a context word adds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT_BONUS = 0.3
#: Added kinds below this score are dropped; base kinds stay at any score.
MIN_SCORE = 0.5

_DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can begin inside a run of digits only where the run's start matches too: so look at starts alone.
_IP = re.compile(rb"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(rb"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_WORD_END = re.compile(rb"(?<=[A-Z0-9])(?![A-Za-z0-9])")
_SSN = re.compile(rb"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NO_DIGITS = bytes(set(range(256)) - set(b"0123456789"))
_DOUBLED = tuple(sum(divmod(2 * d, 10)) for d in range(10))


def luhn(digits: bytes) -> bool:
    """Checksum of card numbers, over ASCII digits."""
    values = [x - 48 for x in digits[::-1]]
    return (sum(values[::2]) + sum(_DOUBLED[x] for x in values[1::2])) % 10 == 0


def mod97(account: bytes) -> bool:
    """Checksum of international account numbers, without spaces."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(chr(c), 36)) for c in moved)) % 97 == 1


def _emails(text: bytes) -> Iterator[tuple[int, int]]:
    free = 0  # a local part may not reach into the last match
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            free = m.end()
            yield start, free


def _ips(text: bytes) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip(b"0")) <= 3 and int(p or b"0") <= 255 for x in m[0].split(b".")):
            yield m.span()


def _cards(text: bytes) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].translate(None, _NO_DIGITS)
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: bytes) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(m[0].translate(None, _NO_DIGITS)) <= 15:
            yield m.span()


def _ibans(text: bytes) -> Iterator[tuple[int, int]]:
    """The longest part of a candidate that ends where a word ends and has the checksum: what follows an account may look like it."""
    at = 0
    while m := _IBAN.search(text, at):
        at = m.start() + 4  # another account may begin where this one is none
        for end in sorted((x.start() for x in _WORD_END.finditer(text, m.start(), m.end() + 1) if x.start() <= m.end()), reverse=True):
            account = text[m.start() : end].replace(b" ", b"")
            if len(account) < 15:
                break
            if mod97(account):
                yield m.start(), end
                at = end
                break


def _ssns(text: bytes) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split(b"-")
        if area not in (b"000", b"666") and area < b"900" and group != b"00" and serial != b"0000":
            yield m.span()


#: What a kind's pattern cannot do without.
_FINDERS = ((b"@", _emails), (b".", _ips), (b"", _cards), (b"+", _phones), (b"", _ibans), (b"-", _ssns))
_DIGIT = re.compile(rb"[0-9]")


def find(text: bytes) -> list[tuple[str, int, int, float]]:
    """(kind, start byte, end byte, score) by start, then kind."""
    found, digits = [], _DIGIT.search(text) is not None
    for order, (kind, (needs, finder)) in enumerate(zip(KINDS, _FINDERS, strict=True)):
        if needs in text and (digits or kind == "email"):
            for s, e in finder(text):
                near = text[max(0, s - CONTEXT_BYTES) : s].lower()
                score = min(1.0, PRIOR[kind] + CONTEXT_BONUS * any(w in near for w in CONTEXT[kind]))
                if kind in BASE or score >= MIN_SCORE:
                    found.append((s, order, e, score))
    return [(KINDS[k], s, e, score) for s, k, e, score in sorted(found)]


_SCHEMA = T.StructType([
    *[T.StructField(f"n_{k}", T.LongType()) for k in BASE],
    T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
    T.StructField("max_score", T.DoubleType()),
])


def _worker():
    def work(texts):
        rows = []
        for text in texts:
            spans = find(text)
            at = code_points(text, [x for _, s, e, _ in spans for x in (s, e)])
            named = [(k, at[s], at[e]) for k, s, e, _ in spans]
            base = [x for x in named if x[0] in BASE]
            counts = [sum(x[0] == k for x in base) for k in BASE]
            rows.append((*counts, sha256(span_digest(base)), span_digest(named), max((x[3] for x in spans), default=0.0)))
        return list(zip(*rows, strict=True))

    return work


def find_personal_data(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Spans of personal data in every whole text.

    Returns the kept columns, n_email, n_ip, n_card, n_phone, base_sha256 (digest of the spans of these
    kinds), spans (all kinds; code points, end exclusive) and max_score (0 without spans). Null and empty
    texts have no spans; rows are independent, so repeated rows give equal results; other columns are ignored.
    """
    return per_text(docs, _worker, _SCHEMA, keep)
