"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust their score.

Every kind has a pattern and a prior. A proposal of a kind with a checksum (Luhn for cards, mod 97 for bank accounts)
needs it to hold. Words of the kind's context within NEAR characters before the span, or directly after it, raise the
score by LIFT; words that speak against it lower it. Spans of the four base kinds are always reported; those of the
added kinds from LEAST on, where no reported span covers a part of them.

All scans are linear in the text, whatever it holds: an address is found from its @ sign backwards, digit runs are
consumed once, and other patterns have bounded or possessive repetitions.

Defined results: null texts are empty and have no spans; rows without doc_id and repeated rows are judged like all others; an empty
table gives an empty result; columns other than doc_id and text are not read. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEAR, LIFT, LEAST = 40, 0.35, 0.6


@dataclass(frozen=True)
class Kind:
    """Prior score, and words around a span that speak for and against it."""

    prior: float
    context: str
    against: str = ""
    base: bool = False


KINDS = {
    "email": Kind(0.9, "mail|email|e-mail|correo|courriel|contact|kontakt|contacto|write|reply", base=True),
    "ip": Kind(0.6, "ip|host|server|address|adresse|dirección|client|login|connect", "version|release|section|kapitel|chapter|build|v", base=True),
    "card": Kind(0.8, "card|visa|mastercard|amex|credit|debit|carte|karte|tarjeta|kreditkarte|payment", "order|serial|tracking|isbn|item", base=True),
    "phone": Kind(0.8, "phone|call|tel|mobile|fax|telefon|téléphone|teléfono|handy|anruf|appeler|llamar|whatsapp", base=True),
    "iban": Kind(0.9, "iban|account|konto|compte|cuenta|bank|banque|banco|transfer"),
    "national_id": Kind(0.35, "ssn|social security|national id|tax id|steuernummer|dni|numéro de sécurité", "part|model|serial|order|isbn"),
    "local_phone": Kind(0.3, "phone|call|tel|mobile|fax|telefon|téléphone|teléfono|handy|anruf|appeler|llamar|whatsapp", "order|serial|tracking|isbn|item|page"),
    "secret": Kind(0.35, "token|secret|password|passwd|api key|api_key|apikey|access key|private key|bearer|passwort|contraseña|mot de passe", "sha1|sha256|md5|commit|checksum|digest"),
}
ORDER = {kind: i for i, kind in enumerate(KINDS)}
_FOR = {k: re.compile(rf"\b(?:{v.context})\b", re.I) for k, v in KINDS.items()}
_AGAINST = {k: re.compile(rf"\b(?:{v.against})\b", re.I) for k, v in KINDS.items() if v.against}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9.+])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])[0-9]{3,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,128}={0,2}(?![A-Za-z0-9_+/=-])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Country and check digits moved to the end, letters as numbers from 10 on: the remainder must be 1."""
    bare = account.replace(" ", "")
    return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        if m.group(1) and all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PLUS.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def _local_phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _LOCAL_PHONE.finditer(text):
        if 7 <= sum(c.isdigit() for c in m.group()) <= 12:
            yield m.span()


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    for m in _SECRET.finditer(text):
        said = m.group()
        if any(c.isdigit() for c in said) and any(c.isalpha() for c in said) and len(set(said)) >= 8:
            yield m.span()


_FINDERS = {
    "email": emails, "ip": _ips, "card": _cards, "phone": _phones,
    "iban": lambda t: (m.span() for m in _IBAN.finditer(t) if mod97(m.group())),
    "national_id": lambda t: (m.span() for m in _NATIONAL.finditer(t) if m.group()[:3] not in ("000", "666") and m.group()[0] != "9"),
    "local_phone": _local_phones, "secret": _secrets,
}


def score(text: str, kind: str, start: int, end: int) -> float:
    before, after = text[max(0, start - NEAR):start], text[end:end + NEAR // 2]
    value = KINDS[kind].prior
    if _FOR[kind].search(before) or _FOR[kind].search(after):
        value += LIFT
    if kind in _AGAINST and _AGAINST[kind].search(before):
        value -= LIFT
    return round(min(1.0, max(0.0, value)), 4)


def spans_of(text: str) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) by kind and start."""
    base, added = [], []
    digits = any(d in text for d in "0123456789")
    for kind, find in _FINDERS.items():
        if kind != "email" and not digits:
            continue
        for start, end in find(text):
            (base if KINDS[kind].base else added).append((kind, start, end, score(text, kind, start, end), KINDS[kind].base))
    kept = list(base)
    if added:
        # best first; a span that overlaps a kept one goes
        merged: list[tuple[int, int]] = []
        for s, e in sorted((b[1], b[2]) for b in base):
            if merged and s <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        for span in sorted(added, key=lambda a: (-a[3], a[1], ORDER[a[0]])):
            i = bisect.bisect_right(merged, (span[1], len(text) + 1))
            clear = (i == 0 or merged[i - 1][1] <= span[1]) and (i == len(merged) or merged[i][0] >= span[2])
            if span[3] >= LEAST and clear:
                merged.insert(i, (span[1], span[2]))
                kept.append(span)
    return sorted(kept, key=lambda s: (ORDER[s[0]], s[1]))


def masked(text: str, spans: list[tuple]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans by the first one's."""
    out, at = [], 0
    for kind, start, end, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind string, start long, end long, score double, base boolean>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))


def find_pii(docs: DataFrame, mask: bool = False) -> DataFrame:
    """doc_id, spans; with `mask` also masked_text."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            spans = [spans_of(t) if (t := x.as_py()) else [] for x in texts]
            found = pa.array([[dict(zip(("kind", "start", "end", "score", "base"), s, strict=True)) for s in one] for one in spans], _TYPE)
            columns = [batch.column(0), found]
            if mask:
                columns.append(pa.array([masked(x.as_py() or "", s) for x, s in zip(texts, spans, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spans", "masked_text"][:len(columns)])

    schema = f"doc_id long, spans {SPANS}" + (", masked_text string" if mask else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
