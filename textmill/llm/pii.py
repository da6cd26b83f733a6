"""Operator 1, PII: patterns propose spans, checksums confirm them, and
context words nearby adjust their scores.

The base kinds (email, ip, card, phone) are always kept; the kinds added to
them (iban, ssn) need a score of at least ``MIN_SCORE``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with one start are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
MIN_SCORE, CONTEXT_CHARS = 0.5, 60

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: An address's part from its @; the part before is found from the @ leftwards.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: The look-behinds only skip starts inside a run of digits, which fail as their run does.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Two letters, two digits and what follows, with single spaces; its end is found by the checksum.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9])++")
#: Characters of an account number (ISO 13616), and of a written group.
IBAN_MIN, IBAN_MAX, IBAN_GROUP = 15, 34, 4
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
DIGIT = re.compile("[0-9]")
LETTERS = re.compile(r"[^\W\d_]+")

#: Scores without context, and what words nearby add (English, German, French, Spanish).
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": {0.1: "mail contact kontakt courriel contacter correo contacto"},
    "ip": {-0.3: "version release versión ausgabe", 0.2: "ip address host server adresse serveur dirección servidor"},
    "card": {0.2: "card visa credit payment karte kreditkarte zahlung carte paiement tarjeta crédito pago", -0.2: "order bestellung commande pedido", -0.3: "isbn"},
    "phone": {0.3: "call phone tel mobile telefon anruf handy téléphone appelez portable teléfono llame móvil", 0.2: "fax"},
    "iban": {0.1: "iban account bank konto bankkonto compte banque cuenta banco"},
    "ssn": {0.5: "ssn", 0.4: "social sociale", 0.3: "security sécurité seguridad", -0.2: "part"},
}
WORDS = {kind: {word: more for more, words in own.items() for word in words.split()} for kind, own in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064: the first four characters go last, letters count from 10."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Confirmed account numbers: one word, or words of four characters of
    which the last may be shorter.  Of the ends of words that would do, the
    longest with a right checksum counts."""
    for m in IBAN.finditer(text):
        words, end, ends = m[0].split(" "), m.start(), []
        for k, word in enumerate(words):
            end += len(word) + (k > 0)
            if len("".join(words[: k + 1])) > IBAN_MAX:
                break
            if k == 0 or len(word) <= IBAN_GROUP:
                ends.append(end)
            if len(word) != IBAN_GROUP:
                break
        for end in reversed(ends):
            number = text[m.start() : end].replace(" ", "")
            if len(number) >= IBAN_MIN and mod97(number):
                yield m.start(), end
                break


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def proposed(text: str) -> Iterator[tuple[int, int, str]]:
    """Confirmed spans, kind by kind; in each, leftmost and without overlap."""
    if "@" in text:
        yield from ((a, b, "email") for a, b in _emails(text))
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m.groups()):
            yield m.start(), m.end(), "ip"
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield m.start(), m.end(), "card"
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield m.start(), m.end(), "phone"
    yield from ((a, b, "iban") for a, b in _ibans(text))
    for m in SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield m.start(), m.end(), "ssn"


def scored(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) in order; ends are exclusive, in code points."""
    out = []
    for a, b, kind in proposed(text):
        near = set(LETTERS.findall((text[max(0, a - CONTEXT_CHARS) : a] + " " + text[b : b + CONTEXT_CHARS]).lower()))
        score = SCORE[kind] + sum(more for word, more in WORDS[kind].items() if word in near)
        if kind in BASE_KINDS or score >= MIN_SCORE:
            out.append((a, b, kind, round(min(1.0, max(0.0, score)), 3)))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans`` (array of start, end, kind, score), one row a
    document.  Null and empty texts have none; repeated rows repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("start", "end", "kind", "score"), s)) for s in scored(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_SPAN))], names=["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    done = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<start:bigint,end:bigint,kind:string,score:double>>")
    return done.select(F.col("id").alias(id_col), "spans")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``text`` with each span replaced by <KIND>; of spans that
    overlap, the first stands for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                parts, at = [], 0
                for a, b, kind, _ in scored(t or ""):
                    if a >= at:
                        parts += [t[at:a], f"<{kind.upper()}>"]
                    at = max(at, b)
                out.append(None if t is None else "".join([*parts, t[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "text"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    done = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string")
    return done.select(F.col("id").alias(id_col), "text")
