"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score."""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "tel")
KINDS = BASE + ADDED
CONTEXT_CHARS = 48  # on either side of a span
THRESHOLD = 0.5  # least score of an added span

# Start score of a kind, and words near a span that raise or lower it.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.9, "ssn": 0.35, "tel": 0.35}
SUPPORT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "server", "host", "login", "logged"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact", "whatsapp", "telefon", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte", "bic", "swift"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "tel": ("phone", "tel", "call", "mobile", "fax", "contact", "whatsapp", "telefon", "teléfono"),
}
AGAINST = ("version", "isbn", "issn", "doi", "order", "invoice", "serial", "sku", "example", "test")

# Letters and digits of an account number, by country.
IBAN_LENGTH = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
        27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}

# Every pattern is tried once at each place where it can start, so the work is linear in the text.
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}))")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_TEL = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9.-])")
_ALNUM = re.compile(r"[A-Za-z0-9]")
_DIGITS = re.compile(r"[0-9]")
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number's letters and digits leave remainder 1."""
    rest = 0
    for ch in iban[4:] + iban[:4]:
        for d in str(int(ch, 36)):
            rest = (rest * 10 + int(d)) % 97
    return rest == 1


def _iban_end(text: str, start: int, end: int) -> int:
    """End of the account number that begins a proposal, or 0; a country's numbers have one length."""
    length = IBAN_LENGTH.get(text[start : start + 2])
    if length:
        at = start
        while length and at < end:
            length -= text[at] != " "
            at += 1
        ends = [] if length else [at]
    else:  # no known country: each end at a blank, the longest first
        ends = [end, *[i for i in range(end - 1, start, -1) if text[i] == " "]]
    for e in ends:
        compact = text[start:e].replace(" ", "")
        if len(compact) >= 15 and not _ALNUM.match(text, e) and mod97(compact):
            return e
    return 0


def _ibans(text: str):
    """Spans of account numbers, leftmost and apart. Words that follow, as a BIC or a currency, are left out."""
    done = 0
    for m in _IBAN.finditer(text):
        s, e = m.span(1)
        if s >= done and (e := _iban_end(text, s, e)):
            yield s, e
            done = e


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            yield lo, m.end()
            done = m.end()
        # a part before this sign that fails cannot start a later match: it cannot cross the sign
        done = max(done, at + 1)
        at = text.find("@", done)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:  # 19 digits and the separators between them
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the four base kinds, leftmost and apart within a kind."""
    found = []
    if "@" in text:
        found += [(s, 0, e) for s, e in _emails(text)]
    if _DIGITS.search(text):
        if "." in text:
            found += [(s, 1, e) for s, e in _ips(text)]
        found += [(s, 2, e) for s, e in _cards(text)]
        if "+" in text:
            found += [(s, 3, e) for s, e in _phones(text)]
    return sorted(found)


def _score(kind: str, text: str, start: int, end: int) -> float:
    around = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
    near = {w.lower() for w in _WORDS.findall(around)}
    score = PRIOR[kind]
    if near & set(SUPPORT[kind]):
        score += 0.4
    if near & set(AGAINST):
        score -= 0.3
    return round(min(1.0, max(0.0, score)), 3)


def find_spans(text: str | None) -> list[Span]:
    """All spans of a text: every base span, and added ones that reach the threshold.

    Added are account numbers that pass mod-97, and social security and local telephone numbers
    that context words support, where they touch no base span.
    """
    text = text or ""
    base = base_spans(text)
    taken = [(s, e) for s, _, e in base]
    found = [Span(BASE[k], s, e, _score(BASE[k], text, s, e)) for s, k, e in base]
    if not _DIGITS.search(text):
        return found
    proposed = [("iban", s, e) for s, e in _ibans(text)]
    for kind, pattern in (("ssn", _SSN), ("tel", _TEL)):
        proposed += [(kind, *m.span()) for m in pattern.finditer(text)]
    for kind, s, e in proposed:
        group = text[s:e]
        if kind != "iban" and any(s < b and a < e for a, b in taken):
            continue
        if kind == "ssn" and (group[:3] in ("000", "666") or group[0] == "9" or group[4:6] == "00" or group[7:] == "0000"):
            continue
        score = _score(kind, text, s, e)
        if score >= THRESHOLD:
            found.append(Span(kind, s, e, score))
            taken.append((s, e))
    return sorted(found, key=lambda x: (x.start, KINDS.index(x.kind)))


def _joined(spans) -> str:
    return ",".join(f"{x.kind}:{x.start}:{x.end}" for x in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: identifier, counts of the base kinds, digest, ``spans`` and more.

    ``base_sha256`` digests ``kind:start:end`` of the base spans in code points, by start and kind;
    ``spans`` lists all spans in this form, and ``scores`` their scores in the same order.
    ``n_added`` counts the spans beyond the base kinds. Null and empty texts have no spans; null
    identifiers and repeated rows come back as they came in; other columns are ignored. The work
    stays in the row, so nothing is shuffled.
    """

    def run(batches):
        for batch in batches:
            columns = [[] for _ in range(8)]
            for value in batch.column(1):
                spans = find_spans(value.as_py())
                base = [x for x in spans if x.kind in BASE]
                row = [sum(x.kind == k for x in base) for k in BASE]
                row += [
                    hashlib.sha256(_joined(base).encode()).hexdigest(),
                    _joined(spans),
                    len(spans) - len(base),
                    [x.score for x in spans],
                ]
                for c, v in zip(columns, row):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=[id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "scores"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run,
        f"`{id_col}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint,"
        " base_sha256 string, spans string, n_added bigint, scores array<double>",
    )


def mask(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlaps are one span."""
    if text is None:
        return None
    out, done = [], 0
    for x in spans:
        if x.start >= done:
            out += [text[done : x.start], f"<{x.kind}>"]
        done = max(done, x.end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of its texts masked; all other columns and null texts stay."""

    @F.pandas_udf("string")
    def masked(texts):
        return texts.map(lambda t: mask(t, find_spans(t)), na_action="ignore")

    return docs.select(
        *[masked(F.col(c)).alias(c) if c == text_col else docs[c] for c in docs.columns]
    )
