"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from gridloom.llm.common import map_documents

SPAN = StructType([
    StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()),
    StructField("score", DoubleType()), StructField("base", BooleanType()),
])

# Kinds in the order in which spans are listed, the first four always reported.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national_id")

# Score of a confirmed span before its surroundings are looked at.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "national_id": 0.4}
# Words that make a kind likelier, and words that make any number less likely to be personal.
CONTEXT = {
    "email": ("mail", "contact", "write to", "courriel", "correo"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "credit", "visa", "mastercard", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "móvil"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social security", "national id", "tax id", "insurance number"),
}
DOUBT = ("version", "example", "isbn", "part no", "serial", "order no")
CONTEXT_CHARS = 40
RAISE, LOWER, KEEP_AT = 0.3, 0.2, 0.5

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins, which keeps the search linear.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)  # twice a digit, its digits added


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Bank account check: the country part moved behind, letters as numbers, remainder one."""
    code = code.replace(" ", "")
    number = "".join(str(int(c, 36)) for c in code[4:] + code[:4])
    return 15 <= len(code) <= 34 and int(number) % 97 == 1


def _emails(text: str):
    """Each @ can only be matched with the longest local part before it, so only those are tried."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", at + 1)


def _base(text: str):
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end
    # Every other kind holds a digit.
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.groups()):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end()


def _extra(text: str):
    for m in _IBAN.finditer(text):
        # The longest prefix that passes: words in capitals may follow the number.
        code = m[0]
        while len(code) >= 15:
            if mod97(code):
                yield "iban", m.start(), m.start() + len(code)
                break
            code = code.rpartition(" ")[0]
    for m in _NATIONAL.finditer(text):
        yield "national_id", m.start(), m.end()


def score(text: str, kind: str, start: int, end: int) -> float:
    near = (text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]).lower()
    value = PRIOR[kind]
    value += RAISE * any(w in near for w in CONTEXT[kind])
    value -= LOWER * any(w in near for w in DOUBT)
    return min(1.0, max(0.0, round(value, 2)))


def _without(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with blanks in place of all spans: what one span holds says nothing about its neighbours."""
    out, last = [], 0
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if e > last:
            out += [text[last:s], " " * (e - max(s, last))]
            last = e
    return "".join(out) + text[last:]


def spans_of(text: str | None) -> list[tuple[str, int, int, float, bool]]:
    """All spans of a text, by kind and start; added kinds only if their score holds."""
    if not text:
        return []
    base, extra = list(_base(text)), list(_extra(text))
    if not base and not extra:
        return []
    around = _without(text, base + extra)
    found = [(k, s, e, score(around, k, s, e), True) for k, s, e in base]
    for k, s, e in extra:
        if (points := score(around, k, s, e)) >= KEEP_AT:
            found.append((k, s, e, points, False))
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``spans`` (kind, start, end in code points, score, base).

    Base kinds (email, ip, card, phone) are reported whenever pattern and validator agree; their score only says how
    the surroundings read. Added kinds (iban, national_id) need a score of ``KEEP_AT``. A null or empty text has no
    spans; a null id stays null; repeated rows get a row each; other columns are left alone. An empty table gives
    an empty result. No shuffle, memory of one batch.
    """
    schema = StructType([docs.schema[id_col], StructField("spans", ArrayType(SPAN))])

    def start():
        def work(rows):
            return {id_col: rows[id_col], "spans": [
                [dict(zip(("kind", "start", "end", "score", "base"), s)) for s in spans_of(t)] for t in rows[text_col]
            ]}
        return work

    return map_documents(docs, [id_col, text_col], text_col, schema, start)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at: float = KEEP_AT) -> DataFrame:
    """The same rows and columns with every base span, and every added span scored ``at`` or more, replaced by ``[KIND]``.

    Overlapping spans become one replacement, named after the first of them. What only becomes a span once its neighbour
    is replaced (the card in ``1.2.3.4 4111 …``, whose digits run into the address) is replaced too. Null texts stay null.
    """
    names = docs.columns

    def start():
        def clean(text):
            # Ends: a span holds a digit or an @, its replacement neither.
            while spans := [x for x in spans_of(text) if x[4] or x[3] >= at]:
                out, last = [], 0
                for kind, s, e, _, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
                    if s < last:
                        last = max(last, e)
                        continue
                    out += [text[last:s], f"[{kind.upper()}]"]
                    last = e
                text = "".join(out) + text[last:]
            return text

        return lambda rows: rows | {text_col: [clean(t) for t in rows[text_col]]}

    return map_documents(docs, names, text_col, docs.schema, start)


def listed(spans):
    """kind:start:end of an array of spans, comma-joined."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.concat_ws(",", one)
