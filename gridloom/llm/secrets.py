"""Secrets: one keyword automaton finds where to look, anchored patterns match there, embedded checksums confirm.

Runs of hexadecimal digits have no keyword to look for; they are found by their own linear pattern.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from gridloom.llm.common import map_documents

SPAN = StructType([
    StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()),
    StructField("base", BooleanType()), StructField("checked", BooleanType()),
])

# Kinds in the order in which spans of one start are listed, the first three always reported.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "code_host", "package_host", "web_token", "chat_token", "payment_key", "private_key")

# Keywords (lower case) and the kind whose pattern is tried where they stand.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "api_key": "assign",
    "apikey": "assign", "akia": "access", "ghp_": "code_host", "gho_": "code_host", "ghu_": "code_host",
    "ghs_": "code_host", "ghr_": "code_host", "npm_": "package_host", "eyj": "web_token", "xoxb-": "chat_token",
    "xoxp-": "chat_token", "xoxa-": "chat_token", "xoxr-": "chat_token", "sk_live_": "payment_key",
    "rk_live_": "payment_key", "-----begin": "private_key",
}
# The pattern of each kind, tried at the keyword only.
PATTERNS = {
    "assign": re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
    ),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "code_host": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "package_host": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "web_token": re.compile(r"(eyJ[A-Za-z0-9_-]{8,})\.(eyJ[A-Za-z0-9_-]{8,})\.[A-Za-z0-9_-]{16,}"),
    "chat_token": re.compile(r"xox[abpr]-[0-9]{8,}-[A-Za-z0-9-]{10,}"),
    "payment_key": re.compile(r"[sr]k_live_[A-Za-z0-9]{16,}"),
    "private_key": re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"),
}
_HEX = re.compile(r"[0-9a-f]{24,}")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(number: int, width: int) -> str:
    out = ""
    while number or len(out) < width:
        number, digit = divmod(number, 62)
        out = _BASE62[digit] + out
    return out


def checksum_holds(body: str, check: str) -> bool:
    """The last six characters are the CRC-32 of the rest in base 62."""
    return base62(zlib.crc32(body.encode()), 6) == check


def is_json_token(*parts: str) -> bool:
    """Both parts decode to JSON objects and the first names an algorithm."""
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(p + "=" * (-len(p) % 4))) for p in parts)
    except (binascii.Error, ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and "alg" in head


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def _lower(text: str) -> str:
    """Lower case of the same length, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def spans_of(text: str | None, words: ahocorasick.Automaton) -> list[tuple[str, int, int, bool, bool]]:
    """All spans of a text by start, then kind; per kind leftmost and without overlaps."""
    if not text:
        return []
    found, free = [], dict.fromkeys(KINDS, 0)
    for end, (size, kind) in words.iter(_lower(text)):
        start = end + 1 - size
        if start < free[kind] or not (m := PATTERNS[kind].match(text, start)):
            continue
        free[kind] = m.end()  # a match that fails below still uses up its place
        checked = False
        if kind == "assign" and len(m[2]) < 6 or kind == "access" and m.end() - start < 20:
            continue
        if kind in ("code_host", "package_host"):
            checked = checksum_holds(m[1], m[2])
            if not checked:
                continue
        elif kind == "web_token":
            checked = is_json_token(m[1], m[2])
            if not checked:
                continue
        found.append((kind, start, m.end(), kind in BASE_KINDS, checked))
    found += [("hex", m.start(), m.end(), True, False) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``spans`` (kind, start, end in code points, base, checked).

    Base kinds (assign, access, hex) are reported wherever their pattern holds; the others only with their checksum or
    structure confirmed, or a prefix that nothing else uses. A null or empty text has no spans; a null id stays null;
    repeated rows get a row each; other columns are left alone; an empty table gives an empty result. No shuffle,
    memory of one batch.
    """
    schema = StructType([docs.schema[id_col], StructField("spans", ArrayType(SPAN))])
    names = SPAN.fieldNames()

    def start():
        words = automaton()
        return lambda rows: {
            id_col: rows[id_col],
            "spans": [[dict(zip(names, s)) for s in spans_of(t, words)] for t in rows[text_col]],
        }

    return map_documents(docs, [id_col, text_col], text_col, schema, start)
