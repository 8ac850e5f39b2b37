"""Personal data: patterns propose spans, checksums confirm them, context words
adjust the score.

Spans are ``(kind, start, end, score)`` in code points, end exclusive. The four
base kinds (email, ip, card, phone) are kept whenever their own check holds; the
added kinds (iban, ssn) are kept when checksum and context give them a score of
at least ``min_score``. Null texts count as empty and have no spans; rows are
independent, so repeated rows give repeated results.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
SPAN_TYPE = "array<struct<kind:string,start:int,end:int,score:double>>"

# Prior score of a confirmed span and the words that raise it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": r"mail|contact|write",
    "ip": r"\bip\b|address|server|host",
    "card": r"card|visa|master|credit|debit|payment",
    "phone": r"phone|call|tel|mobile|fax",
    "iban": r"iban|account|bank|transfer",
    "ssn": r"ssn|social|security|insurance",
}
CONTEXT_BONUS = 0.3
CONTEXT_CHARS = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# The lookbehind only skips restarts inside a run of digits, which fail as the run's start does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_CONTEXT = {k: re.compile(v) for k, v in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    """Leftmost matches in linear time: a match's local part reaches back from its @."""
    done = 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            done = m.end()
            yield start, done


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


def _ibans(text: str):
    for m in _IBAN.finditer(text):
        found = m[0]
        while len(found) >= 15:  # upper-case words may follow; give them back one by one
            if mod97(found.replace(" ", "")):
                yield m.start(), m.start() + len(found)
                break
            found = found.rpartition(" ")[0]


def _ssns(text: str):
    return (m.span() for m in _SSN.finditer(text))


def spans_of(text: str | None, min_score: float = 0.5) -> list[tuple[str, int, int, float]]:
    """All spans of one text, by kind as listed in KINDS, then by start."""
    if not text:
        return []
    digits = _DIGIT.search(text) is not None
    found = [("email", s, e) for s, e in (_emails(text) if "@" in text else ())]
    if digits:
        for kind, search in (("ip", _ips), ("card", _cards), ("phone", _phones), ("iban", _ibans), ("ssn", _ssns)):
            found += [(kind, s, e) for s, e in search(text)]
    out = []
    for kind, s, e in found:
        near = text[max(0, s - CONTEXT_CHARS) : s] + " " + text[e : e + CONTEXT_CHARS // 2]
        score = min(1.0, PRIOR[kind] + CONTEXT_BONUS * bool(_CONTEXT[kind].search(near.lower())))
        if kind in BASE_KINDS or score >= min_score:
            out.append((kind, s, e, score))
    return out


def pii_spans(text: Column, min_score: float = 0.5) -> Column:
    """Column of spans of a text column (Arrow batches; one row at a time inside)."""

    @F.pandas_udf(SPAN_TYPE)
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series(
            [[{"kind": k, "start": s, "end": e, "score": c} for k, s, e, c in spans_of(t, min_score)] for t in texts]
        )

    return find(text)


def span_text(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of these kinds, comma-joined, in their order."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """Per document: id, counts of the base kinds, digest of the base spans, spans.

    Narrow: no shuffle, other columns are not read.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), pii_spans(F.col(text_col), min_score).alias("found"))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, BASE_KINDS),
        F.sha2(span_text(F.col("found"), BASE_KINDS).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )


def redact(docs: DataFrame, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """Replace each span by its kind in angle brackets; overlapping spans become one.
    Null texts stay null, texts without spans stay as they are."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redacted(t, min_score) for t in texts], dtype=object)

    return docs.withColumn(text_col, clean(F.col(text_col)))


def redacted(text: str, min_score: float = 0.5) -> str:
    out, done = [], 0
    for s, e, kind in sorted((s, e, k) for k, s, e, _ in spans_of(text, min_score)):
        if s >= done:
            out += [text[done:s], f"<{kind.upper()}>"]
        done = max(done, e)
    return "".join([*out, text[done:]]) if out else text
