"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Every kind is found leftmost and without overlap by one pass over the whole text. The scanners are
linear: no run of characters is scanned again from each of its positions, so a text of one long run
costs no more than prose. Spans are code-point offsets with an exclusive end.

Null texts count as empty and give no spans. Rows with the same doc_id, or the same text, each give
their own row. An empty table gives an empty result. Extra columns are kept by ``find_pii`` (names
that clash with its own are replaced) and are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, read_table

LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL_LOCAL_END = re.compile(LOCAL + r"*\Z")
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn")

#: Score of a confirmed span without context, by kind.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.45}
#: Words that make a kind likelier within WINDOW characters of a span.
CONTEXT = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "cvv"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
#: Words that speak against every kind.
AGAINST = ("version", "example", "sample", "test", "isbn", "serial")
BOOST, DAMP, WINDOW = 0.15, 0.2, 40


def luhn_ok(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban_ok(value: str) -> bool:
    """Check digits by ISO 7064 mod 97-10."""
    s = value.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ssn_ok(value: str) -> bool:
    area, group, serial = value.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := EMAIL_DOMAIN.match(text, at)):
            out.append((start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = max(last, at)  # what lies before a failing @ belongs to no later local part
            at = text.find("@", at + 1)
    return out


LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Email, IP, card and phone spans, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return out
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := only_digits(m[0])) <= 19 and luhn_ok(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(only_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def more_spans(text: str) -> list[tuple[str, int, int]]:
    if not re.search("[0-9]", text):
        return []
    out = [("iban", m.start(), m.end()) for m in IBAN.finditer(text) if iban_ok(m[0])]
    if "-" in text:
        out += [("ssn", m.start(), m.end()) for m in SSN.finditer(text) if ssn_ok(m[0])]
    return out


def score(kind: str, text: str, start: int, end: int) -> float:
    near = set(re.findall("[a-z]+", (text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]).lower()))
    s = PRIOR[kind] + BOOST * bool(near.intersection(CONTEXT[kind])) - DAMP * bool(near.intersection(AGAINST))
    return round(min(1.0, max(0.0, s)), 4)


def find_spans(text: str | None, least: float = 0.4) -> list[tuple[str, int, int, float]]:
    """All base spans, and of the further kinds those whose score reaches ``least``; kinds in order, then start."""
    text = text or ""
    base = [(k, a, b, score(k, text, a, b)) for k, a, b in base_spans(text)]
    return base + [(k, a, b, s) for k, a, b in more_spans(text) if (s := score(k, text, a, b)) >= least]


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """Replace spans by their kind in angle brackets; of overlapping spans the first to start, then the longest, stands."""
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
            at = b
    return "".join(out) + text[at:]


SPAN_TYPE = "array<struct<kind:string,start:int,end:int,score:double>>"


def find_pii(docs: DataFrame, text: str = "text", least: float = 0.4, redacted: str | None = None, out: str = "spans") -> DataFrame:
    """Add ``out`` (kind, start, end, score) to each row and, if ``redacted`` names a column, the text with spans replaced.

    No shuffle: each row is judged alone, in Arrow batches.
    """

    def run(texts: list[str | None]) -> dict[str, list]:
        found = [find_spans(t, least) for t in texts]
        made = {out: [[{"kind": k, "start": a, "end": e, "score": s} for k, a, e, s in f] for f in found]}
        return made | ({redacted: [t if not s else redact(t, s) for t, s in zip(texts, found, strict=True)]} if redacted else {})

    return map_rows(docs, [text], run, {out: SPAN_TYPE} | ({redacted: "string"} if redacted else {}))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(joined(F.filter("spans", lambda s: s.kind.isin(*KINDS))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s.score)), F.lit(0.0)).alias("top_score"),
    )
