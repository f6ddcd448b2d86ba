"""Personal data in texts: patterns propose, checksums confirm, nearby words weigh.

Base kinds (email, ip, card, phone) follow fixed patterns and rules and are always
kept. The further kinds are added where they overlap no base span and their score
reaches ``least_score``: IBANs confirmed by mod-97, and national numbers and bank
accounts that a word nearby announces. A base span's score starts higher and rises
with context too, but never removes it.

Everything is per row: nothing is shuffled. Patterns are anchored so that long runs
of one character class are read once. Null and empty texts have no spans. Null ids
and repeated rows are rows like any other, texts of any length are searched whole, and
an empty table gives no row; extra columns are kept by ``redacted``
and not read by ``found``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaprof.llm.common import slices

KINDS = ("email", "ip", "card", "phone", "iban", "national_id", "account")
BASE = KINDS[:4]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
ACCOUNT = re.compile(r"(?<![0-9])[0-9]{8,11}(?![0-9])")
NOT_DIGIT = re.compile("[^0-9]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Characters of an IBAN in countries that have fixed its length.
IBAN_LENGTH = {country: int(n) for n, countries in (entry.split(":") for entry in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
    "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
    "28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU 31:MT,SC 32:LC 33:RU").split()) for country in countries.split(",")}

#: Words that announce a kind, and the characters before and after a span in which they count.
CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|credit|karte|carte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|telefon|téléphone|teléfono)\b", re.I),
    "iban": re.compile(r"\b(?:iban|bank|account|konto|compte|cuenta)\b", re.I),
    "national_id": re.compile(r"\b(?:ssn|social security|national id)\b", re.I),
    "account": re.compile(r"\b(?:account|acct|konto|compte|cuenta)\b", re.I),
}
NEAR = 40
#: Score of a confirmed span without context; context adds ``LIFT``.
START = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "national_id": 0.4, "account": 0.3}
LIFT = 0.3


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, at sign and dotted domain, found from the at signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (match := DOMAIN.match(text, at + 1)):
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int, float]]:
    """(start, kind number, end, score) of the base kinds, in order of start and kind."""
    spans = []
    if "@" in text:
        spans += [(a, 0, b) for a, b in _emails(text)]
    for match in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in match[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            spans.append((match.start(), 1, match.end()))
    for match in CARD.finditer(text):
        if match.end() - match.start() >= 12:
            digits = NOT_DIGIT.sub("", match[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((match.start(), 2, match.end()))
    if "+" in text:
        for match in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", match[0])) <= 15:
                spans.append((match.start(), 3, match.end()))
    return spans


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """IBANs with a valid checksum. A match that has taken in the words behind its number ends earlier.

    Ends are tried from the longest on; where the country has fixed the length, only that one and the whole match.
    """
    match = IBAN.search(text)
    while match:
        start, end = match.span()
        fixed = IBAN_LENGTH.get(text[start:start + 2])
        ends = [end] + [at for at in range(end - 1, start + 11, -1) if text[at] == " " and IBAN.fullmatch(text, start, at)]
        if fixed:
            ends = [at for at in ends if at - start - text.count(" ", start, at) == fixed] + [end]
        end = next((at for at in ends if mod97(text[start:at])), None)
        if end is not None:
            yield start, end
        match = IBAN.search(text, start + 1 if end is None else end)


def _score(text: str, kind: str, start: int, end: int) -> float:
    after = min(len(text), end + NEAR)
    while end < after < len(text) and text[after - 1].isalnum() and text[after].isalnum():  # no word is cut
        after -= 1
    words = CONTEXT[kind]
    near = words.search(text, max(0, start - NEAR), start) or words.search(text, end, after)
    return min(1.0, START[kind] + (LIFT if near else 0.0))


def spans_of(text: str, least_score: float = 0.6) -> list[tuple[int, int, int, float]]:
    """All spans of a text as (start, kind number, end, score), in order of start and kind."""
    base = base_spans(text)
    found = [(a, k, b, _score(text, KINDS[k], a, b)) for a, k, b in base]
    busy: list[tuple[int, int]] = []
    for a, _, b, _ in sorted(found):
        if busy and a < busy[-1][1]:
            busy[-1] = (busy[-1][0], max(b, busy[-1][1]))
        else:
            busy.append((a, b))
    for kind, proposed in ((4, _ibans(text)), (5, map(re.Match.span, NATIONAL.finditer(text))), (6, map(re.Match.span, ACCOUNT.finditer(text)))):
        for a, b in proposed:
            score = _score(text, KINDS[kind], a, b)
            at = bisect_left(busy, (b,))
            if score >= least_score and (at == 0 or busy[at - 1][1] <= a):
                insort(busy, (a, b))
                found.append((a, kind, b, score))
    return sorted(found)


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
SPAN_SQL = "array<struct<kind: string, start: int, end: int, score: double>>"


def found(docs: DataFrame, least_score: float = 0.6) -> DataFrame:
    """(doc_id, spans): kind, start, end (code points, end exclusive) and score of every span."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                spans = [[{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, k, b, s in spans_of(t or "", least_score)]
                         for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, SPAN_TYPE)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, f"doc_id bigint, spans {SPAN_SQL}")


def counted(docs: DataFrame, least_score: float = 0.6) -> DataFrame:
    """Per document the number of spans of each base kind, their hash, and all spans as text."""
    rows = found(docs, least_score)
    as_text = "concat(x.kind, ':', x.start, ':', x.end)"
    base = "filter(spans, x -> x.kind in ('email', 'ip', 'card', 'phone'))"
    return rows.select(
        "doc_id", *[F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE],
        F.expr(f"sha2(concat_ws(',', transform({base}, x -> {as_text})), 256)").alias("base_sha256"),
        F.expr(f"concat_ws(',', transform(spans, x -> {as_text}))").alias("spans"))


def masked(text: str, least_score: float = 0.6) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the union is replaced."""
    parts, done = [], 0
    for start, kind, end, _ in spans_of(text, least_score):
        if start < done:
            if end > done:
                done = end
            continue
        parts += [text[done:start], f"<{KINDS[kind]}>"]
        done = end
    return text if not parts else "".join(parts) + text[done:]


def redacted(docs: DataFrame, least_score: float = 0.6) -> DataFrame:
    """``docs`` with personal data masked in ``text`` (a null stays null); ``n_chars``, if there, follows the text."""
    names = docs.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t if t is None else masked(t, least_score) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in names], names)

    rows = docs.mapInArrow(run, schema)
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                               .otherwise(F.length("text")).cast(dict(docs.dtypes)["n_chars"]))
    return rows.select(*names)
