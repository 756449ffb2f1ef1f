"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .tokens import slices

#: Kinds in the order of their spans; the first four are reported whatever their score.
KINDS = ("email", "ip", "card", "phone", "iban", "card_short", "phone_local", "national_id", "secret")
BASE = KINDS[:4]
#: Least score of a span of the other kinds.
THRESHOLD = 0.6
#: Characters looked at before and after a span for context words.
BEFORE, AFTER = 40, 20

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
# A match inside a run of digits would have begun at the start of the run; the look-behind only keeps the search linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
PHONE_LOCAL = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,}+")

CONTEXT = {
    "card": re.compile(r"card|credit|visa|payment|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|tel\b|tel[.:]|call|mobile|fax|telefon|téléphone|teléfono", re.I),
    "iban": re.compile(r"iban|account|bank|konto|compte|cuenta", re.I),
    "national_id": re.compile(r"ssn|social security|national id|tax id|passport", re.I),
    "secret": re.compile(r"token|secret|passw|api[ _-]?key|bearer|credential|access[ _-]?key", re.I),
}
CONTEXT |= {"card_short": CONTEXT["card"], "phone_local": CONTEXT["phone"]}


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def mod97(text: str) -> bool:
    """The check of an IBAN: its first four characters moved behind, letters as numbers, leave 1."""
    s = re.sub(r"\s", "", text)
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, found from each @.

    The part before an @ is the whole run of its characters that no earlier match
    has taken; if the domain fails, no later start in that run can match. This
    takes linear time on any text.
    """
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", at + 1)
    return found


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str, kinds: tuple[str, ...] = BASE) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in emails(text)] if "email" in kinds else []
    if "ip" in kinds:
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p) < 4 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split(".")))]
    if "card" in kinds:
        found += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "phone" in kinds:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


#: kind: pattern, prior score, validator or None, what the validator adds (or takes), what context adds.
PROPOSED = {
    "iban": (IBAN, 0.4, mod97, 0.4, 0.2),
    "card_short": (CARD, 0.1, lambda s: 13 <= len(d := _digits(s)) <= 15 and luhn(d), 0.3, 0.3),
    "phone_local": (PHONE_LOCAL, 0.3, None, 0.0, 0.4),
    "national_id": (NATIONAL_ID, 0.3, lambda s: not re.match(r"000|666|9|...-00|.*-0000", s), 0.1, 0.3),
    "secret": (SECRET, 0.3, None, 0.0, 0.4),
}


class Taken:
    """Disjoint stretches of a text in ascending order."""

    def __init__(self, found: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(found):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def take(self, a: int, b: int) -> bool:
        """Whether the stretch was free; it is taken then."""
        at = bisect_left(self.starts, b)
        if at and self.ends[at - 1] > a:
            return False
        self.starts.insert(at, a)
        self.ends.insert(at, b)
        return True


def spans(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start; starts and ends count code points."""
    text = text or ""
    found = []

    def near(kind: str, a: int, b: int) -> bool:
        return kind in CONTEXT and bool(CONTEXT[kind].search(text, max(0, a - BEFORE), a) or CONTEXT[kind].search(text, b, b + AFTER))

    for kind, a, b in base_spans(text):
        found.append((kind, a, b, min(1.0, 0.7 + 0.2 * (kind == "card") + 0.1 * near(kind, a, b))))
    taken = Taken([s[1:3] for s in found])
    for kind, (pattern, prior, valid, check, context) in PROPOSED.items():
        for m in pattern.finditer(text):
            score = prior + (check * (1 if valid(m[0]) else -1) if valid else 0)
            if score + context >= threshold and (score := score + context * near(kind, *m.span())) >= threshold - 1e-9 and taken.take(*m.span()):
                found.append((kind, *m.span(), round(min(1.0, score), 3)))
    return found


#: Texts without a match hold no span: looked for in a whole batch at once.
MAY_HOLD = r"@|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[ -]?[0-9]){8}|\+[0-9]|[A-Z]{2}[0-9]{2}|[A-Za-z0-9_-]{20}|[0-9]{3}\)? ?[ .-]?[0-9]{3}[ .-][0-9]{4}"
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def _mapped(docs: DataFrame, made, schema: str, column: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            texts = batch.column(column)
            maybe = pc.match_substring_regex(texts, MAY_HOLD).to_pylist()
            yield made(batch, [spans(t.as_py()) if m else [] for t, m in zip(texts, maybe)])

    return docs.mapInArrow(run, schema)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, score) of every row, by kind, then start.

    Null and empty texts have none. Rows are kept as they come, repeats and null
    identifiers included; each is judged alone, so nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    made = lambda batch, found: pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([[dict(zip(("kind", "start", "end", "score"), s)) for s in x] for x in found], struct)], ["doc_id", "spans"])
    return _mapped(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")), made, f"doc_id {kind}, spans {SPANS}")


def masked(text: str, found: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first stands for all."""
    out, at = [], 0
    for kind, a, b, _ in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of its texts masked; null texts and all other columns stay as they are."""

    def made(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text_col)
        texts = [t if not f else masked(t, f) for t, f in zip(batch.column(at).to_pylist(), found)]
        return pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, batch.schema.field(at).type), *batch.columns[at + 1 :]], schema=batch.schema)

    return _mapped(docs, made, docs.schema, text_col)


def digest(found: DataFrame) -> DataFrame:
    """The counts of the base kinds, the digest of their spans and all spans as text."""
    said = lambda rows: F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
