"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Every pattern is written so that it scans in linear time on any text: a run that
failed once is not tried again from each of its characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national_id")

DIGIT = re.compile("[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: What each kind is worth by its pattern and checksum alone, and the words that speak for it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_id": 0.3}
CONTEXT = {
    "email": "email e-mail mail contact",
    "ip": "ip address host server addr",
    "card": "card credit visa mastercard payment",
    "phone": "phone call tel telephone mobile fax",
    "iban": "iban account bank transfer",
    "national_id": "ssn social security taxpayer",
}
AGAINST = "example test sample dummy version order invoice"
REACH = 40  # characters looked at before a span and after it
STEP = 0.2
NEEDED = 0.5  # of the spans beyond the base, those with at least this score are reported


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # end of the last match
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the base kinds, each kind leftmost and without overlap; a match that fails
    its check is dropped and not tried again in another form."""
    emails = list(_emails(text)) if "@" in text else []
    ips, cards, phones = [], [], []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
                ips.append(m.span())
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    cards.append(m.span())
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    phones.append(m.span())
    return [emails, ips, cards, phones]


def score(text: str, kind: str, start: int, end: int) -> float:
    """0 to 1: the kind's prior, raised by context words nearby and lowered by words of examples."""
    near = (text[max(0, start - REACH) : start] + " " + text[end : end + REACH]).lower()
    words = set(re.findall("[a-z-]+", near))
    value = PRIOR[kind] + STEP * bool(words & set(CONTEXT[kind].split())) - STEP * bool(words & set(AGAINST.split()))
    return min(1.0, max(0.0, round(value, 2)))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers: words in capitals may follow one, so shorter ends at the blanks of a match
    are tried too, the longest first; a match has 65 characters at most."""
    at = 0
    while m := IBAN.search(text, at):
        at, end = m.start() + 1, m.end()
        while end > m.start():
            number = text[m.start() : end].replace(" ", "")
            if len(number) < 15:
                break
            if mod97(number):
                yield m.start(), end
                at = end
                break
            end = text.rfind(" ", m.start(), end)


def added_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans beyond the base: account numbers that pass mod-97, and national ids whose context speaks for them."""
    if not DIGIT.search(text):
        return [[], []]
    ibans = list(_ibans(text))
    numbers = [m.span() for m in NATIONAL_ID.finditer(text) if "-" in m[0]]
    return [
        [s for s in found if score(text, kind, *s) >= NEEDED] for kind, found in zip(ADDED, (ibans, numbers))
    ]


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, kinds, starts, ends, scores) for every row: parallel lists, by kind in the
    order of BASE and ADDED, then by start.  Offsets count code points, the end is
    exclusive.  A NULL text counts as empty; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, starts, ends, scores = [], [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                spans = [
                    (kind, *span)
                    for kind, found in zip(BASE + ADDED, base_spans(text) + added_spans(text))
                    for span in found
                ]
                kinds.append([s[0] for s in spans])
                starts.append([s[1] for s in spans])
                ends.append([s[2] for s in spans])
                scores.append([score(text, *s) for s in spans])
            long = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(kinds, pa.list_(pa.string())),
                    pa.array(starts, long),
                    pa.array(ends, long),
                    pa.array(scores, pa.list_(pa.float64())),
                ],
                ["doc_id", "kinds", "starts", "ends", "scores"],
            )

    schema = "doc_id long, kinds array<string>, starts array<long>, ends array<long>, scores array<double>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def redact(text: str | None) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first stays."""
    text = text or ""
    spans = sorted(
        (start, end, kind)
        for kind, found in zip(BASE + ADDED, base_spans(text) + added_spans(text))
        for start, end in found
    )
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join([*out, text[at:]])


def summary(found: DataFrame) -> DataFrame:
    """Digest columns of the spans: counts of the base kinds, a hash of the base spans, all spans as text."""
    span = F.transform(
        F.arrays_zip("kinds", "starts", "ends"),
        lambda s: F.struct(
            s["kinds"].alias("kind"),
            F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string")).alias("text"),
        ),
    )
    spans = found.withColumn("span", span)
    base = F.filter("span", lambda s: s["kind"].isin(*BASE))
    texts = lambda spans: F.array_join(F.transform(spans, lambda s: s["text"]), ",")
    count = lambda kind: F.size(F.filter("span", lambda s: s["kind"] == kind)).cast("long")
    return spans.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(texts(base).cast("binary"), 256).alias("base_sha256"),
        texts(F.col("span")).alias("spans"),
        F.coalesce(F.array_max("scores"), F.lit(0.0)).alias("top_score"),
    )
