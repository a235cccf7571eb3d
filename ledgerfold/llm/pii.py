"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, digits, plus signs before a digit,
schemes and account cues. At each anchor a deterministic parser expands to the boundaries of an
address or number and validates it. Anchors come from left to right and each kind remembers where
its last match ended, so matches of a kind are leftmost and do not overlap. Every parser takes its run of
characters at once, so the time for a text grows in proportion to its length.

A null text is empty. Rows that repeat an id keep a row each. Spans count code points, end
exclusive. Texts are scanned whole, row by row, without a shuffle. Without rows, the result is
empty. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm._text import slices

# The shapes that have to be found, in the order in which kinds are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "login")
BASE = KINDS[:4]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[:=]?\x20?([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGITS = frozenset("0123456789")

_OUT = pa.schema([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _anchors() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    out.add_word("@", ("at", 1))
    for d in "0123456789":
        out.add_word(d, ("digit", 1))
        out.add_word("+" + d, ("plus", 2))
    out.add_word("://", ("scheme", 3))
    out.add_word("IBAN", ("iban", 4))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _octet_ok(digits: str) -> bool:
    bare = digits.lstrip("0")
    return len(bare) <= 3 and int(bare or "0") <= 255


def _iban_ok(text: str) -> bool:
    x = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind, end) of everything found, sorted."""
    out: list[tuple[int, int, int]] = []
    email = ip = card = phone = 0  # where the last match of a kind ended
    for last, (cue, size) in anchors.iter(text):
        at = last - size + 1
        if cue == "digit":
            # Matches take whole runs of digits, so only the first digit of a run can begin one.
            if at and text[at - 1] in _DIGITS:
                continue
            if at >= card and (m := _CARD.match(text, at)):
                card = m.end()
                digits = _NOT_DIGIT.sub("", m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((at, 2, card))
            if at >= ip and (m := _IP.match(text, at)):
                ip = m.end()
                if all(_octet_ok(x) for x in m.group().split(".")):
                    out.append((at, 1, ip))
        elif cue == "at":
            start = at
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email = m.end()
                out.append((start, 0, email))
        elif cue == "plus":
            if at >= phone and (m := _PHONE.match(text, at)):
                phone = m.end()
                if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append((at, 3, phone))
        elif cue == "iban":
            if (m := _IBAN.match(text, last + 1)) and _iban_ok(m.group(1)):
                out.append((m.start(1), 4, m.end(1)))
        elif m := _LOGIN.match(text, last + 1):
            out.append((m.start(), 5, m.end()))
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = _anchors()
    span = pa.struct(list(_OUT))
    for batch in slices(batches):
        found = [
            [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(text or "", anchors)]
            for text in batch.column("text").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(span))], ["doc_id", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every document; spans are by start, then by kind as listed in KINDS."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _scan, f"doc_id {id_type}, spans array<struct<kind:string,start:long,end:long>>"
    )


def redact(docs: DataFrame, mark: str = "<{}>") -> DataFrame:
    """The documents with every found span replaced by its kind; spans that overlap an earlier one are skipped."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _anchors()
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                if text is not None:
                    parts, at = [], 0
                    for s, k, e in find(text, anchors):
                        if s >= at:
                            parts += [text[at:s], mark.format(KINDS[k])]
                            at = e
                    text = "".join([*parts, text[at:]])
                out.append(text)
            where = batch.schema.get_field_index("text")
            yield batch.set_column(where, "text", pa.array(out, pa.string()))

    return docs.mapInArrow(work, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, base_sha256, spans and n_found (all kinds) of (doc_id, spans) rows."""
    word = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    written = lambda spans: F.array_join(F.transform(spans, word), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_found")
    )
