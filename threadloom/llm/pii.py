"""Personal data: Aho-Corasick anchors, expanded by local parsers.

One automaton scan of a text finds the anchors: at-signs, plus signs, digits,
``://`` and cue words of identifiers and streets. A parser then expands from the
anchor and validates: the base kinds are exactly these patterns, leftmost and
non-overlapping per kind, and a failing match is dropped without a retry:

* email  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip     four digit groups joined by dots, each at most 255
* card   digits with single blanks or hyphens between, 12 to 19 of them, passing Luhn
* phone  ``+``, then digits, blanks, dots, brackets, hyphens, 9 to 15 digits in all

Added kinds, which never overlap a base span:

* address  house number and capitalised street name before a street word
* account  identifier after a cue such as ``account:`` or ``token =`` (IBANs by
  their check digits), or ``user:password`` in front of a URL's host

Positions count code points, ends are exclusive. Null and empty texts have no
spans. Repeated rows get equal spans. Texts are never split.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account")
CUES = ("account", "acct", "iban", "passport", "password", "secret", "ssn", "token", "api_key", "apikey")
STREETS = ("Street", "Avenue", "Road", "Lane", "Boulevard", "Drive", "Court", "Square", "Straße", "Strasse")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_SPACED = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_VALUE = re.compile(r"""["']?[ \t]{0,2}(?:(?:number|no\.?|id)[ \t]{0,2})?[:=#][ \t]{0,2}["']?([A-Za-z0-9](?:[ -]?[A-Za-z0-9]){5,63})""", re.I)
_USER = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+(?=@)")
_HOUSE = re.compile(r"[0-9]{1,5}[A-Za-z]?(?: [A-Z][\w'.-]*){1,4} $")


def _automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for digit in "0123456789":
        made.add_word(digit, ("digit", 1))
    made.add_word("@", ("at", 1))
    made.add_word("+", ("plus", 1))
    made.add_word("://", ("scheme", 3))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            made.add_word(form, ("cue", len(form)))
    for street in STREETS:
        made.add_word(street, ("street", len(street)))
    made.make_automaton()
    return made


_ANCHORS = _automaton()


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _iban(code: str) -> bool:
    moved = code[4:] + code[:4]
    return moved.isalnum() and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _account(text: str, stop: int, cue: str) -> tuple[int, int] | None:
    """Identifier after a cue that ends at ``stop``."""
    begin = stop - len(cue)
    if begin and (text[begin - 1].isalnum() or text[begin - 1] == "_"):
        return None
    found = _VALUE.match(text, stop)
    if not found:
        return None
    start = found.start(1)
    value = found.group(1)
    if cue.lower() == "iban":
        # the value may run on into the next words: the longest whole words that pass
        for cut in sorted((m.end() for m in re.finditer(r"[A-Za-z0-9]+", value)), reverse=True):
            packed = re.sub(r"[ -]", "", value[:cut]).upper()
            if 15 <= len(packed) <= 34 and _iban(packed):
                return start, start + cut
        return None
    word = re.match(r"[A-Za-z0-9-]+", value).group(0)
    return (start, start + len(word)) if len(word) >= 6 and sum(c.isdigit() for c in word) >= 4 else None


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as a position in KINDS, end) of all spans, ordered."""
    base: list[tuple[int, int, int]] = []
    more: list[tuple[int, int, int]] = []
    mail_end = dotted_end = spaced_end = phone_end = 0
    for last, (kind, size) in _ANCHORS.iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= dotted_end:
                found = _DOTTED.match(text, at)
                dotted_end = found.end()
                groups = found.group().split(".")
                if len(groups) >= 4:
                    begin = at
                    for i in range(0, len(groups) - 3, 4):
                        part = groups[i : i + 4]
                        end = begin + sum(map(len, part)) + 3
                        if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in part):
                            base.append((begin, 1, end))
                        begin = end + 1
            if at >= spaced_end:
                found = _SPACED.match(text, at)
                spaced_end = found.end()
                if spaced_end - at >= 12:
                    digits = re.sub(r"[ -]", "", found.group())
                    if 12 <= len(digits) <= 19 and _luhn(digits):
                        base.append((at, 2, spaced_end))
        elif kind == "at":
            begin = at
            while begin > mail_end and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < at and (found := _DOMAIN.match(text, at + 1)):
                mail_end = found.end()
                base.append((begin, 0, mail_end))
        elif kind == "plus":
            if at >= phone_end and (found := _PHONE.match(text, at)):
                phone_end = found.end()
                if 9 <= sum(c in "0123456789" for c in found.group()) <= 15:
                    base.append((at, 3, phone_end))
        elif kind == "scheme":
            if found := _USER.match(text, last + 1):
                more.append((found.start(), 5, found.end()))
        elif kind == "cue":
            if found := _account(text, last + 1, text[at : last + 1]):
                more.append((found[0], 5, found[1]))
        elif last + 1 == len(text) or not text[last + 1].isalnum():
            if found := _HOUSE.search(text, max(0, at - 80), at):
                more.append((found.start(), 4, last + 1))
    base.sort()
    # a span meets another if one that starts before its end ends behind its start: the furthest end so far tells
    starts = [s for s, _, _ in base]
    furthest = list(accumulate((e for _, _, e in base), max))
    added_end = 0
    for start, kind, end in sorted(set(more)):
        before = bisect_left(starts, end)
        if start >= added_end and not (before and furthest[before - 1] > start):
            base.append((start, kind, end))
            added_end = end
    return sorted(base)


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _found(texts: pa.Array) -> pa.Array:
    rows = []
    for text in texts:
        value = text.as_py()
        rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_spans(value)] if value else [])
    return pa.array(rows, _SPANS_ARROW)


def spans(text: Column) -> Column:
    """Spans of a text, by start and then kind."""
    return F.arrow_udf(_found, _SPANS)(text)


def _masked(texts: pa.Array) -> pa.Array:
    rows = []
    for text in texts:
        value = text.as_py()
        if value:
            out, done = [], 0
            for start, kind, end in find_spans(value):
                if start >= done:
                    out += [value[done:start], f"<{KINDS[kind]}>"]
                done = max(done, end)
            value = "".join(out) + value[done:] if out else value
        rows.append(value)
    return pa.array(rows, pa.string())


def mask(text: Column) -> Column:
    """The text with every span written as its kind; overlapping spans become the first's. Null stays null."""
    return F.arrow_udf(_masked, "string")(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with masked texts, and ``n_chars``, where it is there, counted anew."""
    made = docs.withColumn("text", mask(docs["text"]))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        made = made.withColumn("n_chars", F.length("text").cast(kind))
    return made


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, digest of base spans, all spans; one row per document."""
    found = docs.select("doc_id", spans(docs["text"]).alias("found"))

    def written(which: Column) -> Column:
        one = F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(one, ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
    )
