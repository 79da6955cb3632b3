import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import frames
from threadloom.llm import pii

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def by_patterns(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = (
                True,
                all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else False,
                12 <= len(digits) <= 19 and luhn(digits),
                9 <= len(digits) <= 15,
            )[kind]
            if good:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text("a@.1 -", max_size=40), st.text("1225. -+()", max_size=40), st.text("aé@.-%_ b", max_size=30)))
def test_base_spans_are_those_of_the_patterns(text):
    assert [s for s in pii.find_spans(text) if s[1] < 4] == by_patterns(text)


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("pay to IBAN: DE89370400440532013000 now", "account", "DE89370400440532013000"),
        ('x token = "f3ef4d6b2755a36d" y', "account", "f3ef4d6b2755a36d"),
        ("see ftp://bob:pa55word@host/x", "account", "bob:pa55word"),
        ("lives at 12 Long Hill Road since", "address", "12 Long Hill Road"),
    ],
)
def test_added_spans(text, kind, value):
    assert (kind, value) in [(pii.KINDS[k], text[s:e]) for s, k, e in pii.find_spans(text)]


@pytest.mark.parametrize("text", ["tokens are nice", "IBAN: DE89370400440532013001", "the account was closed", "on the Road again"])
def test_nothing_added(text):
    assert pii.find_spans(text) == []


def test_report_and_redaction(spark):
    text = "é a.b@c.de and 10.0.0.1 x"
    rows = {r["doc_id"]: r for r in pii.report(frames.documents(spark, [text, None, ""])).collect()}
    assert (rows[0]["n_email"], rows[0]["n_ip"], rows[0]["spans"]) == (1, 1, "email:2:10,ip:15:23")
    assert rows[1]["spans"] == rows[2]["spans"] == ""
    assert rows[1]["base_sha256"] == rows[2]["base_sha256"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    got = [r["text"] for r in pii.redact(frames.documents(spark, [text, None])).orderBy("doc_id").collect()]
    assert got == ["é <email> and <ip> x", None]


def test_awkward_rows(spark):
    docs = frames.awkward(spark)
    assert pii.report(docs).count() == docs.count()
    made = pii.redact(docs)
    assert made.columns == docs.columns and made.count() == docs.count()
    assert pii.report(frames.empty(spark)).count() == 0


def test_added_spans_meet_no_other():
    rng = random.Random(4)
    cues = ["https://x.com/user1", "@", "a@b.co", "12 Main Street", "account 12345678", "IBAN DE89370400440532013000", "+1 202 555 0143", "1.2.3.4", " ", "\n", "word"]
    for _ in range(400):
        text = " ".join(rng.choice(cues) for _ in range(rng.randint(0, 12)))
        found = pii.find_spans(text)
        added = [f for f in found if f[1] >= 4]
        assert all(a is b or a[2] <= b[0] or b[2] <= a[0] for a in added for b in found)


def test_a_text_of_cues_takes_time_in_proportion():
    def seconds(n):
        text = "see 12 Main Street, mail a.b@c.de, account 12345678; " * n
        start = time.perf_counter()
        pii.find_spans(text)
        return time.perf_counter() - start

    seconds(100)
    assert seconds(16_000) < 60 * seconds(1_000) + 1
