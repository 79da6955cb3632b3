"""Cleaning and gates on strings with known results, and against Python's re."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom import fixed_values as V
from threadloom.functions import text as X

ACCOUNTS = ("VirginAmerica", "AmazonHelp", "AppleSupport", "SpotifyCares")
CLEANED = [
    (
        "Hello @884213 your parcel left the depot see https://track.example.org/p We're glad to help. ^KM",
        "Hello <usr> your parcel left the depot see <url> We're glad to help. <sig>",
        None,
    ),
    ("Please write to our Billing Office", "Please write to our Billing Office", "Please write to our Billing<sig>"),
    (
        "@VirginAmerica is row 9 free! Maps at https://seats.example.org/map they're neat! Call @2204417",
        "<bot> is row 9 free! Maps at <url> they're neat! Call <usr>",
        None,
    ),
    ("こんにちは世界！また明日", "", None),
    ("@1115679 hello", "@<phone> hello", None),
    ("@115712 hello", "<usr> hello", None),
    ("call +1 (800) 555-1234 now", "call 1 <phone> now", None),
    ("a, b; c &amp; d", "a b c &amp d", None),
    ("ok Friday", "ok Friday", "ok<sig>"),
    ("@AmazonHelp help me^AB", "<bot> help me<sig>", None),
    ("bye -JB\n", "bye <sig>", "bye<sig>"),
    ("bye -JB\r", "bye -JB", None),
    ("trail ^JÉ", "trail <sig>", "trail <sig>"),
    ("", "", None),
]


def column(spark, texts, expression):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = rows.select("i", expression("text").alias("out")).collect()
    return [r.out for r in sorted(found, key=lambda r: r.i)]


def test_clean_text_strict(spark):
    got = column(spark, [c[0] for c in CLEANED], lambda t: X.clean_text(t, ACCOUNTS))
    assert got == [c[1] for c in CLEANED]


def test_clean_text_loose(spark):
    cases = [c for c in CLEANED if c[2] is not None]
    got = column(spark, [c[0] for c in cases], lambda t: X.clean_text(t, ACCOUNTS, "loose"))
    want = [python_clean(c[0], loose=True) for c in cases]
    assert got == want


def test_no_accounts_leaves_handles(spark):
    assert column(spark, ["@AmazonHelp hi"], X.clean_text) == ["@AmazonHelp hi"]


def test_account_names_are_quoted(spark):
    got = column(spark, ["@a.b @axb"], lambda t: X.clean_text(t, ["a.b"]))
    assert got == ["<bot> @axb"]


def python_clean(text, loose=False):
    """The substitutions with Python's own engine, for comparison."""
    word = r"[\p{L}\p{N}_]"
    signature = V.SIGNATURE_PATTERNS["loose" if loose else "strict"]
    steps = [
        (V.URL_PATTERN, V.URL_TOKEN),
        (V.PHONE_PATTERN, V.PHONE_TOKEN),
        (V.USER_PATTERN, V.USER_TOKEN),
        ("(@(" + "|".join(ACCOUNTS) + "))", V.BOT_TOKEN),
        (signature, V.SIGNATURE_TOKEN),
        (V.DISALLOWED_PATTERN, ""),
    ]
    for pattern, to in steps:
        pattern = pattern.removeprefix("(?Ud)").removeprefix("(?d)").replace(word, r"\w")
        text = re.sub(pattern, to, text)
    return text.strip()


FRAGMENTS = st.sampled_from(
    ["https://a.co/x?y=1", "http://www.é.com", "@12345", "@AmazonHelp", "+1 (800) 555-1234",
     "1234567890", " -Kim", "^AB", "/ Jó", "É", "ñ_9", "\n", "\r", " ", " ", " ",
     ",", ";", "&amp;", "<url>", "<foo>", "el", "ok", "Z", "\U0001f600", "x.y", "٣", "K"]
)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(FRAGMENTS, max_size=9).map("".join), min_size=40, max_size=80))
def test_clean_text_equals_python(spark, texts):
    got = column(spark, texts, lambda t: X.clean_text(t, ACCOUNTS))
    assert got == [python_clean(t) for t in texts]


@pytest.mark.parametrize("threshold", [0.4])
def test_english(spark, threshold):
    texts = ["Hello my name is bert", "おいいいいい！", "", None, "abcd123456", "abcde12345"]
    got = column(spark, texts, lambda t: X.is_english(t, threshold))
    assert got == [True, False, False, False, False, True]


def test_spanish(spark):
    texts = ["Hello", "El gato", "LA trip", "_el_", "delta", "mı", "porqué", "en.", "mío"]
    got = column(spark, texts, X.has_spanish)
    pattern = re.compile(r"\b({})\b".format("|".join(V.SPANISH_WORDS)), re.IGNORECASE)
    assert got == [pattern.search(t) is not None for t in texts]
    assert got[:6] == [False, True, True, False, False, True]


def test_placeholder_split(spark):
    text = "hi <usr> a<foo>b <phone> x"
    assert column(spark, [text], X.text_pieces) == [["hi ", " a", "b ", " x"]]
    assert column(spark, [text], X.placeholder_tokens) == [["<usr>", "<foo>", "<phone>"]]
    assert column(spark, ["plain"], X.text_pieces) == [["plain"]]


def test_word_count_keeps_double_blanks(spark):
    assert column(spark, ["a  b c", "a", ""], X.word_count) == [4, 1, 1]
