import collections
import random
import re

import pytest

from tests.llm import frames
from threadloom.llm import quality_rules


def base(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    often = collections.Counter(zip(own, own[1:], own[2:], strict=False))
    repeated = {j + k for j in range(len(own) - 2) if often[tuple(own[j : j + 3])] > 1 for k in range(3)}
    n = len(own)
    failed = n < 50 or 100 * len(repeated) > 50 * n
    return n, sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated), failed


def awkward_texts(rng):
    for _ in range(150):
        yield "".join(rng.choice(("é", "a b", "\n", "\n\n", " ", "|", "x y z ", "\t", "#", "\u2028", "\x1c")) for _ in range(rng.randint(0, 120)))


def test_base_statistics(spark):
    rng = random.Random(19)
    texts = [*awkward_texts(rng), None, "", "\n", "a\na\na", "a b c " * 30, frames.words(rng, 200, 20)]
    rows = quality_rules.judge(frames.documents(spark, texts)).collect()
    for r in rows:
        got = tuple(r[c] for c in (*quality_rules.STATS, "base_failed"))
        assert got == base(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_outliers_of_their_group_go(spark):
    rng = random.Random(20)
    rows = []
    for i in range(1200):
        text = frames.words(rng, rng.randint(60, 200), 3000)
        bad = i % 5 == 0
        if bad:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, rng.choice(("en", None)), rng.choice(("a", "b")), 0))
    made = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, frames.DOCS)).collect()}
    assert all(made[i]["kept"] == (i % 5 != 0) for i in range(1200))


def test_moderate_junk_goes_and_mild_repetition_stays(spark):
    rng = random.Random(22)
    rows, junk = [], {}
    for i in range(1000):
        own = frames.words(rng, rng.randint(60, 300), 3000).split()
        lines = [" ".join(own[j : j + 12]) for j in range(0, len(own), 12)]
        if i % 20 == 0:  # about 10 % of the characters are separators
            lines, junk[i] = [" | ".join(" ".join(own[j : j + 2]) for j in range(0, len(own), 2))], "separators"
        elif i % 20 == 1:
            lines, junk[i] = [" ".join(w.upper() if j % 3 == 0 else w for j, w in enumerate(own))], "capitals"
        elif i % 20 == 2:
            lines, junk[i] = [" ".join(a + b for a, b in zip(own[::2], own[1::2], strict=False))], "long words"
        elif i % 20 in (3, 4):
            lines = lines + lines[: max(1, len(lines) // 6)]
        rows.append((i, "\n".join(lines), "en", "a", 0))
    made = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, frames.DOCS)).collect()}
    made = {i: r for i, r in made.items() if not r["base_failed"]}
    assert sum(i % 20 in (3, 4) for i in made) > 80
    assert [(i, junk.get(i)) for i, r in sorted(made.items()) if r["kept"] == (i in junk)] == []


def test_small_groups_are_pooled_or_left_alone(spark):
    rng = random.Random(21)
    texts = [frames.words(rng, 80, 3000) for _ in range(260)]
    rows = [(i, t + " #$%&" * 60 * (i == 7), "en", f"s{i}", 0) for i, t in enumerate(texts)] + [(900, texts[0], "fr", "x", 0)]
    made = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, frames.DOCS)).collect()}
    assert not made[7]["kept"] and made[8]["kept"]
    assert made[900]["kept"] and made[900]["distance"] is None


@pytest.mark.parametrize("main", [260, 50])
def test_a_remainder_is_judged_by_the_whole_table(spark, main):
    rng = random.Random(23)
    texts = [frames.words(rng, 120, 3000) for _ in range(main + 4)]
    rows = [(i, t + " #$%&" * 60 * (i >= main + 2), "fr" if i >= main else "en", "x", 0) for i, t in enumerate(texts)]
    made = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, frames.DOCS)).collect()}
    assert [i for i, r in made.items() if not r["kept"]] == [main + 2, main + 3]


@pytest.mark.parametrize(("p", "k", "want"), [(0.95, 1, 3.841), (0.5, 5, 4.351), (0.999, 5, 20.515)])
def test_chi_squared(p, k, want):
    assert quality_rules._chi_squared(p, k) == pytest.approx(want, abs=2e-3)
    assert quality_rules._chi_inside(want, k) == pytest.approx(p, abs=1e-3)


def test_awkward_rows(spark):
    docs = frames.awkward(spark)
    assert quality_rules.judge(docs).count() == docs.count()
    assert quality_rules.judge(frames.empty(spark)).count() == 0
