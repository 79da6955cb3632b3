import hashlib
import itertools
import random
import re
import zlib

import pytest

from threadloom.llm import conversation_repair as C
from threadloom.llm import registry

WANTED = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


# --- a second solution: shortest paths that carry their letters ----------------


def moves(state):
    return {0: 2, 1: 2, 2: 3, 3: 2}[state]


def keeps(role, state):
    return {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role, state))


def cheapest(faults):
    """(cost, audit) of rows (role initial, fault) by a search over (rows used, state)."""
    best = {0: (0, "")}

    def inserted(best):
        for _ in range(4):
            for s, (cost, audit) in list(best.items()):
                offer = (cost + 5, audit + "I")
                best[moves(s)] = min(best.get(moves(s), offer), offer)
        return best

    for role, fault in faults:
        after = {}
        for s, (cost, audit) in inserted(best).items():
            offers = [(cost + 2, audit + "D", s)]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                offers.append((cost + 1 + more, audit + "R", moves(s)))
                if keeps(role, s) is not None:
                    offers.append((cost + more, audit + "K", keeps(role, s)))
            for c, a, t in offers:
                after[t] = min(after.get(t, (c, a)), (c, a))
        best = after
    return min(v for s, v in inserted(best).items() if s in (0, 3))


def enumerated(faults):
    """The same by trying every sequence of letters with at most two inserts before each row."""
    found = []
    choices = [[i + x for i in ("", "I", "II") for x in ("D" if f in ("blank", "duplicate") else "DKR")] for _, f in faults]
    for parts in itertools.product(*choices, ["", "I", "II"]):
        audit, roles, cost, row = "".join(parts), "", 0, 0
        for letter in audit:
            if letter in "IR":
                roles += "a" if roles.endswith("u") else "u"
            cost += {"I": 5, "D": 2, "R": 1, "K": 0}[letter]
            if letter != "I":
                role, fault = faults[row]
                row += 1
                roles += role if letter == "K" else ""
                cost += 5 if fault == "truncated" and letter != "D" else 0
        if WANTED.fullmatch(roles):
            found.append((cost, audit))
    return min(found)


def hurt(rows):
    """Rows after damage."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        out += [(conv, turn, role, text)] * (2 if code == 3 else 1)
    return out


def brute(rows, damage=True):
    out = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in hurt(rows) if damage else rows:
        out[conv].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    made = {}
    for conv, turns in out.items():
        turns.sort()
        seen, faults = set(), []
        for _, _, role, text in turns:
            bare = text.strip(BLANKS)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append((role[:1], fault))
        known = [t for timed, t, *_ in turns if timed]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [f[0] for f in faults]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(faults)
        left, state, kept = iter(turns), 0, []
        for letter in audit:
            if letter == "I":
                state = moves(state)
                kept.append(("user" if state == 2 else "assistant") + ":")
                continue
            _, _, role, text = next(left)
            if letter == "K":
                state = keeps(role[:1], state)
                kept.append(f"{role}:{text}")
            elif letter == "R":
                state = moves(state)
                kept.append(("user" if state == 2 else "assistant") + f":{text}")
        count = {f: sum(x == f for _, x in faults) for f in ("blank", "duplicate", "truncated")}
        sha = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        made[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha)
    return made


def found(frame):
    return {
        r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"])
        for r in frame.collect()
    }


def symbol(role, fault):
    return 0 if fault in ("blank", "duplicate") else 1 + 2 * {"s": 0, "u": 1, "a": 2}.get(role, 3) + (fault == "truncated")


def test_both_searches_agree():
    rng = random.Random(1)
    kinds = [(r, f) for r in "suat" for f in ("", "truncated", "blank")]
    for n in range(5):
        for _ in range(25):
            faults = [rng.choice(kinds) for _ in range(n)]
            assert cheapest(faults) == enumerated(faults)


def test_runs_equal_the_search_row_by_row():
    rng = random.Random(2)
    kinds = [(r, f) for r in "suat" for f in ("", "truncated", "blank")]
    for _ in range(300):
        faults = [k for k in (rng.choice(kinds) for _ in range(rng.randint(0, 8))) for _ in range(rng.choice([1, 1, 2, 3, 7]))]
        runs = [(k, len(list(g))) for k, g in itertools.groupby(symbol(*f) for f in faults)]
        assert C.solve([k for k, _ in runs], [n for _, n in runs]) == cheapest(faults)


@pytest.mark.parametrize("n", [1, 64, 65, 127, 128, 129, 1000])
def test_long_runs(n):
    for kind in (("u", ""), ("a", ""), ("u", "truncated"), ("s", ""), ("t", ""), ("u", "blank")):
        runs = ([3, symbol(*kind), 5], [1, n, 1])
        assert C.solve(*runs) == cheapest([("u", ""), *[kind] * n, ("a", "")])


def test_a_run_of_a_million_rows():
    cost, audit = C.solve([symbol("u", "")], [1_000_000])
    assert (cost, len(audit), set(audit)) == (500_000, 1_000_000, {"K", "R"})


def talk(rng, convs):
    rows = []
    texts = ["Hi.", "Well?", "no end", "So! ", " ", "", None, "Same text.", "é ü.\n", "ok."]
    for conv in range(convs):
        turn = 0
        for _ in range(rng.randint(0, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(texts) if rng.random() < 0.6 else f"text {rng.randrange(10**6)}."
            rows.append((conv, rng.choice([turn, turn, turn, turn, None]), role, text))
            turn += rng.choice([0, 1, 1, 1, 2])
    return rows


def test_damaged_conversations_equal_brute_force(spark):
    rng = random.Random(5)
    rows = talk(rng, 300)
    rows += [(None, *r[1:]) for r in rows[:7]] + rows[20:30] + [(1000, t, "user", "x.") for t in range(40)]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert found(C.report(turns)) == brute(rows)


def test_conversations_cut_over_tasks(spark):
    """Few conversations on eight tasks: pieces are stitched, equal rows and turns across cuts too."""
    rng = random.Random(8)
    rows = [(i % 2, rng.randrange(300), rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "c!", f"{i}."])) for i in range(3_000)]
    rows += [(0, 5, "user", "copy.")] * 500
    turns = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(C.report(turns)) == brute(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "A."), (1, 1, "user", "B."), (1, 2, "user", ""), (1, 3, "system", "C."), (2, 0, "assistant", "D.")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", audit string").withColumnRenamed("audit", "mark")
    kept = {1: [], 2: []}
    for conv, _, role, text in sorted(tuple(r) for r in C.repaired(turns).collect()):
        kept[conv].append(f"{role}:{text}")
    wanted = brute(rows, damage=False)
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in kept.items()} == {c: v[7] for c, v in wanted.items()}
    cost = {r["conv_id"]: r["cost"] for r in C.repairs(turns).collect()}
    assert cost == {c: v[5] for c, v in wanted.items()}


def test_clashing_columns_and_empty_table(spark):
    rows = talk(random.Random(9), 20)
    turns = spark.createDataFrame(rows, SCHEMA)
    for name in ("mark", "copies", "fault", "code", "audit", "piece", "h1"):
        turns = turns.withColumn(name, turns["role"])
    assert found(C.report(turns)) == brute(rows)
    assert C.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_conversation_that_damage_empties(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = C.report(spark.createDataFrame([(gone, 0, "user", "x.")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(registry.QUERIES["op13_conversation_repair"](spark, folder)) == brute(rows)
