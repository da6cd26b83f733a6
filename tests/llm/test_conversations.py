"""Conversation repair against a plain forward search over all edits."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textmill.llm.conversations import END, digests, edits, power, repair, repaired, runs_of, transition

WS = " \t\n\x0b\x0c\r"
LEGAL = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        inner = text.rstrip(WS)
        out.append("blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, lines) by keeping the best of each state, turn by turn."""
    def inserted(best):
        for _ in range(2):
            for s, (c, a, x) in list(best.items()):
                for role in ("user", "assistant"):
                    t = LEGAL.get((s, role[0]))
                    if t and (c + 5, a + "I") < best.get(t, (10**9,))[:2]:
                        best[t] = (c + 5, a + "I", [*x, role + ":"])
        return best

    best = inserted({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, found):
        new, late = {}, 5 * (fault == "truncated")
        for s, (c, a, x) in best.items():
            ways = [(s, 2, "D", [])]
            if fault not in ("blank", "duplicate"):
                ways += [(LEGAL.get((s, role[:1])), late, "K", [f"{role}:{text}"])]
                ways += [(LEGAL.get((s, r[0])), late + 1, "R", [f"{r}:{text}"]) for r in ("user", "assistant")]
            for t, cost, letter, line in ways:
                if t is not None and (c + cost, a + letter) < new.get(t, (10**9,))[:2]:
                    new[t] = (c + cost, a + letter, x + line)
        best = inserted(new)
    return min((best[s] for s in ("", "a") if s in best), key=lambda b: b[:2])


def brute(turns):
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        found = faults(rows)
        known = [r[0] for r in rows if r[0] is not None]
        cost, audit, body = cheapest(rows, found)
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        c = Counter(found)
        out[conv] = (gaps, c["blank"], c["duplicate"], c["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(body).encode()).hexdigest())
    return out


def conversations(n):
    r = random.Random(n)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ubuntu", "User"], ["Yes.", "no", "What?", "", " \t\n", None, "Well!\n", "a.b", "é。", "x" * 3000 + "."]
    out = [(k, r.choice([None, r.randrange(12), t, t, t]), r.choice(roles), r.choice([*texts, f"It is {r.random()}.", f"Is it {r.random()}"])) for k in range(n) for t in range(r.randrange(1, 14))]
    out += [(None, t, ("user", "assistant")[t % 2], f"t{t}.") for t in range(9)]
    return out + r.sample(out, len(out) // 10)


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block_turns", [2, 5, 65_536])
def test_repair_against_brute_force(spark, block_turns):
    turns = conversations(120)
    df = spark.createDataFrame(turns, SCHEMA).withColumn("k", F.lit("x")).withColumn("conv", F.lit(1)).withColumn("a-b", F.lit(1))
    done = repair(df, block_turns=block_turns)
    want = brute(turns)
    got = {(None if r["conv"] == " " else int(r["conv"])): tuple(r)[1:] for r in digests(done).collect()}
    assert got == want


def test_repaired_conversations_are_legal(spark):
    turns = conversations(60)
    rows = sorted(map(tuple, repaired(spark.createDataFrame(turns, SCHEMA)).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    want = brute(turns)
    for conv, own in itertools.groupby(rows, lambda r: r[0]):
        own = list(own)
        body = "\n".join(f"{r[3]}:{r[4]}" for r in own)
        assert hashlib.sha256(body.encode()).hexdigest() == want[conv][-1]
        initials = "".join(r[3][0] for r in own)
        assert initials.lstrip("s").replace("ua", "") == "" and initials.count("s") <= 1


def test_powers_of_a_run_are_its_turns_one_by_one():
    for symbol in "suaoSUAOx":
        for n in (1, 2, 3, 7, 40):
            assert (transition(((symbol, n),)) == transition(tuple((symbol, 1) for _ in range(n)))).all()
        assert (power(symbol, 3) == transition(((symbol, 8),))).all()
    done, state = edits(runs_of("u" * 3000), tuple(END.tolist()))
    assert len(done) == 3000 and state in (0, 3)


def test_one_long_conversation_in_many_blocks(spark):
    r = random.Random(5)
    turns = [(1, t, r.choice(["user", "assistant"]), f"turn {t}{r.choice('. .!')}") for t in range(3000)] + [(2, 0, "user", "Hi.")]
    got = {int(x["conv"]): tuple(x)[1:] for x in digests(repair(spark.createDataFrame(turns, SCHEMA), block_turns=64)).collect()}
    assert got == brute(turns)


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repair(df).collect() == [] and digests(repair(df)).collect() == [] and repaired(df).collect() == []
