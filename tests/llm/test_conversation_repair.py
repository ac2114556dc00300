"""Repair against a plain search over all edits, and against a plain reading of the rules."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from llm import conversation_repair as repair
from llm.queries import op13

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def plain(rows):
    """The least (cost, audit, result) over all ways to edit; at most one insertion between edits."""
    best = None
    options = []
    for role, text, fault in rows:
        own = [("D", 3, None)]
        if fault not in ("blank", "duplicate"):
            late = fault == "truncated"
            own += [("K", late, (role, text)), ("R", 2 + late, ("user", text)), ("R", 2 + late, ("assistant", text))]
        options.append(own)
    gap = [[], ["user"], ["assistant"], ["user", "assistant"]]
    for gaps in itertools.product(gap, repeat=len(rows) + 1):
        for edits in itertools.product(*options):
            audit, cost, out = "", 0, []
            for k in range(len(rows) + 1):
                for role in gaps[k]:
                    audit, cost = audit + "I", cost + 2
                    out.append((role, ""))
                if k < len(rows):
                    letter, c, row = edits[k]
                    audit, cost = audit + letter, cost + c
                    out += [row] if row else []
            initials = [r[:1] for r, _ in out]
            if all(len(i) == 1 for i in initials) and GRAMMAR.fullmatch("".join(initials)):
                way = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
                best = way if best is None or way[:2] < best[:2] else best
    return best


def faults(rows):
    """(role, text, fault) by the words of the contract."""
    seen, out = set(), []
    for role, text in rows:
        signs = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not signs else "duplicate" if (role, text) in seen else None if signs[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def damage(rows):
    out = []
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", hashlib.md5((" " if r[3] is None else r[3]).encode()).hexdigest())):
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        out += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def expected(conv, rows):
    rows = damage(rows)
    found = faults([r[1:] for r in rows])
    cost, audit, text = plain(found)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = zip(rows, rows[1:])
    illegal = sum((a[1][:1], b[1][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in pairs)
    count = lambda kind: sum(f == kind for _, _, f in found)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def conversations(n, most, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "sage", "User"]
    texts = ["Yes.", "No", "No", "Why?", " \t", "", None, "end. ", "x!\x0b", "é…", "a.b"]
    rows = []
    for conv in [*range(n), None]:
        turn = rng.choice([0, 5])
        for _ in range(rng.randint(1, most)):
            turn += rng.choice([0, 1, 1, 1, 3])
            rows.append((conv, None if rng.random() < 0.08 else turn, rng.choice(roles), rng.choice(texts)))
    return rows


def test_integer_minimum_is_the_plain_search():
    rng = random.Random(1)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), "x", rng.choice([None, None, "truncated", "blank", "duplicate"])) for _ in range(rng.randint(0, 3))]
        got = repair.cheapest([(r[:1], f in ("blank", "duplicate"), f == "truncated") for r, _, f in rows])
        assert got == plain(rows)[:2], rows


def test_repaired_conversations(spark, tmp_path):
    rows = conversations(150, 4, 3)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"cost": F.lit("clash"), "phase": F.lit(1), "audit": F.lit(None).cast("int")})
    df.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, op13(spark, str(tmp_path)).collect()), key=str)
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert got == sorted((expected(conv, own) for conv, own in groups.items()), key=str)


def test_without_damage_and_without_rows(spark):
    df = spark.createDataFrame([(1, 0, "system", "S."), (1, 1, "assistant", "A."), (2, 0, "user", "u?"), (2, 1, "assistant", "a!")], SCHEMA)
    got = {r.conv_id: (r.cost, r.audit, r.illegal) for r in repair.repaired(df).collect()}
    assert got == {1: (2, "KIK", 1), 2: (0, "KK", 0)}
    assert repair.repaired(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [500, 3000])
def test_long_conversations_read_the_grammar(spark, n):
    rng = random.Random(n)
    rows = [(7, k, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", f"{k}.", f"{k}"])) for k in range(n)]
    (got,) = repair.repaired(spark.createDataFrame(rows, SCHEMA)).collect()
    assert got.cost == repair.cheapest([(r[:1], f in ("blank", "duplicate"), f == "truncated") for r, _, f in faults([r[2:] for r in rows])])[0]
    # what the audit costs is the cost
    found, at, cost = faults([r[2:] for r in rows]), 0, 0
    for letter in got.audit:
        cost += {"D": 3, "I": 2, "K": 0, "R": 2}[letter]
        if letter != "I":
            cost += letter != "D" and found[at][2] == "truncated"
            at += 1
    assert at == n and cost == got.cost
