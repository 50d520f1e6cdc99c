"""Conversation repair against a plain program over all edits."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanalign.llm import conversation_repair as R

BLANK, CUT = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")
SCHEMA = "conv_id long, turn long, role string, text string"


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        said = lambda v: " " if v is None else v
        way = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if way == 0:
            continue
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [(conv, turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    return out


def _key(conv, turn, role, text):
    own = "-" if conv is None else f"+{conv}"
    return hashlib.sha256(f"{len(own)}:{own}{len(role)}:{role}{text}".encode()).digest()[:16]


def _repair(rows):
    """Results of one conversation's rows after damage."""
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, _key(*r)))
    seen, fault = set(), []
    for _, _, role, text in rows:
        last = CUT.search(text)
        fault.append("blank" if not BLANK.search(text) else "duplicate" if (role, text) in seen else "truncated" if last.group() not in ".!?" else "")
        seen.add((role, text))
    best = {}

    def solve(i, state):
        """Least (cost, audit) from row i on."""
        ways = [(0, "")] if i == len(rows) and state in (0, 3) else []
        if i < len(rows):
            role, extra = rows[i][2][:1], fault[i] == "truncated"
            ways.append((3 + best[i + 1, state][0], "D" + best[i + 1, state][1]))
            if fault[i] not in ("blank", "duplicate"):
                nexts = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state]
                if role in nexts:
                    c, s = best[i + 1, nexts[role]]
                    ways.append((extra + c, "K" + s))
                c, s = best[i + 1, R.NEXT[state]]
                ways.append((2 + extra + c, "R" + s))
        return min(ways, default=(10 ** 9, ""))

    for i in range(len(rows), -1, -1):
        plain = {s: solve(i, s) for s in range(4)}
        for s in range(4):
            ways, c, at = [plain[s]], "", s
            for _ in range(3):
                at, c = R.NEXT[at], c + "I"
                ways.append((2 * len(c) + plain[at][0], c + plain[at][1]))
            best[i, s] = min(ways)
    cost, audit = best[0, 0]
    lines, state, at = [], 0, 0
    for edit in audit:
        if edit == "I":
            state = R.NEXT[state]
            lines.append(R.INSERTED[state] + ":")
            continue
        _, _, role, text = rows[at]
        at += 1
        if edit != "D":
            state = 1 if edit == "K" and role[0] == "s" else R.NEXT[state]
            lines.append((R.INSERTED[state] if edit == "R" else role) + ":" + text)
    turns = [t for _, t, _, _ in rows if t is not None]
    return {"n_rows": len(rows), "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{n: fault.count(n) for n in ("blank", "duplicate", "truncated")},
            "illegal": sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def _table(seed=5):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "so what", "", "  \t", "ends here. \n", "Ünï?", "\x0b", "more", "no stop  ", "a.b"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "umpire"]
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.choice([1, 2, 4, 8, 30])):
            if rng.random() < 0.9:
                rows.append((conv, None if rng.random() < 0.03 else 3 * turn, rng.choice(roles[:5] if conv and conv % 2 else roles), rng.choice([*texts, f"text {rng.random()}."])))
    rows += rows[:7]
    rows += [(500, t, ("user", "assistant")[t % 2 if t % 7 else 0], f"row {t % 50}" + "." * (t % 3 > 0)) for t in range(900)]
    rows += [(501, 4, "user", "same")] * 300 + [(502, None, None, None)] * 2
    rng.shuffle(rows)
    return rows


def _expected(rows, damage):
    groups = {c: [] for c, *_ in rows}
    for r in _damage(rows) if damage else rows:
        groups[r[0]].append(r)
    return {c: _repair(own) for c, own in groups.items()}


@pytest.mark.parametrize("damage", [True, False])
def test_equals_the_plain_program(spark, damage):
    rows = _table()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("audit", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("cost", F.lit("y")).repartition(3)
    found = {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in R.repair(df, damage).collect()}
    assert found == _expected(rows, damage)


@pytest.mark.parametrize("prime,block", [(7, 5), (R.PRIME, 1), (R.PRIME, 64)])
def test_small_blocks_and_colliding_hashes(spark, prime, block):
    rows = _damage(_table(8))
    found = {r.conv_id: (r.cost, r.audit, r.gaps, r.illegal) for r in R.audits(spark.createDataFrame(rows, SCHEMA).repartition(4), block, prime).collect()}
    want = _expected(rows, False)
    assert found == {c: (w["cost"], w["audit"], w["gaps"], w["illegal"]) for c, w in want.items()}


def test_strings_are_compared_at_their_common_prefix():
    rng = random.Random(2)
    for prime in (R.PRIME, 5):
        nodes, made = R.Nodes(room=2, prime=prime), [0]
        for _ in range(300):
            made.append(int(nodes.add(np.array([rng.choice(made[-40:])]), np.array([rng.choice(b"DIKR")], np.uint8))[0]))
        a, b = (np.array([rng.choice(made) for _ in range(2000)]) for _ in range(2))
        want = [nodes.string(x) < nodes.string(y) for x, y in zip(a.tolist(), b.tolist())]
        assert nodes.less(a, b).tolist() == want
        assert nodes.strings(a) == [nodes.string(x) for x in a.tolist()]


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "cut off"), (1, 2, "assistant", "Yes."), (2, 0, "tool", " "), (3, 0, "system", "Be kind.")]
    df = spark.createDataFrame(rows, SCHEMA)
    audited = R.audits(df)
    found = sorted(tuple(r) for r in R.repaired(df, audited).collect())
    # deleting the cut row costs as much as an insert and its point, and D comes first
    assert found == [(1, 0, "K", "user", "Hi."), (1, 1, "K", "assistant", "Yes.")]
    assert sorted((r.conv_id, r.cost, r.audit) for r in audited.collect()) == [(1, 3, "KDK"), (2, 3, "D"), (3, 3, "D")]


def test_empty_table_and_long_texts(spark):
    assert R.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, 0, "user", "word " * 60_000 + "."), (1, 1, "assistant", "x" * 300_000 + " " * 300_000)]
    (r,) = R.repair(spark.createDataFrame(rows, SCHEMA), damage=False).collect()
    want = _repair(rows)
    assert (r.audit, r.repaired_sha256) == (want["audit"], want["repaired_sha256"])
