"""Conversation repair against a plain programme over all states, the SQL, and the edge cases."""

import hashlib
import random
import re
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from pulseframe.llm import conversations as C
from pulseframe.llm.oracles import OP11_SQL

TURNS = "conv_id long, turn long, role string, text string"


def brute(turns):
    """(cost, audit) by trying every edit everywhere, the best (cost, audit) of each (turn, what the roles spell) kept."""
    legal = re.compile(r"(s?(ua)*u?)?")
    best = {"": (0, "")}

    def grown(ways):
        todo = list(ways)
        while todo:
            said = todo.pop()
            for c in "ua":
                cost, audit = ways[said]
                if legal.fullmatch(said + c) and len(said) < 3 and ways.get(said + c, (99e9, "")) > (cost + 3, audit + "I"):
                    ways[said + c] = cost + 3, audit + "I"
                    todo.append(said + c)
        return ways

    def short(said):  # only how it ends counts: "", s, u, ua
        return said if said in ("", "s") else ("u" if said[-1] == "u" else "ua")

    best = grown(best)
    for role, kind in turns:
        new = {}

        def put(said, way, new=new):
            said = short(said)
            new[said] = min(new.get(said, way), way)

        for said, (cost, audit) in best.items():
            put(said, (cost + 4, audit + "D"))
            if kind != C.LOST:
                extra = 3 if kind == C.CUT else 0
                if legal.fullmatch(said + role) and role:
                    put(said + role, (cost + extra, audit + "K"))
                for c in "ua":
                    if legal.fullmatch(said + c):
                        put(said + c, (cost + extra + 3, audit + "R"))
        best = {}
        for said, way in grown(new).items():
            best[short(said)] = min(best.get(short(said), way), way)
    return min(w for s, w in best.items() if s in ("", "ua"))


def test_search_is_the_least(monkeypatch):
    rng = random.Random(5)
    for k in range(3000):
        turns = [(rng.choice("usa" if k % 3 else "usax"), rng.choices((C.SOUND, C.LOST, C.CUT), (6, 2, 2))[0]) for _ in range(rng.randrange(0, 9))]
        (found,) = C.search(turns).values()
        assert found == brute(turns), turns


@pytest.mark.parametrize("segment", [1, 2, 3, 7])
def test_segments_change_nothing(monkeypatch, segment):
    monkeypatch.setattr(C, "SEGMENT", segment)
    rng = random.Random(segment)
    for k in range(600):
        kinds = [(rng.choice(("usa", "s", "ssu", "xu")[k % 4]), rng.choices((C.SOUND, C.LOST, C.CUT), ((6, 2, 2), (1, 8, 1), (1, 1, 8))[k % 3])[0]) for _ in range(rng.randrange(0, 40))]
        wrote = []
        repair = C.Repair(lambda *x, wrote=wrote: wrote.append(x))
        for i, (role, kind) in enumerate(kinds):
            repair.add(i, role, "t", kind)
        assert repair.end() == brute(kinds)
        roles = "".join(role[:1] for _, edit, role, _ in wrote if edit != "D")
        assert re.fullmatch(r"(s?(ua)+)?", roles)
        assert [t for t, edit, _, _ in wrote if edit != "I"] == list(range(len(kinds)))


def test_long_conversations_are_settled_on_the_way():
    """What is held stays far below a conversation's length."""
    rng, held = random.Random(1), 0
    for roles, weights in (("ua", (8, 1, 1)), ("s", (1, 1, 1)), ("uas", (0, 1, 0)), ("s", (0, 0, 1))):
        repair = C.Repair(lambda *x: None)
        for i in range(20_000):
            repair.add(i, roles[i % len(roles)] if rng.random() < 0.9 else "u", "t", rng.choices((C.SOUND, C.LOST, C.CUT), weights)[0])
            held = max(held, len(repair.held))
        assert len(repair.end()[1]) >= 20_000
    assert held < 4 * C.SEGMENT


def rows_at_random(n, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        turn = 0
        for _ in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "User"] if conv % 4 == 0 else ["user", "assistant"])
            text = rng.choice(["Yes.", "Yes.", "no", "", " \t\n", None, "What?! ", "a b", "Ünd.\n", "x" * 3000 + ".", "“so.”"])
            rows.append((conv, None if rng.random() < 0.05 else turn, role, text))
            turn += rng.choice([0, 1, 1, 1, 3])
    return rows + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, None, None, None)] + rows[:7]


def test_query_matches_the_sql_on_odd_rows(spark, tmp_path):
    rows = rows_at_random(400, 9)
    df = spark.createDataFrame(rows, TURNS)
    df.withColumn("audit", F.lit("x")).withColumn("again", F.lit(1)).write.parquet(str(tmp_path / "conversations.parquet"))
    got = C.op11_conversation_repair(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(OP11_SQL)
    assert got.columns == list(want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_repaired_turns_hash_to_the_report(spark):
    df = spark.createDataFrame(rows_at_random(60, 3), TURNS)
    edits, by = C.repaired(df).collect(), {}
    for r in sorted(edits, key=lambda r: r.place):
        by.setdefault(r.conv_id, []).append(r)
    for r in C.report(df).collect():
        own = by[r.conv_id]
        assert [x.place for x in own] == list(range(len(own))) and "".join(x.edit for x in own) == r.audit
        said = [f"{x.role}:{x.text}" for x in own if x.edit != "D"]
        assert hashlib.sha256("\n".join(said).encode()).hexdigest() == r.repaired_sha256


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    got = {}
    for r in C.damaged(spark.createDataFrame(rows, TURNS)).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.absent))
    for conv, turn, role, text in rows:
        hit = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        want = {0: [(role, text, True)], 1: [(role, "", False)], 2: [(role, text.translate(str.maketrans("", "", ".!?")), False)], 3: [(role, text, False)] * 2, 4: [("user", text, False)]}
        assert got[conv, turn] == want.get(hit, [(role, text, False)])


def test_no_turns(spark):
    none = C.report(spark.createDataFrame([], TURNS))
    assert none.count() == 0 and none.columns[0] == "conv_id"
    gone = spark.createDataFrame([(7, 0, "user", "x", True)], TURNS + ", absent boolean")
    assert tuple(C.report(gone, absent="absent").first()) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert C.repaired(spark.createDataFrame([], TURNS)).count() == 0
