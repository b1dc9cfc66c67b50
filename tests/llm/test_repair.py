import itertools
import random
import re

from fluxline.llm import repair

COST = {"K": 0, "R": 2, "D": 3, "I": 2}


def every_edit(roles, faults):
    """(cost, audit, initials kept and made) of all edits of a short conversation with at most one and a half inserts a turn."""
    n = len(roles)
    for length in range(n, 2 * n + 3):
        for audit in itertools.product("DIKR", repeat=length):
            if length - audit.count("I") != n:
                continue
            for free in itertools.product("ua", repeat=audit.count("I") + audit.count("R")):
                made, place, cost, ok, choice = "", 0, 0, True, iter(free)
                for e in audit:
                    cost += COST[e]
                    if e == "I":
                        made += next(choice)
                        continue
                    fault, role, place = faults[place], roles[place], place + 1
                    if e == "D":
                        continue
                    ok = ok and fault not in ("blank", "duplicate") and (e == "R" or role != "")
                    cost += fault == "truncated"
                    made += role if e == "K" else next(choice)
                if ok and re.fullmatch("(s?(ua)+)?", made):
                    yield cost, "".join(audit)


def test_cheapest_edits_equal_all_edits():
    rng = random.Random(5)
    for _ in range(120):
        n = rng.randrange(0, 4)
        roles = [rng.choice(["s", "u", "a", "t", ""]) for _ in range(n)]
        faults = [rng.choice(["", "", "truncated", "blank", "duplicate"]) for _ in range(n)]
        cost, audit, kept = repair.cheapest(roles, faults)
        assert (cost, audit) == min(every_edit(roles, faults)), (roles, faults)
        made = "".join(s or roles[i] for i, s in kept)
        assert re.fullmatch("(s?(ua)+)?", made)


def test_long_conversations_are_linear():
    rng = random.Random(6)
    roles = [rng.choice("uast") for _ in range(30_000)]
    cost, audit, kept = repair.cheapest(roles, [""] * len(roles))
    assert len(audit) - audit.count("I") == len(roles) and re.fullmatch("s?(ua)+", "".join(s or roles[i] for i, s in kept))
    assert cost == 3 * audit.count("D") + 2 * audit.count("I") + 2 * audit.count("R")


def test_faults():
    turns = [("user", "Hi."), ("assistant", "so \n"), ("user", "Hi."), ("user", " \t"), ("user", ""), ("assistant", "ok! "), ("assistant", "so \n")]
    assert repair.faults_of(turns) == ["", "truncated", "duplicate", "blank", "blank", "", "duplicate"]


def test_odd_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 2, "assistant", "Yes."), (2, None, None, None), (None, 1, "user", "Who?"), (3, 5, "", "x."), (4, 1, "user", "Hi."), (4, 1, "user", "Hi."), (5, 7, "system", "Be good."), (5, 9, "user", "w " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS audit", "2 AS turns")
    got = {r.conv_id: r for r in repair.repair(repair.undamaged(df)).collect()}
    assert (got[1].gaps, got[1].cost, got[1].audit) == (1, 0, "KK")
    assert (got[2].gaps, got[2].blank, got[2].cost, got[2].audit, got[2].repaired) == (0, 1, 3, "D", [])
    assert (got[None].cost, got[None].audit, [(t.role, t.text) for t in got[None].repaired]) == (2, "KI", [("user", "Who?"), ("assistant", "")])
    assert (got[3].cost, got[3].audit) == (3, "D")
    assert (got[4].gaps, got[4].duplicate, got[4].cost, got[4].audit) == (0, 1, 5, "KDI")
    assert (got[5].gaps, got[5].truncated, got[5].illegal, got[5].audit) == (1, 1, 0, "KKI")
    assert repair.repair(repair.damage(df.limit(0))).count() == 0
    assert repair.repair(repair.damage(df)).count() == 6


def test_damage_is_as_dealt(spark):
    import zlib

    rows = [(c, t, "assistant", "A! B? c.") for c in range(40) for t in range(5)]
    got = {(r.conv_id, r.turn): r.copies for r in repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).selectExpr("conv_id", "copies", "get(copies, 0).turn AS turn").collect()}
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        want = [("user" if kind == 4 else role, {1: "", 2: "A B c"}.get(kind, text))] * {0: 0, 3: 2}.get(kind, 1)
        assert [(x.role, x.text) for x in got.get((c, t), [])] == want
