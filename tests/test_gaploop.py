"""The gap loop against the same in plain Python, with feedback, breaks and all six rules."""

import pytest

from siltstone.operators.gaploop import Loop


def by_hand(gaps, propose, search, least, repeated, budget, most):
    out, state = [], {g: (0, 0) for g in gaps}
    asked, found = {g: set() for g in gaps}, {g: set() for g in gaps}
    for turn in range(1, most + 1):
        for g in list(state):
            proposed = {q for q in propose(turn, g, found[g]) if q is not None}
            new = proposed - asked[g]
            gain = {e for q in new for e in search(g, q) if e is not None} - found[g]
            covered, spent = state[g][0] + len(gain), state[g][1] + len(new)
            stop = next((n for n, r in (("target_reached", gaps[g] is not None and covered >= gaps[g]), ("no_source_left", not proposed), ("repeating", len(proposed) - len(new) > repeated * len(proposed)), ("no_new_evidence", len(gain) < least), ("budget_exhausted", spent >= budget), ("limit_reached", turn >= most)) if r), None)
            out.append((g, turn, len(proposed), len(new), len(gain), covered, spent, stop))
            asked[g] |= new
            found[g] |= gain
            state[g] = covered, spent
            if stop:
                del state[g]
    return sorted(out)


GAPS = {"target": 4, "dry": 99, "none": 99, "again": 99, "dear": 99, "long": None}
# gap, turn, query
ASKS = [("target", 1, 1), ("target", 2, 2), ("target", 3, 3), ("dry", 1, 1), ("dry", 2, 50), ("none", 1, 1), ("again", 1, 1), ("again", 2, 1), ("again", 2, 2), ("again", 2, 60), ("again", 3, 1), ("again", 3, 2), ("again", 3, 61), ("dear", 1, 1), ("dear", 2, 2), ("dear", 2, 3), ("dear", 2, 4), ("dear", 2, 5), ("dear", 2, 6)]
ASKS += [("long", t, t) for t in range(1, 9)] + [("long", 1, None), ("unknown", 1, 1), ("target", 1, 1)]
HITS = [(q, q * 10 + k) for q in range(1, 9) for k in range(2)] + [(1, 20), (60, 600), (61, 610), (5, None)]


def loop(spark, path, search=None, **limits):
    asks = spark.createDataFrame(ASKS, "gap string, turn int, query int")
    hits = spark.createDataFrame(HITS, "query int, evidence int")
    gaps = spark.createDataFrame([*GAPS.items(), (None, 1), ("target", 1)], "gap string, target int")
    return Loop(spark, str(path), gaps, lambda turn, open_: asks.filter(asks.turn == turn), search or (lambda new: new.join(hits, "query")), **limits)


LIMITS = {"least": 1, "repeated": 0.5, "budget": 6, "most": 4}


def told(rows):
    return sorted(tuple(r) for r in rows.select("gap", "turn", "proposed", "asked", "gained", "covered", "spent", "stop").collect())


def want():
    return by_hand(GAPS, lambda turn, g, _: {q for a, t, q in ASKS if a == g and t == turn}, lambda g, q: {e for x, e in HITS if x == q}, **LIMITS)


def test_six_rules(spark, tmp_path):
    got = told(loop(spark, tmp_path, **LIMITS).run())
    assert got == want()
    assert {r[0]: r[-1] for r in got if r[-1]} == {"target": "target_reached", "dry": "no_new_evidence", "none": "no_source_left", "again": "repeating", "dear": "budget_exhausted", "long": "limit_reached"}


def test_goes_on_where_it_broke_off(spark, tmp_path):
    calls = []

    def breaks(new):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("a lost driver")
        return new.join(spark.createDataFrame(HITS, "query int, evidence int"), "query")

    with pytest.raises(RuntimeError, match="lost driver"):
        loop(spark, tmp_path, breaks, **LIMITS).run()
    again = loop(spark, tmp_path, **LIMITS)
    assert again.turns() == 1 and told(again.run()) == want()
    assert told(loop(spark, tmp_path, **LIMITS).run()) == want() and again.turns() == 4  # nothing is left to do


def test_queries_from_what_was_found(spark, tmp_path):
    """Each turn asks for what the turn before found."""
    edges = {1: [2, 3], 2: [4, 5], 3: [5, 6], 4: [1, 7], 5: [8], 6: [9, 9], 7: [10]}
    hits = spark.createDataFrame([(q, e) for q, es in edges.items() for e in es], "query long, evidence long")
    gaps = spark.createDataFrame([("g", 100)], "gap string, target int")
    own = Loop(spark, str(tmp_path), gaps, None, lambda new: new.join(hits, "query"), most=9)
    own.propose = lambda turn, open_: open_.selectExpr("gap", "1L query") if turn == 1 else own.rows("found").filter(f"turn = {turn - 1}").selectExpr("gap", "evidence query")
    got = told(own.run())
    by_turn = {}

    def propose(turn, g, found):
        by_turn[turn] = set(found)
        return {1} if turn == 1 else by_turn[turn] - by_turn[turn - 1]

    assert got == by_hand({"g": 100}, propose, lambda g, q: edges.get(q, []), 1, 0.5, 1000, 9) and len(got) > 3


def test_no_gaps(spark, tmp_path):
    none = Loop(spark, str(tmp_path), spark.createDataFrame([], "gap string, target int"), None, None)
    assert none.run().count() == 0
