"""Tables of similarities, candidates beside anchors, and queries that once made a row for each three of a query, a candidate and an anchor."""

import collections
import random

import numpy as np
import pytest

from matchloom.functions import similarity as S
from matchloom.functions import tables as TB
from matchloom.operators import decide as D
from matchloom.operators.beside import asked, best_beside

SF = "/root/testdata/sf0.01"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def texts(seed: int) -> list[str]:
    r = random.Random(seed)
    words = ["http", "ab", "abc", "é", "example", "com", "x" * 30, "q9", "zz top"]
    return ["", "ab", *[" ".join(r.choice(words) for _ in range(r.randint(0, 6))) for _ in range(25)], *["".join(r.choice("abcdé ") for _ in range(n)) for n in (1, 3, 63, 64, 65, 130)]]


@pytest.mark.parametrize("table,one", [(TB.ratio, S.ratio_of), (TB.token_set, S.token_set_of), (TB.jaro_winkler, lambda a, b: S.jaro_winkler_of(a.encode(), b.encode())), (TB.equal, lambda a, b: float(a == b))])
def test_tables_are_their_definitions(table, one):
    left, right = texts(1), texts(2) + texts(1)[:5]
    assert (table(left, right) == np.array([[one(a, b) for b in right] for a in left])).all()
    assert table([], right).shape == (0, len(right)) and table(left, []).shape == (len(left), 0)


def test_greatest_of_each_querys_own_anchors(spark):
    r = random.Random(3)
    fields = {f"S2-{i}": r.choice(["acme", "acme foods", "other", ""]) for i in range(600)}  # more than a chunk
    pairs = [(f"S1-{s}", t, r.choice("cca"), i) for s in range(6) for i, t in enumerate(fields) if r.random() < 0.5]
    pairs += [("S1-0", t, "a", 0) for s, t, k, _ in pairs if s == "S1-0" and k == "c"][:40]  # candidates that are anchors too
    make = lambda kind, *cols: spark.createDataFrame([p[:2] + p[3:] for p in pairs if p[2] == kind], "s1_id string, target_id string, i int").select(*cols)
    cand, anchors = make("c", "s1_id", "target_id", "i"), make("a", "s1_id", "target_id")
    names = spark.createDataFrame(list(fields.items()), "target_id string, name string")
    measure = lambda c, a: [TB.ratio(c["name"], a["name"])]
    theirs = collections.defaultdict(list)
    for s, t, k, _ in pairs:
        if k == "a":
            theirs[s].append(t)
    want = {(s, t, i, len(o), max(S.ratio_of(fields[t], fields[x]) for x in o)) for s, t, k, i in pairs if k == "c" and (o := [x for x in theirs[s] if x != t])}
    one = cand.select("s1_id").distinct().selectExpr("s1_id", "7L as block")
    for blocks in (None, one):
        assert {tuple(x) for x in best_beside(cand, anchors, names, measure, ["best"], blocks, ["i"]).collect()} == want
    own, mine = asked(spark.createDataFrame([("S1-1", "acme")], "s1_id string, name string"))
    got = best_beside(cand, own, names, measure, ["best"], anchor_fields=mine)
    assert {(x["target_id"], x["best"]) for x in got.collect()} == {(t, S.ratio_of("acme", fields[t])) for s, t, k, _ in pairs if k == "c" and s == "S1-1"}


def test_group_rule_asks_for_shared_numbers(spark):
    fields = spark.createDataFrame([("S2-1", "Acme", "12 Main"), ("S2-2", "Acme", "12 Main"), ("S2-3", "Acme", "13 Main")], "target_id string, name string, address string")
    cand = spark.createDataFrame([("S1-1", "S2-2"), ("S1-1", "S2-3")], "s1_id string, target_id string")
    anchors = spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, target_id string")
    ask = lambda number: {x["target_id"] for x in D.anchor_group_rule(cand, anchors, fields, TB.ratio, 90, 80, number).collect()}
    assert ask(False) == {"S2-2", "S2-3"} and ask(True) == {"S2-2"}


@pytest.mark.parametrize("name", ["k8_anchor_group_rule", "c16_fuzzy_siblings", "c15_exact_siblings", "k6_seed_propagation", "k7_sibling_rescue", "l10_anchor_diagnostic", "j7_sibling_context"])
def test_no_row_for_each_candidate_and_anchor(spark, name):
    from matchloom.plans import registry

    plan = plan_of(registry.queries()[name](spark, SF))
    assert "FlatMapCoGroupsInPandas" in plan and "anchor_id" not in plan and "a_id" not in plan


def test_partial_ratios_of_many_pairs():
    a, b = texts(4), texts(5)
    pairs = [(x, y) for x in a for y in b if len(x) + len(y) < 120]
    assert (S.partials(pairs) == np.array([S.partial_of(*p) for p in pairs])).all()
    assert len(S.partials([])) == 0


def test_character_features_need_no_contract(spark):
    from matchloom.plans import registry

    plan = plan_of(registry.queries()["j5_char_features"](spark, SF))
    assert "_char" in plan and "_features" not in plan


def test_shortlist_scores_in_full_where_it_proposes(spark):
    from matchloom.operators import tfidf as TI

    rows = [(f"{x:032x}", f"t{j}", j, 0.1 + (x * j % 7) / 10) for x in range(1, 30) for j in range(1, 9) if (x + j) % 3]
    w = spark.createDataFrame(rows, "key string, term string, id int, w double")
    made = TI.shortlist(w, w, 2, 3, 2, 5, 3)
    assert " Join " not in plan_of(made)
    by = collections.defaultdict(dict)
    for key, term, _, x in rows:
        by[key][term] = x
    dot = lambda a, b: round(sum(v * b[t] for t, v in a.items() if t in b), 9)
    for q in by:
        top = dict(sorted(by[q].items(), key=lambda x: (-round(x[1], 9), x[0]))[:2])
        short = sorted((t for t in by if set(top) & set(by[t])), key=lambda t: (-dot(top, by[t]), t))[:5]
        want = sorted(((-dot(by[q], by[t]), t) for t in short))[:3]
        assert [(-r["cosine"], r["t_key"]) for r in made.where(f"q_key = '{q}'").orderBy("rk").collect()] == want


def test_models_read_features_that_are_kept(spark):
    from matchloom.plans import registry

    for name in ("j16_two_stage_scores", "j20_sibling_model"):
        assert "InMemoryRelation" in registry.queries()[name](spark, SF)._jdf.queryExecution().withCachedData().toString()
