"""Rescue rules, strict scores, missing signals and resumed runs against brute force."""

import collections
import itertools
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchloom.functions import similarity as S
from matchloom.functions import text as X
from matchloom.operators import audit as A
from matchloom.operators import blocking as B
from matchloom.operators import siblings as SB
from matchloom.operators import within as W
from matchloom.plans import registry
from matchloom.plans import rules as RU
from matchloom.sources import records as R

SF = "/root/testdata/sf0.01"  # records of sf0.001 share no core name


@pytest.mark.parametrize("name,rules,least", [("k6_seed_propagation", SB.SEED_RULES, 0.05), ("k7_sibling_rescue", SB.SIBLING_RULES, 0.02)])
def test_rules_add_what_brute_force_adds(spark, name, rules, least):
    rows = registry.labelled(spark, SF).collect()
    fields = {r["target_id"]: (r["business_name"], r["business_address"]) for r in registry.pages(spark, SF)[1].collect()}
    anchors = collections.defaultdict(list)
    for r in rows:
        if r["prob"] >= 0.8:
            anchors[r["s1_id"]].append(r["target_id"])
    want = {k: [0, 0] for k in rules}
    for r in rows:
        if least <= r["prob"] < 0.8 and anchors[r["s1_id"]]:
            n, a = fields[r["target_id"]]
            others = [fields[t] for t in anchors[r["s1_id"]]]
            made = {"prob": r["prob"], "name": max(S.ratio_of(n, x) for x, _ in others), "name_set": max(S.token_set_of(n, x) for x, _ in others), "latin_name": max(S.ratio_of(X.ascii_text(n), X.ascii_text(x)) for x, _ in others), "address": max(S.ratio_of(a, y) for _, y in others), "address_set": max(S.token_set_of(a, y) for _, y in others)}
            for k, rule in rules.items():
                if all(made[m] >= v for m, v in rule.items()):
                    want[k][not r["is_match"]] += 1
    got = {r["rule"]: [r["added_true"], r["added_false"]] for r in registry.queries()[name](spark, SF).collect()}
    assert got == want


def test_rules_on_planted_siblings(spark):
    fields = spark.createDataFrame([("S2-1", "Acme Foods", "1 Main Road"), ("S3-2", "Acme Foods", "1 Main Road"), ("S3-3", "Other", "9 Side Lane"), ("S2-4", "Acmé Foods", "1 Main Road")], "target_id string, name string, address string")
    pairs = spark.createDataFrame([("S1-1", "S3-2", 0.15, True), ("S1-1", "S3-3", 0.6, False), ("S1-1", "S2-4", 0.1, True), ("S1-2", "S3-2", 0.6, False)], "s1_id string, target_id string, prob double, is_match boolean")
    judged = SB.resemblance(pairs, spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, target_id string"), fields)
    assert {r["target_id"] for r in judged.collect()} == {"S3-2", "S3-3", "S2-4"}  # a query without accepted targets has none to resemble
    gains = {r["rule"]: (r["added"], r["added_true"], r["added_false"]) for r in SB.rule_gains(judged, SB.SIBLING_RULES).collect()}
    assert gains["translit_name_address"] == (2, 2, 0) and gains["strong_name_address"] == (1, 1, 0) and gains["address_set_name"] == (0, 0, 0)
    assert {tuple(r) for r in SB.rescued(judged, SB.SEED_RULES["strict_name_address"]).collect()} == {("S1-1", "S3-2"), ("S1-1", "S2-4")}


def test_missing_signals_are_those_of_brute_force(spark):
    q, t, p, truth = registry.scored(spark, SF)
    mine = {r["entity_id"]: r for r in q.collect()}
    theirs = {r["target_id"]: r for r in t.collect()}
    true = {tuple(r) for r in truth.select("s1_id", "target_id").collect()}
    prob = {(r["s1_id"], r["target_id"]): r["prob"] for r in p.collect()}
    want = collections.defaultdict(collections.Counter)
    for pair in true | {k for k, v in prob.items() if v >= 0.5}:
        v = prob.get(pair, 0)
        if pair in true and v >= 0.5:
            continue
        kind = "false" if pair not in true else "missed_retrieval" if v < 0.2 else "rejected"
        a, b = mine[pair[0]], theirs[pair[1]]
        x, y, u, w = (X.char_text(s) for s in (a["business_name"], b["business_name"], a["business_address"], b["business_address"]))
        n, m = S.token_set_of(x, y), S.token_set_of(u, w)
        numbers = lambda s: set(re.findall(r"(?<!\S)[0-9]{2,}(?!\S)", s))
        c = want[kind, a["country"], b["source"]]
        c.update(pairs=1, blank_target=w == "", shared_number=bool(numbers(u) & numbers(w)), shared_word=bool(set(u.split()) & set(w.split())), name_alike=n >= 80, address_alike=m >= 80, either_alike=n >= 80 or m >= 80, both_unlike=n < 60 and m < 60)
    got = {(r["kind"], r["country"], r["target_source"]): {k: v for k, v in r.asDict().items() if k not in ("kind", "country", "target_source")} for r in registry.queries()["l8_missing_signals"](spark, SF).collect()}
    assert got == {k: dict(v) for k, v in want.items()} and got


def test_strict_scores_refuse_other_queries(spark):
    lists = lambda rows: spark.createDataFrame(rows, "source1_entity_id string, matched_entity_ids string")
    truth = lists([("S1-1", "S2-1,S2-2"), ("S1-2", "")])
    assert tuple(A.strict_macro(truth, lists([("S1-1", "S2-1"), ("S1-2", "")])).first()) == (2, pytest.approx((1.25 / 1.5 + 1) / 2))
    with pytest.raises(ValueError, match="1 missing, 1 extra"):
        A.strict_macro(truth, lists([("S1-1", ""), ("S1-3", "")]))
    with pytest.raises(ValueError, match="no query"):
        A.strict_macro(truth.limit(0), truth.limit(0))


def test_list_lengths(spark):
    rows = spark.createDataFrame([("",), (None,), ("a",), ("a,b,c",)], "x string")
    assert [r[0] for r in rows.select(R.list_length(F.col("x"))).collect()] == [0, 0, 1, 3]


def page_table(spark, path, rows):
    html = "<html lang=\"en\"><title>{}</title></html>"
    spark.createDataFrame([(i, u, html.format(t)) for i, u, t in rows], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


def dealt(spark):
    """Rows that all stages so far have written for later ones."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_anchor_pairs_make_rows_only_where_they_are_returned(spark, tmp_path):
    """One name of 150 queries and 300 targets: 45,000 pairs, of which none is dealt out, and rows pass one by one."""
    df = registry.queries()["c17_anchor_pairs"](spark, page_table(spark, tmp_path, [(i, "", "Acme Foods") for i in range(450)]))
    before = dealt(spark)
    rows = df.count()
    assert rows > 2_000_000
    assert 450 < dealt(spark) - before < 20_000
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(transform(" in plan and not re.search(r"\*\(\d+\) Generate explode\(transform\(", plan)


def test_anchor_pairs_cost_a_row_no_comparison_and_no_null(spark, tmp_path):
    """Nothing stands after the last explode, and no column can hold a null; null pages and ids give no rows."""
    sf = page_table(spark, tmp_path, [(i, "", "Acme Foods") for i in range(60)] + [(None, "", "Acme Foods")])
    df = registry.queries()["c17_anchor_pairs"](spark, sf)
    assert [(f.name, f.nullable) for f in df.schema] == [("s1_id", False), ("target_id", False), ("anchor_id", False)]
    assert df._jdf.queryExecution().optimizedPlan().toString().startswith("Generate explode(anchors")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()["c17_anchor_pairs"]).fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(want) and len(want) > 1_000


@pytest.mark.parametrize("part", [1, 1 << 16])
def test_anchor_pairs_of_repeated_ids(spark, tmp_path, monkeypatch, part):
    """Ids in several rows, under one name, several names or none, null ids and pages, in one part and in many, against SQL and pair by pair."""
    names = ["Acme Foods", "acme-foods inc", "Acmé", "Other", "Other, ltd", "", "Alone"]
    rows = [(i, "", names[i * i % 7 if i % 5 else 0]) for i in range(150)]
    rows += [(i, "", names[(i + 3) % 7]) for i in (0, 1, 2, 15, 31, 47, 120)] + [(i, "", "") for i in (3, 4, 5)] + [(i, "x", names[0]) for i in (6, 7, 8, 7, 120)] + [(None, "", names[0])]
    sf = page_table(spark, tmp_path, rows)
    spark.createDataFrame([(900, None, None), (901, None, None)], "page_id long, url string, html string").write.mode("append").parquet(f"{sf}/pages.parquet")
    monkeypatch.setattr(B, "PART", part)
    made = sorted(tuple(r) for r in registry.queries()["c17_anchor_pairs"](spark, sf).collect())
    p = registry.scored(spark, sf)[2]
    by_pair = B.siblings(p.where("prob < 0.7").select("s1_id", "target_id"), p.where("prob >= 0.7")).select("s1_id", "target_id", "anchor_id")
    assert made == sorted(tuple(r) for r in by_pair.collect())
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet/*.parquet'")
    assert made == sorted(con.sql(registry.oracle_sql()["c17_anchor_pairs"]).fetchall())
    assert len(made) > len(set(made)) > 5_000


def test_sibling_rescue_makes_no_row_for_a_pair(spark, tmp_path):
    """One name of 300 queries and 600 targets: 180,000 pairs, of which none is dealt out."""
    sf = page_table(spark, tmp_path, [(i, f"http://{i % 7}.org/{i % 50}", "Acme Foods") for i in range(900)])
    sc = spark.sparkContext
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    written = lambda: sum(x.shuffleWriteRecords() for x in (s.apply(i) for s in [stages()] for i in range(s.size())))
    before = written()
    rows = registry.queries()["k7_sibling_rescue"](spark, sf).collect()
    made = written() - before
    assert {r["rule"]: r["added"] for r in rows}["strong_name_address"] > 50_000
    assert 900 < made < 20_000


@pytest.mark.parametrize("again", [False, True])
def test_rules_of_blocks_are_those_of_pairs(spark, tmp_path, monkeypatch, again):
    """With ids that stand in several rows, some of them without a name, and in more parts than one."""
    names = ["Acme Foods", "acme-foods inc", "Acmé", "Other", "Other, ltd", "", "Alone"]
    rows = [(i, f"http://{'abc' * (i % 4)}.org/{i % 11} x{i % 3}", names[i * i % 7 if i % 5 else 0]) for i in range(240)]
    rows += [(i, f"http://again/{i}", names[(i + 3) % 7]) for i in (0, 1, 2, 15, 31, 47, 200)] if again else []
    sf = page_table(spark, tmp_path, rows)
    for name, most in (("CHUNK", 16), ("CELLS", 40), ("WORDS", 1)):
        monkeypatch.setattr(W, name, most)
    rules = SB.SIBLING_RULES | SB.SEED_RULES | {"any": {"prob": 0.3}, "none": {"name": 101}}
    made = {tuple(r) for r in RU.gains(*registry.pages(spark, sf), rules, 0.8, 0.02).collect()}
    assert made == {tuple(r) for r in SB.rule_gains(RU.judged(spark, sf, 0.8, 0.02), rules).collect()}
    assert len(made) == len(rules) and sum(r[1] > 0 for r in made) > 4


def test_rules_of_blocks_in_bounded_steps(monkeypatch):
    """Queries by 64, tables by a few cells: the same counts as in one step."""
    r = random.Random(5)
    q = pd.DataFrame({"s1_id": [f"S1-{i}" for i in range(150)], "n": [r.randrange(10**6) for _ in range(150)]})
    name = lambda: r.choice(["acme", "acme foods", "acme food", "zz"])
    t = pd.DataFrame([{"name": (x := name()), "latin": x, "address": f"http://{r.randrange(30)}.org", "n": r.randrange(10**6), "owner": f"S1-{r.randrange(160)}"} for _ in range(90)])
    rules = SB.SIBLING_RULES | SB.SEED_RULES
    whole = W._gains(t[10:60], q, t, rules, registry.score_table, 0.95, 0.02)
    prob, pass_ = registry.score_table(q, t), {m: f(t[c], t[c]) for m, (c, f) in W.MEASURES.items()}
    want = np.zeros(whole.shape, int)
    for s, j in itertools.product(range(len(q)), range(10, 60)):
        near = np.flatnonzero(prob[s] >= 0.95)
        if 0.02 <= prob[s, j] < 0.95 and len(near):
            for k, rule in enumerate(rules.values()):
                if all(prob[s, j] >= x if m == "prob" else pass_[m][j, near].max() >= x for m, x in rule.items()):
                    want[k, int(q["s1_id"][s] != t["owner"][j])] += 1
    assert (whole == want).all() and want.sum() > 1000
    for at, most in (("CELLS", 100), ("WORDS", 1)):
        monkeypatch.setattr(W, at, most)
        assert (W._gains(t[10:60], q, t, rules, registry.score_table, 0.95, 0.02) == want).all()
