"""Literal cases, invariants and plan shapes of the record-linkage operators."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from matchloom.functions import similarity as S
from matchloom.functions import text as X
from matchloom.operators import blocking as B
from matchloom.operators import decide as D
from matchloom.operators import evaluate as E
from matchloom.operators import features as FT
from matchloom.operators import model as M
from matchloom.operators import tfidf as TI
from matchloom.operators.vectors import nearest
from matchloom.plans import registry
from matchloom.sources import records as R
from matchloom.streaming.arrivals import arrivals, match_arrivals

SF = "/root/testdata/sf0.001"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("tp,fp,fn,want", [(0, 0, 0, 1.0), (0, 1, 0, 0.0), (1, 0, 1, 1.25 / 1.5), (1, 1, 0, 1.25 / 2.25), (0, 0, 2, 0.0)])
def test_f05(spark, tp, fp, fn, want):
    got = spark.createDataFrame([(tp, fp, fn)], "a int, b int, c int").select(S.f05(F.col("a"), F.col("b"), F.col("c")).alias("f")).first()["f"]
    assert abs(got - want) < 1e-9


def test_text_functions(spark):
    assert one(spark, "Acme Private Limited", X.core_key) == "acme"
    assert one(spark, " Null  Bazar!", X.norm) == "null bazar"
    assert one(spark, "No 007, 0 and 00", lambda c: X.address_numbers(c, 1)) == ["7", "0"]
    assert one(spark, "B-26, 4th", X.first_number) == 26
    assert one(spark, "none", X.first_number) == -1
    assert one(spark, "1" * 40, X.first_number) == -1
    assert one(spark, "https://www.acme-x.com/a", X.domain_stem) == "acme-x"
    assert one(spark, "ab", X.trigram_set) == ["ab"]
    assert one(spark, "ab", lambda c: X.char_grams(c, 3)) == []
    assert one(spark, "abcd", lambda c: X.char_grams(c, 3)) == ["abc", "bcd"]
    assert one(spark, "Café", lambda c: X.accent_key(X.core_key(c))) == "cafe"
    assert one(spark, "गुजरात abc", X.scripts) == "Latin+Devanagari"
    assert X.normalize_text("Straße ＡＢ") == "strasse ab"
    assert X.fold_text("Café Ltd") == "cafe"
    assert X.fold_text("गु") == "गु" and X.strip_marks("गु") == "ग"
    latin = X.normalize_text(X.ascii_text("गुजरात लॉजिस्टिक्स"))
    assert latin.isascii() and S.ratio_of("gujarat logistics", latin) > S.ratio_of("gujarat logistics", "गुजरात लॉजिस्टिक्स") + 30
    buckets = [X.split_bucket_of(f"2024:S1-{i}") for i in range(20_000)]
    assert 0.005 < sum(b < 100 for b in buckets) / 20_000 < 0.015 and 0.03 < sum(100 <= b < 500 for b in buckets) / 20_000 < 0.05


def test_similarities():
    assert abs(S.jaro_winkler_of("martha", "marhta") - 0.9611) < 1e-3
    assert S.jaro_winkler_of("", "") == 0 and S.jaro_winkler_of(b"caf\xc3\xa9", b"cafe") < S.jaro_winkler_of("café", "cafe") + 1
    assert abs(S.ratio_of("abcd", "abd") - 600 / 7) < 1e-9 and S.ratio_of("", "") == 100
    assert S.token_sort_of("b a", "a b") == 100 and S.token_set_of("a b c", "a b") == 100 and S.token_set_of("", "") == 0
    assert S.partial_of("abc", "xxabcxx") == 100


def test_features_have_their_contract():
    assert {k: len(v) for k, v in FT.SETS.items()} == {"base": 23, "number": 27, "latin": 35, "blank": 36}
    made = dict(zip(FT.SETS["latin"], FT.pair_features("Acme Ltd", "12 Main", "ACME", "15 Main", "S3"), strict=True))
    assert made["core_exact"] == 1 and made["first_number_near"] == 1 and made["first_number_distance"] == 3 and made["source3"] == 1
    assert made["disjoint_address_numbers"] == 1 and made["name_common_tokens"] == 1 and made["query_name_len"] == 8 and made["target_has_address"] == 1
    assert FT.kind_of(FT.SETS["number"]) == "number"
    with pytest.raises(ValueError):
        FT.kind_of(["x"])
    far = dict(zip(FT.SETS["latin"], FT.pair_features("a", "5000", "a", "1", "S2"), strict=True))
    assert far["first_number_distance"] == 1000 and far["first_number_near"] == 0



def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_features_of_a_batch_are_those_of_the_definitions():
    import random

    rng = random.Random(3)
    word = lambda: rng.choice(["Acme", "ltd", "PVT", "eurl", "7co", "café", "गुजरात", "the", "x", "12", "007", "İstanbul", "ﬁne", "w" * 70, "co"])
    text = lambda: rng.choice([" ", ", ", "-"]).join(word() for _ in range(rng.randint(0, 6)))
    rows = [(text(), text(), text(), text(), rng.choice(["S2", "S3"])) for _ in range(300)]
    got = FT.batch_features(*map(list, zip(*rows, strict=True)))
    ratio = lambda a, b: 100.0 if a == b else 200.0 * slow_lcs(a, b) / (len(a) + len(b))
    in_order = lambda t: " ".join(sorted(t.split()))
    for row, (n, a, m, b, source) in zip(got, rows, strict=True):
        norm, core, latin = X.normalize_text, X.core_text, lambda t: X.normalize_text(X.ascii_text(t))
        wide = lambda t: {x for x in norm(t).split() if len(x) >= 2}  # noqa: B023, E731
        digits = lambda t: {x.lstrip("0") or "0" for x in re.findall(r"[0-9]+", t)}
        lead = lambda t: int(re.search(r"[0-9]+", t)[0]) if re.search(r"[0-9]+", t) else -1
        share = lambda x, y: len(x & y) / max(1, min(len(x), len(y)))
        f, g, d, e = lead(a), lead(b), digits(a), digits(b)
        far = abs(f - g) if min(f, g) >= 0 else -1
        odd = [not (n + m).isascii(), not (a + b).isascii()]
        x1, x2, y1, y2 = (latin(n), latin(m), latin(a), latin(b)) if True else ()
        name = [ratio(norm(n), norm(m)), ratio(in_order(norm(n)), in_order(norm(m))), S.token_set_of(norm(n), norm(m))]
        address = [ratio(norm(a), norm(b)), ratio(in_order(norm(a)), in_order(norm(b))), S.token_set_of(norm(a), norm(b))]
        want = [*name, ratio(core(n), core(m)), ratio(in_order(core(n)), in_order(core(m))), ratio(X.fold_text(n), X.fold_text(m)), core(n) != "" and core(n) == core(m), norm(n) != "" and norm(n) == norm(m), *address]
        want += [len(wide(n) & wide(m)), share(wide(n), wide(m)), len(wide(a) & wide(b)), share(wide(a), wide(b)), len(d & e), bool(d) and bool(e) and not d & e, b != "", len(norm(n)), len(norm(m)), len(norm(a)), len(norm(b)), source == "S3"]
        want += [far == 0, min(far, 1000), 0 < far <= 10, far >= 0]
        want += [ratio(x1, x2), ratio(in_order(x1), in_order(x2)), S.token_set_of(x1, x2)] if odd[0] else name
        want += [ratio(y1, y2), S.token_set_of(y1, y2)] if odd[1] else [address[0], address[2]]
        want += [share(set(x1.split()), set(x2.split())) if odd[0] else share(wide(n), wide(m)), *odd]
        assert [round(float(v), 6) for v in row] == [round(float(v), 6) for v in want]


@pytest.mark.parametrize("form", ["inc", "llc", "ltd", "limited", "private", "pvt", "corp", "corporation", "llp", "co", "company", "sas", "sarl", "sa", "eurl"])
def test_each_legal_form_goes(spark, form):
    assert X.core_text(f"Acme {form.upper()}") == "acme"
    rows = spark.createDataFrame([(f"Acme {form}",), (f"Acme Private {form}",), (f"7{form}",), (f"{form}x Acme",)], "n string")
    assert [r[0] for r in rows.select(X.core_key(F.col("n"))).collect()] == ["acme", "acme", "", f"{form}xacme"]  # a digit is a neighbour, which goes with the form
    assert X.core_text("Acme GmbH Incorporated plc") == "acme gmbh incorporated plc"


def pairs_of(spark, rows, more=""):
    return spark.createDataFrame(rows, "s1_id string, target_id string, prob double" + more)


def test_decisions(spark):
    twelve = pairs_of(spark, [("S1-1", f"S2-{i:02d}", 0.5) for i in range(12)])
    assert {r["target_id"] for r in D.cap(twelve).collect()} == {f"S2-{i:02d}" for i in range(11)}
    tie = pairs_of(spark, [("S1-2", "S2-1", 0.9), ("S1-1", "S2-1", 0.9)])
    assert [r["s1_id"] for r in D.exclusive(tie).collect()] == ["S1-1"]
    veto = spark.createDataFrame([("S1-1", f"S2-{i}", "US", 12, n) for i, n in enumerate((12, 15, 40, -1))] + [("S1-2", "S2-9", "US", 12, 15)], "s1_id string, target_id string, country string, q_num int, t_num int")
    assert {r["target_id"] for r in D.nearby_number_veto(veto).collect()} == {"S2-0", "S2-2", "S2-3", "S2-9"}
    assert D.parse_thresholds(["US:0.7", "IN:S2:0.5"]) == {"US": 0.7, "IN:S2": 0.5}
    assert {r["change"] for r in D.delta(tie, tie.limit(1)).collect()} == {"removed"}


def test_validation_finds_faults(spark):
    q = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    c = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-2", "X-1")], "source1_entity_id string, candidate_entity_ids string")
    m = spark.createDataFrame([("S1-1", "S2-5"), ("S1-3", "")], "source1_entity_id string, matched_entity_ids string")
    got = D.validate(q, c, m).first()
    assert (got["row_faults"], got["repeated"], got["bad_prefix"], got["not_candidates"]) == (2, 1, 1, 1)


def test_rank_fusion_and_sparse_merge(spark):
    ranked = lambda ids: spark.createDataFrame([("q", t, i + 1) for i, t in enumerate(ids)], "s1_id string, target_id string, rn int")
    for order in ((["a", "b"], ["b", "c"]), (["b", "c"], ["a", "b"])):
        assert B.reciprocal_rank_fusion([ranked(x) for x in order]).where("rn = 1").first()["target_id"] == "b"
    base = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "")], "source1_entity_id string, candidate_entity_ids string")
    extra = spark.createDataFrame([("S1-1", "S2-0"), ("S1-9", "S2-2")], "source1_entity_id string, candidate_entity_ids string")
    merged, unused = R.merge_sparse(base, extra)
    assert {tuple(r) for r in merged.collect()} == {("S1-1", "S2-0,S2-1"), ("S1-2", "")} and unused.count() == 1


def test_files_and_stages(spark, tmp_path):
    path = f"{tmp_path}/s.tsv"
    with open(path, "w") as f:
        f.write("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tNull Bazar\t\tUS\nS1-2\tA\t\"x\" 1\tIN\n")
    rows = R.read_records(spark, path)
    assert [tuple(r) for r in rows.orderBy("entity_id").collect()] == [("S1-1", "Null Bazar", "", "US"), ("S1-2", "A", '"x" 1', "IN")]
    lists = R.list_rows(rows, spark.createDataFrame([("S1-2", "S2-2"), ("S1-2", "S2-1")], "s1_id string, target_id string"))
    assert {tuple(r) for r in lists.collect()} == {("S1-1", ""), ("S1-2", "S2-1,S2-2")}
    assert R.list_pairs(lists).count() == 2
    R.write_list(lists, f"{tmp_path}/list")
    R.write_json(lists, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2
    built = []
    for _ in range(2):
        assert R.stage(spark, f"{tmp_path}/stage", lambda: built.append(1) or rows, ("country",)).count() == 2
    assert built == [1]
    shards = [rows.withColumnRenamed("entity_id", "source1_entity_id").where(f"country = '{c}'") for c in ("US", "IN")]
    assert R.shard_check(shards, rows.withColumnRenamed("entity_id", "source1_entity_id")).count() == 0
    assert R.shard_check(shards[:1], rows.withColumnRenamed("entity_id", "source1_entity_id")).count() == 1


def test_learning_end_to_end(spark, tmp_path):
    q, t = registry.pages(spark, "/root/testdata/sf0.01")
    f = FT.featurise(B.hydrate(registry.keyed(q, t), q, t)).withColumn("is_match", F.col("q_address").contains("example.com") == F.col("t_address").contains("example.com")).withColumn("is_validation", X.calibration_fold(F.col("s1_id"))).withColumn("df", F.lit(2))
    owners = f.select("target_id", X.split_of("7", F.col("s1_id")).alias("split"))
    guarded = M.guard(f.withColumn("split", F.lit("training")), owners)
    held = {r["target_id"] for r in owners.where("split <> 'training'").collect()}
    assert not any(r["target_id"] in held for r in guarded.where("not is_match").collect())
    blocker, matcher = M.train(f, "base", 3, 3), M.train(f, "latin", 3, 3)
    special = M.train(f.withColumn("features", F.concat("features", F.array(F.log1p("df").cast("float")))), "blank", 3, 3)
    scored = M.two_stage(f, blocker, matcher, special, 5)
    assert scored.where("select_prob between 0 and 1").count() == scored.count() > 0
    M.save(matcher, "latin", f"{tmp_path}/m")
    again, kind = M.load(spark, f"{tmp_path}/m")
    assert kind == "latin"
    a, b = ({(r["s1_id"], r["target_id"]): r["prob"] for r in M.predict(m, f).collect()} for m in (matcher, again))
    assert a == b
    hard = M.hard_negatives(M.predict(matcher, f), 2, 1)
    assert hard.groupBy("s1_id").agg(F.count_if(~F.col("is_match")).alias("n")).agg(F.max("n")).first()[0] <= 3
    assert M.blend(scored, "select_prob", "rank_prob", 0.5).count() == scored.count()


def long_form_products(q, t, k):
    """Every pair that shares a term, by a join on terms."""
    a, b = q.select(F.col("key").alias("q_key"), "term", F.col("w").alias("x")), t.select(F.col("key").alias("t_key"), "term", F.col("w").alias("y"))
    best = {}
    for r in a.join(b, "term").groupBy("q_key", "t_key").agg(F.round(F.sum(F.col("x") * F.col("y")), 9).alias("c")).collect():
        best.setdefault(r["q_key"], []).append((-r["c"], r["t_key"]))
    return {(q, t, round(-c, 8)) for q, found in best.items() for c, t in sorted(found)[:k]}


def test_products_by_blocks_are_those_of_a_join(spark, monkeypatch):
    from matchloom.operators import blocks

    q, t = registry.pages(spark, SF)
    tk, qk = TI.dictionary(t, "business_address"), TI.dictionary(q, "business_address")
    tc, qc = (TI.term_counts(k, TI.char_terms(X.norm(F.col("raw")))) for k in (tk, qk))
    v = TI.vocabulary(tc, tk.agg(F.count(F.lit(1)).alias("n")))
    qw, tw = TI.weights(qc, v).cache(), TI.weights(tc, v).cache()
    want = long_form_products(qw, tw, 5)
    rows = lambda df: {(r["q_key"], r["t_key"], round(r["cosine"], 8)) for r in df.collect()}
    assert rows(TI.top_products(qw, tw, 5, 1, 1)) == rows(TI.top_products(qw, tw, 5, 3, 4)) == want
    assert rows(TI.shortlist(qw, tw, 1, 2, 10_000, 10_000, 5)) == want
    monkeypatch.setattr(blocks, "STEP", 3)
    monkeypatch.setattr(blocks, "PRODUCTS", 2)
    frames = [TI.sparse_rows(w, n).toPandas() for w, n in ((qw, "q_key"), (tw, "t_key"))]
    assert {(r.q_key, r.t_key, round(r.score, 8)) for r in blocks.best_of(blocks.sparse_products, 5, -1, False)(*frames).itertuples()} == want
    assert TI.top_products(qw.limit(0), tw, 5, 1, 1).count() == 0


def test_hot_strings_expand_to_k_ids(spark):
    rows = [(f"S2-{i:04d}", "x") for i in range(2000)] + [("S2-9999", "y")]
    t = spark.createDataFrame(rows, "target_id string, field string")
    q = spark.createDataFrame([("S1-1", "x"), ("S1-2", "x")], "s1_id string, field string")
    found = spark.createDataFrame([("x", "y", 0.9, 1), ("x", "x", 0.8, 2)], "q string, t string, cosine double, rk int").select(F.md5("q").alias("q_key"), F.md5("t").alias("t_key"), "cosine", "rk")
    got = TI.expand(found, TI.members(q, "field", "s1_id"), TI.members(t, "field", "target_id"), 3)
    assert sorted((r["s1_id"], r["rn"], r["target_id"]) for r in got.collect()) == [(s, n, i) for s in ("S1-1", "S1-2") for n, i in ((1, "S2-9999"), (2, "S2-0000"), (3, "S2-0001"))]


def test_nearest_is_brute_force(spark):
    import numpy as np

    from matchloom.operators.blocks import best_rows, dot_products

    vectors = {i: [float(i % 3), float(i % 5), 1.0] for i in range(40)}
    rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items()}
    want = {(i, j, n + 1) for i in range(3) for n, (_c, j) in enumerate(sorted((-round(float(unit[i] @ unit[j]), 9), j) for j in vectors if j != i)[:5])}
    assert {tuple(r) for r in nearest(rows.where("vec_id < 3"), rows, "vec_id", "embedding", 5).collect()} == want
    side = lambda n: rows.select(F.col("vec_id").alias(n), F.col("embedding").alias("v"))
    assert {(r["q_key"], r["t_key"], r["rk"]) for r in best_rows(side("q_key").where("q_key < 3"), side("t_key"), dot_products, 5, 2, 5, apart=True).collect()} == want
    assert nearest(rows.limit(0), rows, "vec_id", "embedding", 5).count() == 0


def test_results_do_not_depend_on_partitioning(spark):
    q, t = registry.docs(spark, SF)
    a = {tuple(r) for r in B.token_route(q, t, "business_address", 20).collect()}
    b = {tuple(r) for r in B.token_route(q.repartition(7), t.repartition(3), "business_address", 20).collect()}
    assert a == b


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    q, t = registry.docs(spark, SF)
    route = plan(B.token_route(q, t, "business_address", 20))
    assert "BroadcastNestedLoopJoin" not in route and "CartesianProduct" not in route and "WindowGroupLimit" in route
    pool = plan(B.two_rank_pool(spark.createDataFrame([("a", "b", 0.1, 0.2)], "s1_id string, target_id string, ns double, ads double"), 3))
    assert pool.count("WindowGroupLimit") >= 2
    weights = spark.createDataFrame([("k", "t", 1, 0.5)], "key string, term string, id int, w double")
    products = plan(TI.top_products(weights, weights, 3, 2, 2))
    assert "FlatMapCoGroupsInPandas" in products and "Join" not in products and "WindowGroupLimit" in products
    scan = plan(R.read_columns(spark, f"{SF}/orders.parquet", "o_orderkey").where("o_orderkey > 5"))
    assert "ReadSchema: struct<o_orderkey:bigint>" in scan and "PushedFilters" in scan


def test_arrivals_match_like_a_batch(spark, tmp_path):
    q, t = registry.docs(spark, SF)
    os.makedirs(f"{tmp_path}/in")
    sample = q.where("business_address = '' or country = 'en'").withColumn("business_address", F.lit("-"))
    sample.coalesce(1).write.mode("overwrite").csv(f"{tmp_path}/in/a", sep="\t", header=True)
    stream = arrivals(spark, f"{tmp_path}/in/a")
    run = match_arrivals(stream, t, f"{tmp_path}/out", f"{tmp_path}/ck", cap=50)
    run.awaitTermination()
    got = {(r["s1_id"], r["target_id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {tuple(r) for r in B.token_route(sample, t, "business_name", 50).collect()}


def test_metrics_are_bounded(spark):
    q, _t, p, truth = registry.scored(spark, SF)
    ids = q.select(F.col("entity_id").alias("s1_id"))
    scores = E.per_query(ids, truth, p)
    assert scores.count() == ids.count() and scores.where("f05 < 0 or f05 > 1").count() == 0
    assert E.curve(registry.labelled(spark, SF)).where("auc between 0 and 1").count() == 1


def test_running_sums_of_many_ranges(spark):
    rows = [((i * 7919) % 5003 / 7.0, i % 5) for i in range(5003)]
    df = spark.createDataFrame(rows, "v double, n long").repartition(6)
    for down in (False, True):
        total, want = 0, {}
        for v, n in sorted(rows, reverse=down):
            total += n
            want[v] = total
        got = E.running(df, "v", ["n"], down)
        assert {r["v"]: r["upto_n"] for r in got.collect()} == want and {r["all_n"] for r in got.collect()} == {total}
    text = plan(E.running(df, "v", ["n"]))
    assert "CartesianProduct" not in text
    values = spark.createDataFrame([(x,) for x in [3, 1, 1, 1, 9, 4, 4, 2, 8, 8]], "x long")
    assert {r["p"]: r["value"] for r in E.index_quantiles(values, "x", [0.0, 0.5, 0.9, 1.0]).collect()} == {0.0: 1, 0.5: 3, 0.9: 8, 1.0: 9}
    assert E.index_quantiles(values.limit(0), "x", [0.5]).first()["value"] is None


def test_bootstrap_interval_is_that_of_resampling(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    delta = rng.normal(0.02, 0.3, 800)
    got = E.bootstrap(spark.createDataFrame([(f"S1-{i}", float(d)) for i, d in enumerate(delta)], "s1_id string, delta double"), "s1_id", "delta", 1000).first()
    low, high = np.quantile(rng.choice(delta, (4000, len(delta))).mean(1), [0.025, 0.975])
    assert abs(got["mean"] - delta.mean()) < 1e-9 and abs(got["low"] - low) < 0.006 and abs(got["high"] - high) < 0.006


def test_entry_has_unique_names():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert json.dumps(sorted(names))


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr


def test_crc32_split_is_that_of_zlib(spark):
    import zlib

    rows = registry.queries()["h31_crc32_split"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["half"] == zlib.crc32(r["entity_id"].encode()) % 2 for r in rows) and {r["half"] for r in rows} == {0, 1}
