"""Further queries: audits, profiles, headroom probes and rule variants over the same records and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions import similarity as S
from matchloom.functions import tables as TB
from matchloom.functions import text as X
from matchloom.operators import blocking as B
from matchloom.operators import decide as D
from matchloom.operators import evaluate as E
from matchloom.operators import features as FT
from matchloom.operators import tfidf as TI
from matchloom.operators.beside import best_beside
from matchloom.plans.registry import DOCS, FIELDS, KEYED, KEYS, LABELLED, METRIC, NORM, NUM, PAGES, SCORED, SIBLINGS, TERMS, TFIDF, TOKENS, TOP, WORD_TERMS, char_terms_sql, core, docs, field_scored, key_blocks, keyed, labelled, pages, query, r6, scored, tfidf_route
from matchloom.sources import records as R

number = lambda c: F.element_at(F.split(c, "-"), -1).cast("bigint")


@query("b2_country_partition", DOCS + " select entity_id, business_name from rec where country = 'fr'")
def _(spark, sf):
    return R.document_records(spark, sf).where("country = 'fr'").select("entity_id", "business_name")


@query("b5_keyed_targets", PAGES + f" select target_id, {core('business_name')} as core_key from t where {core('business_name')} <> ''")
def _(spark, sf):
    return pages(spark, sf)[1].select("target_id", X.core_key(F.col("business_name")).alias("core_key")).where("core_key <> ''")


@query("b13_leakage_guard", LABELLED + f", o as (select target_id from truth where {NUM('s1_id')} % 10 = 0) select s1_id, target_id, is_match from labelled where is_match or target_id not in (select target_id from o)")
def _(spark, sf):
    from matchloom.operators.model import guard

    rows = labelled(spark, sf)
    owners = rows.where("is_match").select("target_id", F.when(number("s1_id") % 10 == 0, "validation").otherwise("training").alias("split"))
    return guard(rows.withColumn("split", F.lit("training")), owners).select("s1_id", "target_id", "is_match")


@query("b14_anomaly_examples", DOCS + r" select entity_id, business_name from rec where length(business_name) > 80 order by entity_id limit 10")
def _(spark, sf):
    return R.document_records(spark, sf).where(F.length("business_name") > 80).select("entity_id", "business_name").orderBy("entity_id").limit(10)


@query("c7_blank_frequency_join", DOCS + f", k as (select *, {core('business_name')} as ck from t), f as (select country, ck, count(*) as df from k group by all) select target_id, case when business_address = '' then df end as df from k left join f using (country, ck)")
def _(spark, sf):
    k = docs(spark, sf)[1].select("target_id", "country", "business_address", X.core_key(F.col("business_name")).alias("ck"))
    f = k.groupBy("country", "ck").agg(F.count(F.lit(1)).alias("df"))
    return k.join(f, ["country", "ck"], "left").select("target_id", F.when(F.col("business_address") == "", F.col("df")).alias("df"))


@query("c8_labeller", LABELLED + " select s1_id, target_id, is_match from labelled")
def _(spark, sf):
    return labelled(spark, sf).select("s1_id", "target_id", "is_match")


@query("c16_fuzzy_siblings", SIBLINGS + f" select sib.s1_id, sib.target_id, round(max(jaro_winkler_similarity({NORM.format('x.business_name')}, {NORM.format('y.business_name')})), 6) as best from sib join t x using (target_id) join t y on y.target_id = sib.anchor_id group by all")
def _(spark, sf):
    q, t, p, _truth = scored(spark, sf)
    fields = t.select("target_id", X.norm(F.col("business_name")).alias("name"))
    alike = lambda c, a: [TB.jaro_winkler(c["name"], a["name"])]
    return best_beside(p.where("prob < 0.7"), p.where("prob >= 0.7"), fields, alike, ["best"], key_blocks(q)).select("s1_id", "target_id", r6("best").alias("best"))


@query("c20_validated_merge", SCORED + " select s1_id, target_id, 2::bigint as n from scored where prob >= 0.5")
def _(spark, sf):
    p = scored(spark, sf)[2].select("s1_id", "target_id", "prob")
    both = p.unionByName(p.where("prob >= 0.5"))  # a merge that repeats pairs
    return both.groupBy("s1_id", "target_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("c22_in_lookup", SCORED + " select entity_id, business_name from s1 where entity_id in (select s1_id from scored where prob >= 0.9)")
def _(spark, sf):
    q, _t, p, _truth = scored(spark, sf)
    return q.join(p.where("prob >= 0.9").select(F.col("s1_id").alias("entity_id")), "entity_id", "left_semi").select("entity_id", "business_name")


@query("d4_core_frequency", PAGES + f", k as (select country, {core('business_name')} as ck from t) select country, ck, count(*) as df from k group by all")
def _(spark, sf):
    return pages(spark, sf)[1].select("country", X.core_key(F.col("business_name")).alias("ck")).groupBy("country", "ck").agg(F.count(F.lit(1)).alias("df"))


@query("d13_slice_hits", METRIC + ", sl as (select entity_id as s1_id, unnest(list_filter(['all', country, case when regexp_matches(business_name, '[^\\x00-\\x7F]') then 'non_ascii' end], lambda x: x is not null)) as slice from s1) select slice, sum(tp)::bigint as hits, sum(tp + fn)::bigint as total from f join sl using (s1_id) group by 1")
def _(spark, sf):
    q, _t, p, truth = scored(spark, sf)
    labels = F.filter(F.array(F.lit("all"), F.col("country"), F.when(X.non_ascii(F.col("business_name")), "non_ascii")), lambda x: x.isNotNull())
    slices = q.select(F.col("entity_id").alias("s1_id"), F.explode(labels).alias("slice"))
    scores = E.per_query(q.select(F.col("entity_id").alias("s1_id")), truth, p.where("prob >= 0.5"))
    return scores.join(slices, "s1_id").groupBy("slice").agg(F.sum("tp").alias("hits"), F.sum(F.col("tp") + F.col("fn")).alias("total"))


@query("d18_best_in_group", FIELDS + " select entity_id as s1_id, round(coalesce(max(ns), 0), 6) as best from s1 left join js on js.s1_id = entity_id group by 1")
def _(spark, sf):
    q, _t = pages(spark, sf)
    best = field_scored(spark, sf).groupBy("s1_id").agg(F.max("ns").alias("best"))
    return q.select(F.col("entity_id").alias("s1_id")).join(best, "s1_id", "left").select("s1_id", r6(F.coalesce("best", F.lit(0.0))).alias("best"))


@query("d26_propagation_oracle", SCORED + ", n as (select x.s1_id, count(*) as total, count(k.target_id) as anchors from truth x left join (select * from scored where prob >= 0.5) k using (s1_id, target_id) group by 1) select round(1 - sum(case when anchors = 0 then total else 0 end) / sum(total), 6) as reachable from n")
def _(spark, sf):
    _q, _t, p, truth = scored(spark, sf)
    n = truth.join(p.where("prob >= 0.5").select("s1_id", "target_id", F.lit(1).alias("k")), ["s1_id", "target_id"], "left").groupBy("s1_id").agg(F.count(F.lit(1)).alias("total"), F.count("k").alias("anchors"))
    return n.agg(r6(1 - F.sum(F.when(F.col("anchors") == 0, F.col("total")).otherwise(0)) / F.sum("total")).alias("reachable"))


@query("d27_country_mix_score", METRIC + ", c as (select s1.country, avg(f05) as m from f join s1 on s1.entity_id = f.s1_id group by 1) select round(sum(m * case country when 'en' then 3 else 1 end) / sum(case country when 'en' then 3 else 1 end), 6) as score from c")
def _(spark, sf):
    q, _t, p, truth = scored(spark, sf)
    ids = q.select(F.col("entity_id").alias("s1_id"), "country")
    m = E.per_query(ids.select("s1_id"), truth, p.where("prob >= 0.5")).join(ids, "s1_id").groupBy("country").agg(F.avg("f05").alias("m")).withColumn("w", F.when(F.col("country") == "en", 3).otherwise(1))
    return m.agg(r6(F.sum(F.col("m") * F.col("w")) / F.sum("w")).alias("score"))


@query("e6_rank_of_all", TOP + " select s1_id, target_id, rn from ranked")
def _(spark, sf):
    return B.rank(scored(spark, sf)[2], [F.desc("prob"), F.asc("target_id")]).select("s1_id", "target_id", "rn")


@query("f4_strongest_terms", TFIDF + ", r as (select *, row_number() over (partition by raw order by round(w, 9) desc, term) as rk from tn) select md5(raw) as key, term from r where rk <= 4")
def _(spark, sf):
    t = pages(spark, sf)[1]
    keys = TI.dictionary(t, "business_address")
    counts = TI.term_counts(keys, TI.word_terms(F.col("raw")))
    w = TI.weights(counts, TI.vocabulary(counts, keys.agg(F.count(F.lit(1)).alias("n"))))
    return TI.strongest(w, 4).select("key", "term")


@query("f6_hardest_per_kind", LABELLED + ", r as (select *, row_number() over (partition by is_match order by case when is_match then prob else -prob end, s1_id, target_id) as rk from labelled) select is_match, s1_id, target_id from r where rk <= 10")
def _(spark, sf):
    at = Window.partitionBy("is_match").orderBy(F.when(F.col("is_match"), F.col("prob")).otherwise(-F.col("prob")), "s1_id", "target_id")
    return labelled(spark, sf).withColumn("rk", F.row_number().over(at)).where("rk <= 10").select("is_match", "s1_id", "target_id")


@query("f7_top_k_larger_ids", SCORED + ", r as (select *, row_number() over (partition by s1_id order by prob desc, target_id desc) as rn from scored) select s1_id, target_id from r where rn <= 3")
def _(spark, sf):
    return B.rank(scored(spark, sf)[2], [F.desc("prob"), F.desc("target_id")]).where("rn <= 3").select("s1_id", "target_id")


@query("g13_repeated_in_lists", PAGES + KEYED + f" select distinct s1_id as source1_entity_id from pairs where {NUM('s1_id')} % 4 = 0")
def _(spark, sf):
    q, t = pages(spark, sf)
    ids = R.decode_list(F.col("candidate_entity_ids"))
    # every list whose record's number is a multiple of four names its first target twice
    faulty = F.when((number("source1_entity_id") % 4 == 0) & (F.col("candidate_entity_ids") != ""), F.concat_ws(",", "candidate_entity_ids", F.get(ids, F.lit(0)))).otherwise(F.col("candidate_entity_ids"))
    lists = R.list_rows(q, keyed(q, t)).withColumn("candidate_entity_ids", faulty)
    return lists.where(F.size(ids) != F.size(F.array_distinct(ids))).select("source1_entity_id")


@query("h19_jaro_winkler_characters")
def _(spark, sf):
    q, t = pages(spark, sf)
    return B.hydrate(keyed(q, t), q, t).select("s1_id", "target_id", r6(S.jaro_winkler("q_address", "t_address")).alias("similarity"))


@query("h24_rarity_overlap", PAGES + KEYS[len(PAGES):] + f", tok as (select target_id, country, unnest({TOKENS.format('business_address', 2)}) as tok from t), df as (select country, tok, count(*) as df from tok group by all), qt as (select entity_id as s1_id, country, unnest({TOKENS.format('business_address', 2)}) as tok from s1), w as (select qt.s1_id, qt.tok, qt.country, ln(1 + 5e6 / greatest(1, coalesce(df, 0))) as w from qt left join df using (country, tok)), tot as (select s1_id, sum(w) as total from w group by 1), pr as (select distinct a.entity_id as s1_id, b.target_id from s1 a join t b on a.country = b.country and {core('a.business_name')} = {core('b.business_name')} where {core('a.business_name')} <> '') select pr.s1_id, pr.target_id, round(coalesce(sum(w.w), 0) / any_value(total), 6) as overlap from pr join tot using (s1_id) left join (tok join w using (country, tok)) on w.s1_id = pr.s1_id and tok.target_id = pr.target_id group by 1, 2")
def _(spark, sf):
    q, t = pages(spark, sf)
    tok = t.select("target_id", "country", F.explode(X.tokens(F.col("business_address"), 2)).alias("tok"))
    df = B.frequencies(tok)
    w = q.select(F.col("entity_id").alias("s1_id"), "country", F.explode(X.tokens(F.col("business_address"), 2)).alias("tok")).join(df, ["country", "tok"], "left").withColumn("w", F.log(1 + 5e6 / F.greatest(F.lit(1), F.coalesce("df", F.lit(0)))))
    total = w.groupBy("s1_id").agg(F.sum("w").alias("total"))
    pairs = keyed(q, t)
    shared = pairs.join(w, "s1_id").join(tok, ["target_id", "country", "tok"]).groupBy("s1_id", "target_id").agg(F.sum("w").alias("w"))
    return pairs.join(total, "s1_id").join(shared, ["s1_id", "target_id"], "left").select("s1_id", "target_id", r6(F.coalesce("w", F.lit(0.0)) / F.col("total")).alias("overlap"))


@query("h31_crc32_split")
def _(spark, sf):
    return R.document_records(spark, sf).select("entity_id", (F.crc32("entity_id") % 2).alias("half"))


@query("h33_number_flags", PAGES + ", x as (select p.*, coalesce(try_cast(regexp_extract(a.business_address, '([0-9]+)', 1) as bigint), -1) as m, coalesce(try_cast(regexp_extract(b.business_address, '([0-9]+)', 1) as bigint), -1) as n from (select entity_id as s1_id, target_id from s1 join t using (business_name, country)) p join s1 a on a.entity_id = p.s1_id join t b using (target_id)) select s1_id, target_id, least(abs(m - n), 1000) as distance, abs(m - n) between 1 and 10 as near from x")
def _(spark, sf):
    q, t = pages(spark, sf)
    h = B.hydrate(B.key_route(q, t, F.concat("business_name", F.lit("|")), F.concat("business_name", F.lit("|"))), q, t)
    gap = F.abs(X.first_number(F.col("q_address")) - X.first_number(F.col("t_address")))
    return h.select("s1_id", "target_id", F.least(gap, F.lit(1000)).alias("distance"), gap.between(1, 10).alias("near"))


@query("h35_placeholders", DOCS + r" select entity_id, regexp_matches(lower(business_name), '^(n/?a|none|null|unknown|test)$') as placeholder, regexp_matches(business_name, '[À-ÿ]') as accented from rec")
def _(spark, sf):
    n = F.col("business_name")
    return R.document_records(spark, sf).select("entity_id", F.lower(n).rlike(r"^(n/?a|none|null|unknown|test)$").alias("placeholder"), n.rlike("[À-ÿ]").alias("accented"))


@query("i1_string_dictionary", KEYS + " select md5(raw) as key, len(ids)::bigint as ids from tk")
def _(spark, sf):
    return TI.dictionary(pages(spark, sf)[1], "business_address").select("key", F.col("n_ids").alias("ids"))


@query("i2_word_terms", KEYS + f", c as (select raw, unnest({TERMS}) as term from tk) select term, count(*) as cf, count(distinct raw) as df from c group by 1")
def _(spark, sf):
    keys = TI.dictionary(pages(spark, sf)[1], "business_address")
    return TI.term_counts(keys, TI.word_terms(F.col("raw"))).groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))


@query("i9_combined_field_route", tfidf_route("concat_ws(' ', business_name, business_name, business_address)", WORD_TERMS, 5))
def _(spark, sf):
    q, t = (x.withColumn("both", F.concat_ws(" ", "business_name", "business_name", "business_address")) for x in pages(spark, sf))
    return TI.retrieve(q.withColumnRenamed("entity_id", "s1_id"), t, "both", TI.word_terms, 5).select("s1_id", "target_id", "rn")


@query("i10_char_3_to_5_route", tfidf_route("business_name", char_terms_sql(NORM.format("raw"), 3, 5), 5, 120_000))
def _(spark, sf):
    q, t = pages(spark, sf)
    return TI.retrieve(q.withColumnRenamed("entity_id", "s1_id"), t, "business_name", lambda c: TI.char_terms(X.norm(c), 3, 5), 5, most=120_000).select("s1_id", "target_id", "rn")


@query("j4_blank_frequency_features")
def _(spark, sf):
    q, t = pages(spark, sf)
    t = t.withColumn("business_address", F.when(number("target_id") % 2 == 0, "").otherwise(F.col("business_address")))
    ck = t.select("target_id", "country", X.core_key(F.col("business_name")).alias("ck"))
    df = ck.join(ck.groupBy("country", "ck").agg(F.count(F.lit(1)).alias("df")), ["country", "ck"]).select("target_id", "df")
    made = FT.featurise(B.hydrate(keyed(q, t), q, t).where("t_address = ''").join(df, "target_id"), "blank")
    return made.select("s1_id", "target_id", F.size("features").alias("n"), r6(F.element_at("features", -1)).alias("log_target_core_frequency"))


@query("j7_group_context", TOP + " select s1_id, target_id, prob, rn, count(*) over g as group_size, round(max(prob) over g - prob, 6) as gap_to_best, round(avg(prob) over g, 6) as group_mean from ranked window g as (partition by s1_id)")
def _(spark, sf):
    g = Window.partitionBy("s1_id")
    p = B.rank(scored(spark, sf)[2], [F.desc("prob"), F.asc("target_id")])
    return p.select("s1_id", "target_id", "prob", "rn", F.count(F.lit(1)).over(g).alias("group_size"), r6(F.max("prob").over(g) - F.col("prob")).alias("gap_to_best"), r6(F.avg("prob").over(g)).alias("group_mean"))


@query("j18_blend", SCORED + f" select s1_id, target_id, round(0.7 * prob + 0.3 * (({NUM('s1_id')} * 17 + {NUM('target_id')} * 31) % 1000 / 1000.0::double), 6) as prob from scored")
def _(spark, sf):
    from matchloom.operators.model import blend

    second = (number("s1_id") * 17 + number("target_id") * 31) % 1000 / 1000.0
    p = scored(spark, sf)[2].withColumn("first", F.col("prob")).withColumn("second", second)
    return blend(p, "first", "second", 0.3).select("s1_id", "target_id", r6("prob").alias("prob"))


@query("k4_veto_variants", SCORED + f", x as (select *, abs({NUM('s1_id')} % 50 - {NUM('target_id')} % 50) as gap, max(prob) over (partition by s1_id) as best from scored) select count(*) filter (where gap between 1 and 10) as near, count(*) filter (where gap between 1 and 10 and best >= 0.8) as near_anchor, count(*) filter (where gap between 1 and 10 and prob < 0.5) as near_weak from x")
def _(spark, sf):
    gap = F.abs(number("s1_id") % 50 - number("target_id") % 50).between(1, 10)
    p = scored(spark, sf)[2].withColumn("best", F.max("prob").over(Window.partitionBy("s1_id"))).withColumn("near", gap)
    return p.agg(F.count_if("near").alias("near"), F.count_if(F.col("near") & (F.col("best") >= 0.8)).alias("near_anchor"), F.count_if(F.col("near") & (F.col("prob") < 0.5)).alias("near_weak"))


@query("k5_rarity_veto", SCORED + f", k as (select target_id, count(*) over (partition by country, {core('business_name')}) as df from t) select s1_id, target_id from scored join k using (target_id) where not (df >= 3 and prob < 0.6)")
def _(spark, sf):
    _q, t, p, _truth = scored(spark, sf)
    ck = t.select("target_id", "country", X.core_key(F.col("business_name")).alias("ck"))
    df = ck.join(ck.groupBy("country", "ck").agg(F.count(F.lit(1)).alias("df")), ["country", "ck"]).select("target_id", "df")
    return p.join(df, "target_id").where(~((F.col("df") >= 3) & (F.col("prob") < 0.6))).select("s1_id", "target_id")


@query("k8_anchor_group_rule", SIBLINGS + f", s as (select sib.s1_id, sib.target_id, jaro_winkler_similarity({NORM.format('x.business_name')}, {NORM.format('y.business_name')}) as name_set, jaro_winkler_similarity({NORM.format('x.business_address')}, {NORM.format('y.business_address')}) as address_set from sib join t x using (target_id) join t y on y.target_id = sib.anchor_id) select s1_id, target_id from s group by all having bool_or(name_set >= 0.9 and address_set >= 0.8)")
def _(spark, sf):
    q, t, p, _truth = scored(spark, sf)
    fields = t.select("target_id", X.norm(F.col("business_name")).alias("name"), X.norm(F.col("business_address")).alias("address"))
    return D.anchor_group_rule(p.where("prob < 0.7"), p.where("prob >= 0.7"), fields, TB.jaro_winkler, 0.9, 0.8, blocks=key_blocks(q))


@query("k9_transliteration_rescue")
def _(spark, sf):
    q, t = pages(spark, sf)
    h = B.hydrate(keyed(q, t), q, t).join(scored(spark, sf)[2].select("s1_id", "target_id", "prob"), ["s1_id", "target_id"])
    h = h.where(X.non_ascii(F.col("q_name"))).withColumn("latin_name", S.ratio(X.ascii_normalize("q_name"), X.ascii_normalize("t_name"))).withColumn("latin_address", S.ratio(X.ascii_normalize("q_address"), X.ascii_normalize("t_address")))
    return D.rescue(h, 90.0, 60.0, 0.3).select("s1_id", "target_id")


@query("l6_gap_audit", SCORED + ", m as (select x.*, t.country, t.source, s.prob from truth x join t using (target_id) left join (select * from scored where prob >= 0.2) s using (s1_id, target_id)) select country, source, count(*) filter (where prob is null) as not_retrieved, count(*) filter (where prob < 0.5) as rejected, count(*) filter (where prob >= 0.5) as found from m group by all")
def _(spark, sf):
    _q, t, p, truth = scored(spark, sf)
    m = truth.join(t.select("target_id", "country", "source"), "target_id").join(p.where("prob >= 0.2").select("s1_id", "target_id", "prob"), ["s1_id", "target_id"], "left")
    return m.groupBy("country", "source").agg(F.count_if(F.col("prob").isNull()).alias("not_retrieved"), F.count_if(F.col("prob") < 0.5).alias("rejected"), F.count_if(F.col("prob") >= 0.5).alias("found"))


@query("l7_gate_analysis", LABELLED + ", n as (select s1_id, count(*) filter (where prob >= 0.5) as base from labelled group by 1) select least(base, 3) as bucket, count(*) filter (where is_match) as added_true, count(*) filter (where not is_match) as added_false from labelled join n using (s1_id) where prob between 0.3 and 0.499999 group by 1")
def _(spark, sf):
    rows = labelled(spark, sf)
    n = rows.groupBy("s1_id").agg(F.count_if(F.col("prob") >= 0.5).alias("base"))
    added = rows.where("prob between 0.3 and 0.499999").join(n, "s1_id")
    return added.groupBy(F.least("base", F.lit(3)).alias("bucket")).agg(F.count_if("is_match").alias("added_true"), F.count_if(~F.col("is_match")).alias("added_false"))


@query("l9_funnel_headroom", PAGES + KEYS[len(PAGES):] + f", p as (select a.entity_id as s1_id, b.target_id, len(list_intersect({TOKENS.format('a.business_address', 1)}, {TOKENS.format('b.business_address', 1)})) as any_tok, len(list_intersect({TOKENS.format('a.business_address', 4)}, {TOKENS.format('b.business_address', 4)})) as long_tok from s1 a join t b on a.country = b.country and {core('a.business_name')} = {core('b.business_name')} where {core('a.business_name')} <> '') select count(*) as pairs, count(*) filter (where any_tok > 0) as any_overlap, count(*) filter (where long_tok > 0) as long_overlap, count(*) filter (where any_tok > 0 and long_tok = 0) as short_only from p")
def _(spark, sf):
    q, t = pages(spark, sf)
    shared = lambda n: F.size(F.array_intersect(X.tokens(F.col("q_address"), n), X.tokens(F.col("t_address"), n)))
    p = B.hydrate(keyed(q, t), q, t).select(shared(1).alias("a"), shared(4).alias("l"))
    return p.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("a") > 0).alias("any_overlap"), F.count_if(F.col("l") > 0).alias("long_overlap"), F.count_if((F.col("a") > 0) & (F.col("l") == 0)).alias("short_only"))


@query("l11_collision_study", FIELDS + ", truth as (select min(s1_id) as s1_id, target_id from pairs group by target_id) select x.s1_id is not null as is_match, case when ads * 100 < 30 then '<30' when ads * 100 < 50 then '30-49' when ads * 100 < 70 then '50-69' when ads * 100 < 90 then '70-89' else '90+' end as bin, count(*) as n from js left join truth x using (s1_id, target_id) group by all")
def _(spark, sf):
    rows = field_scored(spark, sf).join(scored(spark, sf)[3].withColumn("hit", F.lit(1)), ["s1_id", "target_id"], "left")
    return rows.groupBy(F.col("hit").isNotNull().alias("is_match"), E.bins(F.col("ads") * 100, [30, 50, 70, 90]).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("l12_pair_profile", PAGES + KEYS[len(PAGES):] + f", p as (select a.business_name = b.business_name as same_name, a.business_address = b.business_address as same_address, regexp_matches(a.business_name, '[^\\x00-\\x7F]') as accents, b.country, b.source from s1 a join t b on a.country = b.country and {core('a.business_name')} = {core('b.business_name')} where {core('a.business_name')} <> '') select country, source, count(*) as n, count(*) filter (where same_name) as same_name, count(*) filter (where same_address) as same_address, count(*) filter (where accents) as accents from p group by grouping sets ((), (country), (source))")
def _(spark, sf):
    q, t = pages(spark, sf)
    p = B.hydrate(keyed(q, t), q, t).withColumnRenamed("target_source", "source")
    c, s = F.col("country"), F.col("source")
    return p.groupingSets([[], [c], [s]], c, s).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("q_name") == F.col("t_name")).alias("same_name"), F.count_if(F.col("q_address") == F.col("t_address")).alias("same_address"), F.count_if(X.non_ascii(F.col("q_name"))).alias("accents"))


@query("l14_truth_profile", SCORED + ", g as (select s1_id, count(*) as n, count(*) filter (where target_id like 'S2-%') as s2 from truth group by 1) select n as size, count(*) as groups, count(*) filter (where s2 = 0) as only_s3, count(*) filter (where s2 = n) as only_s2 from g group by 1")
def _(spark, sf):
    g = scored(spark, sf)[3].groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("target_id").startswith("S2-")).alias("s2"))
    return g.groupBy(F.col("n").alias("size")).agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("s2") == 0).alias("only_s3"), F.count_if(F.col("s2") == F.col("n")).alias("only_s2"))


@query("l16_order_leak", SCORED + f" select round(quantile_cont(abs({NUM('s1_id')} - {NUM('target_id')}), 0.5), 6) as median_gap, count(*) filter (where abs({NUM('s1_id')} - {NUM('target_id')}) <= 3) as close from truth")
def _(spark, sf):
    gap = scored(spark, sf)[3].select(F.abs(number("s1_id") - number("target_id")).alias("gap"))
    return gap.agg(r6(F.percentile("gap", F.lit(0.5))).alias("median_gap"), F.count_if(F.col("gap") <= 3).alias("close"))
