"""The corpus pipeline stage by stage, and the thin queries' shapes."""

import collections
import hashlib
import re
import zlib

import numpy as np

import corpus_pipeline
from matchloom.llm import near, packing, registry, substring, tokens, toxicity
from test_operators import brute_lines

SF = "/root/testdata/sf0.001"


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages_do_what_brute_force_does(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert all(r["n_chars"] == len(r["text"] or "") for r in docs.collect())
            got = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "toxicity":
            marks = toxicity.toxicity(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()
            assert set(got) == {r["doc_id"] for r in marks if not r["predicted"]} and all(got[d] == t for d, t in rows if d in got)
        if name == "line_dedup":
            want = {d: (gone, sha) for d, _, gone, sha in brute_lines(rows, 2, 3)}
            assert {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in got.items()} == {d: want[d][1] for d in got}
            assert {d for d, _ in rows} - set(got) == {d for d, t in rows if want[d][0] and not plain_words("\n".join(kept_lines(rows, 2, 3)[d]))}
        if name == "ngram_jaccard_join":
            assert set(got) == {g for _, _, g in near.brute_force(rows)}
        if name == "substring_dedup":
            want = {d: (n, gone) for d, n, gone, _ in substring.brute_force(rows)}
            assert set(got) == {d for d, (n, gone) in want.items() if not gone or gone < n}
            assert all(len(plain_words(t)) == want[d][0] - want[d][1] for d, t in got.items())
    tok = tokens.load_tokenizer(registry.TOKENIZER)
    pieces = {(r["doc_id"], r["piece"]): r for r in docs.collect()}
    assert {d for d, _ in pieces} == {d for d, _ in rows}
    for d, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        mine = [pieces[d, k] for k in range(sum(x == d for x, _ in pieces))]
        assert sum(r["length"] for r in mine) == len(ids) and all(r["length"] <= 1024 for r in mine)
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in mine)
    filled = collections.Counter()
    for r in pieces.values():
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 1024 and len(filled) <= packing.lower_bound(np.bincount([r["length"] for r in pieces.values()], minlength=1025), 1024) * 1.02 + 1
    assert corpus_pipeline.run(spark, SF).count() == len(pieces)


def kept_lines(rows, m, least):
    """The lines that stay of each document, from the same definition as ``brute_lines``."""
    first, out = {}, {}
    for d, t in sorted(rows):
        ls = (t or "").split("\n")
        held, gone = [i for i, x in enumerate(ls) if plain_words(x)], set()
        for size in (1, m):
            for at in range(len(held) - size + 1):
                places = held[at : at + size]
                run = tuple(ls[i] for i in places)
                if (size == m or len(plain_words(run[0])) >= least) and first.setdefault(run, (d, at)) != (d, at):
                    gone.update(places)
        out[d] = [x for i, x in enumerate(ls) if i not in gone]
    return out


def test_stages_take_nulls_clashes_and_empty_tables(spark):
    """Further columns named like those that operators add, null and empty texts, repeated rows, no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, __n_deleted string, __n_lines int, __n_removed string, __kept string, __n_words int, __row string, __key string, __id int, c0 string, places int, listed int"
    more = ("x", 1, "y", "z", 2, "r", "k", 3, "c", 4, 5)
    long = " ".join(f"w{i}" for i in range(5000))
    texts = [(1, None), (2, ""), (3, " \n "), (4, long), (5, "a line of words\nand another one"), (6, "a line of words\nand another one"), (None, None), (None, "null id here"), (7, long[:3000]), (7, long[:3000])]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), *more) for d, t in texts], schema)
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            got = out.collect()
            if name == "best_fit_packing":
                assert len(got) >= rows.count()
            else:
                assert out.columns == docs.columns, name
                assert {tuple(r)[5:] for r in got} <= {more}
            assert bool(got) == (not rows.isEmpty())
    out = {r["doc_id"] for r in corpus_pipeline.line_dedup_stage(spark, docs, SF).collect()}
    assert out == {1, 2, 3, 4, 5, None, 7}


def test_rows_that_stand_twice_come_down_to_one(spark):
    text = {d: " ".join(f"w{d}x{i}" for i in range(50)) for d in (1, 2, 3, 4)}
    rows = [(1, text[1], "en", "a", 0), (1, text[1], "en", "b", 0), (2, text[2], "en", "a", 0), (None, text[3], "en", "a", 0), (None, text[3], "en", "a", 0), (4, text[4], "en", "a", 0), (5, text[4], "en", "a", 0), (5, text[4], "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == sorted([(1, text[1]), (2, text[2]), (0, text[3]), (4, text[4])])
    left = corpus_pipeline.substring_dedup_stage(spark, out, SF).collect()
    assert sorted(r["text"] for r in left) == sorted(text.values())


def test_lines_that_recur_alone_or_between_blank_lines_go(spark):
    rows = [(1, "first own\nthe line that recurs\nmore own", "en", "a", 0), (2, "second own\nthe line that recurs\nother own", "en", "a", 0), (3, "para one\n\npara two", "en", "a", 0), (4, "para one\n\npara two\n\nlast own", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup_stage(spark, docs, SF).collect()}
    assert out == {1: rows[0][1], 2: "second own\nother own", 3: rows[2][1], 4: "\n\nlast own"}


def test_queries_return_what_they_promise(spark):
    promised = {
        "op1_token_counts": "doc_id n_bytes n_tokens over_limit", "op2_substring_dedup": "doc_id n_words n_removed kept_sha256", "op3_bpe_round_trip": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op4_url_filter": "page_id host path rule verdict", "op5_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op6_exact_dedup": "doc_id keep_id group_size kept text_sha256",
        "op8_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op10_toxicity": "doc_id held_out score predicted",
    }
    for name, columns in promised.items():
        assert set(columns.split()) <= set(registry.queries()[name](spark, SF).columns), name


def test_stages_with_python_bound_their_batches(spark):
    name, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.read.parquet(f"{SF}/documents.parquet")
    before = spark.conf.get(name)
    try:
        for had, want in (("10000", "1000"), ("0", "1000"), ("300", "300")):
            spark.conf.set(name, had)
            out = dict(corpus_pipeline.STAGES)["substring_dedup"](spark, docs, SF)
            assert spark.conf.get(name) == want and out.columns == docs.columns
    finally:
        spark.conf.set(name, before)
