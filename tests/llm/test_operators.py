"""Every operator against brute force or its library, on rows chosen to be awkward."""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from matchloom.llm import bpe, exact, lines, near, packing, quality, recompress, substring, tokens, toxicity, urls
from matchloom.llm.registry import TOKENIZER

LONG = " ".join(f"word{i % 997} thing{i % 13}" for i in range(20_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (1, "a b c\nd e\nf g", "en"), (2, None, None), (3, "", "en"), (4, " \t\n ", "xx"), (5, "a b  c\nd e\nf g", "de"), (6, "a b c\nd e\nf g", "en"),
    (7, f"start {PASSAGE} end of it", "en"), (8, f"{PASSAGE}", "fr"), (9, f"other text {PASSAGE} with {PASSAGE}", "en"), (10, LONG, "en"), (10, LONG, "en"), (11, LONG + " tail", "en"),
    (None, "null id\nd e\nf g", "en"), (None, None, None), (12, "same same same same same same same same same same same same", "en"), (13, "x", "es"), (14, "<|endoftext|> <|endo 😀 日本 語", "en"), (14, "different text of one id", "en"), (15, "  " * 500 + "don't we'll", "en"),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(spark):
    """The same rows with further columns, named like those that operators make."""
    rows = [(*r, 5, "k", True, 1, "s") for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA + ", n_words long, `__key` string, kept boolean, n_tokens int, source string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    order = lambda r: repr(tuple(r))
    assert sorted(map(tuple, got), key=order) == sorted(map(tuple, want), key=order)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


OPERATORS = {
    "token_counts": lambda d: tokens.token_counts(d, TOKENIZER),
    "substring": lambda d: substring.substring_dedup(d),
    "bpe": lambda d: bpe.bpe_round_trip(d, TOKENIZER),
    "packing": lambda d: packing.packed_sequences(d, TOKENIZER),
    "exact": lambda d: exact.exact_dedup(d),
    "near": lambda d: near.jaccard_join(d),
    "near_dedup": lambda d: near.near_dedup(d),
    "quality": lambda d: quality.quality(d),
    "lines": lambda d: lines.line_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in ("lines", "near_dedup", "substring", "packing")])
def test_clashing_columns_change_nothing(docs, clashing, name):
    want, got = OPERATORS[name](docs), OPERATORS[name](clashing)
    same(got.select(*want.columns).collect(), want.collect())


@pytest.mark.parametrize("name", ["lines", "near_dedup", "substring"])
def test_carried_columns_stay(docs, clashing, name):
    want, got = OPERATORS[name](docs), OPERATORS[name](clashing)
    assert got.columns[: len(clashing.columns)] == clashing.columns
    same([(r["doc_id"], r["text"]) for r in got.select("doc_id", "text").collect()], [(r["doc_id"], r["text"]) for r in want.select("doc_id", "text").collect()])
    assert {r["__key"] for r in got.select("__key").distinct().collect()} == {"k"}


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 1 << 11), (300, 20), (64, 16)])
def test_token_counts(docs, chunk, overlap):
    tok = tokens.load_tokenizer(TOKENIZER)
    got = tokens.token_counts(docs, TOKENIZER, chunk=chunk, overlap=overlap)
    want = []
    for d, t, _ in ROWS:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 512))
    same(got.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect(), want)


def test_token_counts_widen_overlaps(spark):
    rows = [(1, "x" * 5000 + " end"), (2, "ab <|endoftext|>" * 300), (3, " " * 3000 + "y"), (4, "é日" * 2000)]
    tok = tokens.load_tokenizer(TOKENIZER)
    got = tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER, chunk=256, overlap=32)
    same(got.select("doc_id", "n_tokens").collect(), [(d, len(tok.encode(t, add_special_tokens=False).ids)) for d, t in rows])


def test_token_counts_of_other_kinds(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    assert tokens.lookahead(path) is None
    assert tokens.lookahead(public_tokenizers.path("word_bpe_49k.json")) is None
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    same(tokens.token_counts(docs, path).select("doc_id", "n_tokens").collect(), [(d, len(sp.encode(t or ""))) for d, t, _ in ROWS])


def test_bpe_round_trip(docs):
    tok = tokens.load_tokenizer(TOKENIZER)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t, _ in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    same(bpe.bpe_round_trip(docs, TOKENIZER).collect(), want)


def test_bpe_matches_library_on_random_text():
    tok, b, rng = tokens.load_tokenizer(TOKENIZER), bpe.load_bpe(TOKENIZER), random.Random(5)
    for _ in range(2000):
        t = "".join(rng.choice("ab  \n\t'tsreé日😀1#<|> _-") for _ in range(rng.randint(0, 120)))
        ids = tok.encode(t, add_special_tokens=False).ids
        assert b.encode(t) == ids
        assert b.decode(ids) == tok.decode(ids, skip_special_tokens=False)


def test_substring_dedup(docs):
    same(substring.substring_report(docs).collect(), substring.brute_force([(d, t) for d, t, _ in ROWS]))


@pytest.mark.parametrize("width,hot", [(2, 1), (5, 10**9), (9, 1)])
def test_substring_dedup_of_small_alphabets(spark, monkeypatch, width, hot):
    monkeypatch.setattr(substring, "HOT_IN_SAMPLE", hot)
    rng = random.Random(width)
    rows = [(i, " ".join(rng.choice("abcde" if i % 3 else "ab") for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(1000 + i, "one two three four five six seven eight nine ten " + " ".join(rng.choice("vwxyz") for _ in range(8))) for i in range(60)]
    got = substring.substring_report(spark.createDataFrame(rows, "doc_id long, text string"), width)
    same(got.collect(), substring.brute_force(rows, width))


def test_substring_blocks_are_found_in_little_memory():
    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.run = run

    docs, rng = Docs(), np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 5000, 1000))) for _ in range(450)]
    substring._blocks(docs, 35)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(450)), "__key": list(range(450)), "__text": texts})
    tracemalloc.start()
    rows = sum(b.num_rows for b in docs.run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 10_000 and peak < 80e6


def test_substring_dedup_tells_texts_of_one_id_apart(spark):
    """Texts without an id whose hashes have their low 22 bits in common, one of them repeated under an id."""
    text = lambda i, n: " ".join(f"t{i}w{j}" for j in range(n))
    texts = spark.createDataFrame([(i, text(i, 40 + i % 60)) for i in range(20_000)], "i long, text string")
    low = texts.selectExpr("i", "text", "xxhash64(text) & 4194303 as low")
    pairs = low.alias("x").join(low.alias("y"), "low").where("x.i < y.i").selectExpr("x.text as a", "y.text as b").collect()
    assert pairs
    rows = [(None, t) for p in pairs for t in p] + [(k, p[k % 2]) for k, p in enumerate(pairs)]
    same(substring.substring_report(spark.createDataFrame(rows, "doc_id long, text string")).collect(), substring.brute_force(rows))


def test_equal_windows_have_equal_symbols():
    rng = np.random.default_rng(1)
    texts = [recompress.mix(rng.integers(0, k, n).astype(np.uint64)) for k, n in [(3, 300), (50, 200), (2, 100), (1, 80)] * 3]
    texts.append(np.concatenate([texts[1][:20], texts[0][5:200]]))
    all_words, doc = np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    name, first, count = recompress.blocks(all_words, doc, 35)
    of = {p + i: n for n, p, c in zip(name.tolist(), first.tolist(), count.tolist(), strict=True) for i in range(c)}
    seen = collections.defaultdict(set)
    at = 0
    for t in texts:
        for i in range(len(t) - 34):
            seen[t[i : i + 35].tobytes()].add(of[at + i])
        at += len(t)
    assert all(len(s) == 1 for s in seen.values())
    assert len(of) == sum(max(0, len(t) - 34) for t in texts)


def test_url_filter(spark):
    pages = [(1, "http://www.Example.com/en/x?y"), (2, "https://example.com/en/"), (3, "http://a.b.net/es/1"), (4, "net/fr/"), (5, None), (6, "ftp://x.com"), (7, "http://x.com/#a"), (8, "http://notexample.com/en/"), (9, "http://net/fr/a"), (9, "http://net/fr/a"), (10, "http://"), (11, "http://É.com/"), (None, "http://q.net/fr/")]
    listed = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    got = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), listed).collect()

    def judge(url):
        rest = url.partition("://")[2] if url and "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [(len(h), len(p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, None, "allow"))
        return host, path, best[2], best[3]

    same(got, [(p, *judge(u)) for p, u in pages])
    nothing = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), listed.limit(0)).collect()
    assert {(r["rule"], r["verdict"]) for r in nothing} == {(None, "allow")}
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string"), listed).count() == 0


@pytest.mark.parametrize("group", [1 << 14, 40])
def test_packing(spark, docs, group):
    rng = random.Random(2)
    more = spark.createDataFrame([(100 + i, " word" * rng.randint(0, 900), "en") for i in range(200)], SCHEMA)
    tok = tokens.load_tokenizer(TOKENIZER)
    rows = packing.packed_sequences(docs.unionByName(more), TOKENIZER, group=group).collect()
    by_sequence, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    texts = {d: t for d, t, _ in ROWS if d is not None and d not in (10, 14)}
    for d, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        parts = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(len(parts)))
        assert sum(p["length"] for p in parts) == len(ids)
        assert all(p["length"] == 1024 for p in parts[1:])
        for p in parts:
            assert zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
    counts = np.bincount([r["length"] for r in rows], minlength=1025)
    assert packing.lower_bound(counts, 1024) <= len(by_sequence) <= packing.lower_bound(counts, 1024) * 1.02 + 1


def test_lower_bounds_hold():
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes = rng.integers(1, 31, 8)
        best = min_bins(sorted(sizes.tolist(), reverse=True), 30)
        assert packing.lower_bound(np.bincount(sizes, minlength=31), 30) <= best
        bins, offsets, fill = packing.best_fit_decreasing(sizes, 30)
        assert fill.max() <= 30 and fill.sum() == sizes.sum()


def min_bins(sizes, capacity, bins=()):
    if not sizes:
        return len(bins)
    options = {tuple(sorted(bins[:i] + (b + sizes[0],) + bins[i + 1 :])) for i, b in enumerate(bins) if b + sizes[0] <= capacity}
    return min(min_bins(sizes[1:], capacity, o) for o in [*options, tuple(sorted(bins + (sizes[0],)))])


def test_exact_dedup(spark, docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for rows, df in ((ROWS, docs), ([(i, "hot" if i % 2 else f"t{i}", "en") for i in range(3000)], None)):
        df = df or spark.createDataFrame(rows, SCHEMA)
        groups = collections.defaultdict(list)
        for d, t, _ in rows:
            groups[norm(t)].append(d)
        want = []
        for d, t, _ in rows:
            g = groups[norm(t)]
            keep = min((x for x in g if x is not None), default=None)
            want.append((d, keep, len(g), d == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
        same(exact.exact_dedup(df).collect(), want)


def test_jaccard_join(docs):
    rows = [(d, t) for d, t, _ in ROWS if d is not None]
    got = near.jaccard_join(docs.where("doc_id is not null")).select("doc_id", "n_links", "group_id").collect()
    same(got, near.brute_force(rows))


def test_jaccard_join_of_a_large_near_group(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 16)
    rng, base, rows = random.Random(3), [f"w{i}" for i in range(120)], []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(120)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "a b"), (203, "a b"), (204, "a  b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(near.jaccard_join(df).select("doc_id", "n_links", "group_id").collect(), near.brute_force(rows))
    groups = {g for _, _, g in near.brute_force(rows)}
    assert {r["doc_id"] for r in near.near_dedup(df).collect()} == groups


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.95), (0.9, 0.99)):
        bands, rows = near.bands_for(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall


def base_counts(t):
    t, w, seen = t or "", words(t), collections.defaultdict(list)
    for i in range(len(w) - 4):
        seen[tuple(w[i : i + 5])].append(i)
    covered = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    ls = [x for x in t.split("\n") if words(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(ls) - len(set(ls)), len(covered), failed


def test_quality_base_counts(docs):
    got = quality.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    same(got, [(d, *base_counts(t)) for d, t, _ in ROWS])


def test_quality_distances_are_those_of_the_formula(spark):
    import math

    rng = random.Random(8)
    text = lambda lang: " ".join(rng.choice(quality.COMMON_WORDS[lang]) if rng.random() < 0.4 else "".join(rng.choice("abcÄé9.(#") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(20, 90)))
    rows = [(i, text(lang), lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 10)] + [(99, "1 2 3 #! ... " * 20, None)]
    kind = [lambda c: c.islower(), lambda c: c.isupper(), lambda c: c.isdigit(), lambda c: c in ".,;:!?", lambda c: c in "'\"()[]{}-", lambda c: c in "#*$%&|<>", lambda c: True]

    def shares(t):
        w = words(t)
        chars = collections.Counter(next(i for i, f in enumerate(kind) if f(c)) for x in w for c in x)
        low = collections.Counter(x.lower() if x.lower() in quality.VOCABULARY else "" for x in w)
        return [chars[i] / sum(map(len, w)) for i in range(7)], [low[v] / len(w) for v in [*quality.VOCABULARY, ""]]

    def distance(p, q):
        kl = lambda a, m: sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0)
        mid = [(x + y) / 2 for x, y in zip(p, q)]
        return math.sqrt(max(0.0, (kl(p, mid) + kl(q, mid)) / 2))

    refs = {}
    for lang in quality.COMMON_WORDS:
        own = [shares(t) for _, t, x in rows if x == lang and not base_counts(t)[-1]]
        refs[lang] = [[sum(o[h][i] for o in own) / len(own) for i in range(len(own[0][h]))] for h in (0, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for got in (quality.quality(docs), quality.quality(docs.drop("lang"), references=quality.language_references(docs))):
        for r in got.collect():
            p, w = shares(rows[min(r["doc_id"], 40)][1])
            assert abs(r["char_distance"] - min(distance(p, x[0]) for x in refs.values())) < 1e-9
            assert abs(r["word_distance"] - min(distance(w, x[1]) for x in refs.values())) < 1e-9
    plain = quality.quality(docs.drop("lang")).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in plain)


def test_ids_may_be_strings(spark):
    text = spark.createDataFrame([(f"a{d}" if d is not None else None, t, x) for d, t, x in ROWS], "doc_id string, text string, lang string")
    for name, run in OPERATORS.items():
        out = run(text)
        assert dict(out.dtypes)["doc_id"] == "string", name
        assert {r["doc_id"] for r in out.collect()} == {f"a{d}" if d is not None else None for d, _, _ in ROWS} or name == "near_dedup"


def test_url_filter_of_a_list_with_many_path_lengths(spark):
    listed = [("example.com", "/" + "a" * k, "block" if k % 2 else "allow") for k in range(0, 5000, 7)] + [("other.org", "/x", "block")]
    pages = [(i, f"http://{'www.' * (i % 2)}example.com/{'a' * (i * 41 % 5200)}") for i in range(60)] + [(100, "http://other.org/x/" + "y" * 100_000), (101, "http://none.net/x")]
    got = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(listed, "host string, path string, verdict string")).collect()
    for r in got:
        fit = [(len(p), h + p, v) for h, p, v in listed if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        assert (r["rule"], r["verdict"]) == (max(fit)[1:] if fit else (None, "allow"))
    assert len(got) == len(pages)


def test_ranks_give_the_same_ids_only_where_that_is_proven(tmp_path):
    import json

    assert tokens.same_by_rank(TOKENIZER)
    assert not tokens.same_by_rank(public_tokenizers.path("word_bpe_49k.json")) and not tokens.same_by_rank(public_tokenizers.path("piece_bpe_32k.model"))
    spec = json.load(open(TOKENIZER, encoding="utf-8"))
    spec["model"]["merges"] = spec["model"]["merges"][:-1]  # one entry that no merge makes
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    assert not tokens.same_by_rank(str(tmp_path / "t.json"))


def test_quality_keeps_prose_and_drops_junk(spark):
    rng, common = random.Random(4), "the of and to in is that it was for on with as be at".split()
    prose = lambda: " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(150)).capitalize() + "."
    rows = [(i, prose(), "en") for i in range(60)] + [(100 + i, " | ".join(f"{rng.randint(0, 9999)}$$%%" for _ in range(150)), "en") for i in range(3)]
    kept = {r["doc_id"] for r in quality.quality(spark.createDataFrame(rows, SCHEMA)).where("kept").collect()}
    assert kept == set(range(60))


def test_quality_tests_each_histogram_alone(spark):
    rng, common = random.Random(6), "the of and to in is that it was for on with as be at".split()
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    text = lambda f, other: " ".join(rng.choice(common) if rng.random() < f else other() for _ in range(200)) + "."
    rows = [(i, text(0.4, word), "en") for i in range(200)]
    rows += [(1000 + i, text(0, word), "en") for i in range(4)] + [(2000 + i, text(0.4, lambda: str(rng.randint(1000, 99999))), "en") for i in range(4)]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    prose = [r for i, r in got.items() if i < 1000]
    assert sum(r["kept"] for r in prose) >= 0.9 * len(prose)
    usual = {c: max(r[c] for r in prose) for c in ("char_distance", "word_distance")}
    for start, far, other in ((1000, "word_distance", "char_distance"), (2000, "char_distance", "word_distance")):
        for r in (got[start + i] for i in range(4)):
            assert not r["base_failed"] and not r["kept"]
            assert r[far] > usual[far] and r[other] <= usual[other] * 1.5
    few = [*rows[:30], *[(3000 + i, text(0, word), "en") for i in range(30)]]
    assert {r["kept"] for r in quality.quality(spark.createDataFrame(few, SCHEMA)).where("doc_id >= 3000").collect()} == {False}


def brute_lines(rows, m=2, least=None):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    first, out = {}, []
    for d, t in rows:
        ls = t.split("\n") if t is not None else []
        held, gone = [i for i, x in enumerate(ls) if words(x)], set()
        for size in {1, m} if least is not None else {m}:
            for at in range(len(held) - size + 1):
                places = held[at : at + size]
                run = tuple(ls[i] for i in places)
                if size < m and len(words(run[0])) < least:
                    continue
                if first.setdefault(run, (d, t, at)) != (d, t, at):
                    gone.update(places)
        out.append((d, len(ls), len(gone), hashlib.sha256("\n".join(x for i, x in enumerate(ls) if i not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("m,least,hot", [(1, None, 2), (2, None, 1 << 14), (2, 2, 2), (3, 1, 5)])
def test_line_dedup(spark, docs, monkeypatch, m, least, hot):
    monkeypatch.setattr(lines, "HOT_GROUP", hot)
    plain = [(d, t) for d, t, _ in ROWS if (d, t) != (14, "different text of one id")]
    same(lines.line_report(docs.where("text is null or text <> 'different text of one id'"), m, least).collect(), brute_lines(plain, m, least))
    rng = random.Random(m)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", "d e"]) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    same(lines.line_report(spark.createDataFrame(rows, "doc_id long, text string"), m, least).collect(), brute_lines(rows, m, least))


@pytest.mark.parametrize("hot", [2, 1 << 14])
def test_suffix_array_and_runs(spark, monkeypatch, hot):
    """Ranks at the end are the order of all suffixes; each run is a longest copy of earlier lines, and runs hold all that recurs."""
    monkeypatch.setattr(lines, "HOT_GROUP", hot)
    rng = random.Random(7)
    rows = [(i, "\n".join(rng.choice("abc") if i % 3 else rng.choice("xy") for _ in range(rng.randint(1, 14)))) for i in range(40)]
    rows += [(100 + i, "q\n" * 40 + f"end{i}") for i in range(3)]
    held = lines._lines(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", None)
    names = {r["u"]: [(x["a"], x["b"]) for x in r["lines"]] for r in held.collect()}
    rank = {}
    for _, state in lines.suffix_ranks(held, 1):
        for r in state.collect():
            rank.update({(r["u"], i): v for i, v in enumerate(r["v"])})
    assert all(v % 4 == 0 for v in rank.values())
    order = sorted(rank, key=rank.get)
    assert [rank[x] // 4 for x in order] == list(range(sum(map(len, names.values()))))
    suffix = [names[u][i:] for u, i in order]
    for x, y in zip(suffix, suffix[1:]):
        k = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), None)
        assert k is None or x[k] < y[k]
    texts = {d: t.split("\n") for d, t in rows}
    copied = {}
    for r in lines.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), min_lines=2).collect():
        run = texts[r["id"]][r["start"] : r["start"] + r["length"]]
        assert len(run) == r["length"] >= 2
        assert (r["first_id"], r["first_start"]) < (r["id"], r["start"])
        assert texts[r["first_id"]][r["first_start"] : r["first_start"] + r["length"]] == run
        copied.setdefault(r["id"], set()).update(range(r["start"], r["start"] + r["length"]))
    want = {d: n for d, _, n, _ in brute_lines(rows, 2)}
    assert {d: len(p) for d, p in copied.items()} == {d: n for d, n in want.items() if n}


@pytest.fixture(scope="module")
def toxic_rows():
    rng, rows, labels = random.Random(9), [], []
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    for i in range(900):
        w, bad = [rng.choice(vocabulary) for _ in range(80)], i % 6 == 0
        if bad:
            w[rng.randrange(80)] = rng.choice(["idiot", "worthless", "zorkenta", "zorkenti"])
            w[rng.randrange(80)] = rng.choice(["moron", "zorkento", "scum"])
        rows.append((i, " ".join(w), "en"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, toxic_rows):
    rows, labels = toxic_rows
    docs = spark.createDataFrame([*rows, (5000, None, None), (None, "you idiot moron scum", "en"), (5001, "", "en")], SCHEMA)
    marks = spark.createDataFrame([*labels, (7777, 0, 1), (None, 1, 1), (3, None, None), (5, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == len(rows) + 3
    truth = {i: t for i, _, t in labels}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert right >= 0.97 * len(held)
    assert {r["predicted"] for r in got if r["doc_id"] in (5000, 5001)} == {0}
    assert next(r for r in got if r["doc_id"] is None)["predicted"] == 1
    assert len(toxicity.drop_toxic(docs, marks).columns) == 3


def test_toxicity_ignores_held_out_labels(spark, toxic_rows):
    rows, labels = toxic_rows
    docs = spark.createDataFrame(rows, SCHEMA)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    scores = [{r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, flipped)]
    assert all(abs(scores[0][i] - scores[1][i]) < 1e-9 for i in scores[0])


def test_toxicity_without_labels_or_rows(spark, empty, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(empty, none).count() == 0
    assert toxicity.toxicity(docs, none).count() == len(ROWS)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.2
    rates = [(0.8, 0.05), (0.6, 0.02), (0.7, 0.1), (0.5, 0.05)]
    v = np.stack([np.where(y, rng.random(len(y)) < a, rng.random(len(y)) < b) for a, b in rates], 1).astype(np.int64)
    v = np.concatenate([v, v[:, :1]], 1)  # a voter that only repeats another
    patterns, inverse, count = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    known = np.full(len(patterns), -1)
    q, _, links = toxicity.label_model(patterns, count.astype(float), known)
    # the best that any model can do: the true rates of the four voters that say anything of their own
    odds = np.log(0.2 / 0.8) + sum(np.where(v[:, j] == 1, np.log(a / b), np.log((1 - a) / (1 - b))) for j, (a, b) in enumerate(rates))
    best = ((odds > 0) == y).mean()
    assert ((q[inverse.ravel()] > 0.5) == y).mean() > best - 0.02
    assert {(0, 4), (4, 0)} & {(a, b) for a, b, _ in links}
