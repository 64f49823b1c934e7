"""Quality rules: distance of a document's character and word histograms from language references."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import SPACE, cut, text_of, words

#: Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in is a that it was for on with as be at by are this or from an not have he".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero".split(),
}
VOCABULARY = sorted({w for ws in COMMON_WORDS.values() for w in ws})
#: Character classes; what none of them takes is the last class.
CLASSES = {"lower": r"\p{Ll}+", "upper": r"\p{Lu}+", "digit": r"\p{Nd}+", "stop": r"[.,;:!?]+", "quote": r"['\"()\[\]{}-]+"}
#: Fixed value: the symbols that the base rules count, a class of their own.
SYMBOLS = "#*$%&|<>"
#: Steps that distances are counted in, to find the quantiles of any number of documents.
STEPS = 1 << 12
#: One code for each common word, from the first printable character on.
CODES = [chr(0x100 + i) for i in range(len(VOCABULARY))]


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often a lambda in the body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(ws: Column, width: int = 5) -> Column:
    """Words that lie in some ``width``-word window found twice or more in the array, first included.

    Where the window hashes aren't all distinct, sorting them with their places makes repeated
    windows neighbours; the sorted places of those give the covered words, in O(n log n) of one row.
    """
    def covered(places: Column) -> Column:
        step = F.transform(places, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(places, i + 1), p + width) - p))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def dups(s: Column) -> Column:
        same = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return _let(F.array_sort(F.transform(same, lambda x: x["i"])), covered)

    def counted(names: Column) -> Column:
        placed = F.array_sort(F.transform(names, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(names)) == F.size(names), F.lit(0).cast("long")).otherwise(_let(placed, dups))

    def windows(hs: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hs) - width)
        return _let(F.transform(at, lambda i: F.xxhash64(*[F.get(hs, i + j) for j in range(width)])), counted)

    long = F.size(ws) > width
    return F.coalesce(F.when(long, _let(F.transform(ws, lambda w: F.xxhash64(w)), windows)), F.lit(0).cast("long"))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts of each text: the base rules' five and the two histograms (``chars``, ``common``)."""
    text, ws = F.col("__text"), F.col("__ws")
    df = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c) for c in carry], text_of(text_col).alias("__text"))
    df = df.withColumn("__n", F.length(text)).withColumn("__ws", words(text))
    # each class is taken out of what the classes before it have left, so only the first reads the whole text
    left, sizes = text, [F.col("__n")]
    for i, (take, p) in enumerate([*((F.regexp_replace, p) for p in CLASSES.values()), (F.translate, SYMBOLS), (F.regexp_replace, SPACE)]):
        df = df.withColumn(f"__left{i}", take(left, p, ""))
        left = F.col(f"__left{i}")
        sizes.append(F.length(left))
    taken = [a - b for a, b in zip(sizes, sizes[1:], strict=False)]
    code = F.create_map(*[F.lit(x) for kv in zip(VOCABULARY, CODES, strict=True) for x in kv])
    coded = F.array_join(F.transform(F.filter(F.transform(ws, F.lower), lambda w: w.isin(VOCABULARY)), lambda w: F.element_at(code, w)), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        "doc_id", *carry,
        F.size(ws).cast("long").alias("n_words"),
        (F.col("__n") - taken[-1]).cast("long").alias("word_chars"),
        taken[-2].cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(ws).alias("n_repeat_words"),
        F.array(*taken[:-1]).alias("chars"),
        coded.alias("coded"),
    )
    rest = lambda a, total: F.concat(a, F.array(total - F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)))
    counts = _let(F.length("coded").cast("long"), lambda n: F.transform(F.array(*[F.lit(c) for c in CODES]), lambda c: n - F.length(F.replace(F.col("coded"), c, F.lit("")))))
    return df.withColumn("chars", rest(F.transform("chars", lambda x: x.cast("long")), F.col("word_chars"))).withColumn("common", rest(counts, F.col("n_words"))).drop("coded")


def _shares(a: Column) -> Column:
    return _let(F.aggregate(a, F.lit(0.0), lambda x, y: x + y), lambda t: F.transform(a, lambda v: v / F.greatest(t, F.lit(1.0))))


def _divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two share arrays, 0 to 1."""
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    total = F.aggregate(F.zip_with(p, q, lambda a, b: _let((a + b) / 2, lambda m: term(a, m) + term(b, m))), F.lit(0.0), lambda x, y: x + y)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _without_common(ref: list[float]) -> float:
    """Distance from a reference of the text that has none of its common words."""
    rest = ref[-1]
    mid = (1 + rest) / 2
    term = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
    return math.sqrt((sum(term(x, x / 2) for x in ref[:-1]) + term(rest, mid) + term(1.0, mid)) / 2)


def _limits(counts: list, share: float) -> dict[str, float]:
    """For each histogram the upper edge of the step that the quantile ``share`` of the distances lies in."""
    found, total = {}, {}
    for kind, _, n in counts:
        total[kind] = total.get(kind, 0) + n
    below = dict.fromkeys(total, 0)
    for kind, step, n in sorted(tuple(r) for r in counts):
        below[kind] += n
        if kind not in found and below[kind] >= share * total[kind] - 1e-9:
            found[kind] = (step + 1) / STEPS
    return found


def _pooled(rows: DataFrame) -> dict[str, dict[str, list[float]]]:
    """Mean histograms of each language of ``COMMON_WORDS``: at most one row a language."""
    n_chars, n_common = len(CLASSES) + 2, len(VOCABULARY) + 1
    usable = rows.where(~base_failed() & F.col("__lang").isin(list(COMMON_WORDS)))
    means = usable.groupBy("__lang").agg(F.array(*[F.avg(F.get("p", F.lit(i))) for i in range(n_chars)]).alias("p"), F.array(*[F.avg(F.get("w", F.lit(i))) for i in range(n_common)]).alias("w"))
    return {r["__lang"]: {c: [float(x or 0.0) for x in r[c]] for c in ("p", "w")} for r in means.orderBy("__lang").collect()}


def _measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    rows = cut(measures(docs.select(F.col(id_col), F.col(text_col), lang.alias("__lang")), id_col, text_col, ("__lang",)))
    shares = lambda c: _shares(F.transform(c, lambda x: x.cast("double")))
    return rows.withColumn("p", shares("chars")).withColumn("w", shares("common"))


def language_references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, dict[str, list[float]]]:
    """References to judge other tables by: per language the mean histograms of documents that pass the base rules."""
    return _pooled(_measured(docs, id_col, text_col, lang_col))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", share: float = 0.95, char_limit: float | None = None, word_limit: float | None = None, min_chars: int = 150, min_words: int = 40, references: dict | None = None) -> DataFrame:
    """One row per input row: id, the base counts, ``base_failed``, both distances and ``kept``.

    ``references`` come from :func:`language_references` of a table that is trusted; with these and
    given limits a document's verdict hangs on nothing but its text. Without any they are made of
    ``docs``: the mean histograms, over all documents that pass the base rules, of each language of
    ``COMMON_WORDS`` as ``lang`` names it; rows of other or null languages make none, nor does a
    table without that column.
    A document is compared with every reference and its nearest counts, so a wrong or missing
    language costs nothing. The limit of each histogram is the quantile ``share`` of the distances
    of all documents that pass the base rules and the guards, unless one is given; it is one for all
    references, as junk gathers at some of them and the others would lose good texts. A text
    without any common word always lies beyond the word limit so found. Guards: texts under ``min_chars`` word characters or ``min_words``
    words are too short for the histogram in question, which then passes. Without any reference
    the base rules decide. A null text is empty and fails the base rules; an empty table gives no
    rows; repeated rows are judged alike; other columns are ignored.
    """
    rows = _measured(docs, id_col, text_col, lang_col)
    pooled = list((_pooled(rows) if references is None else references).values())
    lit = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    near = lambda c, i: F.struct(F.least(_divergence(F.col(c), lit(pooled[i][c])), F.lit(1.0)).alias("d"), F.lit(i).alias("r"))
    nearest = lambda c: F.array_min(F.array(*[near(c, i) for i in range(len(pooled))])) if pooled else F.struct(F.lit(0.0).alias("d"), F.lit(0).alias("r"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = cut(rows.select("doc_id", *counts, base_failed().alias("base_failed"), nearest("p").alias("p"), nearest("w").alias("w")))
    short = {"p": F.col("word_chars") < min_chars, "w": F.col("n_words") < min_words}
    step = lambda c: F.when(~short[c], F.struct(F.lit(c).alias("kind"), F.floor(F.col(c)["d"] * STEPS).alias("step")))
    spread = out.where("not base_failed").select(F.explode(F.array(step("p"), step("w"))).alias("s")).where("s is not null")
    limits = _limits(spread.groupBy("s.kind", "s.step").agg(F.count(F.lit(1)).alias("n")).collect(), share)
    # the distance of a text of other words only, where a reference has common ones
    bare = {i: _without_common(r["w"]) - 1e-9 for i, r in enumerate(pooled) if sum(r["w"][:-1]) > 0}

    def fine(c: str, fixed: float | None) -> Column:
        most = limits.get(c, 1.0) if fixed is None else fixed
        of = [F.when(F.col(c)["r"] == i, F.lit(min(most, x))) for i, x in bare.items()] if c == "w" and fixed is None else []
        return short[c] | (F.col(c)["d"] <= F.coalesce(*of, F.lit(most)))

    kept = ~F.col("base_failed") & fine("p", char_limit) & fine("w", word_limit)
    return out.select("doc_id", *counts, "base_failed", F.col("p.d").alias("char_distance"), F.col("w.d").alias("word_distance"), kept.alias("kept"))
