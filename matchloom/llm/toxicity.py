"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import cut, packed, text_of

#: The lexicon voters, one each; entries are words in lower case.
LEXICONS = {
    "insult_person": "idiot moron loser clown imbecile fool scum bastard jerk creep",
    "insult_quality": "stupid worthless pathetic disgusting trash garbage dumb filthy vile useless",
    "insult_de": "idiot dummkopf trottel arschloch abschaum versager wertlos ekelhaft erbärmlich dumm",
    "insult_fr": "idiot imbécile crétin connard ordure minable dégoûtant pathétique stupide débile",
    "insult_es": "idiota imbécil estúpido basura escoria asqueroso patético inútil payaso cabrón",
    "profanity": "fuck fucking shit bitch asshole cunt crap damn scheiße merde mierda puta",
}
#: The pattern voters.
PATTERNS = {
    "threat": r"\b(?:kill|hurt|destroy) (?:you|yourself|them)\b|\bshut up\b|\bgo to hell\b",
    "masked": r"\b\w[*@#$]{2,}\w\b",
}
#: Families of mined terms that are voters of their own, those of most toxic rows; the others are one voter together.
FAMILIES = 24
#: Of a mined term: the least lower limit of its log odds ratio, share of toxic rows among its rows, and share of the toxic rows.
LEAST_ODDS, PURITY, COVERAGE = 0.3, 0.75, 0.008
#: Bounds of the samples, by hash of the id: labelled rows that terms are mined from, and documents that the classifier is trained on.
MOST_ROWS = 20_000
#: A longer word is known by its beginnings alone.
LONGEST = 40
WORDS = re.compile(r"[^\W\d_]+")
LIMIT = 0.7


def terms_of_word(word: str) -> tuple[str, ...]:
    """The word and, for longer words, its beginnings, which inflected and compounded forms share."""
    return (*((word,) if len(word) <= LONGEST else ()), *(f"{word[:k]}-" for k in (4, 5, 6, 7, 8) if len(word) > k))


def held_out(doc: Column) -> Column:
    """Rows whose labels are never learnt from; a null id isn't one of them."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class ToxicityModel:
    """Terms with the voter that each speaks for, the voters' accuracies, and the classifier."""

    terms: dict[str, int]
    voter: np.ndarray
    weights: np.ndarray
    bias: float
    accuracies: dict[str, tuple[float, float]] = field(default_factory=dict)
    correlated: list[tuple[str, str, float]] = field(default_factory=list)


class Reader:
    """Finds a text's terms and patterns; keeps what it has found out about words, within a bound."""

    def __init__(self, terms: dict[str, int]):
        self.terms, self.known = terms, {}
        self.patterns = [re.compile(p) for p in PATTERNS.values()]

    def terms_in(self, text: str) -> set[int]:
        out: set[int] = set()
        if len(self.known) > 150_000:
            self.known.clear()
        known, terms = self.known, self.terms
        for w in set(WORDS.findall(text.lower())):
            ids = known.get(w)
            if ids is None:
                ids = tuple(terms[t] for t in terms_of_word(w) if t in terms)
                if len(w) <= LONGEST:
                    known[w] = ids
            if ids:
                out.update(ids)
        return out

    def patterns_in(self, text: str) -> list[int]:
        low = text.lower()
        return [i for i, p in enumerate(self.patterns) if p.search(low)]


def _mined(sample: DataFrame) -> dict[str, int]:
    """Terms far more frequent in toxic rows of the sample than in others, with their number of toxic rows.

    Each stands in the part ``COVERAGE`` of the sample's toxic rows at least, which bounds their
    number by the terms of a usual text over that part, however many rows there are.
    """

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 100):  # terms take many times their text's memory
                part = pdf.iloc[at : at + 100]
                found = [list({t for w in set(WORDS.findall(x.lower())) for t in terms_of_word(w)}) for x in part["__text"]]
                yield pd.DataFrame({"toxic": part["toxic"].to_numpy(), "term": found})

    counted = sample.mapInPandas(run, "toxic int, term array<string>").select("toxic", F.explode("term").alias("term"))
    counted = counted.groupBy("term").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n")).where("pos >= 3")
    total = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos"), F.count(F.lit(1)).alias("n")).first()
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    a, b, c, d = pos + 0.5, total["pos"] - pos + 0.5, neg + 0.5, total["n"] - total["pos"] - neg + 0.5
    low = F.log(a * d / (b * c)) - 3 * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    # what marks toxicity recurs over its rows and hardly elsewhere; words that a few long texts share don't
    pure = (pos >= PURITY * F.col("n")) & (pos >= COVERAGE * total["pos"])
    top = counted.select("term", "pos", low.alias("low")).where((F.col("low") > LEAST_ODDS) & pure).collect()
    return {r["term"]: r["pos"] for r in top}


def families(mined: dict[str, int]) -> list[list[str]]:
    """Mined terms by the shortest mined beginning that they share, most frequent families first."""
    starts, found = {t[:-1] for t in mined if t.endswith("-")}, {}
    for t in sorted(mined):
        word = t.removesuffix("-")
        root = next((word[:k] for k in range(1, len(word) + 1) if word[:k] in starts), word)
        found.setdefault(root, []).append(t)
    return sorted(found.values(), key=lambda ts: (-max(mined[t] for t in ts), ts))


def _kinds(votes: np.ndarray, weight: np.ndarray, most: int = 8) -> np.ndarray:
    """kinds x voters, 0 or 1: voters that do not shun each other in rows of the given weight, by the most frequent of them.

    Texts of one language never fire the voters of another, so the positive class is of several kinds.
    """
    both = (votes * weight[:, None]).T @ votes
    often, total, found = np.diag(both).copy(), max(weight.sum(), 1e-9), []
    left = often > 0
    while left.any() and len(found) < most:
        seed = int(np.argmax(np.where(left, often, -1)))
        with_seed = (both[seed] * total > 0.5 * often[seed] * often) & (often > 0)
        with_seed[seed] = True
        found.append(with_seed)
        left &= ~with_seed
    return np.array(found, np.float64).reshape(len(found), votes.shape[1])


def label_model(votes: np.ndarray, count: np.ndarray, known: np.ndarray | None = None, turns: int = 80) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, float]]]:
    """Posterior of the positive class for each pattern of votes, the voters' rates and their dependencies.

    ``votes`` is patterns x voters, 0 or 1, with ``count`` rows each. The class is latent but where
    ``known`` isn't -1: those rows anchor the rates. The positive class is a mixture of kinds, which
    differ in the voters that fire together. Each voter depends on the class, its kind and on one
    other voter, along the tree of greatest mutual information given the class, so that voters that
    agree for other reasons don't count twice; for that, the other voters stand for the class of a
    pair where it isn't known. Rates and posteriors are fitted by expectation maximisation; the
    rates are voters x (negative, kinds) x (the other voter abstains, fires).
    """
    n, k = votes.shape
    total = max(float(count.sum()), 1.0)
    share = np.maximum(count / total, 0)
    known = np.full(n, -1) if known is None else known
    fired = votes.sum(1)
    guess = lambda f: np.where(known >= 0, known, np.choose(np.minimum(f, 2), [0.01, 0.6, 0.97]))
    parent = np.full(k, -1)
    info, links = np.zeros((k, k)), []
    for a in range(k):
        for b in range(a):
            q = guess(fired - votes[:, a] - votes[:, b])
            for y in (share * (1 - q), share * q):
                joint = np.array([[y @ ((votes[:, a] == u) & (votes[:, b] == v)) + 1e-12 for v in range(2)] for u in range(2)])
                info[a, b] += (joint * np.log(joint * joint.sum() / np.outer(joint.sum(1), joint.sum(0)))).sum()
            info[b, a] = info[a, b]
    inside = [0] if k else []
    while len(inside) < k:
        a, b = max(((i, j) for i in inside for j in range(k) if j not in inside), key=lambda x: info[x])
        parent[b] = a
        links.append((a, b, float(info[a, b])))
        inside.append(b)
    q = guess(fired)
    kinds = _kinds(votes, share * q)
    c = max(1, len(kinds)) + 1
    fit = (votes @ kinds.T if len(kinds) else np.zeros((n, 1))) + 1e-3
    by_kind = q[:, None] * fit / fit.sum(1, keepdims=True)  # patterns x kinds
    rates = np.zeros((k, c, 2))
    for _ in range(turns):
        given = np.where((known < 0)[:, None], by_kind, (known == 1)[:, None] * by_kind / np.maximum(by_kind.sum(1, keepdims=True), 1e-12))
        by_class = np.vstack([share * (1 - given.sum(1)), (share[:, None] * given).T])
        prior = (by_class.sum(1) * total + 0.1) / (by_class.sum() * total + 0.1 * c)
        logp = np.log(prior)[:, None] + np.zeros((c, n))
        for j in range(k):
            up = votes[:, parent[j]] if parent[j] >= 0 else np.zeros(n, np.int64)
            for y in range(c):
                for u in range(2):
                    w = by_class[y] * (up == u) * total
                    rates[j, y, u] = (w @ votes[:, j] + (0.02 if y == 0 else 0.1)) / (w.sum() + 1.0)
                r = rates[j, y][up]
                logp[y] += np.where(votes[:, j] == 1, np.log(r), np.log1p(-r))
        post = np.exp(logp - logp.max(0))
        new = (post / post.sum(0))[1:].T
        done = np.abs(new - by_kind).max(initial=0) < 1e-7
        by_kind = new
        if done:
            break
    return by_kind.sum(1), rates, links


def _linear(rows: list[np.ndarray], target: np.ndarray, times: np.ndarray, size: int, turns: int = 1500) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels with weights of no less than zero: text of any length is toxic only by what it has."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    heavy = times * np.where(target > 0.5, 1.0 / max(1.0, times[target > 0.5].sum()), 1.0 / max(1.0, times[target <= 0.5].sum()))
    x, m, v = np.append(np.full(size, 0.5), -2.0), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, turns + 1 if len(rows) else 1):
        z = x[-1] + np.bincount(owner, x[flat], len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target) * heavy
        g = np.append(np.bincount(flat, error[owner], size) + 1e-5 * x[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= 0.05 * (1 - t / (turns + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        x[:-1] = np.maximum(0.0, x[:-1])
    return x[:-1], float(x[-1])


def _read(rows: DataFrame, terms: dict[str, int], voter: list[int], carry: tuple[str, ...]) -> DataFrame:
    """``rows`` (columns ``carry`` and ``__text``) with ``votes``, a bit for each voter, and ``found``, the terms of the whole text."""
    first_pattern = len(LEXICONS)

    def run(batches):
        read = Reader(terms)
        for pdf in batches:
            marks, found = [], []
            for text in pdf["__text"]:
                ids = sorted(read.terms_in(text))
                bits = {voter[i] for i in ids} | {first_pattern + i for i in read.patterns_in(text)}
                marks.append(sum(1 << b for b in bits))
                found.append(ids)
            yield pdf[list(carry)].assign(votes=marks, found=found)

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.select(*carry, "__text").mapInPandas(run, f"{kinds}, votes long, found array<int>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = MOST_ROWS) -> tuple[ToxicityModel, DataFrame]:
    """The model fitted on ``docs``, and a stored table ``__id, found``: the terms of each document.

    Labels are used of rows that aren't held out, of at most ``most_rows`` of them, chosen by hash,
    for mining terms and to anchor the label model. Votes are counted over all documents, labelled
    or not: at most one row for each pattern of votes reaches the driver. The classifier is trained
    on the posteriors of at most ``most_rows`` documents, chosen by hash from all, and of the
    labelled ones, whose posterior is their label. Without labels the fixed voters alone decide.
    """
    chosen = labels.where(~held_out(F.col(id_col)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("toxic"))
    chosen = F.broadcast(cut(chosen.orderBy(F.xxhash64("__id"), "__id").limit(most_rows)))  # most_rows rows at most
    base = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    # copies of a text speak once, else all its words would seem to mark its label
    mined = _mined(base.join(chosen, "__id").select("toxic", "__text").dropDuplicates(["toxic", "__text"]))
    found = families({t: n for t, n in mined.items() if t not in {w for ws in LEXICONS.values() for w in ws.split()}})
    names = [*LEXICONS, *PATTERNS, *(f"family_{ts[0]}" for ts in found[:FAMILIES]), "other_families"]
    terms: dict[str, int] = {}
    voter: list[int] = []
    for k, entries in [*enumerate(ws.split() for ws in LEXICONS.values()), *((len(LEXICONS) + len(PATTERNS) + min(i, FAMILIES), ts) for i, ts in enumerate(found))]:
        for t in entries:
            if t not in terms:
                terms[t] = len(terms)
                voter.append(k)
    voted = cut(_read(base.join(chosen, "__id", "left").withColumn("toxic", F.coalesce("toxic", F.lit(-1))), terms, voter, ("__id", "toxic")))
    seen = voted.groupBy("votes", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    keys = sorted((r["votes"], r["toxic"]) for r in seen)
    counts = {(r["votes"], r["toxic"]): r["n"] for r in seen}
    votes = np.array([[(p >> j) & 1 for j in range(len(names))] for p, _ in keys], np.int64).reshape(len(keys), len(names))
    count = np.array([counts[k] for k in keys], np.float64)
    q, rates, links = label_model(votes, count, np.array([y for _, y in keys], np.int64))
    posterior = {p: v for (p, _), v in zip(keys, q.tolist(), strict=True)}
    sample = voted.orderBy(F.xxhash64("__id"), "__id").limit(most_rows).unionByName(voted.where("toxic >= 0").orderBy(F.xxhash64("__id"), "__id").limit(most_rows))
    train = sample.groupBy("votes", "toxic", "found").agg(F.count(F.lit(1)).alias("n")).collect()  # 2 * most_rows rows at most
    rows = [np.array(r["found"], np.int64) for r in train]
    target, times = np.array([posterior[r["votes"]] if r["toxic"] < 0 else r["toxic"] for r in train], np.float64), np.array([r["n"] for r in train], np.float64)
    weights, bias = _linear(rows, target, times, len(terms))
    share = lambda j, c: float((votes[:, j] * c).sum() / max(1e-9, c.sum()))
    truth = {names[j]: (share(j, count * q), share(j, count * (1 - q))) for j in range(len(names))}
    return ToxicityModel(terms, np.array(voter, np.int64), weights, bias, truth, [(names[a], names[b], i) for a, b, i in links]), voted.select("__id", "found")


def _logistic(z: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def score(model: ToxicityModel, text: Column) -> Column:
    """Score of each whole text, 0 to 1; a null text is empty."""
    terms, weights, bias = model.terms, model.weights, model.bias
    readers: list[Reader] = []

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if not readers:
            readers.append(Reader(terms))
        return pd.Series([_logistic(bias + sum(weights[i] for i in readers[0].terms_in(t))) for t in texts], dtype="float64")

    return scored(F.coalesce(text, F.lit("")))


def score_of_terms(model: ToxicityModel, found: Column) -> Column:
    """The same score from the terms found in a text."""
    weights, bias = model.weights, model.bias

    @F.pandas_udf("double")
    def scored(found: pd.Series) -> pd.Series:
        return pd.Series([_logistic(bias + weights[ids].sum()) if len(ids) else _logistic(bias) for ids in found], dtype="float64")

    return scored(found)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Scores depend on the text alone. A null text is empty; empty texts have the score of a text
    without any term. Repeated rows score alike; a null id is never held out nor learnt from; rows
    of ``labels`` without document, with null labels or repeated under one id (the greatest counts)
    are no error; ids may be of any type, the same in both tables; other columns are ignored; an
    empty table gives no rows.
    """
    model, read = fit(docs, labels, id_col, text_col)
    out = read.select(F.col("__id").alias("doc_id"), held_out(F.col("__id")).alias("held_out"), score_of_terms(model, F.col("found")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= LIMIT, 1).otherwise(0))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`toxicity` predicts to be toxic; nothing else is changed.

    All columns are kept whatever their names. Null and empty texts have no term and stay; repeated
    rows stay or go together; an empty table gives no rows.
    """
    model, _ = fit(docs, labels, id_col, text_col)
    row, text = packed(docs), f"c{docs.columns.index(text_col)}"
    kept = docs.select(row.alias("r")).where(score(model, F.col("r")[text]) < LIMIT)
    return kept.select(*[F.col("r")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])
