"""Line deduplication over the suffix array of line-ID sequences, by distributed prefix doubling."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import SPACE, cut, fresh, join_counted, packed, text_key, text_of

#: Parts that the second halves of one class are dealt to, in order, where its members are ranked.
PARTS = 256
WORD = r"[^\x20\x09-\x0D]+"
#: Members of an interval that may be ranked in one task, some 20 MB of rows.
HOT_GROUP = 1 << 18


def _lines(docs: DataFrame, id_col: str, text_col: str, min_words: int | None) -> DataFrame:
    """One row for each (id, text): ``u``, a number of its own, and its lines that aren't blank, in order, by place and names, and whether they have ``min_words`` words."""
    wide = lambda x: F.lit(False) if min_words is None else x.rlike(rf"(?:{WORD}{SPACE}){{{max(0, min_words - 1)}}}{WORD}")
    line = lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["line"]).alias("a"), F.xxhash64(F.lit(7), x["line"]).alias("b"), wide(x["line"]).alias("wide"))
    placed = F.transform(F.split(text_of(text_col), "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    held = F.transform(F.filter(placed, lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]")), line)
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), held.alias("lines")).where("size(lines) > 0")
    return cut(rows.groupBy("id", "key").agg(F.first("lines").alias("lines"))).withColumn("u", F.monotonically_increasing_id())


def _ranks(classes: DataFrame, group: list[str], part: Column, order: list[str], base: Column) -> DataFrame:
    """``classes`` with ``rank``: how many suffixes stand before each class in the order of all suffixes.

    A class of ``n`` suffixes takes ``n`` ranks. Within a group they are counted in two levels: over
    the classes of each part, and over the parts, so that no task sees all classes of a large group.
    """
    dealt = classes.withColumn("part", part)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*group, "part").agg(F.sum("n").alias("t"))
    # without a group this is one row for each of 4,096 parts at most
    offset = parts.select(*group, "part", F.coalesce(F.sum("t").over(before(Window.partitionBy(*group).orderBy("part"))), F.lit(0)).alias("offset"))
    inside = dealt.withColumn("inside", F.coalesce(F.sum("n").over(before(Window.partitionBy(*group, "part").orderBy(*order))), F.lit(0)))
    return inside.join(offset, [*group, "part"]).withColumn("rank", base + F.col("offset") + F.col("inside")).drop("part", "inside", "offset")


def _named(at: DataFrame, name: list[str]) -> DataFrame:
    """Classes of suffixes with one name: their number ``n`` and their first by (id, text, place)."""
    return at.groupBy(*name).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "key", "u", "i")).alias("first"))


def _settled(at: DataFrame, classes: DataFrame, name: list[str], total: int) -> DataFrame:
    return join_counted(at, cut(classes), name, "n", total).select("u", "i", "rank", "n", "first")


def _right(x: Column, bits: int) -> Column:
    return F.call_function("shiftright", x, F.lit(bits))


def _stored(table: DataFrame, held: DataFrame, state: DataFrame | None) -> DataFrame:
    """A row for each text that ``table`` has suffixes of: its ranks ``v`` so far, and ``later``, its suffixes that aren't the first of their interval.

    A rank, whether others share it and whether very many do are one long.
    """
    value = F.col("rank") * 4 + F.when(F.col("n") > HOT_GROUP, 3).when(F.col("n") > 1, 1).otherwise(0)
    later = F.when((F.col("n") > 1) & ((F.col("first.u") != F.col("u")) | (F.col("first.i") != F.col("i"))), F.struct("i", F.col("first.u").alias("fu"), F.col("first.i").alias("fi")))
    news = table.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("i", value.alias("v")))).alias("new"), F.collect_list(later).alias("later"))
    if state is None:
        return cut(news.join(held.select("u", "id", "key"), "u").select("u", "id", "key", F.col("new.v").alias("v"), "later"))
    # the array with its tied places replaced, in time linear in it
    last = F.concat(F.array(F.lit(-1)), F.col("new.i"))
    parts = F.flatten(F.zip_with("new", F.slice(last, 1, F.size("new")), lambda x, p: F.concat(F.slice("v", p + 2, x["i"] - p - 1), F.array(x["v"]))))
    rest = F.slice("v", F.element_at("new", -1)["i"] + 2, F.size("v"))
    return cut(state.drop("later").join(news, "u").select("u", "id", "key", F.concat(parts, rest).alias("v"), "later"))


def suffix_ranks(held: DataFrame, least: int = 1):
    """Prefix doubling to the end: yields (h, state) for each depth h.

    ``state`` has a row for each text with suffixes that were not alone before: ``v`` holds, for
    each suffix, its place in the suffix array as far as h lines tell (times 4, plus whether it
    shares the place), and ``later`` the suffixes ``i`` that have their first h lines in common with
    an earlier one, the first of whose interval is suffix ``fi`` of text ``fu``. Depths are 1,
    ``least``, and on twice the last one, until all suffixes are told apart; the end of a text is
    like nothing else. Intervals are split by ranking their members by the ranks of their second
    halves: those of more than ``HOT_GROUP`` members by counts of equal ones, in two levels, the
    others where they meet.
    """
    at = held.select("u", "id", "key", F.posexplode("lines").alias("i", "l")).select("u", "id", "key", "i", F.col("l.a").alias("a"), F.col("l.b").alias("b"))
    total = held.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    classes = _ranks(_named(at, ["a", "b"]), [], _right(F.col("a"), 52), ["a", "b"], F.lit(0).cast("long"))
    state = _stored(_settled(at.drop("id", "key"), classes, ["a", "b"], total), held, None)
    yield 1, state
    h, width = 1, max(1, -(-total // PARTS))
    while True:
        kinds = state.select(F.explode(F.transform("v", lambda x: x % 4)).alias("kind")).where("kind > 0").groupBy("kind").count().collect()
        if not kinds:
            return
        step = min(h, least - h) if h < least else h
        both = F.transform(F.zip_with("v", F.slice("v", step + 1, F.size("v")), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p, i: F.struct(i.alias("i"), p["x"].alias("x"), p["y"].alias("y")))
        at = state.select("u", "id", "key", F.explode(F.filter(both, lambda p: p["x"] % 2 == 1)).alias("p"))
        at = at.select("u", "id", "key", "p.i", (F.col("p.x") % 4 == 3).alias("hot"), _right(F.col("p.x"), 2).alias("r1"), F.coalesce(_right(F.col("p.y"), 2), -1 - F.col("u")).alias("r2"))
        group, name = Window.partitionBy("r1"), Window.partitionBy("r1", "r2")
        met = at.where("not hot").withColumn("rank", F.col("r1") + F.rank().over(group.orderBy("r2")) - 1).withColumn("n", F.count(F.lit(1)).over(name)).withColumn("first", F.min(F.struct("id", "key", "u", "i")).over(name))
        table = met.select("u", "i", "rank", "n", "first")
        if any(r["kind"] == 3 for r in kinds):
            half = F.when(F.col("r2") < 0, _right(F.col("r2"), 33)).otherwise(F.floor(F.col("r2") / width))
            many = at.where("hot")
            classes = _ranks(_named(many, ["r1", "r2"]), ["r1"], half, ["r2"], F.col("r1"))
            table = table.unionByName(_settled(many.select("u", "i", "r1", "r2"), classes, ["r1", "r2"], sum(r["count"] for r in kinds if r["kind"] == 3)))
        h += step
        state = _stored(table, held, state)
        yield h, state


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_words: int | None = None) -> DataFrame:
    """Maximal later copies of line runs: ``u, id, key, start, length, first_id, first_start``, places counted in lines that aren't blank.

    From the intervals of the suffix array (see :func:`suffix_ranks`): a suffix that isn't the first
    of its interval copies as many lines as the interval has in common. Neighbouring suffixes that
    copy neighbouring lines of one text are one run, as long as the last of them reaches. Runs of
    fewer than ``min_lines`` lines are left out, but for those all of whose lines have ``min_words``
    words, if that is given. Null and empty texts have no lines; rows repeated under one id and text are one text;
    an empty table has no runs; other columns are ignored.
    """
    held = _lines(docs, id_col, text_col, min_words)
    mine, first = held.select("u", "id", "key", "lines"), held.select(F.col("u").alias("fu"), F.col("id").alias("first_id"))
    runs = _runs(held, min_lines, min_words).join(mine, "u").where(F.size(_counted(F.col("start"), F.col("length"), min_lines)) == F.col("length"))
    return runs.join(first, "fu").select("u", "id", "key", "start", "length", "first_id", "first_start")


def _counted(start: Column, length: Column, min_lines: int) -> Column:
    """The lines of a run that count: all of a run that is long enough, else those wide enough."""
    return F.filter(F.slice("lines", start + 1, length), lambda x: (length >= min_lines) | x["wide"])


def _runs(held: DataFrame, min_lines: int, min_words: int | None) -> DataFrame:
    """``u, start, length, fu, first_start`` of all runs; single lines of any width are among them where ``min_words`` is given."""
    marks = []
    for h, state in suffix_ranks(held, min_lines):
        if h >= min_lines or (h == 1 and min_words is not None):
            marks.append(state.select("u", F.explode("later").alias("x")).select("u", "x.i", F.lit(h).alias("h"), "x.fu", "x.fi"))
    # all that follows keeps the texts where they are dealt here
    dealt = functools.reduce(DataFrame.unionByName, marks).repartition("u")
    deep = dealt.groupBy("u", "i").agg(F.max(F.struct("h", "fu", "fi")).alias("m")).select("u", "i", "m.*")
    by = Window.partitionBy("u").orderBy("i")
    new = ~((F.lag("i").over(by) == F.col("i") - 1) & (F.lag("fu").over(by) == F.col("fu")) & (F.lag("fi").over(by) == F.col("fi") - 1))
    chained = deep.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(by))
    runs = chained.groupBy("u", "run").agg(F.min("i").alias("start"), F.max(F.col("i") + F.col("h")).alias("end"), F.first("fu").alias("fu"), F.min("fi").alias("first_start"))
    return runs.select("u", "start", (F.col("end") - F.col("start")).alias("length"), "fu", "first_start")


def _without(lines: Column, gone: Column) -> Column:
    """The lines whose index isn't in ``gone`` (sorted), in time linear in both."""
    before = F.concat(F.array(F.lit(-1)), F.slice(gone, 1, F.greatest(F.size(gone) - 1, F.lit(0))))
    flags = F.flatten(F.zip_with(before, gone, lambda a, b: F.array_append(F.array_repeat(F.lit(0), b - a - 1), F.lit(1))))
    return F.array_join(F.zip_with(lines, flags, lambda x, f: F.when(F.coalesce(f, F.lit(0)) == 0, x)), "\n")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_words: int | None = 3) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted; adds ``__n_lines``, ``__n_deleted`` (long).

    A run is ``min_lines`` or more lines that follow each other, blank lines apart, and stand more
    than once in the table, or a single such line of ``min_words`` words (None: single lines stay).
    Its first occurrence by (id, position) stays and the lines of every later one go, also within
    one document; blank lines stay. Runs are judged on the input. A null text stays null, an empty
    one empty; a text may become empty; rows repeated under one id and text are one document. Null
    ids sort first; ids may be of any type that has an order. All columns of ``docs`` are kept whatever
    their names; where ``docs`` has a column called like an added one, the added one gets an underscore more.
    """
    held = _lines(docs, id_col, text_col, min_words)
    runs = _runs(held, min_lines, min_words).groupBy("u").agg(F.collect_list(F.struct("start", "length")).alias("runs")).join(held, "u")
    at = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.transform(_counted(r["start"], r["length"], min_lines), lambda x: x["pos"]))))
    gone = runs.select(F.col("id").alias("__doc"), F.col("key").alias("__gk"), F.sort_array(at).alias("__gone")).where("size(__gone) > 0")
    keyed = docs.select(packed(docs).alias("__row"), F.col(id_col).alias("__id"), text_key(text_col).alias("__key"))
    joined = keyed.join(gone, keyed["__id"].eqNullSafe(gone["__doc"]) & (keyed["__key"] == gone["__gk"]), "left")
    text = F.col("__row")[f"c{docs.columns.index(text_col)}"]
    lines = F.split(text, "\n")
    kept = F.when(F.col("__gone").isNull(), text).otherwise(_without(lines, F.col("__gone")))
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    n_gone = F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("long")
    return joined.select(*[(kept if c == text_col else F.col("__row")[f"c{i}"]).alias(c) for i, c in enumerate(docs.columns)], n_lines.alias(fresh(docs, "__n_lines")), n_gone.alias(fresh(docs, "__n_deleted")))


def line_report(docs: DataFrame, min_lines: int = 2, min_words: int | None = 3) -> DataFrame:
    """``doc_id, n_lines, n_deleted, kept_sha256`` of :func:`line_dedup` (a null text has no lines and the digest of nothing)."""
    out = line_dedup(docs.select("doc_id", "text"), min_lines=min_lines, min_words=min_words)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_deleted").alias("n_deleted"), F.sha2(text_of(), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents where text is not null),
n as (select *, lead(line) over w as nxt, lead(pos) over w as npos from l where regexp_matches(line, '[^\x20\x09-\x0D]') window w as (partition by doc_id order by pos)),
one as (select doc_id, pos, row_number() over (partition by line order by doc_id, pos) as k from n where len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 3),
two as (select doc_id, pos, npos, row_number() over (partition by line, nxt order by doc_id, pos) as k from n where npos is not null),
gone as (select doc_id, pos from one where k > 1 union select doc_id, pos from two where k > 1 union select doc_id, npos from two where k > 1),
agg as (select l.doc_id, count(*) as n_lines, count(g.pos) as n_deleted,
        coalesce(string_agg(l.line, chr(10) order by l.pos) filter (where g.pos is null), '') as kept
        from l left join gone g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id)
select d.doc_id, coalesce(a.n_lines, 0) as n_lines, coalesce(a.n_deleted, 0) as n_deleted, sha256(coalesce(a.kept, '')) as kept_sha256
from documents d left join agg a on d.doc_id = a.doc_id
"""
