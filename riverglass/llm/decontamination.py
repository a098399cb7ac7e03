"""Benchmark decontamination: windows of template tokens are hash-joined and their slots checked. DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, without

#: Tokens in a window; an item's windows start at every token, a document's tile it under one rule and slide under the other.
WINDOW = 5
TILED, SLIDING = 0, 1
#: How far apart the diagonals of a passage may be under the sliding rule: tokens more or less inside it.
DRIFT = 4
#: Literal tokens that a window of an item needs: one of placeholders alone says nothing.
MIN_LITERAL = 2
#: Windows that must match on one diagonal, and their share of those that could.
MIN_WINDOWS, COVERAGE = 2, 0.6
#: Characters of benchmark text up to which its windows are broadcast; beyond it the join is shuffled.
BROADCAST_CHARS = 4_000_000
#: Units that follow a number.
UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "lb", "oz", "ml", "cl", "l",
    "s", "sec", "min", "h", "hr", "hours", "minutes", "seconds", "days", "weeks", "months", "years",
    "meters", "metres", "kilometers", "miles", "feet", "inches", "grams", "kilograms", "pounds", "liters", "litres",
    "dollars", "cents", "euros", "percent", "degrees", "kmh", "mph", "hz", "kw", "v", "w",
)
_APART = "[^\\p{L}\\p{N}_]+"
_SLOT, _GLUE = "(?:[0-9]|\\p{Lu}\\p{Ll})", "\u0001"
_PLACE = "<(?:num|unit|name)>"
#: Bits, of which each item window sets two: a document window without both is no item's. (They stand in the plan, so they are few.)
BITS = 1 << 20


def tokens(text: Column) -> Column:
    """Runs of letters and digits; a point, comma, colon or slash inside a number stays part of it.

    A capital that starts a sentence gets a mark before it, as it says nothing of names.
    """
    text = F.concat(F.lit("\n"), F.coalesce(text, F.lit("")))
    joined = F.when(text.rlike("[0-9][.,:/][0-9]"), F.regexp_replace(text, "([0-9])[.,:/](?=[0-9])", "$1_")).otherwise(text)
    marked = F.regexp_replace(joined, "([.!?:\n])[^\\p{L}\\p{N}]*+(?=\\p{Lu})", "$1 _")
    return F.array_remove(F.split(marked, _APART), "")


def template(window: Column) -> Column:
    """The window's tokens in lower case, a space between them, with typed placeholders for numbers, units after numbers, and names.

    A name is a word with one capital, its first, that doesn't start a sentence; so texts all in capitals keep their words.
    """
    text = F.concat_ws(" ", window)
    numbers = F.regexp_replace(text, "[0-9](?<![^ ][0-9])[^ ]*", "<num>")  # a look back only where there is a digit
    units = F.regexp_replace(numbers, f"<num> (?i:{'|'.join(UNITS)})(?![^ ])", "<num> <unit>")
    text = F.when(text.rlike("[0-9]"), units).otherwise(text)
    text = F.regexp_replace(text, "\\p{Lu}(?<![^ ]\\p{Lu})\\p{Ll}[^ ]*", "<name>")
    return F.lower(F.replace(text, F.lit("_"), F.lit("")))


def _glued(t: Column) -> Column:
    """The tokens as one string, a space between them but a mark inside each run of numbers, units after numbers, and names."""
    text = F.regexp_replace(F.concat_ws(" ", t), f"((?<![^ ])[0-9][^ ]*) (?=(?i:{'|'.join(UNITS)})(?![^ ]))", f"$1{_GLUE}")
    return F.regexp_replace(text, f"((?<![^ ]){_SLOT}[^ ]*) (?={_SLOT})", f"$1{_GLUE}")


def _collapsed(kinds: Column) -> Column:
    """A template with one placeholder for each run of them."""
    return F.regexp_replace(kinds, f"{_PLACE}(?: {_PLACE})*+", "<slot>")  # possessive: else Java goes one call deeper for each placeholder


def _listed(words: Column, full: Column) -> Column:
    return F.when(full, F.split(words, " ")).otherwise(F.array().cast("array<string>"))


def _window(words: Column, i: Column, size: int | Column) -> Column:
    """The words i to i + size - 1. One by one where the size is known: slice() would go over the whole array each time."""
    return F.array(*(F.get(words, i + (k - 1)) for k in range(size))) if isinstance(size, int) else F.slice(words, i, size)


def _hash(rule: int, raw: Column, kinds: Column, size: int | Column, i: Column) -> Column:
    """The hash of rule and template of the window that starts with token i."""
    if rule == SLIDING:
        return F.xxhash64(F.lit(rule), _window(kinds, i, size))
    first = F.get(kinds, i - 1)  # a unit that starts a window has no number before it there
    return F.xxhash64(F.lit(rule), F.when(first == "<unit>", F.lower(F.replace(F.get(raw, i - 1), F.lit("_"), F.lit("")))).otherwise(first), _window(kinds, i + 1, WINDOW - 1))


def _starts(step: int, last: Column) -> Column:
    """The places of windows: every step-th token, none if there are too few."""
    return F.when(last >= 1, F.sequence(F.lit(1), last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _cut(rule: int, raw: Column, kinds: Column, size: int | Column, starts: Column) -> Column:
    """An array of (at, h, raw): the windows at these places."""
    return F.transform(starts, lambda i: F.struct(i.alias("at"), _hash(rule, raw, kinds, size, i).alias("h"), _window(raw, i, size).alias("raw")))


def _shape(rule: Column, raw: Column) -> Column:
    """The template of one window."""
    tiled = template(raw)
    return F.split(F.when(rule == TILED, tiled).otherwise(_collapsed(template(F.split(F.translate(F.concat_ws(" ", raw), _GLUE, " "), " ")))), " ")


def _read(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, t, kinds, runs, shapes): tokens and their templates, alone and with runs of placeholders collapsed.

    Templates are made of whole texts, so each expression runs once for a text.
    """
    cut = rows.select(F.col(id_col).cast("bigint").alias(id_col), tokens(F.col("text").cast("string")).alias("t"))
    cut = cut.select("*", template(F.col("t")).alias("words"))
    full = F.size("t") > 0
    return cut.select(id_col, "t", _listed(F.col("words"), full).alias("kinds"), _listed(_glued(F.col("t")), full).alias("runs"), _listed(_collapsed(F.col("words")), full).alias("shapes"))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, rule, h, item_at, item_raw, item_shape, possible): the items' windows under both rules.

    Tiled: those of WINDOW tokens with enough literal ones; possible: how many windows of the item a document that
    holds it whole can match at this alignment. Sliding: those of WINDOW collapsed tokens, or of all n of a shorter
    item with enough literal ones. There an item counts twice, as its first word may be a name or only start a sentence.
    """
    from pyspark.sql import Window

    texts = benchmark.where("item_id is not null").select("item_id", F.col("text").cast("string").alias("text"))
    read = _read(texts, "item_id").distinct()
    inside = read.select("item_id", F.transform("t", lambda x, i: F.when(i == 0, F.replace(x, F.lit("_"), F.lit(""))).otherwise(x)).alias("t")).where(F.get("t", F.lit(0)).rlike("^\\p{Lu}"))
    inside = inside.select("item_id", F.split(_glued(F.col("t")), " ").alias("runs"), F.split(_collapsed(template(F.col("t"))), " ").alias("shapes"))
    tiled = read.select("item_id", F.size("t").alias("n"), F.lit(0).alias("variant"), F.lit(TILED).alias("rule"), F.explode(_cut(TILED, F.col("t"), F.col("kinds"), WINDOW, _starts(1, F.size("t") - (WINDOW - 1)))).alias("w"))
    both = read.select("item_id", F.lit(0).alias("variant"), "runs", "shapes").unionByName(inside.select("item_id", F.lit(1).alias("variant"), "runs", "shapes"))
    size = F.least(F.size("runs"), F.lit(WINDOW))
    slid = both.select("item_id", F.size("runs").alias("n"), "variant", F.lit(SLIDING).alias("rule"), F.explode(_cut(SLIDING, F.col("runs"), F.col("shapes"), size, _starts(1, F.size("runs") - size + 1))).alias("w"))
    literal = F.size(F.filter("item_shape", lambda x: ~x.startswith("<")))
    found = tiled.unionByName(slid).select("item_id", "n", "variant", "rule", "w.h", F.col("w.at").alias("item_at"), F.col("w.raw").alias("item_raw"), _shape(F.col("rule"), F.col("w.raw")).alias("item_shape")).where(literal >= MIN_LITERAL).distinct()
    aligned = Window.partitionBy("item_id", "rule", "variant", F.pmod(F.col("item_at"), F.lit(WINDOW)))
    return found.withColumn("possible", F.count(F.lit(1)).over(aligned))


def _met(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Windows of documents with the item windows of the same template.

    Up to BROADCAST_CHARS of benchmark text, windows whose bits no item has are left out before anything is made of
    them, by two of BITS bits. The join after it is exact, and the same beyond.
    """
    items = item_windows(benchmark)
    small = (benchmark.agg(F.sum(F.length("text"))).first()[0] or 0) <= BROADCAST_CHARS
    short = [r.k for r in items.where(F.col("rule") == SLIDING).select(F.size("item_shape").alias("k")).distinct().collect() if r.k < WINDOW]
    held = [0] * (BITS >> 6)
    if small:
        for r in items.select("h").distinct().collect():  # windows of at most BROADCAST_CHARS characters
            for bit in (r.h & (BITS - 1), r.h >> 24 & (BITS - 1)):
                held[bit >> 6] |= 1 << (bit & 63)
    table = F.split(F.lit(",".join(str(x - (x >> 63 << 64)) for x in held)), ",").cast("array<bigint>")

    def has(h: Column, by: int) -> Column:
        bit = F.shiftright(h, by).bitwiseAND(F.lit(BITS - 1)).cast("int")
        word = F.get(table, F.shiftright(bit, 6))
        return F.call_function("shiftright", word, bit.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1

    def likely(rule: int, raw: Column, kinds: Column, size: int, starts: Column) -> Column:
        if not small:
            return starts
        return F.filter(starts, lambda i: F.exists(F.array(_hash(rule, raw, kinds, size, i)), lambda h: has(h, 0) & has(h, 24)))

    t, kinds, shapes = F.col("t"), F.col("kinds"), F.col("shapes")
    full = F.size(t) > 0
    read = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), tokens(F.col("text").cast("string")).alias("t"))
    read = read.select("*", template(t).alias("words")).select("doc_id", "t", _listed(F.col("words"), full).alias("kinds"), _listed(_collapsed(F.col("words")), full).alias("shapes"))
    sizes = [WINDOW, *short]
    slid = [likely(SLIDING, t, shapes, k, _starts(1, F.size(shapes) - (k - 1))).alias(f"s{k}") for k in sizes]
    found = read.select("doc_id", "t", "kinds", "shapes", likely(TILED, t, kinds, WINDOW, _starts(WINDOW, F.size(t) - (WINDOW - 1))).alias("tiled"), *slid)
    #: The words of collapsed windows are needed where there are some, in few documents.
    any_ = F.greatest(*(F.size(f"s{k}") for k in sizes), F.lit(0)) > 0
    found = found.select("*", F.when(any_, F.split(_glued(t), " ")).alias("runs"))
    made = [_cut(TILED, t, kinds, WINDOW, F.col("tiled"))] + [F.when(any_, _cut(SLIDING, F.col("runs"), shapes, k, F.col(f"s{k}"))).otherwise(F.array().cast("array<struct<at:int,h:bigint,raw:array<string>>>")) for k in sizes]
    rows = found.select("doc_id", F.explode_outer(F.concat(*made)).alias("w"))  # outer: plain explode would have the array made twice, to test its size
    mine = rows.select("doc_id", F.col("w.h").alias("h"), "w.at", "w.raw")
    same = F.array_contains(F.array("item_shape"), _shape(F.col("rule"), F.col("raw")))  # not =, so that the hash alone is the join's key
    return mine.join(F.broadcast(items) if small else items, "h").where(same).withColumn("shift", F.col("at") - F.col("item_at"))


def _consistent(slots: str) -> Column:
    """Whether every slot value of the item has a single value in the document."""
    values = F.array_distinct(slots)
    return F.size(values) == F.size(F.array_distinct(F.transform(values, lambda x: x["item"])))


def matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, n_slots): the items that each document holds, re-parameterised or not.

    Texts become templates; windows of WINDOW tokens are joined by 64-bit hash and template. Two rules find pairs:

    Tiled: document windows tile it, item windows start at every token. At one alignment at least MIN_WINDOWS windows
    match, which are at least COVERAGE of those possible there (coverage). By it a passage of 3 * WINDOW - 1 tokens is
    found at every alignment, one of 2 * WINDOW at one alignment of WINDOW.

    Sliding: runs of placeholders count as one token, and windows start at every token of both. Matched windows cover at
    least COVERAGE of the item's n tokens (coverage), and at least 2 * WINDOW - 1 of them or all but one; items of up to
    WINDOW tokens match whole. They lie on one diagonal, or for items of 2 * WINDOW tokens or more on diagonals at most
    DRIFT apart, so tokens more or less inside the passage don't lose it. It gives the pairs that the tiled rule misses.

    In both every slot value of the item has a single value in the document (n_slots: placeholders compared; sliding
    leaves out the item's first and last token, whose run may go on outside). Of several alignments the best counts.
    An item with fewer than MIN_LITERAL literal tokens can't be found.

    Null and empty texts hold nothing, null ids of documents form rows with a null doc_id, null item ids are
    left out, repeated rows give the pair once, empty tables give no rows, other columns are not read.
    """
    slots = F.filter(
        F.transform("item_shape", lambda k, i: F.struct(k.alias("kind"), (F.col("item_at") + i).alias("place"), F.get("item_raw", i).alias("item"), F.get("raw", i).alias("own"))),
        lambda x: x["kind"].startswith("<") & ((F.col("rule") == TILED) | ((x["place"] > 1) & (x["place"] < F.col("n")))),
    )
    pairs = F.transform(slots, lambda x: F.struct(x["item"].alias("item"), x["own"].alias("own")))
    bands = F.array(F.struct(F.lit(0).alias("band"), F.col("shift").cast("bigint").alias("line")), *(F.struct(F.lit(k).alias("band"), F.floor((F.col("shift") + (k - 1) * DRIFT) / (2 * DRIFT)).alias("line")) for k in (1, 2)))
    bands = F.slice(bands, 1, F.when((F.col("rule") == SLIDING) & (F.col("n") >= 2 * WINDOW), 3).otherwise(1))
    rows = _met(documents, benchmark).select("doc_id", "item_id", "rule", "variant", "n", "shift", "at", "item_at", "possible", F.size("item_shape").alias("k"), pairs.alias("slots"), bands.alias("bands")).dropDuplicates(["doc_id", "item_id", "rule", "variant", "shift", "at", "k"])
    rows = rows.withColumn("b", F.explode("bands"))
    places = F.when(F.col("rule") == SLIDING, F.sequence("item_at", F.col("item_at") + F.col("k") - 1)).otherwise(F.array().cast("array<int>"))
    lined = rows.groupBy("doc_id", "item_id", "rule", "variant", "n", "b").agg(
        F.count(F.lit(1)).alias("n_windows"), F.first("possible").alias("possible"), F.flatten(F.collect_list("slots")).alias("slots"), F.size(F.array_distinct(F.flatten(F.collect_list(places)))).alias("covered")
    )
    coverage = F.when(F.col("rule") == TILED, F.col("n_windows") / F.col("possible")).otherwise(F.col("covered") / F.col("n"))
    enough = F.when(F.col("rule") == TILED, F.col("n_windows") >= MIN_WINDOWS).otherwise(F.col("covered") >= F.least(F.lit(2 * WINDOW - 1), F.greatest(F.col("n") - 1, F.least(F.col("n"), F.lit(WINDOW)))))
    held = lined.where(_consistent("slots") & enough & (coverage >= COVERAGE))
    best = F.max(F.struct((-F.col("rule")).alias("rule"), "n_windows", F.round(coverage, 6).alias("coverage"), F.size("slots").cast("bigint").alias("n_slots"))).alias("b")
    return held.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.n_windows", "b.coverage", "b.n_slots")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TOKENS_SQL = r"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([0-9])[.,:/]([0-9])', '\1_\2', 'g'), '([0-9])[.,:/]([0-9])', '\1_\2', 'g'), '(^|[.!?:\n])[^\p{L}\p{N}]*(\p{Lu})', '\1 _\2', 'g'), '[^\p{L}\p{N}_]+'), lambda x: x <> '')"
_SHAPE_SQL = rf"""list_transform(raw, lambda x, i: CASE WHEN regexp_matches(x, '^[0-9]') THEN '<num>'
    WHEN i > 1 AND regexp_matches(raw[i - 1], '^[0-9]') AND list_contains([{", ".join(f"'{u}'" for u in UNITS)}], lower(x)) THEN '<unit>'
    WHEN regexp_matches(x, '^\p{{Lu}}\p{{Ll}}') THEN '<name>' ELSE lower(replace(x, '_', '')) END)"""
OP3_SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id, {_TOKENS_SQL} AS t FROM documents), b AS (SELECT DISTINCT item_id, {_TOKENS_SQL} AS t FROM benchmark),
dw AS (SELECT doc_id, pos, t[pos:pos + 4] AS raw FROM (SELECT doc_id, t, unnest(range(1, len(t) - 3, 5)) AS pos FROM d)),
bw AS (SELECT item_id, pos, t[pos:pos + 4] AS raw FROM (SELECT item_id, t, unnest(range(1, len(t) - 3)) AS pos FROM b)),
ds AS MATERIALIZED (SELECT doc_id, pos, raw, {_SHAPE_SQL} AS shape FROM dw),
bs AS MATERIALIZED (
  SELECT *, count(*) OVER (PARTITION BY item_id, pos % 5) AS possible
  FROM (SELECT item_id, pos AS item_at, pos, raw AS item_raw, {_SHAPE_SQL} AS shape FROM bw) WHERE len(list_filter(shape, lambda x: NOT starts_with(x, '<'))) >= 2),
m AS (SELECT doc_id, item_id, ds.pos - bs.pos AS shift, possible,
        list_filter(list_transform(shape, lambda s, i: {{'kind': s, 'item': item_raw[i], 'own': raw[i]}}), lambda x: starts_with(x.kind, '<')) AS slots
      FROM ds JOIN bs USING (shape)),
g AS (SELECT doc_id, item_id, shift, count(*) AS n, any_value(possible) AS possible, flatten(list(list_transform(slots, lambda x: {{'item': x.item, 'own': x.own}}))) AS slots FROM m GROUP BY 1, 2, 3),
h AS (SELECT * FROM g WHERE n >= 2 AND n / possible >= 0.6 AND len(list_distinct(slots)) = len(list_distinct(list_transform(list_distinct(slots), lambda x: x.item)))),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, round(n / possible, 6) DESC, len(slots) DESC) AS k FROM h)
SELECT doc_id, item_id, n AS n_windows, round(n / possible, 6) AS coverage, len(slots) AS n_slots FROM r WHERE k = 1
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of the benchmark. Rows without doc_id stay."""
    found = matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return without(docs, found)
