"""Line deduplication within an edit bound, by a deletion-neighbourhood join.

A line is its normal form: lower-cased words with one space between them.  Two
lines are alike if they are equal or one edit (an insertion, a deletion or a
replacement) makes them so.  What is edited follows from the length, so that an
edit is always a small part of the line:

* lines of ``MIN_WORDS`` words or more: one word;
* shorter ones of ``MIN_CHARS`` characters or more: one character (so also lines
  in a script without spaces);
* still shorter ones: nothing, they must be equal.

A line goes if an alike one stands earlier, by document id, then line number,
whether or not that one stays itself.

Equal lines are found by 128-bit hashes.  For the others, each distinct line

1. emits its halves: of two alike lines whose longer one has N units (words or
   characters), either the first or the last (N - 1) // 2 units are equal, so a
   line whose halves no other distinct line has is alike to none and is done;
2. emits, for the half in which the difference must lie, all variants with one
   unit deleted (and, for a partner with a unit more, all with a gap), as
   128-bit hashes of what stands before and after; two lines have equal
   variants at the same place exactly if they are alike;
3. is joined to the earliest line with an equal variant, and the two are compared
   unit by unit.

All lines with one variant are alike, so the earliest stands for all of them and
pairs within a group are never made.  Hashes of what stands before and after a
unit are running sums in a window over the line's units, so a line of n units
costs n rows, and very long lines spill.  Texts are parsed once; everything is
built-in functions.

Defined results: null and empty texts have one blank line; blank lines stay.
Null ids are smaller than any other.  Documents that share an id are told apart
by their texts; of their lines with equal numbers the one with the smaller hash
stands earlier.  Equal lines with equal ids and numbers all stay.  An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, stored

MIN_WORDS = 8
MIN_CHARS = 16
#: Bits of each of the two sums by which variants are told apart.
_MASK = (1 << 44) - 1
#: Kinds of lines with a larger share of all lines are common ones.
HEAVY = 1 / 2000
_LINES, _TIES = 1 << 32, 10**9


def _normal(text: str) -> str:
    """SQL: lower-cased words with one space between; lines that are so already aren't split."""
    odd = " OR ".join(f"contains({text}, {c})" for c in (r"'\t'", r"'\u000b'", r"'\u000c'", r"'\r'", "'  '"))
    words = rf"array_remove(split(translate(lower({text}), '\t\u000b\u000c\r', '    '), ' '), '')"
    return f"CASE WHEN {odd} OR startswith({text}, ' ') OR endswith({text}, ' ') THEN array_join({words}, ' ') ELSE lower({text}) END"


#: SQL: the order of lines as one number, from ``doc_id``, ``line`` and the line's hash.
_PLACE = f"""cast((coalesce(cast(doc_id AS decimal(20, 0)), -9223372036854775809BD) * {_LINES}BD + line) * {_TIES}BD
    + pmod(h1, {_TIES}L) AS decimal(38, 0))"""


def _doc_and_line(place: Column) -> tuple[Column, Column]:
    number = F.floor(place / F.lit(_TIES))
    doc = F.floor(number / F.lit(_LINES))
    null = F.when(doc >= F.lit(-(1 << 63)), doc.cast("long"))
    return null, (number - doc * F.lit(_LINES)).cast("int")


def _document(id_col: str, text_col: str) -> list[Column]:
    """What tells a document: id and a 128-bit hash of its text (``doc_id``, ``t1``, ``t2``)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All lines: document, ``line``, hashes ``h1`` and ``h2``, ``normal``; lines are split at line feeds."""
    lines = docs.select(*_document(id_col, text_col), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line", "text"))
    lines = lines.select("doc_id", "t1", "t2", "line", F.expr(_normal("text")).alias("normal"))
    return lines.select("doc_id", "t1", "t2", "line", F.xxhash64("normal").alias("h1"), F.xxhash64(F.lit(7), "normal").alias("h2"), "normal")


def _with_units(lines: DataFrame, min_words: int, min_chars: int) -> DataFrame:
    """Adds ``by_word`` and the number of ``units`` (null: too short for an edit)."""
    words = F.expr("octet_length(normal) - octet_length(replace(normal, ' ', '')) + 1")
    chars = F.length("normal")
    return lines.withColumn("by_word", words >= min_words).withColumn("units", F.when(F.col("by_word"), words).when(chars >= min_chars, chars))


def _halves() -> list[Column]:
    """Hashes of the halves: first and last (units - 1) // 2 units, and units // 2 where that is another number."""
    out = []
    for name, m in (("a", "((units - 1) div 2)"), ("b", "if(units % 2 = 0, units div 2, null)")):
        m = f"cast({m} AS int)"
        for side, word, char in ((0, f"substring_index(normal, ' ', {m})", f"substring(normal, 1, {m})"), (1, f"substring_index(normal, ' ', -{m})", f"substring(normal, -{m})")):
            out.append(F.expr(f"if({m} IS NULL, null, xxhash64({m}, {side}, by_word, if(by_word, {word}, {char})))").alias(f"{name}{side}"))
    return out


def _variants(lines: DataFrame) -> DataFrame:
    """(``v1``, ``v2``, ``h1``, ``h2``, ``place``) of lines with ``normal`` and flags ``slots`` of the halves they share.

    Row ``i`` of a line's window is its unit i; one more row stands for the gap at the end.
    """
    rows = lines.select("h1", "h2", "place", "units", "slots", F.posexplode(F.expr("array_append(if(by_word, split(normal, ' '), split(normal, '')), null)")).alias("pos", "unit"))
    rows = rows.withColumn("i", F.col("pos") + 1)
    part = lambda seed, at: F.when(F.col("unit").isNull(), 0).otherwise(F.xxhash64(F.lit(seed), "unit", at).bitwiseAND(F.lit(_MASK)))
    for seed in (1, 2):
        rows = rows.withColumn(f"p{seed}", part(seed, F.col("i"))).withColumn(f"q{seed}", part(seed + 2, F.col("i") - F.col("units")))
    line = Window.partitionBy("h1", "h2").orderBy("i")
    so_far, whole = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mask = lambda c: c.bitwiseAND(F.lit(_MASK))
    sums = [(mask(F.sum(f"p{s}").over(so_far)) - F.col(f"p{s}")).alias(f"before{s}") for s in (1, 2)]
    sums += [(F.sum(f"q{s}").over(whole) - F.sum(f"q{s}").over(so_far)).alias(f"after{s}") for s in (1, 2)]
    rows = rows.select("h1", "h2", "place", "units", "slots", "i", "q1", "q2", *sums)
    # the line is the longer one (unit i goes) or the shorter one (a gap before unit i)
    shares = lambda slot: (F.col("slots").bitwiseAND(F.lit(1 << slot)) > 0)
    m1, m2 = F.expr("(units - 1) div 2"), F.expr("units div 2")
    odd = F.col("units") % 2 == 1
    longer = (F.col("i") <= F.col("units")) & F.when(F.col("i") > m1, shares(0)).otherwise(shares(1))
    shorter = F.when(F.col("i") > m2, F.when(odd, shares(0)).otherwise(shares(2))).otherwise(F.when(odd, shares(1)).otherwise(shares(3)))
    key = lambda total, s, after: F.xxhash64(total, "i", mask(F.col(f"before{s}") + after))
    units = F.col("units")
    one = F.when(longer, F.struct(key(units, 1, F.col("after1")).alias("v1"), key(units, 2, F.col("after2")).alias("v2")))
    two = F.when(shorter, F.struct(key(units + 1, 1, F.col("after1") + F.col("q1")).alias("v1"), key(units + 1, 2, F.col("after2") + F.col("q2")).alias("v2")))
    rows = rows.select("h1", "h2", "place", F.explode(F.array(one, two)).alias("v")).where("v IS NOT NULL")
    return rows.select("v.v1", "v.v2", "h1", "h2", "place")


def _one_unit_apart(x: str, y: str) -> str:
    """SQL: whether two arrays are equal but for one element inserted, deleted or replaced."""
    first = f"coalesce(nullif(array_position(zip_with({x}, {y}, (a, b) -> a <=> b), false), 0), least(size({x}), size({y})) + 1)"
    rest = lambda a, skip: f"slice({a}, cast({first} AS int) + {skip}, greatest(size({a}), 1))"
    return f"""CASE size({x}) - size({y})
      WHEN 0 THEN {rest(x, 1)} = {rest(y, 1)} WHEN 1 THEN {rest(x, 1)} = {rest(y, 0)} WHEN -1 THEN {rest(x, 0)} = {rest(y, 1)}
      ELSE false END"""


def _gone(docs: DataFrame, id_col: str, text_col: str, min_words: int, min_chars: int) -> DataFrame:
    """The lines that go: document (``doc_id``, ``t1``, ``t2``), ``line``, place of the earlier line (``to``), ``edits``."""
    # blank lines go after the table is written: a filter before it would make each line's form twice
    seen = stored(_lines(docs, id_col, text_col)).where("normal <> ''")
    halved = _with_units(seen, min_words, min_chars).select("h1", "h2", F.expr(_PLACE).alias("place"), *_halves())
    # halves follow from the line, so all its rows have the same
    slots = ["a0", "a1", "b0", "b1"]
    kinds = stored(halved.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"), *[F.min(s).alias(s) for s in slots]))

    named = F.array(*[F.struct(F.lit(1 << i).alias("slot"), F.col(s).alias("half")) for i, s in enumerate(slots)])
    each = kinds.where("a0 IS NOT NULL").select("h1", F.inline(named)).where("half IS NOT NULL")
    shared = each.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    wanted = checkpoint(each.join(shared, "half").groupBy("h1").agg(F.bit_or("slot").alias("slots")))
    text = seen.select("h1", "h2", "normal", F.expr(_PLACE).alias("place")).join(broadcast_if_small(wanted), "h1")
    text = text.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.any_value("normal").alias("normal"), F.any_value("slots").alias("slots"))
    text = stored(_with_units(text, min_words, min_chars))

    variants = stored(_variants(text.repartition("h1", "h2")))
    earliest = variants.groupBy("v1", "v2").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").select("v1", "v2", "first")
    alike = variants.join(earliest, ["v1", "v2"]).where("place > first").groupBy("h1", "h2").agg(F.min("first").alias("earlier"))
    units = F.expr("if(by_word, split(normal, ' '), split(normal, ''))")
    alike = alike.join(text.select("h1", "h2", units.alias("x")), ["h1", "h2"])
    alike = alike.join(text.select(F.col("place").alias("earlier"), units.alias("y")), "earlier").where(F.expr(_one_unit_apart("x", "y")))
    alike = checkpoint(alike.select("h1", "h2", "earlier"))

    # a repeated line is told by its kind's first place or, if that one is alike to an earlier line, by that
    total = kinds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kinds = stored(kinds.select("h1", "h2", "first", "n").join(alike, ["h1", "h2"], "left").where("n > 1 OR earlier IS NOT NULL"))
    slim = seen.select("doc_id", "t1", "t2", "line", "h1", "h2", F.expr(_PLACE).alias("place"))
    # very common lines, at most 1 / HEAVY kinds, are looked up without a shuffle
    common = F.broadcast(kinds.where(F.col("n") > total * HEAVY))
    rest = slim.join(common.select("h1", "h2"), ["h1", "h2"], "left_anti").join(kinds.where(F.col("n") <= total * HEAVY), ["h1", "h2"])
    rows = slim.join(common, ["h1", "h2"]).unionByName(rest).where("place > first OR earlier IS NOT NULL")
    near = F.col("earlier").isNotNull() & (F.col("place") == F.col("first"))
    return rows.select("doc_id", "t1", "t2", "line", F.when(near, F.col("earlier")).otherwise(F.col("first")).alias("to"), near.cast("int").alias("edits"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The lines that go: ``doc_id``, ``line``, the earlier line (``first_doc_id``, ``first_line``) and ``edits`` (0 or 1)."""
    doc, line = _doc_and_line(F.col("to"))
    return _gone(docs, id_col, text_col, min_words, min_chars).select("doc_id", "line", doc.alias("first_doc_id"), line.alias("first_line"), "edits")


def _same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["t1"] == b["t1"]) & (a["t2"] == b["t2"])


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document: ``n_lines``, how many go as ``exact`` or ``near`` copies, and their numbers."""
    # rows that repeat a document give each of its lines again
    gone = _gone(docs, id_col, text_col, min_words, min_chars).select("doc_id", "t1", "t2", "line", "edits").distinct().groupBy("doc_id", "t1", "t2")
    gone = gone.agg(F.count_if(F.col("edits") == 0).alias("exact"), F.count_if(F.col("edits") == 1).alias("near"), F.sort_array(F.collect_list("line")).alias("dropped"))
    n = F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    out = docs.select(*_document(id_col, text_col), n.cast("long").alias("n_lines"))
    zero = F.lit(0).cast("long")
    names = [F.coalesce("exact", zero).alias("exact"), F.coalesce("near", zero).alias("near"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped")]
    return out.join(gone, _same_document(out, gone), "left").select(out["doc_id"], "n_lines", *names)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without their repeated lines, with all their columns."""
    gone = _gone(docs, id_col, text_col, min_words, min_chars).groupBy("doc_id", "t1", "t2").agg(F.collect_set("line").alias("lines"))
    # the caller's columns travel as one, so that no name clashes
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_document(id_col, text_col))
    rows = rows.join(gone, _same_document(rows, gone), "left").select("row", "lines")
    text = F.col("row").getField(text_col)
    kept = F.filter(F.split(text, "\n"), lambda line, i: ~F.coalesce(F.array_contains("lines", i), F.lit(False)))
    cleaned = F.when(F.col("lines").isNull(), text).otherwise(F.array_join(kept, "\n"))
    return rows.select(*[(cleaned if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])
