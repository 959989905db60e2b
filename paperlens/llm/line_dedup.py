"""Line dedup by a deletion-neighbourhood join.

A line goes if an earlier line of the corpus is equal to it, or if both have `LEAST` characters or more and differ by one
edit (a character inserted, deleted or replaced).  Earlier means a smaller (doc_id, line number).

Two lines are within one edit exactly if deleting one character of either or both gives the same string: equal variants
at the same place are a replacement, a variant equal to a whole line is a deletion.  So of all lines that share a variant
each needs only the earliest partner, never all pairs:

1. Equal lines are aggregated to their earliest place, by a 128-bit hash.
2. One edit leaves the first or the second half of a line as it is, so only lines that share the hash of a half with
   another emit variants, and only of the rest of the line behind or before that half.  (Half keys are made for the own
   length and for one less, which covers a shift by one.)
3. The rest is cut into `PIECES`; an edit lies in one of them, so only lines that share all of a rest but one piece emit
   the variants of that piece.
4. A variant's key is a hash of what is shared, of the piece before its 64-character block, the block without the
   character, and the piece after it; so a piece costs a key over 64 characters for each of its own, not over all.  Two
   lines of one length meet where the same character is missing.  A line meets one that is longer by a character where its
   whole piece equals the other's piece without one; for that a whole piece has one key per block.  Per key the earliest
   line of either length is aggregated map-side.
5. The earliest partner is verified on the texts by edit distance.
6. Where a line goes, its number is gathered for the row; rows that lose nothing are in no table.  A row is named by a
   128-bit hash of doc_id and text.

Scale: shuffles move hashes, but for two: the lines that share a half fetch their text, and the documents meet the numbers
of the lines that go.  All joins are sort-merge joins between stored tables or scans, at every size: no side is sent to all
tasks, and adaptive execution may split a hot line.  A hot key is aggregated before it is shuffled.

Defined cases: a null text stays null and has no lines; a line without a word is neither counted nor removed, but a text
that loses all its other lines becomes empty; a null doc_id comes last; of rows that repeat a doc_id (null, too) equal
lines with the same number stay or go together, and other lines do not; columns other than doc_id, text and n_chars pass
through, but n_lines and n_kept are the operator's own unless `counts` is false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paperlens.llm.common import WORD, stored

LEAST = 20
PIECES, BLOCK = 8, 64
#: The half keys of a line, as (length less one, side): own length first.
KEYS = [(less, side) for less in (0, 1) for side in ("first", "second")]


def hashes(*of) -> tuple[Column, Column]:
    """Two hashes that stand together for the columns."""
    return F.xxhash64(*of), F.xxhash64(F.lit("second"), *of)


def lines(docs: DataFrame, *more: Column) -> DataFrame:
    """place (order of lines), line, h and g (hashes of the line), and more columns of the row; lines with a word only."""
    rows = docs.select("doc_id", *more, F.posexplode(F.split("text", "\n")).alias("at", "line")).filter(F.col("line").rlike(WORD))
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("at").alias("at"))
    h, g = hashes("line")
    return rows.withColumns({"place": place, "h": h, "g": g}).drop("doc_id", "at")


def half(less: int, side: str) -> tuple[Column, Column]:
    """The half of a line that a key stands for, and the rest of the line."""
    m = F.length("line") - less
    k = F.floor(m / 2).cast("int")
    if side == "first":
        return F.left("line", k), F.substr("line", k + 1)
    return F.right("line", m - k), F.left("line", k + less)


def half_keys() -> Column:
    keys = [F.xxhash64(F.length("line") - less, F.lit(side), half(less, side)[0]) for less, side in KEYS]
    return F.when(F.length("line") >= LEAST, F.array(*keys))


#: Pieces of a rest r; s is its length without the one character that a longer line has more.  What lies around a piece
#: and its text: both lines of a pair agree in the former.
AROUND = "xxhash64(k, s, j, left(r, int(j * s div {p})), right(r, int(s - (j + 1) * s div {p})))".format(p=PIECES)
PIECE = "substr(r, int(j * s div {p} + 1), int((j + 1) * s div {p} - j * s div {p} + less))".format(p=PIECES)

#: Of a piece m with key k: its blocks, and the keys of the piece without one character, or whole.
BLOCKS = f"""
transform(sequence(0, length(m) div {BLOCK}), j -> named_struct('j', int(j), 'l', xxhash64(k, left(m, int({BLOCK} * j))),
  'm', substr(m, int({BLOCK} * j + 1), {BLOCK}), 'a', xxhash64(substr(m, int({BLOCK} * j + {BLOCK + 1}))),
  'whole', substr(m, int({BLOCK} * j + 1), {BLOCK - 1}), 'rest', xxhash64(substr(m, int({BLOCK} * j + {BLOCK})))))
"""
CUT = "flatten(transform(b, x -> transform(if(x.m = '', array(), sequence(1, length(x.m))), i -> {})))"
KEY = "xxhash64(x.l, concat(left(x.m, i - 1), substr(x.m, i + 1)), x.a, x.j{})"
#: By the line's length against the key's: equal ones replace a character or are the shorter of two, longer ones drop one.
OWN = f"concat({CUT.format(KEY.format(', i'))}, transform(b, x -> xxhash64(x.l, x.whole, x.rest, x.j)))"
OWN_KIND = f"concat({CUT.format('0')}, transform(b, x -> 1))"
LONGER = CUT.format(KEY.format(""))


def pieces(texts: DataFrame) -> DataFrame:
    """h, g, place, less, k (what is shared) and m (the piece), for every half key that the line shares."""
    rests = [F.struct(F.lit(less).alias("less"), F.col("keys")[n].alias("k"), half(less, side)[1].alias("r")) for n, (less, side) in enumerate(KEYS)]
    shared = F.filter(F.array(*rests), lambda x: F.array_contains("shared", x["k"]))
    rows = texts.select("h", "g", "place", F.explode(shared).alias("x")).select("h", "g", "place", "x.*")
    rows = rows.withColumns({"s": F.length("r") - F.col("less"), "j": F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1)))})
    return rows.select("h", "g", "place", "less", F.expr(AROUND).alias("k"), F.expr(PIECE).alias("m"))


def variants(rows: DataFrame) -> DataFrame:
    """h, g, place, key, kind: 0 for a replaced character, 1 for the shorter line, 2 for the longer one."""
    own = F.arrays_zip(F.expr(OWN).alias("key"), F.expr(OWN_KIND).alias("kind"))
    longer = F.expr(f"transform({LONGER}, v -> named_struct('key', v, 'kind', 2))")
    made = F.explode(F.when(F.col("less") == 0, own).otherwise(longer)).alias("v")
    return rows.withColumn("b", F.expr(BLOCKS)).select("h", "g", "place", made).select("h", "g", "place", "v.*")


def joined(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    return a.join(b.hint("merge"), on, how)


def sharing(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs more than once."""
    return joined(rows, rows.groupBy(key).count().filter("count > 1").select(key), key)


def near_lines(docs: DataFrame, first: DataFrame) -> DataFrame:
    """(h, g) of the distinct lines that have an earlier line within one edit."""
    found = sharing(first.select("h", "g", F.explode("keys").alias("half")), "half").groupBy("h", "g")
    found = stored(found.agg(F.collect_set("half").alias("shared")), "lines-that-share")
    texts = joined(lines(docs.filter(F.length("text") >= LEAST)), found, ["h", "g"]).groupBy("h", "g")
    texts = texts.agg(F.min("place").alias("place"), F.first("line").alias("line"), F.first("shared").alias("shared"))
    texts = stored(texts.withColumn("keys", half_keys()), "line-candidates")
    made = stored(variants(sharing(stored(pieces(texts), "line-pieces"), "k")), "line-variants")
    earliest = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("place")))
    by_key = made.groupBy("key").agg(F.count("*").alias("n"), *[earliest(k).alias(f"p{k}") for k in range(3)]).filter("n > 1").drop("n")
    partner = F.when(F.col("kind") == 0, F.col("p0")).when(F.col("kind") == 1, F.col("p2")).otherwise(F.col("p1"))
    pairs = joined(made, by_key, "key").groupBy("h", "g", "place").agg(F.min(partner).alias("partner")).filter("partner < place")
    mine, theirs = texts.select("h", "g", "line"), texts.select(F.col("place").alias("partner"), F.col("line").alias("earlier"))
    both = joined(joined(pairs.drop("place"), mine, ["h", "g"]), theirs, "partner")
    return both.filter(F.levenshtein("line", "earlier", 1) >= 0).select("h", "g").distinct()


def gone_places(docs: DataFrame, first: DataFrame) -> DataFrame:
    """_line_a, _line_b (a row's name) and _line_gone, the numbers of the lines that go from it."""
    near = near_lines(docs, first).withColumn("near", F.lit(True))
    lost = joined(first.select("h", "g", "n", F.col("place").alias("first")), near, ["h", "g"], "left").filter("near OR n > 1")
    lost = stored(lost.drop("n"), "lines-that-go")
    a, b = hashes("doc_id", "text")
    rows = lines(docs, a.alias("_line_a"), b.alias("_line_b")).drop("line")
    goes = joined(rows, lost, ["h", "g"]).filter("near OR place <> first")
    return goes.groupBy("_line_a", "_line_b").agg(F.collect_set("place.at").alias("_line_gone"))


def dedup_lines(docs: DataFrame, counts: bool = True) -> DataFrame:
    """The input with its text (and n_chars, if there) after removal, and n_lines, n_kept: lines with a word before and after."""
    first = lines(docs).groupBy("h", "g").agg(F.min("place").alias("place"), F.count("*").alias("n"), F.first(half_keys()).alias("keys"))
    gone = gone_places(docs, stored(first, "lines"))
    a, b = hashes("doc_id", "text")
    rows = (docs.drop("n_lines", "n_kept") if counts else docs).withColumns({"_line_a": a, "_line_b": b})
    out = joined(rows, gone, ["_line_a", "_line_b"], "left").drop("_line_a", "_line_b")
    out = out.withColumns({"_line_lines": F.split("text", "\n"), "_line_gone": F.coalesce("_line_gone", F.array().cast("array<int>"))})
    held = F.coalesce(F.size(F.filter("_line_lines", lambda x: x.rlike(WORD))), F.lit(0))
    out = out.withColumn("_line_held", F.when(F.col("text").isNull(), 0).otherwise(held))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_line_lines") - 1), "_line_gone")
    rest = F.array_join(F.transform(stay, lambda i: F.get("_line_lines", i)), "\n")
    text = F.when(F.size("_line_gone") == 0, F.col("text")).when(F.size("_line_gone") == F.col("_line_held"), F.lit("")).otherwise(rest)
    if counts:
        out = out.withColumns({"n_lines": F.col("_line_held").cast("bigint"), "n_kept": (F.col("_line_held") - F.size("_line_gone")).cast("bigint")})
    out = out.withColumn("text", text).drop("_line_lines", "_line_gone", "_line_held")
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
