"""Fuzzy line dedup by MinHash, in DataFrame operations only.

1. Lines are grouped by two 64-bit hashes; equal lines are one row from here on.
2. A line's set is its distinct shingles of ``SHINGLE`` characters (a shorter line is one shingle). The signature hashes
   them as UTF-32 units, exploded, so that hashing stays in generated code. Lines
   of many shingles get one minimum for each of ``BANDS * ROWS`` bins (one-permutation MinHash) and a key for each
   band of ``ROWS`` bins. Lines of few distinct shingles deal them to so many bands that two sets of Jaccard ``LEAST`` or
   more differ in fewer shingles than there are bands; ``DEALS`` deals make an equal band that is not empty all
   but certain.
3. Lines that share a band key are compared by exact Jaccard, but only while they are in different components:
   first each line with the smallest of its bucket; then the lines outside the bucket's first component (strays) with
   all lines of a bucket of up to ``PIVOTS``, or with about ``PIVOTS`` of a larger one. Strays that larger buckets still have then meet
   every line that can be similar: shingles are ordered from rare to common, two sets of Jaccard ``least`` share one
   among the first n - ceil(least n) + 1 of each, and lines are joined on these (prefix filter). The join also holds
   the sizes, the place of the shared shingle and an odd sketch against each other: sketches differ in no more bits than the
   sets differ in shingles, so no similar pair is lost and few others leave the join.
4. Distributed union-find; the first occurrence (by doc_id, text hash, line number) of each component is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.llm.common import drop_written, materialise, settings
from plotline.llm.components import connected_components

SHINGLE = 8
LEAST = 0.8
BANDS, ROWS = 12, 5
#: (fewest shingles, bands): partners at 0.8 differ in under a quarter of the shingles of the smaller set
SHORT_TIERS = ((1, 1), (4, 2), (8, 4), (16, 8))
LONG = 32
DEALS = 3
PIVOTS = 8  # lines of a large bucket that its strays meet before the prefix filter; up to so many are all of it
SKETCH = 16  # 64-bit words of an odd sketch: enough bits to tell apart lines of up to some 2,000 shingles
SLOTS = 1 << 18  # counters that order shingles; any order is exact, a rare-first one makes few pairs
#: A task holds millions of (line, bin) minima; generated code's own map stops at 65,536 unless told otherwise.
_MINIMA = {"spark.sql.codegen.aggregate.fastHashMap.capacityBit": "22", "spark.sql.codegen.aggregate.map.vectorized.enable": "true"}


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tag, line_no, line) of every line that is not blank; tag tells apart texts of one id."""
    return (docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tag"),
                        F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("line_no", "line"))
            .filter(F.col("line").rlike(r"\S")))


def _keys() -> list[Column]:
    return [F.xxhash64("line").alias("k1"), F.xxhash64(F.lit("line"), "line").alias("k2")]


#: A shingle that comes again: lines without one among their first ``LONG`` shingles have ``LONG`` distinct ones.
_AGAIN = rf"(?s)(?=(.{{{SHINGLE}}})).+\1"


def _hashed(sized: DataFrame) -> DataFrame:
    """One row (lid, h) for each shingle."""
    return (sized.select("lid", "u", F.explode(F.expr("sequence(0, n - 1)")).alias("i"))
            .select("lid", F.expr(f"xxhash64(substring(u, 4 * i + 1, {4 * SHINGLE}))").alias("h")))


def band_keys(lines: DataFrame) -> DataFrame:
    """(key, lid): the buckets of every line."""
    start = F.substring("line", 1, LONG + SHINGLE - 1)
    sized = (lines.select("lid", "line").repartition("lid")
             .select("lid", F.encode("line", "UTF-32").alias("u"), start.rlike(_AGAIN).alias("again"))
             .withColumn("n", F.expr(f"int(greatest(octet_length(u) div 4 - {SHINGLE} + 1, 1))")))
    bins = BANDS * ROWS
    long = (_hashed(sized.filter(F.col("n") * 5 >= LONG * 4))  # also lines that a longer partner meets here
            .groupBy("lid", F.pmod("h", F.lit(bins)).cast("int").alias("bin")).agg(F.min("h").alias("h"))
            .groupBy("lid", F.floor(F.col("bin") / ROWS).cast("int").alias("band"))
            .agg(F.xxhash64(F.lit("long"), "band", F.sort_array(F.collect_list(F.struct("bin", "h")))).alias("key")))
    tiers = []
    for k, (low, bands) in enumerate(SHORT_TIERS):
        high = SHORT_TIERS[k + 1][0] if k + 1 < len(SHORT_TIERS) else LONG
        mine = (F.col("n") * 5 >= low * 4) & (F.col("n") < high)  # from the sizes that a partner in this tier can have
        tiers.append(F.when(mine, F.struct(F.lit(k).alias("tier"), F.lit(bands).alias("bands"))))
    short = (_hashed(sized.filter((F.col("n") < LONG) | F.col("again")))
             .groupBy("lid").agg(F.collect_set("h").alias("s")).withColumn("n", F.size("s")).filter(F.col("n") < LONG)
             .withColumn("t", F.explode(F.array_compact(F.array(*tiers)))).select("lid", "t", F.explode("s").alias("h"))
             .withColumn("deal", F.explode(F.array(*[F.lit(k) for k in range(DEALS)])))
             .groupBy("lid", "t.tier", "deal", F.pmod(F.xxhash64("h", "deal"), "t.bands").alias("band"))
             .agg(F.sort_array(F.collect_set("h")).alias("set"))
             .select("lid", F.xxhash64(F.lit("short"), "tier", "deal", "band", "set").alias("key")))
    return long.select("key", "lid").unionByName(short.select("key", "lid"))


def _shingles(line: str) -> Column:
    """The shingles of a line, repeats included; none starts inside a surrogate pair."""
    all_ = F.regexp_extract_all(F.col(line), F.lit(rf"(?s)(?![\x{{DC00}}-\x{{DFFF}}])(?=(.{{{SHINGLE}}}))"), 1)
    return F.when(F.length(line) < SHINGLE, F.array(line)).otherwise(all_)


def _once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that later steps may use repeatedly without computing them again (a projection would be merged)."""
    return (df.withColumn("_once", F.explode(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))
            .withColumns({k: F.col(f"_once.{k}") for k in cols}).drop("_once"))


def _verified(pairs: DataFrame, lines: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of line ids whose shingles have Jaccard ``least`` or more."""
    pairs = materialise(pairs, "line-pairs")
    ids = pairs.select(F.col("a").alias("lid")).unionByName(pairs.select(F.col("b").alias("lid"))).distinct()
    some = materialise(lines.select("lid", "line").join(ids, "lid", "left_semi"), "line-texts")
    one = pairs.join(some.withColumnsRenamed({"lid": "a", "line": "la"}), "a")
    both = one.join(some.withColumnsRenamed({"lid": "b", "line": "lb"}), "b")
    dealt = both.repartition("a", "b")  # a leader's many pairs are spread
    sets = _once(dealt, sa=F.array_distinct(_shingles("la")), sb=F.array_distinct(_shingles("lb")))
    counted = _once(sets, shared=F.size(F.array_intersect("sa", "sb")), whole=F.size("sa") + F.size("sb"))
    found = materialise(counted.filter(F.col("shared") >= least * (F.col("whole") - F.col("shared"))).select("a", "b"), "line-links")
    drop_written(pairs)
    drop_written(some)
    return found


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _placed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, lid, size, leader, root, head): the component of every line and of its bucket's leader."""
    named = (members.join(roots, F.col("lid") == F.col("node"), "left")
             .select("key", "lid", "size", "leader", F.coalesce("root", "lid").alias("root")))
    heads = named.filter("lid = leader").select("key", F.col("root").alias("head"))
    return materialise(named.join(heads, "key"), "line-placed")


def _with_links(links: DataFrame, roots: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    if more.isEmpty():
        return links, roots
    links = links.unionByName(more)
    return links, connected_components(links, "a", "b")


def _prefix_pairs(open_: DataFrame, lines: DataFrame, least: float) -> DataFrame:
    """(x, y): all pairs of a stray and another line of ``open_`` (lid, root, stray), of different components, that
    can have Jaccard ``least``, and some more."""
    some = lines.select("lid", "line").join(open_, "lid").repartition("lid")
    sets = _once(some, s=F.array_distinct(_shingles("line"))).select("lid", "root", "stray", F.size("s").alias("n"), "s")
    shingles = (sets.select("lid", "root", "stray", "n", F.explode("s").alias("s"))
                .select("lid", "root", "stray", "n", F.xxhash64("s").alias("h")).withColumn("slot", F.pmod("h", F.lit(SLOTS))))
    counts = materialise(shingles.groupBy("slot").agg(F.count(F.lit(1)).alias("c")), "line-counts")
    odd = [F.expr(f"bit_xor(if(pmod(shiftright(h, 40), {SKETCH}) = {k}, shiftleft(1L, int(pmod(shiftright(h, 32), 64))), 0L))").alias(f"odd{k}")
           for k in range(SKETCH)]
    marks = ["n", *(f"odd{k}" for k in range(SKETCH))]
    rare_first = (shingles.join(F.broadcast(counts), "slot").groupBy("lid", "root", "stray", "n")  # at most SLOTS rows
                  .agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("s"), *odd))
    share = F.lit(least - 1e-9)  # products of whole numbers may come out a little too large
    length = (F.col("n") - F.ceil(share * F.col("n")) + 1).cast("int")
    first = materialise(rare_first.select("lid", "root", "stray", *marks, F.posexplode(F.slice("s", F.lit(1), length)).alias("at", "p"))
                        .select("lid", "root", "stray", *marks, "at", "p.h"), "line-prefixes")
    drop_written(counts)
    side = lambda c: [F.col("lid").alias(c), *(F.col(k).alias(f"{k}_{c}") for k in ("root", "at", *marks))]
    one, two = first.filter("stray").select("h", *side("x")), first.select("h", *side("y"))
    both = F.col("n_x") + F.col("n_y")
    apart = sum((F.bit_count(F.col(f"odd{k}_x").bitwiseXOR(F.col(f"odd{k}_y"))) for k in range(SKETCH)), F.lit(0))
    can = ((F.col("root_x") != F.col("root_y")) & (F.least("n_x", "n_y") >= share * F.greatest("n_x", "n_y"))
           # sets of this Jaccard differ in so many shingles at most, and sketches in no more bits
           & (apart <= both * (1 - share) / (1 + share))
           # the first shared shingle and what follows it on both sides must be shared enough
           & (F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) >= share / (1 + share) * both))
    return one.join(two, (one.h == two.h) & can).select("x", "y")


def similar_lines(lines: DataFrame, least: float = LEAST) -> DataFrame:
    """(node, root): components of similar lines among distinct lines (lid, line)."""
    in_bucket = Window.partitionBy("key")
    buckets = (band_keys(lines).withColumn("leader", F.min("lid").over(in_bucket))
               .withColumn("size", F.count(F.lit(1)).over(in_bucket)).filter("size > 1"))
    with settings(lines.sparkSession, _MINIMA):
        members = materialise(buckets, "line-buckets")
    # only these lines are ever compared: the texts of all lines are shuffled here once and not in every round
    lines = materialise(lines.select("lid", "line").join(members.select("lid").distinct(), "lid", "left_semi"), "line-members")
    stars = members.filter("lid > leader").select(F.col("leader").alias("x"), F.col("lid").alias("y"))
    links = _verified(_ordered(stars), lines, least)
    roots = connected_components(links, "a", "b")
    placed = _placed(members, roots)
    strays = placed.filter("root <> head").select("key", F.col("lid").alias("x"), F.col("root").alias("rx"))
    pivot = F.pmod(F.xxhash64("lid"), F.ceil(F.col("size") / PIVOTS)) == 0
    others = placed.filter(pivot).select("key", F.col("lid").alias("y"), F.col("root").alias("ry"))
    links, roots = _with_links(links, roots, _verified(_ordered(strays.join(others, "key").filter("rx <> ry")), lines, least))
    drop_written(placed)
    placed = _placed(members.filter(F.col("size") > PIVOTS), roots)
    mixed = placed.filter("root <> head").select("key").distinct()
    open_ = materialise(placed.join(mixed, "key", "left_semi").groupBy("lid", "root")
                        .agg(F.max(F.col("root") != F.col("head")).alias("stray")), "line-open")
    drop_written(placed)
    if not open_.isEmpty():
        links, roots = _with_links(links, roots, _verified(_ordered(_prefix_pairs(open_, lines, least)), lines, least))
    drop_written(open_)
    drop_written(lines)
    drop_written(members)
    return roots


def repeated_lines(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tag, gone): the numbers of the lines that go, for every text that loses any."""
    place = F.struct("doc_id", "tag", "line_no")
    spots = split_lines(docs, id_col, text_col)
    lines = materialise(
        spots.select(place.alias("place"), "line", *_keys()).groupBy("k1", "k2")
        .agg(F.min("place").alias("place"), F.count("*").alias("copies"), F.first("line").alias("line"))
        .withColumn("lid", F.monotonically_increasing_id()), "lines")
    roots = similar_lines(lines.select("lid", "line"), least)
    linked = lines.select("k1", "k2", "lid", "place").join(roots, F.col("lid") == F.col("node"))
    keepers = linked.groupBy("root").agg(F.min("place").alias("keeper"))
    linked = linked.join(keepers, "root").select("k1", "k2", "keeper")
    alone = (lines.filter("copies > 1").join(roots, F.col("lid") == F.col("node"), "left_anti")
             .select("k1", "k2", F.col("place").alias("keeper")))
    kept = linked.unionByName(alone)
    gone = (spots.select(place.alias("place"), *_keys()).join(kept, ["k1", "k2"]).filter("not (place <=> keeper)"))
    return materialise(gone.groupBy("place.doc_id", "place.tag").agg(F.sort_array(F.collect_set("place.line_no")).alias("gone")),
                       "line-gone")


def _joined(docs: DataFrame, least: float, id_col: str, text_col: str) -> tuple[DataFrame, Column, Column]:
    """docs with the columns _gone and _lines, the text that is left, and whether a line with text is left."""
    gone = repeated_lines(docs, least, id_col, text_col).select(
        F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), F.col("gone").alias("_gone"))
    joined = docs.join(gone, (F.col(id_col) == F.col("_id")) & (F.xxhash64(text_col) == F.col("_tag")), "left")
    joined = joined.withColumn("_lines", F.split(F.col(text_col).cast("string"), "\n"))
    left = F.expr("transform(array_except(sequence(0, size(_lines) - 1), _gone), i -> _lines[i])")
    text = F.when(F.col("_gone").isNull(), F.col(text_col).cast("string")).otherwise(F.array_join(left, "\n"))
    return joined, text, F.col("_gone").isNull() | text.rlike(r"\S")


def dedup_lines(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_removed) for every row of ``docs``: the text without lines that repeat earlier ones.

    Two lines are similar if the Jaccard of their shingle sets is ``least`` or more; of each component of similar lines the first occurrence stays (smallest doc_id, text hash, line number; a null id sorts first, and its own
    lines never go). Blank lines are not compared and stay. A null text stays null with no lines; a text whose lines
    all go is empty. Rows that repeat id and text count as one and get equal results.
    """
    joined, text, _ = _joined(docs, least, id_col, text_col)
    return joined.select(F.col(id_col).alias("doc_id"), text.alias("text"),
                         F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).alias("n_lines"),
                         F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).alias("n_removed"))


def without_repeated_lines(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its own columns: texts lose repeated lines, and rows that lose every line with text go."""
    joined, text, stays = _joined(docs, least, id_col, text_col)
    return joined.filter(stays).select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
