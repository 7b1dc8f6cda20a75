"""Benchmark decontamination with DataFrame functions only.

Every benchmark item is compared with windows of its own number of words. A window counts as similar if its weighted word
shingles agree with the item's to `similarity` or more. Steps:

* Words become hashes and shingles become codes whose low three bits are the shingle's weight, so that weights need no lookup.
* Only windows that hold enough of an item's shingles can be similar. Positions of shared shingles are dealt into tiles of window starts, whose
  length follows the item's; the starts that have enough of them within reach are the windows that are looked at.
* Each window and item gets a 64-bit SimHash; sums for all bits are kept in lanes of a few integers.
* The bits are cut into blocks. Two fingerprints within `radius` differ by at most radius // blocks bits in some block, so an index of
  items under all block values that close finds every window within the radius.
* Candidates are verified by exact weighted Jaccard similarity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, only, tidy

K = 5
LONG_WORD = 6
TILE = 256
#: Rows of benchmark shingles and of the block index up to which they are broadcast (about 32 MB each).
BROADCAST_ROWS = 1_000_000


def shingle_codes(df: DataFrame, text: str) -> DataFrame:
    """df with `codes`: one long for each run of five words, in order; none for fewer words."""
    word = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{M}\p{N}]+")
    ids = F.transform(F.filter(word, lambda x: x != ""), lambda x: F.xxhash64(x).bitwiseAND(F.lit(-2)).bitwiseOR((F.length(x) >= LONG_WORD).cast("long")))
    df = df.withColumn("word_ids", ids)

    def code(i: Column) -> Column:
        own = [F.get("word_ids", i + j) for j in range(K)]
        weight = reduce(lambda a, b: a + b, [x.bitwiseAND(F.lit(1)) for x in own], F.lit(1).cast("long"))
        return F.xxhash64(*own).bitwiseAND(F.lit(-8)).bitwiseOR(weight)

    starts = F.when(F.size("word_ids") >= K, F.sequence(F.lit(0), F.size("word_ids") - K)).otherwise(F.array().cast("array<int>"))
    return df.withColumn("codes", F.transform(starts, code)).drop("word_ids")


def weight(codes: Column) -> Column:
    return F.aggregate(codes, F.lit(0).cast("long"), lambda total, c: total + c.bitwiseAND(F.lit(7)))


def simhash(df: DataFrame, codes: str, stride: int) -> DataFrame:
    """df with `fp`: bit i is set if the shingles whose hash has bit i weigh more than half of all. stride: bits of a lane, 16 or 32."""
    mask = sum(1 << (stride * j) for j in range(64 // stride))
    marked = F.transform(codes, lambda c: F.struct(F.xxhash64(c).alias("h"), c.bitwiseAND(F.lit(7)).alias("w")))
    df = df.withColumn("marked", marked).withColumn("heavy", weight(F.col(codes)))

    def lane(r: int) -> Column:
        return F.aggregate("marked", F.lit(0).cast("long"), lambda total, x: total + F.shiftrightunsigned(x["h"], r).bitwiseAND(F.lit(mask)) * x["w"])

    lanes = [lane(r).alias(f"lane{r}") for r in range(stride)]
    df = df.select(*[c for c in df.columns if c != "marked"], *lanes)
    bits = [
        F.shiftleft((F.shiftrightunsigned(f"lane{i % stride}", stride * (i // stride)).bitwiseAND(F.lit((1 << stride) - 1)) * 2 > F.col("heavy")).cast("long"), i)
        for i in range(64)
    ]
    return df.withColumn("fp", reduce(lambda a, b: a.bitwiseOR(b), bits)).drop("heavy", *[f"lane{r}" for r in range(stride)])


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each block."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _part(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def block_index(items: DataFrame, radius: int, blocks: int) -> DataFrame:
    """items under every (block, value) that is within radius // blocks bits of their own."""
    near = radius // blocks

    def values(first: int, bits: int) -> Column:
        masks = F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << bits) - 1).cast("long")), lambda m: F.bit_count(m) <= near)
        own = _part(F.col("item_fp"), first, bits)
        return F.transform(masks, lambda m: m.bitwiseXOR(own))

    parts = [items.select("item", "n", "item_fp", F.lit(b).alias("block"), values(first, bits).alias("values")).select("item", "n", "item_fp", "block", F.explode_outer("values").alias("value")) for b, (first, bits) in enumerate(block_bounds(blocks))]
    return reduce(DataFrame.unionByName, parts)


def candidates(windows: DataFrame, index: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Pairs of a window and an item of one size whose fingerprints differ by at most `radius` bits, each once; with `distance`."""
    bounds, near = block_bounds(blocks), radius // blocks
    keys = F.array(*[F.struct(F.lit(b).alias("block"), _part(F.col("fp"), first, bits).alias("value")) for b, (first, bits) in enumerate(bounds)])
    pairs = windows.select("*", F.inline(keys)).join(index, ["n", "block", "value"])
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first_block = reduce(lambda so_far, b: so_far & ((F.col("block") <= b) | (F.bit_count(_part(apart, *bounds[b])) > near)), range(blocks - 1), F.lit(True))
    return pairs.withColumn("distance", F.bit_count(apart)).filter((F.col("distance") <= radius) & first_block).drop("block", "value", "item_fp")


def _coded_items(benchmark: DataFrame, similarity: int) -> DataFrame:
    """item_id, item, codes, n (words), need: the least number of shared positions of a window that is similar enough."""
    c = F.col
    items = cut(shingle_codes(only(benchmark, "item_id", "text"), "text").select("item_id", "codes")).filter(F.size("codes") > 0)
    heaviest = F.array_max(F.transform("codes", lambda x: x.bitwiseAND(F.lit(7))))
    need = F.greatest(F.lit(1), F.ceil(weight(F.array_distinct("codes")) * similarity / (heaviest * 100) - 1e-9)).cast("int")
    return items.select("item_id", "codes", (F.size("codes") + K - 1).alias("n"), F.xxhash64("codes").alias("item"), need.alias("need"))


def _spans(coded: DataFrame, wanted: DataFrame, narrow: bool) -> DataFrame:
    """doc_id, text_key, n, step, need, tile, spots (positions of shared shingles after the tile's first start) and around (the codes that
    the tile's windows reach over). narrow: `wanted` is broadcast, so that a hit can take its surroundings along; else they are joined afterwards."""
    c = F.col
    step = F.greatest(F.lit(TILE), F.pow(F.lit(2), F.ceil(F.log2(c("n"))))).cast("int")
    wanted = wanted.withColumn("step", step)
    kept = ["doc_id", "text_key", *(["codes"] if narrow else [])]
    # the outer form: for the other Spark infers filters on its input, for which it would work out the codes again and again
    hits = coded.select(*kept, F.posexplode_outer("codes").alias("at", "code")).join(F.broadcast(wanted) if narrow else wanted, "code")
    tiles = F.array_distinct(F.array(F.floor(c("at") / c("step")), F.floor(F.greatest(F.lit(0), c("at") - c("n") + K) / c("step"))))
    hits = hits.select(*kept, "n", "step", "need", "at", F.explode(tiles).alias("tile"))
    around = F.slice("codes", (c("tile") * c("step") + 1).cast("int"), c("step") + c("n") - K)
    spots = F.sort_array(F.collect_set((c("at") - c("tile") * c("step")).cast("int"))).alias("spots")
    key = ["doc_id", "text_key", "n", "step", "need", "tile"]
    if narrow:
        return hits.withColumn("around", around).groupBy(*key).agg(spots, F.first("around").alias("around"))
    spans = hits.groupBy(*key).agg(spots)
    held = coded.dropDuplicates(["doc_id", "text_key"]).toDF("held_doc", "held_key", "codes")
    same = c("doc_id").eqNullSafe(c("held_doc")) & c("text_key").eqNullSafe(c("held_key"))
    return spans.join(held, same).select(*key, "spots", around.alias("around"))


def _starts(spans: DataFrame) -> DataFrame:
    """doc_id, text_key, n, base (the tile's first word), around, and the starts of windows that hold `need` shared positions and more."""
    c, reach = F.col, F.col("n") - K
    last = F.least(c("step") - 1, F.greatest(F.lit(0), F.size("around") - 1 - reach))

    def starts(i: Column) -> Column:
        """From the i-th shared position on, a window of `need`; starts up to the position before have been taken with that."""
        before = F.when(i == 0, F.lit(0)).otherwise(F.get("spots", i - 1) + 1)
        return F.struct(F.greatest(F.lit(0), before, F.get("spots", i + c("need") - 1) - reach).alias("lo"), F.least(F.get("spots", i), last).alias("hi"))

    firsts = F.when(F.size("spots") >= c("need"), F.sequence(F.lit(0), F.size("spots") - c("need"))).otherwise(F.array().cast("array<int>"))
    ranges = F.filter(F.transform(firsts, starts), lambda r: r["lo"] <= r["hi"])
    found = spans.withColumn("starts", F.flatten(F.transform(ranges, lambda r: F.sequence(r["lo"], r["hi"]))))
    return found.select("doc_id", "text_key", "n", (c("tile") * c("step")).cast("int").alias("base"), "around", "starts").filter(F.size("starts") > 0)


def _codes_of_window() -> Column:
    return F.slice("around", F.col("start") + 1, F.col("n") - K + 1)


def _matches(docs: DataFrame, benchmark: DataFrame, similarity: int, radius: int, blocks: int, broadcast_rows: int) -> DataFrame:
    """doc_id, text_key (a hash of the text), item_id, n, start_word, distance, similarity of all similar windows."""
    c = F.col
    items = _coded_items(benchmark, similarity)
    facts = items.agg(F.max("n").alias("longest"), F.count(F.lit(1)).alias("items"), F.sum(F.size("codes")).alias("shingles")).first()
    stride = 16 if (facts["longest"] or K) * (K + 1) < 1 << 15 else 32
    few = (facts["shingles"] or 0) <= broadcast_rows
    small = lambda df, rows: F.broadcast(df) if rows <= broadcast_rows else df
    needs = items.groupBy("n").agg(F.min("need").alias("need"))
    wanted = items.select("n", F.explode_outer("codes").alias("code")).distinct().join(needs, "n")
    coded = shingle_codes(only(docs, "doc_id", "text").withColumn("text_key", F.xxhash64("text")), "text").select("doc_id", "text_key", "codes")
    spans = cut(_starts(_spans(coded, wanted, few)))
    each = spans.select("doc_id", "text_key", "n", "base", "around", F.explode_outer("starts").alias("start"))
    # windows are kept by their fingerprint and place; the codes of those that come close to an item are taken from the span again
    windows = cut(simhash(each.select("doc_id", "text_key", "n", "base", "start", _codes_of_window().alias("codes")), "codes", stride).drop("codes"))

    own = cut(simhash(items.groupBy("item", "n").agg(F.first("codes").alias("codes")), "codes", stride).withColumnRenamed("fp", "item_fp"))
    per_item = sum(sum(_choose(bits, i) for i in range(radius // blocks + 1)) for _, bits in block_bounds(blocks))
    index = small(block_index(own, radius, blocks), facts["items"] * per_item)
    held = spans.select(c("doc_id").alias("held_doc"), c("text_key").alias("held_key"), c("n").alias("held_n"), c("base").alias("held_base"), "around")
    same = c("doc_id").eqNullSafe(c("held_doc")) & (c("text_key") == c("held_key")) & (c("n") == c("held_n")) & (c("base") == c("held_base"))
    close = candidates(windows, index, radius, blocks).join(held, same).withColumn("codes", _codes_of_window())
    both = close.select("doc_id", "text_key", "n", (c("base") + c("start")).alias("start_word"), "item", "distance", "codes").join(small(own.select("item", c("codes").alias("item_codes")), facts["shingles"] or 0), "item")
    both = both.withColumn("common", weight(F.array_intersect("codes", "item_codes"))).withColumn("all", weight(F.array_distinct("codes")) + weight(F.array_distinct("item_codes")) - c("common"))
    close = both.filter(c("common") * 100 >= c("all") * similarity).select("doc_id", "text_key", "n", "start_word", "item", "distance", (c("common") / c("all")).alias("similarity"))
    return close.join(small(items.select("item", "item_id"), facts["items"]), "item").drop("item")


@tidy
def contaminations(docs: DataFrame, benchmark: DataFrame, similarity: int = 80, radius: int = 19, blocks: int = 5, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Pairs doc_id, item_id with n_words (of the item), start_word, similarity and distance of the document's best window (the earliest of equals).

    Words are stretches of letters, marks and digits in lower case; shingles have five words and weigh one plus the number of their words of six or
    more characters; similarity is the weighted Jaccard index of the distinct shingles in per cent. A document shorter than the item is one window.
    Null and empty texts, and items of fewer than five words, have no shingles and match nothing. Rows with one doc_id are searched each and reported
    together, a null doc_id as null; likewise item_id. Extra columns are ignored; empty tables give no pairs.
    """
    c = F.col
    best = F.max(F.struct(c("similarity"), (-c("start_word")).alias("back"), (-c("distance")).alias("near"), c("n")))
    found = _matches(docs, benchmark, similarity, radius, blocks, broadcast_rows).groupBy("doc_id", "item_id").agg(best.alias("best"))
    return found.select("doc_id", "item_id", c("best.n").alias("n_words"), (-c("best.back")).alias("start_word"), c("best.similarity").alias("similarity"), (-c("best.near")).alias("distance"))


def _choose(n: int, k: int) -> int:
    from math import comb

    return comb(n, k)


@tidy
def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS, similarity: int = 80, radius: int = 19, blocks: int = 5) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item. Decisions are taken by row: of rows that share a doc_id, or have none, only
    those whose own text holds an item go. Columns may clash with each other in other case; an empty table or benchmark takes nothing away."""
    names = docs.columns
    exact = lambda x: next(f"c{i}" for y in (x, x.lower()) for i, n in enumerate(names) if n == y or (y != x or x not in names) and n.lower() == x)
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    gone = cut(_matches(only(docs, "doc_id", "text"), benchmark, similarity, radius, blocks, broadcast_rows).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct())
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    same = F.col(exact("doc_id")).eqNullSafe(F.col("gone_id")) & (F.xxhash64(exact("text")) == F.col("gone_key"))
    return flat.join(gone, same, "left_anti").toDF(*names)
