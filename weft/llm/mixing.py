"""Mixing sources to target weights by Sainte-Lague apportionment, by DataFrame functions alone.

The words of a source form one line, its documents in a seeded order. The line is cut into blocks
of equally many words, and blocks are what the mix takes. The mix is cut into shards of equally many
blocks. Sainte-Lague (highest quotients target / (2 seats + 1)) gives the seats of each shard to
sources, going on where the shard before stopped: so every shard has a whole quota of blocks for
every source, and the quotas of the first k shards together are what Sainte-Lague gives to k shards.
Only then are blocks selected: a source's blocks are put in a seeded order, and its seats, shard
after shard, take one after the other, from the start again when all are used. A document takes as
many words as its part of the chosen blocks, repeats counted.

Scale: one pass counts words; sources and (source, chunk) totals are small tables; a document's
place on its source's line is the total before its chunk (a chunk is a range of its order key) plus
a running sum within the chunk, so a source with a third of all rows is spread over all chunks.
Of n sources about 2 n seats a shard are ranked, those whose quotient is near the last that wins.
Which shards take a block is a formula in the block's number, so no table of blocks exists.

Defined cases: null text has no words and takes none; a null source is a source, listed last; a
source without words has target 0; repeated doc_ids are placed beside each other, ties by size; very
long texts lie in many blocks; an empty table gives an empty result; other columns of docs aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm._shared import cut, text_or_empty

#: Shards of the mix; blocks that the mix has at least, if words suffice; most words of a block.
SHARDS, BLOCKS, BLOCK_WORDS = 16, 1 << 20, 1024
#: Rows that one chunk of a source's order should hold, and the fewest and most hex digits of a chunk.
CHUNK_ROWS, LEAST_DIGITS, MOST_DIGITS = 20_000, 2, 6
#: A prime above any source's number of blocks that the seeded permutation steps by.
STEP = 2_147_483_647
SPACES = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Number of runs of characters outside the six ASCII spaces."""
    marked = F.regexp_replace(text, r"[^\x20\x09-\x0D]++", "x")
    return F.length(F.translate(marked, SPACES, "")).cast("long")


def targets(totals: DataFrame, cap: int = 3) -> DataFrame:
    """(source, source_size) with each source's weight, and target: its share of all words by
    weight, at most ``cap`` times its size, the excess reshared by weight.

    Sources that stop at the cap are those with the least size per weight: going up that order,
    a source stops if its cap is below its share of what the sources before it have left.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    t = totals.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1)
    up = Window.orderBy(F.expr("source_size * 6 div weight"), F.col("source").isNull(), F.col("source"))
    all_ = Window.partitionBy()
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({"all_words": F.sum("source_size").over(all_), "all_weight": F.sum("weight").over(all_), "words_before": F.coalesce(F.sum("source_size").over(before), F.lit(0)), "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    left = F.col("all_words") - cap * F.col("words_before")
    capped = cap * F.col("source_size") * (F.col("all_weight") - F.col("weight_before")) <= F.col("weight") * left
    t = t.withColumn("capped", capped)
    t = t.withColumns({"capped_words": F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))).over(all_), F.lit(0)), "free_weight": F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(all_), F.lit(0))})
    share = (F.col("weight") * (F.col("all_words") - cap * F.col("capped_words"))).cast("double") / F.nullif("free_weight", F.lit(0)).cast("double")
    return t.select("source", "source_size", "weight", "all_words", F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def quotas(sources: DataFrame, shards: int = SHARDS, cap: int = 3) -> DataFrame:
    """sources with the block length, each source's blocks, ``upto``: the blocks that the first 1, 2, ...
    shards take together by Sainte-Lague, and the quota of all of them."""
    block = F.greatest(F.lit(1).cast("long"), F.least(F.lit(BLOCK_WORDS).cast("long"), F.expr(f"all_words div {BLOCKS}")))
    s = sources.withColumn("block", block).withColumn("blocks", F.expr("(source_size + block - 1) div block"))
    s = s.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    seats = _seats(s, shards).groupBy("number").agg(F.transform(F.sort_array(F.collect_list(F.struct("shards", "seats"))), lambda x: x["seats"]).alias("seats"))
    s = s.join(seats, "number").withColumn("upto", F.transform("seats", lambda x: F.least(x, F.col("blocks") * cap)))
    return s.withColumn("quota", F.element_at("upto", -1)).drop("seats", "number")


def _seats(s: DataFrame, shards: int) -> DataFrame:
    """(number, shards, seats): what each source has of the seats of the first 1, 2, ... shards.

    A divisor d gives each source round(target / d) seats. Those of the divisors at which all have a
    few seats too few, n / 2 + 2, are sure; of those up to n / 2 + 2 too many the best quotients win.
    """
    n, total = F.count(F.lit(1)).over(Window.partitionBy()), F.sum("target").over(Window.partitionBy())
    s = s.select("number", "target", n.alias("n"), total.alias("total"), F.expr("all_words div block").alias("house"))
    s = s.withColumn("shards", F.explode(F.sequence(F.lit(1), F.lit(shards)))).withColumn("house", F.expr(f"house * shards div {shards}"))
    at = lambda house: F.floor(F.coalesce(F.col("target") * F.greatest(house, F.lit(0.0)) / F.nullif("total", F.lit(0.0)), F.lit(0.0)) + 0.5).cast("long")
    s = s.withColumns({"sure": at(F.col("house") - F.col("n") / 2 - 2), "most": at(F.col("house") + F.col("n") / 2 + 2)})
    s = s.withColumn("open", F.col("house") - F.sum("sure").over(Window.partitionBy("shards")))
    listed = s.where("most > sure").select("number", "shards", "open", "target", F.explode(F.sequence("sure", F.col("most") - 1)).alias("seat"))
    best = Window.partitionBy("shards").orderBy((F.col("target") / (2 * F.col("seat") + 1)).desc(), "number", "seat")
    won = listed.withColumn("rank", F.row_number().over(best)).where("rank <= open").groupBy("number", "shards").agg(F.count(F.lit(1)).alias("won"))
    return s.join(won, ["number", "shards"], "left").select("number", "shards", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("seats"))


def place_of(j: Column, blocks: Column, seed: int) -> Column:
    """The place of block j in the seeded order of a source's blocks."""
    return ((j * STEP) % blocks + F.lit(seed) % blocks) % blocks


def times_taken(j: Column, blocks: Column, quota: Column, seed: int) -> Column:
    """How often the mix takes block j of a source's blocks: once for every quota-th seat with its place."""
    return F.floor(quota / blocks).cast("long") + F.when(place_of(j, blocks, seed) < quota % blocks, 1).otherwise(0)


def times_by_shard(j: Column, blocks: Column, upto: Column, seed: int) -> Column:
    """How often each shard takes block j, as an array; its sum is times_taken."""
    place = place_of(j, blocks, seed)
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice(upto, 1, F.size(upto) - 1))
    rounds = lambda seats: F.when(seats > place, F.floor((seats - 1 - place) / blocks).cast("long") + 1).otherwise(F.lit(0).cast("long"))
    return F.zip_with(upto, before, lambda x, y: rounds(x) - rounds(y))


def first_shard(j: Column, blocks: Column, upto: Column, seed: int) -> Column:
    """The first shard that takes block j, from 0; -1 if none does."""
    place = place_of(j, blocks, seed)
    return F.when(place < F.element_at(upto, -1), F.size(F.filter(upto, lambda x: x <= place))).otherwise(-1)


def taken_words(first: Column, size: Column, block: Column, blocks: Column, quota: Column, seed: int) -> Column:
    """Words that the mix takes from the words [first, first + size) of a source's line."""

    def part(j: Column) -> Column:
        inside = F.least(first + size, (j + 1) * block) - F.greatest(first, j * block)
        return inside * times_taken(j, blocks, quota, seed)

    over = F.sequence(F.floor(first / block).cast("long"), F.floor((first + size - 1) / block).cast("long"))
    return F.when(size > 0, F.aggregate(over, F.lit(0).cast("long"), lambda a, j: a + part(j))).otherwise(F.lit(0).cast("long"))


def mix(docs: DataFrame, seed: int = 7, shards: int = SHARDS, cap: int = 3, text: str = "text", whole: bool = False) -> DataFrame:
    """Per document: size, source_size, target, taken (see the module), the first shard that takes the
    block of its first word, and its source's quotas.

    whole: documents aren't divided; the block of its first word says how often one is taken.
    """
    key = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{seed}")))
    sized = docs.select("doc_id", "source", word_count(text_or_empty(text)).alias("size"), F.coalesce(key, F.lit("0" * 32)).alias("order_key"))
    sized = cut(sized)
    digits = LEAST_DIGITS
    rows = sized.count()
    while digits < MOST_DIGITS and rows > CHUNK_ROWS * 16**digits:
        digits += 1
    sized = sized.withColumn("chunk", F.substring("order_key", 1, digits))
    chunks = sized.groupBy("source", "chunk").agg(F.sum("size").alias("chunk_size"))
    totals = chunks.groupBy("source").agg(F.sum("chunk_size").alias("source_size"))
    plan = quotas(targets(totals, cap), shards, cap).select("source", "source_size", "target", "block", "blocks", "quota", "upto")
    starts = chunks.withColumn("chunk_start", F.sum("chunk_size").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)))
    laid = starts.select(F.col("source").alias("__s"), "chunk", F.coalesce("chunk_start", F.lit(0)).alias("chunk_start")).join(plan, F.col("__s").eqNullSafe(F.col("source"))).drop("source")
    laid = laid.withColumnRenamed("chunk", "__c")
    inner = Window.partitionBy("source", "chunk").orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inner_start", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    placed = placed.join(laid, F.col("source").eqNullSafe(F.col("__s")) & (F.col("chunk") == F.col("__c"))).withColumn("first", F.col("chunk_start") + F.col("inner_start"))
    size, block, blocks, quota = (F.col(c) for c in ("size", "block", "blocks", "quota"))
    if whole:
        start = F.least(F.floor(F.col("first") / block).cast("long"), F.greatest(blocks - 1, F.lit(0)))
        taken = F.when(size > 0, size * times_taken(start, blocks, quota, seed)).otherwise(F.lit(0).cast("long"))
    else:
        taken = taken_words(F.col("first"), size, block, blocks, quota, seed)
    shard = F.when(size > 0, first_shard(F.floor(F.col("first") / block).cast("long"), blocks, F.col("upto"), seed)).otherwise(-1)
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), shard.alias("shard"), "first", "block", "blocks", "quota", "upto")


def deal(mixed: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, shard, first, words, times): the parts of documents that each shard takes, as places on
    the source's line, with how often. mixed: the result of mix()."""
    block = F.col("block")
    over = F.sequence(F.floor(F.col("first") / block).cast("long"), F.floor((F.col("first") + F.col("size") - 1) / block).cast("long"))
    parts = mixed.where("size > 0").withColumn("j", F.explode(over))
    parts = parts.select("*", F.posexplode(times_by_shard(F.col("j"), F.col("blocks"), F.col("upto"), seed)).alias("part_shard", "times")).where("times > 0")
    begin = F.greatest(F.col("first"), F.col("j") * block)
    end = F.least(F.col("first") + F.col("size"), (F.col("j") + 1) * block)
    return parts.select("doc_id", F.col("part_shard").alias("shard"), begin.alias("first"), (end - begin).alias("words"), "times")


def mix_report(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "shard")


#: The same in DuckDB: the word line by one running sum per source, and the same formulas.
MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\f\\r]+')) AS BIGINT) AS size,
         coalesce(md5(CAST(doc_id AS VARCHAR) || ':7'), repeat('0', 32)) AS order_key
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM totals),
w2 AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS all_words, CAST(sum(weight) OVER () AS BIGINT) AS all_weight,
    CAST(coalesce(sum(source_size) OVER up, 0) AS BIGINT) AS words_before, CAST(coalesce(sum(weight) OVER up, 0) AS BIGINT) AS weight_before
  FROM w1 WINDOW up AS (ORDER BY source_size * 6 // weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
w3 AS (SELECT *, 3 * source_size * (all_weight - weight_before) <= weight * (all_words - 3 * words_before) AS capped FROM w2),
w4 AS (
  SELECT *, CAST(coalesce(sum(source_size) FILTER (capped) OVER (), 0) AS BIGINT) AS capped_words,
    CAST(coalesce(sum(weight) FILTER (NOT capped) OVER (), 0) AS BIGINT) AS free_weight FROM w3),
aimed AS (
  SELECT source, source_size, all_words,
    CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(weight * (all_words - 3 * capped_words) AS DOUBLE) / CAST(nullif(free_weight, 0) AS DOUBLE) END AS target,
    greatest(1, least({BLOCK_WORDS}, all_words // {BLOCKS})) AS block, CAST(count(*) OVER () AS DOUBLE) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM w4),
q1 AS (SELECT *, (source_size + block - 1) // block AS blocks, sum(target) OVER () AS total FROM aimed),
q2 AS (SELECT *, (all_words // block) * k // {SHARDS} AS house FROM q1, range(1, {SHARDS} + 1) t(k)),
q3 AS (
  SELECT *, CAST(floor(coalesce(target * greatest(house - n / 2 - 2, 0.0) / nullif(total, 0), 0) + 0.5) AS BIGINT) AS sure,
    CAST(floor(coalesce(target * greatest(house + n / 2 + 2, 0.0) / nullif(total, 0), 0) + 0.5) AS BIGINT) AS most FROM q2),
q4 AS (SELECT *, house - sum(sure) OVER (PARTITION BY k) AS open FROM q3),
listed AS (SELECT number, k, open, target, unnest(range(sure, most)) AS seat FROM q4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY target / (2 * seat + 1) DESC, number, seat) AS rank FROM listed),
won AS (SELECT number, k, count(*) AS won FROM ranked WHERE rank <= open GROUP BY ALL),
seats AS (SELECT q4.number, k, least(sure + coalesce(won, 0), blocks * 3) AS upto FROM q4 LEFT JOIN won USING (number, k)),
plan AS (
  SELECT q1.*, CAST(u.upto[{SHARDS}] AS BIGINT) AS quota, u.upto FROM q1
  JOIN (SELECT number, list(CAST(upto AS BIGINT) ORDER BY k) AS upto FROM seats GROUP BY number) u USING (number)),
placed AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY order_key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM sized),
joined AS (
  SELECT doc_id, size, source_size, target, first, block, blocks, quota, upto, (((first // block) * {STEP}) % blocks + 7 % blocks) % blocks AS place
  FROM placed JOIN plan ON placed.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN size > 0 THEN CAST(list_sum(list_transform(range(first // block, (first + size - 1) // block + 1), lambda j:
    (least(first + size, (j + 1) * block) - greatest(first, j * block))
    * (quota // blocks + CASE WHEN (((j * {STEP}) % blocks) + 7 % blocks) % blocks < quota % blocks THEN 1 ELSE 0 END))) AS BIGINT)
  ELSE 0 END AS taken,
  CASE WHEN size > 0 AND place < quota THEN CAST(len(list_filter(upto, lambda x: x <= place)) AS INTEGER) ELSE -1 END AS shard
FROM joined
"""
