"""Mixing sources to target weights by weighted fair queueing.

Sources by code point, null last, weigh 3, 1, 2, repeating. They share a budget of
150 % of all words by weight; a target stops at twice its source's words and the
excess is shared again by weight until none is above (water filling, in closed form
over the sources sorted by words for their weight).

Documents are shuffled by a digest of seed and doc_id. A document's virtual finish
time is its source's cumulative words, its own included, divided by the target; the
second pass over a source goes on where the first ended. All passes of all documents
are put in order of virtual finish time and taken while the running total of words
stays within the budget. So no document is taken more than twice.

No window holds a source or the whole order. Cumulative words are sums over digest
buckets and then over the rows of one bucket; the place where the budget ends is found
in two histograms of finish time, and only the rows of its bin are put in order.

Null and blank texts have size 0, stay out of all orders and are never taken. Rows
without doc_id are shuffled by a digest of their text. Repeated rows are separate
documents, each with its own passes; they are ordered next to each other. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import only, stage

WEIGHTS = (3, 1, 2)
#: The budget, as hundredths of all words, and how often a document may be taken.
BUDGET_PERCENT, PASSES = 150, 2
#: A table of sources of at most this many rows is broadcast.
BROADCAST_SOURCES = 100_000
#: Digest buckets of a source (three hex digits), bins of finish time per unit, finer bins in one of them.
_BINS, _FINE, _LAST = 1024, 4096, 16

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def shuffle_key(seed: int) -> Column:
    nameless = F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), nameless)).cast("binary"))


def _sized(docs: DataFrame, row: Column, seed: int) -> DataFrame:
    return docs.select(row.alias("row"), "doc_id", "source", word_count("text").alias("size"), shuffle_key(seed).alias("key"))


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source: source, rank, source_size, target, and the budget's total words.

    The windows run over one row a source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy()
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("total", F.sum("source_size").over(every)).withColumn("cap", F.lit(float(PASSES)) * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.col("total") * F.lit(BUDGET_PERCENT / 100)
    ranked = ranked.withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("rest", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("full", F.col("cap") * F.col("rest") <= F.col("w") * (budget - F.col("spent")))
    open_w = F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0.0)).over(every)
    left = budget - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)
    target = F.when(F.col("full"), F.col("cap")).otherwise(left * F.col("w") / open_w)
    return ranked.select("source", "rank", "source_size", target.alias("target"), "total")


def mixing_plan(sized: DataFrame) -> DataFrame:
    """``sized`` (row, doc_id, source, size, key) with source_size, target and copies.

    ``row`` must be a stored unique number of the row.
    """
    spark = sized.sparkSession
    sources, sources_path = stage(source_targets(sized), "sources")
    n_sources = sources.count()
    total = sources.agg(F.max("total")).first()[0] or 0
    near = F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources
    keyed = sized.join(near.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "total")
    keyed = keyed.withColumn("bucket", F.substring("key", 1, 3))
    blank = keyed.filter("size = 0")
    keyed = keyed.filter("size > 0")
    sums = keyed.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    offsets = sums.select("rank", "bucket", (F.sum("words").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("words")).alias("offset"))
    within = Window.partitionBy("rank", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    running = keyed.withColumn("own", F.sum("size").over(within)).join(offsets, ["rank", "bucket"])
    reached = F.col("offset") + F.col("own")
    times = F.array(*[F.try_divide((F.lit(p) * F.col("source_size") + reached).cast("double"), F.col("target")) for p in range(PASSES)])
    timed, timed_path = stage(running.select("row", "doc_id", "source", "size", "source_size", "target", "rank", "key", times.alias("times")), "finish-times")
    passes = timed.select("row", "rank", "key", "size", F.posexplode("times").alias("pass", "time"))
    passes = passes.withColumn("bin", F.floor(F.least("time", F.lit(float(_LAST))) * _BINS)).withColumn("fine", F.floor(F.least("time", F.lit(float(_LAST))) * _BINS * _FINE))
    most = total * BUDGET_PERCENT / 100
    base = 0
    place: list[int | None] = []
    rest = passes
    for level in ("bin", "fine"):
        bins = rest.groupBy(level).agg(F.sum("size").alias("words"))
        upto = bins.withColumn("upto", F.sum("words").over(Window.orderBy(level)))
        edge = upto.filter(F.lit(base) + F.col("upto") > most).orderBy(level).first()
        if edge is None:
            place.append(None)
            break
        place.append(edge[level])
        base += edge["upto"] - edge["words"]
        rest = rest.filter(F.col(level) == edge[level])
    if len(place) == 1:  # the budget is never reached
        copies = timed.withColumn("copies", F.lit(PASSES))
    else:
        order = Window.orderBy("time", "rank", "pass", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
        last = rest.withColumn("upto", F.lit(base) + F.sum("size").over(order)).filter(F.col("upto") <= most).groupBy("row").agg(F.count("*").alias("edge"))
        fine = [F.floor(F.least(F.col("times")[p], F.lit(float(_LAST))) * _BINS * _FINE) for p in range(PASSES)]
        sure = sum((F.when(f < place[1], 1).otherwise(0) for f in fine), F.lit(0))
        copies = timed.join(last, "row", "left").withColumn("copies", sure + F.coalesce("edge", F.lit(0)))
    every = copies.select("row", "doc_id", "source", "size", "source_size", "target", F.col("copies").cast("int").alias("copies"))
    return every.unionByName(blank.select("row", "doc_id", "source", "size", "source_size", "target", F.lit(0).alias("copies")))


def mix_sources(docs: DataFrame, seed: int = 17) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken) of all documents."""
    sized, _ = stage(_sized(only(docs, "doc_id", "source", "text"), F.monotonically_increasing_id(), seed), "sizes")
    return mixing_plan(sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns."""
    names = docs.columns
    row = "row"
    while row in names:
        row += "_"
    kept, _ = stage(docs.withColumn(row, F.monotonically_increasing_id()), "mixed")
    sized, _ = stage(_sized(kept, F.col(row), seed), "sizes")
    passes = F.explode(F.sequence(F.lit(1), F.col("copies")))
    taken = mixing_plan(sized).filter("copies > 0").select(F.col("row").alias(row), passes.alias("pass")).select(row)
    return kept.join(taken, row).select([F.col(f"`{c}`") for c in names])


MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS k
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r, sum(source_size) OVER ()::DOUBLE AS total FROM per
), weighed AS (
  SELECT *, [3.0, 1.0, 2.0][(r % 3 + 1)::INT]::DOUBLE AS w, 2.0 * source_size::DOUBLE AS cap FROM ranked
), filled AS (
  SELECT *, sum(w) OVER () AS all_w,
         coalesce(sum(cap) OVER b, 0) AS spent, coalesce(sum(w) OVER b, 0) AS gone
  FROM weighed WINDOW b AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (
  SELECT *, cap * (all_w - gone) <= w * (1.5::DOUBLE * total - spent) AS is_full FROM filled
), targets AS (
  SELECT source, r, source_size, CASE WHEN is_full THEN cap ELSE
           (1.5::DOUBLE * total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) * w / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () END AS target, total
  FROM capped
), reached AS (
  SELECT row_number() OVER () AS row_id, d.doc_id, d.size, d.k, t.r, t.source_size, t.target, t.total,
         sum(d.size) OVER (PARTITION BY t.r ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), passes AS (
  SELECT *, p, (p * source_size + upto)::DOUBLE / target AS finish FROM reached, (VALUES (0), (1)) v(p) WHERE size > 0
), taken AS (
  SELECT row_id, size, total, sum(size) OVER (ORDER BY finish, r, p, k, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM passes
), sums AS (
  SELECT row_id, sum(size)::BIGINT AS taken FROM taken WHERE running <= 1.5::DOUBLE * total GROUP BY row_id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM reached LEFT JOIN sums USING (row_id)
"""
