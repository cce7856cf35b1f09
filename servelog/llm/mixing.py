"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. Every source gets a target in words: the wanted total shared by weight, no source
   above ``epochs`` times its size, the excess shared again until none is above.
2. The targets are allocated in blocks of equal length by highest quotients
   ``target / (2k + 1)``, then each source's quota is allocated to its shelves and each
   shelf's to its shards the same way. A shard is a seeded deal of a source's documents,
   so none is hot; a shelf is a run of shards, so however large a source is, a window task
   ranks the shelves of one source or the shards of one shelf.
3. A shard's documents, in seeded order and repeated, form a stream; the shard's quota
   is read from it from a seeded start on. A document's share is an overlap of
   intervals: no blocks are listed, no sampling is repeated.

All orders and draws are md5 of a seed and keys, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from servelog.session import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
#: No block is ever listed, so small ones cost nothing; larger ones only coarsen the quotas.
BLOCK_WORDS = 4
SHARD_WORDS = 65_536
SHELF_SHARDS = 1024
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    """Runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))


def _number(digest: Column, first: int) -> Column:
    return F.conv(F.substring(digest, first, 13), 16, 10).cast("long")


def source_order(sources: DataFrame) -> DataFrame:
    """Adds ``nth``: the place of each source by code point, from 0, null last. Sources are
    numbered within ranges and shifted by the counts of earlier ranges."""
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(sources.repartitionByRange(parts, F.col("source").asc_nulls_last())
                .withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__range")) - F.col("__n"))
    inside = Window.partitionBy("__range").orderBy(F.col("source").asc_nulls_last())
    return (dealt.join(before.drop("__n"), "__range")
            .withColumn("nth", F.row_number().over(inside) - 1 + F.col("__before"))
            .drop("__range", "__before"))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE,
            epochs: int = EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, source_size). Each round is one aggregate over the
    sources; capped sources only grow in number, a handful of rounds in practice."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.col("nth") % len(weights)).cast("int") + 1)
    rows = cut(source_order(sources).withColumn("weight", weight))
    cap = F.lit(epochs) * F.col("source_size")
    whole = rows.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    wanted = share * (whole["n"] or 0)
    level = wanted / (whole["w"] or 1)
    while True:
        capped = cap <= F.lit(level) * F.col("weight")
        now = rows.agg(F.sum(F.when(capped, cap)).alias("full"),
                       F.sum(F.when(~capped, F.col("weight"))).alias("w")).first()
        higher = (wanted - (now["full"] or 0)) / now["w"] if now["w"] else level
        if higher <= level:
            break
        level = higher
    return rows.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def apportion(parties: DataFrame, group: list[str], votes: str, total: str, order: str,
              out: str) -> DataFrame:
    """Sainte-Laguë: within ``group``, ``total`` seats by highest ``votes / (2k + 1)``.

    Seats that any divisor above the final one would give need no ranking; only about
    three quotients per party are ranked. Ties go to the least ``order``. Parties
    without votes get none. ``group`` and ``order`` are keys without nulls.
    """
    every = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    with_votes = F.col(votes) > 0
    sized = (parties.withColumn("__sum", F.sum(F.when(with_votes, F.col(votes).cast("double"))).over(every))
             .withColumn("__n", F.count(F.when(with_votes, F.lit(1))).over(every)))
    total_, half = F.col(total), F.col("__n") / 2
    share = F.col(votes) / F.col("__sum")
    sure = F.when(with_votes & (total_ > half), F.floor(share * (total_ - half) + 0.5)).otherwise(0)
    most = F.when(with_votes, F.floor(share * (total_ + half) + 0.5) + 1).otherwise(0)
    sized = (sized.withColumn("__sure", sure.cast("long"))
             .withColumn("__left", total_ - F.sum("__sure").over(every))
             .withColumn("__most", most.cast("long")))
    seats = (sized.where(F.col("__most") > F.col("__sure"))
             .select(*group, order, "__left", votes,
                     F.explode(F.sequence("__sure", F.col("__most") - 1)).alias("__k"))
             .withColumn("__q", F.col(votes) / (2 * F.col("__k") + 1)))
    best = Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.col("__q").desc(), order)
    won = (seats.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= F.col("__left"))
           .groupBy(*group, order).agg(F.count(F.lit(1)).alias("__won")))
    return (sized.join(won, [*group, order], "left")
            .withColumn(out, F.col("__sure") + F.coalesce("__won", F.lit(0)))
            .select(*parties.columns, out))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
        weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS,
        block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, shelf_shards: int = SHELF_SHARDS,
        keep: tuple = ()) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, taken; how often it is
    taken as a whole (``full_copies``) and the words [from, to) taken once more; columns ``keep``.

    ``taken`` counts repeats and is at most ``epochs`` times ``size``. Null texts have
    size 0 and take 0. A null source is a source of its own, the last. Rows that repeat
    a doc_id are documents of their own, ordered by size and a hash of the text. An empty
    table gives no rows.
    """
    sizes = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                            word_count(text).alias("size"), _number(F.md5(text), 1).alias("__tie"), *keep))
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    aimed = (targets(per_source, weights, share, epochs)
             .withColumn("__blocks", F.round(F.sum("target").over(Window.partitionBy(F.lit(0)))
                                             / block_words).cast("long")))
    quotas = cut(apportion(aimed, [], "target", "__blocks", "nth", "blocks")
                 .select("source", "nth", "source_size", "target", "blocks",
                         F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))
                         .cast("long").alias("__shards")))
    digest = _digest(F.col("doc_id"))
    dealt = (sizes.join(quotas, sizes["source"].eqNullSafe(quotas["source"])).drop(quotas["source"])
             .withColumn("__d", digest)
             .withColumn("shard", _number(F.col("__d"), 14) % F.col("__shards")))
    shards = cut(dealt.groupBy("nth", "shard", "blocks").agg(F.sum("size").alias("shard_size"))
                 .withColumn("shelf", F.floor(F.col("shard") / shelf_shards)))
    shelves = shards.groupBy("nth", "shelf", "blocks").agg(F.sum("shard_size").alias("shelf_size"))
    shelves = apportion(shelves, ["nth"], "shelf_size", "blocks", "shelf", "shelf_quota")
    shards = apportion(shards.join(shelves.select("nth", "shelf", "shelf_quota"), ["nth", "shelf"]),
                       ["nth", "shelf"], "shard_size", "shelf_quota", "shard", "quota")
    start = _number(_digest(F.col("nth"), F.col("shard")), 1) % F.greatest(F.lit(1), F.col("shard_size"))
    words = F.least(F.col("quota") * block_words, F.lit(epochs) * F.col("shard_size"))
    shards = shards.select(
        "nth", "shard", "shard_size", start.alias("__from"),
        F.floor(words / F.greatest(F.lit(1), F.col("shard_size"))).alias("__full"),
        (words % F.greatest(F.lit(1), F.col("shard_size"))).alias("__rest"))
    stream = (Window.partitionBy("nth", "shard").orderBy("__d", "size", "__tie")
              .rowsBetween(Window.unboundedPreceding, 0))
    placed = (dealt.withColumn("__at", F.sum("size").over(stream) - F.col("size"))
              .join(shards, ["nth", "shard"]))
    first, second = overlap(0), overlap(F.col("shard_size"))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("__full") * F.col("size") + _length(first) + _length(second)).alias("taken"),
        F.col("__full").alias("full_copies"), first.alias("first_part"), second.alias("second_part"), *keep)


def overlap(back: Column | int) -> Column:
    """Words [from, to) of a document that lie in the part of the stream that is read once
    more, which starts ``back`` words earlier for its wrapped end."""
    back = back if isinstance(back, Column) else F.lit(back)
    at, lo = F.col("__at"), F.col("__from") - back
    a = F.greatest(at, lo)
    b = F.least(at + F.col("size"), lo + F.col("__rest"))
    return F.when(b > a, F.struct((a - at).alias("from"), (b - at).alias("to")))


def _length(part: Column) -> Column:
    return F.coalesce(part["to"] - part["from"], F.lit(0))


def mixed_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
                **settings) -> DataFrame:
    """The mix itself: each document once per full copy, and the words of its parts.

    Rows keep the columns of ``docs``; a part's text runs from its first word to its last
    with the white space between. n_chars, where present, is set anew for parts. Rows that
    agree in id, source and text stand for one document given several times.
    """
    keyed = docs.withColumn("__key", F.md5(F.to_json(F.struct(
        F.col(doc_id).alias("a"), F.col(source).alias("b"), F.md5(text).alias("c")))))
    shares = mix(keyed, text, doc_id, source, keep=("__key",), **settings)
    null_part = "cast(null as struct<from:bigint,to:bigint>)"
    plan = shares.where(F.col("taken") > 0).select("__key", F.explode(F.concat(
        F.expr(f"array_repeat({null_part}, cast(full_copies as int))"),
        F.filter(F.array("first_part", "second_part"), lambda p: p.isNotNull()))).alias("__part"))
    words = F.regexp_extract_all(F.col(text), F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    first, after = F.col("__part")["from"], F.col("__part")["to"]
    piece = F.regexp_replace(F.array_join(F.slice(words, (first + 1).cast("int"), (after - first).cast("int")), ""),
                             r"[\x20\x09-\x0D]+$", "")
    rows = plan.join(keyed.dropDuplicates(["__key"]), "__key")
    changed = {text: F.when(F.col("__part").isNull(), F.col(text)).otherwise(piece)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("__part").isNull(), F.col("n_chars")).otherwise(
            F.length(piece).cast(docs.schema["n_chars"].dataType))
    return rows.withColumns(changed).select(*docs.columns)
