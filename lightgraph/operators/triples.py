"""Knowledge triples (head, relation, tail): vocabularies, mapping, statistics, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lookups import DEFAULT_BIN, relation_bin
from ..session import materialize
from .graph import dense_ids


def entity_vocab(triples: DataFrame) -> DataFrame:
    """(entity, entity_id): distinct heads and tails in code-point order, from 0."""
    return dense_ids(triples.select(F.explode(F.array("head", "tail")).alias("entity")).distinct(), "entity", name="entity_id")


def map_triples(triples: DataFrame, vocab: DataFrame, default: int = DEFAULT_BIN) -> DataFrame:
    """(head_id, angle_bin, tail_id); triples with unknown entities are dropped."""
    h = vocab.select(F.col("entity").alias("head"), F.col("entity_id").alias("head_id"))
    t = vocab.select(F.col("entity").alias("tail"), F.col("entity_id").alias("tail_id"))
    return triples.join(h, "head").join(t, "tail").select("head_id", relation_bin(F.col("relation"), default).alias("angle_bin"), "tail_id")


def relation_statistics(triples: DataFrame) -> DataFrame:
    return triples.groupBy(F.lower("relation").alias("relation")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation")


def bin_statistics(triples: DataFrame) -> DataFrame:
    return triples.groupBy(relation_bin(F.col("relation")).alias("angle_bin")).agg(F.count("*").alias("n")).orderBy("angle_bin")


def split(triples: DataFrame, test_ratio: float = 0.1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): int(n (1 - ratio)) triples train, chosen by a seeded hash."""
    if not 0 <= test_ratio <= 1:
        raise ValueError("test_ratio must be between 0 and 1")
    columns = triples.columns
    ranked = materialize(dense_ids(triples.withColumn("_h", F.xxhash64(*columns, F.lit(seed))), "_h", *columns, name="_rank"), "split")
    cut = int(ranked.count() * (1 - test_ratio) + 1e-9)
    return ranked.where(F.col("_rank") < cut).select(columns), ranked.where(F.col("_rank") >= cut).select(columns)


def valid_tails(mapped: DataFrame) -> DataFrame:
    """(head_id, angle_bin, tails) with the tails in order."""
    return mapped.groupBy("head_id", "angle_bin").agg(F.sort_array(F.collect_set("tail_id")).alias("tails"))


def valid_heads(mapped: DataFrame) -> DataFrame:
    """(tail_id, angle_bin, heads) with the heads in order."""
    return mapped.groupBy("tail_id", "angle_bin").agg(F.sort_array(F.collect_set("head_id")).alias("heads"))


#: Draws for each negative that are made for every triple; only triples that these leave short get all attempts.
FIRST_DRAWS = 2


def negatives(mapped: DataFrame, num_entities: int, k: int = 8, seed: int = 42, attempts: int = 10, of: DataFrame | None = None) -> DataFrame:
    """(head_id, angle_bin, tail_id, n, negative): k entities each that aren't valid tails, from `attempts` * k draws by
    a seeded hash; where those don't suffice, draws that may be valid fill up. of: the triples to draw for, all by default.

    Draws count in order, so a triple whose first draws hold k entities that aren't valid tails needs no more of them.
    """
    keys = ["head_id", "angle_bin", "tail_id"]
    distinct = materialize(mapped.select(*keys).distinct(), "negatives-triples")
    asked = distinct if of is None else of.select(*keys).distinct()
    first = materialize(_best_draws(asked, distinct, num_entities, k, seed, min(FIRST_DRAWS, attempts) * k), "negatives-first")
    short = first.where("valid = 1").select(*keys).distinct()
    made = first
    if attempts > FIRST_DRAWS:
        made = first.join(short, keys, "left_anti").unionByName(_best_draws(short, distinct, num_entities, k, seed, attempts * k))
    return made.select(*keys, (F.col("rank") - 1).alias("n"), "negative")


def _best_draws(rows: DataFrame, distinct: DataFrame, num_entities: int, k: int, seed: int, draws: int) -> DataFrame:
    """Of each triple's draws the first k that are no valid tails, then those that are; valid, rank and negative."""
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    drawn = drawn.withColumn("negative", F.pmod(F.xxhash64("head_id", "angle_bin", "tail_id", "draw", F.lit(seed)), F.lit(num_entities)))
    valid = distinct.select("head_id", "angle_bin", F.col("tail_id").alias("negative"), F.lit(1).alias("valid"))
    marked = drawn.join(valid, ["head_id", "angle_bin", "negative"], "left").withColumn("valid", F.coalesce("valid", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("head_id", "angle_bin", "tail_id").orderBy("valid", "draw"))
    return marked.withColumn("rank", rank).where(F.col("rank") <= k).select("head_id", "angle_bin", "tail_id", "rank", "valid", "negative")


def contrastive(chunks: DataFrame, seed: int = 42) -> DataFrame:
    """(document_id, chunk_id, positive_chunk, negative_document, negative_chunk): another chunk of the same document (the
    chunk itself if it is alone) and one of another document (itself if there is no other).

    Chunks are numbered by document, so a document is a range and a draw beyond it is always another document.
    """
    numbered = materialize(dense_ids(chunks.select("document_id", "chunk_id"), "document_id", "chunk_id", name="at"), "contrastive")
    ranges = numbered.groupBy("document_id").agg(F.min("at").alias("from"), F.count("*").alias("size"))
    total = F.lit(numbered.count())
    rows = numbered.join(ranges, "document_id")
    draw = lambda salt, n: F.pmod(F.xxhash64("document_id", "chunk_id", F.lit(seed + salt)), F.greatest(n, F.lit(1)))
    other = F.col("from") + F.pmod(F.col("at") - F.col("from") + 1 + draw(0, F.col("size") - 1), F.col("size"))
    far = F.when(F.col("size") < total, F.pmod(F.col("from") + F.col("size") + draw(1, total - F.col("size")), total)).otherwise(F.col("at"))
    rows = rows.select("document_id", "chunk_id", F.when(F.col("size") > 1, other).otherwise(F.col("at")).alias("p"), far.alias("q"))
    pos = numbered.select(F.col("at").alias("p"), F.col("chunk_id").alias("positive_chunk"))
    neg = numbered.select(F.col("at").alias("q"), F.col("document_id").alias("negative_document"), F.col("chunk_id").alias("negative_chunk"))
    return rows.join(pos, "p").join(neg, "q").select("document_id", "chunk_id", "positive_chunk", "negative_document", "negative_chunk")


def with_texts(triples: DataFrame, texts: DataFrame) -> DataFrame:
    """Triples with head_text and tail_text; an entity without a text (entity, text) stands for itself."""
    h = texts.select(F.col("entity").alias("head"), F.col("text").alias("_h"))
    t = texts.select(F.col("entity").alias("tail"), F.col("text").alias("_t"))
    joined = triples.join(h, "head", "left").join(t, "tail", "left")
    return joined.select("head", "relation", "tail", F.coalesce("_h", "head").alias("head_text"), F.coalesce("_t", "tail").alias("tail_text"))


#: Entities of one block of complement_negatives; the valid tails of a key within a block are one list.
BLOCK_ENTITIES = 4096
#: A multiplicative generator of numbers below a prime.
PRIME, FACTOR = 2_147_483_647, 48_271


def complement_negatives(mapped: DataFrame, num_entities: int, k: int = 8, seed: int = 42, block: int = BLOCK_ENTITIES) -> DataFrame:
    """(head_id, angle_bin, tail_id, n, negative): k distinct entities of 0 to num_entities - 1 for each triple, none of which is a valid
    tail of its (head, bin); all of them, from the least, where there are k at most. Nothing is drawn twice or rejected.

    Of the m entities that aren't valid, the i-th of k comes from the i-th stretch of their order, at a place that a generator gives. The j-th
    that isn't valid is found by rank: blocks of entities know how many aren't valid before them, and a block's valid tails, at
    most `block`, tell it within. A head with very many tails is many rows, one for each block.
    """
    key = ["head_id", "angle_bin"]
    distinct = materialize(mapped.select(*key, "tail_id").distinct(), "complement-triples")
    known = distinct.where(F.col("tail_id").between(0, num_entities - 1))
    blocks = known.groupBy(*key, F.floor(F.col("tail_id") / block).alias("block")).agg(F.sort_array(F.collect_list("tail_id")).alias("tails"))
    # Stretches of the order of entities that aren't valid: from a block that has valid tails up to the next one that does.
    first = distinct.select(*key).distinct().select(*key, F.lit(-1).cast("long").alias("block"), F.array().cast("array<long>").alias("tails"))
    order = Window.partitionBy(*key).orderBy("block")
    ranked = first.unionByName(blocks).withColumn("before", F.coalesce(F.sum(F.size("tails")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.withColumn("from", F.greatest(F.col("block") * block, F.lit(0)) - F.col("before"))  # the rank of the block's first entity, were it not valid
    ranked = ranked.withColumn("to", F.coalesce(F.lead("from").over(order), F.lit(num_entities) - F.col("before") - F.size("tails")))
    stretches = materialize(ranked.where(F.col("to") > F.col("from")), "complement-stretches")
    # As many slots of ranks as a key has stretches: ranks are spread evenly, so one meets two or three stretches on average, however they lie.
    free = stretches.groupBy(*key).agg(F.max("to").alias("m"), F.ceil(F.max("to") / F.count("*")).alias("width"))
    slots = stretches.join(free.drop("m"), key).withColumn("slot", F.explode(F.sequence(F.floor(F.col("from") / F.col("width")), F.floor((F.col("to") - 1) / F.col("width"))))).drop("width")
    asked = distinct.join(free.withColumnRenamed("width", "slot_width"), key)  # keys without a free entity have no stretch
    asked = asked.withColumn("n", F.explode(F.sequence(F.lit(0), F.least(F.lit(k).cast("long"), "m").cast("int") - 1)))
    start = F.floor(F.col("n") * F.col("m") / k)
    width = F.floor((F.col("n") + 1) * F.col("m") / k) - start
    mixed = lambda x: F.pmod(x * FACTOR, F.lit(PRIME))
    drawn = mixed(mixed(F.pmod(mixed(F.pmod(F.col("head_id"), F.lit(PRIME))) + F.col("angle_bin") * 8191 + F.pmod(F.col("tail_id"), F.lit(PRIME)) * 131_071 + F.col("n") * 524_287 + seed, F.lit(PRIME))))
    asked = asked.withColumn("rank", F.when(F.col("m") <= k, F.col("n").cast("long")).otherwise(start + F.pmod(drawn, width)))
    asked = asked.withColumn("slot", F.floor(F.col("rank") / F.col("slot_width")))
    met = asked.join(slots, [*key, "slot"]).where((F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to")))
    # Within a stretch, each valid tail at or before the entity moves it on by one: those whose own rank is not above.
    own = F.transform("tails", lambda t, i: t - F.col("before") - i)
    passed = F.size(F.filter(own, lambda r: r <= F.col("rank")))
    return met.select(*key, "tail_id", "n", (F.col("rank") + F.col("before") + passed).alias("negative"))
