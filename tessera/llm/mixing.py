"""Mixing sources to target weights, in DataFrame operations only.

Every source's words, in a fixed pseudorandom document order, form one stream that is cut into blocks of
``block_words`` words.  Source targets are turned into whole numbers of blocks.  Each block drawn lands in an
output shard: a shard's counts by source are a multinomial draw, conditioned on the sources' totals (so the
totals are exact), made by a keyed permutation of all output slots.  A source's slots are then numbered across
shards, and slot *k* takes block ``perm(k mod n)`` of its pass ``k div n``, where ``perm`` is a permutation of the
source's *n* block indexes keyed by source and pass.  Blocks join slots by index.

Nothing is collected and no group is taken whole: positions in a source's stream come from hashed buckets (about
the square root of the number of documents), whose totals are summed first; slots are generated in chunks.

Permutations are swap-or-not networks, which work for any domain size and need plain arithmetic only.

Null sources form a source of their own, ordered last.  Null texts have no words.  Documents without words are
reported with nothing taken.  Rows with equal ids and texts are mixed as separate documents.  Results depend on
the rows and the seed only, not on their layout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SORTED_BYTES, WORD, dropped, parts_of, text_of, written

ROUNDS = 16
_CHUNK, _RUN = 1 << 14, 1024


@dataclass(frozen=True)
class Mix:
    """The parameters of a mix; ``weights`` repeat over the sources in code point order."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    block_words: int = 64
    shard_slots: int = 4096
    seed: int = 11


def _permuted(value: str, size: str, *key: str | Column) -> Column:
    """A keyed permutation of ``[0, size)`` applied to *value*: in each round a point swaps with its mirror or not."""
    n = F.col(size)

    def turn(x: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, i), n) - x, n)
        coin = F.xxhash64(*key, -i, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(coin, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.col(value), turn)


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, skey, tie``: words per document; *skey* is a source key without nulls."""
    text = text_of(docs)
    source = F.col("source").cast("string")
    return docs.select(
        "doc_id",
        source.alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("skey"),
        F.xxhash64(text).alias("tie"),
    )


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per source: ``skey, source_size, n_docs, weight, target``; its targets by water-filling.

    Targets grow with the weights until they meet ``most`` times their source's size.  With the sources in order
    of that size for each unit of weight, the level is the first that the sources after it can still share.
    The windows run over one row per source.
    """
    total = sizes.groupBy("skey").agg(
        F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")
    )
    cycle = F.array(*[F.lit(float(w)) for w in mix.weights])
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = total.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(mix.weights)))
    capped = ranked.withColumn("_cap", F.col("source_size") * float(mix.most)).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    before = Window.orderBy("_ratio", "skey").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("_ratio", "skey").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    leveled = capped.withColumn(
        "_level",
        F.try_divide(
            F.sum("source_size").over(everything) * mix.share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
            F.sum("weight").over(rest),
        ),
    )
    # The first source whose ratio exceeds the level left for it, and all after it, get that level.
    level = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "skey", "_level"))).over(everything)
    return leveled.withColumn("_at", level).select(
        "skey",
        "source_size",
        "n_docs",
        "weight",
        F.when(F.col("_at").isNull(), F.col("_cap"))
        .otherwise(F.least(F.col("_cap"), F.col("_at._level") * F.col("weight")))
        .alias("target"),
    )


def plan(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """*targets* with ``n_blocks``, ``n_slots`` (blocks to draw) and ``first_slot`` by source, and ``all_slots``."""
    blocks = F.ceil(F.col("source_size") / mix.block_words)
    slots = F.when(
        F.col("source_size") > 0,
        F.least(F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long"), F.col("n_blocks") * mix.most),
    ).otherwise(F.lit(0))
    order = Window.orderBy("skey")
    return (
        targets(sizes, mix)
        .withColumn("n_blocks", blocks)
        .withColumn("n_slots", slots.cast("long"))
        .withColumn("first_slot", F.sum("n_slots").over(order) - F.col("n_slots"))
        .withColumn("all_slots", F.sum("n_slots").over(Window.partitionBy()))
    )


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shard_counts(planned: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``skey, n_blocks, shard, n``: blocks of each source in each output shard, a draw without replacement."""
    chunks = planned.where("n_slots > 0").select(
        "skey",
        "n_blocks",
        "first_slot",
        "n_slots",
        "all_slots",
        F.explode(F.expr(f"sequence(0L, (n_slots - 1) div {_CHUNK}L)")).alias("_chunk"),
    )
    entries = chunks.repartition(_tasks(planned), "skey", "_chunk").select(
        "skey",
        "n_blocks",
        "all_slots",
        F.explode(
            F.expr(
                f"sequence(first_slot + _chunk * {_CHUNK}L,"
                f" first_slot + least(n_slots, (_chunk + 1) * {_CHUNK}L) - 1)"
            )
        ).alias("_entry"),
    )
    placed = entries.withColumn("_place", _permuted("_entry", "all_slots", F.lit(mix.seed)))
    return placed.groupBy("skey", "n_blocks", F.expr(f"_place div {mix.shard_slots}L").alias("shard")).agg(
        F.count(F.lit(1)).alias("n")
    )


def slots(counts: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``skey, shard, slot, block``: the block in each slot; *slot* numbers a source's slots over all shards."""
    # A source's shards are numbered in runs of _RUN, whose totals come first: no task has all of a source's.
    run = F.expr(f"shard div {_RUN}L").alias("_run")
    sums = counts.groupBy("skey", run).agg(F.sum("n").alias("_sum"))
    earlier = Window.partitionBy("skey").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("skey", "_run", F.coalesce(F.sum("_sum").over(earlier), F.lit(0).cast("long")).alias("_base"))
    before = Window.partitionBy("skey", "_run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.select("*", run).withColumn("_in", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    numbered = inside.join(bases, ["skey", "_run"]).withColumn("_from", F.col("_base") + F.col("_in"))
    # A few rows here become very many: they are dealt out before, to a stated number of tasks.
    each = numbered.repartition(_tasks(counts), "skey", "shard").select(
        "skey", "n_blocks", "shard", F.explode(F.expr("sequence(_from, _from + n - 1)")).alias("slot")
    )
    each = each.withColumn("_pass", F.expr("slot div n_blocks")).withColumn("_k", F.expr("slot % n_blocks"))
    drawn = each.withColumn("block", _permuted("_k", "n_blocks", F.lit(mix.seed + 1), "skey", "_pass"))
    return drawn.select("skey", "shard", "slot", "block")


def placed(sizes: DataFrame, planned: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """*sizes* with ``start``: where the document's words begin in its source's stream, and ``target, source_size``."""
    buckets = F.ceil(F.sqrt(F.col("n_docs"))).cast("long")
    keyed = (
        sizes.join(planned.select("skey", "n_docs", "source_size", "target"), "skey")
        .withColumn("_h", F.xxhash64(F.lit(mix.seed + 2), "doc_id", "tie"))
        .withColumn("_bucket", F.pmod("_h", buckets))
    )
    keyed = written(keyed, "mix-keyed", parts_of(sizes))
    sums = keyed.groupBy("skey", "_bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("skey").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("skey", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0).cast("long")).alias("_base"))
    inside = (
        Window.partitionBy("skey", "_bucket")
        .orderBy("_h", "doc_id", "size", "tie")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    run = keyed.withColumn("_run", F.sum("size").over(inside) - F.col("size"))
    return run.join(offsets, ["skey", "_bucket"]).select(
        "doc_id", "source", "size", "skey", "tie", "source_size", "target", (F.col("_base") + F.col("_run")).alias("start")
    )


def pieces(docs_placed: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``skey, block, doc_id, tie, start, piece_from, piece_words``: what each block holds of each document."""
    b = mix.block_words
    cut = docs_placed.where("size > 0").select(
        "skey",
        "doc_id",
        "tie",
        "start",
        "size",
        F.explode(F.expr(f"sequence(start div {b}L, (start + size - 1) div {b}L)")).alias("block"),
    )
    low = F.greatest(F.col("start"), F.col("block") * b)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
    return cut.select(
        "skey", "block", "doc_id", "tie", "start", (low - F.col("start")).alias("piece_from"), (high - low).alias("piece_words")
    )


def mix_blocks(docs: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """The mix: ``(documents placed in their streams, pieces in output slots)``.

    The second has a row for each document's part of each slot: ``shard, slot, skey, block, doc_id, tie, start,
    piece_from, piece_words``; words ``piece_from .. piece_from + piece_words`` of the document stand there.
    """
    files = parts_of(docs)
    sizes = written(sized(docs), "mix-sizes", files)
    planned = written(plan(sizes, mix), "mix-plan", 1)
    where = written(placed(sizes, planned, mix), "mix-placed", files)
    drawn = slots(written(shard_counts(planned, mix), "mix-counts", files), mix)
    dropped(sizes)
    # Sizes before the explode say nothing of those after it, so the join's strategy is stated.
    return where, pieces(where, mix).join(drawn.hint("merge"), ["skey", "block"])


def taken(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row: words of it that the mix holds."""
    where, mixed = mix_blocks(docs, mix)
    uses = mixed.groupBy("skey", "start").agg(F.sum("piece_words").alias("_taken"))
    # Documents without words share their start with another; they take nothing.
    key = F.when(F.col("size") > 0, F.col("start"))
    return (
        where.withColumn("_key", key)
        .join(uses.withColumnsRenamed({"skey": "_skey", "start": "_start"}), (F.col("skey") == F.col("_skey")) & (F.col("_key") == F.col("_start")), "left")
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0).cast("long")).alias("taken"))
    )


def _passages(docs: DataFrame, mix: Mix) -> DataFrame:
    """The columns of *docs* as ``__c0, __c1, ...``, with ``__cut`` (``shard, slot, start, ...``) and ``__text``."""
    names = docs.columns
    _, mixed = mix_blocks(docs, mix)
    key = lambda i, tie, skey: F.concat_ws("|", F.coalesce(i.cast("string"), F.lit("")), tie, skey)
    skey = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    texts = docs.select(
        *[F.col(c).alias(f"__c{i}") for i, c in enumerate(names)],
        key(F.col("doc_id"), F.xxhash64(text_of(docs)), skey).alias("__key"),
    ).dropDuplicates(["__key"])
    # A document's passages are cut in one row: they hold at most `most` times its words.
    cuts = mixed.groupBy(key(F.col("doc_id"), F.col("tie"), F.col("skey")).alias("__key")).agg(
        F.collect_list(F.struct("shard", "slot", "start", "piece_from", "piece_words")).alias("__cuts")
    )
    words = F.regexp_extract_all(F.col(f"__c{names.index('text')}"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    own = [f"__c{i}" for i in range(len(names))]
    joined = texts.join(cuts.hint("merge"), "__key").select(*own, "__cuts", words.alias("__words"))
    passage = lambda p: F.array_join(
        F.slice(F.col("__words"), (p["piece_from"] + 1).cast("int"), p["piece_words"].cast("int")), ""
    )
    cut = F.explode(F.transform("__cuts", lambda p: F.struct(p.alias("cut"), passage(p).alias("text")))).alias("__p")
    return joined.select(*own, cut).select(*own, F.col("__p.cut").alias("__cut"), F.col("__p.text").alias("__text"))


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix as rows of *docs*: each a document's passage in one slot, with the document's other columns.

    ``text`` is the passage with the white space that follows its words; ``n_chars``, where present, is its length.
    Rows with equal sources, ids and texts have their passages cut from one of them.  :func:`mixed_blocks` gives the
    slots whole.
    """
    out = []
    for i, c in enumerate(docs.columns):
        if c == "text":
            out.append(F.col("__text").alias(c))
        elif c == "n_chars":
            out.append(F.length("__text").cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"__c{i}").alias(c))
    return _passages(docs, mix).select(*out).coalesce(parts_of(docs, SORTED_BYTES))


def mixed_blocks(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix as blocks: ``source, shard, slot, n_words, text, doc_ids``, one row for each slot.

    A block holds ``block_words`` words, a source's last one what is left; ``doc_ids`` names the documents its passages
    are from, in order.  Documents that follow one another in a block are parted by a line feed at least.
    """
    at = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    rows = _passages(docs, mix).select(
        F.col(at["source"]).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(at["source"]).cast("string")), F.lit("")).alias("_skey"),
        F.col("__cut.shard").alias("shard"),
        F.col("__cut.slot").alias("slot"),
        # Passages of a block are few: it has no more than its words.
        F.struct("__cut.start", "__cut.piece_words", F.col("__text").alias("text"), F.col(at["doc_id"]).alias("id")).alias("_p"),
    )
    held = rows.groupBy("_skey", "shard", "slot").agg(F.first("source").alias("source"), F.sort_array(F.collect_list("_p")).alias("_p"))
    total = F.aggregate("_p", F.lit(0).cast("long"), lambda a, p: a + p["piece_words"])
    return held.select("source", "shard", "slot", total.alias("n_words"), F.array_join("_p.text", "\n").alias("text"), F.col("_p.id").alias("doc_ids"))
