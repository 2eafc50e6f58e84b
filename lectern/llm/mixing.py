"""Mixing sources to target weights: fixed-length blocks, drawn per output shard.

Only DataFrame functions are used.

1. Each source's words are laid end to end (documents in a fixed pseudorandom
   order) and packed into blocks of ``block_words`` words; what is left at the
   end of a source is its short block.
2. Targets: the sources share ``share`` times all words by weight; a target
   stops at ``repeat`` times its source's size, and the excess is shared again.
   A source has as many slots as its target needs blocks; its last slot takes
   the first words of its block only, so that the target is met to the word.
3. An output shard holds ``shard_blocks`` slots.  Its source counts are drawn:
   a keyed permutation deals all slots, numbered by source, to the shards.
   That is a multinomial draw per shard under the condition that the shards'
   counts of a source sum to its slots.
4. The counts, summed over the earlier shards, give each shard and source a
   range of the source's slots.  Slot j of a source takes block perm(j) of the
   epoch, where perm is a pseudorandom permutation of the indices of the
   source's full blocks (a swap-or-not shuffle, keyed by source and epoch), and
   the short block comes last: no block is taken twice before all were once.
5. Blocks are joined by index with the documents that lie in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .workspace import materialize

#: Weights of the sources in their order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
BLOCK_WORDS, SHARD_BLOCKS, ROUNDS = 128, 1024, 8
#: Documents of a source that one task adds up, and slots that one row makes.
CHUNK_ROWS, CHUNK_SLOTS = 4096, 4096
_WORD = "[^\\x20\\x09-\\x0D]+"


def size_in_words(text: Column) -> Column:
    """The number of runs of ``[^\\x20\\x09-\\x0D]+``; null has none."""
    blank = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(blank, " +"), lambda w: w != "")).cast("bigint")


def _ranked(names: DataFrame) -> DataFrame:
    """names (one string column ``source``, distinct) with its rank by code point, null last.

    Ranges are numbered first, so that no task sees all names.
    """
    n = names.sparkSession.sparkContext.defaultParallelism
    spread = names.withColumn("absent", F.col("source").isNull()).repartitionByRange(n, "absent", "source")
    spread = materialize(spread.withColumn("part", F.spark_partition_id()), "names")
    within = spread.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("absent", "source")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = spread.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    return within.join(sums, "part").select("source", (F.col("base") + F.col("k") - 1).alias("rank"))


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, repeat: float) -> DataFrame:
    """sources (source, source_size) with rank, weight and target.

    A level is looked for such that the targets min(level * weight, repeat *
    size) sum to the share: each step fixes the sources that the level fills,
    until none is above its stop.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    names = _ranked(sources.select("source")).withColumnRenamed("source", "name")
    ranked = sources.join(names, sources["source"].eqNullSafe(names["name"])).drop("name").withColumn("weight", weight)
    ranked = ranked.withColumn("stop", repeat * F.col("source_size"))
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        filled = F.col("stop") <= F.col("weight") * level
        row = ranked.agg(
            F.count(F.when(filled, 1)), F.coalesce(F.sum(F.when(filled, F.col("stop"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~filled, F.col("weight"))), F.lit(0.0))
        ).first()
        if row[0] == full or row[2] == 0:
            break
        full, level = row[0], (total - row[1]) / row[2]
    return ranked.withColumn("target", F.least(F.col("stop"), F.col("weight") * level)).drop("stop")


def _permuted(index: Column, n: Column, key: Column) -> Column:
    """``index`` (0 to n - 1) mapped by a keyed permutation of its range.

    Each round of the swap-or-not shuffle pairs x with (k - x) mod n and swaps
    the pair or not by a hash of its greater member, so that every round is a
    permutation of the range itself, whatever n is.
    """

    def step(x: Column, r: Column) -> Column:
        mate = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.xxhash64(r, F.greatest(x, mate), key).bitwiseAND(1) == 1, mate).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), index, step)


def _sums_before(df: DataFrame, by: list[str], at: str, what: str, name: str) -> DataFrame:
    """``df`` with the sum of ``what`` over the rows with a lower ``at`` (0, 1, ...; one row each), for each ``by``.

    Sums of runs of CHUNK_ROWS rows come first, so that no task sees all of them.
    """
    high = F.floor(F.col(at) / CHUNK_ROWS).alias("_high")
    earlier = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    runs = df.groupBy(*by, high).agg(F.sum(what).alias("_run")).select(*by, "_high", F.coalesce(F.sum("_run").over(earlier(by or [F.lit(0)], "_high")), F.lit(0)).alias("_base"))
    inside = df.withColumn("_high", high).withColumn("_mid", F.coalesce(F.sum(what).over(earlier([*by, "_high"], at)), F.lit(0)))
    return inside.join(runs, [*by, "_high"]).withColumn(name, F.col("_base") + F.col("_mid")).drop("_high", "_base", "_mid")


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5,
    repeat: float = 2.0, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 0,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plan, pieces, draws): the sizes and targets of all documents, what the mix takes, and the drawn counts.

    plan: id, row, size, source, source_size, target for each input row.
    pieces: shard, slot (of the source), epoch, row, id, first, last: the words
    first to last - 1 (from 0) of a document that a slot of an output shard takes.
    draws: shard, source, n, first: the slots first to first + n - 1 of a source
    that a shard holds; shards have ``shard_blocks`` slots, the last what is left.

    row_col: a column of ``docs`` that tells its rows apart; without one they
    are numbered here.  Null and blank texts have size 0 and no pieces.  A null
    source is a source of its own, the last.  Rows that share an id or are
    equal are rows of their own, told apart by ``row``.  A source of size 0 has
    target 0.  Reruns over the same rows give the same mix, but for which of
    several rows equal in id, source and text is meant.  Such equal rows are
    ordered in one task, which streams and spills.
    """
    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).alias("id"), number.alias("row"), F.col(source_col).cast("string").alias("source"), size_in_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("print"))
    rows = materialize(rows, "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    table = targets(sources, weights, share, repeat).withColumn("words", F.floor("target").cast("bigint"))
    table = table.withColumn("full", F.floor(F.col("source_size") / block_words)).withColumn("n_blocks", F.ceil(F.col("source_size") / block_words))
    size = F.greatest("source_size", F.lit(1))
    table = table.withColumn("epochs", F.floor(F.col("words") / size)).withColumn("rest", F.col("words") % size)
    table = table.withColumn("n_slots", F.col("epochs") * F.col("n_blocks") + F.ceil(F.col("rest") / block_words)).withColumn("n_chunks", F.ceil(F.col("n_rows") / CHUNK_ROWS).cast("bigint"))
    table = materialize(_sums_before(table, [], "rank", "n_slots", "base"), "sources")

    # offsets of the documents in their source: chunks of rows by hash, then sums before each chunk
    named = table.select(F.col("source").alias("name"), "rank", "source_size", "target", "n_chunks")
    placed = rows.join(named, rows["source"].eqNullSafe(named["name"])).drop("name")
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("id", "print", F.lit(seed)), F.col("n_chunks")))
    inside = Window.partitionBy("rank", "chunk").orderBy("id", "print", "size")
    placed = placed.withColumn("begin", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    sums = _sums_before(placed.groupBy("rank", "chunk").agg(F.sum("size").alias("words")), ["rank"], "chunk", "words", "before")
    plan = placed.join(sums.select("rank", "chunk", "before"), ["rank", "chunk"]).withColumn("begin", F.col("before") + F.coalesce("begin", F.lit(0)))
    plan = materialize(plan.select("id", "row", "source", "rank", "size", "source_size", "target", "begin"), "plan")

    # the draw: a row for each run of slots, then one for each slot, so that a large source starts in many tasks
    runs = table.where("n_slots > 0").select("rank", "base", "n_slots", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_slots") - 1) / CHUNK_SLOTS))).alias("run"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low, high = F.col("run") * CHUNK_SLOTS, F.least((F.col("run") + 1) * CHUNK_SLOTS, F.col("n_slots")) - 1
    dealt = runs.repartition(tasks, "rank", "run").select("rank", F.explode(F.sequence(F.col("base") + low, F.col("base") + high)).alias("number"))
    total = F.lit(table.agg(F.sum("n_slots")).first()[0] or 1).cast("bigint")
    shard = F.floor(_permuted(F.col("number"), total, F.xxhash64(F.lit(seed), F.lit("shard"))) / shard_blocks)
    counts = dealt.select("rank", shard.alias("shard")).groupBy("rank", "shard").agg(F.count("*").alias("n"))
    # a source may be in few shards: sums before a shard go by the shard's number, whether it has the source or not
    draws = materialize(_sums_before(materialize(counts, "counts"), ["rank"], "shard", "n", "first"), "draws")

    what = table.select("rank", "full", "n_blocks", "epochs", "rest")
    taken = draws.join(what, "rank").repartition(tasks, "rank", "shard").select("*", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
    taken = taken.withColumn("epoch", F.floor(F.col("slot") / F.col("n_blocks"))).withColumn("k", F.col("slot") % F.col("n_blocks"))
    block = F.when(F.col("k") < F.col("full"), _permuted(F.col("k"), F.greatest("full", F.lit(1)), F.xxhash64("rank", "epoch", F.lit(seed)))).otherwise(F.col("k"))
    most = F.when(F.col("epoch") < F.col("epochs"), F.lit(block_words)).otherwise(F.least(F.lit(block_words), F.col("rest") - F.col("k") * block_words))
    taken = taken.select("rank", block.alias("index"), "shard", "slot", "epoch", most.cast("bigint").alias("most"))

    # documents by block index
    end = F.col("begin") + F.col("size")
    spread = plan.where("size > 0").select("rank", "row", "id", "begin", "size", F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.floor((end - 1) / block_words))).alias("index"))
    # both sides grow with the input, and the planner can't see how much the explosions make
    pieces = taken.hint("merge").join(spread, ["rank", "index"])
    first = F.greatest(F.col("index") * block_words - F.col("begin"), F.lit(0))
    last = F.least(F.col("index") * block_words + F.col("most") - F.col("begin"), F.col("size"))
    pieces = pieces.select("shard", "slot", "epoch", "row", "id", first.alias("first"), last.alias("last")).where("first < last")
    named = draws.join(table.select("rank", "source"), "rank").select("shard", "source", "n", "first")
    return plan.select("id", "row", "size", "source", "source_size", "target"), pieces, named


def taken_words(plan: DataFrame, pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    words = pieces.groupBy("row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    out = plan.join(words, "row", "left")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_chars: str | None = "n_chars", shard_col: str | None = None, **options) -> DataFrame:
    """The output shards: a row of ``docs`` for each piece that a slot takes of a document.

    The text is the piece: the whole text where the slot takes all its words,
    else these words with the white space that follows them; n_chars is its
    length.  A shard's rows lie together, in the order of its sources and their slots,
    and ``shard_col``, if given, is its number.  The other options are those of ``mix``; null ids
    and rows that share an id are mixed like all others.
    """
    row = "_row" + "_" * max([0, *(len(c) for c in docs.columns)])  # a name that no column has
    docs = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", "zstd")
    _, pieces, _ = mix(docs, id_col=id_col, text_col=text_col, row_col=row, **options)
    spans = pieces.groupBy("row").agg(F.collect_list(F.struct("shard", "slot", "first", "last")).alias("_spans"))
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"{_WORD}[\\x20\\x09-\\x0D]*"), F.lit(0))
    joined = docs.join(spans.withColumnRenamed("row", row), row).withColumn("_words", words)

    def piece(s: Column) -> Column:
        n = (s["last"] - s["first"]).cast("int")
        cut = F.array_join(F.slice(F.col("_words"), (s["first"] + 1).cast("int"), n), "")
        return F.struct(s["shard"].alias("shard"), s["slot"].alias("slot"), s["first"].alias("first"), F.when(n >= F.size("_words"), F.col(text_col)).otherwise(cut).alias("text"))

    rest = [c for c in docs.columns if c not in (row, text_col)]
    out = joined.select(*rest, F.explode(F.transform("_spans", piece)).alias("_p"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = out.repartition(tasks, F.col("_p.shard")).sortWithinPartitions("_p.shard", "_p.slot", "_p.first").withColumn(text_col, F.col("_p.text"))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.length(text_col).cast(dict(docs.dtypes)[n_chars]))
    kept = [c for c in docs.columns if c != row]
    return out.select(*kept, *([F.col("_p.shard").alias(shard_col)] if shard_col else []))
