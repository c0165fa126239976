"""Balanced label propagation into shards.

Documents with equal text are linked. Each starts in the shard its id hashes to; a round then moves
linked documents to the shard that holds most of their neighbours, as far as that shard's quota has
room, until no move helps. Documents of one text in one shard are interchangeable, so a text's state
is its count per shard and a round joins these counts with the shards' room. Movers are admitted by
gain, then by a hash block; the first block that does not fit is admitted in part. At the end each
text's documents are dealt to its counts; documents beyond a quota (possible only where nearly all
documents are linked) and documents without an equal fill the room that is left.

Law `rows`: shard sizes in rows differ by one at most. Positions come from counts per block, so no
shard, text or table is ordered in one task.

Null text has no links. Rows without id share one hash. Repeated rows are rows of their own. More
shards than documents leave shards empty. Other columns are not looked at.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplodeck.llm.tables import written

SHARDS = 24
ROUNDS = 8
#: Rows of a text (or of the unlinked ones) that one task numbers.
BLOCK_ROWS = 20_000
#: Admission blocks per gain; only how finely a quota's last gap is filled depends on it.
BLOCKS = 64


def _measured(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, size, text_crc32, copy (hash of the text; null without text)."""
    t = F.col(text)
    raw = F.coalesce(t, F.lit("")).cast("binary")
    return written(docs.select(
        F.col(key), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.when(t.isNotNull(), F.sha2(raw, 256)).alias("copy")), "shard-rows")


def _counts_array(shard: str, n: Column, shards: int) -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col(shard) == s, n)), F.lit(0)).cast("long") for s in range(shards)]


def _loads(texts: DataFrame, shards: int) -> list[int]:
    row = texts.agg(*[F.sum(F.col("held")[s]).alias(f"s{s}") for s in range(shards)]).first()
    return [int(x or 0) for x in row]  # one number per shard


def _round(texts: DataFrame, quotas: list[int], shards: int, exchange: bool) -> tuple[DataFrame, int]:
    """One round of moves: texts (copy, held) with moved counts, and how many rows moved. With
    `exchange`, half of what wants to leave a shard counts as room in it, so full shards can trade."""
    spark = texts.sparkSession
    room = [max(0, q - x) for q, x in zip(quotas, _loads(texts, shards), strict=True)]
    # per text: the fullest shard that has room; ties go round by the text's hash
    turn = F.pmod(F.xxhash64("copy"), F.lit(shards)).cast("int")
    open_ = [s for s in range(shards) if exchange or room[s] > 0]
    if not open_:
        return texts, 0
    best = F.array_max(F.array(*[F.struct(
        F.col("held")[s].alias("n"), F.pmod(F.lit(s) + turn, F.lit(shards)).alias("turn"), F.lit(s).alias("s"))
        for s in open_]))
    aimed = texts.withColumn("_b", best).withColumns(
        {"target": F.col("_b.s").cast("int"), "_n": F.col("_b.n"), "_t": F.col("_b.turn")})
    # rows move from shards that hold fewer of the text (or as many, later in its turn)
    cells = aimed.select("copy", "target", "_n", "_t", F.posexplode("held").alias("source", "n")).where(
        (F.col("source") != F.col("target")) & (F.col("n") > 0))
    lower = (F.col("n") < F.col("_n")) | ((F.col("n") == F.col("_n")) & (
        F.pmod(F.col("source") + turn, F.lit(shards)) < F.col("_t")))
    movers = written(cells.where(lower).select(
        "copy", "target", "source", "n", F.floor(F.log2(F.col("_n"))).cast("int").alias("gain"),
        F.pmod(F.xxhash64("copy", "source"), F.lit(BLOCKS)).cast("int").alias("block")), "shard-movers")
    if exchange:
        for source, n in movers.groupBy("source").agg(F.sum("n")).collect():  # one row a shard
            room[source] += n // 2
    rooms = F.broadcast(spark.createDataFrame(list(enumerate(room)), "target int, room long"))  # one row a shard
    # shards x gains x blocks rows from here on
    demand = movers.groupBy("target", "gain", "block").agg(F.sum("n").alias("asked")).withColumn(
        "upto", F.sum("asked").over(Window.partitionBy("target").orderBy(F.desc("gain"), "block")))
    granted = demand.join(rooms, "target").withColumn(
        "granted", F.greatest(F.lit(0), F.least("asked", F.col("room") - F.col("upto") + F.col("asked")))).where(
            "granted > 0").select("target", "gain", "block", "asked", "granted")
    moved = written(movers.join(F.broadcast(granted), ["target", "gain", "block"]).withColumn(
        "n", F.floor(F.col("n") * F.col("granted") / F.col("asked")).cast("long")).where("n > 0").select(
            "copy", "target", "source", "n"), "shard-moved")
    total = moved.agg(F.sum("n")).first()[0] or 0
    if not total:
        return texts, 0
    change = moved.groupBy("copy").agg(F.array(*[
        (F.coalesce(F.sum(F.when(F.col("target") == s, F.col("n"))), F.lit(0)) - F.coalesce(
            F.sum(F.when(F.col("source") == s, F.col("n"))), F.lit(0))) for s in range(shards)]).alias("by"))
    after = texts.join(change, "copy", "left").select("copy", F.when(
        F.col("by").isNull(), F.col("held")).otherwise(
            F.zip_with("held", "by", lambda a, b: a + b)).alias("held"))
    return written(after, "shard-texts"), total


def propagated(rows: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """copy, held (rows per shard) of every text that occurs more than once. rows: key hash in
    `start`, text in `copy`."""
    shards = len(quotas)
    texts = written(rows.where(F.col("copy").isNotNull()).groupBy("copy").agg(
        F.count("*").alias("n"), F.array(*_counts_array("start", F.lit(1), shards)).alias("held")).where(
            "n > 1").select("copy", "held"), "shard-texts")
    trading = True
    for i in range(rounds):
        texts, moved = _round(texts, quotas, shards, trading)
        if not moved and not trading:
            break
        trading = moved > 0 and i + 1 < rounds // 2
    return texts


def _numbered(rows: DataFrame, group: str, key: str) -> DataFrame:
    """_rank: position of each row within its group, from 0. A group is numbered in blocks of about
    BLOCK_ROWS rows; only the blocks' counts of a group meet in one window."""
    inside = Window.partitionBy(group, "_block").orderBy(key, "size", "text_crc32")
    blocks = rows.groupBy(group, "_block").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    return rows.withColumn("_in", F.row_number().over(inside) - 1).join(offsets, [group, "_block"]).withColumn(
        "_rank", F.col("_before") + F.col("_in")).drop("_in", "_before", "_block")


def _texts_with_slots(texts: DataFrame, shards: int) -> DataFrame:
    """copy, ends (cumulative counts of the text over the shards), first (slot of the text's first row
    in each shard). Texts are numbered per shard in blocks of hashes."""
    n = texts.count()
    cells = texts.select("copy", F.pmod(F.xxhash64("copy"), F.lit(max(1, -(-n // BLOCK_ROWS)))).alias("_block"),
                         F.posexplode("held").alias("shard", "n")).where("n > 0")
    sums = cells.groupBy("shard", "_block").agg(F.sum("n").alias("_c")).withColumn("_base", F.coalesce(
        F.sum("_c").over(Window.partitionBy("shard").orderBy("_block").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    within = Window.partitionBy("shard", "_block").orderBy("copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("_in", F.coalesce(F.sum("n").over(within), F.lit(0))).join(
        sums, ["shard", "_block"]).withColumn("slot", F.col("_base") + F.col("_in"))
    first = placed.groupBy("copy").agg(F.array(*_counts_array("shard", F.col("slot"), shards)).alias("first"))
    ends = F.transform("held", lambda _, i: F.aggregate(
        F.slice("held", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, b: a + b))
    return written(texts.select("copy", ends.alias("ends")).join(first, "copy"), "shard-slots")


def _interval(position: Column, ends: list[int]) -> Column:
    """First interval whose end is beyond the position; one comparison per shard."""
    out = F.lit(len(ends) - 1)
    for s in reversed(range(len(ends) - 1)):
        out = F.when(position < ends[s], s).otherwise(out)
    return out


def sharded(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text",
            rounds: int = ROUNDS) -> DataFrame:
    """key, size, text_crc32, shard, slot (gapless from 0 within the shard) of every row."""
    rows = _measured(docs, key, text)
    total = rows.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    start = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(shards))
    texts = propagated(rows.select("copy", start.alias("start")), quotas, rounds)
    loads = _loads(texts, shards)
    slots = _texts_with_slots(texts, shards)
    # rows of repeated texts; a text of a third of all rows is one key of the join, which adaptive
    # execution splits, and many blocks of the numbering
    joined = rows.join(slots, "copy", "left")
    size = F.coalesce(F.element_at("ends", -1), F.lit(total))
    spread = F.pmod(F.xxhash64(key, "text_crc32"), F.greatest(F.ceil(size / BLOCK_ROWS), F.lit(1)))
    grouped = written(joined.select(
        key, "size", "text_crc32", F.when(F.col("ends").isNotNull(), F.col("copy")).otherwise(F.lit("")).alias("_g"),
        spread.alias("_block"), "ends", "first"), "shard-grouped")
    ranked = _numbered(grouped, "_g", key)
    linked = ranked.where("_g <> ''").withColumn("_s", F.size(F.filter(
        "ends", lambda e: e <= F.col("_rank")))).withColumns({
            "_in": F.col("_rank") - F.when(F.col("_s") > 0, F.get("ends", F.col("_s") - 1)).otherwise(0)}
        ).withColumn("_slot", F.col("_in") + F.get("first", F.col("_s")))
    quota, over = F.array(*map(F.lit, quotas)), [max(0, x - q) for x, q in zip(loads, quotas, strict=True)]
    over_before = F.array(*[F.lit(sum(over[:s])) for s in range(shards)])
    within = F.col("_slot") < F.get(quota, F.col("_s"))
    held = linked.withColumn("_e", F.when(~within, F.get(over_before, F.col("_s")) + F.col("_slot") - F.get(
        quota, F.col("_s"))))
    loose = ranked.where("_g = ''").withColumns({
        "_s": F.lit(None).cast("int"), "_slot": F.lit(None).cast("long"), "_e": F.col("_rank") + sum(over)})
    columns = [key, "size", "text_crc32", "_s", "_slot", "_e"]
    free = [max(0, q - x) for q, x in zip(quotas, loads, strict=True)]
    ends = [sum(free[:s + 1]) for s in range(shards)]
    base = F.array(*[F.lit(min(loads[s], quotas[s]) - (ends[s - 1] if s else 0)) for s in range(shards)])
    fill = _interval(F.col("_e"), ends)
    return held.select(*columns).unionByName(loose.select(*columns)).select(
        key, "size", "text_crc32",
        F.when(F.col("_e").isNull(), F.col("_s")).otherwise(fill).cast("int").alias("shard"),
        F.when(F.col("_e").isNull(), F.col("_slot")).otherwise(
            F.col("_e") + F.get(base, fill)).cast("long").alias("slot"))


def cut_texts(placed: DataFrame) -> DataFrame:
    """linked_rows, shards_of_texts, texts: how far equal texts are spread (by checksum)."""
    per = placed.groupBy("text_crc32").agg(
        F.count("*").alias("n"), F.countDistinct("shard").alias("k")).where("n > 1")
    return per.agg(F.sum("n").alias("linked_rows"), F.sum("k").alias("shards_of_texts"), F.count("*").alias("texts"))
