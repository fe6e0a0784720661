"""Balanced label propagation: linked documents move towards the shards of their neighbours, under quotas.

Documents of one text are linked; the text's hash is a hub between them, so a group of n copies has n links, not n^2.
Documents of a hub that began in the same shard behave alike, so they move as an atom; a large group is dealt over many
atoms. A round joins the atoms with what their hub prefers, admits the moves that the target's quota has room for, and
leaves the rest for the next round. Unlinked documents cut no edge wherever they are: they fill the room that is left,
so that the shards' counts end at most one apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

SHARDS = 8
ROUNDS = 6
#: Atoms of one hub and first shard.
SALT = 64
#: Hash buckets by which moves are admitted.
ADMIT = 1024
#: A group is large beyond this part of what a shard holds.
LARGE = 4
#: The new columns, and what they are called inside.
MADE = {"size": "_size", "text_crc32": "_crc", "shard": "shard", "slot": "slot"}
#: Documents that are put into order together when slots are given.
CELL = 5000


def _literal(values: list[int], at) -> F.Column:
    return F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), at)


def propagate(atoms: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """atoms (hub, first, salt, n, total, shard) with their shards after at most `rounds` rounds.

    A hub wants its members in as few shards as hold them, those that have most of it already. The driver sees sums by
    shard and bucket only: at most shards x ADMIT numbers.
    """
    shards = len(quotas)
    mean = max(1, sum(quotas) // shards)
    for turn in range(rounds):
        # At most `shards` entries a hub.
        held = atoms.groupBy("hub", "total", "shard").agg(F.sum("n").alias("w"))
        ranked = held.groupBy("hub", "total").agg(F.sort_array(F.collect_list(F.struct("w", F.xxhash64("hub", "shard", F.lit(turn)).alias("tie"), "shard")), False).alias("r"))
        # A group larger than what a shard may hold takes the first shards, the later ones by turns if it is in fewer so far.
        k = F.least(F.lit(shards), F.ceil(F.col("total") / F.lit(mean * 0.95)).cast("int"))
        now = F.transform("r", lambda x: x["shard"])
        wanted = F.slice(F.concat(now, F.array_except(F.array(*[F.lit(s) for s in range(shards)]), now)), F.lit(1), k)
        ranked = ranked.select("hub", wanted.alias("wanted"))
        moves = atoms.join(ranked, "hub")
        pick = F.get("wanted", F.pmod(F.xxhash64("hub", "first", "salt", F.lit(turn)), F.size("wanted")).cast("int"))
        moves = moves.withColumn("to", F.when(F.array_contains("wanted", F.col("shard")), F.col("shard")).otherwise(pick)).drop("wanted")
        large = F.col("total") > mean // LARGE
        moves = moves.withColumn("bucket", F.pmod(F.xxhash64("hub", F.when(large, F.col("salt")), F.lit(turn)), F.lit(ADMIT)).cast("int"))
        moves = materialize(moves.withColumn("large", large), "moves")
        stay = F.col("shard") == F.col("to")
        seen = moves.groupBy("large", stay.alias("stay"), "to", F.when(stay, 0).otherwise(F.col("bucket")).alias("bucket")).agg(F.sum("n").alias("n")).collect()
        if all(r.stay for r in seen):
            return atoms
        # Large groups come first: small ones give way to them as a whole when the counts are evened out.
        room, admitted = list(quotas), {True: [0] * shards, False: [0] * shards}
        for big in (True, False):
            for s in range(shards):
                room[s] -= sum(r.n for r in seen if r.large == big and r.stay and r.to == s)
                for r in sorted((r for r in seen if r.large == big and not r.stay and r.to == s), key=lambda r: r.bucket):
                    if r.n > room[s]:
                        break
                    room[s] -= r.n
                    admitted[big][s] = r.bucket + 1
        go = F.col("bucket") < F.when(F.col("large"), _literal(admitted[True], F.col("to"))).otherwise(_literal(admitted[False], F.col("to")))
        atoms = moves.withColumn("shard", F.when(go, F.col("to")).otherwise(F.col("shard"))).drop("to", "bucket", "large")
        if not any(admitted[True]) and not any(admitted[False]):
            break
    return atoms


def shard(docs: DataFrame, *, shards: int = SHARDS, rounds: int = ROUNDS, with_text: bool = False) -> DataFrame:
    """Every row of `docs` (its columns, and size, text_crc32) with shard and slot.

    The text is left behind unless asked for; with it, texts are written once, numbered, and shuffled once, to be joined with
    their places; without it no text is.

    The shards' counts are at most one apart, slots are gapless from 0 in each, and reruns agree but for the places of
    equal rows among each other. Null texts have size 1 and the checksum of the empty text, and are linked with it. Columns of
    docs named like the new ones are replaced, whatever their case; all others pass. Repeated rows each get a slot. An empty table gives an empty result.
    """
    if with_text:
        (number,) = fresh(docs.columns, "row_number")
        whole = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "shard-docs")
        placed = shard(whole.select("doc_id", "text", number), shards=shards, rounds=rounds).drop("doc_id")
        # A merge at every size: the plan, and what it shuffles, do not change where one side would fit a broadcast.
        rest = whole.drop(*[c for c in docs.columns if c.lower() in MADE])
        return rest.join(placed.hint("merge"), number).drop(number)
    text = F.coalesce(F.col("text"), F.lit(""))
    own = [c for c in docs.columns if c != "text"]
    # The documents' columns travel as one, so that none clashes with those made here.
    rows = docs.select(F.struct(*[docs[c] for c in own]).alias("_row"), (F.octet_length(text) + 1).cast("long").alias("_size"), F.crc32(text).cast("long").alias("_crc"), F.xxhash64(text).alias("_hub"))
    rows = rows.withColumn("_h", F.xxhash64("_hub", F.col("_row.doc_id").cast("string")))
    rows = rows.withColumns({"_first": F.pmod("_h", F.lit(shards)).cast("int"), "_salt": F.pmod(F.shiftright("_h", 20), F.lit(SALT)).cast("int")})
    rows = materialize(rows, "shard-rows")
    count = rows.count()
    quotas = [count // shards + (s < count % shards) for s in range(shards)]
    atoms = rows.groupBy(F.col("_hub").alias("hub"), F.col("_first").alias("first"), F.col("_salt").alias("salt")).agg(F.count("*").alias("n"))
    hubs = atoms.groupBy("hub").agg(F.sum("n").alias("total")).where("total > 1")
    atoms = materialize(atoms.join(hubs, "hub").withColumn("shard", F.col("first")), "atoms")
    atoms = propagate(atoms, quotas, rounds)
    moved = atoms.select(F.col("hub").alias("_a"), F.col("first").alias("_b"), F.col("salt").alias("_c"), F.col("total").alias("_total"), F.col("shard").alias("_shard"))
    at = [rows["_hub"] == moved["_a"], rows["_first"] == moved["_b"], rows["_salt"] == moved["_c"]]
    placed = rows.join(moved, at, "left").withColumn("_shard", F.coalesce("_shard", "_first"))
    large = max(1, count // shards) // LARGE
    placed = placed.withColumn("_class", F.when(F.col("_total").isNull(), 2).when(F.col("_total") > large, 0).otherwise(1))
    cells = max(1, count // CELL)
    # Groups stay together in the order; a large one is dealt over the cells.
    which = F.when(F.coalesce("_total", F.lit(0)).between(2, CELL), F.col("_hub")).otherwise(F.xxhash64("_h", F.lit(1)))
    placed = placed.withColumn("_cell", F.pmod(which, F.lit(cells)).cast("int")).drop("_a", "_b", "_c", "_total")
    placed = materialize(placed, "placed")
    sizes = placed.groupBy("_shard", "_class", "_cell").agg(F.count("*").alias("_n"))
    # A row for each shard and cell, large groups first, the unlinked last: the last go where there is room.
    upto = Window.partitionBy("_shard").orderBy("_class", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    sizes = materialize(sizes, "cells")
    held = {r["_shard"]: r["n"] for r in sizes.groupBy("_shard").agg(F.sum("_n").alias("n")).collect()}
    over = [max(0, held.get(s, 0) - quotas[s]) for s in range(shards)]
    under = [max(0, quotas[s] - held.get(s, 0)) for s in range(shards)]
    over_base = [sum(over[:s]) for s in range(shards)]
    under_base = [sum(under[:s]) for s in range(shards)]
    ranked = placed.join(sizes.drop("_n"), ["_shard", "_class", "_cell"])
    inside = Window.partitionBy("_shard", "_class", "_cell").orderBy("_hub", "_h")
    ranked = ranked.withColumn("_rank", F.col("_base") + F.row_number().over(inside) - 1)
    surplus = F.col("_rank") - _literal(quotas, F.col("_shard"))
    number = F.when(surplus >= 0, surplus + _literal(over_base, F.col("_shard")))
    ranked = ranked.withColumn("_surplus", number)
    to = F.lit(0)
    for s in range(shards):
        if under[s]:
            to = F.when(F.col("_surplus") >= under_base[s], s).otherwise(to) if under_base[s] else F.lit(s)
    ranked = ranked.withColumn("shard", F.when(F.col("_surplus").isNull(), F.col("_shard")).otherwise(to).cast("int"))
    kept = _literal([held.get(s, 0) for s in range(shards)], F.col("shard")) - _literal(under_base, F.col("shard"))
    ranked = ranked.withColumn("slot", F.when(F.col("_surplus").isNull(), F.col("_rank")).otherwise(F.col("_surplus") + kept).cast("long"))
    return ranked.select(*[F.col("_row").getField(c).alias(c) for c in own if c.lower() not in MADE], *[F.col(c).alias(name) for name, c in MADE.items()])


def write(docs: DataFrame, folder: str, **how) -> None:
    """The documents as Parquet, a directory a shard, its rows in order of their slots within each file."""
    placed = shard(docs, with_text=True, **how)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


DIGEST = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def digest(placed: DataFrame, *more: str) -> DataFrame:
    """The columns DIGEST of sharded rows and `more` of theirs."""
    made = {"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}
    return placed.select(*[made[c].alias(c) if c in made else placed[c] for c in DIGEST], *[placed[c] for c in more])


def query(spark, sf_dir: str) -> DataFrame:
    return digest(shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
