"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``virtual`` places on a ring of 64-bit hashes; a key (a text, so equal texts share one) belongs to the
first place clockwise from its hash. No shard takes more than ``1 + slack`` times the mean load; a key that its shard
has no room for continues clockwise to the next that has. Large keys are placed before small ones, so the small ones
level the shards. A key that no shard has room for is placed in parts, dealt by a hash of the row's id: a text that a
third of all rows share can't be kept together and balanced at once.

The load is the text's UTF-8 bytes plus 1 (null: 1), so the law is ``bytes``. The ring walk runs on the driver over
units: a unit is a key, or a part of one, or the keys of one short arc of the ring that are small, and holds at most
``slack / (2 * shards)`` of all bytes if no single row does. There are at most some ``12 * shards / slack`` of them, a
number that grows with the shards and never with the input. Balance is guaranteed: while a unit of that size is
unplaced, all shards together have more room left than one such unit for each, so one of them can take it. Only a row
that is larger by itself can't be kept to the bound; it goes to the emptiest shard, which it exceeds by less than its
own size. Rows are only hashed, counted and numbered; texts are never shuffled.

Nulls are the key of no text. Repeated rows share key and id and are numbered in any order among themselves, which
can't be told apart. An empty table gives an empty table. With fewer keys than shards some shards stay empty.
"""

from __future__ import annotations

import bisect
import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.storage import cut


def ring(shards: int, virtual: int) -> tuple[list[int], list[int]]:
    """Places in ascending order, and the shard at each."""
    places = sorted((int.from_bytes(hashlib.blake2b(f"shard {s} place {v}".encode(), digest_size=8).digest(), "big", signed=True), s) for s in range(shards) for v in range(virtual))
    return [p for p, _ in places], [s for _, s in places]


def walk(keys: list[tuple[int, list[tuple]]], loads: dict[tuple, int], shards: int, virtual: int, slack: float) -> dict[tuple, int]:
    """Place keys. ``keys``: position on the ring and the cells of each; ``loads``: by cell. Cell to shard.

    A key goes whole to the first shard clockwise with room for all of it, else cell by cell; a cell that fits nowhere
    goes to the emptiest shard. That is a single large row, or else an error."""
    places, owner = ring(shards, virtual)
    clockwise: dict[int, list[int]] = {}
    total = sum(loads.values())
    room = [math.ceil((1 + slack) * total / shards)] * shards
    out: dict[tuple, int] = {}
    weight = {id(cells): sum(loads[c] for c in cells) for _, cells in keys}
    for position, cells in sorted(keys, key=lambda k: (-weight[id(k[1])], k[0], k[1])):
        at = bisect.bisect_left(places, position) % len(places)
        if at not in clockwise:
            clockwise[at] = list(dict.fromkeys(owner[at:] + owner[:at]))
        order = clockwise[at]
        whole = weight[id(cells)]
        shard = next((s for s in order if room[s] >= whole), None)
        for c in cells:
            to = shard if shard is not None else next((s for s in order if room[s] >= loads[c]), None)
            if to is None:
                if loads[c] <= slack * total / shards:
                    raise RuntimeError("no shard has room for a unit that is small enough")
                to = max(order, key=lambda s: room[s])
            room[to] -= loads[c]
            out[c] = to
    return out


def shard(docs: DataFrame, shards: int = 8, virtual: int = 128, slack: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, size, text_crc32, law, shard, slot, grown_shard`` for each row; slots are gapless from 0 in a shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("i"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(F.col(text_col)).alias("key"),
        F.xxhash64(F.lit("part"), F.col(id_col).cast("string")).alias("h"),
    )
    rows = cut(rows, "sharding")  # texts are read once
    known = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    most = max(1, int(slack * (known["b"] or 0) / (2 * shards)))
    # a key above half of a unit is a unit or more of its own: fewer than 4 * shards / slack such keys exist
    large = cut(rows.groupBy("key").agg(F.sum("size").alias("w")).where(F.col("w") > most / 2).select("key", F.ceil(F.col("w") / (most / 2)).cast("int").alias("parts")), "sharding-large")
    first = math.ceil(math.log2(8 * shards / slack))
    # rows of a unit are numbered in parts of some tens of thousands
    subs = max(1, math.ceil(known["n"] / (50_000 << first)))
    for finer in range(16):  # each turn doubles the units, until no unit that can be parted is too large
        bits = 64 - first - finer
        # a small key's place on the ring: its hash's upper bits, so units stand on the ring in order
        own = F.col("parts").isNotNull()
        placed = rows.join(F.broadcast(large), "key", "left").select(
            "i", "size", "crc", "h", "key", F.when(own, F.col("key")).otherwise(F.shiftrightunsigned("key", bits)).alias("spot"),
            F.when(own, F.pmod(F.col("h"), F.col("parts").cast("long") * (1 << finer))).otherwise(F.lit(-1)).cast("int").alias("part"),
            F.pmod(F.shiftright("h", 20), F.lit(subs)).cast("int").alias("sub"),
        )
        units = placed.groupBy("spot", "part").agg(F.sum("size").alias("w"), (F.when(F.col("part") < 0, F.min("key") != F.max("key")).otherwise(F.min("h") != F.max("h"))).alias("parted"))
        if not units.where((F.col("w") > most) & F.col("parted")).limit(1).count():
            break
    counted = placed.groupBy("spot", "part", "sub").agg(F.sum("size").alias("w"), F.count("*").alias("n")).collect()  # `subs` rows for each unit
    loads: dict[tuple, int] = {}
    numbers: dict[tuple, list[tuple[int, int]]] = {}
    for r in counted:
        cell = (r["spot"], r["part"])
        loads[cell] = loads.get(cell, 0) + r["w"]
        numbers.setdefault(cell, []).append((r["sub"], r["n"]))
    by_key: dict[tuple, list[tuple]] = {}
    for cell in sorted(loads):
        by_key.setdefault((cell[0], cell[1] >= 0), []).append(cell)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    keys = [(spot if own else signed(spot << bits), of) for (spot, own), of in by_key.items()]
    to = walk(keys, loads, shards, virtual, slack) if loads else {}
    start, table = [0] * shards, []
    for cell in sorted(to):
        for sub, n in sorted(numbers[cell]):
            table.append((cell[0], cell[1], sub, to[cell], start[to[cell]]))
            start[to[cell]] += n
    chosen = spark.createDataFrame(table, "spot long, part int, sub int, shard int, start long")
    within = Window.partitionBy("spot", "part", "sub").orderBy("h", "i", "crc", "size")
    numbered = placed.withColumn("at", F.row_number().over(within))
    return numbered.join(F.broadcast(chosen), ["spot", "part", "sub"]).select(
        F.col("i").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
