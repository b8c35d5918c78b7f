"""Sharding by fixed virtual slots and a versioned map from slots to shards.

Records are hashed to thousands of slots once and for all; bytes are added up per slot; a small map, kept as
JSON with a version, says which shard holds a slot. Rebalancing edits the map and moves whole slots.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, filesystem

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """``shard_of[slot]``; each edit gives a new map of the next version."""

    shards: int
    shard_of: tuple[int, ...]
    version: int = 1

    def save(self, folder: str) -> str:
        """Write this version to ``folder``; earlier versions stay there."""
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        path = f"{root}/map-{self.version:06d}.json"
        with store.open_output_stream(f"{path}.part") as f:
            f.write(json.dumps({"version": self.version, "shards": self.shards, "shard_of": self.shard_of}).encode())
        store.move(f"{path}.part", path)
        return path

    @staticmethod
    def load(folder: str, version: int | None = None) -> SlotMap:
        """The given version, or the newest."""
        from pyarrow import fs

        store, root = filesystem(folder)
        names = sorted(x.path for x in store.get_file_info(fs.FileSelector(root)) if x.path.endswith(".json"))
        path = names[-1] if version is None else f"{root}/map-{version:06d}.json"
        with store.open_input_stream(path) as f:
            got = json.loads(f.read())
        return SlotMap(got["shards"], tuple(got["shard_of"]), got["version"])


def assign(sizes: Sequence[int], shards: int) -> SlotMap:
    """A first map: slots in falling order of bytes, each to the lightest shard (ties: the lower number)."""
    heap = [(0, s) for s in range(shards)]
    shard_of = [0] * len(sizes)
    for slot in sorted(range(len(sizes)), key=lambda x: (-sizes[x], x)):
        load, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (load + sizes[slot], shard))
    return SlotMap(shards, tuple(shard_of))


def rebalance(old: SlotMap, sizes: Sequence[int], shards: int | None = None, slack: float = 0.02) -> SlotMap:
    """The next version of ``old`` for new ``sizes`` or another number of shards, moving few slots.

    Slots of shards that are gone are dealt out first. Then, while the heaviest shard is more than ``slack``
    above the mean, the largest slot moves from it to the lightest that makes neither heavier than it was.
    """
    shards = shards or old.shards
    shard_of, load = list(old.shard_of), [0] * shards
    for slot, shard in enumerate(shard_of):
        if shard < shards:
            load[shard] += sizes[slot]
    for slot in sorted((s for s, x in enumerate(shard_of) if x >= shards), key=lambda s: -sizes[s]):
        to = load.index(min(load))
        shard_of[slot] = to
        load[to] += sizes[slot]
    held = [sorted((s for s, x in enumerate(shard_of) if x == k), key=lambda s: sizes[s]) for k in range(shards)]
    mean = sum(load) / shards
    while True:
        heavy, light = load.index(max(load)), load.index(min(load))
        gap = load[heavy] - load[light]
        fits = [s for s in held[heavy] if 0 < sizes[s] < gap]
        if load[heavy] <= (1 + slack) * mean or not fits:
            break
        slot = min(fits, key=lambda s: abs(2 * sizes[s] - gap))
        held[heavy].remove(slot)
        held[light].append(slot)
        shard_of[slot] = light
        load[heavy] -= sizes[slot]
        load[light] += sizes[slot]
    return SlotMap(shards, tuple(shard_of), old.version + 1)


def with_slots(docs: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, vslot, row (a number of its own) of every row.

    The slot is a hash of the text, so that copies share a slot and thereby a shard. A text whose copies together
    hold more bytes than a shard's equal part, of which there are fewer than ``shards``, fits into none: its rows
    are dealt by their numbers over so many slots that each holds no more than a slot's equal part.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = cut(rows, "sizes")  # from here on a row keeps its number
    total = rows.agg(F.sum("size").alias("bytes")).first().bytes or 1
    groups = rows.groupBy("text_hash").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    large = groups.filter((F.col("b") * shards > total) & (F.col("n") > 1)).select("text_hash", F.ceil(F.col("b") / total * slots).cast("int").alias("salts"))
    salted = rows.join(F.broadcast(large), "text_hash", "left")
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("row", F.lit(11)), F.col("salts")))
    return salted.select("doc_id", "size", "text_crc32", F.pmod(F.xxhash64("text_hash", F.coalesce(salt, F.lit(0))), F.lit(slots)).cast("int").alias("vslot"), "row")


def shard_documents(docs: DataFrame, shards: int, slots: int = SLOTS, folder: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Place every row of ``docs`` (doc_id, text): doc_id, size, text_crc32, vslot, shard, slot; and the map used.

    Shards hold nearly equal bytes; slot counts the rows of a shard from 0 without gaps, in order of virtual
    slot. Rows of a slot are numbered in boxes, as many as the slot holds times the rows of an equal part, so that no
    task numbers a large group alone. The driver holds one row per virtual slot and one per box, of which there are at
    most twice as many. With ``folder`` the map is saved there.

    A null text has no bytes and size 1. Rows with a null or repeated doc_id are placed like any other. Other
    columns are not read. An empty table gives no rows and a map of all slots.
    """
    spark = docs.sparkSession
    placed = cut(with_slots(docs, shards, slots), "slots")
    counted = {r.vslot: (r.bytes, r.rows) for r in placed.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
    mapped = assign([counted.get(v, (0, 0))[0] for v in range(slots)], shards)
    if folder:
        mapped.save(folder)
    part = max(-(-sum(n for _, n in counted.values()) // slots), 1)
    in_boxes = F.broadcast(spark.createDataFrame([(v, -(-n // part)) for v, (_, n) in sorted(counted.items())], "vslot int, boxes int"))  # a row per slot
    boxed = placed.join(in_boxes, "vslot").withColumn("box", F.pmod(F.xxhash64("row", F.lit(13)), F.col("boxes")).cast("int")).drop("boxes")
    at, table = [0] * shards, []
    for r in boxed.groupBy("vslot", "box").count().orderBy("vslot", "box").collect():  # at most 2 * slots
        shard = mapped.shard_of[r.vslot]
        table.append((r.vslot, r.box, shard, at[shard]))
        at[shard] += r["count"]
    places = F.broadcast(spark.createDataFrame(table, "vslot int, box int, shard int, first long"))
    within = F.row_number().over(Window.partitionBy("vslot", "box").orderBy("doc_id", "text_crc32", "size", "row")) - 1
    out = boxed.withColumn("within", within).join(places, ["vslot", "box"])
    return out.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("first") + F.col("within")).alias("slot")), mapped
