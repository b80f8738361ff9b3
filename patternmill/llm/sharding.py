"""Sharding by Karmarkar-Karp differencing over indivisible groups of equal texts.

A group's bytes are one number. Differencing keeps *partial partitions* (k sums each) and repeatedly combines the two
of largest spread, one in the opposite order to the other. Here it runs as a tree: groups are dealt by hash into
blocks of bounded size, each block is reduced to one partial partition, and those, far fewer, are reduced again in
blocks until one is left. A partial partition combines with others exactly like a group does, so every level is the
same routine. Each level keeps which part went where; following the levels gives each group its shard. Blocks are
independent tasks of bounded size; nothing is collected.

Defined results: a null text has no bytes, and is one group with the empty texts. A row's size is its bytes plus 16;
rows that repeat are counted and placed each. ``slot`` numbers a shard's rows without gaps, by doc_id within hash
buckets, so no task sorts a whole shard. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import heapq
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patternmill.llm.common import Scratch


def difference(items: list[tuple[list[int], object]], k: int) -> tuple[list[int], list[tuple[object, list[int]]]]:
    """Combine partial partitions (k sums each, any order) into one.

    Returns the final sums and, for each item, to which final part each of its parts went.
    """
    heap = []
    for n, (sums, name) in enumerate(items):
        order = sorted(range(k), key=lambda i: (-sums[i], i))
        ranked = [sums[i] for i in order]
        heap.append((ranked[-1] - ranked[0], n, ranked, [(name, part, at) for at, part in enumerate(order) if sums[part]]))
    heapq.heapify(heap)
    # parts are tracked as a tree of merges; leaves are (name, part)
    nodes: list = [None] * len(items)
    base = {}
    for _, n, _, leaf in heap:
        slots: list = [None] * k
        for name, part, at in leaf:
            slots[at] = (n, part)
        nodes[n] = slots
        base[n] = items[n][1]
    while len(heap) > 1:
        _, _, a, sa = _pop(heap, nodes)
        _, m, b, sb = _pop(heap, nodes)
        sums = [x + y for x, y in zip(a, reversed(b))]
        slots = [_join(x, y) for x, y in zip(sa, reversed(sb))]
        order = sorted(range(k), key=lambda i: (-sums[i], i))
        ranked = [sums[i] for i in order]
        nodes[m] = [slots[i] for i in order]
        heapq.heappush(heap, (ranked[-1] - ranked[0], m, ranked, None))
    _, m, sums, _ = heap[0]
    went = {n: [0] * k for n in base}
    for at, slot in enumerate(nodes[m]):
        stack = [slot]
        while stack:
            x = stack.pop()
            if x is None:
                continue
            if isinstance(x, list):
                stack.extend(x)
            else:
                went[x[0]][x[1]] = at
    return sums, [(base[n], went[n]) for n in went]


def _pop(heap: list, nodes: list) -> tuple:
    spread, n, sums, _ = heapq.heappop(heap)
    return spread, n, sums, nodes[n]


def _join(x: object, y: object) -> object:
    return y if x is None else x if y is None else [x, y]


def shard_groups(groups: DataFrame, shards: int, block: int, scratch: Scratch) -> DataFrame:
    """groups (g, size) -> (g, shard).

    The last level sees the parts of all blocks as single numbers, with the groups that are too large for a block to
    even out and about ``2 * block`` ordinary groups dealt to it by hash, whose small sizes level what is left.
    """
    n, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    # fewer than block / 2 groups can be this large
    late = (F.col("size") * (block // 2) > total) | (F.pmod(F.xxhash64(F.lit("late"), "g"), F.lit(max(1, n))) < 2 * block)
    blocks = max(1, -(-n // block))

    def first(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("g", "ascending")])
        items = [([s] + [0] * (shards - 1), i) for i, s in enumerate(table.column("size").to_pylist())]
        sums, went = difference(items, shards)
        part = [0] * len(items)
        for i, w in went:
            part[i] = w[0]
        names, blks = table.column("g").to_pylist(), [key[0].as_py()]
        rows = {"g": names + [None], "blk": blks * (len(names) + 1), "part": part + [-1], "sums": [None] * len(names) + [sums]}
        return pa.Table.from_pydict(rows, pa.schema([("g", pa.string()), ("blk", pa.int64()), ("part", pa.int32()), ("sums", pa.list_(pa.int64()))]))

    def again(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("blk")
        names = table.column("blk").to_pylist()
        sums, went = difference(list(zip(table.column("sums").to_pylist(), names)), shards)
        blks = [b for b, _ in went for _ in range(shards)]
        rows = {"blk": blks + [None], "part": [*range(shards)] * len(went) + [-1], "up": [key[0].as_py()] * (len(blks) + 1), "up_part": [x for _, w in went for x in w] + [-1], "sums": [None] * len(blks) + [sums]}
        return pa.Table.from_pydict(rows, pa.schema([("blk", pa.int64()), ("part", pa.int32()), ("up", pa.int64()), ("up_part", pa.int32()), ("sums", pa.list_(pa.int64()))]))

    def last(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("g", "ascending"), ("blk", "ascending"), ("part", "ascending")])
        _, went = difference([([s] + [0] * (shards - 1), i) for i, s in enumerate(table.column("size").to_pylist())], shards)
        shard = [0] * table.num_rows
        for i, w in went:
            shard[i] = w[0]
        return table.select(["g", "blk", "part"]).append_column("shard", pa.array(shard, pa.int32()))

    level = scratch.save(groups.where(~late).withColumn("blk", F.pmod(F.xxhash64("g"), F.lit(blocks))).groupBy("blk").applyInArrow(first, "g string, blk long, part int, sums array<long>"), "level0")
    place = level.where(F.col("g").isNotNull()).select("g", "blk", "part")
    tops, depth = level.where(F.col("g").isNull()).select("blk", "sums"), 0
    while blocks > block // 4:
        blocks, depth = -(-blocks // (block // 4)), depth + 1
        level = scratch.save(tops.withColumn("up", F.pmod(F.xxhash64("blk"), F.lit(blocks))).groupBy("up").applyInArrow(again, "blk long, part int, up long, up_part int, sums array<long>"), f"level{depth}")
        place = place.join(level.where(F.col("blk").isNotNull()).drop("sums"), ["blk", "part"]).select("g", F.col("up").alias("blk"), F.col("up_part").alias("part"))
        tops = level.where(F.col("blk").isNull()).select(F.col("up").alias("blk"), "sums")
    parts = tops.select(F.lit(None).cast("string").alias("g"), "blk", F.posexplode("sums").alias("part", "size"))
    single = groups.where(late).select("g", F.lit(None).cast("long").alias("blk"), F.lit(None).cast("int").alias("part"), "size")
    final = scratch.save(parts.unionByName(single).withColumn("one", F.lit(0)).groupBy("one").applyInArrow(last, "g string, blk long, part int, shard int"), "last")
    return place.join(final.where(F.col("g").isNull()).drop("g"), ["blk", "part"]).select("g", "shard").unionByName(final.where(F.col("g").isNotNull()).select("g", "shard"))


def shard_documents(docs: DataFrame, shards: int = 40, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document."""
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha1(text.cast("binary")).alias("g"))
    rows = scratch.save(rows, "rows")
    groups = scratch.save(rows.groupBy("g").agg(F.sum("size").alias("size")), "groups")
    shard = scratch.save(shard_groups(groups, shards, block, scratch), "shards")
    placed = rows.join(shard, "g").withColumn("sub", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(max(1, rows.count() // (shards * 2048)))))
    placed = scratch.save(placed, "placed")
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("n")).select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32", "size"))
    out = placed.withColumn("within", within).join(starts, ["shard", "sub"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("within") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
