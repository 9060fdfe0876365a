"""Sharding by minimum-cost flow: move the fewest bytes from old shards to new capacities.

Old shards and new ones are the two sides of a transport network. A byte that stays
costs nothing, one that moves within its zone (a rack, say) 1, one that leaves it ``far``. Moves of a zone pass through a hub, and zones are
joined by their hubs, so the network has an edge or three a shard, not one for each pair; augmenting along cheapest paths, all of
one length at once, gives the cheapest flow, on the driver. The transfers of hubs are then dealt out in order.

A flow is made of blocks: the rows of a size class of an old shard, in parts by hash. Blocks lie by size class in the old
shard, the largest first, in the part that stays; the first bytes stay, the following ones go where the flow sends them, and only a block that a
cut falls in is divided, among its own rows. Cuts thus fall among small rows and each shard gets its share within a few of these.
Offsets are a two-level prefix sum (block totals, then rows within a block), so no task sees a whole shard.

Cases: a null text has 1 byte and checksum 0; a null id has an old shard like any
other; equal rows are told apart by nothing and get neighbouring slots; an empty table gives
an empty result; other columns are left out, or carried along by ``placed`` and ``rewrite``.
"""

from __future__ import annotations

import uuid
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK_ROWS = 512


class Network:
    """Edges [to, room, cost], each followed by its reverse."""

    def __init__(self, nodes: int):
        self.edges: list[list[int]] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def edge(self, a: int, b: int, room: int, cost: int) -> int:
        for at, to, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[at].append(len(self.edges))
            self.edges.append([to, r, c])
        return len(self.edges) - 2

    def _distances(self, source: int) -> list[float]:
        far = [float("inf")] * len(self.out)
        far[source], queue, queued = 0, deque([source]), {source}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in self.out[a]:
                b, room, cost = self.edges[e]
                if room and far[a] + cost < far[b]:
                    far[b] = far[a] + cost
                    if b not in queued:
                        queued.add(b)
                        queue.append(b)
        return far

    def flow(self, source: int, sink: int) -> None:
        """The cheapest of the largest flows: as much as fits along the shortest paths, until none is left."""
        while (far := self._distances(source))[sink] < float("inf"):
            turn, path, on = [0] * len(self.out), [], {source}
            while True:
                a = self.edges[path[-1]][0] if path else source
                if a == sink:
                    room = min(self.edges[e][1] for e in path)
                    for e in path:
                        self.edges[e][1] -= room
                        self.edges[e ^ 1][1] += room
                    path, on = [], {source}
                    continue
                while turn[a] < len(self.out[a]):
                    e = self.out[a][turn[a]]
                    b, room, cost = self.edges[e]
                    if room and far[b] == far[a] + cost and b not in on:
                        path.append(e)
                        on.add(b)
                        break
                    turn[a] += 1
                else:
                    if not path:
                        break
                    on.discard(a)
                    back = self.edges[path.pop() ^ 1][0]
                    turn[back] += 1


def cheapest_flow(supply: list[int], capacity: list[int], old_zones: list[int] | None = None, new_zones: list[int] | None = None, far: int = 3) -> dict[tuple[int, int], int]:
    """Bytes from old shards to new ones that cost the least in all; shards of one number are one place."""
    n, m = len(supply), len(capacity)
    old_zones, new_zones = old_zones or [0] * n, new_zones or [0] * m
    zones = max([*old_zones, *new_zones], default=0) + 1
    net = Network(n + m + 2 * zones + 2)
    leave, enter, source, sink = n + m, n + m + zones, n + m + 2 * zones, n + m + 2 * zones + 1
    stays, goes, comes, passes = {}, {}, {}, {}
    for i, s in enumerate(supply):
        net.edge(source, i, s, 0)
        if i < m:
            stays[i] = net.edge(i, n + i, s, 0)
        goes[i] = net.edge(i, leave + old_zones[i], s, 0)
    total = sum(supply)
    for a in range(zones):
        for b in range(zones):
            passes[a, b] = net.edge(leave + a, enter + b, total, 1 if a == b else far)
    for j, c in enumerate(capacity):
        comes[j] = net.edge(enter + new_zones[j], n + j, c, 0)
        net.edge(n + j, sink, c, 0)
    net.flow(source, sink)
    moved = lambda e: net.edges[e ^ 1][1]
    flow = {(i, i): moved(e) for i, e in stays.items() if moved(e)}
    giving = [deque((i, moved(e)) for i, e in goes.items() if old_zones[i] == z and moved(e)) for z in range(zones)]
    taking = [deque((j, moved(e)) for j, e in comes.items() if new_zones[j] == z and moved(e)) for z in range(zones)]
    for (a, b), e in passes.items():
        rest = moved(e)
        while rest:
            (i, x), (j, y) = giving[a].popleft(), taking[b].popleft()
            part = min(x, y, rest)
            flow[i, j] = flow.get((i, j), 0) + part
            rest -= part
            if x > part:
                giving[a].appendleft((i, x - part))
            if y > part:
                taking[b].appendleft((j, y - part))
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def segments(flow: dict[tuple[int, int], int], n_old: int, n_new: int) -> list[tuple[int, int, int, int]]:
    """(old, from byte, to byte, new): what stays first, then by new shard; the last is open."""
    rows: list[list[tuple[int, int]]] = [[] for _ in range(n_old)]
    for (i, j), b in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        rows[i].append((j, b))
    found = []
    for i, parts in enumerate(rows):
        at, parts = 0, parts or [(min(i, n_new - 1), 1)]
        for k, (j, b) in enumerate(parts):
            found.append((i, at, 1 << 62 if k == len(parts) - 1 else at + b, j))
            at += b
    return found


def reshard(docs: DataFrame, old: str, size: str, order: list[str], n_old: int, n_new: int, **zones) -> DataFrame:
    """docs with ``shard`` and ``slot``. ``order``: columns that fix the place of a row in its old shard."""
    spark = docs.sparkSession
    held = {r[old]: (r["b"], r["n"]) for r in docs.groupBy(old).agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n")).collect()}  # n_old rows
    supply = [held.get(i, (0, 0))[0] for i in range(n_old)]
    capacity = even_capacities(sum(supply), n_new)
    flow = cheapest_flow(supply, capacity, **zones)
    cut = spark.createDataFrame(segments(flow, n_old, n_new), "seg_old int, lo long, hi long, shard int")
    n_blocks = max(1, -(-max((n for _, n in held.values()), default=0) // BLOCK_ROWS))
    spread = F.xxhash64(*order)
    size_class = F.floor(F.log2(F.greatest(F.col(size), F.lit(1)).cast("double")))
    placed = docs.withColumn("spread", spread).withColumn("block", (64 - size_class) * n_blocks + F.pmod("spread", F.lit(n_blocks)))
    inside = Window.partitionBy(old, "block").orderBy("spread", *order)
    placed = placed.withColumn("inner_off", F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    totals = placed.groupBy(old, "block").agg(F.sum(size).alias("block_bytes"))
    before = Window.partitionBy("b_old").orderBy("b_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col(old).alias("b_old"), F.col("block").alias("b_block"), "block_bytes").withColumn("block_off", F.coalesce(F.sum("block_bytes").over(before), F.lit(0))).drop("block_bytes")
    mid = F.col("block_off") + F.coalesce("inner_off", F.lit(0)) + F.col(size) / 2
    moved = (
        placed.join(starts, (F.col(old) == F.col("b_old")) & (F.col("block") == F.col("b_block")))
        .withColumn("mid", mid)
        .join(F.broadcast(cut), (F.col(old) == F.col("seg_old")) & (F.col("mid") >= F.col("lo")) & (F.col("mid") < F.col("hi")))  # three rows a shard at most
        .withColumn("nth", F.row_number().over(Window.partitionBy(old, "block", "shard").orderBy("spread", *order)))
    )
    moved = written(moved.select(*docs.columns, "block", "shard", "nth"), "moved")
    tally = moved.groupBy(F.col(old).alias("t_old"), F.col("block").alias("t_block"), F.col("shard").alias("t_shard")).count()
    ahead = Window.partitionBy("t_shard").orderBy("t_old", "t_block").rowsBetween(Window.unboundedPreceding, -1)
    tally = tally.withColumn("ahead", F.coalesce(F.sum("count").over(ahead), F.lit(0))).drop("count")
    return moved.join(tally, (F.col(old) == F.col("t_old")) & (F.col("block") == F.col("t_block")) & (F.col("shard") == F.col("t_shard"))).select(*docs.columns, "shard", (F.col("ahead") + F.col("nth") - 1).alias("slot"))


def _sized(docs: DataFrame, n_old: int, *more) -> DataFrame:
    """doc_id, size and checksum of each row. The old layout is ``crc32(doc_id) mod n_old``, uneven by bytes."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(n_old)).cast("int").alias("old_shard"),
        *more,
    )


def placed(docs: DataFrame, n_old: int = 12, n_new: int = 16) -> DataFrame:
    """docs with all their columns (but for ``shard`` and ``slot``, if they have such), and their shard and slot."""
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = _sized(docs, n_old, F.struct(*[F.col(f"`{c}`") for c in names]).alias("whole_row"))
    return reshard(rows, "old_shard", "size", ["doc_id", "text_crc32", "size"], n_old, n_new).select("whole_row.*", "shard", "slot")


def digest(docs: DataFrame, n_old: int = 12, n_new: int = 16) -> DataFrame:
    """The contract's columns, and the old shard."""
    narrow = written(_sized(docs, n_old), "sizes")
    out = reshard(narrow, "old_shard", "size", ["doc_id", "text_crc32", "size"], n_old, n_new)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def rewrite(spark, folder: str, n_new: int, order: list[str], target: str | None = None, size_of: str = "text") -> dict[str, list[int]]:
    """Reshard a folder of ``shard=K`` parquet directories, in place or into another folder, which then has all shards.

    Only shards that gain or lose a row are rewritten. They are written beside the target first, under a name that readers
    skip; in place, the old ones are then set aside, the new ones put in, and what was set aside is deleted last: if this is cut short, the
    rows are in the target and ``_aside`` still. The others are listed under ``kept``: their files stay, or are copied as they are. Other columns are carried along.
    """
    df = spark.read.parquet(folder)
    columns = [c for c in df.columns if c not in ("shard", "slot")]
    n_old = (df.agg(F.max("shard")).first()[0] or 0) + 1
    ordered = [f"order_{i}" for i in range(len(order))]
    names = [F.col(f"`{c}`") for c in columns]
    sized = df.select(F.col("shard").cast("int").alias("old_shard"), (F.coalesce(F.octet_length(size_of), F.lit(0)) + 1).cast("long").alias("move_bytes"), *[F.col(c).alias(o) for c, o in zip(order, ordered, strict=True)], F.struct(*names).alias("whole_row"))
    out = written(reshard(sized, "old_shard", "move_bytes", ordered, n_old, n_new), "resharded")
    crossing = out.where("old_shard <> shard").select("old_shard", "shard").distinct().collect()  # what the flow sends: three rows a shard at most
    touched = sorted({r["old_shard"] for r in crossing} | {r["shard"] for r in crossing})
    old = {r["shard"] for r in df.select(F.col("shard").cast("int").alias("shard")).distinct().collect()}  # n_old rows
    kept = sorted(old - set(touched))
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    goal = (target or folder).rstrip("/")
    fs = path(goal).getFileSystem(conf)
    made, aside = f"{goal}/_made-{uuid.uuid4().hex}", f"{goal}/_aside-{uuid.uuid4().hex}"

    def move(a: str, b: str) -> None:
        if fs.exists(path(a)) and not fs.rename(path(a), path(b)):
            raise OSError(f"{a} could not be moved to {b}")

    out.where(F.col("shard").isin(touched)).select("whole_row.*", "slot", "shard").repartition("shard").write.partitionBy("shard").parquet(made)
    same = fs.makeQualified(path(goal)).equals(fs.makeQualified(path(folder)))
    if same:
        fs.mkdirs(path(aside))
        for k in touched:
            move(f"{goal}/shard={k}", f"{aside}/shard={k}")
    else:
        for k in kept:
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(path(folder).getFileSystem(conf), path(f"{folder}/shard={k}"), fs, path(f"{goal}/shard={k}"), False, conf)
    for k in touched:
        move(f"{made}/shard={k}", f"{goal}/shard={k}")
    for x in (made, aside):
        fs.delete(path(x), True)
    return {"rewritten": touched, "kept": kept}
