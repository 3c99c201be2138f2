"""Moving documents from old shards to new ones so that the fewest bytes move.

Old shard sizes and new capacities make a small flow network; a minimum-cost flow says how many bytes each
old shard hands to each new one, and documents are then cut along these amounts.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import delete_folder, staged

CHUNK_ROWS = 4096
SHARD_LIMIT = 4096  # shards are an argument; their table is solved on the driver


def byte_size(text: str = "text"):
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


def minimum_cost_flow(supply: dict[int, int], demand: dict[int, int]) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard; supply and demand sum to the same.

    A byte that stays in a shard of the same number costs nothing, any other costs one. Successive shortest
    paths with potentials; every path fills a supply, a demand or a used arc, so the number of rounds does not
    depend on the number of bytes.
    """
    old, new = sorted(supply), sorted(demand)
    left, wanted = dict(supply), dict(demand)
    flow: dict[tuple[int, int], int] = {}
    cost = lambda i, j: 0 if i == j else 1
    potential = {("o", i): 0 for i in old} | {("n", j): 0 for j in new}
    while any(left.values()):
        distance = {("o", i): 0 - potential["o", i] for i in old if left[i]}
        least = min(distance.values())
        distance = {k: v - least for k, v in distance.items()}
        before: dict[tuple, tuple] = {}
        queue = [(d, k) for k, d in distance.items()]
        heapq.heapify(queue)
        done = set()
        while queue:
            d, node = heapq.heappop(queue)
            if node in done:
                continue
            done.add(node)
            side, i = node
            if side == "o":
                arcs = [(("n", j), cost(i, j)) for j in new]
            else:
                arcs = [(("o", o), -cost(o, i)) for o in old if flow.get((o, i))]
            for to, c in arcs:
                reached = d + c + potential[node] - potential[to]
                if to not in done and reached < distance.get(to, reached + 1):
                    distance[to], before[to] = reached, node
                    heapq.heappush(queue, (reached, to))
        far = max(distance.values())
        for node in potential:
            potential[node] += distance.get(node, far)
        end = min((("n", j) for j in new if wanted[j]), key=lambda n: (potential[n], n))
        path = [end]
        while path[-1] in before:
            path.append(before[path[-1]])
        path.reverse()
        amount = min(left[path[0][1]], wanted[end[1]])
        steps = list(zip(path, path[1:], strict=False))
        back = [flow[b[1], a[1]] for a, b in steps if a[0] == "n"]
        amount = min([amount, *back])
        for a, b in steps:
            pair = (a[1], b[1]) if a[0] == "o" else (b[1], a[1])
            flow[pair] = flow.get(pair, 0) + (amount if a[0] == "o" else -amount)
        left[path[0][1]] -= amount
        wanted[end[1]] -= amount
    return {pair: n for pair, n in flow.items() if n}


def even_capacities(total: int, shards: int) -> dict[int, int]:
    return {j: total // shards + (j < total % shards) for j in range(shards)}


def reshard(rows: DataFrame, shards: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Assign every row of ``rows`` (``doc_id, old_shard, size`` and others) a ``shard`` and a ``slot``.

    The flow gives each old shard a list of amounts, the one that stays first. Sizes are summed along the old
    shard and a document goes where the middle of its stretch falls, so every shard's bytes differ from its
    capacity by less than two of its documents for each old shard it takes from. Slots count from 0 without gaps.

    Sums and slots have two levels: hash chunks of about ``chunk_rows`` rows inside an old (a new) shard, and
    one row per chunk; a shard with a third of all rows is many tasks. The driver sees one row per shard.
    Null sizes count 0 bytes, a null ``old_shard`` is shard -1 and hands on everything. Repeated rows are rows
    of their own and get slots of their own. Empty table: no rows.
    """
    sized = rows.withColumn("size", F.coalesce("size", F.lit(0))).withColumn("old_shard", F.coalesce("old_shard", F.lit(-1)))
    sized = staged(sized, "reshard-sizes")
    totals = sized.groupBy("old_shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).limit(SHARD_LIMIT + 1).collect()
    if len(totals) > SHARD_LIMIT:
        raise ValueError(f"more than {SHARD_LIMIT} old shards")
    supply = {r["old_shard"]: r["bytes"] for r in totals}
    flow = minimum_cost_flow(supply, even_capacities(sum(supply.values()), shards))
    cuts = []
    for i in supply:
        at = 0
        for j in sorted((j for o, j in flow if o == i), key=lambda j: (j != i, j)):
            cuts.append((i, at, at + flow[i, j], j))
            at += flow[i, j]
        last = max((c for c in range(len(cuts)) if cuts[c][0] == i), default=None)
        if last is None:  # an old shard of empty rows only
            cuts.append((i, 0, 1 << 62, i if 0 <= i < shards else 0))
        else:
            cuts[last] = (i, cuts[last][1], 1 << 62, cuts[last][3])
    chunks = max([1, *(-(-r["n"] // chunk_rows) for r in totals)])
    chunked = sized.withColumn("__chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))
    starts = chunked.groupBy("old_shard", "__chunk").agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy("old_shard").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("old_shard", "__chunk", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("old_shard", "__chunk").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = chunked.withColumn("__upto", F.sum("size").over(inside)).join(starts, ["old_shard", "__chunk"])
    placed = placed.withColumn("__middle", F.col("__start") + F.col("__upto") - F.expr("size div 2"))
    shard = F.lit(None)
    if cuts:
        by_old: dict[int, list] = {}
        for i, _, end, j in cuts:
            by_old.setdefault(i, []).append(F.struct(F.lit(end).cast("long").alias("end"), F.lit(j).alias("shard")))
        table = F.create_map(*[x for i, parts in by_old.items() for x in (F.lit(i), F.array(*parts))])
        shard = F.filter(table[F.col("old_shard")], lambda x: F.col("__middle") <= x["end"])[0]["shard"]
    assigned = placed.withColumn("shard", shard.cast("int")).drop("__chunk", "__start", "__upto", "__middle")
    return with_slots(staged(assigned, "reshard-assigned"), chunk_rows)


def with_slots(assigned: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Number the rows of each ``shard`` from 0. Shards are few, so their counts are broadcast."""
    counts = assigned.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(chunk_rows)).alias("__chunks"))
    chunked = assigned.join(F.broadcast(counts), "shard").withColumn("__chunk", F.pmod(F.xxhash64("doc_id"), "__chunks"))
    before = Window.partitionBy("shard").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunked.groupBy("shard", "__chunk").count()
    starts = starts.select("shard", "__chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__chunk").orderBy("doc_id", "size")
    numbered = chunked.withColumn("__place", F.row_number().over(inside)).join(starts, ["shard", "__chunk"])
    slot = (F.col("__start") + F.col("__place") - 1).cast("long")
    return numbered.withColumn("slot", slot).drop("__chunks", "__chunk", "__start", "__place")


def rewrite_shards(docs: DataFrame, moved: DataFrame, path: str) -> list[int]:
    """Write the shards below ``path`` (``shard=N`` folders) that gain or lose documents; the others stay as
    they are on disk. ``docs`` holds the old shards' rows, ``moved`` comes from ``reshard`` with the sizes of
    ``byte_size``. Rows are matched by id (null ids too), size and their number among equal ones, so that every
    row is written; more than ``2 * SHARD_LIMIT`` affected shards are refused before anything is.

    New contents are complete in a sibling folder (``-new``) before any shard is touched, and an old shard is
    moved aside (``-old``) until its new one stands in its place: whenever the driver dies, every row is in one
    of the three folders. Returns the numbers of the shards written.
    """
    spark = docs.sparkSession
    changed = moved.where(~F.col("shard").eqNullSafe(F.col("old_shard")))
    changed = changed.select(F.explode(F.array("shard", "old_shard")).alias("shard")).distinct().where("shard >= 0")
    affected = sorted(r[0] for r in changed.limit(2 * SHARD_LIMIT + 1).collect())
    if len(affected) > 2 * SHARD_LIMIT:
        raise ValueError(f"more than {2 * SHARD_LIMIT} affected shards")
    base = path.rstrip("/")
    fresh, aside = f"{base}-new", f"{base}-old"
    number = F.row_number().over(Window.partitionBy("doc_id", "__size").orderBy("__size"))
    kept = moved.select("doc_id", F.col("size").alias("__size"), "shard", "slot").withColumn("__number", number)
    kept = kept.where(F.col("shard").isin(affected)).withColumnsRenamed({"doc_id": "__id", "__size": "__moved_size", "__number": "__moved_number"})
    texts = docs.drop("shard", "slot").withColumn("__size", byte_size()).withColumn("__number", number)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__size") == F.col("__moved_size")) & (F.col("__number") == F.col("__moved_number"))
    rows = texts.join(kept, same).select(*[c for c in texts.columns if not c.startswith("__")], "shard", "slot")
    rows.write.partitionBy("shard").mode("overwrite").parquet(fresh)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(base).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in (base, aside):
        fs.mkdirs(at(folder))
    for shard in (f"shard={n}" for n in affected):
        for source, target in ((base, aside), (fresh, base)):
            if fs.exists(at(f"{source}/{shard}")) and not fs.rename(at(f"{source}/{shard}"), at(f"{target}/{shard}")):
                raise OSError(f"{source}/{shard} could not be moved to {target}")
    for folder in (aside, fresh):
        delete_folder(spark, folder)
    return affected
