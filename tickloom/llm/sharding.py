"""Shards of near equal bytes by a k-d tree over metadata."""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tickloom.llm.common import stage

#: Bins of one histogram round; two rounds give the place of a median among BINS^2 bins.
BINS = 4096
#: Texts whose rows weigh more than this share of a shard get their shards first; there are at most shards / HEAVY of them.
HEAVY = 1 / 64
#: Rows that one task numbers.
RUN_ROWS = 100_000


@dataclass(frozen=True)
class Node:
    """Part of the tree that still becomes ``shards`` shards, the first of which is ``first``."""

    first: int
    shards: int


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", shards: int = 40) -> DataFrame:
    """Deal documents to ``shards`` shards of near equal bytes, cut along metadata.

    A document weighs its UTF-8 bytes (null text: none) plus 16. A point of the tree is a text: its
    rows weigh together and stay together; only a text that weighs more than a whole shard is dealt to several, in
    parts by a hash of the id. Texts and parts of more than HEAVY of a shard are placed first, the heaviest on the shard with
    most room, and the tree deals all others to the room that is left, leaf by leaf. Dimensions, each scaled to [0, 1): size (logarithm), source and language
    (hash; the smallest one of a text's copies). All parts of one depth are cut at once, along the dimension
    with the widest spread in that part, at the weighted quantile that gives each side the room of its shards (the median,
    where shards have equal room), until each part fills one shard. Order along a dimension is by
    value, then by hash of the text, so ties are cut too. Only sums for at most ``shards * BINS`` bins per round reach
    the driver, whatever the input.

    Result, one row per input row: ``doc_id``, ``size``, ``text_crc32``, ``law`` ('bytes'),
    ``shard``, ``slot`` (gapless from 0 in the shard), ``grown_shard`` (null). Null and empty texts
    differ in nothing here; nulls in other columns are values of their own; repeated rows share a
    shard; an empty table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("string")

    def place(name: str) -> Column:
        if name not in docs.columns:
            return F.lit(0).cast("long")
        return F.coalesce(F.pmod(F.xxhash64(F.col(f"`{name}`").cast("string")), F.lit(1 << 20)), F.lit(-1).cast("long"))

    body = F.coalesce(text, F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
        F.xxhash64(body).alias("h"),
        place(source_col).alias("source"),
        place(lang_col).alias("lang"),
    )
    rows, _ = stage(rows, "shard-rows")
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return _numbered(rows.withColumn("shard", F.lit(0)), id_col)
    whole = max(1.0, total / shards)

    # Points: a text's rows, or parts of them. Size and two hashes tell texts apart.
    per_text = rows.groupBy("size", "crc", "h").agg(F.sum("size").alias("w"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    per_text = per_text.withColumn("parts", F.when(F.col("w") > whole, F.ceil(F.col("w") / whole)).otherwise(1).cast("int"))
    per_text, _ = stage(per_text, "shard-texts")
    split = per_text.where("parts > 1").select("size", "crc", "h", F.col("parts").alias("deal"))  # at most one for each shard
    dealt = rows.join(F.broadcast(split), ["size", "crc", "h"], "left").withColumn("part", F.when(F.col("deal").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("deal"))).cast("int"))
    weights = dealt.groupBy("size", "crc", "h", "part").agg(F.sum("size").alias("w"))
    points = weights.join(per_text.select("size", "crc", "h", "source", "lang"), ["size", "crc", "h"])
    points, _ = stage(points, "shard-weights")
    heavy = points.where(F.col("w") > HEAVY * whole).select("w", "size", "crc", "h", "part").collect()  # at most shards / HEAVY
    homes, room = _place_heavy(heavy, shards, whole)
    points = points.where(F.col("w") <= HEAVY * whole)
    fine = F.pmod(F.xxhash64("h", "crc", "part"), F.lit(1 << 20))
    values = {"size": (F.log2(F.col("size")) * (1 << 16)).cast("long"), "source": F.col("source") + 1, "lang": F.col("lang") + 1}
    dims = list(values)
    points = points.select("size", "crc", "h", "part", "w", *[((v * (1 << 20)) + fine).cast("long").alias(f"d_{d}") for d, v in values.items()])
    points, _ = stage(points, "shard-points")

    open_nodes, cuts = [Node(0, shards)], []
    node = F.lit(0)  # first shard of a point's part, as an expression over all cuts so far
    span = None
    while True:
        todo = [n for n in open_nodes if n.shards > 1]
        if not todo:
            break
        here = points.withColumn("node", node).where(F.col("node").isin([n.first for n in todo]))
        edges = here.groupBy("node").agg(F.sum("w").alias("w"), *[f(f"d_{d}").alias(f"{k}_{d}") for d in dims for k, f in (("lo", F.min), ("hi", F.max))])
        stats = {r.node: r for r in edges.collect()}  # one row per part
        if not stats:
            break
        span = span or {d: max(1, stats[0][f"hi_{d}"] - stats[0][f"lo_{d}"]) for d in dims}
        plan = {}
        for n in todo:
            r = stats.get(n.first)
            if r is None:
                continue
            d = max(dims, key=lambda d: ((r[f"hi_{d}"] - r[f"lo_{d}"]) / span[d], d))
            first, middle, last = n.first, n.first + n.shards // 2, n.first + n.shards
            share = sum(room[first:middle]) / max(1.0, sum(room[first:last]))
            plan[n.first] = (d, r[f"lo_{d}"], r[f"hi_{d}"] + 1, r.w * share)
        # Two or more rounds: the histogram of a range, then of the bin in which the quantile lies.
        below = dict.fromkeys(plan, 0)
        while any(hi - lo > 1 for _, lo, hi, _ in plan.values()):
            wide = {k: v for k, v in plan.items() if v[2] - v[1] > 1}
            values_ = ", ".join(f"({k}, '{d}', {lo}L, {-(-(hi - lo) // BINS)}L, {hi}L)" for k, (d, lo, hi, _) in wide.items())
            table = spark.sql(f"SELECT * FROM VALUES {values_} AS t(node, d, lo, width, hi)")
            value = F.coalesce(*[F.when(F.col("d") == d, F.col(f"d_{d}")) for d in dims])
            binned = here.join(F.broadcast(table), "node").withColumn("v", value).where("v >= lo and v < hi")  # one row per part
            sums: dict[int, list] = {}
            for r in binned.groupBy("node", F.floor((F.col("v") - F.col("lo")) / F.col("width")).alias("bin")).agg(F.sum("w").alias("w")).collect():
                sums.setdefault(r.node, []).append((r.bin, r.w))
            for k, (d, lo, hi, want) in wide.items():
                step, have = -(-(hi - lo) // BINS), below[k]
                for b, w in sorted(sums.get(k, [])):
                    if have + w >= want or b == max(sums[k])[0]:
                        break
                    have += w
                below[k] = have
                plan[k] = (d, lo + b * step, min(hi, lo + (b + 1) * step), want)
                if step == 1:  # the cut falls before or after this one value, whichever is nearer
                    at = lo + b + (1 if abs(have + w - want) <= abs(have - want) else 0)
                    plan[k] = (d, at, at, want)
        new = []
        for n in open_nodes:
            if n.shards == 1 or n.first not in plan:
                new.append(n if n.shards == 1 else Node(n.first, 1))
                continue
            left = n.shards // 2
            cuts.append((n.first, n.first + left, plan[n.first][0], plan[n.first][1]))
            new += [Node(n.first, left), Node(n.first + left, n.shards - left)]
        open_nodes = new
        node = _walk(cuts)

    leaves = points.select("size", "crc", "h", "part", node.alias("shard"))
    columns = ["id", "size", "crc", "shard"]
    if not homes:
        return _numbered(dealt.join(leaves, ["size", "crc", "h", "part"]).select(*columns), id_col)
    # Rows of heavy points find their shards without a shuffle.
    cells = ", ".join(f"({r.size}L, {r.crc}L, {r.h}L, {r.part}, {k})" for r, k in homes)
    home = spark.sql(f"SELECT * FROM VALUES {cells} AS t(size, crc, h, part, home)")
    known = dealt.join(F.broadcast(home), ["size", "crc", "h", "part"], "left")
    light = known.where("home IS NULL").join(leaves, ["size", "crc", "h", "part"]).select(*columns)
    return _numbered(light.unionByName(known.where("home IS NOT NULL").select("id", "size", "crc", F.col("home").alias("shard"))), id_col)


def _place_heavy(heavy: list[Row], shards: int, whole: float) -> tuple[list[tuple[Row, int]], list[float]]:
    """Shards of the heavy points, each on the one with most room, the heaviest first; and the room left in each shard."""
    room = [(-whole, k) for k in range(shards)]
    heapify(room)
    homes = []
    for r in sorted(heavy, key=lambda r: (-r.w, r.size, r.crc, r.h, r.part)):
        left, k = heappop(room)
        homes.append((r, k))
        heappush(room, (left + r.w, k))
    free = dict((k, max(0.0, -left)) for left, k in room)
    return homes, [free[k] for k in range(shards)]


def _walk(cuts: list[tuple[int, int, str, int]]) -> Column:
    """First shard of the part that a point falls into."""

    def below(first: int, k: int) -> Column:
        # The cuts of one part follow each other in ``cuts``: part `first` is cut, then its halves.
        for i in range(k, len(cuts)):
            a, b, d, at = cuts[i]
            if a == first:
                return F.when(F.col(f"d_{d}") < at, below(a, i + 1)).otherwise(below(b, i + 1))
        return F.lit(first)

    return below(0, 0)


def _numbered(rows: DataFrame, id_col: str) -> DataFrame:
    """Slots by counting: each shard in runs by a hash of the id, the runs' sizes added up, then rows within a run."""
    spark = rows.sparkSession
    rows, _ = stage(rows.select("id", "size", "crc", "shard"), "shard-dealt")
    runs = max(1, -(-rows.count() // (RUN_ROWS * 4)))
    rows = rows.withColumn("run", F.pmod(F.xxhash64("id", "crc"), F.lit(runs)).cast("int"))
    rows.createOrReplaceTempView(view := f"shard_rows_{abs(hash(id(rows)))}")
    out = spark.sql(
        f"""
        WITH sizes AS (SELECT shard, run, count(*) AS n FROM {view} GROUP BY shard, run),
        starts AS (SELECT shard, run, sum(n) OVER (PARTITION BY shard ORDER BY run) - n AS start FROM sizes),
        placed AS (SELECT *, row_number() OVER (PARTITION BY shard, run ORDER BY id, crc) - 1 AS within FROM {view})
        SELECT id, size, crc, 'bytes' AS law, p.shard, s.start + within AS slot
        FROM placed p JOIN starts s ON p.shard = s.shard AND p.run = s.run"""
    )
    spark.catalog.dropTempView(view)
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "law", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
