"""Sharding by balanced label propagation (DataFrame functions only).

Documents with equal texts are linked. Copies of a text in one shard are alike, so the labels are kept as counts (text, shard, n):
in each round a joined table of each text's best shard tells the copies elsewhere to move there. Opposite moves between shards cancel, so
that only the net flow takes free rows of a quota; rounds go on until no move is left. Then unlinked documents fill the shards up to their exact quotas. Law `rows`: counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priceatlas.functions.running import running_start
from priceatlas.llm.common import buckets_for, materialize, number_rows

#: Rounds without a move, each with other ties, after which propagation ends.
IDLE = 3


def _wants(state: DataFrame, targets: list[int], quotas: list[int], turn: int) -> DataFrame:
    """g, s, t, n: copies in shard s whose text has its best target in t; ties fall by turn. A shard that a text fills alone is neither."""
    quota = F.element_at(F.array(*[F.lit(q) for q in quotas]), F.col("s") + 1)
    state = state.where(F.col("n") < quota)
    rank = F.struct("n", F.xxhash64("g", "s", F.lit(turn)).alias("h"))
    best = state.where(F.col("s").isin(targets)).groupBy("g").agg(F.max(F.struct(rank.alias("rank"), F.col("s").alias("t"))).alias("to"))
    return state.join(best, "g").where((F.col("to.t") != F.col("s")) & (F.col("to.rank") > rank)).select("g", "s", F.col("to.t").alias("t"), "n")


def flows(want: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """Rows to move by (s, t), at most want: opposite moves and longer cycles cancel, and only the net flow takes free rows."""
    left, free, flow = {}, list(free), {}
    for (s, t), n in want.items():
        both = min(n, want.get((t, s), 0))
        flow[s, t] = both
        if n > both:
            left.setdefault(s, {})[t] = n - both

    def push(path: list[int], most: int) -> None:
        steps = list(zip(path, path[1:], strict=False))
        n = min([most, *(left[s][t] for s, t in steps)])
        for s, t in steps:
            flow[s, t] += n
            left[s][t] -= n
            if not left[s][t]:
                del left[s][t]

    for start in list(left):
        path = [start]
        while left.get(start):
            at = path[-1]
            if at in path[:-1]:  # a cycle
                push(path[path.index(at) :], sum(want.values()))
                path = [start]
            elif len(path) > 1 and free[at] > 0:
                before = flow[start, path[1]]
                push(path, free[at])
                n = flow[start, path[1]] - before
                free[at] -= n
                free[start] += n
                path = [start]
            elif left.get(at):
                path.append(next(iter(left[at])))
            else:  # no row of the last shard can leave in this round
                del left[path[-2]][at]
                path = [start]
    return {k: n for k, n in flow.items() if n}


def _moves(want: DataFrame, flow: dict[tuple[int, int], int], buckets: int) -> DataFrame:
    """g, s, t, moved: of the wanted copies, as many of each pair of shards as its flow says."""
    want = want.withColumn("b", F.pmod(F.xxhash64("g"), F.lit(buckets)))
    starts = running_start(want.groupBy("s", "t", "b").agg(F.sum("n").alias("n")), ["s", "t"], "b", "n", "start").drop("n")
    inside = Window.partitionBy("s", "t", "b").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    most = want.sparkSession.createDataFrame([(s, t, n) for (s, t), n in flow.items()], "s int, t int, most long")
    rows = want.join(F.broadcast(most), ["s", "t"]).join(starts, ["s", "t", "b"])
    return rows.withColumn("moved", F.least(F.col("n"), F.col("most") - before)).where("moved > 0").select("g", "s", "t", "moved")


def propagate(copies: DataFrame, quotas: list[int], buckets: int) -> DataFrame:
    """copies (g, s, n) after label propagation; no shard takes more linked rows than its quota.

    Every move raises the sum of squared counts of a text, so the rounds end. Rounds of one kind go on while they move rows: texts aim
    at their best shard, or at their best one with free rows.
    """
    state = materialize(copies, "labels")
    turn = idle = kind = 0
    while idle < IDLE:
        load = {r.s: r.n for r in state.groupBy("s").agg(F.sum("n").alias("n")).collect()}  # one row per shard
        free = [max(0, q - load.get(s, 0)) for s, q in enumerate(quotas)]
        want = materialize(_wants(state, [s for s, f in enumerate(free) if f > 0 or not kind], quotas, turn), "wants")
        sums = {(r.s, r.t): r.n for r in want.groupBy("s", "t").agg(F.sum("n").alias("n")).collect()}  # at most one row per pair of shards
        if not sums and not kind:
            break
        flow = flows(sums, free)
        turn += 1
        if not flow:
            idle, kind = idle + 1, 1 - kind
            continue
        idle = 0
        moves = materialize(_moves(want, flow, buckets), "moves")
        out = moves.select("g", "s", (-F.col("moved")).alias("n"))
        into = moves.select("g", F.col("t").alias("s"), F.col("moved").alias("n"))
        state = materialize(state.unionByName(out).unionByName(into).groupBy("g", "s").agg(F.sum("n").alias("n")).where("n > 0"), "labels")
    return state


def balanced_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law ('rows'), shard, slot (gapless from 0 in its shard), linked: one row per row of docs.

    size: UTF-8 bytes of the text (null: none) plus 1. A null text is linked with nothing; empty texts are equal texts. A text with more
    copies than a shard holds fills shards one after the other. Repeated rows and null ids are rows like others; an empty table gives none.
    """
    text = F.col(text_col)
    v = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(text.isNotNull(), F.xxhash64(F.octet_length(text), text)).alias("g"),
    ).withColumn("rid", F.monotonically_increasing_id())
    v = materialize(v, "vertices")
    rows = v.count()
    buckets = buckets_for(rows)
    quotas = [rows // shards + (s < rows % shards) for s in range(shards)]
    whole = Window.partitionBy("g")
    copies = v.where("g is not null").groupBy("g", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    copies = copies.withColumn("all", F.sum("n").over(whole)).where("all > 1").drop("all")
    # Quotas are counted against linked rows; a start above a quota is possible only for a random deal of nearly all rows, and then moves on.
    state = propagate(_within(copies, quotas), quotas, buckets)

    upto = Window.partitionBy("g").orderBy("s")
    spans = state.withColumn("end", F.sum("n").over(upto)).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("end", "s"))).alias("spans"))
    salted = v.where("g is not null").withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(buckets)))
    parts = running_start(salted.groupBy("g", "salt").agg(F.count(F.lit(1)).alias("n")), ["g"], "salt", "n", "start").drop("n").join(spans, "g")
    nth = F.row_number().over(Window.partitionBy("g", "salt").orderBy("rid")) - 1 + F.col("start")
    linked = salted.join(parts, ["g", "salt"]).withColumn("nth", nth)
    linked = linked.withColumn("shard", F.element_at(F.filter("spans", lambda x: x.end > F.col("nth")), 1).s).select("rid", "id", "size", "text_crc32", "shard", F.lit(True).alias("linked"))
    load = {r.s: r.n for r in state.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    ends, end = [], 0
    for s, q in enumerate(quotas):
        end += q - load.get(s, 0)
        ends.append(end)
    alone = v.join(state.select("g").distinct(), "g", "left_anti")
    alone = number_rows(alone, [], "rid", buckets, "nth") if shards > 1 else alone.withColumn("nth", F.lit(0))
    fill = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("nth")))
    alone = alone.select("rid", "id", "size", "text_crc32", F.least(fill, F.lit(shards - 1)).alias("shard"), F.lit(False).alias("linked"))
    placed = materialize(linked.unionByName(alone), "placed")
    return number_rows(placed, ["shard"], "rid", buckets, "slot").select("id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), "linked")


def _within(copies: DataFrame, quotas: list[int]) -> DataFrame:
    """The random first deal, corrected to keep every shard's linked rows within its quota: what is over goes, text by text, to shards with room."""
    load = {r.s: r.n for r in copies.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    over = [max(0, load.get(s, 0) - q) for s, q in enumerate(quotas)]
    if not any(over):
        return copies
    room, spare = [], 0
    for s, q in enumerate(quotas):
        spare += max(0, q - load.get(s, 0))
        room.append(spare)
    taken, base = [], 0
    for o in over:
        taken.append(base)
        base += o
    buckets = 64
    rows = copies.withColumn("b", F.pmod(F.xxhash64("g"), F.lit(buckets)))
    starts = running_start(rows.groupBy("s", "b").agg(F.sum("n").alias("n")), ["s"], "b", "n", "start").drop("n")
    inside = Window.partitionBy("s", "b").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("s") + 1)
    rows = rows.join(starts, ["s", "b"]).withColumn("from", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    rows = rows.withColumn("out", F.greatest(F.lit(0), F.least(F.col("n"), pick(over) - F.col("from"))))
    stay = rows.select("g", "s", (F.col("n") - F.col("out")).alias("n")).where("n > 0")
    lo, hi = pick(taken) + F.col("from"), pick(taken) + F.col("from") + F.col("out")
    shelves = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(room[s - 1] if s else 0).alias("a"), F.lit(room[s]).alias("z")) for s in range(len(quotas))])
    moved = rows.where("out > 0").select("g", lo.alias("lo"), hi.alias("hi")).withColumn("to", F.explode(shelves))
    moved = moved.select("g", F.col("to.s").alias("s"), (F.least("hi", "to.z") - F.greatest("lo", "to.a")).alias("n")).where("n > 0")
    return stay.unionByName(moved).groupBy("g", "s").agg(F.sum("n").alias("n"))
