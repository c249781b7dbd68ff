"""Iterative graph work as rounds of joins and aggregations over written tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ridgewater.operators.scale import global_positions, hot_keys, spread, spread_join
from ridgewater.session import drop_staged, stage, without_inferred_filters

# Origins that share a row of costs, and improved labels from which on a merge is worth new bounds of the steps.
SLOTS = 16
SMALL_ROUND = 100_000


def _observed_stage(df: DataFrame, changed: Column, label: str) -> tuple[DataFrame, int]:
    """Write a table and count its changed rows in the same pass."""
    seen = Observation()
    out = stage(df.observe(seen, F.coalesce(F.sum(changed.cast("long")), F.lit(0)).alias("n")), label)
    return out, seen.get["n"]


def _split_hubs(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges with a split number for start nodes that hold a large share of all edges.

    The edges are laid out by start node once and kept on the executors, so no round shuffles them again; a
    lost partition is rebuilt from the written table.
    """
    edges = stage(edges, "edges")
    hubs = hot_keys(edges, ["src"])
    salt = F.lit(0)
    if hubs is not None:
        hubs = stage(hubs, "hubs")
        edges = edges.join(F.broadcast(hubs), "src", "left")
        salt = F.pmod(F.hash("dst"), F.coalesce(F.col("_splits"), F.lit(1)))
    salted = edges.withColumn("_salt", salt).drop("_splits")
    return spread(salted, "src", "_salt").persist(StorageLevel.MEMORY_AND_DISK), hubs


def _repeat_hubs(frontier: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """Frontier rows once per split of their node's edges."""
    if hubs is None:
        return spread(frontier.withColumn("_salt", F.lit(0)), "node", "_salt")
    split = F.coalesce(F.col("_splits"), F.lit(1))
    known = F.broadcast(hubs.withColumnRenamed("src", "node"))
    repeated = frontier.join(known, "node", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), split - 1)))
    return spread(repeated.drop("_splits"), "node", "_salt")


class _Known:
    """Best values so far: a base table and what later rounds improved, each laid out by key once.

    A round writes its improved rows only. After ``LEVELS`` rounds, or when the improvements outgrow half the base, all
    are merged into a new base, so the bytes written follow the frontier and a key is rewritten a few times at most.
    """

    LEVELS = 4

    def __init__(self, key: list[str], value: list[str]):
        self.key, self.value = key, value
        self.held: list[tuple[DataFrame, DataFrame, int]] = []
        self.late: list[DataFrame] = []
        self.merges = 0
        self.wanted: int | None = None  # merge as soon as this many labels may be known

    def add(self, written: DataFrame, rows: int) -> None:
        self.held.append((written, spread(written, *self.key).persist(StorageLevel.MEMORY_AND_DISK), rows))
        full = self.wanted is not None and len(self.held) > 1 and sum(n for _, _, n in self.held) >= self.wanted
        if full or len(self.held) > self.LEVELS or 2 * sum(n for _, _, n in self.held[1:]) > self.held[0][2] > 1_000_000:
            merged, n = _observed_stage(self._least(), self._labels(), "known")
            self.merges += 1
            self.drop(but=written)  # the next round still reads it
            self.held = [(merged, spread(merged, *self.key).persist(StorageLevel.MEMORY_AND_DISK), n)]

    def _labels(self) -> Column:
        return F.lit(1)

    def _least(self) -> DataFrame:
        every = self.held[0][0]
        for written, _, _ in self.held[1:]:
            every = every.unionByName(written)
        return _least_per_key(every, self.key, self.value)

    def better(self, found: DataFrame) -> DataFrame:
        """The rows of ``found`` that beat every known value of their key."""
        for _, table, _ in self.held:
            k, f = table.alias("k"), found.alias("f")
            same = [F.col(f"k.{c}") == F.col(f"f.{c}") for c in self.key]
            held = F.struct(*[F.col(f"k.{c}") for c in self.value]) <= F.struct(*[F.col(f"f.{c}") for c in self.value])
            found = f.join(k, [*same, held], "left_anti")
        return found

    def drop(self, but: DataFrame | None = None) -> None:
        for written, table, _ in self.held:
            table.unpersist()
            if written is not but:
                drop_staged(written)
        for written in self.late:
            drop_staged(written)
        self.late = [but] if but is not None else []

    def result(self, label: str) -> DataFrame:
        out = stage(self._least(), label)
        self.drop()
        return out


class _KnownCosts(_Known):
    """``_Known`` for rows of costs, one column an origin: each column has a least value of its own."""

    def _labels(self) -> Column:
        return _count_costs(self.value)

    def _least(self) -> DataFrame:
        every = self.held[0][0]
        for written, _, _ in self.held[1:]:
            every = every.unionByName(written)
        return _least_costs(every, self.key, self.value)

    def better(self, found: DataFrame) -> DataFrame:
        for _, table, _ in self.held:
            k, f = table.alias("k"), found.alias("f")
            same = [F.col(f"k.{c}") == F.col(f"f.{c}") for c in self.key]
            less = [f"CASE WHEN k.{c} IS NULL OR f.{c} < k.{c} THEN f.{c} END AS {c}" for c in self.value]
            found = f.join(k.hint("shuffle_hash"), same, "left").selectExpr(*[f"f.{c}" for c in self.key], *less)
        return found.filter(_any_cost(self.value))


def _least_costs(rows: DataFrame, key: list[str], costs: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(*[F.min(c).alias(c) for c in costs])


def _count_costs(costs: list[str]) -> Column:
    return F.expr(" + ".join(f"int({c} IS NOT NULL)" for c in costs))


def _any_cost(costs: list[str]) -> str:
    return f"coalesce({', '.join(costs)}) IS NOT NULL"


def _least_per_key(rows: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    if len(value) == 1:  # a plain numeric buffer, so Spark hashes instead of sorting
        return rows.groupBy(*key).agg(F.min(value[0]).alias(value[0]))
    best = rows.groupBy(*key).agg(F.min(F.struct(*value)).alias("_b"))
    return best.select(*key, *[F.col(f"_b.{c}").alias(c) for c in value])


def _search(
    starts: DataFrame,
    edges: DataFrame,
    hubs: DataFrame | None,
    key: list[str],
    value: list[str],
    max_cost: float | None = None,
    label: str = "paths",
) -> DataFrame:
    """Least values per key over all steps from ``starts``; value is the cost and then what breaks its ties."""
    known = _Known(key, value)
    frontier, rows = _observed_stage(_least_per_key(starts, key, value), F.lit(1), label)
    while rows:
        known.add(frontier, rows)
        f, e = _repeat_hubs(frontier, hubs).alias("f"), edges.alias("e")
        moved = f.join(e, (F.col("f.node") == F.col("e.src")) & (F.col("f._salt") == F.col("e._salt")))
        total = F.col("f.cost") + F.col("e.cost")
        if max_cost is not None:
            moved = moved.filter(total <= max_cost)
        others = [F.col(f"f.{c}").alias(c) for c in [*key, *value[1:]] if c != "node"]
        moved = moved.select(*others, F.col("e.dst").alias("node"), total.alias("cost")).select(*key, *value)
        frontier, rows = _observed_stage(known.better(_least_per_key(moved, key, value)), F.lit(1), label)
    if not known.held:
        return frontier
    return known.result(label)


class _Slots:
    """Numbers origins, so that a row of costs serves up to SLOTS of them: block, node and one column for each slot."""

    KEY = ["block", "node"]

    def __init__(self, origins: DataFrame):
        placed = stage(global_positions(origins.select("origin").distinct(), [F.col("origin")], "_at"), "origins")
        self.n = placed.count()
        blocks = max(1, -(-self.n // SLOTS))
        self.width = max(1, -(-self.n // blocks))
        self.table = placed.select("origin", F.col("_at").cast("long").alias("_at"))
        self.costs = [f"d{i}" for i in range(self.width)]

    def wide(self, rows: DataFrame) -> DataFrame:
        """origin, node, cost to rows of costs; the least of a key counts."""
        numbered = rows.join(self.table, "origin").withColumn("_slot", F.col("_at") % self.width)
        each = [F.when(F.col("_slot") == i, F.col("cost")).alias(c) for i, c in enumerate(self.costs)]
        return _least_costs(numbered.select(F.expr(f"_at div {self.width}").alias("block"), "node", *each), self.KEY, self.costs)

    def long(self, rows: DataFrame) -> DataFrame:
        """Rows of costs to _at, node, cost."""
        pairs = ", ".join(f"{i}L, {c}" for i, c in enumerate(self.costs))
        each = rows.select("block", "node", F.expr(f"stack({self.width}, {pairs}) AS (_slot, cost)"))
        return each.filter("cost IS NOT NULL").select((F.col("block") * self.width + F.col("_slot")).alias("_at"), "node", "cost")

    def named(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.table, "_at").drop("_at")


def _search_costs(
    slots: _Slots,
    starts: DataFrame,
    edges: DataFrame,
    hubs: DataFrame | None,
    max_cost: float | None = None,
    closed: DataFrame | None = None,
) -> DataFrame:
    """Least cost of every origin and node as rows of costs, written.

    A round extends every label that the round before improved. Rounds so follow the steps of the longest cheapest path, however
    far apart costs lie; rounds in the order of costs would follow each range of costs by itself. Once every node that a step
    leads to is known from every origin, steps to more than any origin's cost of the node they lead to are left out before
    anything is moved.
    """
    key, costs = slots.KEY, slots.costs
    known = _KnownCosts(key, costs)
    first = slots.wide(starts)
    marks = starts.select("origin", "node")
    if closed is not None:
        # Below any cost, so that no step improves it; it is never open.
        known.add(*_observed_stage(slots.wide(closed.select("origin", "node", F.lit(-1.0).alias("cost"))), _count_costs(costs), "closed"))
        first, marks = known.better(first), marks.union(closed.select("origin", "node")).distinct()
    ends = edges.select(F.col("dst").alias("node")).distinct()
    plain = edges.select("src", "dst", "cost", "_salt")
    every_label = ends.count() * slots.n + marks.join(ends, "node", "left_anti").count() if max_cost is None else None
    known.wanted, bounded = every_label, None
    frontier, fresh = _observed_stage(first, _count_costs(costs), "paths")
    while fresh:
        merges = known.merges
        known.add(frontier, fresh)
        if known.merges > merges:
            whole = known.held[0][2] == every_label
            known.wanted = every_label if bounded is None and not whole else None
            if whole and (bounded is None or fresh > SMALL_ROUND):
                last, bounded = bounded, _bounded(plain, known.held[0][0], costs).persist(StorageLevel.MEMORY_AND_DISK)
                if last is not None:
                    last.unpersist()
        near = plain if bounded is None else bounded
        f, e = _repeat_hubs(frontier, hubs).hint("shuffle_hash").alias("f"), near.alias("e")  # sorting all edges would cost more
        moved = f.join(e, (F.col("f.node") == F.col("e.src")) & (F.col("f._salt") == F.col("e._salt")))
        most = F.lit(max_cost).cast("double") if bounded is None else F.col("e._most")
        moved = moved.select("f.block", F.col("e.dst").alias("node"), most.alias("_most"), *[F.expr(f"f.{c} + e.cost AS {c}") for c in costs])
        if bounded is not None or max_cost is not None:
            moved = _costs_where(moved, key, costs, "<= _most")
        frontier, fresh = _observed_stage(known.better(_least_costs(moved, key, costs)), _count_costs(costs), "paths")
    if bounded is not None:
        bounded.unpersist()
    return known.result("paths") if known.held else frontier


def _bounded(edges: DataFrame, wide: DataFrame, costs: list[str]) -> DataFrame:
    """Edges laid out by start node with ``_most``, the highest cost by which an origin knows the node they lead to.

    No step to more than that is on a cheapest path. Edges to nodes that no origin knows are left out.
    """
    most = wide.groupBy(F.col("node").alias("_to")).agg(F.max(F.greatest(*costs, F.lit(None).cast("double"))).alias("_most"))
    return spread(edges.join(most, edges.dst == F.col("_to")).drop("_to"), "src", "_salt")


def _costs_where(rows: DataFrame, key: list[str], costs: list[str], test: str) -> DataFrame:
    """Rows of costs with those that fit only; ``test`` is what follows a cost, such as "<= 5"."""
    out = rows.selectExpr(*key, *[f"CASE WHEN {c} {test} THEN {c} END AS {c}" for c in costs])
    return out.filter(_any_cost(costs))


def contract(edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(long steps, inner places): chains of nodes with two neighbours each become one step.

    ``edges``: src, dst, cost and sums; ``keep``: nodes that stay whatever their neighbours. Long steps join nodes that
    stay: src, dst, cost, sums over the chain and via, the chain's last node before dst. Inner places have the same columns
    for the nodes inside, from the chain's head src to the node dst. Of parallel edges the cheapest counts. Chains are
    followed by doubling, so one of h nodes takes log2(h) rounds; rings without a node that stays are left out, as nothing
    reaches them.
    """
    sums = [c for c in edges.columns if c not in ("src", "dst", "cost")]
    arcs = stage(_least_per_key(edges.filter("src <> dst"), ["src", "dst"], ["cost", *sums]), "arcs")
    ends = arcs.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(arcs.select("dst", "src")).distinct()
    inner = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("node")
    inner = stage(inner.join(keep.select("node"), "node", "left_anti"), "inner")
    from_inner = arcs.join(inner, arcs.src == inner.node, "left_semi").select(F.col("src").alias("at"), F.col("dst").alias("to"))
    into = arcs.select(F.col("src").alias("up_src"), F.col("dst").alias("at"))
    before = from_inner.join(into, "at").filter("up_src <> to").select(F.col("at").alias("src"), F.col("to").alias("dst"), "up_src")
    table = arcs.join(before, ["src", "dst"], "left").select(
        "src", "dst", "cost", *sums, F.col("src").alias("head"), "up_src", F.when(F.col("up_src").isNotNull(), F.col("src")).alias("up_dst")
    )
    table, left = _observed_stage(table, F.col("up_src").isNotNull(), "chains")
    for _ in range(left.bit_length() + 1):
        if not left:
            break
        above = table.select(
            F.col("src").alias("up_src"), F.col("dst").alias("up_dst"), F.col("head").alias("_head"), F.col("up_src").alias("_up_src"),
            F.col("up_dst").alias("_up_dst"), *[F.col(c).alias(f"_{c}_up") for c in ("cost", *sums)],
        )
        grown = table.join(above, ["up_src", "up_dst"], "left").select(
            "src", "dst", *[(F.col(c) + F.coalesce(f"_{c}_up", F.lit(0.0))).alias(c) for c in ("cost", *sums)],
            F.coalesce("_head", "head").alias("head"), F.col("_up_src").alias("up_src"), F.col("_up_dst").alias("up_dst"),
        )
        old = table
        table, left = _observed_stage(grown, F.col("up_src").isNotNull(), "chains")
        drop_staged(old)
    whole = table.filter("up_src IS NULL").join(inner.withColumnRenamed("node", "head"), "head", "left_anti")
    whole = whole.select(F.col("head").alias("src"), "dst", "cost", *sums, F.col("src").alias("via"))
    nodes = inner.withColumnRenamed("node", "dst")
    return whole.join(nodes, "dst", "left_anti").filter("src <> dst"), whole.join(nodes, "dst", "left_semi")


def shortest_paths(
    edges: DataFrame,
    origins: DataFrame,
    carry: dict[str, Column] | None = None,
    max_cost: float | None = None,
    closed: DataFrame | None = None,
    chains: bool = False,
) -> DataFrame:
    """Cheapest cost from every origin to every node it reaches, all origins at once.

    ``edges``: src, dst, cost (positive) and whatever ``carry`` mentions. ``origins``: origin, node (several
    nodes may share an origin, which then means "nearest of them") and optionally a starting cost. Columns:
    origin, node, cost, and, when ``carry`` is given, prev and the carried sums along the chosen path. Origins
    are searched SLOTS to a row, so a step is read, moved and compared once for all of them. Each
    round extends what the last one improved and writes improved rows only; candidates are
    reduced map-side before they are compared. With ``chains`` the search steps over chains of nodes with two
    neighbours at once and fills in their inner nodes at the end: rounds follow the junctions of a road network,
    not its nodes; costs are then summed chain by chain. ``closed`` (origin, node) are nodes that an origin's
    paths may not enter.
    """
    with without_inferred_filters(edges.sparkSession):
        return _shortest_paths(edges, origins, carry, max_cost, closed, chains)


def _shortest_paths(
    edges: DataFrame,
    origins: DataFrame,
    carry: dict[str, Column] | None,
    max_cost: float | None,
    closed: DataFrame | None,
    chains: bool,
) -> DataFrame:
    carry = carry or {}
    if closed is not None and (carry or chains):
        raise ValueError("sums along paths and chains are not supported with closed nodes")
    sums = [f"_e_{n}" for n in carry]
    steps = edges.select("src", "dst", F.col("cost").cast("double").alias("cost"), *[c.cast("double").alias(f"_e_{n}") for n, c in carry.items()])
    first = F.col("cost").cast("double") if "cost" in origins.columns else F.lit(0.0)
    starts = stage(origins.select("origin", "node", first.alias("cost")).groupBy("origin", "node").agg(F.min("cost").alias("cost")), "starts")
    inner = None
    if chains:
        steps, inner = contract(steps, starts.select("node").distinct())
    elif carry:
        steps = steps.withColumn("via", F.col("src"))
    prepared, hubs = _split_hubs(steps)
    slots = _Slots(starts if closed is None else starts.select("origin").union(closed.select("origin")))
    wide = _search_costs(slots, starts, prepared, hubs, max_cost, closed)
    if carry:
        found = _add_path_sums(wide, slots, starts, prepared, hubs, sums)
    else:
        found = slots.named(slots.long(wide))
        found = found if closed is None else found.filter("cost >= 0")
    prepared.unpersist()
    drop_staged(prepared)  # found reads what was written after it
    if inner is not None:
        found = _with_inner(found, inner, sums, bool(carry), max_cost)
    return found.select("origin", "node", "cost", *(["prev", *[F.col(f"_e_{n}").alias(n) for n in carry]] if carry else []))


def _with_inner(found: DataFrame, inner: DataFrame, sums: list[str], carried: bool, max_cost: float | None) -> DataFrame:
    """Adds the nodes inside chains, each from the cheaper end."""
    placed, hubs = _split_hubs(inner)
    f, e = _repeat_hubs(found, hubs).alias("f"), placed.alias("e")
    reached = f.join(e, (F.col("f.node") == F.col("e.src")) & (F.col("f._salt") == F.col("e._salt")))
    more = [F.col("e.via").alias("prev"), *[(F.col(f"f.{c}") + F.col(f"e.{c}")).alias(c) for c in sums]] if carried else []
    reached = reached.select(F.col("f.origin").alias("origin"), F.col("e.dst").alias("node"), (F.col("f.cost") + F.col("e.cost")).alias("cost"), *more)
    if max_cost is not None:
        reached = reached.filter(F.col("cost") <= max_cost)
    inside = _least_per_key(reached, ["origin", "node"], ["cost", *(["prev", *sums] if carried else [])])
    out = stage(found.unionByName(inside), "paths")
    placed.unpersist()
    return out


def _add_path_sums(wide: DataFrame, slots: _Slots, starts: DataFrame, edges: DataFrame, hubs: DataFrame | None, sums: list[str]) -> DataFrame:
    """Adds prev (lowest ``via`` of a cheapest last step) and the sums of ``sums`` from origin to node.

    A step is on a cheapest path when its start's cost plus its own is exactly the end's cost; this is seen on rows of
    costs, and only such steps are listed by origin. Sums are completed by doubling: what a row lacks is its ancestor's sum,
    1, 2, 4, 8 .. steps up.
    """
    costs = slots.costs
    f, e = _repeat_hubs(wide, hubs).hint("shuffle_hash").alias("f"), _bounded(edges, wide, costs).alias("e")
    steps = f.join(e, (F.col("f.node") == F.col("e.src")) & (F.col("f._salt") == F.col("e._salt"))).select(
        "f.block", F.col("e.dst").alias("node"), F.col("e.via").alias("via"), F.col("f.node").alias("up"), "e._most", *[F.col(f"e.{c}").alias(c) for c in sums],
        *[(F.col(f"f.{c}") + F.col("e.cost")).alias(c) for c in costs],
    )
    others = ["block", "node", "via", "up", *sums]
    steps = _costs_where(steps, others, costs, "<= _most")
    ends = wide.select("block", "node", *[F.col(c).alias(f"_to_{c}") for c in costs])
    hit = [F.when(F.col(c) == F.col(f"_to_{c}"), F.struct(F.lit(i).cast("long").alias("slot"), F.col(c).alias("cost"))) for i, c in enumerate(costs)]
    tight = steps.join(ends, ["block", "node"]).filter(F.coalesce(*[F.when(F.col(c) == F.col(f"_to_{c}"), True) for c in costs]))
    tight = tight.select(*others, F.explode(F.array_compact(F.array(*hit))).alias("_h")).select(
        (F.col("block") * slots.width + F.col("_h.slot")).alias("_at"), "node", "_h.cost", F.lit(1).alias("_own"), "via", "up", *sums
    )
    found = slots.long(wide)
    roots = slots.table.join(starts, "origin").select("_at", "node", "cost").join(found, ["_at", "node", "cost"], "left_semi")
    nothing = F.lit(None).cast(dict(edges.dtypes)["src"])
    roots = roots.select("_at", "node", "cost", F.lit(0).alias("_own"), nothing.alias("via"), nothing.alias("up"), *[F.lit(0.0).alias(c) for c in sums])
    best = tight.unionByName(roots).groupBy("_at", "node").agg(F.min("cost").alias("cost"), F.min(F.struct("_own", "via", "up", *sums)).alias("b"))
    rows = best.select("_at", "node", "cost", F.col("b.via").alias("prev"), F.col("b.up").alias("_up"), *[F.col(f"b.{c}").alias(c) for c in sums])
    table = stage(rows, "sums")
    drop_staged(wide)
    while True:
        above = table.select("_at", F.col("node").alias("_up"), F.col("_up").alias("_next"), *[F.col(c).alias(f"_up{c}") for c in sums])
        grown = table.join(above, ["_at", "_up"], "left").select(
            "_at", "node", "cost", "prev", F.col("_next").alias("_up"),
            *[(F.col(c) + F.coalesce(f"_up{c}", F.lit(0.0))).alias(c) for c in sums],
        )
        before = table
        table, left = _observed_stage(grown, F.col("_up").isNotNull(), "sums")
        drop_staged(before)
        if left == 0:
            return slots.named(table.drop("_up"))


def nearest_source(edges: DataFrame, sources: DataFrame, max_cost: float | None = None) -> DataFrame:
    """For every node the source it reaches most cheaply: node, source, cost. ``sources``: source, node.

    One search from all sources along reversed edges; a node keeps its best label only, so the table
    never exceeds the number of nodes. Equal costs go to the lower source.
    """
    reverse, hubs = _split_hubs(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("cost").cast("double").alias("cost")))
    starts = sources.select("node", F.lit(0.0).alias("cost"), "source")
    out = _search(starts, reverse, hubs, ["node"], ["cost", "source"], max_cost, label="labels")
    reverse.unpersist()
    return out.select("node", "source", "cost")


def unroll(paths: DataFrame, ends: DataFrame) -> DataFrame:
    """Node sequence of chosen paths: origin, end, position, node (position counts back from the end).

    ``paths`` is a carried result of shortest_paths; ``ends``: origin, node. Ancestors are found by
    doubling, so a path of h hops takes log2(h) rounds of joins.
    """
    step = paths.filter("prev IS NOT NULL").select("origin", F.col("node").alias("a"), F.col("prev").alias("b"))
    out = stage(ends.select("origin", F.col("node").alias("end"), "node", F.lit(0).cast("long").alias("position")), "unroll")
    jump, width = stage(step, "jump"), 1
    while True:
        further = (
            out.join(jump, (out.origin == jump.origin) & (out.node == jump.a))
            .select(out.origin, "end", jump.b.alias("node"), (out.position + width).alias("position"))
        )
        grown, added = _observed_stage(
            out.withColumn("_new", F.lit(0)).unionByName(further.withColumn("_new", F.lit(1))), F.col("_new"), "unroll"
        )
        out = grown.drop("_new")
        if added == 0:
            return out
        left, right = jump.alias("l"), jump.alias("r")
        jump = stage(
            left.join(right, (F.col("l.origin") == F.col("r.origin")) & (F.col("l.b") == F.col("r.a"))).select(
                F.col("l.origin").alias("origin"), F.col("l.a").alias("a"), F.col("r.b").alias("b")
            ),
            "jump",
        )
        width *= 2


def components(links: DataFrame) -> DataFrame:
    """Connected components of undirected ``links`` (a, b): node, component (its smallest node).

    Alternates two contractions: every node points its larger neighbours, then its smaller ones, at the
    smallest node around it. The number of rounds grows with the logarithm of a component's size. A node
    that becomes the centre of a large component is split by ``spread_join``.
    """
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    pairs = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while True:
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            spread_join(both, low, ["u"], "v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct()
        )
        large = stage(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = spread_join(large, low, ["u"], "v")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        pairs = stage(small.filter("u <> v").distinct(), "links")
        # Contractions change nothing any more when every node points at one centre that points nowhere itself.
        ends = pairs.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(pairs.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty():
            break
    root = pairs.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(root, nodes.node == root.u, "left").select("node", F.coalesce("component", "node").alias("component"))
