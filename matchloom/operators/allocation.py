"""Capacity-constrained allocation by min-cost flow, and how fair it is."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.components import components
from matchloom.session import Scratch

#: Offers that hang together at most: one task solves them.
MOST_OFFERS = 2_000_000
#: Offers up to which one task solves all (some 400 MB).
DIRECT = 500_000
#: Tasks that components times capacities are dealt to.
GROUPS = 211
#: What it costs to go beyond a person's capacity (extra places, cost of each), and to leave a module out.
TIERS = ((2, 5_000), (15, 25_000))
LEFT_OUT, SCALE, RANK_COST = 200_000, 10_000, 5


def cost(score: float, rank: int) -> int:
    return SCALE - int(round(score * SCALE)) + RANK_COST * rank


def solve(edges: list[tuple[int, int, int]], capacity: dict[int, int], tiers=TIERS, left_out: int | dict[int, int] = LEFT_OUT) -> dict[int, int]:
    """module -> person of a cheapest assignment; modules that are left out are missing.

    edges: (module, person, cost). left_out: what it costs to leave a module out, or that of each module. Everybody starts with the
    price of the tier that suits most loads, and modules choose by cost and price. Then each person with more modules than places taken,
    or fewer, is evened out by shortest paths of modules between people, under prices that stay exact: a path a place that is off, not a path a module.
    A person's places cost more tier by tier, so their convex cost is an order, not a network. Modules and
    persons are taken in ascending order, which settles ties.
    """
    price: dict[int, dict[int, int]] = {}
    for m, p, c in sorted(edges):
        price.setdefault(m, {})[p] = c
    modules, people = list(price), sorted({p for _, p, _ in edges})
    node = {p: i for i, p in enumerate(people)}
    offers = [[(node[p], c) for p, c in price[m].items()] for m in modules]
    costs = [dict(o) for o in offers]
    outs = [left_out[m] for m in modules] if isinstance(left_out, dict) else [left_out] * len(modules)
    places = [[0] * capacity.get(p, 0) + [c for n, c in tiers for _ in range(n)] for p in people]
    asked: list[list[tuple[int, int]]] = [[] for _ in people]
    liked, loads = [], [0] * len(people)
    for m, o in enumerate(offers):
        for p, c in o:
            asked[p].append((m, c))
        c, p = min((c, p) for p, c in o)
        liked.append((p, c))
        loads[p] += 1
    # places cheaper than a person's price are taken, dearer ones are not
    off = lambda x: sum(max(bisect_left(all_, x) - n, n - bisect_right(all_, x), 0) for all_, n in zip(places, loads))
    tier = min((0, *[c for _, c in tiers]), key=off)
    prices = [tier] * len(people)
    chosen = [p if c + tier <= out else -1 for (p, c), out in zip(liked, outs)]
    held: list[dict[int, None]] = [{} for _ in people]
    for m, p in enumerate(chosen):
        if p >= 0:
            held[p][m] = None
    used = [min(max(len(h), bisect_left(all_, tier)), bisect_right(all_, tier)) for h, all_ in zip(held, places)]
    push, pop = heapq.heappush, heapq.heappop

    def even(start: int, up: bool) -> None:
        """Takes one module from who has too many, or gives one to who has too few; or a place more or less is taken, where that is cheaper."""
        dist, back, done, heap, nearest, end, free = {start: 0}, {}, {}, [(0, start)], math.inf, start, None
        while heap:
            d, v = pop(heap)
            if d >= nearest:
                break
            if v in done:
                continue
            done[v] = d
            mine, taken = held[v], used[v]
            if v != start and (len(mine) < taken if up else len(mine) > taken):
                nearest, end, free = d, v, None
                break
            at = d - prices[v] if up else d + prices[v]
            if up:
                if taken < len(places[v]) and at + places[v][taken] < nearest:
                    nearest, end, free = at + places[v][taken], v, -1
                for m in mine:
                    less = at - costs[m][v]
                    if less + outs[m] < nearest:
                        nearest, end, free = less + outs[m], v, m
                    for w, c in offers[m]:
                        step = less + c + prices[w]
                        # what isn't nearer than the end is on no shortest path
                        if w != v and step < nearest and step < dist.get(w, math.inf):
                            dist[w], back[w] = step, (v, m)
                            push(heap, (step, w))
            else:
                if taken and at - places[v][taken - 1] < nearest:
                    nearest, end, free = at - places[v][taken - 1], v, -1
                for m, c in asked[v]:
                    w = chosen[m]
                    if w < 0:
                        if at + c - outs[m] < nearest:
                            nearest, end, free = at + c - outs[m], v, m
                    elif w != v:
                        step = at + c - costs[m][w] - prices[w]
                        if step < nearest and step < dist.get(w, math.inf):
                            dist[w], back[w] = step, (v, m)
                            push(heap, (step, w))
        for v, d in done.items():
            prices[v] += nearest - d if up else d - nearest
        if free == -1:  # a place is taken or given up
            used[end] += 1 if up else -1
        elif free is not None:  # a module is left out, or no longer
            chosen[free] = -1 if up else end
            if up:
                del held[end][free]
            else:
                held[end][free] = None
        v = end
        while v != start:
            u, m = back[v]
            giver, taker = (u, v) if up else (v, u)
            del held[giver][m]
            held[taker][m] = None
            chosen[m] = taker
            v = u

    for p in range(len(people)):
        while len(held[p]) != used[p]:
            even(p, len(held[p]) > used[p])
    return {modules[i]: people[c] for i, c in enumerate(chosen) if c >= 0}


def objective(assigned: dict[int, int], edges, capacity, tiers=TIERS, left_out: int = LEFT_OUT) -> int:
    price = {(m, p): c for m, p, c in edges}
    load: dict[int, int] = {}
    total = 0
    for m in {e[0] for e in edges}:
        if m in assigned:
            p = assigned[m]
            total += price[m, p]
            load[p] = load.get(p, 0) + 1
        else:
            total += left_out
    for p, n in load.items():
        prices = [0] * capacity.get(p, 0) + [c for k, c in tiers for _ in range(k)]
        total += sum(prices[:n])
    return total


def parts(offers: DataFrame, apart: Sequence[int] = ()) -> DataFrame:
    """offers with `part`: the connected component of modules and people that an offer is in. apart: capacities whose offers don't hang together."""
    scratch = Scratch(offers.sparkSession)
    keys = ["capacity", "module_id"] if apart else ["module_id"]
    place = F.array_position(F.array(*[F.lit(c) for c in apart]), F.col("capacity")) - 1 if apart else F.lit(0)
    # one range of ids for both, and for each capacity
    m, p = ((F.col(c) * 2 + side) * max(1, len(apart)) + place for side, c in enumerate(("module_id", "staff_id")))
    named = components(offers.select(m.cast("long").alias("a"), p.cast("long").alias("b")), scratch)
    found = offers.withColumn("node", m.cast("long")).join(named.withColumnRenamed("root", "__root"), "node", "left") if apart else offers.join(named.select((F.col("node") / 2).cast("long").alias("module_id"), F.col("root").alias("__root")).where("node % 2 = 0"), "module_id", "left")
    return found.withColumn("part", F.coalesce("__root", m.cast("long"))).drop("__root", "node")


def _solved(priced: DataFrame, tiers, most: int, swept: list[str], apart: Sequence[int] = (), whole: bool = False) -> DataFrame:
    """module_id, staff_id (and `swept`) of the modules that get somebody: each component of offers (module_id, staff_id, price, capacity, out) is solved in one task, or all of them are (whole)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        edges = [(int(m), int(s), int(c)) for m, s, c in zip(frame["module_id"], frame["staff_id"], frame["price"])]
        capacity = {int(s): int(c) for s, c in zip(frame["staff_id"], frame["capacity"])}
        found = solve(edges, capacity, tiers, {int(m): int(c) for m, c in zip(frame["module_id"], frame["out"])})
        out = pd.DataFrame({"module_id": list(found), "staff_id": list(found.values())}, dtype="int64")
        return out.assign(capacity=int(frame["capacity"].iloc[0])) if swept else out

    marked = priced.withColumn("part", F.lit(0)) if whole else parts(priced, apart)
    largest = 0 if whole else marked.groupBy("part", *swept).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if largest > most:
        raise ValueError(f"{largest} offers hang together, {most} are allowed")
    if swept:
        marked = marked.repartition(GROUPS, "part", *swept)  # by number, or the few groups would be put together in one task
    return marked.groupBy("part", *swept).applyInPandas(run, "module_id long, staff_id long" + ", capacity int" * len(swept))


def _reduced(priced: DataFrame, tiers, most: int, capacities: Sequence[int] = (), direct: int = DIRECT, left_out: int = LEFT_OUT) -> DataFrame:
    """module_id, staff_id (and the capacity, where all people have `capacities` in turn) of a cheapest allocation, of which only what capacities decide is solved.

    Somebody whose load ends within one tier takes one module more or less at that tier's price, so the
    costs of such people are taken to be that price times their load, which is nowhere more than what they
    really cost: modules of theirs choose by price alone, and such a person binds no two modules. What is
    left are the others' offers, each module with the price of its best offer elsewhere. Whoever doesn't
    keep within the tier after all joins the others, until nobody does; then the cheapest allocation
    under the lower costs costs as much under the real ones, and none is cheaper.
    Capacities are solved beside each other, each until it is done.
    """
    scratch = Scratch(priced.sparkSession)
    swept = ["capacity"] if capacities else []
    each = lambda df, some: df.withColumn("capacity", F.explode(F.array(*[F.lit(c) for c in some]))) if swept else df
    load = lambda chosen: chosen.where("staff_id is not null").groupBy(*swept, "staff_id").agg(F.count("*").alias("load"))
    prices = [0, *[c for _, c in tiers]]
    most_of = [F.col("capacity") + sum(n for n, _ in tiers[:i]) for i in range(len(prices))]
    least_of = [F.lit(0), *most_of[:-1]]
    loaded = F.coalesce("load", F.lit(0))

    first = priced.groupBy("module_id").agg(F.min(F.struct("price", "staff_id")).alias("x")).select("module_id", "x.staff_id")
    greedy = first.groupBy("staff_id").agg(F.count("*").alias("load"))
    met = scratch.keep(each(priced.groupBy("staff_id").agg(F.max("capacity").alias("capacity")).join(greedy, "staff_id", "left"), capacities), "loads")
    people = met.drop("load")
    fits = met.groupBy(*swept).agg(*[F.count_if(loaded.between(*r)).alias(f"in{i}") for i, r in enumerate(zip(least_of, most_of))]).collect()  # a row a capacity
    best = {r["capacity"] if swept else None: max(range(len(prices)), key=lambda i: r[f"in{i}"]) for r in fits}  # the tier that most people's loads are in
    if not best:
        return people.select("staff_id", *swept).withColumn("module_id", F.lit(0).cast("long")).where("false")

    def of(values: list) -> Column:
        """What a row's tier has of these."""
        return reduce(lambda other, c: F.when(F.col("capacity") == c, values[best[c]]).otherwise(other), best, F.lit(None)) if swept else values[best[None]]

    price = of([F.lit(x).cast("long") for x in prices])
    within = loaded.between(of(least_of), of(most_of))
    others = scratch.keep(met.where(~within).select(*swept, "staff_id"), "others")
    some, done = list(best) if swept else [], []
    offer = F.struct("price", "staff_id") if swept else F.struct("price", "staff_id", "capacity")
    while True:
        marked = each(priced, some).join(others.withColumn("__other", F.lit(True)), [*swept, "staff_id"], "left")
        per = marked.groupBy(*swept, "module_id").agg(F.min(F.when(F.col("__other").isNull(), offer)).alias("free"), F.collect_list(F.when(F.col("__other"), offer)).alias("held"))
        out = F.least(F.col("free.price") + price, F.lit(left_out).cast("long"))
        # an offer that costs as much as the best one elsewhere is in no cheaper allocation, as places cost nothing at least
        per = per.withColumn("out", out).withColumn("held", F.filter("held", lambda x: x["price"] < F.col("out")))
        per = scratch.keep(per.select(*swept, "module_id", "out", "held", F.when(F.col("free.price") + price <= left_out, F.col("free.staff_id")).alias("stand")), "modules")
        bound = per.select(*swept, "module_id", "out", F.explode("held").alias("x")).select(*swept, "module_id", "out", "x.*")
        n = per.groupBy(*swept).agg(F.sum(F.size("held")).alias("n")).agg(F.max("n")).first()[0] or 0  # offers of one capacity
        given = _solved(bound, tiers, most, swept, some, n <= min(direct, most)).withColumnRenamed("staff_id", "given")
        chosen = scratch.keep(per.join(given, [*swept, "module_id"], "left").select(*swept, "module_id", F.coalesce("given", "stand").alias("staff_id")), "chosen")
        asked = people.where(F.col("capacity").isin(some)) if swept else people
        more = asked.join(load(chosen), [*swept, "staff_id"], "left").join(others, [*swept, "staff_id"], "left_anti").where(~within).select(*swept, "staff_id")
        more = scratch.keep(more, "more")
        left = [r["capacity"] for r in more.select("capacity").distinct().collect()] if swept else [None] * (not more.isEmpty())  # a row a capacity at most
        done.append(chosen.where(~F.col("capacity").isin(left)) if swept and left else chosen)
        if not left:
            return reduce(DataFrame.unionByName, done if swept else done[-1:]).where("staff_id is not null")
        some, others = left if swept else [], others.union(more)


def balance(offers: DataFrame, tiers=TIERS, most: int = MOST_OFFERS, capacities: Sequence[int] | None = None, direct: int = DIRECT) -> DataFrame:
    """module_id, staff_id, rank, rank_shift of the cheapest allocation of the modules that get somebody.

    offers: module_id, staff_id, rank, score, capacity. Modules that share people are one problem, so a
    person's capacity counts once: up to `direct` offers are solved in one task. Of more
    offers only those are solved that hang together by people whose load isn't within one tier, each connected component in one task where they are more than `direct` again. What then
    has more than `most` offers is no task's work, and an error tells so.
    capacities: instead of each person's own, all people have these in turn; the result tells `capacity`,
    and each capacity is solved in tasks of its own.
    """
    scratch = Scratch(offers.sparkSession)
    swept = ["capacity"] if capacities else []
    price = F.lit(SCALE) - F.rint(F.col("score") * SCALE).cast("long") + F.lit(RANK_COST) * F.col("rank")
    priced = scratch.keep(offers.select("module_id", "staff_id", "rank", "capacity", price.cast("long").alias("price"), F.lit(LEFT_OUT).cast("long").alias("out")), "offers")
    ranks = priced.select("module_id", "staff_id", "rank")
    n = priced.count()
    if n > direct:
        chosen = _reduced(priced, tiers, most, capacities or (), direct)
    else:
        if swept:
            priced = priced.withColumn("capacity", F.explode(F.array(*[F.lit(c) for c in capacities])))
        chosen = scratch.keep(_solved(priced, tiers, most, swept, capacities or (), whole=n <= most), "chosen")
    return chosen.join(ranks, ["module_id", "staff_id"]).withColumn("rank_shift", F.col("rank") - 1)


def extraction(taught: DataFrame, offers: DataFrame, balanced: DataFrame) -> DataFrame:
    """module_id, taught, staff_id, score, greedy_id, greedy_score, rank_shift, displaced (staff_id, score, rank of those passed over).

    taught: module_id, taught. A module that isn't taught keeps its first choice and shifts nothing; so does one
    that the allocation left out. A module without offers has nobody.
    """
    per = offers.groupBy("module_id").agg(F.array_sort(F.collect_list(F.struct("rank", "staff_id", "score"))).alias("all"))
    rows = taught.join(per, "module_id", "left").join(balanced.select("module_id", F.col("staff_id").alias("given")), "module_id", "left")
    first = F.get("all", 0)
    mine = F.when(F.col("taught") & F.col("given").isNotNull(), F.get(F.filter("all", lambda x: x["staff_id"] == F.col("given")), 0)).otherwise(first)
    rows = rows.withColumn("mine", mine).withColumn("rank_shift", F.coalesce(F.col("mine.rank") - 1, F.lit(0)))
    passed = F.transform(F.filter(F.coalesce("all", F.array().cast("array<struct<rank:bigint,staff_id:bigint,score:double>>")), lambda x: x["rank"] < F.col("mine.rank")), lambda x: F.struct(x["staff_id"].alias("staff_id"), x["score"].alias("score"), x["rank"].alias("rank")))
    displaced = F.when(F.col("rank_shift") > 0, passed).otherwise(F.array().cast("array<struct<staff_id:bigint,score:double,rank:bigint>>"))
    return rows.select("module_id", "taught", F.col("mine.staff_id").alias("staff_id"), F.col("mine.score").alias("score"), first["staff_id"].alias("greedy_id"), first["score"].alias("greedy_score"), "rank_shift", displaced.alias("displaced"))


def deltas(extracted: DataFrame, pool: DataFrame) -> DataFrame:
    """One row: what balancing changes for taught modules against everybody's first choice."""
    some = extracted.where("taught and staff_id is not null")
    sides = {}
    for side, who, score in (("g", "greedy_id", "greedy_score"), ("b", "staff_id", "score")):
        load = workloads(some.select(F.col(who).alias("staff_id")), pool)
        row = fairness(load).select(*[F.col(c).alias(f"{side}_{c}") for c in ("gini", "utilisation", "ten_share")])
        sides[side] = row.join(F.broadcast(some.agg(F.avg(score).alias(f"{side}_score"))), F.lit(True))
    moved = some.agg(F.count("*").alias("modules"), F.count_if(F.col("rank_shift") > 0).alias("reallocated"))
    row = sides["g"].join(F.broadcast(sides["b"]), F.lit(True)).join(F.broadcast(moved), F.lit(True))  # one row each
    c, pct = F.col, lambda a, b, other: F.round(F.when(b == 0, other).otherwise(100.0 * a / b), 2)
    return row.select(
        "modules", "reallocated", pct(c("reallocated"), c("modules"), 0.0).alias("reallocated_pct"), F.round(c("g_gini") - c("b_gini"), 4).alias("gini_reduction"),
        pct(c("g_gini") - c("b_gini"), c("g_gini"), 0.0).alias("gini_reduction_pct"), F.round(c("b_utilisation") - c("g_utilisation"), 2).alias("utilisation_increase"),
        F.round(c("g_ten_share") - c("b_ten_share"), 2).alias("ten_share_reduction"), F.round(c("g_score") - c("b_score"), 4).alias("relevance_cost"), pct(c("b_score"), c("g_score"), 100.0).alias("relevance_retention"),
    )


def everyone(pool: DataFrame, assigned: DataFrame, staff_id: str = "staff_id") -> DataFrame:
    """Who is in the pool or has something, each once; nobody stands for what has nobody."""
    return pool.select(staff_id).union(assigned.select(staff_id)).where(F.col(staff_id).isNotNull()).distinct()


def workloads(assigned: DataFrame, pool: DataFrame, staff_id: str = "staff_id") -> DataFrame:
    """staff_id, load of everyone in the pool or assigned; who has nothing has 0. Nobody stands for unassigned modules."""
    load = assigned.where(F.col(staff_id).isNotNull()).groupBy(staff_id).agg(F.count("*").alias("load"))
    return everyone(pool, load, staff_id).join(load, staff_id, "left").select(staff_id, F.coalesce("load", F.lit(0)).cast("long").alias("load"))


def _steps(load: DataFrame, group: list[str], falling: bool = False) -> DataFrame:
    """Different loads with their number k, how many people come before them, and the load of those before; as many rows as there are different loads."""
    steps = load.groupBy(*group, "load").agg(F.count("*").alias("k"))
    w = Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.desc("load") if falling else "load").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("before", F.coalesce(F.sum("k").over(w), F.lit(0))).withColumn("gone", F.coalesce(F.sum(F.col("k") * F.col("load")).over(w), F.lit(0)))


def gini(load: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Gini of loads; 0 where there are none. Equal loads are one row with their number, so the order stays small."""
    group = group or []
    # ranks before+1 .. before+k share a load: their sum times the load
    part = F.col("load") * (F.col("k") * F.col("before") + F.col("k") * (F.col("k") + 1) / 2)
    total = _steps(load, group).groupBy(*group).agg(F.sum(part).alias("ranked"), F.sum(F.col("k") * F.col("load")).alias("total"), F.sum("k").alias("n"))
    return total.select(*group, F.when(F.col("total") == 0, 0.0).otherwise(2.0 * F.col("ranked") / (F.col("n") * F.col("total")) - (F.col("n") + 1.0) / F.col("n")).alias("gini"))


def lorenz(load: DataFrame, points: int = 10) -> DataFrame:
    """staff_share, load_share at `points` even places of the ordered loads; places that fall together are one."""
    steps = _steps(load, [])
    size = steps.agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("load")).alias("total"))
    at = F.array_distinct(F.array(*[F.floor(F.lit(k) * (F.col("n") - 1) / (points - 1)) for k in range(points)]))
    wanted = size.select("n", "total", F.explode(at).alias("i"))
    both = steps.join(F.broadcast(wanted), (F.col("i") >= F.col("before")) & (F.col("i") < F.col("before") + F.col("k")))  # as many rows as points
    reached = F.col("gone") + (F.col("i") - F.col("before") + 1) * F.col("load")
    return both.select(F.round(F.col("i") / F.greatest(F.col("n") - 1, F.lit(1)), 4).alias("staff_share"), F.round(reached / F.greatest("total", F.lit(1)), 4).alias("load_share"))


def fairness(load: DataFrame) -> DataFrame:
    """One row: pool, allocated, utilisation, gini, loads of those allocated, shares of the ten and of the busiest 5 %."""
    busy = load.where("load > 0")
    base = load.agg(F.count("*").alias("pool"), F.sum("load").alias("modules"), F.count_if(F.col("load") > 0).alias("allocated"))
    spread = busy.agg(F.max("load").alias("most"), F.min("load").alias("least"), F.avg("load").alias("mean"), F.stddev_pop("load").alias("deviation"))
    head = _steps(busy, [], falling=True).join(F.broadcast(base), F.lit(True))
    few = F.greatest(F.lit(1), F.ceil(0.05 * F.col("pool")))
    first = lambda n: F.coalesce(F.sum(F.col("load") * F.greatest(F.lit(0), F.least("k", n - F.col("before")))), F.lit(0))
    top = head.agg(first(F.lit(10)).alias("ten"), first(few).alias("busiest"))
    row = base.join(F.broadcast(spread), F.lit(True)).join(F.broadcast(top), F.lit(True)).join(F.broadcast(gini(load)), F.lit(True))  # rows of one aggregate each
    pct = lambda a, b: F.round(F.when(b == 0, 0.0).otherwise(100.0 * a / b), 2)
    c = F.col
    return row.select(
        "pool", "modules", "allocated", pct(c("allocated"), c("pool")).alias("utilisation"), F.round("gini", 4).alias("gini"), "most", "least", F.round("mean", 3).alias("mean"),
        F.round("deviation", 3).alias("deviation"), pct(c("ten"), c("modules")).alias("ten_share"), pct(c("busiest"), c("modules")).alias("busiest_share"),
    )
