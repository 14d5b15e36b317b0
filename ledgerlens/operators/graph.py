"""Funding provenance and graph traversals over each wallet's own transactions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import direction, recency_layer, value_layer
from ..ranks import before_stretches, in_stretches
from ..schema import DEFAULT, SOURCES, Config, eth
from ..scratch import discard, materialise, together
from .lifecycle import first_deployment, inbound, with_first
from .overlaps import in_cells


def seeds(tx: DataFrame) -> DataFrame:
    """Inbound transfers before the first deployment, with ``d0``."""
    return with_first(inbound(tx), tx).where("ts < d0")


def _source(type_: Column, age_seconds: Column, c: Config) -> Column:
    return F.when(type_.isNotNull(), type_).when(age_seconds / 3600.0 <= c.fresh_hours, "FRESH_WALLET").otherwise("UNKNOWN_EOA")


def _with_source(rows: DataFrame, entities: DataFrame, ages: DataFrame) -> DataFrame:
    return rows.join(entities.select(F.col("address").alias("src"), "type"), "src", "left").join(ages.select(F.col("address").alias("src"), "first_ts"), "src", "left")


def first_source(tx: DataFrame, entities: DataFrame, ages: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """FP1: what the first inbound sender is: an entity's type, a fresh wallet at deployment, or unknown."""
    firsts = inbound(tx).groupBy("wallet").agg(F.min(F.struct("ts", "stream", "ord", "src")).alias("f")).select("wallet", F.col("f.src").alias("src"))
    rows = _with_source(firsts, entities, ages).join(first_deployment(tx).select("wallet", "d0"), "wallet", "left")
    out = rows.select("wallet", _source(F.col("type"), F.col("d0") - F.col("first_ts"), c).alias("fp_first_inbound_source_type"))
    return tx.select("wallet").distinct().join(out, "wallet", "left").na.fill("UNKNOWN_EOA", ["fp_first_inbound_source_type"])


def seed_features(tx: DataFrame, entities: DataFrame, ages: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """FP3, FP5 and FP6: share of fresh capital, entropy of sources by value, median seed, seed in gas units."""
    rows = _with_source(seeds(tx), entities, ages).withColumn("source", _source(F.col("type"), F.col("ts") - F.col("first_ts"), c))
    v = F.col("value")
    young = (F.col("ts") - F.col("first_ts")) / 3600.0 <= c.fresh_hours
    agg = rows.groupBy("wallet").agg(
        (F.coalesce(F.sum(F.when(young, v)), F.lit(0)).cast("double") / F.sum(v).cast("double")).alias("fp_fraction_fresh"),
        F.median(eth("value")).alias("fp_median_seed_eth"), F.count("*").alias("fp_seed_count"),
        F.max(F.when(F.col("gas_price") > 0, F.struct("value", -F.col("ts"), -F.col("stream"), -F.col("ord"), "gas_price"))).alias("_top"),
    )
    by = rows.groupBy("wallet", "source").agg(F.sum(v).cast("double").alias("x"))
    share = F.col("x") / F.sum("x").over(W.partitionBy("wallet"))
    h = by.withColumn("p", share).groupBy("wallet").agg(((F.lit(0.0) - F.sum(F.col("p") * F.log2("p"))) / math.log2(len(SOURCES))).alias("fp_entropy_norm"))
    units = F.col("_top.value").cast("double") / F.col("_top.gas_price")
    return agg.join(h, "wallet").select("wallet", "fp_fraction_fresh", "fp_entropy_norm", "fp_median_seed_eth", "fp_seed_count", units.alias("fp_seed_gas_units"))


def edges(tx: DataFrame, least_wei: int = 1) -> DataFrame:
    """``wallet, src, dst``: distinct directed transfers in a wallet's own transactions."""
    return tx.where((F.col("value") >= least_wei) & (F.col("src") != "") & (F.col("dst") != "")).select("wallet", "src", "dst").distinct()


def min_hops(tx: DataFrame, entities: DataFrame, depth: int = 5) -> DataFrame:
    """FP2: fewest hops from any known entity to the wallet, in its own graph; null beyond ``depth``.

    Level by level backwards from the wallet. Each level's distinct new nodes are stored before the next reads them, so
    a lost executor costs a re-read and the plan doesn't grow with the depth; nodes met before don't go on again.
    """
    graph = materialise(edges(tx), "edges")
    wallets = tx.select("wallet").distinct()
    frontier = materialise(wallets.select("wallet", F.col("wallet").alias("node"), F.lit(0).alias("hops")), "level")
    levels = [frontier]
    for level in range(1, depth + 1):
        step = frontier.select("wallet", F.col("node").alias("dst")).join(graph, ["wallet", "dst"]).select("wallet", F.col("src").alias("node")).distinct()
        frontier = materialise(step.join(union(levels).select("wallet", "node"), ["wallet", "node"], "left_anti").withColumn("hops", F.lit(level)), "level")
        levels.append(frontier)
    reached = union(levels).join(entities.select(F.col("address").alias("node")), "node", "left_semi").groupBy("wallet").agg(F.min("hops").alias("fp_min_hops"))
    return wallets.join(reached, "wallet", "left")


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def upstream_funders(tx: DataFrame, entities: DataFrame, noise: list[str], depth: int = 3, c: Config = DEFAULT, scope: str = "ego") -> DataFrame:
    """``wallet, funder, depth``: senders up to three hops upstream that are neither noise nor infrastructure.

    ``scope='ego'`` follows the wallet's own transactions, ``'global'`` those of all wallets. Levels are stored as in
    :func:`min_hops`.
    """
    graph = edges(tx, c.min_edge_wei)
    public = entities.where(F.col("type").isin("CEX", "BRIDGE", "MIXER", "DEX")).select(F.col("address").alias("src"))
    graph = graph.where(~F.col("src").isin(noise)).join(public, "src", "left_anti")
    key = ["wallet", "dst"]
    if scope == "global":
        graph, key = graph.select("src", "dst").distinct(), ["dst"]
    graph = materialise(graph, "upstream")
    frontier = tx.select("wallet").distinct().select("wallet", F.col("wallet").alias("node"), F.lit(0).alias("depth"))
    levels = [frontier]
    for level in range(1, depth + 1):
        step = frontier.select("wallet", F.col("node").alias("dst")).join(graph, key).select("wallet", F.col("src").alias("node")).distinct()
        frontier = materialise(step.join(union(levels).select("wallet", "node"), ["wallet", "node"], "left_anti").withColumn("depth", F.lit(level)), "level")
        levels.append(frontier)
    return union(levels[1:]).where("node <> wallet").withColumnRenamed("node", "funder").select("wallet", "funder", "depth")


def shared_funder_flags(links: DataFrame) -> DataFrame:
    """``wallet, fp_shared_funder``: whether any of its funders funds another wallet too; a count by funder, no pairs."""
    a = links.select("wallet", "funder").distinct()
    shared = a.groupBy("funder").agg((F.count("*") > 1).alias("s"))
    return a.join(shared, "funder").groupBy("wallet").agg(F.bool_or("s").alias("fp_shared_funder"))


def shared_funders(links: DataFrame, mode: str = "closed_world", order: DataFrame | None = None) -> DataFrame:
    """FP4: ``wallet, n_shared``, the wallets that share an upstream funder with it.

    ``closed_world`` is symmetric; ``sequential`` counts earlier wallets only, by ``order(wallet, seq)``; wallets of equal
    ``seq`` aren't earlier than each other. No pairs are made, nor anything that is as wide as there are wallets: the links
    of wallets that share a funder at all are compared in cells (see ``overlaps``). In the sequential mode wallets are
    numbered in their order, so the earlier ones are those of lower numbers.
    """
    a = materialise(links.select("wallet", "funder").distinct(), "links")
    shared = _shared_links(a)
    wallets = shared.select("wallet").distinct()
    sequential = mode == "sequential"
    numbers = _numbered(wallets.join(order, "wallet") if sequential else wallets.withColumn("seq", F.xxhash64("wallet")))
    held = materialise(shared.join(numbers, "wallet").select("number", "funder", F.lit(0).cast("long").alias("n"), F.col("least").alias("low")), "held")
    met = in_cells(held, held.drop("low"), numbers.count(), "count", upto=sequential)
    n = numbers.join(met.groupBy("number").agg(F.sum("shared").alias("n_shared")), "number").select("wallet", "n_shared")
    return a.select("wallet").distinct().join(n, "wallet", "left").na.fill(0, ["n_shared"])


def _shared_links(a: DataFrame) -> DataFrame:
    """``wallet, funder, k``, stored: links to funders of ``k`` wallets, two at least, the funder as a number."""
    shared = a.groupBy("funder").agg(F.count("*").alias("k")).where("k > 1")
    # numbers are given once, in a stored table, so that they hold whatever is computed again
    coded = materialise(shared.withColumn("code", F.monotonically_increasing_id()), "funders")
    return materialise(a.join(coded, "funder").select("wallet", F.col("code").alias("funder"), "k"), "shared")


def _numbered(wallets: DataFrame) -> DataFrame:
    """``wallet, number, least``, stored: places in order of ``seq``, and the first place of those with an equal one."""
    stored = in_stretches(wallets.select("seq", "wallet"), ["seq", "wallet"], "order")
    sums = before_stretches(stored, F.lit(1).cast("long")).select("stretch", "before")
    within = F.row_number().over(W.partitionBy("stretch").orderBy(F.col("seq").asc_nulls_first(), "wallet")) - 1
    numbered = materialise(stored.withColumn("within", within).join(sums, "stretch").select("wallet", "seq", (F.col("before") + F.col("within")).alias("number")), "numbers")
    least = numbered.groupBy("seq").agg(F.min("number").alias("least"))
    return materialise(numbered.join(least, "seq").select("wallet", "number", "least"), "numbers")


#: Candidates a set that funders looked up may make on the average of all sets; beyond, sets are compared in cells.
LOOKED_UP = 128


def funder_jaccard(links: DataFrame, seen: list[int] | None = None, looked_up: float = LOOKED_UP) -> DataFrame:
    """``wallet, fp_max_funder_jaccard``: the greatest overlap of its funders with another wallet's.

    Wallets with equal funder sets (by two hashes over the set) are one: they reach 1.0, and only unlike sets are compared.
    A set's best so far begins with what it surely shares with the smallest sets that its funders name. To beat it, another
    set must share so many funders that one of them is among the set's rarest: only those are looked up, rarest first, in
    rounds that reach twice as far each, and every better set that is found leaves fewer to look up. Since the least that one
    shared funder can give is the best so far from the beginning, the funder of a set that most others have, too, is never
    looked up. ``seen`` gets the number of candidate pairs of each round.

    Where even the rarest funders of sets are those of very many others, a round would make nearly all pairs. Before that, at
    over ``looked_up`` candidates a set, the sets that are still open are compared with all others in cells (see
    ``overlaps``), which make no pairs.
    """
    a = materialise(links.select("wallet", "funder").distinct(), "links")
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.col("funder")).cast("decimal(38,0)"))
    marks = materialise(a.groupBy("wallet").agg(F.count("*").alias("n"), h(1).alias("x"), h(2).alias("y")), "marks")
    sets = materialise(marks.groupBy("n", "x", "y").agg(F.min("wallet").alias("set"), F.count("*").alias("m")), "sets")
    # a funder of one set is in no common part; it counts in the set's size only
    held = _shared_links(a.join(sets.select(F.col("set").alias("wallet")), "wallet"))
    held = held.withColumnRenamed("wallet", "set").join(sets.select("set", "n"), "set")
    alone = F.col("n") - F.count("*").over(W.partitionBy("set"))
    held = materialise(held.withColumn("pos", alone + F.row_number().over(W.partitionBy("set").orderBy("k", "funder"))), "held")
    best = materialise(_first_best(held), "best")
    n_sets, low = best.count(), 1
    while True:
        # p of q, the best so far; least: the funders that a better set shares at least, if it is as small as one can be
        need = lambda n, m: F.expr(f"(p * ({n} + {m})) div (p + q) + 1")
        open_ = best.withColumn("reach", F.col("n") - need("n", "greatest(smallest, (p * n) div q)") + 1).where(F.col("reach") >= low).drop("n")
        ahead = held.join(open_, "set").where((F.col("pos") >= low) & (F.col("pos") <= F.col("reach")))
        probes = ahead.where(F.col("pos") < 2 * low)
        left, candidates = ahead.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("pos") < 2 * low, F.col("k"))), F.lit(0))).first()
        if not left:
            break
        if candidates > looked_up * n_sets:
            last, best = best, materialise(_risen(best, _best_in_cells(held, open_)), "best")
            discard(last)
            break
        other = held.select("funder", F.col("set").alias("other"), F.col("n").alias("n2"), F.col("pos").alias("pos2"))
        pairs = probes.join(other, "funder").where("set <> other").withColumn("need", need("n", "n2"))
        pairs = materialise(pairs.where("pos <= n - need + 1 AND pos2 <= n2 - need + 1").select("set", "other", "n", "n2").distinct(), "pairs")
        if seen is not None:
            seen.append(pairs.count())
        shared = pairs.join(held.select("set", "funder"), "set").join(held.select(F.col("set").alias("other"), "funder"), ["other", "funder"])
        found = shared.groupBy("set", "other", "n", "n2").agg(F.count("*").alias("i"))
        last, best = best, materialise(_risen(best, found.select("set", "i", (F.col("n") + F.col("n2") - F.col("i")).alias("u"))), "best")
        discard(last, pairs)
        low *= 2
    best = best.select("set", (F.col("p") / F.col("q")).alias("best"))
    of = sets.join(best, "set", "left").select("n", "x", "y", F.when(F.col("m") > 1, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("fp_max_funder_jaccard"))
    return marks.join(of, ["n", "x", "y"]).select("wallet", "fp_max_funder_jaccard")


def _risen(best: DataFrame, found: DataFrame) -> DataFrame:
    """``best(set, n, smallest, p, q)`` with what ``found(set, i, u)`` has better."""
    better = found.groupBy("set").agg(F.max(F.struct((F.col("i") / F.col("u")).alias("j"), "i", "u")).alias("b"))
    rises = F.col("b").isNotNull() & (F.col("b.i") * F.col("q") > F.col("p") * F.col("b.u"))
    return best.join(better, "set", "left").select("set", "n", "smallest", F.when(rises, F.col("b.i")).otherwise(F.col("p")).alias("p"), F.when(rises, F.col("b.u")).otherwise(F.col("q")).alias("q"))


def _best_in_cells(held: DataFrame, open_: DataFrame) -> DataFrame:
    """``set, i, u``: the best of each range of sets for those that are open, compared with all sets in order of their size."""
    sizes = held.select(F.col("set").alias("wallet"), F.col("n").alias("seq")).distinct()
    numbers = _numbered(sizes).select(F.col("wallet").alias("set"), "number")
    rows = materialise(held.join(numbers, "set").select("set", "number", "funder", "n"), "numbered")
    asked = rows.join(open_.select("set", (F.col("p") / F.col("q")).alias("low")), "set").drop("set")
    met = in_cells(asked, rows.drop("set"), numbers.count(), "best")
    return met.join(numbers, "number").select("set", "i", "u")


def _first_best(held: DataFrame) -> DataFrame:
    """``set, n, smallest, p, q`` of sets that share a funder with another: ``p / q`` is a lower bound of the best overlap.

    Each funder names its smallest set, or to that set the next; a set named by ``p`` of another's funders shares as many at
    least. ``smallest`` is the size of the smallest set that any funder names, so none that shares one is smaller.
    """
    size = F.struct("n", "set")
    first = held.groupBy("funder").agg(F.min(size).alias("f"))
    named = held.join(first, "funder")
    second = named.where(F.col("set") != F.col("f.set")).groupBy("funder").agg(F.min(size).alias("s"))
    named = named.join(second, "funder", "left").withColumn("o", F.when(F.col("set") != F.col("f.set"), F.col("f")).otherwise(F.col("s"))).where("o IS NOT NULL")
    by = named.groupBy("set", "n", F.col("o.set").alias("other"), F.col("o.n").alias("n2")).agg(F.count("*").alias("i"))
    union = F.col("n") + F.col("n2") - F.col("i")
    agg = by.groupBy("set", "n").agg(F.min("n2").alias("smallest"), F.max(F.struct((F.col("i") / union).alias("j"), F.col("i").alias("i"), union.alias("u"))).alias("b"))
    return agg.select("set", "n", "smallest", F.col("b.i").alias("p"), F.col("b.u").alias("q"))


def funding_features(tx: DataFrame, entities: DataFrame, ages: DataFrame, noise: list[str], c: Config = DEFAULT) -> DataFrame:
    """All funding features that the rules read, for every wallet."""
    links, hops = together(lambda: upstream_funders(tx, entities, noise, c=c), lambda: min_hops(tx, entities))
    out = first_source(tx, entities, ages, c).join(seed_features(tx, entities, ages, c), "wallet", "left").join(hops, "wallet", "left")
    out = out.join(shared_funder_flags(links), "wallet", "left")
    return out.na.fill(False, ["fp_shared_funder"]).na.fill(0, ["fp_seed_count"])


# --- tracing ---


def counterparties(tx: DataFrame) -> DataFrame:
    """``wallet, other, value, ts, ord, tx_hash``: transfers with the address at the other end, whichever direction."""
    other = F.when(F.col("src") == F.col("wallet"), F.col("dst")).when(F.col("dst") == F.col("wallet"), F.col("src"))
    return tx.select("wallet", other.alias("other"), eth("value").alias("value"), "ts", "ord", "tx_hash").where("other <> '' AND other <> wallet")


def prune(candidates: DataFrame, min_eth: float = 0.05, max_nodes: int = 500, fanout: int = 50) -> DataFrame:
    """Decision and reason for ``candidates(other, value, traced, n_nodes, halt, dex, n_counterparties)``; the first match wins."""
    traced, small, full = F.col("traced"), F.col("value") < min_eth, F.col("n_nodes") >= max_nodes
    wide = F.col("n_counterparties") > fanout
    decision = F.when(traced | small | full, "SKIP").when(F.col("halt"), "HALT").when(F.col("dex") | wide, "SAMPLE").otherwise("EXPAND")
    reason = (
        F.when(traced, "already_traced").when(small, "dust").when(full, "budget").when(F.col("halt"), "entity").when(F.col("dex"), "dex").when(wide, "fanout").otherwise("ok")
    )
    size = F.when(decision == "SAMPLE", max(5, fanout // 5))
    return candidates.withColumns({"decision": decision, "reason": reason, "sample_size": size})


def accept(candidates: DataFrame, key: str, order: list[Column], budget: int) -> DataFrame:
    """Rows decided EXPAND, in order, as long as the node budget lasts. Once it is used up nothing more is taken."""
    kept = candidates.where("decision = 'EXPAND'").withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return kept.where(F.col("n_nodes") + F.col("rank") <= budget)


def onward(going: DataFrame, placed: DataFrame, most: int) -> DataFrame:
    """``root, other, value``: links of nodes that go on, all those of EXPAND nodes and the largest ``most`` of SAMPLE nodes.

    A SAMPLE node may have very many links and be reached from very many roots, so its links are cut before they meet the
    roots; an EXPAND node has few links, or is a root itself.
    """
    made = [going.where("decision = 'EXPAND'").join(placed, "wallet"), going.where("decision = 'SAMPLE'").join(placed.where(F.col("place") <= most), "wallet")]
    return union([x.select("root", "other", "value") for x in made])


def trace(tx: DataFrame, roots: DataFrame, entities: DataFrame, depth: int = 3, min_eth: float = 0.05, fanout: int = 50, max_nodes: int = 500) -> DataFrame:
    """Bounded breadth-first trace: ``root, node, depth, decision, reason`` of every node reached.

    Only EXPAND nodes go on, SAMPLE nodes with their largest edges; a node is visited once for each root. A root has room
    for ``max_nodes`` nodes that may go on (itself among them): of a level's the largest come first, those beyond are
    skipped for the budget, and so are all nodes of later levels. Every level is stored before the next reads it.
    """
    links = counterparties(tx).groupBy("wallet", "other").agg(F.max("value").alias("value"))
    placed = materialise(links.withColumn("place", F.row_number().over(W.partitionBy("wallet").orderBy(F.desc("value"), "other"))), "links")
    wide = placed.groupBy(F.col("wallet").alias("other")).agg(F.count("*").alias("n_counterparties"))
    kinds = entities.select(F.col("address").alias("other"), "type")
    kept = ["root", "node", "depth", "decision", "reason"]
    levels = [materialise(roots.select(F.col("wallet").alias("root"), F.col("wallet").alias("node"), F.lit(0).alias("depth"), F.lit("EXPAND").alias("decision"), F.lit("ok").alias("reason")), "trace")]
    for level in range(1, depth + 1):
        seen = union(levels)
        going = levels[-1].where("decision IN ('EXPAND', 'SAMPLE')").select("root", F.col("node").alias("wallet"), "decision")
        step = onward(going, placed, max(5, fanout // 5)).groupBy("root", "other").agg(F.max("value").alias("value")).join(seen.select("root", F.col("node").alias("other")), ["root", "other"], "left_anti")
        used = seen.groupBy("root").agg(F.count_if(F.col("decision").isin("EXPAND", "SAMPLE")).alias("n_nodes"))
        rows = step.join(kinds, "other", "left").join(wide, "other", "left").join(used, "root").withColumns({
            "traced": F.lit(False), "halt": F.coalesce(F.col("type").isin("CEX", "MIXER", "BRIDGE"), F.lit(False)), "dex": F.coalesce(F.col("type") == "DEX", F.lit(False)), "n_counterparties": F.coalesce("n_counterparties", F.lit(0)),
        })
        decided = prune(rows, min_eth, max_nodes, fanout)
        goes = F.col("decision").isin("EXPAND", "SAMPLE")
        rank = F.row_number().over(W.partitionBy("root", goes).orderBy(F.desc("value"), "other"))
        over = goes & (F.col("n_nodes") + rank > max_nodes)
        out = decided.withColumn("over", over).select("root", F.col("other").alias("node"), F.lit(level).alias("depth"), F.when(F.col("over"), "SKIP").otherwise(F.col("decision")).alias("decision"), F.when(F.col("over"), "budget").otherwise(F.col("reason")).alias("reason"))
        levels.append(materialise(out.select(*kept), "trace"))
    return union(levels)


#: Which transfers make candidates for a trace.
STRATEGIES = {"FORWARD_ONLY": ["OUTGOING"], "BACKWARD_ONLY": ["INCOMING"], "FULL": ["OUTGOING", "INCOMING"]}


def trace_scores(
    tx: DataFrame, traced: DataFrame, flagged: DataFrame, as_of: int, weights: tuple[float, float, float, float] = (0.30, 0.20, 0.30, 0.20), strategy: str = "FORWARD_ONLY"
) -> DataFrame:
    """Candidates of each wallet with the layers of their priority and the sum; ``traced`` and ``flagged`` have column ``other``.

    ``strategy`` says in which direction a trace goes on: to receivers, to senders, or (any other name) to both. Internal
    transfers make no candidates.
    """
    if abs(sum(weights) - 1) > 0.001:
        raise ValueError("weights must sum to 1")
    side = direction(F.col("src"), F.col("dst"), F.col("wallet"), F.col("stream") == 1)
    sent = counterparties(tx.where(side.isin(STRATEGIES.get(strategy.upper(), STRATEGIES["FULL"]))))
    top = F.max("value").over(W.partitionBy("wallet"))
    rows = sent.withColumn("top", F.when(top > 0, top).otherwise(1.0))
    rows = rows.join(traced.withColumn("_t", F.lit(True)), "other", "left").join(flagged.withColumn("_f", F.lit(True)), "other", "left")
    layers = rows.withColumns({
        "value_score": value_layer(F.col("value"), F.col("top")), "recency_score": recency_layer(F.col("ts"), as_of),
        "novelty_score": F.when(F.col("_t"), 0.0).otherwise(1.0), "rule_score": F.when(F.col("_f"), 1.0).otherwise(0.0),
    })
    names = ["value_score", "recency_score", "novelty_score", "rule_score"]
    total = sum((F.col(n) * w for n, w in zip(names, weights, strict=True)), F.lit(0.0))
    best = layers.withColumn("score", total).withColumn("_r", F.row_number().over(W.partitionBy("wallet", "other").orderBy(F.desc("score"), "ts", "ord"))).where("_r = 1")
    return best.select("wallet", "other", "value", *names, "score", "ts", "ord")


def graph(tx: DataFrame, flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (with a flag) and distinct edges of the transfer graph; the first transfer of an edge names it."""
    links = tx.where("src <> '' AND dst <> ''").groupBy("src", "dst", "tx_hash").agg(F.min(F.struct("ts", "stream", "ord", "value")).alias("f"))
    edge_rows = links.select("src", "dst", "tx_hash", eth(F.col("f.value")).alias("value"), F.col("f.ts").alias("ts"))
    nodes = edge_rows.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(flagged.select(F.col("wallet").alias("node"), F.lit(True).alias("_f")), "node", "left")
    return nodes.select("node", F.coalesce("_f", F.lit(False)).alias("is_flagged")), edge_rows


def renderer(n_nodes: Column, canvas: int = 500, webgl: int = 5000) -> Column:
    """How a graph of so many nodes is best drawn."""
    return F.when(n_nodes >= webgl, "webgl").when(n_nodes >= canvas, "canvas").otherwise("svg")


def graph_summary(tx: DataFrame) -> DataFrame:
    """``wallet, n_nodes, n_edges, renderer`` of every wallet's own graph."""
    links = tx.where("src <> '' AND dst <> ''").select("wallet", "src", "dst", "tx_hash").distinct()
    nodes = links.select("wallet", F.explode(F.array("src", "dst")).alias("node")).distinct().groupBy("wallet").agg(F.count("*").alias("n_nodes"))
    return nodes.join(links.groupBy("wallet").agg(F.count("*").alias("n_edges")), "wallet").withColumn("renderer", renderer(F.col("n_nodes")))


#: Candidates that are taken up at each depth of a trace; beyond, the default.
TOP_BY_DEPTH, TOP_DEFAULT = {1: 3, 2: 3, 3: 7}, 3


def top_of_depth(rows: DataFrame, key: str, order: list[Column], depth: Column) -> DataFrame:
    """The best rows of each ``key``, as many as their depth calls for, with their ``rank``."""
    most = reduce(lambda acc, x: F.when(depth == x[0], x[1]).otherwise(acc), TOP_BY_DEPTH.items(), F.lit(TOP_DEFAULT))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= most)
