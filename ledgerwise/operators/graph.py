"""Referral edges, ego networks, address clusters and lead packs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_divide
from ..sources.staging import dealt, written
from .peers import beside
from .scoring import ordinal_rank

#: Specialties that get many referrals by their nature (G-04); edges to or from them are never suspicious.
EXEMPT = frozenset((
    "clinical laboratory", "independent laboratory", "pathology", "clinical pathology", "anatomic pathology", "diagnostic radiology", "radiology",
    "interventional radiology", "nuclear medicine", "radiation oncology", "durable medical equipment", "home health", "skilled nursing facility", "hospice",
    "ambulance", "ambulatory surgical center", "pharmacy"))
#: Weights are whole numbers, UNIT to a point of risk, so prefix sums are exact; CELL points of weight make a cell of the join.
UNIT, CELL, PARTS = 1000, 64, 4096
#: Draws of each source, and of those that got too few partners by them. Above SMALL providers nine hold 83 % of the weight at most.
SMALL, DRAWS, MORE_DRAWS = 200, 24, 2048


def edge_percent(edges: DataFrame) -> DataFrame:
    """Each edge's part of its source's weight."""
    total = F.sum("shared").over(Window.partitionBy("source"))
    return edges.select("source", "target", "shared", (safe_divide("shared", total) * 100).alias("referral_percent"))


def edge_outliers(edges: DataFrame, people: DataFrame, cut: float = 0.99) -> DataFrame:
    """Edges at or above a percent rank within their pair of specialties; ranks come from counts of equal weights."""
    a = people.select(F.col("npi").alias("source"), F.col("specialty").alias("specialty1"))
    b = people.select(F.col("npi").alias("target"), F.col("specialty").alias("specialty2"))
    both, pair = edges.join(a, "source").join(b, "target"), ["specialty1", "specialty2"]
    counts = both.groupBy(*pair, "shared").agg(F.count("*").alias("n"))  # a row for each distinct weight of a pair
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*pair).orderBy("shared").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = safe_divide(below, F.sum("n").over(Window.partitionBy(*pair)) - 1)
    top = counts.withColumn("rank", rank).where(F.col("rank") >= cut).drop("n")
    return beside(both, top, [*pair, "shared"]).where("rank IS NOT NULL")


def suspicious_edges(edges: DataFrame, flagged: DataFrame, excluded: DataFrame) -> DataFrame:
    """is_suspicious: both ends flagged, or either one excluded."""
    def mark(df, keys, end, name):
        known = keys.select(F.col("npi").alias(end)).distinct().withColumn(name, F.lit(True))
        return df.join(known, end, "left").withColumn(name, F.coalesce(name, F.lit(False)))

    out = edges
    for end in ("source", "target"):
        out = mark(mark(out, flagged, end, f"_f_{end}"), excluded, end, f"_x_{end}")
    return out.select(*edges.columns, ((F.col("_f_source") & F.col("_f_target")) | F.col("_x_source") | F.col("_x_target")).alias("is_suspicious"))


def edge_summary(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("edges"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets"), F.max("shared").alias("max_shared"), F.sum("shared").alias("sum_shared"))


def mutual_edges(edges: DataFrame) -> DataFrame:
    """Edges whose reverse exists, once for each pair."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("shared").alias("shared_back"))
    return edges.join(back, ["source", "target"]).where("source < target")


def incident(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end in nodes(npi): two equi-joins, since a join on either end would be a nested loop."""
    keys = nodes.select("npi").distinct()
    out = edges.join(keys, edges.source == keys.npi, "left_semi")
    return out.unionByName(edges.join(keys, edges.target == keys.npi, "left_semi")).distinct()


def among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    keys = nodes.select("npi").distinct()
    return edges.join(keys, edges.source == keys.npi, "left_semi").join(keys, edges.target == keys.npi, "left_semi")


def ego_network(edges: DataFrame, center: int, hops: int = 1, most_edges: int = 100, most_inner: int = 150, people: DataFrame | None = None, most_nodes: int = 60, second_edges: int = 500) -> DataFrame:
    """Edges around a provider: the strongest incident ones, those among its neighbours, and a second hop.

    The limits are the feature's own. hop: 1 incident, 0 among neighbours, 2 beyond.
    """
    order = [F.desc("shared"), "source", "target"]
    first = edges.where((F.col("source") == center) | (F.col("target") == center)).orderBy(*order).limit(most_edges)
    other = F.when(F.col("source") == center, F.col("target")).otherwise(F.col("source"))
    near = first.select(other.alias("npi")).distinct()
    if hops == 1:
        inner = among(edges, near).orderBy(*order).limit(most_inner)
        return first.withColumn("hop", F.lit(1)).unionByName(inner.withColumn("hop", F.lit(0)))
    own = (F.col("source") != center) & (F.col("target") != center)
    second = incident(edges.where(own), near).orderBy(*order).limit(second_edges)
    both = first.withColumn("hop", F.lit(1)).unionByName(second.withColumn("hop", F.lit(2)))
    if people is None:
        return both
    ends = both.select(F.col("source").alias("npi")).unionByName(both.select(F.col("target").alias("npi"))).distinct()
    top = people.join(ends, "npi", "left_semi").orderBy((F.col("npi") != center), F.desc_nulls_last("risk_score"), "npi").limit(most_nodes)
    return among(both, top)


def _best(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first `most` rows of each key; Spark drops the others in the tasks already, so a hub's edges aren't gathered."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def ego_networks(edges: DataFrame, centers: DataFrame, hops: int = 1, most_edges: int = 100, most_inner: int = 150, people: DataFrame | None = None, most_nodes: int = 60, second_edges: int = 500) -> DataFrame:
    """ego_network of every provider in centers(npi), in one plan: (center, columns of edges, hop).

    A node keeps its strongest edges only, as many as one network can take from it, before it is joined to the networks
    it is in; so a hub that many networks share brings each of them a bounded number of rows. Edges among a
    centre's neighbours are looked up by their pairs, of which `most_edges` is the bound, not by a hub's edges. Edges
    must be one row for each source and target.
    """
    order = [F.desc("shared"), "source", "target"]
    names = edges.columns
    ends = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), *names).unionByName(edges.where("source <> target").select(F.col("target").alias("node"), F.col("source").alias("other"), *names))
    asked = centers.select(F.col("npi").alias("node")).distinct()
    first = _best(ends.join(asked, "node", "left_semi"), ["node"], order, most_edges).withColumnRenamed("node", "center")
    first = written(first, "first")
    near = first.select("center", F.col("other").alias("npi")).distinct()
    hop1 = first.select("center", *names, F.lit(1).alias("hop"))
    if hops == 1:
        pairs = near.withColumnRenamed("npi", "source").join(near.withColumnRenamed("npi", "target"), "center")
        inner = _best(pairs.join(edges, ["source", "target"]), ["center"], order, most_inner)
        return hop1.unionByName(inner.select("center", *names, F.lit(0).alias("hop")))
    # a neighbour's edges with the centre itself, one each way, take places of it
    strong = _best(ends.join(near.select(F.col("npi").alias("node")).distinct(), "node", "left_semi"), ["node"], order, second_edges + 2)
    second = near.join(strong, near.npi == strong.node).where("source <> center AND target <> center").select("center", *names)
    # dealt once, by centre, for the distinct edges and their order; a centre has a bounded number of rows
    second = dealt(second, first.count() * (second_edges + 2), "center").distinct()
    hop2 = _best(second, ["center"], order, second_edges).withColumn("hop", F.lit(2))
    both = hop1.unionByName(hop2)
    if people is None:
        return both
    both = written(both, "both")
    nodes = both.select("center", F.col("source").alias("npi")).unionByName(both.select("center", F.col("target").alias("npi"))).distinct()
    known = nodes.join(people.select("npi", "risk_score"), "npi")
    top = _best(known, ["center"], [F.col("npi") != F.col("center"), F.desc_nulls_last("risk_score"), "npi"], most_nodes).select("center", "npi")
    for end in ("source", "target"):
        both = both.join(top.withColumnRenamed("npi", end), ["center", end], "left_semi")
    return both.select("center", *names, "hop")


def edge_width(shared) -> F.Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.log1p(shared) * 0.6))


def _quantile(p: DataFrame, column: str, key: str, at: float) -> DataFrame:
    """One row `cut`: the exact quantile with linear interpolation, from global ranks; null of an empty table."""
    total = p.agg(F.count("*").alias("_n")).withColumn("_h", F.round(F.lit(at) * (F.col("_n") - 1), 9))
    ranked = ordinal_rank(p.select(column, key), [column, key], "_rank").join(F.broadcast(total), (F.col("_rank") >= F.floor("_h") + 1) & (F.col("_rank") <= F.ceil("_h") + 1))  # one row
    low, high = F.min_by(column, "_rank"), F.max_by(column, "_rank")
    return ranked.agg((low + (high - low) * F.max(F.col("_h") - F.floor("_h"))).alias("cut"))


def sampled_edges(people: DataFrame, seed: int = 42) -> DataFrame:
    """people(npi, state, specialty, risk_score 0 to 100) -> synthetic edges (source, target, is_suspicious) within states.

    Each provider draws 3 + min(5, risk / 20) partners, all others at most, by risk + 1 over its whole state
    without replacement. A pair that both ends draw is there once, from the end with more risk. Suspicious:
    both ends in the top fifth of the risks, neither of an exempt specialty. npi is unique; rows without a
    state draw nobody.

    Draws are numbers against prefix sums of the weights; a repeat or the source itself is drawn again, which
    is sampling without replacement. A number finds its provider by the cell of weight it lies in. In states
    of at most SMALL providers the same distribution comes from keys -ln(u) / weight of all pairs, as there a
    few may hold nearly all weight and the rest would take many draws.
    """
    risk = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(F.col("risk_score").cast("double"), F.lit(0.0)), F.lit(0.0))))
    p = people.select("npi", "state", F.lower(F.trim(F.coalesce("specialty", F.lit("")))).isin(sorted(EXEMPT)).alias("exempt"), risk.alias("risk"))
    cut = _quantile(p, "risk", "npi", 0.8)
    p = p.where("state IS NOT NULL").withColumns({"w": F.round((F.col("risk") + 1) * UNIT).cast("long"), "part": F.pmod(F.xxhash64("npi"), F.lit(PARTS))})
    sums = p.groupBy("state", "part").agg(F.sum("w").alias("w"), F.count("*").alias("n"))  # at most PARTS rows for each state
    before = Window.partitionBy("state").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("state")
    sums = sums.select("state", "part", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("base"), F.sum("w").over(whole).alias("all"), F.sum("n").over(whole).alias("n"))
    within = Window.partitionBy("state", "part").orderBy("npi").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("ahead", F.coalesce(F.sum("w").over(within), F.lit(0))).join(sums, ["state", "part"])
    p = p.withColumns({"low": F.col("base") + F.col("ahead"), "k": F.least(F.floor(3 + F.least(F.lit(5.0), F.col("risk") / 20)), F.col("n") - 1)})

    # each number in [0, all) to the provider whose weight it lies in
    cell = lambda x: F.floor(x / (CELL * UNIT))
    ends = p.where(F.col("n") > SMALL).select("state", F.col("npi").alias("target"), "low", (F.col("low") + F.col("w")).alias("high"), F.explode(F.sequence(cell(F.col("low")), cell(F.col("low") + F.col("w") - 1))).alias("cell"))

    def drawn(sources: DataFrame, draws: int) -> DataFrame:
        tries = sources.select("state", F.col("npi").alias("source"), "k", "all", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("order"))
        tries = tries.withColumn("x", F.pmod(F.xxhash64("source", "order", F.lit(seed)), F.col("all"))).withColumn("cell", cell(F.col("x")))
        hits = tries.join(ends, ["state", "cell"]).where("low <= x AND x < high AND source <> target").groupBy("source", "target", "k").agg(F.min("order").alias("order"))
        return hits.withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy("order"))).where("nth <= k").select("source", "target", "k", "nth")

    many = p.where(F.col("n") > SMALL)
    first = drawn(many, DRAWS)
    done = first.where("nth = k").select(F.col("source").alias("npi"))
    more = drawn(many.join(done, "npi", "left_anti"), MORE_DRAWS)
    few = p.where((F.col("n") <= SMALL) & (F.col("n") > 1))
    both = few.select("state", F.col("npi").alias("source"), "k").join(few.select("state", F.col("npi").alias("target"), "w"), "state").where("source <> target")  # SMALL for each source
    u = (F.pmod(F.xxhash64("source", "target", F.lit(seed)), F.lit(1 << 50)) + 1) / float((1 << 50) + 1)
    both = both.withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy(-F.log(u) / F.col("w"), "target"))).where("nth <= k")
    pairs = first.join(done, first.source == done.npi, "left_semi").select("source", "target").unionByName(more.select("source", "target")).unionByName(both.select("source", "target"))
    for end in ("source", "target"):
        pairs = pairs.join(p.select(F.col("npi").alias(end), F.col("risk").alias(f"{end}_risk"), F.col("exempt").alias(f"{end}_exempt")), end)
    pair = [f("source", "target") for f in (F.least, F.greatest)]
    pairs = pairs.groupBy(pair[0].alias("_a"), pair[1].alias("_b")).agg(F.min_by(F.struct(*pairs.columns), F.struct((-F.col("source_risk")).alias("r"), "source")).alias("e")).select("e.*")
    high = (F.col("source_risk") >= F.col("cut")) & (F.col("target_risk") >= F.col("cut"))
    return pairs.crossJoin(F.broadcast(cut)).select("source", "target", (high & ~F.col("source_exempt") & ~F.col("target_exempt")).alias("is_suspicious"))  # one row


def cluster_score(n, max_risk, avg_risk, same, excluded) -> F.Column:
    score = 0.35 * same * 100 + 0.25 * max_risk + 0.15 * avg_risk + 0.10 * F.least(n, F.lit(10)) / 10 * 100 + 0.15 * F.least(excluded, F.lit(2)) / 2 * 100
    return F.when(n > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 1)).otherwise(0.0)


def address_clusters(people: DataFrame, least: int = 3, most: int | None = None) -> DataFrame:
    """people(npi, address, specialty, risk_score, total_payment, excluded) -> one row per shared address.

    dominant: the most frequent specialty, ties by name. Large clusters are limited before they are ranked.
    """
    p = people.where("address IS NOT NULL")
    per = p.groupBy("address", "specialty").agg(F.count("*").alias("n"))
    best = per.where("specialty IS NOT NULL").groupBy("address").agg(F.min_by(F.struct("specialty", "n"), F.struct((-F.col("n")).alias("m"), "specialty")).alias("top"))
    whole = p.groupBy("address").agg(F.count("*").alias("provider_count"), F.max("risk_score").alias("max_risk"), F.avg("risk_score").alias("avg_risk"), F.sum("total_payment").alias("total_payment"), F.count_if("excluded").alias("excluded_count")).where(F.col("provider_count") >= least)
    out = whole.join(best, "address", "left").withColumn("same_fraction", F.coalesce(F.col("top.n") / F.col("provider_count"), F.lit(0.0)))
    if most is not None:
        out = out.orderBy(F.desc("provider_count"), F.desc("max_risk"), "address").limit(most)
    score = cluster_score(F.col("provider_count"), F.coalesce("max_risk", F.lit(0.0)), F.coalesce("avg_risk", F.lit(0.0)), F.col("same_fraction"), F.col("excluded_count"))
    return out.select("address", "provider_count", "max_risk", "avg_risk", "total_payment", "excluded_count", F.col("top.specialty").alias("dominant"), "same_fraction", score.alias("cluster_score"))


def cluster_members(people: DataFrame, clusters: DataFrame, most: int = 50) -> DataFrame:
    """The members with most risk of each cluster; the limit is the feature's own."""
    rank = F.row_number().over(Window.partitionBy("address").orderBy(F.desc_nulls_last("risk_score"), "npi"))
    return people.join(clusters.select("address"), "address", "left_semi").withColumn("n", rank).where(F.col("n") <= most).drop("n")


def address_coverage(people: DataFrame, ready: int = 10_000) -> DataFrame:
    return people.agg(F.count("*").alias("providers"), F.count("address").alias("with_address"), (F.count("address") >= ready).alias("is_ready"))


def cluster_of(people: DataFrame, npi, least: int = 2) -> DataFrame:
    """The cluster at one provider's address, from two providers on; no row without one. Only that address is aggregated."""
    at = people.where((F.col("npi") == npi) & F.col("address").isNotNull()).select("address").limit(1)
    return address_clusters(people.join(F.broadcast(at), "address", "left_semi"), least)  # one row


def cluster_count(people: DataFrame, least: int = 3) -> DataFrame:
    """(clusters, providers): addresses that `least` providers or more share, and how many those are."""
    sizes = people.where("address IS NOT NULL").groupBy("address").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return sizes.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("providers"))


def node_search(people: DataFrame, edges: DataFrame, text: str, access: list[str] = (), columns: tuple[str, ...] = ("npi", "name"), limit: int = 20) -> DataFrame:
    """Providers whose columns hold the text (two characters or more): those with edges of their own first, then by risk."""
    if len(text) < 2:
        raise ValueError("two characters or more")
    found = reduce(lambda a, b: a | b, (F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())) for c in columns))
    out = people.where(found)
    if access:
        out = out.where(F.col("state").isin(list(access)))
    known = edges.select(F.col("source").alias("npi")).distinct().withColumn("has_edges", F.lit(True))
    out = out.join(known, "npi", "left").withColumn("has_edges", F.coalesce("has_edges", F.lit(False)))
    return out.orderBy(F.desc("has_edges"), F.desc_nulls_last("risk_score"), "npi").limit(limit)


def pack_summary(people: DataFrame, state: str | None = None) -> DataFrame:
    """(providers, high_risk, excluded) of a state or of all."""
    own = people if state is None else people.where(F.col("state") == state)
    return own.agg(F.count("*").alias("providers"), F.count_if(F.col("risk_score") >= 70).alias("high_risk"), F.count_if("excluded").alias("excluded"))


def lead_pack(people: DataFrame, flags: DataFrame, impact: DataFrame, limit: int = 50, state: str | None = None) -> DataFrame:
    """Leads of a state: three times the limit by risk, ranked anew by risk, excess, kinds of flags and cluster."""
    sizes = people.where("address IS NOT NULL").groupBy("address").agg(F.count("*").alias("cluster_size"))
    kinds = flags.where("is_active").groupBy("npi").agg(F.count_distinct("flag_type").alias("flag_types"), F.array_sort(F.collect_set("flag_type")).alias("types"))
    own = people if state is None else people.where(F.col("state") == state)
    first = own.orderBy(F.desc_nulls_last("risk_score"), "npi").limit(3 * limit)
    out = first.join(kinds, "npi", "left").join(sizes, "address", "left").join(impact.select("npi", "excess"), "npi", "left")
    out = out.withColumns({"flag_types": F.coalesce("flag_types", F.lit(0)), "excess": F.coalesce("excess", F.lit(0.0)), "cluster_size": F.coalesce("cluster_size", F.lit(0))})
    top = out.agg(F.max("excess").alias("_top"))
    out = out.crossJoin(F.broadcast(top))  # one row
    rank = 0.5 * F.coalesce("risk_score", F.lit(0.0)) + 25 * safe_divide("excess", "_top") + 15 * F.least("flag_types", F.lit(5)) / 5 + 10 * (F.col("cluster_size") >= 3).cast("int")
    return out.withColumn("lead_rank", F.round(rank, 1)).drop("_top").orderBy(F.desc("lead_rank"), "npi").limit(limit)


def next_steps(lead) -> F.Column:
    """Recommendations as an array of words."""
    every = [F.when(F.col("excluded"), "verify exclusion"), F.when(F.col("cluster_size") >= 3, "visit address"), F.when(F.col("excess") >= 250_000, "request records"), F.when(F.col("flag_types") >= 3, "full review")]
    return F.filter(F.array(*every), lambda x: x.isNotNull())
