"""Analytics over target, position, trade and equity tables, many portfolios at once.

Windows run per portfolio over its sessions or signals; wide member lists are never
collected, set comparisons are unions followed by one grouped count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratapanel.functions.scalars import ratio, yes
from stratapanel.runtime import explode_literals

PORTFOLIO = "portfolio_id"


def target_weight_returns(
    targets: DataFrame, prices: DataFrame, costs_bps: list[float], *, keys: list[str] | None = None, index: str = "signal_index",
    entity: str = "entity", weight: str = "target_weight", at: str = "execution_position", until: str = "next_position",
    position: str = "position", price: str = "open",
) -> DataFrame:
    """Net return per signal from weights: sum of w * (next open / open - 1) minus cost * turnover.

    ``at`` and ``until`` are the session positions of this and the next execution.  A name
    without both prices earns nothing and is counted.
    """
    keys = keys or []
    by = [*keys, index]
    a = prices.select(entity, F.col(position).alias(at), F.col(price).alias("_p0"))
    b = prices.select(entity, F.col(position).alias(until), F.col(price).alias("_p1"))
    held = targets.join(a, [entity, at], "left").join(b, [entity, until], "left")
    move = ratio("_p1", "_p0") - 1
    gross = held.groupBy(*by).agg(
        F.coalesce(F.sum(F.col(weight) * move), F.lit(0.0)).alias("gross_return"),
        F.count_if(move.isNull()).alias("unpriced_names"), F.count(F.lit(1)).alias("names"))
    # Turnover needs each name's weight now and at the signal before: union and one sum.
    now = targets.select(*by, entity, F.col(weight).alias("_d"))
    then = targets.select(*keys, (F.col(index) + 1).alias(index), entity, (-F.col(weight)).alias("_d"))
    change = now.unionByName(then).groupBy(*by, entity).agg(F.abs(F.sum("_d")).alias("_d"))
    turnover = change.groupBy(*by).agg(F.sum("_d").alias("turnover"))
    out = explode_literals(gross.join(turnover, by), [(float(c),) for c in costs_bps], [("cost_bps", "double")])
    return out.withColumn("net_return", F.col("gross_return") - F.col("turnover") * F.col("cost_bps") / 10000)


def equity_from_returns(
    returns: DataFrame, initial: float, *, keys: tuple[str, ...] = (PORTFOLIO,), order: str = "session", value: str = "net_return"
) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order)
    return returns.withColumn("equity", F.lit(float(initial)) * F.product(F.lit(1.0) + F.col(value)).over(w))


def equity_enrich(equity: DataFrame, initial: float, *, key: str = PORTFOLIO, session: str = "session") -> DataFrame:
    """Daily return (the first against the initial capital) and drawdown from the running peak."""
    w = W.partitionBy(key).orderBy(session)
    before = F.coalesce(F.lag("equity").over(w), F.lit(float(initial)))
    return equity.withColumn("daily_return", ratio("equity", before) - 1).withColumn(
        "drawdown", ratio("equity", F.max("equity").over(w)) - 1)


def performance_metrics(
    equity: DataFrame, initial: float, *, key: str = PORTFOLIO, session: str = "session", periods: int = 252
) -> DataFrame:
    """Return, risk and drawdown figures per portfolio."""
    w = W.partitionBy(key).orderBy(session)
    curve = (
        equity.withColumn("_r", ratio("equity", F.lag("equity").over(w)) - 1)
        .withColumn("_dd", ratio("equity", F.max("equity").over(w)) - 1)
    )
    # Rows since the last peak share an island number; the longest island is the duration.
    curve = curve.withColumn("_u", (F.col("_dd") < 0).cast("int"))
    curve = curve.withColumn("_island", F.sum(1 - F.col("_u")).over(w))
    curve = curve.withColumn("_run", F.sum("_u").over(W.partitionBy(key, "_island").orderBy(session)))
    down = F.when(F.col("_r") < 0, F.col("_r"))
    m = curve.groupBy(key).agg(
        F.min(session).alias("start_session"), F.max(session).alias("end_session"), F.count("_r").alias("observations"),
        (F.max_by("equity", session) / F.lit(float(initial)) - 1).alias("cumulative_return"),
        F.avg("_r").alias("_mean"), F.stddev_samp("_r").alias("_std"), F.stddev_samp(down).alias("_down"),
        F.min("_dd").alias("maximum_drawdown"), F.max("_run").alias("maximum_drawdown_duration"),
        F.count_if(yes(F.col("_r") > 0)).alias("positive_periods"), F.count_if(yes(F.col("_r") < 0)).alias("negative_periods"))
    n, c = F.col("observations"), F.col("cumulative_return")
    root = F.sqrt(F.lit(float(periods)))
    std, dn = F.when(F.col("_std") > 0, F.col("_std")), F.when(F.col("_down") > 0, F.col("_down"))
    m = m.withColumn("cagr", F.when((n > 0) & (c > -1), F.pow(1 + c, F.lit(float(periods)) / n) - 1))
    return (
        m.withColumn("annualized_volatility", F.col("_std") * root)
        .withColumn("sharpe", ratio("_mean", std) * root)
        .withColumn("sortino", ratio("_mean", dn) * root)
        .withColumn("calmar", F.when(F.col("maximum_drawdown") < 0, ratio("cagr", F.abs("maximum_drawdown"))))
        .drop("_mean", "_std", "_down")
    )


def period_returns(equity: DataFrame, initial: float, unit: str, *, key: str = PORTFOLIO, session: str = "session") -> DataFrame:
    """Return per month or year: last equity over the last equity of the period before."""
    ends = equity.groupBy(key, F.date_trunc(unit, F.col(session)).cast("date").alias("period")).agg(
        F.max_by("equity", session).alias("_end"))
    before = F.lag("_end").over(W.partitionBy(key).orderBy("period"))
    return ends.select(key, "period", (ratio("_end", F.coalesce(before, F.lit(float(initial)))) - 1).alias("period_return"))


def _peaks(equity: DataFrame, key: str, session: str) -> DataFrame:
    """Sessions with their number ``_i``, ``_p`` (1 at a running peak) and ``_episode``, the number of peaks so far."""
    w = W.partitionBy(key).orderBy(session)
    rows = equity.select(key, session, "equity", F.row_number().over(w).alias("_i"), F.max("equity").over(w).alias("_peak"))
    at_peak = F.col("equity") >= F.col("_peak")
    return rows.withColumn("_p", at_peak.cast("int")).withColumn("_episode", F.sum(at_peak.cast("int")).over(w))


def drawdown_episodes(equity: DataFrame, top: int | None = 10, *, key: str = PORTFOLIO, session: str = "session") -> DataFrame:
    """Peak, start, trough and recovery of every drawdown, deepest first; ``top`` limits the report."""
    rows = _peaks(equity, key, session)
    under = F.col("_p") == 0
    e = rows.groupBy(key, "_episode").agg(
        F.max(F.when(~under, F.col(session))).alias("peak_session"), F.max(F.when(~under, F.col("_i"))).alias("_pi"),
        F.max(F.when(~under, F.col("equity"))).alias("_pe"), F.min(F.when(under, F.col(session))).alias("underwater_start"),
        F.min(F.when(under, F.struct("equity", F.col("_i"), F.col(session)))).alias("_t"))
    line = W.partitionBy(key).orderBy("_episode")
    e = e.withColumn("recovery_session", F.lead("peak_session").over(line)).withColumn("_ri", F.lead("_pi").over(line))
    e = e.where(F.col("_t").isNotNull())
    depth = ratio("_t.equity", "_pe") - 1
    out = e.select(
        key, "peak_session", "underwater_start", F.col(f"_t.{session}").alias("trough_session"), "recovery_session",
        depth.alias("depth"), (F.col("_t._i") - F.col("_pi")).alias("peak_to_trough"), (F.col("_ri") - F.col("_pi")).alias("recovery_duration"),
        F.col("_ri").isNotNull().alias("recovered"))
    out = out.withColumn("episode_id", F.row_number().over(W.partitionBy(key).orderBy("depth", "peak_session")))
    return out.where(F.col("episode_id") <= top) if top else out


def daily_contribution(
    equity: DataFrame, positions: DataFrame, trades: DataFrame, *, key: str = PORTFOLIO, session: str = "session", entity: str = "entity"
) -> DataFrame:
    """Change of market value minus net investment, per portfolio, session and entity.

    Today's value, yesterday's value and trades meet in one union and one grouped sum.
    """
    order = W.partitionBy(key).orderBy(session)
    line = equity.select(key, session, F.row_number().over(order).alias("_i"))
    zero = F.lit(0.0)
    pos = positions.join(line, [key, session]).select(key, entity, "_i", F.col("market_value").alias("_mv"))
    cols = lambda now, prior, inv, cost, had: [
        now.alias("_now"), prior.alias("_prior"), inv.alias("_inv"), cost.alias("_cost"), had.alias("_had")]
    today = pos.select(key, entity, "_i", *cols(F.col("_mv"), zero, zero, zero, F.lit(0)))
    before = pos.select(key, entity, (F.col("_i") + 1).alias("_i"), *cols(zero, F.col("_mv"), zero, zero, F.lit(1)))
    signed = F.when(F.col("side") == "BUY", F.col("notional") + F.col("transaction_cost")).otherwise(
        -(F.col("notional") - F.col("transaction_cost")))
    fills = trades.join(line, [key, session]).select(
        key, entity, "_i", *cols(zero, zero, signed, F.col("transaction_cost") + F.col("slippage_cost"), F.lit(0)))
    total = today.unionByName(before).unionByName(fills).groupBy(key, entity, "_i").agg(
        F.sum("_now").alias("_now"), F.sum("_prior").alias("_prior"), F.sum("_inv").alias("_inv"), F.sum("_cost").alias("all_in_cost"),
        F.max("_had").alias("_had"))
    net = F.col("_now") - F.col("_prior") - F.col("_inv")
    return total.join(line, [key, "_i"]).select(
        key, session, entity, net.alias("net_contribution"), "all_in_cost", (net + F.col("all_in_cost")).alias("gross_contribution"),
        F.when(F.col("_had") == 1, "EXISTING").otherwise("NEWLY_ENTERED").alias("position_status"))


def contribution_share(contributions: DataFrame, by: str, *, key: str = PORTFOLIO, value: str = "net_contribution") -> DataFrame:
    """Sum per name or group and its share of the absolute total."""
    sums = contributions.groupBy(key, by).agg(F.sum(value).alias("contribution"))
    total = sums.groupBy(key).agg(F.sum(F.abs("contribution")).alias("_t"))
    return sums.join(total, key).withColumn("absolute_share", ratio(F.abs("contribution"), "_t")).drop("_t")


def episode_sessions(equity: DataFrame, *, key: str = PORTFOLIO, session: str = "session") -> DataFrame:
    """(portfolio, session, episode_id) of every session in (peak, trough] of a drawdown; ids by depth as in ``drawdown_episodes``.

    Episodes do not overlap, so one pass over the running peaks labels each session once.
    """
    rows = _peaks(equity, key, session).withColumn("_t", F.when(F.col("_p") == 0, F.struct("equity", "_i", session)))
    episode = W.partitionBy(key, "_episode")
    low = F.min("_t").over(episode)
    marked = rows.select(
        key, session, "_i", "_p", F.max(F.when(F.col("_p") == 1, F.col("equity"))).over(episode).alias("_pe"), low.alias("_low"),
        F.max(F.when(F.col("_p") == 1, F.col(session))).over(episode).alias("_ps"))
    depth = (ratio("_low.equity", "_pe") - 1).alias("_depth")
    falling = marked.where((F.col("_p") == 0) & (F.col("_i") <= F.col("_low._i"))).select(key, session, depth, "_ps")
    return falling.select(key, session, F.dense_rank().over(W.partitionBy(key).orderBy("_depth", "_ps")).alias("episode_id"))


def drawdown_attribution(equity: DataFrame, contributions: DataFrame, by: str, *, key: str = PORTFOLIO, session: str = "session") -> DataFrame:
    """Contribution by name or group inside (peak, trough] of every episode, and its absolute share.

    Sessions carry the label of their episode, so contributions meet them once, on portfolio and session.
    """
    inside = contributions.join(episode_sessions(equity, key=key, session=session), [key, session])
    keys = [key, "episode_id"]
    kinds = lambda s: F.coalesce(F.sum(F.when(F.col("position_status") == s, F.col("net_contribution"))), F.lit(0.0))
    sums = inside.groupBy(*keys, by).agg(
        F.sum("net_contribution").alias("net_contribution"), kinds("EXISTING").alias("existing_contribution"),
        kinds("NEWLY_ENTERED").alias("new_contribution"))
    total = sums.groupBy(*keys).agg(F.sum(F.abs("net_contribution")).alias("_t"))
    return sums.join(total, keys).withColumn("absolute_share", ratio(F.abs("net_contribution"), "_t")).drop("_t")


def holding_sets(
    positions: DataFrame, anomalies: DataFrame, rebalances: DataFrame, *, key: str = PORTFOLIO, session: str = "session", entity: str = "entity",
    index: str = "rebalance_index",
) -> DataFrame:
    """Intended names per rebalance: held after execution, minus trapped exits, plus prevented entries.

    Long form, one row per (portfolio, rebalance, entity) with ``in_prior`` and ``in_current``.
    """
    line = rebalances.select(key, session, index)
    trapped = anomalies.where(F.col("type") == "UNEXECUTABLE_EXIT").select(key, session, entity)
    prevented = anomalies.where(F.col("type") == "PREVENTED_ENTRY").select(key, session, entity)
    now = positions.select(key, session, entity).join(trapped, [key, session, entity], "left_anti").unionByName(prevented)
    current = now.distinct().join(line, [key, session]).select(key, index, entity)
    return prior_and_current(current, rebalances, key=key, index=index, item=entity)


def prior_and_current(chosen: DataFrame, rebalances: DataFrame, *, key: str = PORTFOLIO, index: str = "rebalance_index", item: str = "entity") -> DataFrame:
    """Every item chosen now or at the rebalance before, with both flags."""
    now = chosen.select(key, index, item, F.lit(1).alias("_c"), F.lit(0).alias("_p"))
    before = chosen.select(key, (F.col(index) + 1).alias(index), item, F.lit(0).alias("_c"), F.lit(1).alias("_p"))
    both = now.unionByName(before).groupBy(key, index, item).agg((F.max("_p") == 1).alias("in_prior"), (F.max("_c") == 1).alias("in_current"))
    return both.join(rebalances.select(key, index).distinct(), [key, index], "left_semi")


def selection_stability(sets: DataFrame, *, key: str = PORTFOLIO, index: str = "rebalance_index", item: str = "entity", prefix: str = "names") -> DataFrame:
    """Retained, entered and exited counts, Jaccard overlap and mean current run length per rebalance."""
    p, c = F.col("in_prior"), F.col("in_current")
    held = sets.where(c)
    # Consecutive rebalances of one item differ from its row number by a constant.
    island = F.col(index) - F.row_number().over(W.partitionBy(key, item).orderBy(index))
    runs = held.withColumn("_g", island)
    runs = runs.withColumn("_run", F.row_number().over(W.partitionBy(key, item, "_g").orderBy(index)))
    length = runs.groupBy(key, index).agg(F.avg("_run").alias(f"mean_active_{prefix}_run"))
    counts = sets.groupBy(key, index).agg(
        F.count_if(p & c).alias(f"{prefix}_retained"), F.count_if(c & ~p).alias(f"{prefix}_entered"), F.count_if(p & ~c).alias(f"{prefix}_exited"),
        ratio(F.count_if(p & c), F.count(F.lit(1))).alias(f"{prefix}_jaccard"))
    return counts.join(length, [key, index], "left")


def run_durations(chosen: DataFrame, *, key: str = PORTFOLIO, index: str = "rebalance_index", item: str = "entity") -> DataFrame:
    """Number and mean length of uninterrupted selections per portfolio."""
    island = F.col(index) - F.row_number().over(W.partitionBy(key, item).orderBy(index))
    runs = chosen.withColumn("_g", island).groupBy(key, item, "_g").agg(F.count(F.lit(1)).alias("_n"))
    return runs.groupBy(key).agg(F.count(F.lit(1)).alias("runs"), F.avg("_n").alias("mean_run"), F.max("_n").alias("longest_run"))


# Moves across the selection boundary that count as small.
SMALL_MOVES = ["3->4", "4->3", "3->5", "5->3"]


def boundary_churn(sets: DataFrame, ranks: DataFrame, *, key: str = PORTFOLIO, index: str = "rebalance_index", item: str = "entity") -> DataFrame:
    """Rank before and after for names that enter or leave, and whether the move is small.

    The first rebalance has nothing before it and is left out.
    """
    first = sets.groupBy(key).agg(F.min(index).alias("_first"))
    moved = sets.where(F.col("in_prior") != F.col("in_current")).join(first, key).where(F.col(index) > F.col("_first")).drop("_first")
    now = ranks.select(index, item, F.col("rank").alias("current_rank"))
    before = ranks.select((F.col(index) + 1).alias(index), item, F.col("rank").alias("previous_rank"))
    out = moved.join(before, [index, item], "left").join(now, [index, item], "left")
    text = F.concat(F.coalesce(F.col("previous_rank").cast("string"), F.lit("none")), F.lit("->"), F.coalesce(F.col("current_rank").cast("string"), F.lit("none")))
    return out.select(
        key, index, item, F.when(F.col("in_current"), "ENTER").otherwise("EXIT").alias("direction"), "previous_rank", "current_rank",
        text.alias("rank_move"), text.isin(SMALL_MOVES).alias("small_move"))


def turnover_attribution(
    trades: DataFrame, sets: DataFrame, mapping: DataFrame, rebalances: DataFrame, *, key: str = PORTFOLIO, index: str = "rebalance_index",
    entity: str = "entity", group: str = "group_code", forced: str = "forced",
) -> DataFrame:
    """Class of every fill: forced, weight rebalancing, group entry or exit, replacement inside a group.

    ``forced`` marks fills with an operational cause (lost eligibility, event, trapped exit).
    """
    names = sets.select(key, index, entity, (F.col("in_prior") & F.col("in_current")).alias("retained_name"))
    groups = sets.join(mapping.select(entity, group), entity).groupBy(key, index, group).agg(
        F.max("in_prior").alias("_gp"), F.max("in_current").alias("_gc"))
    t = trades.join(mapping.select(entity, group), entity, "left").join(names, [key, index, entity], "left").join(groups, [key, index, group], "left")
    moved = ((F.col("side") == "BUY") & ~yes("_gp")) | ((F.col("side") == "SELL") & ~yes("_gc"))
    kind = (
        F.when(yes(forced), "FORCED_OPERATIONAL").when(yes("retained_name"), "WEIGHT_REBALANCING").when(moved, "SECTOR_ENTRY_EXIT")
        .otherwise("WITHIN_SECTOR_STOCK_REPLACEMENT"))
    equity = rebalances.select(key, index, "pretrade_equity")
    return (
        t.withColumn("turnover_class", kind).join(equity, [key, index])
        .withColumn("normalized_turnover", ratio("notional", "pretrade_equity"))
        .withColumn("all_in_cost", F.col("transaction_cost") + F.col("slippage_cost"))
        .drop("_gp", "_gc")
    )


def turnover_shares(attributed: DataFrame, *, by: list[str]) -> DataFrame:
    """Notional, cost and share of notional per class inside each ``by`` group."""
    sums = attributed.groupBy(*by, "turnover_class").agg(
        F.sum("notional").alias("notional"), F.sum("normalized_turnover").alias("normalized_turnover"), F.sum("all_in_cost").alias("all_in_cost"),
        F.count(F.lit(1)).alias("trades"))
    total = F.sum("notional").over(W.partitionBy(*by))  # at most four classes
    return sums.withColumn("notional_share", ratio("notional", total))


def weight_drift(
    sets: DataFrame, positions: DataFrame, prices: DataFrame, rebalances: DataFrame, *, key: str = PORTFOLIO, index: str = "rebalance_index",
    entity: str = "entity", session: str = "session", price: str = "open",
) -> DataFrame:
    """Weight of retained names just before a rebalance against the equal target.

    Shares are those of the session before; the mark is the open of the execution
    session, else the previous close.
    """
    line = rebalances.select(key, index, session, "previous_session", "pretrade_equity")
    size = sets.where("in_current").groupBy(key, index).agg(F.count(F.lit(1)).alias("_n"))
    kept = sets.where("in_prior AND in_current").join(line, [key, index]).join(size, [key, index])
    prev = positions.select(key, F.col(session).alias("previous_session"), entity, "shares", F.col("close").alias("_last"))
    opens = prices.where(F.col(price) > 0).select(entity, session, F.col(price).alias("_open"))
    j = kept.join(prev, [key, "previous_session", entity]).join(opens, [entity, session], "left")
    pre = ratio(F.col("shares") * F.coalesce("_open", "_last"), "pretrade_equity")
    target = 1 / F.col("_n")
    return j.select(key, index, entity, pre.alias("pre_weight"), target.alias("target_weight"), F.abs(target - pre).alias("absolute_deviation"))


def exception_audit(
    anomalies: DataFrame, trades: DataFrame, positions: DataFrame, *, key: str = PORTFOLIO, entity: str = "entity", session: str = "session"
) -> DataFrame:
    """Incidents per name: counts by type, first and last, eventual exit and sessions spent trapped."""
    kinds = {"STALE_MARK": "stale_marks", "UNEXECUTABLE_EXIT": "unavailable_exits", "PREVENTED_ENTRY": "prevented_entries"}
    by = [key, entity]
    core = F.when(F.col("type").isin("STALE_MARK", "UNEXECUTABLE_EXIT"), F.col(session))
    base = anomalies.groupBy(*by).agg(
        *[F.count_if(F.col("type") == k).alias(v) for k, v in kinds.items()], F.min(session).alias("first_incident"),
        F.max(session).alias("last_incident"), F.min(core).alias("_a"), F.max(core).alias("_b"))
    sold = trades.where(F.col("side") == "SELL").select(*by, F.col(session).alias("_s")).join(
        positions.select(*by, F.col(session).alias("_s")), [*by, "_s"], "left_anti")
    exits = sold.join(base.select(*by, "_b"), by).where(F.col("_s") > F.col("_b")).groupBy(*by).agg(F.min("_s").alias("eventual_exit"))
    out = base.join(exits, by, "left")
    stay = positions.select(*by, session).join(out.select(*by, "_a", "eventual_exit"), by).where(
        (F.col(session) >= F.col("_a")) & (F.col("eventual_exit").isNull() | (F.col(session) <= F.col("eventual_exit"))))
    trapped = stay.groupBy(*by).agg(F.count(F.lit(1)).alias("trapped_sessions"))
    return out.join(trapped, by, "left").fillna(0, ["trapped_sessions"]).drop("_a", "_b")


def benchmark_return(equity: DataFrame, prices: DataFrame, benchmark: str, *, key: str = PORTFOLIO, session: str = "session", entity: str = "entity") -> DataFrame:
    """Open-to-close return of one name over exactly the span of each curve; NULL if an end is missing."""
    span = equity.groupBy(key).agg(F.min(session).alias("start_session"), F.max(session).alias("end_session"))
    one = prices.where(F.col(entity) == benchmark)
    first = one.select(F.col(session).alias("start_session"), F.col("open").alias("_o"))
    last = one.select(F.col(session).alias("end_session"), F.col("close").alias("_c"))
    return span.join(first, "start_session", "left").join(last, "end_session", "left").select(
        key, "start_session", "end_session", (ratio("_c", "_o") - 1).alias("benchmark_return"))
