"""Order screening as table work: costs, sizing, profiles, portfolios, and the checks of every order in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Profile figures at level 0 and level 100 (fixed values).
PROFILE = {
    "risk_per_trade": (0.0025, 0.02), "max_position_pct": (0.10, 0.35), "max_portfolio_exposure": (0.30, 0.90), "min_edge_score": (60.0, 20.0), "min_confidence": (0.95, 0.80), "min_expected_net_edge": (0.004, 0.001),
    "max_drawdown": (0.08, 0.25), "max_daily_loss": (0.01, 0.04), "max_positions": (2.0, 8.0), "max_consecutive_losses": (3.0, 8.0), "kelly_coefficient": (0.10, 0.50), "cash_reserve": (0.50, 0.10), "max_spread_pct": (0.002, 0.006), "max_slippage_pct": (0.002, 0.005),
}
#: Absolute limits of the same figures: at most, or at least (fixed values).
AT_MOST = {"risk_per_trade": 0.02, "max_position_pct": 0.40, "max_portfolio_exposure": 1.0, "max_drawdown": 0.30, "max_daily_loss": 0.05, "max_positions": 10.0, "kelly_coefficient": 0.5, "max_consecutive_losses": 10.0, "max_spread_pct": 0.01, "max_slippage_pct": 0.01}
AT_LEAST = {"cash_reserve": 0.05, "min_edge_score": 10.0, "min_confidence": 0.75, "min_expected_net_edge": 0.0005}
MAX_DATA_AGE, MAX_PARTICIPATION, MIN_NOTIONAL = 900.0, 0.005, 1.0


def profile(level: Column) -> dict[str, Column]:
    """Figures of an aggressiveness level from 0 to 100, held to the absolute limits; counts round half to even."""
    out = {}
    for name, (low, high) in PROFILE.items():
        x = F.lit(low) + F.lit(high - low) * level / 100
        x = F.bround(x) if name in ("max_positions", "max_consecutive_losses") else x
        x = F.least(x, F.lit(AT_MOST[name])) if name in AT_MOST else x
        out[name] = F.greatest(x, F.lit(AT_LEAST[name])) if name in AT_LEAST else x
    return out


def profile_violations(prefix: str = "") -> Column:
    """Names of figures beyond the absolute limits."""
    tests = [(n, F.col(prefix + n) > m + 1e-12) for n, m in AT_MOST.items()] + [(n, F.col(prefix + n) < m - 1e-12) for n, m in AT_LEAST.items()]
    tests += [("risk_per_trade", F.col(prefix + "risk_per_trade") <= 0), ("cash_reserve", F.col(prefix + "cash_reserve") >= 1), ("max_positions", F.col(prefix + "max_positions") < 1)]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests)))))


def side_cost(fee: Column, fx: Column, fixed: Column, notional: Column) -> Column:
    """Cost of one side as a fraction of its notional."""
    return fee + fx + F.when(notional > 0, fixed / F.nullif(notional, F.lit(0.0))).otherwise(0.0)


def trade_costs(spread: Column, slippage: Column, side: Column) -> dict[str, Column]:
    """Effective prices for ``price``, and the whole round trip; negative figures are an error, not a discount."""
    bad = (spread < 0) | (slippage < 0) | (side < 0)
    held = lambda c: F.when(bad, F.raise_error(F.lit("costs must not be negative"))).otherwise(c)
    p = F.col("price")
    return {"buy_price": held(p * (1 + spread / 2 + slippage)), "sell_price": held(p * (1 - spread / 2 - slippage)), "effective_buy": held(p * (1 + spread / 2 + slippage) * (1 + side)), "effective_sell": held(p * (1 - spread / 2 - slippage) * (1 - side)), "round_trip": held(spread + 2 * slippage + 2 * side)}


def fx_cost(instrument: Column, account: Column, fee: float = 0.0015) -> Column:
    """A conversion fee a side where currencies differ."""
    return F.when(F.upper(instrument) != F.upper(account), F.lit(fee)).otherwise(0.0)


def sizing() -> dict[str, Column]:
    """Notional of an order from equity, ask, stop, p_win, avg_win, avg_loss, risk_per_trade and kelly_coefficient; ``size_error`` says what rules it out."""
    c = F.col
    error = F.when(c("equity") <= 0, "equity").when((c("ask") <= 0) | (c("stop") <= 0), "prices").when(c("stop") >= c("ask"), "stop above entry").when((c("risk_per_trade") <= 0) | (c("risk_per_trade") >= 1), "risk").when((c("p_win") < 0) | (c("p_win") > 1), "p_win")
    distance = (c("ask") - c("stop")) / F.nullif("ask", F.lit(0.0))
    by_risk = c("equity") * c("risk_per_trade") / F.nullif(distance, F.lit(0.0))
    kelly = F.when((c("avg_win") > 0) & (c("avg_loss") > 0), F.greatest(F.lit(0.0), c("p_win") - (1 - c("p_win")) * c("avg_loss") / F.nullif("avg_win", F.lit(0.0)))).otherwise(0.0)
    by_kelly = c("equity") * kelly * c("kelly_coefficient")
    return {"size_error": error, "stop_distance": distance, "risk_notional": by_risk, "full_kelly": kelly, "kelly_notional": by_kelly, "requested": F.when(error.isNull(), F.least(by_risk, by_kelly)), "limited_by": F.when(error.isNull(), F.when(by_kelly < by_risk, "fractional_kelly").otherwise("risk_per_trade"))}


def portfolio_values(positions: str = "positions") -> dict[str, Column]:
    """Derived values of a portfolio whose positions map symbols to (quantity, market_price); cash, equity_peak and day_start beside it."""
    value = F.aggregate(F.map_values(positions), F.lit(0.0), lambda s, p: s + p["quantity"] * p["market_price"])
    equity = F.col("cash") + value
    peak = F.greatest("equity_peak", equity)
    return {
        "positions_value": value, "equity": equity, "exposure": F.when(equity > 0, value / F.nullif(equity, F.lit(0.0))).otherwise(0.0), "drawdown": F.when(peak > 0, equity / F.nullif(peak, F.lit(0.0)) - 1).otherwise(0.0),
        "daily_pnl": F.when(F.col("day_start") > 0, equity / F.nullif("day_start", F.lit(0.0)) - 1).otherwise(0.0), "open_positions": F.size(F.filter(F.map_values(positions), lambda p: p["quantity"] > 0)),
    }


def daily_volume(known: Column, per_second: Column) -> Column:
    """Average daily volume, or what a second's volume amounts to in a day."""
    return F.coalesce(known, per_second * 86_400)


def _check(name: str, passed: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"))


def checked(orders: DataFrame) -> DataFrame:
    """Adds ``checks``, (name, passed) of every check before sizing, in a fixed order; one that a kind of order does not meet is absent."""
    c = F.col
    spread = F.when(c("bid") + c("ask") > 0, (c("ask") - c("bid")) / ((c("bid") + c("ask")) / 2)).otherwise(float("inf"))
    sell, known = c("side") == "sell", c("evidence_strategy").isNotNull()
    net_edge = c("gross_edge") - spread - 2 * c("slippage") - c("fees")
    stop_fine = (c("stop") > 0) & (c("stop") < F.least("entry_price", "ask"))
    tests: list[tuple[str, Column, Column]] = [
        ("kill_switch", F.lit(True), ~c("kill_switch")), ("api_health", F.lit(True), c("api_healthy")), ("reconciliation", F.lit(True), c("reconciled")), ("stale_data", F.lit(True), c("data_age").between(0, MAX_DATA_AGE)),
        ("trading_hours", F.lit(True), c("market_open")), ("duplicate_order", F.lit(True), ~F.array_contains("pending", c("order_key"))), ("symbol_match", F.lit(True), c("market_symbol") == c("symbol")), ("valid_quote", F.lit(True), (c("bid") > 0) & (c("ask") >= c("bid"))),
        ("no_short_selling", sell, c("held") > 0), ("max_daily_loss", ~sell, c("daily_pnl") > -c("max_daily_loss")), ("max_drawdown", ~sell, c("drawdown") > -c("max_drawdown")), ("consecutive_losses", ~sell, c("consecutive_losses") < c("max_consecutive_losses")),
        ("max_positions", ~sell, (c("held") > 0) | (c("open_positions") < c("max_positions"))), ("max_spread", ~sell, spread <= c("max_spread_pct")), ("max_slippage", ~sell, c("slippage") <= c("max_slippage_pct")), ("min_liquidity", ~sell, c("adv") > 0),
        ("evidence", ~sell & ~known, F.lit(False)), ("evidence_strategy", ~sell & known, c("evidence_strategy") == c("strategy")), ("min_edge_score", ~sell & known, c("edge_score") >= c("min_edge_score")), ("min_confidence", ~sell & known, c("confidence") >= c("min_confidence")),
        ("min_expected_net_edge", ~sell & known, net_edge >= c("min_expected_net_edge")), ("valid_stop", ~sell, stop_fine),
    ]
    return orders.withColumn("checks", F.array_compact(F.array(*(F.when(applies, _check(name, passed)) for name, applies, passed in tests))))


def screen(orders: DataFrame) -> DataFrame:
    """Checks, ``action`` (APPROVE, ADJUST_SIZE or REJECT), ``quantity``, ``notional`` and ``adjustments`` of every order.

    orders: one row an order with its market, portfolio, evidence and profile figures joined; evidence_strategy null: no evidence.
    Checks come in a fixed order; caps apply one after the other: position, exposure, cash reserve, liquidity. A check that a kind of
    order does not meet (edge and exposure for sells) is absent.
    """
    c, sell = F.col, F.col("side") == "sell"
    rows = checked(orders).withColumn("_fine", F.forall("checks", lambda x: x["passed"])).withColumns(sizing())
    caps = {
        "max_position_pct": c("equity") * c("max_position_pct") - c("held") * c("held_price"), "max_portfolio_exposure": c("equity") * c("max_portfolio_exposure") - c("positions_value"),
        "cash_reserve": c("cash") - c("equity") * c("cash_reserve"), "liquidity": c("adv") * c("ask") * MAX_PARTICIPATION,
    }
    rows = rows.withColumn("_n", F.when(c("_fine") & ~sell, c("requested"))).withColumn("adjustments", F.array().cast("array<string>"))
    for name, cap in caps.items():
        over = c("_n") > cap
        rows = rows.withColumns({"adjustments": F.when(over, F.array_append("adjustments", F.lit(name))).otherwise(c("adjustments")), "_n": F.when(over, F.greatest(cap, F.lit(0.0))).otherwise(c("_n"))})
    rows = rows.withColumn("_q", F.floor(c("_n") / F.nullif("ask", F.lit(0.0)) / c("step")) * c("step")).withColumn("_v", c("_q") * c("ask"))
    small = c("_v") < MIN_NOTIONAL
    capped = c("_q") * (c("ask") - c("stop")) <= c("equity") * F.least(c("risk_per_trade"), F.lit(AT_MOST["risk_per_trade"])) * (1 + 1e-9)
    last = F.when(c("_fine") & ~sell, F.when(small, _check("min_order_notional", F.lit(False))).otherwise(_check("max_risk_per_trade", capped)))
    rows = rows.withColumn("checks", F.array_compact(F.array_append("checks", last)))
    passed = F.forall("checks", lambda x: x["passed"])
    action = F.when(~passed, "REJECT").when(sell, "APPROVE").when(F.size("adjustments") > 0, "ADJUST_SIZE").otherwise("APPROVE")
    rows = rows.withColumn("action", action)
    taken = c("action") != "REJECT"
    quantity = F.when(taken, F.when(sell, c("held")).otherwise(c("_q"))).otherwise(0.0)
    rows = rows.withColumn("quantity", quantity).withColumn("notional", F.when(taken, F.when(sell, c("held") * c("bid")).otherwise(c("_v"))).otherwise(0.0))
    return rows.withColumn("failed", F.transform(F.filter("checks", lambda x: ~x["passed"]), lambda x: x["name"])).drop("_fine", "_n", "_q", "_v")


def session_bounds(ts: Column, holidays: tuple[str, ...] = (), zone: str = "America/New_York") -> dict[str, Column]:
    """Is the regular session open, the seconds to its close (null when closed), and the next time it opens within ten days."""
    local = F.from_utc_timestamp(ts, zone)
    trading = lambda day: (F.weekday(day) < 5) & ~F.array_contains(F.array(*map(F.lit, holidays)).cast("array<string>"), day.cast("string"))
    day = F.to_date(local)
    at = F.unix_micros(local) - F.unix_micros(day.cast("timestamp"))
    open_, close = 34_200_000_000, 57_600_000_000
    is_open = trading(day) & (at >= open_) & (at < close)
    # The calendar of the days ahead is a short array a row, not a table.
    days = F.filter(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: F.date_add(day, k)), lambda d: trading(d) & ((d > day) | (at < open_)))
    opens = F.to_utc_timestamp(F.timestamp_micros(F.unix_micros(F.get(days, F.lit(0)).cast("timestamp")) + open_), zone)
    return {"is_open": is_open, "seconds_to_close": F.when(is_open, (F.lit(close) - at) / 1e6), "next_open": opens}


def session_gates(seconds_to_close: Column, swing: Column) -> dict[str, Column]:
    """No intraday entry in the last quarter of an hour, and intraday positions flat five minutes before the close."""
    return {"may_enter": swing | (seconds_to_close > 900), "must_flatten": ~swing & (seconds_to_close <= 300)}
