"""Fees, expected value, sizing and settlement arithmetic as Column expressions.

Prices are cents of a one-dollar contract.
"""

from pyspark.sql import functions as F

from .timeutil import col

# Taker fee rate and the sizing defaults.
TAKER_RATE = 0.07
BANKROLL = 10000.0
KELLY_FRACTION = 0.25
MAX_BET = 50.0
MAX_CONTRACTS = 100


def taker_fee_cents(price, n=1):
    """Fee of the whole order, rounded up to a cent."""
    p = col(price) / 100.0
    n = n if not isinstance(n, str) else F.col(n)
    return F.ceil(TAKER_RATE * p * n * (1 - p) * 100).cast("long")


def taker_fee_usd(price, n=1):
    """Unrounded dollar variant; zero outside the open price range."""
    p = col(price)
    n = n if not isinstance(n, str) else F.col(n)
    return F.when((p <= 0) | (p >= 100), 0.0).otherwise(TAKER_RATE * p * (100 - p) / 100 / 100 * n)


def liquidity_role(side, action, price, bid, ask):
    """taker when the order crosses the book of its side, else maker."""
    side, action, p, b, a = (col(c) for c in (side, action, price, bid, ask))
    yes, buy = side == "yes", action == "buy"
    crosses = (F.when(yes & buy, p >= a).when(yes, p <= b)
               .when(buy, p >= 100 - b).otherwise(p <= 100 - a))
    return F.when(crosses, "taker").otherwise("maker")


def expected_value(side, action, price, prob, role):
    """Cents per contract, net of the role's fee."""
    side, action, p, q, role = (col(c) for c in (side, action, price, prob, role))
    fee = F.when(role == "taker", taker_fee_cents(p)).otherwise(0)
    worth = F.when(side == "yes", q * 100).otherwise((1 - q) * 100)
    return F.when(action == "buy", worth - p - fee).otherwise(p - worth - fee)


def best_trade(prob, bid, ask, min_ev=3.0, fill_prob=0.4):
    """Best of take/make x buy/sell as a struct (ev, rank, action, price, role), or NULL.

    Earlier candidates win ties: take-buy, make-buy, take-sell, make-sell.
    """
    q, b, a = col(prob), col(bid), col(ask)
    fill = col(fill_prob) if isinstance(fill_prob, str) else F.lit(fill_prob)

    def cand(rank, action, price, role, ev, cond):
        s = F.struct(ev.alias("ev"), F.lit(-rank).alias("rank"), F.lit(action).alias("action"),
                     price.cast("long").alias("price"), F.lit(role).alias("role"))
        return F.when(cond & (ev >= min_ev), s)

    wide = (a - b) > 1
    c = [
        cand(0, "buy", a, "taker", q * 100 - a - taker_fee_cents(a), F.lit(True)),
        cand(1, "buy", b + 1, "maker", (q * 100 - (b + 1)) * fill, wide),
        cand(2, "sell", b, "taker", b - q * 100 - taker_fee_cents(b), F.lit(True)),
        cand(3, "sell", a - 1, "maker", ((a - 1) - q * 100) * fill, wide),
    ]
    return F.when(valid_quote(b, a), F.greatest(*c))


def valid_quote(bid, ask):
    b, a = col(bid), col(ask)
    return (b > 0) & (a < 100) & (a > b)


def contracts_for_budget(price, budget):
    """Whole contracts a budget buys, at least one; zero for a free price."""
    cost = col(price) / 100
    return F.when(cost <= 0, 0).otherwise(F.greatest(F.floor(F.lit(budget) / cost), F.lit(1))).cast("long")


def kelly_size(ev, price, prob, std, position, bankroll=BANKROLL, fraction=KELLY_FRACTION,
               max_bet=MAX_BET, max_contracts=MAX_CONTRACTS):
    """Fractional-Kelly contracts and the cap that bound them, as (contracts, capped_by)."""
    ev, p, q, std, pos = col(ev), col(price) / 100.0, col(prob), col(std), col(position)
    var = q * (1 - q)
    f = F.when(var > 0, (ev / 100.0 / p) / var).otherwise(0.0) * fraction
    f = F.least(f, F.lit(0.1))
    f = f * F.when(std > 3.0, F.greatest(F.lit(0.25), 1.0 - (std - 3.0) * 0.25)).otherwise(1.0)
    want = F.floor(f * bankroll / p)
    bet_cap = F.floor(max_bet / p)
    room = F.lit(max_contracts) - pos
    n = F.least(want, bet_cap, room)
    capped = (F.when(n == 0, "minimum").when(F.least(want, bet_cap) > room, "max_position")
              .when(want > bet_cap, "max_bet_size"))
    return (F.when(ev <= 0, 0).when(n == 0, 1).otherwise(n).cast("long"),
            F.when(ev > 0, capped))


def held_pnl(price, n, won, fee=0.0):
    p = col(price) / 100
    return F.when(col(won), col(n) * (1.0 - p)).otherwise(-col(n) * p) - (col(fee) if isinstance(fee, str) else fee)


def exit_pnl(price, exit_price, n, fee=0.0):
    return col(n) * (col(exit_price) / 100 - col(price) / 100) - fee


def outcome_pnl(side, action, price, won):
    """Cents per contract for the four side x action cases."""
    pays = F.when((col(side) == "yes") == col(won), 100).otherwise(0)
    return F.when(col(action) == "buy", pays - col(price)).otherwise(col(price) - pays)
