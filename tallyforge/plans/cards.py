"""Queries over card statements and payoff."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import cards as c
from tallyforge.operators import payoff as p
from tallyforge.plans.registry import cents, query
from tallyforge.sources.tables import ORDERS_AS_OF

K = "card_issuer, card_last_four"
_LATEST = f"lt as (select * from (select *, row_number() over (partition by {K} order by statement_date desc, ord) as rn from st) where rn = 1)"


@query("latest_statement", "st", f"with {_LATEST} select {K}, statement_date, round(total_due * 100)::bigint as due from lt")
def latest_statement(st):
    return c.latest(st).select(*c.CARD, "statement_date", cents("total_due").alias("due"))


_UT = f"{_LATEST}, ut as (select {K}, case when credit_limit > 0 then total_due::double / credit_limit::double else 0 end as utilization, (sum(total_due) over ())::double / (sum(credit_limit) over ())::double as overall from lt)"


@query("utilization", "st", f"with {_UT} select {K}, utilization, overall, case when utilization <= 0.1 then 'excellent' when utilization <= 0.3 then 'good' when utilization <= 0.5 then 'fair' else 'high' end as band from ut")
def utilization(st):
    return c.utilization(st).select(*c.CARD, "utilization", "overall", c.utilization_band(F.col("utilization")).alias("band"))


@query("due_dates", "st", f"with {_LATEST} select {K}, payment_due_date, round(total_due * 100)::bigint as due, (payment_due_date - date '2001-08-02')::int as days_left, payment_due_date < date '2001-08-02' as overdue from lt where not is_paid")
def due_dates(st):
    return c.due_dates(st, ORDERS_AS_OF[:10]).select(*c.CARD, "payment_due_date", cents("total_due").alias("due"), "days_left", "overdue")


_BEH = "b as (select count(*) as n, count(*) filter (payments_received >= total_due) as f, count(*) filter (late_fee = 0) as o, sum(interest_charged) as i from st where statement_date >= date '2000-08-01')"


@query("payment_behavior", "st", f'with {_BEH} select n, f as "full", o as on_time, round(i * 100)::bigint as interest from b')
def payment_behavior(st):
    return c.payment_behaviour(st, ORDERS_AS_OF[:10]).select("n", "full", "on_time", cents("interest").alias("interest"))


@query("cashback", "st", f"select {K}, round(sum(cashback_earned) * 100)::bigint as cashback, round(sum(total_due) * 100)::bigint as spend, case when sum(total_due) > 0 then sum(cashback_earned)::double / sum(total_due)::double else 0 end as rate from st group by all")
def cashback(st):
    return c.cashback(st).select(*c.CARD, cents("cashback").alias("cashback"), cents("spend").alias("spend"), "rate")


@query("reward_points", "st", f"select {K}, sum(points_earned)::bigint as earned, sum(points_redeemed)::bigint as redeemed, list_reduce(list(points_earned::double / total_due::double order by ord) filter (points_earned > 0), lambda a, x: (a + x) / 2) as smoothed, (sum(points_earned) - sum(points_redeemed))::double * 0.2 as value from st group by all")
def reward_points(st):
    return c.reward_points(st)


@query("card_comparison", "od st", f"with {_UT}, b as (select {K}, category, sum(amount) as t, count(*) as c from od where source_type = 'credit_card' group by all), r as (select *, row_number() over (partition by {K} order by t desc, category) as place from b), s as (select {K}, sum(t) as total, sum(c)::bigint as n, string_agg(category, ',' order by place) filter (place <= 3) as top_categories from r group by all) select {K}, round(coalesce(total, 0) * 100)::bigint as total, coalesce(n, 0) as n, utilization, coalesce(top_categories, '') as top_categories from ut left join s using ({K})")
def card_comparison(od, st):
    return c.compare_cards(od, st).select(*c.CARD, cents("total").alias("total"), "n", "utilization", "top_categories")


@query("true_balance", "od st", f"with {_LATEST} select round((i - e - o) * 100)::bigint as balance, round(o * 100)::bigint as owed from (select sum(amount) filter (category_type = 'Income' and source_type = 'bank') as i, sum(amount) filter (category_type = 'Expense' and source_type = 'bank') as e from od), (select sum(total_due) as o from lt)")
def true_balance(od, st):
    return c.true_balance(od, st).select(cents("balance").alias("balance"), cents("owed").alias("owed"))


_RUNS = f"q as (select *, payments_received * 100 < total_due * 95 as short, row_number() over (partition by {K} order by statement_date, ord) as a from st), w as (select *, row_number() over (partition by {K}, short order by statement_date, ord) as b from q), i as (select {K}, short, a - b as island, count(*) as len from w group by all), runs as (select {K}, coalesce(max(len) filter (short), 0) as longest, sum(len)::bigint as n from i group by all)"


@query("revolving_runs", "st", f"with {_RUNS} select * from runs")
def revolving_runs(st):
    return c.revolving_runs(st)


@query("balance_trend", "st", f"with x as (select {K}, (statement_date - min(statement_date) over (partition by {K})) / 30.0 as x, total_due::double as y from st), t as (select {K}, count(*) as n, case when count(*) >= 2 and avg(y) <> 0 then coalesce(regr_slope(y, x), 0) / avg(y) else 0 end as trend from x group by all) select {K}, n, floor(trend * 1000000 + 0.5)::bigint as trend_millionths from t")
def balance_trend(st):
    return c.balance_trend(st).select(*c.CARD, "n", F.floor(F.col("trend") * 1_000_000 + 0.5).alias("trend_millionths"))


_STATUS = f"{_RUNS}, s0 as (select {K}, count(*) as n, count(*) filter (payments_received * 100 >= total_due * 95) as f, count(*) filter (payments_received > 0 and payments_received * 100 <= minimum_due * 105) as m, sum(total_due) as owed from st group by all), s1 as (select s0.*, longest, f::double / s0.n as full_rate from s0 join runs using ({K})), s2 as (select *, case when full_rate >= 0.9 and longest < 3 then 'none' when full_rate >= 0.7 and longest < 6 then 'low' when full_rate >= 0.5 and longest < 12 then 'medium' else 'high' end as risk from s1)"


@query("revolving_status", "st", f"with {_STATUS} select {K}, n, longest, full_rate, 2 * (n - f) > n as revolving, 2 * m > n as minimum_only, risk from s2")
def revolving_status(st):
    return c.revolving_status(st).select(*c.CARD, "n", "longest", "full_rate", "revolving", "minimum_only", "risk")


@query("debt_trap", "st", f"with {_STATUS} select count(*) filter (risk <> 'none') as cards, sum(floor(owed::double / n + 0.5)::bigint) filter (risk <> 'none')::bigint as owed, case when count(*) filter (risk = 'high') >= 2 then 'critical' when count(*) filter (risk = 'high') = 1 then 'high' when count(*) filter (risk = 'medium') > 0 then 'medium' when count(*) filter (risk = 'low') > 0 then 'low' else 'none' end as worst from s2")
def debt_trap(st):
    return c.debt_trap(st)


@query("credit_health", "st", f'with {_UT}, {_BEH}, x as (select n, f, o, f::double / n as fr, o::double / n as otr, (select max(overall) from ut) as u from b) select n, f as "full", o as on_time, floor((case when u <= 0.1 then 100 when u <= 0.3 then 80 when u <= 0.5 then 60 else 40 end) * 0.40::double + fr * 100 * 0.35::double + otr * 100 * 0.15::double + (case when otr >= 0.5 then 100 else 50 end) * 0.10::double + 0.5)::int as score from x')
def credit_health(st):
    return c.credit_health(st, ORDERS_AS_OF[:10])


def _debts(st):
    return c.latest(st).filter("total_due > 0").select("ord", *c.CARD, "total_due", F.lit(0.408).alias("apr"), F.col("total_due").cast("double").alias("balance"))


def _sim_sql(pay: str, start: str = "total_due::double * 0 ", most: int = 600) -> str:
    """A recursive month by month account of each debt; ``pay`` from b, due and p (the fixed payment)."""
    due = "(b + b * 0.408::double / 12)"
    left = f"({due} - least({pay}, {due}))"
    return f"with recursive {_LATEST}, sim as (select ord, 0 as m, total_due::double as b, 0.0::double as i, {start} as p from lt where total_due > 0 union all select ord, m + 1, case when {left} < 1 then 0 else {left} end, i + b * 0.408::double / 12, p from sim where b > 0 and m < {most}) select ord, max(m)::int as months, floor(max(i) * 100 + 0.5)::bigint as interest_cents from sim group by ord"


@query("payoff_minimum", "st", _sim_sql("greatest((b + b * 0.408::double / 12) * 0.05::double, 200.0::double)"))
def payoff_minimum(st):
    f = p.minimum_payoff(F.col("total_due"), F.col("apr"))
    return _debts(st).withColumn("f", f).select("ord", F.col("f.m").alias("months"), F.floor(F.col("f.i") * 100 + 0.5).alias("interest_cents"))


@query("payoff_fixed", "st", _sim_sql("p", "ceil(total_due::double * 0.06::double)::double"))
def payoff_fixed(st):
    pay = F.ceil(F.col("balance") * 0.06)
    return _debts(st).withColumn("f", p.fixed_payoff(F.col("total_due"), F.col("apr"), pay)).select("ord", F.col("f.m").alias("months"), F.floor(F.col("f.i") * 100 + 0.5).alias("interest_cents"))


_DUE_408 = "(b + b * 0.408::double / 12)"
_LEFT_P = f"({_DUE_408} - least(p, {_DUE_408}))"


@query("interest_projection", "st", f"with recursive {_LATEST}, sim as (select ord, scale, 0 as m, total_due::double as b, 0.0::double as i, ceil(greatest(total_due::double * 0.05::double, 200.0::double) * scale)::bigint as p, total_due::double * 0.408::double / 12 as first from lt, (select unnest([1.1::double, 1.25::double, 1.5::double, 2.0::double]) as scale) where total_due > 0 union all select ord, scale, m + 1, case when {_LEFT_P} < 1 then 0 else {_LEFT_P} end, i + b * 0.408::double / 12, p, first from sim where b > 0 and m < 600 and p > first) select ord, scale, max(p) as payment, max(m)::int as months, floor(max(i) * 100 + 0.5)::bigint as interest_cents from sim group by ord, scale having max(p) > max(first)")
def interest_projection(st):
    return p.projections(_debts(st)).select("ord", "scale", "payment", "months", F.floor(F.col("interest") * 100 + 0.5).alias("interest_cents"))


def _strategy_sql(order: str) -> str:
    return f"""with {_LATEST}, d as (select ord, card_issuer, total_due::double as b, least(greatest(total_due::double * 0.05::double, 200.0::double), total_due::double) as l, 0.3::double + (ord % 7)::double / 100 as apr from lt where total_due > 0),
 w as (select *, coalesce(sum(l) over x, 0) as lb, sum(l) over (partition by card_issuer) as lt, coalesce(sum(b - l) over x, 0) as ob, row_number() over (partition by card_issuer order by {order}) as priority from d window x as (partition by card_issuer order by {order} rows between unbounded preceding and 1 preceding))
 select ord, priority::int as priority, floor((least(l, greatest(0.0::double, 2000000 - lb)) + least(b - l, greatest(0.0::double, greatest(0.0::double, 2000000 - lt) - ob))) * 100 + 0.5)::bigint as cents from w"""


@query("strategy_avalanche", "st", _strategy_sql("apr desc, ord"))
def strategy_avalanche(st):
    d = _debts(st).withColumn("apr", F.lit(0.3) + (F.col("ord") % 7) / 100)
    return p.strategy(d, 2_000_000, "avalanche", ["card_issuer"]).select("ord", "priority", F.floor(F.col("payment") * 100 + 0.5).alias("cents"))


@query("strategy_snowball", "st", _strategy_sql("b, ord"))
def strategy_snowball(st):
    return p.strategy(_debts(st), 2_000_000, "snowball", ["card_issuer"]).select("ord", "priority", F.floor(F.col("payment") * 100 + 0.5).alias("cents"))


@query("debt_free_months", "st", f"with recursive {_LATEST}, d as (select card_issuer, sum(total_due)::double as t from lt where total_due > 0 group by 1), sim as (select card_issuer, 0 as m, t as b, t * 0.05::double as p from d union all select card_issuer, m + 1, b * (1 + 0.408::double / 12) - p, p from sim where b > 0 and m < 120) select card_issuer, max(m)::int as months from sim group by 1")
def debt_free_months(st):
    return _debts(st).groupBy("card_issuer").agg(F.sum("balance").alias("total")).select("card_issuer", p.debt_free_months(F.col("total"), F.lit(0.408), F.col("total") * 0.05).alias("months"))
