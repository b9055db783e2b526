"""Queries over the grouped analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import spending as s
from tallyforge.plans.registry import cents, query
from tallyforge.sources.tables import ORDERS_AS_OF

tot = lambda x="amount": f"round(sum({x}) * 100)::bigint"


@query("explorer_filter", "ev", "select id, date, round(amount * 100)::bigint as cents from ev where lower(description) like '%user 1%' and category_type = 'Expense' and date >= '2024-01-05' and date <= '2024-01-20'")
def explorer_filter(ev):
    return s.explore(ev, search="User 1", kind="expense", date_from="2024-01-05", date_to="2024-01-20").select("id", "date", cents("amount").alias("cents"))


@query("transaction_flags", "od", "select id, category_type = 'Income' as is_income, category_type = 'Expense' as is_expense, category_type = 'Excluded' as is_excluded, round(case when type = 'credit' then amount else -amount end * 100)::bigint as signed_cents from od")
def transaction_flags(od):
    return s.flags(od).select("id", "is_income", "is_expense", "is_excluded", cents("signed_amount").alias("signed_cents"))


@query("date_range_totals", "od", f"select {tot()} as cents, count(*) as n from od where date between '1996-01-01' and '1997-12-31' and category_type = 'Expense'")
def date_range_totals(od):
    return s.explore(od, date_from="1996-01-01", date_to="1997-12-31", kind="expense").agg(cents(F.sum("amount")).alias("cents"), F.count(F.lit(1)).alias("n"))


@query("month_income_expense", "ev", f"select strftime(date, '%Y-%m') as month, {tot('case when category_type = $$Income$$ then amount else 0 end')} as income, {tot('case when category_type = $$Income$$ then 0 else amount end')} as expense from ev group by 1")
def month_income_expense(ev):
    return s.by_month(ev).select("month", cents("income").alias("income"), cents("expense").alias("expense"))


@query("category_totals", "ev", f"select category, {tot()} as total, count(*) as n, {tot()}::double / count(*) as mean_cents from ev group by 1")
def category_totals(ev):
    return s.by_category(ev).select("category", cents("total").alias("total"), "n", (cents("total").cast("double") / F.col("n")).alias("mean_cents"))


@query("category_month_totals", "od", f"select category, strftime(date, '%Y-%m') as month, {tot()} as total from od where category_type = 'Expense' group by all")
def category_month_totals(od):
    return s.by_category_month(od).select("category", "month", cents("total").alias("total"))


@query("category_month_share", "ev", "select category, strftime(date, '%Y-%m') as month, round(sum(amount) * 100)::bigint as total, sum(amount)::double / (sum(sum(amount)) over ())::double as share from ev where category_type = 'Expense' group by all")
def category_month_share(ev):
    return s.with_share(s.by_category_month(ev)).select("category", "month", cents("total").alias("total"), "share")


@query("day_of_week_dense", "ev", "select d::int as day, coalesce(round(sum(amount) * 100), 0)::bigint as total from (select unnest(range(7)) as d) left join ev on dayofweek(date) = d and category_type = 'Expense' group by 1")
def day_of_week_dense(ev):
    return s.by_weekday(ev).select("day", cents("total").alias("total"))


@query("top_merchants", "ev", f"select coalesce(nullif(merchant, ''), left(description, 30)) as merchant, {tot()} as total, count(*) as n from ev where category_type = 'Expense' group by 1 order by 2 desc, 1 limit 5")
def top_merchants(ev):
    return s.top_merchants(ev).select("merchant", cents("total").alias("total"), "n")


@query("top_categories_pct", "ev", "select category, round(total * 100)::bigint as total, floor(total::double / (sum(total) over ())::double * 100 + 0.5)::int as percent from (select category, sum(amount) as total from ev where category not in ('income', 'transfer') group by 1) order by 2 desc, 1 limit 5")
def top_categories_pct(ev):
    return s.top_categories(ev).select("category", cents("total").alias("total"), "percent")


@query("category_pie_top8", "ev", "select category, round(total * 100)::bigint as total, floor(total::double / (sum(total) over ())::double * 1000 + 0.5)::int as tenths from (select category, sum(amount) as total from ev group by 1 order by 2 desc, 1 limit 8)")
def category_pie_top8(ev):
    return s.category_pie(ev).select("category", cents("total").alias("total"), "tenths")


@query("three_month_average", "od", "with m as (select strftime(date, '%Y-%m') as month, sum(case when category_type = 'Income' then amount else 0 end) as i, sum(case when category_type = 'Income' then 0 else amount end) as e from od group by 1 order by 1 desc limit 3) select floor(sum(i)::double / count(*) + 0.5)::bigint as income, floor(sum(e)::double / count(*) + 0.5)::bigint as expense, count(*) as months from m")
def three_month_average(od):
    return s.recent_average(od)


@query("dashboard_stats", "ev", "with a as (select sum(amount) filter (category_type = 'Income') as i, sum(amount) filter (category_type = 'Expense') as e, min(date) as first, max(date) as last, count(*) as n from ev) select round(i * 100)::bigint as income, round(e * 100)::bigint as expense, first, last, n, round((i - e) * 100)::bigint as balance, case when i > 0 then floor((i - e)::double / i::double * 1000 + 0.5) else 0 end::bigint as savings_tenths from a")
def dashboard_stats(ev):
    return s.dashboard(ev).select(cents("income").alias("income"), cents("expense").alias("expense"), "first", "last", "n", cents("balance").alias("balance"), "savings_tenths")


def _trend_sql(t, unit):
    return f"with x as (select unnest(generate_series(min(date_trunc('{unit}', date)), max(date_trunc('{unit}', date)), interval 1 {unit}))::date as start from {t}), y as (select start from x order by 1 desc limit 12) select start, coalesce(round(sum(amount) filter (category_type = 'Income') * 100), 0)::bigint as income, coalesce(round(sum(amount) filter (category_type = 'Expense') * 100), 0)::bigint as expense from y left join {t} on date_trunc('{unit}', date)::date = start group by 1"


@query("trend_weekly_dense", "ev", _trend_sql("ev", "week"))
def trend_weekly_dense(ev):
    return s.trend(ev, "week").select("start", cents("income").alias("income"), cents("expense").alias("expense"))


@query("trend_monthly_dense", "od", _trend_sql("od", "month"))
def trend_monthly_dense(od):
    return s.trend(od, "month").select("start", cents("income").alias("income"), cents("expense").alias("expense"))


_KEYS = {
    "category": "coalesce(category, 'uncategorized')",
    "card": "case when source_type = 'credit_card' and card_issuer is not null then card_issuer || '-****' || card_last_four else 'bank' end",
    "amount_range": "case when abs(amount) < 500 then '<500' when abs(amount) < 2000 then '500-2000' when abs(amount) < 10000 then '2000-10000' else '>10000' end",
    "country": "case when is_international and original_currency is not null then 'International (' || original_currency || ')' else 'Domestic' end",
    "holder": "coalesce(card_holder, 'Primary')",
    "month": "strftime(date, '%Y-%m')",
}


def _dimension(name):
    @query(f"dim_{name}", "od", f"select {_KEYS[name]} as key, round(sum(amount) * 100)::bigint as total, count(*) as n, sum(amount)::double / (sum(sum(amount)) over ())::double as share from od where category_type = 'Expense' or source_type = 'credit_card' group by 1")
    def run(od):
        return s.by_dimension(od, name).select("key", cents("total").alias("total"), "n", "share")


for _name in _KEYS:
    _dimension(_name)


@query("category_month_rollup", "od", "select category, strftime(date, '%Y-%m') as month, grouping(category, strftime(date, '%Y-%m'))::int as level, round(sum(amount) * 100)::bigint as total, count(*) as n from od where category_type = 'Expense' group by grouping sets ((category, strftime(date, '%Y-%m')), (category), (strftime(date, '%Y-%m')), ())")
def category_month_rollup(od):
    return s.rollups(od).select("category", "month", "level", cents("total").alias("total"), "n")


@query("period_over_period", "od", "with p as (select category, coalesce(sum(amount) filter (date between '2001-01-01' and '2001-06-30'), 0) as now, coalesce(sum(amount) filter (date between '2000-07-01' and '2000-12-31'), 0) as before from od where (date between '2001-01-01' and '2001-06-30' or date between '2000-07-01' and '2000-12-31') and (category_type = 'Expense' or source_type = 'credit_card') group by 1) select category, round(now * 100)::bigint as now, round(before * 100)::bigint as before, case when before > 0 then (now - before)::double / before::double * 100 else 0 end as change from p")
def period_over_period(od):
    return s.compare_periods(od, ("2001-01-01", "2001-06-30"), ("2000-07-01", "2000-12-31")).select("category", cents("now").alias("now"), cents("before").alias("before"), "change")


_CARD = "source_type = 'credit_card' and type = 'debit'"


@query("card_spend_by_category", "od", f"select category, {tot()} as total, count(*) as n from od where {_CARD} group by 1 order by 2 desc, 1 limit 6")
def card_spend_by_category(od):
    return s.top(s.card_spend(od, ["category"]), 6, "total", "category").select("category", cents("total").alias("total"), "n")


@query("card_spend_by_card", "od", f"select card_issuer, card_last_four, {tot()} as total, count(*) as n from od where {_CARD} group by all")
def card_spend_by_card(od):
    return s.card_spend(od, ["card_issuer", "card_last_four"]).select("card_issuer", "card_last_four", cents("total").alias("total"), "n")


@query("card_top_merchants", "od", f"select left(array_to_string(string_split(description, ' ')[1:2], ' '), 20) as merchant, {tot()} as total, count(*) as n from od where {_CARD} group by 1 order by 2 desc, 1 limit 5")
def card_top_merchants(od):
    return s.card_merchants(od).select("merchant", cents("total").alias("total"), "n")


@query("card_last6_dense", "od", f"with m as (select strftime(unnest(generate_series(date '2001-03-01', date '2001-08-01', interval 1 month)), '%Y-%m') as month) select month, coalesce(round(sum(amount) * 100), 0)::bigint as total from m left join od on strftime(date, '%Y-%m') = month and {_CARD} group by 1")
def card_last6_dense(od):
    return s.card_months(od, ORDERS_AS_OF[:10]).select("month", cents("total").alias("total"))


@query("international_by_currency", "od", f"select original_currency, {tot()} as total, count(*) as n from od where source_type = 'credit_card' and is_international and original_currency is not null group by 1")
def international_by_currency(od):
    return s.international(od).select("original_currency", cents("total").alias("total"), "n")


@query("distinct_cards", "od", "select card_issuer, card_last_four, arg_min(card_holder, ord) filter (card_holder is not null) as holder, count(*) as n from od where source_type = 'credit_card' group by all")
def distinct_cards(od):
    return s.distinct_cards(od)


@query("latest_two_months", "od", "with m as (select strftime(date, '%Y-%m') as month, sum(case when category_type = 'Income' then amount else 0 end) as i, sum(case when category_type = 'Income' then 0 else amount end) as e from od group by 1 order by 1 desc limit 2), r as (select *, case when i > 0 then (i - e)::double / i::double else 0 end as rate from m) select month, round(i * 100)::bigint as income, round(e * 100)::bigint as expense, rate, rate - lag(rate) over (order by month) as rate_change from r")
def latest_two_months(od):
    return s.latest_months(od).select("month", cents("income").alias("income"), cents("expense").alias("expense"), "rate", "rate_change")


_FC = "select category, round(sum(amount) * 100)::bigint as total, sum(amount)::double / 3 as monthly from od where category_type = 'Expense' and date between '2001-05-01' and '2001-08-02' group by 1"


@query("category_forecast", "od", _FC)
def category_forecast(od):
    return s.forecast(od, ORDERS_AS_OF).select("category", cents("total").alias("total"), "monthly")


@query("avg_income", "od", "select round(sum(amount) * 100)::bigint as total, sum(amount)::double / 3 as monthly from od where category_type = 'Income' and date between '2001-05-01' and '2001-08-02'")
def avg_income(od):
    return s.average_income(od, ORDERS_AS_OF).select(cents("total").alias("total"), "monthly")


@query("budget_auto", "od", f"with f as ({_FC}) select category, floor((total / 100)::double / ((sum(total) over ()) / 100)::double * 1000000 + 0.5)::bigint as budgeted from f")
def budget_auto(od):
    return s.distribute_budget(s.forecast(od, ORDERS_AS_OF), 1_000_000).select("category", "budgeted")


@query("budget_progress", "ev", "with b(category, budgeted) as (values ('dining', 100000.0::double), ('entertainment', 90000.0), ('shopping', 150000.0), ('travel', 500.0)), p as (select b.category, budgeted, coalesce(sum(amount), 0) as spent from b left join ev on ev.category = b.category and category_type = 'Expense' group by all) select category, budgeted, round(spent * 100)::bigint as spent, spent::double / budgeted * 100 as percent, case when spent::double / budgeted * 100 <= 75 then 'on-track' when spent::double / budgeted * 100 <= 100 then 'warning' else 'over-budget' end as status from p")
def budget_progress(ev):
    plan = ev.sparkSession.createDataFrame([("dining", 100000.0), ("entertainment", 90000.0), ("shopping", 150000.0), ("travel", 500.0)], "category string, budgeted double")
    spent = ev.filter(s.is_expense()).groupBy("category").agg(F.sum("amount").alias("spent"))
    return s.budget_progress(spent, plan).select("category", "budgeted", cents("spent").alias("spent"), "percent", "status")


