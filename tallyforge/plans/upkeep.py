"""Queries over upkeep, checks, health and JSON functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import json as js
from tallyforge.operators import cards as c
from tallyforge.operators import rules
from tallyforge.operators import upkeep as u
from tallyforge.operators.spending import signed_amount
from tallyforge.plans.registry import cents, query, told_balance

KNOWN = [r[0] for r in rules.REGISTRY]
K = "card_issuer, card_last_four"
_LATEST = f"lt as (select * from (select *, row_number() over (partition by {K} order by statement_date desc, ord) as rn from st) where rn = 1)"


_GIVEN = "case id % 7 when 0 then upper(category) when 1 then category || ' payment' when 2 then ' My  ' || category || ' ' when 3 then lower(card_issuer) when 4 then 'salary for ' || status when 5 then left(category, 3) else 'Loan Payment' end"
_TABLE = "[" + ", ".join(f"{{'alias': '{a}', 'name': '{n}'}}" for a, n in u.ALIASES.items()) + "]"


@query("category_normalize", "od", f"with x as (select id, regexp_replace(lower(trim({_GIVEN})), '\\s+', '_', 'g') as t from od) select id, case when t = '' then 'other' when t in ({', '.join(repr(k) for k in KNOWN)}) then t else coalesce(list_filter({_TABLE}, lambda x: x.alias = t)[1].name, list_filter({_TABLE}, lambda x: contains(t, x.alias) or contains(x.alias, t))[1].name, 'other') end as category from x")
def category_normalize(od):
    return od.select("id", u.normalize_category(F.expr(_GIVEN), KNOWN).alias("category"))


@query("delete_rows", "ev", "select id from ev where id % 3 <> 0")
def delete_rows(ev):
    return u.without(ev, ev.filter("id % 3 = 0")).select("id")


@query("selected_rows", "ev", "select id, type from ev where id % 3 = 0")
def selected_rows(ev):
    return u.only(ev, ev.filter("id % 3 = 0")).select("id", "type")


@query("active_anomalies", "ev", "select id from ev where id % 4 = 0 and id % 8 <> 0")
def active_anomalies(ev):
    return u.active_anomalies(ev.withColumns({"is_anomaly": F.col("id") % 4 == 0, "anomaly_dismissed": F.when(F.col("id") % 8 == 0, True)})).select("id")


@query("confidence_bands", "ev", "with x as (select id, (id % 10) / 10.0::double as m, ((id * 3) % 10) / 10.0::double as v from ev) select id, case when abs(m - v) > 0.3::double then 'disagrees' when m < 0.5 then 'low' when m < 0.75 then 'medium' else 'high' end as band from x")
def confidence_bands(ev):
    return ev.select("id", u.confidence_band((F.col("id") % 10) / F.lit(10.0), (F.col("id") * 3 % 10) / F.lit(10.0)).alias("band"))


@query("display_names", "od", "select card_issuer, arg_min(merchant, length(merchant)::hugeint * 1000000000000 + ord) as display from od group by 1")
def display_names(od):
    return u.display_name(od, "card_issuer", "merchant")


@query("issuer_rates", "st", "select ord, case card_issuer when 'BUILDING' then 0.36 when 'AUTOMOBILE' then 0.40 when 'HOUSEHOLD' then 0.38 else 0.42 end::double as apr from st")
def issuer_rates(st):
    table = st.sparkSession.createDataFrame([("BUILDING", 1, 0.36), ("auto", 2, 0.40), ("HOUSEHOLD SOCIETY", 3, 0.38)], "name string, rank int, value double")
    return u.issuer_value(st, table).select("ord", F.col("value").alias("apr"))


@query("total_outstanding", "st", f"with {_LATEST} select round(sum(total_due) * 100)::bigint as due, round(sum(credit_limit) * 100)::bigint as credit_limit, count(*) filter (not is_paid) as unpaid from lt")
def total_outstanding(st):
    return u.outstanding(st).select(cents("due").alias("due"), cents("credit_limit").alias("credit_limit"), "unpaid")


@query("statement_paid_counts", "st", f"select {K}, count(*) filter (is_paid) as paid, count(*) as n, max(statement_date) as last from st group by all")
def statement_paid_counts(st):
    return u.paid_counts(st)


@query("mark_paid", "st", "select ord, is_paid or ord % 3 = 0 as is_paid, case when ord % 3 = 0 then round(case when ord % 2 = 0 then 10 else total_due end * 100)::bigint end as paid from st")
def mark_paid(st):
    paid = st.filter("ord % 3 = 0").select("ord", F.when(F.col("ord") % 2 == 0, 10).cast("decimal(18,2)").alias("amount"))
    return u.mark_paid(st, paid).select("ord", "is_paid", cents("paid_amount").alias("paid"))


@query("chat_summary", "od", "with t as (select category, sum(amount) as t from od where category_type = 'Expense' group by 1 order by 2 desc, 1 limit 5) select count(*) as n, min(date) as first, max(date) as last, round(sum(amount) filter (category_type = 'Income') * 100)::bigint as income, round(sum(amount) filter (category_type = 'Expense') * 100)::bigint as expense, round(sum(amount) filter (category_type = 'Excluded') * 100)::bigint as excluded, round((sum(amount) filter (category_type = 'Income') - sum(amount) filter (category_type = 'Expense')) * 100)::bigint as net, (select string_agg(category, ',' order by t desc, category) from t) as top from od")
def chat_summary(od):
    return u.summary(od).select("n", "first", "last", cents("income").alias("income"), cents("expense").alias("expense"), cents("excluded").alias("excluded"), cents("net").alias("net"), "top")


@query("dashboard_health", "od st", f"with {_LATEST}, m as (select strftime(date, '%Y-%m') as month, coalesce(sum(amount) filter (category_type = 'Income'), 0) as i, coalesce(sum(amount) filter (category_type = 'Expense'), 0) as e from od group by 1 order by 1 desc limit 1), x as (select month, case when i > 0 then (i - e)::double / i::double else 0 end as r, (select sum(total_due)::double / sum(credit_limit)::double from lt) as u from m), s as (select month, greatest(0, least(100, 50 + (case when r >= 0.3 then 30 when r >= 0.2 then 20 when r >= 0.1 then 10 when r >= 0 then 0 else -25 end) + (case when u <= 0.1 then 20 when u <= 0.3 then 10 when u <= 0.5 then 0 else -10 end)))::int as score from x) select month, score, case when score >= 80 then 'excellent' when score >= 60 then 'good' when score >= 40 then 'fair' else 'poor' end as label from s")
def dashboard_health(od, st):
    return u.financial_health(od, st)


_BAL = "b as (select merchant, ord, sum(case when type = 'credit' then amount else -amount end) over (partition by merchant order by ord) as balance from ev)"


@query("opening_closing", "ev", f"with {_BAL} select merchant, round(arg_min(balance, ord) * 100)::bigint as opening, round(arg_max(balance, ord) * 100)::bigint as closing, count(*) as n from b group by 1")
def opening_closing(ev):

    b = ev.withColumn("balance", F.sum(signed_amount()).over(Window.partitionBy("merchant").orderBy("ord")))
    return u.opening_closing(b, ["merchant"]).select("merchant", cents("opening").alias("opening"), cents("closing").alias("closing"), "n")


@query("balance_inference", "ev", "with f as (select *, lag(amount) over (partition by merchant order by ord) is not null as has from ev) select id, case when has then round(amount * 100)::bigint end as cents, case when has then type end as type, true as trusted from f")
def balance_inference(ev):
    b = ev.withColumn("balance", told_balance())
    lines = b.select("id", "ord", "merchant", "balance", F.array("amount", "balance").alias("amounts"))
    return u.infer_from_balance(lines, ["merchant"]).select("id", cents("amount").alias("cents"), "type", "trusted")


@query("card_summary_checks", "st", "select ord, (payment_due_date < statement_date)::int + (minimum_due > total_due)::int + (total_due > credit_limit)::int as n_problems from st")
def card_summary_checks(st):
    return u.check_card_summary(st).select("ord", F.size("problems").alias("n_problems"))


@query("savings_estimate", "st", f"with {_LATEST} select sum(floor(total_due::double * 0.408::double + 0.5))::bigint as interest, count(*) as cards from lt")
def savings_estimate(st):
    return u.savings_estimate(c.latest(st).select(F.col("total_due").cast("double").alias("balance"), F.lit(0.408).alias("apr")))


@query("nearest_columns", "od", "select id % 100 as page, id as item, case id % 3 when 0 then 'date' when 1 then 'amount' else 'balance' end as role from od where id % 3 <> 2 or id % 2 = 0")
def nearest_columns(od):
    page = (F.col("id") % 100).alias("page")
    heads = od.select(page).distinct().withColumn("h", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(x).alias("x")) for r, x in (("date", 10), ("amount", 300), ("balance", 600))]))).select("page", "h.role", "h.x")
    x = F.when(F.col("id") % 3 == 0, 15).when(F.col("id") % 3 == 1, 240).otherwise(F.when(F.col("id") % 2 == 0, 620).otherwise(900))
    return u.nearest_column(od.select(page, F.col("id").alias("item"), x.alias("x")), heads, "page")


@query("lenient_json", "ev", "select id, case when id % 4 = 3 then 0 else 1 + (category in ('income', 'dining'))::int end as n, case when id % 4 = 3 then null when category in ('income', 'dining') then category else 'travel' end as category, case when id % 4 = 3 then null when category in ('income', 'dining') and amount <= 50 then (amount / 50)::decimal(18,4)::double when category in ('income', 'dining') then 0.2 else 0.5 end::double as confidence from ev")
def lenient_json(ev):
    """Answers about the events, bare, fenced or within words; categories that are not asked for and odd confidences among them."""
    sure = (F.col("amount") / 50).cast("decimal(18,4)").cast("string")
    rows = F.concat(F.lit('{"id": "a", "category": "'), F.col("category"), F.lit('", "confidence": '), sure, F.lit('}, {"id": "b", "category": "travel", "confidence": 0.5}, {"id": "", "category": "travel"}'))
    k = F.col("id") % 4
    said = F.when(k == 0, F.concat(F.lit("["), rows, F.lit("]"))).when(k == 1, F.concat(F.lit("Sure!\n```json\n["), rows, F.lit("]\n```"))).when(k == 2, F.concat(F.lit("Here it is: ["), rows, F.lit(",] as asked"))).otherwise("I can not")
    df = ev.select("id", js.categorized(said, ["income", "dining", "travel"]).alias("r"))
    return df.select("id", F.size("r").alias("n"), F.get("r", 0)["category"].alias("category"), F.get("r", 0)["confidence"].alias("confidence"))