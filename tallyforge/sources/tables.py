"""Ledger tables laid out from the driver's star schema, and the same as DuckDB common table expressions.

Money is decimal(18,2), so sums are exact and order does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS_AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-08-02 00:00:00"

#: Category of each event type and order priority, as (value, category, category type).
EVENT_CATEGORIES = [("signup", "income", "Income"), ("click", "dining", "Expense"), ("view", "entertainment", "Expense"), ("purchase", "shopping", "Expense"), ("error", "transfer", "Excluded")]
ORDER_CATEGORIES = [("1-URGENT", "income", "Income"), ("2-HIGH", "groceries", "Expense"), ("3-MEDIUM", "travel", "Expense"), ("4-NOT SPECIFIED", "bills", "Expense"), ("5-LOW", "transfer", "Excluded")]
CURRENCIES = ["USD", "EUR", "GBP", "JPY"]
STEPS = [7, 30, 91, 365]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(col: Column, rows: list[tuple[str, str, str]], at: int) -> Column:
    out = F.when(col == rows[0][0], rows[0][at])
    for r in rows[1:]:
        out = out.when(col == r[0], r[at])
    return out


def money(col: Column | str) -> Column:
    return F.col(col).cast("decimal(18,2)") if isinstance(col, str) else col.cast("decimal(18,2)")


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    user = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    return e.select(
        F.col("event_id").alias("id"),
        F.col("event_id").alias("ord"),
        F.col("ts").alias("date"),
        F.concat_ws(" ", "event_type", user).alias("description"),
        money("value").alias("amount"),
        F.when(F.col("event_type") == "signup", "credit").otherwise("debit").alias("type"),
        _pick(F.col("event_type"), EVENT_CATEGORIES, 1).alias("category"),
        _pick(F.col("event_type"), EVENT_CATEGORIES, 2).alias("category_type"),
        user.alias("merchant"),
    )


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (_read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").alias("ord"),
        F.col("o_orderdate").alias("date"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("c_name")).alias("description"),
        money("o_totalprice").alias("amount"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "credit").otherwise("debit").alias("type"),
        _pick(F.col("o_orderpriority"), ORDER_CATEGORIES, 1).alias("category"),
        _pick(F.col("o_orderpriority"), ORDER_CATEGORIES, 2).alias("category_type"),
        F.col("c_name").alias("merchant"),
        F.when(F.col("o_custkey") % 3 == 0, "bank").otherwise("credit_card").alias("source_type"),
        F.col("c_mktsegment").alias("card_issuer"),
        F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0").alias("card_last_four"),
        F.when(F.col("o_custkey") % 5 != 0, F.col("c_name")).alias("card_holder"),
        (F.col("n_regionkey") != 2).alias("is_international"),
        F.element_at(F.array(*[F.lit(x) for x in CURRENCIES]), (F.col("n_nationkey") % 4 + 1).cast("int")).alias("original_currency"),
        F.col("o_orderstatus").alias("status"),
        money("c_acctbal").alias("account_balance"),
    )


def card_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = order_transactions(spark, sf_dir)
    g = t.groupBy("card_issuer", "card_last_four", F.trunc("date", "month").alias("month")).agg(
        F.sum("amount").cast("decimal(18,2)").alias("total_due"),
        F.sum(F.when(F.col("status") == "F", F.col("amount")).otherwise(0)).cast("decimal(18,2)").alias("payments_received"),
        F.sum(F.when(F.col("status") == "P", F.col("amount")).otherwise(0)).cast("decimal(18,2)").alias("pending"),
        F.max(F.abs("account_balance")).alias("balance"),
        F.count(F.lit(1)).alias("n"),
        F.min("ord").alias("ord"),
    )
    return g.select(
        "ord", "card_issuer", "card_last_four", "month", F.last_day("month").alias("statement_date"), F.date_add(F.last_day("month"), 20).alias("payment_due_date"),
        "total_due", "payments_received",
        F.greatest(money(F.lit(0.05).cast("decimal(3,2)") * F.col("total_due")), F.lit(200).cast("decimal(18,2)")).alias("minimum_due"),
        money(F.col("balance") * 100).alias("credit_limit"),
        money(F.lit(0.02).cast("decimal(3,2)") * F.col("pending")).alias("interest_charged"),
        F.when(F.col("n") % 3 == 0, 25).otherwise(0).cast("decimal(18,2)").alias("late_fee"),
        money(F.lit(0.01).cast("decimal(3,2)") * F.col("total_due")).alias("cashback_earned"),
        F.floor(F.col("total_due") / 100).cast("long").alias("points_earned"),
        F.floor(F.col("total_due") / 500).cast("long").alias("points_redeemed"),
        (F.col("payments_received") >= F.col("total_due")).alias("is_paid"),
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11))))
    step = F.element_at(F.array(*[F.lit(x) for x in STEPS]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return s.select(
        (F.col("s_suppkey") * 12 + F.col("k")).alias("id"),
        (F.col("s_suppkey") * 12 + F.col("k")).alias("ord"),
        F.date_add(F.lit("2012-01-15").cast("date"), F.col("k") * step).alias("date"),
        F.col("s_name").alias("description"),
        money(F.abs("s_acctbal")).alias("amount"),
        F.lit("debit").alias("type"),
        F.lit("bills").alias("category"),
        F.lit("Expense").alias("category_type"),
        F.col("s_name").alias("merchant"),
    )


def _case(col: str, rows: list[tuple[str, str, str]], at: int) -> str:
    return "case " + col + " " + " ".join(f"when '{r[0]}' then '{r[at]}'" for r in rows) + " end"


CTES = {
    "ev": f"""ev as (select event_id as id, event_id as ord, ts as date, event_type || ' user ' || user_id as description, cast(value as decimal(18,2)) as amount,
  case when event_type = 'signup' then 'credit' else 'debit' end as type, {_case('event_type', EVENT_CATEGORIES, 1)} as category, {_case('event_type', EVENT_CATEGORIES, 2)} as category_type, 'user ' || user_id as merchant from events)""",
    "od": f"""od as (select o_orderkey as id, o_orderkey as ord, o_orderdate as date, 'Order ' || o_orderkey || ' ' || c_name as description, cast(o_totalprice as decimal(18,2)) as amount,
  case when o_orderpriority = '1-URGENT' then 'credit' else 'debit' end as type, {_case('o_orderpriority', ORDER_CATEGORIES, 1)} as category, {_case('o_orderpriority', ORDER_CATEGORIES, 2)} as category_type,
  c_name as merchant, case when o_custkey % 3 = 0 then 'bank' else 'credit_card' end as source_type, c_mktsegment as card_issuer, lpad((o_custkey % 10000)::varchar, 4, '0') as card_last_four,
  case when o_custkey % 5 <> 0 then c_name end as card_holder, n_regionkey <> 2 as is_international, (['USD', 'EUR', 'GBP', 'JPY'])[(n_nationkey % 4 + 1)::int] as original_currency, o_orderstatus as status, cast(c_acctbal as decimal(18,2)) as account_balance
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)""",
    "st": """st as (select ord, card_issuer, card_last_four, month, last_day(month) as statement_date, last_day(month) + 20 as payment_due_date, total_due, payments_received,
  greatest(cast(0.05 * total_due as decimal(18,2)), 200.00::decimal(18,2)) as minimum_due, cast(balance * 100 as decimal(18,2)) as credit_limit, cast(0.02 * pending as decimal(18,2)) as interest_charged,
  cast(case when n % 3 = 0 then 25 else 0 end as decimal(18,2)) as late_fee, cast(0.01 * total_due as decimal(18,2)) as cashback_earned, (total_due * 100)::bigint // 10000 as points_earned, (total_due * 100)::bigint // 50000 as points_redeemed, payments_received >= total_due as is_paid
  from (select card_issuer, card_last_four, date_trunc('month', date)::date as month, sum(amount)::decimal(18,2) as total_due, coalesce(sum(amount) filter (status = 'F'), 0)::decimal(18,2) as payments_received,
    coalesce(sum(amount) filter (status = 'P'), 0)::decimal(18,2) as pending, max(abs(account_balance)) as balance, count(*) as n, min(ord) as ord from od group by all))""",
    "sub": """sub as (select s_suppkey * 12 + k as id, s_suppkey * 12 + k as ord, date '2012-01-15' + (k * ([7, 30, 91, 365])[(s_suppkey % 4 + 1)::int])::int as date, s_name as description, cast(abs(s_acctbal) as decimal(18,2)) as amount,
  'debit' as type, 'bills' as category, 'Expense' as category_type, s_name as merchant from supplier, (select unnest(range(12)) as k))""",
}


def with_tables(body: str, *names: str) -> str:
    """``body`` after the expressions it needs ('st' needs 'od'); a body may begin with expressions of its own, "with x as ...". """
    need = [n for n in ("ev", "od", "st", "sub") if n in names or n == "od" and "st" in names]
    own = body.strip()
    head = ", ".join(CTES[n] for n in need)
    if own.lower().startswith("with recursive "):
        return f"with recursive {head}, {own[15:]}"
    if own.lower().startswith("with "):
        return f"with {head}, {own[5:]}"
    return f"with {head} {own}"
