"""Queries over the anomaly and recurrence detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions.text import NAME_SUFFIXES
from tallyforge.operators import anomalies as a
from tallyforge.operators import recurring as r
from tallyforge.plans.registry import cents, direct, query

_STATS = "count(*) as n, sum(c)::double / count(*) as mean, sqrt(greatest((count(*) * sum(c::hugeint * c))::double - sum(c)::double * sum(c)::double, 0)) / count(*) as deviation"
_E = "e as (select *, round(abs(amount) * 100)::bigint as c from ev where category_type = 'Expense')"


@query("category_stats", "ev", f"with {_E} select category, {_STATS} from e group by 1")
def category_stats(ev):
    return a.category_stats(ev)


@query("amount_anomaly", "ev", f"with {_E}, s as (select category as k, {_STATS} from e group by 1), z as (select id, category, (c::double - mean) / deviation as z from e join s on category = k where n >= 5 and deviation > 0) select id, category, z, case when z > 2.5 then 'high_amount' else 'low_amount' end as kind from z where abs(z) > 2.5")
def amount_anomaly(ev):
    return a.amount_anomalies(ev)


@query("global_outliers_top5", "ev", f"with {_E}, s as (select {_STATS} from e), z as (select id, ord, amount, (c::double - mean) / deviation as z from e, s) select id, round(amount * 100)::bigint as cents, floor(z * 100 + 0.5)::bigint as z_hundredths from z where z > 2 order by z desc, ord limit 5")
def global_outliers_top5(ev):
    return a.global_outliers(ev).select("id", cents("amount").alias("cents"), "z_hundredths")


_SIM = "case when lower(trim({a})) = lower(trim({b})) then 1.0 else 1 - levenshtein(lower(trim({a})), lower(trim({b})))::double / greatest(length(trim({a})), length(trim({b}))) end"
_PAIRS = f"{_E}, p as (select x.id, y.id as other, x.ord, y.ord as other_ord, y.c - x.c as o from e x join e y on y.c between x.c - 1 and x.c + 1 and x.id <> y.id and abs(epoch_us(x.date) - epoch_us(y.date)) <= {{us}} where {{sim}} >= {{least}})"
_DUP = _PAIRS.format(us=172800000000, sim=_SIM.format(a="x.description", b="y.description"), least=0.8)


@query("duplicate_pairs", "ev", f"with {_DUP} select id, arg_min(other, (o + 1) * 1000000000 + other_ord) as duplicate_of from p group by id")
def duplicate_pairs(ev):
    return a.duplicates(ev)


_BI = "list_distinct(list_transform(range(1, length(lower(trim({x})))), lambda i: substr(lower(trim({x})), i, 2)))"
_DICE = "case when lower(trim(x.description)) = lower(trim(y.description)) then 1.0 else 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) end".format(a=_BI.format(x="x.description"), b=_BI.format(x="y.description"))


@query("near_duplicate_pairs", "ev", f"with {_PAIRS.format(us=86400000000, sim=_DICE, least=0.85)} select id, other from p where other_ord < ord")
def near_duplicate_pairs(ev):
    from tallyforge.operators import verify

    return verify.near_duplicates(ev)


@query("near_duplicate_report", "ev", f"with {_PAIRS.format(us=86400000000, sim=_DICE, least=0.85)} select id, arg_min(other, other_ord) as matched_with from p where other_ord < ord group by id")
def near_duplicate_report(ev):
    from tallyforge.operators import verify

    return verify.near_duplicate_report(ev)


_WC = "count(*) over (partition by merchant order by date range between interval {x} preceding and interval {x} following)"


@query("frequency_counts", "ev", f"select id, {_WC.format(x='24 hours')} as in_day, {_WC.format(x='7 days')} as in_week from ev")
def frequency_counts(ev):
    return a.window_counts(ev).select("id", "in_day", "in_week")


_FREQ = f"w as (select id, {_WC.format(x='24 hours')} as d, {_WC.format(x='7 days')} as k from ev where category_type = 'Expense'), f as (select id, case when d >= 3 then '24h' else '7d' end as period, case when d >= 3 then d else k end as times from w where d >= 3 or k >= 5)"


@query("frequency_anomaly", "ev", f"with {_FREQ} select id, period, times from f")
def frequency_anomaly(ev):
    return a.frequency_anomalies(ev)


_ALL = f"with {_DUP}, d as (select id, arg_min(other, (o + 1) * 1000000000 + other_ord) as duplicate_of from p group by id), {_FREQ}, s as (select category as k, {_STATS} from e group by 1), z as (select id, (c::double - mean) / deviation as z from e join s on category = k where n >= 5 and deviation > 0), t as (select ev.id, list_filter([case when z.z > 2.5 then 'high_amount' when z.z < -2.5 then 'low_amount' end, case when duplicate_of is not null then 'duplicate' end, case when period is not null then 'frequency' end], lambda x: x is not null) as kinds, duplicate_of, times from ev left join z on ev.id = z.id left join d on ev.id = d.id left join f on ev.id = f.id)"


@query("anomaly_summary", "ev", _ALL + " select id, array_to_string(kinds, ',') as kinds, len(kinds) > 0 as is_anomaly, duplicate_of, times from t")
def anomaly_summary(ev):
    return a.assemble(ev).select("id", F.array_join("anomaly_types", ",").alias("kinds"), "is_anomaly", "duplicate_of", "times")


@query("anomaly_type_counts", "ev", _ALL + " select anomaly_type, count(*) as n from (select unnest(kinds) as anomaly_type from t) group by 1")
def anomaly_type_counts(ev):
    return a.type_counts(a.assemble(ev))


_GAPS = "g0 as (select merchant, id, floor((epoch_us(date) - lag(epoch_us(date)) over (partition by merchant order by date, ord)) / 86400000000.0 + 0.5)::int as gap from sub), g as (select * from g0 where gap > 0), gs as (select merchant, count(*) as gaps, sum(gap)::double / count(*) as mean_gap, sqrt((count(*) * sum(gap::bigint * gap) - sum(gap)::bigint * sum(gap)::bigint)::double) / count(*) as gap_deviation from g group by 1)"
_CLASS = "case when abs(mean_gap - 7) <= 2 and gap_deviation <= 3.0 then 'weekly' when abs(mean_gap - 30) <= 7 and gap_deviation <= 10.5 then 'monthly' when abs(mean_gap - 91) <= 14 and gap_deviation <= 21.0 then 'quarterly' when abs(mean_gap - 365) <= 30 and gap_deviation <= 45.0 then 'yearly' end"


@query("merchant_intervals", "sub", f"with {_GAPS} select merchant, id, gap from g")
def merchant_intervals(sub):
    return r.intervals(sub)


@query("frequency_class", "sub", f"with {_GAPS} select merchant, gaps as n, mean_gap, gap_deviation, {_CLASS} as frequency from gs")
def frequency_class(sub):
    return r.gap_stats(r.intervals(sub)).withColumn("frequency", r.frequency(F.col("mean_gap"), F.col("gap_deviation")))


_REC = f"""with {_GAPS}, c as (select merchant, {_CLASS} as frequency, gap_deviation from gs), s as (select merchant, count(*) as n, max(date)::date as last, arg_max(amount, ord) as amount from sub group by 1),
 x as (select s.*, frequency, case frequency when 'weekly' then 7 when 'monthly' then 30 when 'quarterly' then 91 else 365 end as days, gap_deviation from s join c using (merchant) where frequency is not null),
 y as (select *, greatest(0.0, least(1.0, 0.5 + (case when n >= 6 then 0.3 when n >= 4 then 0.2 when n >= 3 then 0.1 else 0.05 end) + 0.2 + (case when gap_deviation / days < 0.1 then 0.2 when gap_deviation / days < 0.2 then 0.15 when gap_deviation / days < 0.3 then 0.1 else -0.1 end)))::double as confidence,
  case frequency when 'weekly' then last + 7 else (date_trunc('month', last) + (case frequency when 'monthly' then 1 when 'quarterly' then 3 else 12 end) * interval 1 month)::date + (day(last) - 1)::int end as next from x)"""
_AS_OF = "2013-06-01"


@query("recurring_payments", "sub", f"{_REC} select merchant, n, frequency, confidence, round(amount * 100)::bigint as cents, last, next, date '{_AS_OF}' - last <= days * 3 as active from y where confidence >= 0.7")
def recurring_payments(sub):
    return r.recurring_payments(sub, _AS_OF).select("merchant", "n", "frequency", "confidence", cents("amount").alias("cents"), "last", "next", "active")


@query("monthly_recurring_total", "sub", f"{_REC} select frequency, count(*) as n, sum(floor((case frequency when 'weekly' then amount::double * 4.33 when 'monthly' then amount::double when 'quarterly' then amount::double / 3 else amount::double / 12 end) * 100 + 0.5)::bigint)::bigint as monthly_cents from y where confidence >= 0.7 and date '{_AS_OF}' - last <= days * 3 group by 1")
def monthly_recurring_total(sub):
    return r.monthly_total(r.recurring_payments(sub, _AS_OF))


@query("recurring_without_excluded", "sub", f"{_REC} select merchant, frequency from y where confidence >= 0.7 and not (contains(lower(merchant), 'supplier#000000001') or contains('supplier#000000001', lower(merchant)))")
def recurring_without_excluded(sub):
    out = sub.sparkSession.createDataFrame([("Supplier#000000001",)], "name string")
    return r.without_excluded(r.recurring_payments(sub, _AS_OF), out).select("merchant", "frequency")


_FIT = f"""
nm as (select name, min(ord) as ord from named where name <> '' group by name),
wd as (select name, ord, list_filter(string_split(name, ' '), lambda w: length(w) > 2)[1] as w from nm),
o as (select name, case when w not in ({", ".join(repr(w) for w in r.COMMON_WORDS)}) then w end as word, row_number() over (order by ord, name) as i from wd),
f as (select 0::bigint as i, []::struct(name varchar, word varchar)[] as heads, ''::varchar as name, ''::varchar as cluster
  union all select g.i, case when g.hit is null then list_append(g.heads, {{'name': g.name, 'word': g.word}}) else g.heads end, g.name, coalesce(g.hit, g.name)
  from (select o.i, f.heads, o.name, o.word, list_filter(f.heads, lambda h: contains(o.name, h.name) or contains(h.name, o.name) or coalesce(h.word = o.word, false))[1].name as hit from f join o on o.i = f.i + 1) g)
select name, cluster from f where i > 0"""


def _suffixed(x: str) -> str:
    for s in NAME_SUFFIXES:
        x = f"regexp_replace({x}, '\\s+{s}\\s*$', '')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _named(raw: str) -> str:
    return _suffixed(f"regexp_replace(regexp_replace(lower(trim({raw})), '^(payment\\s*(to|for)?|purchase\\s*(at|from)?|bill\\s*payment\\s*(to)?|sub\\s*)\\s*', ''), '[^a-z0-9\\s]', ' ', 'g')")


@query("merchant_clusters", "sub", f"with recursive named as (select {_named('merchant')} as name, ord from sub), {_FIT}")
def merchant_clusters(sub):
    return r.clusters(sub)


def _turn_names(spark, sf_dir):
    """Names of one to four words, as the turns of conversations begin."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    words = F.array_join(F.slice(F.split("text", " "), F.lit(1), F.col("turn") % 4 + 1), " ")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), words.alias("merchant"), F.lit(None).cast("string").alias("description"))


@direct("merchant_clusters_of_turns", f"with recursive named as (select {_named("array_to_string(string_split(text, ' ')[1:turn % 4 + 1], ' ')")} as name, conv_id * 1000 + turn as ord from conversations where text is not null), {_FIT}")
def merchant_clusters_of_turns(spark, sf_dir):
    return r.clusters(_turn_names(spark, sf_dir))
