"""Queries that check extracted rows against their statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import answers, schema
from tallyforge.operators import evidence as e
from tallyforge.operators import verify
from tallyforge.operators.extraction import ASK, extract
from tallyforge.operators.retrieve import contexts, prompt_batches
from tallyforge.plans.registry import cents, direct, lakh, query, thousand

# A customer's statement: a line an order, written in changing ways; the rows to check are the orders, some with another
# sum, day or direction than the line.
_DAY = [("yyyy-MM-dd", "strftime(date, '%Y-%m-%d')"), ("dd/MM/yyyy", "strftime(date, '%d/%m/%Y')"), ("d MMM yyyy", "day(date) || ' ' || strftime(date, '%b %Y')"), ("MMM dd, yyyy", "strftime(date, '%b %d, %Y')"), ("yyyy.MM.dd", "strftime(date, '%Y.%m.%d')")]


def _statements(od):
    amount = F.col("amount").cast("string")
    day = F.element_at(F.array(*[F.date_format("date", f) for f, _ in _DAY]), (F.col("ord") % 5 + 1).cast("int"))
    written = F.element_at(F.array(amount, e.grouped(amount, "western"), e.grouped(amount, "indian"), F.concat(F.lit("-"), amount)), (F.floor(F.col("ord") / 5) % 4 + 1).cast("int"))
    mark = F.element_at(F.array(F.lit(""), F.lit(" CR"), F.lit(" DR"), F.lit(" deposit"), F.lit("")), (F.floor(F.col("ord") / 20) % 5 + 1).cast("int"))
    line = F.concat_ws(" ", day, "status", F.concat(F.lit("order "), F.col("ord").cast("string")), F.concat(written, mark))
    return od.groupBy("merchant").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("raw_text"))


def _extracted(od):
    moved = F.when(F.col("ord") % 11 == 0, F.date_add(F.to_date("date"), 400)).otherwise(F.to_date("date"))
    off = F.when(F.col("ord") % 7 == 0, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(18,2)")
    words = F.when(F.col("ord") % 13 == 0, F.concat(F.lit("unknown shop "), "ord")).otherwise(F.concat(F.lit("order "), F.col("ord").cast("string"), F.lit(" "), "status"))
    return od.select("merchant", F.col("ord").alias("id"), moved.alias("day"), off.alias("amount"), "type", words.alias("description"), F.when(F.col("ord") % 17 == 0, F.col("original_currency")).alias("currency"))


_SHORT = "case when f = '00' then '' when right(f, 1) = '0' then '.' || left(f, 1) else '.' || f end"
_FORMS = f"[amount::varchar, ({lakh('w')}) || '.' || f, ({lakh('w')}) || {_SHORT}, ({thousand('w')}) || '.' || f, ({thousand('w')}) || {_SHORT}, round(amount)::bigint::varchar]"
_DAYS = "[[strftime(day, '%Y-%m-%d')], [strftime(day, '%d/%m/%Y')], [month(day) || '/' || day(day) || '/' || year(day)], [strftime(day, '%d-%m-%Y')], [day(day)::varchar, lower(strftime(day, '%b')), year(day)::varchar], [strftime(day, '%d'), lower(strftime(day, '%b')), year(day)::varchar], [lower(strftime(day, '%b')), day(day)::varchar, year(day)::varchar], [lower(strftime(day, '%b')), strftime(day, '%d'), year(day)::varchar]]"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_EVIDENCE = rf"""
with src as (select *, amount::varchar as a, split_part(amount::varchar, '.', 1) as w, split_part(amount::varchar, '.', 2) as f from od),
lines as (select merchant, ord, ([{", ".join(s for _, s in _DAY)}])[(ord % 5 + 1)::int] || ' ' || status || ' order ' || ord || ' ' ||
  ([a, ({thousand('w')}) || '.' || f, ({lakh('w')}) || '.' || f, '-' || a])[(ord // 5 % 4 + 1)::int] || (['', ' CR', ' DR', ' deposit', ''])[(ord // 20 % 5 + 1)::int] as l from src),
texts as (select merchant, trim(regexp_replace(regexp_replace(lower(string_agg(l, chr(10) order by ord)), '[^\w\s.,/-]', '', 'g'), '\s+', ' ', 'g')) as t from lines group by 1),
cutup as (select merchant, regexp_extract_all(t, '{e.TOKEN}') as tk, regexp_split_to_array(t, '{e.TOKEN}') as gp from texts),
each as (select merchant, i, tk[i] as token, gp[i] as gap from (select *, unnest(range(1, len(tk) + 1)) as i from cutup)),
ix as materialized (select merchant, i, token, ends_with(gap, '-') as minus, sum(length(token) + length(gap)) over w - length(token) as at, lead(token) over w as mark from each window w as (partition by merchant order by i)),
r0 as (select merchant, ord as id, case when ord % 11 = 0 then date::date + 400 else date::date end as day, (case when ord % 7 = 0 then amount + 1 else amount end)::decimal(18,2) as amount, type,
  case when ord % 13 = 0 then 'unknown shop ' || ord else 'order ' || ord || ' ' || status end as description, case when ord % 17 = 0 then original_currency end as currency from od),
r1 as (select *, split_part(amount::varchar, '.', 1) as w, split_part(amount::varchar, '.', 2) as f from r0),
r as materialized (select * exclude (w, f), {_FORMS} as forms, {_DAYS} as days from r1),
am as materialized (select r.id, r.type, r.merchant, x.at, x.minus, x.mark, list_position(forms, x.token) as form, row_number() over (partition by r.id, x.token order by x.at) as n from r join ix x on x.merchant = r.merchant and list_contains(forms, x.token)),
dy as materialized (select distinct r.id, x.at, z.at + length(z.token) as until from r, (select unnest(range(1, 9)) as k) join ix x on x.merchant = r.merchant and x.token = days[k][1]
  join ix z on z.merchant = r.merchant and z.i = x.i + len(days[k]) - 1 and z.token = days[k][len(days[k])] left join ix y on y.merchant = r.merchant and y.i = x.i + 1 where len(days[k]) = 1 or y.token = days[k][2]),
an as (select a.id, min(a.at) as anchor, count(distinct a.at) as anchors from am a join dy d on d.id = a.id and d.at >= a.at - {e.NEAR_DAY} and d.until <= a.at + {e.NEAR_DAY} group by 1),
nw as (select a.id, a.form, coalesce(bool_or(list_contains({_LIST(e.IN_WORDS)}, x.token)), false) as i, coalesce(bool_or(list_contains({_LIST(e.OUT_WORDS)}, x.token)), false) as o from am a
  left join ix x on x.merchant = a.merchant and list_contains({_LIST([*e.IN_WORDS, *e.OUT_WORDS])}, x.token) and x.at >= a.at - {e.NEAR_WORD} and x.at < a.at + {e.NEAR_WORD} where a.n = 1 group by all),
tl as (select a.id, a.form, case when type = 'credit' then case when (i and not o) or coalesce(mark in ('cr', 'credit'), false) or not minus then true when o or coalesce(mark in ('dr', 'debit'), false) then false end
  else case when (o and not i) or coalesce(mark in ('dr', 'debit'), false) or minus then true when i or coalesce(mark in ('cr', 'credit'), false) then false end end as agrees from am a join nw using (id, form) where a.n = 1),
tt as (select id, arg_min(agrees, form) filter (agrees is not null) as agrees from tl group by 1),
wd as (select id, count(*) filter (length(w) > 2 and exists (from ix x where x.merchant = q.merchant and x.token = q.w)) / count(*) >= {e.PART} as ok from (select id, merchant, unnest(regexp_extract_all(lower(description), '{e.TOKEN}')) as w from r) q group by 1),
got as (select r.id, merchant, tt.id is not null as amount_found, exists (from dy where dy.id = r.id) as day_found, coalesce(agrees, true) as direction_found, coalesce(wd.ok, false) as words_found,
  currency is null or exists (from ix x where x.merchant = r.merchant and x.token = lower(currency)) as currency_found, anchor, coalesce(anchors, 0) as anchors from r left join tt using (id) left join an using (id) left join wd using (id))
"""
_SCORE = f"{e.AMOUNT} * amount_found::int + {e.DIRECTION} * direction_found::int + {e.DAY} * day_found::int + {e.WORDS} * words_found::int + {e.CURRENCY} * currency_found::int"


@query("row_evidence", "od", f"{_EVIDENCE} select *, {_SCORE} as score, {_SCORE} >= {e.ACCEPT} as accepted from got")
def row_evidence(od):
    return e.evidence(_extracted(od), _statements(od), "merchant")


@query("verified_rows", "od", f"{_EVIDENCE}, s as (select got.id, merchant, amount, r.type, day, {_SCORE} as score, coalesce((anchor // 8)::bigint::varchar, 'na') as a, left(lower(description), 40) as dsc from got join r using (id, merchant)), k as (select *, min(case when score >= {e.ACCEPT} then id end) over (partition by merchant, day, amount, type, dsc, a) as first from s) select id, score::int as score, case when id > first then 'duplicate' when id = first then 'verified' else 'rejected' end as status from k")
def verified_rows(od):
    rows = _extracted(od)
    checked = e.evidence(rows, _statements(od), "merchant").select("id", "score", "anchor")
    settled = verify.settle(rows.join(checked, "id").withColumnsRenamed({"id": "ord", "day": "date"}), ["merchant"])
    return settled.select(F.col("ord").alias("id"), "score", "status")


_KIND = ["purchase", "fee", "interest", "charge", "bill_payment", "refund"]
_CARD = f"""
m as (select *, case when type = 'credit' then (['bill_payment', 'refund'])[(id % 2 + 1)::int] else (['purchase', 'fee', 'interest', 'charge'])[(id % 4 + 1)::int] end as sub_type from od),
s as (select card_issuer, card_last_four, sum(case when type = 'debit' then amount else 0 end) as d, sum(case when type = 'credit' then amount else 0 end) as c,
  sum(case when sub_type in ('purchase', 'charge') then amount else 0 end) as p, sum(case when sub_type = 'bill_payment' then amount else 0 end) as b, sum(case when sub_type in ('fee', 'interest') then amount else 0 end) as f, count(*) as n from m group by all),
st as (select *, card_last_four::int as k from s),
g as (select *, case when k % 5 <> 0 then n::decimal(18,2) end as prev, n + d - c + case k % 3 when 1 then 50 when 2 then 500 else 0 end as due, case when k % 4 <> 0 then d + 100 * (k % 2) end as sp, case when k % 7 <> 0 then case when k % 2 = 1 then b else c end end as sy, case when k % 3 <> 0 then f end as si from st),
o as (select *, case when prev is null then 0 else prev + d - c end as computed from g),
v as (select *, abs(computed - due) as diff, (sp is null or abs(d - sp) < 10) and (sy is null or abs(c - sy) < 10) and (si is null or abs(f - si) < 10) as sums from o)"""


@query("card_verification", "od", f"with {_CARD} select card_issuer, card_last_four, round(computed * 100)::bigint as computed_cents, round(diff * 100)::bigint as difference_cents, diff <= 1 as total_agrees, sums as sums_agree, case when diff <= 1 then 50 when diff < 100 then 25 else 0 end + case when sums then 50 else case when sp is null or abs(p - sp) < 10 then 17 else 0 end + case when sy is null or abs(b - sy) < 10 then 17 else 0 end + case when abs(f - coalesce(si, 0)) < 10 then 16 else 0 end end as confidence from v")
def card_verification(od):
    kinds = lambda words, k: F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("id") % k + 1).cast("int"))
    moves = od.withColumn("sub_type", F.when(F.col("type") == "credit", kinds(["bill_payment", "refund"], 2)).otherwise(kinds(["purchase", "fee", "interest", "charge"], 4)))
    keys = ["card_issuer", "card_last_four"]
    part = lambda cond: F.sum(F.when(cond, F.col("amount")).otherwise(0))
    sums = moves.groupBy(*keys).agg(part(F.col("type") == "debit").alias("d"), part(F.col("type") == "credit").alias("c"), part(F.col("sub_type") == "bill_payment").alias("b"), part(F.col("sub_type").isin("fee", "interest")).alias("f"), F.count(F.lit(1)).alias("n"))
    k, money = F.col("card_last_four").cast("int"), "decimal(18,2)"
    said = sums.select(
        *keys, F.when(k % 5 != 0, F.col("n").cast(money)).alias("previous_balance"), (F.col("n") + F.col("d") - F.col("c") + F.when(k % 3 == 1, 50).when(k % 3 == 2, 500).otherwise(0)).cast(money).alias("total_due"),
        F.when(k % 4 != 0, F.col("d") + 100 * (k % 2)).cast(money).alias("purchases"), F.when(k % 7 != 0, F.when(k % 2 == 1, F.col("b")).otherwise(F.col("c"))).cast(money).alias("payments"),
        F.lit(None).cast(money).alias("interest"), F.when(k % 3 != 0, F.col("f")).cast(money).alias("late_fee"),
    )
    df = verify.verify_card(moves, said, keys)
    return df.select(*keys, cents("computed_due").alias("computed_cents"), cents("difference").alias("difference_cents"), "total_agrees", "sums_agree", "confidence")


@query("merged_cards", "od", "with t as (select card_issuer, card_last_four, sum(case when type = 'debit' then amount else 0 end) as d, sum(case when type <> 'debit' then amount else 0 end) as c, count(*) as n from od where card_last_four::int % 9 <> 0 group by all), k as (select distinct card_issuer, card_last_four, card_last_four::int as k from od), s as (select k.*, d * (k % 3) as p, c * (k % 2) as y from k left join t using (card_issuer, card_last_four) where k % 8 <> 0), x as (select card_issuer, card_last_four, n, s.k is null as nos, n is null as nor, coalesce(p > 0 and abs(d - p) * 100 > p * 15, false)::int + coalesce(y > 0 and abs(c - y) * 100 > y * 15, false)::int as w from s full join t using (card_issuer, card_last_four)) select card_issuer, card_last_four, n, nos::int + nor::int + w as n_warnings, round(1000 * (1 - 0.1 * (nos::int + nor::int) - 0.15 * w))::bigint as confidence from x")
def merged_cards(od):
    keys, k = ["card_issuer", "card_last_four"], F.col("card_last_four").cast("int")
    rows = od.filter(k % 9 != 0)
    totals = verify.derived_totals(rows, keys)
    said = od.select(*keys).distinct().filter(k % 8 != 0).join(totals, keys, "left").select(*keys, (F.col("debits") * (k % 3)).alias("purchases"), (F.col("credits") * (k % 2)).alias("payments"))
    df = verify.merge_cards(rows, said, keys)
    return df.select(*keys, "n", F.size("warnings").alias("n_warnings"), F.round(F.col("confidence") * 1000).cast("long").alias("confidence"))


def _model():
    """A stand-in for a model, the same on every run: it reads the lines, but its first answer is no JSON if the chunk's first
    order divides by 3, its second has a row with a negative sum if it divides by 9, and all further ones if by 27."""
    ask = ASK

    def client(prompts):
        import json

        out = []
        for p in prompts:
            round_ = 1 + ("\n\nThe answer before:" in p) + ("smallest valid JSON" in p)
            lines = [x.split() for x in p.removeprefix(ask).split("\n\nThe answer before:")[0].split("\n")]
            first = int(lines[0][1])
            rows = [{"date": x[0], "description": f"order {x[1]}", "amount": float(x[2]), "type": x[3], "confidence": int(x[1]) % 10 / 10} for x in lines]
            if first % 9 == 0 and round_ == 2 or first % 27 == 0 and round_ == 3:
                rows[-1]["amount"] = -1
            out.append("I can not read this" if first % 3 == 0 and round_ == 1 else "```json\n" + json.dumps({"transactions": rows}) + "\n```")
        return out

    return client


_CHUNKS = """
l as (select card_issuer, card_last_four, ord, row_number() over w - 1 as i, count(*) over (partition by card_issuer, card_last_four) as n from od window w as (partition by card_issuer, card_last_four order by ord)),
c as (select *, unnest(case when n > 6 then range(greatest(0, ceil((n - 4) / 3))::bigint + 1) else [0] end) as chunk from l),
h as (select *, min(ord) over (partition by card_issuer, card_last_four, chunk) as first, max(ord) over (partition by card_issuer, card_last_four, chunk) as last from c where n <= 6 or i >= 3 * chunk and i < 3 * chunk + 4),
r as (select card_issuer, card_last_four, chunk, first, case when first % 3 <> 0 then 1 when first % 9 <> 0 then 2 else 3 end as attempts, first % 27 <> 0 as success, count(*) filter (first % 27 <> 0 or ord <> last) as n_rows from h group by all)"""
_CARDS = ["card_issuer", "card_last_four"]


def _texts(od):
    line = F.concat_ws(" ", F.date_format("date", "yyyy-MM-dd"), F.col("ord").cast("string"), F.col("amount").cast("string"), "type")
    return od.groupBy(*_CARDS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


@query("extraction_report", "od", f"with {_CHUNKS} select card_issuer, card_last_four, chunk::int as chunk, attempts, success, case when success then 0 else 1 end as n_errors, n_rows from r")
def extraction_report(od):
    _, report = extract(_texts(od), _CARDS, _model(), most=6, size=4, overlap=1)
    return report.select(*_CARDS, "chunk", "attempts", "success", F.size("errors").alias("n_errors"), "n_rows")


@query("extracted_rows", "od", f"with {_CHUNKS} select distinct od.id, date::date as date, round(amount * 100)::bigint as cents, type from h join od using (ord) where first % 27 <> 0 or h.ord <> last")
def extracted_rows(od):
    rows, _ = extract(_texts(od), _CARDS, _model(), most=6, size=4, overlap=1)
    return rows.select(F.substring_index("description", " ", -1).cast("long").alias("id"), F.to_date("date").alias("date"), F.round(F.col("amount") * 100).cast("long").alias("cents"), "type")


_KIND_OF = "case json_type({0}) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then null when 'OBJECT' then 'object' when 'ARRAY' then 'array' else case when {0} is not null then 'number' end end"
_ANSWER = """'{"results": [{"id": ' || case event_id % 5 when 0 then event_id::varchar when 1 then 'null' else '"' || event_id || '"' end || ', "category": "' || event_type || '", "confidence": ' || case when event_id % 7 = 0 then '"' || value || '"' else value::varchar end || case when user_id % 3 = 0 then '' else ', "source": "' || case when user_id % 3 = 1 then 'ai' else event_type end || '"' end || '}]' || case when event_id % 11 = 0 then '' else '}' end"""


@direct("answer_errors", f"""
with a as (select event_id, {_ANSWER} as said from events), j as (select event_id, case when json_valid(said) then said::json end as j from a), x as (select event_id, j, j->'$.results[0]' as r from j),
k as (select event_id, j, r, {_KIND_OF.format("(r->'$.id')")} as i, {_KIND_OF.format("(r->'$.confidence')")} as c, r->>'$.confidence' as cv, r->>'$.source' as s from x)
select event_id, case when j is null then 'answer: must be an object' else concat_ws('; ', case when i is null then 'results[0].id: missing' when i <> 'string' then 'results[0].id: must be a string, is ' || i end,
  case when c <> 'number' then 'results[0].confidence: must be a number, is ' || c when cv::double < 0 then 'results[0].confidence: must be at least 0' when cv::double > 1 then 'results[0].confidence: must be at most 1' end,
  case when s is null then 'results[0].source: missing' when s not in ('rule', 'ai', 'keyword') then 'results[0].source: must be one of rule, ai, keyword' end) end as problems from k""")
def answer_errors(spark, sf_dir):
    said = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", _ANSWER.replace("event_id::varchar", "cast(event_id as string)").replace("value::varchar", "cast(value as string)") + " as said")
    return said.select("event_id", F.array_join(schema.errors(F.try_parse_json("said"), answers.CATEGORIZE_RESPONSE), "; ").alias("problems"))


_SUMMARY = """'{"statementDate": "' || case user_id % 4 when 0 then '2024-02-30' when 1 then strftime(ts, '%d/%m/%Y') else strftime(ts, '%Y-%m-%d') end || '", "totalDue": ' || value || ', "minimumDue": ' || (user_id - 30) || ', "creditLimit": ' || case when event_id % 6 = 0 then 'null' else (100 + user_id)::varchar end || ', "availableCredit": ' || (event_id % 200) || '}'"""


@direct("card_summary_errors", f"""
with x as (select event_id, case when user_id % 4 = 0 then 'statementDate: no date' end as a, case when user_id < 30 then 'minimumDue: must be at least 0' end as b, case when value < 0 then 'totalDue: must be at least 0' end as t, case when value < user_id - 30 then 'total due below minimum due' end as c,
  case when event_id % 6 <> 0 and event_id % 200 > 100 + user_id then 'available credit beyond the limit' end as d from events)
select event_id, concat_ws('; ', a, t, b, c, d) as problems from x""")
def card_summary_errors(spark, sf_dir):
    text = _SUMMARY.replace("strftime(ts, '%d/%m/%Y')", "date_format(ts, 'dd/MM/yyyy')").replace("strftime(ts, '%Y-%m-%d')", "date_format(ts, 'yyyy-MM-dd')").replace("(100 + user_id)::varchar", "cast(100 + user_id as string)")
    said = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"{text} as said")
    return said.select("event_id", F.array_join(schema.errors(F.try_parse_json("said"), answers.CARD_SUMMARY), "; ").alias("problems"))


@direct("conversation_contexts", """
with h as (select conv_id, 'Conversation ' || conv_id || ', ' || count(*) || ' turns' as head from conversations group by conv_id),
l as (select conv_id, turn, role || ': ' || text as line from conversations where text is not null and role is not null),
r as (select l.*, row_number() over w as n, sum(length(line) + 1) over w + length(head) as run from l join h using (conv_id) window w as (partition by conv_id order by turn, line)),
k as (select conv_id, count(*) as lines, string_agg(left(line, 1200), chr(10) order by n) as t from r where run <= 1200 or n <= 3 group by conv_id),
f as (select conv_id, coalesce(lines, 0) as lines, case when t is null then head else head || chr(10) || t end as text from h left join k using (conv_id))
select conv_id, lines, case when length(text) > 1200 then left(text, 1197) || '...' else text end as text from f""")
def conversation_contexts(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    heads = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", F.concat(F.lit("Conversation "), "conv_id", F.lit(", "), "n", F.lit(" turns")).alias("head"))
    lines = turns.select("conv_id", F.concat("role", F.lit(": "), "text").alias("line"), "turn").withColumn("ord", F.struct("turn", "line"))
    return contexts(lines, ["conv_id"], letters=1200, heads=heads)


@query("prompt_batches", "ev", "with n as (select merchant, ord, id, (row_number() over (partition by merchant order by ord) - 1) // 20 as batch, id || ' ' || description as line from ev) select merchant as bucket, batch, count(*) as n, string_agg(line, chr(10) order by ord) as text from n group by all")
def prompt_batches_of_events(ev):
    return prompt_batches(ev, F.col("merchant"), F.concat(F.col("id").cast("string"), F.lit(" "), "description"))
