"""Fixtures of the text, date, money and currency functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import answers, currency, dates, money, schema, text
from tallyforge.operators import payoff, retrieve, rules, spending, verify
from tallyforge.sources import statements, store

D = dt.date(2024, 1, 15)


def one(spark, expr, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {'string' if isinstance(v, str) or v is None else 'double'}" for i, v in enumerate(values)))
    return df.select(expr(*[F.col(c) for c in df.columns]).alias("x")).first().x


@pytest.mark.parametrize(
    ("written", "value"),
    [("1,234.56", 1234.56), ("1.234,56", 1234.56), ("12,34", 12.34), ("1,234", 1234.0), ("₹ 1,23,456.78", 123456.78), ("(500.00)", -500.0), ("500 CR", 500.0), ("Rs. 500", 500.0), ("", None), ("-", None), ("--", None), ("null", None), (None, None), ("-12.5", -12.5)],
)
def test_amounts(spark, written, value):
    assert one(spark, money.parse_amount, written) == value


@pytest.mark.parametrize("written", ["2024-01-15", "15-Jan-24", "Jan 15, 2024", "15.01.2024", "20240115", "Mon, 15 Jan 2024", "15/01/2024 14:30", "15/01/2024", "01/15/2024", "15th Jan 2024", "2024/1/15"])
@pytest.mark.parametrize("order", ["DMY", "MDY"])
def test_dates(spark, written, order):
    assert one(spark, lambda c: dates.parse_date(c, order), written) == D


def test_date_edges(spark):
    f = lambda w, o="DMY": one(spark, lambda c: dates.parse_date(c, o), w)
    assert f("03/04/2024") == dt.date(2024, 4, 3) and f("03/04/2024", "MDY") == dt.date(2024, 3, 4)
    assert f("30/02/2024") is None and f("") is None and f(None) is None
    assert f("01/01/49") == dt.date(2049, 1, 1) and f("01/01/95") == dt.date(1995, 1, 1) and f("01/01/50") is None
    assert one(spark, lambda c: dates.date_in_text(c), "paid on 15/01/2024 at the shop") == D
    assert one(spark, lambda c: dates.serial_date(c), 45306.0) == D


def test_similarities(spark):
    assert abs(one(spark, text.levenshtein_similarity, "netflix", "netflux") - 6 / 7) < 1e-12
    assert one(spark, text.levenshtein_similarity, " Netflix ", "netflix") == 1 and one(spark, text.levenshtein_similarity, "", "a") == 0
    assert abs(one(spark, text.dice_similarity, "netflix", "netflux") - 2 / 3) < 1e-12 and one(spark, text.dice_similarity, "", "a") == 0


def test_merchants(spark):
    assert one(spark, text.merchant_name, "AMZN*Mktp 123456") == "Amazon"
    assert one(spark, text.merchant_key, "") == "__unknown__" and one(spark, text.merchant_key, None) == "__unknown__"
    assert one(spark, text.recurring_name, "Payment to Acme Pvt Ltd") == "acme"
    assert one(spark, text.nfkc, "ﬁne ①") == "fine 1"


@pytest.mark.parametrize(("description", "kind", "category"), [("UBER TRIP", "debit", "transportation"), ("Amazon Prime", "debit", "entertainment"), ("SALARY ACME", "credit", "income"), ("CURRENT BILL", "debit", "housing"), ("ZZZ", "debit", "other"), ("ZZZ", "credit", "income"), (None, "debit", "other")])
def test_keywords(spark, description, kind, category):
    assert one(spark, rules.keyword_category, description, kind) == category


def test_currency(spark):
    assert one(spark, currency.detect_currency, "Total: $ 500 USD") == "USD" and one(spark, currency.detect_currency, "₹ 500") == "INR" and one(spark, currency.detect_currency, "nothing") is None
    assert one(spark, currency.repair_glyphs, "â‚¹ 500") == "₹ 500"


def test_payoff(spark):
    f = spark.range(1).select(payoff.minimum_payoff(F.lit(50_000.0), F.lit(0.408)).alias("f")).first().f
    assert f.m == 176 and abs(f.i - 91_157.68) < 0.01
    never = spark.range(1).select(payoff.fixed_payoff(F.lit(50_000.0), F.lit(0.408), F.lit(100.0)).alias("f")).first().f
    assert never.m == -1 and never.i == float("inf")


def test_strategies(spark):
    cards = spark.createDataFrame([(1, 10_000.0, 0.42), (2, 3_000.0, 0.36)], "ord long, balance double, apr double")
    pay = lambda how: {r.ord: round(r.payment, 6) for r in payoff.strategy(cards, 2_000, how).collect()}
    assert pay("avalanche") == {1: 1_800, 2: 200} and pay("snowball") == {1: 500, 2: 1_500}


@pytest.mark.parametrize("how", ["avalanche", "snowball"])
def test_strategy_of_many_cards(spark, how):
    """One budget over 200,000 cards in several ranges, with equal rates and balances, against the allocation card by card."""
    cards = spark.range(200_000).select(F.col("id").alias("ord"), F.pmod(F.xxhash64("id"), F.lit(50)).cast("double").alias("balance"), (F.col("id") % 3 / 10).alias("apr"), F.lit(None).cast("string").alias("owner"))
    cards = cards.withColumn("balance", F.col("balance") * 100)
    rows = sorted(cards.collect(), key=lambda r: (-r.apr, r.ord) if how == "avalanche" else (r.balance, r.ord))
    left, paid = 150_000_000.0, {}
    for r in rows:
        paid[r.ord] = min(min(max(r.balance * payoff.MIN_PART, payoff.MIN_MONEY), r.balance), left)
        left -= paid[r.ord]
    for r in rows:
        more = min(r.balance - paid[r.ord], left)
        paid[r.ord], left = paid[r.ord] + more, left - more
    for group in (None, ["owner"]):
        got = payoff.strategy(cards, 150_000_000, how, group)
        assert got.columns == [*cards.columns, "payment", "priority"]
        got = got.collect()
        assert len(got) == len(rows) and all(abs(r.payment - paid[r.ord]) < 1e-3 for r in got)
        assert [r.ord for r in sorted(got, key=lambda r: r.priority)] == [r.ord for r in rows] and sorted(r.priority for r in got) == list(range(1, len(rows) + 1))
    assert payoff.strategy(cards.limit(0), 100, how).count() == 0


def test_columns():
    m = statements.map_columns(["Txn Date", "Narration", "Withdrawal Amount", "Deposit Amount", "Closing Balance"])
    assert m.roles == {"date": "Txn Date", "debit": "Withdrawal Amount", "credit": "Deposit Amount", "balance": "Closing Balance"} and m.description == ["Narration"]
    m = statements.map_columns(["Date", "Description", "Debit", "Credit"])
    assert m.roles["credit"] == "Credit" and m.description == ["Description"]
    with pytest.raises(ValueError):
        statements.map_columns(["Description", "Amount"])


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date, Merchant, Memo, Amount\n15/01/2024,Shop,\"a, b\",-12.50\n,skip,,1\n16/01/2024,Pay,,\"1,000.00\"\n", encoding="utf-8")
    got = sorted(statements.read_csv(spark, str(tmp_path)).collect())
    assert [(r.date, r.description, r.amount, r.type) for r in got] == [(D, "Shop — a, b", 12.5, "debit"), (dt.date(2024, 1, 16), "Pay", 1000.0, "credit")]


def test_chunks(spark):
    df = spark.createDataFrame([("\n".join(f"line {i}" for i in range(300)),), ("short",)], "text string")
    got = sorted((r.first_line, len(r.chunk_text.split("\n"))) for r in statements.chunk_plan(df).collect())
    assert got == [(0, 1), (0, 180), (168, 132)]


def test_lines_of_items(spark):
    items = spark.createDataFrame([("d", 1, 10, 700, "15/01/2024"), ("d", 1, 120, 699, "Shop"), ("d", 1, 10, 650, "more")], "doc string, page int, x int, y int, text string")
    assert [r.text for r in statements.lines_of_items(items).orderBy("line").collect()] == ["15/01/2024\tShop", "more"]


def test_routes():
    assert retrieve.route("give me an overview")["rows"] == 0 and retrieve.route("what about june")["history"] == 8
    assert retrieve.context(["x" * 50] * 10, letters=120) == "\n".join(["x" * 50] * 3)[:117] + "..."


def test_empty_ledger(spark):
    txns = spark.createDataFrame([], "id long, ord long, date timestamp_ntz, description string, amount decimal(18,2), type string, category string, category_type string, merchant string, source_type string")
    assert spending.by_month(txns).count() == 0 and spending.by_weekday(txns).count() == 7 and spending.dashboard(txns).first().n == 0


def test_stream(spark, tmp_path):
    from tallyforge.streaming.imports import import_stream

    schema = "id long, ord long, date timestamp_ntz, description string, amount decimal(18,2)"
    row = lambda i: (i, i, dt.datetime(2024, 1, i), f"shop {i}", 1)
    for k, ids in enumerate([(1, 2), (2, 3), (1, 2)]):
        from decimal import Decimal

        spark.createDataFrame([(*row(i)[:4], Decimal(1)) for i in ids], schema).write.parquet(str(tmp_path / "in" / f"b{k}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        import_stream(stream, str(tmp_path / "ledger"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "ledger")).collect()) == [1, 2, 3]


def test_clusters(spark):
    from tallyforge.operators.recurring import clusters

    names = ["Netflix", "netflix premium", "Acme Gas", "Acme Water", "gas", "The Shop", "The Bar", "shop", "zz", "pizza zz"]
    txns = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "ord long, merchant string").selectExpr("*", "merchant as description")
    got = {r.name: r.cluster for r in clusters(txns).collect()}
    assert got == {"netflix": "netflix", "netflix premium": "netflix", "acme gas": "acme gas", "acme water": "acme gas", "gas": "acme gas", "the shop": "the shop", "the bar": "the bar", "shop": "the shop", "zz": "zz", "pizza zz": "zz"}


def test_raw_texts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Details,Debit,Credit\n15/01/2024,Shop,12.50,\n16/01/2024,Pay,,99\n")
    assert statements.raw_texts(spark, str(tmp_path / "a.csv")).first().text.startswith("Date,Details")


def test_staging_and_log(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, description string")
    store.stage(rows, rows.limit(1), str(tmp_path / "staged"))
    got, report = store.staged(spark, str(tmp_path / "staged"))
    assert got.count() == 2 and report.count() == 1
    store.write_log(rows, str(tmp_path / "log"))
    assert {r.value for r in spark.read.text(str(tmp_path / "log")).collect()} == {'{"id":1,"description":"a"}', '{"id":2,"description":"b"}'}


def test_merge_confidence(spark):
    f = lambda *w: spark.range(1).select(verify.merge_confidence(F.array(*[F.lit(x) for x in w]).cast("array<string>")).alias("x")).first().x
    assert f() == 1.0 and abs(f("Duplicate rows", "balance mismatch") - 0.6) < 1e-12 and f(*["balance"] * 9) == 0.0


def test_payoff_edges(spark):
    df = spark.createDataFrame([(1, 0.5, 0.4), (2, None, 0.4), (3, 0.0, 0.4), (4, 50000.0, 0.408), (5, 100.0, None)], "id int, b double, apr double")
    got = {r.id: r.f for r in df.select("id", payoff.minimum_payoff(F.col("b"), F.col("apr")).alias("f")).collect()}
    assert got[1].m == 1 and got[3].m == 0 and got[4].m == 176 and abs(got[4].i - 91157.68) < 0.01 and got[2].m is None and got[5].m is None


def test_headers_and_context_of_currency(spark):
    f = lambda t, c=None: one(spark, lambda x: currency.repair_glyphs(x, c), t)
    assert f("C 500", "INR") == "₹500" and f("C 500") == "C 500" and f("C 1,23,456") == "₹1,23,456" and f(None) is None
    assert one(spark, currency.plain_currency, "5 Euro") == "EUR" and one(spark, currency.plain_currency, "five") is None


@pytest.mark.parametrize(
    ("written", "name", "key"),
    [
        ("POS Corner Bakery #1234567", "Corner Bakery", "CORNER BAKERY"), ("UPI-Blue Cafe REF: A1", "Blue Cafe", "BLUE CAFE"), ("Transfer to Ann 12/31", "to Ann", "TO ANN"), ("NEFT/VISA Book Shop/20231", "Book Shop", "BOOK SHOP"),
        ("Netflix.com 4499", "Netflix", "NETFLIX"), ("Tool Hut (Main St) order 55-A 10:30", "Tool Hut (Main St) order 55-A 10:30", "TOOL HUT"), ("Referral Desk", "Referral Desk", "REFERRAL DESK"), ("**Gym** & Spa 05/06", "Gym & Spa", "GYM & SPA"), ("", "", "__unknown__"),
    ],
)
def test_names_and_keys(spark, written, name, key):
    assert one(spark, text.merchant_name, written) == name and one(spark, text.merchant_key, written) == key


def test_line_description(spark):
    assert one(spark, text.clean_description, "05 Jan 2024 Corner Bakery ₹ 1,200.50 DR 10:30 pm") == "Corner Bakery"
    assert one(spark, text.clean_description, "2024-01-05 Ref No. X9 Tool Hut 12.00 CR") == "Tool Hut" and one(spark, text.clean_description, "05/01/2024 12.00") == "Transaction"


def test_contexts(spark):
    """Lines per key up to a budget, three in any case, as the driver's own version gives them."""
    given = {"a": [f"line {i} {'x' * (i * 3)}" for i in range(12)], "b": ["y" * 90] * 5, "c": ["z"], "d": []}
    lines = spark.createDataFrame([(k, i, x) for k, v in given.items() for i, x in enumerate([*v, None])], "k string, ord int, line string")
    got = {r.k: (r.lines, r.text) for r in retrieve.contexts(lines, ["k"], letters=150).collect()}
    assert {k: t for k, (_, t) in got.items()} == {k: retrieve.context(v, 150) for k, v in given.items() if v} and got["b"][0] == 3
    heads = spark.createDataFrame([("c", "H"), ("d", "only")], "k string, head string")
    more = {r.k: r.text for r in retrieve.contexts(lines.filter("k in ('c', 'd')"), ["k"], letters=150, heads=heads).collect()}
    assert more == {"c": "H\nz", "d": "only"}


def test_money_formats(spark):
    f = lambda a, c: spark.createDataFrame([(c,)], "c string").select(currency.formatted(F.lit(a).cast("decimal(18,2)"), F.col("c")).alias("x")).first().x
    assert [f("1234567.50", c) for c in ("USD", "INR", "EUR", "JPY", "SEK", "XXX")] == ["$1,234,567.50", "₹12,34,567.50", "1.234.567,50 €", "¥1,234,568", "1 234 567,50 kr", "XXX 1,234,567.50"]
    assert f("-12.00", "GBP") == "-£12" and f("0.05", "USD") == "$0.05" and f(None, "USD") is None


def test_letters_of_currency_patterns(spark):
    """Every match of a pattern holds its letters, so texts without them need no search; the scores are those of all patterns."""
    assert [currency.held_letters(p) for p in (r"\bINR\b", r"\bRs\.?\s", r"\bRupees?\b", r"COL\$", r"\bUS\s?Dollar", r"د\.إ", "Kč")] == ["inr", "rs", "rupee", "col$", "dollar", "د.إ", "kč"]
    texts = ["paid rs. 5 and RS 6", "usdollar and US Dollar", "AR$ 5 Kč 9 zł", "POUNDSTERLING", "د.إ 5", "İNR inr ſek", "", None, "Rupee rupees eur EURO fr. 9"]
    want = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    plain = F.concat(*[F.concat(F.coalesce((w * F.regexp_count("t", F.lit(f"(?i){p}"))).cast("string"), F.lit("0")), F.lit(f":{c},")) for _, c, p, w in currency.patterns()])
    for r in want.select("k", plain.alias("all"), currency.currency_scores(F.col("t")).alias("got")).collect():
        total = {}
        for part in r["all"].split(",")[:-1]:
            n, c = part.split(":")
            total[c] = total.get(c, 0) + int(n)
        assert {x.code: x.score for x in r.got} == {c: n for c, n in total.items() if n}


def test_answers_are_parsed_once(spark):
    """However many fields and limits a schema has, its column holds the answer's own expression once."""
    for kind in (answers.CARD_SUMMARY, answers.CATEGORIZE_RESPONSE):
        assert repr(schema.errors(F.try_parse_json("said"), kind)).count("parse_json") == 1
