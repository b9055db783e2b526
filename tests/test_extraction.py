"""Chunks, rounds and best effort with a client whose answers are known; validators against hand-made JSON."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import answers
from tallyforge.functions.json import json_of
from tallyforge.functions.schema import errors
from tallyforge.operators.extraction import ASK, extract


def made():
    """Nested, so that tasks get the function and not the name of this module."""
    import json

    ask = ASK

    def client(prompts):
        out = []
        for p in prompts:
            if "crash" in p:
                raise RuntimeError("no model")
            again = "The answer before:" in p
            lines = p.removeprefix(ask).split("\n\nThe answer before:")[0].split("\n")
            rows = [{"date": x.split()[0], "description": x.split()[1], "amount": float(x.split()[2]), "type": "debit"} for x in lines if x]
            if any("twice" in x for x in lines) and not again:
                out.append("Sorry, I can not")
            elif any("never" in x for x in lines):
                out.append(json.dumps({"transactions": [r | {"amount": -1} if r["description"] == "never" else r for r in rows]}))
            elif any("fenced" in x for x in lines):
                out.append("Here:\n```json\n" + json.dumps({"transactions": rows}) + "\n```")
            elif any("list" in x for x in lines):
                out.append(json.dumps(rows))
            else:
                out.append(json.dumps({"transactions": rows}))
        return out

    return client


def test_extract(spark):
    line = lambda i, w="shop": f"2024-01-{i + 1:02d} {w} {i + 1}.5"
    texts = [("plain", "\n".join(line(i) for i in range(10))), ("twice", "\n".join(line(i, "twice" if i == 5 else "shop") for i in range(10))), ("never", "\n".join(line(i, "never" if i == 9 else "shop") for i in range(10))), ("fenced", line(0, "fenced")), ("list", line(0, "list")), ("crash", "crash"), ("empty", ""), ("null", None)]
    rows, report = extract(spark.createDataFrame(texts, "k string, text string"), ["k"], made(), batch=1, letters=10_000, most=6, size=4, overlap=1)
    got, said = {}, {(r.k, r.chunk): r for r in report.collect()}
    for r in rows.collect():
        got.setdefault(r.k, []).append((r.date, r.description, r.amount))
    want = lambda k: sorted((x.split()[0], x.split()[1], float(x.split()[2])) for x in dict(texts)[k].split("\n"))
    assert all(sorted(got[k]) == want(k) for k in ("plain", "twice", "fenced", "list"))
    assert sorted(got["never"]) == want("never")[:-1] and "crash" not in got and "empty" not in got
    assert [said["plain", c].attempts for c in range(3)] == [1, 1, 1] and {k for k, _ in said} == set(dict(texts)) - {"null"}
    assert [(said["twice", c].attempts, said["twice", c].success) for c in range(3)] == [(1, True), (2, True), (1, True)]
    last = said["never", 2]
    assert (last.attempts, last.success, last.n_rows, last.errors) == (3, False, 3, ["transactions[3].amount: must be above 0"])
    assert said["crash", 0].errors == ["client failed: RuntimeError: no model"] and said["crash", 0].attempts == 3
    assert said["empty", 0].success and said["empty", 0].n_rows == 0


def test_extract_nothing(spark):
    rows, report = extract(spark.createDataFrame([], "k string, text string"), ["k"], made())
    assert rows.count() == 0 and report.count() == 0


@pytest.mark.parametrize(
    ("schema", "text", "want"),
    [
        ("CATEGORIZE_RESPONSE", '{"results": [{"id": "a", "category": "x", "confidence": 0.5, "source": "ai"}]}', []),
        ("CATEGORIZE_RESPONSE", '{"results": [{"id": 1, "confidence": 2, "source": "me"}, 5]}', ["results[0].id: must be a string, is number", "results[0].category: missing", "results[0].confidence: must be at most 1", "results[0].source: must be one of rule, ai, keyword", "results[1]: must be an object, is number"]),
        ("CATEGORIZE_RESPONSE", "[]", ["answer: must be an object"]), ("CATEGORIZE_RESPONSE", None, ["answer: must be an object"]), ("CATEGORIZE_RESPONSE", '{"results": null}', ["results: missing"]),
        ("CARD_SUMMARY", '{"statementDate": "2024-02-30", "totalDue": 5, "minimumDue": 6, "creditLimit": -1, "availableCredit": null}', ["statementDate: no date", "creditLimit: must be at least 0", "total due below minimum due"]),
        ("BANK_SUMMARY", '{"statementDate": "05/01/2024"}', []),
        ("INSIGHTS_REQUEST", '{"analytics": {"totalTransactions": 1.5, "byCategory": {"food": {"count": -1}, "x": 3}, "byCategoryByMonth": {"a": {"b": "c"}}}, "currency": {"code": "EURO", "symbol": "x", "name": "y"}}', ["analytics.totalTransactions: must be whole", "analytics.byCategory.food.count: must be at least 0", "analytics.byCategory.x: must be an object, is number", "analytics.byCategoryByMonth.a.b: must be a number, is string", "currency.code: longer than 3"]),
        ("CATEGORIZE_REQUEST", '{"transactions": [{"id": "", "amount": "x1", "type": "debit"}, {"id": "b", "amount": "12.5", "type": "income"}, {"id": "c", "amount": 3, "type": "gift"}]}', ["transactions[0].id: shorter than 1", "transactions[0].amount: must be a number", "transactions[2].type: must be one of credit, debit, income, expense, transfer"]),
    ],
)
def test_schemas(spark, schema, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(errors(F.try_parse_json("t"), getattr(answers, schema)).alias("e")).first().e == want


def test_insights(spark):
    text = 'Sure! {"insights": [{"type": "odd", "title": "A", "description": "B", "severity": "bad"}, {"title": "", "description": "C"}, {"type": "anomaly", "title": "D", "description": "E", "severity": "warning", "category": "x"},]}'
    df = spark.createDataFrame([(text,), ("nothing",), (None,)], "t string").select(answers.insights(F.col("t")).alias("i"), json_of(F.col("t")).isNull().alias("none"))
    got = df.collect()
    assert [tuple(x) for x in got[0].i] == [("category_trend", "A", "B", "info", None), ("anomaly", "D", "E", "warning", "x")]
    assert got[1].i == [] and got[2].i == [] and got[1].none and not got[0].none
