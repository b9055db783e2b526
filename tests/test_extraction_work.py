"""The work that extraction does a chunk: a text is split once, and a plain answer is not searched for errors field by field."""

import json

from pyspark.sql import functions as F

from tallyforge.functions.answers import EXTRACTED
from tallyforge.functions.schema import errors
from tallyforge.operators import extraction
from tallyforge.sources.statements import chunk_plan


def test_a_text_is_split_once(spark):
    lines = [f"line {i}" for i in range(2_000)]
    df = chunk_plan(spark.createDataFrame([("\n".join(lines),), ("short",), (None,)], "text string"), most=6, size=4, overlap=1)
    got = df.filter("length(text) > 10").select("chunk", "first_line", "chunk_text").orderBy("chunk").collect()
    assert [tuple(r) for r in got] == [(c, 3 * c, "\n".join(lines[3 * c : 3 * c + 4])) for c in range(667)]
    assert sorted((r.chunk, r.first_line, str(r.chunk_text)) for r in df.filter("text is null or length(text) < 10").collect()) == [(0, 0, "None"), (0, 0, "short")]
    plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert all("Generate" in x for x in plan if "split(" in x) and any("split(" in x for x in plan)


def test_answers_of_odd_values(spark):
    base = {"date": "2024-01-01", "description": "a", "amount": 1.5, "type": "debit"}
    odd = ["abc", "12", 12, 1e300, 12345678901234567890123, True, None, {"x": 1}, [1], [], {}, "", "é\"\n", 0, -3, 1e-30, [["a"]], [[[True]]]]
    items = [base | {k: o} for o in odd for k in (*base, "balance", "confidence", "original_currency", "a b")] + [{k: v for k, v in base.items() if k != gone} for gone in base] + odd
    answers = [json.dumps({"transactions": [base, i]}) for i in items] + [json.dumps({"transactions": o}) for o in odd] + ["```json\n" + json.dumps({"transactions": [base] * 3}) + "\n```", json.dumps([base, 5]), "nothing", None]
    none = F.lit(None).cast("string")
    df = spark.createDataFrame(list(enumerate(answers)), "k int, answer string").select("k", extraction.read(F.col("answer"), none, none, True).alias("r"), errors(extraction.understood(F.col("answer")), EXTRACTED).alias("e"), F.to_json(extraction.understood(F.col("answer"))).alias("v"))
    seen = 0
    for r in df.collect():
        said = json.loads(r.v) if r.v else None
        listed = isinstance(said, dict) and isinstance(said.get("transactions"), list)
        assert (r.r.problems, r.r.listed) == (r.e, listed)
        whole = said["transactions"] if listed else []
        at_fault = {int(e.split("[")[1].split("]")[0]) for e in r.e if "[" in e}
        assert [(x.place, x.wrong) for x in r.r["rows"] or []] == [(i, i in at_fault) for i in range(len(whole))]
        for x in (x for x in r.r["rows"] or [] if not x.wrong):
            want = whole[x.place]
            assert (x.row.date, x.row.description, x.row.amount, x.row.type) == (want["date"], want.get("description"), float(want["amount"]), want.get("type"))
            seen += 1
    assert seen > len(items)
