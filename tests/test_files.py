"""A folder of statements to staged rows, and the stored ledger."""

import datetime as dt
import os
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import files, store
from tallyforge.streaming.imports import import_stream

D = dt.date(2024, 1, 15)
LEDGER = "id string, ord long, date timestamp_ntz, description string, amount decimal(18,2), type string, category string, merchant string"


def workbook(path, sheets):
    """An xlsx file by hand: shared and inline texts, numbers, and cells left out."""
    texts, parts = [], {}
    for k, (_, rows) in enumerate(sheets):
        xml = ""
        for i, row in enumerate(rows, 1):
            cells = ""
            for j, v in enumerate(row):
                at = f'r="{chr(65 + j)}{i}"'
                if isinstance(v, str) and j % 2:
                    cells += f'<c {at} t="inlineStr"><is><t>{v}</t></is></c>'
                elif isinstance(v, str):
                    texts.append(v)
                    cells += f'<c {at} t="s"><v>{len(texts) - 1}</v></c>'
                elif v is not None:
                    cells += f"<c {at}><v>{v}</v></c>"
            xml += f'<row r="{i}">{cells}</row>'
        parts[f"xl/worksheets/sheet{k + 1}.xml"] = f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{xml}</sheetData></worksheet>'
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts["xl/workbook.xml"] = f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k + 1}" r:id="rId{k + 1}"/>' for k, (n, _) in enumerate(sheets)) + "</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = "<Relationships>" + "".join(f'<Relationship Id="rId{k + 1}" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(len(sheets))) + "</Relationships>"
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{main}">' + "".join(f"<si><t>{t}</t></si>" for t in texts) + "</sst>"
    with zipfile.ZipFile(path, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)


@pytest.fixture
def folder(tmp_path):
    f = tmp_path / "in"
    (f / "sub").mkdir(parents=True)
    (f / "dmy.csv").write_text("Bank of X\n\nDate,Details,Debit (GBP),Credit (GBP),Balance\n15/01/2024,Netflix plan,12.50,,100\n03/02/2024,Pay,,\"1,099.00\",1199\n,nothing,1,,\n")
    (f / "sub" / "mdy.csv").write_text("Date;Memo;Amount\n01/15/2024;Shop;-3,50\n02/03/2024;Shop;4\n", encoding="utf-8-sig")
    workbook(f / "book.xlsx", [("Info", [["Hello", "there"]]), ("B", [["Date", "Narration", "Amount", "Type"], ["15-Jan-2024", "Cab", 7, "DR"], [45306, "Cab fare", 8.25, "CR"], [None, "x", 5, None]]), ("C", [["Date", "Amount"], ["15-Jan-2024", 1]])])
    (f / "broken.xlsx").write_bytes(b"no zip")
    (f / "empty.csv").write_text("")
    (f / "blank.csv").write_text("\n")
    (f / "nodate.csv").write_text("Name,Amount\nx,1\n")
    (f / "scan.pdf").write_bytes(b"%PDF")
    return str(f)


def test_folder(spark, folder, tmp_path):
    rows, report = files.stage_folder(spark, folder, str(tmp_path / "staging"))
    got = sorted((os.path.basename(r.path), r.date, r.description, float(r.amount), r.type) for r in rows.collect())
    assert got == [
        ("book.xlsx", D, "Cab", 7.0, "debit"), ("book.xlsx", D, "Cab fare", 8.25, "credit"), ("dmy.csv", D, "Netflix plan", 12.5, "debit"), ("dmy.csv", dt.date(2024, 2, 3), "Pay", 1099.0, "credit"),
        ("mdy.csv", D, "Shop", 3.5, "debit"), ("mdy.csv", dt.date(2024, 2, 3), "Shop", 4.0, "credit"),
    ]
    assert rows.filter("needs_review and categorized_by = 'keyword' and category_confidence = 0.3 and merchant is not null").count() == 6
    said = {os.path.basename(r.path): r for r in report.collect()}
    assert {k for k, r in said.items() if r.problem} == {"broken.xlsx", "blank.csv", "nodate.csv", "scan.pdf"}
    assert said["scan.pdf"].problem == "ValueError: no reader for .pdf files; there are csv, xlsx" and said["blank.csv"].problem == "no columns of dates and amounts" and "empty.csv" not in said and said["nodate.csv"].problem == "no columns of dates and amounts"
    assert (said["mdy.csv"].date_order, said["dmy.csv"].date_order, said["dmy.csv"].currency, said["book.xlsx"].sheet) == ("MDY", "DMY", "GBP", "B")
    assert (said["dmy.csv"].n_rows, said["dmy.csv"].n_ledger, said["dmy.csv"].last_date) == (3, 2, dt.date(2024, 2, 3))
    ledger = store.Ledger(spark, str(tmp_path / "ledger"), LEDGER)
    store.accept(ledger, str(tmp_path / "staging"), rows.filter("description = 'Cab'").select("id", F.lit("travel").alias("category")))
    assert ledger.read().count() == 6 and ledger.read().filter("category = 'travel' and description = 'Cab'").count() == 1
    files.stage_folder(spark, folder, str(tmp_path / "staging"))
    store.accept(ledger, str(tmp_path / "staging"))
    assert ledger.read().count() == 6


def test_other_decoders(spark, folder):
    rows, report = files.read_folder(spark, folder + "/scan.pdf", {"pdf": lambda content: iter([("", ["Date", "Details", "Amount"]), ("", ["2024-01-15", content.decode(), "5"])])})
    assert [(r.date, r.description, r.amount) for r in rows.collect()] == [(D, "%PDF", Decimal(5))] and report.first().problem is None


def _rows(spark, *values):
    return spark.createDataFrame([(str(i), i, None if m is None else dt.datetime(2024, m, 1 + i % 20), f"shop {i}", Decimal(i), "debit", "other", "m") for i, m in values], LEDGER)


def _files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_ledger_changes(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger = store.Ledger(spark, path, LEDGER)
    assert ledger.read().count() == 0
    ledger.update(_rows(spark, (1, 1)).select("id", "category"))
    ledger.append(_rows(spark, *[(i, 1 + i % 4) for i in range(1, 41)], (41, None)))
    before = _files(path)
    ledger.update(spark.createDataFrame([("3", "food", None), ("99", "x", None)], "id string, category string, merchant string"))
    after = _files(path)
    assert {f for f in before if "month=2024-04" not in f} == {f for f in after if "month=2024-04" not in f} and before != after
    assert {(r.id, r.category, r.merchant) for r in ledger.read().filter("category != 'other'").collect()} == {("3", "food", "m")}
    # A row that moves takes the other month along; a month that is left empty goes.
    ledger.delete(ledger.read().filter("id != '5' and month(date) = 2"))
    ledger.update(spark.createDataFrame([("5", dt.datetime(2024, 3, 30))], "id string, date timestamp_ntz"))
    assert ledger.read().filter("month(date) = 3").count() == 11 and not any("month=2024-02" in f for f in _files(path))
    ledger.delete(spark.createDataFrame([("41",)], "id string"))
    assert ledger.read().filter("date is null").count() == 0 and ledger.read().count() == 31
    ledger.clear()
    assert ledger.read().count() == 0


def test_ledger_killed(spark, tmp_path):
    """A change that fails while it runs leaves every file as it was."""
    path = str(tmp_path / "ledger")
    ledger = store.Ledger(spark, path, LEDGER)
    ledger.append(_rows(spark, *[(i, 1 + i % 4) for i in range(1, 41)]))
    before, rows = _files(path), sorted(ledger.read().collect())
    with pytest.raises(Exception, match="half-way"):
        ledger.rewrite(["2024-01", "2024-02"], lambda df: df.withColumn("category", F.when(F.col("id") == "36", F.raise_error(F.lit("half-way"))).otherwise(F.lit("lost"))))
    with pytest.raises(Exception, match="half-way"):
        ledger._put(ledger.read(["2024-01"]).withColumn("category", F.when(F.col("id") == "36", F.raise_error(F.lit("half-way"))).otherwise(F.lit("lost"))), "overwrite")
    assert _files(path) == before and sorted(ledger.read().collect()) == rows


def test_import_reads_own_months(spark, tmp_path):
    ledger = store.Ledger(spark, str(tmp_path / "ledger"), LEDGER)
    ledger.append(_rows(spark, *[(i, 1 + i % 4) for i in range(1, 41)]))
    batch = _rows(spark, (4, 1), (44, 1), (44, 1))
    plan = ledger.new_rows(batch)._jdf.queryExecution().executedPlan().toString()
    scan = [x for x in plan.split("\n") if "PartitionFilters" in x]
    assert any("2024-01" in x for x in scan) and not any("2024-02" in x for x in scan)
    # Repeats within a batch stay; those of the ledger do not, however late they come.
    assert sorted(r.id for r in ledger.new_rows(batch).collect()) == ["44", "44"]


def test_stream_is_repeatable(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "ledger")
    for k in range(2):
        _rows(spark, *[(i, 1 + i % 4) for i in range(k, 20)]).write.parquet(f"{source}/{k}")
        stream = spark.readStream.schema(LEDGER).option("recursiveFileLookup", "true").parquet(source)
        import_stream(stream, path, str(tmp_path / f"state{k}")).awaitTermination()
    assert store.Ledger(spark, path, LEDGER).read().count() == 20
