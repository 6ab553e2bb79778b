"""Report files, named tables and written results."""

import datetime as dt
import uuid
import zipfile
from xml.sax.saxutils import escape

import pytest

from conftest import T1, T2, rows
from pyspark.sql import functions as F

from spendlens.operators.attribution import flag_promoted
from spendlens.operators.filters import has_rows
from spendlens.plans.load import load_reports
from spendlens.schema import CAMPAIGN_LABELS, CAMPAIGN_SCHEMA, SALES_LABELS, SALES_SCHEMA
from spendlens.sources import reports
from spendlens.sources.normalize import normalize_campaign, normalize_sales
from spendlens.sources import snapshots
from spendlens.sources.tables import register, restore, stored_bounds, table, with_headings, write_result

LEAD = [["Report", "Campaign, all"], [], ["made", "2024-02-01"]]
CAMPAIGN_CELLS = [list(CAMPAIGN_LABELS.values())] + [
    [r[0].isoformat(), r[1], r[2], r[3], r[4], r[5], *r[6:]] for r in T1
]
SALES_CELLS = [list(SALES_LABELS.values())] + [list(r) for r in T2]


def csv_file(path, cells, lead=LEAD, end="\n"):
    def text(v):
        v = "" if v is None else str(v)
        return f'"{v}"' if "," in v else v

    path.write_text("".join(",".join(map(text, row)) + end for row in [*lead, *cells]), newline="")
    return str(path)


def column_name(i):
    return chr(ord("A") + i) if i < 26 else column_name(i // 26 - 1) + column_name(i % 26)


def xlsx_file(path, cells, lead=LEAD, shared=False):
    """The smallest workbook that holds the cells; dates as day numbers."""
    texts = []

    def cell(r, c, v):
        ref = f"{column_name(c)}{r}"
        if v is None:
            return ""
        if isinstance(v, dt.date):
            return f'<c r="{ref}"><v>{(v - dt.date(1899, 12, 30)).days}</v></c>'
        if not isinstance(v, str):
            return f'<c r="{ref}"><v>{v}</v></c>'
        if shared:
            texts.append(v)
            return f'<c r="{ref}" t="s"><v>{len(texts) - 1}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'

    body = "".join(
        f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>'
        for r, row in enumerate([*lead, *cells], 1) if row
    )
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    link = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as book:
        sheets = '<sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets>'
        target = f'<Relationship Id="r1" Type="{link}/worksheet" Target="worksheets/sheet1.xml"/>'
        parts = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{link}">{sheets}</workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships {parts}>{target}</Relationships>")
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
        if shared:
            items = "".join(f"<si><t>{escape(t)}</t></si>" for t in texts)
            book.writestr("xl/sharedStrings.xml", f"<sst {main}>{items}</sst>")
    return str(path)


def without(cells, label):
    place = cells[0].index(label)
    return [[v for i, v in enumerate(row) if i != place] for row in cells]


def test_csv_report(spark, tmp_path):
    csv_file(tmp_path / "a.csv", CAMPAIGN_CELLS[:4])
    # other column order, carriage returns
    turned = [list(reversed(row)) for row in [CAMPAIGN_CELLS[0], *CAMPAIGN_CELLS[4:]]]
    csv_file(tmp_path / "b.csv", turned, end="\r\n")
    report = reports.read_report(spark, str(tmp_path), "campaign", "csv")
    assert report.rejected.count() == 0
    typed = normalize_campaign(report.table)
    assert typed.schema == CAMPAIGN_SCHEMA
    assert rows(typed) == rows(spark.createDataFrame(T1, CAMPAIGN_SCHEMA))


@pytest.mark.parametrize("shared", [False, True])
def test_xlsx_report(spark, tmp_path, shared):
    dated = [CAMPAIGN_CELLS[0]] + [[dt.date.fromisoformat(r[0]), *r[1:]] for r in CAMPAIGN_CELLS[1:]]
    xlsx_file(tmp_path / "a.xlsx", dated[:3], shared=shared)
    xlsx_file(tmp_path / "b.xlsx", [dated[0], *dated[3:]], shared=shared)
    report = reports.read_report(spark, str(tmp_path), "campaign", "xlsx")
    assert rows(normalize_campaign(report.table)) == rows(spark.createDataFrame(T1, CAMPAIGN_SCHEMA))
    assert report.rejected.count() == 0


def test_csv_split_over_blocks(spark, tmp_path):
    cells = [SALES_CELLS[0]] + [["2024-01-01", "A", str(i), 1] for i in range(3000)]
    path = csv_file(tmp_path / "big.csv", cells)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        report = reports.read_report(spark, path, "sales", "csv")
        assert report.table.rdd.getNumPartitions() > 4
        assert report.table.select("purchased_sku").distinct().count() == 3000 == report.table.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_of_many_files_takes_the_other_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reports, "BROADCAST_ROWS", 1)
    for i in range(4):
        csv_file(tmp_path / f"{i}.csv", SALES_CELLS)
    csv_file(tmp_path / "bad.csv", without(SALES_CELLS, "CAMPAIGN ID"))
    report = reports.read_report(spark, str(tmp_path), "sales", "csv")
    assert report.table.count() == 4 * len(T2) and report.rejected.count() == 1


@pytest.mark.parametrize("fmt,write", [("csv", csv_file), ("xlsx", xlsx_file)])
def test_quarantine(spark, tmp_path, fmt, write):
    write(tmp_path / f"good.{fmt}", CAMPAIGN_CELLS)
    write(tmp_path / f"no_roas.{fmt}", without(CAMPAIGN_CELLS, "ROAS"))
    write(tmp_path / f"no_date.{fmt}", without(CAMPAIGN_CELLS, "DATE"))
    write(tmp_path / f"no_place.{fmt}", without(CAMPAIGN_CELLS, "PLACEMENT TYPE"))
    write(tmp_path / f"empty.{fmt}", [], lead=LEAD[:1])
    (tmp_path / f"corrupt.{fmt}").write_bytes(b"\x00\x01 no report \xff")
    report = reports.read_report(spark, str(tmp_path), "campaign", fmt)
    errors = {r["path"].rsplit("/", 1)[1].split(".")[0]: r["error"] for r in report.rejected.collect()}
    assert set(errors) == {"no_roas", "no_date", "empty", "corrupt"}
    assert errors["no_roas"] == "missing columns: ROAS" and errors["no_date"] == "missing columns: DATE"
    assert errors["empty"] == reports.NO_HEADINGS
    assert report.table.count() == 2 * len(T1)  # the placement column may be absent
    assert reports.quarantine(spark, str(tmp_path), "campaign", fmt).count() == 4


def test_damage_late_in_a_file_rejects_all_of_it(spark, tmp_path):
    path = tmp_path / "a.xlsx"
    xlsx_file(path, CAMPAIGN_CELLS)
    with zipfile.ZipFile(path) as book:
        parts = {n: book.read(n) for n in book.namelist()}
    with zipfile.ZipFile(path, "w") as book:
        for name, content in parts.items():
            book.writestr(name, content.replace(b"</sheetData></worksheet>", b"<row") if "sheet1" in name else content)
    report = reports.read_report(spark, str(path), "campaign")
    assert report.table.count() == 0 and report.rejected.count() == 1


def test_broken_lines_reject_their_file(spark, tmp_path):
    csv_file(tmp_path / "good.csv", SALES_CELLS)
    csv_file(tmp_path / "short.csv", [*SALES_CELLS, ["2024-01-01", "A"]])
    csv_file(tmp_path / "cut.csv", SALES_CELLS)
    with open(tmp_path / "cut.csv", "a", newline="") as file:
        file.write('2024-01-01,A,"1\n2",5\n')  # a line break inside quotes
    report = reports.read_report(spark, str(tmp_path), "sales", "csv")
    errors = {r["path"].rsplit("/", 1)[1]: r["error"] for r in report.rejected.collect()}
    assert errors == {"short.csv": reports.BROKEN + "1", "cut.csv": reports.BROKEN + "2"}
    assert report.table.count() == len(T2)


def test_dates_of_cells(spark):
    cells = ["45292.75", "45292", "20240101", "2024-01-01", " 2024-01-01 18:00:00", "2958465", None]
    df = spark.createDataFrame([(c,) for c in cells], "order_date string").selectExpr(
        "*", "'7.0' AS campaign_id", "'123.0' AS purchased_sku", "CAST('1.5' AS STRING) AS total_sales")
    typed = normalize_sales(df, null_label="none").collect()
    first = dt.datetime(2024, 1, 1)
    evening = dt.datetime(2024, 1, 1, 18)
    assert [r["order_date"] for r in typed] == [evening, first, first, first, evening, dt.datetime(9999, 12, 31), None]
    assert [r["date"] for r in typed][:5] == [first.date()] * 5
    assert {(r["campaign_id"], r["purchased_sku"]) for r in typed} == {("7", "123")}
    for wrong in ("2958466", "0", "99999999", "20241301", "soon"):
        with pytest.raises(Exception):
            normalize_sales(df.withColumn("order_date", F.lit(wrong))).collect()


def test_ids_from_numbers_match(spark, tmp_path):
    promoted = [CAMPAIGN_CELLS[0]] + [[*r[:3], f"{r[3]}.0" if r[3] else None, *r[4:]] for r in CAMPAIGN_CELLS[1:]]
    campaign = normalize_campaign(reports.read_report(spark, xlsx_file(tmp_path / "c.xlsx", promoted), "campaign").table)
    sales = normalize_sales(reports.read_report(spark, xlsx_file(tmp_path / "s.xlsx", SALES_CELLS), "sales").table)
    assert flag_promoted(sales, campaign).filter("is_promoted").count() == 2


def test_unreadable_date_fails(spark, tmp_path):
    path = csv_file(tmp_path / "a.csv", [SALES_CELLS[0], ["soon", "A", "1", 3]])
    with pytest.raises(Exception):
        normalize_sales(reports.read_report(spark, path, "sales", "csv").table).collect()


def test_load_reports(spark, tmp_path):
    campaign = xlsx_file(tmp_path / "c.xlsx", CAMPAIGN_CELLS)
    sales = xlsx_file(tmp_path / "s.xlsx", SALES_CELLS)
    loaded = load_reports(spark, campaign, sales)
    assert loaded.rejected.count() == 0
    assert table(spark, "campaign_summary").count() == len(T1)
    days = rows(table(spark, "sales_report"), "date", "order_date")
    assert days[0] == (dt.date(2024, 1, 1), dt.datetime(2024, 1, 1))
    # a second load replaces the first
    half = spark.createDataFrame(table(spark, "sales_report").limit(2).collect(), SALES_SCHEMA)
    register(half, "sales_report", durable=True)
    assert table(spark, "sales_report").count() == 2
    # one report alone; the other stays, and rows without a campaign get a name
    alone = load_reports(spark, campaign_paths=campaign, null_label="none")
    assert alone.sales.count() == 2 and alone.campaign.filter("campaign_id = 'none'").count() == 1
    assert "parquet" in alone.campaign._jdf.queryExecution().toString().lower()
    with pytest.raises(ValueError):
        load_reports(spark)
    for name in ("campaign_summary", "sales_report"):
        spark.sql(f"DROP TABLE {name}")


def test_a_failed_load_leaves_the_old_table(spark):
    name = f"kept_{uuid.uuid4().hex}"
    first = register(spark.range(5).withColumnRenamed("id", "n"), name, durable=True)
    broken = spark.range(100).select(F.when(F.col("id") == 99, F.raise_error(F.lit("half-way")).cast("long")).otherwise(F.col("id")).alias("n"))
    with pytest.raises(Exception, match="half-way"):
        register(broken, name, durable=True)
    assert spark.table(name).count() == 5 and len(snapshots.folders(spark, name)) == 1
    # a table may be made from itself; those read before keep their version
    register(spark.table(name).filter("n > 1"), name, durable=True)
    assert spark.table(name).count() == 3 and first.count() == 5
    assert [r["version"] for r in snapshots.entries(spark, name)] == [1, 2]
    assert restore(spark, name, 1).count() == 5 and restore(spark, name).count() == 3
    spark.sql(f"DROP TABLE {name}")
    assert restore(spark, name).count() == 3  # as a new session finds it
    spark.sql(f"DROP TABLE {name}")
    with pytest.raises(ValueError):
        restore(spark, "never_loaded")


def test_bounds_of_a_stored_table_come_from_footers(spark, t1):
    name = f"bounds_{uuid.uuid4().hex}"
    register(t1.repartition(3), name, durable=True)
    found = stored_bounds(spark, name)
    plan = found._jdf.queryExecution().toString()
    assert "PushedAggregation: [MIN(date), MAX(date)]" in plan
    assert tuple(found.first()) == (dt.date(2024, 1, 1), dt.date(2024, 1, 3))
    register(t1.limit(0), name, durable=True)
    assert tuple(stored_bounds(spark, name).first()) == (None, None)
    spark.sql(f"DROP TABLE {name}")
    t1.createOrReplaceTempView("bounds_view")
    with pytest.raises(ValueError, match="durable"):
        stored_bounds(spark, "bounds_view")
    spark.catalog.dropTempView("bounds_view")


def test_a_text_report_is_scanned_once(spark, tmp_path):
    path = csv_file(tmp_path / "a.csv", SALES_CELLS)
    report = reports.read_report(spark, path, "sales", "csv")
    for df in (report.table, report.rejected):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "a.csv" not in plan and "FileScan text" not in plan and "report-lines" in plan


def test_views_instead_of_tables(spark, tmp_path):
    loaded = load_reports(spark, sales_paths=xlsx_file(tmp_path / "s.xlsx", SALES_CELLS), durable=False)
    assert loaded.sales.count() == len(T2) and not has_rows(loaded.campaign)
    spark.catalog.dropTempView("sales_report")


def test_tables_are_empty_before_any_load(spark):
    empty = table(spark, "campaign_summary")
    assert empty.schema == CAMPAIGN_SCHEMA and not has_rows(empty)
    with pytest.raises(ValueError):
        table(spark, "nothing")


def test_require_columns(t1):
    assert reports.require_columns(t1) is t1
    with pytest.raises(ValueError, match="ctr, roas"):
        reports.require_columns(t1.drop("roas", "ctr"))


def test_headings(t1):
    renamed = with_headings(t1.select("campaign_id", "total_sales", "date").withColumnRenamed("date", "day"))
    assert renamed.columns == ["CAMPAIGN ID", "TOTAL SALES", "day"]


def test_write_result(spark, t1, tmp_path):
    flat = t1.select("campaign_id", "clicks", "date")
    for fmt, reader in (("parquet", spark.read.parquet), ("csv", lambda p: spark.read.csv(p, header=True))):
        write_result(flat, str(tmp_path / fmt), fmt)
        assert reader(str(tmp_path / fmt)).count() == len(T1)
    write_result(flat, str(tmp_path / "days"), partition_by="date")
    assert (tmp_path / "days" / "date=2024-01-01").exists()
    with pytest.raises(ValueError):
        write_result(flat, str(tmp_path / "x"), "xlsx")
