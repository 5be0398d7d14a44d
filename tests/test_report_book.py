import io
import random
import zipfile
import zlib

from pyspark.sql import functions as F
from test_matching import SOURCES, frame, inv, led

from ledgerloom.operators import matching, report
from ledgerloom.plans.model import SCENARIOS
from ledgerloom.sources import report_book, xlsx


def test_check_sums_and_streams_join():
    rng = random.Random(3)
    for _ in range(50):
        parts = [rng.randbytes(rng.choice((0, 1, 100, 3_000_000))) if rng.random() < 0.2 else b"abc" * rng.randrange(500) for _ in range(rng.randint(0, 5))]
        crc = 0
        for p in parts:
            crc = report_book.crc_of_both(crc, zlib.crc32(p), len(p))
        assert crc == zlib.crc32(b"".join(parts))
        assert zlib.decompress(b"".join(map(report_book.pack, parts)) + report_book.STREAM_END, -15) == b"".join(parts)


def test_archives_open():
    out = io.BytesIO()
    z = report_book.Archive(out)
    z.file("a/é.xml", "một")
    z.begin("b")
    for text in ("x" * 10_000, "", "y"):
        z.text(text)
    z.end()
    z.close()
    with zipfile.ZipFile(out) as book:
        assert book.testzip() is None and book.namelist() == ["a/é.xml", "b"]
        assert book.read("a/é.xml").decode() == "một" and book.read("b") == b"x" * 10_000 + b"y"


def test_a_table_over_several_sheets(spark, tmp_path):
    df = spark.range(0, 2500, numPartitions=5).select(F.col("id"), F.concat(F.lit("tên & <"), F.col("id").cast("string"), F.lit("\x01")).alias("name"), (F.col("id") / 4).cast("decimal(18,2)").alias("amount"), F.when(F.col("id") % 3 == 0, "đ").alias("maybe"))
    assert report_book.export_table(df, [F.desc("id")], tmp_path / "t.xlsx", "Bảng", per_sheet=1000) == 2500
    content = (tmp_path / "t.xlsx").read_bytes()
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        assert list(xlsx.sheet_paths(book)) == ["Bảng", "Bảng (2)", "Bảng (3)"] and book.testzip() is None
    rows = []
    for name in ("Bảng", "Bảng (2)", "Bảng (3)"):
        head, *more = xlsx.sheet_rows(content, name)
        assert head == ["id", "name", "amount", "maybe"]
        rows += more
    want = [[str(i), f"tên & <{i}", xlsx.cell_text("n", repr(i / 4), []), *(["đ"] if i % 3 == 0 else [])] for i in reversed(range(2500))]
    assert rows == want
    assert report_book.export_table(df.limit(0), [F.col("id")], tmp_path / "e.xlsx") == 0
    assert list(xlsx.sheet_rows((tmp_path / "e.xlsx").read_bytes())) == [["id", "name", "amount", "maybe"]]


def test_report_by_tasks_equals_the_drivers(spark, tmp_path):
    session = SCENARIOS["scenario_revenue_standard"].session("s", SOURCES)
    left, right = [inv(f"p{i}", str(i), 100 + i) for i in range(40)], [led(f"r{i}", str(i), 100 + i * (i % 3)) for i in range(5, 45)]
    frames = matching.reconcile(session, {"inv": frame(spark, left), "led": frame(spark, right)})
    told = report_book.export_report(frames, tmp_path / "tasks.xlsx", "Hóa đơn", per_sheet=30)
    sheets = {name: xlsx.values_of(report.report_sheet(frames, only, "Hóa đơn")) for name, only in (("Sai lech & Can chu y", True), ("Chi tiet tat ca", False))}
    xlsx.write_workbook(tmp_path / "driver.xlsx", sheets)
    content, plain = (tmp_path / "tasks.xlsx").read_bytes(), (tmp_path / "driver.xlsx").read_bytes()
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = list(xlsx.sheet_paths(book))
    assert names[0] == "Tong quan" and told["rows"]["Chi tiet tat ca"] > 40
    for name in sheets:
        got = [list(xlsx.sheet_rows(content, n)) for n in names if n.startswith(name[:20])]
        assert [got[0][0]] + [row for rows in got for row in rows[1:]] == list(xlsx.sheet_rows(plain, name)) and len(got) == -(-told["rows"][name] // 30)
