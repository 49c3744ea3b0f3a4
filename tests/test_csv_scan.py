"""The split scan of CSV against Python's reader, with files cut at many places."""

import csv
import io
import random

import pytest

from lodestone.sources.csv_scan import csv_scan


def scan(spark, path, cut):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    for n in names:
        spark.conf.set(n, str(cut))
    try:
        return sorted(csv_scan(spark, str(path)).drop("_path").collect())
    finally:
        for n in names:
            spark.conf.unset(n)


def expected(data):
    reader = csv.reader(io.StringIO(data.replace("\r\n", "\n"), newline=""), strict=True)
    rows, last = [], 0
    for row in reader:
        if row:
            rows.append((reader.line_num, last, row))
        last = reader.line_num
    return [r for _, _, r in rows]


@pytest.mark.parametrize("cut", [7, 23, 64, 1 << 20])
def test_cut_anywhere(spark, tmp_path, cut):
    r = random.Random(cut)
    cell = lambda: r.choice(["", "a", 'say "x"', "two\nlines", "\n\n", 'q"\n,"z', "a,b", "é", " pad ", "\u0001"])
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\r\n")
    w.writerow(["id", "x y", "z"])
    for k in range(30):
        w.writerow([k, cell(), cell()])
        if k % 7 == 0:
            out.write("\r\n")
    data = out.getvalue()
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + data.encode())
    got, lines = scan(spark, tmp_path / "a.csv", cut), data.replace("\r\n", "\n").split("\n")
    want = expected(data)
    assert [list(g[2:]) for g in got] == want[1:]
    assert [g[0] for g in got] == list(range(1, 31))
    assert all(lines[g[1] - 1].startswith(f"{g[2]},") for g in got)


@pytest.mark.parametrize("bad", ['a,b\n1,x"y\n', 'a,b\n1,"x"y\n', 'a,b\n1,"x\n', "a,b\n1\n", "a,b\n1,2,3\n", "a,a\n1,2\n", "a,\n1,2\n"])
def test_malformed_files_fail(spark, tmp_path, bad):
    (tmp_path / "a.csv").write_text(bad)
    with pytest.raises(Exception):
        csv_scan(spark, str(tmp_path / "a.csv")).where("a = 'none'").count()
