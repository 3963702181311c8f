"""CSV records against Python's reader, at any number of splits and files."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from intakespark.sources.contacts import load_contacts, read_contacts
from intakespark.sources.records import ends_open, read_header, read_records
from intakespark.sources.settings import load_settings

HEADER = 'id,"note, or\nmessage",id,e-mail\n'
ROWS = (
    'L-1,"two\nlines, and a ""quoted"" word",A-1,a@b.com\n',
    "L-2,plain,A-2,c@d.com\r\n",
    'L-3,5" pipe and a 3" one,A-3\n',
    "\n",
    'L-4,"closed"x"y,A-4,e@f.com,more,"and\nmore"\n',
    '"","\n\n\n",\n',
    'L-5,"ends with a quote\n""","A\n-5",g@h.com\n',
    "L-6,é ü 你好 — ok,A-6,i@j.com\n",
    ' "L-7" , "not\n',
    '"a\r\nb",c\n',
)


def text_of(rng, n):
    return HEADER + "".join(rng.choice(ROWS) for _ in range(n))


def expected(files):
    out = []
    for raw in files:
        rows = [r for r in csv.reader(io.StringIO(raw.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n"))) if r]
        out += rows[1:]
    return out


def got(spark, path, **how):
    rows = read_records(spark, str(path), **how).collect()
    assert sorted(r.seq for r in rows) == list(range(len(rows)))
    return [r.cells for r in sorted(rows, key=lambda r: r.seq)]


def test_lines():
    rng = random.Random(3)
    for _ in range(3_000):
        line = "".join(rng.choices('",ab', k=rng.randint(0, 9)))
        for start in (False, True):
            # Two records come out unless the line leaves its cell open.
            rows = list(csv.reader(([f'"x\n'] if start else []) + [line + "\n", "z\n"]))
            assert ends_open(line, start) == (rows[-1] != ["z"]), (line, start)


@pytest.mark.parametrize("split", ["31b", "64b", "257b", "1m"])
def test_any_split(spark, tmp_path, split):
    rng = random.Random(7)
    files = [text_of(rng, n).encode() for n in (40, 0, 25)] + [HEADER.encode() + b"L-8,\xff\xfe bad \xc3(,A-8,\xe9\n"]
    files.append(HEADER.encode() + b'L-9,"' + b"a long cell, over many splits\n" * 30 + b'",A-9,z\nL-10,x,y,z\n')
    for k, raw in enumerate(files):
        (tmp_path / f"part-{k}.csv").write_bytes(raw)
    (tmp_path / "part-9.csv").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for packed in ("4194304", "1"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", packed)
            assert got(spark, tmp_path) == expected(files)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_odd_files(spark, tmp_path):
    path = tmp_path / "open.csv"
    path.write_bytes(b'a,b\n1,"never closed\n2,3\n')
    assert got(spark, path) == [["1", "never closed\n2,3"]]
    path.write_bytes(b"\n\n\xef\xbb\xbfa,b\r1,2\r\r3\r")
    assert got(spark, path) == [["1", "2"], ["3"]]
    path.write_bytes("x;y,é\n1,ß\n".encode("latin-1"))
    assert read_header(spark, str(path), "latin-1") == ["x;y", "é"] and got(spark, path, encoding="latin-1") == [["1", "ß"]]
    path.write_bytes(b"")
    assert got(spark, path) == [] and read_header(spark, str(path)) == []
    path.write_bytes(b"1,2\n3,4\n")
    assert got(spark, path, with_header=False) == [["1", "2"], ["3", "4"]]
    with pytest.raises(ValueError, match="UTF-8"):
        read_records(spark, str(path), "utf-16")


def test_contacts_of_files(spark, tmp_path):
    rng = random.Random(1)
    for k in range(3):
        (tmp_path / f"{k}.csv").write_bytes(text_of(rng, 30).encode())
    assert read_header(spark, str(tmp_path)) == ["id", "note, or\nmessage", "id", "e-mail"]
    rows = expected([(tmp_path / f"{k}.csv").read_bytes() for k in range(3)])
    settings = load_settings(data={"mapping": {"lead_id": ["id"], "notes": ["note or message"], "email": ["e-mail"], "title": ["role"]}})
    cell = lambda r, k: r[k] if k < len(r) else ""
    for df in (load_contacts(spark, str(tmp_path), settings=settings), read_contacts(spark, str(tmp_path), settings.fields)):
        found = df.orderBy("seq").select("seq", "lead_id", "notes", "email", "title", F.size("raw").alias("n"), F.col("raw")["id"].alias("raw_id")).collect()
        assert [tuple(r) for r in found] == [(k, cell(r, 2), cell(r, 1), cell(r, 3), "", 3, cell(r, 2)) for k, r in enumerate(rows)]
    one = load_contacts(spark, b"id,notes\nL-1,\xff\n").first()
    assert (one.lead_id, one.notes) == ("L-1", "�")
