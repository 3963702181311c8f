import datetime
import re

from pyspark.sql import functions as F

from intakespark.llm import pii_feistel as p


def swap(spark, texts, key=p.DEMO_KEY):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, r.n_private) for r in p.pseudonymise(df, key).orderBy("doc_id").collect()]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban_good(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_formats_are_kept(spark):
    values = ["jo.doe+x7@example.co.uk", "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32", "123-45-6789", "192.168.10.250", "2021-02-28", "31.12.1999", "+44 20 7946 0958"]
    got = swap(spark, [f"see {v}, ok" for v in values])
    for v, (t, n) in zip(values, got):
        new = t.removeprefix("see ").removesuffix(", ok")
        assert n == 1 and new != v, v
        kinds = lambda s: re.sub("[0-9]", "0", s)
        if v[0] not in "jG1":
            assert kinds(new) == kinds(v), v
    new = [t[4:-4] for t, _ in got]
    assert new[0].endswith("@example.co.uk") and re.fullmatch(r"[a-z]{2}\.[a-z]{3}\+[a-z][0-9]", new[0].split("@")[0])
    assert luhn(new[1].replace(" ", "")) and iban_good(new[2]) and new[2].startswith("GB")
    area, group, serial = new[3].split("-")
    assert area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
    assert all(0 <= int(x) <= 255 for x in new[4].split("."))
    assert datetime.date.fromisoformat(new[5]) and datetime.datetime.strptime(new[6], "%d.%m.%Y") and new[7].startswith("+44 ")


def test_equal_values_stay_linked(spark):
    (a, n), (b, _), (c, _) = swap(spark, ["a@b.org wrote", "to a@b.org and a@b.org", "c@b.org"])
    assert n == 1 and b == f"to {a.split()[0]} and {a.split()[0]}" and c.split("@")[0] != a.split("@")[0]
    assert swap(spark, ["a@b.org wrote"], "another key")[0][0] != a


def test_what_is_not_valid_stays(spark):
    texts = ["card 4111 1111 1111 1112", "GB82 WEST 1234 5698 7654 33", "666-12-3456", "1.2.3.999", "2021-13-45", "version 1.2.3", "no data here", "", None]
    assert swap(spark, texts) == [(t, 0) for t in texts]


def test_pairs_are_permuted(spark):
    n, m = 7, 9
    df = spark.range(n * m).select(p.permute_pair(F.col("id") % n, F.floor(F.col("id") / n), n, m, "test", "k").alias("p"))
    got = {(r.p.a, r.p.b) for r in df.collect()}
    assert len(got) == n * m and all(0 <= a < n and 0 <= b < m for a, b in got)


def test_signs_are_permuted(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    got = {r.n for r in df.select(p.permute_signs(F.col("v"), "test", "k").alias("n")).collect()}
    assert len(got) == 1000 and all(re.fullmatch("[0-9]{3}", x) for x in got)


def test_long_and_repeated(spark):
    text = "word " * 60_000 + "a@b.org " * 300
    (long, n), (again, _) = swap(spark, [text, text])
    assert n == 300 and long == again and "a@b.org" not in long and len(long) == len(text)


def test_values_with_neighbours(spark):
    """(before, value, behind): the value goes, what stands around it stays."""
    cases = [
        ("pay BE68 5390 0754 7034", " USD 500"), ("BE68 5390 0754 7034", " AND 12"), ("(NO93 8601 1117 947", " EUR)"), ("GB82 WEST 1234 5698 7654 32", " A1"), ("DE89 3704 0044 0532 0130 00", " BIC"), ("NO9386011117947", " X"),
        ("3782 822463 10005", " 0427"), ("3782-822463-10005", ""), ("3056 930902 5904", ", ok"), ("at 2024-06-08", "T09:30"), ("2024-06-08", "t09:30:00Z"), ("2024-06-08", " 09:30"), ("on 8.6.2024", "."), ("6/28/2024", " x"), ("2024-6-8", ""),
        ("call 555.123.4567", "."), ("(555) 123 4567", " x"), ("(555).123.4567", ""), ("+33 1 23 45 67 89", " x"), ("+44 7911 123456", ", x"), ("+1.555.123.4567", " x"), ("+44 2079 4609 5820", " 2024"),
    ]
    for (v, behind), (new, n) in zip(cases, swap(spark, [a + b for a, b in cases])):
        assert n == 1 and new.endswith(behind), (v, behind, new)
        new, word = new[: len(new) - len(behind)], re.match(r"[a-z(]+ |\((?=NO)|", v)[0]
        assert new.startswith(word) and new != v, (v, behind, new)
        new, old = new.removeprefix(word), v.removeprefix(word)
        if old[:1].isupper():
            assert iban_good(new) and len(new) == len(old)
        if old.startswith("3"):
            assert luhn(re.sub("[^0-9]", "", new)) and len(new) == len(old)
    # A date behind a number is found too.
    (text, n), = swap(spark, ["+44 20 7946 0958 2024-06-08"])
    assert n == 2 and "0958" not in text[:17] and not text.endswith("2024-06-08")


def test_one_day_however_written(spark):
    (a, _), (b, _), (c, _) = swap(spark, ["8.6.2024", "08.06.2024", "2024-06-08"])
    day = lambda t: tuple(map(int, t.split(".")))
    assert day(a) == day(b) == tuple(int(x) for x in reversed(c.split("-"))) and len(b) == 10


def test_numbers_that_only_look_alike_stay(spark):
    texts = ["+12345.678901", "1.555.123.4567", "2024-06-08Tx", "2024-13-8", "v1.2.3-4", "3782 822463 10006", "BE68 5390 0754 7035 USD"]
    assert swap(spark, texts) == [(t, 0) for t in texts]
