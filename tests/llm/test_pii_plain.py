"""Pseudonyms of the whole sf0.01 documents against plain Python, and back."""

import datetime
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from intakespark.llm import pii_feistel as p

KEY = p.DEMO_KEY
SETS = [set("0123456789"), set("abcdefghijklmnopqrstuvwxyz"), set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")]
FIRST = "0aA"


def draw(kind, *parts):
    return sha256("|".join([KEY, kind, *map(str, parts)]).encode()).hexdigest()


def kind_of_sign(c):
    return next(k for k, s in enumerate(SETS) if c in s)


def moved(c, by):
    k = kind_of_sign(c)
    return chr(ord(FIRST[k]) + (ord(c) - ord(FIRST[k]) + by) % len(SETS[k]))


def shifted(text, digest, way):
    return "".join(moved(c, way * int(digest[i * 4 % 60 : i * 4 % 60 + 4], 16)) for i, c in enumerate(text))


def signs(text, kind, step=1):
    if len(text) < 2:
        out = ""
        for c in text:
            order = sorted(SETS[kind_of_sign(c)], key=lambda x: sha256(f"{KEY}|{kind}|{x}".encode()).digest())
            out += order[(order.index(c) + step) % len(order)]
        return out
    mask = "".join(FIRST[kind_of_sign(c)] for c in text)
    left, right = text[: len(text) // 2], text[len(text) // 2 :]
    for k in range(1, 9):
        left, right = right, shifted(left, draw(kind, mask, k, right), 1)
    right = right[:-1] + moved(right[-1], step)
    for k in range(8, 0, -1):
        left, right = shifted(right, draw(kind, mask, k, left), -1), left
    return left + right


def pair(a, b, size_a, size_b, kind, step=1):
    number = lambda *x: int(draw(kind, *x)[:12], 16)
    for k in range(1, 5):
        a = (a + number("a", k, b)) % size_a
        b = (b + number("b", k, a)) % size_b
    b = (b + step) % size_b
    for k in range(4, 0, -1):
        b = (b - number("b", k, a)) % size_b
        a = (a - number("a", k, b)) % size_a
    return a, b


def refill(shape, new, of):
    it = iter(new)
    return "".join(next(it) if re.match(of, c) else c for c in shape)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def day(y, m, d):
    try:
        return datetime.date(int(y), int(m), int(d))
    except ValueError:
        return None


def new_value(v, kind):
    if kind == "email":
        local = v.split("@")[0]
        return refill(local, signs(re.sub("[^0-9A-Za-z]", "", local), kind), "[0-9A-Za-z]") + v[len(local) :]
    if kind == "ip":
        w, x, y, z = map(int, v.split("."))
        a, b = pair(w * 256 + x, y * 256 + z, 65536, 65536, kind)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind == "ssn":
        area, group, serial = map(int, v.split("-"))
        a, b = pair((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, kind)
        area = a // 99 + 1
        return f"{area + (area >= 666):03}-{a % 99 + 1:02}-{b + 1:04}"
    if kind == "phone":
        if not 8 <= len(re.sub("[^0-9]", "", v)) <= 15:
            return v
        code = re.match(r"\+[0-9]{1,3}(?=[ .\-])", v) or re.match(p.CALLING_CODE, v)
        code = code.group() if code else ""
        rest = v[len(code) :]
        return code + refill(rest, signs(re.sub("[^0-9]", "", rest), kind), "[0-9]")
    if kind == "card":
        d = re.sub("[^0-9]", "", v)
        if luhn(d):
            return v
        body = signs(d[:-1], kind)
        return refill(v, body + str(-luhn(body + "0") % 10), "[0-9]")
    if kind == "iban":
        d = v.replace(" ", "")
        if not 15 <= len(d) <= 34 or mod97(d[4:] + d[:4]) != 1:
            return v
        account = signs(d[4:], kind)
        return refill(v, d[:2] + f"{98 - mod97(account + d[:2] + '00'):02}" + account, "[0-9A-Z]")
    f, sign = re.split(r"[./\-]", v), re.search(r"[./\-]", v).group()
    orders = {"ymd": f} if len(f[0]) == 4 else {"dmy": f[::-1], "mdy": [f[2], f[0], f[1]]}
    order, date = next(((o, day(*x)) for o, x in orders.items() if day(*x)), (None, None))
    if not date:
        return v
    n = (date - datetime.date(1900, 1, 1)).days
    a, b = pair(n % 17, n // 17, 17, 4297, kind)
    new = datetime.date(1900, 1, 1) + datetime.timedelta(b * 17 + a)
    pad = 1 if any(len(x) == 1 for x in f) else 2
    shown = {"y": f"{new.year}", "m": f"{new.month:0{pad}}", "d": f"{new.day:0{pad}}"}
    return sign.join(shown[c] for c in order)


def plain(text):
    out, at, n = [], 0, 0
    found = re.compile("|".join(f"(?:{p.PATTERNS[k]})" for k in p.KINDS))
    for m in found.finditer(text):
        v = m.group()
        new = new_value(v, next(k for k in p.KINDS if re.fullmatch(p.PATTERNS[k], v)))
        out += [text[at : m.start()], new]
        at, n = m.end(), n + (new != v)
    return "".join(out) + text[at:], n


@pytest.fixture(scope="module")
def swapped(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    return docs, p.pseudonymise(docs)


def test_whole_table(swapped):
    docs, new = swapped
    got = {r.doc_id: (r.text, r.n_private) for r in new.collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and sum(n for _, n in got.values()) > 50
    for r in rows:
        assert got[r.doc_id] == (plain(r.text) if r.text else (r.text, 0)), r.doc_id


def test_every_valid_value_changes_and_comes_back(spark):
    values = [f"{x}@b.org" for x in ("a", "b", "z", "Q", "7", "ab", "a1", "j.doe")] + [f"10.0.{k}.{k}" for k in range(40)] + [f"123-45-{k:04}" for k in range(1, 40)]
    values += ["+442079460958", "+44 20 7946 0958", "+15551234567", "+353861234567", "(555) 123-4567", "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"]
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    new = p.pseudonymise(df)
    assert [r.text for r in p.restore(new).orderBy("doc_id").collect()] == values
    got = dict(zip(values, (r.text for r in new.orderBy("doc_id").collect())))
    assert all(v != n for v, n in got.items()) and len(set(got.values())) == len(values)
    assert got["+442079460958"][3:] == got["+44 20 7946 0958"][3:].replace(" ", "") and got["+442079460958"].startswith("+44")
    assert got["+15551234567"].startswith("+1") and got["+353861234567"].startswith("+353")


def test_one_sign_is_no_fixed_shift(spark):
    """Single signs go to one another in one round through all of their kind, by steps that differ."""
    df = spark.createDataFrame([(c,) for s in p._SIGNS for c in s], "c string")
    got = {r.c: r.n for r in df.select("c", p.permute_signs(F.col("c"), "email", "k").alias("n")).collect()}
    for s in p._SIGNS:
        seen, c = [], s[0]
        while c not in seen:
            seen.append(c)
            c = got[c]
        assert sorted(seen) == sorted(s) and len({(ord(got[c]) - ord(c)) % len(s) for c in s}) > 3
