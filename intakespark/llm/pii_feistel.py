"""Personal data replaced by format-preserving pseudonyms.

Values are found by pattern and then validated (card and account checksums,
address octets, calendar dates, number lengths); what fails is left alone. A
valid value is permuted within its own format, so the same value gives the same
pseudonym in every document, and different values give different ones. The
permutation is a step of one between a keyed Feistel network and its inverse: no
value stays as it is, and the key holder undoes it by a step back (``restore``):

* e-mail addresses: letters and digits of the local part, each within its kind;
* telephone numbers: the digits after the country code, which is taken from the
  signs behind it or, without any, from the list of country codes;
* payment cards: all digits but the last, which is set to the checksum again;
* IBANs: the account part, with check digits set again;
* social security numbers (three valid fields) and IPv4 addresses: as numbers;
* dates of 1900 to 2099: as day numbers, written in their own order and signs,
  without leading zeros where the value has a day or month of one digit.

Round functions are SHA-256 digests of key, kind, round and the other half. A
value of one sign has no halves; it goes to the next sign of its kind in an order
that the key gives.
Everything is built-in expressions in one narrow pass: no shuffle, no Python.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: For tests and demonstrations; pass a secret of your own.
DEMO_KEY = "intakespark demonstration key"

_END = r"(?![0-9A-Za-z])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Length of an account number by country, as registered for IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


#: Country codes of telephone numbers by their first digits; all others have three digits. Fixed values.
CALLING_CODE = r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _accounts() -> str:
    """Accounts of the registered length of their country, so that what follows is not taken in; those of other countries by form alone."""
    of = lambda n, lands: f"(?:{lands.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + _END
    return "|".join([*(of(n, lands) for n, lands in IBAN_LENGTHS.items()), rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}"])


PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]++\.)+[A-Za-z]{2,}",
    "ip": rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])",
    "date": rf"(?<![0-9A-Za-z./\-])(?:(?:19|20)[0-9]{{2}}([./\-])[01]?[0-9]\1[0-3]?[0-9]|[0-3]?[0-9]([./\-])[0-3]?[0-9]\2(?:19|20)[0-9]{{2}})(?:(?=[Tt][0-9]{{2}}:?[0-9]{{2}})|(?![0-9A-Za-z]|[./\-][0-9]))",
    "ssn": rf"(?<![0-9A-Za-z\-])(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}(?![0-9A-Za-z]|-[0-9])",
    "phone": rf"(?<![0-9A-Za-z+])(?:\+[0-9]{{1,3}}[ .\-]?\([0-9]{{2,4}}\)[ .\-]?[0-9]{{3,4}}[ .\-]?[0-9]{{4}}{_END}|\+[0-9](?:[ \-]?[0-9]){{7,14}}(?![0-9A-Za-z]|[./\-][0-9])|\+[0-9]{{8,15}}{_END}|\+[0-9]{{1,3}}(?:\.[0-9]{{2,4}}){{2,4}}{_END}|\([0-9]{{3}}\)[ .\-]?[0-9]{{3}}[ .\-][0-9]{{4}}{_END}|[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}}{_END}|(?<!\.)[0-9]{{3}}\.[0-9]{{3}}\.[0-9]{{4}}(?![0-9A-Za-z]|\.[0-9]))",
    "card": rf"(?<![0-9A-Za-z])(?:[0-9]{{13,19}}|[0-9]{{4}}(?:[ \-][0-9]{{4}}){{3}}|[0-9]{{4}}[ \-][0-9]{{6}}[ \-][0-9]{{4,5}}){_END}",
    "iban": rf"(?<![0-9A-Za-z])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_accounts()})",
}
KINDS = tuple(PATTERNS)


def _let(value: Column, body) -> Column:
    """Bind a value once, so that an expression that uses it often does not repeat it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chars(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def _draw(key: str, kind: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *(p.cast("string") for p in parts)).cast("binary"), 256)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


_SIGNS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _shift(text: Column, digest: Column, way: int) -> Column:
    """Each letter and digit moved within its kind by a part of the digest, on or back."""

    def one(c: Column, i: Column) -> Column:
        step = F.conv(F.substring(digest, F.pmod(i * 4, F.lit(60)) + 1, F.lit(4)), 16, 10).cast("int")
        moved = lambda signs: F.substring(F.lit(signs), F.pmod(F.position(c, F.lit(signs)) - 1 + step * way, F.lit(len(signs))) + 1, F.lit(1))
        digits, low, high = map(moved, _SIGNS)
        return F.when(c.between("0", "9"), digits).when(c.between("a", "z"), low).when(c.between("A", "Z"), high).otherwise(c)

    return F.array_join(F.transform(_chars(text), one), "")


def _next(sign: Column, orders: tuple[str, ...], step: int) -> Column:
    """The next or the last sign in the order of its kind."""
    return F.translate(sign, "".join(orders), "".join(o[step:] + o[:step] for o in orders))


def _keyed_orders(kind: str, key: str) -> tuple[str, ...]:
    return tuple("".join(sorted(signs, key=lambda c: sha256(f"{key}|{kind}|{c}".encode()).digest())) for signs in _SIGNS)


def permute_signs(text: Column, kind: str, key: str, step: int = 1) -> Column:
    """Permutation of a run of ASCII letters and digits that keeps the kind of sign at every place and no value as it is; ``step`` -1 undoes it. An empty run stays."""
    half = (F.length(text) / 2).cast("int")
    mask = F.translate(F.regexp_replace(F.regexp_replace(text, "[a-z]", "a"), "[A-Z]", "A"), "0123456789", "0" * 10)
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"), mask.alias("m"))

    def turn(s: Column, k: Column) -> Column:
        moved = _let(_draw(key, kind, s["m"], k, s["r"]), lambda d: _shift(s["l"], d, 1))
        return F.struct(s["r"].alias("l"), moved.alias("r"), s["m"].alias("m"))

    def turn_back(s: Column, k: Column) -> Column:
        moved = _let(_draw(key, kind, s["m"], k, s["l"]), lambda d: _shift(s["r"], d, -1))
        return F.struct(moved.alias("l"), s["l"].alias("r"), s["m"].alias("m"))

    def stepped(s: Column) -> Column:
        n = F.length(s["r"])
        return F.struct(s["l"].alias("l"), F.concat(F.substring(s["r"], F.lit(1), n - 1), _next(F.substring(s["r"], n, F.lit(1)), _SIGNS, step)).alias("r"), s["m"].alias("m"))

    there = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, stepped)
    back = F.aggregate(F.sequence(F.lit(ROUNDS), F.lit(1)), there, turn_back, lambda s: F.concat(s["l"], s["r"]))
    return F.when(F.length(text) > 1, back).otherwise(_next(text, _keyed_orders(kind, key), step))


def permute_pair(a: Column, b: Column, size_a: int, size_b: int, kind: str, key: str, step: int = 1) -> Column:
    """struct<a, b>: permutation of the pairs with 0 <= a < size_a and 0 <= b < size_b (b of two values or more) that keeps none as it is; ``step`` -1 undoes it."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def move_a(s: Column, k: Column, way: int) -> Column:
        return F.struct(F.pmod(s["a"] + way * F.pmod(_number(_draw(key, kind, F.lit("a"), k, s["b"])), F.lit(size_a)), F.lit(size_a)).alias("a"), s["b"].alias("b"))

    def move_b(s: Column, k: Column, way: int) -> Column:
        return F.struct(s["a"].alias("a"), F.pmod(s["b"] + way * F.pmod(_number(_draw(key, kind, F.lit("b"), k, s["a"])), F.lit(size_b)), F.lit(size_b)).alias("b"))

    there = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, lambda s, k: _let(move_a(s, k, 1), lambda t: move_b(t, k, 1)), lambda s: F.struct(s["a"].alias("a"), F.pmod(s["b"] + step, F.lit(size_b)).alias("b")))
    return F.aggregate(F.sequence(F.lit(ROUNDS // 2), F.lit(1)), there, lambda s, k: _let(move_b(s, k, -1), lambda t: move_a(t, k, -1)))


def _only(text: Column, signs: str) -> Column:
    return F.regexp_replace(text, f"[^{signs}]", "")


def _refill(shape: Column, new: Column, signs: str) -> Column:
    """``shape`` with its signs of the class replaced in turn by those of ``new``."""
    put = lambda c, i: F.when(c.rlike(f"^[{signs}]$"), F.substring(new, F.length(_only(F.substring(shape, F.lit(1), i + 1), signs)), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(_chars(shape), put), "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits by which a card number is checked: it divides by ten where the last one is right."""
    doubled = "0246813579"
    n = F.length(digits)
    part = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when(F.pmod(n - i, F.lit(2)) == 1, F.substring(F.lit(doubled), F.substring(digits, i, F.lit(1)).cast("int") + 1, F.lit(1))).otherwise(F.substring(digits, i, F.lit(1))).cast("int"),
    )
    return F.aggregate(part, F.lit(0), lambda s, x: s + x)


def mod97(text: Column) -> Column:
    """Remainder by 97 of a run of digits and capital letters (A is 10), as account numbers are checked."""
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(_chars(text), value), F.lit(0), lambda s, x: F.pmod(F.when(x > 9, s * 100 + x).otherwise(s * 10 + x), F.lit(97)))


def _card(v: Column, key: str, step: int) -> Column:
    d = _only(v, "0-9")
    body = lambda x: permute_signs(F.substring(x, F.lit(1), F.length(x) - 1), "card", key, step)
    closed = lambda b: F.concat(b, F.pmod(10 - F.pmod(luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))
    new = _let(d, lambda x: _let(_let(body(x), closed), lambda n: _refill(v, n, "0-9")))
    return F.when(F.pmod(luhn_sum(d), F.lit(10)) == 0, new).otherwise(v)


def _iban(v: Column, key: str, step: int) -> Column:
    d = F.replace(v, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(d, F.lit(5), F.length(d)), F.substring(d, 1, 4))
    good = F.length(d).between(15, 34) & (mod97(turned) == 1)

    def new(x: Column) -> Column:
        account = permute_signs(F.substring(x, F.lit(5), F.length(x)), "iban", key, step)
        land = F.substring(x, 1, 2)
        full = lambda a: F.concat(land, F.lpad((98 - mod97(F.concat(a, land, F.lit("00")))).cast("string"), 2, "0"), a)
        return _let(_let(account, full), lambda n: _refill(v, n, "0-9A-Z"))

    return F.when(good, _let(d, new)).otherwise(v)


def _email(v: Column, key: str, step: int) -> Column:
    local = F.substring_index(v, "@", 1)
    new = _let(_only(local, "0-9A-Za-z"), lambda x: _let(permute_signs(x, "email", key, step), lambda n: _refill(local, n, "0-9A-Za-z")))
    return F.concat(new, F.substring(v, F.length(local) + 1, F.length(v)))


def _phone(v: Column, key: str, step: int) -> Column:
    code = F.regexp_extract(v, rf"^(\+[0-9]{{1,3}}(?=[ .\-])|{CALLING_CODE})", 1)
    rest = F.substring(v, F.length(code) + 1, F.length(v))
    new = _let(_only(rest, "0-9"), lambda x: _let(permute_signs(x, "phone", key, step), lambda n: _refill(rest, n, "0-9")))
    return F.when(F.length(_only(v, "0-9")).between(8, 15), F.concat(code, new)).otherwise(v)


def _ip(v: Column, key: str, step: int) -> Column:
    o = F.transform(F.split(v, "\\."), lambda x: x.cast("long"))
    got = permute_pair(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), 65_536, 65_536, "ip", key, step)
    parts = lambda p: F.concat_ws(".", *((F.floor(x / 256) if high else F.pmod(x, F.lit(256))).cast("string") for x in (p["a"], p["b"]) for high in (True, False)))
    return _let(got, parts)


def _ssn(v: Column, key: str, step: int) -> Column:
    area, group, serial = (F.get(F.split(v, "-"), F.lit(k)).cast("long") for k in range(3))
    index = area - 1 - F.when(area > 666, 1).otherwise(0)
    got = permute_pair(index * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn", key, step)

    def shown(p: Column) -> Column:
        a = F.floor(p["a"] / 99) + 1
        a = a + F.when(a >= 666, 1).otherwise(0)
        pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.concat_ws("-", pad(a, 3), pad(F.pmod(p["a"], F.lit(99)) + 1, 2), pad(p["b"] + 1, 4))

    return _let(got, shown)


#: The 73049 days of 1900 to 2099 are 17 times 4297.
DAYS_A, DAYS_B = 17, 4297


def _date(v: Column, key: str, step: int) -> Column:
    f = F.split(v, "[./\\-]")
    year_first = F.length(F.get(f, F.lit(0))) == 4
    day_first = F.concat_ws("-", F.get(f, F.lit(2)), F.get(f, F.lit(1)), F.get(f, F.lit(0)))
    month_first = F.concat_ws("-", F.get(f, F.lit(2)), F.get(f, F.lit(0)), F.get(f, F.lit(1)))
    iso = F.concat_ws("-", f)
    read = lambda t: t.try_cast("date")
    order = F.when(year_first & read(iso).isNotNull(), "ymd").when(~year_first & read(day_first).isNotNull(), "dmy").when(~year_first & read(month_first).isNotNull(), "mdy")
    date = F.when(year_first, read(iso)).otherwise(F.coalesce(read(day_first), read(month_first)))
    index = F.datediff(date, F.lit("1900-01-01").cast("date")).cast("long")
    got = permute_pair(F.pmod(index, F.lit(DAYS_A)), F.floor(index / DAYS_A), DAYS_A, DAYS_B, "date", key, step)
    new = F.date_add(F.lit("1900-01-01").cast("date"), (got["b"] * DAYS_A + got["a"]).cast("int"))
    sign = F.regexp_extract(v, "[./\\-]", 0)
    short = F.exists(f, lambda x: F.length(x) == 1)

    def shown(d: Column) -> Column:
        y, m, n = F.date_format(d, "yyyy"), *(F.when(short, F.date_format(d, x)).otherwise(F.date_format(d, x * 2)) for x in "Md")
        return F.when(order == "ymd", F.concat(y, sign, m, sign, n)).when(order == "dmy", F.concat(n, sign, m, sign, y)).otherwise(F.concat(m, sign, n, sign, y))

    return F.when(order.isNotNull(), _let(new, shown)).otherwise(v)


_CHANGE = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card, "iban": _iban}


def _search_pattern() -> str:
    # No kind starts behind a letter or digit: this is told once for all.
    # Groups are numbered over the whole alternation: the date pattern's two come first and second.
    return "(?<![0-9A-Za-z])(?:" + "|".join(f"(?:{PATTERNS[k]})" for k in KINDS) + ")"


def kind_of(v: Column) -> Column:
    """Kind of a found value, by the first pattern that it fits whole."""
    out = None
    for k in KINDS:
        fits = v.rlike(f"^(?:{PATTERNS[k]})$")
        out = F.when(fits, k) if out is None else out.when(fits, k)
    return out


def pseudonym(v: Column, kind: Column, key: str = DEMO_KEY, step: int = 1) -> Column:
    """The pseudonym of a found value, or with ``step`` -1 the value of a pseudonym; the same where it is not valid."""
    out = None
    for k in KINDS:
        out = F.when(kind == k, _CHANGE[k](v, key, step)) if out is None else out.when(kind == k, _CHANGE[k](v, key, step))
    return out.otherwise(v)


def restore(docs: DataFrame, key: str = DEMO_KEY, text_col: str = "text") -> DataFrame:
    """Put the values back for the pseudonyms in every whole text.

    What a notation does not tell is not known: a date written month first comes back wrong where its pseudonym can be
    read day first, and leading zeros come back where the pseudonym has no part of one digit. A pseudonym next to which
    the text holds signs that make it look like another value is not found as it was.
    """
    return pseudonymise(docs, key, text_col, step=-1)


def pseudonymise(docs: DataFrame, key: str = DEMO_KEY, text_col: str = "text", step: int = 1) -> DataFrame:
    """Replace the valid personal data in every whole text; add ``n_private``, the number of values replaced.

    Null and empty texts stay as they are, with 0. All rows and other columns are kept; a column named n_private is
    replaced. An empty table gives an empty one.
    """
    docs = docs.drop("n_private")
    # The input's columns travel in a struct, so that none of them can clash with those added here.
    own = F.struct(*docs.columns).alias("own")
    pattern, text = _search_pattern(), F.col("own")[text_col]
    swap = lambda v: F.struct(v.alias("old"), _let(kind_of(v), lambda k: pseudonym(v, k, key, step)).alias("new"))

    def put(swaps: Column) -> Column:
        filled = F.array_join(F.zip_with(F.split(text, pattern, -1), swaps, lambda g, s: F.concat(g, F.coalesce(s["new"], F.lit("")))), "")
        return F.struct(filled.alias("text"), F.size(F.filter(swaps, lambda s: s["old"] != s["new"])).cast("long").alias("n"))

    # Every kind of value holds a digit or an at sign; most texts hold neither and are passed over quickly.
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    done = docs.select(own).withColumn("found", found)
    done = done.withColumn("done", F.when(F.size("found") > 0, _let(F.transform("found", swap), put)))
    columns = [F.coalesce("done.text", text).alias(c) if c == text_col else F.col("own")[c].alias(c) for c in docs.columns]
    return done.select(*columns, F.coalesce("done.n", F.lit(0)).cast("long").alias("n_private"))
