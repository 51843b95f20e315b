"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Validated numbers and dates go through a keyed Feistel permutation of their own format, so equal values
keep equal pseudonyms in every document and different ones stay different:

- card numbers with a right Luhn digit: all digits but the last; the Luhn digit is computed anew
- IBANs with a right remainder modulo 97: the digits of the account; the check digits are computed anew
- phone numbers: the digits after the country code, which the numbering plan tells, whether it is set apart or not; without a code, as in that of +1
- social security numbers: among the valid ones
- IPv4 addresses: both halves; 0.0.0.0 and 127.* stay
- dates: the day within its century-long era, written in the same style, with leading zeros or without. With slashes, the day comes first where both may
  (`day_first=False`: the month)

E-mail addresses and access keys are not numbers; they get a keyed hash in their own form. Everything else,
invalid numbers and impossible dates included, stays as it is.

A null text stays null with zero counts; empty texts, repeated rows and null ids pass through; an empty table
gives an empty result. Columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import named as _named

ROUNDS = 10
MARK, ESCAPE = "\x01", "\x02"

#: A domain has at most 253 characters, so 126 dots; the matcher's stack grows with repeated groups.
EMAIL = r"[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9.-]{1,253}+(?![A-Za-z0-9.-]))[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,126}\.[A-Za-z]{2,}(?![A-Za-z0-9])"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
KEY = r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|(?=[a-fA-F]{0,39}[0-9])(?=[0-9]{0,39}[a-fA-F])[0-9a-fA-F]{32,64})(?![A-Za-z0-9])"
IP = r"(?<![0-9]\.)(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
DATE = r"(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9A-Za-z]|[-/.][0-9])"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![-0-9A-Za-z])"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}|[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4})(?![-0-9A-Za-z])"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}(?![-0-9A-Za-z])"
#: Where two forms fit, the first is taken.
FOUND = rf"(?:(?<![A-Za-z0-9._%+@-]){EMAIL}|(?<![A-Za-z0-9+@])(?<![0-9][-./])(?:{KEY}|{IBAN}|{IP}|{DATE}|{SSN}|{PHONE}|{CARD}))"
#: Every text with a value has this, which is cheaper to look for.
HINT = r"[0-9]{4}|[A-Z]{2}[0-9]{2}|[0-9]\.[0-9]|@|AKIA|gh[pousr]_|[0-9a-fA-F]{32}|[0-9][-. ][0-9]"
KINDS = ("email", "key", "iban", "ip", "date", "ssn", "phone", "card")
#: Fixed value: country codes of the numbering plan, of one, two or else three digits.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

#: Days of an era, as the product of the Feistel halves' sizes.
ERA = (75, 487)


def key_of_executors(variable: str) -> Column:
    """The key that executors have in an environment variable. A text key is a literal, which plans and the event log show."""
    return F.coalesce(F.reflect(F.lit("java.lang.System"), F.lit("getenv"), F.lit(variable)), F.raise_error(F.lit(f"{variable} is not set")).cast("string"))


def _of(key: str | Column) -> Column:
    return F.lit(key) if isinstance(key, str) else key


def feistel(left: Column, right: Column, sizes: tuple[Column, Column], key: str | Column, tweak: Column) -> Column:
    """A permutation of pairs (left below sizes[0], right below sizes[1]) as a struct."""

    def step(pair: Column, r: Column) -> Column:
        even = r % 2 == 0
        seen = F.when(even, pair["right"]).otherwise(pair["left"])
        hashed = F.sha2(F.concat_ws("|", _of(key), tweak, r.cast("string"), seen.cast("string")).cast("binary"), 256)
        add = F.conv(F.substring(hashed, 1, 13), 16, 10).cast("long")
        return F.struct(
            F.when(even, F.pmod(pair["left"] + add, sizes[0])).otherwise(pair["left"]).alias("left"),
            F.when(even, pair["right"]).otherwise(F.pmod(pair["right"] + add, sizes[1])).alias("right"),
        )

    start = F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permuted_digits(digits: Column, key: str | Column | Column, tweak: Column) -> Column:
    """Of a string of 2 to 30 digits, another of the same length."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    size = lambda k: F.pow(F.lit(10.0), k).cast("long")
    pair = feistel(F.substring(digits, F.lit(1), a), F.substring(digits, a + 1, n), (size(a), size(n - a)), key, tweak)
    return _named(pair, lambda p: F.concat(F.lpad(p["left"].cast("string"), a, "0"), F.lpad(p["right"].cast("string"), n - a, "0")))


def luhn(payload: Column) -> Column:
    """The digit that follows."""
    n = F.length(payload)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(payload, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.pmod(-F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add), F.lit(10)).cast("string")


def in_format(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced in order."""

    def put(state: Column, char: Column) -> Column:
        digit = char.rlike("^[0-9]$")
        return F.struct(
            F.concat(state["out"], F.when(digit, F.substring(digits, state["k"], F.lit(1))).otherwise(char)).alias("out"),
            (state["k"] + digit.cast("int")).alias("k"),
        )

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), put, lambda s: s["out"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _card(x: Column, key: str | Column) -> Column:
    d = _digits(x)
    payload = F.substring(d, F.lit(1), F.length(d) - 1)
    new = permuted_digits(payload, key, F.lit("card"))
    return F.when(luhn(payload) == F.right(d, F.lit(1)), in_format(x, _named(new, lambda p: F.concat(p, luhn(p)))))


def _phone(x: Column, key: str | Column) -> Column:
    country = F.regexp_extract(x, COUNTRY, 0)
    rest = F.substring(x, F.length(country) + 1, F.length(x))
    d = _digits(rest)
    plan = F.when(country == "", F.lit("+1")).otherwise(country)
    return F.when(F.length(d).between(6, 15), F.concat(country, in_format(rest, permuted_digits(d, key, F.concat(F.lit("phone"), plan)))))


def _modulo_97(x: Column) -> Column:
    """Of digits and letters, which count from 10 on."""

    def add(total: Column, char: Column) -> Column:
        digit = char.rlike("^[0-9]$")
        return F.pmod(F.when(digit, total * 10 + F.ascii(char) - 48).otherwise(total * 100 + F.ascii(char) - 55), F.lit(97))

    return F.aggregate(F.split(x, ""), F.lit(0), add)


def _iban(x: Column, key: str | Column) -> Column:
    bare = F.replace(x, F.lit(" "))
    country, account = F.substring(bare, 1, 2), F.substring(bare, F.lit(5), F.length(bare))
    d = _digits(account)
    good = (_modulo_97(F.concat(account, country, F.substring(bare, 3, 2))) == 1) & F.length(d).between(2, 30)
    moved = in_format(account, permuted_digits(d, key, F.concat(F.lit("iban"), country, F.regexp_replace(account, "[0-9]", "0"))))

    def write(new: Column) -> Column:
        check = F.lpad((F.lit(98) - _modulo_97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
        return F.concat(country, _spaced(F.substring(x, F.lit(3), F.length(x)), F.concat(check, new)))

    return F.when(good, _named(moved, write))


def _spaced(shape: Column, chars: Column) -> Column:
    """chars with spaces where shape has them."""

    def put(state: Column, char: Column) -> Column:
        space = char == " "
        return F.struct(F.concat(state["out"], F.when(space, char).otherwise(F.substring(chars, state["k"], F.lit(1)))).alias("out"), (state["k"] + (~space).cast("int")).alias("k"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), put, lambda s: s["out"])


def _ssn(x: Column, key: str | Column) -> Column:
    area, group, serial = (F.substring(x, *p).cast("long") for p in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    pair = feistel((area - 1 - (area > 666).cast("int")) * 99 + group - 1, serial - 1, (F.lit(898 * 99), F.lit(9999)), key, F.lit("ssn"))

    def write(p: Column) -> Column:
        a = F.floor(p["left"] / 99)
        a = a + 1 + (a >= 665).cast("int")
        parts = ((a, 3), (p["left"] % 99 + 1, 2), (p["right"] + 1, 4))
        return F.concat_ws("-", *(F.lpad(v.cast("string"), n, "0") for v, n in parts))

    return F.when(valid, _named(pair, write))


def _ip(x: Column, key: str | Column) -> Column:
    o = [F.split_part(x, F.lit("."), F.lit(k)).cast("long") for k in (1, 2, 3, 4)]
    valid = (o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256) & (o[0] != 127) & ~((o[0] == 0) & (o[1] == 0) & (o[2] == 0) & (o[3] == 0))
    pair = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], (F.lit(65536), F.lit(65536)), key, F.lit("ip"))
    write = lambda p: F.concat_ws(".", *(F.floor(v).cast("string") for h in (p["left"], p["right"]) for v in (h / 256, h % 256)))
    return F.when(valid, _named(pair, write))


def _date(x: Column, key: str | Column, day_first: bool = True) -> Column:
    def moved(long: str, short: str) -> Column:
        return F.coalesce(styled(F.when(F.length(x) == 10, x), long), styled(F.when(F.length(x) < 10, x), short))

    def styled(x: Column, style: str) -> Column:
        day = F.unix_date(F.try_to_timestamp(x, F.lit(style)).cast("date")) - F.lit(-18263)  # 1920-01-01
        n = ERA[0] * ERA[1]
        era = F.floor(day / n)
        pair = feistel(F.floor(F.pmod(day, F.lit(n)) / ERA[1]), F.pmod(day, F.lit(ERA[1])), (F.lit(ERA[0]), F.lit(ERA[1])), key, F.concat(F.lit("date"), era.cast("string")))
        return _named(pair, lambda p: F.date_format(F.date_from_unix_date((era * n + p["left"] * ERA[1] + p["right"] - 18263).cast("int")), style))

    styles = [moved("dd/MM/yyyy", "d/M/yyyy"), moved("MM/dd/yyyy", "M/d/yyyy")]
    slashes = F.coalesce(*(styles if day_first else styles[::-1]))
    return F.when(x.contains("-"), moved("yyyy-MM-dd", "yyyy-M-d")).when(x.contains("/"), slashes).otherwise(moved("dd.MM.yyyy", "d.M.yyyy"))


def _hashed(x: Column, key: str | Column) -> Column:
    return F.sha2(F.concat(_of(key), F.lit("|"), x).cast("binary"), 256)


def _email(x: Column, key: str | Column) -> Column:
    return F.concat(F.lit("u"), F.substring(_hashed(F.lower(x), key), 1, 16), F.lit("@mail.invalid"))


def _key(x: Column, key: str | Column) -> Column:
    head = F.regexp_extract(x, "^(?:AKIA|gh[pousr]_)", 0)
    tail = F.substring(_hashed(F.lower(x), key), F.lit(1), F.length(x) - F.length(head))
    return F.concat(head, F.when(F.upper(x) == x, F.upper(tail)).otherwise(tail))


def _kind(x: Column) -> Column:
    whole = lambda p: x.rlike(rf"^(?:{p})$")
    return F.when(x.contains("@"), "email").when(whole(KEY), "key").when(whole(IBAN), "iban").when(whole(IP), "ip").when(whole(DATE), "date").when(whole(SSN), "ssn").when(whole(PHONE), "phone").otherwise("card")


def pseudonymize(docs: DataFrame, key: str | Column, id_col: str = "doc_id", text_col: str = "text", day_first: bool = True) -> DataFrame:
    """id_col, text with pseudonyms, n_<kind> for each kind, n_values and changed, for every row; key: the secret of the permutation, as a text or a column that gives it."""
    text = F.col("text")
    escaped = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "B")), F.lit(MARK), F.lit(ESCAPE + "A"))
    unescaped = lambda x: F.replace(F.replace(x, F.lit(ESCAPE + "A"), F.lit(MARK)), F.lit(ESCAPE + "B"), F.lit(ESCAPE))
    odd = text.contains(MARK) | text.contains(ESCAPE)
    marked = F.split(F.regexp_replace(F.when(odd, escaped).otherwise(text), FOUND, f"{MARK}$0{MARK}"), MARK)
    makers = {"email": _email, "key": _key, "iban": _iban, "ip": _ip, "date": lambda x, key: _date(x, key, day_first), "ssn": _ssn, "phone": _phone, "card": _card}

    def part(x: Column, i: Column) -> Column:
        def value(kind: Column) -> Column:
            new = F.lit(None).cast("string")
            for name, f in makers.items():
                new = F.when(kind == name, f(x, key)).otherwise(new)
            return _named(new, lambda n: F.struct(F.coalesce(n, x).alias("text"), F.when(n.isNotNull(), kind).alias("kind")))

        plain = F.struct(x.alias("text"), F.lit(None).cast("string").alias("kind"))
        return F.when(i % 2 == 1, _named(_kind(x), value)).otherwise(plain)

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = base.select("id", "text", F.when(text.rlike(HINT), F.transform(marked, part)).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    new = F.when(F.col("parts").isNull(), text).when(odd, unescaped(joined)).otherwise(joined)
    count = lambda kind: F.coalesce(F.size(F.filter("parts", lambda p: p["kind"] == kind)), F.lit(0)).cast("long")
    counted = parts.select("id", "text", new.alias("new"), *(F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(count(k)).alias(f"n_{k}") for k in KINDS))
    return counted.select(
        F.col("id").alias(id_col),
        F.col("new").alias("text"),
        *(f"n_{k}" for k in KINDS),
        sum((F.col(f"n_{k}") for k in KINDS[1:]), F.col(f"n_{KINDS[0]}")).alias("n_values"),
        (~F.col("new").eqNullSafe(F.col("text"))).alias("changed"),
    )
