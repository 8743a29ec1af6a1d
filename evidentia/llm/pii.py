"""Format-preserving Feistel pseudonyms for private values, in DataFrame operations only.

A pattern finds candidates in whole texts; each is validated (Luhn and IBAN
checks, octets, calendar dates, area numbers). A valid value goes through a
keyed Feistel permutation of its own domain and is written back into its own
format. A permutation maps equal values to equal pseudonyms and different ones
to different ones, so values stay linked across documents. Texts are changed
row by row: nothing is shuffled. ``restore`` undoes it with the same key.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

#: Candidates, in this order where several begin at one place. All texts go through Java's regular expressions, in
#: time linear in their length: parts are bounded (those of an address as its standard bounds them) or not given back.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,63}",
    "secret": r"(?i:\b(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d)\b[\"']?\s*+[:=]\s*+[\"']?)[A-Za-z0-9+/_=-]{8,}+",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "date": r"\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})\b",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "phone": r"\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}\b|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}\b|\b[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}\b",
    "card": r"\b[0-9](?:[ -]?[0-9]){12,18}\b",
}

#: Setting that holds the key, and rounds of a permutation.
KEY_SETTING, ROUNDS = "spark.evidentia.pii.key", 10

#: Dates from 1900-01-01 to 2099-12-31: 73,049 days, which is this product; steps of a walk through a part of them.
FIRST_YEAR, YEARS, FIRST_DAY, DAY_FACTORS, STEPS = 1900, 200, "1900-01-01", (17, 4297), 64

#: Groups and serial numbers of a social security number; its 898 areas are 001 to 899 but 666.
SSN_SIZES = (99, 9999)


def configured_key(spark: SparkSession) -> str:
    """The key in the session's KEY_SETTING; where none is set, a random one for this session alone."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def _hash(key: str, tag: str, i: Column, value: Column) -> Column:
    """60 bits of SHA-256 over key, domain, round and the other half."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), i.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _rounds(undo: bool) -> Column:
    return F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if undo else F.sequence(F.lit(1), F.lit(ROUNDS))


def permuted(a: Column, b: Column, size_a: Column, size_b: Column, key: str, tag: str, undo: bool = False) -> Column:
    """A keyed permutation of pairs (a, b) with 0 <= a < size_a and 0 <= b < size_b: rounds shift one half by a hash of the other."""

    def moved(x: Column, by: Column, size: Column) -> Column:
        return F.pmod(x - F.pmod(by, size) if undo else x + F.pmod(by, size), size)

    def turn(pair: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, moved(pair["a"], _hash(key, tag, i, pair["b"]), size_a)).otherwise(pair["a"]).alias("a"),
            F.when(odd, pair["b"]).otherwise(moved(pair["b"], _hash(key, tag, i, pair["a"]), size_b)).alias("b"),
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(_rounds(undo), start, turn)


def permuted_digits(digits: Column, key: str, tag: str, undo: bool = False) -> Column:
    """A keyed permutation of the strings of 2 to 34 digits of one length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    ten = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("long")
    pair = permuted(F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, rest), ten(half), ten(rest), key, tag, undo)
    return F.concat(F.lpad(pair["a"].cast("string"), half, "0"), F.lpad(pair["b"].cast("string"), rest, "0"))


def permuted_letters(text: Column, key: str, tag: str, undo: bool = False) -> Column:
    """A keyed permutation of strings: letters and digits change within their class and case, other characters stay."""

    def shifted(half: Column, digest: Column, i: Column) -> Column:
        def letter(c: Column, at: Column) -> Column:
            move = _hash(key, tag, i, F.concat_ws("|", at.cast("string"), digest))
            code = F.ascii(c)
            base = F.when(c.rlike("[a-z]"), 97).when(c.rlike("[A-Z]"), 65).when(c.rlike("[0-9]"), 48)
            size = F.when(c.rlike("[0-9]"), 10).otherwise(26)
            by = F.pmod(move, size)
            return F.when(base.isNull(), c).otherwise(F.char(base + F.pmod(code - base - by if undo else code - base + by, size)))

        return F.when(F.length(half) == 0, half).otherwise(F.array_join(F.transform(F.split(half, ""), letter), ""))

    def turn(state: Column, i: Column) -> Column:
        """One half moves by the digest of the other, which is made anew a round later: long texts take linear time."""
        odd = i % 2 == 1
        one = F.when(odd, shifted(state["a"], state["digest"], i)).otherwise(shifted(state["b"], state["digest"], i))
        moved = F.transform(F.array(one), lambda x: F.struct(F.when(odd, x).otherwise(state["a"]).alias("a"), F.when(odd, state["b"]).otherwise(x).alias("b"), F.sha2(x, 256).alias("digest")))
        return F.get(moved, 0)

    half = F.floor((F.length(text) + 1) / 2).cast("int")
    a, b = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    start = F.struct(a.alias("a"), b.alias("b"), F.sha2(a if undo else b, 256).alias("digest"))
    pair = F.aggregate(_rounds(undo), start, turn)
    return F.concat(pair["a"], pair["b"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def in_format(value: Column, new: Column) -> Column:
    """``value`` with its letters and digits replaced by those of ``new``, one by one; other characters keep their places."""

    def step(done: Column, c: Column) -> Column:
        mine = c.rlike("[A-Za-z0-9]")
        return F.struct(
            F.concat(done["out"], F.when(mine, F.substring(new, done["at"] + 1, F.lit(1))).otherwise(c)).alias("out"),
            (done["at"] + mine.cast("int")).alias("at"),
        )

    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)["out"]


def luhn_sum(digits: Column, first_doubled: bool) -> Column:
    """Sum of a number's digits from the right, every second one doubled (the last one too if ``first_doubled``)."""

    def add(total: Column, c: Column) -> Column:
        d = c.cast("int") * F.when(total["odd"], 2).otherwise(1)
        return F.struct((total["sum"] + d - F.when(d > 9, 9).otherwise(0)).alias("sum"), (~total["odd"]).alias("odd"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(first_doubled).alias("odd"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, add)["sum"]


def iban_remainder(text: Column) -> Column:
    """The number that letters (A = 10) and digits spell, modulo 97."""

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def permuted_date(value: Column, key: str, undo: bool) -> tuple[Column, Column]:
    """Whether a candidate is a calendar date from 1900 to 2099, and its pseudonym with digits in the same places.

    A date with a slash has the month first if it can. One-digit days go to
    one-digit days; else a walk along the permutation of all days ends at the
    first that can be written in the same places and read the same way.
    """
    parts = F.split(value, "[-./]")
    part = lambda k: F.get(parts, k)
    iso, dots = value.contains("-"), value.contains(".")
    day_first = dots | (~iso & (part(0).cast("int") > 12))
    year = F.when(iso, part(0)).otherwise(part(2)).cast("int")
    month_text = F.when(iso | day_first, part(1)).otherwise(part(0))
    day_text = F.when(iso, part(2)).when(day_first, part(0)).otherwise(part(1))
    month, day = month_text.cast("int"), day_text.cast("int")
    date = F.try_to_timestamp(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month.cast("string"), day.cast("string")), F.lit("yyyy-M-d")).cast("date")
    valid = date.isNotNull() & year.between(FIRST_YEAR, FIRST_YEAR + YEARS - 1)

    narrow_month, narrow_day = F.length(month_text) == 1, F.length(day_text) == 1
    pair = permuted(year - FIRST_YEAR, (month - 1) * 9 + day - 1, F.lit(YEARS), F.when(narrow_month, 81).otherwise(108), key, "date9", undo)
    m, n = DAY_FACTORS
    date_of = lambda x: F.date_add(F.lit(FIRST_DAY).cast("date"), (x["a"] * n + x["b"]).cast("int"))
    fits = lambda x: (~narrow_month | (F.month(date_of(x)) <= 9)) & (dots | ~day_first | (F.dayofmonth(date_of(x)) > 12))
    number = F.datediff(date, F.lit(FIRST_DAY).cast("date"))
    start = F.struct(F.floor(number / n).cast("long").alias("a"), F.pmod(number, F.lit(n)).cast("long").alias("b"))
    far = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda x, k: F.when((k == 1) | ~fits(x), permuted(x["a"], x["b"], F.lit(m), F.lit(n), key, "date", undo)).otherwise(x))

    def written(y: Column, mo: Column, d: Column) -> Column:
        y, mo, d = y.cast("string"), F.lpad(mo.cast("string"), F.length(month_text), "0"), F.lpad(d.cast("string"), F.length(day_text), "0")
        return F.when(iso, F.concat_ws("-", y, mo, d)).when(dots, F.concat_ws(".", d, mo, y)).when(day_first, F.concat_ws("/", d, mo, y)).otherwise(F.concat_ws("/", mo, d, y))

    near = written(pair["a"] + FIRST_YEAR, F.floor(pair["b"] / 9) + 1, F.pmod(pair["b"], F.lit(9)) + 1)
    found = F.transform(F.array(far), lambda x: written(F.year(date_of(x)), F.month(date_of(x)), F.dayofmonth(date_of(x))))
    return valid, F.when(narrow_day, near).otherwise(F.get(found, 0))


def pseudonym(value: Column, key: str, undo: bool = False) -> Column:
    """A struct (kind, text) of a candidate: its kind and pseudonym, or null and itself where it isn't valid."""
    digits = _digits(value)
    matches = {kind: value.rlike(f"^(?:{pattern})$") for kind, pattern in PATTERNS.items()}

    local = F.regexp_extract(value, "^([^@]*)@", 1)
    email = F.concat(permuted_letters(local, key, "email", undo), F.substring(value, F.length(local) + 1, F.length(value)))

    name = F.regexp_extract(value, r"(?s)^(.*?[:=]\s*[\"']?)[^:=\s\"']", 1)
    secret = F.concat(name, permuted_letters(F.substring(value, F.length(name) + 1, F.length(value)), key, "secret", undo))

    compact = F.replace(value, F.lit(" "), F.lit(""))
    country, account = F.substring(compact, 1, 2), F.substring(compact, F.lit(5), F.length(compact))
    iban_valid = F.length(compact).between(15, 34) & F.substring(compact, 3, 2).between("02", "98") & (iban_remainder(F.concat(account, F.substring(compact, 1, 4))) == 1)
    new_account = permuted_letters(account, key, "iban", undo)
    check = F.lpad((98 - iban_remainder(F.concat(new_account, country, F.lit("00")))).cast("string"), 2, "0")
    iban = in_format(value, F.concat(country, check, new_account))

    date_valid, date = permuted_date(value, key, undo)

    octets = F.split(value, r"\.")
    octet = lambda k: F.get(octets, k).cast("int")
    address = permuted(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536), key, "ip", undo)
    ip = F.concat_ws(".", *[F.pmod(F.floor(address[h] / s), F.lit(256)).cast("string") for h in "ab" for s in (256, 1)])

    number = lambda a, n: F.substring(digits, a, n).cast("int")
    ssn_valid = ~number(1, 3).isin(0, 666) & (number(1, 3) < 900) & (number(4, 2) > 0) & (number(6, 4) > 0)
    groups, serials = SSN_SIZES
    area = number(1, 3) - 1 - (number(1, 3) > 666).cast("int")
    pair = permuted(area * groups + number(4, 2) - 1, number(6, 4) - 1, F.lit(898 * groups), F.lit(serials), key, "ssn", undo)
    area = F.floor(pair["a"] / groups) + 1
    area = area + (area >= 666).cast("int")
    ssn = F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in ((area, 3), (F.pmod(pair["a"], F.lit(groups)) + 1, 2), (pair["b"] + 1, 4))])

    code = F.when(value.startswith("+"), F.regexp_extract(value, r"^\+([0-9]{1,3}?)(?:[ .(-]|[0-9]{7,}$)", 1)).otherwise("")
    national = F.substring(digits, F.length(code) + 1, F.length(digits))
    phone = in_format(value, F.concat(code, permuted_digits(national, key, "phone", undo)))

    payload = F.substring(digits, F.lit(1), F.length(digits) - 1)
    new_payload = permuted_digits(payload, key, "card", undo)
    card = in_format(value, F.concat(new_payload, F.pmod(-luhn_sum(new_payload, True), F.lit(10)).cast("string")))

    valid = {
        "email": (F.lit(True), email),
        "secret": (F.lit(True), secret),
        "iban": (iban_valid, iban),
        "date": (date_valid, date),
        "ip": (F.forall(octets, lambda o: (o.cast("int") <= 255) & (o.cast("int").cast("string") == o)), ip),
        "ssn": (ssn_valid, ssn),
        "phone": (F.length(national).between(7, 12), phone),
        "card": (F.length(digits).between(13, 19) & (luhn_sum(digits, False) % 10 == 0), card),
    }
    out = F.struct(F.lit(None).cast("string").alias("kind"), value.alias("text"))
    for kind in reversed(PATTERNS):
        fits, text = valid[kind]
        out = F.when(matches[kind] & fits, F.struct(F.lit(kind).alias("kind"), text.alias("text"))).otherwise(out)
    return out


def _replaced(docs: DataFrame, key: str, undo: bool) -> DataFrame:
    every = "|".join(f"(?:{p})" for p in PATTERNS.values())
    text = F.col("text")
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    may = text.rlike("[0-9@]|(?i:secret|token|key|passw)")  # without these no pattern fits
    rows = rows.withColumn("values", F.when(may, F.transform(F.regexp_extract_all(text, F.lit(every), F.lit(0)), lambda v: pseudonym(v, key, undo))))
    found = F.transform(F.filter("values", lambda v: v["kind"].isNotNull()), lambda v: v["kind"])
    pieces = F.split(text, every, -1)
    merged = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("values"), i)["text"], F.lit("")))), "")
    return rows.select(
        "doc_id",
        F.when(F.size(found) > 0, merged).otherwise(text).alias("text"),
        F.coalesce(found, F.expr("cast(array() as array<string>)")).alias("found"),
    )


def pseudonymise(docs: DataFrame, key: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, text (with pseudonyms), found (array of kinds, one for each value replaced).

    Candidates that aren't valid stay as they are: card numbers that fail Luhn's
    check, dates that aren't in the calendar or not from 1900 to 2099, octets
    over 255 or with leading zeros, local parts of over 64 characters. A null text
    stays null, an empty one empty, and texts of any length are read whole, in
    linear time. Repeated rows get equal results, an empty table gives an empty
    one. Other columns, whatever their names, are not read. ``key`` is the secret
    of the permutation, by default the cluster's (``configured_key``).
    """
    return _replaced(docs, key or configured_key(docs.sparkSession), undo=False)


def restore(docs: DataFrame, key: str) -> DataFrame:
    """``pseudonymise`` undone with the same key: the same columns, ``text`` as it was."""
    return _replaced(docs, key, undo=True)
