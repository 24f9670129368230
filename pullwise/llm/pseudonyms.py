"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Validated values are permuted within their own format: card numbers (Luhn), IBANs (mod 97), North American phone numbers, social
security numbers, IPv4 addresses, calendar dates of 1900 to 2099 (YYYY-MM-DD and DD/MM/YYYY; other forms of dates stay as they are) and
e-mail addresses. The pseudonym is valid in the same format and looks the same (punctuation, grouping, case); numbers outside the North
American plan, and account numbers, stay outside the plan and without a card's check. As the permutation depends on the key and the format
only, equal values have equal pseudonyms in all documents and different values different ones. Numbers run through a Feistel network over Z_a x Z_b
with a * b the size of the format; names in e-mail addresses through one over their characters, letters to letters and digits
to digits. Check digits are worked out again. Values that fail validation stay; long digit runs that fit the card format but fail the
check are treated as plain account numbers.

Odd cases: null and empty texts stay; repeated rows come out alike; an empty table gives an empty table; further columns pass
through untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullwise.llm.common import array_sum, let
from pullwise.llm.spans import matches, replaced

ROUNDS = 8
WALK = 100          # steps of a walk at most; a class takes up a third of its values or more, so more are needed once in 10^17 values
EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+?1[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
ABROAD = r"(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}(?:[\x20.-]?\(?[0-9]{2,4}\)?){2,4}(?![0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9/.-])(?:(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])/(?:0[1-9]|1[0-2])/(?:19|20)[0-9]{2})(?![0-9/-])"
CARD = r"(?<![0-9A-Za-z.+-])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9A-Za-z]|[.-][0-9])"
KINDS = (("email", EMAIL), ("ip", IP), ("iban", IBAN), ("phone", PHONE), ("abroad", ABROAD), ("ssn", SSN), ("date", DATE), ("card", CARD))
ANY = "|".join(f"(?:{p})" for _, p in KINDS)
GUARD = "[0-9@]"
FIRST_DAY, DAYS = "1900-01-01", 73049       # of the two centuries, all fewer than 270 * 271


def keyed(key: str, *parts: Column | str) -> Column:
    """48 pseudo-random bits of the key and the parts."""
    text = F.concat_ws("|", F.lit(key), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def permuted(value: Column, a: int, b: int, key: str, name: str) -> Column:
    """A keyed permutation of 0 .. a * b - 1: alternately one half is moved by a function of the other."""
    start = F.struct(F.floor(value / F.lit(b)).cast("long").alias("l"), (value % F.lit(b)).cast("long").alias("r"))
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def step(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(((s["l"] + keyed(key, name, i, s["r"])) % F.lit(a)).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), ((s["r"] + keyed(key, name, i, s["l"])) % F.lit(b)).alias("r")))

    return F.aggregate(rounds, start, step, lambda s: s["l"] * F.lit(b) + s["r"])


def shifted(text: Column, bits: Column) -> Column:
    """Every letter moved in its alphabet and digit in its own, by the hexadecimal digits of a digest; other characters stay."""
    def moved(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(bits, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")

        def turn(first: str, n: int) -> Column:
            return F.char((F.ascii(c) - ord(first) + by) % n + ord(first))

        return F.when(c.rlike("^[0-9]$"), turn("0", 10)).when(c.rlike("^[a-z]$"), turn("a", 26)).when(c.rlike("^[A-Z]$"), turn("A", 26)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), moved), "")


def permuted_text(text: Column, key: str, name: str) -> Column:
    """A keyed permutation of the texts of one shape, by a Feistel network over their two halves."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, n - half).alias("r"))

    def step(s: Column, i: Column) -> Column:
        digest = lambda side: F.sha2(F.concat_ws("|", F.lit(key), F.lit(name), i.cast("string"), n.cast("string"), side), 256)
        return F.when(i % 2 == 0, F.struct(shifted(s["l"], digest(s["r"])).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), shifted(s["r"], digest(s["l"])).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def walked(value: Column, step: Callable[[Column], Column], belongs: Callable[[Column], Column]) -> Column:
    """The first of step(value), step(step(value)) and so on that belongs to the class of value: a permutation of the class, as the
    step is one of all values."""
    def taken(v: Column) -> Column:
        return let(step(v), lambda new: F.struct(new.alias("v"), belongs(new).alias("there")))

    return F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), taken(value), lambda s, _: F.when(s["there"], s).otherwise(taken(s["v"])), lambda s: s["v"])


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def refilled(text: Column, symbols: Column, which: str = "[0-9]") -> Column:
    """The text with its characters of a class replaced by the given ones, in order."""
    before = lambda i: F.length(F.regexp_replace(F.substring(text, F.lit(1), i), f"[^{which[1:-1]}]", ""))
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(
        c.rlike(f"^{which}$"), F.substring(symbols, before(i) + 1, F.lit(1))).otherwise(c)), "")


def luhn(body: Column) -> Column:
    """Check digit of a number without it."""
    doubled = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return ((10 - array_sum(doubled) % 10) % 10).cast("string")


def mod97(text: Column) -> Column:
    """An IBAN's digits (letters as 10 to 35) modulo 97."""
    values = F.transform(F.split(text, ""), lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda a, v: ((F.when(v > 9, a * 100).otherwise(a * 10) + v) % 97).cast("int"))


def _card(m: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        new = let(permuted_text(body, key, "card"), lambda b: F.concat(b, luhn(b)))
        checked = lambda x: F.right(x, F.lit(1)) == luhn(F.substring(x, F.lit(1), F.length(x) - 1))
        return F.when(checked(d), new).otherwise(walked(d, lambda x: permuted_text(x, key, "account"), lambda x: ~checked(x)))

    return let(digits_of(m), lambda d: let(of(d), lambda new: refilled(m, new)))


def _iban(m: Column, key: str) -> Column:
    def of(x: Column) -> Column:
        land, body = F.substring(x, 1, 2), F.substring(x, F.lit(5), F.length(x) - 4)
        valid = mod97(F.concat(body, F.substring(x, 1, 4))) == 1
        new = let(permuted_text(body, key, "iban"), lambda b: F.concat(land, F.lpad((98 - mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), b))
        return F.when(valid, new).otherwise(x)

    return let(F.regexp_replace(m, r"\x20", ""), lambda x: let(of(x), lambda new: refilled(m, new, "[A-Z0-9]")))


def _phone(m: Column, key: str) -> Column:
    """Area code and exchange within 200 to 999, so the result is a number of the same plan; others only keep the format."""
    def of(d: Column) -> Column:
        own = F.right(d, F.lit(10))
        part = lambda a, n: F.substring(own, a, n).cast("long")
        value = ((part(1, 3) - 200) * 800 + part(4, 3) - 200) * 10000 + part(7, 4)
        land = F.substring(d, F.lit(1), F.length(d) - 10)
        planned = let(permuted(value, 80000, 80000, key, "phone"), lambda v: F.concat(
            land, (F.floor(v / 8000000) + 200).cast("string"), (F.floor(v / 10000) % 800 + 200).cast("string"), F.lpad((v % 10000).cast("string"), 4, "0")))
        inside = lambda x: (F.substring(x, F.lit(1), F.lit(1)) >= "2") & (F.substring(x, F.lit(4), F.lit(1)) >= "2")
        return F.when(inside(own), planned).otherwise(F.concat(land, walked(own, lambda x: permuted_text(x, key, "number"), lambda x: ~inside(x))))

    return let(digits_of(m), lambda d: let(of(d), lambda new: refilled(m, new)))


def _abroad(m: Column, key: str) -> Column:
    """All digits but the first."""
    return let(digits_of(m), lambda d: let(F.concat(F.substring(d, 1, 1), permuted_text(F.substring(d, F.lit(2), F.length(d) - 1), key, "abroad")),
                                           lambda new: refilled(m, new)))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    part = lambda a, n: F.substring(m, a, n).cast("long")
    area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
    value = (area * 99 + part(5, 2) - 1) * 9999 + part(8, 4) - 1
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return let(permuted(value, 898 * 99, 9999, key, "ssn"), lambda v: let(F.floor(v / (99 * 9999)), lambda a: F.concat_ws(
        "-", pad(a + F.when(a >= 665, 2).otherwise(1), 3), pad(F.floor(v / 9999) % 99 + 1, 2), pad(v % 9999 + 1, 4))))


def _ip(m: Column, key: str) -> Column:
    value = F.aggregate(F.split(m, r"\."), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    return let(permuted(value, 1 << 16, 1 << 16, key, "ip"), lambda v: F.concat_ws(
        ".", *[(F.shiftrightunsigned(v, s) % 256).cast("string") for s in (24, 16, 8, 0)]))


def _date(m: Column, key: str) -> Column:
    iso = m.rlike("^[0-9]{4}-")
    day = F.coalesce(F.try_to_timestamp(m, F.lit("yyyy-MM-dd")), F.try_to_timestamp(m, F.lit("dd/MM/yyyy"))).cast("date")
    value = F.datediff(day, F.to_date(F.lit(FIRST_DAY))).cast("long")
    new = lambda v: F.date_add(F.to_date(F.lit(FIRST_DAY)), v.cast("int"))
    return F.when(day.isNull(), m).otherwise(let(walked(value, lambda v: permuted(v, 270, 271, key, "date"), lambda v: v < DAYS), lambda v: F.when(
        iso, F.date_format(new(v), "yyyy-MM-dd")).otherwise(F.date_format(new(v), "dd/MM/yyyy"))))


def _email(m: Column, key: str) -> Column:
    return F.concat(permuted_text(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


MAKERS = {"email": _email, "ip": _ip, "iban": _iban, "phone": _phone, "abroad": _abroad, "ssn": _ssn, "date": _date, "card": _card}


def kind_of(match: Column) -> Column:
    """The first kind whose pattern is the whole match."""
    result = None
    for name, pattern in KINDS:
        fits = match.rlike(f"^(?:{pattern})$")
        result = F.when(fits, F.lit(name)) if result is None else result.when(fits, F.lit(name))
    return result


def pseudonym(match: Column, key: str) -> Column:
    result = None
    for name, pattern in KINDS:
        fits, value = match.rlike(f"^(?:{pattern})$"), MAKERS[name](match, key)
        result = F.when(fits, value) if result is None else result.when(fits, value)
    return F.coalesce(result.otherwise(match), match)


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """The documents with pseudonyms in their texts; n_chars, if there, follows."""
    text = F.col(column).cast("string")
    new = replaced(text, ANY, lambda m: pseudonym(m, key), GUARD)
    columns = {column: new}
    out = docs.withColumns(columns)
    return out.withColumn("n_chars", F.length(column).cast("long")) if "n_chars" in docs.columns else out


def found(docs: DataFrame) -> DataFrame:
    """Per row doc_id and the personal data in its text: (start, end, kind)."""
    spans = matches(F.coalesce(F.col("text").cast("string"), F.lit("")), ANY, GUARD)
    return docs.select("doc_id", F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind_of(s["match"]).alias("kind"))).alias("found"))
