"""Format-preserving pseudonyms for numbers and dates by a keyed Feistel permutation. Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.registry import query, table

ROUNDS = 10

# fixed values: what each format looks like; all but cards are right by their pattern alone
PHONE = r"(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})"
SSN = r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"{OCTET}(?:\.{OCTET}){{3}}"
YEAR = r"(?:1[89]|2[01])\d{2}"
LEAP = r"(?:(?:1[89]|2[01])(?:0[48]|[2468][048]|[13579][26])|2000)"
LONG, SHORT = "(?:0[13578]|1[02])", "(?:0[469]|11)"  # months
TO_28, TO_30, TO_31 = r"(?:0[1-9]|1\d|2[0-8])", r"(?:0[1-9]|[12]\d|30)", r"(?:0[1-9]|[12]\d|3[01])"
ISO_DATE = rf"(?:{YEAR}-(?:{LONG}-{TO_31}|{SHORT}-{TO_30}|02-{TO_28})|{LEAP}-02-29)"
DAY_DATE = rf"(?:(?:{TO_31}\.{LONG}|{TO_30}\.{SHORT}|{TO_28}\.02)\.{YEAR}|29\.02\.{LEAP})"
BEFORE, AFTER = r"(?<![\w.+-])", r"(?![\w-]|\.\d)"
ANY = rf"{BEFORE}(?:{ISO_DATE}(?=T\d\d)|(?:{PHONE}|{ISO_DATE}|{DAY_DATE}|{SSN}|{IPV4}){AFTER})"
# groups of digits with single separators, as many as follow each other (possessive: no stack for long ones)
BLOCK = rf"\d++(?:-\d++)*+{AFTER}"
RUN = rf"{BEFORE}{BLOCK}(?: {BLOCK})*+"
CARD_DIGITS = r"\d(?:[ -]?\d){12}"
CARD_GROUPS = "1[3-9]|4 4 4 [1-4]|4 4 4 4( [1-3])?|4 6 [45]"  # lengths that cards are written in

# dates are permuted within one Gregorian cycle, 1800-01-01 to 2199-12-31: 146097 = 189 * 773 days
FIRST_DAY, DAYS_A, DAYS_B = "1800-01-01", 189, 773


def permute(value: Column, a: Column | int, b: Column | int, key: str, kind: Column | str) -> Column:
    """The keyed permutation of 0 <= value < a * b that belongs to a kind of value.

    value = left * b + right; in even rounds left is moved by a keyed hash of right modulo a, in odd rounds
    right by one of left modulo b. Every round can be undone, so values stay distinct. The hash is the first
    60 bits of SHA-256 over key, kind, round and the other half.
    """
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    a, b = as_col(a).cast("long"), as_col(b).cast("long")
    start = F.struct(F.call_function("div", value, b).alias("l"), F.pmod(value, b).alias("r"))

    def hashed(i: Column, half: Column) -> Column:
        text = F.concat_ws(":", F.lit(key), as_col(kind), i.cast("string"), half.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        moved = hashed(i, F.when(even, s["r"]).otherwise(s["l"]))
        return F.struct(F.when(even, F.pmod(s["l"] + F.pmod(moved, a), a)).otherwise(s["l"]).alias("l"),
                        F.when(even, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(moved, b), b)).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * b + s["r"])


def _digits(value: Column, width: Column | int) -> Column:
    return F.lpad(value.cast("string"), width, F.lit("0"))


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits``, one by one."""
    put = lambda s, c: F.when(
        c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), put, lambda s: s["out"])


def _luhn_sum(digits: Column, double_last: bool) -> Column:
    """Sum of the digits from the right, every second one doubled (and its digits added)."""
    at = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == (0 if double_last else 1), c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(at, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def _card(found: Column, key: str) -> Column:
    d = F.regexp_replace(found, "[^0-9]", "")
    width = F.length(d) - 1
    body = F.substr(d, F.lit(1), width)
    high = F.ceil(width / 2)
    new = _digits(permute(body.cast("long"), F.pow(F.lit(10.0), high).cast("long"), F.pow(F.lit(10.0), width - high).cast("long"),
                          key, F.concat(F.lit("card"), width.cast("string"))), width)
    check = F.pmod(10 - _luhn_sum(new, True) % 10, F.lit(10))
    valid = F.length(d).between(13, 19) & (_luhn_sum(d, False) % 10 == 0)
    return F.when(valid, _refill(found, F.concat(new, check.cast("string"))))


def _phone(found: Column, key: str) -> Column:
    d = F.regexp_replace(found, "[^0-9]", "")
    new = _digits(permute(F.substring(d, -10, 10).cast("long"), 100000, 100000, key, "phone"), 10)
    return _refill(found, F.concat(F.when(found.startswith("+"), "1").otherwise(""), new))


def _ssn(found: Column, key: str) -> Column:
    area, group, serial = (F.substring(found, p, n).cast("long") for p, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = area - 1 - F.when(area > 666, 1).otherwise(0)  # 898 areas
    new = permute((index * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "ssn")
    top = F.call_function("div", new, F.lit(9999).cast("long"))
    area = F.call_function("div", top, F.lit(99).cast("long")) + 1
    area = area + F.when(area >= 666, 1).otherwise(0)
    return F.when(valid, F.concat_ws("-", _digits(area, 3), _digits(top % 99 + 1, 2), _digits(new % 9999 + 1, 4)))


def _ipv4(found: Column, key: str) -> Column:
    parts = F.split(found, "\\.")
    valid = F.forall(parts, lambda p: (p.cast("int") <= 255) & (p.cast("int").cast("string") == p))
    new = permute(F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s * 256 + p.cast("long")), 65536, 65536, key, "ipv4")
    octets = [(F.shiftrightunsigned(new, s) % 256).cast("string") for s in (24, 16, 8, 0)]
    return F.when(valid, F.concat_ws(".", *octets))


def _date(found: Column, year: Column, month: Column, day: Column, form: str, key: str) -> Column:
    at = F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")
    number = F.datediff(at, F.lit(FIRST_DAY).cast("date")).cast("long")
    new = permute(number, DAYS_A, DAYS_B, key, "date")
    valid = at.isNotNull() & number.between(0, DAYS_A * DAYS_B - 1)
    return F.when(valid, F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), new.cast("int")), form))


def pseudonym(found: Column, key: str) -> Column:
    """The pseudonym of one found string of ``ANY``, or null where it fails the checks of its format."""
    sub = F.substring
    whole = lambda p: found.rlike(f"^(?:{p})$")
    forms = [
        (PHONE, _phone(found, key)),
        (ISO_DATE, _date(found, sub(found, 1, 4), sub(found, 6, 2), sub(found, 9, 2), "yyyy-MM-dd", key)),
        (DAY_DATE, _date(found, sub(found, 7, 4), sub(found, 4, 2), sub(found, 1, 2), "dd.MM.yyyy", key)),
        (SSN, _ssn(found, key)), (IPV4, _ipv4(found, key))]
    return reduce(lambda rest, f: F.when(whole(f[0]), f[1]).otherwise(rest), reversed(forms), F.lit(None).cast("string"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _run(run: Column, key: str) -> Column:
    """``(text, n)`` of a run of digit groups: its cards and dates replaced, and how many.

    Parts of the run begin and end at separators. From the left, a group that begins a date or a card of the usual
    groups takes that, another the longest part with a right check digit that ends before the next such group.
    """
    def parts(groups: Column) -> Column:
        size = F.size(groups)
        part = lambda i, n: F.array_join(F.slice(groups, i + 1, n), "")
        counts = lambda i, most: F.sequence(F.lit(1), F.least(size - i, F.lit(most)))
        is_date = lambda i, n: (n == 3) & part(i, n).rlike(f"^{ISO_DATE}[ -]?$")

        def is_card(i: Column, n: Column) -> Column:
            return _let(F.regexp_replace(part(i, n), "[^0-9]", ""), lambda d: F.when(
                F.length(d).between(13, 19), _luhn_sum(d, False) % 10 == 0).otherwise(False))

        def is_usual(i: Column, n: Column) -> Column:
            lengths = F.transform(F.slice(groups, i + 1, n), lambda g: F.length(F.regexp_replace(g, "[^0-9]", "")).cast("string"))
            return F.array_join(lengths, " ").rlike(f"^(?:{CARD_GROUPS})$") & is_card(i, n)

        usual = F.transform(groups, lambda g, i: F.coalesce(
            F.when(i + 3 <= size, F.when(is_date(i, F.lit(3)), F.lit(3))),
            F.array_max(F.filter(counts(i, 5), lambda n: is_usual(i, n)))))

        def chosen(usual: Column) -> Column:
            longest = lambda i: F.array_max(F.filter(counts(i, 19), lambda n: is_card(i, n) & ~F.exists(
                F.slice(usual, i + 2, n - 1), lambda x: x.isNotNull())))
            step = lambda s, i: F.when(i < s["free"], s).otherwise(_let(F.coalesce(F.get(usual, i), longest(i)), lambda n: F.when(
                n.isNull(), s).otherwise(F.struct((i + n).alias("free"), F.concat(s["at"], F.array(F.struct(i.alias("i"), n.alias("n")))).alias("at")))))
            start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<i:int,n:int>>").alias("at"))
            return F.aggregate(F.sequence(F.lit(0), size - 1), start, step, lambda s: s["at"])

        def written(at: Column) -> Column:
            end = lambda k: F.when(k == 0, 0).otherwise(F.get(at, k - 1)["i"] + F.get(at, k - 1)["n"])
            date = lambda p: F.concat(pseudonym(F.substring(p, 1, 10), key), F.substring(p, 11, 1))
            new = lambda p: F.when(p.rlike(f"^{ISO_DATE}[ -]?$"), date(p)).otherwise(_card(p, key))
            out = F.transform(at, lambda x, k: F.concat(part(end(k), x["i"] - end(k)), _let(part(x["i"], x["n"]), new)))
            rest = part(end(F.size(at)), size - end(F.size(at)))
            return F.struct(F.concat(F.array_join(out, ""), rest).alias("text"), F.size(at).alias("n"))

        return _let(_let(usual, chosen), written)

    few = F.struct(run.alias("text"), F.lit(0).alias("n"))
    return F.when(run.rlike(CARD_DIGITS), _let(F.split(run, "(?<=[ -])"), parts)).otherwise(few)


def _gap(gap: Column, key: str) -> Column:
    """``(text, n)`` of the text between found strings: its runs of digit groups replaced, and how many cards and dates."""
    def joined(new: Column) -> Column:
        text = F.transform(F.split(gap, RUN, -1), lambda x, i: F.concat(x, F.coalesce(F.get(new, i)["text"], F.lit(""))))
        return F.struct(F.array_join(text, "").alias("text"), F.aggregate(new, F.lit(0), lambda s, x: s + x["n"]).alias("n"))

    runs = F.transform(F.regexp_extract_all(gap, F.lit(RUN), F.lit(0)), lambda x: _run(x, key))
    return F.when(gap.rlike(CARD_DIGITS), _let(runs, joined)).otherwise(F.struct(gap.alias("text"), F.lit(0).alias("n")))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count: str = "n_replaced") -> DataFrame:
    """Replace card, phone, social-security and IPv4 numbers and dates by keyed pseudonyms of the same format.

    * cards: 13 to 19 digits with a right check digit, also next to other groups of digits; all but the last digit
      are permuted, the check digit is set anew
    * phones: ten digits, any area and exchange, with or without +1; all ten are permuted
    * social-security numbers: valid areas, groups and serials only
    * IPv4 addresses without leading zeros
    * dates (2024-05-31, 31.05.2024) that exist, from 1800 to 2199, under one permutation for both forms; a time may
      follow after T

    All others come before cards. Separators stay where they are. The same number has the same pseudonym in every
    document (whatever its separators), different ones differ, and the key decides which. What looks like a number
    and fails its checks stays. A null text stays null with count 0; other columns and repeated rows stay; a column
    of the name of ``count`` is replaced. One narrow pass, no shuffle.
    """
    text = F.col(text_col)
    found = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new")))
    docs = docs.withColumn("_found", F.when(text.rlike("[0-9][ .-]?[0-9]"), found))
    docs = docs.withColumn("_gaps", F.when(F.col("_found").isNotNull(), F.transform(F.split(text, ANY, -1), lambda gap: _gap(gap, key))))
    joined = F.array_join(F.transform("_gaps", lambda gap, i: F.concat(
        gap["text"], F.coalesce(F.get("_found", i)["new"], F.get("_found", i)["old"], F.lit("")))), "")
    n = F.size(F.filter("_found", lambda x: x["new"].isNotNull())) + F.aggregate("_gaps", F.lit(0), lambda s, x: s + x["n"])
    return docs.withColumns({text_col: F.coalesce(joined, text), count: F.when(F.col("_found").isNull(), 0).otherwise(n)}).drop("_found", "_gaps")


@query("op3_pseudonyms")
def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, key="corpus-pseudonyms-1").select("doc_id", "text", "n_replaced")
