"""Format-preserving pseudonyms for numbers and dates in texts, by keyed Feistel permutations.

Found by pattern and then validated: payment card numbers (Luhn), phone numbers of ten digits, with or without 1 before
them, and of other countries with + before them, social security numbers, IPv4 addresses, and dates from 1900 to 2099.  A
valid value is permuted within all valid values of its format: its pseudonym has the same separators and is valid again,
equal values get equal pseudonyms in every document however they are punctuated, different ones different pseudonyms, and
who has the key can undo it.  All else in a text stays as it is.  Native: only DataFrame functions.

In a row of digit groups every part of 13 to 19 digits may be a card; from the left, the longest valid part is taken.  The
digits of a pseudonym are masked until all formats are done, so no format reads another's pseudonym: every digit is replaced
at most once.  Dates stay on the same side of day 12, which tells dd/MM/yyyy from MM/dd/yyyy.

Undoing needs a text that is read in the same parts as the original.  With ``reversible``, a row of groups whose pseudonym
would be read in other parts is permuted again, so there, and only there, equal cards can differ; without it they never do.
Either way a phone number or date that forms a card number together with the digit groups next to it may not be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.feistel import WALK, permuted

# Patterns of the formats, in the order in which they are applied.
_WORD, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"


def _apart(pattern: str, separator: str) -> str:
    """``pattern`` not next to digits, nor to more of the same format."""
    return f"(?<![0-9])(?<![0-9]{separator}){pattern}(?![0-9]|{separator}[0-9])"


PATTERNS = {
    # whole rows of groups; possessive, so that long rows need no stack
    "card": _WORD + r"(?=(?:[ -]?[0-9]){13})[0-9]++(?![A-Za-z])(?:[ -][0-9]++(?![A-Za-z]))*+",
    "phone": _WORD + r"(?<![0-9][.-])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-]?)[0-9]{3}[ .-]?[0-9]{4}" + _END + r"(?![.-][0-9])",
    "abroad": r"(?<![0-9A-Za-z+])\+[2-9](?:[ .-]?\(?[0-9]\)?){7,14}" + _END,
    "ssn": _apart(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "-"),
    "ip": _apart(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", r"\."),
    "iso_date": _apart(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "-"),
    "dotted_date": _apart(r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}", r"\."),
    "slashed_date": _apart(r"[0-9]{2}/[0-9]{2}/[0-9]{4}", "/"),
}
DATES = {"iso_date": ["yyyy-MM-dd"], "dotted_date": ["dd.MM.yyyy"], "slashed_date": ["MM/dd/yyyy", "dd/MM/yyyy"]}
FIRST_DAY, DAYS = "1900-01-01", 73049

# Noncharacters stand for the digits of pseudonyms; where a text holds such characters itself, they are escaped.
_MASK = "".join(chr(0xFDD0 + i) for i in range(10))
_ESCAPE, _ESCAPED = chr(0xFDDA), [chr(0xFDDB + i) for i in range(11)]


def _masked(digits: Column) -> Column:
    return F.translate(digits, "0123456789", _MASK)


def _escaped(text: Column) -> Column:
    out = F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + _ESCAPED[10]))
    for c, e in zip(_MASK, _ESCAPED):
        out = F.replace(out, F.lit(c), F.lit(_ESCAPE + e))
    return F.when(text.rlike(f"[{_MASK}{_ESCAPE}]"), out).otherwise(text)


def _unmasked(text: Column) -> Column:
    out = F.translate(text, _MASK, "0123456789")
    some = out
    for c, e in zip(_MASK + _ESCAPE, _ESCAPED):
        some = F.replace(some, F.lit(_ESCAPE + e), F.lit(c))
    return F.when(text.contains(_ESCAPE), some).otherwise(out)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _part(digits: Column, at: int, n: int) -> Column:
    return F.substring(digits, at, n).cast("long")


def _padded(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _into(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits`` one by one."""
    letters = F.split(shape, "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        number = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(number, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"),
                        (s["at"] + number.cast("int")).alias("at"))

    return F.aggregate(letters, start, step, lambda s: s["out"])


def luhn_digit(body: Column) -> Column:
    """The check digit behind ``body``."""
    total = F.aggregate(F.reverse(F.split(body, "")), F.struct(F.lit(0).alias("sum"), F.lit(2).alias("times")), lambda s, c: F.struct(
        (s["sum"] + F.when(c.cast("int") * s["times"] > 9, c.cast("int") * s["times"] - 9).otherwise(c.cast("int") * s["times"])).alias("sum"),
        (3 - s["times"]).alias("times")), lambda s: s["sum"])
    return ((10 - total % 10) % 10).cast("string")


def _ten(k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**i) for i in range(11)]), k.cast("int") + 1)


def _number(digits: Column, key: str, tweak: str, back: bool) -> Column:
    """``digits`` (2 to 18) permuted within all numbers of as many digits."""
    n = F.length(digits)
    half = F.call_function("div", n, F.lit(2))
    image = permuted(digits.cast("long"), None, key, F.concat(F.lit(tweak), n.cast("string")), back, (_ten(n - half), _ten(half)))
    return F.lpad(image.cast("string"), n, F.lit("0"))


def _card(found: Column, key: str, back: bool) -> Column:
    digits = _digits(found)
    image = _number(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card", back)
    return _into(found, F.concat(image, luhn_digit(image)))


def _groups(row: Column) -> Column:
    return F.regexp_extract_all(row, F.lit("[0-9]+[ -]?"), F.lit(0))


def _joined(groups: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(groups, first, n), "")


def _cards(row: Column) -> Column:
    """The first and last groups (from 1) of the cards in a row of groups."""
    groups = _groups(row)

    def valid(digits: Column) -> Column:
        n = F.length(digits)
        return F.when(n.between(13, 19), F.right(digits, F.lit(1)) == luhn_digit(F.substr(digits, F.lit(1), n - 1))).otherwise(False)

    def step(s: Column, i: Column) -> Column:
        ends = F.sequence(i, F.least(i + 18, F.size(s["groups"])))
        last = F.array_max(F.filter(ends, lambda j: valid(_digits(_joined(s["groups"], i, j - i + 1)))))
        last = F.when(i >= s["next"], last)
        return F.transform(F.array(last), lambda e: F.struct(
            s["groups"].alias("groups"), F.coalesce(e + 1, s["next"]).alias("next"),
            F.when(e.isNotNull(), F.concat(s["cuts"], F.array(F.struct(i.alias("a"), e.alias("b"))))).otherwise(s["cuts"]).alias("cuts")))[0]

    start = F.struct(groups.alias("groups"), F.lit(1).alias("next"), F.lit(None).cast("array<struct<a:int,b:int>>").alias("cuts"))
    start = start.withField("cuts", F.from_json(F.lit("[]"), "array<struct<a:int,b:int>>"))
    return F.aggregate(F.sequence(F.lit(1), F.size(groups)), start, step, lambda s: s["cuts"])


def _row(row: Column, cuts: Column, key: str, back: bool, reversible: bool) -> Column:
    """``row`` with its cards permuted and masked; ``reversible``: permuted until it is read in the same parts again."""

    def each(row: Column, image) -> Column:
        start = F.struct(_groups(row).alias("groups"), F.lit("").alias("out"), F.lit(1).alias("next"))
        return F.aggregate(cuts, start, lambda s, c: F.struct(s["groups"].alias("groups"), F.concat(
            s["out"], _joined(s["groups"], s["next"], c["a"] - s["next"]), image(_joined(s["groups"], c["a"], c["b"] - c["a"] + 1))).alias("out"),
            (c["b"] + 1).alias("next")), lambda s: F.concat(s["out"], _joined(s["groups"], s["next"], F.size(s["groups"]) - s["next"] + 1)))

    def once(row: Column) -> Column:
        return each(row, lambda found: _card(found, key, back))

    def again(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(F.transform(F.array(once(s["row"])), lambda r: F.struct(
            r.alias("row"), F.coalesce(_cards(r) == cuts, F.lit(False)).alias("done")))[0])

    if not reversible:
        return F.when(F.size(cuts) > 0, each(row, lambda found: _masked(_card(found, key, back))))
    walked = F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), F.struct(row.alias("row"), F.lit(False).alias("done")), again, lambda s: s["row"])
    return F.when(F.size(cuts) > 0, F.transform(F.array(walked), lambda r: each(r, _masked))[0])


def _phone(found: Column, key: str, back: bool) -> Column:
    digits = _digits(found)
    lead = F.when(F.length(digits) > 10, F.lit("1")).otherwise(F.lit(""))
    return _into(found, F.concat(lead, _number(F.right(digits, F.lit(10)), key, "phone", back)))


def _abroad(found: Column, key: str, back: bool) -> Column:
    """The first two digits, which tell the country or its region, stay."""
    digits = _digits(found)
    return _into(found, F.concat(F.substr(digits, F.lit(1), F.lit(2)), _number(F.substr(digits, F.lit(3)), key, "abroad", back)))


def _ssn(found: Column, key: str, back: bool) -> Column:
    digits = _digits(found)
    area, group, serial = _part(digits, 1, 3), _part(digits, 4, 2), _part(digits, 6, 4)
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    x = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    y = permuted(F.when(valid, x), 898 * 99 * 9999, key, "ssn", back)
    place = F.call_function("div", y, F.lit(99 * 9999))
    number = F.concat(_padded(place + F.when(place >= 665, 2).otherwise(1), 3), _padded(F.call_function("div", y, F.lit(9999)) % 99 + 1, 2),
                      _padded(y % 9999 + 1, 4))
    return F.when(valid, _into(found, number))


def _ip(found: Column, key: str, back: bool) -> Column:
    parts = F.split(found, r"\.")
    octet = [F.try_element_at(parts, F.lit(i)).cast("long") for i in (1, 2, 3, 4)]
    valid = F.forall(parts, lambda p: (p.cast("int") < 256) & ((F.length(p) == 1) | ~p.startswith("0")))
    x = ((octet[0] * 256 + octet[1]) * 256 + octet[2]) * 256 + octet[3]
    y = permuted(F.when(valid, x), 1 << 32, key, "ip", back, (F.lit(65536).cast("long"), F.lit(65536).cast("long")))
    return F.when(valid, F.concat_ws(".", *[(F.call_function("div", y, F.lit(256**i)) % 256).cast("string") for i in (3, 2, 1, 0)]))


def _date(found: Column, key: str, back: bool, form: str) -> Column:
    first = F.lit(FIRST_DAY).cast("date")
    day = F.datediff(F.try_to_timestamp(found, F.lit(form)).cast("date"), first).cast("long")
    valid = day.between(0, DAYS - 1)
    late = lambda x: F.dayofmonth(F.date_add(first, x.cast("int"))) > 12
    once = lambda x: permuted(x, DAYS, key, "date", back)
    y = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(F.when(valid, day)),
                    lambda y, _: F.when(late(y) == late(day), y).otherwise(once(y)))
    return F.when(valid, F.date_format(F.date_add(first, y.cast("int")), form))


def _image(kind: str, found: Column, key: str, back: bool) -> Column:
    if kind in DATES:
        return F.coalesce(*[_date(found, key, back, form) for form in DATES[kind]])
    return {"phone": _phone, "abroad": _abroad, "ssn": _ssn, "ip": _ip}[kind](found, key, back)


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", out_col: str = "pseudonymised", back: bool = False,
                  reversible: bool = True) -> DataFrame:
    """``docs`` with ``out_col``, the text with its pseudonyms, and ``n_`` columns that count the replaced values by format.

    Null texts stay null with counts of 0.  Values that the validation rejects stay.  ``back`` puts the originals back,
    given the same key.  All other columns stay; an existing column of an added name is an error.
    """
    if clash := {out_col, *[f"n_{k}" for k in PATTERNS]} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    out = docs.withColumn(out_col, _escaped(F.col(f"`{text_col}`").cast("string")))
    for kind, pattern in PATTERNS.items():
        text = F.col(f"`{out_col}`")
        some = text.rlike(pattern)
        found = F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        out = out.withColumn("_found", found)
        if kind == "card":
            out = out.withColumn("_cuts", F.transform("_found", _cards))
            out = out.withColumn("_images", F.zip_with("_found", "_cuts", lambda f, c: _row(f, c, key, back, reversible)))
            many = F.aggregate("_cuts", F.lit(0), lambda n, c: n + F.size(c))
        else:
            out = out.withColumn("_images", F.transform("_found", lambda f: _masked(_image(kind, f, key, back))))
            many = F.size(F.filter("_images", lambda i: i.isNotNull()))
        whole = F.array_join(F.zip_with(F.split(text, pattern, -1), F.zip_with(
            "_found", "_images", lambda f, i: F.coalesce(i, f)), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        out = out.withColumns({out_col: F.coalesce(F.when(F.col("_found").isNotNull(), whole), text),
                               f"n_{kind}": F.greatest(F.lit(0), F.coalesce(many, F.lit(0)).cast("int"))}).drop("_found", "_images", "_cuts")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], _unmasked(F.col(f"`{out_col}`")).alias(out_col), *[f"n_{kind}" for kind in PATTERNS])
