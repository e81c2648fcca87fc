"""Format-preserving pseudonyms by keyed Feistel networks, in column expressions.

Personal values are found in the text and replaced in place by another value of
the same format. The replacement depends on the key and the value alone, so
equal values get equal pseudonyms in every document, and different values of
one format different ones: each network is a permutation of its format.

Two networks do the work. ``_mixed`` permutes a list of small numbers with a
radix each (octets, area codes, day numbers): a round adds a keyed hash of the
other numbers to one of them. ``_lettered`` permutes a string position by
position within its character class (digit, small, capital, or hexadecimal):
a round shifts one half by a keyed hash of the other. Validity survives: card
numbers keep their check digit right (with ``check_cards`` those where it is
wrong stay; else it is wrong by the same amount), IBANs are checked and rebuilt, dates stay dates of the calendar, social security numbers
stay inside the issued ranges, telephone numbers keep country code and layout.

Everything is one projection without a shuffle, so a document's size or a value
that a third of all rows share makes no difference to any other task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollspark.llm.common import table

#: What is looked for, in the order in which a place is tried.
PATTERNS = {
    "secret": r"(?i:(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[ \t]{0,8}[=:][ \t]{0,8}[\"']?)[A-Za-z0-9+/_\-]{6,}+",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9]{4}){2,7}(?: ?[0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}(?![0-9])"
             r"|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}(?![0-9])"
             r"|(?<![0-9.\-])[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![0-9\-])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9.\-/])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9]|[.\-/][0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9.+\-])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
}
ANY = "|".join(PATTERNS.values())
#: Groups of a longer run of digits that may be a card number by themselves.
GROUPED_CARD = r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5})(?![0-9])"
ROUNDS = 10
#: 400 years of the calendar have 146,097 = 189 * 773 days.
DATE_RADICES, EPOCH = (189, 773), "1800-01-01"


def _hash(key: str, tweak: str, *parts: Column) -> Column:
    """60 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")


def _mixed(numbers: Column, radices: tuple[int, ...], key: str, tweak: str) -> Column:
    """A keyed permutation of the product of ranges 0 to radix - 1; ``numbers`` is an array of them."""
    n, sizes = len(radices), F.array(*[F.lit(r).cast("long") for r in radices])

    def one_round(acc, i):
        here = i % n
        others = F.array_join(F.transform(acc, lambda x, j: F.when(j == here, F.lit("*")).otherwise(x.cast("string"))), ",")
        return F.transform(acc, lambda x, j: F.when(j == here, F.pmod(x + F.pmod(_hash(key, tweak, i, others), F.element_at(sizes, (j + 1).cast("int"))),
                                                                      F.element_at(sizes, (j + 1).cast("int")))).otherwise(x))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS * n // 2 + n)), numbers, one_round)


def _class(c: Column, base: str, size: int, by: Column) -> Column:
    """The character ``c`` moved ``by`` places round its class, which starts at ``base``."""
    return F.chr((F.pmod(F.ascii(c) - ord(base) + by, F.lit(size)) + ord(base)).cast("long"))


def _lettered(text: Column, key: str, tweak: str, hexadecimal: Column | None = None) -> Column:
    """A keyed permutation of the strings with this string's character classes; other characters stay."""
    hexadecimal = F.lit(False) if hexadecimal is None else hexadecimal

    def shifted(half, other, i):
        blocks = F.sequence(F.lit(0), F.floor((F.greatest(F.length(half), F.lit(1)) - 1) / 64).cast("int"))
        stream = F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), b.cast("string"), F.lower(other)), 512)), "")

        def move(c, j):
            by = F.conv(F.substring(stream, 2 * j + 1, F.lit(2)), 16, 10).cast("int")
            at = F.instr(F.lit("0123456789abcdef"), c) - 1
            return (F.when(hexadecimal & c.rlike("^[0-9a-f]$"), F.substring(F.lit("0123456789abcdef"), F.pmod(at + by, F.lit(16)) + 1, F.lit(1)))
                    .when(c.rlike("^[0-9]$"), _class(c, "0", 10, by)).when(c.rlike("^[a-z]$"), _class(c, "a", 26, by))
                    .when(c.rlike("^[A-Z]$"), _class(c, "A", 26, by)).otherwise(c))

        return F.when(F.length(half) == 0, half).otherwise(F.array_join(F.transform(F.split(half, ""), move), ""))

    a = F.floor(F.length(text) / 2).cast("int")
    halves = F.struct(F.substring(text, F.lit(1), a).alias("l"), F.substring(text, a + 1, F.length(text)).alias("r"))

    def one_round(acc, i):
        left, right = acc["l"], acc["r"]
        return F.when(i % 2 == 0, F.struct(left.alias("l"), shifted(right, left, i).alias("r"))) \
            .otherwise(F.struct(shifted(left, right, i).alias("l"), right.alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, one_round, lambda acc: F.concat(acc["l"], acc["r"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(layout: Column, digits: Column) -> Column:
    """``layout`` with its digits replaced, one after another, by ``digits`` (as many)."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    return F.aggregate(
        F.split(layout, ""), start,
        lambda acc, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(acc["s"], F.substring(digits, acc["i"], F.lit(1))).alias("s"), (acc["i"] + 1).alias("i")))
        .otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["i"].alias("i"))),
        lambda acc: acc["s"])


def _let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits that a check digit would follow."""
    def add(acc, d):
        x = d.cast("int") * 2
        return F.struct((acc["s"] + F.when(acc["i"] % 2 == 0, F.when(x > 9, x - 9).otherwise(x)).otherwise(d.cast("int"))).alias("s"), (acc["i"] + 1).alias("i"))
    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("s"), F.lit(0).alias("i")), add, lambda acc: acc["s"])


def _is_card(digits: Column) -> Column:
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return F.pmod(F.substring(digits, -1, 1).cast("int") + _luhn_sum(body), F.lit(10)) == 0


def _card(m: Column, key: str) -> Column:
    def with_check(d):
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        off = F.pmod(F.substring(d, -1, 1).cast("int") + _luhn_sum(body), F.lit(10))  # 0 in a valid number
        new = F.concat(F.substring(d, 1, 1), _lettered(F.substring(body, F.lit(2), F.length(body)), key, "card"))
        return _let(new, lambda x: F.concat(x, F.pmod(off - _luhn_sum(x), F.lit(10)).cast("string")))
    return _refill(m, _let(_digits(m), with_check))


def _checked_card(m: Column, key: str) -> Column:
    """The pseudonym if the Luhn sum is right; else that of the first right number among the run's groups (next to an expiry date, say); else null."""
    def groups(run):
        tail = lambda i: F.substring(run, i, F.length(run))
        starts = F.filter(F.sequence(F.lit(1), F.length(run)), lambda i: (i == 1) | F.substring(run, i - 1, F.lit(1)).isin(" ", "-"))
        return F.concat(F.array(F.struct(F.lit(1).alias("at"), run.alias("number"))),
                        F.transform(starts, lambda i: F.struct(i.alias("at"), F.regexp_extract(tail(i), GROUPED_CARD, 0).alias("number"))))

    right = F.filter(groups(m), lambda g: (g["number"] != "") & _is_card(_digits(g["number"])))
    return _let(F.get(right, F.lit(0)), lambda g: F.when(g.isNotNull(), F.concat(
        F.substring(m, F.lit(1), g["at"] - 1), _card(g["number"], key), F.substring(m, g["at"] + F.length(g["number"]), F.length(m)))))


def _mod97(text: Column) -> Column:
    """Remainder modulo 97 of a string of digits and capitals, capitals counting 10 to 35."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: F.when(c.rlike("^[0-9]$"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))


def _iban(m: Column, key: str) -> Column:
    def rebuilt(x):
        land, account = F.substring(x, 1, 2), F.substring(x, F.lit(5), F.length(x))
        valid = _mod97(F.concat(account, F.substring(x, 1, 4))) == 1
        new = _let(_lettered(account, key, "iban"), lambda y: F.concat(F.lpad((98 - _mod97(F.concat(y, land, F.lit("00")))).cast("string"), 2, "0"), y))
        return F.when(valid, _refill(m, new))
    return _let(F.regexp_replace(m, " ", ""), rebuilt)


def _numbers(*parts: Column) -> Column:
    return F.array(*[p.cast("long") for p in parts])


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, r"^\+([0-9]{1,3})(?=[^0-9])", 1)

    def renumbered(d):
        n = F.substring(d, F.length(code) + 1, F.length(d))
        american = (F.length(n) == 10) & n.rlike("^[2-9][0-9]{2}[2-9]") & code.isin("", "1")
        parts = _numbers(F.substring(n, 1, 3).cast("int") - 200, F.substring(n, 4, 3).cast("int") - 200, F.substring(n, 7, 4).cast("int"))
        new = _let(_mixed(parts, (800, 800, 10000), key, "phone"),
                   lambda x: F.concat((x[0] + 200).cast("string"), (x[1] + 200).cast("string"), F.lpad(x[2].cast("string"), 4, "0")))
        return F.concat(code, F.when(american, new).otherwise(_lettered(n, key, "phone")))

    return _refill(m, _let(_digits(m), renumbered))


def _ip(m: Column, key: str) -> Column:
    return F.array_join(F.transform(_mixed(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), (256,) * 4, key, "ip"), lambda x: x.cast("string")), ".")


def _ssn(m: Column, key: str) -> Column:
    def renumbered(p):
        area, group, serial = p[0], p[1], p[2]
        valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        mine = _numbers(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
        new = _let(_mixed(mine, (898, 99, 9999), key, "ssn"), lambda x: F.concat_ws(
            "-", F.lpad(F.when(x[0] >= 665, x[0] + 2).otherwise(x[0] + 1).cast("string"), 3, "0"),
            F.lpad((x[1] + 1).cast("string"), 2, "0"), F.lpad((x[2] + 1).cast("string"), 4, "0")))
        return F.when(valid, new)
    return _let(F.transform(F.split(m, "-"), lambda x: x.cast("long")), renumbered)


def _date(m: Column, key: str) -> Column:
    """ISO, day.month.year, and month/day/year (day/month/year where the first number is over 12).

    Within an order the pseudonym is a permutation of the days; a date written
    with slashes does not tell its order, so one of each order may look alike.
    """
    p = F.split(m, r"[.\-/]")
    iso, dots = m.contains("-"), m.contains(".")
    dayfirst = dots | (~iso & (p[0].cast("int") > 12))
    y = F.when(iso, p[0]).otherwise(p[2])
    mo = F.when(iso, p[1]).when(dayfirst, p[1]).otherwise(p[0])
    d = F.when(iso, p[2]).when(dayfirst, p[0]).otherwise(p[1])

    def changed(day):
        n = F.datediff(day, F.lit(EPOCH).cast("date")).cast("long")
        block, pos = F.floor(n / 146097), F.pmod(n, F.lit(146097).cast("long"))
        moved = _mixed(_numbers(F.floor(pos / 773), pos % 773), DATE_RADICES, key, "date")
        new = _let(moved, lambda x: F.date_add(F.lit(EPOCH).cast("date"), (block * 146097 + x[0] * 773 + x[1]).cast("int")))

        def written(z):
            two = lambda v: F.lpad(v.cast("string"), 2, "0")
            yy, mm, dd = F.lpad(F.year(z).cast("string"), 4, "0"), two(F.month(z)), two(F.dayofmonth(z))
            return F.when(iso, F.concat_ws("-", yy, mm, dd)).when(dots, F.concat_ws(".", dd, mm, yy)) \
                .when(dayfirst, F.concat_ws("/", dd, mm, yy)).otherwise(F.concat_ws("/", mm, dd, yy))

        good = day.isNotNull() & F.year(day).between(1000, 9799)
        return F.when(good, _let(new, written))

    return _let(F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"), changed)


def _secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"([A-Za-z0-9+/_\-]+)$", 1)
    lead = F.substring(m, F.lit(1), F.length(m) - F.length(value))
    return F.concat(lead, _lettered(value, key, "secret", value.rlike("^[0-9a-f]+$")))


def _email(m: Column, key: str) -> Column:
    """The name and the first part of the host change; the rest of the host stays."""
    name, host, rest = (F.regexp_extract(m, r"^([^@]+)@([^.]+)(.+)$", i) for i in (1, 2, 3))
    return F.concat(_lettered(name, key, "email"), F.lit("@"), _lettered(host, key, "host"), rest)


_MAKERS = {
    "secret": _secret, "key": lambda m, key: F.concat(F.lit("AKIA"), _lettered(F.substring(m, 5, 16), key, "key")), "email": _email,
    "iban": _iban, "phone": _phone, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card,
}


def pseudonym(found: Column, key: str, check_cards: bool = False) -> Column:
    """The pseudonym of one found value, of which kind it is follows from the whole of it; null if it fails its kind's check."""
    makers = {**_MAKERS, "card": _checked_card} if check_cards else _MAKERS
    out = F
    for kind, pattern in PATTERNS.items():
        out = out.when(found.rlike(f"^(?:{pattern})$"), makers[kind](found, key))
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str | None = None, check_cards: bool = False) -> DataFrame:
    """``docs`` with personal values in ``text`` replaced; all other columns as they are.

    Null and empty texts stay. ``count`` names a further column for the number
    of values replaced. A number that only looks like an IBAN, date or social
    security number (it fails the check) stays as it is and is not counted.
    So does a run of 13 to 19 digits with a wrong Luhn sum with
    ``check_cards``; without, it is replaced by one that is wrong by as much.
    """
    t = F.col(f"`{text}`")
    has = t.rlike("[0-9@=:]") & t.rlike(ANY)
    found = F.when(has, F.regexp_extract_all(t, F.lit(f"({ANY})"), F.lit(1)))
    given = docs.withColumn("__found", F.transform(found, lambda b: F.struct(b.alias("old"), pseudonym(b, key, check_cards).alias("new"))))
    each = F.col("__found")
    new = F.array_join(F.zip_with(F.split(t, ANY, -1), each, lambda a, b: F.concat(a, F.coalesce(b["new"], b["old"], F.lit("")))), "")
    replaced = {text: F.when(each.isNotNull(), new).otherwise(t)}
    if count is not None:
        replaced[count] = F.coalesce(F.size(F.filter(each, lambda b: b["new"].isNotNull())), F.lit(0)).cast("long")
    return given.withColumns(replaced).drop("__found")


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, "rollspark", count="n_found", check_cards=True).select("doc_id", "text", "n_found")
