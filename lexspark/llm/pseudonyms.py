"""Format-preserving Feistel pseudonyms for personal data, with SQL functions alone.

Values are found by pattern, validated (Luhn, mod 97, calendar, octet and numbering rules) and permuted
within their own format by a keyed alternating Feistel network, so that a value becomes another valid value
of its kind and equal values get equal pseudonyms in every document, without a table of values.

A value is read as digits v[i] of mixed radix r[i]: decimal digits, letters of either case, octets of an
address, the two coordinates of a day number.  In each of ``ROUNDS`` rounds the digits at every other place
are moved by a keyed hash of round, place, kind, format and the digits at the remaining places:
v[i] := (v[i] + F) mod r[i].  A round can be undone, so the network is a permutation of the format's values
(:func:`restored` undoes it; only a date read as month, day, year may come back as day, month, year).  Places that must not move have radix 1; check digits are computed afterwards.

Cases: null text stays null and counts 0; empty text stays empty; text without values is returned as it is,
to the byte; failing validation leaves a candidate alone; repeated rows repeat; the input's other columns are
kept; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import free

ROUNDS = 8
#: For tests and demonstrations; a deployment passes its own secret.
DEFAULT_KEY = "lexspark pseudonyms"

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Candidate patterns by kind, in order of precedence.  Bounded, so that a long run of letters costs no more than its length.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:(?:password|passwd|secret|api_?key|token) ?[=:] ?\"?)[A-Za-z0-9]{8,128}(?![A-Za-z0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])|\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "iso": r"(?<![0-9A-Za-z-])[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}(?![0-9]|[-/][0-9])",
    "dmy": r"(?<![0-9A-Za-z./-])[0-9]{2}[./][0-9]{2}[./][0-9]{4}(?![0-9]|[./-][0-9])",
    "ip": rf"(?<![0-9A-Za-z.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9A-Za-z]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z])",
}
ANY = "|".join(PATTERNS.values())
KINDS = list(PATTERNS)

#: Days of a Gregorian cycle of 400 years, as the product of the two radixes of a day number.
CYCLE, COARSE, FINE = 146_097, 189, 773


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once: SQL has no other way to name an intermediate result in a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def permuted(values: Column, radixes: Column, tweak: Column, key: str, undo: bool = False) -> Column:
    """``values`` (array<int>) moved within ``radixes`` (array<int>) by the network."""
    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if undo else F.sequence(F.lit(1), F.lit(ROUNDS))

    def one(acc: Column, r: Column) -> Column:
        others = F.array_join(F.transform(acc, lambda v, i: F.when(i % 2 != r % 2, v.cast("string")).otherwise(F.lit("-"))), ",")

        def move(seed: Column) -> Column:
            def step(v: Column, i: Column) -> Column:
                digest = F.substring(F.sha2(F.concat_ws("|", seed, i.cast("string")), 256), 1, 12)
                shift = F.conv(digest, 16, 10).cast("long") % F.get(radixes, i)
                moved = (v - shift if undo else v + shift).cast("long")
                return F.when((i % 2 == r % 2) & (F.get(radixes, i) > 1), F.pmod(moved, F.get(radixes, i)).cast("int")).otherwise(v)

            return F.transform(acc, step)

        return let(F.concat_ws("|", F.lit(key), r.cast("string"), tweak, others), move)

    return F.aggregate(rounds, values, one)


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def digits_of(s: Column) -> Column:
    return F.transform(chars(F.regexp_replace(s, "[^0-9]", "")), lambda c: c.cast("int"))


def luhn_check(s: Column) -> Column:
    """Check digit for the digits of ``s`` but the last."""

    def check(d: Column) -> Column:
        doubled = F.transform(F.reverse(F.slice(d, 1, F.size(d) - 1)), lambda x, i: F.when(i % 2 == 0, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x))
        return F.aggregate(doubled, F.lit(0), lambda a, x: a + x, lambda total: (10 - total % 10) % 10).cast("string")

    return let(digits_of(s), lambda d: F.when(F.size(d) > 1, check(d)))


def mod97(s: Column) -> Column:
    """The IBAN's remainder: first four characters moved to the end, letters read as 10 to 35."""

    def rest(flat: Column) -> Column:
        turned = F.concat(F.substr(flat, F.lit(5)), F.substring(flat, 1, 4))
        return F.aggregate(chars(turned), F.lit(0), lambda a, c: F.when(c.between("0", "9"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97)

    return let(F.regexp_replace(s, " ", ""), rest)


def valid_date(s: Column, parts: str) -> Column:
    """The date that a text names, null if there is none; ``parts`` gives the order of y, m and d."""
    at = {"ymd": (1, 6, 9), "dmy": (7, 4, 1), "mdy": (7, 1, 4)}[parts]
    text = F.concat_ws("-", F.substring(s, at[0], 4), F.substring(s, at[1], 2), F.substring(s, at[2], 2))
    return F.when(F.substring(s, at[0], 4).between("0001", "9600"), F.try_to_date(text, "yyyy-MM-dd"))  # whole cycles only


def kind_of(m: Column) -> Column:
    """The kind of a candidate, null if it fails validation."""
    full = lambda kind: m.rlike(f"^(?:{PATTERNS[kind]})$")
    return (
        F.when(m.contains("@"), F.lit("email"))
        .when(full("key"), F.lit("key"))
        .when(full("secret"), F.lit("secret"))
        .when(full("iban") & (mod97(m) == 1), F.lit("iban"))
        .when(full("phone"), F.lit("phone"))
        .when(full("ssn") & ~m.rlike("^(?:000|666|9)|-00-|-0000$"), F.lit("ssn"))
        .when(full("iso") & valid_date(m, "ymd").isNotNull(), F.lit("iso"))
        .when(full("dmy") & valid_date(m, "dmy").isNotNull(), F.lit("dmy"))
        .when(full("dmy") & valid_date(m, "mdy").isNotNull(), F.lit("mdy"))
        .when(full("ip"), F.lit("ip"))
        .when(full("card") & (F.right(m, F.lit(1)) == luhn_check(m)) & ~m.rlike("^[0 -]+$"), F.lit("card"))
    )


def places(m: Column, kind: Column) -> Column:
    """For each character: (base, radix) of the range that it moves in."""
    first = (
        F.when(kind == "key", 4)
        .when(kind == "iban", 4)
        .when(kind == "secret", F.length(F.regexp_extract(m, r"^(.*[=:] ?\"?)", 1)))
        .when(kind == "phone", F.length(F.regexp_extract(m, r"^(\+[0-9]{1,3})", 1)))
        .otherwise(0)
    )
    # an address moves up to its @, a card up to its check digit
    stop = F.when(kind == "email", F.instr(m, "@") - 1).when(kind == "card", F.length(m) - 1).otherwise(F.length(m))
    pair = lambda base, radix: F.struct(F.lit(base).cast("int").alias("base"), F.lit(radix).cast("int").alias("radix"))

    def all_places(bounds: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            before = F.length(F.regexp_replace(F.substr(m, bounds["first"] + 1, i - bounds["first"]), "[^0-9]", ""))
            digit = c.between("0", "9")
            # no part of an SSN becomes all zeros, nor its area 666 or 9xx
            ssn = (
                F.when((c == "0") | ~digit | ((i < 3) & m.startswith("6")), pair(F.ascii(c), 1))
                .when((i == 0) & (c >= "7"), pair(55, 2))
                .when(i == 0, pair(49, 5))
                .otherwise(pair(49, 9))
            )
            # area and exchange of a telephone number begin with 2 to 9
            lead = (kind == "phone") & digit & before.isin(0, 3)
            return (
                F.when((i < bounds["first"]) | (i >= bounds["stop"]), pair(F.ascii(c), 1))
                .when(kind == "ssn", ssn)
                .when(lead & (c >= "2"), pair(50, 8))
                .when(lead, pair(48, 2))
                .when(digit, pair(48, 10))
                .when(c.between("a", "z"), pair(97, 26))
                .when(c.between("A", "Z"), pair(65, 26))
                .otherwise(pair(F.ascii(c), 1))
            )

        return F.transform(chars(m), one)

    return let(F.struct(F.coalesce(first, F.lit(0)).alias("first"), stop.alias("stop")), all_places)


def as_digits(m: Column, kind: Column) -> Column:
    """A value as digits of mixed radix: struct of ``v``, ``radix``, ``base`` (arrays) and of ``at``, the first day of a date's cycle."""
    whole = lambda v, radix, base, at: F.struct(v.cast("array<int>").alias("v"), radix.cast("array<int>").alias("radix"), base.cast("array<int>").alias("base"), at.cast("int").alias("at"))
    none = F.lit(None)
    date = F.when(kind == "iso", valid_date(m, "ymd")).when(kind == "dmy", valid_date(m, "dmy")).otherwise(valid_date(m, "mdy"))

    def day(n: Column) -> Column:
        within = F.pmod(n, F.lit(CYCLE))
        return whole(F.array(F.floor(within / FINE), within % FINE), F.array(F.lit(COARSE), F.lit(FINE)), none, n - within)

    # check digits take no part: they follow from the rest
    plain = F.when(kind == "card", F.concat(F.substr(m, F.lit(1), F.length(m) - 1), F.lit("0"))).when(kind == "iban", F.concat(F.substring(m, 1, 2), F.lit("00"), F.substr(m, F.lit(5)))).otherwise(m)

    def text(p: Column) -> Column:
        bases = F.transform(p, lambda x: x["base"])
        return whole(F.transform(chars(plain), lambda c, i: F.ascii(c) - F.get(bases, i)), F.transform(p, lambda x: x["radix"]), bases, none)

    return (
        F.when(kind.isin("iso", "dmy", "mdy"), let(F.datediff(date, F.lit("0001-01-01").cast("date")), day))
        .when(kind == "ip", whole(F.split(m, r"\."), F.array_repeat(F.lit(256), 4), none, none))
        .when(kind.isNotNull(), let(places(plain, kind), text))
    )


def from_digits(m: Column, kind: Column, d: Column, out: Column) -> Column:
    """The text of the value with the digits ``out``, check digits included."""
    base = F.lit("0001-01-01").cast("date")
    date = F.date_add(base, (d["at"] + F.get(out, F.lit(0)) * FINE + F.get(out, F.lit(1))).cast("int"))
    dated = F.date_format(date, "yyyy-MM-dd")
    part = lambda x, at, n: F.substring(x, at, n)
    text = F.array_join(F.transform(out, lambda v, i: F.chr((v + F.get(d["base"], i)).cast("long"))), "")

    def iban(body: Column) -> Column:
        bare = F.concat(F.substring(body, 1, 2), F.lit("00"), F.substr(body, F.lit(5)))
        return F.concat(F.substring(body, 1, 2), F.lpad((98 - mod97(bare)).cast("string"), 2, "0"), F.substr(body, F.lit(5)))

    return (
        F.when(kind.isNull(), m)
        .when(kind == "iso", let(dated, lambda x: F.concat(part(x, 1, 4), part(m, 5, 1), part(x, 6, 2), part(m, 8, 1), part(x, 9, 2))))
        .when(kind == "dmy", let(dated, lambda x: F.concat(part(x, 9, 2), part(m, 3, 1), part(x, 6, 2), part(m, 6, 1), part(x, 1, 4))))
        .when(kind == "mdy", let(dated, lambda x: F.concat(part(x, 6, 2), part(m, 3, 1), part(x, 9, 2), part(m, 6, 1), part(x, 1, 4))))
        .when(kind == "ip", F.array_join(out.cast("array<string>"), "."))
        .when(kind == "iban", let(text, iban))
        .when(kind == "card", let(text, lambda b: F.concat(F.substr(b, F.lit(1), F.length(b) - 1), luhn_check(b))))
        .otherwise(text)
    )


def pseudonymised(docs: DataFrame, key: str = DEFAULT_KEY, text_col: str = "text", found_col: str = "n_pseudonyms", undo: bool = False) -> DataFrame:
    """``docs`` with the values in ``text_col`` replaced, and in ``found_col`` how many were."""
    text = F.col(text_col)
    hit = text.rlike("[0-9@=:]|A[KS]IA") & text.rlike(ANY)
    names = [free(docs, f"__{step}_of_{text_col}") for step in ("kinds", "digits", "moved", "new")]
    kinds, digits, moved, new = map(F.col, names)
    tweak = lambda c: F.concat_ws(";", F.when(c["kind"].isin("iso", "dmy", "mdy"), F.lit("day")).otherwise(c["kind"]), c["d"]["radix"].cast("string"), c["d"]["base"].cast("string"))
    found = F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))
    kept = F.split(text, ANY, -1)
    # each step is a column of its own, so that its expression stands in the plan once
    held = docs.withColumn(names[0], F.when(hit, F.transform(found, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))))
    held = held.withColumn(names[1], F.transform(kinds, lambda c: F.struct(c["m"].alias("m"), c["kind"].alias("kind"), as_digits(c["m"], c["kind"]).alias("d"))))
    held = held.withColumn(names[2], F.transform(digits, lambda c: F.struct(c["m"].alias("m"), c["kind"].alias("kind"), c["d"].alias("d"), F.when(c["kind"].isNotNull(), permuted(c["d"]["v"], c["d"]["radix"], tweak(c), key, undo)).alias("out"))))
    held = held.withColumn(names[3], F.transform(moved, lambda c: from_digits(c["m"], c["kind"], c["d"], c["out"])))
    joined = let(kept, lambda k: F.concat(F.get(k, F.lit(0)), F.array_join(F.transform(new, lambda r, i: F.concat(r, F.get(k, i + 1))), "")))
    return (
        held.withColumn(text_col, F.when(new.isNotNull(), joined).otherwise(text))
        .withColumn(found_col, F.when(kinds.isNull(), 0).otherwise(F.size(F.filter(kinds, lambda c: c["kind"].isNotNull()))).cast("long"))
        .drop(*names)
    )


def restored(docs: DataFrame, key: str = DEFAULT_KEY, text_col: str = "text") -> DataFrame:
    """The texts before :func:`pseudonymised`, for whoever holds the key."""
    return pseudonymised(docs, key, text_col, "n_restored", undo=True)
