"""Format-preserving pseudonyms for personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import fresh

#: Rounds of the Feistel networks, and most steps of a card beside other digits; one in ten needs another step.
ROUNDS, CARD_STEPS = 10, 16

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: What is looked for, in this order at each place. Validation follows in ``pseudonym``.
PATTERNS = {
    "email": r"(?<![\w.%+-])[\w.%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|(?<=token = \")[0-9a-f]{16,64}(?=\")|(?<=password=)[0-9a-f]{8,64}\b",
    "phone": r"(?<![\w+])(?:\+1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?!\w)",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d)",
    "date": r"(?<![\w.-])(?:(?:18|19|20|21)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[./](?:0[1-9]|1[0-2])[./](?:18|19|20|21)\d{2})(?![\w-])",
    "ssn": r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?!\w)",
}
#: Usual groups of a card number within a longer run of digits, and what stands before and after; a run of 19 digits has room for one.
_CARD_INSIDE = r"^(.*?)(?<!\d)(" + "|".join([r"\d{13,18}", *(s.join(rf"\d{{{n}}}" for n in g) for g in ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4)) for s in " -")]) + r")(?!\d)(.*)$"
_NUMBERS = "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k not in ("email", "secret"))
#: All of them. One look at the next character spares most places the longer alternatives.
PATTERN = rf"(?:{PATTERNS['email']})|(?=[A0-9a-f])(?:{PATTERNS['secret']})|(?=[0-9(+])(?:{_NUMBERS})"


def _digest(key: str, kind: str, i: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other), 256)


def _pair(x: Column, y: Column, a: int, b: int, key: str, kind: str, inverse: bool) -> Column:
    """Feistel network on Z_a x Z_b: either half is shifted by a keyed function of the other, in turn."""

    def step(acc: Column, i: Column) -> Column:
        def f(other: Column, mod: int) -> Column:
            n = F.pmod(F.conv(F.substring(_digest(key, kind, i, other.cast("string")), 1, 15), 16, 10).cast("long"), F.lit(mod))
            return -n if inverse else n

        return F.when(i % 2 == 0, F.struct(F.pmod(acc["x"] + f(acc["y"], a), F.lit(a)).alias("x"), acc["y"].alias("y"))).otherwise(
            F.struct(acc["x"].alias("x"), F.pmod(acc["y"] + f(acc["x"], b), F.lit(b)).alias("y"))
        )

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), step)


def _string(s: Column, key: str, kind: str, inverse: bool, first: Column | None = None, letters: int = 26) -> Column:
    """Feistel network on the characters of a string: halves in turn, each character within its class.

    Digits stay digits, small and capital letters stay such, all else stays as it is. ``first`` says for a
    position whether its digit is 2 to 9 only. ``letters=6`` keeps hexadecimal text hexadecimal.
    """
    chars = F.split(s, "")

    def cell(c: Column, j: Column) -> Column:
        code = F.ascii(c)
        lead = first(j) if first is not None else F.lit(False)
        base = F.when(lead, 50).when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).when(c.rlike("[A-Z]"), 65).otherwise(code)
        mod = F.when(lead, 8).when(c.rlike("[0-9]"), 10).when(c.rlike("[a-zA-Z]"), letters).otherwise(1)
        return F.struct((code - base).alias("v"), base.alias("base"), mod.alias("mod"), c.alias("c"))

    cells = F.transform(F.filter(chars, lambda c: c != ""), cell)

    def step(acc: Column, i: Column) -> Column:
        half = F.floor(F.size(acc) / 2)
        mine = lambda j: (j < half) == (i % 2 == 0)
        kept = F.array_join(F.transform(F.filter(acc, lambda c, j: ~mine(j)), lambda c: c["v"].cast("string")), ",")

        def shifted(digest: Column) -> Column:  # one digest per round; 32 shifts, then again from the first
            def shift(c: Column, j: Column) -> Column:
                n = F.conv(F.substr(digest, 2 * F.pmod(j, F.lit(32)) + 1, F.lit(2)), 16, 10).cast("int")
                v = F.pmod(c["v"] + (-n if inverse else n), c["mod"])
                return F.struct(F.when(mine(j), v).otherwise(c["v"]).alias("v"), c["base"].alias("base"), c["mod"].alias("mod"), c["c"].alias("c"))

            return F.transform(acc, shift)

        return F.transform(F.array(_digest(key, kind, i, kept)), shifted)[0]

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    done = F.aggregate(rounds, cells, step)
    return F.array_join(F.transform(done, lambda c: F.when(c["mod"] == 1, c["c"]).otherwise(F.chr(c["base"] + c["v"]))), "")


def _luhn_sum(digits: Column, parity: Column) -> Column:
    """Sum of the Luhn rule; digits whose distance from the right end has ``parity`` count twice."""
    n = F.length(digits)

    def part(c: Column, j: Column) -> Column:
        d = c.cast("int")
        twice = F.pmod(n - 1 - j, F.lit(2)) == parity
        return F.when(twice & (d > 4), 2 * d - 9).when(twice, 2 * d).otherwise(d)

    return F.aggregate(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), part), F.lit(0), lambda a, x: a + x)


def _refill(shape: Column, digits: Column) -> Column:
    """The digits, in order, in the places of the digits of ``shape``."""
    seen = lambda j: F.length(F.regexp_replace(F.substr(shape, F.lit(1), j + 1), "[^0-9]", ""))
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c, j: F.when(c.rlike("[0-9]"), F.substr(digits, seen(j), F.lit(1))).otherwise(c)), "")


def pseudonym(m: Column, key: str, inverse: bool = False) -> Column:
    """Replacement of one found value; a value that fails its validation comes back unchanged.

    Equal values (digits equal, whatever the separators) get equal pseudonyms for one key; each kind
    is a permutation of its valid values, so nothing collides, and ``inverse`` undoes it.
    """
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    num = lambda c, a, k: F.substr(c, F.lit(a), F.lit(k)).cast("long")

    # Cards: first digit stays, the middle is permuted, the check digit is made anew.
    def shown(c: Column) -> Column:
        d = F.regexp_replace(c, "[^0-9]", "")
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), _string(F.substr(d, F.lit(2), F.length(d) - 2), key, "card", inverse))
        return _refill(c, F.concat(body, F.pmod(-_luhn_sum(body, F.lit(0)), F.lit(10)).cast("string")))

    valid = lambda c: _luhn_sum(F.regexp_replace(c, "[^0-9]", ""), F.lit(1)) % 10 == 0
    # A card beside an expiry date, a security code or another short number. Should the whole run become a valid card, the card
    # is permuted again: so the inverse finds the same card in it, and comes back by as many steps.
    head, inside, tail = (F.regexp_extract(m, _CARD_INSIDE, i) for i in (1, 2, 3))
    again = lambda c, _: F.when(valid(F.concat(head, c, tail)), shown(c)).otherwise(c)
    beside = F.concat(head, F.aggregate(F.sequence(F.lit(1), F.lit(CARD_STEPS)), shown(inside), again), tail)
    card = F.when(valid(m), shown(m)).when((inside != "") & valid(inside), beside).otherwise(m)

    # Phones: area and exchange start with 2 to 9; a country code stays.
    local = _string(F.right(digits, F.lit(10)), key, "phone", inverse, first=lambda j: (j == 0) | (j == 3))
    phone = _refill(m, F.concat(F.substr(digits, F.lit(1), n - 10), local))

    octets = F.split(m, r"\.")
    ip2 = _pair(octets[0].cast("long") * 256 + octets[1].cast("long"), octets[2].cast("long") * 256 + octets[3].cast("long"), 65536, 65536, key, "ip", inverse)
    ip = F.transform(F.array(ip2), lambda p: F.concat_ws(".", F.floor(p["x"] / 256).cast("string"), (p["x"] % 256).cast("string"), F.floor(p["y"] / 256).cast("string"), (p["y"] % 256).cast("string")))[0]

    # Dates: 400 Gregorian years from 1800 have 146,097 = 189 * 773 days.
    iso = F.substr(m, F.lit(5), F.lit(1)) == "-"
    day = F.when(iso, F.try_to_date(m, "yyyy-MM-dd")).otherwise(F.try_to_date(F.regexp_replace(m, "/", "."), "dd.MM.yyyy"))
    at = F.date_diff(day, F.lit("1800-01-01").cast("date")).cast("long")
    day2 = _pair(F.floor(at / 773), at % 773, 189, 773, key, "date", inverse)
    new = F.transform(F.array(day2), lambda p: F.date_add(F.lit("1800-01-01").cast("date"), (p["x"] * 773 + p["y"]).cast("int")))[0]
    date = F.when(day.isNull(), m).when(iso, F.date_format(new, "yyyy-MM-dd")).when(F.substr(m, F.lit(3), F.lit(1)) == "/", F.date_format(new, "dd/MM/yyyy")).otherwise(F.date_format(new, "dd.MM.yyyy"))

    area = num(digits, 1, 3)
    ssn2 = _pair(area - 1 - F.when(area > 666, 1).otherwise(0), (num(digits, 4, 2) - 1) * 9999 + num(digits, 6, 4) - 1, 898, 989901, key, "ssn", inverse)

    def show_ssn(p: Column) -> Column:
        a = p["x"] + 1 + F.when(p["x"] + 1 >= 666, 1).otherwise(0)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.floor(p["y"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((p["y"] % 9999 + 1).cast("string"), 4, "0"))

    ssn = F.transform(F.array(ssn2), show_ssn)[0]
    user = F.substring_index(m, "@", 1)
    email = F.concat(_string(user, key, "email", inverse), F.lit("@"), F.substring_index(m, "@", -1))
    secret = F.when(m.startswith("AKIA"), F.concat(F.lit("AKIA"), _string(F.substr(m, F.lit(5)), key, "key", inverse))).otherwise(_string(m, key, "secret", inverse, letters=6))
    whole = {k: f"^(?:{p})$" for k, p in SHAPES.items()}
    return (
        F.when(m.contains("@"), email)
        .when(m.rlike(whole["ip"]), ip)
        .when(m.rlike(whole["date"]), date)
        .when(m.rlike(whole["ssn"]), ssn)
        .when(m.rlike(whole["phone"]), phone)
        .when(m.rlike(whole["card"]), card)
        .otherwise(secret)
    )


#: Shapes by which a found value is told apart again, without its surroundings.
SHAPES = {
    "ip": r"\d{1,3}(?:\.\d{1,3}){3}",
    "date": r"\d{4}-\d\d-\d\d|\d\d[./]\d\d[./]\d{4}",
    "ssn": r"\d{3}-\d\d-\d{4}",
    "phone": r"(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}",
    "card": r"\d(?:[ -]?\d){12,18}",
}


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", inverse: bool = False) -> DataFrame:
    """Replace personal data in place by keyed pseudonyms of the same format; all columns stay.

    Email users, card numbers that pass the Luhn rule (if a run of up to 19 digits does not as a whole, also 13 to 18 digits in one
    piece or in groups of 4-4-4-4, 4-6-5 or 4-6-4 within it; not yet found are cards in longer runs of which the first 19 digits hold no whole card), phone and social security numbers, IPv4 addresses
    and calendar dates of 1800-2199, keys and passwords. Each is permuted by a Feistel network within its
    valid values, so one value has one pseudonym in all documents. Other numbers stay as they are.
    Adds ``n_replaced`` (with underscores if that name is taken). Null text stays null with 0
    replaced; texts without personal data, empty ones included, stay as they are; repeated rows get
    equal results; an empty table gives an empty result. DataFrame functions only, no shuffle.
    """
    count, hits, made = fresh(docs.columns, "n_replaced", "x_found", "x_made")
    text, found, new = F.col(f"`{text_col}`"), F.col(hits), F.col(made)
    # Texts are searched once; only those with personal data are split as well.
    searched = docs.withColumn(hits, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    searched = searched.withColumn(made, F.transform(found, lambda m: pseudonym(m, key, inverse)))
    parts = F.zip_with(F.split(text, PATTERN, -1), new, lambda p, r: F.concat(p, F.coalesce(r, F.lit(""))))
    hit = F.size(found) > 0
    changed = F.when(hit, F.array_join(parts, "")).otherwise(text)
    # Values that failed their validation came back as they were.
    amount = F.when(hit, F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))).otherwise(0)
    columns = [changed.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return searched.select(*columns, amount.cast("int").alias(count))
