"""Format-preserving pseudonyms for personal numbers and dates, built-in functions only.

A value that proves valid is permuted within its format by a keyed Feistel network:
the same value gets the same pseudonym in every document, two values never share
one, and the result is again a valid value written the same way. Networks with
unequal moduli cover ranges that are no power, such as the days of 400 years, so
nothing is drawn twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_ISO = r"(?:1[89]|2[01])\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
#: Repeats of groups are bounded or possessive: Java's matcher takes stack for each turn of any other.
_EMAIL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,10}[A-Za-z]{2,63}"
#: Between the digits of a number; what follows may not be a date, an address or a mailbox.
_PART = rf"[ -](?!{_ISO}(?!\d)|\d{{1,2}}(?:/\d{{1,2}}/|\.\d{{1,2}}\.)\d{{4}}(?!\d)|\d{{1,3}}(?:\.\d{{1,3}}){{3}}(?!\d)|{_EMAIL})"
_GAP = rf"(?:{_PART})?"
#: What is looked at; whether it is a value is decided after. Runs of 13 digits and more
#: come before what they may hold.
PATTERNS = {
    "email": _EMAIL,
    "date": rf"{_ISO}|" r"\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}",
    "ip": r"\d{1,3}(?:\.\d{1,3}){3}",
    "card": rf"(?=(?:\d[ -]?){{12}}\d)\d++(?:{_PART}\d++(?![A-Za-z]))*+",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "phone": r"(?:\+\d{1,3}[ -]?)?\(\d{3}\)[ -]?\d{3}[ -]\d{4}|" rf"\+\d{{1,3}}(?:{_GAP}\d){{7,12}}|" r"\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}",
}
#: Digits of ``base`` that one network permutes: its halves stay within 64 bits.
BLOCK = 24
#: A time may follow a date.
ANY = rf"(?<![0-9A-Za-z])(?:{_ISO}(?=T\d)|(?:" + "|".join(PATTERNS.values()) + r")(?![0-9A-Za-z]))"
#: Four hundred years from here: 146,097 days, 189 x 773.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)
#: Turns to a day over 12: each finds one in three of five cases.
WALK = 64


def _secret(key: str | Column, label: Column, turn: Column, half: Column) -> Column:
    """60 keyed bits of a half."""
    text = F.concat_ws("|", key if isinstance(key, Column) else F.lit(key), label, turn.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, label: Column, a: Column, b: Column, a_size: Column, b_size: Column) -> Column:
    """struct(a, b): a keyed permutation of all pairs below (a_size, b_size)."""

    def turn(s: Column, r: Column) -> Column:
        left = F.struct(((s["a"] + _secret(key, label, r, s["b"])) % a_size).alias("a"), s["b"].alias("b"))
        right = F.struct(s["a"].alias("a"), ((s["b"] + _secret(key, label, r, s["a"])) % b_size).alias("b"))
        return F.when(r % 2 == 0, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def power(base: int, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(base**i) for i in range(14)]), (n + 1).cast("int"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def permute(key: str, label: Column, s: Column, base: int) -> Column:
    """A string of up to ``BLOCK`` digits of ``base`` permuted among those of its length.

    A single digit has no two halves: all are put in a keyed order, and it gets the
    digit that stands at its place.
    """
    n = F.length(s)
    m = F.floor(n / 2).cast("int")
    number = lambda x: F.coalesce(F.conv(x, base, 10).cast("long"), F.lit(0).cast("long"))
    text = lambda x, k: F.when(k > 0, F.lpad(F.lower(F.conv(x.cast("string"), 10, base)), k, F.lit("0"))).otherwise("")
    of_length = F.concat_ws("|", label, n.cast("string"))
    pair = feistel(key, of_length, number(F.substring(s, F.lit(1), m)), number(F.substring(s, m + 1, n - m)), power(base, m), power(base, n - m))
    every = F.sort_array(F.transform(F.sequence(F.lit(0), F.lit(base - 1)), lambda d: F.struct(_secret(key, of_length, F.lit(0), d).alias("order"), d.alias("digit"))))
    single = F.element_at(every, (number(s) + 1).cast("int"))["digit"]
    return F.when(n == 1, text(single, n)).when(n > 0, _let(pair, lambda p: F.concat(text(p["a"], m), text(p["b"], n - m)))).otherwise("")


def permute_all(key: str, label: Column, s: Column, base: int) -> Column:
    """A string of any number of digits, ``BLOCK`` after ``BLOCK``, each in its own way."""
    blocks = F.sequence(F.lit(0), F.floor((F.length(s) - 1) / BLOCK).cast("int"))
    each = F.transform(blocks, lambda k: permute(key, F.concat_ws("#", label, k.cast("string")), F.substring(s, k * BLOCK + 1, F.lit(BLOCK)), base))
    return F.when(F.length(s) > 0, F.array_join(each, "")).otherwise("")


def put_back(value: Column, keep: str, new: Column) -> Column:
    """``value`` with the characters of the class ``keep`` replaced by those of ``new``, in order."""
    chars = F.split(value, "")
    mine = lambda x: F.regexp_replace(x, f"[^{keep}]", "")

    def char(c: Column, i: Column) -> Column:
        return F.when(c.rlike(f"^[{keep}]$"), F.substring(new, F.length(mine(F.substring(value, F.lit(1), i + 1))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(chars, char), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum of digits whose last is the check digit."""

    def add(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), add), F.lit(0), lambda x, y: x + y)


def _card(v: Column, key: str) -> Column:
    digits = F.regexp_replace(v, r"\D", "")
    n = F.length(digits)

    def changed(d: Column) -> Column:
        # the first digit says whose card it is, the last one is made to fit
        body = F.concat(F.substring(d, 1, 1), permute(key, F.lit("card"), F.substring(d, F.lit(2), F.length(d) - 2), 10))
        return _let(body, lambda b: F.concat(b, ((10 - luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))

    return F.when(n.between(13, 19) & (luhn(digits) % 10 == 0), put_back(v, "0-9", _let(digits, changed)))


def _in_run(run: Column, key: str) -> Column:
    """struct(new, kinds): a run of 13 digits and more that is no card as a whole, with
    the values in it replaced.

    Values begin and end with a group of digits. A social security number or phone is
    told by its hyphens; of cards the longest from a group on counts. One that overlaps
    a better one that begins later (these two, or a longer card) is none.
    """
    some = lambda parts, i, n: F.regexp_replace(F.array_join(F.slice(parts, i + 1, n), ""), "^[ -]", "")
    digits = lambda parts, i, n: F.regexp_replace(F.array_join(F.slice(parts, i + 1, n), ""), "[ -]", "")

    def best(parts: Column, i: Column) -> Column:
        """struct(score, n): n groups from group i on are a value, 0 none."""
        spans = F.sequence(F.lit(1), F.least(F.lit(19), F.size(parts) - i))
        cards = F.transform(spans, lambda n: F.struct(F.length(digits(parts, i, n)).alias("score"), n.alias("n")))
        cards = F.filter(F.filter(cards, lambda c: c["score"].between(13, 19)), lambda c: luhn(digits(parts, i, c["n"])) % 10 == 0)
        none = F.struct(F.lit(0).alias("score"), F.lit(0).alias("n"))
        three = F.struct(F.lit(20).alias("score"), F.lit(3).alias("n"))
        marked = lambda t: t.rlike(rf"^(?:{PATTERNS['ssn']})$") & _ssn(t, key).isNotNull() | t.rlike(r"^\d{3}-\d{3}-\d{4}$")
        return F.when(_let(some(parts, i, F.lit(3)), marked), three).otherwise(F.coalesce(F.array_max(cards), none))

    def walk(parts: Column, scores: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            mine = F.element_at(scores, i + 1)
            later = F.slice(scores, i + 2, F.greatest(mine["n"] - 1, F.lit(0)))
            found = (mine["n"] > 0) & ~F.exists(later, lambda x: x["score"] > mine["score"])
            value = some(parts, i, mine["n"])
            kind = F.when(mine["score"] < 20, F.lit("card")).when(value.rlike(rf"^(?:{PATTERNS['ssn']})$"), F.lit("ssn")).otherwise(F.lit("phone"))
            new = F.when(kind == "card", _card(value, key)).when(kind == "ssn", _ssn(value, key)).otherwise(_phone(value, key))
            lead = F.regexp_extract(F.element_at(parts, i + 1), "^[ -]?", 0)
            taken = F.struct((i + mine["n"]).alias("next"), F.concat(s["new"], lead, new).alias("new"), F.concat(s["kinds"], F.array(kind)).alias("kinds"))
            left = F.struct((i + 1).alias("next"), F.concat(s["new"], F.element_at(parts, i + 1)).alias("new"), s["kinds"].alias("kinds"))
            return F.when(i < s["next"], s).when(found, taken).otherwise(left)

        start = F.struct(F.lit(0).alias("next"), F.lit("").alias("new"), F.array().cast("array<string>").alias("kinds"))
        return F.aggregate(F.sequence(F.lit(0), F.size(parts) - 1), start, step, lambda s: F.struct(F.when(F.size(s["kinds"]) > 0, s["new"]).alias("new"), s["kinds"].alias("kinds")))

    def resolved(parts: Column) -> Column:
        return _let(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: best(parts, i)), lambda scores: walk(parts, scores))

    return _let(F.regexp_extract_all(run, F.lit("([ -]?[0-9]+)"), F.lit(1)), resolved)


def _phone(v: Column, key: str) -> Column:
    digits = F.regexp_replace(v, r"\D", "")
    n = F.length(digits)
    area = F.substring(digits, F.lit(1), n - 7)
    return F.when(n.between(10, 15), put_back(v, "0-9", F.concat(area, permute(key, F.concat(F.lit("phone"), area), F.substring(digits, n - 6, F.lit(7)), 10))))


def _ssn(v: Column, key: str) -> Column:
    area, group, serial = (F.substring(v, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    pair = feistel(key, F.lit("ssn"), area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))
    parts = _let(pair, lambda p: F.concat_ws("-", F.lpad((p["a"] + F.when(p["a"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.floor(p["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((p["b"] % 9999 + 1).cast("string"), 4, "0")))
    return F.when(valid, parts)


def _ip(v: Column, key: str) -> Column:
    octets = F.transform(F.split(v, r"\."), lambda x: x.cast("int"))
    at = lambda i: F.element_at(octets, i)
    pair = feistel(key, F.lit("ip"), at(1) * 256 + at(2), at(3) * 256 + at(4), F.lit(65536), F.lit(65536))
    name = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
    return F.when(~F.exists(octets, lambda x: x > 255), _let(pair, lambda p: F.concat_ws(".", name(p["a"]), name(p["b"]))))


def _date(v: Column, key: str) -> Column:
    iso, slash = v.rlike("^\\d{4}-"), v.contains("/")
    form = F.when(iso, F.lit("yyyy-MM-dd")).when(slash, F.lit("M/d/yyyy")).otherwise(F.lit("d.M.yyyy"))
    month_first = F.to_date(F.try_to_timestamp(v, form))
    # a day over 12 in front says that the day is first; its pseudonym has one too
    day_first = slash & month_first.isNull()
    day = F.coalesce(month_first, F.when(slash, F.to_date(F.try_to_timestamp(v, F.lit("d/M/yyyy")))))
    number = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    dated = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))

    def moved(n: Column) -> Column:
        return _let(feistel(key, F.lit("date"), F.floor(n / DAYS[1]), n % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1])), lambda p: p["a"] * DAYS[1] + p["b"])

    def walked(n: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), moved(n), lambda s, _: F.when(F.dayofmonth(dated(s)) > 12, s).otherwise(moved(s)))

    padded = F.regexp_replace(v, r"\d{4}", "").rlike(r"^\d{2}.\d{2}.$")
    new = dated(F.when(day_first, walked(number)).otherwise(moved(number)))
    written = lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).when(day_first & padded, F.date_format(d, "dd/MM/yyyy")).when(day_first, F.date_format(d, "d/M/yyyy")).when(slash & padded, F.date_format(d, "MM/dd/yyyy")).when(slash, F.date_format(d, "M/d/yyyy")).when(padded, F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "d.M.yyyy"))
    return F.when(number.between(0, DAYS[0] * DAYS[1] - 1), _let(new, written))


def _email(v: Column, key: str) -> Column:
    local, host = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    letters = F.lower(F.regexp_replace(local, "[^A-Za-z]", ""))
    digits = F.regexp_replace(local, r"\D", "")
    low, base26 = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"
    label = F.concat(F.lit("email"), F.lower(host))
    new = F.translate(permute_all(key, F.concat(label, digits), F.translate(letters, low, base26), 26), base26, low)
    first = put_back(local, "A-Za-z", new)
    return F.concat(put_back(first, "0-9", permute_all(key, F.concat(label, F.lit("#")), digits, 10)), F.lit("@"), host)


_MAKERS = {"email": _email, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(value: Column, key: str) -> Column:
    """struct(new, kinds) for a match of ``ANY``: new is null where no value is valid,
    kinds has the kind of each valid one."""
    kind = reduce(lambda c, k: c.when(value.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)), list(PATTERNS)[1:], F.when(value.rlike(f"^(?:{PATTERNS['email']})$"), F.lit("email")))
    made = _let(kind, lambda k: F.struct(k.alias("kind"), reduce(lambda c, n: c.when(k == n, _MAKERS[n](value, key)), list(_MAKERS)[1:], F.when(k == "email", _email(value, key))).alias("new")))
    none = F.array().cast("array<string>")
    single = lambda m: F.struct(m["new"].alias("new"), F.when(m["new"].isNotNull(), F.array(m["kind"])).otherwise(none).alias("kinds"))
    # a run is looked into where it is no value as a whole, be it of 13 digits or more or of fewer before a date
    return _let(made, lambda m: F.when(m["new"].isNull() & value.rlike(r"^\d+(?:[ -]\d+)*+$"), _in_run(value, key)).otherwise(single(m)))


def pseudonymise(docs: DataFrame, key: str | Column, text_col: str = "text") -> DataFrame:
    """``docs`` with valid values replaced in ``text_col``, ``n_values`` (how many)
    and ``kinds`` (which, sorted).

    Values, and what of them stays:

    - cards: 13 to 19 digits with a Luhn check digit and single spaces or hyphens, also
      among other groups of digits; the first digit stays, the last is made to fit
    - phones: 555-123-4567, 555.123.4567, (555) 123-4567, each also after +1, and +44 20 7946 0958,
      of 10 to 15 digits; all but the last seven stay. Ten digits without any mark are none
    - US social security numbers in valid ranges, 123-45-6789
    - IPv4 addresses
    - dates of 1800 to 2199 that exist: 2024-02-29 (a time may follow after T), 29.2.2024, and
      2/29/2024, where the day is first if that is no date
    - mailboxes; the host stays (ten labels at most), all letters and digits before it change

    Separators stay. What is not valid stays, and a text without a value is returned as it
    is; a null text stays null with 0 values. A single letter or digit is drawn from a keyed
    order of all, two and more go through eight rounds. Nothing is shuffled; rows and
    other columns stay as they are, but columns named n_values and kinds give way.
    ``key`` as text stands in the query's plan; a column (of a table of one row that was
    joined, say) keeps it out.
    """
    columns = [c for c in docs.columns if c not in ("n_values", "kinds")]
    temporary = "_made"
    while temporary in docs.columns:
        temporary += "_"
    found = F.when(F.col(text_col).rlike("[0-9@]"), F.regexp_extract_all(text_col, F.lit(f"({ANY})"), F.lit(1)))
    made = docs.withColumn(temporary, found)
    made = made.withColumn(temporary, F.when(F.size(temporary) > 0, F.transform(temporary, lambda v: F.struct(v.alias("old"), pseudonym(v, key).alias("p")))))
    new = F.transform(temporary, lambda x: F.coalesce(x["p"]["new"], x["old"]))
    rebuilt = F.array_join(F.zip_with(F.split(text_col, ANY, -1), F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    kinds = F.flatten(F.transform(temporary, lambda x: x["p"]["kinds"]))
    n = F.coalesce(F.when(F.size(temporary) > 0, F.size(kinds)), F.lit(0))
    text = F.when(n > 0, rebuilt).otherwise(F.col(text_col)).alias(text_col)
    return made.select(*[text if c == text_col else F.col(c) for c in columns], n.alias("n_values"), F.coalesce(F.sort_array(F.array_distinct(kinds)), F.array().cast("array<string>")).alias("kinds"))
