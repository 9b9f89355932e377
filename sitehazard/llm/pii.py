"""Personal data under format-preserving pseudonyms, in built-in expressions only.

Card numbers (Luhn), US telephone and social security numbers, IPv4 addresses, calendar dates
and mail addresses are found, validated, and replaced by another valid value of the same format.
The replacement is a keyed permutation of the format's values, a ten-round Feistel network whose
round function is SHA-256 of key, kind, round and half: equal values get equal pseudonyms in any
document, different ones stay different, and the key's holder can undo it.

A value is a pair of numbers (l, r) with l < a and r < b; rounds add to l and r in turn, modulo
a and b. The formats' sizes are exact products a * b, so no value falls outside and none has to
be walked back in: the Gregorian calendar's 400 years have 146,097 = 189 * 773 days, for one.

Whatever doesn't validate (a card number with a wrong check digit, the 31st of June) is left as
it is. Texts without a digit or an at sign are passed through unread. Where cards stand among other
digits, another run of the same digits may check after the change; to undo it there, the places
must be known.

Defined results: a null text stays null, an empty one empty, both with no finding. Repeated rows
are separate rows with equal results; tables without rows stay empty. The text column is replaced
in place and all others are kept. Values that touch letters or further digits are not taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 10
#: Possessive and bounded by what stands before, so that scanning takes linear time.
MAIL = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@"
    r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
)
#: Without brackets or a country code, area and exchange begin with 2 to 9, as all real ones do.
PHONE = "|".join(
    [r"(?:\+1 \(\d{3}\) |\(\d{3}\) ?|\+1[ -]\d{3}[ -])\d{3}-\d{4}"]
    + [rf"(?:\+?1[-. ])?[2-9]\d\d{sep}[2-9]\d\d{sep}\d{{4}}" for sep in ("-", r"\.", " ")]
)
SSN = r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}"
ADDRESS = r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
ISO_DATE = r"(?:1[89]|2[01])\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
SLASHED = r"(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01])/(?:1[89]|2[01])\d{2}"
DOTTED = r"(?:0[1-9]|[12]\d|3[01])\.(?:0[1-9]|1[0-2])\.(?:1[89]|2[01])\d{2}"
START, EDGE = r"(?<![A-Za-z0-9.+])", r"(?![A-Za-z0-9])(?!\.\d)"
NUMBERS = START + "(?:" + "|".join([PHONE, SSN, ADDRESS, ISO_DATE, SLASHED, DOTTED]) + ")" + EDGE
#: Digits, spaces and hyphens in which cards are looked for, with what the last digits touch.
RUN = START + r"\d[0-9 -]{12,}+(?:[A-Za-z@]|\.(?=\d))?"
KINDS = ("mail", "phone", "ssn", "address", "date", "card")


def _sql(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(key: str, kind: str, left: str, right: str, a: str, b: str) -> str:
    """SQL: the permuted (l, r) of two BIGINT expressions below ``a`` and ``b``."""

    def add(half: str) -> str:
        return (
            f"CAST(conv(substr(sha2(concat_ws('|', {_sql(key)}, {kind}, CAST(i AS string), "
            f"CAST({half} AS string)), 256), 1, 15), 16, 10) AS bigint)"
        )

    return (
        f"aggregate(sequence(1, {ROUNDS}), struct(CAST({left} AS bigint) AS l, "
        f"CAST({right} AS bigint) AS r), (s, i) -> CASE WHEN i % 2 = 1 "
        f"THEN struct(pmod(s.l + {add('s.r')}, {a}) AS l, s.r AS r) "
        f"ELSE struct(s.l AS l, pmod(s.r + {add('s.l')}, {b}) AS r) END)"
    )


def _bind(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _digits(m: str = "m") -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _refill(template: str, digits: str) -> str:
    """SQL: the template with its digits replaced, in order, by those of ``digits``."""
    return (
        f"array_join(transform(split({template}, ''), (c, j) -> CASE WHEN c BETWEEN '0' AND '9' "
        f"THEN substr({digits}, length(regexp_replace(substr({template}, 1, j + 1), "
        "'[^0-9]', '')), 1) ELSE c END), '')"
    )


def _luhn(digits: str, doubled: int) -> str:
    """SQL: sum of digits, every second one doubled; ``doubled`` is the parity from the right."""
    digit = f"CAST(substr({digits}, length({digits}) - k + 1, 1) AS int)"
    return (
        f"aggregate(sequence(1, length({digits})), CAST(0 AS bigint), (t, k) -> t + CASE WHEN k % 2 = {doubled} "
        f"THEN ({digit} * 2) DIV 10 + ({digit} * 2) % 10 ELSE {digit} END)"
    )


def _card(key: str) -> str:
    """Of the digits ``d``, all but the last are permuted, and the last one made to check."""
    size = "(length(d) - 1)"
    low = f"({size} DIV 2)"
    power = "CAST(rpad('1', {} + 1, '0') AS bigint)"
    new = feistel(
        key,
        "concat('card', length(d))",
        f"substr(d, 1, {low})",
        f"substr(d, {low} + 1, {size} - {low})",
        power.format(low),
        power.format(f"({size} - {low})"),
    )
    body = f"concat(lpad(CAST(p.l AS string), {low}, '0'), lpad(CAST(p.r AS string), {size} - {low}, '0'))"
    check = f"CAST(pmod(10 - {_luhn('q', 1)} % 10, 10) AS string)"
    return _bind(new, "p", _bind(body, "q", f"concat(q, {check})"))


def _cards(key: str) -> str:
    """SQL: a run ``m`` of digits with the cards in it replaced, as (text, how many changed).

    A card is one group of digits or several with the same single space or hyphen between, 13 to
    19 digits that check: the whole run, or else, from the left, the longest that is one group or
    has a group of four and then groups of four to six, the last one of up to six. The whole run
    doesn't count if it holds a value of another kind.
    """
    groups = "filter(split(m, '[^0-9]+'), x -> x <> '')"
    gaps = "regexp_extract_all(m, '[^0-9]+', 0)"
    usable = "(size(g) - CASE WHEN m rlike '[0-9][A-Za-z@.]$' THEN 1 ELSE 0 END)"
    whole = f"(k = 0 AND j = n - 1 AND NOT m rlike {_sql(NUMBERS)})"
    shape = (
        "(j >= k + 2 AND length(g[k]) = 4 AND length(g[j]) <= 6 AND "
        "forall(slice(g, k + 2, j - k - 1), x -> length(x) BETWEEN 4 AND 6))"
    )
    joined = (
        "(j = k OR (s[k] IN (' ', '-') AND size(array_distinct(slice(s, k + 1, j - k))) = 1 "
        f"AND ({whole} OR {shape})))"
    )
    digits = "array_join(slice(g, k + 1, j - k + 1), '')"
    checks = _bind(digits, "d", f"length(d) BETWEEN 13 AND 19 AND {_luhn('d', 0)} % 10 = 0")
    # A card has 19 groups at most.
    ends = f"filter(sequence(k, least(k + 18, n - 1)), j -> {joined} AND {checks})"
    end = f"coalesce(array_max({ends}), -1)"
    all_ends = f"transform(sequence(0, n - 1), k -> struct(k AS k, {end} AS j))"
    picked = (
        f"aggregate(filter({all_ends}, c -> c.j >= 0), CAST(array() AS array<struct<k: int, j: int>>), "
        "(a, c) -> CASE WHEN size(a) = 0 OR element_at(a, -1).j < c.k THEN array_append(a, c) ELSE a END)"
    )
    value = "array_join(slice(g, c.k + 1, c.j - c.k + 1), '')"
    new = _bind(value, "d", f"struct(c.k AS k, c.j AS j, d AS old, {_card(key)} AS new)")
    cards = f"transform({picked}, c -> {new})"
    at = "1 + length(array_join(slice(g, c.k + 1, i - c.k), ''))"
    group = (
        "coalesce(element_at(transform(filter(cards, c -> i BETWEEN c.k AND c.j), "
        f"c -> substr(c.new, {at}, length(x))), 1), x)"
    )
    group = group.replace("element_at(", "try_element_at(")
    text = f"array_join(zip_with(transform(g, (x, i) -> {group}), s, (x, y) -> concat(x, coalesce(y, ''))), '')"
    changed = "size(filter(cards, c -> c.old <> c.new))"
    out = (
        f"CASE WHEN size(cards) = 0 THEN struct(m AS text, 0 AS n) "
        f"ELSE struct({text} AS text, {changed} AS n) END"
    )
    inner = _bind(f"CASE WHEN n > 0 THEN {cards} ELSE array() END", "cards", out)
    return _bind(groups, "g", _bind(gaps, "s", _bind(usable, "n", inner)))


def _phone(key: str) -> str:
    """The ten digits are permuted; the country code 1 is kept.

    Numbers whose area and exchange begin with 2 to 9 stay among these, in any way of writing.
    """
    area, rest = "CAST(substr(d, 1, 3) AS bigint)", "CAST(substr(d, 4, 7) AS bigint)"
    low = f"CASE WHEN {area} >= 200 THEN 200 ELSE 0 END"
    low_rest = f"CASE WHEN {area} >= 200 AND {rest} >= 2000000 THEN 2000000 ELSE 0 END"
    a = f"CASE WHEN {area} >= 200 THEN 800 ELSE 200 END"
    b = f"CASE WHEN {area} < 200 THEN 10000000 WHEN {rest} >= 2000000 THEN 8000000 ELSE 2000000 END"
    new = feistel(key, f"concat('phone', {b})", f"{area} - {low}", f"{rest} - {low_rest}", a, b)
    number = (
        f"concat(CASE WHEN length({_digits()}) > 10 THEN '1' ELSE '' END, "
        f"lpad(CAST(p.l + {low} AS string), 3, '0'), lpad(CAST(p.r + {low_rest} AS string), 7, '0'))"
    )
    d = f"right({_digits()}, 10)"
    return _bind(d, "d", _bind(new, "p", _bind(number, "w", _refill("m", "w"))))


def _ssn(key: str) -> str:
    """898 areas (001-899 without 666) by 99 groups, and 9,999 serial numbers."""
    area = "CAST(substr(m, 1, 3) AS bigint)"
    new = feistel(
        key,
        "'ssn'",
        f"({area} - CASE WHEN {area} > 666 THEN 2 ELSE 1 END) * 99 + CAST(substr(m, 5, 2) AS bigint) - 1",
        "CAST(substr(m, 8, 4) AS bigint) - 1",
        "88902",
        "9999",
    )
    number = (
        "concat_ws('-', lpad(CAST(p.l DIV 99 + CASE WHEN p.l DIV 99 >= 665 THEN 2 ELSE 1 END "
        "AS string), 3, '0'), lpad(CAST(p.l % 99 + 1 AS string), 2, '0'), "
        "lpad(CAST(p.r + 1 AS string), 4, '0'))"
    )
    return _bind(new, "p", number)


def _address(key: str) -> str:
    part = "CAST(d[{}] AS bigint)"
    new = feistel(
        key,
        "'address'",
        f"{part.format(0)} * 256 + {part.format(1)}",
        f"{part.format(2)} * 256 + {part.format(3)}",
        "65536",
        "65536",
    )
    number = (
        "concat_ws('.', CAST(p.l DIV 256 AS string), CAST(p.l % 256 AS string), "
        "CAST(p.r DIV 256 AS string), CAST(p.r % 256 AS string))"
    )
    return _bind("split(m, '[.]')", "d", _bind(new, "p", number))


def _date(key: str, form: str) -> str:
    """Days of 1800 to 2199, one whole Gregorian cycle; both ways of writing share it."""
    day = f"datediff(CAST(try_to_timestamp(m, '{form}') AS date), DATE'1800-01-01')"
    new = feistel(key, "'date'", "d DIV 773", "d % 773", "189", "773")
    date = f"date_format(date_add(DATE'1800-01-01', CAST(p.l * 773 + p.r AS int)), '{form}')"
    return _bind(day, "d", f"CASE WHEN d IS NULL THEN m ELSE {_bind(new, 'p', date)} END")


def _mail(key: str) -> str:
    """The local part's letters and digits, each within its own class; the domain is kept.

    The two halves shift each other's characters by bytes of the round's hash, which only
    depends on the other half, so every round can be undone.
    """

    def shifted(half: str, other: str) -> str:
        # one hash per 20 characters: three hexadecimal digits a character
        block = (
            f"sha2(concat_ws('|', {_sql(key)}, 'mail', CAST(i AS string), CAST(j DIV 20 AS string), "
            f"{other}), 256)"
        )
        step = f"CAST(conv(substr({block}, (j % 20) * 3 + 1, 3), 16, 10) AS int)"
        moved = " ".join(
            f"WHEN c BETWEEN '{low}' AND '{high}' THEN chr(ascii('{low}') + "
            f"(ascii(c) - ascii('{low}') + {step}) % {size})"
            for low, high, size in (("a", "z", 26), ("A", "Z", 26), ("0", "9", 10))
        )
        return f"array_join(transform(split({half}, ''), (c, j) -> CASE {moved} ELSE c END), '')"

    local = "split(m, '@')[0]"
    new = (
        f"aggregate(sequence(1, {ROUNDS}), struct(substr(d, 1, length(d) DIV 2) AS l, "
        "substr(d, length(d) DIV 2 + 1) AS r), (s, i) -> CASE WHEN i % 2 = 1 "
        f"THEN struct({shifted('s.l', 's.r')} AS l, s.r AS r) "
        f"ELSE struct(s.l AS l, {shifted('s.r', 's.l')} AS r) END)"
    )
    return _bind(local, "d", _bind(new, "p", "concat(p.l, p.r, '@', split(m, '@')[1])"))


def _kind(m: str = "m") -> str:
    """SQL: what a found value is."""
    tests = [("mail", ".*@.*"), ("phone", PHONE), ("ssn", SSN), ("address", ADDRESS)]
    tests += [("iso", ISO_DATE), ("slashed", SLASHED)]
    cases = " ".join(f"WHEN {m} rlike {_sql('^(?:' + p + ')$')} THEN '{k}'" for k, p in tests)
    return f"CASE {cases} ELSE 'dotted' END"


def pseudonym(key: str) -> str:
    """SQL: the pseudonym of a found value ``m``, or ``m`` itself if it doesn't validate."""
    of = {
        "mail": _mail(key),
        "phone": _phone(key),
        "ssn": _ssn(key),
        "address": _address(key),
        "iso": _date(key, "yyyy-MM-dd"),
        "slashed": _date(key, "MM/dd/yyyy"),
        "dotted": _date(key, "dd.MM.yyyy"),
    }
    cases = " ".join(f"WHEN '{k}' THEN {body}" for k, body in of.items())
    return f"CASE {_kind()} {cases} END"


def with_pseudonyms(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The rows with the text rewritten, and ``n_replaced`` (long), the values that changed.

    Only a column named ``n_replaced`` is replaced; all others come back untouched.
    """
    return _rewritten(docs, key, text).select(*_source(docs, text, ("n_replaced",)), "n_replaced")


def rewrite(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The rows with the text rewritten and all other columns as they came, whatever their names."""
    return _rewritten(docs, key, text).select(*_source(docs, text))


def _source(docs: DataFrame, text: str, but: tuple[str, ...] = ()) -> list[Column]:
    return [
        F.col("new_text").alias(text) if c == text else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
        if c not in but
    ]


def _rewritten(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``row`` (the given columns but the text), ``new_text`` and ``n_replaced``."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    df = docs.select(F.struct(*rest or [F.lit(0).alias("none")]).alias("row"), F.col(f"`{text}`").alias("text"))
    text = "text"

    def found(text: str, pattern: str) -> str:
        both = f"(?:{MAIL})|(?:{pattern})"
        return (
            f"CASE WHEN contains({text}, '@') THEN regexp_extract_all({text}, {_sql(both)}, 0) "
            f"WHEN {text} rlike '[0-9]' THEN regexp_extract_all({text}, {_sql(pattern)}, 0) END"
        )

    def rewritten(text: str, pattern: str, new: str) -> str:
        both = f"(?:{MAIL})|(?:{pattern})"
        return (
            f"CASE WHEN {new} IS NULL THEN {text} ELSE array_join(zip_with("
            f"CASE WHEN contains({text}, '@') THEN split({text}, {_sql(both)}) "
            f"ELSE split({text}, {_sql(pattern)}) END, {new}, (x, y) -> concat(x, coalesce(y, ''))), '') END"
        )

    # Cards first, as the runs of digits that hold them may hold other values too. Mail addresses
    # are found with them, so that digits inside are left for the second step.
    card = f"CASE WHEN m LIKE '%@' OR NOT contains(m, '@') THEN {_cards(key)} ELSE struct(m AS text, 0 AS n) END"
    long_run = f"`{text}` rlike '[0-9][0-9 -]{{11}}[0-9]'"
    df = df.withColumn("_found", F.expr(f"CASE WHEN {long_run} THEN {found(f'`{text}`', RUN)} END"))
    df = df.withColumn("_cards", F.expr(f"CASE WHEN size(_found) > 0 THEN transform(_found, m -> {card}) END"))
    new_cards = "transform(_cards, c -> c.text)"
    df = df.withColumn("_text", F.expr(rewritten(f"`{text}`", RUN, new_cards)))
    df = df.withColumn("_found", F.expr(found("_text", NUMBERS)))
    df = df.withColumn(
        "_new",
        F.expr(f"CASE WHEN size(_found) > 0 THEN transform(_found, m -> {pseudonym(key)}) END"),
    )
    changed = (
        "CAST(coalesce(aggregate(_cards, 0, (a, c) -> a + c.n), 0) + CASE WHEN _new IS NULL THEN 0 "
        "ELSE size(filter(zip_with(_found, _new, (x, y) -> x <> y), z -> z)) END AS bigint)"
    )
    return df.select("row", F.expr(rewritten("_text", NUMBERS, "_new")).alias("new_text"), F.expr(changed).alias("n_replaced"))
