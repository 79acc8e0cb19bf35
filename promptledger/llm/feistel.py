"""Format-preserving pseudonyms for personal data and secrets, in DataFrame operations only.

Values are found by one pattern and validated by kind: card numbers by their
check digit, account numbers (IBAN) by their remainder, social security
numbers, addresses and dates by their ranges.  Card and account numbers may have
other groups of digits or capitals next to them: every run of whole groups is
tried from every group on, and only the valid ones enter the pattern of their
text, the longest of a place first; a card number in usual groups goes before
one in unusual groups that would reach into it.  A valid value is replaced by its
image under a keyed permutation of all values of its format, built as a
Feistel network: two halves in turn are shifted by a keyed digest of the other
half, each character within its own class.  The permutation depends on key,
kind and format only, so equal values have equal pseudonyms in every document,
different values have different ones, and who holds the key can invert it.

=========  =======================================================================
card       first digit kept, the rest permuted, check digit made right
iban       country kept, the account permuted by class, check digits made right
ssn        permuted among all valid numbers
phone      country code and the first digits of area and exchange kept
ip         four numbers of 0-255 permuted
date       permuted among the days of 1900 to 2099, written in the same style
email      letters and digits before the last dot permuted by class
secret     letters and digits of a password, token or key permuted by class
=========  =======================================================================

Defined cases: a null text stays null, an empty one empty; invalid values stay
as they are and are not counted; rows are independent, so ids, repeated rows
and an empty table need no rule; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clear_of, free_name

ROUNDS = 8
DEFAULT_KEY = "change this key"

_DIGITS, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"

# Each kind with the pattern of its candidates; the first that matches counts.
PATTERNS: dict[str, str] = {
    "secret": r'(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*"?[A-Za-z0-9_\-]{8,}"?)|\bAKIA[A-Z0-9]{16}\b',
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "date": r"(?<![\w./\-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\w/\-])",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "phone": r"(?<![\w])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?![\w])",
    "card": r"(?<![\w\-])\d(?:[ \-]?\d){12,18}(?![\w\-])",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
}
# Where a card or account number may start and the longest run from there.
RUNS: dict[str, str] = {
    "iban": r"\b(?=([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?))",
    "card": r"(?:(?<![\w\-])|(?<=\d-))(?=(\d(?:[ \-]?\d){12,18}))",
}
# What stands before and after one.
EDGES: dict[str, tuple[str, str]] = {"iban": (r"\b", r"\b"), "card": (r"(?:(?<![\w\-])|(?<=\d-))", r"(?:(?![\w\-])|(?=-\d))")}
USUAL_CARD = r"^(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?|\d{4}([ \-])\d{6}\2\d{4,5})$"
SHORTEST = 12  # characters of any of them
NEVER = r"(?!)"

FIRST_DAY, DAYS_LEFT, DAYS_RIGHT = "1900-01-01", 229, 319  # 229 * 319 days end with 2099-12-31


def _number(digest_of: Column) -> Column:
    """Fifty-two bits of a keyed digest."""
    return F.conv(F.substring(F.sha2(digest_of, 256), 1, 13), 16, 10).cast("long")


class Network:
    """The Feistel network of one key and kind."""

    def __init__(self, key: str, kind: str) -> None:
        self.name = f"{key}|{kind}"

    def _digest(self, turn: int, *parts: Column) -> Column:
        return _number(F.concat_ws("|", F.lit(f"{self.name}|{turn}"), *(p.cast("string") for p in parts)))

    def text(self, value: Column, classes: tuple[str, ...]) -> Column:
        """Permute the characters of ``classes``, each within its class; others stay in place."""
        chars = F.split(value, "")
        half = F.floor(F.size(chars) / 2).cast("int")
        start = F.struct(F.slice(chars, 1, half).alias("l"), F.slice(chars, half + 1, F.size(chars) - half).alias("r"))

        def turned(part: Column, other: Column, turn: Column) -> Column:
            seen = F.array_join(other, "")

            def shift(c: Column, i: Column) -> Column:
                by = _number(F.concat_ws("|", F.lit(self.name), turn.cast("string"), i.cast("string"), seen))
                out = c
                for letters in classes:
                    at = F.instr(F.lit(letters), c)
                    moved = F.substring(F.lit(letters), ((at - 1 + by) % len(letters) + 1).cast("int"), F.lit(1))
                    out = F.when(F.contains(F.lit(letters), c) & (c != ""), moved).otherwise(out)
                return out

            return F.transform(part, shift)

        def turn(state: Column, k: Column) -> Column:
            # Even turns move the left half by the right one, odd turns the other way.
            left = F.when(k % 2 == 0, turned(state["l"], state["r"], k)).otherwise(state["l"])
            right = F.when(k % 2 == 1, turned(state["r"], state["l"], k)).otherwise(state["r"])
            return F.struct(left.alias("l"), right.alias("r"))

        return F.aggregate(
            F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.array_join(F.concat(s["l"], s["r"]), "")
        )

    def pair(self, left: Column, right: Column, n_left: int, n_right: int) -> tuple[Column, Column]:
        """Permute the pairs of Z(n_left) x Z(n_right)."""
        def turn(state: Column, k: Column) -> Column:
            by = _number(F.concat_ws("|", F.lit(self.name), k.cast("string"), F.when(k % 2 == 0, state["r"]).otherwise(state["l"]).cast("string")))
            return F.struct(
                F.when(k % 2 == 0, (state["l"] + by) % n_left).otherwise(state["l"]).alias("l"),
                F.when(k % 2 == 1, (state["r"] + by) % n_right).otherwise(state["r"]).alias("r"),
            )

        start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
        done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
        return done["l"], done["r"]


def _only(value: Column, letters: str) -> Column:
    return F.regexp_replace(value, f"[^{letters}]", "")


def _put_back(value: Column, taken: str, new: Column) -> Column:
    """``value`` with the characters of class ``taken`` replaced, in order, by those of ``new``."""
    chars = F.split(value, "")
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def put(s: Column, c: Column) -> Column:
        hit = c.rlike(f"^[{taken}]$")
        n = s["n"] + F.when(hit, 1).otherwise(0)
        return F.struct(n.alias("n"), F.concat(s["out"], F.array(F.when(hit, F.substring(new, n, F.lit(1))).otherwise(c))).alias("out"))

    return F.aggregate(chars, start, put, lambda s: F.array_join(s["out"], ""))


def luhn_sum(digits: Column) -> Column:
    """Of a whole number, the check digit included."""
    def doubled(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).otherwise(F.when(n > 4, 2 * n - 9).otherwise(2 * n))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), doubled), F.lit(0), lambda a, x: a + x)


def _iban_rest(account: Column, country: Column, check: Column) -> Column:
    """The remainder by 97 of an account number, letters counting from 10."""
    def step(a: Column, c: Column) -> Column:
        n = F.instr(F.lit(_DIGITS + _UPPER), c) - 1
        return F.when(n > 9, (a * 100 + n) % 97).otherwise((a * 10 + n) % 97).cast("int")

    return F.aggregate(F.split(F.concat(account, country, check), ""), F.lit(0), step)


def _date_of(value: Column) -> Column:
    day, month, year = (F.regexp_extract(value, r"^(\d{2})[./](\d{2})[./](\d{4})$", k) for k in (1, 2, 3))
    iso = F.when(value.rlike(r"^\d{4}-"), value).otherwise(F.concat_ws("-", year, month, day))
    return F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")


def _numbers(value: Column) -> list[Column]:
    return [F.get(F.split(value, r"\."), k).cast("int") for k in range(4)]


def is_valid(kind: str, value: Column) -> Column:
    if kind == "card":
        return luhn_sum(_only(value, _DIGITS)) % 10 == 0
    if kind == "iban":
        bare = F.replace(value, F.lit(" "), F.lit(""))
        return _iban_rest(F.substr(bare, F.lit(5)), F.substring(bare, 1, 2), F.substring(bare, 3, 2)) == 1
    if kind == "ssn":
        return ~value.rlike(r"^(?:000|666|9\d\d)|-00-|-0000$")
    if kind == "ip":
        return reduce(lambda a, b: a & b, (n <= 255 for n in _numbers(value)))
    if kind == "date":
        d = _date_of(value)
        return F.coalesce(d.between(F.lit(FIRST_DAY).cast("date"), F.lit("2099-12-31").cast("date")), F.lit(False))
    return F.lit(True)


def _card(value: Column, key: str) -> Column:
    digits = _only(value, _DIGITS)
    body = F.substr(digits, F.lit(2), F.length(digits) - 2)
    open_ = F.concat(F.substring(digits, 1, 1), Network(key, "card").text(body, (_DIGITS,)))
    check = (10 - luhn_sum(F.concat(open_, F.lit("0"))) % 10) % 10
    return _put_back(value, "0-9", F.concat(open_, check.cast("string")))


def _iban(value: Column, key: str) -> Column:
    bare = F.replace(value, F.lit(" "), F.lit(""))
    country = F.substring(bare, 1, 2)
    account = Network(key, "iban").text(F.substr(bare, F.lit(5)), (_DIGITS, _UPPER))
    check = F.lpad((98 - _iban_rest(account, country, F.lit("00"))).cast("string"), 2, "0")
    return _put_back(value, "A-Z0-9", F.concat(country, check, account))


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.get(F.split(value, "-"), k).cast("long") for k in range(3))
    # 898 areas without 000, 666 and from 900 on.
    left, right = Network(key, "ssn").pair(
        F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999
    )
    area = F.when(left + 1 >= 666, left + 2).otherwise(left + 1)
    return F.format_string("%03d-%02d-%04d", area, F.floor(right / 9999) + 1, right % 9999 + 1)


def _phone(value: Column, key: str) -> Column:
    lead = F.regexp_extract(value, r"^(\+\d{1,3}[ .\-]?)?", 0)
    rest = F.substr(value, F.length(lead) + 1)
    digits = _only(rest, _DIGITS)
    moved = Network(key, "phone").text(F.concat(F.substring(digits, 2, 2), F.substring(digits, 5, 6)), (_DIGITS,))
    new = F.concat(F.substring(digits, 1, 1), F.substring(moved, 1, 2), F.substring(digits, 4, 1), F.substring(moved, 3, 6))
    return F.concat(lead, _put_back(rest, "0-9", new))


def _ip(value: Column, key: str) -> Column:
    a, b, c, d = (n.cast("long") for n in _numbers(value))
    left, right = Network(key, "ip").pair(a * 256 + b, c * 256 + d, 65536, 65536)
    return F.concat_ws(".", *(n.cast("string") for n in (F.shiftright(left, 8), left % 256, F.shiftright(right, 8), right % 256)))


def _date(value: Column, key: str) -> Column:
    n = F.date_diff(_date_of(value), F.lit(FIRST_DAY).cast("date")).cast("long")
    left, right = Network(key, "date").pair(F.floor(n / DAYS_RIGHT), n % DAYS_RIGHT, DAYS_LEFT, DAYS_RIGHT)
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (left * DAYS_RIGHT + right).cast("int"))
    mark = F.substring(value, 3, 1)
    other = F.concat(F.date_format(day, "dd"), mark, F.date_format(day, "MM"), mark, F.date_format(day, "yyyy"))
    return F.when(value.rlike(r"^\d{4}-"), F.date_format(day, "yyyy-MM-dd")).otherwise(other)


def _email(value: Column, key: str) -> Column:
    local, domain, top = (F.regexp_extract(value, r"^([^@]+)@(.*)(\.[^.]+)$", k) for k in (1, 2, 3))
    classes = (_DIGITS, _LOWER, _UPPER)
    # Apart, so that addresses of one domain stay linked.
    return F.concat(Network(key, "local").text(local, classes), F.lit("@"), Network(key, "domain").text(domain, classes), top)


def _secret(value: Column, key: str) -> Column:
    bare = F.regexp_extract(value, r'([A-Za-z0-9_\-]{8,})"?$', 1)
    start = F.length(value) - F.length(bare) - F.when(value.endswith('"'), 1).otherwise(0)
    network = Network(key, "secret")
    new = F.when(bare.rlike("^[0-9a-f]+$"), network.text(bare, (_HEX,)))
    new = new.when(bare.rlike("^AKIA"), F.concat(F.lit("AKIA"), network.text(F.substr(bare, F.lit(5)), (_DIGITS, _UPPER))))
    new = new.otherwise(network.text(bare, (_DIGITS, _LOWER, _UPPER)))
    return F.concat(F.substr(value, F.lit(1), start), new, F.substr(value, start + F.length(bare) + 1))


PSEUDONYMS: dict[str, Callable[[Column, str], Column]] = {
    "secret": _secret, "email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card, "ip": _ip,
}


def kind_of(value: Column) -> Column:
    """The first kind whose pattern the whole value matches and which it is valid for; else null."""
    out: Column | None = None
    for kind, pattern in PATTERNS.items():
        held = value.rlike(f"^(?:{pattern})$")
        ok = F.when(held, is_valid(kind, value)).otherwise(False)
        out = F.when(ok, F.lit(kind)) if out is None else out.when(ok, F.lit(kind))
    return out


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    out: Column | None = None
    for k, permuted in PSEUDONYMS.items():
        out = F.when(kind == k, permuted(value, key)) if out is None else out.when(kind == k, permuted(value, key))
    return out.otherwise(value)


def _valid_runs(kind: str, text: Column) -> Column:
    """The different valid values of ``kind`` in ``text``, from every place on, the longest first."""
    longest = F.array_distinct(F.regexp_extract_all(text, F.lit(RUNS[kind]), F.lit(1)))

    def heads(run: Column) -> Column:
        ends = F.filter(
            F.sequence(F.lit(SHORTEST), F.length(run)), lambda n: ~F.substr(run, n, F.lit(2)).rlike("^(?:[A-Z0-9]{2}|[ \\-])")
        )
        return F.transform(ends, lambda n: F.substr(run, F.lit(1), n))

    whole = F.filter(F.array_distinct(F.flatten(F.transform(longest, heads))), lambda v: v.rlike(f"^(?:{PATTERNS[kind]})$"))
    sized = F.transform(F.filter(whole, lambda v: is_valid(kind, v)), lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))
    return F.transform(F.array_sort(sized), lambda x: x["v"])


def _pattern(ibans: Column, cards: Column) -> Column:
    """The pattern of all candidates, with these account and card numbers in it; they need no escapes."""

    def one_of(kind: str, values: Column) -> Column:
        before, after = EDGES[kind]
        return F.when(F.size(values) > 0, F.concat(F.lit(before + "(?:"), F.array_join(values, "|"), F.lit(")" + after))).otherwise(NEVER)

    usual = F.filter(cards, lambda v: v.rlike(USUAL_CARD))

    def clear_of_usual(v: Column) -> Column:
        ahead = F.concat(F.lit("(?!.{1,"), (F.length(v) - 1).cast("string"), F.lit("}"), one_of("card", usual), F.lit(")"), v)
        return F.when(v.rlike(USUAL_CARD) | (F.size(usual) == 0), v).otherwise(ahead)

    held = {"iban": one_of("iban", ibans), "card": one_of("card", F.transform(cards, clear_of_usual))}
    parts = [F.concat(F.lit("(?:"), held.get(k, F.lit(p)), F.lit(")")) for k, p in PATTERNS.items()]
    return F.concat_ws("|", *parts)


def pseudonymise(docs: DataFrame, key: str = DEFAULT_KEY, text_col: str = "text", found_col: str | None = None) -> DataFrame:
    """``docs`` with valid values in ``text_col`` replaced.

    ``found_col`` names an added column, ``array<struct<kind, pseudonym>>`` in
    order of the text; underscores come before the name where it exists.
    """
    p = clear_of(docs.columns, "_pii_")
    text = F.col(text_col)
    none = F.array().cast("array<string>")
    # Generators, so that the values, the patterns and the hits are computed once.
    runs = F.struct(*(F.coalesce(_valid_runs(kind, text), none).alias(kind) for kind in RUNS))
    held = docs.select("*", F.explode(F.array(runs)).alias(p + "runs"))
    pattern = _pattern(F.col(p + "runs")["iban"], F.col(p + "runs")["card"])
    held = held.select("*", F.explode(F.array(pattern)).alias(p + "pattern"))
    # Every candidate holds a digit, an @, an equals sign or a colon.
    hits = F.when(text.rlike("[0-9@=:]"), F.regexp_extract_all(text, F.col(p + "pattern"), F.lit(0))).otherwise(none)
    held = held.select("*", F.explode(F.array(F.coalesce(hits, none))).alias(p + "hits"))
    judged = F.transform(F.col(p + "hits"), lambda h: F.struct(h.alias("value"), kind_of(h).alias("kind")))
    held = held.select("*", F.explode(F.array(judged)).alias(p + "judged"))
    made = F.transform(
        F.col(p + "judged"), lambda j: F.struct(j["kind"].alias("kind"), pseudonym(j["value"], j["kind"], key).alias("pseudonym"))
    )
    held = held.select("*", F.explode(F.array(made)).alias(p + "made"))
    gaps = F.split(text, F.col(p + "pattern"), -1)
    pieces = F.zip_with(F.slice(gaps, 1, F.size(p + "made")), F.col(p + "made"), lambda g, m: F.concat(g, m["pseudonym"]))
    new = F.concat(F.array_join(pieces, ""), F.element_at(gaps, -1))
    out = {c: F.col(c) for c in docs.columns}
    out[text_col] = F.when(F.size(p + "made") > 0, new).otherwise(text)
    if found_col:
        out[free_name(docs.columns, found_col)] = F.filter(F.col(p + "made"), lambda m: m["kind"].isNotNull())
    return held.select(*(v.alias(k) for k, v in out.items()))


def op8_pii(docs: DataFrame) -> DataFrame:
    """doc_id, the text with pseudonyms, their number, and kind and pseudonym of each, for every document."""
    out = pseudonymise(docs.select("doc_id", "text"), found_col="found")
    return out.select("doc_id", "text", F.size("found").cast("long").alias("n_found"), "found")
