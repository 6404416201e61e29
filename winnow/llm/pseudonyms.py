"""Format-preserving pseudonyms by keyed Feistel permutations, in Spark expressions only.

Validated values are permuted within their own format: card numbers (Luhn) stay card numbers with a right check digit, dates stay
dates of the same 400 years, IPv4 addresses stay addresses, telephone and social security numbers and the names before the @ of e-mail
addresses keep every character's class. Each permutation is one to one for a key, so equal values stay linked across documents and different
values stay apart. A value that fails its check is no such value and is left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.numeric import let

ROUNDS = 6
# The formats that are looked for, in the order in which they are tried at each place.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "address": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]|-[0-9])",
    "social": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9-])(?:[0-9]{4} ){3}[0-9]{4}(?![0-9])|(?<![0-9-])(?:[0-9]{4}-){3}[0-9]{4}(?![0-9-])|(?<![0-9-])[0-9]{13,19}(?![0-9])",
}
ANY = "|".join(f"(?:{pattern})" for pattern in FORMATS.values())
#: First day and length of the 400 years that dates stay in, and the two factors of the length that the halves of a date count in.
FIRST_DAY, DAY_FACTORS = "1800-01-01", (189, 773)


def _number(digest: Column, at, width: int) -> Column:
    return F.conv(F.substring(digest, at, F.lit(width)) if isinstance(at, Column) else F.substring(digest, at, width), 16, 10).cast("long")


def _shifted(ch: Column, by: Column) -> Column:
    """A character moved within its class; other characters stay."""
    code = F.ascii(ch)

    def move(first: str, size: int) -> Column:
        return F.char((code - ord(first) + by) % size + ord(first))

    return F.when(ch.between("0", "9"), move("0", 10)).when(ch.between("a", "z"), move("a", 26)).when(ch.between("A", "Z"), move("A", 26)).otherwise(ch)


def _half(text: Column, other: Column, key: str, turn: int) -> Column:
    def stream(digest: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: _shifted(F.substring(text, i, F.lit(1)), _number(digest, ((i - 1) % 64) * 2 + 1, 2))), "")

    return F.when(F.length(text) > 0, let(F.sha2(F.concat(F.lit(f"{key}:{turn}:"), other), 512), stream)).otherwise(text)


def _turns(state: Column, change) -> Column:
    """The Feistel rounds over a struct of two halves: each changes one half by the other, in turn."""

    def once(turn: int):
        def step(s: Column) -> Column:
            if turn % 2:
                return F.struct(change(s["a"], s["b"], 0, turn).alias("a"), s["b"].alias("b"))
            return F.struct(s["a"].alias("a"), change(s["b"], s["a"], 1, turn).alias("b"))

        return step

    for turn in range(ROUNDS):
        state = let(state, once(turn))
    return state


def permute_text(text: Column, key: str) -> Column:
    """A keyed one-to-one map of ASCII letters and digits of a string within their classes."""

    def halves(s: Column) -> Column:
        cut = F.floor(F.length(s) / 2).cast("int")
        return F.struct(F.substring(s, F.lit(1), cut).alias("a"), F.substring(s, cut + 1, F.length(s)).alias("b"))

    state = _turns(let(text, halves), lambda own, other, side, turn: _half(own, other, key, turn))
    return let(state, lambda s: F.concat(s["a"], s["b"]))


def permute_number(value: Column, sizes: tuple[int, int], key: str) -> Column:
    """A keyed one-to-one map of the numbers from 0 to the product of ``sizes``."""
    state = let(value.cast("long"), lambda v: F.struct(F.floor(v / sizes[1]).cast("long").alias("a"), (v % sizes[1]).alias("b")))

    def pull(other: Column, turn: int) -> Column:
        return _number(F.md5(F.concat(F.lit(f"{key}:{turn}:"), other.cast("string"))), 1, 8)

    state = _turns(state, lambda own, other, side, turn: (own + pull(other, turn)) % sizes[side])
    return let(state, lambda s: s["a"] * sizes[1] + s["b"])


def _luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Sum of the digits from the right, every second one doubled, starting with the last or the one before."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == (0 if doubled_last else 1), twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _card(value: Column, key: str) -> Column:
    """The card number with all digits but the last permuted, a fitting last digit, and its separators where they were."""
    separator = F.regexp_extract(value, "[ -]", 0)

    def written(digits: Column) -> Column:
        grouped = F.concat(F.substring(digits, 1, 4), *(F.concat(separator, F.substring(digits, 1 + 4 * i, 4)) for i in range(1, 4)))
        return F.when(separator == "", digits).otherwise(grouped)

    def closed(body: Column) -> Column:
        return let(F.concat(body, ((10 - _luhn_sum(body, True) % 10) % 10).cast("string")), written)

    digits = F.regexp_replace(value, "[ -]", "")
    return let(permute_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key), closed)


def _address(value: Column, key: str) -> Column:
    parts = F.split(value, "\\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda total, p: total * 256 + p.cast("long"))
    moved = permute_number(number, (65536, 65536), key)
    return let(moved, lambda n: F.concat_ws(".", *(F.shiftright(n, 24 - 8 * i).bitwiseAND(255).cast("string") for i in range(4))))


def _date(value: Column, key: str) -> Column:
    day = F.datediff(value.try_cast("date"), F.lit(FIRST_DAY).cast("date"))
    return F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), permute_number(day, DAY_FACTORS, key).cast("int")), "yyyy-MM-dd")


def pseudonym(value: Column, key: str) -> Column:
    """``kind, out`` of one found value; the kind is null if the value fails its check."""
    digits = F.regexp_replace(value, "[ -]", "")
    year = F.substring(value, 1, 4).cast("int")

    def made(kind: str, out: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), out.alias("out"))

    return (
        F.when(value.contains("@"), made("email", F.concat(permute_text(F.substring_index(value, "@", 1), f"{key}:email"), F.lit("@"), F.substring_index(value, "@", -1))))
        .when(value.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.when(F.forall(F.split(value, "\\."), lambda p: p.cast("int") <= 255), made("address", _address(value, f"{key}:address"))))
        .when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.when(value.try_cast("date").isNotNull() & year.between(1800, 2199), made("date", _date(value, f"{key}:date"))))
        .when(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(~value.rlike("^(000|666|9)|-00-|-0000$"), made("social", permute_text(value, f"{key}:social"))))
        .when(value.rlike(r"^\(|^[0-9]{3}[-.]"), made("phone", permute_text(value, f"{key}:phone")))
        .when(let(digits, lambda d: _luhn_sum(d, False)) % 10 == 0, made("card", _card(value, f"{key}:card")))
    )


def pseudonymise(docs: DataFrame, key: str = "key") -> DataFrame:
    """The columns of ``docs`` with pseudonyms in ``text``, and ``n_email, n_address, n_date, n_social, n_phone, n_card`` (long).

    A null text stays null with counts of 0. Columns of ``docs`` named like a count are replaced. Every row is handled on its own, so
    repeated rows get equal pseudonyms, and nothing is shuffled.
    """
    text = F.col("text")
    found = F.when(text.rlike("[0-9@]") & text.rlike(ANY), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    values = F.transform(found, lambda v: F.coalesce(pseudonym(v, key), F.struct(F.lit(None).cast("string").alias("kind"), v.alias("out"))))
    rows = docs.withColumn("_values", values)
    outs = F.concat(F.transform("_values", lambda v: v["out"]), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(F.split("text", ANY, -1), outs, lambda a, b: F.concat(a, b)), "")

    def times(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("_values", lambda v: v["kind"] == kind)), F.lit(0))

    counts = {f"n_{kind}": times(kind) for kind in FORMATS}
    changed = F.when(F.size("_values") > 0, joined).otherwise(text)
    kept = [changed.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in counts]
    return rows.select(*kept, *(F.greatest(n, F.lit(0)).cast("long").alias(c) for c, n in counts.items()))
