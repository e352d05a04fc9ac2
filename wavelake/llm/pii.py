"""Personal data, in DataFrame operations only: regular expressions propose spans, validators confirm them, words nearby
adjust their scores.

Base spans are e-mail addresses, IP addresses (parts up to 255), card numbers (Luhn) and phone numbers (8 to 15 digits).
The method adds IBANs (country, length, mod-97) and US social security numbers (ranges of their parts), both only if their
scores reach LIKELY, which a social security number can't without a word of context. A span's score, in hundredths, is
that of its kind, with BONUS for a word that suggests the kind and without as much for one that speaks against it. Its
neighbourhood is REACH code points on both sides, at most up to the next match of the same pattern.

The patterns here find the stated ones' matches in time linear in a text: where a stated pattern starts with a run of a
class, the leftmost match starts where the run does or the match before ended, so other starts aren't tried; and no
repeat is ever left for a shorter one. No text moves between tasks: there is no shuffle, so no key can be hot.

Null texts are empty and give no spans, an empty table no rows; repeated rows stay rows; rows with a null id are scanned
too. Offsets count code points, ends are exclusive; spans of two kinds may overlap. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.llm.secret_scan import bound, running

#: Kinds in the order of reports: the first four are base kinds.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE_KINDS = 4

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Lengths of IBANs without their country and check digits (fixed values).
IBAN_LENGTHS = {11: "NO", 12: "BE", 14: "DK|FI|NL", 16: "AT|LU", 17: "CH|LI", 18: "DE|GB|IE", 20: "CZ|ES|SE", 21: "PT", 23: "FR|IT", 24: "HU|PL"}
IBAN = "|".join(rf"(?:{c})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n}}}" for n, c in IBAN_LENGTHS.items())
SSN = "[0-9]{3}-[0-9]{2}-[0-9]{4}"
PATTERNS = [EMAIL, IP, CARD, PHONE, IBAN, SSN]
#: What a text must hold for a pattern to be tried.
NEEDS = ["@", r"[0-9]\.[0-9]", "[0-9]", r"\+[0-9]", "[A-Z]{2}[0-9]{2}", "[0-9]-[0-9]"]

#: An IP part of at most 255, and social security numbers that were never given out.
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
IP_VALID = rf"^{PART}\.{PART}\.{PART}\.{PART}$"
SSN_INVALID = "^(?:000|666|9)|-00-|-0000$"
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Scores in hundredths: of each kind, what a word of context adds or takes, and from where on a span is likely.
SCORES = [90, 50, 60, 50, 80, 30]
BONUS, LIKELY, REACH = 30, 60, 40
WORDS = [
    "email|mail|contact|write|courriel|correo|kontakt",
    "ip|host|server|address|login|adresse|servidor",
    "card|credit|visa|mastercard|payment|karte|carte|tarjeta",
    "phone|call|tel|telephone|mobile|fax|telefon|telefono",
    "iban|bank|account|konto|compte|cuenta",
    "ssn|social|security|insurance",
]
AGAINST = "example|sample|test|dummy|version|isbn|order|beispiel|exemple|ejemplo"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SPAN = "struct<kind:int,start:int,end:int,value:string,around:string>"


def whole_word(words: str) -> str:
    return f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)"


def proposed(text: Column, kind: int) -> Column:
    """All leftmost matches of the kind's pattern that don't overlap, with the text around each. What a split leaves are
    the gaps between matches: they give offsets and neighbourhoods without counting from the text's start each time."""
    pattern = PATTERNS[kind]
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))

    def place(x: Column) -> Column:
        steps = F.zip_with(F.slice(x["gaps"], 1, F.size(x["values"])), x["values"], lambda gap, value: F.char_length(gap) + F.char_length(value))
        zipped = lambda ends: F.arrays_zip(ends.alias("end"), x["values"].alias("value"))
        around = lambda i: F.concat(F.right(F.get(x["gaps"], i), F.lit(REACH)), F.lit("\n"), F.left(F.get(x["gaps"], i + 1), F.lit(REACH)))
        one = lambda s, i: F.struct(F.lit(kind).alias("kind"), (s["end"] - F.char_length(s["value"])).alias("start"), s["end"].alias("end"), s["value"].alias("value"), around(i).alias("around"))
        return F.transform(zipped(running(steps, 0, lambda u, v: u + v)), one)

    placed = bound(found, lambda x: F.when(F.size(x["values"]) > 0, place(x)))
    return F.coalesce(F.when(text.rlike(NEEDS[kind]), placed), F.array().cast(f"array<{SPAN}>"))


def mod97(code: Column) -> Column:
    """The remainder of an IBAN's number: its first four characters moved to the end, letters as 10 to 35."""
    moved = F.concat(F.substr(code, F.lit(5)), F.left(code, F.lit(4)))
    value = lambda i: F.position(F.substr(moved, i, F.lit(1)), F.lit(ALPHABET)) - 1
    return F.aggregate(F.sequence(F.lit(1), F.char_length(moved)), F.lit(0), lambda r, i: (r * F.when(value(i) > 9, 100).otherwise(10) + value(i)) % 97)


def apart(span: Column, alike: str) -> Column:
    """True if no character of the class stands right before or after the span."""
    return ~span["around"].rlike(f"{alike}\n|\n{alike}")


def confirmed(span: Column, kind: int) -> Column:
    value = span["value"]
    digits = F.regexp_replace(value, "[^0-9]", "")
    code = F.replace(value, F.lit(" "), F.lit(""))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: value.rlike(IP_VALID),
        "card": lambda: F.char_length(digits).between(16, 19) & F.call_function("luhn_check", digits),
        "phone": lambda: F.char_length(digits).between(8, 15),
        "iban": lambda: apart(span, "[A-Za-z0-9]") & (mod97(code) == 1),
        "ssn": lambda: apart(span, "[0-9-]") & ~value.rlike(SSN_INVALID),
    }[KINDS[kind]]()


def score(span: Column, kind: int) -> Column:
    near = F.translate(span["around"], UPPER, LOWER)
    bonus = lambda words: F.when(near.rlike(whole_word(words)), BONUS).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(SCORES[kind]) + bonus(WORDS[kind]) - bonus(AGAINST)))


def spans(text: Column) -> Column:
    """All spans by kind, then start: kind (its place in KINDS), start, end, value, score."""

    def of(kind: int) -> Column:
        valid = F.filter(proposed(text, kind), lambda s: confirmed(s, kind))
        scored = F.transform(valid, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), score(s, kind).alias("score")))
        return scored if kind < BASE_KINDS else F.filter(scored, lambda s: s["score"] >= LIKELY)

    return F.concat(*(of(k) for k in range(len(KINDS))))


def found(documents: DataFrame, text: str = "text") -> DataFrame:
    """kept (a struct of all columns, whatever their names) and its spans."""
    return documents.select(F.struct(*documents.columns).alias("kept"), spans(F.coalesce(F.col(text), F.lit(""))).alias("spans"))


def listed(items: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(documents: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, n_likely (spans whose score reaches LIKELY) and scores (in the
    order of spans)."""
    made = found(documents.select("doc_id", "text"))
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda k: count(lambda s: s["kind"] == k)
    counts = [of_kind(k).alias(f"n_{KINDS[k]}") for k in range(BASE_KINDS)]
    base = listed(F.filter("spans", lambda s: s["kind"] < BASE_KINDS))
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return made.select("kept.doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count(lambda s: s["score"] >= LIKELY).alias("n_likely"), scores.alias("scores"))


def redact(documents: DataFrame, least: int = LIKELY, mark: Callable[[str], str] = lambda kind: f"[{kind.upper()}]") -> DataFrame:
    """The same rows and columns; in texts, spans whose score reaches least are replaced by their kind's mark. Of spans that
    overlap, the first one's mark stands for all of them; null texts stay null."""
    made, text = found(documents), F.col("kept.text")
    placed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["score"].alias("score")))
    likely = F.array_sort(F.filter(placed, lambda s: s["score"] >= least))
    marks = F.array(*(F.lit(mark(k)) for k in KINDS))

    def cut(own: Column) -> Column:
        """Each span's text before it and its mark, nothing for what lies in the spans before; then the rest."""
        reached = F.concat(F.array(F.lit(0)), running(F.transform(own, lambda s: s["end"]), 0, lambda u, v: F.greatest(u, v)))
        piece = lambda s, at: F.when(s["start"] >= at, F.concat(F.substr(text, at + 1, s["start"] - at), F.element_at(marks, s["kind"] + 1))).otherwise("")
        return bound(reached, lambda at: F.concat(F.transform(own, lambda s, i: piece(s, F.get(at, i))), F.array(F.substr(text, F.element_at(at, -1) + 1))))

    new = F.when(F.size(likely) > 0, F.array_join(bound(likely, cut), "")).otherwise(text)
    return made.select(*(new.alias(c) if c == "text" else F.col("kept").getField(c).alias(c) for c in documents.columns))
