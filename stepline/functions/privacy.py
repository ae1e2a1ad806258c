"""Column functions that find, mask and replace personal data and secrets, in the JVM.

Spark returns matched texts, not their places. ``spans`` marks every match inside the text
with two control characters and cuts there, so places follow from the lengths of the pieces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepline.functions.prob import let
from stepline.functions.text import col, norm_ws, strip

# fixed values: the detector patterns
EMAIL = r"(?U)(?<![\w.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])"
PHONE = (
    r"(?U)(?<![\w+.])(?:\+?1[\s.-])?(?:\(\d{3}\)\s?\d{3}[-.]\d{4}|\d{3}([-.])\d{3}\1\d{4})(?![\d.])"
    r"|(?<![\w+])\+\d{1,3}(?:[\s.-]?\d{2,4}){3,5}(?![\d.])"
)
CARD = r"(?U)(?<![\d.,-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{13,19})(?![\d.,])"
SSN = r"(?U)(?<![\d.-])\d{3}-\d{2}-\d{4}(?![\d-])"
NOT_SSN = r"(?i)DPCI|item|model|part|sku|order"
CARD_CONTEXT = r"(?i)card|account|member|family id|visa|mastercard|amex|discover|iban|loyalty"
YEARS_ONLY = r"^(?:(?:19|20)\d\d(?:[ -]|$))+$"
SECRET = (
    r"(?U)AKIA[0-9A-Z]{16}|\bsk-[A-Za-z0-9_-]{20,}|\bgh[pousr]_[A-Za-z0-9]{36}|\bhf_[A-Za-z0-9]{30,}"
    r"|\bxox[abpr]-[A-Za-z0-9-]{10,}|\bAIza[0-9A-Za-z_-]{35}"
    r"|\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
    r"|-----BEGIN [A-Z ]*PRIVATE KEY-----"
)
URL_SECRET = (
    r"(?i)([?&#](?:access_token|id_token|auth|token|api_?key|apikey|secret|password|passwd|pwd|"
    r"session_?id|sid|sig|signature|code)=)([^&#\s]{12,})"
)
PASSWORD_LABEL = r"(?iU)pass(word|code)|pwd|\bpin\b"
NAME = r"^([A-Z][a-z]+)(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]+(?:[-'][A-Z][a-z]+)?$"

# fixed values: replacements and the proposed rule per category
REDACTED, NAME_STAND_IN, EMAIL_STAND_IN, PHONE_STAND_IN, EMAIL_TAG = (
    "<redacted>",
    "Alex Doe",
    "user@example.com",
    "555-0100",
    "<email>",
)
POLICY = {
    "email": "typed/url/labels: replace with user@example.com; page_text: replace with <email>",
    "phone": "typed: replace with 555-0100; url: drop the parameter; page_text and labels: keep (published business "
    "numbers on public pages) unless the row is also flagged for a typed value",
    "card": "drop the row",
    "ssn": "drop the row",
    "secret": "replace the value with <redacted>",
    "password_value": "replace the value with <redacted>",
    "name": "typed: replace with a fixed placeholder name (e.g. Alex Doe) in recent_actions and element values",
    "*_from_goal": "keep: the value is part of the task's own goal",
}
# fixed values: a cheap sign without which a detector can not match at all
SIGNS = {
    EMAIL: r"@",
    PHONE: r"\p{Nd}{3}[-.]\p{Nd}{4}|\+\p{Nd}",
    CARD: r"\p{Nd}{4}[ -]?\p{Nd}{4}",
    SSN: r"\p{Nd}-\p{Nd}{2}-\p{Nd}",
    URL_SECRET: r"[?&#][A-Za-z_]+=",
}
SECRET_STARTS = ["AKIA", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "hf_", "xox", "AIza", "eyJ", "-----BEGIN"]
NUMBER_SIGN = r"\p{Nd}{2}"
SPAN_TYPE = "array<struct<start:int,end:int,text:string>>"
MARK_OPEN, MARK_CLOSE = "\u0001", "\u0002"
CONTEXT_WIDTH = 30


def luhn(digits: Column | str) -> Column:
    """Checksum of card numbers: every second digit from the right doubled, the sum ends in 0."""
    d = F.transform(F.split(F.reverse(col(digits)), ""), lambda c: c.cast("int"))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(doubled, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def mask(s: Column | str) -> Column:
    """The shape of a value: letters x, digits 0 but for the last two; at most 80 characters."""
    t = F.substring(col(s), 1, 80)
    cut = r"(?s)^(.*?)((?:\p{Nd}[^\p{Nd}]*){0,2})$"
    letters = lambda c: F.regexp_replace(c, r"\p{L}", "x")
    head, tail = F.regexp_extract(t, cut, 1), F.regexp_extract(t, cut, 2)
    return F.concat(F.regexp_replace(letters(head), r"\p{Nd}", "0"), letters(tail))


def context(text: Column, start: Column, end: Column, width: int = CONTEXT_WIDTH) -> Column:
    """The masked match in brackets between its neighbours; places are 0-based, end exclusive."""
    left_at = F.greatest(F.lit(0), start - width)
    left = F.substring(text, left_at + 1, start - left_at)
    match = F.substring(text, start + 1, end - start)
    right = F.substring(text, end + 1, F.lit(width))
    return norm_ws(F.concat(left, F.lit("["), mask(match), F.lit("]"), right))


def spans(text: Column, pattern: str, replacement: str = MARK_OPEN + "$0" + MARK_CLOSE) -> Column:
    """All matches as array<struct<start,end,text>>, 0-based, end exclusive."""
    # a match can not swallow a mark: marks in the text itself become spaces of the same length
    marked = F.regexp_replace(F.translate(text, MARK_OPEN + MARK_CLOSE, "  "), pattern, replacement)
    pieces = F.split(marked, f"[{MARK_OPEN}{MARK_CLOSE}]", -1)

    empty = F.array().cast(SPAN_TYPE)

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + F.length(x)
        found = F.struct(a["at"].alias("start"), end.alias("end"), x.alias("text"))
        return F.struct(end.alias("at"), (~a["inside"]).alias("inside"), F.when(a["inside"], F.concat(a["out"], F.array(found))).otherwise(a["out"]).alias("out"))

    def places(p: Column) -> Column:
        # pieces alternate between what is around a match and a match; the place is carried along
        start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), empty.alias("out"))
        return F.when(F.size(p) > 1, F.aggregate(p, start, step)["out"]).otherwise(empty)

    return let(pieces, places)


def no_spans() -> Column:
    return F.array().cast(SPAN_TYPE)


def may_hold(text: Column, pattern: str) -> Column:
    """Whether a text shows the sign of a detector: most texts do not, and skip the full pattern."""
    if pattern == SECRET:
        return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in SECRET_STARTS])
    sign = SIGNS[pattern]
    return F.contains(text, F.lit(sign)) if sign == "@" else text.rlike(sign)


# an escaped character of a JSON text, behind which a sign may hide
ESCAPED = "\\u"


def json_may_change(json_text: Column) -> Column:
    """Whether ``redact_free`` could change any string of a JSON text: without a sign in all of it, it could not."""
    return F.contains(json_text, F.lit(ESCAPED)) | may_hold(json_text, EMAIL) | may_hold(json_text, SECRET) | may_hold(json_text, URL_SECRET)


def json_may_hold_numbers(json_text: Column) -> Column:
    """Whether any string of a JSON text could hold a card or social security number."""
    return F.contains(json_text, F.lit(ESCAPED)) | may_hold(json_text, CARD) | may_hold(json_text, SSN)


def detect(text: Column, pattern: str, replacement: str = MARK_OPEN + "$0" + MARK_CLOSE) -> Column:
    """``spans`` of a detector, behind its sign."""
    return F.when(may_hold(text, pattern), spans(text, pattern, replacement)).otherwise(no_spans())


def find_numbers(text: Column) -> Column:
    """Card and social security numbers: array<struct<category,start,end,text>>."""
    ssn = F.filter(detect(text, SSN), lambda s: ~before(text, s["start"], 30).rlike(NOT_SSN))
    card = F.filter(detect(text, CARD), lambda s: is_card(text, s))
    found = F.concat(_tagged("ssn", ssn), _tagged("card", card))
    return F.when(text.rlike(NUMBER_SIGN), found).otherwise(_tagged("card", no_spans()))


def _tagged(category: str, found: Column) -> Column:
    return F.transform(
        found,
        lambda s: F.struct(F.lit(category).alias("category"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")),
    )


def before(text: Column, start: Column, width: int) -> Column:
    at = F.greatest(F.lit(0), start - width)
    return F.substring(text, at + 1, start - at)


def is_card(text: Column, span: Column) -> Column:
    """A card-like number: right length, checksum, more than one digit, no list of years, grouped or in context."""
    digits = F.regexp_replace(span["text"], r"\D", "")
    grouped = span["text"].rlike(r"[ -]")
    many = ~digits.rlike(r"^(\d)\1*$")
    return (
        F.length(digits).between(13, 19)
        & luhn(digits)
        & many
        & ~span["text"].rlike(YEARS_ONLY)
        & (grouped | before(text, span["start"], 40).rlike(CARD_CONTEXT))
    )


def find(text: Column, in_url: Column | bool = False) -> Column:
    """All findings of a text: array<struct<category,start,end,text>>."""
    url = in_url if isinstance(in_url, Column) else F.lit(in_url)
    numbers = F.when(url, F.filter(find_numbers(text), lambda s: s["category"] != "card")).otherwise(find_numbers(text))
    url_secret = F.when(url, detect(text, URL_SECRET, "$1" + MARK_OPEN + "$2" + MARK_CLOSE)).otherwise(no_spans())
    return F.concat(
        _tagged("email", detect(text, EMAIL)),
        _tagged("phone", F.when(text.rlike(NUMBER_SIGN), detect(text, PHONE)).otherwise(no_spans())),
        numbers,
        _tagged("secret", detect(text, SECRET)),
        _tagged("secret", url_secret),
    )


def is_name(text: Column | str, first_names: list[str]) -> Column:
    """``First Last`` whose first word is a common first name."""
    t = strip(text)
    return t.rlike(NAME) & F.lower(F.regexp_extract(t, NAME, 1)).isin(*first_names)


def redact_free(text: Column, goal: Column) -> Column:
    """Secrets, URL credentials and e-mail addresses out of any text; addresses the goal names stay."""
    t = F.when(may_hold(text, SECRET), F.regexp_replace(text, SECRET, REDACTED)).otherwise(text)
    secret_free = lambda c: F.when(may_hold(c, URL_SECRET), F.regexp_replace(c, URL_SECRET, "$1" + REDACTED)).otherwise(c)
    kept = lambda s: F.contains(goal, F.lower(s["text"])) | (s["text"] == EMAIL_STAND_IN)

    def rebuilt(v: Column) -> Column:
        # pieces between the matches, with each match kept or replaced
        return let(
            detect(v, EMAIL),
            lambda sp: F.when(F.size(sp) == 0, v).otherwise(
                F.concat(
                    F.array_join(
                        F.transform(
                            sp,
                            lambda s, i: F.concat(
                                let(
                                    F.when(i == 0, F.lit(0)).otherwise(sp[i - 1]["end"]),
                                    lambda at: F.substring(v, at + 1, s["start"] - at),
                                ),
                                F.when(kept(s), s["text"]).otherwise(EMAIL_TAG),
                            ),
                        ),
                        "",
                    ),
                    F.substring(v, F.element_at(sp, -1)["end"] + 1, F.length(v)),
                )
            ),
        )

    return let(let(t, secret_free), rebuilt)


def replace_all(text: Column, pairs: Column) -> Column:
    """Literal replacements in the given order: array<struct<old,new>>."""
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["old"], p["new"]))


# stand in for an escaped backslash and an escaped quote while JSON is cut at its quotes;
# control characters can not occur in JSON text
HELD_BACKSLASH, HELD_QUOTE = "\u0003", "\u0004"


def _json_pieces(json_text: Column) -> Column:
    """JSON cut at its quotes: pieces with an odd place (from 0) are strings, keys or values."""
    held = F.replace(F.replace(json_text, F.lit("\\\\"), F.lit(HELD_BACKSLASH)), F.lit('\\"'), F.lit(HELD_QUOTE))
    return F.split(held, '"', -1)


def _released(piece: Column) -> Column:
    return F.replace(F.replace(piece, F.lit(HELD_QUOTE), F.lit('\\"')), F.lit(HELD_BACKSLASH), F.lit("\\\\"))


def _is_value(pieces: Column, i: Column) -> Column:
    return (i % 2 == 1) & ~F.startswith(F.ltrim(F.coalesce(F.get(pieces, i + 1), F.lit(""))), F.lit(":"))


def _string_of(piece: Column) -> Column:
    """The text that a JSON string stands for."""
    raw = _released(piece)
    parsed = F.from_json(F.concat(F.lit('["'), raw, F.lit('"]')), "array<string>")
    return F.when(F.contains(raw, F.lit("\\")), F.get(parsed, 0)).otherwise(raw)


def json_texts(json_text: Column) -> Column:
    """Every string value of a JSON text at any depth, in order; keys are left out."""

    def values(p: Column) -> Column:
        placed = F.transform(p, lambda x, i: F.when(_is_value(p, i), _string_of(x)))
        return F.filter(placed, lambda x: x.isNotNull())

    return let(_json_pieces(json_text), values)


def rewrite_json(json_text: Column, fix, wanted=None) -> Column:
    """The JSON text with ``fix`` applied to every string value; keys, numbers and layout stay.

    ``wanted`` tells from a value as it is written whether ``fix`` could change it; others are not touched.
    """

    def written(x: Column) -> Column:
        j = F.to_json(F.struct(fix(_string_of(x)).alias("v")))
        return F.substring(j, F.lit(7), F.length(j) - 8)

    def whole(p: Column) -> Column:
        ask = (lambda x, i: _is_value(p, i)) if wanted is None else (lambda x, i: _is_value(p, i) & wanted(x))
        return F.array_join(F.transform(p, lambda x, i: F.when(ask(x, i), written(x)).otherwise(_released(x))), '"')

    return let(_json_pieces(json_text), whole)
