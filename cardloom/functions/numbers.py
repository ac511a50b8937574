"""Card-number expressions. Six normalisers are kept apart on purpose: they differ
on "000", on letters and on empty input."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Number and promo patterns, and the promo prefixes they know.
NUMBER_PATTERN = r"([A-Z]{0,3}\d{1,3})\s*/\s*([A-Z]{0,3}\d{1,3})"
PROMO_PATTERN = r"\b(SWSH|SVP|MEP)\s*0*(\d{1,3})\b"
BARE_NUMBER_PATTERN = r"^\d{2,3}$"
CODE_PATTERN = r"^[A-Z0-9]{3,6}(-[A-Z0-9]{3,6}){2,4}$"
CODE_TOKEN_PATTERN = r"^[A-Z0-9][A-Z0-9-]{8,}$"
CODE_SEGMENT_PATTERN = r"^[A-Z0-9]{3,6}$"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip_zeros(c: Column) -> Column:
    return F.regexp_replace(c, "^0+", "")


def zero_fill(c: Column, width: int = 3) -> Column:
    """Left-pad with zeros, never truncating."""
    return F.lpad(c, F.greatest(F.lit(width), F.length(c)), F.lit("0"))


def normalize_local_id(c: Column) -> Column:
    """GG07 -> GG7, SWSH009 -> SWSH9, 000 -> 0, 12A unchanged, NULL -> ''."""
    return F.regexp_replace(F.upper(F.trim(F.coalesce(c, F.lit("")))),
                            r"^([A-Z]*)0*(\d+)$", "$1$2")


def normalize_numerator(c: Column) -> Column:
    return F.upper(F.coalesce(blank_to_null(strip_zeros(c)), F.lit("0")))


def number_key(c: Column) -> Column:
    """Part before the slash, zero-stripped; NULL and empty stay NULL."""
    head = F.upper(F.trim(F.split_part(c, F.lit("/"), F.lit(1))))
    return F.when(blank_to_null(c).isNotNull(),
                  F.coalesce(blank_to_null(strip_zeros(head)), F.lit("0")))


def collection_numerator(c: Column) -> Column:
    """As ``number_key`` but "000" stays "000" and case is kept."""
    head = blank_to_null(F.trim(F.split_part(c, F.lit("/"), F.lit(1))))
    return F.coalesce(blank_to_null(strip_zeros(head)), head)


def catalog_tail_id(c: Column) -> Column:
    """Letters upper-cased, integer tail de-zeroed (crosswalk building form)."""
    return F.regexp_replace(F.upper(F.trim(c)), r"^([A-Z]*?)0*(\d+)$", "$1$2")


def catalog_local_id(value: Column, promo_prefix: Column, prefixed: Column) -> Column:
    """A printed number in the form the given set's catalog rows use."""
    s = F.upper(F.trim(value))
    rest = F.when(F.startswith(s, promo_prefix),
                  F.substr(s, F.length(promo_prefix) + 1)).otherwise(s)
    digits = zero_fill(F.coalesce(blank_to_null(strip_zeros(rest)), F.lit("0")))
    promo = F.when(~rest.rlike(r"^\d+$"), zero_fill(s)) \
             .when(prefixed, F.concat(promo_prefix, digits)).otherwise(digits)
    return F.when(value.isNull(), F.lit(None).cast("string")) \
            .when(blank_to_null(promo_prefix).isNull(), zero_fill(s)).otherwise(promo)


def alpha_prefix(c: Column) -> Column:
    return F.upper(F.regexp_extract(F.coalesce(c, F.lit("")), r"^[A-Za-z]+", 0))


def parse_number(text: Column, confidence: Column) -> Column:
    """STRUCT(numerator, denominator, prefix, confidence, pattern_ok, tokens).

    Letters stay on a numerator only if its denominator carries letters too;
    without an N/N pattern a promo prefix plus digits is taken.
    """
    up = F.upper(F.coalesce(text, F.lit("")))
    num = blank_to_null(F.regexp_extract(up, NUMBER_PATTERN, 1))
    den = blank_to_null(F.regexp_extract(up, NUMBER_PATTERN, 2))
    pre = blank_to_null(F.regexp_extract(up, PROMO_PATTERN, 1))
    pnum = blank_to_null(F.regexp_extract(up, PROMO_PATTERN, 2))
    plain = F.when(den.rlike("^[A-Z]"), num).otherwise(F.regexp_replace(num, "^[A-Z]+", ""))
    return F.struct(
        F.when(num.isNotNull(), plain).otherwise(pnum).alias("numerator"),
        den.alias("denominator"),
        F.when(num.isNull(), pre).alias("prefix"),
        F.round(confidence, 3).alias("confidence"),
        (num.isNotNull() | pre.isNotNull()).alias("pattern_ok"),
        F.split(F.trim(up), r"\s+").alias("tokens"))


def lookup_number(numerator: Column, prefix: Column) -> Column:
    return F.when(blank_to_null(prefix).isNotNull() & blank_to_null(numerator).isNotNull(),
                  F.concat(prefix, numerator)).otherwise(numerator)


def display_number(numerator: Column, denominator: Column, prefix: Column) -> Column:
    num, den, pre = map(blank_to_null, (numerator, denominator, prefix))
    return F.when(pre.isNotNull() & num.isNotNull(), F.concat(pre, num)) \
            .when(num.isNotNull() & den.isNotNull(), F.concat(num, F.lit("/"), den))


def identity_display_number(numerator: Column, denominator: Column) -> Column:
    """Identity form: numerator padded to three when a denominator follows it."""
    return F.when(denominator.isNotNull(),
                  F.concat(zero_fill(numerator), F.lit("/"), denominator)).otherwise(numerator)


def matched_token_confidence(tokens: Column, matched: Column, default: float = 0.3) -> Column:
    """Mean confidence / 100 of the tokens (array<struct<text, conf>>) that make up
    the whitespace-split ``matched`` span."""
    span = F.split(F.trim(matched), r"\s+")
    hits = F.filter(tokens, lambda t: F.array_contains(span, t["text"]))
    total = F.aggregate(hits, F.lit(0.0), lambda a, t: a + t["conf"])
    return F.when(F.size(hits) > 0, total / F.size(hits) / F.lit(100.0)).otherwise(F.lit(default))


def normalize_code(c: Column) -> Column:
    return blank_to_null(F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", "")))


# Subset slugs whose reference form breaks the general rule.
SLUG_OVERRIDES = {
    "swsh3.5": "swsh35", "swsh4.5": "swsh45", "swsh10.5": "swsh10tg", "swsh12.5": "swsh12pt5",
    "swsh9.5tg": "swsh9tg", "swsh10.5tg": "swsh10tg", "swsh11.5tg": "swsh11tg",
    "swsh12.5tg": "swsh12tg", "swsh12.5gg": "swsh12pt5gg", "swsh4.5sv": "swsh45sv",
    "cel25c": "cel25c",
}


def reference_key(card_key: Column, overrides: dict[str, str] | None = None) -> Column:
    """``set-number`` key in reference-image form: zero padding off, ".5" spelled
    "pt5", override table first, NULL when the set slug has no such form."""
    table = SLUG_OVERRIDES if overrides is None else overrides
    cut = r"^(.*)-([^-]*)$"
    slug, tail = F.regexp_extract(card_key, cut, 1), F.regexp_extract(card_key, cut, 2)
    shape = r"^([a-z]+)0*(\d+)(?:\.(\d+))?([a-z]*)$"
    minor = F.regexp_extract(slug, shape, 3)
    general = F.when(slug.rlike(shape), F.concat(
        F.regexp_extract(slug, shape, 1), F.regexp_extract(slug, shape, 2),
        F.when(minor != "", F.concat(F.lit("pt"), minor)).otherwise(F.lit("")),
        F.regexp_extract(slug, shape, 4)))
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    number = F.when(tail.rlike("^[A-Za-z]"), tail) \
              .otherwise(F.coalesce(blank_to_null(strip_zeros(tail)), F.lit("0")))
    return F.when(F.contains(card_key, F.lit("-")),
                  F.concat(F.coalesce(F.try_element_at(known, slug), general), F.lit("-"), number))
