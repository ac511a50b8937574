"""Name, code and handle expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from cardloom.functions.numbers import blank_to_null

# Name tokens that are card mechanics or forms, not part of a species.
SUFFIX_TOKENS = ("ex", "gx", "v", "vmax", "vstar", "break", "star")
PREFIX_TOKENS = ("radiant", "tera", "alolan", "galarian", "hisuian", "paldean", "origin",
                 "therian", "incarnate", "bloodmoon", "forme", "shiny", "dark", "light")
# Slugs whose display name is not their title-cased words.
SLUG_NAMES = {
    "mr-mime": "Mr. Mime", "mime-jr": "Mime Jr.", "mr-rime": "Mr. Rime",
    "farfetchd": "Farfetch'd", "sirfetchd": "Sirfetch'd", "ho-oh": "Ho-Oh",
    "porygon-z": "Porygon-Z", "nidoran-f": "Nidoran♀", "nidoran-m": "Nidoran♂",
    "flabebe": "Flabébé", "type-null": "Type: Null", "jangmo-o": "Jangmo-o",
    "hakamo-o": "Hakamo-o", "kommo-o": "Kommo-o", "wo-chien": "Wo-Chien",
    "chien-pao": "Chien-Pao", "ting-lu": "Ting-Lu", "chi-yu": "Chi-Yu",
}


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility decompositions without combining marks, by the rule and not by a list: code
    points that become one letter or digit of ASCII, as two aligned strings, and those that
    become several characters with one among them, as a map."""
    one_from, one_to, several = [], [], {}
    for code in range(0x80, 0x20000):
        full = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if full == chr(code) or not any(c.isascii() and c.isalnum() for c in full):
            continue
        if len(full) == 1:
            one_from.append(chr(code))
            one_to.append(full)
        else:
            several[chr(code)] = full
    return "".join(one_from), "".join(one_to), several


_FROM, _TO, _SEVERAL = _fold_tables()
_SEVERAL_KEYS = "".join(_SEVERAL)


def fold_accents(c: Column) -> Column:
    """Letters and digits by full compatibility decomposition, combining marks dropped; stays
    JVM-side. Only strings with a character that becomes several are walked by character."""
    table = F.map_from_arrays(F.array(*[F.lit(k) for k in _SEVERAL]), F.array(*[F.lit(v) for v in _SEVERAL.values()]))
    walked = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    c = F.when(F.length(F.translate(c, _SEVERAL_KEYS, "")) < F.length(c), walked).otherwise(c)
    return F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{M}+", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_name(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    for symbol, word in (("♀", " f"), ("♂", " m")):
        c = F.replace(c, F.lit(symbol), F.lit(word))
    c = F.regexp_replace(c, "[★☆◇]", "")
    return squeeze(F.regexp_replace(F.lower(fold_accents(c)), "[^a-z0-9 ]+", " "))


def alnum_key(c: Column) -> Column:
    c = F.replace(F.replace(F.lower(c), F.lit("♀"), F.lit("f")), F.lit("♂"), F.lit("m"))
    return F.regexp_replace(F.lower(fold_accents(c)), "[^a-z0-9]", "")


def species_key(name: Column) -> Column:
    """Lookup key of the species part of a card name; NULL when nothing is left.

    Join it to a species dimension; a key that is not there is not a species."""
    tail = r"(?i)(?:(?:^|\s+)(?:" + "|".join(SUFFIX_TOKENS) + r"))+\s*$"
    head = r"(?i)^\s*(?:(?:" + "|".join(PREFIX_TOKENS) + r")(?:\s+|$))+"
    c = F.regexp_replace(F.trim(name), r"\s*\([^)]*\)\s*$", "")
    c = F.split_part(c, F.lit("&"), F.lit(1))
    c = F.regexp_replace(F.regexp_replace(c, tail, ""), r"(?i)(?:^|\s+)prism\s*$", "")
    c = F.trim(F.regexp_replace(c, head, ""))
    c = F.regexp_replace(c, r"(?i)^\S+[’']s\s+", "")
    return blank_to_null(alnum_key(c))


def set_name_key(c: Column) -> Column:
    """Casefolded, '&' as 'and', alphanumerics only."""
    return F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit("and")),
                            r"[^\p{L}\p{N}]", "")


def set_name_words(c: Column) -> Column:
    """The space-keeping variant."""
    c = F.replace(F.lower(c), F.lit("&"), F.lit(" and "))
    return squeeze(F.regexp_replace(c, r"[^a-z0-9\s]", " "))


def sanitize_query(c: Column, longest: int = 120) -> Column:
    """Search fragment; NULL when fewer than two characters survive."""
    q = F.substring(squeeze(F.regexp_replace(c, r"[^\p{L}\p{N}_\s\-/]", " ")), 1, longest)
    return F.when(F.length(q) >= 2, q)


def normalize_handle(c: Column) -> Column:
    return F.lower(F.trim(c))


def handle_valid(c: Column) -> Column:
    return normalize_handle(c).rlike(r"^[a-z0-9_]{3,20}$")


def is_stage_label(c: Column) -> Column:
    letters = F.regexp_replace(F.lower(c), "[^a-z]", "")
    return letters.rlike("^(basic$|stage|tage)")


def is_noise_name(c: Column) -> Column:
    t = F.trim(c)
    return is_stage_label(c) | (t == "HP") | t.rlike(r"^\d+$")


def display_from_slug(c: Column, exceptions: dict[str, str] | None = None) -> Column:
    table = SLUG_NAMES if exceptions is None else exceptions
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(known, c), F.initcap(F.replace(c, F.lit("-"), F.lit(" "))))


def live_identity_key(set_code: Column, set_name: Column, number: Column, name: Column) -> Column:
    """set : number-or-name, NULL when there is no evidence at all ('' is missing)."""
    left = F.coalesce(blank_to_null(set_code), blank_to_null(set_name))
    right = F.coalesce(blank_to_null(number), blank_to_null(normalize_name(name)))
    return F.when(left.isNotNull() | right.isNotNull(),
                  F.concat(F.coalesce(left, F.lit("?")), F.lit(":"),
                           F.coalesce(right, F.lit("unknown"))))


def saved_identity_key(set_code: Column, set_name: Column, number: Column, name: Column) -> Column:
    left = F.coalesce(blank_to_null(set_code), blank_to_null(set_name), F.lit("?"))
    return F.concat(left, F.lit(":"), F.coalesce(blank_to_null(number), normalize_name(name)))


def is_degenerate_key(key: Column) -> Column:
    """Nothing after the last colon, or the literal no-evidence key."""
    return (F.element_at(F.split(key, ":"), -1) == "") | (key == "?:unknown")


def short_grams(c: Column) -> Column:
    """All distinct substrings of one to three characters: any text holding a needle
    holds the needle's first three characters, so containment becomes an equi join."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c)))
    return F.array_distinct(F.flatten(F.transform(
        at, lambda i: F.array(*[F.substr(c, i, F.lit(n)) for n in (1, 2, 3)]))))
