"""Text functions of the catalogue search, as column expressions, and their SQL for the oracle."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from priceatlas.functions.once import bound

# The rewrites of the N1 text dialect, in the order that results depend on (\b: a boundary of ASCII words).
N1_REWRITES = [
    (r"[×*]", " x "),
    (r"\bfr\s*[-_/]?\s*ls\s*h\b", " frlsh "),
    (r"\bfr\s*[-_/]?\s*ls\b", " frls "),
    (r"\bcabels?\b", " cable "),
    (r"\bscensior\b", " sensor "),
    (r"\bsq\.?\s*mm\b", " sqmm "),
    (r"\bmtrs?\.?\b", " meter "),
    (r"\b(\d+(?:\.\d+)?)\s*m\b", "$1 meter"),
    (r"\bmetres?\b", " meter "),
    (r"\bmeters?\b", " meter "),
    (r"\bnos?\.?\b", " piece "),
    (r"\bpcs?\.?\b", " piece "),
    (r"\bcopers?\b", " copper "),
    (r"\bcoppers?\b", " copper "),
    (r"\bbdls?\b", " bundle "),
    (r"\bbundles?\b", " bundle "),
    (r"\bcu\b", " copper "),
    (r"\bal\b", " aluminium "),
    (r"\bun\s*[-_/]?\s*arm(?:ou?red|ored|d)?\.?\b", " unarmoured "),
    (r"\barm(?:ou?red|ored|d)?\.?\b", " armoured "),
    (r"(\d+(?:\.\d+)?)\s*sqmm\s*x\s*(\d+(?:\.\d+)?)\s*(?:cores?|c)\b", "$1 sqmm $2 core"),
    (r"(\d+(?:\.\d+)?)\s*(?:cores?|c)\b", "$1 core"),
    (r"([a-z])(\d)", "$1 $2"),
    (r"(\d)([a-z])", "$1 $2"),
    (r"([0-9a-z])\s+x\s+([0-9])", "$1 $2"),
    (r"[^a-z0-9.]+", " "),
]
#: Consecutive rewrites by number (from, to) and what a text must hold for any of them to change it; the rest are asked for only where it does.
N1_SIGNS = [
    (0, 1, r"[×*]"), (1, 6, r"\b(?:fr|cabel|scensior|sq)"), (6, 10, r"\bm(?:tr|et)|\d\s*m"), (10, 12, r"\b(?:nos?|pcs?)\b"), (12, 18, r"\b(?:cop|bdl|bundle|cu\b|al\b)"),
    (18, 20, r"\b(?:un\s*[-_/]?\s*)?arm"), (20, 22, r"\d\s*(?:sqmm|c)"), (22, 24, r"[a-z]\d|\d[a-z]"), (24, 25, r"\sx\s"),
]
# Words that tokens leave out, and unit words by unit, in the order of their precedence.
STOP_WORDS = "a about all and any available by can for from give how in is list of please price prices rate rates show the to what with".split()
UNIT_WORDS = [
    ("bundle", "bundle"), ("bag", "bag"), ("case", "case"), ("coil", "coil|roll"), ("meter", "meter|mtr|mtrs"),
    ("piece", "piece|pc|pcs|no|nos|number|numbers"), ("kg", "kg|kilogram"), ("box", "box|boxes"), ("litre", "ltr|ltrs|litre|litres|liter|liters"),
    ("packet", "pkt|packet|packets"), ("pair", "pair"), ("set", "set"), ("sqft", "sqft|sq ft|square feet|square foot"),
    ("sqm", "sqm|sq m|square meters?|square metres?"), ("tin", "tin"), ("ton", "ton"), ("unit", "unt|unit|units"), ("dozen", "dozens?"),
]
PRICE_WORDS = "rs|inr|mrp|rate|each|ea|pc|pcs|nos?|numbers?|mtr|meter|kg|kilograms?|box|boxes|bag|case|coil|roll|packet|pkt|set|tin|ton|dozen|ltr|litres?|liters?|per"

_W = "[A-Za-z0-9_]"
_EDGE = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def ascii_words(pattern: str) -> str:
    """Java's word boundary knows more letters than ASCII; the dialects do not."""
    return pattern.replace(r"\b", _EDGE)


def ascii_only(c: Column) -> Column:
    """c with ~ for each character beyond ASCII: Java's plain word boundary, much faster than looking around, knows ASCII words alone there."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.regexp_replace(c, r"[^\x00-\x7F]", "~"))


def has_words(c: Column, pattern: str) -> Column:
    r"""Whether c matches a pattern of ASCII characters, in which \b is a boundary of ASCII words."""
    return bound(c, lambda c: ascii_only(c).rlike(pattern))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rewritten(text: Column, rewrites: list[tuple[str, str]]) -> Column:
    for pattern, to in rewrites:
        text = F.regexp_replace(text, pattern, to)
    return text


def rewritten_by_signs(text: Column, rewrites: list[tuple[str, str]], signs: list[tuple[int, int, str]]) -> Column:
    """The rewrites in their order, those of a sign (from, to, what a text must hold for any of them to change it) only where the text then holds it."""
    if not signs:
        return text
    first, last, sign = signs[0]
    return bound(F.when(text.rlike(sign), rewritten(text, rewrites[first:last])).otherwise(text), lambda done: rewritten_by_signs(done, rewrites, signs[1:]))


def normalize_n1(c: Column) -> Column:
    """No rewrite keeps or asks for a character beyond ASCII but ×. The others become ~ first, so that Java's plain word boundary, much faster than looking around, knows ASCII words alone."""
    c = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("\u00a0"), F.lit(" "))
    c = F.regexp_replace(c, r"[^\x00-\x7F×]", "~")
    words, forms = N1_SIGNS[:-2], N1_SIGNS[-2:]
    # most texts hold no sign of any word, which one look tells
    some = "|".join(sign for _, _, sign in words)
    c = bound(c, lambda text: F.when(text.rlike(some), rewritten_by_signs(text, N1_REWRITES, words)).otherwise(text))
    return F.trim(rewritten(bound(c, lambda text: rewritten_by_signs(text, N1_REWRITES, forms)), N1_REWRITES[forms[-1][1]:]))


def normalize_n1_sql(e: str) -> str:
    e = f"replace(lower(coalesce({e}, '')), chr(160), ' ')"
    for pattern, to in N1_REWRITES:
        e = f"regexp_replace({e}, {quoted(pattern)}, {quoted(to.replace('$', chr(92)))}, 'g')"
    return f"trim({e})"


def compact(c: Column) -> Column:
    return F.regexp_replace(normalize_n1(c), "[^a-z0-9.]+", "")


def unique_text(values: Column) -> Column:
    """White space squeezed, empty values left out, the first of values equal but for case kept."""
    clean = F.filter(F.transform(values, lambda v: F.trim(F.regexp_replace(F.coalesce(v, F.lit("")), r"\s+", " "))), lambda v: v != "")
    first = lambda all_, low: F.filter(all_, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)
    return bound(clean, lambda all_: bound(F.transform(all_, F.lower), lambda low: first(all_, low)))


def unique_text_sql(values: str) -> str:
    clean = f"list_filter(list_transform({values}, lambda v: trim(regexp_replace(coalesce(v, ''), '\\s+', ' ', 'g'))), lambda v: v <> '')"
    return f"list_filter({clean}, lambda v, i: list_position(list_transform({clean}, lambda u: lower(u)), lower(v)) = i)"


def tokens(normal: Column) -> Column:
    """Distinct words of a normalized text, in order, without stop words and single letters."""
    words = F.filter(F.split(normal, " "), lambda w: (w != "") & ~w.isin(STOP_WORDS) & ((F.length(w) >= 2) | w.rlike("^[0-9]$")))
    return F.array_distinct(words)


def tokens_sql(normal: str) -> str:
    stop = ", ".join(map(quoted, STOP_WORDS))
    words = f"list_filter(string_split({normal}, ' '), lambda w: w <> '' AND w NOT IN ({stop}) AND (length(w) >= 2 OR regexp_matches(w, '^[0-9]$')))"
    return f"list_filter({words}, lambda w, i: list_position({words}, w) = i)"


def parse_price(c: Column) -> Column:
    """Price number or null: currency signs, separators and unit words go first, then all but digits, dot and minus."""
    c = F.regexp_replace(c, r"[₹$€,\s]", "")
    # what is not ASCII goes in the end anyway
    without = lambda c: F.when(c.rlike("[A-Za-z]"), F.regexp_replace(ascii_only(c), rf"(?i)\b(?:{PRICE_WORDS})\b", "")).otherwise(c)
    return F.regexp_replace(bound(c, without), r"[^\d.\-]", "").try_cast("double")


def parse_price_sql(e: str) -> str:
    e = f"regexp_replace({e}, '[₹$€,\\s]', '', 'g')"
    e = f"regexp_replace({e}, {quoted(f'(?i)' + chr(92) + f'b(?:{PRICE_WORDS})' + chr(92) + 'b')}, '', 'g')"
    return f"TRY_CAST(regexp_replace({e}, '[^\\d.\\-]', '', 'g') AS DOUBLE)"


def normalize_unit(normal: Column) -> Column:
    def named(text: Column) -> Column:
        out = F.when(text == "", F.lit(None))
        for unit, words in UNIT_WORDS:
            out = out.when(text.rlike(rf"\b(?:{words})\b"), unit)
        return out

    return bound(normal, lambda whole: bound(ascii_only(whole), lambda text: named(text).otherwise(whole)))


def normalize_unit_sql(normal: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({normal}, {quoted(chr(92) + f'b(?:{w})' + chr(92) + 'b')}) THEN {quoted(u)}" for u, w in UNIT_WORDS)
    return f"CASE WHEN {normal} = '' THEN NULL {cases} ELSE {normal} END"


def trigrams(c: Column) -> Column:
    """Distinct three-letter groups of the words of letters and digits, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def trigrams_sql(e: str) -> str:
    words = f"list_filter(string_split(regexp_replace(lower({e}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def round2(c: Column) -> Column:
    """Two decimals, halves upwards, as money is rounded everywhere."""
    return F.floor(c * 100 + 0.5) / 100


def round2_sql(e: str) -> str:
    return f"(floor(({e}) * 100 + 0.5) / 100)"


def slug(c: Column) -> Column:
    """Lower-case letters and digits joined by single hyphens, for file names."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def slug_sql(e: str) -> str:
    return f"trim(regexp_replace(lower({e}), '[^a-z0-9]+', '-', 'g'), '-')"


def format_inr(c: Column) -> Column:
    """Rupees with two decimals and Indian grouping: three digits, then pairs (12,34,567.80). Null stays null."""
    paise = F.floor(F.abs(c) * 100 + 0.5).cast("long")
    whole = F.floor(paise / 100).cast("long").cast("string")
    head = F.reverse(F.trim(F.regexp_replace(F.reverse(F.substring(whole, F.lit(1), F.length(whole) - 3)), "([0-9]{2})", "$1,"), F.lit(",")))
    grouped = F.when(F.length(whole) <= 3, whole).otherwise(F.concat(head, F.lit(","), F.right(whole, F.lit(3))))
    return F.concat(F.when(c < 0, "-").otherwise(""), F.lit("₹"), grouped, F.lit("."), F.lpad((paise % 100).cast("string"), 2, "0"))


def format_inr_sql(e: str) -> str:
    paise = f"CAST(floor(abs({e}) * 100 + 0.5) AS BIGINT)"
    whole = f"CAST({paise} // 100 AS VARCHAR)"
    head = f"reverse(trim(regexp_replace(reverse(substr({whole}, 1, length({whole}) - 3)), '([0-9][0-9])', '\\1,', 'g'), ','))"
    return f"(CASE WHEN {e} < 0 THEN '-' ELSE '' END || '₹' || CASE WHEN length({whole}) <= 3 THEN {whole} ELSE {head} || ',' || right({whole}, 3) END || '.' || lpad(CAST({paise} % 100 AS VARCHAR), 2, '0'))"
