"""The N2 text dialect, electrical attributes of a text, price bases and quotation rates, as column expressions and SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from priceatlas.functions.once import bound
from priceatlas.functions.text import normalize_n1, normalize_n1_sql, normalize_unit, normalize_unit_sql, quoted, rewritten, rewritten_by_signs, round2, round2_sql

# The rewrites of the N2 text dialect, in the order that results depend on; a dot between digits is kept as p meanwhile.
N2_REWRITES = [
    (r"[×*]", " x "),
    (r"\bfr\s*[-_/]?\s*ls\s*h\b", " frlsh "),
    (r"\bfr\s*[-_/]?\s*ls\b", " frls "),
    (r"\bcu\b", " copper "),
    (r"\bal\b", " aluminium "),
    (r"\bun\s*[-_/]?\s*arm(?:ou?red|ored|d)?\.?\b", " unarmoured "),
    (r"\barm(?:ou?red|ored|d)?\.?\b", " armoured "),
    (r"(\d+(?:\.\d+)?)\s*sq\.?\s*mm\s*x\s*(\d+)\s*(?:cores?|c)\b", "$1 sqmm $2 core"),
    (r"(\d+(?:\.\d+)?)\s*sq\.?\s*mm\b", "$1 sqmm"),
    (r"(\d+)\s*(?:cores?|c)\b", "$1 core"),
    (r"(\d+(?:\.\d+)?)\s*(?:mtrs?\.?|met(?:er|re)s?)\b", "$1 mtr"),
    (r"([a-z])(\d)", "$1 $2"),
    (r"(\d)([a-z])", "$1 $2"),
    (r"([0-9a-z.])\s*x\s*([0-9])", "$1 $2"),
    (r"(\d)\.(\d)", "$1p$2"),
    (r"[^a-z0-9]+", " "),
    (r"(\d)p(\d)", "$1.$2"),
]
#: Consecutive rewrites by number (from, to) and what a text must hold for any of them to change it. The last three are asked for by a dot between digits.
N2_SIGNS = [(0, 1, r"[×*]"), (1, 3, r"\bfr"), (3, 5, r"\b(?:cu|al)\b"), (5, 7, r"\b(?:un\s*[-_/]?\s*)?arm"), (7, 11, r"\d\s*(?:sq|c|m)"), (11, 13, r"[a-z]\d|\d[a-z]"), (13, 14, r"x\s*[0-9]")]
# Units that a price may be per, packs, and the kinds of a pack's length.
PER_UNITS, PACKS, PACK_UNITS = "meter|kg|piece|pair|box|set", "coil|roll|bundle", "coil|roll|bundle|box|piece|pair|set"


def normalize_n2(c: Column) -> Column:
    """As normalize_n1: characters beyond ASCII but × become ~, so that Java's plain word boundary serves, and rewrites are asked for by signs."""
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\x00-\x7F×]", "~")
    words, forms = N2_SIGNS[:-2], N2_SIGNS[-2:]
    some = "|".join(sign for _, _, sign in words)
    c = bound(c, lambda text: F.when(text.rlike(some), rewritten_by_signs(text, N2_REWRITES, words)).otherwise(text))
    kept, plain, back = (N2_REWRITES[-3:-2], N2_REWRITES[-2:-1], N2_REWRITES[-1:])

    def parted(text: Column) -> Column:
        # no digit, p and digit stand side by side by now but by a dot between digits
        return F.when(text.rlike(r"\d\.\d"), rewritten(text, [*kept, *plain, *back])).otherwise(rewritten(text, plain))

    return F.trim(bound(bound(c, lambda text: rewritten_by_signs(text, N2_REWRITES, forms)), parted))


def normalize_n2_sql(e: str) -> str:
    e = f"lower(coalesce({e}, ''))"
    for pattern, to in N2_REWRITES:
        e = f"regexp_replace({e}, {quoted(pattern)}, {quoted(to.replace('$', chr(92)))}, 'g')"
    return f"trim({e})"


class _Spark:
    """The few operations that an attribute rule needs, in Spark; _Sql has the same in SQL text, so each rule stands once."""

    @staticmethod
    def has(c, pattern):
        return c.rlike(pattern)  # normalized texts are ASCII

    @staticmethod
    def find(c, pattern, group=1):
        return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))

    @staticmethod
    def case(*branches, other=None):
        out = F.when(F.lit(False), F.lit(None))
        for when, then in branches:
            out = out.when(when, then if isinstance(then, Column) else F.lit(then))
        return out.otherwise(other if isinstance(other, Column) else F.lit(other))

    @staticmethod
    def double(c):
        return c.cast("double")

    @staticmethod
    def either(a, b):
        return F.coalesce(a, b)

    @staticmethod
    def both(a, b):
        return a & b

    @staticmethod
    def any(a, b):
        return a | b

    @staticmethod
    def no(a):
        return ~a

    @staticmethod
    def absent(a):
        return a.isNull()


class _Sql:
    @staticmethod
    def has(c, pattern):
        return f"regexp_matches({c}, {quoted(pattern)})"

    @staticmethod
    def find(c, pattern, group=1):
        return f"nullif(regexp_extract({c}, {quoted(pattern)}, {group}), '')"

    @staticmethod
    def case(*branches, other=None):
        def text(v):
            return "NULL" if v is None else v if v.startswith(("CAST", "nullif", "(")) else quoted(v)

        return "(CASE " + " ".join(f"WHEN {w} THEN {text(t)}" for w, t in branches) + f" ELSE {text(other)} END)"

    @staticmethod
    def double(c):
        return f"CAST({c} AS DOUBLE)"

    @staticmethod
    def either(a, b):
        return f"coalesce({a}, {b})"

    @staticmethod
    def both(a, b):
        return f"(({a}) AND ({b}))"

    @staticmethod
    def any(a, b):
        return f"(({a}) OR ({b}))"

    @staticmethod
    def no(a):
        return f"(NOT ({a}))"

    @staticmethod
    def absent(a):
        return f"(({a}) IS NULL)"


def _attributes(x: type, n, record: bool) -> dict:
    """Attributes of a normalized (N2) text. In a record, a coil or an insulation without cores makes a wire whatever else stands there."""
    size, cores = x.double(x.find(n, r"\b(\d+(?:\.\d+)?)\s+sqmm\b")), x.double(x.find(n, r"\b(\d+)\s+core\b"))
    length = x.double(x.find(n, r"\b(\d+(?:\.\d+)?)\s+mtr\b"))
    insulation = x.case((x.has(n, r"\bfrlsh\b"), "frlsh"), (x.has(n, r"\bfrls\b"), "frls"), (x.has(n, r"\bfr\b"), "fr"))
    cable, wire = x.has(n, r"\b(?:cables?|core|xlpe|armoured|unarmoured|conductor)\b"), x.has(n, r"\b(?:wires?|fr|frls|frlsh|coil|mtr)\b")
    rules = [(x.both(x.both(wire, x.absent(cores)), x.no(cable)), "wire"), (x.any(cable, x.no(x.absent(cores))), "cable"), (wire, "wire")]
    if record:
        rules.insert(0, (x.both(x.no(x.both(x.absent(length), x.absent(insulation))), x.absent(cores)), "wire"))
    return {
        "size": size, "cores": cores, "length": length, "insulation": insulation,
        "conductor": x.case((x.has(n, r"\bcopper\b"), "copper"), (x.has(n, r"\baluminium\b"), "aluminium")),
        "cable_type": x.case((x.has(n, r"\bunarmoured\b"), "unarmoured"), (x.has(n, r"\barmoured\b"), "armoured")),
        "category": x.case(*rules),
    }


def electrical(normal: Column, record: bool = False) -> dict[str, Column]:
    """size, cores, length, insulation, conductor, cable_type, category of an N2 text; null where it tells nothing."""
    return _attributes(_Spark, normal, record)


def electrical_sql(normal: str, record: bool = False) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in _attributes(_Sql, normal, record).items())


def _basis(x: type, n, unit) -> dict:
    number = r"\b(\d+(?:\.\d+)?)\s*"
    per = rf"\bper\s+(\d+(?:\.\d+)?)\s*({PER_UNITS})\b"
    length, pack = rf"{number}(meter)\s*\.?\s*({PACKS})\b", rf"{number}({PACK_UNITS})\b"
    is_per, is_length, is_pack = x.has(n, per), x.has(n, length), x.has(n, pack)
    quantity = x.double(x.case((is_per, x.find(n, per)), (is_length, x.find(n, length)), (is_pack, x.find(n, pack)), other="1"))
    basis = x.case((is_per, x.find(n, per, 2)), (is_length, "meter"), (is_pack, x.find(n, pack, 2)), other=unit)
    basis = x.either(basis, x.case((x.both(x.has(n, "meter"), x.no(x.any(x.any(is_per, is_length), is_pack))), "meter")))
    return {"quantity": quantity, "basis": basis, "pack": x.case((x.both(is_length, x.no(is_per)), x.find(n, length, 3)))}


def price_basis(price: Column, unit: Column, context: Column) -> Column:
    """struct(quantity, unit, pack_unit, label, unit_price): what a price is for, from the N1 text of everything around it.

    First `per <n> <unit>`, then `<n> meter <pack>`, then `<n> <pack>`, else the given unit or a mention of metres. A quantity of 0 counts as 1.
    A known roll is named coil, as units are normalized.
    """
    given = normalize_unit(normalize_n1(unit))
    told = lambda n, g: F.struct(*[c.alias(k) for k, c in _basis(_Spark, n, g).items()])
    found = bound(normalize_n1(F.concat_ws(" ", unit, context)), lambda n: bound(given, lambda g: told(n, g)))
    return bound(found, lambda b: _priced(price, b))


def _priced(price: Column, b: Column) -> Column:
    q = F.when(b["quantity"] > 0, b["quantity"]).otherwise(F.lit(1.0))
    basis, pack = F.replace(b["basis"], F.lit("roll"), F.lit("coil")), F.replace(b["pack"], F.lit("roll"), F.lit("coil"))
    label = F.concat(F.when(q == 1, "").otherwise(F.concat(F.regexp_replace(q.cast("string"), r"\.0$", ""), F.lit(" "))), basis, F.coalesce(F.concat(F.lit(" "), pack), F.lit("")))
    per = F.when(basis.isNull(), price).otherwise(round2(price / q))
    return F.struct(q.alias("quantity"), basis.alias("unit"), pack.alias("pack_unit"), label.alias("label"), per.alias("unit_price"))


def price_basis_sql(price: str, unit: str, context: str) -> str:
    """A SELECT list over the row's columns; nested queries keep every expression once."""
    n = normalize_n1_sql(f"concat_ws(' ', {unit}, {context})")
    given = normalize_unit_sql(normalize_n1_sql(unit))
    b = _basis(_Sql, "n", "(g)")
    label = "CASE WHEN q = 1 THEN '' ELSE regexp_replace(CAST(q AS VARCHAR), '\\.0$', '') || ' ' END || u || coalesce(' ' || k, '')"
    return f"""SELECT *, {label} AS label, CASE WHEN u IS NULL THEN p ELSE {round2_sql('p / q')} END AS unit_price FROM (
SELECT *, CASE WHEN quantity > 0 THEN quantity ELSE 1 END AS q, replace(basis, 'roll', 'coil') AS u, replace(pack, 'roll', 'coil') AS k FROM (
SELECT *, {', '.join(f'{v} AS {k}' for k, v in b.items())} FROM (SELECT *, {price} AS p, {n} AS n, {given} AS g FROM src)))"""


def quotation_rate(price: Column, basis: Column, quantity: Column, unit: Column) -> Column:
    """struct(qty, unit, unit_price): the line for a requested quantity; packs at the pack's price, the basis unit at its unit price, all else as listed."""
    qty = F.when(quantity > 0, quantity.cast("double")).otherwise(F.lit(1.0))
    return bound(normalize_unit(normalize_n1(unit)), lambda asked: _rate(price, basis, qty, asked))


def _rate(price: Column, basis: Column, qty: Column, asked: Column) -> Column:
    packs = asked.isin(*PACKS.split("|")) & basis["pack_unit"].isNotNull()
    same = asked == basis["unit"]
    name = F.when(packs, F.when(asked == "bundle", asked).otherwise(basis["pack_unit"])).when(same, asked).otherwise(F.coalesce(basis["label"], basis["unit"], asked))
    return F.struct(qty.alias("qty"), name.alias("unit"), F.when(packs, price).when(same, basis["unit_price"]).otherwise(price).alias("unit_price"))
