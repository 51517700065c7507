"""Item names parsed, scored against the catalogue's names and ranked by five keys; the SQL of the parse, the score and the ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priceatlas.functions.stored import stored
from priceatlas.functions.text import normalize_n1, normalize_n1_sql, normalize_unit_sql, quoted, tokens_sql
from priceatlas.operators import engine
from priceatlas.operators.engine import ITEMS, WEIGHTS, items, parse_queries, score_candidates
from priceatlas.operators.search import CAP, MATCHED, NEAR, REVIEW

#: What score_candidates reads of a query and of a candidate (hints without their raw text).
OF_QUERY = ["normalized", "hints", "terms", "search_terms", "query_identity", "query_numbers", "requested_unit", "vendor_terms", "alias_confidence"]
OF_CANDIDATE = [*(f"_{t}" for t in ["searchable", "rows", "columns", "parents", "title", "section", "vendor", "id", "all", "unit", "ci", "not_price"]), "price", "page", "confidence", "recall", "recency", "duplicate", "attributes"]
#: Parts of a size or term, so that no task holds all candidates of a hot one against all its queries.
SALTS = 16
#: Places of a ranking.
PLACES = 5
#: Rows a task of costly expressions: at least, where there are tasks for all cores, and at most.
FEW, MANY = 200, 50_000


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parse of every distinct item name as a query."""
    rows = parse_queries(spread(stored(items(spark, sf_dir).select(F.col("name").alias("query")).distinct(), "item-names")))
    hints = F.array_join(F.transform("hints", lambda h: F.concat_ws(":", h["name"], h["value"].cast("string"))), ",")
    asked = F.array_join(F.transform("requested", lambda r: F.concat_ws(":", r["value"].cast("string"), r["unit"])), ",")
    return rows.select("query", "normalized", "match", asked.alias("requested"), hints.alias("hints"), F.array_join("terms", ",").alias("terms"), "requested_unit", "intent")


def spread(rows: DataFrame) -> DataFrame:
    """rows (a stored table) over as many tasks as their number asks for: their bytes, by which tasks are joined otherwise, say little of the work."""
    n = rows.count()
    return rows.repartition(max(1, -(-n // MANY), min(-(-n // FEW), 4 * rows.sparkSession.sparkContext.defaultParallelism)))


def _size(hints: str) -> Column:
    return F.try_element_at(F.filter(hints, lambda h: h["name"] == "size"), F.lit(1))["value"]


def _class(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def query_classes(queries: DataFrame) -> DataFrame:
    """The columns of parse_queries' rows with hints without raw text, q_class and q_size: queries of one class score alike everywhere."""
    plain = F.transform("hints", lambda h: F.struct(*[h[k].alias(k) for k in ["name", "value", "unit", "plain", "phrase", "normal"]]))
    return queries.withColumn("hints", plain).withColumn("q_class", _class(OF_QUERY)).withColumn("q_size", _size("hints"))


def candidate_classes(rows: DataFrame) -> DataFrame:
    """The columns of engine.candidates(rows) with c_class and c_size; attributes keep name, value and unit, and any price above 0 counts as 1."""
    plain = F.transform("attributes", lambda a: F.struct(*[a[k].alias(k) for k in ["name", "value", "unit"]]))
    priced = F.when(F.col("price") > 0, 1.0).when(F.col("price").isNotNull(), 0.0)
    made = engine.candidates(rows).withColumn("attributes", plain).withColumn("own_price", F.col("price")).withColumn("price", priced)
    return made.withColumn("c_class", _class(OF_CANDIDATE)).withColumn("c_size", _size("attributes"))


def scored_classes(queries: DataFrame, candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """q_class, c_class, score, label of pairs (q_class, c_class, distinct)."""
    q, c = (rows.select(k, *columns).dropDuplicates([k]) for rows, k, columns in [(queries, "q_class", OF_QUERY), (candidates, "c_class", OF_CANDIDATE)])
    return score_candidates(spread(stored(pairs, "class-pairs")).join(q, "q_class").join(c, "c_class")).select("q_class", "c_class", "score", "label")


def meet(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The rows of left and right that agree in key; those of a key are dealt to SALTS parts by q_class, right (the classes of candidates) goes to each."""
    dealt = left.withColumn("salt", F.pmod(F.xxhash64("q_class"), F.lit(SALTS)).cast("int"))
    return dealt.join(right.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))), [key, "salt"]).drop("salt")


def by_size(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """q_class, c_class that agree in size."""
    q = queries.select("q_class", F.col("q_size").alias("size")).where("size IS NOT NULL").distinct()
    c = candidates.select("c_class", F.col("c_size").alias("size")).where("size IS NOT NULL").distinct()
    return meet(q, c, "size").select("q_class", "c_class")


def by_rarest_term(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """q_class, c_class where the candidate's identity holds the rarest of the query's terms that any holds (ties: the first by spelling)."""
    postings = candidates.select("c_class", F.explode("_ci").alias("term")).distinct()
    often = postings.groupBy("term").agg(F.count(F.lit(1)).alias("often"))
    asked = queries.select("q_class", F.explode("search_terms").alias("term")).distinct().join(often, "term")
    first = asked.groupBy("q_class").agg(F.min(F.struct("often", "term"))["term"].alias("term"))
    return meet(first, postings, "term").select("q_class", "c_class")


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries (distinct names) and candidates (distinct names and units; the least id and price, the latest day) of the items, with their classes."""
    day = F.col("id") % 28
    rows = items(spark, sf_dir).groupBy("name", "unit").agg(F.count(F.lit(1)).alias("items"), F.min("price").alias("price"), F.min("id").alias("id"), F.max(day).alias("uploaded"))
    names = spread(stored(rows.select(F.col("name").alias("query")).distinct(), "item-names"))
    names = stored(parse_queries(names), "item-queries")
    q = names.withColumn("vendor_terms", F.array().cast("array<string>")).withColumn("alias_confidence", F.lit(None).cast("double"))
    own = rows.join(names.select(F.col("query").alias("name"), F.col("hints").alias("attributes")), "name").withColumnRenamed("name", "candidate")
    none, name = F.lit(None).cast("string"), F.col("candidate")
    own = spread(stored(own, "item-rows"))
    own = own.select("*", *[name.alias(c) for c in ["searchable", "product", "description", "rows"]], *[none.alias(c) for c in ["sku", "columns", "parents", "title", "section", "vendor", "raw_cell"]], F.lit(1).alias("page"), F.lit(0.9).alias("confidence"), F.lit(0.82).alias("recall"), F.lit(0.0).alias("recency"), (F.col("items") > 1).alias("duplicate"))
    return query_classes(q), stored(candidate_classes(own), "item-candidates")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, candidate, items, score, label: distinct names as queries against the distinct names of the same size (recall by attribute).

    Names that read alike are scored once; the scores are then joined back to the names.
    """
    q, c = _both(spark, sf_dir)
    scores = stored(scored_classes(q, c, by_size(q, c)), "class-scores")
    return scores.join(q.select("query", "q_class"), "q_class").join(c.select("candidate", "unit", "items", "c_class"), "c_class").select("query", "candidate", "unit", "items", "score", "label")


def rank_candidates(scores: DataFrame, places: int = PLACES) -> DataFrame:
    """query, rank, candidate, score, label, capped of scores (query, candidate, unit, normal, score, specific, confidence, uploaded, id): the `places` best.

    Order: score, fewest identity words (specific), confidence, latest day (none last), id. Where the best reaches MATCHED and n others of another text do too
    within NEAR of it, the first n + 1 are capped at CAP, and all go by score, identity words and id again.
    """
    w = Window.partitionBy("query").orderBy(F.desc("score"), "specific", F.desc("confidence"), F.desc_nulls_last("uploaded"), "id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = scores.select("*", F.row_number().over(w).alias("place"), F.first("score").over(whole).alias("best"), F.first("normal").over(whole).alias("best_normal"))
    near = (F.col("best") >= MATCHED) & (F.col("score") >= MATCHED) & (F.col("best") - F.col("score") <= NEAR) & (F.col("normal") != F.col("best_normal"))
    rows = rows.withColumn("ties", F.sum(near.cast("int")).over(whole))
    capped = (F.col("ties") > 0) & (F.col("place") <= F.col("ties") + 1)
    rows = rows.withColumn("capped", capped).withColumn("score", F.when(capped, F.least("score", F.lit(CAP))).otherwise(F.col("score")))
    again = [F.desc("score"), F.col("specific"), F.col("id")]
    order = [F.when(F.col("ties") > 0, F.lit(0)).otherwise(F.col("place")), *again]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= places)
    label = F.when(F.col("score") >= MATCHED, "Matched").when(F.col("score") >= REVIEW, "Needs review").otherwise("Not reliable enough")
    return rows.select("query", "rank", "candidate", "unit", "score", label.alias("label"), "capped")


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking of every query's candidates, recalled by size or by the rarest term.

    All queries of a class have one ranking, worked out once: a class meets candidates' names, not queries' names.
    """
    q, c = _both(spark, sf_dir)
    pairs = by_size(q, c).union(by_rarest_term(q, c)).distinct()
    scores = stored(scored_classes(q, c, pairs), "ranking-scores")
    own = c.select("c_class", "candidate", "unit", normalize_n1(F.col("description")).alias("normal"), F.size("_ci").alias("specific"), "confidence", "uploaded", "id")
    best = rank_candidates(scores.join(own, "c_class").withColumnRenamed("q_class", "query")).withColumnRenamed("query", "q_class")
    return q.select("query", "q_class").join(best, "q_class").drop("q_class")


def _rewritten(e: str, rewrites: list[tuple[str, str]]) -> str:
    return reduce(lambda s, r: f"regexp_replace({s}, {quoted(r[0])}, {quoted(r[1].replace('$', chr(92)))}, 'g')", rewrites, e)


def _listed(words: list[str]) -> str:
    return ", ".join(map(quoted, words))


def _unit_sql(e: str) -> str:
    """As a list expression: the unit of each u in the list e of (raw, u)."""
    u = f"list_transform({e}, lambda x: {{'raw': x.raw, 'u': replace(lower(x.u), '.', '')}})"
    named = r"CASE WHEN regexp_matches(x.u, '^sq\s*mm$') THEN 'sqmm' WHEN regexp_matches(x.u, '^(?:m|met(?:er|re)s?|mtrs?)$') THEN 'meter' WHEN regexp_matches(x.u, '^(?:c|cores?)$') THEN 'core' WHEN regexp_matches(x.u, '^sq\s*ft$') THEN 'sqft' WHEN regexp_matches(x.u, '^sq\s*m$') THEN 'sqm' WHEN x.u = 'bdl' THEN 'bundle' ELSE x.u END"
    single = f"regexp_replace({named}, '^(box|piece|coil|roll|pair|set|bag|case|tin|ton|bundle|bdl|kilogram)(?:es|s)$', '\\1')"
    return f"list_transform(list_transform({u}, lambda x: {{'raw': x.raw, 'u': {single}}}), lambda x: {{'raw': x.raw, 'u': {normalize_unit_sql('x.u')}}})"


def _raws(e: str, pattern: str) -> str:
    """(raw, u) of each match: u is what follows the number."""
    return f"list_transform(regexp_extract_all({e}, {quoted(pattern)}), lambda r: {{'raw': r, 'u': trim(regexp_replace(r, '^(\\d+(?:\\.\\d+)?)', ''))}})"


def _value(raw: str) -> str:
    return f"CAST(regexp_extract({raw}, '(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE)"


def _identity_sql(text: str) -> str:
    found = f"list_filter({tokens_sql(text)}, lambda t: t NOT IN ({_listed(engine.NO_IDENTITY)}))"
    keys = f"list_transform({found}, lambda t: regexp_replace(t, '^0+(\\d)', '\\1'))"
    return f"list_filter({found}, lambda t, i: list_position({keys}, regexp_replace(t, '^0+(\\d)', '\\1')) = i)"


_SOLD = rf"(?i)\b(?:\d+(?:\.\d+)?)\s*(?:{engine.SALES})\b"
_HINT = rf"(?i)(?:\d+(?:\.\d+)?)\s*(?:{engine.MEASURES}|{engine.SALES})\b"
_PER = rf"(?i)\bper\s+({engine.MEASURES}|{engine.SALES})\b"
_KEYS = "list_transform(asked, lambda y: y.raw || chr(1) || coalesce(y.u, chr(2)))"
#: CTEs up to p: query and the parse; hints are (name, value, unit, plain, phrase, normal).
PARSE = f"""names AS (SELECT DISTINCT name AS query FROM ({ITEMS})),
e0 AS (SELECT query, {_rewritten('query', engine.COMPACT)} AS e, regexp_matches(query, {quoted(engine.IS_ELECTRICAL)}) AND NOT regexp_matches(query, '(?i)\\b(?:telephone|jelly|pair)\\b') AS electrical FROM names),
e1 AS (SELECT query, CASE WHEN electrical THEN {_rewritten('e', engine.COMPACT_ELECTRICAL)} ELSE e END AS e FROM e0),
e2 AS (SELECT query, e, {normalize_n1_sql('e')} AS normalized, {_unit_sql(_raws('e', _SOLD))} AS sold, regexp_extract_all(e, '(?i)\\b(?:qty|quantity)\\s*[:#-]?\\s*(?:\\d+(?:\\.\\d+)?)\\b') AS quantity, regexp_extract_all(e, '(?i)\\b(?:\\d+(?:\\.\\d+)?)\\s*(?:meter|mtrs?\\.?|met(?:er|re)s?)\\b') AS metres FROM e1),
e3 AS (SELECT *, regexp_matches(normalized, '\\b(?:armoured|cable|copper|aluminium)\\b') AND NOT regexp_matches(normalized, '\\b(?:fr|frls|frlsh|hffr|zhfr)\\b') AS by_metre, regexp_matches(e, '(?i)\\b(?:telephone|jelly|cables?)\\b') AS paired FROM e2),
e4 AS (SELECT query, e, normalized, list_concat(list_filter(sold, lambda x: NOT (x.u = 'pair' AND paired)), list_transform(quantity, lambda r: {{'raw': r, 'u': CAST(NULL AS VARCHAR)}}), CASE WHEN by_metre THEN list_transform(metres, lambda r: {{'raw': r, 'u': 'meter'}}) ELSE [] END) AS asked FROM e3),
e5 AS (SELECT query, e, normalized, list_filter(asked, lambda x, i: list_position({_KEYS}, x.raw || chr(1) || coalesce(x.u, chr(2))) = i) AS requested FROM e4),
e6 AS (SELECT *, trim(regexp_replace(list_reduce(list_concat([e], list_transform(requested, lambda x: x.raw)), lambda t, r: CASE WHEN contains(t, r) THEN substr(t, 1, strpos(t, r) - 1) || ' ' || substr(t, strpos(t, r) + length(r)) ELSE t END), '\\s+', ' ', 'g')) AS rest FROM e5),
e7 AS (SELECT *, {normalize_n1_sql('rest')} AS match, {_unit_sql(_raws('rest', _HINT))} AS found, {_unit_sql(f"[{{'raw': '', 'u': regexp_extract(e, {quoted(_PER)}, 1)}}]")}[1].u AS requested_unit,
  CASE WHEN regexp_matches(lower(query), '\\b(?:quote|quotation|proforma|add)\\b') THEN 'quote' ELSE 'price_lookup' END AS intent FROM e6),
e8 AS (SELECT *, list_transform(list_transform(found, lambda x: {{'raw': x.raw, 'u': x.u, 'value': {_value('x.raw')}}}), lambda x: {{'name': CASE x.u WHEN 'sqmm' THEN 'size' WHEN 'core' THEN 'cores' WHEN 'meter' THEN 'length' ELSE x.u END, 'value': x.value, 'unit': CASE WHEN x.u <> 'core' THEN x.u END,
  'plain': regexp_replace(CAST(x.value AS VARCHAR), '\\.0$', ''), 'phrase': regexp_replace(CAST(x.value AS VARCHAR), '\\.0$', '') || ' ' || x.u, 'normal': {normalize_n1_sql('x.raw')}}}) AS hints,
  list_filter({tokens_sql('match')}, lambda t: t NOT IN ({_listed(engine.NO_PRODUCT)}) AND t NOT IN ({_listed(engine.KNOWN_UNITS)}) AND NOT regexp_matches(t, '^[.\\d]+$')) AS terms FROM e7),
p AS (SELECT *, CASE WHEN len(terms) > 0 THEN terms ELSE list_filter({tokens_sql('normalized')}, lambda t: t NOT IN ('core', 'sqmm', 'meter') AND NOT regexp_matches(t, '^\\d+(?:\\.\\d+)?$') AND NOT list_contains(list_transform(hints, lambda h: coalesce(h.unit, h.name)), t)) END AS search_terms,
  {_identity_sql('match')} AS query_identity, list_distinct(list_transform(list_filter(string_split(match, ' '), lambda t: regexp_matches(t, '^\\d+(?:\\.\\d+)?$')), lambda t: regexp_replace(t, '^0+(\\d)', '\\1'))) AS query_numbers FROM e8)"""
PARSE_SQL = f"""WITH {PARSE} SELECT query, normalized, match, array_to_string(list_transform(requested, lambda r: concat_ws(':', CAST({_value('r.raw')} AS VARCHAR), r.u)), ',') AS requested,
array_to_string(list_transform(hints, lambda h: concat_ws(':', h.name, CAST(h.value AS VARCHAR))), ',') AS hints, array_to_string(terms, ',') AS terms, requested_unit, intent FROM p"""


def _d(x: float) -> str:
    return f"{x}::DOUBLE"


def _word_in_sql(text: str, w: str) -> str:
    has = lambda x: f"contains(' ' || {text} || ' ', ' ' || {x} || ' ')"
    other = f"CASE {w} {' '.join(f'WHEN {quoted(a)} THEN {quoted(b)}' for a, b in engine.ALIKE)} END"
    plural, single = f"{w} || 's'", f"regexp_replace({w}, 's$', '')"
    return f"(CASE WHEN {w} = '' THEN false WHEN regexp_matches({w}, '^[a-z]+$') THEN {has(w)} OR {has(plural)} OR ({w} LIKE '%s' AND {has(single)}) OR coalesce({has(other)}, false) ELSE contains({text}, {w}) END)"


def _any_sql(text: str, words: list[str]) -> str:
    return f"regexp_matches({text}, {quoted(engine.any_pattern(words))})"


def _asks(*words: str) -> str:
    return f"list_has_any(terms, [{_listed(list(words))}])"


def _capped_sql() -> str:
    """(condition, most, points less) in order, as the score's caps; a candidate has no more texts than its name."""
    rules = [
        ("conflicts > 0", 0.78, 0), ("missing > 0 AND NOT exact", 0.84, 0), ("NOT exact AND (ratio < 1 OR few)", 0.84, 0), ("regexp_matches(normalized, '\\bper meter\\b') AND regexp_matches(id_text, '\\bcoil\\b')", 9, 0.12),
        (f"{_asks('armoured', 'armored')} AND NOT {_any_sql('id_text', ['armoured'])}", 0.64, 0), (f"{_asks('unarmoured', 'unarmored')} AND {_any_sql('id_text', ['armoured'])} AND NOT {_any_sql('id_text', ['unarmoured'])}", 0.64, 0),
        (f"{_asks('copper')} AND {_any_sql('id_text', ['aluminium'])} AND NOT {_any_sql('id_text', ['copper'])}", 0.64, 0), (f"{_asks('aluminium')} AND {_any_sql('id_text', ['copper'])} AND NOT {_any_sql('id_text', ['aluminium'])}", 0.64, 0),
        (f"NOT {_asks('speaker')} AND {_any_sql('id_text', ['speaker'])}", 9, 0.6), (f"{_asks('pipe')} AND NOT {_asks(*engine.FITTINGS)} AND {_any_sql('id_text', engine.FITTINGS)}", 0.72, 0.16),
        (" OR ".join(f"({_any_sql('wanted', f)} AND (NOT {_any_sql('had', f)} OR {_any_sql('had', engine.NO_FAMILY)}))" for f in engine.FAMILIES), 0.34, 0.35),
        (f"{_any_sql('cell', engine.SPEC_WORDS)} AND NOT {_any_sql('cell', engine.PRICE_SIGNS)}", 0.49, 0), ("items > 1", 9, 0.03),
    ]
    s = "s"
    for when, most, less in rules:
        s = f"least({s} - CASE WHEN {when} THEN {_d(less)} ELSE 0::DOUBLE END, CASE WHEN {when} THEN {_d(most)} ELSE 9::DOUBLE END)"
    return f"round(greatest(0::DOUBLE, least(1::DOUBLE, {s})), 4)"


_W = {k: _d(v) for k, v in WEIGHTS.items()}
_S0 = f"""CASE WHEN n > 0 THEN {_W['numeric_attribute']} * matched / n ELSE 0::DOUBLE END + CASE WHEN q_size <> c_size THEN greatest(0::DOUBLE, {_d(0.08)} - abs(q_size - c_size) / greatest(q_size, c_size, 1::DOUBLE) * {_d(0.1)}) ELSE 0::DOUBLE END
+ CASE WHEN requested_unit IS NULL THEN CASE WHEN own_unit IS NOT NULL THEN {_W['unit']} * {_d(0.5)} ELSE 0::DOUBLE END WHEN own_unit = requested_unit OR (own_unit IS NULL AND {_word_in_sql('name_text', 'requested_unit')}) THEN {_W['unit']} WHEN own_unit IS NOT NULL THEN {_d(-0.25)} ELSE 0::DOUBLE END
+ CASE WHEN nt > 0 THEN {_W['product_term']} * ratio ELSE 0::DOUBLE END + CASE WHEN in_row THEN {_W['row']} ELSE 0::DOUBLE END + CASE WHEN price > 0 THEN {_W['price']} ELSE 0::DOUBLE END + {_W['page']} + {_W['parser']} * {_d(0.9)} + {_W['recency']} * {_d(0)} + {_W['recall']} * {_d(0.82)}
+ CASE WHEN judged THEN {_W['row_identity']} * identity - CASE WHEN identity >= {_d(0.85)} THEN 0::DOUBLE ELSE least({_d(0.22)}, {_d(0.22)} * (1 - identity)) END + CASE WHEN exact THEN {_d(0.08)} ELSE 0::DOUBLE END ELSE 0::DOUBLE END
- CASE WHEN nq >= 3 AND len(ci) > nq * {_d(1.8)} AND extra > {_d(0.45)} THEN least({_d(0.18)}, {_d(0.22)} * extra) ELSE 0::DOUBLE END
+ CASE WHEN nn >= 2 THEN {_W['numeric_identity']} * numeric - CASE WHEN numeric >= {_d(0.9)} THEN 0::DOUBLE ELSE least({_d(0.28)}, {_d(0.45)} * (1 - numeric)) END ELSE 0::DOUBLE END
+ CASE WHEN n >= 2 AND len(terms) > 0 AND matched = n AND ratio >= {_d(0.75)} THEN {_W['exact']} ELSE 0::DOUBLE END
- least({_d(0.5)}, list_sum(list_concat([0::DOUBLE], list_transform(list_filter(states, lambda x: x.s = 'conflict'), lambda x: CASE WHEN x.name IN ('size', 'cores', 'length') THEN {_d(0.24)} ELSE {_d(0.1)} END)))) - least({_d(0.24)}, {_d(0.06)} * missing)"""
_STATE = """CASE WHEN len(list_filter(attributes, lambda a: a.name = h.name AND a.value = h.value AND (h.unit IS NULL OR a.unit IS NULL OR a.unit = h.unit))) > 0 OR contains(' ' || all_text || ' ', ' ' || h.phrase || ' ') THEN 'matched'
  WHEN len(list_filter(attributes, lambda a: a.name = h.name)) > 0 THEN 'conflict' ELSE 'missing' END"""
_SHARE = "len(list_filter({of}, lambda t: {test})) / greatest(len({of}), 1)"


def _scores(pairs: str) -> str:
    """CTEs up to z: the pairs (queries and candidates' rows, by the CTE pairs) and their scores."""
    size = "list_filter({}, lambda h: h.name = 'size')[1].value"
    return f"""{PARSE},
q AS (SELECT *, {size.format('hints')} AS q_size FROM p),
c0 AS (SELECT name AS candidate, unit, count(*) AS items, min(price) AS price, min(id) AS id, max(id % 28) AS uploaded FROM ({ITEMS}) GROUP BY 1, 2),
c1 AS (SELECT c0.*, hints AS attributes, q_size AS c_size, {normalize_n1_sql('candidate')} AS name_text, {normalize_n1_sql("concat_ws(' ', candidate, unit, candidate, candidate)")} AS id_text, {normalize_n1_sql("concat_ws(' ', candidate, candidate, candidate, candidate)")} AS all_text, {normalize_n1_sql("concat_ws(' ', candidate, candidate, candidate)")} AS cell, {normalize_n1_sql('unit')} AS unit_text FROM c0 JOIN q ON query = candidate),
c AS (SELECT *, {_identity_sql('id_text')} AS ci, {normalize_unit_sql('unit_text')} AS own_unit FROM c1),
{pairs},
x AS (SELECT *, len(hints) AS n, len(search_terms) AS nt, len(query_identity) AS nq, len(query_numbers) AS nn, list_transform(hints, lambda h: {{'name': h.name, 's': {_STATE}}}) AS states,
  len(list_filter(search_terms, lambda t: {_word_in_sql('name_text', 't')})) > 0 AS in_row,
  CASE WHEN len(search_terms) = 0 THEN 1::DOUBLE ELSE len(list_filter(search_terms, lambda t: {_word_in_sql('name_text', 't')} OR (NOT regexp_matches(t, '^[a-z]+$') AND contains(replace(name_text, ' ', ''), t)))) / len(search_terms) END AS ratio,
  {_SHARE.format(of='query_identity', test=_word_in_sql('id_text', 't'))} AS identity, {_SHARE.format(of='query_numbers', test=_word_in_sql('id_text', 't'))} AS numeric,
  {_SHARE.format(of='ci', test=f"len(list_filter(query_identity, lambda u: {_word_in_sql('u', 't')})) = 0")} AS extra, array_to_string(terms, ' ') AS wanted, id_text || ' ' || name_text AS had FROM pairs),
y0 AS (SELECT *, len(list_filter(states, lambda v: v.s = 'matched')) AS matched, len(list_filter(states, lambda v: v.s = 'missing')) AS missing, len(list_filter(states, lambda v: v.s = 'conflict')) AS conflicts, len(terms) > 0 AND nq >= 3 AS judged, nn >= 2 AND numeric < {_d(0.9)} AS few FROM x),
y1 AS (SELECT *, judged AND identity >= {_d(0.95)} AND conflicts = 0 AND ratio >= {_d(0.6)} AS exact FROM y0),
y2 AS (SELECT *, {_S0} AS s FROM y1),
z AS (SELECT *, {_capped_sql()} AS score FROM y2)"""


_LABEL = f"CASE WHEN score >= {MATCHED} THEN 'Matched' WHEN score >= {REVIEW} THEN 'Needs review' ELSE 'Not reliable enough' END AS label"
SCORE_SQL = f"WITH {_scores('pairs AS (SELECT q.*, c.* FROM q JOIN c ON q_size = c_size)')} SELECT query, candidate, unit, items, score, {_LABEL} FROM z"
_RECALL = """held AS (SELECT DISTINCT candidate, unit, unnest(ci) AS term FROM c),
often AS (SELECT term, count(*) AS often FROM held GROUP BY 1),
rare AS (SELECT query, term FROM (SELECT query, unnest(search_terms) AS term FROM q) JOIN often USING (term) QUALIFY row_number() OVER (PARTITION BY query ORDER BY often, term) = 1),
met AS (SELECT query, candidate, unit FROM q JOIN c ON q_size = c_size UNION SELECT query, candidate, unit FROM rare JOIN held USING (term)),
pairs AS (SELECT q.*, c.* FROM met JOIN q ON met.query = q.query JOIN c ON met.candidate = c.candidate AND met.unit = c.unit)"""
RANKING_SQL = f"""WITH {_scores(_RECALL)},
k AS (SELECT query, candidate, unit, score, len(ci) AS specific, id, name_text AS normal, row_number() OVER (PARTITION BY query ORDER BY score DESC, len(ci), uploaded DESC, id) AS place FROM z),
b AS (SELECT query, score AS best, normal AS best_normal FROM k WHERE place = 1),
t AS (SELECT query, count(*) AS ties FROM k JOIN b USING (query) WHERE best >= {MATCHED} AND score >= {MATCHED} AND best - score <= {NEAR}::DOUBLE AND normal <> best_normal GROUP BY 1),
g AS (SELECT k.* EXCLUDE (score), coalesce(ties, 0) AS ties, coalesce(place <= ties + 1, false) AS capped, CASE WHEN place <= ties + 1 THEN least(score, {CAP}::DOUBLE) ELSE score END AS score FROM k LEFT JOIN t USING (query))
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY CASE WHEN ties > 0 THEN 0 ELSE place END, score DESC, specific, id) AS INTEGER) AS rank, candidate, unit, score, {_LABEL}, capped FROM g QUALIFY rank <= {PLACES}"""
QUERIES = {"query_parse": parsed, "candidate_score": scored, "candidate_ranking": ranking}
SQL = {"query_parse": PARSE_SQL, "candidate_score": SCORE_SQL, "candidate_ranking": RANKING_SQL}
