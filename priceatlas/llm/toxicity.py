"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a fixed and of a learned lexicon, their words near the second person, capitals, punctuation and obfuscation.
The learned lexicon holds words and word beginnings that labelled toxic texts use far more often than clean ones, in many different
surroundings, so that copies of one text teach nothing. Trees are fitted on two thirds of a bounded labelled sample, the calibration
on the rest, weighted back to the table's class shares.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from priceatlas.llm.common import materialize, packed, slices, small_batches, texts_of

#: Labelled rows that the model is fitted on, at most on average: toxic and clean; chosen by a hash of doc_id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 6_000, 14_000
#: A learned entry: different preceding words, toxic documents without copies, log odds; most entries.
CONTEXTS, SUPPORT, LOG_ODDS, ENTRIES = 8, 6, 3.0, 5_000
#: Words between a lexicon word and a second-person word that still count as near.
NEAR = 6
#: Words that a task remembers as in or out of the lexicon; it begins anew beyond.
KNOWN_WORDS = 100_000
#: Share of the uncalibrated probability in the score: it orders texts within a step of the calibration.
BLEND = 0.01
#: Insults in English, French, German and Spanish, and second-person words.
INSULTS = frozenset(
    "arsehole asshole bastard bitch bollocks bullshit clown coward cretin cunt degenerate dickhead disgusting douchebag dumb dumbass dunce faggot fool freak fuck "
    "fucker fucking garbage halfwit hypocrite idiot idiotic idiots imbecile jackass jerk kill liar loser losers lowlife moron moronic morons motherfucker nitwit "
    "parasite pathetic pig pigs prick retard retarded scum scumbag shit shithead shitty sicko slut stupid subhuman trash twat ugly useless vermin wanker whore worthless "
    "abruti batard conard connard connasse cretine debile degage encule imbeciles merde ordure pouffiasse salaud salope "
    "abschaum arschloch bloedmann depp dreckskerl drecksau hurensohn idioten missgeburt schlampe schwein trottel vollidiot wichser "
    "cabron escoria estupido gilipollas hijoputa idiota imbecil mierda pendejo puta puto subnormal zorra".split()
)
SECOND = frozenset("you your yours yourself yourselves youre ya u ur tu toi te ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer sie ti tus tuyo usted ustedes vosotros os vuestro".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None})
_WORDS = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"\b[^\W\d_]+[@$*!0-9._-]+[^\W\d_]+(?:[@$*!0-9._-]+[^\W\d_]+)*")
_RUN = re.compile(r"([^\W\d_])\1{3,}")
_PUNCT = re.compile(r"[^\w\s]+")
_SHOUT = re.compile(r"[!?]")
FEATURES = 13


def parts(word: str) -> list[str]:
    """A word and its beginnings of 4 to 6 letters, as lexicon entries."""
    return [word, *("^" + word[:n] for n in (4, 5, 6) if len(word) > n)]


def features(text: str, learned: frozenset[str], known: dict[str, bool]) -> list[float]:
    low = text.lower()
    words = _WORDS.findall(low)
    hits, fixed, near, masked = [], 0, 0, 0
    for at, w in enumerate(words):
        hit = known.get(w)
        if hit is None:
            if len(known) > KNOWN_WORDS:
                known.clear()
            hit = known[w] = any(p in learned for p in parts(w))
        if hit:
            hits.append(at)
    fixed_at = [at for at, w in enumerate(words) if w in INSULTS]
    fixed = len(fixed_at)
    tokens = _MASKED.findall(low)
    for t in tokens:
        plain = t.translate(LEET)
        masked += plain in INSULTS or any(p in learned for p in parts(plain))
    both = sorted({*hits, *fixed_at})
    for at in both:
        near += any(w in SECOND for w in words[max(0, at - NEAR) : at + NEAR + 1])
    n, chars = max(1, len(words)), max(1, len(text))
    letters = max(1, sum(map(len, words)))
    return [
        100 * len(hits) / n, math.log1p(len(hits)), math.log1p(len({words[a] for a in hits})),
        100 * fixed / n, math.log1p(fixed), math.log1p(len(both) + masked), near / max(1, len(both)), math.log1p(near),
        sum(map(str.isupper, text)) / letters, sum(map(len, _PUNCT.findall(text))) / chars, len(_SHOUT.findall(text)) / n,
        100 * (len(tokens) + sum(1 for _ in _RUN.finditer(low))) / n, float(masked),
    ]


def _feature_task(learned: frozenset[str], keep: list[str], place: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for b in slices(batches):
            values = [features(t or "", learned, known) for t in texts_of(b, place)]
            yield pa.RecordBatch.from_pydict({n: b.column(n) for n in keep} | {"x": pa.array(values, pa.list_(pa.float64()))})

    return run


def with_features(rows: DataFrame, learned: frozenset[str], keep: list[str], place: int | None = None) -> DataFrame:
    """Columns keep of rows, and x: the features of their column text, or of the field at place of their column row."""
    schema = StructType([*rows.select(*keep).schema.fields, StructField("x", ArrayType(DoubleType()))])
    return small_batches(rows).mapInArrow(_feature_task(learned, keep, place), schema)


def _toxic_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in slices(batches):
        entry, context, doc = [], [], []
        for t in b.column("text").to_pylist():
            words = _WORDS.findall((t or "").lower())
            found = {(p, a) for a, w in zip(["", *words], words, strict=False) for p in parts(w)}
            # near copies mostly have the same smallest hash, so a group of copies counts about once
            n = min((xxhash.xxh3_64_intdigest(w) for w in set(words)), default=0) >> 1
            entry += [p for p, _ in found]
            context += [a for _, a in found]
            doc += [n] * len(found)
        yield pa.RecordBatch.from_pydict({"entry": pa.array(entry, pa.string()), "context": pa.array(context, pa.string()), "n": pa.array(doc, pa.int64())})


def _clean_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        docs: Counter[str] = Counter()
        for t in b.column("text").to_pylist():
            docs.update({p for w in set(_WORDS.findall((t or "").lower())) for p in parts(w)})
        yield pa.RecordBatch.from_pydict({"entry": pa.array(docs.keys(), pa.string()), "clean": pa.array(docs.values(), pa.int64())})


def learn_lexicon(sample: DataFrame) -> frozenset[str]:
    """At most ENTRIES words and beginnings from the labelled sample (columns text, toxic); groups of copies count about once among the toxic."""
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic = sample.where("toxic = 1").select("text").mapInArrow(_toxic_task, "entry string, context string, n long")
    seen = toxic.groupBy("entry").agg(F.countDistinct("context").alias("contexts"), F.countDistinct("n").alias("docs")).where((F.col("contexts") >= CONTEXTS) & (F.col("docs") >= SUPPORT))
    clean = sample.where("toxic = 0").select("text").mapInArrow(_clean_task, "entry string, clean long").groupBy("entry").agg(F.sum("clean").alias("clean"))
    odds = F.log((F.col("docs") + 0.5) / (sizes.get(1, 0) + 1)) - F.log((F.coalesce("clean", F.lit(0)) + 0.5) / (sizes.get(0, 0) + 1))
    rows = seen.join(clean, "entry", "left").withColumn("odds", odds).where(F.col("odds") >= LOG_ODDS)
    return frozenset(r.entry for r in rows.orderBy(F.desc("docs"), "entry").limit(ENTRIES).collect())


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple | None:
    """(lexicon, trees, calibration) from labelled rows with train (over id_col); None if one class is missing.

    A document labelled more than once counts as toxic if any label says so; null labels and ids are left out. Of several documents of
    one id, one is learned from: the smallest text.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & train).groupBy(id_col).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sizes = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    shares = {1: min(1.0, SAMPLE_TOXIC / sizes[1]), 0: min(1.0, SAMPLE_CLEAN / sizes[0])}
    u = F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1_000_003))
    share = F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0])
    picked = marks.where(u < share * 1_000_003).select(F.col(id_col).alias("n"), "toxic", (1 / share).alias("weight"), F.pmod(F.xxhash64(id_col, F.lit("part")), F.lit(3)).alias("part"))
    texts = docs.select(F.col(id_col).alias("n"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(picked), "n").groupBy("n", "toxic", "weight", "part").agg(F.min("text").alias("text"))
    sample = materialize(sample, "toxicity-sample")  # at most about SAMPLE_TOXIC + SAMPLE_CLEAN small rows
    learned = learn_lexicon(sample.where("part < 2"))
    ready = materialize(with_features(sample, learned, ["toxic", "weight", "part"]), "toxicity-features")
    ready = ready.withColumn("features", array_to_vector("x")).withColumn("label", F.col("toxic").cast("double"))
    if ready.where("part < 2").select("toxic").distinct().count() < 2:
        return None
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.2, maxBins=32, seed=7, featuresCol="features", labelCol="label").fit(ready.where("part < 2").coalesce(4))
    held = _probability(trees, ready.where("part = 2")).select(array_to_vector(F.array("p")).alias("features"), "label", "weight")
    if not held.take(1):
        return None
    scale = IsotonicRegression(featuresCol="features", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(held)
    return learned, trees, scale


def _probability(trees, rows: DataFrame) -> DataFrame:
    return trees.transform(rows).withColumn("p", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def score(docs: DataFrame, model: tuple | None, keep: list[str], text_col: str = "text", into: str = "toxicity") -> DataFrame:
    """Columns keep of docs and toxicity (in column into, 0 to 1) for every row; a null text counts as empty. Without a model: lexicon words / (lexicon words + 2).

    A kept column that is called like into is replaced.
    """
    # the row travels as one struct, so that names of the steps' columns cannot clash with its own
    keep = [c for c in keep if c.lower() != into.lower()]
    rows, place = packed(docs, keep, text_col)
    if model is None:
        hits = F.expm1(F.col("x")[5])
        return with_features(rows, frozenset(), ["row"], place).select("row.*", (hits / (hits + 2)).alias(into))
    learned, trees, scale = model
    found = with_features(rows, learned, ["row"], place).withColumn("features", array_to_vector("x"))
    found = _probability(trees, found).withColumn("features", array_to_vector(F.array("p")))
    value = (1 - BLEND) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated"))) + BLEND * F.col("p")
    return scale.transform(found).select("row.*", value.alias(into))
