"""Extractors of requirement labels from text: ordered rules, keyword scores, majority, n-gram TF-IDF, linear heads."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import casting, text
from quillon.operators import metrics
from quillon.sources.shared import bounded_batches, written

FIELDS = ("domain", "latency", "privacy", "execution_policy", "reliability", "accuracy", "energy_priority", "divisibility")
#: Vocabularies up to this size are broadcast.
BROADCAST_TERMS = 1_000_000
# Keywords that speak for a domain, matched in folded text. "surü" can't occur there (folding makes it "suru"); it is kept for completeness.
DOMAIN_KEYWORDS = {
    "healthcare": ("hasta", "klinik", "hastane", "saglik", "ekg", "glikoz", "patoloji", "radyoloji", "ambulans", "yogun bakim"),
    "industrial": ("uretim", "fabrika", "endustri", "robot kolu", "cnc", "montaj", "konveyor", "paketleme hatti"),
    "transportation": ("ulasim", "trafik", "arac", "otobus", "demiryolu", "metro", "havalimani", "otopark", "feribot"),
    "public_safety": ("acil durum", "afet", "yangin", "deprem", "arama kurtarma", "kolluk", "tahliye", "heyelan"),
    "smart_city": ("belediye", "kent", "sokak lambasi", "hava kalitesi", "atik kutusu", "kanalizasyon", "kamusal"),
    "agriculture": ("tarimsal", "tarla", "sera", "sulama", "surü", "suru", "ekin", "koyun", "hasat", "traktor"),
    "consumer": ("kisisel cihaz", "akilli ev", "oyun", "sanal gerceklik", "artirilmis gerceklik", "robot supurge", "akilli televizyon", "muzik hoparloru"),
}
# Phrases that forbid the cloud, and the phrases (all of them, and any of the second list if there are some)
# or the kind of stated number that give a field its label. Of a field's rows the first that applies counts.
CLOUD_FORBIDDEN = ("bulut kullanilamaz", "buluta gonderilmesi kesinlikle yasaktir", "genel bulut kullanilamaz")
RULES = (
    ("latency", ("anit", "dort saniye"), (), "ambiguous", {}),
    ("latency", "latency_ms", (), "explicit", {"value": "latency_class"}),
    ("privacy", ("kamuya acik",), (), "explicit", {"value": "public"}),
    ("privacy", ("kisitli veri",), (), "explicit", {"value": "restricted"}),
    ("privacy", (), ("hassas veri", "kisisel veri"), "explicit", {"value": "sensitive"}),
    ("privacy", ("kurum disina",), (), "explicit", {"value": "internal"}),
    ("execution_policy", ("yalniz bulutta",), CLOUD_FORBIDDEN, "ambiguous", {"device": "unknown", "edge": "unknown", "cloud": "unknown"}),
    ("execution_policy", ("cihaz, yakin edge veya bulutta",), (), "explicit", {"device": "allowed", "edge": "allowed", "cloud": "allowed"}),
    ("execution_policy", ("cihaz veya yakin edge",), CLOUD_FORBIDDEN, "explicit", {"device": "allowed", "edge": "allowed", "cloud": "forbidden"}),
    ("execution_policy", ("yakin edge sunucusunda",), CLOUD_FORBIDDEN, "partial", {"device": "unknown", "edge": "allowed", "cloud": "forbidden"}),
    ("reliability", "reliability", (), "explicit", {"value": "reliability_tier"}),
    ("reliability", ("yuksek guvenilirlik",), (), "explicit", {"value": "high"}),
    ("reliability", ("basarisiz istek kabul edilebilir",), (), "explicit", {"value": "best_effort"}),
    ("accuracy", ("yuksek dogrulukta", "dusuk dogruluklu"), (), "ambiguous", {}),
    ("accuracy", "accuracy", (), "explicit", {"value": "high", "metric": "f1_metric"}),
    ("accuracy", ("yuksek dogruluk",), (), "explicit", {"value": "high"}),
    ("energy_priority", ("birinci oncelik", "pil"), (), "explicit", {"value": "high"}),
    ("energy_priority", ("enerji tuketimi", "dengelenmelidir"), (), "explicit", {"value": "balanced"}),
    ("divisibility", ("tek parca", "bagimsiz parca"), (), "ambiguous", {}),
    ("divisibility", ("bagimsiz",), ("paralel", "parcalari"), "explicit", {"value": "divisible"}),
    ("divisibility", ("tek parca",), (), "explicit", {"value": "indivisible"}),
)
#: What a field says of itself where no rule applies.
SILENT = {"execution_policy": {"device": "unknown", "edge": "unknown", "cloud": "unknown"}}


def keyword_scores(folded: Column, keywords: dict[str, tuple[str, ...]]) -> Column:
    """array<struct<score, label>>: how many keywords of each label the text contains."""
    return F.array(*[F.struct(sum((folded.contains(k).cast("int") for k in words), F.lit(0)).alias("score"), F.lit(label).alias("label")) for label, words in sorted(keywords.items())])


def best_label(scores: Column, none: str = "other") -> Column:
    """The label of the highest score, the smallest of equals; `none` if nothing was found."""
    top = F.array_max(F.transform(scores, lambda s: s["score"]))
    return F.when(top > 0, F.element_at(F.filter(scores, lambda s: s["score"] == top), 1)["label"]).otherwise(none)


def _label(status: str, values: dict, number: Column | None, computed: dict[str, Column]) -> Column:
    """A struct of one shape for all fields: status, value, the three targets or the metric where they apply, the stated number."""
    each = [F.lit(None).cast("string") if v is None else computed.get(v, F.lit(v)) for v in map(values.get, ("value", "device", "edge", "cloud", "metric"))]
    own = F.lit(None).cast("double") if number is None else number.cast("double")
    return F.struct(F.lit(status).alias("status"), *[c.alias(n) for c, n in zip(each, ("value", "device", "edge", "cloud", "metric"))], own.alias("number"))


def rule_labels(df: DataFrame, text_col: str = "task_text", policy_col: str | None = None) -> DataFrame:
    """df with a struct column per field of FIELDS: RULES over the folded text, numbers read from the text as it is, and the domain of most keywords."""
    shown = text.visible_text(F.col(text_col), F.col(policy_col)) if policy_col else F.col(text_col)
    # folded and read once, as columns of their own: the rules name them dozens of times
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), shown.alias("shown"))
    rows = rows.select("row", text.folded(F.col("shown")).alias("folded"), text.stated_latency_ms(F.col("shown")).alias("latency_ms"), text.stated_reliability(F.col("shown")).alias("reliability_"), text.stated_accuracy(F.col("shown")).alias("accuracy_"), text.stated_f1(F.col("shown")).alias("f1"))
    folded = F.col("folded")
    stated = {"latency_ms": F.col("latency_ms"), "reliability": F.col("reliability_"), "accuracy": F.col("accuracy_")}
    computed = {"latency_class": casting.latency_class(stated["latency_ms"]), "reliability_tier": casting.reliability_tier(stated["reliability"]), "f1_metric": F.when(F.col("f1").isNotNull(), "F1")}
    out = {"domain": _label("explicit", {"value": "domain"}, None, {"domain": best_label(keyword_scores(folded, DOMAIN_KEYWORDS))})}
    for field in FIELDS[1:]:
        label = _label("not_stated", SILENT.get(field, {}), None, {})
        for _, need, some, status, values in reversed([r for r in RULES if r[0] == field]):
            number = stated[need] if isinstance(need, str) else None
            tests = [number.isNotNull()] if number is not None else [folded.contains(x) for x in need]
            if some:
                tests.append(reduce(or_, (folded.contains(x) for x in some)))
            label = F.when(reduce(and_, tests), _label(status, values, number, computed)).otherwise(label)
        out[field] = label
    return rows.select(*[F.col("row")[c].alias(c) for c in df.columns if c not in out], *[c.alias(f) for f, c in out.items()])


def assembled(labels: DataFrame, text_col: str, confident: float = 0.8, silent: float = 0.7) -> DataFrame:
    """Rule labels with evidence, confidence, abstained_fields and overall_confidence."""
    snippet = text.evidence(F.col(text_col))
    stated = {f: F.col(f)["status"] != "not_stated" for f in FIELDS}
    out = labels.withColumns({f: F.struct(f"{f}.*", F.when(stated[f], F.array(snippet)).otherwise(F.array().cast("array<string>")).alias("evidence"), F.when(stated[f], confident).otherwise(silent).alias("confidence")) for f in FIELDS})
    held = [F.when(F.col(f)["status"].isin("not_stated", "ambiguous"), F.lit(f)) for f in FIELDS]
    return out.withColumns({"abstained_fields": F.array_compact(F.array(*held)), "overall_confidence": sum((F.col(f)["confidence"] for f in FIELDS), F.lit(0.0)) / len(FIELDS)})


@dataclass(frozen=True)
class WordNgrams:
    """Terms of a text: character n-grams inside words (by white space, marks stay) padded with one space each side; a padded word of up to n characters gives itself once."""

    text: Column
    low: int = 3
    high: int = 5

    def of(self, padded: Column) -> Column:
        size = F.length(padded)

        def grams(n: int) -> Column:
            last = F.greatest(size - n + 1, F.lit(1)) if n == self.low else size - n + 1
            starts = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))
            return F.when(last >= 1, F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

        return F.concat(*[grams(n) for n in range(self.low, self.high + 1)])


def word_ngrams(c: Column, low: int = 3, high: int = 5) -> WordNgrams:
    return WordNgrams(c, low, high)


def _term_counts(df: DataFrame, key: str, terms: Column | WordNgrams) -> DataFrame:
    """key, term, tf. Rows are dealt by key before their terms are spread out: the rows are shuffled, not their many terms, and what groups by key afterwards needs no other shuffle.

    Of n-grams the words are counted first, so a repeated word is cut up once a row.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if isinstance(terms, WordNgrams):
        rows = df.select(key, text.unaccented(terms.text).alias("_t")).repartition(n, key)
        words = rows.select(key, F.explode(F.split("_t", r"\s+")).alias("_w")).where("_w <> ''").groupBy(key, "_w").agg(F.count(F.lit(1)).alias("_k"))
        words = words.select(key, "_k", F.concat(F.lit(" "), "_w", F.lit(" ")).alias("_w"))
        return words.select(key, "_k", F.explode(terms.of(F.col("_w"))).alias("term")).groupBy(key, "term").agg(F.sum("_k").alias("tf"))
    return df.repartition(n, key).select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def _one_row_a_key(df: DataFrame, key: str, units: Column) -> DataFrame:
    """key, units (array) with each key once: rows of the same key are joined, and nothing is shuffled but keys where there are none."""
    rows = df.select(key, units.alias("_u"))
    if rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        return rows
    return rows.groupBy(key).agg(F.flatten(F.collect_list("_u")).alias("_u"))


def _units(terms: Column | WordNgrams) -> Column:
    """What a text is cut into once: its terms, or the words whose n-grams are its terms."""
    return F.filter(F.split(text.unaccented(terms.text), r"\s+"), lambda w: w != "") if isinstance(terms, WordNgrams) else terms


def _padded(word: Column) -> Column:
    return F.concat(F.lit(" "), word, F.lit(" "))


def _lengths(terms: Column | WordNgrams) -> tuple[int, int]:
    return (terms.low, terms.high) if isinstance(terms, WordNgrams) else (0, 0)


def _cut(low: int, high: int, vocabulary: dict[str, int]):
    """A function from units to the ids of their known terms (n-grams of low to high; 0: the units), flat, with their number per unit; units that came before are looked up."""
    seen: dict[str, np.ndarray] = {}
    none = np.empty(0, np.int64)

    def of(unit: str) -> np.ndarray:
        if not low:
            i = vocabulary.get(unit)
            return none if i is None else np.array([i])
        w = f" {unit} "
        n = len(w)
        grams = [w[i : i + k] for k in range(low, high + 1) for i in range(max(n - k + 1, 1) if k == low else n - k + 1)]
        return np.array([vocabulary[g] for g in grams if g in vocabulary], np.int64)

    def cut(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(seen) > 200_000:  # a bound of the memory, not of the vocabulary
            seen.clear()
        each = []
        for u in units:
            ids = seen.get(u)
            if ids is None:
                ids = seen[u] = of(u)
            each.append(ids)
        return np.concatenate([none, *each]), np.fromiter(map(len, each), np.int64, len(each))

    return cut


def _known_counts(column: pa.ListArray, cut, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a column of units, some rows at a time: how many rows, and by row and term id the row, the term id and its count."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = column.flatten().dictionary_encode()
    ids, per = cut(codes.dictionary.to_pylist())
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    unit = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    step = max((1 << 20) // max(size, 1), 1)
    for a in range(0, len(lengths), step):
        b = min(a + step, len(lengths))
        u = unit[ends[a] : ends[b]]
        row = np.repeat(np.arange(b - a), lengths[a:b])
        n = per[u]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[u], n)
        counts = np.bincount(np.repeat(row, n) * size + ids[at], minlength=(b - a) * size)
        cell = np.flatnonzero(counts)
        yield b - a, cell // size, cell % size, counts[cell]


def _fit_tfidf_of_all(df: DataFrame, key: str, terms: Column | WordNgrams, min_df: int, max_terms: int) -> DataFrame:
    """The vocabulary from the counts of all terms by key: for any min_df and size."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    counts = _term_counts(df, key, terms).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    kept = counts.orderBy(F.col("total").desc(), "term").limit(max_terms).crossJoin(n)  # one row
    ids = (F.row_number().over(Window.orderBy("term")) - 1).cast("int")  # at most max_terms rows
    return kept.select("term", ids.alias("term_id"), (F.log((1.0 + F.col("_n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def fit_tfidf(df: DataFrame, key: str, terms: Column | WordNgrams, min_df: int = 2, max_terms: int = 20_000) -> DataFrame:
    """The fitted vocabulary: term, term_id (from 0, by term), idf = ln((1 + n) / (1 + df)) + 1.

    Terms of fewer than min_df rows are left out; of the others the max_terms
    most frequent stay (max_terms is the model's size, a bounded table).

    A term's total is told by the counts of the different words (or terms) of all
    rows, and that two rows hold it by the smallest and largest key it has, so
    only the terms that stay are looked up row by row, for their df.  A larger
    min_df, or a vocabulary that isn't broadcast, needs the counts of all terms.
    """
    if min_df > 2 or max_terms > BROADCAST_TERMS:
        return _fit_tfidf_of_all(df, key, terms, min_df, max_terms)
    spark = df.sparkSession
    units = df.select(F.col(f"`{key}`").alias("_key"), F.explode(_units(terms)).alias("_u")).where("_u is not null")
    words = units.groupBy("_u").agg(F.count(F.lit(1)).alias("_k"), F.min("_key").alias("_a"), F.max("_key").alias("_b"), F.count_if(F.col("_key").isNull()).alias("_none"))
    each = F.explode(terms.of(_padded(F.col("_u")))) if isinstance(terms, WordNgrams) else F.col("_u")
    counts = words.select(each.alias("term"), "_k", "_a", "_b", "_none").groupBy("term").agg(F.sum("_k").alias("total"), F.min("_a").alias("_a"), F.max("_b").alias("_b"), F.sum("_none").alias("_none"))
    if min_df == 2:
        counts = counts.where((F.col("_a") < F.col("_b")) | (F.col("_a").isNotNull() & (F.col("_none") > 0)))
    kept = sorted(r.term for r in counts.orderBy(F.col("total").desc(), "term").limit(max_terms).select("term").collect())  # the model: max_terms terms
    lengths, vocabulary, size = _lengths(terms), {t: i for i, t in enumerate(kept)}, max(len(kept), 1)
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, sums = _cut(*lengths, vocabulary), np.zeros(size, np.int64)
        for b in batches:
            for _, _, ids, _ in _known_counts(b.column(0), cut, size):
                sums += np.bincount(ids, minlength=size)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some])], ["term_id", "df"])

    rows = _one_row_a_key(df, key, _units(terms)).select("_u")
    found = dict(rows.mapInArrow(run, "term_id int, df long").groupBy("term_id").agg(F.sum("df").alias("df")).collect())  # one row a kept term
    n = df.count()
    told = [(t, i, float(np.log((1.0 + n) / (1.0 + found[i])) + 1.0)) for i, t in enumerate(kept)]
    return spark.createDataFrame(told, "term string, term_id int, idf double")


def apply_tfidf(df: DataFrame, key: str, terms: Column | WordNgrams, vocabulary: DataFrame, max_terms: int = 20_000) -> DataFrame:
    """key, cells (array of term, term_id, weight by term_id): (1 + ln tf) * idf, each row of length 1. Rows without known terms are left out.

    The vocabulary holds max_terms rows at most, and is sent to the tasks, which
    count its terms in Arrow batches, if that is up to BROADCAST_TERMS.
    """
    if max_terms > BROADCAST_TERMS:
        w = _term_counts(df, key, terms).join(vocabulary, "term").select(key, F.struct("term_id", "term", ((1.0 + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("w")).alias("c"))
        per = w.groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("cells"), F.sqrt(F.sum(F.col("c.w") ** 2)).alias("norm"))
        return per.select(key, F.transform("cells", lambda x: F.struct(x["term"].alias("term"), x["term_id"].alias("term_id"), (x["w"] / F.col("norm")).alias("weight"))).alias("cells"))
    model = vocabulary.select("term", "term_id", "idf").orderBy("term_id").collect()  # max_terms rows
    known, ids_of, idf = {r.term: i for i, r in enumerate(model)}, [r.term_id for r in model], [r.idf for r in model]
    lengths, size = _lengths(terms), max(len(model), 1)
    bounded_batches(df.sparkSession)
    rows = _one_row_a_key(df, key, _units(terms))
    cell = T.StructType().add("term", "string").add("term_id", "integer").add("weight", "double")
    schema = T.StructType([rows.schema[key], T.StructField("cells", T.ArrayType(cell))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _cut(*lengths, known)
        names, numbers, factors = pa.array(list(known), pa.string()), pa.array(ids_of, pa.int32()), np.array(idf)
        for b in batches:
            at = 0
            for n, row, ids, counts in _known_counts(b.column(1), cut, size):
                keys, at = b.column(0).slice(at, n), at + n
                if not len(ids):
                    continue
                w = (1.0 + np.log(counts)) * factors[ids]
                per = np.bincount(row, minlength=n)
                w /= np.sqrt(np.bincount(row, weights=w * w, minlength=n))[row]
                some = np.flatnonzero(per)
                of = pa.array(ids)
                cells = pa.StructArray.from_arrays([names.take(of), numbers.take(of), pa.array(w)], ["term", "term_id", "weight"])
                offsets = pa.array(np.concatenate([[0], np.cumsum(per[some])]), pa.int32())
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(some)), pa.ListArray.from_arrays(offsets, cells)], schema.names)

    return rows.mapInArrow(run, schema)


def tfidf(df: DataFrame, key: str, terms: Column | WordNgrams, min_df: int = 2, max_terms: int = 20_000) -> DataFrame:
    """key, term, weight: fitted on df and applied to it."""
    out = apply_tfidf(df, key, terms, fit_tfidf(df, key, terms, min_df, max_terms), max_terms)
    return out.select(key, F.inline("cells")).drop("term_id")


def tfidf_vectors(cells: DataFrame, key: str, size: int) -> DataFrame:
    """key, features: the rows of apply_tfidf as sparse vectors of the vocabulary's size, whole Arrow batches at a time."""
    from pyspark.ml.linalg import VectorUDT

    rows = cells.select(key, F.transform("cells", lambda x: x["term_id"]).alias("i"), F.transform("cells", lambda x: x["weight"]).alias("w"))
    schema = T.StructType([rows.schema[key], T.StructField("features", VectorUDT())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            sparse, width = pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.StructArray.from_arrays([sparse, width, b.column(1), b.column(2)], ["type", "size", "indices", "values"])], schema.names)

    return rows.mapInArrow(run, schema)


def fit_text_classifier(train: DataFrame, key: str, text_col: str, label: str, max_terms: int = 20_000, max_iter: int = 200):
    """N-gram TF-IDF and a balanced linear head fitted on the training rows; returns a function df -> df with prediction and confidence.

    Rows without any known term get the vector of zeros.
    """
    vocabulary = fit_tfidf(train, key, word_ngrams(F.col(text_col)), 2, max_terms).persist()  # max_terms rows
    size = max(vocabulary.count(), 1)

    def vectors(df: DataFrame) -> DataFrame:
        known = apply_tfidf(df, key, word_ngrams(F.col(text_col)), vocabulary, max_terms)
        none = F.array().cast(known.schema["cells"].dataType)
        return df.join(tfidf_vectors(df.select(key).join(known, key, "left").select(key, F.coalesce("cells", none).alias("cells")), key, size), key)

    fitted_on = vectors(train).persist()
    head = fit_linear_head(fitted_on, label, max_iter=max_iter)
    fitted_on.unpersist()
    return lambda df: head(vectors(df)).drop("features")


def fit_fields(train: DataFrame, key: str, text_col: str, fields: list[str], max_terms: int = 20_000, max_iter: int = 200):
    """One balanced linear head a field over the same n-gram TF-IDF vectors; returns a function (df, truth) -> long predictions.

    The training texts are vectorised once, written with their labels, and every
    head is fitted on that table; a head leaves out rows whose label is null.
    Applying vectorises once too: the heads follow one another on the row.
    Predictions: key, field, label, confidence, and with truth=True the row's
    own label as `truth`, as `field_scores` takes them.
    """
    names = {f: f"y{i}" for i, f in enumerate(fields)}
    plain = lambda df, own: df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text_col}`").alias("text"), *([F.col(f"`{f}`").cast("string").alias(n) for f, n in names.items()] if own else []))
    rows = plain(train, True)
    vocabulary = written(fit_tfidf(rows, "key", word_ngrams(F.col("text")), 2, max_terms), "vocabulary")  # max_terms rows
    size = max(vocabulary.count(), 1)

    def vectors(df: DataFrame) -> DataFrame:
        known = apply_tfidf(df, "key", word_ngrams(F.col("text")), vocabulary, max_terms)
        none = F.array().cast(known.schema["cells"].dataType)
        ids = df.select("key").distinct()
        return df.join(tfidf_vectors(ids.join(known, "key", "left").select("key", F.coalesce("cells", none).alias("cells")), "key", size), "key").drop("text")

    table = written(vectors(rows), "field-vectors")
    heads = {f: fit_linear_head(table.where(F.col(n).isNotNull()), n, max_iter=max_iter) for f, n in names.items()}

    def predict(df: DataFrame, truth: bool = False) -> DataFrame:
        out = vectors(plain(df, truth))
        for f, head in heads.items():
            out = head(out).withColumnsRenamed({"prediction": f"p_{names[f]}", "confidence": f"c_{names[f]}"})
        cells = [F.struct(F.lit(f).alias("field"), F.col(f"p_{n}").alias("label"), F.col(f"c_{n}").alias("confidence"), *([F.col(n).alias("truth")] if truth else [])) for f, n in names.items()]
        return out.select(F.col("key").alias(key), F.inline(F.array(*cells)))

    return predict


def field_scores(predictions: DataFrame) -> DataFrame:
    """field, n, exact_accuracy, macro_f1 of predictions with their truth; rows without truth aren't scored."""
    rows = predictions.where("truth is not null")
    exact = rows.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("truth") == F.col("label")).cast("double")), 6).alias("exact_accuracy"))
    return exact.join(metrics.macro_f1(rows, "truth", "label", "field").drop("n_labels"), "field")


def fit_linear_head(train: DataFrame, label: str, features: str = "features", c: float = 1.0, max_iter: int = 200):
    """Balanced multinomial logistic regression; returns a function df -> df with prediction and probability.

    One class alone gives a constant with probability 1.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IndexToString, StringIndexer

    counts = {r[0]: r[1] for r in train.groupBy(label).agg(F.count(F.lit(1))).collect()}  # one row a class
    if not counts:
        raise ValueError("no training rows")
    if len(counts) == 1:
        only = next(iter(counts))
        return lambda df: df.withColumns({"prediction": F.lit(only).cast("string"), "confidence": F.lit(1.0)})
    n = sum(counts.values())
    weight = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (str(k), n / (len(counts) * v))])
    rows = train.withColumn("_l", F.col(label).cast("string")).withColumn("_w", weight[F.col("_l")])
    index = StringIndexer(inputCol="_l", outputCol="_y", stringOrderType="alphabetAsc").fit(rows)
    model = Pipeline(stages=[index, LogisticRegression(featuresCol=features, labelCol="_y", weightCol="_w", regParam=1.0 / (c * n), standardization=False, maxIter=max_iter, family="multinomial", predictionCol="_k", probabilityCol="_probability", rawPredictionCol="_raw")]).fit(rows).stages[-1]
    back = IndexToString(inputCol="_k", outputCol="prediction", labels=index.labels)

    def predict(df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out = back.transform(model.transform(df))
        return out.withColumn("confidence", F.array_max(vector_to_array("_probability"))).drop("_k", "_raw", "_probability")

    return predict


def embedding_features(df: DataFrame, embedding: str, size: int | None = None) -> DataFrame:
    """A vector column from a frozen encoder's arrays; wrong sizes and non-finite numbers raise."""
    from pyspark.ml.functions import array_to_vector

    c = F.col(embedding)
    bad = F.exists(c, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    if size is not None:
        bad = bad | (F.size(c) != size)
    checked = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("embedding of wrong size or not finite"))).otherwise(c)
    return df.withColumn("features", array_to_vector(checked.cast("array<double>")))


def phrase_spans(df: DataFrame, text_col: str, phrases: list[str], name: str = "spans") -> DataFrame:
    """df with every occurrence of every phrase, overlapping ones too, as (index of the phrase, start, end) in code points.

    One pass of a multi-pattern automaton over each text, whatever the number of
    phrases, which every task builds for itself: they are a vocabulary, not data.
    A null text has no spans; repeated and empty phrases are refused.
    """
    import pyarrow as pa

    if len(set(phrases)) != len(phrases) or not all(phrases):
        raise ValueError("phrases must be different and not empty")
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.StructType().add("phrase", "integer").add("start", "integer").add("end", "integer")))])

    def run(batches):
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, p in enumerate(phrases):
            found.add_word(p, (i, len(p)))
        if phrases:
            found.make_automaton()
        long, none = np.array([len(p) for p in phrases], np.int32), np.empty(0, np.int32)
        for b in batches:
            ends, ids, starts = [0], array("i"), array("i")
            for t in b.column(b.schema.get_field_index(text_col)):
                t = t.as_py()
                for at, (i, n) in found.iter(t) if t and phrases else ():
                    ids.append(i)
                    starts.append(at + 1 - n)
                ends.append(len(ids))
            # flat numbers, not an object a span: a text may hold very many
            phrase, start = np.frombuffer(ids, np.int32) if ids else none, np.frombuffer(starts, np.int32) if ids else none
            spans = pa.StructArray.from_arrays([pa.array(phrase), pa.array(start), pa.array(start + long[phrase])], ["phrase", "start", "end"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)], schema.names)

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def phrase_labels(df: DataFrame, key: str, text_col: str, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """key, field, label, status, evidence (array of phrase, start, end) of the fields that a text speaks of: weak labels, never references.

    patterns: (phrase, field, label).  A field with one label is explicit, with
    several ambiguous (label null).  All that concerns a text is on its row, so
    nothing is shuffled.
    """
    rows = phrase_spans(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text_col}`").alias("text")), "text", [p for p, _, _ in patterns])
    table = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(f).alias("field"), F.lit(v).alias("label")) for p, f, v in patterns])
    told = F.transform("spans", lambda s: F.struct(F.get(table, s["phrase"]).alias("of"), s["start"].alias("start"), s["end"].alias("end")))
    rows = rows.where(F.size("spans") > 0).select("key", told.alias("told"))
    fields = F.array_sort(F.array_distinct(F.transform("told", lambda t: t["of"]["field"])))
    per = rows.select("key", "told", F.explode(fields).alias("field"))
    own = F.filter("told", lambda t: t["of"]["field"] == F.col("field"))
    labels = F.array_distinct(F.transform(own, lambda t: t["of"]["label"]))
    evidence = F.transform(own, lambda t: F.struct(t["of"]["phrase"].alias("phrase"), t["start"].alias("start"), t["end"].alias("end")))
    status = F.when(F.size(labels) == 1, "explicit").otherwise("ambiguous")
    return per.select(F.col("key").alias(key), "field", F.when(F.size(labels) == 1, labels[0]).alias("label"), status.alias("status"), evidence.alias("evidence"))


def template_labels(df: DataFrame, template_id: str, table: DataFrame) -> DataFrame:
    """Weak labels by template id: a lookup in a table (template_id, label columns); an unknown template raises."""
    own = table.withColumnRenamed("template_id", template_id)
    out = df.join(own.withColumn("_hit", F.lit(True)), template_id, "left")
    return out.where(F.coalesce("_hit", F.raise_error(F.concat(F.lit("no template "), F.col(template_id).cast("string"))).cast("boolean"))).drop("_hit")


def ranked(df: DataFrame, score: str, tie: str, *by: str) -> DataFrame:
    """The first row of each group by falling score, then rising tie."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
