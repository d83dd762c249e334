"""Benchmark decontamination by template canonicalisation, DataFrame functions only.

Numbers, units after numbers and names (capitalised words inside a sentence)
become typed placeholders, everything else is lower-cased, and all windows of
WINDOW tokens of the documents are hash-joined to the windows of the benchmark
items.  A diagonal (document position minus item position) counts only if its
slots are consistent: each value of the item stands for one value in the
document.  So a question with other numbers or names is caught, and a table of
unrelated numbers is not.  Windows that are mostly placeholders are joined with
their values, and items shorter than a window as a whole with theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.workdir import written

WINDOW = 8
#: A window with fewer tokens that are not placeholders must have equal values.
PLAIN = 4
#: A document is contaminated by an item of which it holds this many tokens, or this share.
COVERED, SHARE = 13, 0.6
#: Plain tokens of an anchor, and what must hold where an item is laid over a document: matching plain tokens at least, their share of the item's, and the share of all its tokens.
ANCHORS = (4, 3)
PLAIN_FOUND, PLAIN_SHARE, LAID_SHARE = 3, 0.75, 0.8
#: Windows of the benchmark, or keys of candidate documents, that are broadcast; beyond it joins are shuffled.
BROADCAST_ROWS = 1_000_000

# Units of measure that become placeholders after a number.
UNITS = "%|°c|°f|kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|ft|in|yd|l|ml|s|ms|min|h|hr|hz|khz|mhz|ghz|w|kw|v|a|j|kj|n|pa|kb|mb|gb|tb|bit|bits|byte|bytes|usd|eur|gbp|dollars|euros|pounds|cents|meters|metres|kilometers|kilometres|miles|feet|inches|grams|kilograms|liters|litres|seconds|minutes|hours|days|weeks|months|years|degrees|percent"
_MARK = "\x01"
#: Scripts without spaces between words: each character is a token.
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
#: The same; ASCII, which holds none of them, is told apart first.
_UNSPACED_WIDE = rf"[^\x00-\x7F]&&[{_UNSPACED}]"


def tokens(text: Column) -> Column:
    """Tokens of a text; a placeholder token is the mark, its type (n, d or u) and the lower-cased value.

    They are numbers, single characters of unspaced scripts and runs of letters, % and °; what is none of them becomes a space to split at.
    """
    t = F.coalesce(text, F.lit(""))
    t = F.replace(t, F.lit(_MARK), F.lit(" "))
    t = F.regexp_replace(t, r"(?=\p{Lu})(?<=[\p{Ll},;] )\p{Lu}\p{Ll}+", _MARK + "n$0")
    t = F.lower(F.regexp_replace(t, r"\p{Nd}+(?:[.,:/]\p{Nd}+)*", f" {_MARK}d$0 "))
    t = F.when(t.contains(_MARK + "d"), F.regexp_replace(t, rf"(?<=\p{{Nd}} ) ?({UNITS})(?![\p{{L}}\p{{Nd}}])", _MARK + "u$1")).otherwise(t)
    t = F.regexp_replace(t, rf"[{_UNSPACED_WIDE}&&[^\p{{Nd}}]]", " $0 ")
    # the mark stands before every number, so a point or the like before a digit is inside one
    t = F.regexp_replace(t, rf"[^ a-z\p{{L}}\p{{M}}\p{{Nd}}%°{_MARK}.,:/[{_UNSPACED_WIDE}]]|[.,:/](?!\p{{Nd}})", " ")
    return F.array_remove(F.split(t, " "), "")


def _is_slot(token: Column) -> Column:
    return token.startswith(_MARK)


def _codes(tokens_col: Column) -> Column:
    """A long for each token: its hash, with 0 as the last two bits for a plain token, else the type of the slot."""
    kind = lambda t: F.when(t.startswith(_MARK + "n"), 1).when(t.startswith(_MARK + "d"), 2).otherwise(3)
    return F.transform(tokens_col, lambda t: F.when(~_is_slot(t), F.shiftleft(F.xxhash64(t), 2)).otherwise(F.shiftleft(F.xxhash64(t), 2).bitwiseOR(kind(t))))


def _kind(code: Column) -> Column:
    return code.bitwiseAND(F.lit(3))


def _places(n: Column) -> Column:
    """0 to n - 1, to be exploded: keys are made of rows, as Spark compiles these and not the lambdas of arrays."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))


def _once(rows: DataFrame, name: str, value: Column, *keep: str) -> DataFrame:
    """rows[keep] with a computed array that later expressions read but never compute again (a generator isn't inlined)."""
    return rows.select(*keep, F.explode(F.array(value)).alias(name))


def _coded(rows: DataFrame, *keep: str) -> DataFrame:
    """rows (t: tokens) with c, their codes."""
    return _once(rows, "c", _codes(F.col("t")), *keep)


def _windows(rows: DataFrame, *keep: str) -> DataFrame:
    """rows (c: codes) as keep, pos, window: keys of all windows, of the types or, where fewer than PLAIN tokens are no slots, of the values."""
    at = rows.select(*keep, "c", F.explode(_places(F.size("c") - (WINDOW - 1))).alias("pos"))
    values = [F.get("c", F.col("pos") + j) for j in range(WINDOW)]
    slots = sum((F.when(_kind(x) != 0, 1).otherwise(0) for x in values[1:]), F.when(_kind(values[0]) != 0, 1).otherwise(0))
    typed = F.xxhash64(*[F.when(_kind(x) == 0, x).otherwise(_kind(x)) for x in values])
    return at.select(*keep, "pos", F.when(slots <= WINDOW - PLAIN, typed).otherwise(F.xxhash64(*values, F.lit(WINDOW))).alias("window"))


def _whole(c: Column, pos: Column, length: int) -> Column:
    """Key of the stretch of length tokens from pos on, with their values; null if it ends outside."""
    return F.when(pos + length <= F.size(c), F.xxhash64(F.lit(length), *[F.get(c, pos + j) for j in range(length)]))


def _item_tokens(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id (a struct, so that items without an id meet like others), t (tokens)."""
    return _once(benchmark.select(F.struct(F.col(id_col).alias("id")).alias("item_id"), F.col(text_col).alias("text")), "t", tokens(F.col("text")), "item_id").distinct()


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, length (tokens), ipos, window, values (the WINDOW tokens). Items of fewer tokens than a window have none, see short_items."""
    rows = _windows(_coded(_item_tokens(benchmark, id_col, text_col), "item_id", "t"), "item_id", "t")
    return rows.select("item_id", F.size("t").alias("length"), F.col("pos").alias("ipos"), "window", F.slice("t", F.col("pos") + 1, WINDOW).alias("values"))


def short_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, length, slots (distinct ones), window (key of the whole item) of the items of 1 to WINDOW - 1 tokens."""
    rows = _coded(_item_tokens(benchmark, id_col, text_col).where(F.size("t").between(1, WINDOW - 1)), "item_id", "t")
    key = F.coalesce(*[F.when(F.size("t") == n, _whole(F.col("c"), F.lit(0), n)) for n in range(1, WINDOW)])
    return rows.select("item_id", F.size("t").alias("length"), F.size(F.array_distinct(F.filter("t", _is_slot))).alias("slots"), key.alias("window"))


def _short_leaks(rows: DataFrame, short: DataFrame) -> DataFrame:
    """leaks of the short items: verbatim, as a whole."""
    lengths = sorted(r["length"] for r in short.select("length").distinct().collect())  # at most WINDOW - 1
    few = short.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    c = _coded(_once(rows, "t", tokens(F.col("text")), "k1", "k2", "doc_id"), "k1", "k2", "doc_id")
    at = c.select("k1", "k2", "doc_id", "c", F.explode(_places(F.size("c"))).alias("pos"))
    keys = at.select("k1", "k2", "doc_id", F.explode(F.array(*[_whole(F.col("c"), F.col("pos"), n) for n in lengths])).alias("window"))
    found = (keys if few else keys.distinct()).join(F.broadcast(short) if few else short, "window")
    return found.select("k1", "k2", "doc_id", "item_id", F.col("length").cast("long").alias("covered"), F.lit(1.0).alias("share"), F.col("slots").cast("long").alias("slots")).distinct()


def _typed(token: Column) -> Column:
    return F.when(_is_slot(token), F.substring(token, 1, 2)).otherwise(token)


def _plain_places(c: Column) -> Column:
    """Where the tokens are that aren't placeholders (c: codes)."""
    every = F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: _kind(F.get(c, i)) == 0)


def _with_places(rows: DataFrame, *keep: str) -> DataFrame:
    """rows (t: tokens) with c, their codes, and p, the places of the plain ones."""
    return _once(_coded(rows, *keep), "p", _plain_places(F.col("c")), *keep, "c")


def _anchors(rows: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """rows (c: codes, p: places of the plain tokens) as keep, m, key, pos: the anchors of m plain tokens, for each m of sizes; pos is the place of the first."""
    at = rows.select(*keep, "c", "p", F.explode(_places(F.size("p"))).alias("k"))
    place = [F.get("p", F.col("k") + j) for j in range(max(sizes))]

    def anchor(m: int) -> Column:
        told = [F.get("c", place[0])]
        for j in range(1, m):
            told += [place[j] - place[j - 1], F.get("c", place[j])]
        return F.struct(F.lit(m).alias("m"), F.when(place[m - 1] - place[0] >= m, F.xxhash64(F.lit(m), *told)).alias("key"))

    found = at.select(*keep, place[0].alias("pos"), F.explode(F.array(*[anchor(m) for m in sizes])).alias("a"))
    return found.select(*keep, "a.m", "a.key", "pos").where(F.col("key").isNotNull())


def item_anchors(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, t, m, key, pos: anchors of the items with placeholders and three plain tokens or more; of an item with three plain tokens only those of three."""
    rows = _with_places(_item_tokens(benchmark, id_col, text_col), "item_id", "t").where(F.size("p").between(min(ANCHORS), F.size("t") - 1))
    m = F.when(F.size("p") >= ANCHORS[0], ANCHORS[0]).otherwise(ANCHORS[1])
    found = _anchors(rows.withColumn("own", m), sorted(ANCHORS), "item_id", "t", "own")
    return found.where(F.col("m") == F.col("own")).select("item_id", "t", "m", "key", "pos")


def _laid(item: Column, doc: Column, diagonal: Column) -> Column:
    """array<struct<item, doc>>: each token of the item with the one that lies under it, which is null outside the document."""
    under = F.transform(F.sequence(F.lit(0), F.size(item) - 1), lambda i: F.get(doc, i + diagonal))
    return F.zip_with(item, under, lambda a, b: F.struct(a.alias("item"), b.alias("doc")))


def _anchored_leaks(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """leaks of re-parameterised items, whatever their length: slots must stand for one another one-to-one."""
    few = anchors.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sizes = [r["m"] for r in anchors.select("m").distinct().collect()]  # at most two
    d = _with_places(_once(rows, "t", tokens(F.col("text")), "k1", "k2"), "k1", "k2")
    hit = anchors.select("item_id", "key", F.col("pos").alias("ipos"))
    found = _anchors(d, sorted(sizes), "k1", "k2").join(F.broadcast(hit) if few else hit, "key")
    found = written(found.select("k1", "k2", "item_id", (F.col("pos") - F.col("ipos")).alias("diagonal")).distinct(), "decontam-anchored")
    keys = written(found.select("k1", "k2").distinct(), "decontam-anchored-keys")
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    again = _once(rows.join(F.broadcast(keys) if small else keys, ["k1", "k2"]).dropDuplicates(["k1", "k2"]), "t", tokens(F.col("text")), "k1", "k2", "doc_id").withColumnRenamed("t", "own")
    items = anchors.select("item_id", "t").distinct()
    laid = found.join(F.broadcast(items) if few else items, "item_id").join(again, ["k1", "k2"])
    laid = _once(laid, "pairs", F.filter(_laid(F.col("t"), F.col("own"), F.col("diagonal")), lambda p: _typed(p["item"]) == _typed(p["doc"])), "k1", "k2", "doc_id", "item_id", "t")
    slots = F.array_distinct(F.filter("pairs", lambda p: _is_slot(p["item"])))
    laid = laid.select("k1", "k2", "doc_id", "item_id", F.size("t").alias("length"), F.size(F.filter("t", lambda x: ~_is_slot(x))).alias("n_plain"), F.size("pairs").alias("covered"), F.size(F.filter("pairs", lambda p: ~_is_slot(p["item"]))).alias("plain"), slots.alias("slots"))
    side = lambda name: F.size(F.array_distinct(F.transform("slots", lambda p: p[name])))
    one_to_one = (side("item") == F.size("slots")) & (side("doc") == F.size("slots"))
    enough = (F.col("plain") >= PLAIN_FOUND) & (F.col("plain") >= PLAIN_SHARE * F.col("n_plain")) & (F.col("covered") >= LAID_SHARE * F.col("length"))
    return laid.where(one_to_one & enough).select("k1", "k2", "doc_id", "item_id", F.col("covered").cast("long").alias("covered"), (F.col("covered") / F.col("length")).alias("share"), F.size("slots").cast("long").alias("slots"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.select(F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2"), "doc_id", "text")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per contaminated document and item: k1, k2 (row key), doc_id, item_id, covered (tokens of the item found), share, slots (distinct consistent slot pairs).

    Null and empty texts hold nothing; equal rows are one row here; an item that
    occurs twice in the benchmark under one id counts once; items without an id
    are found like others (item_id is null); an empty benchmark
    or document table gives no rows.
    """
    items = written(item_windows(benchmark), "decontam-items")
    few = items.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hit = items.select("item_id", "ipos", "window")
    rows = _keyed(docs, id_col, text_col)
    found = _windows(_coded(_once(rows, "t", tokens(F.col("text")), "k1", "k2"), "k1", "k2"), "k1", "k2")
    found = written(found.join(F.broadcast(hit) if few else hit, "window").select("k1", "k2", "item_id", "pos", "ipos").distinct(), "decontam-hits")
    # a short stretch can't be enough: these go no further
    enough = found.groupBy("k1", "k2", "item_id").agg(F.count_distinct("ipos").alias("n"))
    most = F.col("n") * WINDOW
    length = items.groupBy("item_id").agg(F.max("length").alias("length"))
    enough = enough.join(F.broadcast(length) if few else length, "item_id").where((most >= COVERED) | (most >= SHARE * F.col("length")))
    found = found.join(enough.select("k1", "k2", "item_id"), ["k1", "k2", "item_id"])
    keys = written(found.select("k1", "k2").distinct(), "decontam-keys")
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    again = _once(rows.join(F.broadcast(keys) if small else keys, ["k1", "k2"]).dropDuplicates(["k1", "k2"]), "t", tokens(F.col("text")), "k1", "k2", "doc_id")
    full = items.select("item_id", "ipos", "length", "values")
    hits = found.join(F.broadcast(full) if few else full, ["item_id", "ipos"]).join(again, ["k1", "k2"])
    own = F.slice("t", F.col("pos") + 1, WINDOW)
    pairs = F.filter(F.zip_with("values", own, lambda a, b: F.struct(a.alias("item"), b.alias("doc"))), lambda p: _is_slot(p["item"]))
    hits = hits.select("k1", "k2", "doc_id", "item_id", "length", "ipos", (F.col("pos") - F.col("ipos")).alias("diagonal"), pairs.alias("pairs"))
    valued = F.size("pairs") > WINDOW - PLAIN  # joined with its values
    by_diagonal = hits.groupBy("k1", "k2", "doc_id", "item_id", "length", "diagonal").agg(F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"), F.collect_set("ipos").alias("all"), F.collect_set(F.when((F.size("pairs") == 0) | valued, F.col("ipos"))).alias("plain"))
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["item"])))
    kept = by_diagonal.select("k1", "k2", "doc_id", "item_id", "length", F.when(consistent, F.col("all")).otherwise(F.col("plain")).alias("at"), F.when(consistent, F.size("pairs")).otherwise(0).alias("slots"))
    at = F.array_sort(F.array_distinct(F.flatten(F.collect_list("at"))))
    out = kept.groupBy("k1", "k2", "doc_id", "item_id", "length").agg(at.alias("at"), F.max("slots").alias("slots"))
    covered = F.aggregate("at", F.struct(F.lit(-WINDOW).alias("p"), F.lit(0).alias("n")), lambda a, x: F.struct(x.alias("p"), (a["n"] + F.least(F.lit(WINDOW), x - a["p"])).alias("n")))["n"]
    out = out.withColumn("covered", covered.cast("long")).withColumn("share", F.col("covered") / F.col("length"))
    out = out.where((F.col("covered") >= COVERED) | (F.col("share") >= SHARE)).select("k1", "k2", "doc_id", "item_id", "covered", "share", F.col("slots").cast("long").alias("slots"))
    short = written(short_items(benchmark), "decontam-short")
    if short.limit(1).count():
        out = out.union(_short_leaks(rows, short))
    anchors = written(item_anchors(benchmark), "decontam-anchors")
    if anchors.limit(1).count():
        out = out.union(_anchored_leaks(rows, anchors)).groupBy("k1", "k2", "doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("covered", "share", "slots")])
    return out.withColumn("item_id", F.col("item_id.id"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that no item contaminates, with their own columns."""
    bad = written(leaks(docs, benchmark, id_col, text_col).select("k1", "k2").distinct(), "decontam-bad")
    few = bad.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(id_col, text_col).alias("k1"), F.hash(text_col, id_col).alias("k2"))
    return rows.join(F.broadcast(bad) if few else bad, ["k1", "k2"], "left_anti").select("row.*")
