"""PII: exact base patterns, and bootstrapped contextual extraction.

Base spans (e-mail, IP, card, phone) and long strings of mixed hexadecimal digits
or of capitals and digits are the seeds.  Each identifier-like token and each
seed occurs in lexical patterns: the word before it and what connects them, and
of an identifier that begins with four capitals these and its length.  On the graph of patterns and instances
Spark alternates between two scores: a pattern's confidence is the share of its
distinct instances that are known identifiers, an instance's the probability
that not all its confident patterns err; instances above ACCEPT become known.
This goes on until no instance becomes known; then tokens in confident patterns and
known instances are spans too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.textops import by_chunk
from quillon.llm.workdir import mapped, written

#: A pattern counts from this many distinct known instances and this confidence; an instance becomes known above ACCEPT.
SUPPORT, CONFIDENT, ACCEPT = 5, 0.7, 0.7

# The base patterns and their order.
KINDS = ("email", "ip", "card", "phone")
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]+"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")  # an e-mail address: a local part, "@", a domain
_ROW = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # of a row of dotted numbers each four are an IP address
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")
_TOKEN = re.compile(r"""[^\s"'<>()\[\]{},;=:|]{6,}""")
#: Seeds besides the base kinds: 16 or more hexadecimal digits, or capitals and digits, with both letters and digits.
_SECRET = re.compile(r"(?=[0-9a-fA-F]*[0-9])(?=[0-9]*[a-fA-F])[0-9a-fA-F]{16,}|(?=[0-9A-Z]*[0-9])(?=[0-9]*[A-Z])[0-9A-Z]{16,}")
#: Four capitals that begin an identifier: with its length they are a pattern too.
_HEAD = re.compile(r"[A-Z]{4}[0-9A-Z]+")
_BEFORE = re.compile(r"""(\w{1,40})([\s"'<>()\[\]{},;=:|]{1,8})$""")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping addresses in one pass: a match ends its local part at an "@" and begins it at the start of that run of characters, or where the match before has ended."""
    out, done = [], 0
    for run in LOCAL.finditer(text):
        start, at = max(run.start(), done), run.end()
        if start < at < len(text) and text[at] == "@" and (domain := DOMAIN.match(text, at + 1)):
            done = domain.end()
            out.append(("email", start, done))
    return out


def _ips(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping groups of four in each longest row of dotted numbers, those with parts of at most 255."""
    out = []
    for row in _rows(text):
        parts, at = row[0].split("."), row.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in four):
                out.append(("ip", at, end))
            at = end + 1
    return out


def _rows(text: str) -> Iterator[re.Match]:
    """Longest rows of dotted numbers with three dots or more; a long number before a dot is read once."""
    return (m for m in _ROW.finditer(text) if m[0].count(".") >= 3)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All base spans by kind, then start; code points, end exclusive. Matches that fail their test are dropped without another try."""
    out = []
    if "@" in text:
        out += _emails(text)
    if _DIGITS.search(text):
        if "." in text:
            out += _ips(text)
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = _join(m[0])
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_join(m[0])) <= 15]
    return out


def _join(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _number(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def occurrences(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """Seeds and identifier-like tokens with their instance and pattern. Tokens that overlap a base span are left to it."""
    if not base and not _DIGITS.search(text):
        return []
    taken = sorted((s, e) for _, s, e in base)
    found = [(s, e, kind) for kind, s, e in base]
    i = 0
    for m in _TOKEN.finditer(text):
        s, e = m.start(), m.end()
        while e > s and text[e - 1] in ".!?*#$%&":
            e -= 1
        if e - s < 6 or not _DIGITS.search(text, s, e):
            continue
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if i < len(taken) and taken[i][0] < e:
            continue
        found.append((s, e, "secret" if _SECRET.fullmatch(text, s, e) else None))
    out = []
    for s, e, kind in found:
        m = _BEFORE.search(text[max(0, s - 48) : s])
        pattern = _number(f"{m[1].lower()}\0{' '.join(m[2].split()) or ' '}") if m else None
        one = {"start": s, "end": e, "instance": _number(text[s:e]), "pattern": pattern, "seed": kind, "base": kind in KINDS}
        out.append(one)
        if _HEAD.fullmatch(text, s, e):
            out.append(one | {"pattern": _number(f"{text[s : s + 4]}\1{e - s}")})
    return out


OCCURRENCE = T.StructType().add("start", "integer").add("end", "integer").add("instance", "long").add("pattern", "long").add("seed", "string").add("base", "boolean")


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType().add("row", "long")
    schema = T.StructType([*schema, rows.schema["doc_id"]])
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    schema = schema.add("base", "string").add("found", T.ArrayType(OCCURRENCE))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("pattern", pa.int64()), ("seed", pa.string()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 36

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal at
            counts: list[list[int]] = [[] for _ in KINDS]
            spans, found = [], []
            for text in b.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                for c, k in zip(counts, KINDS):
                    c.append(sum(x[0] == k for x in base))
                spans.append(",".join(f"{k}:{s}:{e}" for k, s, e in base))
                found.append(occurrences(text, base))
            ids = pa.array(range(at, at + b.num_rows), pa.int64())
            at += b.num_rows
            return pa.RecordBatch.from_arrays([ids, b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(spans, pa.string()), pa.array(found, kind)], schema.names)

        return by_chunk(one)(batches)

    return mapped(rows, run, schema)


def bootstrap(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patterns, instances) that are confident once nothing new becomes known: pattern, kind, confidence; instance, kind.

    places: instance, pattern, seed. Counts are of distinct pattern-instance
    links, so a copied text counts once; both groupings are combined before the
    shuffle, so a hot pattern or instance is a sum, not a group.
    """
    links = written(places.where("pattern is not null").select("pattern", "instance").distinct(), "pii-links")
    known = places.where("seed is not null").groupBy("instance").agg(F.min("seed").alias("kind"))
    known = written(known, "pii-known0")
    turn = 0
    while True:
        turn += 1
        judged = links.join(known, "instance", "left")
        tally = judged.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n"))
        best = F.max(F.when(F.col("kind").isNotNull(), F.struct("n", "kind")))
        per = tally.groupBy("pattern").agg(F.sum("n").alias("all"), best.alias("best")).where(F.col("best").isNotNull())
        per = per.select("pattern", "best.kind", F.col("best.n").alias("support"), (F.col("best.n") / F.col("all")).alias("confidence"))
        patterns = written(per.where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENT)).select("pattern", "kind", "confidence"), f"pii-patterns{turn}")
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("confidence")))))
        grown = links.join(patterns, "pattern").groupBy("instance").agg((1 - doubt).alias("sure"), F.max(F.struct("confidence", "kind"))["kind"].alias("kind")).where(F.col("sure") >= ACCEPT).select("instance", "kind")
        fresh = written(grown.join(known.select("instance"), "instance", "left_anti"), f"pii-fresh{turn}")
        if not fresh.limit(1).count():
            return patterns, known
        known = written(known.unionByName(fresh), f"pii-known{turn}")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (all of them, long).

    spans: kind:start:end of base spans and of what the bootstrapping adds, base
    kinds first, then by start. A null or empty text has none (an empty string);
    repeated rows have equal results; an empty table gives no rows.
    """
    scanned = written(_scanned(docs, id_col, text_col), "pii-scanned")
    places = written(scanned.select("row", F.explode("found").alias("o")).select("row", "o.*"), "pii-places")
    patterns, known = bootstrap(places)
    seen = known.join(places.where("seed is not null and not base").select("instance").distinct(), "instance", "left_anti")  # a secret seed needs a confident pattern
    new = places.where(~F.col("base")).join(patterns.select("pattern", F.col("kind").alias("by_pattern")), "pattern", "left").join(seen.select("instance", F.col("kind").alias("by_instance")), "instance", "left")
    kind = F.coalesce("seed", "by_pattern", "by_instance")
    new = new.where("by_pattern is not null or by_instance is not null").groupBy("row").agg(F.array_sort(F.collect_set(F.struct(kind.alias("kind"), F.col("start"), F.col("end")))).alias("more"))
    out = scanned.drop("found").join(new, "row", "left")
    base = F.filter(F.split("base", ","), lambda x: x != "")
    parsed = F.transform(base, lambda x: F.struct(F.split(x, ":")[0].alias("kind"), F.split(x, ":")[1].cast("int").alias("start"), F.split(x, ":")[2].cast("int").alias("end")))
    order = F.transform(F.concat(parsed, F.coalesce("more", F.array().cast(parsed_type()))), lambda x: F.struct(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]), F.lit(0)), F.lit(9)).alias("o"), x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    text = F.transform(F.array_sort(order), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_join(text, ","))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"), (F.size(base) + F.coalesce(F.size("more"), F.lit(0))).cast("long").alias("n_spans"))


def parsed_type() -> str:
    return "array<struct<kind:string,start:int,end:int>>"
