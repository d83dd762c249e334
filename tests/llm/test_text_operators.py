"""License scans, fingerprints, PII, decontamination: brute force and planted cases."""

import hashlib
import re

from pyspark.sql import functions as F

from quillon.llm import decontam, fingerprints, licenses, pii

ODD_ROWS = [(1, None), (2, ""), (3, "x"), (4, "a b c"), (5, "é ü 中文 " * 500), (5, "é ü 中文 " * 500), (None, "no id"), (6, "Released under the MIT License. mit license\n" * 3)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, labels string, base int")


def plain_licenses(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_base_columns_are_exact_and_templates_add_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    notice = next(t for label, t in licenses.TEMPLATES if label == "gpl-3.0" and "redistribute" in t).title()
    rows = ODD_ROWS + [(100_000 + d.doc_id, d.text) for d in docs] + [(7, "intro words " + notice + " and more"), (8, "This program is free software"), (9, notice.replace("redistribute it", "share it freely"))]
    out = licenses.license_report(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(plain_licenses(t))
    for r in out:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) in want[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    by = {r.doc_id: r for r in out}
    assert "gpl-3.0" in by[7].labels and by[7].score == 1.0
    assert by[8].labels == "" and by[8].score == 0
    assert "gpl-3.0" in by[9].labels  # two diagonals, merged
    assert by[1].labels == by[2].labels == ""


def test_fingerprints_and_edits(spark):
    rows = [r for r in ODD_ROWS] + [(50, "the same long text " * 40), (51, "the same long text " * 40), (52, "quite other words here " * 40)]
    out = fingerprints.fingerprints(frame(spark, rows)).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = {}
    for k, (i, t) in enumerate(order):
        after, third = order[k - 1][1], len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        want.setdefault(i, []).append((len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.as_text(fingerprints.fingerprint(t)), fingerprints.as_text(fingerprints.fingerprint(edited)), fingerprints.likeness(fingerprints.fingerprint(t), fingerprints.fingerprint(after))))
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_next) in want[r.doc_id]
        assert 0 <= r.near_edited <= 1
    by = {r.doc_id: r for r in out}
    assert by[50].fingerprint == by[51].fingerprint and by[51].near_next == 1.0
    assert by[52].near_next < 0.5


def test_fingerprint_sketch_estimates_the_overlap_of_phrases():
    import random

    rnd = random.Random(2)
    a = "".join(rnd.choices("abcdefgh ", k=6000))
    b = a[:4000] + "".join(rnd.choices("stuvwxyz ", k=2000))
    x, y = fingerprints.phrases(a), fingerprints.phrases(b)
    true = len(x & y) / len(x | y)
    assert abs(fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(b)) - true) < 0.15


def plain_pii(text):
    text, out = text or "", []
    out += [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        s = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


PII = ["mail a.b@c.de, or x@y.z.w.", "ip 1.2.3.4 and 1.2.3.4.5 and 300.1.1.1 and 0001.2.3.4", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "call +49 (30) 1234-567 or +1 2", "+1+49 151 23456789", "ñandú @x.y a@b 4242424242424242é"]


def test_pii_base_spans_are_exact(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = ODD_ROWS + [(100_000 + d.doc_id, d.text) for d in docs] + [(200_000 + i, t) for i, t in enumerate(PII)]
    out = pii.pii_report(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    text = {i: t for i, t in rows}
    for r in out:
        spans = plain_pii(text[r.doc_id])
        told = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in spans) for k in pii.KINDS)
        assert set(filter(None, told.split(","))) <= set(r.spans.split(","))


def test_pii_patterns_discover_unseen_identifiers_and_leave_prose_alone(spark):
    mails = [(i, f"some words then contact: user{i}@mail.example now") for i in range(20)]
    unseen = [(100, "some words then contact: agent-4711-x now"), (101, "room 101-and-more is a place, see page12345 there")]
    out = {r.doc_id: r.spans for r in pii.pii_report(spark.createDataFrame(mails + unseen, "doc_id long, text string")).collect()}
    assert out[100] == "email:25:37"
    assert out[101] == ""


def test_pii_bootstrap_goes_on_until_nothing_new_is_known(spark):
    # pattern p holds seven instances of the pattern before and three of its own: one pattern more each turn
    steps = 7
    rows = [(i, p, "secret" if i < 10 else None) for p in range(steps) for i in range(3 * p, 3 * p + 10)]
    patterns, known = pii.bootstrap(spark.createDataFrame(rows, "instance long, pattern long, seed string"))
    assert {r.pattern for r in patterns.collect()} == set(range(steps))
    assert {r.instance for r in known.collect()} == set(range(3 * steps + 7))


def test_decontamination_finds_passages_and_checks_slots(spark):
    item = "In the year 1999 the farmer Smith sold 12 kg of apples to Jones for 30 dollars and then 12 more."
    other = "Plain words only make up this second item which is long enough to be found by any window"
    bench = spark.createDataFrame([(1, item), (2, other), (3, "too short"), (4, None)], "item_id long, text string")
    rows = [
        (1, "before it. " + item + " after it"), (2, item.replace("then 12", "then 13")), (3, item.replace("1999", "2005").replace("Smith", "Miller").replace("12", "77").replace("Jones", "Brown").replace("30", "99").replace("kg", "g")),
        (4, "one two three. " + other.upper() + " four"), (5, "nothing of it here, only some words that say little"), (6, None), (7, ""), (8, "numbers 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"), (1, "before it. " + item + " after it"),
        (9, " ".join(other.split()[:6])),
    ]
    docs = spark.createDataFrame([(i, t, 0, "h") for i, t in rows], "doc_id long, text string, k1 int, h string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert found == {(1, 1), (3, 1), (4, 2)}
    clean = decontam.clean(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [2, 5, 6, 7, 8, 9]
    assert decontam.leaks(docs.limit(0), bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_of_number_dense_and_short_items(spark):
    bench = spark.createDataFrame([(1, "Add 12, 15, 18, 21, 24, 27 and 30 together"), (2, "How many moons has Mars?"), (3, "Is 17 really a prime number?")], "item_id long, text string")
    texts = ["we read: add 12, 15, 18, 21, 24, 27 and 30 together, and more", "a table 1 2 3 4 5 6 7 8 9 10 11 12", "so how many moons has Mars? two", "how many moons has Venus?", "is 19 really a prime number?", "is 17 really a prime number?", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = decontam.leaks(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(0, 1), (2, 2), (4, 3), (5, 3)]
    assert {r.item_id: r.slots for r in rows}[3] == 1


def test_decontamination_of_questions_with_other_numbers_and_names(spark):
    """Short, number-dense and name-first questions, re-parameterised; and texts that only look like them."""
    items = {1: "What is 12 plus 31 times 4?", 2: "Add 12, 15, 18, 21, 24, 27 and 30 together", 3: "Peter buys 3 pens for 7 dollars each.", 4: "It costs 5 dollars", 5: "no placeholders in this one at all"}
    docs = {
        1: ("Warm-up: What is 45 plus 8 times 77? Think.", {1}), 2: ("First add 1, 2, 3, 4, 5, 6 and 7 together and then rest", {2}), 3: ("They said John buys 9 pens for 2 dollars each. Fine", {3}), 4: ("Yesterday. John buys 9 pens for 2 euros each", {3}),
        5: (items[1], {1}), 6: ("What is 5 plus 5 times 5?", set()), 7: ("It costs 7 euros", set()), 8: ("add 1, 2, 3, 4, 5, 6 or 7 together", set()), 9: ("What is the 5 plus of 6 in times 7", set()),
        10: ("1 2 3 4 5 6 7 8 9 10 11 12 13 14", set()), 11: (None, set()), 12: ("Add 12, 15, 18, 21, 24, 27 and 31 together", {2}), 13: ("each 9 pens", set()), 14: ("It costs 5 dollars", {4}),
    }
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    df = spark.createDataFrame([(i, t) for i, (t, _) in docs.items()] + [(1, docs[1][0])], "doc_id long, text string")
    got = decontam.leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, x) for i, (_, want) in docs.items() for x in want}
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    one = {(r.doc_id, r.item_id): (r.covered, r.slots) for r in got}
    assert one[1, 1] == (7, 3) and one[2, 2] == (10, 7) and one[3, 3] == (7, 3)
    assert sorted(r.doc_id for r in decontam.clean(df, bench).collect()) == [6, 7, 8, 9, 10, 11, 13]


def test_anchors_against_brute_force(spark):
    """Random texts over few words, numbers and names: every item laid over every place of every text."""
    import random

    r = random.Random(12)

    def some(n):
        return " ".join(r.choice(["add", "the", "sum", "of", "and", "Anna", "Ben", "3", "5", "7.5", "12", "kg", "pens"]) for _ in range(n))

    items = {i: some(r.randrange(3, 14)) for i in range(40)}
    texts = {i: some(20) + " " + re.sub(r"[0-9.]+", lambda m: str(r.randrange(90)), r.choice(list(items.values()))) + " " + some(9) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    cut = lambda rows: {x.i: x.t for x in spark.createDataFrame(list(rows.items()), "i int, text string").select("i", decontam.tokens(F.col("text")).alias("t")).collect()}
    slot = lambda t: t.startswith("\x01")
    kind = lambda t: t[:2] if slot(t) else t
    own, every = cut(texts), cut(items)

    def anchored(t):
        p = [i for i, x in enumerate(t) if not slot(x)]
        m = 4 if len(p) >= 4 else 3
        return {(tuple((t[x], x - p[k]) for x in p[k : k + m]), p[k]) for k in range(len(p) - m + 1) if p[k + m - 1] - p[k] >= m} if len(p) >= 3 and len(p) < len(t) else set()

    def anchors_of(t, m):
        p = [i for i, x in enumerate(t) if not slot(x)]
        return {(tuple((t[x], x - p[k]) for x in p[k : k + m]), p[k]) for k in range(len(p) - m + 1)}

    want = set()
    for d, t in own.items():
        at = {m: anchors_of(t, m) for m in (3, 4)}
        for i, x in every.items():
            keys = anchored(x)
            for diagonal in {b - a for key, a in keys for k2, b in at[len(key)] if k2 == key} if keys else ():
                pairs = [(a, t[k + diagonal]) for k, a in enumerate(x) if 0 <= k + diagonal < len(t) and kind(a) == kind(t[k + diagonal])]
                slots = {p for p in pairs if slot(p[0])}
                plain = sum(not slot(a) for a, _ in pairs)
                if len({a for a, _ in slots}) == len({b for _, b in slots}) == len(slots) and plain >= 3 and plain >= 0.75 * sum(not slot(a) for a in x) and len(pairs) >= 0.8 * len(x):
                    want.add((d, i))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    anchors = decontam.written(decontam.item_anchors(bench), "anchors")
    got = {(r.doc_id, r.item_id.id) for r in decontam._anchored_leaks(decontam._keyed(df, "doc_id", "text"), anchors).collect()}
    assert got == want and len(want) > 10


def test_decontamination_makes_keys_of_documents_in_compiled_rows(spark, monkeypatch):
    """Lambdas of arrays are interpreted: they code the tokens and tell the plain ones, and no key of a place is made in them."""
    plans = {}
    written = decontam.written
    monkeypatch.setattr(decontam, "written", lambda df, name, *more: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or written(df, name, *more))
    bench = spark.createDataFrame([(1, "Plain words only make up this item which is long enough to be found"), (2, "What is 12 plus 31 times 4?")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Plain words only make up this item which is long enough to be found"), (2, "so what is 5 plus 6 times 7?")], "doc_id long, text string")
    found = decontam.leaks(docs, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (2, 2)}
    assert plans["decontam-hits"].count("lambdafunction(") == 1
    assert plans["decontam-anchored"].count("lambdafunction(") == 2


def test_tokens_against_their_definition(spark):
    """Numbers, single characters of unspaced scripts and runs of letters, by one pattern, over random texts of odd characters."""
    import random

    r = random.Random(5)
    some = ["a", "B", "É", "ß", "İ", "Σ", " ", " ", " ", "  ", "\n", ".", ",", ":", "/", "-", "%", "°", "\x01", "\x01d", "\x01n", "\x01u", "5", "12", "3.5", "1,000", "๕", "๑.๒", "ก", "ั", "漢", "々", "〇", "カ", "ー", "kg", "Km", "percent", "Anna", "Bob", "\u0301", "\U0001d7d8", "\U0001d400", "\U00020000", "ǅ", "$1", "\\", "\x00", "\u00a0", "_", "½", "Ⅷ"]
    texts = ["".join(r.choice(some) for _ in range(r.randrange(25))) for _ in range(5000)] + ["", None]
    mark, wide = "\x01", r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
    t = F.translate(F.coalesce("text", F.lit("")), mark, " ")
    t = F.regexp_replace(t, r"(?<=[\p{Ll},;] )(\p{Lu}\p{Ll}+)", mark + "n$1")
    t = F.regexp_replace(t, r"\p{Nd}+(?:[.,:/]\p{Nd}+)*", f" {mark}d$0 ")
    t = F.regexp_replace(F.lower(t), rf"(?<=\p{{Nd}} ) ?({decontam.UNITS})(?![\p{{L}}\p{{Nd}}])", mark + "u$1")
    told = F.regexp_extract_all(t, F.lit(rf"{mark}d[\p{{Nd}}.,:/]+|[{wide}]|{mark}?[\p{{L}}\p{{M}}%°&&[^{wide}]]+"), F.lit(0))
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select("text", told.alias("told"), decontam.tokens(F.col("text")).alias("got"))
    assert [(x.text, x.got) for x in rows.where("told != got or got is null").collect()] == []


def test_decontamination_against_brute_force(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    items = [(b.item_id, b.text) for b in bench.collect()]
    verbatim = {(d.doc_id, i) for d in docs.collect() for i, t in items if t in d.text}
    assert verbatim and verbatim <= found
    words = lambda s: re.findall(r"\w+", s.lower())
    for d in docs.collect():
        w = words(d.text)
        have = {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
        for i, t in items:
            if (d.doc_id, i) in found:
                v = words(t)
                assert any(tuple(v[k : k + 8]) in have for k in range(len(v) - 7))
