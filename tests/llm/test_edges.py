"""Long texts, clashing names, odd ids: what every operator must take."""

import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import binary_output, decontam, fingerprints, mixing, neardup, pii, pretokens, quality
from quillon.llm.queries import tokenizer_path

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_one_pass_patterns_equal_the_regular_expressions():
    r = random.Random(5)
    for _ in range(20_000):
        t = "".join(r.choice("a1b.@-_ 9.2") for _ in range(r.randrange(40)))
        assert pii._emails(t) == [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
        assert pii._ips(t) == [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]


@pytest.mark.parametrize("text", ["1" * 5_000_000 + " .", "a" * 5_000_000 + " @", "1." * 1_000_000, "a@" * 1_000_000, "+1" * 1_000_000, "0f" * 2_500_000 + "g", "A1" * 2_500_000 + "b"])
def test_long_texts_take_time_in_proportion(text):
    began = time.time()
    pii.occurrences(text, pii.base_spans(text))
    assert time.time() - began < 20


def test_secrets_with_a_common_head_are_found(spark):
    rows = [(i, f"word{i} AKIA{i:04d}ZZXXYYQQ{i:04d} and more") for i in range(9)] + [(99, "a plain text of 2024 with ABCDEFGHIJKLMNOPQRST")]
    out = {r.doc_id: r for r in pii.pii_report(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert all(out[i].n_spans == 1 and out[i].spans.startswith("secret:") for i in range(9)) and out[99].n_spans == 0


@pytest.mark.parametrize("n", [16, 256, 257, 300, 100_000])
def test_secrets_of_any_length_are_seeds(n):
    text = "password=" + "0f" * (n // 2) + "a" * (n % 2) + " and more"
    assert [(x["start"], x["end"], x["seed"]) for x in pii.occurrences(text, pii.base_spans(text))] == [(9, 9 + n, "secret")]


def test_pieces_of_long_texts_have_the_same_tokens(monkeypatch):
    r = random.Random(3)
    text = "".join(r.choice(["It's", " a", "  b", "\n", " 12", "é", "x y", " ", ", "]) for _ in range(3000))
    path = tokenizer_path()
    want = pretokens.load(path)[0].encode(text, add_special_tokens=False).ids
    prefix = pretokens.PrefixCounts(path).of(pa.array([text]))[0]
    monkeypatch.setattr(pretokens, "PIECE", 100)
    assert len(pretokens.pieces(text, {})) > 20 and "".join(pretokens.pieces(text, {})) == text
    assert pretokens.Ids(path).of(pa.array([text]))[0].tolist() == want
    assert (pretokens.PrefixCounts(path).of(pa.array([text]))[0] == prefix).all()


def test_long_documents_lie_in_several_blocks(spark, tmp_path, monkeypatch):
    r = random.Random(4)
    texts = ["short one", "".join(r.choice("abc de") for _ in range(500_000)), None, "last"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = binary_output.write_ids(docs, f"file://{tmp_path}/ids", tokenizer_path(), 2)
    assert spark.read.parquet(f"{path}/blocks").where("piece >= 0").count() > 1
    assert spark.read.parquet(f"{path}/blocks").agg(F.max("n_ids")).first()[0] <= binary_output.LONGEST
    encode = pretokens.load(tokenizer_path())[0].encode
    start = 0
    got = binary_output.read_ids(spark, path).orderBy("doc_id").collect()
    brief = binary_output.read_ids(spark, path, digest_only=True).orderBy("doc_id").collect()
    for row, short, t in zip(got, brief, texts, strict=True):
        ids = [*encode(t or "", add_special_tokens=False).ids, 2]
        assert (row.start, row.n_tokens, row.ids) == (start, len(ids), ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) == short.ids_crc32 and (short.start, short.n_tokens) == (start, len(ids))
        start += len(ids)


def test_names_of_the_caller_stay(spark):
    names = ["th", "own_th", "own_id", "row", "k1", "k2", "place", "n", "copy", "whole", "below", "log_weight", "_th", "_r1", "_mix_place", "_log_weight"]
    rows = [(i, f"text number {i} of some words that differ {i * 7}", f"s{i % 2}", *[f"{c}{i}" for c in names]) for i in range(12)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *[f"{c} string" for c in names]]))
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "something else of no interest at all to anyone here")], "item_id long, text string")
    for out in (neardup.deduplicated(docs), decontam.clean(docs, items), mixing.mixed(docs), quality.kept(docs, labels)):
        assert out.columns == docs.columns
        assert all(tuple(r) == rows[r.doc_id] for r in out.collect())
    assert decontam.clean(docs, items).count() == 12


def test_items_without_an_id_and_without_spaces_are_found(spark):
    han = "今天天气很好我们一起去公园散步然后回家吃饭"
    docs = spark.createDataFrame([(1, "before " + "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "前" + han + "后"), (3, "clean text without any passage")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (5, han)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()} == {(1, None), (2, 5)}
    assert [r.doc_id for r in decontam.clean(docs, items).collect()] == [3]


def test_fingerprints_of_ids_as_text_and_many_ranges(spark):
    rows = [(str(i), f"text {i} " * 30) for i in range(50)]
    out = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert len(out) == 50
    t = dict(rows)
    for i in range(50):
        text, after = t[str(i)], t[str((i - 1) % 50)]
        third = len(text) // 3
        assert out[str(i)].near_next == fingerprints.likeness(fingerprints.fingerprint(text), fingerprints.fingerprint(after))
        import hashlib

        assert out[str(i)].edited_sha256 == hashlib.sha256((text[: len(text) - third] + after[:third]).encode()).hexdigest()
