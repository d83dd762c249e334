"""Token counts and binary output against the tokenizer library."""

import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import huffman
from quillon.llm.binary_output import read_ids, write_ids
from quillon.llm.pretokens import Ids, PrefixCounts, load
from quillon.llm.queries import tokenizer_path
from quillon.llm.token_counts import longest_within, prefix_counts, tokens_of_prefix, total_tokens
from quillon.llm.workdir import table_path

ODD = ["", "a", "  ", "'re", "it's  we'll\n\n x", "  \nb", "don't 'r 'real !'s  ", "<|endoftext|>", " a<|endoftext|>b", "<|endoftext|", "hello   world  ", "x<|endoftext|>\n\n  c<|endoftext|>"]
ALPHABET = [*" \n\t'srtveldm aéñ中0x1!?.,  ½²Éİ👍\x00\x1c\x85", "<|endoftext|>"]


def texts(n: int) -> list[str]:
    rnd = random.Random(5)
    return ODD + ["".join(rnd.choices(ALPHABET, k=rnd.randint(0, 25))) for _ in range(n)]


def test_ids_are_the_librarys():
    path = tokenizer_path()
    library, _ = load(path)
    sample = texts(400)
    ids, per = Ids(path).of(pa.array(sample))
    at = 0
    for t, n in zip(sample, per):
        assert ids[at : at + n].tolist() == library.encode(t, add_special_tokens=False).ids
        at += n


def test_every_prefix_is_counted_as_the_library_counts_it():
    path = tokenizer_path()
    library, _ = load(path)
    sample = texts(150)
    counts, per = PrefixCounts(path).of(pa.array(sample))
    at = 0
    for t, n in zip(sample, per):
        assert n == len(t) + 1
        assert counts[at : at + n].tolist() == [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(n)]
        at += n


def test_stored_counts_answer_budget_questions(spark):
    path = tokenizer_path()
    library, _ = load(path)
    text = "The quick brown fox doesn't jump over 12 lazy dogs.\n\n  Again."
    df = spark.createDataFrame([(1, text, 9), (2, None, 9), (3, "", 9), (1, text, 9)], "doc_id long, text string, n_tokens int")
    c = prefix_counts(df, path)
    p = c["prefix_tokens"]
    rows = c.select("doc_id", "n_bytes", total_tokens(p).alias("n"), longest_within(p, 5).alias("fit"), tokens_of_prefix(p, 9).alias("nine")).collect()
    assert len(rows) == 4
    by = {r.doc_id: r for r in rows}
    count = lambda s: len(library.encode(s, add_special_tokens=False).ids)
    assert by[1].n == count(text) and by[1].nine == count(text[:9]) and by[1].n_bytes == len(text.encode())
    assert by[1].fit == max(i for i in range(len(text) + 1) if count(text[:i]) <= 5)
    assert (by[2].n, by[2].n_bytes, by[2].fit) == (0, 0, 0) == (by[3].n, by[3].n_bytes, by[3].fit)


def test_huffman_codes_are_limited_complete_and_round_trip():
    rnd = np.random.default_rng(3)
    for counts in (np.array([0, 5, 0]), np.array([1, 1]), 2 ** np.arange(40), rnd.integers(0, 1000, 5000), np.ones(4096, np.int64)):
        lengths = huffman.code_lengths(counts)
        used = counts > 0
        assert (lengths[used] > 0).all() and not lengths[~used].any() and lengths.max() <= huffman.LIMIT
        if used.sum() > 1:
            assert (2.0 ** -lengths[used].astype(float)).sum() == 1.0
        ids = rnd.choice(np.flatnonzero(counts), 1000).astype(np.uint32)
        bits, marks = huffman.pack(ids, huffman.canonical(lengths), lengths)
        for n in (1000, 64, 65, 1, 0):
            part, m = huffman.pack(ids[:n], huffman.canonical(lengths), lengths)
            assert (huffman.Reader(lengths).read(part, n, m) == ids[:n]).all()
        assert len(marks) == 16 and bits


def test_unlimited_lengths_are_optimal():
    import heapq

    counts = np.random.default_rng(4).integers(1, 50, 200)
    heap = [(int(c), i, 0) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    cost, k = 0, 1000
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], k, 0))
        k += 1
    assert int((huffman.code_lengths(counts) * counts).sum()) == cost


def test_binary_output_round_trip(spark, sf_dir):
    path = tokenizer_path()
    library, _ = load(path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    extra = spark.createDataFrame([(None, "null id", "x"), (7, None, "x"), (7, "", None), (7, "twice", "x"), (7, "twice", "x")], docs.schema)
    docs = docs.unionByName(extra)
    out = read_ids(spark, write_ids(docs, table_path(spark, "t"), path, 2)).orderBy("start").collect()
    want = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at = 0
    assert len(out) == len(want)
    for r, (doc_id, text) in zip(out, want):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (doc_id, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        at += len(ids)


def test_binary_output_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert read_ids(spark, write_ids(docs, table_path(spark, "t"), tokenizer_path(), 2)).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        load(tokenizer_path("word_bpe_49k.json"))
