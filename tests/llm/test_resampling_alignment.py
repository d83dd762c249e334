"""Resampling and alignment against plain versions over whole small tables and over odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quillon.llm import alignment, queries, resampling

BUCKETS = 10_000


def plain_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(r.encode()) % BUCKETS for r in runs]


def plain_resampling(docs, target):
    found = [(i, *plain_features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in plain_features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + BUCKETS) / ((s[b] + 1) * (n_t + BUCKETS)))) for b in range(BUCKETS)]
    rows = []
    for i, n, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {}
    for k, r in enumerate(order[: 25 * len(order) // 100]):
        rank.setdefault(r, []).append(k + 1)
    return sorted(((r[0], *r[2:], rank[r].pop(0) if rank.get(r) else None) for r in rows), key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_op11_over_the_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert rows(queries.op11_importance_resampling(spark, sf_dir)) == plain_resampling(docs, target)


ODD = [(1, None), (2, ""), (3, "One two " * 15), (3, "One two " * 15), (None, "three four five " * 9), (4, "x" * 70_000 + " ÄÖ ü 1a_b"), (5, "long words and more " * 40_000), (6, "​ \n-- 一二 三"), (7, "<s> <|endoftext|> </s> <0x41> a▁b\x00"), (8, "tab\tand  two spaces\r\n")]
ODD_SCHEMA = "doc_id long, text string, weight long, score long, rank long, n long, fit boolean, above long, block long, slot int, pair long, count long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, True, 5, 6, 7, 8, 9) for i, t in ODD], ODD_SCHEMA)


def test_resampling_of_odd_rows(spark, odd):
    target = spark.createDataFrame([("one two three",), (None,), ("one two three",)], "text string")
    assert rows(resampling.resampled(odd, target)) == plain_resampling(ODD, ["one two three", None, "one two three"])


def test_resampling_towards_nothing_and_ties(spark):
    docs = [(i, "the same twenty words " * 6) for i in range(40)] + [(i, "the same twenty words " * 6) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    empty = spark.createDataFrame([], "text string")
    got = rows(resampling.resampled(df, empty))
    assert got == plain_resampling(docs, []) and sum(r[4] is not None for r in got) == 20


def test_the_matrix_is_what_was_counted(spark, tmp_path, odd):
    m = resampling.count_matrix(odd, f"file://{tmp_path}/m").collect()
    import numpy as np

    found = []
    for b in m:
        ends, at, n = np.frombuffer(b.row_ends, "<i8"), np.frombuffer(b.buckets, "<u2"), np.frombuffer(b.counts, "<u4")
        for i, s, e in zip(b.doc_ids, [0, *ends], ends):
            found.append((i, sorted(zip(at[s:e].tolist(), n[s:e].tolist()))))
    assert sorted(found, key=repr) == sorted(((i, sorted(Counter(plain_features(t)[1]).items())) for i, t in ODD), key=repr)


def plain_alignment(docs, texts_of=lambda t: t):
    """Token spans by the libraries, overlaps by comparing byte ranges."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.tokenizer_path())
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    out, links_of = [], []
    for i, t in docs:
        row = None
        if t:
            ids = a.encode(" " + t, add_special_tokens=False).ids
            raw = [bytes(byte[c] for c in a.id_to_token(x)) for x in ids]
            pieces = b.encode(t)
            raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(x) else p.replace("▁", " ").encode() for x in pieces for p in [b.id_to_piece(x)]]
            if b"".join(raw) == b"".join(raw_b) == (" " + t).encode():
                row = (ids, raw, pieces, raw_b)
        if row is None:
            links_of.append([])
            out.append([i, 0, 0, 0, 0, ""])
            continue
        ids, raw, pieces, raw_b = row
        ends = [[sum(map(len, x[: k + 1])) for k in range(len(x))] if len(x) < 3000 else __import__("itertools").accumulate(map(len, x)) for x in (raw, raw_b)]
        ends = [list(x) for x in ends]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, s, u = [], 0, 0
        for c in cuts:
            e, v = ends[0].index(c, s) + 1, ends[1].index(c, u) + 1
            groups.append(",".join(map(str, ids[s:e])) + "|" + ",".join(map(str, pieces[u:v])))
            s, u = e, v
        links, k = [], 0
        starts = [[0, *x[:-1]] for x in ends]
        for x in range(len(ids)):
            while ends[1][k] <= starts[0][x]:
                k += 1
            y = k
            while y < len(pieces) and starts[1][y] < ends[0][x]:
                links.append((ids[x], pieces[y]))
                y += 1
        links_of.append(links)
        out.append([i, len(ids), len(pieces), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()])
    count = Counter(p for x in links_of for p in set(x))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return sorted(((*o[:5], sum(count[p] == most[p[0]] for p in x), sum(count[p] for p in x), o[5]) for o, x in zip(out, links_of)), key=repr)


def test_op12_over_the_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = rows(queries.op12_tokenizer_alignment(spark, sf_dir))
    assert got == plain_alignment(docs) and sum(r[1] > 0 for r in got) > len(got) // 2


def test_alignment_of_odd_rows(spark, odd, monkeypatch):
    short = [(i, t[:20_000] if t else t) for i, t in ODD]
    df = odd.sparkSession.createDataFrame([(i, t, 1, 2, 3, 4, True, 5, 6, 7, 8, 9) for i, t in short], ODD_SCHEMA)
    got = rows(alignment.alignment(df, queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model")))
    assert got == plain_alignment(short)
    assert sum(r[1] == 0 for r in got) == 3  # null, empty, and the text with U+2581


def test_pairs_hold_each_document_once(spark):
    df = spark.createDataFrame([(1, "a a a"), (2, "a b"), (2, "a b")], "doc_id long, text string")
    blocks = alignment.aligned_blocks(df, queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model"))
    assert sorted(r["count"] for r in alignment.pair_counts(blocks).collect()) == [2, 3]
