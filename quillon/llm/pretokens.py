"""Byte-level BPE over whole texts, one library call per distinct pretoken.

The tokenizer splits a text by a fixed pattern into pretokens and encodes each
on its own, so the ids of a text are the ids of its pretokens in order.  Here
the split is done with numpy for a chunk of documents at once and each distinct
pretoken is encoded once and remembered in a table of bounded size.

Only for tokenizers whose file names a ByteLevel pre-tokenizer with the pattern
below and no normaliser; `load` refuses others.  Added tokens inside a text are
found first, as the library does by default.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

from quillon.llm.textops import U64, Chunk

#: Fixed value: the contractions of the pre-tokenizer's pattern; then come runs
#: of letters, of numbers and of other characters, each with one space before
#: it or none, and white space (all but its last character, if more follows).
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
OTHER, LETTER, NUMBER, SPACE, SEPARATOR = range(5)


@lru_cache(1)
def char_classes() -> np.ndarray:
    import regex

    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            table[a : b + 1] = cls
    table[0xD800:0xE000] = OTHER
    return table


@lru_cache(4)
def load(path: str):
    """The library's tokenizer, and its added tokens (text to id)."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    told = json.loads(open(path, encoding="utf-8").read())
    pre = told["pre_tokenizer"] or {}
    if any(x.get(k) for x in told["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens that take white space or whole words only aren't supported")
    if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or told["normalizer"] or told["model"].get("ignore_merges"):
        raise ValueError("a byte-level tokenizer with the standard pattern is needed")
    return Tokenizer.from_file(path), {x["content"]: x["id"] for x in told["added_tokens"]}


class Split:
    """The pretokens of a chunk, as byte ranges, without the separators between documents."""

    def __init__(self, chunk: Chunk):
        cp = np.frombuffer(chunk.buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        width = np.ones(len(cp), np.int64)
        for bound in (0x80, 0x800, 0x10000):
            width += cp >= bound
        self.at = np.zeros(len(cp) + 1, np.int64)  # byte offset of each character
        np.cumsum(width, out=self.at[1:])
        self.doc_char = np.searchsorted(self.at, chunk.offsets)  # first character of each document
        cls = char_classes()[cp]
        seps = self.doc_char[1:] - 1
        cls[seps] = SEPARATOR
        n = len(cp)
        st = np.ones(n + 1, bool)
        st[1:n] = cls[1:] != cls[:-1]
        st[self.doc_char[:-1]] = True
        # the last white space before something else
        last = np.flatnonzero((cls[:-1] == SPACE) & (cls[1:] < SPACE)) if n else np.zeros(0, np.int64)
        run_start = np.maximum.accumulate(np.where(st[:n], np.arange(n), 0))[last] if n else last
        long = last > run_start
        self.run_last, self.run_start = last[long], run_start[long]  # runs of two or more, cut before their last
        st[last] = True
        st[last[cp[last] == 0x20] + 1] = False
        # contractions
        quote = np.flatnonzero((cp[:-2] == 0x27) & st[: n - 2] & (cls[1:-1] == LETTER)) if n > 2 else np.zeros(0, np.int64)
        if len(quote):
            a, b = cp[quote + 1], cp[quote + 2]
            one, two = np.zeros(len(quote), bool), np.zeros(len(quote), bool)
            for c in CONTRACTIONS:
                if len(c) == 2:
                    one |= a == ord(c[1])
                else:
                    two |= (a == ord(c[1])) & (b == ord(c[2])) & (cls[quote + 2] == LETTER)
            two &= ~one
            st[quote[one | two] + 1] = False
            st[quote[one] + 2] = True
            st[quote[two] + 2] = False
            st[quote[two] + 3] = True
        starts = np.flatnonzero(st[:n])
        ends = np.append(starts[1:], n)
        real = cls[starts] != SEPARATOR
        self.start_char, self.end_char = starts[real], ends[real]
        self.starts, self.ends = self.at[self.start_char], self.at[self.end_char]
        self.first = np.searchsorted(self.start_char, self.doc_char)  # first pretoken of each document


class Memo:
    """What is known of each distinct pretoken: some integers, kept flat. It starts anew beyond `most` pretokens or values, so its memory is bounded; results don't depend on it."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]], dtype, most: int = 1_000_000):
        self.learn, self.dtype, self.most = learn, dtype, most
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, U64)
        self.slot = np.zeros(0, np.int64)
        self.begin = np.zeros(1, np.int64)
        self.flat = np.zeros(0, self.dtype)

    def find(self, chunk: Chunk, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The slot of each byte range; slot i holds flat[begin[i]:begin[i + 1]]."""
        if len(self.known) > self.most or len(self.flat) > 12 * self.most:
            self.clear()
        h = chunk.hash(starts, ends)
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        pos = np.searchsorted(self.known, u)
        new = np.ones(len(u), bool)
        inside = pos < len(self.known)
        new[inside] = self.known[pos[inside]] != u[inside]
        if new.any():
            raw = chunk.buf.tobytes()
            at = first[new]
            values, counts, order = self.learn([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            slots = np.empty(len(at), np.int64)
            slots[order] = len(self.begin) - 1 + np.arange(len(at))
            self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(counts)))
            self.flat = np.concatenate((self.flat, np.asarray(values, self.dtype)))
            where = pos[new]
            self.known = np.insert(self.known, where, u[new])
            self.slot = np.insert(self.slot, where, slots)
            pos = np.searchsorted(self.known, u)
        return self.slot[pos][back]

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the slots one after another, and how many each has."""
        counts = self.begin[slots + 1] - self.begin[slots]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.begin[slots] - (ends - counts), counts)], counts


#: Pretokens of letters that one call of the library takes.
TOGETHER = 64
#: Longer texts are taken in pieces of about so many characters.
PIECE = 1 << 20
_BORDER = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str, added: dict[str, int]) -> list[str]:
    """A long text cut before single spaces between other characters, where a pretoken always begins; whole if an added token has a space."""
    if len(text) <= PIECE or any(" " in a for a in added):
        return [text]
    out, at = [], 0
    while len(text) - at > PIECE and (m := _BORDER.search(text, at + PIECE)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


class Ids:
    """Token ids of documents, as the library gives them without added begin or end tokens."""

    def __init__(self, path: str):
        self.tokenizer, self.added = load(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.memo = Memo(self._learn, self.dtype)

    def _learn(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of each pretoken, in an order of its own. Those of a space and letters stay apart when written one after another, so a call takes TOGETHER of them; it is done again one by one should the library count other words."""
        words = [p.decode("utf-8") for p in pretokens]
        plain = [i for i, w in enumerate(words) if w[0] == " " and w[1:].isalpha()]
        alone = sorted(set(range(len(words))).difference(plain))
        flat: list[int] = []
        counts, order = [], []
        groups = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
        for g, x in zip(groups, self.tokenizer.encode_batch(["".join([words[i] for i in g]) for g in groups], add_special_tokens=False)):
            per = np.bincount(np.array(x.word_ids, np.int64), minlength=len(g))
            if len(per) != len(g) or not per.all():
                alone += g
                continue
            flat += x.ids
            counts.append(per)
            order += g
        rest = [x.ids for x in self.tokenizer.encode_batch_fast([words[i] for i in alone], add_special_tokens=False)]
        for ids in rest:
            flat += ids
        counts.append(np.fromiter(map(len, rest), np.int64, len(rest)))
        return np.array(flat, self.dtype), np.concatenate(counts), np.array(order + alone, np.int64)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the texts one after another, and how many each text has. A single long text is taken in pieces."""
        if len(texts) == 1 and len(cut := pieces(texts[0].as_py() or "", self.added)) > 1:
            ids = np.concatenate([self.of(pa.array([x], pa.string()))[0] for x in cut])
            return ids, np.array([len(ids)], np.int64)
        chunk = Chunk(texts)
        raw = chunk.buf.tobytes()
        if any(s.encode() in raw for s in self.added):  # rare: the library does these texts itself
            found = [self.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for x in found for i in x), self.dtype, int(counts.sum())), counts
        split = Split(chunk)
        ids, per = self.memo.gather(self.memo.find(chunk, split.starts, split.ends))
        sums = np.concatenate(([0], np.cumsum(per)))[split.first]
        return ids, np.diff(sums)


class PrefixCounts:
    """The exact number of tokens of every prefix of a text.

    Dynamic program over the bytes of a pretoken: the encoding of a prefix ends
    with the one vocabulary token t that is a suffix of it and that may follow
    the last token of the prefix before t; its count is that prefix's plus one.
    Two tokens may stand side by side if undoing their merges, the latest first,
    never meets a pair that would have merged earlier across the border.
    """

    def __init__(self, path: str):
        self.tokenizer, self.added = load(path)
        model = json.loads(open(path, encoding="utf-8").read())["model"]
        raw = _byte_of_char()
        spell = {t: bytes(raw[c] for c in t) for t in model["vocab"] if all(c in raw for c in t)}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # tokens are numbered by the merge that makes them: bytes first, then in order of the merges
        rank: dict[bytes, int] = {}
        for t in sorted((spell[t] for t in model["vocab"] if t in spell and len(spell[t]) == 1)):
            rank[t] = len(rank)
        self.split: list[tuple[int, int]] = [(i, i) for i in range(len(rank))]
        self.pair: dict[tuple[int, int], int] = {}
        for a, b in merges:
            x, y = rank[spell[a]], rank[spell[b]]
            t = rank.setdefault(spell[a] + spell[b], len(self.split))
            if t == len(self.split):
                self.split.append((x, y))
            self.pair.setdefault((x, y), t)
        self.rank, self.longest = rank, max(map(len, rank))
        self.sits: dict[int, bool] = {}
        self.memo = Memo(self._learn, np.int32)

    def _beside(self, a: int, b: int) -> bool:
        key = (a << 20) | b
        known = self.sits.get(key)
        if known is None:
            if len(self.sits) > 1_000_000:
                self.sits.clear()
            known = self.sits[key] = self._settled(a, b, len(self.split))
        return known

    def _settled(self, a: int, b: int, bound: int) -> bool:
        split, pair = self.split, self.pair
        while True:
            joined = pair.get((a, b))
            if joined is not None and joined < bound:
                return False
            left_later = a > b
            for side in (left_later, not left_later):
                x, y = split[a if side else b]
                if x != y or (a if side else b) != x:  # a merge to undo
                    if side:
                        bound, a = a, y
                    else:
                        bound, b = b + 1, x
                    break
            else:
                return True

    def _whole(self, t: int) -> bool:
        """Whether the bytes of t are encoded as t alone."""
        x, y = self.split[t]
        return (x == y == t) or self._settled(x, y, t)

    def of_pretoken(self, p: bytes) -> list[int]:
        """Counts of the byte prefixes of one pretoken, lengths 1 to len(p)."""
        rank, beside, longest = self.rank, self._beside, self.longest
        last, count = [-1] * (len(p) + 1), [0] * (len(p) + 1)
        for i in range(1, len(p) + 1):
            for j in range(max(0, i - longest), i):
                t = rank.get(p[j:i])
                if t is not None and (beside(last[j], t) if j else self._whole(t)):
                    last[i], count[i] = t, count[j] + 1
                    break
        return count[1:]

    def _learn(self, pretokens: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        values: list[int] = []
        counts = np.zeros(len(pretokens), np.int64)
        for k, p in enumerate(pretokens):
            c = self.of_pretoken(p)
            if len(p) > 1 and p[0] == 0x27 and 0x61 <= p[1] <= 0x7A:  # a contraction is one only when whole
                c[:-1] = [1, 2][: len(p) - 1]
            if not p.isascii():  # keep the ends of characters
                c = [x for x, nxt in zip(c, [*p[1:], 0]) if nxt & 0xC0 != 0x80]
            values += c
            counts[k] = len(c)
        return values, counts, np.arange(len(pretokens))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Counts of every prefix (in code points, the empty prefix first) of every text one after another, and how many each text has. A single long text is taken in pieces."""
        if len(texts) == 1 and len(cut := pieces(texts[0].as_py() or "", self.added)) > 1:
            out, done = [np.zeros(1, np.int32)], 0
            for x in cut:
                counts = self.of(pa.array([x], pa.string()))[0][1:] + done
                out.append(counts.astype(np.int32))
                done = int(counts[-1])
            every = np.concatenate(out)
            return every, np.array([len(every)], np.int64)
        chunk = Chunk(texts)
        raw = chunk.buf.tobytes()
        if any(s.encode() in raw for s in self.added):
            each = [self._with_added(t or "") for t in texts.to_pylist()]
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        split = Split(chunk)
        slots = self.memo.find(chunk, np.concatenate((split.starts, split.at[split.run_start])), np.concatenate((split.ends, split.at[split.run_last + 1])))
        slots, runs = slots[: len(split.starts)], slots[len(split.starts) :]
        inner, per = self.memo.gather(slots)
        total = self.memo.flat[self.memo.begin[slots + 1] - 1] if len(slots) else np.zeros(0, np.int32)
        before = np.concatenate(([0], np.cumsum(total, dtype=np.int64)))
        doc = np.repeat(np.arange(chunk.n), np.diff(split.first))
        base = before[:-1] - before[split.first[:-1]][doc] if len(slots) else np.zeros(0, np.int64)
        out = np.zeros(len(split.at) - 1, np.int64)  # per character of the chunk: at its end; at the separator: of the whole text
        chars = np.arange(len(inner)) + np.repeat(split.start_char - (np.cumsum(per) - per), per)
        out[chars] = inner + np.repeat(base, per)
        if len(runs):  # a prefix that ends with white space has the whole run as one pretoken
            token = np.searchsorted(split.start_char, split.run_start)
            out[split.run_last] = base[token] + self.memo.flat[self.memo.begin[runs + 1] - 1]
        # shift by one: entry i is the prefix of i characters
        shifted = np.zeros_like(out)
        shifted[1:] = out[:-1]
        shifted[split.doc_char[:-1]] = 0
        return shifted, np.diff(split.doc_char)

    def _with_added(self, text: str) -> np.ndarray:
        """A text with added tokens: until an added token is whole its characters are ordinary; then it counts one and a new stretch begins."""
        out, done = [np.zeros(1, np.int64)], 0
        while text:
            first = min(((text.find(s), -len(s), s) for s in self.added if s in text), default=None)
            part = text if first is None else text[: first[0] - first[1]]
            counts = self._plain(part)[1:].copy()
            if first is not None:
                counts[-1] = (counts[first[0] - 1] if first[0] else 0) + 1
            out.append(counts + done)
            done += int(counts[-1])
            text = text[len(part) :]
        return np.concatenate(out)

    def _plain(self, text: str) -> np.ndarray:
        added, self.added = self.added, {}
        try:
            return self.of(pa.array([text]))[0]
        finally:
            self.added = added


@lru_cache(1)
def _byte_of_char() -> dict[str, int]:
    """Byte-level spelling: printable bytes stand for themselves, the others for the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
