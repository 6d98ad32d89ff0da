"""Byte-level BPE in batched numpy merge rounds, and decoding.

Texts are cut into pre-tokens; each distinct pre-token of a batch is encoded
once. All of them lie as symbols in one flat array. A round finds for every
word its lowest-rank adjacent pair (ranks come from binary search over sorted
pair keys), merges its occurrences from the left, and drops words without a
pair left. Only pairs beside a merge are looked up again. A bounded table of
encoded words is kept by each Python worker.

ids are BINARY: little-endian unsigned 32-bit integers, so that size, hashes
and equality are JVM functions of the column; unpack_ids() gives arrays.

Defined cases: null text is encoded as the empty text (no ids); empty ids decode
to the empty text; ids outside the vocabulary are left out; special tokens of
the vocabulary found in a text become their ids; a very long text is one row
but is worked on in pieces of about CHUNK_CHARS characters, cut before a space
(a longer stretch without a letter or digit before a space is one piece); repeated rows stay; other columns
are passed through; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, span_blocks, with_text

#: Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)
CHUNK_CHARS = 400_000
TABLE_WORDS = 900_000
TABLE_BLOCKS = 4_000_000
SLOTS = (1 << 20) - 3


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Merge table as sorted pair keys, and the bytes of every id."""

    def __init__(self, spec: bytes) -> None:
        j = json.loads(spec)
        vocab: dict[str, int] = j["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in j["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        chars = byte_chars()
        self.of_byte = np.array([vocab[c] for c in chars], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int32), made
        back = {c: i for i, c in enumerate(chars)}
        token = [b""] * self.size
        for t, i in vocab.items():
            token[i] = bytes(back[c] for c in t)
        for t, i in self.special.items():
            token[i] = t.encode()
        self.token_off = np.concatenate([[0], np.cumsum([len(t) for t in token])])
        self.token_bytes = np.frombuffer(b"".join(token), dtype=np.uint8)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words, and how many each has."""
        data = [w.encode() for w in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        sym = self.of_byte[np.frombuffer(b"".join(data), dtype=np.uint8)]
        word = np.repeat(np.arange(len(data), dtype=np.int32), sizes)
        rank = np.full(len(sym), NONE, dtype=np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self.rank(sym[inner], sym[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(sym)))
            going = np.repeat(least != NONE, lengths)
            if not going.all():
                done.append((word[~going], sym[~going]))
                sym, word, rank = sym[going], word[going], rank[going]
                lengths, least = lengths[least != NONE], least[least != NONE]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, lengths))
            # of a run of overlapping pairs, the first, third, ... merge
            first = np.concatenate([[True], np.diff(at) != 1])
            run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            rank[at] = rank[at + 1]
            sym, word, rank = sym[keep], word[keep], rank[keep]
            new = at - np.arange(len(at))
            beside = np.concatenate([new, new[new > 0] - 1])
            beside = beside[beside + 1 < len(sym)]
            same = word[beside] == word[beside + 1]
            rank[beside] = NONE
            beside = beside[same]
            rank[beside] = self.rank(sym[beside], sym[beside + 1])
            if len(new) and new[-1] == len(sym) - 1:
                rank[-1] = NONE
        if not done:
            return sym, np.zeros(len(data), dtype=np.int64)
        of, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(data))

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids[ids < self.size]
        lengths = self.token_off[ids + 1] - self.token_off[ids]
        return self.token_bytes[ragged(self.token_off[ids], lengths)].tobytes()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], ..., starts[i] + lengths[i] - 1 of all i in a row."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Rows:
    """Rows of different lengths in one flat array; it and its offsets grow by doubling."""

    def __init__(self, kind) -> None:
        self.flat, self.off, self.n = np.empty(1 << 16, dtype=kind), np.zeros(1 << 14, dtype=np.int64), 0

    def add(self, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of the rows added."""
        n, at = self.n, int(self.off[self.n])
        while at + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(sizes) + 1 > len(self.off):
            self.off = np.concatenate([self.off, np.zeros_like(self.off)])
        self.flat[at : at + len(values)] = values
        self.off[n + 1 : n + 1 + len(sizes)] = at + np.cumsum(sizes)
        self.n = n + len(sizes)
        return np.arange(n, self.n)

    def sizes(self, at: np.ndarray) -> np.ndarray:
        return self.off[at + 1] - self.off[at]

    def take(self, at: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.off[at], self.sizes(at))]


UNKNOWN, LETTER, NUMBER, SPACE, OTHER = 255, 0, 1, 2, 3


class WordEncoder:
    """Texts to ids through a bounded table of encoded pre-tokens.

    Pre-tokens are found in one pass over the code points of many texts: a
    table gives each character's class, asked once of the tokenizer itself,
    and tokens begin where classes change (one space joins what follows; the
    last white space before a word stands alone). Texts with an apostrophe or a
    special token are cut by the pattern. Pre-tokens are looked up by 64-bit
    hash in a two-way table and compared byte by byte with the word found there, so equal hashes of different words do no harm; fill encodes
    new ones: (flat ids, counts). The table starts anew beyond TABLE_WORDS words
    or TABLE_BLOCKS blocks of 8 bytes.
    """

    def __init__(self, special: dict[str, int], fill: Callable, cut: Callable) -> None:
        self.special, self.fill, self.cut = special, fill, cut
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self.kind = np.full(0x110000, UNKNOWN, dtype=np.uint8)
        self.odd: set[str] = set()
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(2 * SLOTS, dtype=np.uint64)
        self.slot = np.zeros(2 * SLOTS, dtype=np.int32)
        self.ids, self.blocks = Rows(np.int32), Rows(np.uint64)
        if self.special:
            size = np.array([len(w.encode()) for w in self.special])
            flat, n, h = self.hashed(np.frombuffer("".join(self.special).encode(), dtype=np.uint8), np.cumsum(size) - size, np.cumsum(size))
            self.blocks.add(flat, n)
            self.store(h, self.ids.add(np.array(list(self.special.values()), dtype=np.int32), np.ones(len(n), dtype=np.int64)))

    @staticmethod
    def hashed(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat, n, h = span_blocks(raw, begin, end)
        return flat, n, h | np.uint64(1)

    def encoded(self, words: list[str], flat: np.ndarray, n: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Numbers of the words, encoded and kept anew; which: their places among the spans of flat."""
        self.blocks.add(flat[ragged((np.cumsum(n) - n)[which], n[which])], n[which])
        return self.ids.add(*self.fill(words))

    def differ(self, at: np.ndarray, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which of the spans of flat are not the kept words numbered at."""
        held, first = self.blocks.sizes(at), np.cumsum(n) - n
        if (held == n).all():
            return np.logical_or.reduceat(self.blocks.take(at) != flat, first)
        out = held != n
        same = np.flatnonzero(~out)
        if len(same):
            out[same] = np.logical_or.reduceat(self.blocks.take(at[same]) != flat[ragged(first[same], n[same])], np.cumsum(n[same]) - n[same])
        return out

    def store(self, h: np.ndarray, at: np.ndarray) -> None:
        a = (h >> np.uint64(1)) % np.uint64(SLOTS)
        b = (h >> np.uint64(33)) % np.uint64(SLOTS) + np.uint64(SLOTS)
        to = np.where(self.keys[a] == 0, a, np.where(self.keys[b] == 0, b, a))
        self.slot[to] = at  # of several on one place the last stays, here and in keys
        self.keys[to] = h

    def lookup(self, h: np.ndarray) -> np.ndarray:
        a = (h >> np.uint64(1)) % np.uint64(SLOTS)
        b = (h >> np.uint64(33)) % np.uint64(SLOTS) + np.uint64(SLOTS)
        return np.where(self.keys[a] == h, self.slot[a], np.where(self.keys[b] == h, self.slot[b], np.int32(-1)))

    def learn(self, points: np.ndarray) -> None:
        for p in points:
            c = chr(p)
            probe = f"a{c}1{c}!{c}a"
            got = self.cut(probe)
            kind = {(2, 1, 1, 1, 2): LETTER, (1, 3, 1, 1, 1): NUMBER, (1, 1, 1, 3, 1): OTHER}.get(tuple(got), SPACE)
            if c == " ":
                kind = SPACE
            self.kind[p] = kind
            if [len(x) for x in self.find(probe)] != got:
                self.odd.add(c)

    def by_pattern(self, text: str) -> list[int]:
        """Pre-token lengths of a text with apostrophes or special tokens."""
        out: list[int] = []
        for part in self.split(text) if self.split else [text]:
            if part in self.special:
                out.append(len(part))
            elif part:
                out += self.cut(part) if self.odd and not self.odd.isdisjoint(part) else map(len, self.find(part))
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and how many each has."""
        if self.ids.n > TABLE_WORDS or self.blocks.off[self.blocks.n] > TABLE_BLOCKS:
            self.reset()
        texts = [x or "" for x in texts]
        joined = "".join(texts)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        cp = code_points(joined)
        if not len(cp):
            return np.empty(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        kind = self.kind[cp]
        if (kind == UNKNOWN).any():
            self.learn(np.unique(cp[kind == UNKNOWN]))
            kind = self.kind[cp]
        space = kind == SPACE
        first = np.zeros(len(cp) + 1, dtype=bool)
        first[bounds] = True
        start = np.ones(len(cp), dtype=bool)
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start[1:] &= ~((cp[:-1] == 32) & ~space[1:])
        start[:-1] |= space[:-1] & ~space[1:] & ~first[1:-1]
        start |= first[:-1]
        for i, x in enumerate(texts):
            if "'" in x or any(w in x for w in self.special):
                lo, hi = bounds[i], bounds[i + 1]
                start[lo:hi] = False
                lengths = np.array(self.by_pattern(x), dtype=np.int64)
                start[lo + np.cumsum(lengths) - lengths] = True
        begin = np.flatnonzero(start)
        raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        if len(raw) == len(cp):
            byte = begin
        else:
            wide = (cp >= 0x80).view(np.uint8) + (cp >= 0x800) + (cp >= 0x10000)
            byte = begin + np.concatenate([[0], np.cumsum(wide, dtype=np.int64)])[begin]
        flat, n, h = self.hashed(raw, byte, np.append(byte[1:], len(raw)))
        at = self.lookup(h).astype(np.int64)
        words = lambda which: [joined[a:b] for a, b in zip(begin[which].tolist(), np.append(begin[1:], len(cp))[which].tolist(), strict=True)]
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, where, back = np.unique(h[new], return_index=True, return_inverse=True)
            place = self.encoded(words(new[where]), flat, n, new[where])
            self.store(fresh, place)
            at[new] = place[back]
        other = np.flatnonzero(self.differ(at, flat, n))
        if len(other):  # words with the hash of another word: encoded by themselves, not looked up again
            at[other] = self.encoded(words(other), flat, n, other)
        ends = np.concatenate([[0], np.cumsum(self.ids.sizes(at))])
        return self.ids.take(at), np.diff(ends[np.searchsorted(begin, bounds)])

    def encode_pieces(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """encode(), with a very long text in pieces that are cut where a pre-token must end."""
        if len(texts) != 1 or len(texts[0] or "") < 2 * CHUNK_CHARS:
            return self.encode(texts)
        parts = [self.encode([x])[0] for x in pieces(texts[0])]
        ids = np.concatenate(parts)
        return ids, np.array([len(ids)])


#: Between an ASCII letter or digit and a space a pre-token ends, whatever stands around.
SAFE = regex.compile(r"[A-Za-z0-9](?= )")


def pieces(text: str, chars: int | None = None) -> Iterator[str]:
    at, chars = 0, chars or CHUNK_CHARS
    while at < len(text):
        found = SAFE.search(text, at + chars)
        to = found.end() if found else len(text)
        yield text[at:to]
        at = to


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def slices(batches, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, which bound what is held as Python objects."""
    for whole in batches:
        for lo in range(0, whole.num_rows, rows):
            yield whole.slice(lo, rows)


def chunks(texts: list, chars: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def library(spec: bytes):
    """The tokenizers library's object: its pre-tokenizer's cuts, and encoding for the file operator."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec.decode())
    t.no_truncation()
    t.no_padding()
    return t


def library_fill(tok) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Encode pre-tokens with the library; those of a space and letters, which cut apart again, as one text."""

    def fill(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joint = np.array([len(w) > 1 and w[0] == " " and w[1:].isalpha() for w in words], dtype=bool)
        counts = np.zeros(len(words), dtype=np.int64)
        whole = tok.encode("".join(w for w, j in zip(words, joint, strict=True) if j), add_special_tokens=False)
        ids, of = np.array(whole.ids, dtype=np.int32), np.array(whole.word_ids, dtype=np.int64)
        n = int(joint.sum())
        if len(of) and of[-1] != n - 1:  # the library cut some word otherwise: one by one
            joint[:], n, ids = False, 0, ids[:0]
        own = np.bincount(of, minlength=n) if n else np.zeros(0, dtype=np.int64)
        rest = [e.ids for e in tok.encode_batch_fast([w for w, j in zip(words, joint, strict=True) if not j], add_special_tokens=False)]
        counts[joint] = own
        counts[~joint] = [len(x) for x in rest]
        out = np.empty(int(counts.sum()), dtype=np.int32)
        is_joint = np.repeat(joint, counts)
        out[is_joint], out[~is_joint] = ids, np.array([i for x in rest for i in x], dtype=np.int32)
        return out, counts

    return fill


def cutter(tok) -> Callable[[str], list[int]]:
    return lambda s: [b - a for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(s)]


_workers: dict[str, object] = {}


def once(key: str, make: Callable):
    """One object for each Python worker."""
    if key not in _workers:
        _workers[key] = make()
    return _workers[key]


def binary(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column from fixed-width values and the number of them in each row."""
    off = np.concatenate([[0], np.cumsum(counts)]) * data.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())]).cast(pa.binary())


def read_spec(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def bpe_encode(docs: DataFrame, tokenizer_path: str, text: str = "text", out: str = "ids", keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """The kept columns (all, unless named) plus out: the ids of text as BINARY; with decoded also the text decoded from them.

    tokenizer_path is read on the driver; its few MB are broadcast.
    """
    source, keep, schema = with_text(docs, docs.columns if keep is None else keep, text, f"`{out}` binary" + (f", `{decoded}` string" if decoded else ""))
    names = schema.fieldNames()
    data = read_spec(tokenizer_path)
    spec, key = docs.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()

    def run(batches):
        def make():
            v = Vocabulary(spec.value)
            return WordEncoder(v.special, v.merge, cutter(library(spec.value))), v

        enc, v = once(f"bpe-{key}", make)
        for b in slices(batches):
            texts = b.column(b.num_columns - 1).to_pylist()
            for lo, hi in chunks(texts):
                ids, counts = enc.encode_pieces(texts[lo:hi])
                cols = [*(c.slice(lo, hi - lo) for c in b.columns[:-1]), binary(ids.astype("<u4"), counts)]
                if decoded:
                    ends = np.cumsum(counts)
                    cols.append(pa.array([v.decode(ids[e - n : e]).decode("utf-8", "replace") for n, e in zip(counts, ends, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names)

    return map_arrow(source, run, schema)


def bpe_decode(tokenizer_path: str, spark) -> Callable[[Column], Column]:
    """A column function: BINARY ids to text; special tokens appear as their text."""
    data = read_spec(tokenizer_path)
    spec, key = spark.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()

    @F.pandas_udf("string")
    def decode(col: pd.Series) -> pd.Series:
        v = once(f"vocabulary-{key}", lambda: Vocabulary(spec.value))
        return pd.Series([v.decode(np.frombuffer(x or b"", dtype="<u4")).decode("utf-8", "replace") for x in col], dtype="object")

    return decode


def unpack_ids(ids: Column) -> Column:
    """BINARY ids as array<bigint>, in the JVM."""
    h = F.hex(ids)
    part = lambda i, k: F.substr(h, i * 8 + 1 + 2 * k, F.lit(2))
    n = (F.octet_length(ids) / 4).cast("int")
    one = lambda i: F.conv(F.concat(*[part(i, k) for k in (3, 2, 1, 0)]), 16, 10).cast("long")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<long>"))


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe_encode(docs, path, keep=["doc_id"], decoded="decoded").select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
