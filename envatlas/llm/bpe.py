"""BPE encoding and decoding with a segment tree over adjacent pair ranks, and token counts as an exact histogram.

The vocabulary is a `tokenizers` JSON file of the word kind: NFC, white space runs to one blank, lower case, a split
pattern, byte-level letters and an end-of-word suffix. Merging one word: leaf i of the tree holds the rank of the pair that
starts at symbol i (none: infinite), an inner node the smaller of its children and the left one on ties, so the root is the
leftmost pair of lowest rank. A merge replaces that leaf, clears the next symbol's and updates at most three leaves, each
in logarithmic time, until the root is infinite.

Null texts count as empty. Texts of any length are encoded whole. Rows are kept as they are, repeated ones too; an empty
table gives an empty result. Columns of the input other than the text pass through untouched, and of clashing names the
operator's own takes a trailing underscore.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envatlas.llm.shared import column_named, kept, shipped, tidy

#: Words kept with their ids by each Python worker, in each of two generations; others are merged again.
CACHED_WORDS = 40_000
#: Characters of texts whose words are merged together.
_TOGETHER = 1 << 20
_NEVER = np.int64(1 << 60)
_NONE = (1 << 62, 0)

# What Unicode 16 added to Python's Unicode 15.1 tables and the vocabulary files' own library knows.
NEWER_LETTERS = """1C89-1C8A A7CB-A7CD A7D2-A7D2 A7D4-A7D4 A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389
1138B-1138B 1138E-1138E 11390-113B5 113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C
18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0"""
NEWER_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
NEWER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEWER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def _known(kind: str, newer: str) -> str:
    """The regex class of category `kind` without characters that the regex module knows and the library doesn't."""
    some, no = regex.compile(rf"\p{{{kind}}}"), []
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        if some.fullmatch(c) and unicodedata.category(c)[0] != kind:
            if no and ord(no[-1][1]) == ord(c) - 1:
                no[-1][1] = c
            else:
                no.append([c, c])
    more = "".join("-".join(f"\\U{int(x, 16):08x}" for x in span.split("-")) for span in newer.split())
    return rf"[[\p{{{kind}}}--[{''.join(map('-'.join, no))}]]||[{more}]]" if no else rf"\p{{{kind}}}"


class PairTree:
    """The least (rank, position) of adjacent pairs, with point updates."""

    def __init__(self, ranks: list[int | None]):
        self.size = 1 << max(0, (len(ranks) - 1).bit_length())
        self.node = [_NONE] * (2 * self.size)
        for i, r in enumerate(ranks):
            if r is not None:
                self.node[self.size + i] = (r, i)
        for i in range(self.size - 1, 0, -1):
            self.node[i] = min(self.node[2 * i], self.node[2 * i + 1])

    def root(self) -> tuple[int, int]:
        return self.node[1]

    def put(self, i: int, rank: int | None) -> None:
        node, at = self.node, self.size + i
        node[at] = _NONE if rank is None else (rank, i)
        at >>= 1
        while at:
            best = min(node[2 * at], node[2 * at + 1])
            if node[at] == best:
                break
            node[at] = best
            at >>= 1


def merge_all(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merges the leftmost pair of lowest rank until no pair of `symbols` has a rank."""
    n = len(symbols)
    if n < 2:
        return list(symbols)
    symbols, after, before = list(symbols), [*range(1, n), -1], list(range(-1, n - 1))
    tree = PairTree([ranks.get((symbols[i], symbols[i + 1])) for i in range(n - 1)])
    while (best := tree.root())[0] < _NONE[0]:
        i = best[1]
        j = after[i]
        symbols[i] += symbols[j]
        symbols[j] = ""
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            tree.put(j, None)
        tree.put(i, ranks.get((symbols[i], symbols[k])) if k >= 0 else None)
        if (p := before[i]) >= 0:
            tree.put(p, ranks.get((symbols[p], symbols[i])))
    return [s for s in symbols if s]


class PairTrees:
    """The same trees for many words at once, as rows of arrays; each step merges at the root of every word that has one."""

    def __init__(self, vocab: dict[str, int], ranks: dict[tuple[str, str], int]):
        pairs = sorted((vocab[a] << 32 | vocab[b], rank, vocab[a + b]) for (a, b), rank in ranks.items())
        self.keys = np.array([x[0] for x in pairs], dtype=np.int64)
        self.rank = np.array([x[1] for x in pairs], dtype=np.int64)
        self.made = np.zeros(len(pairs), dtype=np.int64)
        self.made[self.rank] = [x[2] for x in pairs]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; those without one, or with a side below 0, get a number above all ranks."""
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.rank[at], _NEVER >> 8)

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """Merges rows of symbol ids, padded at the end with -1 to a power of two of at most 256; what is left over is -1."""
        n, width = symbols.shape
        symbols = symbols.astype(np.int64)
        place = np.arange(width)
        after = np.where(symbols[:, 1:] >= 0, place[1:], -1)
        after = np.concatenate([after, np.full((n, 1), -1)], axis=1).astype(np.int16)
        before = np.broadcast_to(place - 1, (n, width)).astype(np.int16).copy()
        tree = np.full((n, 2 * width), _NEVER, dtype=np.int64)
        tree[:, width : 2 * width - 1] = self.ranks(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, -1) << 8 | place[:-1]
        half = width // 2
        while half:
            np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2], out=tree[:, half : 2 * half])
            half //= 2
        none = (_NEVER >> 8) << 8
        row = np.flatnonzero(tree[:, 1] < none)
        while len(row):
            root = tree[row, 1]
            i = root & 255
            j = after[row, i].astype(np.int64)
            symbols[row, i] = self.made[root >> 8]
            symbols[row, j] = -1
            k = after[row, j].astype(np.int64)
            after[row, i] = k
            has = k >= 0
            before[row[has], k[has]] = i[has]
            p = before[row, i].astype(np.int64)
            right = np.where(has, self.ranks(symbols[row, i], symbols[row, k]), _NEVER >> 8) << 8 | i
            left = self.ranks(np.where(p >= 0, symbols[row, p], -1), symbols[row, i]) << 8 | np.maximum(p, 0)
            some = p >= 0
            for who, at, value in ((row, j, np.full(len(row), _NEVER)), (row, i, right), (row[some], p[some], left[some])):
                at = at + width
                tree[who, at] = value
                while at[0:1].size and at[0] > 1:
                    at = at >> 1
                    tree[who, at] = np.minimum(tree[who, 2 * at], tree[who, 2 * at + 1])
            row = row[tree[row, 1] < none]
        return symbols


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 stands for itself, the others for U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, n = {b: chr(b) for b in own}, 0
    for b in range(256):
        if b not in out:
            out[b], n = chr(0x100 + n), n + 1
    return out


class WordBpe:
    """Encodes and decodes as the tokenizers library does with such a file, without added special tokens."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        model = j["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.suffix = model["end_of_word_suffix"] or ""
        self.names = {i: s for s, i in self.vocab.items()}
        self.added = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.names |= {i: s for s, i in self.added.items()}
        self.letters = _byte_letters()
        self.lead = "<|"
        pattern = next(p["pattern"]["Regex"] for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # the file's classes hold nothing but white space, \p{L} and \p{N}
        self.words = regex.compile(pattern.replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}").replace("\\p{L}", _known("L", NEWER_LETTERS)).replace("\\p{N}", _known("N", NEWER_NUMBERS)), regex.V1)
        self.lower = str.maketrans(NEWER_LOWER)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.space = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
        self.trees = PairTrees(self.vocab, self.ranks)
        self.first = np.array([self.vocab.get(self.letters[b], -1) for b in range(256)])
        self.final = np.array([self.vocab.get(self.letters[b] + self.suffix, -1) for b in range(256)])
        self.whole = min(self.first.min(), self.final.min()) >= 0
        self.young: dict[str, tuple[int, str, str]] = {"": (0, "", "")}
        self.old: dict[str, tuple[int, str, str]] = {}
        self.word_young: dict[str, tuple[int, str, str]] = {}
        self.word_old: dict[str, tuple[int, str, str]] = {}

    def _word_ids(self, word: str) -> tuple[int, ...]:
        raw = [self.letters[b] for b in word.encode()]
        raw[-1] += self.suffix
        return tuple(self.vocab[s] for s in merge_all([s for s in raw if s in self.vocab], self.ranks))

    @staticmethod
    def lowered(text: str) -> str:
        """Lower case letter by letter: a final sigma gets no form of its own."""
        return text.replace("Σ", "σ").lower()

    def split_words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).translate(self.lower)
        return self.words.findall(self.lowered(self.space.sub(" ", text)))

    def piece_words(self, piece: str) -> list[str]:
        """split_words() of a piece without white space; letters alone, or letters before plain punctuation, need no pattern."""
        if piece.isascii():
            low = piece.lower()
        else:
            low = self.lowered(unicodedata.normalize("NFC", piece).translate(self.lower))
        if low.isalpha():
            return [low]
        core = low.rstrip(".,;:!?|")
        if core.isalpha():
            return [core, low[len(core) :]]
        return self.words.findall(low)

    def plain_ids(self, text: str) -> list[int]:
        return [i for w in self.split_words(text) for i in self._word_ids(w)]

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text; a special token's string in it is that token."""
        if not self.special or self.lead not in text:
            return self.plain_ids(text)
        return [i for k, part in enumerate(self.special.split(text)) for i in ([self.added[part]] if k % 2 else self.plain_ids(part))]

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder: the tokens' own strings, joined by one blank."""
        return " ".join(self.names[i] for i in ids)

    def _said(self, ids: list[int]) -> tuple[int, str, str]:
        """Count, ids and decoded string, the latter two with a blank before each token."""
        return len(ids), "".join([f" {i}" for i in ids]), "".join([" " + self.names[i] for i in ids])

    def rest(self) -> None:
        """Between tasks a worker process keeps only the words used of late."""
        self.old, self.word_old = {}, {}

    def _learn_words(self, new: list[str]) -> None:
        """Merges words, those of about equal length together."""
        kinds: dict[int, list[tuple[str, bytes]]] = {}
        for w in new:
            raw = w.encode()
            kinds.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((w, raw))
        for width, group in kinds.items():
            if width > 128 or not self.whole:
                for w, _ in group:
                    self.word_young[w] = self._said(list(self._word_ids(w)))
                continue
            for a in range(0, len(group), 1 << 20 >> width.bit_length()):
                some = group[a : a + (1 << 20 >> width.bit_length())]
                flat = np.frombuffer(b"".join([raw.ljust(width, b"\0") for _, raw in some]), dtype=np.uint8).reshape(-1, width)
                size = np.array([len(raw) for _, raw in some])
                ids = np.where(np.arange(width) < size[:, None], self.first[flat], -1)
                ids[np.arange(len(some)), size - 1] = self.final[flat[np.arange(len(some)), size - 1]]
                for (w, _), row in zip(some, self.trees.merge(ids).tolist(), strict=True):
                    self.word_young[w] = self._said([i for i in row if i >= 0])

    def split(self, text: str) -> list[str]:
        """Pieces between white space. It separates words before and after each normalisation step, so the pieces' ids together are the text's."""
        # str.split() takes these four for white space too
        return self.space.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def learn(self, pieces: set[str]) -> None:
        """Afterwards `young` has every one of the pieces, and what was used of late."""
        if len(self.young) > CACHED_WORDS:
            self.young, self.old = {"": (0, "", "")}, self.young
        if len(self.word_young) > CACHED_WORDS:
            self.word_young, self.word_old = {}, self.word_young
        young, old, split, new = self.young, self.old, {}, set()
        for piece in pieces - young.keys():
            if piece in old:
                young[piece] = old[piece]
            elif self.special and self.lead in piece:
                young[piece] = self._said(self.encode(piece))
            else:
                split[piece] = ws = self.piece_words(piece)
                new.update(ws)
        new -= self.word_young.keys()
        for w in new & self.word_old.keys():
            self.word_young[w] = self.word_old[w]
        self._learn_words(list(new - self.word_old.keys()))
        seen = self.word_young
        for piece, ws in split.items():
            if len(ws) == 1:
                young[piece] = seen[ws[0]]
            elif len(ws) == 2:
                (a, b, c), (x, y, z) = seen[ws[0]], seen[ws[1]]
                young[piece] = a + x, b + y, c + z
            else:
                got = [seen[w] for w in ws]
                young[piece] = sum([g[0] for g in got]), "".join([g[1] for g in got]), "".join([g[2] for g in got])

    def batch(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Count, ids and decoded string (the latter two joined by one blank) of each whole text, in order."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j] or "") <= _TOGETHER):
                size += len(texts[j] or "")
                j += 1
            split = [self.split(t or "") for t in texts[i:j]]
            self.learn(set().union(*split))
            seen = self.young
            for pieces in split:
                if not pieces:
                    yield 0, "", ""
                    continue
                n, ids, back = zip(*map(seen.__getitem__, pieces), strict=True)
                yield sum(n), "".join(ids)[1:], "".join(back)[1:]
            i = j


@kept
@lru_cache(2)
def _load(name: str, _version: str) -> WordBpe:
    return WordBpe(Path(SparkFiles.get(name)).read_text(encoding="utf-8"))


def encode_decode(df: DataFrame, path: str, text: str = "text", full: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 of each row's whole text; with `full`, also token_ids and decoded.

    `path` is a vocabulary file on the driver; executors receive it from Spark. A clashing column keeps its name and the
    operator's takes a trailing underscore.
    """
    name, version = shipped(df, path)
    own = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    own += [("token_ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())] if full else []
    own = [(column_named(df, c), t) for c, t in own]
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, t) for c, t in own)])
    where = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(name, version)
        for batch in batches:
            out: list[list] = [[] for _ in own]
            for n, ids, back in bpe.batch(batch.column(where).to_pylist()):
                row = [n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()]
                for column, x in zip(out, row + ([[int(i) for i in ids.split(" ") if i], back] if full else []), strict=True):
                    column.append(x)
            arrays = [pa.array(x, type=t) for x, t in zip(out, [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[f.name for f in schema.fields])
        bpe.rest()

    return df.mapInArrow(tidy(run, _load), schema)


def decode_ids(df: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """Adds `decoded`: the strings of the ids, joined by one blank; null ids decode to an empty string."""
    name, version = shipped(df, path)
    own = column_named(df, "decoded")
    schema = T.StructType([*df.schema.fields, T.StructField(own, T.StringType())])
    where = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(name, version)
        for batch in batches:
            back = pa.array([bpe.decode(x.as_py() or []) for x in batch.column(where)], type=pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, back], names=[f.name for f in schema.fields])

    return df.mapInArrow(tidy(run, _load), schema)


def encoded_lengths(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """One column n_tokens: the encoded length of each row's whole text."""
    name, version = shipped(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(name, version)
        for batch in batches:
            n = [x[0] for x in bpe.batch(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(n, type=pa.int64())], names=["n_tokens"])
        bpe.rest()

    return df.select(F.col(text)).mapInArrow(tidy(run, _load), "n_tokens bigint")
