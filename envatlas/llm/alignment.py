"""Alignment of two tokenizers over the same bytes.

The ends of A's and of B's tokens, as offsets into the bytes, make one sorted array without repeats (union1d). Between two neighbours lies
an elementary interval; searchsorted names the A token and the B token that own it. Two tokens overlap in one interval at most, so that each interval is
one link. An end that both have closes a group, and a group's ids may be expanded into all their pairs (`expand`).

Neither tokenizer joins anything across a blank that follows another character than a blank and precedes one that is not white space: A's pattern starts a
new piece there, and none of B's pieces holds a blank behind another character. Texts are cut there into units; each distinct unit is
encoded once a block, and all that a document returns is a sum, or a join by `;`, over its units. The tests hold this against encoding whole texts.

Counts of id pairs over the corpus: see blocks.py; a block returns a row for each distinct pair in it. Null and empty texts have no tokens, nor have texts whose joined token
bytes are not a blank and the text (U+2581, which B writes for a blank, or invalid UTF-8). Repeated rows count each time; an empty table gives none. Other columns pass
through, and of clashing names the operator's own takes trailing underscores. Vocabularies whose tokens are empty, or whose B pieces hold a blank inside, are refused.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envatlas.llm.blocks import Numbered, chunks, items, met, packed, unpacked
from envatlas.llm.shared import kept, save, shipped, tidy

#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20
#: Units kept with their alignment by each Python worker, in each of two generations, and their greatest length.
KEPT_UNITS, KEPT_LENGTH = 25_000, 64
_AT_ONCE = 2048
#: Units of characters below this one (Latin letters, known alike to every regex library) are encoded together.
_PLAIN = "\u0250"
# Fixed value: the pieces of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLANK = "▁"
_CUT = re.compile(rf"(?<=[^ {_BLANK}]) (?=\S)")
_HARD = re.compile(rf"\A | \s| \Z|{_BLANK}")
_LOW = (1 << 32) - 1


def letters_to_bytes() -> dict[str, int]:
    """The letters of byte-level vocabularies: printable characters of Latin-1 stand for their own byte, the other bytes for U+0100 and on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def units(text: str) -> list[str]:
    """The text's units; the blank between two of them belongs to neither."""
    return _CUT.split(text) if _HARD.search(text) else text.split(" ")


def _units_of(text: bytes) -> list[str] | None:
    try:
        return units(text.decode()) if text else None
    except UnicodeDecodeError:
        return None


def expand(group: np.ndarray, a: np.ndarray, b: np.ndarray, groups_of_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (position in a, position in b) within each group; `group` and `groups_of_b` rise."""
    first, last = np.searchsorted(groups_of_b, group, side="left"), np.searchsorted(groups_of_b, group, side="right")
    many = last - first
    left = np.repeat(np.arange(len(a)), many)
    start = np.repeat(first - (np.cumsum(many) - many), many)
    return left, start + np.arange(len(left))


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the units aligned of late. Its pairs are links or, with `products`, those of whole groups."""

    def __init__(self, a: str, b: str, products: bool = False):
        import sentencepiece
        import tiktoken
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the cores
        self.a, self.b = tokenizers.Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        letter = letters_to_bytes()
        model = json.loads(Path(a).read_text(encoding="utf-8"))["model"]
        vocabulary = model["vocab"]
        of_a = {i: bytes(letter[c] for c in s) for s, i in vocabulary.items() if all(c in letter for c in s)}
        self.bytes_a = [of_a.get(i) or self.a.id_to_token(i).encode() for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if not all(self.bytes_a) or not all(pieces) or any(_BLANK in p.lstrip(_BLANK) for p in pieces):
            raise ValueError("a token is empty or holds a blank inside")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace(_BLANK, " ").encode() for p in pieces]
        self.long_a, self.long_b = (np.array([len(x) for x in table]) for table in (self.bytes_a, self.bytes_b))
        self.texts = [f"{i}{end}" for n, ends in ((len(pieces), ",;"), (len(self.bytes_a), ",|")) for end in ends for i in range(n)]  # B's, then A's
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.plain = None
        if [vocabulary[m] for m in merged] == list(range(256, 256 + len(merged))):  # an id is its merge's rank, as tiktoken takes it
            self.plain = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={self.bytes_a[i]: i for i in range(256 + len(merged))}, special_tokens={})
        self.products = products
        self.kept: tuple[dict, dict] = {}, {}

    def align(self, some: list[str]) -> list[tuple | None]:
        """(tokens of A, tokens of B, groups, their string, pairs as bytes of a << 32 | b) of each unit, null where the bytes differ."""
        out: list[tuple | None] = [None] * len(some)
        todo = []
        for i, u in enumerate(some):
            got = self.kept[0].get(u) or self.kept[1].get(u)
            if got is None:
                todo.append(i)
            else:
                out[i] = self.kept[0][u] = got
        for k in range(0, len(todo), _AT_ONCE):
            part = todo[k : k + _AT_ONCE]
            for i, got in zip(part, self._align([some[i] for i in part]), strict=True):
                out[i] = got
                if got is not None and len(some[i]) <= KEPT_LENGTH:
                    self.kept[0][some[i]] = got
        if len(self.kept[0]) > KEPT_UNITS:
            self.kept = {}, self.kept[0]
        return out

    def _align(self, some: list[str]) -> list[tuple | None]:
        out: list[tuple | None] = [None] * len(some)
        plain = [bool(self.plain and u and max(u) < _PLAIN and not u[0].isspace() and u[-1] != " ") for u in some]
        if together := [i for i, x in enumerate(plain) if x]:  # their text is encoded in one call
            text = " " + " ".join(some[i] for i in together)
            raw = text.encode()
            a, b = self.plain.encode_ordinary(text), self.b.encode(text[1:], num_threads=1)
            if b"".join(map(self.bytes_a.__getitem__, a)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw:
                self._intervals(out, together, [len(some[i].encode()) + 1 for i in together], np.array(a), np.array(b))
            else:
                plain = [False] * len(some)
        if alone := [i for i, x in enumerate(plain) if not x]:
            ids_a = [e.ids for e in self.a.encode_batch_fast([" " + some[i] for i in alone], add_special_tokens=False)]
            ids_b = self.b.encode([some[i] for i in alone], num_threads=1)
            raw = [(" " + some[i]).encode() for i in alone]
            good = [k for k, (x, y, r) in enumerate(zip(ids_a, ids_b, raw, strict=True)) if b"".join(map(self.bytes_a.__getitem__, x)) == r and b"".join(map(self.bytes_b.__getitem__, y)) == r]
            if good:
                a, b = (np.fromiter(chain.from_iterable(ids[k] for k in good), dtype=np.int64) for ids in (ids_a, ids_b))
                self._intervals(out, [alone[k] for k in good], [len(raw[k]) for k in good], a, b)
        return out

    def _intervals(self, out: list[tuple | None], use: list[int], sizes: list[int], a: np.ndarray, b: np.ndarray) -> None:
        """Fills `out` for the units `use` of these sizes in bytes, whose tokens stand one after the other in a and b."""
        bounds = np.cumsum(sizes)
        ends_a, ends_b = np.cumsum(self.long_a[a]), np.cumsum(self.long_b[b])
        ends = np.union1d(ends_a, ends_b)
        own_a, own_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        shared = ends[(ends_a[own_a] == ends) & (ends_b[own_b] == ends)]
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        if self.products:
            left, right = expand(group_a, a, b, group_b)
            pairs, at = a[left] << 32 | b[right], np.searchsorted(ends_a[left], bounds, side="right")
        else:
            pairs, at = a[own_a] << 32 | b[own_b], np.searchsorted(ends, bounds, side="right")
        last_a, last_b = shared[group_a] == ends_a, shared[group_b] == ends_b
        nb, na = len(self.bytes_b), len(self.bytes_a)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        names = list(map(self.texts.__getitem__, np.concatenate([a + 2 * nb + na * last_a, b + nb * last_b])[order].tolist()))
        to_a, to_b, to_group = (np.searchsorted(x, bounds, side="right") for x in (ends_a, ends_b, shared))
        before = (0, 0, 0, 0)
        for i, *now in zip(use, to_a.tolist(), to_b.tolist(), to_group.tolist(), at.tolist(), strict=True):
            out[i] = now[0] - before[0], now[1] - before[1], now[2] - before[2], "".join(names[before[0] + before[1] : now[0] + now[1]])[:-1], pairs[before[3] : now[3]].tobytes()
            before = now


@kept
@lru_cache(1)
def _load(a: str, b: str, _versions: str, products: bool) -> Aligner:
    return Aligner(SparkFiles.get(a), SparkFiles.get(b), products)


_OWN = [("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("groups_sha256", T.StringType())]
_LATE = [("n_best", T.LongType()), ("count_sum", T.LongType())]
_BLOCK = [("block", T.LongType()), ("units", T.BinaryType()), ("lists", T.BinaryType()), ("list_ends", T.BinaryType()), ("pairs", T.ArrayType(T.LongType())), ("pair_counts", T.ArrayType(T.LongType()))]


def _fields(have: list[T.StructField], more: list[tuple[str, T.DataType]]) -> list[T.StructField]:
    out = [T.StructField(f.name, f.dataType, True) for f in have]
    for name, kind in more:
        while name.lower() in {f.name.lower() for f in out}:
            name += "_"
        out.append(T.StructField(name, kind))
    return out


def _aligned(df: DataFrame, a: str, b: str, text: str, full: bool, products: bool) -> tuple[DataFrame, list[str], list[str]]:
    """The saved first pass (a row a document and a row a block), names of the documents' columns and of the blocks'."""
    (name_a, version_a), (name_b, version_b) = shipped(df, a), shipped(df, b)
    keep = [f for f in df.schema.fields if f.name != text]
    docs = _fields(keep, _OWN + ([("groups", T.StringType())] if full else []))
    fields = _fields(docs, _BLOCK)
    schema = T.StructType(fields)
    names = [f.name for f in fields]
    rows = df.select(F.col(text).cast("binary"), *[F.col(f"`{f.name}`") for f in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _load(name_a, name_b, version_a + version_b, products)
        arrow = None
        for batch, texts, block in chunks(batches, 0, BLOCK_BYTES):
            number = Numbered()
            split = [None if x is None else np.fromiter(map(number.__getitem__, x), dtype=np.int32) for x in map(_units_of, texts)]
            aligned = aligner.align(list(number))
            sound = np.array([x is not None for x in aligned], dtype=bool)
            sums = np.array([(*x[:3], len(x[4]) >> 3) if x else (0, 0, 0, 0) for x in aligned], dtype=np.int64).reshape(-1, 4)
            strings = [x[3] if x else "" for x in aligned]
            invalid = [x is None or not sound[x].all() for x in split]
            used = np.zeros(len(aligned), dtype=np.int64)
            out: list[list] = [[] for _ in range(6 if full else 5)]
            places = []
            for x, none in zip(split, invalid, strict=True):
                if none:
                    own, groups = [0, 0, 0, 0], ""
                    places.append(b"")
                else:
                    own, groups = sums[x].sum(axis=0).tolist(), ";".join(map(strings.__getitem__, x.tolist()))
                    used += np.bincount(x, minlength=len(used))
                    places.append(packed(x, len(aligned)))
                for column, v in zip(out, [*own, "" if none else hashlib.sha256(groups.encode()).hexdigest(), *([groups] if full else [])], strict=True):
                    column.append(v)
            ends = np.cumsum(sums[:, 3])
            flat = np.frombuffer(b"".join([x[4] for x in aligned if x]), dtype=np.int64)
            pairs, at = np.unique(flat, return_inverse=True)
            counts = np.bincount(at, weights=np.repeat(used, np.diff(ends, prepend=0)), minlength=len(pairs)).astype(np.int64)
            if arrow is None:
                arrow = [*[c.type for c in batch.columns[1:]], *[pa.int64()] * 4, pa.string(), *([pa.string()] if full else []), pa.int64(), *[pa.binary()] * 3, *[pa.list_(pa.int64())] * 2]
            some = batch.num_rows
            own = [*batch.columns[1:], *[pa.array(x, type=t) for x, t in zip(out, [*[pa.int64()] * 4, pa.string(), pa.string()], strict=False)]]
            own += [pa.array([block] * some), pa.array(places, type=pa.binary()), *[pa.nulls(some, t) for t in arrow[-4:]]]
            yield pa.RecordBatch.from_arrays(own, names=names)
            if len(flat):
                row = [block, None, at.astype(np.int32).tobytes(), ends.tobytes(), pairs, counts]
                lead = len(arrow) - len(row)
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in arrow[:lead]], *[pa.array([v], type=t) for v, t in zip(row, arrow[lead:], strict=True)]], names=names)

    return save(rows.mapInArrow(tidy(run, _load), schema), "aligned"), [f.name for f in docs], names[len(docs) :]


def pair_counts(df: DataFrame, a: str, b: str, text: str = "text", products: bool = False) -> DataFrame:
    """(a_id, b_id, n): how often the corpus links two ids; with `products`, how often they stand in one group."""
    saved, _, (block, _, _, _, pairs, counts) = _aligned(df, a, b, text, False, products)
    return items(saved, block, pairs, counts).groupBy("key").agg(F.sum("n").alias("n")).where("n > 0").select(F.shiftright("key", 32).cast("int").alias("a_id"), F.col("key").bitwiseAND(_LOW).cast("int").alias("b_id"), "n")


def align(df: DataFrame, a: str, b: str, text: str = "text", full: bool = False) -> DataFrame:
    """The columns of `df` but the text, and for each document

    n_a, n_b tokens, n_groups, n_links, groups_sha256 (of `a1,a2|b1;a3|b2,b3`; empty without tokens), with `full` that string as groups, n_best (links whose pair's count over the
    corpus is the highest of its B id, ties included) and count_sum (the sum of those counts over links).

    `a` is a byte-level `tokenizers` file, `b` a `sentencepiece` model, both on the driver; Spark hands them to the executors.
    """
    saved, docs, (block, places, lists, list_ends, pairs, counts) = _aligned(df, a, b, text, full, False)
    per_block = items(saved, block, pairs, counts).repartition("key")  # serves the counts and the join
    totals = per_block.groupBy("key").agg(F.sum("n").alias("total")).withColumn("b", F.col("key").bitwiseAND(_LOW))
    best = totals.groupBy("b").agg(F.max("total").alias("most"))
    known = totals.join(best, "b").select("key", "total", (F.col("total") == F.col("most")).alias("best"))
    back = per_block.select("block", "i", "key").join(known, "key").select("block", "i", "total", "best")
    fields = [T.StructField(f.name, f.dataType, True) for f in saved.schema.fields[: len(docs)]]
    schema = T.StructType(_fields(fields, _LATE))

    def finish(rows: pa.Table, known: pa.Table) -> pa.Table:
        total, best = np.zeros(known.num_rows, dtype=np.int64), np.zeros(known.num_rows, dtype=np.int64)
        i = known.column("i").to_numpy()
        total[i], best[i] = known.column("total").to_numpy(), known.column("best").to_numpy(zero_copy_only=False)
        own = rows.filter(pc.is_valid(rows.column(places)))
        sums = np.zeros((0, 2), dtype=np.int64)
        for x, e in zip(rows.column(lists).to_pylist(), rows.column(list_ends).to_pylist(), strict=True):
            if x is not None:
                at, ends = np.frombuffer(x, dtype=np.int32), np.frombuffer(e, dtype=np.int64)
                upto = np.zeros((len(at) + 1, 2), dtype=np.int64)
                np.cumsum(np.stack([best[at], total[at]], axis=1), axis=0, out=upto[1:])
                sums = np.diff(upto[ends], axis=0, prepend=upto[:1])
        late = np.array([sums[unpacked(x, len(sums))].sum(axis=0) if x else (0, 0) for x in own.column(places).to_pylist()], dtype=np.int64).reshape(-1, 2)
        columns = [own.column(c) for c in docs] + [pa.array(late[:, 0]), pa.array(late[:, 1])]
        return pa.Table.from_arrays(columns, names=[f.name for f in schema.fields])

    return met(saved.drop(pairs, counts), block, back, finish, schema)
