"""N-gram Jaccard join: documents whose shingle sets have a Jaccard similarity of at least `percent` / 100, exactly.

Sets, not documents, are joined: documents of equal sets collapse to one point with a 128-bit name.

Regions. Document pivots cannot divide a whole corpus: nearly all sets are at distance 1 from any pivot document and would stand
on every boundary. The outermost pivots are therefore single shingles, in a global order of rarity (a count-min class over
all documents, then the hash). A set belongs to the region of its first shingle, and the boundary window of width
e = 1 - t replicates it into the regions of its first n - ceil(t * n) + 1 shingles: two sets within e share one of
them. Shingles that the sketch proves unique have empty regions and are left out. The sketch has a fixed size, and with more shingles than cells (2**28: some GB
of text) it proves few unique; so the shingles that are left in those first places are counted exactly, over all sets, and one that no other
set has there is left out as well. Of two sets within e the smaller one has the first shingle that they share in its first n - ceil(2t / (1 + t) * n) + 1
places: it is home there, and in the places after those a set is a guest, which needs to meet smaller homes only; a guest that no home of its region
is small enough for is left out. A set's text goes on only with a shingle that another set has, so that what is carried grows with the sets that may have a partner.

Recursion. Within a region documents are the pivots. All members' distances d to the pivot are computed exactly; members within
e are linked to it. The rest is cut into Voronoi shells of width e around the pivot. By the triangle inequality two members
within e of each other have distances to the pivot that differ by at most e, so a member is home in its shell and is replicated,
as a guest, into the neighbouring ones only; guests need not meet guests. The pivot is the member with the smallest share of unique
shingles, the most central one. A region ends when its members are one component, or no home member is left. In a region with few
pairs the first pivot is compared with all others, and then those of different components, whose sizes, places of the region's shingle in both orders and marks allow the
similarity, are compared directly (the first shingle that two sets share leaves at most the rest of either order in common).
In larger ones the number of pivots doubles each round, so the number of rounds is logarithmic. A set's mark has a bit for each of up to n
hash values, which tells whether an odd number of its shingles have that one: marks differ in no more bits than the sets do in shingles, so that
no similar pair is lost, and the texts themselves are read and shuffled for the pairs that are left only.

Null or empty text has an empty set and is linked with nothing. With fewer words than `size` the whole sequence is one
shingle. Repeated rows are equal sets. The smallest non-null id names a component; it is null where all ids are. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envatlas.llm.arrowtext import mix, shingle_sets, words
from envatlas.llm.shared import column_named, components, drop, save, tidy
from envatlas.llm.sketch import holds, reaches, repeated, sketch

SIZE = 4
PERCENT = 85
#: Cells of the sketch, as a power of two: two planes of 32 MB, and a filter of 16 MB, at any size of input.
SKETCH_BITS = 28
#: Counts from which a shingle is of the shared and of the frequent class.
CLASSES = (2, 64)
#: Pairs for each row of a region up to which they are compared directly.
DIRECT = 256


def _sets(df: DataFrame, size: int, percent: int, lower: bool, bits: int, used: list | None = None) -> DataFrame:
    """(id, n, name, prefix, places, alone, mark, text) of each row; all but the first three once a task for each set that may have a partner, else null.

    places: where in the set's global order each shingle of the prefix stands; alone: how many of its shingles are known to be unique.
    used: gets the broadcasts, which nobody needs once the rows are saved.
    """

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in words(batch.column(0), lower):
            yield shingle_sets(part, size)[0]

    texts = df.select("text")
    planes = sketch(texts, hashes, bits, 1, list(CLASSES))

    def firsts(column: pa.Array, seen: set[bytes]) -> Iterator[tuple[int, bytes | None, int | None, np.ndarray | None, bytes | None]]:
        """(n, name, single, prefix, mark) of each text: how many shingles the sketch proves unique, and the others of the first places; null for a set in `seen`."""
        for part in words(column, lower):
            values, at = shingle_sets(part, size)
            rank = reaches(planes.value, values, 0).astype(np.uint8) + reaches(planes.value, values, 1)
            order_ = mix(values, 3)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                n = b - a
                name = hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if n else None
                prefix, single, bits_ = None, None, None
                if n and name not in seen:
                    length = n - (percent * n + 99) // 100 + 1
                    single = int(np.count_nonzero(rank[a:b] == 0))
                    if single < length:
                        prefix = values[a:b][np.lexsort((order_[a:b], rank[a:b]))[single:length]]
                        bits_ = _mark(order_[a:b])
                    if len(seen) > 1 << 18:
                        seen.clear()
                    seen.add(name)
                yield n, name, single, prefix, bits_

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        seen: set[bytes] = set()
        for batch in batches:
            for _, _, _, prefix, _ in firsts(batch.column(0), seen):
                if prefix is not None:
                    yield prefix

    shared = repeated(texts, left, bits - 1)
    if used is not None:
        used += [planes, shared]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            sizes, names, singles, own, marks = [], [], [], [], []
            for n, name, single, prefix, bits_ in firsts(batch.column(1), seen):
                sizes.append(n)
                names.append(name)
                singles.append(single)
                own.append(prefix)
                marks.append(bits_)
            many = [0 if x is None else len(x) for x in own]
            flat = np.concatenate([np.zeros(0, dtype=np.uint64), *(x for x in own if x is not None)])
            found = holds(shared.value, flat)
            prefixes, places, alone, end = [], [], [], 0
            for k, single in zip(many, singles, strict=True):
                kept = np.flatnonzero(found[end : end + k])
                prefixes.append(flat[end : end + k][kept].view(np.int64).tolist() or None)
                places.append((kept + single).tolist() if len(kept) else None)
                alone.append(None if single is None else single + k - len(kept))
                end += k
            whole = pa.array([x is not None for x in prefixes], type=pa.bool_())
            text = pc.if_else(whole, batch.column(1), pa.scalar(None, batch.column(1).type))
            mark = pc.if_else(whole, pa.array(marks, type=pa.binary()), pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, type=pa.int64()), pa.array(names, type=pa.binary()), pa.array(prefixes, type=pa.list_(pa.int64())), pa.array(places, type=pa.list_(pa.int32())), pa.array(alone, type=pa.int32()), mark, text], names=["id", "n", "name", "prefix", "places", "alone", "mark", "text"])

    return df.select("id", "text").mapInArrow(tidy(run), f"id {df.schema['id'].dataType.simpleString()}, n bigint, name binary, prefix array<bigint>, places array<int>, alone int, mark binary, text string")


def _mark(hashes: np.ndarray) -> bytes:
    """Whether an odd number of the hashes end in each value of some bits: n / 2 to n values, 64 at least."""
    many = max(64, 1 << (len(hashes).bit_length() - 1))
    return np.packbits((np.bincount((hashes & np.uint64(many - 1)).astype(np.int64), minlength=many) & 1).astype(np.uint8), bitorder="little").tobytes()


def _apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many bits each two marks differ; the longer one is folded to the other's length."""
    out, sizes = np.zeros(len(a), dtype=np.int64), np.array([[len(x) for x in a], [len(x) for x in b]])
    for k, m in {(k, m) for k, m in sizes.T.tolist()}:
        i = np.flatnonzero((sizes[0] == k) & (sizes[1] == m))
        least = min(k, m)
        x, y = (np.bitwise_xor.reduce(np.frombuffer(b"".join([v[j] for j in i]), dtype=np.uint8).reshape(len(i), -1, least), axis=1) for v in (a, b))
        out[i] = np.bitwise_count(x ^ y).sum(axis=1)
    return out


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """(pivot, name) of the pairs (pivot, name, total: both sizes, a, b: both marks) whose marks allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = _apart(batch.column(3).to_pylist(), batch.column(4).to_pylist())
            yield batch.select([0, 1]).filter(pa.array(apart * (100 + percent) <= batch.column(2).to_numpy() * (100 - percent)))

    return pairs.select("pivot", "name", "total", "a", "b").mapInArrow(tidy(run), "pivot binary, name binary").distinct()


def _distances(pairs: DataFrame, texts: DataFrame, size: int, lower: bool) -> DataFrame:
    """(pivot, name, both, either): sizes of intersection and union of each pair's sets, from the texts themselves.

    Both texts arrive by joins, so that a pivot of any number of pairs streams through many tasks.
    """
    left = texts.select(F.col("name").alias("pivot"), F.col("text").alias("pivot_text"))
    rows = pairs.join(texts, "name").join(left, "pivot").select("pivot", "name", "pivot_text", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, np.ndarray] = {}
        for batch in batches:
            pivots, both, either = batch.column(0).to_pylist(), [], []
            new = {p: i for i, p in enumerate(pivots) if p not in kept}
            if len(kept) > 256:
                kept, new = {}, {p: i for i, p in enumerate(pivots)}
            if new:
                some = batch.column(2).take(pa.array(list(new.values()), type=pa.int64()))
                held = [v[a:b] for part in words(some, lower) for v, at in [shingle_sets(part, size)] for a, b in zip(at[:-1], at[1:], strict=True)]
                kept |= dict(zip(new, held, strict=True))
            for part in words(batch.column(3), lower):
                values, at = shingle_sets(part, size)
                for i in range(len(at) - 1):
                    x, y = kept[pivots[part.first + i]], values[at[i] : at[i + 1]]
                    common = len(x) + len(y) - len(np.union1d(x, y)) if len(x) and len(y) else 0
                    both.append(common)
                    either.append(len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, type=pa.int64()), pa.array(either, type=pa.int64())], names=["pivot", "name", "both", "either"])

    return rows.mapInArrow(tidy(run), "pivot binary, name binary, both bigint, either bigint")


def _regions(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(region, place, name, n, c: how many sets, home, least: the smallest home's n) of the regions of two sets or more: a row for each set in each.

    Of regions of the same sets the first in the global order stays alone: the first shingle that two sets share is then of a region that stays.
    """
    rows = sets.select("name", "n", F.explode(F.arrays_zip("prefix", "places")).alias("x")).select(F.col("x.prefix").alias("region"), F.col("x.places").alias("place"), "name", "n")
    rows = rows.withColumn("home", F.expr(f"{100 + percent} * (n - place) >= {2 * percent} * n"))
    held = rows.groupBy("region").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("name")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "name")).alias("b"), F.min("place").alias("place"), F.min(F.when(F.col("home"), F.col("n"))).alias("least")).where("c > 1")
    kept = held.groupBy("c", "a", "b").agg(F.min(F.struct("place", "region", "least")).alias("x")).select(F.col("x.region").alias("region"), "c", "x.least")
    return rows.join(kept, "region")


def _active(regions: DataFrame) -> DataFrame:
    """Rows of the regions that have a home member and two components."""
    open_ = regions.groupBy("region").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.max("home").alias("h")).where("a <> b and h").select("region")
    return regions.join(open_, "region")


def link(df: DataFrame, ident: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT, lower: bool = True, bits: int = SKETCH_BITS, direct: float = DIRECT) -> DataFrame:
    """(id, n_shingles, component_id) for each row."""
    docs = df.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    used: list = []
    rows = save(_sets(docs, size, percent, lower, bits, used), "sets")
    for x in used:
        x.unpersist()
    width = (100 - percent) / 100.0
    sets = save(rows.where("prefix is not null").groupBy("name").agg(F.min("prefix").alias("prefix"), F.min("places").alias("places"), F.min("n").alias("n"), (F.min("alone") / F.min("n")).alias("alone"), F.min("mark").alias("mark")), "shared")
    same = ["name", "n", "place", "alone", "mark"]
    own = sets.select("name", F.col("name").alias("component"), "alone", "mark")
    met = _regions(sets, percent).where(f"home or {100 + percent} * (n - place) >= {percent} * (n + least)")
    regions = save(met.join(own, "name").select("region", "c", "home", "component", *same), "regions")
    drop(sets)
    joined, n = None, 0
    while regions.limit(1).count():
        sums = regions.groupBy("region", "component").agg(F.count("*").alias("c"), F.count_if("home").alias("h")).groupBy("region").agg(F.sum("c").alias("c"), F.sum("h").alias("h"), F.sum(F.col("c") * F.col("h")).alias("ch"), F.sum(F.col("h") * F.col("h")).alias("hh"))
        large = save(sums.where(F.col("c") * F.col("h") - F.col("ch") - (F.col("h") * F.col("h") - F.col("hh")) / 2 > direct * F.col("c")).select("region"), "large")
        small = regions.join(large, "region", "left_anti")
        if n:
            a, each = small, "a.home and (not b.home or a.name < b.name)"
        else:  # the pivots alone, so that a group of near copies is mostly one component before its members meet
            a, each = small.where("home").groupBy("region").agg(F.min(F.struct("alone", F.xxhash64("name", F.lit(n)).alias("p"), "name", "n", "place", "mark", "component")).alias("x")).select("region", "x.*"), "a.name <> b.name"
        near = a.alias("a").join(small.alias("b"), "region").where(f"""a.component <> b.component and {each}
            and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
            and (100 + {percent}) * least(a.n - a.place, b.n - b.place) >= {percent} * (a.n + b.n)""").select(F.least("a.name", "b.name").alias("pivot"), F.greatest("a.name", "b.name").alias("name"), (F.col("a.n") + F.col("b.n")).alias("total"), F.col("a.mark").alias("a"), F.col("b.mark").alias("b"))
        pairs = _possible(near, percent)
        some = large.limit(1).count() > 0
        done = n and not some
        if some:
            wide = save(regions.join(large, "region", "left_semi").select("region", *same, "component", "home"), "regions")
            spread = F.pmod(F.xxhash64("name", F.lit(n)), F.lit(1 << n)).cast("int")
            chosen = wide.where("home").groupBy("region", spread.alias("cell")).agg(F.min(F.struct("alone", F.xxhash64("name", F.lit(n)).alias("p"), "name")).alias("x")).select("region", "cell", F.col("x.name").alias("pivot"))
            chosen = save(chosen, "pivots")
            pairs = pairs.union(wide.join(chosen, "region").where("name <> pivot").select("pivot", "name")).distinct()
        pairs = save(pairs, "pairs")
        wanted = save(pairs.select(F.explode(F.array("pivot", "name")).alias("name")).distinct(), "wanted")
        texts = save(rows.where("text is not null").select("name", "text").join(wanted, "name", "left_semi").dropDuplicates(["name"]), "texts")
        found = save(_distances(pairs, texts, size, lower), "distances")
        drop(pairs, wanted, texts)
        linked = found.where(F.col("both") * 100 >= F.col("either") * percent).select(F.col("pivot").alias("a"), F.col("name").alias("b"))
        before, joined = joined, save(components(linked if joined is None else linked.union(joined)), "components")
        if before is not None:
            drop(before)
        if done:
            break
        rest = None if n else small.where("c > 2").select("region", *same, "home")  # two sets have met
        if some:
            first = chosen.groupBy("region").agg(F.min_by("pivot", "cell").alias("pivot"))
            gone = chosen.select("region", F.col("pivot").alias("name"))
            d = found.select("pivot", "name", (F.lit(1.0) - F.col("both") / F.col("either")).alias("d"))
            more = wide.drop("component").join(gone, ["region", "name"], "left_anti").join(first, "region").join(d, ["pivot", "name"])
            # shells are a little wider than e, for rounding errors at their edges
            shell = F.floor(F.col("d") / (width + 1e-6)).cast("int")
            into = F.when(F.col("home"), F.array(F.struct(shell.alias("shell"), F.lit(True).alias("home")), F.struct((shell - 1).alias("shell"), F.lit(False).alias("home")))).otherwise(
                F.transform(F.array(shell - 1, shell, shell + 1), lambda x: F.struct(x.alias("shell"), F.lit(False).alias("home")))
            )
            more = more.select("region", "pivot", *same, F.explode(into).alias("x")).select(F.xxhash64("region", "pivot", "x.shell").alias("region"), *same, F.col("x.home").alias("home"))
            rest = more if rest is None else rest.union(more)
        rest = rest.join(joined.withColumnRenamed("node", "name"), "name", "left").select("region", *same, F.coalesce("component", "name").alias("component"), "home")
        after = save(_active(rest), "regions")
        drop(regions, large, found, *([wide, chosen] if some else []))
        regions, n = after, n + 1
    names = rows.where("name is not null").groupBy("name").agg(F.min("id").alias("least"))
    if joined is not None:
        names = names.join(joined.withColumnRenamed("node", "name"), "name", "left").withColumn("component", F.coalesce("component", "name"))
        least = names.groupBy("component").agg(F.min("least").alias("component_id"))
        names = names.join(least, "component").select("name", "component_id")
    else:
        names = names.withColumnRenamed("least", "component_id")
    names = save(names, "names")
    out = rows.select("id", "n", "name").join(names, "name", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("name").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(df: DataFrame, ident: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `df` that stay when one document of each component stays: the one of least id, rows without an id last.

    Rows are told apart by id and text, so that of a component whose ids are all null, or are repeated with other texts, one row stays as well. Rows
    that repeat an id with an equal text stay once. Texts without words are linked with nothing and stay. Columns of any name pass through.
    """
    mark, n = column_named(df, "mark"), "n"
    keyed = df.withColumn(mark, F.struct(df[ident].isNull().alias("none"), df[ident].alias("id"), F.xxhash64(df[text]).alias("a"), F.xxhash64(F.lit(1), df[text]).alias("b")))
    rows = link(keyed, mark, text, **options).select(F.col("id").alias("stay"), "component_id")
    stay = save(rows.where(F.col("stay") == F.col("component_id")).groupBy("stay").agg(F.count("*").alias(n)), "stay")
    kept = keyed.join(stay, keyed[mark] == stay["stay"], "left_semi")
    if stay.where("n > 1").limit(1).count():
        kept = kept.dropDuplicates([mark])
    return kept.drop(mark)
