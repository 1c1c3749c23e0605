"""Operator 2, n-gram Jaccard join: rare-first prefix filtering, verified once per pair.

A document is its set of distinct word n-grams. Texts with equal sets are one node. Grams are ordered rare
first by a counter table of fixed size over the whole corpus, so two nodes can only link if they share one of
their first ``n - ceil(t n) + 1`` grams. A group of nodes with a common prefix gram is not paired
with itself: in rounds, every node tries some neighbours in its groups, and links merge components; the last join is
left with groups that still hold several components, and with pairs across these.

Filters before any text moves: length; position (at the first common gram nothing before it is common, so as many
grams as the pair needs must be left from there in both); suffix (a set's parity bits bound the Hamming distance of two sets
from below, and so their overlap from above). A pair that passes is verified once, on whole sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import gram_hashes, map_arrow, release, save, split_words, steps, word_hashes
from pagewright.llm.graph import components

WORDS = 5
#: The threshold as a whole percentage.
PERCENT = 80
#: Bits of a gram's place in the rarity table: 4 million counters, 16 MB in a task and 4 MB when broadcast, for any corpus.
COUNTER_BITS = 22
#: The rarity tables of the tasks are summed in slices of so many counters, so many tables at a time.
SLICE, FAN_IN = 1 << 16, 64
#: Parity bits of a set, as 64-bit words.
PARITY_WORDS = 8
PARITY = [f"parity_{i}" for i in range(PARITY_WORDS)]
#: Neighbours in its group that a row is paired with in the first round.
NEIGHBOURS = 8
#: Rounds end when the last join has to compare at most so many pairs for each node, when a round settles less than a quarter of
#: what is to be compared, or after so many.
COMPARED, ROUNDS = 256, 8
#: Hubs that a group draws in each later round.
HUBS = 4
#: Partners of one node that one task verifies (in the mean); a node with more is salted.
PARTNERS = 256
#: Names of sets that a task remembers, so that copies in one partition give their postings once.
REMEMBERED = 200_000
#: Bits of the bitmap that keeps documents without candidates out of a shuffle: 4 MB at most.
MOST_BITS = 1 << 25
#: Nodes whose 64-bit name is shared by two sets; expected none below 10^9 documents, some dozens at 3 * 10^10.
MOST_COLLIDED = 100_000


def gram_sets(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams; with fewer words, one for the whole sequence; without, none."""
    words, starts = split_words(texts, lower=True)
    h = word_hashes(words)
    grams = gram_hashes(h, n)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
            out.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes(), b - a)], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def names_of(grams: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit names of a set, as signed integers."""
    raw = grams.tobytes()
    return tuple(np.array([xxhash.xxh3_64_intdigest(raw, 1), xxhash.xxh3_64_intdigest(raw, 2)], np.uint64).view(np.int64).tolist())


def rare_first(grams: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Grams renamed so that their numerical order is rare first: class of rarity, then hash."""
    return np.sort((classes[(grams >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (grams & np.uint64((1 << 56) - 1)))


def parity_bits(sets: list[np.ndarray]) -> np.ndarray:
    """A row of :data:`PARITY_WORDS` integers a set; bit i tells whether an odd number of the set's grams fall on i.

    Each bit in which two sets differ is owed to another gram that only one of them has.
    """
    out = np.zeros((len(sets), PARITY_WORDS), np.int64)
    bits = PARITY_WORDS * 64
    for lo in range(0, len(sets), 4096):
        some = sets[lo : lo + 4096]
        row = np.repeat(np.arange(len(some)), [len(s) for s in some])
        if len(row):
            at = row * bits + ((np.concatenate(some) >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)
            odd = (np.bincount(at, minlength=len(some) * bits) & 1).astype(bool)
            out[lo : lo + len(some)] = np.packbits(odd, bitorder="little").view("<i8").reshape(len(some), PARITY_WORDS)
    return out


def needed_overlap(na: int, nb: int, percent: int = PERCENT) -> int:
    return -(-percent * (na + nb) // (100 + percent))


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b|, for sorted distinct arrays.

    Suffix filter: both are parted at the middle of ``b``; parts that differ in size by too much end it early.
    """
    na, nb = len(a), len(b)
    if not na or not nb or 100 * min(na, nb) < percent * max(na, nb):
        return False
    need = needed_overlap(na, nb, percent)
    middle = nb // 2
    cut = int(np.searchsorted(a, b[middle]))
    if min(cut, middle) + min(na - cut, nb - middle) < need:
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (na + nb - shared)


def _scan(docs: DataFrame) -> DataFrame:
    """Pass one, saved: a narrow row for each document, and a task's counters as rows of slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << COUNTER_BITS, np.uint32)
        columns = ["doc_id", "text_key", "n_shingles", "name", "check", *PARITY, "slice", "counters"]
        kind = None
        for b in steps(batches, "text"):
            kind = b.schema.field("doc_id").type
            sets = gram_sets(b.column("text"))
            np.add.at(counters, (np.concatenate(sets) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), np.uint32(1))
            names = [names_of(s) if len(s) else (None, None) for s in sets]
            parity, m = parity_bits(sets), len(sets)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in names], pa.int64()), pa.array([x[1] for x in names], pa.int64()), *(pa.array(np.ascontiguousarray(parity[:, i])) for i in range(PARITY_WORDS)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], columns)
        if kind is not None:
            slices = counters.astype("<u8").reshape(-1, SLICE)
            for k in range(0, len(slices), 8):
                part = [zlib.compress(x.tobytes(), 1) for x in slices[k : k + 8]]
                m = len(part)
                yield pa.RecordBatch.from_arrays([pa.nulls(m, kind), *(pa.nulls(m, pa.int64()) for _ in range(4 + PARITY_WORDS)), pa.array(range(k, k + m), pa.int32()), pa.array(part, pa.binary())], columns)

    narrow = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    parity = ", ".join(f"{c} long" for c in PARITY)
    return save(map_arrow(narrow, run, f"doc_id {kind}, text_key long, n_shingles long, name long, check long, {parity}, slice int, counters binary"), "scan")


def _rarity(scan: DataFrame) -> np.ndarray:
    """A class of rarity for each counter, monotone in the corpus count. Slices are summed, some tables at a time; classes go to the driver."""

    def adding(last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(SLICE, np.uint64)
            for x in pdf["counters"]:
                total += np.frombuffer(zlib.decompress(x), "<u8")
            if last:
                total = np.minimum(255, np.floor(np.log2(total + 1.0) * 7)).astype(np.uint8)
            return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "counters": [zlib.compress(total.tobytes(), 1)]})

        return add

    parts = scan.filter("slice is not null").select("slice", "counters")
    tables = parts.filter("slice = 0").count()
    while tables > FAN_IN:
        tables = -(-tables // FAN_IN)
        parts = save(parts.groupBy("slice", F.pmod(F.xxhash64("counters"), F.lit(tables)).alias("k")).applyInPandas(adding(False), "slice int, counters binary"), "counters")
    out = np.zeros(1 << COUNTER_BITS, np.uint8)
    for x in parts.groupBy("slice").applyInPandas(adding(True), "slice int, counters binary").collect():
        out[x.slice * SLICE : (x.slice + 1) * SLICE] = np.frombuffer(zlib.decompress(x.counters), np.uint8)
    return out


def _postings(docs: DataFrame, classes: np.ndarray, collided: set[int], percent: int) -> DataFrame:
    """Pass two: ``(gram, node, size_at)`` for the prefix of each node; ``size_at`` packs set size and position."""
    table = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, seen = table.value, set()
        for b in steps(batches, "text"):
            if len(seen) > REMEMBERED:
                seen.clear()
            grams, nodes, packed = [], [], []
            for s in gram_sets(b.column("text")):
                if not len(s):
                    continue
                name, check = names_of(s)
                node = node_of(name, check, collided)
                if node in seen:
                    continue
                seen.add(node)
                n = len(s)
                p = n - -(-percent * n // 100) + 1
                grams.append(rare_first(s, rarity)[:p])
                nodes.append(np.full(p, node, np.int64))
                packed.append((n << 32) + np.arange(p, dtype=np.int64))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(packed))], ["gram", "node", "size_at"])

    return map_arrow(docs.select("text"), run, "gram long, node long, size_at long")


def node_of(name: int, check: int, collided: set[int]) -> int:
    return name if name not in collided else int(np.uint64(xxhash.xxh3_64_intdigest(np.array([name, check]).tobytes())).astype(np.int64))


def _shared(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (rows with ``other``) of each row with up to :data:`NEIGHBOURS` rows before it in its gram's group, and the rows of larger groups.

    In a group of up to NEIGHBOURS + 1 rows these are all pairs, so only larger groups are looked at again. The pairs have
    passed the length and positional filters. One sorted pass that holds a batch and the last rows.
    """
    names, most = ["gram", "node", "size_at", "other"], NEIGHBOURS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = v = x = np.empty(0, np.int64)
        for b in batches:
            held = len(g)
            g, v, x = (np.concatenate((old, b.column(i).to_numpy(zero_copy_only=False))) for i, old in enumerate((g, v, x)))
            fresh = np.ones(len(g), bool)
            fresh[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
            g, v, x = g[fresh], v[fresh], x[fresh]
            for far in range(1, most):
                i = np.arange(max(held, far), len(g))
                i = i[g[i] == g[i - far]]
                i = i[_fits(x[i], x[i - far], percent)]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(i), pa.int64()), pa.array(v[i - far]), pa.nulls(len(i), pa.int64()), pa.array(v[i])], names)
            i = np.arange(max(held, most), len(g))
            i = i[g[i] == g[i - most]]
            first = i[(i == most) | (g[i] != g[i - most - 1])]  # with these a group proves large: those before are due too
            i = np.concatenate((i, (first[:, None] - np.arange(1, most + 1)).ravel()))
            if len(i):
                yield pa.RecordBatch.from_arrays([*(pa.array(c[i]) for c in (g, v, x)), pa.nulls(len(i), pa.int64())], names)
            g, v, x = g[-most - 1 :], v[-most - 1 :], x[-most - 1 :]
        release()

    dealt = postings.repartition("gram").sortWithinPartitions("gram", "node")
    return save(map_arrow(dealt, run, "gram long, node long, size_at long, other long"), "shared-grams")


def _fits(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """:func:`_possible` on arrays."""
    na, nb = a >> 32, b >> 32
    left = np.minimum(na - (a & 0xFFFFFFFF), nb - (b & 0xFFFFFFFF))
    return (percent * np.maximum(na, nb) <= 100 * np.minimum(na, nb)) & ((100 + percent) * left >= percent * (na + nb))


def _possible(a: Column, b: Column, percent: int) -> Column:
    """Length and positional filters on packed sizes and positions.

    They hold for every linked pair at its first common gram (of earlier ones none is common): the overlap that the sizes ask for must fit in what is left from there.
    """
    na, nb = F.shiftright(a, 32), F.shiftright(b, 32)
    left = F.least(na - a.bitwiseAND((1 << 32) - 1), nb - b.bitwiseAND((1 << 32) - 1))
    return (percent * F.greatest(na, nb) <= 100 * F.least(na, nb)) & ((100 + percent) * left >= percent * (na + nb))


def _overlap_possible(one: str, two: str, percent: int) -> Column:
    """Suffix filter on parity bits: na + nb - 2 * overlap is at least the number of bits that differ."""
    size = F.shiftright(F.col(f"{one}.size_at"), 32) + F.shiftright(F.col(f"{two}.size_at"), 32)
    apart = sum((F.bit_count(F.col(f"{one}.{c}").bitwiseXOR(F.col(f"{two}.{c}"))) for c in PARITY), F.lit(0))
    return (100 + percent) * (size - apart) >= 2 * percent * size


def _may_hold(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of bounded size that has a bit for every key: false positives only, more of them as it fills."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * keys.count()).bit_length()))
    at = F.pmod(F.xxhash64(column), F.lit(bits))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(1 << 16, bool)
        part[pdf["at"].to_numpy() & 0xFFFF] = True
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(part, bitorder="little").tobytes()]})

    out = np.zeros(bits >> 3, np.uint8)
    for row in keys.select(at.alias("at")).distinct().groupBy(F.shiftright("at", 16).alias("part")).applyInPandas(fill, "part long, bits binary").collect():
        out[row.part << 13 : (row.part + 1) << 13] = np.frombuffer(row.bits, np.uint8)
    return out


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar; each pair once.

    ``a``'s text goes to one task (or, with many partners, to so many salted ones) and the partners' texts stream past it there.
    A node's text comes from its first document; a bitmap keeps most other documents out of the shuffle.
    """
    hubs = pairs.groupBy("a").agg((F.floor(F.count("*") / PARTNERS) + 1).alias("salts"))
    partners = pairs.join(hubs, "a").select(F.col("b").alias("node"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), F.lit(True).alias("partner"))
    own = hubs.select(F.col("a").alias("node"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("partner"))
    sent = save(partners.unionByName(own).join(nodes, "node").select("node", "hub", "salt", "partner", F.col("first.doc_id").alias("own_id"), F.col("first.text_key").alias("own_key")), "sent")
    bitmap = docs.sparkSession.sparkContext.broadcast(_may_hold(sent.select("own_key").distinct(), "own_key"))

    @F.pandas_udf("boolean")
    def wanted(at: pd.Series) -> pd.Series:
        x, table = at.to_numpy(), bitmap.value
        return pd.Series((table[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1)

    bits = len(bitmap.value) * 8
    source = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), "text").filter(wanted(F.pmod(F.xxhash64("key"), F.lit(bits))))
    match = source.join(sent, (source["key"] == sent["own_key"]) & source["id"].eqNullSafe(sent["own_id"])).select("hub", "salt", "partner", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, current = None, None
        for b in steps(batches, "text"):
            good: list[tuple[int, int]] = []
            for h, partner, node, grams in zip(b.column("hub").to_pylist(), b.column("partner").to_pylist(), b.column("node").to_pylist(), gram_sets(b.column("text")), strict=True):
                if not partner:
                    hub, current = h, grams
                elif h == hub and similar(current, grams, percent):
                    good.append((h, node))
            if good:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*good, strict=True)], ["a", "b"])

    dealt = match.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "partner", "node")
    return save(map_arrow(dealt, run, "a long, b long").distinct(), "links")


def _open(shared: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """The rows of groups that still hold several components, with their roots; and how many pairs across components these groups hold."""
    known = shared.select("gram", "node", "size_at").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = known.groupBy("gram", "root").agg(F.count("*").cast("double").alias("n"))
    several = parts.groupBy("gram").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"))
    several = save(several.filter("roots > 1").select("gram", ((F.col("n") * F.col("n") - F.col("inside")) / 2).alias("compared")), "open-groups")
    compared = several.agg(F.sum("compared")).first()[0] or 0
    return save(known.join(several.select("gram"), "gram", "left_semi"), "open-grams"), int(compared)


def _tries(open_rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of each row of an open group with the nodes of other components that the group draws in this turn."""
    drawn = [F.min(F.struct(F.xxhash64("node", F.lit(turn * HUBS + i)).alias("draw"), F.col("node").alias("hub"), F.col("root").alias("hub_root"), F.col("size_at").alias("hub_size_at"))).alias(f"hub_{i}") for i in range(HUBS)]
    hubs = open_rows.groupBy("gram").agg(*drawn)
    each = F.array_distinct(F.array(*(F.col(f"hub_{i}").dropFields("draw") for i in range(HUBS))))
    met = open_rows.join(hubs.select("gram", F.inline(each)), "gram").filter(F.col("root") != F.col("hub_root"))
    return met.filter(_possible(F.col("size_at"), F.col("hub_size_at"), percent)).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))


def similar_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document, one row for each row of ``docs``; also ``text_key, component_key``.

    Two documents link where 100 * intersection >= ``percent`` * union of their shingle sets; component_id is the
    smallest doc_id reachable by links. Documents without words link with nothing and are their own component.
    Rows with equal sets are one node, so copies cost one narrow row each, in any number. Null ids take part
    and never name a component unless it has no other id. Repeated rows give repeated results; other columns are not read.
    component_id does not tell components apart where ids are null or repeated; component_key does: the root node, or for a row without words its id and text_key.
    """
    scan = _scan(docs)
    rows = scan.filter("slice is null").drop("slice", "counters")
    twice = rows.filter("name is not null").groupBy("name").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo <> hi").select("name").limit(MOST_COLLIDED + 1).collect()
    if len(twice) > MOST_COLLIDED:
        raise RuntimeError("too many sets share a name")
    collided = {r.name for r in twice}
    if collided:

        def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                node = [None if n is None else node_of(n, c, collided) for n, c in zip(b.column("name").to_pylist(), b.column("check").to_pylist(), strict=True)]
                yield b.append_column("node", pa.array(node, pa.int64()))

        rows = map_arrow(rows, rename, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", node long")
    else:
        rows = rows.withColumn("node", F.col("name"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "text_key")).alias("first")
    size = F.shiftleft(F.first("n_shingles"), 32).alias("size_at")
    nodes = save(rows.filter("node is not null").groupBy("node").agg(first, size, *(F.first(c).alias(c) for c in PARITY)), "nodes")
    bits = nodes.select("node", "size_at", *PARITY)

    met = _shared(_postings(docs, _rarity(scan), collided, percent), percent)
    shared = met.filter("other is null").drop("other")
    budget = COMPARED * nodes.count()
    tried = links = roots = None
    before = float("inf")
    for turn in range(ROUNDS + 1):
        if turn == 0:
            near = met.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
        else:
            open_rows, compared = _open(shared, roots)
            if not compared:
                break
            last = turn == ROUNDS or compared <= budget or compared > 0.75 * before
            before = compared
            near = None if last else _tries(open_rows, turn, percent)
        if near is not None:
            near = near.distinct()
            one, two = bits.alias("one"), bits.alias("two")
            found = near.join(one, F.col("a") == F.col("one.node")).join(two, F.col("b") == F.col("two.node"))
            found = found.filter(_overlap_possible("one", "two", percent)).select("a", "b")
        else:
            wide = open_rows.join(bits.drop("size_at"), "node")
            one, two = wide.alias("one"), wide.alias("two")
            across = (F.col("one.node") < F.col("two.node")) & (F.col("one.root") != F.col("two.root"))
            across = across & _possible(F.col("one.size_at"), F.col("two.size_at"), percent) & _overlap_possible("one", "two", percent)
            found = one.join(two, (F.col("one.gram") == F.col("two.gram")) & across).select(F.col("one.node").alias("a"), F.col("two.node").alias("b")).distinct()
        fresh = save(found if tried is None else found.join(tried, ["a", "b"], "left_anti"), "pairs")
        if roots is None:
            roots = fresh.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
        if fresh.take(1):
            linked = _verified(fresh, nodes, docs, percent)
            tried = fresh if tried is None else tried.unionByName(fresh)
            if linked.take(1):
                links = linked if links is None else links.unionByName(linked)
                roots = components(links)
        if near is None:
            break

    named = nodes.select("node", F.col("first.doc_id").alias("own")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = named.groupBy("root").agg(F.min("own").alias("component"))
    classes = named.join(best, "root").select("node", "component", "root")
    out = rows.join(classes, "node", "left")
    alone = F.col("root").isNull()
    key = F.struct("root", F.when(alone, F.col("doc_id")).alias("doc_id"), F.when(alone, F.col("text_key")).alias("text_key"))
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "text_key", key.alias("component_key"))
