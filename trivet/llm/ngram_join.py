"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document of n shingles reaches the similarity with another one only if it shares T = 0.8 n of them or more. Its inverted
lists are divided: the longest ones, L of them, are set aside, so a partner must occur T - L times or more in the short
ones. Short lists are merged by a heap over sorted runs, each range of shingles in one task; occurrences are counted for
each pair of documents and added up over the ranges, and pairs below T - L are dropped. The set-aside lists are never
merged: the entries of the documents that candidates need are built into sorted lists where the pairs meet, and probed by
binary search, which gives the exact overlap.

"Long" is a corpus-wide fact: shingles of more than ``heavy`` sets come last in the one order that all documents share.
The order only has to be the same everywhere, so the count may be a bitmap of fixed size without touching results.

Copies (equal shingle sets) are one node. Each node is first verified with its best candidate; of the other pairs only
those whose components still differ are. A list of many different sets is not expanded into pairs: its members are
candidates of a few hubs, and after the components of verified links are known, only members of different components
still meet, in blocks. So large groups of near copies cost a few verifications a member, and no link between components
is lost. Texts move once for each role of a document in a verification, never in the counting.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivet.llm.common import Scratch, batches_of_rows, give_back
from trivet.llm.graph import components
from trivet.llm.shingles import U, Index, Lanes, batches_of, mix, set_print, shingle_sets
from trivet.llm.word_parts import pack, small, unpack

#: Bits of the fixed-size maps (8 MB each) that travel to every task.
MAP_BITS = 26
COUNTED_BITS = 63  # shingles in the lower half of the prints are counted
SHORT = 12
#: Short lists of a document beyond the fewest that must be merged, so that one shared shingle makes no candidate.
SPARE = 2
PART_BYTES = 16 << 20  # text for each range of shingles
BLOCK_SHINGLES = 200_000  # of the sets that meet in one block
PARTNERS = 128  # texts that come to one document's verification at once


def least_overlap(n: np.ndarray | int, share: int) -> np.ndarray | int:
    """Shingles that a set of ``n`` has in common with any partner, at least."""
    return (share * n + 99) // 100


def fixed_map(places: DataFrame) -> bytes:
    """A bitmap of ``place`` (0 to 2**MAP_BITS - 1). Its size does not depend on the input."""
    at = F.col("place") + 1
    rows = places.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = bytearray(2 ** (MAP_BITS - 3))
    for row in rows:
        start = (row.k - 1) * 4096
        out[start : start + len(row.bits)] = row.bits
    return bytes(out)


def marked(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def heavy_places(src: DataFrame, parts_log2: int, heavy: int, size: int) -> DataFrame:
    """``place`` of the shingles that more than ``heavy`` texts have. Prints move in packed form, sorted by range."""
    low = COUNTED_BITS - parts_log2 - 32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in batches_of(x.as_py() for x in batch.column("text")):
                sets = {u[0].tobytes(): u[0] for u in shingle_sets(texts, size)}  # copies in a batch count once
                prints = np.concatenate([*sets.values(), np.empty(0, np.uint64)])
                prints = np.sort(prints[prints < U(1 << COUNTED_BITS)] >> U(low))
                edges = np.searchsorted(prints, np.arange((1 << parts_log2) + 1, dtype=np.uint64) << U(32))
                keep = np.flatnonzero(np.diff(edges))
                data = prints.astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([data[edges[k] : edges[k + 1]].tobytes() for k in keep], pa.binary())], ["part", "data"])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in gathered(batches):
            prints, counts = np.unique(np.frombuffer(b"".join(blobs), np.uint32), return_counts=True)
            place = (U(part) << U(32) | prints[counts > heavy].astype(np.uint64)) >> U(32 + parts_log2 - MAP_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(place).astype(np.int64))], ["place"])

    return src.mapInArrow(count, "part int, data binary").repartition(1 << parts_log2, "part").mapInArrow(select, "place bigint")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The blobs of each part that came to this task."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist()):
            held.setdefault(part, []).append(data)
    while held:
        yield held.popitem()


def short_lists(src: DataFrame, kind: str, parts_log2: int, share: int, size: int, map_of_heavy) -> DataFrame:
    """A row ``doc_id, sid, n`` for every document, and rows ``part, data`` with packed entries of its short lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(map_of_heavy.value, np.uint8)
        for batch in batches:
            sids: list[bytes | None] = []
            ns: list[int] = []
            parts, blobs = [], []
            for texts in batches_of(x.as_py() for x in batch.column("text")):
                lists, who, many, aside, seen = [], [], [], [], set()
                for shingles in shingle_sets(texts, size):
                    u = shingles[0]
                    n = len(u)
                    ns.append(n)
                    if not n:
                        sids.append(None)
                        continue
                    sid = set_print(shingles)
                    sids.append(sid)
                    if sid in seen:
                        continue
                    seen.add(sid)
                    least = least_overlap(n, share)
                    k = n - least + min(SPARE, least)
                    counted = np.searchsorted(u, U(1 << COUNTED_BITS))
                    long = np.zeros(n, bool)
                    long[:counted] = marked(bits, (u[:counted] >> U(COUNTED_BITS - MAP_BITS)).astype(np.int64))
                    own = np.unique(np.concatenate([u[~long][:k], u[long][: max(0, k - n + int(long.sum()))]]))
                    lists.append(own)
                    who.append(sid)
                    many.append(n)
                    aside.append(n - len(own))
                if not lists:
                    continue
                lengths = np.fromiter(map(len, lists), np.int64, len(lists))
                prints = np.concatenate(lists)
                owner = np.repeat(np.arange(len(lists)), lengths)
                part = (prints >> U(64 - parts_log2)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                prints, owner, part = prints[order], owner[order], part[order]
                edges = np.searchsorted(part, np.arange((1 << parts_log2) + 1))
                names, sizes = np.frombuffer(b"".join(who), np.uint8).reshape(-1, 16), np.array([many, aside])
                for p in np.flatnonzero(np.diff(edges)):
                    own, each = np.unique(owner[edges[p] : edges[p + 1]], return_counts=True)
                    parts.append(p)
                    blobs.append(pack(names[own].ravel(), small(sizes[0, own]), small(sizes[1, own]), small(each), prints[edges[p] : edges[p + 1]]))
            a, b = len(sids), len(parts)
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([ids, pa.nulls(b, ids.type)]), pa.array(sids + [None] * b, pa.binary()), pa.array(ns + [0] * b, pa.int64()), pa.array([None] * a + [int(p) for p in parts], pa.int32()), pa.array([None] * a + blobs, pa.binary())],
                ["doc_id", "sid", "n", "part", "data"],
            )
        give_back()

    return src.mapInArrow(run, f"doc_id {kind}, sid binary, n bigint, part int, data binary")


def sorted_runs(blobs: list[bytes], parts_log2: int) -> tuple[list[bytes], np.ndarray, list[list[int]]]:
    """The documents of a range, their sizes and set-aside lists, and a run for each blob: its entries (shingle and
    document in one number) in order. Shingles that a sieve finds only once in the range have no list and are left out."""
    number: dict[bytes, int] = {}
    sizes: list[tuple[int, int]] = []
    runs = []
    bits = 20
    sieve = np.zeros(1 << bits, np.uint32)
    for blob in blobs:
        names, many, aside, each, prints = unpack(blob)
        docs = np.empty(len(many), np.int64)
        for i, both in enumerate(zip(many.tolist(), aside.tolist())):
            sid = names[16 * i : 16 * i + 16].tobytes()
            at = number.get(sid)
            if at is None:
                at = number[sid] = len(number)
                sizes.append(both)
            docs[i] = at
        runs.append((prints, np.repeat(docs, each)))
        sieve += np.bincount((prints << U(parts_log2) >> U(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
    out = []
    for prints, docs in runs:
        several = sieve[(prints << U(parts_log2) >> U(64 - bits)).astype(np.int64)] > 1
        out.append(sorted([p << 32 | d for p, d in zip(prints[several].tolist(), docs[several].tolist())]))
    return list(number), np.array(sizes, np.int64).reshape(-1, 2), out


def merged_lists(runs: list[list[int]]) -> Iterator[tuple[int, list[int]]]:
    """Shingles and the documents of their lists, by a heap over the heads of the runs."""
    last, members = -1, []
    for key in heapq.merge(*runs):
        shingle, doc = key >> 32, key & 0xFFFFFFFF
        if shingle != last:
            if len(members) > 1:
                yield last, members
            last, members = shingle, [doc]
        elif doc != members[-1]:
            members.append(doc)
    if len(members) > 1:
        yield last, members


def candidates(lists: DataFrame, parts_log2: int, share: int, short: int) -> DataFrame:
    """Rows of pairs (``a < b``) with their occurrences ``c`` in the range's short lists and the number ``needed`` over
    all ranges, pairs with hubs with ``c`` null, and rows ``print, a`` of the entries of lists too long to give pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in gathered(batches):
            names, sizes, runs = sorted_runs(blobs, parts_log2)
            n, aside = sizes[:, 0], sizes[:, 1]
            of = n.tolist()
            counts: Counter[tuple[int, int]] = Counter()
            hubs: set[tuple[int, int]] = set()
            prints, entries = [], []

            def fit(i: int, j: int) -> bool:
                return 100 * min(of[i], of[j]) >= share * max(of[i], of[j])

            for shingle, members in merged_lists(runs):
                if len(members) <= short:
                    counts.update([p for p in combinations(members, 2) if fit(*p)])
                    continue
                prints += [shingle - (1 << 64) if shingle >> 63 else shingle] * len(members)
                entries += members
                own = np.array(members)
                band = (np.log(n[own]) / np.log(100 / share)).astype(np.int64)
                name = np.array([int.from_bytes(names[i][:8], "little") for i in members], np.uint64)
                for seed in (1, 2):
                    order = np.lexsort((mix(name + U(seed)), band))
                    first = dict(zip(reversed(band[order].tolist()), reversed(own[order].tolist())))
                    for i, b in zip(members, band.tolist()):
                        for hub in (first[b], first.get(b - 1)):
                            if hub is not None and hub != i and fit(i, hub):
                                hubs.add((min(i, hub), max(i, hub)))
            pairs = [*counts, *hubs]
            i, j = np.array(pairs, np.int64).reshape(-1, 2).T
            least = -(-share * (n[i] + n[j]) // (100 + share)) - np.maximum(aside[i], aside[j])
            turned = [(names[x], names[y]) if names[x] < names[y] else (names[y], names[x]) for x, y in pairs]
            k, m = len(pairs), len(entries)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None] * k + prints, pa.int64()),
                    pa.array([x for x, _ in turned] + [names[x] for x in entries], pa.binary()),
                    pa.array([y for _, y in turned] + [None] * m, pa.binary()),
                    pa.array([*counts.values(), *[None] * (len(hubs) + m)], pa.int64()),
                    pa.array([*least.tolist(), *[None] * m], pa.int64()),
                    pa.array([*(n[i] + n[j]).tolist(), *[None] * m], pa.int64()),
                ],
                ["print", "a", "b", "c", "needed", "n"],
            )
            give_back()

    return lists.repartition(1 << parts_log2, "part").mapInArrow(run, "print bigint, a binary, b binary, c bigint, needed bigint, n bigint")


def texts_of(sids: DataFrame, src: DataFrame, nodes: DataFrame, kind: str, size: int, scratch: Scratch) -> DataFrame:
    """``sid, data``: one packed text for each set. A bitmap of fixed size keeps most other texts from moving."""
    chosen = scratch.cut(nodes.join(sids, "sid").groupBy("sid").agg(F.min("doc_id").alias("doc_id")))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << MAP_BITS))
    wanted = src.sparkSession.sparkContext.broadcast(fixed_map(chosen.select(place.alias("place"))))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, pack = np.frombuffer(wanted.value, np.uint8), zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            at = np.flatnonzero(marked(bits, batch.column("place").to_numpy(zero_copy_only=False)))
            for k in range(0, len(at), 1000):
                rows = pa.array(at[k : k + 1000])
                texts = batch.column("text").take(rows).to_pylist()
                sids = [set_print(u) for part in batches_of(texts) for u in shingle_sets(part, size)]
                data = pa.array([pack(t.encode()) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), pa.array(sids, pa.binary()), data], ["doc_id", "sid", "data"])

    found = src.withColumn("place", place).mapInArrow(fetch, f"doc_id {kind}, sid binary, data binary")
    same = F.expr("found.sid = chosen.sid AND found.doc_id <=> chosen.doc_id")
    out = scratch.cut(found.alias("found").join(chosen.alias("chosen"), same).select("found.sid", "data").dropDuplicates(["sid"]))
    scratch.free(chosen)
    return out


def sets_of(data: pa.ChunkedArray, size: int) -> list[Lanes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [u for part in batches_of(unpack(x).decode() for x in data.to_pylist()) for u in shingle_sets(part, size)]


def oriented(pairs: DataFrame) -> DataFrame:
    """``a, b, turn``: of each pair the document of more pairs is ``a``, whose partners are dealt into turns. So the text of a hub moves
    once a turn, and no document is the ``b`` of very many pairs. Only documents of more pairs than a turn has are looked up."""
    ends = pairs.select(F.col("a").alias("x")).unionAll(pairs.select(F.col("b").alias("x")))
    many = ends.groupBy("x").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PARTNERS)
    for x in ("a", "b"):
        pairs = pairs.join(many.select(F.col("x").alias(x), F.col("n").alias(f"n_{x}")), x, "left")
    na, nb = (F.coalesce(f"n_{x}", F.lit(1)) for x in ("a", "b"))
    a, b = F.when(nb > na, F.col("b")).otherwise(F.col("a")), F.when(nb > na, F.col("a")).otherwise(F.col("b"))
    both = pairs.select(a.alias("a"), b.alias("b"), F.ceil(F.greatest(na, nb) / PARTNERS).alias("turns"))
    return both.select("a", "b", F.pmod(F.xxhash64("b"), F.col("turns")).alias("turn"))


def verified(pairs: DataFrame, texts: DataFrame, share: int, size: int, scratch: Scratch) -> DataFrame:
    """The pairs whose sets reach the similarity, by exact overlap. Partners come to one document, ``PARTNERS`` at a time,
    into one index that its shingles probe."""
    dealt = oriented(pairs)
    theirs = dealt.join(texts.withColumnRenamed("sid", "b"), "b").select("a", "turn", "b", "data")
    mine = dealt.select(F.col("a").alias("own"), F.col("turn").alias("own_turn")).distinct().join(texts.select(F.col("sid").alias("own"), F.col("data").alias("own_data")), "own")

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return right.slice(0, 0).select(["a", "b"])
        x = sets_of(left.column("own_data"), size)[0]
        index = Index(sets_of(right.column("data"), size))
        both = index.overlaps(x)
        take = np.flatnonzero(100 * both >= share * (len(x[0]) + index.sizes - both))
        return right.select(["a", "b"]).take(pa.array(take))

    return scratch.cut(mine.groupBy("own", "own_turn").cogroup(theirs.groupBy("a", "turn")).applyInArrow(probe, "a binary, b binary"))


def best_pairs(pairs: DataFrame) -> DataFrame:
    """For each document its pair of the largest share of occurrences."""
    ends = pairs.select(F.col("a").alias("x"), "*").unionByName(pairs.select(F.col("b").alias("x"), "*"))
    top = ends.groupBy("x").agg(F.max(F.struct((F.col("c") / F.col("n")).alias("r"), "a", "b")).alias("p"))
    return top.select("p.a", "p.b").distinct()


def apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs that no known component joins."""
    for x in ("a", "b"):
        pairs = pairs.join(known.select(F.col("node").alias(x), F.col("component").alias(f"_{x}")), x, "left")
    return pairs.filter("_a IS NULL OR _b IS NULL OR _a <> _b").select("a", "b")


def closing_links(entries: DataFrame, known: DataFrame, texts: DataFrame, nodes: DataFrame, share: int, size: int, scratch: Scratch, block: int = BLOCK_SHINGLES) -> DataFrame:
    """Links between the components that still stand apart in long lists.

    Lists whose members are of one component are done. Components that meet in other lists form a cluster. Inside a
    cluster, the members outside its largest component are queries against all of its members, which are dealt into
    blocks of about ``block`` shingles, each with one merged list. So no list is ever turned into pairs.
    """
    placed = scratch.cut(entries.join(known.withColumnRenamed("node", "a"), "a", "left").select("print", "a", F.coalesce("component", "a").alias("c")))
    mixed = placed.groupBy("print").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("print", "lo")
    open_ = scratch.cut(placed.join(mixed, "print").select("a", "c", "lo").distinct())
    scratch.free(placed)
    clusters = components(open_.select(F.col("c").alias("a"), F.col("lo").alias("b")).distinct(), scratch)
    members = open_.select("a", "c").distinct().join(clusters.select(F.col("node").alias("c"), F.col("component").alias("cluster")), "c")
    sizes_of = nodes.groupBy("sid").agg(F.first("n").alias("n")).withColumnRenamed("sid", "a")
    members = scratch.cut(members.join(sizes_of, "a"))
    scratch.free(open_)
    sizes = members.groupBy("cluster", "c").agg(F.sum("n").alias("n")).groupBy("cluster").agg(F.sum("n").alias("all"), F.max(F.struct("n", "c")).alias("top"))
    sizes = sizes.select("cluster", F.ceil(F.col("all") / block).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("top.n")) / (4 * block)).cast("int").alias("turns"), F.col("top.c").alias("main"))
    dealt = scratch.cut(members.join(sizes, "cluster").join(texts.withColumnRenamed("sid", "a"), "a"))
    scratch.free(members)
    luck = F.xxhash64("a")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    filed = dealt.select("cluster", F.pmod(luck, F.col("blocks")).cast("int").alias("block"), upto("turns").alias("turn"), "a", "c", "data")
    asking = dealt.filter("c <> main").select("cluster", upto("blocks").alias("block"), F.pmod(luck, F.col("turns")).cast("int").alias("turn"), "a", "c", "data")

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list] = ([], [])
        if left.num_rows and right.num_rows:
            index = Index(sets_of(right.column("data"), size))
            names, c = right.column("a").to_pylist(), right.column("c").to_pylist()
            for x, name, own in zip(sets_of(left.column("data"), size), left.column("a").to_pylist(), left.column("c").to_pylist()):
                both = index.overlaps(x)
                hits = np.flatnonzero(100 * both >= share * (len(x[0]) + index.sizes - both))
                found = {c[h]: names[h] for h in hits if c[h] != own}  # one link to a component is enough
                out[0].extend([name] * len(found))
                out[1].extend(found.values())
        return pa.Table.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], ["a", "b"])

    keys = ["cluster", "block", "turn"]
    links = scratch.cut(asking.groupBy(*keys).cogroup(filed.groupBy(*keys)).applyInArrow(probe, "a binary, b binary"))
    scratch.free(dealt)
    return links


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, size: int = 5, heavy: int = 8, short: int = SHORT) -> DataFrame:
    """Link texts whose sets of ``size``-word shingles have a Jaccard similarity of ``percent``/100 or more.

    Returns ``doc_id, n_shingles long, component_id, set_print binary``, a row for each input row. ``component_id`` is the
    smallest id reachable by links, ``set_print`` names the class of equal sets (null for an empty set).

    * null texts, and texts without words, have an empty set, link with nothing and are their own component.
    * texts of fewer words than ``size`` have one shingle, their whole sequence; very long texts are read whole.
    * repeated rows each give a row; rows with a null id give a row and never name a component unless all its ids are null.
    * an empty table gives no rows; other columns of the input are not read.
    * ``heavy`` and ``short`` steer the work only.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    n_bytes = src.agg(F.sum(F.octet_length("text")).cast("long")).first()[0] or 0
    parts_log2 = min(max(4, (n_bytes // PART_BYTES).bit_length()), 17)
    with batches_of_rows(spark, 2000):
        heavies = spark.sparkContext.broadcast(fixed_map(heavy_places(src.select("text"), parts_log2, heavy, size)))
        rows = scratch.cut(short_lists(src, kind, parts_log2, percent, size, heavies))
    nodes = scratch.cut(rows.filter("part IS NULL").select("doc_id", "sid", "n"))
    found = scratch.cut(candidates(rows.filter("part IS NOT NULL").select("part", "data"), parts_log2, percent, short))
    scratch.free(rows)
    # T-occurrence: what the short lists have counted, over all ranges; pairs with hubs are candidates whatever they count.
    counted = found.filter("b IS NOT NULL").groupBy("a", "b").agg(F.sum(F.coalesce("c", F.lit(0))).alias("c"), F.max("needed").alias("needed"), F.max("n").alias("n"), F.max(F.col("c").isNull()).alias("hub"))
    pairs = scratch.cut(counted.filter("hub OR c >= needed").select("a", "b", "c", "n"))
    entries = scratch.cut(found.filter("b IS NULL").select("print", "a"))
    scratch.free(found)
    sides = [pairs.select(F.col("a").alias("sid")), pairs.select(F.col("b").alias("sid")), entries.select(F.col("a").alias("sid"))]
    texts = texts_of(reduce(DataFrame.union, sides).distinct(), src, nodes, kind, size, scratch)
    links = verified(best_pairs(pairs), texts, percent, size, scratch)
    known = scratch.cut(components(links, scratch))
    more = verified(apart(pairs, known), texts, percent, size, scratch)
    if not entries.isEmpty():  # long lists: components that stand apart still have to meet
        more = more.union(closing_links(entries, known, texts, nodes, percent, size, scratch))
    known = grown(known, more, scratch)
    scratch.free(texts, pairs, entries, links)
    classes = nodes.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    grouped = scratch.cut(classes.join(known.withColumnRenamed("node", "sid"), "sid", "left"))
    roots = grouped.filter("component IS NOT NULL").groupBy("component").agg(F.min("least_id").alias("root"))
    named = grouped.join(roots, "component", "left").select("sid", F.coalesce("root", "least_id").alias("root"), "copies", F.col("component").isNotNull().alias("linked"))
    # Both sides of the join back are read from files, so a hot class's rows are split by the skew join.
    named = scratch.cut(named.filter("linked OR copies > 1").select("sid", "root"))
    scratch.free(grouped, known)
    out = nodes.join(named, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"), F.col("sid").alias("set_print"))


def grown(known: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Components after more links."""
    if links.isEmpty():
        return known
    out = scratch.cut(components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links), scratch))
    scratch.free(known, links)
    return out


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS s FROM w),
c AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM g) WHERE len(s) > 0 GROUP BY s),
e AS (SELECT rep, n, unnest(s) AS t FROM c),
o AS (SELECT x.rep AS a, y.rep AS b, count(*) AS k, any_value(x.n) AS n, any_value(y.n) AS m
      FROM e x JOIN e y ON x.t = y.t AND x.rep < y.rep AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY x.rep, y.rep),
l AS (SELECT a, b FROM o WHERE 100 * k >= 80 * (n + m - k)),
r AS (WITH RECURSIVE reach(a, b) AS (SELECT rep, rep FROM c UNION
      SELECT reach.a, z.b FROM reach JOIN (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) z ON reach.b = z.a)
      SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT g.doc_id, len(g.s)::BIGINT AS n_shingles, coalesce(r.root, g.doc_id) AS component_id
FROM g LEFT JOIN c ON c.s = list_sort(g.s) LEFT JOIN r ON r.a = c.rep
"""
