"""N-gram Jaccard join by grouped prefixes (operator 9).

A text's set holds its distinct runs of `width` lower-cased words; a text of fewer words has its whole
sequence as the one element, a text without words an empty set that links with nothing. Two sets link if
their Jaccard similarity is `percent` / 100 or more.

1. An element that no other set has can't be shared, and a set with a quarter of such elements or more can't
   link. A first pass over all texts counts half of all elements, by hash, and lets such texts go.
2. Equal sets become one. For the rest all elements are counted; a set's elements stand in order of their
   number of sets, then of hash, and its prefix is the shortest that any link must meet.
3. Sets with identical prefixes and size form a group. Groups that meet in a prefix element are candidates.
   First every group is compared with two pivots of the lists it is in, round by round; links join components.
   Then all pairs that still lie in different components and pass the size, position and sketch filters are verified.
   Only pairs that a link could not change are left out, so the components are exact.

Repeated rows are copies of each other. A null text is empty. A null doc_id never becomes a component's id
unless the component has no other. Of equal sets or equal doc_ids none is preferred: only the smallest doc_id names a
component, and of rows with that doc_id `deduplicate` keeps the one of the smallest text hash. A task holds a text
whole, with about 10 bytes of memory for each byte of the longest and 60 for each of its words. `deduplicate` returns extra columns, whatever their
names; `join` ignores them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tessella.llm.stage import dropped, few_rows, written
from tessella.llm.textblock import LOWER, Block, blocks, gathered, mix, spans_hash, window_hash

WIDTH = 5
PERCENT = 75
PIVOT_ROUNDS = 6
PIVOTS = 3
DRAWN = 8
#: 64-bit words of a set's sketch, and of the short one that candidate joins carry; powers of two.
SKETCH = 8
SHORT = 4
#: Pivot rounds end when one links less than this share of the sets.
WORTH = 0.002
SLOTS = 1 << 24
#: Bytes of the texts whose elements a task of the first pass compares at once.
BATCH_BYTES = 12 << 20
#: Elements that one bucket of the first pass holds, about.
BUCKET = 1_000_000


def shingles(block: Block, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Elements of all sets of a block, text by text and in order within, and the bounds of each text's."""
    starts, ends, bounds = block.words()
    words = spans_hash(LOWER[block.data], starts, ends)
    runs = window_hash(words, width)
    counts = np.diff(bounds)
    short = {d: None for d in np.flatnonzero((counts > 0) & (counts < width)).tolist()}
    for k in range(1, width):
        own = window_hash(words, k)
        for d in short:
            if counts[d] == k:
                short[d] = mix(own[bounds[d] : bounds[d] + 1] + np.uint64(k))
    out, sizes = [], np.zeros(len(block), np.int64)
    for d in range(len(block)):
        if counts[d] >= width:
            found = np.unique(runs[bounds[d] : bounds[d + 1] - width + 1])
        elif counts[d]:
            found = short[d]
        else:
            continue
        out.append(found)
        sizes[d] = len(found)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _five(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("_d"), F.xxhash64(text).alias("_t"), text.alias("_text"))


_META = "d array<long>, t array<long>, n array<long>, s1 array<long>, s2 array<long>"


def sets_with_company(keyed: DataFrame, width: int, percent: int) -> DataFrame:
    """_d, _t, n, s1, s2 and `alone` of every text: its set's size, its 128-bit digest, and how many of half of its elements no other set has.

    Elements meet by hash in buckets. An element that occurs twice in a batch of texts goes there once, so
    the most frequent ones don't fill a bucket.
    """
    volume = keyed.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    bits = min(max(4, int(volume / 12 / BUCKET).bit_length()), 20)
    low = np.uint64(63 - bits)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in gathered(batches, 2, BATCH_BYTES):
            found, sizes = [np.zeros(0, np.uint64)], []
            for block in blocks(batch.column(2)):
                elements, bounds = shingles(block, width)
                found.append(elements)
                sizes.append(np.diff(bounds))
            if not sizes:
                continue
            elements, size = np.concatenate(found), np.concatenate(sizes)
            bounds = np.concatenate([[0], np.cumsum(size)])
            s1, s2 = (_sums(mix(elements ^ np.uint64(c)), bounds) for c in (0x243F6A8885A308D3, 0x13198A2E03707344))
            text = np.repeat(np.arange(len(size)), size)
            half = elements >> np.uint64(63) == 0
            elements, text = elements[half], text[half]
            values, place, count = np.unique(elements, return_inverse=True, return_counts=True)
            single = count[place] == 1
            elements, text = elements[single], text[single]
            shared = values[count > 1]
            bucket, shared_bucket = (elements >> low).astype(np.int64), (shared >> low).astype(np.int64)
            turn = np.argsort(bucket, kind="stable")
            elements, text, bucket = elements[turn], text[turn], bucket[turn]
            edge, shared_edge = np.searchsorted(bucket, np.arange((1 << bits) + 1)), np.searchsorted(shared_bucket, np.arange((1 << bits) + 1))
            part = np.uint64((1 << 40) - 1)
            down = np.uint64(max(0, 63 - bits - 40))
            used = np.flatnonzero((np.diff(edge) > 0) | (np.diff(shared_edge) > 0))
            if not len(used):
                used = np.array([0])
            rows = []
            for k, b in enumerate(used.tolist()):
                a, z = edge[b], edge[b + 1]
                mine = k == number % len(used)
                rows.append(
                    {
                        "bucket": b,
                        "batch": number,
                        "single": _five((elements[a:z] >> down) & part),
                        "text": text[a:z].astype(np.uint32).tobytes(),
                        "shared": _five((shared[shared_edge[b] : shared_edge[b + 1]] >> down) & part),
                        "d": batch.column(0).to_pylist() if mine else None,
                        "t": batch.column(1).to_pylist() if mine else None,
                        "n": size.tolist() if mine else None,
                        "s1": s1.view(np.int64).tolist() if mine else None,
                        "s2": s2.view(np.int64).tolist() if mine else None,
                    }
                )
            number += 1
            yield pa.RecordBatch.from_pylist(rows, schema=spread_schema)

    lists = [(c, pa.list_(pa.int64())) for c in ("d", "t", "n", "s1", "s2")]
    spread_schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("single", pa.binary()), ("text", pa.binary()), ("shared", pa.binary()), *lists])
    spreaded = keyed.mapInArrow(spread, f"bucket int, batch long, single binary, text binary, shared binary, {_META}")

    def meet(table: pa.Table) -> pa.Table:
        singles = [_from_five(x) for x in table["single"].to_pylist()]
        announced = [_from_five(x) for x in table["shared"].to_pylist()]
        values, count = np.unique(np.concatenate(singles + announced), return_counts=True)
        common = np.unique(np.concatenate(announced)) if announced else np.zeros(0, np.uint64)
        often = values[count > 1]
        often = np.union1d(often, common)
        alone = []
        for found, raw in zip(singles, table["text"].to_pylist(), strict=True):
            place = np.searchsorted(often, found)
            hit = np.zeros(len(found), bool)
            inside = place < len(often)
            hit[inside] = often[place[inside]] == found[inside]
            text = np.frombuffer(raw, np.uint32)[~hit]
            alone.append(np.bincount(text).astype(np.uint16).tobytes() if len(text) else b"")
        return table.select(["batch", "d", "t", "n", "s1", "s2"]).append_column("alone", pa.array(alone, pa.binary()))

    met = spreaded.groupBy("bucket").applyInArrow(meet, f"batch long, {_META}, alone binary")

    def gather(table: pa.Table) -> pa.Table:
        k = next(i for i, x in enumerate(table["d"]) if x.is_valid)
        meta = {c: table[c][k].values for c in ("d", "t", "n", "s1", "s2")}
        alone = np.zeros(len(meta["n"]), np.int64)
        for raw in table["alone"].to_pylist():
            part = np.frombuffer(raw, np.uint16)
            alone[: len(part)] += part
        return pa.table({"_d": meta["d"], "_t": meta["t"], "n": meta["n"], "s1": meta["s1"], "s2": meta["s2"], "alone": pa.array(alone)})

    return met.groupBy("batch").applyInArrow(gather, "_d long, _t long, n long, s1 long, s2 long, alone long")


def _elements(texts: DataFrame, width: int) -> DataFrame:
    """id, n and the elements of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                elements, bounds = shingles(block, width)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(elements.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[block.first : block.first + len(block)], pa.array(np.diff(bounds)), lists], names=["id", "n", "e"])

    return texts.select("id", "_text").mapInArrow(run, "id long, n long, e array<long>")


def contract(edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """Labels (id, comp), a table, after joining the components that edges (a, b) between components connect, and the number of edges; replaces the table given."""
    mapping = None
    left = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    linked = left.count()
    while not left.isEmpty():
        # Every component goes to its smallest neighbour, and on to that one's.
        near = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b"))
        down = near.select(F.col("a").alias("v"), F.least("a", "b").alias("to"))
        jump = down.alias("x").join(down.alias("y"), F.col("x.to") == F.col("y.v"), "left").select(F.col("x.v").alias("v"), F.coalesce("y.to", "x.to").alias("to"))
        jump = written(jump, "jump")
        a, b = jump.select(F.col("v").alias("a"), F.col("to").alias("_a")), jump.select(F.col("v").alias("b"), F.col("to").alias("_b"))
        moved = left.join(a, "a").join(b, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        left = written(moved.where("a <> b").distinct(), "edges", left)
        if mapping is None:
            mapping = jump
        else:
            both = mapping.alias("m").join(jump.alias("j"), F.col("m.to") == F.col("j.v"), "left").select(F.col("m.v").alias("v"), F.coalesce("j.to", "m.to").alias("to"))
            fresh = jump.join(mapping.select("v"), "v", "left_anti")
            mapping = written(both.unionByName(fresh), "mapping", mapping, jump)
    dropped(left)
    if mapping is None:
        return labels, 0
    moved = labels.join(mapping, labels["comp"] == mapping["v"], "left").select("id", F.coalesce("to", "comp").alias("comp"))
    return written(moved, "labels", labels, mapping), linked


def _parities(words: int) -> list[Column]:
    """The sketch of `e`: parities of its elements by hash. Two sketches differ in no more bits than their sets differ in elements."""
    return [F.expr(f"aggregate(e, 0L, (s, x) -> s ^ if((shiftright(x, 6) & {words - 1}) = {k}, shiftleft(1L, cast(x & 63 as int)), 0L))") for k in range(words)]


def _close(differ: Column, na: str, nb: str, percent: int) -> Column:
    """False for sets that surely don't link: those that do differ in (100 - percent) (na + nb) / (100 + percent) elements at most."""
    return (100 + percent) * differ <= (100 - percent) * (F.col(na) + F.col(nb))


def _side(table: DataFrame, key: str, *names: str) -> DataFrame:
    return table.select(F.col("id").alias(key), *(F.col(n).alias(f"_{n}{key}") for n in names))


def _joined_by_links(pairs: DataFrame, sets: DataFrame, sketches: DataFrame, percent: int, labels: DataFrame) -> tuple[DataFrame, int]:
    """`contract` by those of the pairs (a, b, ca, cb) of sets and their components that link."""
    both = pairs.join(_side(sketches, "a", "n", "own", "sketch"), "a").join(_side(sketches, "b", "n", "own", "sketch"), "b")
    differ = sum((F.bit_count(F.col("_sketcha")[k].bitwiseXOR(F.col("_sketchb")[k])) for k in range(SKETCH)), F.col("_owna") + F.col("_ownb"))
    # Written, so that its size is known before the sets are dealt out to meet it.
    likely = written(both.where(_close(differ, "_na", "_nb", percent)).select("a", "b", "ca", "cb", "_na", "_nb"), "likely")
    both = likely.join(_side(sets, "a", "e"), "a").join(_side(sets, "b", "e"), "b")
    common = F.size(F.array_intersect("_ea", "_eb"))
    links = both.where(100 * common >= percent * (F.col("_na") + F.col("_nb") - common)).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    told = contract(links, labels)
    dropped(likely)
    return told


def _among(rows: DataFrame, key: Column, chosen: DataFrame, chosen_key: Column) -> DataFrame:
    """Rows whose key may be among the chosen ones, by a bitmap of `SLOTS` hashed slots: 2 MB at most, whatever the input, and only a filter before a join."""
    slot = lambda k: F.pmod(F.xxhash64(k, F.lit(11)), F.lit(SLOTS))
    bits = chosen.select(slot(chosen_key).alias("_slot")).groupBy(F.bitmap_bucket_number("_slot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))
    told = rows.withColumn("_slot", slot(key)).join(F.broadcast(bits), F.bitmap_bucket_number("_slot") == F.col("_bucket"))
    at = F.bitmap_bit_position(F.col("_slot"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return told.where(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0).drop("_slot", "_bucket", "_bits")


def components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """_d, _t, n, s1, s2, component_id and comp of every text.

    `comp` tells components apart, which null and shared doc_ids don't: the number of the component, or the digest of
    a set that links with no other; null for texts without words.
    """
    few_rows(docs.sparkSession)
    keyed = _keyed(docs)
    told = written(sets_with_company(keyed, width, percent), "company")
    spare = F.floor((100 - percent) * F.col("n") / 100)
    open_ = told.where((F.col("n") > 0) & (F.col("alone") <= spare))
    reps = open_.groupBy("s1", "s2", "n").agg(F.min(F.struct("_d", "_t")).alias("_m"), F.min("_d").alias("first"))
    # Numbers hold from here on: the table is written once.
    reps = written(reps.select(F.monotonically_increasing_id().alias("id"), "s1", "s2", "n", "first", F.col("_m._d").alias("_d"), F.col("_m._t").alias("_t")), "sets")
    texts = _among(keyed, F.col("_t"), reps, F.col("_t")).alias("k").join(reps.select("id", "_d", "_t").alias("r"), F.col("k._d").eqNullSafe(F.col("r._d")) & (F.col("k._t") == F.col("r._t"))).select("r.id", "k._text")
    full = written(_elements(texts, width).dropDuplicates(["id"]), "elements")

    # Elements that two sets have, in order of how many have them.
    single = full.select("id", F.explode("e").alias("w"))
    often = single.groupBy("w").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    ordered = single.join(often, "w").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("_o"))  # bounded by the text
    ordered = ordered.select("id", F.col("_o.w").alias("e")).join(reps.select("id", "n"), "id")
    need = F.ceil(percent * F.col("n") / 100)
    reach = F.size("e") - need + 1  # of the prefix, what others have too
    sets = written(ordered.withColumn("k", reach.cast("int")).where("k > 0").withColumn("p", F.slice("e", 1, F.col("k"))), "prefixes", full)
    sketches = written(sets.select("id", "n", (F.col("n") - F.size("e")).alias("own"), F.array(*_parities(SKETCH)).alias("sketch"), *(x.alias(f"short{k}") for k, x in enumerate(_parities(SHORT)))), "sketches")

    groups = sets.groupBy("n", "k", F.xxhash64("p").alias("_h"), "p").agg(F.min("id").alias("g")).select("n", "k", "p", "g")
    groups = written(groups, "groups")
    same = (F.col("s.n") == F.col("q.n")) & (F.col("s.k") == F.col("q.k")) & (F.col("s.p") == F.col("q.p"))
    members = written(sets.alias("s").join(groups.alias("q"), same).select("s.id", "q.g", "s.n", "s.k"), "members")
    lists = groups.select("g", "n", "k", F.posexplode("p").alias("pos", "w"))
    shared = lists.groupBy("w").agg(F.count(F.lit(1)).alias("_c"))
    alone = members.groupBy("g").agg(F.count(F.lit(1)).alias("_size"))
    alone = written(alone, "sizes")
    lists = written(lists.join(alone, "g").join(shared, "w").where("_c > 1 or _size > 1").select("w", "g", "n", (F.col("k") - 1 + need - F.col("pos")).alias("left")), "lists", groups)

    labels = written(members.select("id", F.col("id").alias("comp")), "labels")
    many = members.count()
    for r in range(rounds):
        # Several pivots a list. In the first round they are the same for lists of the same groups, and a group is compared
        # with the one of the smallest hash, the same for many groups, and the one that it meets most often. Later rounds,
        # which few groups need, draw other pivots for each list and compare a group with some more of them.
        draw = [F.xxhash64("g", F.lit(k)) if not r else F.xxhash64("g", "w", F.lit(PIVOTS * r + k)) for k in range(PIVOTS)]
        ranked = [F.min(F.struct(h.alias("_r"), "g", "n", "left")).alias(f"_p{k}") for k, h in enumerate(draw)]
        pivot = lists.groupBy("w").agg(*ranked).select("w", F.array_distinct(F.array(*(F.struct(f"_p{k}.g", f"_p{k}.n", f"_p{k}.left") for k in range(PIVOTS)))).alias("_ps"))
        met = lists.join(pivot, "w").select("g", "n", "left", F.explode("_ps").alias("_p")).where("g <> _p.g")
        fits = (100 * F.least("n", "_p.n") >= percent * F.greatest("n", "_p.n")) & ((100 + percent) * F.least("left", "_p.left") >= percent * (F.col("n") + F.col("_p.n")))
        met = met.where(fits).groupBy("g", F.col("_p.g").alias("a")).agg(F.count(F.lit(1)).alias("_c"))
        if r:
            place = labels.select("id", "comp")
            met = met.join(place.toDF("g", "_cg"), "g").join(place.toDF("a", "_ca"), "a").where("_cg <> _ca")
        hashed = F.xxhash64("a", F.lit(r))
        drawn = F.collect_list(F.struct(F.xxhash64("a", "g", F.lit(r)).alias("_h"), "a"))  # bounded by the text
        best = met.groupBy("g").agg(F.min(F.struct(hashed.alias("_h"), "a")).alias("_first"), F.max(F.struct("_c", hashed.alias("_h"), "a")).alias("_most"), F.slice(F.array_sort(drawn), 1, DRAWN if r else 1).alias("_drawn"))
        chosen = F.array("_first.a", "_most.a") if not r else F.concat(F.array("_first.a", "_most.a"), F.col("_drawn.a"))
        met = best.select("g", F.explode(F.array_distinct(chosen)).alias("a"))
        if not r:
            met = met.unionByName(alone.where("_size > 1").select("g", F.col("g").alias("a")))
        told_members = members.join(labels, "id").select("g", F.col("id").alias("b"), F.col("comp").alias("cb"))
        pairs = met.join(told_members, "g").join(labels.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a").where("a <> b and ca <> cb")
        labels, linked = _joined_by_links(pairs.select("a", "b", "ca", "cb"), sets, sketches, percent, labels)
        if linked < WORTH * many:
            break

    # What still lies apart: the smaller components of each list against all of it.
    spread = written(lists.join(members.select("id", "g"), "g").join(labels, "id").select("w", "id", "comp", "n", "left"), "spread", lists, alone, members)
    per_list = spread.groupBy("w", "comp").agg(F.count(F.lit(1)).alias("_c")).groupBy("w").agg(F.max(F.struct("_c", "comp")).alias("_top"), F.count(F.lit(1)).alias("_k")).where("_k > 1")
    apart = spread.join(per_list.select("w", F.col("_top.comp").alias("_major")), "w")
    apart = apart.join(sketches.select("id", "own", *(f"short{k}" for k in range(SHORT))), "id")
    side = lambda key: [F.col(n).alias(f"{n}_{key}") for n in ("id", "comp", "n", "left", "own", *(f"short{k}" for k in range(SHORT)))]
    minor = apart.where("comp <> _major").select("w", *side("a"))
    other = apart.select(F.col("w").alias("_w"), *side("b"), (F.col("comp") == F.col("_major")).alias("_big"))
    near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    # An overlap of o links sets of na and nb if 100 o >= percent (na + nb - o). Where two sets first meet, they can
    # share no more than what stands from there on in either; a pair that fails there fails at every later place.
    room = (100 + percent) * F.least("left_a", "left_b") >= percent * (F.col("n_a") + F.col("n_b"))
    differ = sum((F.bit_count(F.col(f"short{k}_a").bitwiseXOR(F.col(f"short{k}_b"))) for k in range(SHORT)), F.col("own_a") + F.col("own_b"))
    once = F.col("_big") | (F.col("id_a") < F.col("id_b"))
    pairs = minor.join(other, (F.col("w") == F.col("_w")) & (F.col("comp_a") != F.col("comp_b")) & near & room & _close(differ, "n_a", "n_b", percent) & once)
    pairs = pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.col("comp_a").alias("ca"), F.col("comp_b").alias("cb")).distinct()
    labels, _ = _joined_by_links(pairs, sets, sketches, percent, labels)
    dropped(spread, sets, sketches)

    named = reps.join(labels, "id", "left").select("s1", "s2", F.col("n").alias("_n"), "first", F.coalesce("comp", "id").alias("comp"))
    least = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = named.join(least, "comp").select("s1", "s2", F.col("_n").alias("n"), "component_id", F.col("comp").alias("_c"))
    linked = told.where("n > 0").join(named, ["s1", "s2", "n"], "left")
    key = lambda a, b, c: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), c.cast("long").alias("c"))
    comp = F.when(F.col("_c").isNull(), key(F.col("s1"), F.col("s2"), F.col("n"))).otherwise(key(F.col("_c"), F.lit(0), F.lit(-1)))
    own = told.where("n = 0").withColumns({"component_id": F.col("_d"), "comp": F.when(F.lit(False), key(F.col("s1"), F.col("s2"), F.col("n")))})
    return linked.select("_d", "_t", "n", "s1", "s2", F.coalesce("component_id", "_d").alias("component_id"), comp.alias("comp")).unionByName(own.select("_d", "_t", "n", "s1", "s2", "component_id", "comp"))


def deduplicate(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The input's rows without all but the first document, by doc_id and text, of each component."""
    found = components(docs, width, percent)
    first = found.where("n > 0").groupBy("comp").agg(F.min(F.struct("_d", "_t")).alias("_m")).select("_m.*")
    first = written(first.unionByName(found.where("n = 0").select("_d", "_t")).distinct(), "first")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # One struct carries the row, so that no name of a column meets those used here.
    rows = docs.select(F.struct(*(F.col(f"`{name}`") for name in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("_rd"), F.xxhash64(text).alias("_rt"), text.rlike("[^\\x20\\x09-\\x0D]").alias("_worded"))
    kept = rows.join(first, rows["_rd"].eqNullSafe(first["_d"]) & (rows["_rt"] == first["_t"]), "left_semi")
    # Rows without words link with nothing, not even their copies.
    once = kept.where("_worded").dropDuplicates(["_rd", "_rt"])
    return once.unionByName(kept.where("not _worded")).select(*(F.col("_row").getField(name).alias(name) for name in docs.columns))


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id, one row per input row."""
    found = components(docs, width, percent)
    return found.select(F.col("_d").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component_id").cast(docs.schema["doc_id"].dataType).alias("component_id"))
