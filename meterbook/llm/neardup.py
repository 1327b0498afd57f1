"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's set is its distinct five-word shingles. Each of the forest's orders
sorts the documents by their signature, starting at another lane. Documents that
share a prefix of ``DEPTH`` lanes in an order form a region. In it, each document is
compared with its neighbours of longest common prefix, so that a dense region costs
as many comparisons as it has documents, however deep they agree. Regions whose
documents did not all end in one component are then completed: whatever is outside
the region's largest component is compared with everything in the region. Small
regions do so pair by pair, a sketch of the signatures ruling out most. Large ones
that share documents form a zone, which is cut into blocks; two blocks at a time are
compared in a task, and only links between components leave it. Two documents are
thus compared, or already in one component, whenever they share a region: at
similarity 0.75, one pair in four million shares none.

Links are confirmed on the full sets. Texts with equal sets are one node throughout.

Defined cases: a null or wordless text has an empty set and is linked with nothing.
Rows sharing a doc_id are one document, which has the links of all of them. A row
without a doc_id is linked with nothing, has no component and is kept.
"""

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, free_name, map_rows, prepare, staged, unstage
from .graph import components

WORDS = 5
NUMERATOR, DENOMINATOR = 75, 100
ORDERS, DEPTH = 40, 4
#: Lanes by which a region is sorted beyond the prefix, each cut to 16 bits.
BEYOND = 8
LANES = ORDERS * DEPTH
#: Regions over so many documents are completed in blocks of so many.
LARGE, BLOCK = 64, 256
#: Signatures of similar texts agree in 120 of 160 lanes, give or take 5.5; their
#: two-bit sketches differ in 30, give or take 5. Both bounds are six deviations off.
LEAST_EQUAL, MOST_DIFFERENT = 87, 60
SKETCH = [f"s{i}" for i in range(LANES // 32)]
#: Word hashes a worker keeps, of words up to so many bytes.
_CACHE, _CACHED_WORD = 120_000, 64
_CHUNK = 2048

_random = np.random.default_rng(20)
_A = (_random.integers(0, 1 << 63, LANES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _random.integers(0, 1 << 63, LANES, dtype=np.uint64)
_W = (_random.integers(0, 1 << 63, WORDS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
#: Row o: the lanes of order o, prefix first.
_LANE = (np.arange(ORDERS)[:, None] * DEPTH + np.arange(DEPTH + BEYOND)[None, :]) % LANES


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= _CACHED_WORD:
            if len(self) >= _CACHE:
                self.clear()
            self[word] = value
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the set of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        if 0 < len(h) < WORDS:
            return _mix(np.array([(h * _W[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64))
        if not len(h):
            return h
        n = len(h) - WORDS + 1
        total = np.zeros(n, np.uint64)
        for i in range(WORDS):
            total += h[i : i + n] * _W[i]
        return np.unique(_mix(total))


def signature(found: np.ndarray) -> np.ndarray:
    """The smallest value of every lane's hash over the set, 32 bits each."""
    best = np.full(LANES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), _CHUNK):
            lanes = (found[at : at + _CHUNK, None] * _A + _B) >> np.uint64(32)
            best = np.minimum(best, lanes.min(axis=0).astype(np.uint32))
    return best


def sketch(lanes: np.ndarray) -> list[int]:
    """Two bits of every lane, 32 lanes to a number."""
    bits = (lanes & np.uint32(3)).astype(np.uint64).reshape(-1, 32)
    return (bits << np.arange(0, 64, 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


def _differing(a: list[Column], b: list[Column]) -> Column:
    """In how many lanes two sketches differ."""
    mixed = [x.bitwiseXOR(y) for x, y in zip(a, b, strict=True)]
    each = [F.bit_count(m.bitwiseOR(F.shiftrightunsigned(m, 1)).bitwiseAND(F.lit(0x5555555555555555))) for m in mixed]
    return reduce(lambda x, y: x + y, each)


def _print_of(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _prints(rows: Iterator[tuple]) -> Iterator[tuple]:
    hashes = _WordHashes()
    for doc_id, text in rows:
        found = shingles(text, hashes)
        if not len(found):
            yield doc_id, 0, None, None, *[None] * len(SKETCH)
            continue
        lanes = signature(found)
        yield doc_id, len(found), _print_of(found), lanes.tobytes(), *sketch(lanes)


def _places(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Where each document stands in every order: region, then the lanes beyond."""
    for rep, lanes in rows:
        values = np.frombuffer(lanes, np.uint32)[_LANE]
        short = (values[:, DEPTH:] & np.uint32(0xFFFF)).astype(np.uint64).reshape(ORDERS, BEYOND // 4, 4)
        beyond = (short << np.array([48, 32, 16, 0], np.uint64)).sum(axis=2, dtype=np.uint64).view(np.int64)
        for order in range(ORDERS):
            region = xxhash.xxh64_intdigest(values[order, :DEPTH].tobytes(), seed=order) - (1 << 63)
            yield region, int(beyond[order, 0]), int(beyond[order, 1]), rep


def _walk(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Neighbours in sorted order, members of regions of three and more, and ends.

    Rows (kind, region, a, b): kind 0 a pair, 1 a member a, 2 the first and 3 the last
    row of the partition, whose region may go on in the next one.
    """
    region = opening = previous = None
    waiting: list[int] = []
    size, first = 0, True
    for now, _, _, rep in rows:
        if now != region:
            if not first and size <= 2 and region == opening:  # may go on before this partition
                yield from ((1, region, x, None) for x in waiting)
            if first:
                yield 2, now, rep, None
                first, opening = False, now
            region, size, waiting = now, 0, []
        else:
            yield 0, region, min(previous, rep), max(previous, rep)
        size += 1
        if size < 3:
            waiting.append(rep)
        else:
            if size == 3:
                yield from ((1, region, x, None) for x in waiting)
            yield 1, region, rep, None
        previous = rep
    if not first:
        if size <= 2:
            yield from ((1, region, x, None) for x in waiting)
        yield 3, region, previous, None


def _sets(rows: Iterator[tuple]) -> Iterator[tuple]:
    hashes = _WordHashes()
    for rep, text, wanted in rows:
        found = shingles(text, hashes)
        if len(found) and _print_of(found) == wanted:
            yield rep, found.view(np.int64).tolist()


def _sets_of(asked: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rep, shingles) of the asked nodes, staged."""
    wanted = asked.join(nodes.select("rep", "print"), "rep")
    texts = columns(docs, doc_id="long", text="string").join(wanted, F.col("doc_id") == F.col("rep"))
    return staged(map_rows(texts.select("rep", "text", "print"), _sets, "rep long, shingles array<long>"), "sets")


def _confirm(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b), those similar enough by their full sets."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), docs, nodes)
    a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa") + F.size("sb") - both
    similar = pairs.join(a, "a").join(b, "b").filter(DENOMINATOR * both >= NUMERATOR * union)
    links = staged(similar.select("a", "b").distinct(), "links")
    unstage(sets)
    return links


def _may_link(a: str, b: str) -> Column:
    """Set sizes and sketches of two nodes, given by column prefix, do not rule a link out."""
    least, most = F.least(f"{a}n", f"{b}n"), F.greatest(f"{a}n", f"{b}n")
    differing = _differing([F.col(a + s) for s in SKETCH], [F.col(b + s) for s in SKETCH])
    return (DENOMINATOR * least >= NUMERATOR * most) & (differing <= MOST_DIFFERENT)


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs that sizes and sketches do not rule out."""
    facts = ["n", *SKETCH]
    side = lambda p: nodes.select(F.col("rep").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in facts))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_may_link("a_", "b_")).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept; a row per row."""
    spark = prepare(docs.sparkSession)
    rows = columns(docs, doc_id="long", text="string")
    schema = "doc_id long, n long, print binary, lanes binary, " + ", ".join(f"{s} long" for s in SKETCH)
    prints = staged(map_rows(rows, _prints, schema), "prints")
    linked = prints.filter("doc_id IS NOT NULL AND print IS NOT NULL")
    facts = [F.first(c).alias(c) for c in ("n", "lanes", *SKETCH)]
    nodes = linked.groupBy("print").agg(F.min("doc_id").alias("rep"), *facts)
    nodes = staged(nodes, "nodes")

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = map_rows(nodes.select("rep", "lanes"), _places, "region long, x long, y long, rep long")
    sorted_places = places.repartitionByRange(n, "region", "x", "y", "rep").sortWithinPartitions("region", "x", "y", "rep")
    walked = map_rows(sorted_places, _walk, "kind int, region long, a long, b long")
    walked = staged(walked.withColumn("part", F.spark_partition_id()), "forest")

    ends = walked.filter("kind >= 2").orderBy("part", "kind").collect()  # two rows a partition
    seams = [
        (min(x.a, y.a), max(x.a, y.a))
        for x, y in zip(ends[1::2], ends[2::2], strict=False)
        if x.region == y.region and x.a != y.a
    ]
    pairs = walked.filter("kind = 0").select("a", "b").union(spark.createDataFrame(seams, "a long, b long"))
    links = _confirm(_possible(pairs.filter("a < b").distinct(), nodes), docs, nodes)

    same_id = linked.select("doc_id", "print").distinct().groupBy("doc_id").count().filter("count > 1").select("doc_id")
    repeated = linked.select("doc_id", "print").join(same_id, "doc_id").join(nodes.select("print", "rep"), "print")
    repeated = repeated.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    known = links.select("a", "b").union(repeated)

    found = staged(components(known), "components")
    mixed = _mixed(walked.filter("kind = 1").select("region", F.col("a").alias("rep")), found)
    more = staged(_small_regions(mixed, nodes), "rest")
    late = [] if more.isEmpty() else [_confirm(more, docs, nodes)]
    if not mixed.filter(F.col("size") > LARGE).isEmpty():
        late.append(_large_regions(mixed.filter(F.col("size") > LARGE), docs, nodes))
    if late:
        known = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
        found = staged(components(reduce(DataFrame.union, late, known)), "components")

    of_print = staged(
        nodes.select("print", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left")
        .select("print", F.coalesce("component", "rep").alias("component")),
        "labels",
    )
    for done in (nodes, walked, links, found, more, mixed, *late):
        unstage(done)
    named = prints.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("print")).alias("print"))
    alone = named.filter("print IS NULL").withColumn("component", F.col("doc_id"))
    grouped = named.filter("print IS NOT NULL").join(of_print, "print")
    return (
        grouped.select("doc_id", "n", "component").union(alone.select("doc_id", "n", "component"))
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.col("component").alias("component_id"),
            F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"),
        )
    )


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """(region, rep, component, main, size) of the regions of several components, staged."""
    placed = members.distinct().join(found.withColumnRenamed("id", "rep"), "rep", "left")
    placed = placed.select("region", "rep", F.coalesce("component", "rep").alias("component"))
    sizes = placed.groupBy("region", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("region").agg(
        F.max_by("component", "size").alias("main"), F.count("*").alias("kinds"), F.sum("size").alias("size")
    )
    return staged(placed.join(main.filter("kinds > 1").drop("kinds"), "region"), "regions")


def _small_regions(mixed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Possible pairs of whatever is outside a region's largest component."""
    facts = nodes.select("rep", "n", *SKETCH)
    rows = mixed.filter(F.col("size") <= LARGE).join(facts, "rep")
    side = lambda p: rows.select("region", *(F.col(c).alias(f"{p}_{c}") for c in ("rep", "component", "main", "n", *SKETCH)))
    few = side("x").filter("x_component <> x_main")
    once = (F.col("y_component") == F.col("y_main")) | (F.col("x_rep") < F.col("y_rep"))
    met = few.join(side("y").withColumnRenamed("region", "region_"), (
        (F.col("region") == F.col("region_")) & (F.col("x_component") != F.col("y_component")) & once & _may_link("x_", "y_")
    ))
    return met.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()


def _link_blocks(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Links between components among the nodes of one or two blocks.

    Pairs of most equal signatures first; what is linked by then is not compared.
    """
    reps, minor = rows["rep"].to_numpy(), rows["minor"].to_numpy()
    sets = [np.asarray(x, np.int64) for x in rows["shingles"]]
    n = np.array([len(x) for x in sets], np.int64)
    lanes = np.frombuffer(b"".join(rows["lanes"]), np.uint32).reshape(-1, LANES)
    root = {c: c for c in rows["component"]}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    component = rows["component"].to_numpy()
    found = []
    for u in np.flatnonzero(minor):
        equal = (lanes == lanes[u]).sum(axis=1)
        sized = DENOMINATOR * np.minimum(n, n[u]) >= NUMERATOR * np.maximum(n, n[u])
        near = np.flatnonzero((equal >= LEAST_EQUAL) & sized & (component != component[u]))
        found += [(-int(equal[v]), int(u), int(v)) for v in near if not (minor[v] and v < u)]
    links = []
    for _, u, v in sorted(found):
        a, b = find(component[u]), find(component[v])
        if a == b:
            continue
        both = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
        if DENOMINATOR * both >= NUMERATOR * (n[u] + n[v] - both):
            root[max(a, b)] = min(a, b)
            links.append((int(min(reps[u], reps[v])), int(max(reps[u], reps[v]))))
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def _large_regions(mixed: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between components inside zones: large regions that share documents.

    A zone's nodes outside its largest component meet each other and the rest, a
    block against a block. A task holds two blocks, whatever the size of the zone.
    """
    first = mixed.groupBy("region").agg(F.min("rep").alias("b"))
    zones = components(mixed.select("region", F.col("rep").alias("a")).join(first, "region").select("a", "b"))
    rows = zones.select(F.col("id").alias("rep"), F.col("component").alias("zone"))
    rows = staged(rows.join(mixed.select("rep", "component").distinct(), "rep"), "zones")
    sizes = rows.groupBy("zone", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("zone").agg(F.max_by("component", "n").alias("main"), F.max("n").alias("mains"), F.sum("n").alias("all"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    main = main.select("zone", "main", blocks(F.col("mains")).alias("mains"), blocks(F.col("all") - F.col("mains")).alias("minors"))
    placed = rows.join(main, "zone").withColumn("minor", F.col("component") != F.col("main"))
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("mains"))).cast("int")
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ids = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    with_minor = F.transform(ids("minors"), lambda i: pair(F.least(i, F.col("own")), F.greatest(i, F.col("own"))))
    with_main = F.transform(ids("mains"), lambda i: pair(F.col("own"), -1 - i))  # main blocks count downwards from -1
    of_main = F.transform(ids("minors"), lambda i: pair(i, -1 - F.col("own")))
    meets = F.when(F.col("minor"), F.concat(with_minor, with_main)).otherwise(of_main)
    sets = _sets_of(rows.select("rep"), docs, nodes)
    full = placed.withColumn("own", own).join(sets, "rep").join(nodes.select("rep", "lanes"), "rep")
    dealt = full.select("zone", "rep", "component", "minor", "lanes", "shingles", F.explode(meets).alias("to"))
    dealt = dealt.select("zone", "to.x", "to.y", "rep", "component", "minor", "lanes", "shingles")
    links = staged(dealt.groupBy("zone", "x", "y").applyInPandas(_link_blocks, "a long, b long"), "links")
    for done in (rows, sets):
        unstage(done)
    return links


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents, all columns, less all but one of each group."""
    name = free_name(docs, "gone")
    gone = near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("`doc_id`").cast("long") == F.col(name), "left_anti")
