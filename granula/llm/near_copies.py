"""n-gram Jaccard join: documents whose sets of word shingles overlap by ``percent`` or more, as components.

Identical sets are one node, so exact copies cost nothing beyond one grouped minimum. Two
linked nodes share one of their rarest ranks: with all shingles in one order (by hash), the first
n - ceil(t n) + 1 of either must have one in common. These leading shingles, a quarter of all, decide
only *where* nodes meet; chunks ask hash buckets which of theirs occur elsewhere. Where nodes meet, an R-tree over
count vectors bounds the overlap of pairs and exact intersections decide.

* Rounds: nodes meet at their first, then second repeated shingle, with their sets. Pairs already
  connected are skipped at every tree node, so a group of thousands of near copies costs
  about one check each. Large groups are dealt into parts, anew in each round.
* Rest: wherever a shingle still brings different components together, their count vectors meet
  (by class of size, large groups as blocks against blocks), the tree yields the pairs
  whose bound suffices, and only those are joined with their sets and checked. This step
  alone is exact for all pairs; the rounds only make it cheap.

Defined cases: null, empty and blank texts have an empty set, link with nothing and are their
own component; with fewer words than a shingle the whole sequence is the one shingle; repeated
rows and equal texts are one component; ids may repeat (the component is the smallest id, null
only where all are null); columns named like the results are replaced; sets of very long texts are whole;
an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granula.operators.components import connected_components
from granula.session import WorkTables

from . import cells
from .base import fresh, keep, partitions, query, table
from .hashes import joined, runs, word_hashes
from .rtree import Forest, RTree, count_vector, enough, fold, group_count, unpacked

SHINGLE, PERCENT = 5, 75
CHUNK = 8_000_000
PART = 4_096
ROUNDS = 2
SMALL = 32
SLICE = 25_000
RESULTS = ["n_shingles", "component_id"]
EDGES = "u long, v long"
NODES = "chunk long, name string, n int, vector binary, tokens array<long>, places array<int>"
SETS = "node long, set binary"


def shingle_sets(texts: list, k: int = SHINGLE) -> list[np.ndarray]:
    """Per text its distinct shingle hashes, sorted."""
    h, counts = word_hashes(texts, lower=True)
    every = runs(h, k)
    ends = np.cumsum(counts)
    out = []
    for a, e in zip(ends - counts, ends):
        n = e - a
        if n >= k:
            out.append(np.unique(every[a:e - k + 1]))
        else:
            out.append(joined(runs(h[a:e], int(n)), np.full(1, n, np.uint64)) if n else np.empty(0, np.uint64))
    return out


def node_of(s: np.ndarray) -> str | None:
    return xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None


def leading(s: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of which a partner must share one."""
    return s[:len(s) + 1 + (-len(s) * percent // 100)]  # n - ceil(n t) + 1


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def size_class(n):
    """Sizes whose ratio is 3/4 or more lie in the same or in neighbouring classes (for 75 percent)."""
    return F.log(n.cast("double")) / float(np.log(4 / 3))


def groups_of(table: pa.Table, by: list[str]) -> Iterator[np.ndarray]:
    """Rows of each group of two rows or more."""
    keys = [table[c].to_numpy() for c in by]
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    starts = np.flatnonzero(new)
    for a, e in zip(starts, [*starts[1:], len(order)]):
        if e - a > 1:
            yield order[a:e]


def in_buckets(rows: DataFrame, by: list[str]) -> DataFrame:
    """Many groups share a call: groups keyed by ``by`` are hashed into buckets."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*by), F.lit(4 * partitions(rows.sparkSession)))).groupBy("bucket")


def edge_table(found: list[tuple[int, int]]) -> pa.Table:
    u, v = zip(*found) if found else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def linked(names: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning links of the nodes that meet in one place."""
    sizes = np.array([len(s) for s in sets], np.int64)
    forest, found = Forest(len(names)), []

    def check(i: int, j: int) -> None:
        if forest.find(i) != forest.find(j) and enough(overlap(sets[i], sets[j]), sizes[i] + sizes[j], percent):
            forest.join(forest.find(i), forest.find(j))
            found.append((names[i], names[j]))

    if len(names) <= 4:
        for i in range(len(names)):
            for j in range(i):
                if enough(min(sizes[i], sizes[j]), sizes[i] + sizes[j], percent):
                    check(i, j)
    else:
        groups = min(4_096, 2 * group_count(int(sizes.min())))
        points = np.array([np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups) for s in sets], np.int32)
        for i, j in RTree(points, sizes).pairs(percent, forest.labels):
            for x, y in zip(i.tolist(), j.tolist()):
                check(x, y)
    return found


def meetings(nodes: DataFrame, number: int, percent: int, part: int) -> DataFrame:
    """Nodes of one size class that meet at their ``number``-th repeated shingle, where count vectors leave them a possible partner."""
    by = ["token", "class"]
    own = nodes.filter(F.size("tokens") > number).select(F.col("tokens")[number].alias("token"), F.floor(size_class(F.col("n"))).alias("class"), "node", "chunk", "n", "vector")
    several = own.groupBy(*by).agg(F.count("*").alias("count")).filter("count > 1")
    several = keep(several.select(*by, F.ceil(F.col("count") / part).alias("parts")))
    met = own.join(several, by).withColumn("part", F.pmod(F.xxhash64("node", F.lit(number)), F.col("parts"))).drop("parts")

    def run(bucket: pa.Table) -> pa.Table:
        raw = [unpacked(x.as_buffer()) for x in bucket["vector"]]
        n, some = bucket["n"].to_numpy().astype(np.int64), np.zeros(len(raw), bool)
        for rows in groups_of(bucket, [*by, "part"]):
            if len(rows) <= SMALL:
                i, j = (rows[x] for x in np.triu_indices(len(rows), 1))
                good = enough(bounds(raw, i, j), n[i] + n[j], percent)
                some[i[good]] = some[j[good]] = True
            else:
                least = min(len(raw[k]) for k in rows)
                each = np.arange(len(rows))
                for i, j in RTree(np.array([fold(raw[k], least) for k in rows]), n[rows]).pairs(percent, lambda: each):
                    some[rows[i]] = some[rows[j]] = True
        return bucket.select([*by, "part", "node", "chunk"]).filter(pa.array(some))

    return keep(in_buckets(met, [*by, "part"]).applyInArrow(run, "token long, class long, part long, node long, chunk long"))


def round_links(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the nodes that meet, by their sets."""
    by = ["token", "class", "part"]

    def run(bucket: pa.Table) -> pa.Table:
        names, column, found = bucket["node"].to_pylist(), bucket["set"], []
        for rows in groups_of(bucket, by):
            found += linked([names[i] for i in rows], [np.frombuffer(column[int(i)].as_buffer(), "<u8") for i in rows], percent)
        return edge_table(found)

    return in_buckets(met.join(sets, "node").select(*by, "node", "set"), by).applyInArrow(run, EDGES)


def bounds(raw: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Most that the sets of i and j can share, pair by pair, at the coarser of their two grids."""
    groups = np.array([len(r) for r in raw])
    out, common = np.zeros(len(i), np.int64), np.minimum(groups[i], groups[j])
    for g in np.unique(common).tolist():
        own = np.flatnonzero(common == g)
        step = max(64, 4_000_000 // g)
        for a in range(0, len(own), step):
            part = own[a:a + step]
            used, at = np.unique(np.concatenate([i[part], j[part]]), return_inverse=True)
            m = np.array([fold(raw[k], g) for k in used])
            out[part] = np.minimum(m[at[:len(part)]], m[at[len(part):]]).sum(1)
    return out


def trimmed(placed: DataFrame, by: list[str], percent: int) -> DataFrame:
    """Drop postings that no partner at their place can make up for.

    Where a shingle is the first that two sets share, they share at most what either has left
    from there on; so that must do for a partner as small as the smallest there. Places keep
    different components and a node at home; of two nodes alone the pair itself is tested.
    """
    places = placed.groupBy(*by).agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("count"), F.count_if(F.col("home") == F.col("class")).alias("own"),
                                     F.min("n").alias("least"), F.min("rest").alias("left"), F.sum("n").alias("total"))
    open_ = (F.col("count") > 2) | enough(F.col("left"), F.col("total"), percent)
    places = keep(places.filter((F.col("a") != F.col("b")) & (F.col("own") > 0) & open_).select(*by, "least"))
    return placed.join(places, by).filter(enough(F.col("rest"), F.col("n") + F.col("least"), percent)).drop("least")


def rest_pairs(nodes: DataFrame, components: DataFrame, percent: int, part: int) -> DataFrame:
    """Pairs of different components that share a leading shingle and whose bound suffices."""
    by = ["token", "class"]
    x = size_class(F.col("n"))
    postings = nodes.select("node", "n", F.explode(F.arrays_zip("tokens", "places")).alias("t")).select("node", "n", F.col("t.tokens").alias("token"), (F.col("n") - F.col("t.places")).alias("rest")).join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = keep(postings.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("token"))
    placed = keep(postings.join(mixed, "token").distinct().withColumn("home", F.floor(x)).withColumn("class", F.explode(F.sequence(F.floor(x), F.floor(x + (1 + 1e-9))))))
    for _ in range(2):
        placed = keep(trimmed(placed, by, percent))
    met = placed.groupBy(*by).agg(F.count("*").alias("count")).filter("count > 1")
    met = keep(met.select(*by, F.ceil(F.col("count") / part).alias("parts")))
    blocks = placed.join(met, by).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    blocks = blocks.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("other", "parts")
    # a class lies in as few buckets as its postings allow: its vectors travel once or twice, its pairs are found once
    # and no bucket gets much more than its share
    postings = keep(placed.groupBy("class").agg(F.count("*").alias("count")))
    share = 2 * (postings.agg(F.sum("count")).first()[0] or 0) // partitions(nodes.sparkSession)
    slices = postings.select("class", F.ceil(F.col("count") / max(SLICE, share)).alias("slices"))
    place = F.pmod(F.xxhash64("class", F.pmod(F.xxhash64("token"), F.col("slices")), "low", "high"), F.lit(partitions(nodes.sparkSession)))
    blocks = keep(blocks.join(slices, "class").withColumn("bucket", place).drop("slices"))
    # in a bucket every node has one vector, however many of its shingles lie there
    needed = blocks.select("bucket", F.col("node").alias("id")).distinct().join(nodes.select(F.col("node").alias("id"), "vector"), "id").select(F.col("bucket").alias("place"), "id", "vector")

    def run(postings: pa.Table, points: pa.Table) -> pa.Table:
        names = points["id"].to_numpy()
        by_name = np.argsort(names)
        raw = [unpacked(x.as_buffer()) for x in points["vector"]]
        at = by_name[np.searchsorted(names, postings["node"].to_numpy(), sorter=by_name)]
        n, label = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        n[at] = postings["n"].to_numpy()
        label[at] = postings["component"].to_numpy()
        home = postings["home"].to_numpy() == postings["class"].to_numpy()
        rest = postings["rest"].to_numpy().astype(np.int64)  # shingles from this one on: where it is the first shared one, no more can be shared
        block, across = postings["part"].to_numpy(), postings["low"].to_numpy() != postings["high"].to_numpy()
        found = [np.empty((0, 2), np.int64)]

        def add(i: np.ndarray, j: np.ndarray) -> None:
            """Keep pairs of postings that may link: enough left to share from here on, of two components, one at home, of two blocks where blocks meet."""
            a, b = at[i], at[j]
            good = (label[a] != label[b]) & (home[i] | home[j]) & ((block[i] != block[j]) | ~across[i]) & enough(np.minimum(rest[i], rest[j]), n[a] + n[b], percent)
            found.append(np.unique(np.stack([np.minimum(a, b)[good], np.maximum(a, b)[good]], 1), axis=0))

        i_s, j_s, held = [], [], 0
        for rows in groups_of(postings, [*by, "low", "high"]):
            if len(rows) <= SMALL:
                i, j = np.triu_indices(len(rows), 1)
                i_s.append(rows[i])
                j_s.append(rows[j])
                held += len(i)
                if held > 1_000_000:
                    add(np.concatenate(i_s), np.concatenate(j_s))
                    i_s, j_s, held = [], [], 0
            else:
                own = [raw[k] for k in at[rows]]
                least = min(map(len, own))
                labels = label[at[rows]]
                for i, j in RTree(np.array([fold(r, least) for r in own]), n[at[rows]]).pairs(percent, lambda: labels):
                    add(rows[i], rows[j])
        if i_s:
            add(np.concatenate(i_s), np.concatenate(j_s))
        pairs = np.unique(np.concatenate(found), axis=0)
        i, j = pairs[:, 0], pairs[:, 1]
        good = enough(bounds(raw, i, j), n[i] + n[j], percent)
        return pa.table({"u": np.minimum(names[i[good]], names[j[good]]), "v": np.maximum(names[i[good]], names[j[good]])})

    return blocks.groupBy("bucket").cogroup(needed.groupBy("place")).applyInArrow(run, EDGES).distinct()


def gathered(pairs: DataFrame, components: DataFrame, part: int) -> DataFrame:
    """Give each pair a ``bucket`` so that pairs around one component lie together and a set is sent there once.

    A node leans on the largest component among its own and its partners'; a pair goes to the
    larger of both choices. Where more than ``part`` nodes would meet, parts meet parts.
    """
    size = components.groupBy("component").agg(F.count("*").alias("size"))
    known = keep(components.join(size, "component").select("node", F.struct("size", "component").alias("own")))

    def told(df: DataFrame, column: str, name: str) -> DataFrame:
        own = known.select(F.col("node").alias(column), F.col("own").alias(name))
        alone = F.struct(F.lit(1).cast("long").alias("size"), F.col(column).alias("component"))
        return df.join(own, column, "left").withColumn(name, F.coalesce(name, alone))

    both = keep(told(told(pairs, "u", "cu"), "v", "cv").withColumn("most", F.greatest("cu", "cv")))
    lean = both.select(F.explode(F.array("u", "v")).alias("node"), "most").groupBy("node").agg(F.max("most").alias("lean"))
    lean = keep(lean)
    keyed = both.join(lean.select(F.col("node").alias("u"), F.col("lean").alias("lu")), "u").join(lean.select(F.col("node").alias("v"), F.col("lean").alias("lv")), "v")
    keyed = keep(keyed.select("u", "v", F.greatest("lu", "lv")["component"].alias("key"), F.col("cu.component").alias("cu"), F.col("cv.component").alias("cv")))
    parts = keep(keyed.groupBy("key").agg(F.ceil(F.count_distinct("u") / part).alias("parts")))
    place = F.xxhash64("key", F.pmod(F.xxhash64("u"), F.col("parts")), F.pmod(F.xxhash64("v"), F.col("parts")))
    return keyed.join(parts, "key").select("u", "v", "cu", "cv", F.pmod(place, F.lit(4 * partitions(pairs.sparkSession))).alias("bucket"))


def checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the pairs, by exact intersection; pairs that are connected by then are passed over."""
    needed = pairs.select(F.explode(F.array("u", "v")).alias("node"), "bucket").distinct().join(sets, "node").select(F.col("bucket").alias("place"), "node", "set")

    def run(asked: pa.Table, given: pa.Table) -> pa.Table:
        column = given["set"]
        at = {x: i for i, x in enumerate(given["node"].to_pylist())}
        known = {x: i for i, x in enumerate({*asked["cu"].to_pylist(), *asked["cv"].to_pylist()})}
        forest, found = Forest(len(known)), []
        for u, v, cu, cv in zip(*(asked[c].to_pylist() for c in ("u", "v", "cu", "cv"))):
            i, j = forest.find(known[cu]), forest.find(known[cv])
            if i != j:
                x, y = (np.frombuffer(column[at[w]].as_buffer(), "<u8") for w in (u, v))
                if enough(overlap(x, y), len(x) + len(y), percent):
                    forest.join(i, j)
                    found.append((u, v))
        return edge_table(found)

    return pairs.groupBy("bucket").cogroup(needed.groupBy("place")).applyInArrow(run, EDGES)


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None, percent: int = PERCENT, part: int = PART, rounds: int = ROUNDS, first: str | None = None) -> DataFrame:
    """``docs`` with ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    ``first`` adds a boolean column that is true for exactly one row of each component, the one with the smallest id
    (of rows with equal ids, or only null ids, the first of the lowest chunk), and for rows without words.
    """
    if percent < 75:
        raise ValueError("size classes hold for 75 percent or more")
    buckets = partitions(docs.sparkSession)
    carry = [c for c in (docs.columns if carry is None else carry) if c not in RESULTS]
    name = fresh("node", docs)
    docs = docs.select(*dict.fromkeys([*carry, key, text]))

    def ask(rows: pa.Table):
        sets = shingle_sets(rows[text].to_pylist())
        names = [node_of(s) for s in sets]
        own = {x: leading(s, percent) for x, s in zip(names, sets) if x}
        every = np.concatenate(list(own.values())) if own else np.empty(0, np.uint64)
        kept = rows.append_column("n_shingles", pa.array([len(s) for s in sets], pa.int64())).append_column(name, pa.array(names, pa.string()))
        return kept, cells.ask_hashes(every, buckets)[1]

    def open_nodes(rows: pa.Table, got: list[dict[int, bytes]], number: int) -> pa.Table:
        first = {x: i for i, x in reversed(list(enumerate(rows[name].to_pylist()))) if x}
        sets = dict(zip(first, shingle_sets([rows[text][i].as_py() for i in first.values()])))
        own = {x: leading(s, percent) for x, s in sets.items()}
        keys = np.unique(np.concatenate(list(own.values()))) if own else np.empty(0, np.uint64)
        bits = cells.read_bits(keys, got[0], buckets)
        places = {x: np.flatnonzero(bits[np.searchsorted(keys, t)]) for x, t in own.items()}
        use = [x for x, at in places.items() if len(at)]
        points = [count_vector(sets[x], group_count(len(sets[x]))) for x in use]
        return pa.table({"chunk": pa.array([number] * len(use), pa.int64()), "name": pa.array(use, pa.string()), "n": pa.array([len(sets[x]) for x in use], pa.int32()), "vector": pa.array(points, pa.binary()),
                         "tokens": pa.array([own[x][places[x]].astype(np.int64) for x in use], pa.list_(pa.int64())), "places": pa.array([places[x] for x in use], pa.list_(pa.int32()))})

    slim_schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("row", T.IntegerType()), T.StructField("key", docs.schema[key].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("name", T.StringType())])

    def rows_of(batches):
        """What decisions need of each row; the documents stay where they are."""
        for batch in batches:
            for number, data in zip(batch.column("chunk").to_pylist(), batch.column("data")):
                rows = cells.from_stream(data.as_buffer()).select([key, "n_shingles", name]).combine_chunks()
                own = [pa.array(np.full(rows.num_rows, number, np.int64)), pa.array(np.arange(rows.num_rows, dtype=np.int32)), *rows.columns]
                yield from pa.Table.from_arrays(own, names=slim_schema.fieldNames()).to_batches()

    stored, asked = cells.split(docs, ask, CHUNK)

    def sets_of(wanted: DataFrame) -> DataFrame:
        """Sets of some nodes, computed again where their chunk lies."""
        each = F.concat_ws("=", "name", "node")
        names = F.encode(F.array_join(F.array_sort(F.collect_set(each)), ","), "UTF-8")  # no more than the chunk holds
        lists = wanted.select("node").distinct().join(nodes.select("node", "chunk", "name"), "node").groupBy("chunk").agg(names.alias("data")).select("chunk", F.lit(0).alias("bucket"), "data", F.lit(1).alias("kind"))

        def finish(rows: pa.Table, got: list[dict[int, bytes]], _number: int) -> pa.Table:
            names = dict(x.split("=") for x in got[0][0].decode().split(",")) if got[0] else {}
            first = {x: i for i, x in reversed(list(enumerate(rows[name].to_pylist()))) if x in names}
            sets = shingle_sets([rows[text][i].as_py() for i in first.values()])
            return pa.table({"node": pa.array([int(names[x]) for x in first], pa.int64()), "set": pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())})

        return keep(cells.meet(stored, [lists], finish, SETS))

    with WorkTables() as work:
        nodes = keep(cells.meet(stored, [cells.answer(asked, cells.repeated, 1)], open_nodes, NODES).dropDuplicates(["name"]).withColumn("node", F.monotonically_increasing_id()))
        edges = docs.sparkSession.createDataFrame([], EDGES)
        met = [meetings(nodes, number, percent, part) for number in range(rounds)]
        if met:
            sets = sets_of(reduce(DataFrame.unionByName, met))
            edges = reduce(DataFrame.unionByName, [keep(round_links(m, sets, percent)) for m in met])
        components = keep(connected_components(edges))
        pairs = keep(rest_pairs(nodes, components, percent, part))
        ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        edges = edges.unionByName(keep(checked(keep(gathered(pairs, components, part)), sets_of(ends), percent)))
        components = keep(connected_components(edges).join(nodes.select("node", "name"), "node").select("name", F.col("component").cast("string").alias("component")))
        slim = stored.mapInArrow(rows_of, slim_schema)
        labelled = keep(slim.join(components, "name", "left").withColumn("label", F.coalesce("component", "name")).select(*slim_schema.fieldNames()[:4], "label"))
        order = F.struct(F.isnull("key").alias("unnamed"), "key", "chunk", "row")
        least = keep(labelled.filter("label IS NOT NULL").groupBy("label").agg(F.min(order).alias("least")))
        alone = F.col("label").isNull()
        told = keep(labelled.join(least, "label", "left").select(
            F.col("chunk").alias("home"), "row", "key", "n_shingles", F.when(alone, F.col("key")).otherwise(F.col("least.key")).alias("component_id"),
            (alone | ((F.col("least.chunk") == F.col("chunk")) & (F.col("least.row") == F.col("row")))).alias("first")))
        work.drop(told)

    if set(carry) <= {key}:
        return told.select(*([F.col("key").alias(key)] if carry else []), "n_shingles", "component_id", *([F.col("first").alias(first)] if first else []))
    results = ["component_id", *([first] if first else [])]
    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField("n_shingles", T.LongType()), T.StructField("component_id", docs.schema[key].dataType), *([T.StructField(first, T.BooleanType())] if first else [])])

    def finish(mine: pa.Table, decided: pa.Table) -> pa.Table:
        rows = cells.from_stream(mine["data"][0].as_buffer()).select([*carry, "n_shingles"])
        decided = decided.sort_by("row")  # one for each row
        for column in results:
            rows = rows.append_column(column, decided["first" if column == first else column])
        return rows

    return stored.groupBy("chunk").cogroup(told.groupBy("home")).applyInArrow(finish, schema)


SQL_OP8 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS k FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
o AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM s a JOIN s b ON a.k = b.k AND a.r <> b.r GROUP BY a.r, b.r),
l AS MATERIALIZED (SELECT o.a, o.b FROM o JOIN n x ON o.a = x.r JOIN n y ON o.b = y.r WHERE 100 * o.o >= 75 * (x.n + y.n - o.o)),
c AS (SELECT r, r AS other FROM d UNION SELECT c.r, l.b FROM c JOIN l ON c.other = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(e.doc_id) AS component_id FROM d JOIN c ON d.r = c.r JOIN d e ON c.other = e.r LEFT JOIN n ON d.r = n.r GROUP BY d.r, d.doc_id
"""


@query("op8_jaccard_join", SQL_OP8)
def op8(spark, sf_dir):
    return near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
