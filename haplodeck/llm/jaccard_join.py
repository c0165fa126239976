"""Exact Jaccard join of word-shingle sets through a token-group matrix.

Equal sets are one node. Shingles have one order for all (rare ones first, then by hash), and two
sets with a similarity of THRESHOLD or more share a shingle among the first fifth of each. So only
these prefixes are dealt out by shingle; shingles in one node only go no further.

Nodes are partitioned into groups of similar ones: by the most frequent shared shingle of their prefix,
by size band, and by hash where that shingle is frequent. So a shingle of many nodes lies in few groups,
and the join of nodes with the groups of a shingle grows with the nodes. A node asks a group if it shares prefix shingles
with it, and if these are enough for the sizes in the group's band. The group then holds the union of its members'
shingles (its row of the token-group matrix): only if the overlap of query and union reaches what the
smallest possible member needs is the group opened and its members compared. This is done with the first
16 bits of a quarter of the shingles first, the rest counted as common: no link is lost, and few sets
that do not link are left. Only these are sent whole, to the same tasks, and compared exactly. Each
comparison's task returns a spanning forest of its links, not all of them, so dense groups stay linear
in size; the forest has the same components.

Frequent shingles are found by a count sketch of fixed size. It decides the order and how buckets and
groups are split, never which pairs are compared. Shingles, sets and nodes are known by 64-bit hashes.

Null text has an empty set; empty sets link with nothing. Rows without id have a set but no component.
Repeated rows each get their result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplodeck.llm.arrow_text import mixed, shingle_sets
from haplodeck.llm.components import component_labels
from haplodeck.llm.tables import written

WORDS = 5
#: Similarity in hundredths; link if 100 * intersection >= THRESHOLD * union.
THRESHOLD = 80
CELLS = 1 << 20
#: Buckets of a shingle are split so that about so many nodes share one; groups hold four times that.
BUCKET = 64
QUERIES_PER_TASK = 2000
TOGETHER = 3000
BROADCAST_IDS = 500_000
ROWS_AT_ONCE = 500
#: A size band ends at 1.1 times its start.
_BAND = 1.1


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in small batches, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens.view(np.uint64) >> np.uint64(44)).astype(np.int64)


def _node(tokens: np.ndarray) -> int:
    """Hash of a sorted set; 0 for the empty one."""
    if not len(tokens):
        return 0
    place = np.arange(len(tokens), dtype=np.uint64)
    total = (mixed(tokens.view(np.uint64) ^ mixed(place))).sum(dtype=np.uint64, keepdims=True)
    return int(mixed(total ^ np.uint64(len(tokens))).view(np.int64)[0]) or 1


def prefix_length(n: int) -> int:
    return n - -(-THRESHOLD * n // 100) + 1


def _sets_and_sketch(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, np.ndarray]:
    """(key, node, n) per row, and the level of every sketch cell: log2 of its shingles over BUCKET.
    One pass; a task reports the cells that stand out in it."""
    kind = docs.schema[key].dataType.simpleString()
    out = ["row", "key", "node", "n", "cell", "hits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, id_type = np.zeros(CELLS, np.int64), None
        for batch in _slices(batches):
            ids, id_type = batch.column(0), batch.column(0).type
            nodes, sizes = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            cells = [np.zeros(0, np.int64)]
            for row, tokens in shingle_sets(batch.column(1), WORDS):
                nodes[row], sizes[row] = _node(tokens), len(tokens)
                cells.append(_cells(tokens))
            np.add.at(hits, np.concatenate(cells), 1)
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(ids), bool)), ids, pa.array(nodes), pa.array(sizes), none, none], out)
        usual = hits.sum() / CELLS
        loud = np.flatnonzero(hits >= usual + 4 * np.sqrt(usual) + 4)
        if len(loud):
            none = pa.nulls(len(loud), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(loud), bool)), pa.nulls(len(loud), id_type), none, none,
                 pa.array(loud), pa.array(hits[loud])], out)

    both = written(docs.select(F.col(key), F.col(text)).mapInArrow(
        run, f"row boolean, key {kind}, node long, n long, cell long, hits long"), "jaccard-sets")
    loud = both.where("not row").groupBy("cell").agg(F.sum("hits").alias("hits")).where(
        F.col("hits") >= BUCKET).select("cell", F.floor(F.log2(F.col("hits") / BUCKET)).cast("int").alias("level"))
    levels = np.zeros(CELLS, np.uint8)  # at most CELLS rows come back, whatever the input
    for cell, level in loud.where("level > 0").toLocalIterator():
        levels[cell] = level
    return both.where("row").select(F.col("key").alias(key), "node", "n"), levels


def _prefixes(docs: DataFrame, text: str, levels) -> DataFrame:
    """token, node, n, level of every node's prefix; a task reports a node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, done = levels.value, set()
        for batch in _slices(batches):
            columns = [], [], [], []
            for _, tokens in shingle_sets(batch.column(0), WORDS):
                node, n = _node(tokens), len(tokens)
                if not n or node in done:
                    continue
                done.add(node)
                heights = level[_cells(tokens)]
                if heights.any():
                    order = np.lexsort((tokens, heights))[:prefix_length(n)]
                    tokens, heights = tokens[order], heights[order]
                else:
                    tokens, heights = tokens[:prefix_length(n)], heights[:prefix_length(n)]
                columns[0].append(tokens)
                columns[1].append(np.full(len(tokens), node, np.int64))
                columns[2].append(np.full(len(tokens), n, np.int32))
                columns[3].append(heights.astype(np.int32))
            if columns[0]:
                table = [pa.array(np.concatenate(c)) for c in columns]
                yield pa.RecordBatch.from_arrays(table, ["token", "node", "n", "level"])

    return docs.select(F.col(text)).mapInArrow(run, "token long, node long, n int, level int")


def _band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(_BAND)) + 1e-9).cast("int")


def _candidates(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, own) of every node with a shared shingle and its group, and (node, own, grp) for every
    group it has to ask: its own or one of a higher number."""
    # frequent shingles are shared; of the others, those of one node only end here
    rare = prefixes.where("level = 0").select("token", "node", "n")
    by_token = Window.partitionBy("token")
    shared = rare.withColumns({
        "_low": F.min("node").over(by_token), "_high": F.max("node").over(by_token),
        "often": F.count("*").over(by_token)}).where("_low <> _high").select("token", "node", "n", "often")
    frequent = (BUCKET * F.pow(F.lit(2.0), F.col("level"))).cast("long").alias("often")
    shared = shared.unionByName(prefixes.where("level > 0").select("token", "node", "n", frequent))
    shared = shared.repartition("node").dropDuplicates(["node", "token"])
    first = F.min(F.struct((-F.col("often")).alias("seldom"), "token")).over(Window.partitionBy("node"))
    parts = F.greatest(F.floor(-F.col("_f.seldom") / (4 * BUCKET)), F.lit(1))
    placed = written(shared.withColumn("_f", first).select(
        "token", "node", "n", F.xxhash64(
            F.col("_f.token"), _band(F.col("n")),
            F.pmod(F.xxhash64("node"), parts)).alias("own")), "jaccard-buckets")
    index = placed.groupBy("token", "own").agg(
        F.count("*").alias("members"), F.min("n").alias("low"), F.max("n").alias("high")).withColumnRenamed(
            "own", "grp")
    asked = placed.join(index, "token").where(
        (F.col("grp") > F.col("own")) | ((F.col("grp") == F.col("own")) & (F.col("members") > 1)))
    q, t = F.col("n"), THRESHOLD
    per = asked.groupBy("node", "n", "grp").agg(
        F.count("*").alias("shared"), F.min("low").alias("low"), F.max("high").alias("high"))
    # sizes that can be similar to the query and are in the group's shared buckets
    low = F.greatest(F.col("low"), F.ceil(q * t / 100))
    high = F.least(F.col("high"), F.floor(q * 100 / t))
    # overlap needed, less what can lie behind the prefix whose last shingle comes first
    by_query = F.ceil((q + low) * t / (100 + t)) - F.ceil(q * t / 100) + 1
    by_member = F.ceil((q + high) * t / (100 + t)) - F.ceil(high * t / 100)
    enough = per.where((low <= high) & (F.col("shared") >= F.least(by_query, by_member)))
    homes = placed.select("node", "own").distinct()
    return homes, written(enough.select("node", "grp").join(homes, "node").select(
        "node", "own", "grp"), "jaccard-candidates")


def _needed(a, b):
    """Least overlap of sets of sizes a and b with the similarity: t / (100 + t) of their sum."""
    return -(-THRESHOLD * (a + b) // (100 + THRESHOLD))


def _index(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of all sets, and for each of them a slice of the numbers of the sets it is in."""
    union, posting = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[np.argsort(posting, kind="stable")]
    return union, np.concatenate([[0], np.cumsum(np.bincount(posting, minlength=len(union)))]), owner


def _overlaps(index, tokens: np.ndarray, n: int) -> np.ndarray:
    """Overlap of the tokens with each of the n indexed sets."""
    union, starts, owner = index
    at = np.searchsorted(union, tokens)
    inside = at < len(union)
    at = at[inside]
    at = at[union[at] == tokens[inside]]
    if not len(at):
        return np.zeros(n, np.int64)
    return np.bincount(np.concatenate([owner[starts[j]:starts[j + 1]] for j in at]), minlength=n)


def starts(tokens: np.ndarray) -> np.ndarray:
    """The first 16 bits of a quarter of the shingles: those whose last two bits are 0. Sets have no more
    shingles in common than starts, and what the smaller has of the rest."""
    return (tokens[tokens & 3 == 0] >> 48).astype(np.int16)


def _pairs(rows: list[tuple[bool, int, int, int, np.ndarray]], exact: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows it links with) within one task's groups. rows: (whether a guest, group, node, size,
    tokens); guests belong to groups that are not here and ask all that are. Not exact: tokens are as
    `starts` gives them, what they leave out counts as common, and the rows may link but need not."""
    groups: dict[int, dict[int, int]] = {}
    for i, (guest, own, node, _, _) in enumerate(rows):
        if not guest:
            groups.setdefault(own, {})[node] = i
    if not groups:
        return
    names = sorted(groups)
    members = [np.array(list(groups[g].values())) for g in names]
    sizes = [np.array([rows[i][3] for i in m]) for m in members]
    out = [np.array([rows[i][3] - len(rows[i][4]) for i in m]) for m in members]
    inside = [_index([rows[i][4] if exact else np.unique(rows[i][4]) for i in m]) for m in members]
    matrix = inside[0] if len(names) == 1 else _index([i[0] for i in inside])  # tokens by groups
    smallest = np.array([s.min() for s in sizes])
    for i, (guest, own, _, n, tokens) in enumerate(rows):
        left_out = n - len(tokens)
        if len(names) == 1:
            bound = np.array([np.isin(tokens, inside[0][0], assume_unique=exact).sum()])
        else:
            bound = _overlaps(matrix, tokens, len(names))
        asked = bound + left_out >= _needed(n, np.maximum(smallest, -(-THRESHOLD * n // 100)))
        for g in np.flatnonzero(asked):
            if not guest and names[g] < own:
                continue  # compared from the other side
            overlap = _overlaps(inside[g], tokens, len(members[g])) + np.minimum(left_out, out[g])
            yield i, members[g][overlap * (100 + THRESHOLD) >= THRESHOLD * (n + sizes[g])]


def _open(rows: list[tuple[bool, int, int, int, np.ndarray]]) -> tuple[list[int], list[int]]:
    """Links of one task's groups as a spanning forest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    left, right = [], []
    for i, found in _pairs(rows, True):
        for j in found:
            x, y = root(rows[i][2]), root(rows[j][2])
            if x != y:
                parent[max(x, y)] = min(x, y)
                left.append(rows[i][2])
                right.append(rows[j][2])
    return left, right


def _may_link(rows: list[tuple[bool, int, int, int, np.ndarray]]) -> np.ndarray:
    """Whether each row has another that it may link with."""
    some = np.zeros(len(rows), bool)
    for i, found in _pairs(rows, False):
        others = found[np.array([rows[j][2] != rows[i][2] for j in found], bool)]
        if len(others):
            some[i] = True
            some[others] = True
    return some


def _compared(rows: DataFrame, exact: bool = True) -> DataFrame:
    """a, b: links found; or, if not exact, node and dests (array of dest, chunk, guest, own) of the rows
    that may have one. rows has dest, chunk (a task's groups come together), guest, own, node, n, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close():
            if exact:
                left, right = _open(held)
                return pa.RecordBatch.from_arrays(
                    [pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
            kept = [h[:3] for h, may in zip(held, _may_link(held), strict=True) if may]
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]] * len(kept), pa.int64()), pa.array([now[1]] * len(kept), pa.int32()),
                 pa.array([k[0] for k in kept], pa.bool_()), pa.array([k[1] for k in kept], pa.int64()),
                 pa.array([k[2] for k in kept], pa.int64())], ["dest", "chunk", "guest", "own", "node"])

        for batch in batches:
            dest, chunk = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            guest = batch.column(2).to_numpy(zero_copy_only=False)
            own, node, n = (batch.column(c).to_numpy() for c in (3, 4, 5))
            bounds, values = batch.column(6).offsets.to_numpy(), batch.column(6).values.to_numpy()
            for i in range(batch.num_rows):
                here = (int(dest[i]), int(chunk[i]))
                if here != now and held:
                    yield close()
                    held = []
                now = here
                held.append((bool(guest[i]), int(own[i]), int(node[i]), int(n[i]),
                             values[bounds[i]:bounds[i + 1]].copy()))
        if held:
            yield close()

    out = "a long, b long" if exact else "dest long, chunk int, guest boolean, own long, node long"
    # starts are much work in few bytes: adaptive execution would join their partitions by their bytes
    parts = [] if exact else [int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))]
    found = rows.repartition(*parts, "dest", "chunk").sortWithinPartitions("dest", "chunk").select(
        "dest", "chunk", "guest", "own", "node", "n", "tokens").mapInArrow(run, out)
    return found if exact else found.groupBy("node").agg(
        F.collect_list(F.struct("dest", "chunk", "guest", "own")).alias("dests"))


def _destinations(homes: DataFrame, asks: DataFrame) -> DataFrame:
    """node, dests (array of dest, chunk, guest, own). Groups that ask each other, directly or through
    others, meet in one task and every node goes there once; where they hold more than TOGETHER nodes,
    each group is a task (or several) of its own, and nodes go to every group they ask."""
    between = asks.where("own <> grp").select(F.col("own").alias("a"), F.col("grp").alias("b")).distinct()
    labels = component_labels(between)
    # two nodes of one group can only be linked if both ask it, so of a group that no other asks, the askers go
    asked = between.select(F.col("b").alias("own")).distinct()
    sent = asks.select("node", "own").unionByName(homes.join(asked, "own", "left_semi")).distinct()
    placed = sent.join(labels.withColumnRenamed("node", "own"), "own", "left").withColumn(
        "dest", F.coalesce("label", "own"))
    sizes = placed.groupBy("dest").agg(F.count("*").alias("together"))
    at = written(placed.select("node", "own", "dest").join(sizes, "dest"), "jaccard-placed")
    whole = at.where(F.col("together") <= TOGETHER).select(
        "node", "dest", F.lit(0).alias("chunk"), F.lit(False).alias("guest"), "own")
    apart = at.where(F.col("together") > TOGETHER).select("node", "own")
    guests = asks.where("own <> grp").join(apart, ["node", "own"])
    chunks_ = guests.groupBy("grp").agg(F.ceil(F.count("*") / QUERIES_PER_TASK).cast("int").alias("chunks"))
    members = apart.join(chunks_, apart["own"] == chunks_["grp"], "left").select(
        "node", F.col("own").alias("dest"), F.explode(F.sequence(
            F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("chunk"), F.lit(False).alias("guest"), "own")
    visiting = guests.join(chunks_, "grp").select(
        "node", F.col("grp").alias("dest"), F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"),
        F.lit(True).alias("guest"), "own")
    return whole.unionByName(members).unionByName(visiting).groupBy("node").agg(
        F.collect_list(F.struct("dest", "chunk", "guest", "own")).alias("dests"))


def _sent(docs: DataFrame, key: str, text: str, ids: DataFrame, exact: bool = True) -> DataFrame:
    """dest, chunk, guest, own, node, n, tokens: every node's set, from its document of lowest id, for
    each of its destinations; only its `starts` if not exact. The ids choose the texts
    inside the scan while they are few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    ids = ids.select(key, "dests")
    texts = docs.select(F.col(key), F.col(text)).join(F.broadcast(ids) if few else ids, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            found = [(row, tokens) for row, tokens in shingle_sets(part.column(0), WORDS) if len(tokens)]
            if not found:
                continue
            sent = [t if exact else starts(t) for _, t in found]
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum([len(t) for t in sent])]), pa.int32()),
                pa.array(np.concatenate(sent)))
            yield pa.RecordBatch.from_arrays(
                [part.column(1).take(pa.array([row for row, _ in found])),
                 pa.array([_node(t) for _, t in found], pa.int64()),
                 pa.array([len(t) for _, t in found], pa.int32()), lists], ["dests", "node", "n", "tokens"])

    kind = "long" if exact else "short"
    sent = texts.select(text, "dests").mapInArrow(
        run, "dests array<struct<dest:long,chunk:int,guest:boolean,own:long>>, node long, n int, "
        f"tokens array<{kind}>")
    return sent.select(F.explode("dests").alias("_d"), "node", "n", "tokens").select("_d.*", "node", "n", "tokens")


def links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, node, n) per row, and (a, b): a spanning forest of the links between nodes."""
    sets, levels = _sets_and_sketch(docs, key, text)
    homes, asks = _candidates(_prefixes(docs, text, docs.sparkSession.sparkContext.broadcast(levels)))
    ids = written(sets.join(_destinations(homes, asks), "node").groupBy("node").agg(
        F.min(key).alias(key), F.first("dests").alias("dests")), "jaccard-ids")
    near = _compared(_sent(docs, key, text, ids, exact=False), exact=False)
    near = written(near.join(ids.select("node", key), "node"), "jaccard-near")
    return sets, written(_compared(_sent(docs, key, text, near)), "jaccard-links")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable by links) of every row."""
    sets, found = links(docs, key, text)
    labels = component_labels(found)
    named = sets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    low = named.where((F.col("n") > 0) & F.col(key).isNotNull()).groupBy("label").agg(
        F.min(key).alias("_low"))
    return named.join(low, "label", "left").select(
        key, F.col("n").alias("n_shingles"), F.when(F.col(key).isNull(), F.lit(None)).when(
            F.col("n") == 0, F.col(key)).otherwise(F.col("_low")).alias("component_id"))


def one_per_component(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, without those of a component that has one of lower id. Rows that
    share the kept id all stay, and so do rows without id."""
    kept = components(docs, key, text).where(F.col(key) == F.col("component_id")).select(key).distinct()
    few = kept.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    named = docs.where(F.col(key).isNotNull()).join(F.broadcast(kept) if few else kept, key, "left_semi")
    return named.unionByName(docs.where(F.col(key).isNull())).select(*[F.col(f"`{c}`") for c in docs.columns])
