"""Near duplicates among embeddings: a small-world graph per shard, searched by every vector of the label."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from winnow.llm import hnsw
from winnow.llm.components import components
from winnow.sources.scratch import cut_lineage

MIN_COSINE = 0.93
#: Vectors of a graph: so many at least, and this many times the root of those of the label, as far as a worker holds them.
#: A group of as many queries searches a graph, a block of them at a time.
SHARD_ROWS = 8192
SHARD_GROWTH = 26
MOST_SHARD_ROWS = 1 << 18
QUERY_ROWS = 4096
#: Bytes of a graph in one row.
PART_BYTES = 8 << 20
BEAM = 64
#: Queries of a block that are compared with the whole shard, as many made-up ones near its vectors, and the share of
#: those with links that must find all of them.
AUDITS = 64
RECALL = 0.995
BATCH = 512
_SLACK = 1e-4  # of 32-bit similarities, which are then verified in double precision


def classes(rows: DataFrame) -> DataFrame:
    """Distinct vectors of each label: ``cid, label, dim, n, vector``; equal vectors are one class of ``n``."""
    return rows.where("cid IS NOT NULL").groupBy("cid", "label").agg(
        F.count("*").alias("n"), F.any_value("embedding").alias("vector")
    ).withColumn("dim", F.size("vector"))


def _rows(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, embedding, cid``; the class is null for vectors that link with nothing."""
    picked = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    return picked.withColumn("cid", F.when(usable, F.xxhash64("label", "embedding")))


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of equal length, scaled to length one without overflow."""
    flat = column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _draws(cids: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each class, the same on every machine."""
    mixed = cids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _build(table: pa.Table) -> pa.Table:
    """The graph of a shard, in rows of bounded size."""
    table = table.sort_by("cid")
    cids, unit = table["cid"].to_numpy(), _unit(table["vector"])
    graph, order = hnsw.build(unit, _draws(cids))
    held = pickle.dumps((unit[order], [x.astype(np.int32) for x in graph.layers], cids[order], table["n"].to_numpy()[order]))
    parts = [held[i : i + PART_BYTES] for i in range(0, len(held), PART_BYTES)]
    names = {k: table[k].take(pa.array([0] * len(parts))) for k in ("label", "dim", "shard")}
    return pa.table(names | {"part": pa.array(range(len(parts)), pa.int32()), "graph": pa.array(parts, pa.binary())})


def _labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest labels over the links between ``a`` and ``b``, added to what is known."""
    while True:
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            return label
        # hook the roots of both ends, then shorten all paths
        for ends in (a, b):
            np.minimum.at(label, label[ends], low)
            np.minimum.at(label, ends, low)
        while True:
            shorter = label[label]
            if (shorter == label).all():
                break
            label = shorter


def _audits(queries: np.ndarray, exact: np.ndarray, own: np.ndarray, min_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Queries that tell whether a beam is wide enough, and the node that each of them is itself.

    Some are drawn from the block, by the rank of their vectors' first component so that dense and thin places are both met; as many are
    made up: nodes turned by an angle that keeps them within the threshold. So there is always one with a link.
    """
    rank = np.argsort(queries[:, 0], kind="stable")
    drawn = np.unique(rank[np.linspace(0, len(rank) - 1, min(AUDITS, len(rank))).astype(int)])
    rng = np.random.default_rng(len(exact))
    base = exact[rng.integers(0, len(exact), AUDITS)]
    aside = rng.normal(size=base.shape)
    aside -= (aside * base).sum(axis=1, keepdims=True) * base
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-300)
    near = rng.uniform(min_cosine, 1, (len(base), 1))
    made = near * base + np.sqrt(1 - near * near) * aside
    made = np.where(np.abs(made).max(axis=1, keepdims=True) > 0, made, base)
    made /= np.linalg.norm(made, axis=1, keepdims=True)
    return np.concatenate((queries[drawn], made)), np.concatenate((own[drawn], np.full(len(made), -1)))


def _wide_enough(graph: hnsw.Graph, exact: np.ndarray, audits: np.ndarray, own: np.ndarray, true: np.ndarray, beam: int, min_cosine: float) -> bool:
    """Whether enough of the audited queries that have links find every one of them; a query's own node is none."""
    found = np.zeros(len(audits), np.int64)
    for _, nodes, query in _found(graph, audits.astype(np.float32), audits, exact, np.arange(len(audits)), beam, min_cosine):
        found += np.bincount(query[nodes != own[query]], minlength=len(audits))
    linked = true > 0
    return bool((found[linked] >= true[linked]).mean() >= RECALL) if linked.any() else False


def search_shard(graph: hnsw.Graph, queries: np.ndarray, exact: np.ndarray, own: np.ndarray, min_cosine: float):
    """Yields, for batches of queries, their numbers, the nodes they link to, and each node's query.

    ``own`` is the node of the query itself in this shard, -1 if it lies in another. Beams double while
    they are full of links, and for all queries until the audited ones find their links, each for itself;
    a beam as wide as the shard compares everything.
    """
    n = len(graph.vectors)
    single = queries.astype(np.float32)
    beam = BEAM
    if beam < n:
        audits, node = _audits(queries, exact, own, min_cosine)
        close = audits @ exact.T >= min_cosine
        held = node >= 0
        true = close.sum(axis=1) - (held & close[np.arange(len(audits)), np.maximum(node, 0)])
        while beam < n and not _wide_enough(graph, exact, audits, node, true, beam, min_cosine):
            beam *= 2
    for at in range(0, len(queries), BATCH):
        part = np.arange(at, min(at + BATCH, len(queries)))
        for numbers, nodes, query in _found(graph, single, queries, exact, part, beam, min_cosine):
            other = nodes != own[query]
            yield numbers, nodes[other], query[other]


def _found(graph, single, queries, exact, part, beam, min_cosine):
    """Links of some queries; those whose beam is full of links are searched again with a wider one."""
    n = len(graph.vectors)
    while len(part):
        if beam >= n:
            for at in range(0, len(part), 128):
                rows = part[at : at + 128]
                i, nodes = np.nonzero(queries[rows] @ exact.T >= min_cosine)
                yield rows, nodes, rows[i]
            return
        ids, sims = graph.search(single[part], beam)
        full = sims[:, -1] >= min_cosine - _SLACK
        i, k = np.nonzero((sims >= min_cosine - _SLACK) & ~full[:, None] & (ids >= 0))
        nodes, rows = ids[i, k], part[i]
        good = np.einsum("ij,ij->i", queries[rows], exact[nodes]) >= min_cosine
        yield part[~full], nodes[good], rows[good]
        part, beam = part[full], 2 * beam


class _Search:
    """What the queries of a group find in a shard: their links, and which classes hang together by them."""

    def __init__(self, graph: bytes, min_cosine: float):
        self.exact, layers, self.cids, self.sizes = pickle.loads(graph)
        self.graph = hnsw.Graph(self.exact.astype(np.float32), [x.astype(np.int64) for x in layers])
        self.order, self.min_cosine = np.argsort(self.cids), min_cosine
        self.names, self.label = self.cids, np.arange(len(self.cids))

    def block(self, asked: np.ndarray, unit: np.ndarray) -> pa.RecordBatch | None:
        """``a, n`` of the queries of a block that have links; what hangs together is kept."""
        at = np.minimum(np.searchsorted(self.cids[self.order], asked), len(self.cids) - 1)
        own = np.where(self.cids[self.order][at] == asked, self.order[at], -1)
        place = np.where(own >= 0, own, len(self.names) + np.arange(len(asked)))
        label = np.concatenate((self.label, len(self.names) + np.arange(len(asked))))
        links = np.zeros(len(asked), np.int64)
        for _, nodes, query in search_shard(self.graph, unit, self.exact, own, self.min_cosine):
            links += np.bincount(query, self.sizes[nodes], minlength=len(asked)).astype(np.int64)
            label = _labels(label, nodes, place[query])
        self.names, self.label = np.concatenate((self.names, asked)), label
        linked = np.flatnonzero(links)
        return _edges(asked[linked], None, links[linked]) if len(linked) else None

    def forest(self) -> pa.RecordBatch | None:
        """``a, b``: each class that hangs together with another one, and the first of them."""
        moved = np.flatnonzero(self.names != self.names[self.label])
        return _edges(self.names[moved], self.names[self.label[moved]], None) if len(moved) else None


def _edges(a: np.ndarray, b: np.ndarray | None, n: np.ndarray | None) -> pa.RecordBatch:
    columns = [a, np.zeros(len(a), np.int64) if n is None else n]
    other = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(columns[0]), other, pa.array(columns[1])], ["a", "b", "n"])


def _search_sorted(batches: Iterator[pa.RecordBatch], min_cosine: float, query_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and group, in each the parts of the graph before the queries: a graph is held once, a block at a time.

    Yields ``a, b, n``: the links ``n`` of each query ``a`` into the shard (``b`` null), and edges that join linked classes.
    """
    key, search, parts, asked, vectors = None, None, [], [], []

    def flush(all_of_group: bool) -> Iterator[pa.RecordBatch]:
        nonlocal search, asked, vectors
        if asked:
            if search is None:
                search = _Search(b"".join(parts), min_cosine)
            found = search.block(np.concatenate(asked), np.concatenate(vectors))
            asked, vectors = [], []
            if found:
                yield found
        if all_of_group and search is not None:
            found = search.forest()
            if found:
                yield found

    for batch in batches:
        if not batch.num_rows:
            continue
        names = [batch.column(c) for c in ("label", "dim", "shard", "group")]
        keys = list(zip(*(c.to_pylist() for c in names)))
        kinds = batch.column("part").to_numpy(zero_copy_only=False)  # of a graph, or the number after all parts
        start = 0
        while start < batch.num_rows:
            stop = start + 1
            while stop < batch.num_rows and keys[stop] == keys[start] and stop - start < query_rows:
                stop += 1
            if keys[start] != key:
                yield from flush(True)
                key, search, parts = keys[start], None, []
            piece = batch.slice(start, stop - start)
            is_part = kinds[start:stop] < _QUERY
            parts += [x for x in piece.column("graph").to_pylist() if x is not None]
            own = piece.filter(pa.array(~is_part))
            if own.num_rows:
                asked.append(own.column("cid").to_numpy())
                vectors.append(_unit(pa.chunked_array([own.column("vector")])))
                if sum(map(len, asked)) >= query_rows:
                    yield from flush(False)
            start = stop
    yield from flush(True)


#: Sorts queries behind all parts of their graph.
_QUERY = 1 << 30


def shards(rows: Column, least: int = SHARD_ROWS, growth: float = SHARD_GROWTH) -> Column:
    """How many graphs the classes of a label are dealt over."""
    size = F.greatest(F.least(F.ceil(F.sqrt(rows) * growth), F.lit(MOST_SHARD_ROWS)), F.lit(least))
    return F.ceil(rows / size).cast("int")


def embedding_groups(
    vectors: DataFrame,
    min_cosine: float = MIN_COSINE,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
    growth: float = SHARD_GROWTH,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector.

    Vectors of one label (and length) link if their cosine in double precision is at least
    ``min_cosine``. Equal vectors are one class, so copies are never compared. The classes of a label are
    dealt over shards, each with a small-world graph, and every class searches every shard of its label. Shards grow with the
    root of the label (from ``shard_rows`` on), so a vector is sent to as many. A graph is sent to each group of
    queries, which searches it ``query_rows`` at a time. ``n_links`` counts vectors, copies included; a component is named by its
    smallest vec_id, which is kept.

    Vectors without label or vec_id, empty, zero, or with null or non-finite components link with
    nothing and are their own component; without vec_id it is null and the vector kept. Rows that share
    a vec_id are vectors of their own. Vectors of any length are compared whole. An empty table gives an empty result; other columns are ignored.
    """
    rows = cut_lineage(_rows(vectors), "vectors")
    found = cut_lineage(classes(rows), "classes")
    sizes = found.groupBy("label", "dim").agg(F.count("*").alias("rows")).select(
        "label", "dim", shards(F.col("rows"), shard_rows, growth).alias("shards")
    )
    placed = found.join(sizes, ["label", "dim"])
    kind = dict(found.dtypes)["label"]
    index = cut_lineage(
        placed.select("label", "dim", F.pmod(F.xxhash64("cid"), F.col("shards")).cast("int").alias("shard"), "cid", "n", "vector")
        .groupBy("label", "dim", "shard")
        .applyInArrow(_build, f"label {kind}, dim int, shard int, part int, graph binary"),
        "graphs",
    )
    key = ["label", "dim", "shard", "group"]
    each = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    queries = placed.withColumn("shard", each).select(
        "label", "dim", "shard",
        F.pmod(F.xxhash64("cid", F.lit(1)), F.col("shards")).cast("int").alias("group"),
        F.lit(_QUERY).alias("part"), "cid", "vector", F.lit(None).cast("binary").alias("graph"),
    )
    graphs = index.join(sizes, ["label", "dim"]).withColumn("group", each).select(
        *key, "part", F.lit(None).cast("long").alias("cid"), F.lit(None).cast("array<double>").alias("vector"), "graph"
    )
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by work, not by bytes
    dealt = queries.unionByName(graphs).repartition(tasks, *key).sortWithinPartitions(*key, "part", "cid")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _search_sorted(batches, min_cosine, query_rows)

    links = cut_lineage(dealt.mapInArrow(search, "a long, b long, n long"), "links")
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    roots = components(links.where("b IS NOT NULL").select("a", "b"))
    smallest = rows.where("cid IS NOT NULL").groupBy("cid").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    named = smallest.join(roots, smallest["cid"] == roots["node"], "left").withColumn("root", F.coalesce("root", "cid"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    info = named.join(lowest, "root").join(counts, "cid", "left").select(
        "cid", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    loose = rows.where("cid IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    return (
        rows.where("cid IS NOT NULL").join(info, "cid")
        .select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
        .unionByName(loose)
    )
