"""Graph operators over ``nodes(id, ...)`` and ``edges(src, dst, ...)`` tables.

Traversals are semi-naive: a round joins only the frontier with the edges, and each
round is written to the shared checkpoint folder. A graph of at most ``LOCAL_EDGES``
edges and nodes (both counted first) is walked by one Arrow task instead, as job start-up
would be most of the time; results are the same, and ``local_edges=0`` turns it off.
A larger graph is cut into its weakly connected pieces, which no walk leaves: pieces of at
most ``PIECE_EDGES`` edges are dealt over tasks and walked there, and only larger ones go
by rounds. Results are the same again, and ``piece_edges=0`` turns it off.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquetry.operators.components import connected_components
from marquetry.runtime import cut, running_total

LOCAL_EDGES = 500_000
#: Edges of a piece that one task holds; rows of small pieces that are walked together;
#: steps up to which rounds are cheaper than finding the pieces.
PIECE_EDGES, CHUNK, FEW_STEPS = 500_000, 100_000, 4


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst): the one that sorts first by its other columns."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    if not rest:
        return edges.distinct()
    # An aggregate, not a window: it combines on the map side, so hubs do not gather.
    return edges.groupBy("src", "dst").agg(F.min(F.struct(*rest)).alias("x")).select("src", "dst", "x.*")


def merge_graphs(nodes: list[DataFrame], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Union of graphs; of nodes with one id the first graph's stays."""
    every = None
    for order, n in enumerate(nodes):
        part = n.withColumn("__order", F.lit(order))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in ("id", "__order")]
    first = every.groupBy("id").agg(F.min_by(F.struct(*rest), "__order").alias("x")).select("id", "x.*")
    joined = edges[0]
    for e in edges[1:]:
        joined = joined.unionByName(e, allowMissingColumns=True)
    return first, dedupe_edges(joined)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, in_degree, out_degree)`` over distinct edges; zero where there are none."""
    pairs = edges.select("src", "dst").distinct()
    ends = pairs.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(
        pairs.select(F.col("dst").alias("id"), F.lit(1), F.lit(0))
    )
    every = ends.union(nodes.select("id", F.lit(0), F.lit(0)))
    counts = every.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return counts.join(nodes.select("id").distinct(), "id", "left_semi")


def roots_and_leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, is_root, is_leaf)``: no callers, no callees."""
    d = degrees(nodes, edges)
    return d.select("id", (F.col("in_degree") == 0).alias("is_root"), (F.col("out_degree") == 0).alias("is_leaf"))


def confidence_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))


def neighbours(nodes: DataFrame, edges: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """``(id, other, direction)``; with ``groups(language, lang_group)`` only between
    languages of one group, joined by equality on the group."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("callee").alias("direction")).union(
        edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("caller").alias("direction"))
    ).distinct()
    if groups is None:
        return both
    lang = nodes.select("id", "language").join(groups, "language", "left").select(
        "id", F.coalesce("lang_group", "language").alias("g")
    )
    return (
        both.join(lang, "id").join(lang.select(F.col("id").alias("other"), F.col("g").alias("h")), "other")
        .filter("g = h").select("id", "other", "direction")
    )


def _adjacency(rows) -> dict:
    out = defaultdict(list)
    for a, b in rows:
        out[a].append(b)
    return out


def _fits(edges: DataFrame, nodes: DataFrame, most: int) -> bool:
    """Whether a graph may be walked in one task; both its tables are counted."""
    return most > 0 and all(t.limit(most + 1).count() <= most for t in (edges, nodes))


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def _batch(rows, schema: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    fields = [x.split() for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(columns[i] if columns else [], _KINDS[t]) for i, (_, t) in enumerate(fields)], [x for x, _ in fields])


def _tagged(edges: DataFrame, seeds: DataFrame, *keys: str) -> DataFrame:
    """Edges and seeds as one table, after their ``keys``."""
    return edges.select(*keys, F.lit(0).alias("tag"), F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), F.lit(None).cast("string").alias("k")).union(
        seeds.select(*keys, F.lit(1), F.col("id").cast("long"), F.lit(None).cast("long"), F.col("kind").cast("string"))
    )


def _local(edges: DataFrame, seeds: DataFrame, body, schema: str) -> DataFrame:
    """Run ``body(edges, seeds)`` over whole small tables in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, starts = [], []
        for batch in batches:
            for tag, a, b, k in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                (starts if tag else pairs).append((a, k) if tag else (a, b))
        yield _batch(body(pairs, starts), schema)

    return _tagged(edges, seeds).coalesce(1).mapInArrow(run, schema)


def _split(pairs: DataFrame, most: int) -> tuple[DataFrame, DataFrame, bool]:
    """``labels(id, piece)`` of the nodes of edges, the ``piece`` ids with more than ``most``
    edges, and whether there are any."""
    labels = cut(connected_components(pairs.select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"))).withColumnRenamed("component", "piece"))
    sizes = _labelled(pairs, labels, "src").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.filter(F.col("n") > most).select("piece"))
    return labels, large, large.limit(1).count() > 0


def _labelled(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``rows`` with their ``piece``; a node that has no edge to another is its own."""
    return rows.join(labels.withColumnRenamed("id", key), key, "left").withColumn("piece", F.coalesce("piece", F.col(key).cast("long")))


def _in_pieces(edges: DataFrame, seeds: DataFrame, body, schema: str) -> DataFrame:
    """Run ``body(edges, seeds)`` over the pieces of ``edges(piece, src, dst)`` and
    ``seeds(piece, id, kind)``, small ones together. A task holds one piece and a chunk.

    With a column ``share`` in both, parts of a piece's seeds are walked apart, each with
    all its edges.
    """
    if "share" not in edges.columns:
        edges, seeds = edges.withColumn("share", F.lit(0).cast("long")), seeds.withColumn("share", F.lit(0).cast("long"))
    tagged = cut(_tagged(edges, seeds, "share", "piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, starts, last = [], [], None
        for batch in batches:
            share, piece, tag = (batch.column(i).to_numpy() for i in range(3))
            a, b, k = (batch.column(i).to_pylist() for i in range(3, 6))
            ends = (np.flatnonzero((share[1:] != share[:-1]) | (piece[1:] != piece[:-1])) + 1).tolist()
            for begin, end in zip([0, *ends], [*ends, len(tag)], strict=True):
                now = (share[begin], piece[begin])
                if last is not None and now != last and (now[0] != last[0] or len(pairs) + len(starts) >= CHUNK):
                    yield _batch(body(pairs, starts), schema)
                    pairs, starts = [], []
                last = now
                for i in range(begin, end):
                    if tag[i]:
                        starts.append((a[i], k[i]))
                    else:
                        pairs.append((a[i], b[i]))
        if last is not None:
            yield _batch(body(pairs, starts), schema)

    tasks = min(2000, max(edges.sparkSession.sparkContext.defaultParallelism, tagged.count() // CHUNK))
    return tagged.repartition(tasks, "share", "piece").sortWithinPartitions("share", "piece").mapInArrow(run, schema)


def _bfs(pairs, starts, limit=None):
    out, adjacency = [], _adjacency(pairs)
    by_kind = defaultdict(set)
    for a, k in starts:
        by_kind[k].add(a)
    for kind, seeds in by_kind.items():
        depth, queue = dict.fromkeys(seeds, 0), deque(seeds)
        while queue:
            u = queue.popleft()
            if limit is not None and depth[u] >= limit:
                continue
            for v in adjacency.get(u, ()):
                if v not in depth:
                    depth[v] = depth[u] + 1
                    queue.append(v)
        out += [(v, kind, d) for v, d in depth.items()]
    return out


_FILES = 12


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def reach(
    edges: DataFrame, seeds: DataFrame, *, max_depth: int | None = None, local_edges: int = LOCAL_EDGES, piece_edges: int = PIECE_EDGES
) -> DataFrame:
    """``(id, kind, depth)``: all that ``seeds(id[, kind])`` reach, with the least depth.

    Seeds of different kinds (production, test) are followed in one pass.
    """
    seeds = _seeds(seeds)
    pairs = cut(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    if _fits(pairs, seeds, local_edges):
        return _local(pairs, seeds, lambda p, s: _bfs(p, s, max_depth), _REACH)
    if piece_edges <= 0 or (max_depth is not None and max_depth <= FEW_STEPS):
        return _reach_rounds(pairs, seeds, max_depth)
    return _reach_pieces(pairs, seeds, _split(pairs, piece_edges), max_depth)


_REACH = "id long,kind string,depth int"


def _seeds(seeds: DataFrame) -> DataFrame:
    if "kind" not in seeds.columns:
        seeds = seeds.withColumn("kind", F.lit("seed"))
    return seeds.select("id", F.col("kind").cast("string").alias("kind")).filter("id is not null").distinct()


def _reach_pieces(pairs: DataFrame, seeds: DataFrame, split, max_depth: int | None = None) -> DataFrame:
    labels, large, any_large = split
    started = cut(_labelled(seeds, labels, "id"))
    # Edges of pieces without a seed lead nowhere.
    dealt = _labelled(pairs, labels, "src").join(started.select("piece").distinct(), "piece", "left_semi")
    near = lambda t: t.join(large, "piece", "left_anti") if any_large else t
    found = cut(_in_pieces(near(dealt), near(started), lambda p, s: _bfs(p, s, max_depth), _REACH))
    if not any_large:
        return found
    far = lambda t: t.join(large, "piece", "left_semi").drop("piece")
    return found.unionByName(_reach_rounds(cut(far(dealt)), far(started), max_depth).select("id", "kind", "depth"))


def _reach_rounds(pairs: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    seen = [cut(seeds.select("id", "kind", F.lit(0).alias("depth")))]
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = seen[-1].withColumnsRenamed({"id": "at"}).join(pairs, F.col("at") == F.col("src")).select(F.col("dst").alias("id"), "kind").distinct()
        frontier = cut(step.join(_all(seen), ["id", "kind"], "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.limit(1).count():
            break
        # A file a round; of many, those before the last are written as one.
        seen = [*seen, frontier] if len(seen) < _FILES else [cut(_all(seen)), frontier]
    return _all(seen)


def unreachable(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, **options) -> DataFrame:
    """Nodes that no seed reaches."""
    return nodes.join(reach(edges, seeds, **options).select("id").distinct(), "id", "left_anti")


def can_reach(edges: DataFrame, source: int, target: int, **options) -> bool:
    spark = edges.sparkSession
    found = reach(edges, spark.range(source, source + 1), **options)
    return found.filter(F.col("id") == target).limit(1).count() > 0


def blast_radius(nodes: DataFrame, edges: DataFrame, start: DataFrame, *, direction: str = "downstream", max_depth: int = 10) -> DataFrame:
    """``(id, file, depth, direction)`` of what a change touches."""
    if direction == "both":
        down = blast_radius(nodes, edges, start, direction="downstream", max_depth=max_depth)
        return down.unionByName(blast_radius(nodes, edges, start, direction="upstream", max_depth=max_depth))
    if direction not in ("downstream", "upstream"):
        raise ValueError("direction must be downstream, upstream or both")
    walked = edges if direction == "downstream" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = reach(walked, start.select("id"), max_depth=max_depth).filter("depth > 0").select("id", "depth")
    return found.join(nodes.select("id", "file"), "id", "left").select("id", "file", "depth", F.lit(direction).alias("direction"))


def trace_paths(edges: DataFrame, source: int, target: int, *, max_paths: int = 3, max_depth: int = 10) -> DataFrame:
    """Shortest simple paths from source to target: the ``max_paths`` smallest by their nodes.

    The frontier is pruned to nodes that reach the target in the steps left, and holds at
    most ``max_paths`` paths a node.
    """
    spark = edges.sparkSession
    pairs = cut(edges.select("src", "dst").distinct())
    back = reach(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), spark.range(target, target + 1), max_depth=max_depth)
    left = cut(back.select(F.col("id").alias("node"), F.col("depth").alias("left")))
    row = left.filter(F.col("node") == source).first()
    empty = spark.createDataFrame([], "path array<bigint>, depth int")
    if row is None or source == target:
        return empty
    paths = spark.range(source, source + 1).select(F.array("id").alias("path"), F.col("id").alias("last"))
    for step in range(row["left"]):
        ahead = left.filter(F.col("left") == row["left"] - step - 1)
        paths = (
            paths.join(pairs, F.col("last") == F.col("src")).join(ahead, F.col("dst") == F.col("node"))
            .select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("last"))
        )
        # What follows a node is the same for all paths to it, so its smallest ones are enough.
        place = F.row_number().over(Window.partitionBy("last").orderBy("path"))
        paths = cut(paths.withColumn("place", place).filter(F.col("place") <= max_paths).drop("place"))
    return paths.select("path", F.lit(row["left"]).cast("int").alias("depth")).orderBy("path").limit(max_paths)


def _scc(pairs, starts):
    """Components by an iterative depth-first search with low links."""
    adjacency = _adjacency(pairs)
    index, low, on, stack, out = {}, {}, set(), [], []
    for root, _ in starts:
        if root in index:
            continue
        work = [(root, iter(adjacency.get(root, ())))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, targets = work[-1]
            for w in targets:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(adjacency.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    group = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        group.append(w)
                        if w == v:
                            break
                    out += [(w, min(group)) for w in group]
    return out


def _without(open_: DataFrame, live: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that are left when some nodes go."""
    for end in ("src", "dst"):
        live = live.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return cut(open_.join(gone.select("id"), "id", "left_anti")), cut(live.select("src", "dst"))


def strongly_connected(nodes: DataFrame, edges: DataFrame, *, local_edges: int = LOCAL_EDGES, piece_edges: int = PIECE_EDGES) -> DataFrame:
    """``(id, component)``, named by its smallest node.

    Large graphs: nodes without an open caller or callee are components of their own and go
    first, from both ends of every chain at once. What is left is coloured: the smallest
    open node that reaches a node colours it, and nodes that reach their colour back form a
    component.
    """
    pairs, ids = cut(edges.select("src", "dst").distinct()), cut(nodes.select("id").distinct())
    if _fits(pairs, ids, local_edges):
        return _local(pairs, ids.withColumn("kind", F.lit("n")), _scc, "id long,component long")
    live = cut(
        pairs.filter("src <> dst").join(ids.select(F.col("id").alias("src")), "src", "left_semi")
        .join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    )
    if piece_edges <= 0:
        return _scc_rounds(ids, live)
    labels, large, any_large = _split(live, piece_edges)
    alone = ids.join(labels, "id", "left_anti").select("id", F.col("id").alias("component"))
    placed, dealt = labels.withColumn("kind", F.lit("n")), _labelled(live, labels, "src")
    near = lambda t: t.join(large, "piece", "left_anti") if any_large else t
    done = alone.unionByName(cut(_in_pieces(near(dealt), near(placed), _scc, "id long,component long")))
    if not any_large:
        return done
    far = lambda t: t.join(large, "piece", "left_semi")
    return done.unionByName(_scc_rounds(cut(far(placed).select("id")), cut(far(dealt).select("src", "dst"))))


def _scc_rounds(ids: DataFrame, live: DataFrame) -> DataFrame:
    # Columns are named afresh in each step, as all tables come from the same two.
    open_, done = ids, []
    while open_.limit(1).count():
        inner = live.select(F.col("src").alias("id")).intersect(live.select(F.col("dst").alias("id")))
        alone = cut(open_.join(inner, "id", "left_anti").select("id", F.col("id").alias("component")))
        if alone.limit(1).count():
            done = [*done, alone] if len(done) < _FILES else [cut(_all(done)), alone]
            open_, live = _without(open_, live, alone)
            continue
        colour = cut(open_.select("id", F.col("id").alias("c")))
        while True:
            push = live.join(colour.select(F.col("id").alias("src"), "c"), "src").select(F.col("dst").alias("id"), "c")
            following = cut(colour.unionByName(push).groupBy("id").agg(F.min("c").alias("c")))
            moved = following.join(colour, ["id", "c"], "left_anti").limit(1).count()
            colour = following
            if not moved:
                break
        own = live.join(colour.select(F.col("id").alias("src"), "c"), "src").join(
            colour.select(F.col("id").alias("dst"), F.col("c").alias("d")), "dst"
        ).filter("c = d")
        back = own.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        found = reach(back, colour.filter("id = c").select("id"), local_edges=0, piece_edges=0).select("id")
        settled = cut(colour.join(found, "id", "left_semi").select("id", F.col("c").alias("component")))
        done = [*done, settled] if len(done) < _FILES else [cut(_all(done)), settled]
        open_, live = _without(open_, live, settled)
    return _all(done) if done else ids.select("id", F.col("id").alias("component"))


def _push(links):
    """Ids, sources, targets and out-degrees of a list of links, as arrays of positions."""
    ends = np.array(links, np.int64).reshape(-1, 2)
    names, at = np.unique(ends, return_inverse=True)
    src, dst = at.reshape(-1, 2).T
    return names, src, dst, np.bincount(src, minlength=len(names))


def _loose_shares(links, rounds: int, damping: float):
    """What a mass of one a node leaves in nodes without targets after 0, 1, ... rounds."""
    names, src, dst, out = _push(links)
    mass = np.ones(len(names))
    for j in range(rounds):
        yield j, float(mass[out == 0].sum())
        mass = damping * np.bincount(dst, mass[src] / out[src], len(names))


def _scores(links, loose: list[float], n: int, damping: float):
    names, src, dst, out = _push(links)
    score = np.full(len(names), 1 / n)
    for mass in loose:
        score = (1 - damping) / n + damping * (np.bincount(dst, score[src] / out[src], len(names)) + mass / n)
    return zip(names.tolist(), score.tolist(), strict=True)


def _pagerank_pieces(ids: DataFrame, pairs: DataFrame, labels: DataFrame, rounds: int, damping: float) -> DataFrame:
    """Pieces share nothing but the mass of nodes without targets, one number a round. What
    each piece adds to it is linear in what all nodes got in the rounds before, so a first
    pass over the pieces gives these numbers and a second one the scores."""
    n = ids.count()
    dealt = cut(_labelled(pairs, labels, "src"))
    none = dealt.select("piece", F.lit(0).cast("long").alias("id"), F.lit("n").alias("kind")).limit(0)
    ends = pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct()
    alone = cut(ids.join(ends, "id", "left_anti"))
    parts = _in_pieces(dealt, none, lambda p, _: _loose_shares(p, rounds, damping), "j int,mass double")
    share = [0.0] * rounds
    for row in parts.groupBy("j").agg(F.sum("mass").alias("mass")).collect():  # a row a round
        share[row.j] = row.mass
    if rounds:
        share[0] += alone.count()
    loose, given = [], []
    for t in range(rounds):
        loose.append(share[t] / n + sum(given[t - 1 - j] * share[j] for j in range(t)))
        given.append((1 - damping) / n + damping * loose[t] / n)
    found = _in_pieces(dealt, none, lambda p, _: _scores(p, loose, n, damping), "id long,score double")
    return cut(found).unionByName(alone.select("id", F.lit(given[-1] if rounds else 1.0 / max(n, 1)).alias("score")))


def pagerank(
    nodes: DataFrame, edges: DataFrame, *, damping: float = 0.85, rounds: int = 100, local_edges: int = LOCAL_EDGES, piece_edges: int = PIECE_EDGES
) -> DataFrame:
    """``(id, score)`` after exactly ``rounds`` rounds; dangling mass is shared by all."""
    ids = cut(nodes.select("id").distinct())
    inner = edges.select("src", "dst").distinct().join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    pairs = cut(inner.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
    if _fits(pairs, ids, local_edges):

        def body(links, starts):
            names = sorted({a for a, _ in starts})
            at = {v: i for i, v in enumerate(names)}
            n = len(names)
            if not n:
                return []
            src = np.array([at[a] for a, _ in links], int)
            dst = np.array([at[b] for _, b in links], int)
            out = np.bincount(src, minlength=n)
            score = np.full(n, 1 / n)
            for _ in range(rounds):
                got = np.bincount(dst, score[src] / out[src], n) if len(src) else np.zeros(n)
                score = (1 - damping) / n + damping * (got + score[out == 0].sum() / n)
            return list(zip(names, score.tolist(), strict=True))

        return _local(pairs, ids.withColumn("kind", F.lit("n")), body, "id long,score double")
    if piece_edges > 0:
        labels, _, any_large = _split(pairs, piece_edges)
        if not any_large:
            return _pagerank_pieces(ids, pairs, labels, rounds, damping)
    n = ids.count()
    out = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    links = cut(pairs.join(out, "src"))
    base = cut(ids.join(out.withColumnRenamed("src", "id"), "id", "left").select("id", "out"))
    score = base.select("id", "out", F.lit(1.0 / max(n, 1)).alias("score"))
    for _ in range(rounds):
        got = links.join(score.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(
            F.sum(F.col("score") / F.col("out")).alias("got")
        )
        loose = score.filter("out is null").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("loose"))  # one row
        flow = F.lit((1 - damping) / max(n, 1)) + damping * (F.col("loose") / max(n, 1) + F.coalesce("got", F.lit(0.0)))
        score = cut(base.join(got, "id", "left").crossJoin(F.broadcast(loose)).select("id", "out", flow.alias("score")))
    return score.select("id", "score")


def _brandes(pairs, starts):
    """What shortest paths from each start add to the nodes between."""
    adjacency, total = dict(_adjacency(pairs)), defaultdict(float)
    for s, _ in starts:
        order, parents, sigma, depth = [], defaultdict(list), defaultdict(float), {s: 0}
        sigma[s] = 1.0
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in adjacency.get(v, ()):
                if w not in depth:
                    depth[w] = depth[v] + 1
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    sigma[w] += sigma[v]
                    parents[w].append(v)
        share = defaultdict(float)
        for w in reversed(order):
            for v in parents[w]:
                share[v] += sigma[v] / sigma[w] * (1 + share[w])
            if w != s:
                total[w] += share[w]
    return total.items()


#: Sources that share a copy of a piece; rows ``(source, node)`` of rounds before a batch is halved.
SOURCES, MOST_STATES = 2048, 200_000_000
_PART = "id long,part double"


def _brandes_rounds(pairs: DataFrame, sources: DataFrame, most: int) -> list[DataFrame]:
    """The same by joins, for pieces that no task holds. Sources whose paths would make more
    than ``most`` rows at a time are halved and walked one half after the other."""
    seen = [cut(sources.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("sigma")))]
    rows = count = seen[0].count()
    while count:
        step = seen[-1].withColumnsRenamed({"id": "at"}).join(pairs, F.col("at") == F.col("src"))
        sums = step.groupBy("s", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        seen.append(cut(sums.join(_all([t.select("s", "id") for t in seen]), ["s", "id"], "left_anti").select("s", "id", "sigma")))
        count = seen[-1].count()
        rows += count
        if rows > most and seen[0].limit(2).count() > 1:
            middle = sources.approxQuantile("id", [0.5], 0.05)[0]
            low, high = sources.filter(F.col("id") < middle), sources.filter(F.col("id") >= middle)
            if not low.limit(1).count():
                low, high = sources.filter(F.col("id") <= middle), sources.filter(F.col("id") > middle)
            return _brandes_rounds(pairs, low, most) + _brandes_rounds(pairs, high, most)
    parts, below = [], None
    for level in reversed(seen[:-1]):
        if below is None:
            below = cut(level.withColumn("share", F.lit(0.0)))
            continue
        given = below.select("s", F.col("id").alias("dst"), ((1 + F.col("share")) / F.col("sigma")).alias("x")).join(pairs, "dst")
        sums = given.groupBy("s", F.col("src").alias("id")).agg(F.sum("x").alias("x"))
        share = F.coalesce(F.col("sigma") * F.col("x"), F.lit(0.0))
        below = cut(level.join(sums, ["s", "id"], "left").select("s", "id", "sigma", share.alias("share")))
        parts.append(cut(below.filter("s <> id and share <> 0").groupBy("id").agg(F.sum("share").alias("part"))))
    return parts


def betweenness(
    nodes: DataFrame, edges: DataFrame, *, most_edges: int = LOCAL_EDGES, piece_edges: int = PIECE_EDGES, most_states: int = MOST_STATES
) -> DataFrame:
    """``(id, score)``: directed, normalised by (n-1)(n-2). Sources are dealt over tasks, each
    with the edges of their weakly connected piece; pieces of more than ``piece_edges`` edges
    are walked by joins. A graph of at most ``most_edges`` edges goes to each task whole."""
    pairs = cut(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    ids = cut(nodes.select("id").distinct())
    n = ids.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    few = most_edges > 0 and pairs.limit(most_edges + 1).count() <= most_edges
    if few:
        held = [(r.src, r.dst) for r in pairs.collect()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield _batch(_brandes(held, [(s, None) for batch in batches for s in batch.column(0).to_pylist()]), _PART)

        parts = ids.repartition(ids.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, _PART)
    else:
        labels, large, any_large = _split(pairs, piece_edges)
        # A node without edges lies on no path.
        placed = cut(labels.join(ids, "id", "left_semi").withColumn("kind", F.lit("n")))
        shares = placed.groupBy("piece").agg(F.ceil(F.count(F.lit(1)) / SOURCES).cast("long").alias("shares"))
        near = shares.join(large, "piece", "left_anti") if any_large else shares
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share")
        dealt = _labelled(pairs, labels, "src").join(near, "piece").select("piece", "src", "dst", every)
        starts = placed.join(near, "piece").withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares"))).drop("shares")
        parts = _in_pieces(dealt, starts, lambda p, s: _brandes(p, s), _PART)
        if any_large:
            far = lambda t: t.join(large, "piece", "left_semi")
            large_pairs = cut(far(_labelled(pairs, labels, "src")).select("src", "dst"))
            parts = _all([parts, *_brandes_rounds(large_pairs, cut(far(placed).select("id")), most_states)])
    sums = parts.groupBy("id").agg((F.sum("part") * scale).alias("score"))
    return ids.join(sums, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def importance(scores: DataFrame) -> DataFrame:
    """``(id, percentile, importance)`` from ``(id, pagerank, betweenness)``.

    A percentile is the share of nodes strictly below, so ``n`` divides it, not ``n - 1``.
    Ranks come from counts of distinct scores, summed over ranges of them.
    """

    scores = cut(scores)  # counted, ranked twice and joined: made once
    n = scores.count()

    def shares(column: str) -> DataFrame:
        counts = scores.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        below = running_total(counts, [column], F.col("n"), "below")
        return below.select(F.col(column).alias(f"k_{column}"), (F.col("below") / n).alias(f"p_{column}"))

    a, b = shares("pagerank"), shares("betweenness")
    joined = scores.join(a, scores.pagerank == F.col("k_pagerank")).join(b, scores.betweenness == F.col("k_betweenness"))
    mean = (F.col("p_pagerank") + F.col("p_betweenness")) / 2
    label = F.when(mean >= 0.95, "critical").when(mean >= 0.8, "high").when(mean >= 0.2, "normal").otherwise("low")
    return joined.select("id", mean.alias("percentile"), label.alias("importance"))


def csr(edges: DataFrame) -> DataFrame:
    """``(src, offset, targets)``: sorted adjacency with the running number of edges
    before it. A source's list is as long as its degree."""
    lists = edges.select("src", "dst").distinct().groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("targets"))
    return running_total(lists, ["src"], F.size("targets"), "offset").select("src", "offset", "targets")


def closure(links: DataFrame, *, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``(child, parent)`` links -> ``(child, ancestor, depth)`` with the least depth.

    Doubling: each round joins paths with paths, so depth d takes log2(d) rounds.
    """
    now = cut(links.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct())
    while True:
        longer = now.alias("a").join(now.alias("b"), F.col("a.ancestor") == F.col("b.child")).select(
            F.col("a.child"), F.col("b.ancestor"), (F.col("a.depth") + F.col("b.depth")).alias("depth")
        )
        merged = cut(now.union(longer).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")))
        if not merged.join(now, ["child", "ancestor", "depth"], "left_anti").limit(1).count():
            return merged
        now = merged


def virtual_targets(calls: DataFrame, subtypes: DataFrame, methods: DataFrame) -> DataFrame:
    """Class-hierarchy targets of ``calls(call_id, receiver, method)``: methods of the
    receiver and of the subtypes that override it. ``subtypes(child, ancestor)``."""
    owners = calls.select("call_id", "method", F.col("receiver").alias("owner")).union(
        calls.join(subtypes, calls.receiver == subtypes.ancestor).select("call_id", "method", F.col("child").alias("owner"))
    ).distinct()
    return owners.join(methods, (owners.owner == methods["class"]) & (owners.method == methods["name"])).select(
        "call_id", "owner", F.col("id").alias("target")
    )


def rapid_types(edges: DataFrame, entries: DataFrame, virtual: DataFrame, instantiates: DataFrame, methods: DataFrame, *, local_edges: int = LOCAL_EDGES, piece_edges: int = PIECE_EDGES) -> DataFrame:
    """Rapid type analysis: ``(id)`` reached when a virtual call only goes to methods of
    types that reached code instantiates.

    ``virtual(src, target)``: possible targets; ``instantiates(id, class)``;
    ``methods(id, class, name)``. What is reached and the types it makes grow until neither does.
    """
    owner = methods.select(F.col("id").alias("target"), "class")
    direct = cut(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    possible = cut(virtual.select("src", "target").distinct().join(owner, "target").filter("src is not null and target is not null"))
    made, starts = cut(instantiates.select("id", "class")), cut(_seeds(entries.select("id")))
    every = cut(direct.union(possible.select("src", "target")).distinct())
    # The pieces of all calls that may ever open serve each round.
    small = _fits(every, starts, local_edges)
    split = None if small or piece_edges <= 0 else _split(every, piece_edges)
    types, known = made.select("class").limit(0), 0
    while True:
        # Types open calls, so a round is needed only when a type is new: few rounds, not one a call.
        open_ = possible.join(types, "class", "left_semi").select("src", F.col("target").alias("dst"))
        pairs = cut(direct.union(open_).distinct())
        if split is not None:
            found = _reach_pieces(pairs, starts, split)
        else:
            found = _local(pairs, starts, _bfs, _REACH) if small else _reach_rounds(pairs, starts)
        reached = cut(found.select("id").distinct())
        types = cut(made.join(reached, "id", "left_semi").select("class").filter("class is not null").distinct())
        now = types.count()
        if now == known:
            return reached
        known = now


def variable_types(allocations: DataFrame, assignments: DataFrame, **options) -> DataFrame:
    """Variable type analysis: ``(var, class)`` grown along ``assignments(src, dst)``. It is
    reachability with a class for the kind of each seed."""
    seeds = allocations.select(F.col("var").alias("id"), F.col("class").alias("kind"))
    return reach(assignments, seeds, **options).select(F.col("id").alias("var"), F.col("kind").alias("class"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, averages and density (edges over nodes squared)."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("file").alias("files"), F.sum("loc").alias("loc"), F.avg("loc").alias("avg_loc"))
    e = edges.select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("edges"))
    return n.crossJoin(e).select(  # one row each
        "nodes", "edges", "files", "loc", "avg_loc", (F.col("edges") / F.col("nodes")).alias("avg_degree"),
        (F.col("edges") / (F.col("nodes") * F.col("nodes"))).alias("density"),
    )


def attribute_hierarchy(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(child, parent)`` from ``extends:`` and ``implements:`` attributes, and ``(class,
    name, id)`` of methods, whose class is that of ``parent_id`` or what stands before the
    last ``.`` or ``::`` of their full name."""
    marks = nodes.select(F.col("name").alias("child"), F.explode("attributes").alias("mark"))
    links = marks.select("child", F.trim(F.regexp_extract("mark", r"^(?:extends|implements):(.+)$", 1)).alias("parent")).filter("parent <> ''").distinct()
    classes = nodes.select(F.col("id").alias("parent_id"), F.col("name").alias("holder"))
    before = F.regexp_extract(F.regexp_extract("full_name", r"^(.*?)(?:\.|::)[^.:]+$", 1), r"([^.:]+)$", 1)
    methods = nodes.filter(F.col("kind").isin("method", "async_method", "static_method", "constructor")).join(classes, "parent_id", "left")
    owned = methods.select(F.coalesce("holder", F.nullif(before, F.lit(""))).alias("class"), "name", "id").filter("class is not null")
    return links, owned


def call_neighbourhood(nodes: DataFrame, edges: DataFrame, start: int, *, depth: int = 2, entries: DataFrame | None = None, **options) -> DataFrame:
    """``(id, direction, depth, reachable)`` of callers and callees up to ``depth``;
    ``reachable`` tells whether an entry leads there (null without entries)."""
    spark = nodes.sparkSession
    edges = cut(edges.select("src", "dst"))  # walked three times: made once
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    parts = [
        reach(e, spark.range(start, start + 1), max_depth=depth, **options).filter("depth > 0").select("id", F.lit(d).alias("direction"), "depth")
        for e, d in ((edges, "callee"), (back, "caller"))
    ]
    around = parts[0].unionByName(parts[1])
    if entries is None:
        return around.withColumn("reachable", F.lit(None).cast("boolean"))
    alive = reach(edges, entries.select("id"), **options).select("id", F.lit(True).alias("alive")).distinct()
    return around.join(alive, "id", "left").select("id", "direction", "depth", F.coalesce("alive", F.lit(False)).alias("reachable"))


def trace_both(edges: DataFrame, one: int, two: int, **options) -> DataFrame:
    """Paths from one to two and from two to one: ``(direction, path, depth)``."""
    there, back = trace_paths(edges, one, two, **options), trace_paths(edges, two, one, **options)
    return there.select(F.lit("forward").alias("direction"), "path", "depth").union(back.select(F.lit("backward"), "path", "depth"))
