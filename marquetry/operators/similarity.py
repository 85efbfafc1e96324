"""Similarity joins, clones, clusters, snapshots and sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquetry.functions.text import cosine, shingles, words
from marquetry.operators.cells import compare_cells
from marquetry.operators.components import connected_components
from marquetry.operators.terms import distinct_grams, parts, term_counts, theta_sketches
from marquetry.runtime import BROADCAST_ROWS, cut, lookup_join, running_total


def document_grams(docs: DataFrame, *, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, gram)``: the distinct word k-grams of each text."""
    w = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    return w.select("doc_id", F.explode(F.array_distinct(shingles(F.col("w"), k))).alias("gram"))


def document_codes(docs: DataFrame, *, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, codes)``: the sorted hashes of each text's distinct grams, made inside its row,
    as ``overlap_classes`` needs them; texts without a gram and null ids are left out."""
    w = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w")).filter("doc_id is not null")
    hashed = F.transform(shingles(F.col("w"), k), lambda g: F.xxhash64(g))
    made = w.select("doc_id", F.sort_array(F.array_distinct(hashed)).alias("codes")).filter("size(codes) > 0")
    ids = docs.select(F.col(id_col).alias("doc_id")).filter("doc_id is not null")
    if ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        # Rows of one id are one document.
        made = made.groupBy("doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"))
    return made


def gram_index(tokens: DataFrame) -> DataFrame:
    """``tokens(doc_id, pos, gram)`` -> positions by gram and document."""
    return tokens.groupBy("gram", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def stop_grams(grams: DataFrame, *, share: float = 0.5) -> DataFrame:
    """Grams in more than ``floor(n * share)`` documents."""
    bucket = lambda: F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")
    hashed = cut(grams.select("doc_id", bucket().alias("bucket")))
    most = int(hashed.select("doc_id").distinct().count() * share)
    # A gram is in as many documents as its bucket at most, so few buckets are looked at,
    # and only their grams move.
    heavy = hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("bucket")
    held = lookup_join(grams.select("gram", bucket().alias("bucket")), heavy, ["bucket"], how="inner")
    return held.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > most)


#: Buckets of grams that are counted before any gram is.
BUCKETS = 1 << 18


def overlap_classes(grams: DataFrame, *, threshold: float = 0.8, stop: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b, shared, jaccard)`` of class representatives at or above ``threshold``,
    exactly, and ``(rep, doc_id)`` members: documents with the same grams are one class,
    so copies, however many, make no pairs.

    A prefix-filter join: grams are ordered from rare to frequent and only the first
    ``n - ceil(t n) + 1`` of a class can start a match, so frequent grams, which
    would make the pairs, are hardly ever joined. Candidates are then verified.

    ``grams`` may be ``document_codes`` instead, which move no gram to find the sets.
    """
    if "codes" in grams.columns:
        if stop is not None:
            raise ValueError("stop grams are left out of grams, not of their codes")
        sets = grams
    else:
        base = grams if stop is None else grams.join(stop.select("gram"), "gram", "left_anti")
        sets = base.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.xxhash64("gram"))).alias("codes"))
    # Two hashes of 64 bits name a set of grams.
    keyed = cut(sets.select("doc_id", "codes", F.xxhash64("codes").alias("h1"), F.xxhash64(F.lit(11), "codes").alias("h2")))
    groups = keyed.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("codes").alias("codes"))
    members = keyed.join(groups.select("h1", "h2", "rep"), ["h1", "h2"]).select("rep", "doc_id")
    coded = groups.select("rep", F.explode("codes").alias("code"))
    df = coded.groupBy("code").agg(F.count(F.lit(1)).alias("df"))
    ranked = cut(
        coded.join(df, "code").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "code"))).alias("g"))
        .select("rep", F.transform("g", lambda x: x["code"]).alias("codes"), F.size("g").alias("n"))
    )
    prefix = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int") + 1
    heads = ranked.select("rep", "n", F.explode(F.slice("codes", F.lit(1), prefix)).alias("code"))
    a, b = heads.alias("a"), heads.alias("b")
    near = (F.col("a.n") >= F.col("b.n") * threshold) & (F.col("b.n") >= F.col("a.n") * threshold)
    pairs = a.join(b, (F.col("a.code") == F.col("b.code")) & (F.col("a.rep") < F.col("b.rep")) & near).select(
        F.col("a.rep").alias("a"), F.col("b.rep").alias("b")
    ).distinct()
    left, right = ranked.select(F.col("rep").alias("a"), F.col("codes").alias("x")), ranked.select(F.col("rep").alias("b"), F.col("codes").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    full = pairs.join(left, "a").join(right, "b").select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y") - shared).alias("union"), F.size("x").alias("n"))
    found = full.select("a", "b", "shared", (F.col("shared") / F.col("union")).alias("jaccard")).filter(F.col("jaccard") >= threshold)
    return found, members.join(ranked.select("rep", "n"), "rep")


def overlap_pairs(grams: DataFrame, *, threshold: float = 0.8, stop: DataFrame | None = None) -> DataFrame:
    """All pairs ``(a, b, shared, jaccard)`` of documents, copies expanded, as the result
    says; ``overlap_classes`` has the same links without them."""
    found, members = overlap_classes(grams, threshold=threshold, stop=stop)
    found, members = cut(found), cut(members)
    x, y = members.select(F.col("rep").alias("a"), F.col("doc_id").alias("x")), members.select(F.col("rep").alias("b"), F.col("doc_id").alias("y"))
    across = found.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared", "jaccard")
    twin = members.select("rep", F.col("doc_id").alias("z"))
    within = members.join(twin, "rep").filter("doc_id < z").select(F.col("doc_id").alias("a"), F.col("z").alias("b"), F.col("n").alias("shared"), F.lit(1.0).alias("jaccard"))
    return across.unionByName(within)


def overlap_clusters(grams: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """``(id, cluster)`` of documents that links or copies join; copies are never paired."""
    found, members = overlap_classes(grams, threshold=threshold)
    members = cut(members)
    copies = members.filter("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    return clusters(found.select("a", "b").union(copies))


def contamination(grams: DataFrame, items: DataFrame) -> DataFrame:
    """Overlap of documents with benchmark items: ``(doc_id, item_id, shared, share)``."""
    items = cut(items.select("item_id", "gram"))
    sizes = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    # One row a gram, so a table of items that was counted as small is broadcast, and grams
    # that stand in no item never move.
    holders = items.groupBy("gram").agg(F.collect_list("item_id").alias("held"))
    found = lookup_join(grams, holders, ["gram"], how="inner")
    hits = found.select("doc_id", F.explode("held").alias("item_id")).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))
    return hits.join(sizes, "item_id").select("doc_id", "item_id", "shared", (F.col("shared") / F.col("n")).alias("share"))


_PRIME = np.uint64((1 << 61) - 1)


def _permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def minhash(docs: DataFrame, *, n: int = 128, k: int = 3, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, sig array<long>)``; texts below ``k`` words have a null signature."""

    from xxhash import xxh64_intdigest

    @F.arrow_udf("array<long>")
    def sketch(grams: pa.Array) -> pa.Array:
        mul, add = _permutations(n, seed)
        out = []
        for row in grams.to_pylist():
            if not row:
                out.append(None)
                continue
            h = np.array([xxh64_intdigest(g) for g in row], np.uint64)
            low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
            for at in range(0, len(h), 4096):
                low = np.minimum(low, (h[at : at + 4096, None] * mul + add).min(axis=0))
            out.append(low.view(np.int64).tolist())
        return pa.array(out, pa.list_(pa.int64()))

    w = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    return w.select("doc_id", sketch(F.array_distinct(shingles(F.col("w"), k))).alias("sig"))


def lsh_shape(n: int, threshold: float) -> tuple[int, int]:
    """(bands, rows) whose step lies nearest to the threshold."""
    rows = min(range(1, 21), key=lambda r: abs((1 / max(n // r, 1)) ** (1 / r) - threshold))
    return max(n // rows, 1), rows


def collision_probability(similarity: float, bands: int, rows: int) -> float:
    return 1 - (1 - similarity**rows) ** bands


def lsh_pairs(signatures: DataFrame, *, n: int = 128, threshold: float = 0.8) -> DataFrame:
    """Pairs ``(a, b, similarity)`` whose estimated Jaccard reaches the threshold.

    Equal signatures are collapsed to their smallest id first, so copies make no pairs
    of their own; they come back as pairs with their representative.
    """
    bands, rows = lsh_shape(n, threshold)
    signatures = cut(signatures.filter("sig is not null"))  # grouped and joined: made once
    groups = cut(signatures.filter("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep")))
    copies = signatures.join(groups, "sig").filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("similarity"))
    keys = F.array(*[F.xxhash64(F.lit(i), F.slice("sig", i * rows + 1, rows)) for i in range(bands)])
    banded = groups.select("rep", F.explode(keys).alias("key"))
    x, y = banded.alias("x"), banded.alias("y")
    found = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep"))).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    same = F.aggregate(F.zip_with("s", "t", lambda p, q: (p == q).cast("int")), F.lit(0), lambda acc, v: acc + v) / n
    left, right = groups.select(F.col("rep").alias("a"), F.col("sig").alias("s")), groups.select(F.col("rep").alias("b"), F.col("sig").alias("t"))
    return found.join(left, "a").join(right, "b").select("a", "b", same.alias("similarity")).filter(F.col("similarity") >= threshold).union(copies)


def cross_language_pairs(pairs: DataFrame, languages: DataFrame) -> DataFrame:
    """Pairs of different languages; similarity is capped at 0.99."""
    a = languages.select(F.col("doc_id").alias("a"), F.col("language").alias("la"))
    b = languages.select(F.col("doc_id").alias("b"), F.col("language").alias("lb"))
    return pairs.join(a, "a").join(b, "b").filter("la <> lb").withColumn("similarity", F.least("similarity", F.lit(0.99)))


def clusters(pairs: DataFrame) -> DataFrame:
    """``(id, cluster)`` of linked ids; a cluster is named by its smallest id."""
    return connected_components(pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))).select("id", F.col("component").alias("cluster"))


def cosine_pairs(vectors: DataFrame, *, threshold: float, by: str, id_col: str, vec_col: str) -> DataFrame:
    """Pairs of one block ``by`` at or above the threshold, exactly.

    Above a threshold of zero, pairs are found by matrix products over cells of bounded
    size, with a slack for their rounding; those found are computed again in the order of
    ``functions.text.cosine``.
    """
    v = vectors.select(F.col(by).alias("k"), F.col(id_col).alias("i"), F.col(vec_col).alias("v"))
    if threshold <= 0:  # vectors without a direction have a cosine of zero, so all pairs count
        x, y = v.withColumn("v", F.col("v").cast("array<double>")).alias("x"), v.withColumn("v", F.col("v").cast("array<double>")).alias("y")
        joined = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.i") < F.col("y.i")))
        return joined.select(F.col("x.i").alias("a"), F.col("y.i").alias("b"), cosine(F.col("x.v"), F.col("y.v")).alias("similarity")).filter(F.col("similarity") >= threshold)

    def close(rows: pa.Table, first: int) -> Iterator[pa.RecordBatch]:
        arrays = rows.column("v").combine_chunks()
        sizes = np.diff(arrays.offsets.to_numpy())
        for size in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero(sizes == size)
            flat = arrays.take(pa.array(at)).flatten().cast(pa.float64())
            m = flat.to_numpy(zero_copy_only=False).reshape(-1, size)
            if flat.null_count:  # a vector with a null component has no cosine
                solid = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, size).any(axis=1)
                at, m = at[solid], m[solid]
            yield from _close_cosines(rows.column("i").combine_chunks(), at, m, first, threshold)

    kind = v.schema["i"].dataType.simpleString()
    solid = v.filter("i is not null and v is not null")
    return compare_cells(solid, "k", "i", close, f"a {kind}, b {kind}, similarity double", cell=COSINE_CELL)


#: Rows of a block of vectors; and rows that are multiplied with a block at a time.
COSINE_CELL, STRIP = 4096, 256


def _close_cosines(ids: pa.Array, at: np.ndarray, m: np.ndarray, first: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of rows ``at`` of a cell with vectors ``m``; sums run from left to right."""
    norms = np.sqrt(np.cumsum(m * m, axis=1)[:, -1])
    at, m, norms = at[norms != 0], m[norms != 0], norms[norms != 0]
    with np.errstate(all="ignore"):
        unit = m / norms[:, None]
    half = int(np.searchsorted(at, first))
    for begin in range(0, half if first else len(m), STRIP):
        end = min(begin + STRIP, half) if first else begin + STRIP
        low = half if first else begin + 1
        with np.errstate(all="ignore"):
            # Not below the slack: what is not a number is looked at again, too.
            x, y = np.nonzero(~(unit[begin:end] @ unit[low:].T < threshold - 1e-6))
        x, y = x + begin, y + low
        if not first:
            x, y = x[x < y], y[x < y]
        for part in range(0, len(x), 65_536):
            p, q = x[part : part + 65_536], y[part : part + 65_536]
            with np.errstate(all="ignore"):
                scale = norms[p] * norms[q]
                same = np.cumsum(m[p] * m[q], axis=1)[:, -1] / scale
            # As in Spark, what is not a number is above all numbers.
            same = np.where(np.isnan(scale) | (scale > 0), np.maximum(np.fmin(same, 1.0), -1.0), 0.0)
            keep = same >= threshold
            a, b = ids.take(pa.array(at[p[keep]])), ids.take(pa.array(at[q[keep]]))
            ahead, apart = pc.less(a, b), pc.not_equal(a, b)
            pairs = [pc.if_else(ahead, a, b), pc.if_else(ahead, b, a), pa.array(same[keep])]
            yield pa.RecordBatch.from_arrays(pairs, ["a", "b", "similarity"]).filter(apart)


def tf_idf(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4 * BROADCAST_ROWS) -> DataFrame:
    """``(doc_id, term, weight)``: ``(1 + ln tf)(ln((1 + n) / (1 + df)) + 1)``, L2-normed.
    Terms of one letter are left out.

    Words are counted and weighed inside their row: up to ``limit`` frequent terms go to all
    tasks, and only the rows of the rarer terms move, to meet their df and then their document.
    Rows of one id are one document; they move by term, as null ids do.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind, n = text.schema["doc_id"].dataType.simpleString(), docs.count()
    repeated = cut(text.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").select("doc_id", F.lit(True).alias("again")))
    tf = None
    if repeated.limit(1).count():
        marked = lookup_join(text, repeated, ["doc_id"])
        text, many = marked.filter("again is null").drop("again"), marked.filter("again")
        terms = many.select("doc_id", F.explode(words(F.col("text"))).alias("term")).filter(F.length("term") > 1)
        tf = cut(terms.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")))
    text = text.withColumn("text", F.lower("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            _, code, _, names = term_counts(part.column("text"), least=2)
            yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(np.bincount(code, minlength=len(names)))], ["term", "n"])

    counts = text.select("text").mapInArrow(count, "term string, n long")
    if tf is not None:
        counts = counts.unionByName(tf.select("term", F.lit(1).cast("long").alias("n")))
    df = cut(counts.groupBy("term").agg(F.sum("n").alias("df")))

    # Terms with a df of as many bits go together to all tasks, or move.
    held, low = 0, None
    sizes = df.groupBy(F.length(F.bin("df")).alias("bits")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bits")).collect()
    for bits, size in sizes:
        held += size
        if held > limit:
            break
        low = 1 << (bits - 1)
    frequent = df.filter(F.col("df") >= low if low else F.lit(False)).toArrow().combine_chunks()
    known = pa.concat_arrays(frequent.column("term").chunks or [pa.array([], pa.string())]).cast(pa.large_string())
    idf = np.log((1 + n) / (1 + frequent.column("df").to_numpy())) + 1

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            row, code, tf, names = term_counts(part.column("text"), least=2)
            keep = pc.is_null(pc.index_in(names, value_set=known)).to_numpy(zero_copy_only=False)[code]
            found = [part.column("doc_id").take(pa.array(row[keep])), names.take(pa.array(code[keep])).cast(pa.string()), pa.array(tf[keep])]
            yield pa.RecordBatch.from_arrays(found, ["doc_id", "term", "tf"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            row, code, tf, names = term_counts(part.column("text"), least=2)
            at = pc.fill_null(pc.index_in(names, value_set=known), -1).to_numpy()[code]
            row, code, tf, at = (x[at >= 0] for x in (row, code, tf, at))
            w, terms = (1 + np.log(tf)) * idf[at], names.take(pa.array(code)).cast(pa.string())
            if "rare" in part.schema.names:
                moved, owner = part.column("rare").flatten(), pc.list_parent_indices(part.column("rare")).to_numpy()
                row, w = np.concatenate([row, owner]), np.concatenate([w, moved.field("w").to_numpy()])
                terms = pa.concat_arrays([terms, moved.field("term").cast(pa.string())])
            norm = np.sqrt(np.bincount(row, w * w, minlength=len(part)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), terms, pa.array(w / norm[row])], ["doc_id", "term", "weight"])

    weight = (1 + F.log("tf")) * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)
    whole = text
    if held > limit:
        moved = text.mapInArrow(rare, f"doc_id {kind}, term string, tf long")
        met = moved.join(df.filter(F.col("df") < low) if low else df, "term")
        listed = met.groupBy("doc_id").agg(F.collect_list(F.struct("term", weight.alias("w"))).alias("rare"))
        whole = text.join(listed, "doc_id", "left")
    out = whole.mapInArrow(weigh, f"doc_id {kind}, term string, weight double")
    if tf is None:
        return out
    raw = lookup_join(tf, df, ["term"], limit=limit).select("doc_id", "term", weight.alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return out.unionByName(raw.select("doc_id", "term", (F.col("w") / norm).alias("weight")))


def interval_overlaps(spans: DataFrame, *, slack: int = 0, width: int = 64) -> DataFrame:
    """Pairs ``(a, b)`` of ``spans(id, file, start, end)`` in one file that overlap, or lie
    within ``slack`` lines. Lines are cut in buckets, joined by equality, and a pair counts
    in the first bucket both touch only."""
    bucket = lambda c: F.floor(c / width)
    cells = spans.select("id", "file", "start", "end", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end") + slack))).alias("cell"))
    x, y = cells.alias("x"), cells.alias("y")
    meets = (F.col("x.start") <= F.col("y.end") + slack) & (F.col("y.start") <= F.col("x.end") + slack)
    first = F.col("x.cell") == F.greatest(bucket(F.col("x.start")), bucket(F.col("y.start")))
    same = (F.col("x.file") == F.col("y.file")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.id") < F.col("y.id"))
    return x.join(y, same & meets & first).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def containing(points: DataFrame, spans: DataFrame, *, width: int = 64) -> DataFrame:
    """The innermost of ``spans(id, file, start, end)`` around each ``points(file, line)``."""
    cells = spans.select("id", "file", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("cell"))
    p = points.withColumn("cell", F.floor(F.col("line") / width))
    hit = p.join(cells, ["file", "cell"]).filter("line between start and end")
    keep = [c for c in points.columns]
    return hit.groupBy(*keep).agg(F.max(F.struct(F.col("start"), (-F.col("end")).alias("e"), F.col("id"))).alias("m")).select(*keep, F.col("m.id").alias("span_id"))


def snapshot_events(old: DataFrame, new: DataFrame, *, keys: list[str], value: str, threshold: float | None = None, similarity=None) -> DataFrame:
    """``appeared``, ``disappeared``, ``changed`` or ``unchanged`` for each key."""
    a = old.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("was"))
    b = new.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("is"))
    joined = a.join(b, keys, "full_outer")
    event = (
        F.when(F.col("was").isNull(), "appeared").when(F.col("is").isNull(), "disappeared")
        .when(F.col("old_value").eqNullSafe(F.col("new_value")), "unchanged").otherwise("changed")
    )
    return joined.select(*keys, event.alias("event"))


def pair_evolution(old: DataFrame, new: DataFrame, *, threshold: float) -> DataFrame:
    """Events of pairs ``(a, b, similarity)``: diverged, converged, unchanged."""
    o, n = old.select("a", "b", F.col("similarity").alias("s0")), new.select("a", "b", F.col("similarity").alias("s1"))
    was, is_ = F.coalesce(F.col("s0") >= threshold, F.lit(False)), F.coalesce(F.col("s1") >= threshold, F.lit(False))
    event = F.when(was & ~is_, "diverged").when(~was & is_, "converged").otherwise("unchanged")
    return o.join(n, ["a", "b"], "full_outer").select("a", "b", event.alias("event"))


def duplicated_lines(instances: DataFrame) -> DataFrame:
    """Lines of a group's first instance times one less than its instances."""
    order = F.struct("file", "start_line")
    g = instances.groupBy("group_id").agg(F.min_by(F.col("end_line") - F.col("start_line") + 1, order).alias("lines"), F.count(F.lit(1)).alias("n"))
    return g.select("group_id", (F.col("lines") * (F.col("n") - 1)).alias("duplicated_lines"))


def number_clusters(instances: DataFrame) -> DataFrame:
    """Clusters by total lines, largest first, numbered from 1."""
    sums = instances.groupBy("cluster").agg(F.sum("lines").alias("total_lines"), F.count(F.lit(1)).alias("n"))
    order = sums.withColumn("__least", -F.col("total_lines"))
    return running_total(order, ["__least", "cluster"], F.lit(1), "rank").withColumn("rank", (F.col("rank") + 1).cast("int")).drop("__least")


def hash_groups(rows: DataFrame, key: str, *, least: int = 2) -> DataFrame:
    """Groups of equal ``key`` with at least ``least`` rows: ``(key, n, first_id)``."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).filter(F.col("n") >= least)


def sketch_summary(rows: DataFrame, *, key: str, value: str, by: str | None = None) -> DataFrame:
    """Approximate distinct keys, median and p99 of a value from mergeable sketches."""
    grouped = rows.groupBy(by) if by else rows.groupBy()
    return grouped.agg(
        F.hll_sketch_estimate(F.hll_sketch_agg(key)).alias("distinct"),
        F.expr(f"kll_sketch_get_quantile_double(kll_sketch_agg_double({value}), 0.5D)").alias("median"),
        F.expr(f"kll_sketch_get_quantile_double(kll_sketch_agg_double({value}), 0.99D)").alias("p99"),
    )


def heavy_hitters(rows: DataFrame, key: str, k: int = 100) -> DataFrame:
    """The exact top k with ties broken by key; partial counts first, then a bounded heap."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(k)


def similarity_order(pairs: DataFrame) -> DataFrame:
    """Pairs from most to least alike, equal ones by their ids."""
    return pairs.orderBy(F.desc("similarity"), "a", "b")


def distinct_sketches(grams: DataFrame, *, by: str = "doc_id", lg_k: int = 12) -> DataFrame:
    """``(by, theta, distinct)``: a mergeable theta sketch of each group's grams."""
    built = grams.groupBy(by).agg(F.expr(f"theta_sketch_agg(gram, {lg_k})").alias("theta"))
    return built.withColumn("distinct", F.expr("theta_sketch_estimate(theta)"))


def document_sketches(docs: DataFrame, *, k: int = 3, id_col: str = "doc_id", text_col: str = "text", lg_k: int = 12) -> DataFrame:
    """``(doc_id, words, grams, theta, distinct)``: how many distinct words and word k-grams each
    text has, and a theta sketch of its grams as ``distinct_sketches`` makes it, all inside its
    row, so that no gram moves. Texts without a gram are left out; rows of one id stay apart,
    and ``theta_union_agg`` merges their sketches."""
    text = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, size=GRAM_PART):
            row, hashes, words = distinct_grams(part.column("text"), k)
            n = np.bincount(row, minlength=len(part))
            made = [part.column("doc_id"), pa.array(words), pa.array(n), theta_sketches(row, hashes, len(part), lg_k)]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "words", "grams", "theta"]).filter(pa.array(n > 0))

    kind = text.schema["doc_id"].dataType.simpleString()
    built = text.mapInArrow(sketch, f"doc_id {kind}, words long, grams long, theta binary")
    return built.withColumn("distinct", F.expr("theta_sketch_estimate(theta)"))


#: Bytes of text whose grams are sketched at a time, or one text.
GRAM_PART = 2 << 20


def sketch_algebra(pairs: DataFrame, sketches: DataFrame, *, by: str = "doc_id") -> DataFrame:
    """Estimates ``(a, b, both, either, jaccard)`` for pairs of sketched groups, from the
    sketches alone."""
    left, right = sketches.select(F.col(by).alias("a"), F.col("theta").alias("s")), sketches.select(F.col(by).alias("b"), F.col("theta").alias("t"))
    sized = pairs.select("a", "b").join(left, "a").join(right, "b").select(
        "a", "b", F.expr("theta_sketch_estimate(theta_intersection(s, t))").alias("both"), F.expr("theta_sketch_estimate(theta_union(s, t))").alias("either")
    )
    return sized.withColumn("jaccard", F.when(F.col("either") > 0, F.col("both") / F.col("either")).otherwise(F.lit(0.0)))


def frequency_sketch(rows: DataFrame, key: str, *, eps: float = 0.01, confidence: float = 0.99, seed: int = 7) -> DataFrame:
    """One row with a count-min sketch (as binary) of a column's values; mergeable."""
    return rows.agg(F.count_min_sketch(F.col(key), F.lit(eps), F.lit(confidence), F.lit(seed)).alias("sketch"))
