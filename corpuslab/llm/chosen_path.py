"""MinHash near-dedup by a chosen-path set similarity join.

Every different shingle set is a class. A tree starts with a class choosing one of its minwise tokens, and the
classes that chose the same token share a node. A node that is small is compared exhaustively; in a larger
one each class chooses ``BRANCH`` further minwise tokens, which the node's path picks, and goes on to those nodes.
Two sets of similarity J part at the root with probability 1 - J, so ``TREES`` independent trees miss a
pair with (1 - J) ** TREES: under 3e-7 at 0.85.

What a node compares are sketches of 64 minwise bytes and set sizes: they tell which pairs may be links. Copies with
small changes would never part however deep a tree is, and all their pairs may be links, so a node gives on
only a spanning forest of those pairs, and a large one compares its classes with a pivot before it branches: those
near one pivot are a group, whose pairs need no more comparing, and groups that share a class in any node are one. The forests of all nodes make clusters, and every link
lies inside one. Links are then found on the full sets, which each task holds for a bounded part of a
cluster: again only a forest of them leaves a task. A cluster beyond one part is first compared with its
middle class; only the classes that it does not link are compared with all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import join_hot, small_batches, text_bytes
from corpuslab.llm.components import components, extended
from corpuslab.session import stage

SHINGLE, PERCENT = 3, 85
TREES, BRANCH, DEPTH = 8, 3, 8
TOKENS, SKETCH = 32, 64  # minwise tokens kept whole, for paths; minwise bytes, for comparing
LEAST_EQUAL = 38  # of 64 bytes: at similarity 0.85 fewer agree with a probability of about 1e-6
SMALL = 256
WHOLE = 16  # a node of up to so many parts of SMALL classes is compared in pairs of parts, without branching
PART = 512  # classes whose full sets a task compares with as many others
COLUMNS = 4096  # shingles counted at a time
WORDS_KEPT = 1_000_000

_SEEDS = np.random.default_rng(11)
_ODD = _SEEDS.integers(0, 1 << 63, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _SEEDS.integers(0, 1 << 63, SKETCH, np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_KNOWN: dict[bytes, int] = {}


def _hashed(words: list[bytes]) -> np.ndarray:
    if len(_KNOWN) > WORDS_KEPT:
        _KNOWN.clear()
    for w in set(words):
        if w not in _KNOWN:
            _KNOWN[w] = xxhash.xxh64_intdigest(w, 42)
    return np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the different word shingles; fewer words are one shingle, and none the empty set."""
    words = (text or b"").lower().split()  # bytes: only A-Z, and only \x20 \x09-\x0D
    if not words:
        return np.empty(0, np.uint64)
    size = min(shingle, len(words))
    h, n = _hashed(words), len(words) - size + 1
    with np.errstate(over="ignore"):
        x = np.full(n, size, np.uint64)
        for i in range(size):
            x = (x ^ (x >> np.uint64(29))) * _MIX[0] + h[i : i + n] * _MIX[1 + i % 2]
        x = (x ^ (x >> np.uint64(32))) * _MIX[2]
        return np.unique(x ^ (x >> np.uint64(29)))


def minwise(found: np.ndarray) -> np.ndarray:
    """The least value of each of ``SKETCH`` permutations."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(found), 2048):
            np.minimum(least, (found[i : i + 2048, None] * _ODD + _ADD).min(axis=0), out=least)
    return least


def _signatures(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, text) to (doc_id, key, c, n, tokens, sketch): c names the set, null if it is empty."""
    for b in small_batches(batches):
        sets = [shingle_set(t, shingle) for t in text_bytes(b, "text")]
        mins = [minwise(s) for s in sets]
        yield pa.record_batch([
            b.column(0), b.column(1),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([m[:TOKENS].view(np.int64) for m in mins], pa.list_(pa.int64())),
            pa.array([(m >> np.uint64(24)).astype(np.uint8).tobytes() for m in mins], pa.binary()),
        ], names=["doc_id", "key", "c", "n", "tokens", "sketch"])


def _near(n: np.ndarray, sketch: np.ndarray, percent: int) -> np.ndarray:
    """Whether each two rows may be a link."""
    equal = np.zeros((len(n), len(n)), np.uint8)
    for byte in np.ascontiguousarray(sketch.T):
        equal += byte[:, None] == byte
    return (equal >= LEAST_EQUAL) & (100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n))


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def _forest(near: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of ``near`` that join all that it connects, beyond what equal labels say."""
    for p in np.flatnonzero((near & (label[:, None] != label)).any(axis=1)):
        other = near[p] & (label != label[p])
        while other.any():
            q = int(other.argmax())
            yield q, int(p)
            label[label == label[q]] = label[p]
            other &= label != label[p]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first two columns, by which they come sorted."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        x, y = (t.column(i).combine_chunks() for i in (0, 1))
        x, y = ((c.to_numpy(zero_copy_only=False)) for c in (x, y))
        edges = [0, *(np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1).tolist()]
        for lo, hi in zip(edges, edges[1:]):
            yield t.slice(lo, hi - lo)
        rest = t.slice(edges[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _pairs(groups: Iterator[pa.Table], of: Callable[[pa.Table], Iterator[tuple[bytes, bytes]]]) -> Iterator[pa.RecordBatch]:
    found: list[tuple[bytes, bytes]] = []

    def batch() -> pa.RecordBatch:
        made = pa.record_batch([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["a", "b"])
        found.clear()
        return made

    for t in groups:
        if t.num_rows > 1:
            found += of(t)
        if len(found) > 4096:
            yield batch()
    yield batch()


def _labels(column: pa.ChunkedArray, names: list[bytes]) -> np.ndarray:
    return np.unique(np.array([(g or c).hex() for g, c in zip(column.to_pylist(), names)]), return_inverse=True)[1]


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, cell, c, n, sketch, grp, out) sorted by node and cell; a cell holds a bounded number of them.
    Pairs (a, b) that may be links, of different groups, one of them ``out``: a forest of them."""

    def pairs(t: pa.Table) -> Iterator[tuple[bytes, bytes]]:
        c = t.column("c").to_pylist()
        n, out = t.column("n").to_numpy(), t.column("out").to_numpy(zero_copy_only=False)
        sketch = _sketches(t.column("sketch").combine_chunks())
        near = _near(n, sketch, percent)
        near &= out[:, None] | out
        yield from ((c[x], c[y]) for x, y in _forest(near, _labels(t.column("grp"), c)))

    yield from _pairs(_groups(batches), pairs)


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share."""
    tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    often = np.bincount(at, minlength=len(tokens)) > 1
    place = np.cumsum(often) - 1
    row, at = row[often[at]], place[at[often[at]]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    both = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers, exact up to 2 ** 24 a block of columns
    total = np.zeros(both.shape, np.int64)
    for first in range(0, int(often.sum()), COLUMNS):
        lo, hi = np.searchsorted(at, (first, first + COLUMNS))
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[row[lo:hi], at[lo:hi] - first] = 1
        np.matmul(has, has.T, out=both)
        total += both.astype(np.int64)
    return total


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (root, cell, c, label, out, found) sorted by root and cell. Links (a, b) of different labels, one of them
    ``out``, by the full sets: a forest of them."""

    def links(t: pa.Table) -> Iterator[tuple[bytes, bytes]]:
        names = t.column("c").to_pylist()
        first = np.unique(np.array([x.hex() for x in names]), return_index=True)[1]  # a class may be on both sides
        t, names = t.take(first), [names[i] for i in first]
        sets = [np.frombuffer(x, np.uint64) for x in t.column("found").to_pylist()]
        size = np.array([len(x) for x in sets])
        out = t.column("out").to_numpy(zero_copy_only=False)
        both = _shared(sets)
        near = 100 * both >= percent * (size[:, None] + size - both)
        near &= out[:, None] | out
        yield from ((names[x], names[y]) for x, y in _forest(near, _labels(t.column("label"), names)))

    yield from _pairs(_groups(batches), links)


def _stars(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows with their node's pivot (pc, pn, psketch): those without a group that are near it join its group."""
    for b in batches:
        n, pn = (b.column(b.schema.get_field_index(x)).to_numpy() for x in ("n", "pn"))
        s, ps = (_sketches(b.column(b.schema.get_field_index(x))) for x in ("sketch", "psketch"))
        near = ((s == ps).sum(axis=1) >= LEAST_EQUAL) & (100 * np.minimum(n, pn) >= percent * np.maximum(n, pn))
        grp, pc = (b.column(b.schema.get_field_index(x)).to_pylist() for x in ("grp", "pc"))
        new = [p if g is None and x else g for g, p, x in zip(grp, pc, near.tolist())]
        star = [bool(g is None and x) for g, x in zip(grp, near.tolist())]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(new, pa.binary()), pa.array(star)], names=["node", "c", "grp", "star"])


def search(classes: DataFrame, percent: int, small: int) -> DataFrame:
    """(node, root) of the classes (c, n, tokens, sketch) that pairs that may be links connect, over all trees.

    A node is done where all its classes are of one group. It is small if at most ``small`` of its classes
    are outside its largest group: those are compared with each other and with the rest, in cells of about
    ``small`` of the rest each. One of at most ``WHOLE * small`` classes is compared in cells for each pair of parts.
    Others get a pivot and then branch; what is still larger after ``DEPTH`` branches is compared in pairs of parts too.
    What a turn's pivots and parts connect is added to what is known, and is not worked on again.
    """
    looks = classes.select("c", "n", "sketch")
    paths = F.transform(F.slice("tokens", 1, TREES), lambda t, i: F.xxhash64(i, t))
    rows = classes.select(F.explode(paths).alias("node"), "c", F.lit(None).cast("binary").alias("grp"))
    found: list[DataFrame] = []
    known: DataFrame | None = None
    for turn in range(2 * DEPTH + 1):
        open_rows = _open(rows)
        is_small = (F.col("m") <= small) | (F.col("outside") <= small)
        is_whole = ~is_small & ((F.col("m") <= WHOLE * small) | F.lit(turn == 2 * DEPTH))
        found.append(_cells(open_rows.where(is_small), looks, percent, small))
        whole = open_rows.where(is_whole)
        if not whole.isEmpty():
            # the parts by themselves first: what they connect, over all nodes, need not be told again by each pair of parts
            known = extended(known, _parts(whole, looks, percent, small, "within"))
            again = _open(_regrouped(whole.select("node", "c", "grp"), known))
            found += [_cells(again.where(F.col("outside") <= small), looks, percent, small),
                      _parts(again.where(F.col("outside") > small), looks, percent, small, "across")]
        large = open_rows.where(~is_small & ~is_whole)
        if large.isEmpty():
            break
        if turn % 2 == 0:
            seen = large.join(looks, "c")
            pivot = F.min(F.when(F.col("grp").isNull(), F.struct(F.xxhash64("c").alias("h"), "c", "n", "sketch"))).alias("p")
            pivots = seen.groupBy("node").agg(pivot)
            told = seen.join(pivots.select("node", F.col("p.c").alias("pc"), F.col("p.n").alias("pn"), F.col("p.sketch").alias("psketch")).where("pc is not null"), "node")
            told = told.select("node", "c", "grp", "n", "sketch", "pc", "pn", "psketch")
            starred = stage(told.mapInArrow(lambda b: _stars(b, percent), "node long, c binary, grp binary, star boolean"), "starred")
            without = large.join(pivots.where("p is null"), "node", "left_semi").select("node", "c", "grp")
            known = extended(known, starred.where("star and c <> grp").select(F.col("c").alias("a"), F.col("grp").alias("b")))
            # groups that stars of any node connect are one group in all nodes
            rows = stage(_regrouped(starred.select("node", "c", "grp").union(without), known), "merged")
        else:
            tokens = classes.select("c", "tokens")
            places = F.array_distinct(F.array(*(F.pmod(F.xxhash64("node", F.lit(k)), F.lit(TOKENS - TREES)) + TREES + 1 for k in range(BRANCH))))
            paired = large.select("node", "c", "grp").join(tokens, "c").withColumn("place", F.explode(places))
            child = F.xxhash64("node", "place", F.element_at("tokens", F.col("place").cast("int")))
            rows = paired.select(child.alias("node"), "c", "grp")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return extended(known, out)


def _open(rows: DataFrame) -> DataFrame:
    """Rows (node, c, grp) of nodes that are not of one group, with the node's size m, its largest group ``top`` and how
    many classes are ``outside`` of it."""
    by_group = rows.groupBy("node", "grp").agg(F.count(F.lit(1)).alias("m"))
    top = F.max(F.when(F.col("grp").isNotNull(), F.struct("m", "grp"))).alias("top")
    nodes = by_group.groupBy("node").agg(F.sum("m").alias("m"), top)
    nodes = nodes.select("node", "m", F.col("top.grp").alias("top"), (F.col("m") - F.coalesce("top.m", F.lit(0))).alias("outside"))
    return stage(rows.join(nodes.where("m > 1 and outside > 0"), "node"), "open")


def _regrouped(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (node, c, grp) with the groups of ``known`` (node, root)."""
    roots = known.select(F.col("node").alias("x"), "root")
    return rows.join(roots, F.col("c") == F.col("x"), "left").select("node", "c", F.coalesce("root", "grp").alias("grp"))


def _cells(rows: DataFrame, looks: DataFrame, percent: int, small: int) -> DataFrame:
    """A node's classes in cells: those outside its largest group in each, the others dealt out."""
    out = (F.col("m") <= small) | F.col("top").isNull() | ~F.col("grp").eqNullSafe(F.col("top"))
    cells = F.when(F.col("m") <= small, F.lit(1)).otherwise(F.ceil((F.col("m") - F.col("outside")) / small)).cast("int")
    mine = F.pmod(F.xxhash64("c"), cells).cast("int")
    cell = F.explode(F.when(out, F.sequence(F.lit(0), cells - 1)).otherwise(F.array(mine)))
    dealt = rows.select("node", "c", "grp", out.alias("out"), cell.alias("cell"))
    return _run_cells(dealt, looks, percent)


def _parts(rows: DataFrame, looks: DataFrame, percent: int, small: int, which: str = "all") -> DataFrame:
    """Every pair of parts of a node is a cell, so that no pair is left out and no cell is large; ``within``: only each
    part with itself; ``across``: only pairs of two. A node has parts of its own, so that those of several overlap."""
    parts = F.ceil(F.col("m") / small).cast("int")
    mine = F.pmod(F.xxhash64("node", "c"), parts).cast("int")
    others = F.array(mine) if which == "within" else F.sequence(F.lit(0), parts - 1)
    other = F.explode(F.array_remove(others, mine) if which == "across" else others)
    dealt = rows.select("node", "c", "grp", F.lit(True).alias("out"), mine.alias("mine"), parts.alias("parts"), other.alias("other"))
    cell = F.least("mine", "other") * F.col("parts") + F.greatest("mine", "other")
    return _run_cells(dealt.select("node", "c", "grp", "out", cell.alias("cell")), looks, percent)


def _run_cells(dealt: DataFrame, looks: DataFrame, percent: int) -> DataFrame:
    full = dealt.join(looks, "c").select("node", F.col("cell").cast("long").alias("cell"), "c", "n", "sketch", "grp", "out")
    ordered = full.repartition("node", "cell").sortWithinPartitions("node", "cell", F.xxhash64("c"))
    return ordered.mapInArrow(lambda b: _compare(b, percent), "a binary, b binary")


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches):
        made = [shingle_set(t, shingle).tobytes() for t in text_bytes(b, "text")]
        yield pa.record_batch([*b.columns[:3], pa.array(made, pa.binary())], names=["c", "root", "sketch", "found"])


def _star_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(c, root, found, pivot, pfound) to (c, root, found, label): the pivot where it is a link."""
    for b in small_batches(batches):
        label = []
        for c, x, p, y in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
            label.append(p if 100 * both >= percent * (len(x) + len(y) - both) else c)
        yield pa.record_batch([*b.columns[:3], pa.array(label, pa.binary())], names=["c", "root", "found", "label"])


def _pivots(members: DataFrame) -> DataFrame:
    """(root, pivot, pfound): of each cluster the class whose sketch agrees most with the commonest bytes. Any class
    gives the same components; this one leaves the fewest to be compared."""
    byte = [F.substring("sketch", i + 1, 1) for i in range(SKETCH)]
    middle = members.groupBy("root").agg(F.array(*(F.mode(x) for x in byte)).alias("middle"))
    agree = sum((F.when(x == F.col("middle")[i], 1).otherwise(0) for i, x in enumerate(byte)), F.lit(0))
    scored = members.join(middle, "root").select("root", "c", agree.alias("agree"))
    best = scored.groupBy("root").agg(F.max(F.struct("agree", "c")).alias("best")).select("root", F.col("best.c").alias("pivot"))
    return best.join(members.select(F.col("c").alias("pivot"), F.col("found").alias("pfound")), "pivot")


def confirm(members: DataFrame, percent: int, part: int) -> DataFrame:
    """Links (a, b), by the full sets, that connect each cluster's (c, root, sketch, found) classes as all its links do.

    A cluster of at most ``part`` classes is one cell. In a larger one the classes that the pivot does not link
    are dealt into parts, all classes into parts too, and each two parts are a cell.
    """
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    small = members.join(sizes.where(F.col("m") <= part), "root").select(
        "root", F.lit(0).cast("long").alias("cell"), "c", F.col("c").alias("label"), F.lit(True).alias("out"), "found")
    large = stage(members.join(sizes.where(F.col("m") > part), "root").select("c", "root", "sketch", "found"), "large")
    cells = small
    stars = None
    if not large.isEmpty():
        told = large.select("c", "root", "found").join(stage(_pivots(large), "pivots"), "root").select("c", "root", "found", "pivot", "pfound")
        told = stage(told.mapInArrow(lambda b: _star_links(b, percent), "c binary, root binary, found binary, label binary"), "stars")
        stars = told.where("c <> label").select(F.col("c").alias("a"), F.col("label").alias("b"))
        by = told.groupBy("root", "label").agg(F.count(F.lit(1)).alias("k"))
        counts = by.groupBy("root").agg(F.sum("k").alias("m"), F.count_if(F.col("k") == 1).alias("o"))
        parts, outs = F.ceil(F.col("m") / part).cast("int"), F.ceil(F.col("o") / part).cast("int")
        put = told.join(counts.where("o > 0"), "root").withColumns({"parts": parts, "outs": outs}).withColumns(
            {"mine": F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"), "mine_out": F.pmod(F.xxhash64("c", F.lit(1)), F.col("outs")).cast("int")})
        alone = F.col("c") == F.col("label")
        as_out = put.where(alone).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        as_any = put.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("outs") - 1)))
        cell = lambda out, any_: (out * F.col("parts") + any_).cast("long").alias("cell")
        cells = cells.union(as_out.select("root", cell(F.col("mine_out"), F.col("other")), "c", "label", F.lit(True), "found"))
        cells = cells.union(as_any.select("root", cell(F.col("other"), F.col("mine")), "c", "label", alone, "found"))
    ordered = cells.repartition("root", "cell").sortWithinPartitions("root", "cell")
    links = ordered.mapInArrow(lambda b: _confirm(b, percent), "a binary, b binary")
    return links if stars is None else links.union(stars)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT, small: int = SMALL, part: int = PART) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    component_id is the smallest doc_id reachable over links, itself included; sets link if
    ``100 * intersection >= percent * union``, by 64-bit hashes of whole shingles. Texts of one set are one
    class, linked. Null, empty and wordless texts have no shingle and link with nothing. Rows with a null
    doc_id link their neighbours, are never kept, and get a null component_id only where the whole component has
    no doc_id. Repeated rows share a class, and all with the smallest doc_id are kept. An empty table gives an empty result; other columns
    are ignored, whatever they are called.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("key"),
                     F.col(text_col).cast("string").alias("text"))
    kinds = "doc_id long, key binary, c binary, n long, tokens array<long>, sketch binary"
    rows = stage(docs.mapInArrow(lambda b: _signatures(b, shingle), kinds), "signatures")
    classes = stage(rows.where("c is not null").groupBy("c").agg(
        F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("rows"), F.min("key").alias("key"),
        F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")), "classes")

    clusters = search(classes.select("c", "n", "tokens", "sketch"), percent, small)
    wanted = clusters.select(F.col("node").alias("c"), "root").join(classes.select("c", "key", "sketch"), "c")
    texts = docs.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key").select("c", "root", "sketch", "text")
    members = stage(texts.mapInArrow(lambda b: _sets(b, shingle), "c binary, root binary, sketch binary, found binary"), "members")
    roots = components(confirm(members, percent, part))

    rooted = classes.join(roots, F.col("c") == F.col("node"), "left").select("c", "rows", "least_id", F.coalesce("root", "c").alias("root"))
    rooted = stage(rooted, "rooted")
    tops = stage(rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("classes")), "tops")
    named = join_hot(rooted.select("c", "rows", "root"), tops, "root", "classes", "c").select("c", "rows", "component_id")
    linked = join_hot(rows.where("c is not null").select("doc_id", "n", "c"), stage(named, "named"), "c", "rows", "doc_id").select("doc_id", "n", "component_id")
    alone = rows.where("c is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
