"""MinHash near-duplicates: a chosen-path set similarity join.

Documents become sets of word shingles (64-bit hashes).  Equal sets are one *class*; all
that follows works on classes, so thousands of exact copies cost one row.

*Paths.*  Each class has a signature of minwise values, ``Config.coordinates`` in all.  A tree
starts with ``branch`` coordinates; a node is a (path, coordinate, value) and holds the classes
that have that value.  Nodes of one class end.  Nodes of at most ``small`` classes are leaves.
Larger nodes branch again by ``branch`` coordinates that the node itself selects from the
``level_choice`` that its tree has for the next level, up to ``depth``.  Every tree has
coordinates of its own on every level, so trees are independent.  With two branches a level, a
pair at similarity 0.8 that shares large nodes all the way down is missed by one tree with a
probability of 0.083, and by four trees with about 4.7e-5 (simulated, ``tests/llm``); pairs that
meet in a leaf before, or are nearer to each other, are missed less.  The comparison of
signatures adds less than 1e-7.  What is still large at ``depth`` is cut into blocks by hash,
and every two blocks of the node are compared, so no case is dropped.

*Leaves.*  Signatures of a leaf are compared exhaustively, and the connected parts of "at
least ``agree`` equal coordinates" go on as one group each.  Groups that overlap are joined up
to ``together`` classes.  Only their members' full sets are made, from whole texts, and
compared exactly inside the group; pairs that are already connected there are skipped.
Links found are the edges of the result's components, which are found by
large-star/small-star steps.

Defined results: words are maximal runs without ASCII white space, with A-Z lowered; a text
of fewer words than a shingle is one shingle, its whole sequence; texts without words and
null texts have the empty set, link with nothing and are kept; repeated rows share a class;
texts of any length are read whole; rows of one id with different texts are judged each by
itself; rows with a null id get a null component and are kept; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _base


@dataclass(frozen=True)
class Config:
    shingle: int = 5
    #: Similarity threshold as a fraction: intersection * below >= union * above.
    above: int = 80
    below: int = 100
    trees: int = 4
    branch: int = 2
    small: int = 2048
    depth: int = 5
    level_choice: int = 4
    #: Share of equal coordinates from which two signatures are candidates.
    agreeing: float = 0.5
    #: Candidates that hang together are compared in one task up to this many classes.
    together: int = 4096

    @property
    def coordinates(self) -> int:
        return self.trees * (self.branch + (self.depth - 1) * self.level_choice)

    @property
    def agree(self) -> int:
        return math.ceil(self.agreeing * self.coordinates)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False


def _odd(n: int, salt: int) -> np.ndarray:
    rng = np.random.default_rng(salt)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    out: list[np.ndarray] = []
    none = np.zeros(0, np.uint64)
    factor = _odd(k, 11)
    for first, last in _base.slices(offsets):
        piece = _LOWER[raw[offsets[first] : offsets[last]]]
        ends = offsets[first + 1 : last + 1] - offsets[first]
        starts = offsets[first:last] - offsets[first]
        solid = _SOLID[piece]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        inner = ends[(ends > 0) & (ends < len(piece))]
        begin[inner] = solid[inner]
        word = np.flatnonzero(begin)
        if not len(word):
            out += [none] * (last - first)
            continue
        at = np.arange(len(piece), dtype=np.int64)
        at -= np.repeat(np.concatenate([[0], word]), np.diff(np.concatenate([[0], word, [len(piece)]])))
        powers = np.full(int(at.max()) + 2, 0x9E3779B97F4A7C15, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        term = (piece.astype(np.uint64) + np.uint64(1)) * powers[at]
        term[~solid] = 0
        words = _mix(np.add.reduceat(term, word))
        mixed = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j in range(k):
            mixed += _mix(words[j : len(words) - k + 1 + j] * factor[j]) if len(mixed) else mixed
        mixed = _mix(mixed)
        lo, hi = np.searchsorted(word, starts), np.searchsorted(word, ends)
        for a, b in zip(lo.tolist(), hi.tolist()):
            if b - a >= k:
                out.append(np.unique(mixed[a : b - k + 1]))
            elif b > a:
                short = _mix(words[a:b] * factor[: b - a]).sum(dtype=np.uint64)  # the whole sequence
                out.append(_mix(np.array([short ^ np.uint64(0x5851F42D4C957F2D)], np.uint64)))
            else:
                out.append(none)
    return out


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Minwise values (len(sets) x n) of sets that are not empty."""
    if not sets:
        return np.zeros((0, n), np.uint64)
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), n), np.uint64)
    for j, (a, b) in enumerate(zip(_odd(n, 21), _odd(n, 22))):
        x = (flat ^ a) * b
        x ^= x >> np.uint64(32)
        x *= a
        out[:, j] = np.minimum.reduceat(x, starts)
    return out


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _describe(config: Config) -> Callable:
    """Rows (doc_id, text, text_key) to (doc_id, n_shingles, cid, sig, text_key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = _base.utf8(batch.column(1))
            for first, last in _base.slices(offsets, 4 * _base.SLICE_BYTES):
                sets = shingle_hashes(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], config.shingle)
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full, config.coordinates))
                cid = [_digest(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(cid, pa.binary()),
                        pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
                        batch.column(2).slice(first, last - first),
                    ],
                    ["doc_id", "n_shingles", "cid", "sig", "text_key"],
                )

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Batches of rows sorted by the column ``key``, cut so that no group is split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(key)
        last = column[batch.num_rows - 1]
        values = column.to_pylist() if pa.types.is_binary(column.type) else column.to_numpy(zero_copy_only=False)
        at, end = batch.num_rows - 1, last.as_py()
        while at > 0 and values[at - 1] == end:
            at -= 1
        if at == 0 and (not held or held[-1].column(key)[0].as_py() == end):
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch.slice(0, at)]) if at or held else None
        if at == 0:  # the group that was held has ended, this batch is all one new group
            table = pa.Table.from_batches(held)
        held = [batch.slice(at)]
        if table is not None and table.num_rows:
            yield table
    if held:
        yield pa.Table.from_batches(held)


def _bounds(values: list) -> list[int]:
    return [0, *[i for i in range(1, len(values)) if values[i] != values[i - 1]], len(values)]


def _parts(near: np.ndarray) -> np.ndarray:
    """Number of the connected part of each row of a symmetric boolean matrix."""
    part = np.full(len(near), -1)
    for i in range(len(near)):
        if part[i] >= 0:
            continue
        front = np.array([i])
        part[i] = i
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & (part < 0))
            part[front] = i
    return part


def _agreement(sig: np.ndarray) -> np.ndarray:
    """Number of equal coordinates of every two rows."""
    n = len(sig)
    out = np.zeros((n, n), np.int16)
    for j in range(sig.shape[1]):
        column = sig[:, j]
        out += column[:, None] == column[None, :]
    return out


def _leaf_groups(config: Config) -> Callable:
    """Rows (node, cid, sig) sorted by node to (gid, cids): what may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, 0):
            nodes = table.column("node").to_pylist()
            cids = table.column("cid").to_pylist()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint64).reshape(len(cids), -1)
            cut = np.array(_bounds(nodes))
            near = np.zeros(len(cut) - 1, bool)
            two = np.flatnonzero(np.diff(cut) == 2)
            near[two] = (sig[cut[two]] == sig[cut[two] + 1]).sum(axis=1) >= config.agree
            near[np.diff(cut) > 2] = True
            gids, groups = [], []
            for g in np.flatnonzero(near):
                a, b = int(cut[g]), int(cut[g + 1])
                part = np.zeros(2, int) if b - a == 2 else _parts(_agreement(sig[a:b]) >= config.agree)
                names, count = np.unique(part, return_counts=True)
                for r in names[count > 1]:
                    some = sorted(cids[a + x] for x in np.flatnonzero(part == r))
                    groups.append(some)
                    gids.append(hashlib.blake2b(b"".join(some), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(gids, pa.binary()), pa.array(groups, pa.list_(pa.binary()))], ["gid", "cids"])

    return run


def linked(sets: list[np.ndarray], config: Config) -> list[tuple[int, int]]:
    """Exact links that connect what is linked among a few sets (a spanning forest of it).

    Each set in turn is compared with all sets that are not yet connected with it and whose
    size allows a link; one pass over their shingles counts all intersections.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    part = np.arange(n)
    found: list[tuple[int, int]] = []
    for i in range(n):
        low, high = np.minimum(size, size[i]), np.maximum(size, size[i])
        rest = np.flatnonzero((part != part[i]) & (config.below * low >= config.above * high))
        if not len(rest):
            continue
        if len(rest) == 1:
            both = np.array([len(np.intersect1d(sets[i], sets[rest[0]], assume_unique=True))])
        else:
            flat = np.concatenate([sets[j] for j in rest])
            at = np.searchsorted(sets[i], flat)
            hit = sets[i][np.minimum(at, size[i] - 1)] == flat
            both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(size[rest])[:-1]]), dtype=np.int64)
        for j in rest[config.below * both >= config.above * (size[rest] + size[i] - both)]:
            if part[j] != part[i]:
                found.append((i, int(j)))
                part[part == part[j]] = part[i]
    return found


def _group_links(config: Config) -> Callable:
    """Rows (gid, cid, text) sorted by gid to links (a, b) of class ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, 0):
            gids, cids = table.column("gid").to_pylist(), table.column("cid").to_pylist()
            body = table.column("body")
            cut = _bounds(gids)
            left, right = [], []
            for a, b in zip(cut, cut[1:]):
                sets = [np.frombuffer(x.as_py(), np.uint64) for x in body[a:b]]
                for i, j in linked(sets, config):
                    left.append(cids[a + i])
                    right.append(cids[a + j])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return run


def _make_sets(config: Config) -> Callable:
    """Rows (cid, text) to (cid, body): the full set as bytes, where the text is one of the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = _base.utf8(batch.column(1))
            for first, last in _base.slices(offsets, 4 * _base.SLICE_BYTES):
                sets = shingle_hashes(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], config.shingle)
                right = [(c, s.tobytes()) for c, s in zip(batch.column(0).slice(first, last - first).to_pylist(), sets) if _digest(s) == c]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in right], pa.binary()) for k in (0, 1)], ["cid", "body"])

    return run


def _leaves(classes: DataFrame, config: Config) -> DataFrame:
    """(node, cid) of all leaves, after as many levels of branching as are needed."""
    value = lambda at: F.substring("sig", at * 8 + 1, F.lit(8))
    roots = config.trees * config.branch
    nodes = F.array(*[F.xxhash64(F.lit(t // config.branch), F.lit(t), value(F.lit(t))) for t in range(roots)])
    level = classes.select("cid", F.posexplode(nodes).alias("at", "node")).select("cid", F.floor(F.col("at") / config.branch).cast("int").alias("tree"), "node")
    leaves: DataFrame | None = None
    for depth in range(1, config.depth + 1):
        level = _base.materialize(level, f"nodes-{depth}")
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        sized = _base.materialize(level.join(sizes, "node"), f"sized-{depth}")
        leaf = sized.where(F.col("n") <= config.small).select("node", "cid")
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        large = sized.where(F.col("n") > config.small)
        if large.isEmpty():
            return leaves
        if depth == config.depth:
            return leaves.unionByName(_block_pairs(large, config))
        # The node selects `branch` different coordinates of those that its tree has on this level.
        span = config.level_choice
        base = roots + ((depth - 1) * config.trees + F.col("tree")) * span
        pick = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(span))
        step = 1 + F.pmod(F.xxhash64("node", F.lit(2)), F.lit(span - 1))
        chosen = F.explode(F.array(*[(F.pmod(pick + b * step, F.lit(span)) + base).cast("int") for b in range(config.branch)]))
        level = (
            large.select("node", "cid", "tree", chosen.alias("at"))
            .join(classes.select("cid", "sig"), "cid")
            .select("cid", "tree", F.xxhash64("node", "at", F.substring(F.col("sig"), F.col("at") * 8 + 1, F.lit(8))).alias("node"))
        )
    return leaves


def _block_pairs(large: DataFrame, config: Config) -> DataFrame:
    """Nodes that stay large: blocks of at most about half a leaf, and a leaf for every two."""
    blocks = F.ceil(F.col("n") / F.lit(config.small // 4)).cast("int")
    mine = F.pmod(F.xxhash64("cid", F.lit(3)), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    both = large.select("node", "cid", mine.alias("mine"), other.alias("other"))
    return both.select(F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("node"), "cid")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for links (a, b): root is the least node that can be reached.

    Alternating large-star and small-star steps; each is a join and an aggregation of the
    links, written to the shared folder, until a round changes nothing.
    """
    edges = _base.materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while True:
        twice = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = twice.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = twice.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = _base.materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        small = _base.materialize(small.select("e.*").where("u <> v").distinct(), "small-star")
        same = small.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        before = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        edges = small
        if same == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _gathered(groups: DataFrame, config: Config) -> DataFrame:
    """(gid, cid): the classes to compare with each other.

    Groups of different nodes that overlap are one if they have at most ``together`` classes,
    so that each full set is sent once; what hangs together beyond that stays in its groups.
    """
    members = groups.select("gid", F.explode("cids").alias("cid"))
    chain = groups.select(F.explode(F.slice("cids", F.lit(2), F.size("cids"))).alias("a"), F.get("cids", F.lit(0)).alias("b"))
    roots = _base.materialize(components(chain), "candidate-roots")
    whole = roots.select(F.col("node").alias("cid"), "root").unionByName(roots.select(F.col("root").alias("cid"), "root").distinct())
    sizes = whole.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    sized = _base.materialize(whole.join(sizes, "root"), "candidate-sizes")
    small = sized.where(F.col("n") <= config.together).select(F.col("root").alias("gid"), "cid")
    large = sized.where(F.col("n") > config.together).select("cid")
    return _base.materialize(small.unionByName(members.join(large, "cid").select("gid", "cid")), "members")


def find(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    return _found(docs, config).drop("text_key")


def _found(docs: DataFrame, config: Config) -> DataFrame:
    """What ``find`` gives, and the hash of the row's text."""
    with _base.scratch(docs.sparkSession):
        return _found_in(docs, config)


def _found_in(docs: DataFrame, config: Config) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    described = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    described = described.mapInArrow(_describe(config), f"doc_id {kind}, n_shingles long, cid binary, sig binary, text_key long")
    rows = _base.materialize(described, "shingle-sets")
    full = rows.where(F.col("cid").isNotNull())
    classes = _base.materialize(full.groupBy("cid").agg(F.min("doc_id").alias("least_id"), F.min("sig").alias("sig")), "classes")
    leaves = _leaves(classes, config).join(classes.select("cid", "sig"), "cid").select("node", "cid", "sig")
    found = leaves.repartition("node").sortWithinPartitions("node").mapInArrow(_leaf_groups(config), "gid binary, cids array<binary>")
    groups = _base.materialize(found.groupBy("gid").agg(F.first("cids").alias("cids")), "groups")
    members = _gathered(groups, config)
    needed = _base.materialize(members.select("cid").distinct().join(classes.select("cid", "least_id"), "cid"), "needed")
    texts = docs.select(F.col("doc_id"), "text").join(needed.hint("shuffle_hash"), docs["doc_id"] == needed["least_id"]).select("cid", "text")
    # A repeated id may bring a text that is not of the class: _make_sets drops it by its digest.
    sets = texts.mapInArrow(_make_sets(config), "cid binary, body binary")
    sized = members.join(sets, "cid").select("gid", "cid", "body")
    links = sized.repartition("gid").sortWithinPartitions("gid", "cid").mapInArrow(_group_links(config), "a binary, b binary")
    roots = components(links)
    named = classes.select("cid", "least_id").join(roots, F.col("cid") == F.col("node"), "left").select("cid", "least_id", F.coalesce("root", "cid").alias("root"))
    heads = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = _base.materialize(named.join(heads, "root").select(F.col("cid").alias("class"), "component_id"), "components")
    out = rows.select("doc_id", "n_shingles", "cid", "text_key").join(named, F.col("cid") == F.col("class"), "left")
    component = F.coalesce("component_id", "doc_id")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_key")
    return _base.materialize(out, "near-duplicate-rows", keep=1)


def keep_one(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """The rows of ``docs`` that their component keeps, with their own columns."""
    with _base.scratch(docs.sparkSession):
        gone = _found(docs, config).where(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__text_key")).distinct()
        gone = _base.materialize(gone, "near-duplicates", keep=1)
    return docs.join(gone, (docs["doc_id"] == gone["__gone"]) & (F.xxhash64(docs["text"]) == gone["__text_key"]), "left_anti")


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return find(_base.documents(spark, sf_dir), Config(shingle=4))


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
f AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i, len(w) AS n FROM w),
g AS (
  SELECT doc_id, i, n, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o) AS s
  FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, s FROM g WHERE i <= greatest(n - 3, 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
