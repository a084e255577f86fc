"""Near-duplicate documents: banded SetSketch registers give candidates, their joint likelihood estimate thins them, full shingle sets confirm, and links are joined into components.

Equal sets are one class from the start, so copies cost one row each. In a bucket only its smallest class is tried first
(hub); classes that are in one component need no further test; what is left in buckets of several components is compared
in blocks of bounded size, where the sets themselves lie and only links come out; a large bucket's largest component is not
compared with itself. No step lists all pairs of a group,
and no bucket is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import sketches as S
from tidemark.llm.common import checkpointed, discard, importable, map_texts, slices

SHINGLE_WORDS, PERCENT = 5, 80
#: How far below the threshold a likelihood estimate may lie; its standard deviation is 0.032.
SLACK = 0.13
#: Classes along the side of a block, and shingles of all of them together.
BLOCK, BLOCK_SHINGLES = 1024, 4_000_000
#: So many of the best candidates between two components go first; the others follow where these have not joined them.
FIRST_TRIES = 3
#: At most so many ids of texts, or buckets, are broadcast to join the table or the members; more are joined by a shuffle.
MOST_BROADCAST = 500_000


def set_key(h: np.ndarray) -> bytes:
    """16 bytes that stand for a set of shingles."""
    return np.array([h.sum(dtype=np.uint64), np.bitwise_xor.reduce(S.mixed(h * np.uint64(3)))], np.uint64).tobytes()


def whole_ids(docs: DataFrame, id_col: str) -> bool:
    return docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")


def numbered(docs: DataFrame, id_col: str) -> Column:
    """The id as a whole number: itself, or the hash of one of another type."""
    c = F.col(f"`{id_col}`")
    return c.cast("long") if whole_ids(docs, id_col) else F.when(c.isNotNull(), F.xxhash64(c))


def sketched(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, n, key (16 bytes that stand for the set; null for an empty one), sketch."""

    def step(texts):
        out = []
        for t in texts:
            h = S.shingles(t, size)
            if len(h):
                out.append((len(h), set_key(h), S.sketch(h).tobytes()))
            else:
                out.append((0, None, None))
        return [list(c) for c in zip(*out)]

    return map_texts(docs.select(numbered(docs, id_col).alias("id"), F.col(text_col).alias("text")), ["id"], "text", {"n": "bigint", "key": "binary", "sketch": "binary"}, step)


def banded(classes: DataFrame) -> DataFrame:
    """(bucket, cid, n) of every band."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                regs = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(part.num_rows, S.REGISTERS)
                buckets = S.bands(regs).view(np.int64).ravel()
                cids, sizes = (pa.array(np.repeat(part.column(c).to_numpy(), S.BANDS)) for c in (0, 2))
                yield pa.RecordBatch.from_arrays([pa.array(buckets), cids, sizes], names=["bucket", "cid", "n"])

    return classes.select("cid", "sketch", "n").mapInArrow(run, "bucket bigint, cid bigint, n bigint")


def likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(a, b, weight) whose estimate reaches `least`."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                p = b.slice(at, 2000)
                s = [np.frombuffer(b"".join(p.column(c).to_pylist()), "<u2").reshape(p.num_rows, S.REGISTERS) for c in ("s_a", "s_b")]
                est = S.joint_similarity(*s, *[p.column(c).to_numpy() for c in ("n_a", "n_b")])
                out = pa.RecordBatch.from_arrays([p.column("a"), p.column("b"), p.column("weight")], names=["a", "b", "weight"])
                yield out.filter(pa.array(est >= least))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "weight", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a bigint, b bigint, weight bigint")


def picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of a written table of distinct ids."""
    return docs.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "id")


def texts_of(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text) of the documents in the pairs."""
    ids = checkpointed(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    out = checkpointed(picked(docs, ids))
    discard(ids)
    return out


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, as a written table. docs: id, text."""
    texts = texts_of(pairs, docs)
    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"t_{x}"))

    def run(batches):
        known: dict[int, tuple] = {}  # of the hubs met last

        def of(i, t):
            if (hit := known.get(i)) is None or hit[0] != t:
                if len(known) > 64:
                    known.clear()
                hit = known[i] = (t, S.shingles(t, size))
            return hit[1]

        for batch in batches:
            for p in slices(batch, 2):
                keep = []
                for a, b, ta, tb in zip(*(c.to_pylist() for c in p.columns)):
                    x, y = of(a, ta), of(b, tb)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
                yield pa.RecordBatch.from_arrays(p.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = checkpointed(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b").mapInArrow(run, "a bigint, b bigint").distinct())
    discard(texts)
    return out


def twice(hook: DataFrame) -> DataFrame:
    """Pointers (r, p) that go on to where p points."""
    up = hook.select(F.col("r").alias("p"), F.col("p").alias("pp"))
    return hook.join(up, "p", "left").select("r", F.coalesce("pp", "p").alias("p"))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes with an edge (a, b); comp is the least node that can be reached.

    Each round hooks every component on its least neighbour, doubles the pointers four times and contracts the edges; what the
    pointers have not reached yet stays as an edge between components, so the result does not depend on their depth.
    """
    live = checkpointed(edges.filter("a <> b").distinct())
    nodes = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
    labels = checkpointed(nodes.withColumn("comp", F.col("node")))
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        hook = checkpointed(both.groupBy(F.col("a").alias("r")).agg(F.min("b").alias("m")).select("r", F.least("r", "m").alias("p")))
        for _ in range(2):
            shallow, hook = hook, checkpointed(twice(twice(hook)))
            discard(shallow)
        to = lambda x: hook.select(F.col("r").alias(x), F.col("p").alias(f"new_{x}"))
        old = (labels, live)
        labels = checkpointed(labels.join(to("comp"), "comp", "left").select("node", F.coalesce("new_comp", "comp").alias("comp")))
        live = checkpointed(live.join(to("a"), "a").join(to("b"), "b").select(F.col("new_a").alias("a"), F.col("new_b").alias("b")).filter("a <> b").distinct())
        discard(*old, hook)
    discard(live)
    return labels


def labelled(rows: DataFrame, labels: DataFrame, node: str, into: str) -> DataFrame:
    """Adds the component of a node; a node without links is one of its own."""
    own = labels.select(F.col("node").alias(node), F.col("comp").alias("__comp"))
    return rows.join(own, node, "left").withColumn(into, F.coalesce("__comp", node)).drop("__comp")


def largest(members: DataFrame) -> DataFrame:
    """bucket, major: number of classes, name and number of shingles of its largest component. members: bucket, cid, n, comp."""
    parts = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n"))
    return parts.groupBy("bucket").agg(F.max(F.struct("classes", "comp", "n")).alias("major"))


def arranged(members: DataFrame, major: DataFrame) -> DataFrame:
    """Adds how a bucket (bucket, cid, n, comp; its size and n_all) is cut into blocks. major: what largest() gives, written.

    Classes of its largest component need no comparison among themselves. Where the bucket is larger than a block, only the others
    (`minor`, dealt over `blocks`) meet each other, and each meets all of the largest component (dealt over `tail`), so the work
    grows with the product of both and not with the square of the bucket.
    """
    if major.count() <= MOST_BROADCAST:  # else a large bucket is one key of a shuffle, which adaptive execution splits
        major = F.broadcast(major)
    blocks = lambda classes, n: F.ceil(F.greatest(classes / BLOCK, n / BLOCK_SHINGLES)).cast("bigint")
    whole = blocks(F.col("size"), F.col("n_all")) <= 1
    return members.join(major, "bucket").select(
        "bucket", "cid", "comp",
        (whole | (F.col("comp") != F.col("major.comp"))).alias("minor"),
        F.when(whole, 1).otherwise(blocks(F.col("size") - F.col("major.classes"), F.col("n_all") - F.col("major.n"))).alias("blocks"),
        F.when(whole, 0).otherwise(blocks(F.col("major.classes"), F.col("major.n"))).alias("tail"),
    )


def placed(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of all blocks, sorted by block. members: what arranged() gives."""
    deal = lambda n: F.pmod(F.xxhash64("cid"), n)
    own = members.withColumn("mine", F.when(F.col("minor"), deal(F.col("blocks"))).otherwise(F.col("blocks") + deal(F.col("tail"))))
    # a class stands in the row of its block, as a, and in the column, as b; blocks (i, j) with i <= j and i a minor one hold all pairs
    last = F.col("blocks") - 1 + F.when(F.col("minor"), F.col("tail")).otherwise(0)
    grid = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    at = grid.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "cid", "comp")
    return by_block(at.join(classes.select("cid", "n", "key", "sketch"), "cid"))


def by_block(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*PLACED, *more).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


#: Columns of a row in a block; the first three name the block.
PLACED = ["bucket", "i", "j", "mine", "cid", "comp", "n", "key", "sketch"]


class Block:
    """The classes of one block, and which of them may be linked though their components differ."""

    def __init__(self, key: tuple, cols: list[list[pa.Array]]):
        self.bucket, self.i, self.j = key
        self.arrays = [pa.concat_arrays(c) for c in cols]
        self.mine, self.cid, comp, self.n = (c.to_numpy() for c in self.arrays[:4])
        self.root = comp.copy()
        self.regs = np.frombuffer(b"".join(self.arrays[5].to_pylist()), "<u2").reshape(len(self.cid), S.REGISTERS)

    def join(self, k: int, o: int) -> None:
        self.root[self.root == self.root[o]] = self.root[k]

    def candidates(self, least: float) -> Iterator[tuple[int, np.ndarray]]:
        """For a class, the others of the other side and of components other than its own whose estimate reaches `least`, the best first."""
        left = np.flatnonzero(self.mine == self.i)
        right = left if self.i == self.j else np.flatnonzero(self.mine == self.j)
        regs, keys = self.regs, S.bands(self.regs).view(np.int64)
        for k in left.tolist():
            others = right[(self.root[right] != self.root[k]) & ((right > k) | (self.i != self.j))]
            if len(others):
                others = others[(regs[others] == regs[k]).sum(1) >= (least - 0.15) * S.REGISTERS]
            if len(others):  # a pair is looked at in the first bucket that it shares
                others = others[keys[k][(keys[others] == keys[k]).argmax(1)] == self.bucket]
            if len(others):
                est = S.joint_similarity(np.broadcast_to(regs[k], (len(others), S.REGISTERS)), regs[others], np.full(len(others), self.n[k]), self.n[others])
                order = np.argsort(-est, kind="stable")
                if len(others := others[order][est[order] >= least]):
                    yield k, others


def promising(rows: DataFrame, least: float) -> DataFrame:
    """The rows of blocks that have a candidate there."""

    def run(batches):
        for key, cols in groups(batches, 3):
            block = Block(key, cols)
            hit = np.zeros(len(block.cid), bool)
            for k, others in block.candidates(least):
                hit[k] = hit[others] = True
            if hit.any():
                same = [pa.array(np.full(len(hit), x)) for x in key]
                yield pa.RecordBatch.from_arrays([*same, *block.arrays], names=PLACED).filter(pa.array(hit))

    return rows.mapInArrow(run, rows.schema)


def linked_in_blocks(members: DataFrame, classes: DataFrame, docs: DataFrame, least: float, size: int, percent: int) -> DataFrame:
    """Links (a, b) that join all components which any link within a bucket joins, as a written table; at most one a class and block comes out.

    The sets of the classes with candidates are computed once and brought to their blocks, not to pairs.
    """
    rows = checkpointed(promising(placed(members, classes), least))
    ids = checkpointed(rows.select(F.col("cid").alias("id")).distinct())

    def sets(texts):
        found = [S.shingles(t, size) for t in texts]
        return [[set_key(h) if len(h) else None for h in found], [h.tobytes() for h in found]]

    hashed = map_texts(picked(docs, ids), ["id"], "text", {"key": "binary", "hashes": "binary"}, sets).dropDuplicates(["id", "key"])
    full = rows.join(hashed.withColumnRenamed("id", "cid"), ["cid", "key"])

    def run(batches):
        for key, cols in groups(batches, 3):
            block, links = Block(key, cols), []
            sets = block.arrays[6]
            of = lambda k: np.frombuffer(sets[k].as_buffer(), np.uint64)  # noqa: E731, B023
            for k, others in block.candidates(least):
                x = of(k)
                for o in others.tolist():
                    if block.root[o] != block.root[k]:
                        y = of(o)
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        if 100 * both >= percent * (len(x) + len(y) - both) and both:
                            links.append((k, o))
                            block.join(k, o)
            if links:
                a, b = (block.cid[list(c)] for c in zip(*links))
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    out = checkpointed(by_block(full, "hashes").mapInArrow(run, "a bigint, b bigint"))
    discard(rows, ids)
    return out


def groups(batches, keys: int) -> Iterator[tuple[tuple, list[list[pa.Array]]]]:
    """Runs of rows with equal first columns out of sorted batches: (key, parts of each other column)."""
    now, held = None, None
    for b in batches:
        if not b.num_rows:
            continue
        ks = [c.to_numpy() for c in b.columns[:keys]]
        change = np.zeros(b.num_rows, bool)
        change[0] = True
        for k in ks:
            change[1:] |= k[1:] != k[:-1]
        cuts = [*np.flatnonzero(change).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            key = tuple(int(k[s]) for k in ks)
            part = [c.slice(s, e - s) for c in b.columns[keys:]]
            if key == now:
                for h, p in zip(held, part):
                    h.append(p)
            else:
                if now is not None:
                    yield now, held
                now, held = key, [[p] for p in part]
    if now is not None:
        yield now, held


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row a document: id, n_shingles, component_id (the least id that links reach, itself included) and kept (id = component_id).

    Documents are linked when 100 * common >= percent * all distinct shingles of both. A null text or one without words has
    no shingles and no links. Rows that repeat an id are one document, whose texts' links all count; each keeps its row. A
    null id is linked with nothing: component_id is null, and the row is kept. Ids may be of any type that has an order. An
    empty table gives no rows. The result reads tables in the shared folder that only its reader can know to be done with:
    one row a document, one a class and one a linked class; who owns the folder deletes them.
    """
    importable(docs.sparkSession)
    least = percent / 100 - SLACK
    base = checkpointed(sketched(docs, id_col, text_col, size))
    texts = docs.select(numbered(docs, id_col).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    named = base.filter(F.col("id").isNotNull() & F.col("key").isNotNull())
    classes = checkpointed(named.groupBy("key").agg(F.min("id").alias("cid"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))

    members = checkpointed(banded(classes))
    hubs = members.groupBy("bucket").agg(F.min("cid").alias("hub"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("n_all")).filter("size > 1")
    shared = members.join(hubs, "bucket").filter("cid <> hub")
    pairs = checkpointed(shared.groupBy(F.col("cid").alias("a"), F.col("hub").alias("b")).agg(F.count(F.lit(1)).alias("weight"), F.min("size").alias("size")))

    # first the hub that shares most bands with each class
    best = pairs.groupBy("a").agg(F.max(F.struct("weight", (-F.col("b")).alias("nb"))).alias("m")).select("a", (-F.col("m.nb")).alias("b"), "m.weight")
    first = checkpointed(likely(best, classes, least))
    sure = confirmed(first, texts, size, percent)
    labels = components(sure)
    discard(first, sure)

    def grown(links: DataFrame) -> None:
        """Joins the components that the links lie between."""
        nonlocal labels
        if links.isEmpty():
            return
        between = labelled(labelled(links, labels, "a", "ca"), labels, "b", "cb")
        joined = components(between.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        new = joined.join(labels.select("node"), "node", "left_anti")
        old = labels
        labels = checkpointed(labelled(labels.withColumnRenamed("comp", "was"), joined, "was", "comp").select("node", "comp").union(new.select("node", "comp")))
        discard(old, joined)

    def crossing() -> DataFrame:
        return labelled(labelled(pairs, labels, "a", "ca"), labels, "b", "cb").filter("ca <> cb")

    # then the other hubs, a few between any two components
    between = Window.partitionBy("ca", "cb").orderBy(F.desc("weight"), "a", "b")
    some = crossing().withColumn("k", F.row_number().over(between)).filter(F.col("k") <= FIRST_TRIES)
    second = checkpointed(likely(some.select("a", "b", "weight"), classes, least))
    sure = confirmed(second, texts, size, percent)
    grown(sure)
    discard(second, sure)

    # and all that is left: buckets of two classes have one pair, that with the hub; members of larger ones that lie in several components meet in blocks
    rows = labelled(members.join(hubs.filter("size > 2").select("bucket", "size", "n_all"), "bucket"), labels, "cid", "comp")
    mixed = rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket")
    unsettled = checkpointed(rows.join(mixed, "bucket"))
    major = checkpointed(largest(unsettled))
    two = checkpointed(likely(crossing().filter("size = 2").select("a", "b", "weight"), classes, least))
    inside, outside = linked_in_blocks(arranged(unsettled, major), classes, texts, least, size, percent), confirmed(two, texts, size, percent)
    grown(inside.union(outside))
    discard(unsettled, major, two, inside, outside)

    # rows of one id with several texts are one document: their classes are linked
    several = checkpointed(base.filter("id IS NOT NULL").groupBy("id").agg(F.min(F.xxhash64("key")).alias("lo"), F.max(F.xxhash64("key")).alias("hi")).filter("lo <> hi").select("id"))
    repeated = not several.isEmpty()
    if repeated:
        own = checkpointed(named.join(several, "id").select("id", "key").distinct().join(classes.select("key", "cid"), "key").select("id", "cid"))
        grown(own.join(own.groupBy("id").agg(F.min("cid").alias("b")), "id").select(F.col("cid").alias("a"), "b").filter("a <> b"))

    discard(members, pairs)
    of_class = labelled(classes.select("key", "cid"), labels, "cid", "component").select("key", "component")
    out = base.join(of_class, "key", "left")
    if repeated:  # a text without words has no class, but its id may have one
        same = out.join(several, "id").groupBy("id").agg(F.min("component").alias("same"))
        out = out.join(same, "id", "left").withColumn("component", F.coalesce("same", "component"))
    out = out.select("id", "n", F.coalesce("component", "id").alias("component"))
    if whole_ids(docs, id_col):
        kind = docs.schema[id_col].dataType
        return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("component")).cast(kind).alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
    return renamed(checkpointed(out), docs, id_col)


def renamed(out: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """The result with ids of the documents' own type in place of their hashes; two ids of one hash are an error, as they would be one document."""
    own = F.col(f"`{id_col}`")
    names = checkpointed(docs.filter(own.isNotNull()).groupBy(numbered(docs, id_col).alias("id")).agg(F.min(own).alias("name"), F.max(own).alias("other")))
    if not names.filter("name <> other").isEmpty():
        raise ValueError(f"two values of {id_col} have one hash")
    least = out.join(names, "id").groupBy("component").agg(F.min("name").alias("least"))
    full = out.join(names.select("id", "name"), "id", "left").join(least, "component", "left")
    return full.select(F.col("name").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("name").isNotNull(), F.col("least")).alias("component_id"), F.coalesce(F.col("name") == F.col("least"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents without those that another document of their group stands for; all columns stay.

    Null texts and null ids stay, rows that repeat an id stay or go together, an empty table stays empty.
    """
    found = near_duplicates(docs, id_col, text_col, size, percent)
    return docs.join(found.filter(~F.col("kept")).select(id_col).distinct(), id_col, "left_anti").select(*docs.columns)


def sql(size: int, percent: int) -> str:
    """The result by brute force over all shingles, in DuckDB's SQL."""
    leads = " || ".join(["w", *(f"' ' || lead(w, {i}) OVER t" for i in range(1, size))])
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM d WHERE len(ws) >= {size}),
s AS (
  SELECT DISTINCT doc_id, hash(g) AS g FROM (SELECT doc_id, {leads} AS g FROM w WINDOW t AS (PARTITION BY doc_id ORDER BY i)) WHERE g IS NOT NULL
  UNION SELECT doc_id, hash(array_to_string(ws, ' ')) FROM d WHERE len(ws) BETWEEN 1 AND {size - 1}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY 1) m USING (doc_id)"""
