"""N-gram Jaccard join by a token-group matrix.

Documents are shingle sets.  Similar documents are put into groups of bounded
size; a group is known by the union of its members' tokens, and only groups whose
union holds enough of a document's tokens are opened and compared exactly.

1. A fixed-size table of token counts over all documents orders tokens from rare
   to frequent.  By the prefix principle, of two sets that are similar enough the
   ``n - o + extra`` rarest tokens (``o``: the overlap that a set of n tokens needs)
   have ``extra`` in common, so only those tokens are dealt out.
2. Every document goes to the group of the leader with which it shares most such
   tokens; the leader is in all slices of its group.  Within a slice all members
   are compared.  A second round takes the best linked documents as leaders.
3. Groups of the resulting components, and of what is still single, become rows
   of the token-group matrix: a document that has too few of its dealt tokens in a
   group's union cannot link with a member.  Groups for which documents of each
   other qualify are opened, and those documents compared, again after a bound by
   the unions of all their tokens.  Groups of one component need no comparison.

Every step that leaves pairs out does so by a bound, so no link is lost.
Documents with equal sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .mixing import WORD
from .tables import hot_join, hot_keys, scratch, stored, unused
from .wordhash import Words, mix, shingle_sets, slices

_BITS = 20  # of the count table: a million counters, whatever the input
_CHUNK = 1 << 14
_EXTRA = 8
_MEMBERS, _TOKENS = 200, 300_000  # of a slice
_SLICE = 2 << 20


def _keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set, 0 for empty ones."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(values + np.uint64(0x632BE59BD9B4E019)), dtype=np.uint64)])
    size = np.diff(bounds).astype(np.uint64)
    return np.where(size > 0, mix(sums[bounds[1:]] - sums[bounds[:-1]] + mix(size)), np.uint64(0))


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for piece in slices(batches, "_text", _SLICE):
        yield piece, *shingle_sets(Words(piece.column("_text"), lower=True), width)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _fresh(keys: np.ndarray, seen: set[int]) -> list[int]:
    """Places of the keys that this task has not met: copies are counted before they are shuffled."""
    out = []
    for i, k in enumerate(keys.tolist()):
        if k and k not in seen:
            seen.add(k)
            out.append(i)
    return out


def token_classes(docs: DataFrame, width: int) -> np.ndarray:
    """log2 of how many of all documents' tokens fall on each counter: an order of tokens from rare to frequent."""
    chunks = (1 << _BITS) // _CHUNK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _BITS, dtype=np.int64)
        for _, values, _ in _sets(batches, width):
            total += np.bincount((values >> np.uint64(64 - _BITS)).astype(np.int64), minlength=1 << _BITS)
        part = TaskContext.get().partitionId() % 256
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(chunks, dtype=np.int32)), pa.array(np.full(chunks, part, dtype=np.int32)), pa.array([total[i * _CHUNK : (i + 1) * _CHUNK].tobytes() for i in range(chunks)], pa.binary())], names=["chunk", "part", "counts"]
        )

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(_CHUNK, dtype=np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_py(), dtype=np.int64)
        return pa.table({"chunk": table.column("chunk")[:1], "part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "chunk int, part int, counts binary"
    sums = docs.select("_text").mapInArrow(count, kind).groupBy("chunk", "part").applyInArrow(add, kind).groupBy("chunk").applyInArrow(add, kind)
    total = np.zeros(1 << _BITS, dtype=np.int64)
    for row in sums.collect():  # of the table's fixed size
        total[row.chunk * _CHUNK : (row.chunk + 1) * _CHUNK] = np.frombuffer(row.counts, dtype=np.int64)
    return np.ceil(np.log2(total + 1)).astype(np.uint8)


def _needed(n: Column, num: int, den: int) -> Column:
    """The overlap that a set of ``n`` tokens needs: the least integer of at least ``n * num / den``."""
    return F.ceil(n * num / F.lit(den).cast("double") - 1e-9)


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """``(id_col, n_shingles, component_id)``, one row per row of ``df``.

    Words are lower-cased (A to Z) and parted by blanks; a document is the set of
    its ``width``-word shingles, or of its whole sequence if it has fewer words.
    Documents link if ``den * intersection >= num * union``; ``component_id`` is the
    smallest id that links reach, the own one included.

    Null and empty texts have no set and link with nothing: 0 and the own id.
    Rows without an id link with nothing either and have a null component.
    Repeated rows and equal texts are linked; rows of one id are judged by their
    own texts.  Other columns are not read; an empty table stays empty.

    Sets and tokens are compared by 64-bit fingerprints.  ``df`` is read four
    times, so pass a scan or a stored table.  The result is a stored table; what
    was stored on the way is deleted.
    """
    with scratch(df.sparkSession) as keep:
        return keep(stored(_similar(df, id_col, text_col, width, num, den)))


def _similar(df: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> DataFrame:
    docs = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    named = docs.filter("_id is not null")
    classes = token_classes(named, width)

    def node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, values, bounds in _sets(batches, width):
            yield pa.RecordBatch.from_arrays([piece.column("_id"), pa.array(np.diff(bounds).astype(np.int64)), _signed(_keys(values, bounds))], names=["_id", "n", "node"])

    def prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, values, bounds in _sets(batches, width):
            keys, tokens, nodes, sizes = _keys(values, bounds), [], [], []
            order = (classes[(values >> np.uint64(64 - _BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (values >> np.uint64(8))
            for i in _fresh(keys, seen):
                a, b = int(bounds[i]), int(bounds[i + 1])
                n = b - a
                own = min(n, n - -(-num * n // den) + _EXTRA)
                pick = np.argpartition(order[a:b], own - 1)[:own] if own < n else slice(None)
                tokens.append(values[a:b][pick])
                nodes.append(np.full(own, keys[i]))
                sizes.append(np.full(own, n, dtype=np.int32))
            if tokens:
                t = np.concatenate(tokens)
                rank = classes[(t >> np.uint64(64 - _BITS)).astype(np.int64)].astype(np.int32)
                node = np.concatenate(nodes)
                salt = (mix(node) % (np.uint64(1) << np.maximum(rank - 16, 0).astype(np.uint64))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([_signed(t), pa.array(salt), pa.array(rank > 16), _signed(node), pa.array(np.concatenate(sizes))], names=["token", "salt", "hot", "node", "n"])

    def text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for piece, values, bounds in _sets(batches, width):
            keys = _keys(values, bounds)
            take = np.array(_fresh(keys, seen), dtype=np.int64)
            packed = [zstandard.compress(t.as_buffer(), 3) for t in piece.column("_text").take(pa.array(take))]
            yield pa.RecordBatch.from_arrays([_signed(keys[take]), pa.array(packed, pa.binary())], names=["node", "_zip"])

    mine = stored(named.mapInArrow(node_rows, "_id long, n long, node long"))
    # tokens that one node alone has lead nowhere; a token so frequent that it is salted is shared for certain
    each = Window.partitionBy("token", "salt")
    prefix = named.select("_text").mapInArrow(prefix_rows, "token long, salt int, hot boolean, node long, n int")
    prefix = prefix.withColumns({"lead": F.min("node").over(each), "tail": F.max("node").over(each)}).filter("lead <> tail or hot")
    with scratch(df.sparkSession) as keep:  # of the first table nothing is needed later
        prefix = keep(stored(_dense(stored(prefix.select("token", "node", "n")), num, den)))
    nodes = prefix.select("node").distinct()
    texts = stored(named.select("_text").mapInArrow(text_rows, "node long, _zip binary").join(nodes, "node"))

    compare = lambda rows: _compared(rows, texts, width, num, den)
    edges = stored(compare(_led(prefix, num, den)))
    # round two: the best linked member of a first-round slice leads those that its links have not reached
    degree = edges.groupBy("a").agg(F.max("links").alias("links"), F.min("b").alias("root"))
    better = prefix.join(degree.select(F.col("a").alias("node"), "links", "root"), "node", "left")
    top = better.groupBy("token").agg(F.max(F.struct(F.coalesce("links", F.lit(0)).alias("links"), F.col("node").alias("lead"), F.coalesce("root", F.col("node")).alias("lead_root"))).alias("top"))
    again = better.drop("lead").join(top.select("token", F.col("top.lead").alias("lead"), F.col("top.lead_root").alias("lead_root")), "token").filter("coalesce(root, node) <> lead_root")
    more = stored(compare(_led(again.select("token", "node", "n", "lead"), num, den)))
    first = components(edges.unionByName(more))

    grouped = stored(_groups(prefix, first))
    cross = stored(_crossed(prefix, grouped, texts, width, num, den))
    root = first if cross.isEmpty() else components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(cross))
    # copies first become one row a node; nodes of a large component, and rows of a node with many copies, are dealt out
    each = stored(mine.filter("n > 0").groupBy("node").agg(F.min("_id").alias("_id"), F.count("*").alias("k")).join(root, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = each.groupBy("root").agg(F.min("_id").alias("component_id"))
    large = hot_keys(each.groupBy("root").agg(F.count("*").alias("k")), ["root"], "k")
    named_nodes = hot_join(each.select("node", "root"), least, ["root"], large).select("node", "component_id")
    out = hot_join(mine, named_nodes, ["node"], hot_keys(each, ["node"], "k"), "left")
    out = out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))
    return out.unionByName(_unnamed(docs, node_rows, id_col))


def _unnamed(docs: DataFrame, node_rows: object, id_col: str) -> DataFrame:
    rows = docs.filter("_id is null").mapInArrow(node_rows, "_id long, n long, node long")
    return rows.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))


def _dense(prefix: DataFrame, num: int, den: int) -> DataFrame:
    """``(token, node, n, lead)`` of nodes that share as many tokens with others as any link of theirs needs."""
    own = prefix.groupBy("node").agg(F.count("*").alias("c"), F.first("n").alias("n")).filter(F.col("c") >= _least(F.col("n"), num, den))
    rows = prefix.join(own.select("node"), "node")
    shared = rows.groupBy("token").agg(F.min("node").alias("lead"), F.max("node").alias("tail")).filter("lead <> tail")
    return rows.join(shared.select("token", "lead"), "token").select("token", "node", "n", "lead")


def _least(n: Column, num: int, den: int) -> Column:
    """How many of the dealt tokens a set of ``n`` shares with any set that it links with."""
    return F.least(F.lit(_EXTRA), _needed(n, num, den))


def _led(prefix: DataFrame, num: int, den: int) -> DataFrame:
    """``(bucket, slice, node)``: each node with the leader of most of its tokens, the leader in every slice."""
    shared = prefix.filter("node <> lead").groupBy("node", "lead").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    enough = shared.filter(F.col("c") >= _least(F.col("n"), num, den))
    chosen = enough.groupBy("node").agg(F.max(F.struct("c", "lead")).alias("x"), F.first("n").alias("n")).select("node", "n", F.col("x.lead").alias("bucket"))
    total = chosen.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n").alias("t"))
    slots = F.greatest(F.ceil(F.col("m") / _MEMBERS), F.ceil(F.col("t") / _TOKENS)).cast("int")
    total = total.select("bucket", slots.alias("slots"))
    members = chosen.join(total, "bucket").select("bucket", F.pmod(F.xxhash64("node"), "slots").cast("int").alias("slice"), "node")
    leaders = total.select("bucket", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slice"), F.col("bucket").alias("node"))
    return members.unionByName(leaders)


class _Members:
    """The sets of a slice's nodes over the tokens that at least two of them have."""

    def __init__(self, table: pa.Table, width: int):
        nodes = table.column("node").to_numpy()
        _, first = np.unique(nodes, return_index=True)
        table = table.take(pa.array(first))
        self.node = nodes[first]
        self.side = table.column("side").to_numpy()
        parts, sizes = [], []
        for a in range(0, len(table), 50):
            some = [zstandard.decompress(z.as_py()) for z in table.column("_zip")[a : a + 50]]
            values, bounds = shingle_sets(Words(pa.array(some, pa.large_binary()), lower=True), width)
            parts.append(values)
            sizes.append(np.diff(bounds))
        self.n = np.concatenate(sizes)
        flat = np.concatenate(parts)
        owner = np.repeat(np.arange(len(self.n)), self.n)
        _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
        both = count[code] > 1
        self.code, self.owner = code[both], owner[both]
        self.width = int(code.max()) + 1 if len(code) else 0
        self.bounds = np.searchsorted(self.owner, np.arange(len(self.n) + 1))

    def overlaps(self, i: int) -> np.ndarray:
        """Common tokens of member i with every member."""
        flag = np.zeros(self.width, dtype=bool)
        flag[self.code[self.bounds[i] : self.bounds[i + 1]]] = True
        return np.bincount(self.owner, weights=flag[self.code], minlength=len(self.n)).astype(np.int64)

    def held_by(self, side: int) -> np.ndarray:
        """How many of each member's tokens the union of the members of ``side`` has."""
        flag = np.zeros(self.width, dtype=bool)
        flag[self.code[self.side[self.owner] == side]] = True
        return np.bincount(self.owner, weights=flag[self.code], minlength=len(self.n)).astype(np.int64)


_EDGES = "a long, b long, links long"


def _linked(m: _Members, num: int, den: int, across: bool) -> pa.Table:
    """Edges from each linked member to the least member of its component in the slice, with its number of links."""
    parent, links = np.arange(len(m.n)), np.zeros(len(m.n), dtype=np.int64)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    open_ = np.ones(len(m.n), dtype=bool)
    if across:
        need = -(-num * m.n // den)
        open_ = np.where(m.side == 0, m.held_by(1), m.held_by(0)) >= need
    for i in np.flatnonzero(open_).tolist():
        if across and m.side[i]:
            continue
        shared = m.overlaps(i)
        hit = den * shared >= num * (m.n + m.n[i] - shared)
        hit &= open_ & ((m.side == 1) if across else True)
        hit[i] = False
        links[i] = hit.sum()
        for j in np.flatnonzero(hit).tolist():
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    root = np.array([find(i) for i in range(len(m.n))], dtype=np.int64)
    some = np.bincount(root, minlength=len(m.n))[root] > 1 if len(root) else np.zeros(0, bool)
    return pa.table({"a": m.node[some], "b": m.node[root[some]], "links": links[some]})


def _compared(rows: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        return _linked(_Members(table, width), num, den, across=False)

    full = rows.join(texts, "node").withColumn("side", F.lit(0))
    return full.groupBy("bucket", "slice").applyInArrow(run, _EDGES)


def _groups(prefix: DataFrame, root: DataFrame) -> DataFrame:
    """``(node, n, family, pure, group, low, high)``: slices of components, and of single nodes by their first token's leader.

    ``low`` and ``high`` are the sizes of the group's smallest and largest set.
    """
    lead = prefix.groupBy("node").agg(F.min("lead").alias("lead"), F.first("n").alias("n"))
    of = lead.join(root, "node", "left").select("node", "n", F.coalesce("root", "lead").alias("family"), F.col("root").isNotNull().alias("pure"))
    total = of.groupBy("family", "pure").agg(F.greatest(F.ceil(F.count("*") / _MEMBERS), F.ceil(F.sum("n") / _TOKENS)).cast("int").alias("slots"))
    rows = of.join(total, ["family", "pure"]).select("node", "n", "family", "pure", F.xxhash64("family", "pure", F.pmod(F.xxhash64("node"), "slots")).alias("group"))
    own = Window.partitionBy("group")  # of bounded size
    return rows.withColumns({"low": F.min("n").over(own), "high": F.max("n").over(own)})


def _crossed(prefix: DataFrame, grouped: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links between groups (and within groups of single nodes) that the token-group matrix does not rule out.

    A node qualifies for a group if the union of the group's dealt tokens holds as
    many of its own as any link needs, and the sizes fit.  Two groups are opened
    if nodes of both qualify for the other, and only those nodes are compared.
    """
    rows = prefix.select("token", "node").join(grouped, "node")
    matrix = rows.groupBy("token", F.col("group").alias("other")).agg(F.first("family").alias("f"), F.first("pure").alias("u"), F.count("*").alias("k"), F.first("low").alias("l"), F.first("high").alias("h"))
    fits = (F.col("n") * den >= F.col("l") * num) & (F.col("h") * den >= F.col("n") * num)
    meets = fits & ~(F.col("pure") & F.col("u") & (F.col("family") == F.col("f"))) & ((F.col("group") != F.col("other")) | (F.col("k") > 1))
    near = rows.join(matrix.withColumnRenamed("token", "_t"), (F.col("token") == F.col("_t")) & meets)
    near = near.groupBy("node", "group", "other").agg(F.count("*").alias("c"), F.first("n").alias("n")).filter(F.col("c") >= _least(F.col("n"), num, den))
    side = (F.col("group") > F.col("other")).cast("int")
    asked = stored(near.select("node", F.least("group", "other").alias("g"), F.greatest("group", "other").alias("h"), side.alias("side")))
    both = asked.groupBy("g", "h").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    both = both.filter("(g = h and a > 1) or (a > 0 and b > 0)").select("g", "h")

    def run(table: pa.Table) -> pa.Table:
        m = _Members(table, width)
        return _linked(m, num, den, across=bool((m.side == 1).any())).select(["a", "b"])

    full = asked.join(both, ["g", "h"]).join(texts, "node").select("g", "h", "node", "side", "_zip")
    return full.groupBy("g", "h").applyInArrow(run, "a long, b long")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each group of similar rows of ``docs``: that with the smallest id, of equal ids the one with the least text hash.

    Rows are judged one by one, whatever their ids: rows with a null or a repeated
    id link by their own texts, null ids come last, and of rows that are equal
    throughout one stays.  Null and empty texts link with nothing and all stay; an
    empty table stays empty; columns, whatever their names, pass through.

    Rows are known by a hash of id and text, so no copy of the table is stored;
    equal ones are counted before they meet, and a row that very many equal ones
    repeat is reduced in the scan's own tasks.
    """
    spark = docs.sparkSession
    key, check = unused("_key", docs.columns), unused("_check", docs.columns)
    silent = ~F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    rows = docs.filter(~silent).withColumn(key, F.xxhash64(id_col, text_col))
    with scratch(spark) as keep:
        similar = similar_documents(rows.select(key, text_col), key, text_col, width, num, den).groupBy(F.col(key).alias("k")).agg(F.min("component_id").alias("component"))
        order = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"))
        own = rows.groupBy(F.col(key).alias("k")).agg(F.min(order).alias("x"), F.count("*").alias("n"))
        kept = keep(stored(own.join(similar, "k").groupBy("component").agg(F.min(F.struct("x", "k", "n")).alias("y")).select(F.col("y.k").alias(key), F.col("y.n").alias("n"))))
        hot = hot_keys(kept, [key], "n")
    again = rows.withColumn(check, F.xxhash64(F.lit(1), text_col, id_col))
    many = F.xxhash64(key).isin(hot) if hot else F.lit(False)
    few = again.filter(~many).join(kept.select(key), key, "left_semi").dropDuplicates([key, check])
    out = few.select(*docs.columns).unionByName(docs.filter(silent))
    if hot:
        out = out.unionByName(again.filter(many).dropDuplicates([key, check]).join(kept.select(key), key, "left_semi").select(*docs.columns))
    return out
