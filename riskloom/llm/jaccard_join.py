"""N-gram Jaccard join by a MinHash LSH forest.

Shingles are five consecutive words (lower case, runs of letters and digits); a
shorter text is one shingle. Documents with the same shingle set form a class;
the rest of the work sees one representative (smallest doc_id) per class.

1. Each representative has ``TREES`` labels of ``MAX_DEPTH`` min-hash symbols. The
   labels of a tree, sorted, are a prefix trie: documents that share a prefix are
   neighbours, a node is a run of them. Labels that share not even ``TOP`` symbols
   with a neighbour are alone and leave.
2. Every document shortens its matched prefixes until a partner at the threshold is
   found with the target recall (``shorten``). Trees are taken in a fixed order. Where
   the node of the shortest prefix is small, that node is matched. Trees in which it is
   crowded are set aside; if the others do not reach the recall, the crowded ones are
   matched at the longest prefix that does, the same in all of them. So a document
   without a crowd needs a few short prefixes, one in a crowd long ones, and the
   prefixes of a document follow the data. A prefix of d symbols adds
   -log(1 - similarity ** d); the choice does not look at where a partner is: a node
   counts towards the recall only if it stays small with one more member.
3. A matched node holds all documents that share its prefix. Of nodes with the same
   members one stays; a node whose members all lie in one larger node goes; one that
   shares most members with a larger node of at most twice its size joins it, so that
   a crowd is verified once and not in every tree. Nodes of more
   than ``BLOCK`` members are split into blocks, and each pair of blocks is one bounded
   unit of work.
4. A unit verifies its pairs exactly by counting common shingles (a product of
   incidence matrices) and gives, per member, its links and its local component.
   A pair in several nodes counts in the first only. Pairs are never emitted.

``links``: one row per document with class_id (smallest doc_id of all documents
connected by links), n_links (other documents of similarity >= threshold, copies
included), and representative.

Defined results: texts without words (null, empty) have the empty shingle set
and are copies of each other; a null doc_id is left out; rows that share a
doc_id are versions of one document, which is linked to whatever one of them is
linked to (n_links counts the linked documents of all versions); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, doc_shingles, mix, partitions, running, scratch, ship, slices, utf8, word_hashes
from .components import components

SHINGLE, THRESHOLD, TREES, MAX_DEPTH, RECALL, BLOCK = 5, 0.8, 16, 8, 0.999, 256
#: Shortest prefix (symbols), and the members from which its node is crowded.
TOP, CROWD = 2, 32
SYMBOL = 2  # bytes
SLICE_BYTES = 2 << 20


def gain(threshold: float, depth: int | np.ndarray) -> np.ndarray:
    """What one tree matched at ``depth`` symbols adds to -log(1 - recall)."""
    return -np.log1p(-np.power(threshold, np.asarray(depth, np.float64)))


def shorten(sizes: np.ndarray, threshold: float, recall: float) -> np.ndarray:
    """Prefix lengths (0: not matched) at which the documents are matched in their trees.

    ``sizes`` (document, tree) are the members of the nodes at ``TOP`` symbols, 1 if alone.
    """
    goal = -np.log1p(-recall)
    small = sizes < CROWD           # with a partner more the node would still be matched
    reached = np.cumsum(small, axis=1) * gain(threshold, TOP)
    before = np.concatenate((np.zeros((len(sizes), 1)), reached[:, :-1]), axis=1)
    out = np.where((sizes <= CROWD) & (before < goal), TOP, 0)
    left = goal - reached[:, -1]
    crowded = sizes >= CROWD
    depths = np.arange(MAX_DEPTH, TOP, -1)
    enough = crowded.sum(1)[:, None] * gain(threshold, depths)[None, :] >= left[:, None]
    # the longest that is enough, else the shortest one of a crowd; no more trees than it needs
    depth = np.where(enough.any(1), depths[enough.argmax(1)], TOP)
    needed = (np.cumsum(crowded, axis=1) - 1) * gain(threshold, depth)[:, None] < left[:, None]
    return np.where(crowded & needed & (left > 0)[:, None], depth[:, None], out)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted shingle hashes of all texts in a row, and the offsets of each."""
    texts = pc.utf8_lower(texts.fill_null(""))
    buf, off = utf8(texts)
    h, words, _, _ = word_hashes(buf, off, ALNUM)
    sh, soff = doc_shingles(h, words, k)
    doc = np.repeat(np.arange(len(soff) - 1), np.diff(soff))
    order = np.lexsort((sh, doc))
    sh, doc = sh[order], doc[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
    return sh[new], np.searchsorted(doc[new], np.arange(len(soff)))


def _min_hashes(values: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """Min-hashes (the upper 16 of 32 bits) of each set; empty sets have the largest value."""
    out = np.full((len(off) - 1, count), 0xFFFF, np.uint16)
    full = np.flatnonzero(off[1:] > off[:-1])
    if not len(full):
        return out
    x = mix(values)
    low, high = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
    odd = mix(np.arange(1, count + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
    for i in range(count):
        h = low * odd[i]
        h ^= h >> np.uint32(15)
        h += high * odd[-1 - i]
        h ^= h >> np.uint32(13)
        h *= np.uint32(0x9E3779B1)
        m = np.minimum.reduceat(h, off[full])
        # the least values crowd near 0: their own mixed bits are the symbol
        out[full, i] = ((m * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16)
    return out


def _signatures(src: DataFrame, kind: str, k: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            values, off = shingle_sets(part.column("text"), k)
            sig = _min_hashes(values, off, TREES * MAX_DEPTH)
            total, total2 = running(mix(values)), running(mix(values ^ np.uint64(0x5851F42D4C957F2D)))
            fp = [pa.array((t[off[1:]] - t[off[:-1]]).view(np.int64)) for t in (total, total2)]
            # big-endian, so that labels sort by symbol
            raw = sig.astype(">u2").tobytes()
            width = TREES * MAX_DEPTH * SYMBOL
            labels = pa.array([raw[i * width:(i + 1) * width] for i in range(part.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), *fp, pa.array(np.diff(off).astype(np.int32)), labels],
                ["id", "fp1", "fp2", "n", "sig"])

    return src.mapInArrow(run, f"id {kind}, fp1 long, fp2 long, n int, sig binary")


def _trie_neighbours(forest: DataFrame) -> DataFrame:
    """Labels that share ``TOP`` symbols with a neighbour in sorted order (first and last of
    a sorted partition stay, as their neighbours are not seen here)."""
    width = TOP * SYMBOL

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sure_first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches(([held] if held is not None else []) + [batch]).combine_chunks()
            tree = rows.column("tree").to_numpy()
            node = pc.binary_slice(rows.column("label").combine_chunks(), 0, width)
            same = (tree[1:] == tree[:-1]) & pc.equal(node[1:], node[:-1]).to_numpy(zero_copy_only=False)
            sure = np.zeros(len(tree), bool)
            sure[0] = sure_first
            sure[1:] |= same
            sure[:-1] |= same
            yield from rows.take(pa.array(np.flatnonzero(sure[:-1]))).to_batches()
            held, sure_first = rows.slice(len(tree) - 1, 1).to_batches()[0], bool(sure[-1])
        if held is not None:
            yield held

    n = partitions(forest)
    return (forest.repartitionByRange(n, "tree", "label", "id").sortWithinPartitions("tree", "label", "id")
            .mapInArrow(run, "tree int, label binary, id long"))


def _matched(close: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(id, tree, depth, label, seeks): the prefixes of every document at which it may be
    matched; it seeks partners at those that ``shorten`` chose."""
    top = F.substring("label", 1, TOP * SYMBOL)
    close = scratch(close, "trie")
    sizes = close.groupBy("tree", top.alias("top")).agg(F.count("*").alias("size")).filter("size > 1")
    here = close.withColumn("top", top).join(sizes, ["tree", "top"]).select("id", "tree", "label", "size")
    per_doc = here.groupBy("id").agg(F.collect_list(F.struct("tree", "label", "size")).alias("rows"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rows")
            at, flat = lists.offsets.to_numpy(), lists.flatten()
            doc = np.repeat(np.arange(batch.num_rows), np.diff(at))
            tree, size = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            table = np.ones((batch.num_rows, TREES), np.int64)
            table[doc, tree] = size
            depth = shorten(table, threshold, recall)[doc, tree]
            rows, depths, seeks = [], [], []
            for d in (TOP, *range(TOP + 1, MAX_DEPTH + 1)):
                # all members of a small node, and of every node in a crowd, may be partners there
                some = np.flatnonzero(size <= CROWD if d == TOP else size >= CROWD)
                rows.append(some)
                depths.append(np.full(len(some), d, np.int32))
                seeks.append(depth[some] == d)
            # a crowd that is too large for its recall is matched at its shortest prefix
            some = np.flatnonzero((size > CROWD) & (depth == TOP))
            rows, depths, seeks = (np.concatenate(x) for x in ([*rows, some], [*depths, np.full(len(some), TOP, np.int32)],
                                                               [*seeks, np.ones(len(some), bool)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(doc[rows])), pa.array(tree[rows]), pa.array(depths),
                 flat.field(1).take(pa.array(rows)), pa.array(seeks)], ["id", "tree", "depth", "label", "seeks"])

    return per_doc.mapInArrow(run, "id long, tree int, depth int, label binary, seeks boolean")


def _nodes(matched: DataFrame) -> DataFrame:
    """(node, id, size) of the matched trie nodes that are left after dropping contained ones."""
    prefix = F.substring("label", F.lit(1), F.col("depth") * SYMBOL)
    members = matched.select(F.xxhash64("tree", "depth", prefix).alias("node"), "id", "seeks")
    sizes = (members.groupBy("node").agg(F.count("*").alias("size"), F.max("seeks").alias("seeks"),
                                         F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"))
             .filter("size > 1 AND seeks"))
    # one node per set of members
    single = scratch(sizes.groupBy("size", "who").agg(F.min("node").alias("node")).select("node", "size"), "nodes")
    members = scratch(members.drop("seeks").join(single, "node"), "members")
    # every member votes for its largest node
    largest = members.groupBy("id").agg(F.max(F.struct("size", "node")).alias("top"))
    votes = (members.join(largest, "id").groupBy("node", "size", F.col("top.node").alias("into"),
                                                 F.col("top.size").alias("whole")).agg(F.count("*").alias("n")))
    best = scratch(votes.groupBy("node", "size").agg(F.max(F.struct("n", "into", "whole")).alias("v"))
                   .select("node", "size", "v.*"), "votes")
    roots = best.filter("into = node").select(F.col("node").alias("into"))
    inside = best.filter("n = size AND into != node").select("node")
    # the nodes of one crowd in different trees are one node: its pairs are verified once
    merged = best.filter("n < size AND into != node AND 2 * n >= size AND 2 * size >= whole").join(roots, "into")
    moved = merged.select(F.col("node"), F.col("into"))
    members = (members.select("node", "id").join(inside, "node", "left_anti").join(moved, "node", "left")
               .select(F.coalesce("into", "node").alias("node"), "id").distinct())
    members = scratch(members, "merged-members")
    return members.join(members.groupBy("node").agg(F.count("*").alias("size")), "node")


def _verify(kind: str, num: int, den: int):
    """Function of one unit of work: exact links of its members."""
    columns = ["id", "n_links", "least"]

    def run(table: pa.Table) -> pa.Table:
        packed = table.column("members").combine_chunks()
        block = np.repeat(table.column("block").to_numpy(), np.diff(packed.offsets.to_numpy()))
        node, lo, hi = (table.column(c)[0].as_py() for c in ("node", "lo", "hi"))
        flat = packed.flatten()
        ids, weight = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("id", "weight"))
        sets, nodes = flat.field("shingles"), flat.field("nodes")
        n = len(ids)
        size = np.diff(sets.offsets.to_numpy()).astype(np.int64)
        values, row = sets.flatten().to_numpy(), np.repeat(np.arange(n), size)
        # shingles of one member only cannot be common
        _, code, seen = np.unique(values, return_inverse=True, return_counts=True)
        keep = seen[code] > 1
        code, row = np.unique(code[keep], return_inverse=True)[1], row[keep]
        order = np.argsort(code, kind="stable")
        code, row = code[order], row[order]
        common = np.zeros((n, n), np.float32)
        width = 4096
        for c in range(0, int(code[-1]) + 1 if len(code) else 0, width):
            a, b = np.searchsorted(code, [c, c + width])
            part = np.zeros((n, width), np.float32)
            part[row[a:b], code[a:b] - c] = 1
            common += part @ part.T
        # similarity >= num/den  <=>  (num + den) * common >= num * (size + size)
        linked = (num + den) * common.astype(np.int64) >= num * (size[:, None] + size[None, :])
        np.fill_diagonal(linked, False)
        if lo != hi:
            linked &= block[:, None] != block[None, :]
        # a pair in several nodes counts in the smallest of them
        other, who = nodes.flatten().to_numpy(), np.repeat(np.arange(n), np.diff(nodes.offsets.to_numpy()))
        early = other < node
        if early.any():
            number = np.unique(other[early], return_inverse=True)[1]
            member = np.zeros((n, number.max() + 1), np.float32)
            member[who[early], number] = 1
            linked &= member @ member.T == 0
        least = ids.copy()
        while True:  # local components: smallest linked id, until nothing changes
            new = np.minimum(least, np.where(linked, least[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (new == least).all():
                break
            least = new
        out = pd.DataFrame({"id": ids, "n_links": linked @ weight, "least": least})
        return pa.Table.from_pandas(out[out["n_links"] > 0], preserve_index=False).select(columns)

    return run, f"id {kind}, n_links long, least {kind}"


def links(docs: DataFrame, threshold: tuple[int, int] = (4, 5), k: int = SHINGLE, recall: float = RECALL,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, n_links, representative.

    ``threshold`` is the least similarity as a fraction (numerator, denominator).
    """
    ship(docs.sparkSession)
    num, den = threshold
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(
        "id IS NOT NULL")
    kind = src.schema["id"].dataType.simpleString()
    sigs = scratch(_signatures(src, kind, k), "signatures")
    classes = scratch(sigs.groupBy("fp1", "fp2").agg(
        F.min("id").alias("rep"), F.count_distinct("id").alias("weight"), F.min("sig").alias("sig"),
        F.min("n").alias("n")), "classes")
    width = MAX_DEPTH * SYMBOL
    # a document of several versions may represent several classes: classes are told apart by fp1
    forest = (classes.filter("n > 0").select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"),
                                             "sig", F.col("fp1").alias("id"))
              .select("tree", F.substring("sig", F.col("tree") * width + 1, F.lit(width)).alias("label"), "id"))
    matched = scratch(_matched(_trie_neighbours(forest), num / den, recall), "matched")
    members = scratch(_nodes(matched), "kept-members")
    per_class = members.groupBy("id").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    wanted = classes.join(per_class.withColumnRenamed("id", "fp1"), "fp1").select(
        "rep", "fp1", "fp2", "weight", "nodes")
    sets = _sets(src.join(wanted, src["id"] == wanted["rep"]), k)
    sets = scratch(sets.dropDuplicates(["fp1"]), "sets")
    parts = members.withColumn("parts", F.ceil(F.col("size") / BLOCK)).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("parts")))
    # every member meets its set once; a unit gets whole blocks, one row each
    blocks = (parts.join(sets.withColumnRenamed("fp1", "id"), "id").groupBy("node", "parts", "block")
              .agg(F.collect_list(F.struct("id", "weight", "nodes", "shingles")).alias("members")))
    units = (blocks.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("node", "block", "members", F.least("block", "j").alias("lo"), F.greatest("block", "j").alias("hi")))
    run, schema = _verify("long", num, den)
    found = scratch(units.groupBy("node", "lo", "hi").applyInArrow(run, schema), "links")
    class_links = found.groupBy("id").agg(F.sum("n_links").alias("linked"))
    # components over documents: links between representatives, and members of classes
    names = classes.select(F.col("fp1").alias("id"), "rep")
    edges = (found.filter("id != least").select("id", "least").distinct()
             .join(names.withColumnRenamed("rep", "u"), "id")
             .join(names.select(F.col("id").alias("least"), F.col("rep").alias("v")), "least").select("u", "v"))
    of_class = (sigs.select("id", "fp1", "fp2").distinct()
                .join(classes.select("fp1", "fp2", "rep", "weight"), ["fp1", "fp2"])
                .join(class_links.withColumnRenamed("id", "fp1"), "fp1", "left"))
    of_class = scratch(of_class.select(
        "id", "rep", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "of-class")
    own = of_class.filter("id != rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    comp = components(edges.unionByName(own))
    per_doc = of_class.groupBy("id").agg(F.min("rep").alias("representative"), F.sum("n_links").alias("n_links"))
    return per_doc.join(comp.withColumnRenamed("node", "id"), "id", "left").select(
        F.col("id").alias("doc_id"), F.coalesce("component", "id").alias("class_id"), "n_links", "representative")


def _sets(src: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            values, off = shingle_sets(part.column("text"), k)
            total = running(mix(values))
            # the version of the document that has the class's shingle set
            mine = (total[off[1:]] - total[off[:-1]]).view(np.int64) == part.column("fp1").to_numpy()
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values.view(np.int64)))
            rows = pa.RecordBatch.from_arrays(
                [part.column("fp1"), part.column("weight"), part.column("nodes"), lists],
                ["fp1", "weight", "nodes", "shingles"])
            yield rows.filter(pa.array(mine))

    return src.select("text", "fp1", "weight", "nodes").mapInArrow(
        run, "fp1 long, weight long, nodes array<long>, shingles array<long>")


def drop_near_copies(docs: DataFrame, threshold: tuple[int, int] = (4, 5), id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``docs`` with one document (the smallest doc_id) of each group of near copies.

    Rows without doc_id stay; of rows that share a kept doc_id the one with the least hash
    over its columns stays, whatever the partitioning.
    """
    cols = docs.columns
    kept = links(docs, threshold, id_col=id_col, text_col=text_col).filter("doc_id = class_id").select(
        F.col("doc_id").alias("kept_id"))
    src = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)))
    key = f"c{cols.index(id_col)}"
    row = F.struct(*src.columns)
    stay = (src.join(kept, F.col(key) == F.col("kept_id"), "left_semi").groupBy(F.col(key).alias("key"))
            .agg(F.min_by(row, F.xxhash64(*src.columns)).alias("row")).select("row.*"))
    return stay.unionByName(src.filter(F.col(key).isNull())).toDF(*cols)
