"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Documents with the same shingles form a class; what follows is done once per class. Candidates come from a MinHash LSH
forest: every class has a signature, and each of TREES tries holds the classes by its own part of the signature, value by
value. A trie node at depth d is the group of classes with the same first d values; classes that share a node, directly or
over others, form a candidate component, and all pairs within one are verified on their exact shingle sets.

Matched prefixes are shortened on what the data gives. At first only the deepest nodes count, where pairs must share the
longest prefix. Each verified pair of similarity s would share a node at depth d with probability p(s) = 1 - (1 - s^d)^TREES,
so it stands for 1 / p(s) pairs; while the pairs found are less than RECALL of that sum, prefixes lose a value, and
components that have grown are verified anew. The shortest prefix is the one at which a pair at the threshold itself is
met with probability RECALL (`prefix_depth`).

Pairs are never written out: a task verifies a component (or, where that is large, two blocks of it) and returns for each
class how many others it is linked to and the smallest class it is connected to. So a group of many near copies costs
rows in proportion to its documents.

Words are runs of other than white space. A text of one to four words has one shingle, all its words. Null texts and texts
without a word are alone: no links, no class mates. Repeated rows are copies of each other. Very long texts are read
whole. An empty table gives no rows. Shingles and classes are told apart by 64 bits of hash.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import WORD, append_columns, stage
from eventloom.llm.graph import components
from eventloom.llm.vocab import Memory

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 32, 8
RECALL = 0.9999
#: Values below the shortest prefix by which tries tell classes apart, 16 bits each.
FURTHER = 2
#: Classes of a component that one task compares with each other; larger components are compared block by block.
BLOCK = 384

_WORD = re.compile(WORD)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _words_memory() -> Memory:
    return Memory(lambda words: [xxhash.xxh64_intdigest(w.encode()) for w in words])


def shingles(text: str, memory: Memory, size: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = np.array(memory.values(_WORD.findall(text)), dtype=np.uint64)
    if not len(words):
        return words
    size = min(size, len(words))
    mixed = words[: len(words) - size + 1].copy()
    for k in range(1, size):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _STEP + words[k : len(words) - size + 1 + k]
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed * _STEP)


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets in some trie with probability `recall`."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _hashes(count: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(5)
    return random.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 1 << 63, count, dtype=np.uint64)


def signature(found: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the shingles."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(found), 2048):
        part = found[start : start + 2048, None]
        np.minimum(least, ((part ^ shifts) * factors).min(axis=0), out=least)
    return least


def sketched(documents: DataFrame, text: str = "text", trees: int = TREES) -> DataFrame:
    """`documents` with `class` (null without a word) and its path in each trie: `nodes`, the shortest prefix, and `tails`."""
    depth = prefix_depth(trees=trees)

    def build():
        memory = _words_memory()
        factors, shifts = _hashes(trees * (depth + FURTHER))

        def run(texts: list[str]) -> dict[str, list]:
            classes, nodes, tails = [], [], []
            for value in texts:
                found = shingles(value, memory)
                if not len(found):
                    classes.append(None)
                    nodes.append(None)
                    tails.append(None)
                    continue
                label = signature(found, factors, shifts).reshape(trees, depth + FURTHER)
                node = np.arange(trees, dtype=np.uint64) * _STEP
                for k in range(depth):  # the prefix, value by value
                    node = (node ^ (node >> np.uint64(31)) ^ label[:, k]) * _STEP
                classes.append(xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63))
                nodes.append(node.view(np.int64).tolist())
                tail = np.zeros(trees, dtype=np.uint32)
                for k in range(depth, depth + FURTHER):
                    tail = (tail << np.uint32(16)) | (label[:, k] * _STEP >> np.uint64(48)).astype(np.uint32)
                tails.append(tail.view(np.int32).tolist())
            return {"class": classes, "nodes": nodes, "tails": tails}

        return run

    return append_columns(documents, text, "class BIGINT, nodes ARRAY<BIGINT>, tails ARRAY<INT>", build)


def candidate_edges(classes: DataFrame, further: int = 0) -> DataFrame:
    """a, b: each class with the smallest class of every trie node that it shares; all nodes' members are connected.

    Nodes lie `further` values below the shortest prefix.
    """
    path = classes.select(F.explode(F.arrays_zip("nodes", "tails")).alias("path"), "class")
    part = F.shiftrightunsigned("path.tails", 16 * (FURTHER - further)) if further else F.lit(0)
    members = path.select(F.col("path.nodes").alias("node"), part.alias("part"), "class")
    shared = members.groupBy("node", "part").agg(F.min("class").alias("first"), F.max("class").alias("last")).filter("first < last")
    shared = stage(shared, "shared-nodes")
    joined = members.join(shared, ["node", "part"]).filter(F.col("class") != F.col("first"))
    return joined.select(F.col("class").alias("a"), F.col("first").alias("b")).distinct()


def met_with(similarity: np.ndarray, depth: int, trees: int = TREES) -> np.ndarray:
    """The probability that a pair shares a trie node at a depth."""
    return 1 - (1 - similarity**depth) ** trees


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """Places (i, j), i < j, of the linked pairs between rows `left` and rows `right` of the sets, and their similarity."""
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), sizes)
    keep = count[column] > 1  # a shingle of one set is in no intersection
    rows, column = rows[keep], np.unique(column[keep], return_inverse=True)[1]
    width = int(column.max(initial=-1)) + 1
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    place = np.full(len(sets), -1)
    side = []
    for chosen in (left, right):
        place[:] = -1
        place[chosen] = np.arange(len(chosen))
        side.append(place[rows].copy())
    step = max(64, min(4096, (1 << 24) // max(1, len(sets))))
    for start in range(0, width, step):
        a, b = np.searchsorted(column, [start, start + step])
        span = min(step, width - start)
        part = []
        for at, n in zip(side, (len(left), len(right))):
            matrix = np.zeros((n, span), dtype=np.float32)
            inside = at[a:b] >= 0
            matrix[at[a:b][inside], column[a:b][inside] - start] = 1
            part.append(matrix)
        common += part[0] @ part[1].T
    common = common.astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - common
    # exact in whole numbers: common / union >= threshold
    per_mille = round(threshold * 1000)
    i, j = np.nonzero(common * 1000 >= per_mille * union)
    similar = common[i, j] / union[i, j]
    i, j = left[i], right[j]
    return i[i < j], j[i < j], similar[i < j]


def _connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of `n` places is connected to."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def verified(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """class, links, root, pairs, weights of the classes (`class`, `component`, `members`, `text`) of candidate components.

    All hold within the task's share: a class of a large component has a row for each pair of blocks. `pairs` are the links
    to later classes, `weights` how many pairs they stand for by depth, from the shortest prefix on.
    """
    depths = range(prefix_depth(threshold), prefix_depth(threshold) + FURTHER + 1)
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("class", F.lit(3)), blocks).cast("int")
    # a class of block x takes part in the pairs (x, y) and (y, x) of blocks, smaller block first
    pairs = F.when(blocks == 1, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(
        F.transform(F.sequence(F.lit(0), blocks - 1), lambda y: F.struct(F.least(own, y).alias("x"), F.greatest(own, y).alias("y")))
    )
    dealt = texts.select("class", "component", "members", "text", own.alias("block"), F.explode(pairs).alias("pair"))
    total = texts.sparkSession.conf.get("spark.sql.shuffle.partitions")
    small = F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(max(64, 8 * int(total)))))
    large = F.concat_ws(" ", F.lit("l"), "component", "pair.x", "pair.y")
    dealt = dealt.select("class", "component", "text", "block", "pair.x", "pair.y", F.when(F.col("members") <= BLOCK, small).otherwise(large).alias("share"))

    def run(share: pd.DataFrame) -> pd.DataFrame:
        memory = _words_memory()
        out = []
        share = share.drop_duplicates(["class"]).sort_values(["component", "class"])
        for _, rows in share.groupby("component", sort=False):
            ids = rows["class"].to_numpy()
            sets = [shingles(t, memory) for t in rows["text"]]
            x, y, block = rows["x"].iloc[0], rows["y"].iloc[0], rows["block"].to_numpy()
            every = np.arange(len(ids))
            if x == y:
                i, j, similar = _links(sets, every, every, threshold)
            elif len(set(block)) > 1:
                both = [_links(sets, every[block == a], every[block == b], threshold) for a, b in ((x, y), (y, x))]
                i, j, similar = (np.concatenate(parts) for parts in zip(*both))
            else:
                i, j, similar = every[:0], every[:0], np.zeros(0)
            links = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
            weights = np.stack([np.bincount(i, weights=1 / met_with(similar, d), minlength=len(ids)) for d in depths], axis=1)
            out.append(pd.DataFrame({
                "class": ids, "links": links, "root": ids[_connected(len(ids), i, j)], "pairs": np.bincount(i, minlength=len(ids)),
                "weights": weights.tolist(),
            }))
        return pd.concat(out)

    return dealt.groupBy("share").applyInPandas(run, "class BIGINT, links BIGINT, root BIGINT, pairs BIGINT, weights ARRAY<DOUBLE>")


def linked(source: DataFrame, classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The verified shares of all classes, from prefixes as short as the recall asks for.

    `source` has doc_id, text_hash and text, `classes` one such row (doc_id, text_hash) and the path of every class.
    """
    shares, before = None, None
    for further in range(FURTHER, -1, -1):
        found = components(candidate_edges(classes, further)).select(F.col("node").alias("class"), "component")
        found = stage(found, "forest")
        sizes = stage(found.groupBy("component").agg(F.count("*").alias("members")), "component-sizes")
        # shorter prefixes only join components, so one with the same name and size is the same
        grown = sizes if before is None else sizes.join(before, ["component", "members"], "left_anti")
        before = sizes
        wanted = stage(found.join(grown, "component").join(classes.drop("nodes", "tails"), "class"), "candidates")
        same = [source["doc_id"].eqNullSafe(wanted["doc_id"]), source["text_hash"] == wanted["text_hash"]]
        # candidates grow with the input: no broadcast at any size
        texts = source.join(wanted.hint("merge"), same).select("class", "component", "members", "text")
        new = verified(texts, threshold)
        if shares is not None:
            new = new.unionByName(shares.join(wanted.select("class"), "class", "left_anti"))
        shares = stage(new, "links")
        weight = F.coalesce(F.sum(F.get("weights", F.lit(further))), F.lit(0.0)).alias("weight")
        total = shares.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), weight).first()
        if total.pairs >= recall * total.weight:
            break
    return shares


def grouped(documents: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: doc_id, text_hash, class, class_id (smallest doc_id of its class), n_links (other classes that
    its class is linked to), group_id (smallest doc_id connected by links) and `first` (the row stands for its group).

    Rows without a word have no class; they are their own class and group.
    """
    source = documents.select("doc_id", F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    docs = stage(sketched(source).drop("text"), "sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash"))  # null ids come last
    path = [F.first("nodes").alias("nodes"), F.first("tails").alias("tails")]
    classes = docs.filter("class IS NOT NULL").groupBy("class").agg(least.alias("rep"), *path)
    classes = stage(classes.select("class", "rep.doc_id", "rep.text_hash", "nodes", "tails"), "classes")
    shares = linked(source, classes, threshold)
    links = shares.groupBy("class").agg(F.sum("links").alias("links"))
    edges = shares.filter("class <> root").select(F.col("class").alias("a"), F.col("root").alias("b"))
    groups = components(edges).select(F.col("node").alias("class"), "component")
    classes = classes.select("class", "doc_id", "text_hash").join(links, "class", "left").join(groups, "class", "left")
    classes = classes.withColumn("group", F.coalesce("component", "class"))
    leaders = classes.groupBy("group").agg(least.alias("leader"))
    classes = classes.join(leaders, "group").select(
        "class", F.col("doc_id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
        F.col("leader.doc_id").alias("group_id"), F.col("leader.text_hash").alias("leader_hash"),
    )
    alone = F.col("class").isNull()
    return docs.drop("nodes", "tails").join(classes, "class", "left").select(
        "doc_id", "text_hash", "class",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"),
        (alone | F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("text_hash") == F.col("leader_hash"))).alias("first"),
    )
