"""N-gram Jaccard self-join by grouped prefixes.

1. Batches of documents learn from hash buckets in how many documents each of their shingles occurs. Rare shingles come
   first in the order that prefixes are cut from; a shingle of one document can't be shared and isn't sent on.
2. Documents of one shingle set are one class. Two classes can only link if their prefixes share a shingle, so classes
   that any chain of shared prefix shingles joins form a cluster, and clusters (in blocks, if they are large) are dealt
   out to bins of bounded size.
3. Within a bin, classes of the same prefix and size form a group. Pairs of groups that share a prefix shingle and pass
   the size filter are expanded to members, and members verified on their whole sets. Members that are in one component
   by then aren't verified again, and only links that join components leave the task.
4. A cluster beyond one block is joined within two different blockings first; whatever is then outside its largest
   component is verified against all of the cluster. Every pair is thus either verified, filtered or in one component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.batching import KEY, blobs, dealt, from_planes, in_order, packed, planes, sizes, table_of, unpacked
from cellweave.llm.components import connected
from cellweave.llm.durable import saved
from cellweave.llm.textblock import SPACED, TextBlock, Windows, by_owner, mix

SHINGLE = 3
PERCENT = 90
#: Classes and bytes of their sets in a block of a cluster, and bytes of shingle sets in a bin, about.
BLOCK_CLASSES, BLOCK_BYTES = 4096, 32 << 20
BIN_BYTES = 16 << 20
_SENT = f"bucket int, {KEY} int, hashes binary, counts binary"
_ANSWER = f"{KEY} int, bucket int, codes binary"
_MANY = np.uint64(0x2545F4914F6CDD1D)


def shingle_sets(block: TextBlock, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's distinct shingles, ascending; n+1 offsets). A text of fewer words is one shingle; of none, none."""
    windows = Windows(block.word_hashes())
    room, owner = block.room(), block.doc_of_word()
    full = np.flatnonzero(room >= words)
    hashes, owners = [windows.of(words)[full]], [owner[full]]
    for n in range(1, words):
        short = block.first[:-1][block.counts == n]
        # Another factor keeps a short text apart from a window of the same words.
        hashes.append(windows.of(n)[short] + _MANY * np.uint64(n))
        owners.append(owner[short])
    h, o = mix(np.concatenate(hashes)), np.concatenate(owners)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    return h, np.searchsorted(o, np.arange(block.n + 1))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Two sets of a Jaccard similarity of percent/100 share one of the first so many shingles of either."""
    return n - (percent * n + 99) // 100 + 1


def _cells(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


def _edges(cells: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(cells >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))


def _sender(words: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        key = table.column(KEY)[0].as_py()
        h, _ = shingle_sets(TextBlock(in_order(table).column("text"), SPACED, lower=True), words)
        cells, counts = np.unique(_cells(h, buckets), return_counts=True)
        edges = _edges(cells, buckets)
        low = (cells & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = [(int(b), slice(edges[b], edges[b + 1])) for b in np.flatnonzero(np.diff(edges))]
        return table_of([(b, key, packed(low[s]), planes(counts[s])) for b, s in at], _SENT)

    return run


def _bucket(table: pa.Table) -> pa.Table:
    """For each batch and shingle, a code of how many documents hold it: 0 for one, then finely logarithmic."""
    parts = [unpacked(x).astype(np.uint32) for x in blobs(table.column("hashes"))]
    edges = np.append(0, np.cumsum([len(p) for p in parts]))
    known, which = np.unique(np.concatenate(parts), return_inverse=True)
    counts = np.concatenate([from_planes(x) for x in blobs(table.column("counts"))])
    total = np.zeros(len(known), np.int64)
    np.add.at(total, which, counts)
    codes = np.minimum(255, np.floor(8 * np.log2(total) + 1e-9)).astype(np.uint8)
    bucket = table.column("bucket")[0].as_py()
    return table_of([(key, bucket, codes[which[edges[k] : edges[k + 1]]].tobytes()) for k, key in enumerate(table.column(KEY).to_pylist())], _ANSWER)


DETAILS = [T.StructField("n_shingles", T.LongType()), T.StructField("class", T.BinaryType()), T.StructField("prefix", T.BinaryType()), T.StructField("set", T.BinaryType())]


def _detailer(words: int, percent: int, buckets: int):
    """Each document's set size and class; its shared prefix shingles and set too, if its prefix has shared shingles."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = in_order(table)
        h, first = shingle_sets(TextBlock(table.column("text"), SPACED, lower=True), words)
        cells, which = np.unique(_cells(h, buckets), return_inverse=True)
        edges = _edges(cells, buckets)
        codes = np.zeros(len(cells), np.uint8)
        for b, x in zip(answers.column("bucket").to_pylist(), blobs(answers.column("codes"))):
            codes[edges[b] : edges[b + 1]] = np.frombuffer(x, np.uint8)
        codes = codes[which]
        n = np.diff(first)
        owner = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((h, codes, owner))
        place = np.arange(len(h)) - np.repeat(first[:-1], n)
        shared = np.zeros(len(h), bool)
        shared[:] = (place < np.repeat(prefix_length(n, percent), n)) & (codes[order] > 0)
        at = np.append(0, np.cumsum(shared))[first]
        prefix = h[order][shared]
        sums = [np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)]
        np.add.at(sums[0], owner, mix(h ^ _MANY))
        np.add.at(sums[1], owner, mix(h + _MANY))
        classes = np.stack([mix(sums[0] + n.astype(np.uint64)), mix(sums[1] ^ _MANY)], axis=1)
        some = at[1:] > at[:-1]
        rows = [(classes[k].tobytes() if n[k] else None, *((prefix[at[k] : at[k + 1]].tobytes(), h[first[k] : first[k + 1]].tobytes()) if some[k] else (None, None))) for k in range(len(n))]
        new = [pa.array(n.astype(np.int64))] + [pa.array([r[i] for r in rows], pa.binary()) for i in range(3)]
        return pa.table([table.column("row"), table.column("id"), table.column("tie"), *new], names=["row", "id", "tie", *(f.name for f in DETAILS)])

    return run


def _links(percent: int):
    """Links that join components among a bin's classes (columns class, prefix, set, component)."""

    def run(table: pa.Table) -> pa.Table:
        names = table.column("class").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in blobs(table.column("set"))]
        prefixes = [bytes(x) for x in table.column("prefix").to_pylist()]
        known = table.column("component").to_pylist()
        size = np.array([len(s) for s in sets])
        number: dict = {}
        label = np.array([number.setdefault(c if c is not None else name, len(number)) for c, name in zip(known, names)])
        members: dict[int, list[int]] = {}
        for k, x in enumerate(label.tolist()):
            members.setdefault(x, []).append(k)
        groups: dict[tuple, list[int]] = {}
        for k in sorted(range(len(names)), key=lambda k: (size[k], names[k])):
            groups.setdefault((int(size[k]), prefixes[k]), []).append(k)
        lists = [np.array(g) for g in groups.values()]
        index: dict[int, list[int]] = {}
        rows = []
        for g, ((n, prefix), own) in enumerate(groups.items()):
            shared = np.frombuffer(prefix, np.uint64).tolist()
            found = [index[s] for s in shared if s in index]
            others = np.zeros(0, np.int64)
            if found:
                near, times = np.unique(np.concatenate([np.array(f) for f in found]), return_counts=True)
                near = near[np.argsort(-times, kind="stable")]
                near = near[[100 * size[lists[k][0]] >= percent * n for k in near]] if len(near) else near
                others = np.concatenate([lists[k] for k in near]) if len(near) else others
            for done, k in enumerate(own):
                candidates = np.concatenate([np.array(own[:done], np.int64), others])
                batch = 8
                while True:
                    candidates = candidates[label[candidates] != label[k]]
                    if not len(candidates):
                        break
                    now, candidates = candidates[:batch], candidates[batch:]
                    batch = min(4 * batch, 512)
                    common = _common(sets[k], [sets[c] for c in now])
                    for c in now[100 * common >= percent * (size[k] + size[now] - common)]:
                        x, y = int(label[k]), int(label[c])
                        if x != y:
                            rows.append((names[k], names[c]))
                            x, y = (x, y) if len(members[x]) >= len(members[y]) else (y, x)
                            label[members[y]] = x
                            members[x] += members.pop(y)
            for s in shared:
                index.setdefault(s, []).append(g)
        return table_of(rows, "a binary, b binary")

    return run


def _common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of one set with others, all ascending and not empty."""
    whole = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, whole), len(one) - 1)
    starts = np.append(0, np.cumsum([len(o) for o in others])[:-1])
    return np.add.reduceat((one[at] == whole).astype(np.int64), starts)


def _joined(dealt_out: DataFrame, bins: int, percent: int) -> DataFrame:
    """Links within each group of rows of one ``unit``; units share bins."""
    binned = dealt_out.withColumn("bin", F.pmod(F.xxhash64("unit"), F.lit(bins)))
    return binned.select("bin", "class", "prefix", "set", "component").groupBy("bin").applyInArrow(_links(percent), "a binary, b binary")


def components(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT, text: str = "text", id: str = "doc_id", batches: int | None = None, buckets: int | None = None, block_classes: int = BLOCK_CLASSES) -> DataFrame:
    """The columns of ``docs`` but the text, with n_shingles and component_id.

    A document's set holds its distinct shingles of ``words`` words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a shorter text
    is one shingle, a null or empty one has none and links with nothing. Two documents link if 100 * intersection >=
    percent * union. component_id: the smallest id that links reach, the row's own included; null ids are passed over.
    Rows are told apart by their sets, so repeated rows and ids are allowed. Sets are of 64-bit hashes. New columns replace
    those of their names.
    """
    kept = [c for c in docs.columns if c not in ("n_shingles", "component_id", text)]
    found = detailed_components(docs.select(*[f"`{c}`" for c in (*kept, text)]), words, percent, text, id, batches, buckets, block_classes)
    return found.select(*[F.col("row")[c].alias(c) for c in kept], "n_shingles", F.coalesce("least", "id").alias("component_id"))


def detailed_components(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT, text: str = "text", id: str = "doc_id", batches: int | None = None, buckets: int | None = None, block_classes: int = BLOCK_CLASSES) -> DataFrame:
    """(row, id, tie, n_shingles, component, least): a row for each document. row: its columns but the text. tie: a hash of
    its text. component: a key that linked documents share, null for an empty set. least: the smallest id of the component."""
    size = sizes(docs, text) if batches is None or buckets is None else None
    n_batches, n_buckets = batches or size.batches, buckets or size.buckets
    keyed = dealt(docs, n_batches, id, text)
    sent = keyed.groupBy(KEY).applyInArrow(_sender(words, n_buckets), _SENT)
    answers = sent.groupBy("bucket").applyInArrow(_bucket, _ANSWER)
    schema = T.StructType([*(keyed.schema[c] for c in ("row", "id", "tie")), *DETAILS])
    found = saved(keyed.groupBy(KEY).cogroup(answers.groupBy(KEY)).applyInArrow(_detailer(words, percent, n_buckets), schema))

    # One row a class. Copies have equal prefixes and sets, so any of them will do; the partial aggregation keeps one a task.
    classes = saved(found.where("class is not null").groupBy("class").agg(F.first("prefix").alias("prefix"), F.first("set").alias("set"), F.min("id").alias("least")))
    linked = connected(_class_links(classes.where("prefix is not null").select("class", "prefix", "set"), percent, block_classes))
    of_class = classes.select("class", "least").join(linked.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = of_class.groupBy("component").agg(F.min("least").alias("least"))
    of_class = of_class.select("class", "component").join(least, "component")
    return found.drop("prefix", "set").join(of_class, "class", "left").select("row", "id", "tie", "n_shingles", "component", "least")


def _class_links(classes: DataFrame, percent: int, block_classes: int) -> DataFrame:
    """Links between classes that have the same connected components as all links."""
    shingles = F.expr("transform(sequence(0, length(prefix) div 8 - 1), i -> substring(prefix, i * 8 + 1, 8))")
    postings = classes.select("class", F.explode(shingles).alias("shingle"))
    heads = postings.groupBy("shingle").agg(F.min("class").alias("head"), F.count("*").alias("n")).where("n > 1").select("shingle", "head")
    clusters = connected(postings.join(heads, "shingle").select(F.col("head").alias("a"), F.col("class").alias("b")).distinct())
    clusters = clusters.select(F.col("node").alias("class"), F.col("component").alias("cluster"))
    with_sets = clusters.join(classes, "class")
    in_cluster = with_sets.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.length("set")).alias("bytes")).where("n > 1")
    # So many blocks that one holds neither too many classes nor too many bytes of their sets.
    blocks = F.greatest(F.ceil(F.col("n") / block_classes), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    members = saved(with_sets.join(in_cluster.select("cluster", blocks.alias("blocks")), "cluster").withColumn("component", F.lit(None).cast("binary")))
    total = members.agg(F.coalesce(F.sum(F.length("set")), F.lit(0)), F.coalesce(F.max("blocks"), F.lit(0))).first()
    bins = max(1, -(-total[0] // BIN_BYTES))
    blocked = lambda seed: members.withColumn("unit", F.struct("cluster", F.pmod(F.xxhash64("class", F.lit(seed)), F.col("blocks"))))
    links = _joined(blocked(1), bins, percent)
    if total[1] <= 1:
        return links
    large = members.where("blocks > 1")
    links = saved(links.union(_joined(blocked(2).where("blocks > 1"), bins, percent)))
    now = large.drop("component").join(connected(links).withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    parts = now.groupBy("cluster", "component").agg(F.count("*").alias("in"))
    most = parts.groupBy("cluster").agg(F.max(F.struct("in", "component")).alias("most")).select("cluster", F.col("most.component").alias("largest"))
    now = saved(now.join(most, "cluster").withColumn("apart", F.col("component") != F.col("largest")))
    apart = now.where("apart").groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / block_classes), F.ceil(F.sum(F.length("set")) / BLOCK_BYTES)).cast("int").alias("chunks"))
    now = now.join(apart, "cluster")
    # A class apart meets every block in its own chunk; every class meets every chunk in its own block.
    chunk, block = F.pmod(F.xxhash64("class", F.lit(3)), F.col("chunks")).cast("int"), F.pmod(F.xxhash64("class", F.lit(4)), F.col("blocks")).cast("int")
    left = now.where("apart").withColumn("chunk", chunk).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    right = now.withColumn("block", block).withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
    met = left.unionByName(right).withColumn("unit", F.struct("cluster", "chunk", "block"))
    met = met.dropDuplicates(["unit", "class"])
    pieces = now.agg(F.coalesce(F.sum((F.col("chunks") + F.col("blocks")) * F.length("set")), F.lit(0))).first()[0]
    return links.union(_joined(met, max(1, -(-pieces // BIN_BYTES)), percent))
