"""Near-duplicate documents by consistent weighted sampling (operator 3).

1. Document frequencies of five-word shingles over all documents. Shingles on more
   than ``SHARE`` of the documents have their exact count, rarer ones share the
   weight of that floor. They are found in two passes without a shuffle of all
   shingles: a shingle that frequent must, summed over the blocks of documents
   where it is on at least half that share, reach half that share of all
   documents; so few can that they are then counted exactly.
2. Each text gets ``BANDS`` * ``ROWS`` samples (``icws``), hashed band by band. Texts
   with equal words are one node from here on, whatever their number.
3. Nodes that share a band key meet in a bucket. Every bucket has a leader, its
   smallest node. A member is first compared with the leader it shares most
   bands with, then with the leaders outside its component; both are as many
   pairs as there are members. Buckets that still join several components are
   cut into blocks; a task holds two blocks of a bucket and compares all nodes
   of different components in them, but it returns no more than the links that
   join these components. Nodes whose samples agree with no such node (``AGREE``)
   are left out before texts are moved.
4. A pair is a link if the weighted Jaccard similarity of the whole texts is at
   least ``SIMILARITY``. Components of links are the classes.

A true pair is missed only if it shares no band, at similarity 0.8 with chance
(1 - 0.8^4)^16 = 2e-4, or if fewer than AGREE of its 64 samples agree (1e-4).

Defined results: null texts and texts without words are classes of their own;
a text of fewer than five words is one shingle; repeated rows are copies of each
other; the class id is the smallest doc_id of the class (null if it has none);
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from patchlore.llm import icws
from patchlore.llm.registry import query, table
from patchlore.llm.tokens import forget, release, text_slices, tidy
from patchlore.session import cut

SIMILARITY = 0.8
BANDS, ROWS = 16, 4
SHARE = 0.01              # floor of a document frequency, as a share of the documents
BLOCK_DOCS = 1 << 14
BLOCK_SHINGLES = 1 << 21
MEMO_TEXTS = 20_000       # signatures a task remembers for exact copies
AGREE = 39                # of BANDS * ROWS samples: at SIMILARITY as rarely missed as by the bands
BLOCK_NODES = 512
BROADCAST_ROWS = 2_000_000

Pass = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has few rows; beyond that Spark shuffles it."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def counted(hashes: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(numbers.astype(np.int64))], names=["shingle", "n"])


def frequent_in_blocks(share: float) -> Pass:
    """(shingle, count) of shingles on at least ``share`` of a block; counts may include repeats within a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[np.ndarray] = []
        docs = 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate(block)
            block.clear()
            h.sort()
            least = max(1, math.ceil(share * docs))  # one of so many stands this far behind an equal one; runs are counted for these alone
            many = np.unique(h[least - 1:][h[least - 1:] == h[:max(0, len(h) - least + 1)]])
            return counted(many, np.minimum(np.searchsorted(h, many, "right") - np.searchsorted(h, many), docs))

        forget()
        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                block.append(icws.all_shingles(icws.words_of(texts))[0])
                docs += len(texts)
                if docs >= BLOCK_DOCS or sum(map(len, block)) >= BLOCK_SHINGLES:
                    yield flush()
                    docs = 0
        if docs:
            yield flush()
    return run


def documents_with(known: np.ndarray) -> Pass:
    """(shingle, documents) of the given shingles, exact for each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                h, text = icws.all_shingles(icws.words_of(texts))
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                total += np.bincount(np.unique(text[hit] * len(known) + at[hit]) % len(known), minlength=len(known))
        yield counted(known[total > 0], total[total > 0])
    return run


def shingle_weights(docs: DataFrame, text_col: str = "text", share: float = 0.2) -> icws.Weights:
    """Inverse document frequencies over all of ``docs``: log(1 + documents / max(count, share * documents))."""
    texts = docs.select(F.col(text_col).alias("text"))
    total = docs.count()
    rare = math.log(1 + 1 / share)
    none = icws.Weights(np.zeros(0, np.uint64), np.zeros(0), rare)
    summed = lambda df: df.groupBy("shingle").agg(F.sum("n").alias("n"))
    # At most (shingles per document) * 2 / share rows can pass.
    likely = summed(texts.mapInArrow(tidy(frequent_in_blocks(share / 2)), "shingle long, n long")).filter(F.col("n") >= F.lit(total * share / 2))
    known = np.sort(np.array([r[0] for r in likely.collect()], dtype=np.int64).view(np.uint64))
    if not len(known):
        return none
    exact = summed(texts.mapInArrow(tidy(documents_with(known)), "shingle long, n long")).filter(F.col("n") > F.lit(total * share))
    rows = sorted((np.int64(r[0]).view(np.uint64), r[1]) for r in exact.collect())
    if not rows:
        return none
    return icws.Weights(np.array([h for h, _ in rows], dtype=np.uint64), np.array([math.log(1 + total / n) for _, n in rows]), rare)


def signatures(docs: DataFrame, weights: icws.Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, node, bands, codes): node is a fingerprint of the words, null without words; codes has 16 bits of each sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        memo: dict[bytes, tuple[np.ndarray, bytes]] = {}
        for batch in batches:
            for lo, texts in text_slices(batch.column(2), 1 << 19):
                words = icws.words_of(texts)
                nodes = [icws.fingerprint(words.text(i)) for i in range(len(texts))]
                if len(memo) > MEMO_TEXTS:
                    memo.clear()
                new = {n: i for i, n in enumerate(nodes) if n is not None and n not in memo}
                if new:
                    s = icws.shingles(icws.words_of([texts[i] for i in new.values()]) if len(new) < len(texts) else words)
                    samples = icws.samples(s, weights.of(s), BANDS * ROWS)
                    short = samples.astype(np.uint16)
                    memo.update(zip(new, zip(icws.band_keys(samples, ROWS), (x.tobytes() for x in short), strict=True), strict=True))
                own = [memo[n] for n in nodes if n is not None]
                bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([0 if n is None else BANDS for n in nodes])), pa.int32()), pa.array(np.concatenate([x for x, _ in own]) if own else np.zeros(0, np.int64)))
                part = batch.slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.binary()), bands, pa.array([None if n is None else memo[n][1] for n in nodes], pa.binary())],
                                                 names=["doc_id", "text_key", "node", "bands", "codes"])
        memo.clear()
        release()

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, text_key long, node binary, bands array<long>, codes binary")


def compare(pairs: DataFrame, texts: DataFrame, weights: icws.Weights) -> DataFrame:
    """(a, b, similarity) for pairs of nodes; ``texts`` has one text per node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, tb in text_slices(batch.column(3), 1 << 19):
                a, b, ta = (batch.column(i).slice(lo, len(tb)).to_pylist() for i in range(3))
                own = dict(zip(a, ta, strict=True)) | dict(zip(b, tb, strict=True))
                s = icws.shingles(icws.words_of(list(own.values())))
                w = weights.of(s)
                at = {n: slice(s.bounds[i], s.bounds[i + 1]) for i, n in enumerate(own)}
                sims = [icws.similarity(s.hashes[at[x]], w[at[x]], s.hashes[at[y]], w[at[y]]) for x, y in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])
        release()

    both = pairs.select("a", "b").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    both = both.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary, similarity double")


def in_blocks(members: DataFrame, size: int, *carried: str) -> DataFrame:
    """Members (key, node, root, carried) copied into every pair of blocks (lead, led) they belong to, with their block ``at``.

    The nodes outside a bucket's largest component are dealt into blocks, and so
    is the largest one; each of the former blocks meets every block.
    """
    per_root = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = per_root.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("all")).select("key", F.col("m.root").alias("top"), F.col("m.n").alias("n_top"), "all")
    fan = lambda n: F.ceil(n / F.lit(size)).cast("long")
    m = members.join(largest, "key").withColumn("major", F.col("root") == F.col("top")).withColumns({"minors": fan(F.col("all") - F.col("n_top")), "majors": fan(F.col("n_top"))})
    m = m.withColumn("at", F.when(F.col("major"), F.pmod(F.xxhash64("node"), F.col("majors")) + F.col("minors")).otherwise(F.pmod(F.xxhash64("node"), F.col("minors"))))
    none = F.array().cast("array<struct<lead:bigint,led:bigint>>")
    # A minor block leads its pairs with itself, later minor blocks and all major blocks; any block follows earlier minor ones.
    leads = F.when(F.col("major"), none).otherwise(F.transform(F.sequence(F.col("at"), F.col("minors") + F.col("majors") - 1), lambda x: F.struct(F.col("at").alias("lead"), x.alias("led"))))
    last = F.when(F.col("major"), F.col("minors") - 1).otherwise(F.col("at") - 1)
    follows = F.when(last >= 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0).cast("long"))), lambda x: F.struct(x.alias("lead"), F.col("at").alias("led")))).otherwise(none)
    return m.select("key", F.explode(F.concat(leads, follows)).alias("p"), "at", "node", "root", *carried).select("key", "p.lead", "p.led", "at", "node", "root", *carried)


def sides(key: tuple, t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, numbered components, and the positions of the leading and the led block."""
    at = t.column("at").to_numpy()
    _, root = np.unique(np.array(t.column("root").to_pylist(), dtype=object), return_inverse=True)
    return np.array(t.column("node").to_pylist(), dtype=object), root, np.flatnonzero(at == key[1].as_py()), np.flatnonzero(at == key[2].as_py())


def with_partners(members: DataFrame) -> DataFrame:
    """Nodes that agree in AGREE samples with a node of another component in their bucket; ``members`` carries codes."""
    def meet(key: tuple, t: pa.Table) -> pa.Table:
        node, root, left, right = sides(key, t)
        codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), dtype=np.uint16).reshape(len(node), -1)
        seen = np.zeros(len(node), dtype=bool)
        for i in left:
            hit = right[((codes[right] == codes[i]).sum(axis=1) >= AGREE) & (root[right] != root[i])]
            seen[hit] = True
            seen[i] |= len(hit) > 0
        return pa.table({"node": pa.array(node[seen].tolist(), pa.binary())})

    return in_blocks(members, BLOCK_NODES, "codes").groupBy("key", "lead", "led").applyInArrow(meet, "node binary").distinct()


def joining_links(members: DataFrame, weights: icws.Weights, least: float) -> DataFrame:
    """(a, b) links between components; ``members`` carries bands and text.

    A pair that shares several buckets is compared in the one of its first common
    band. A task joins components as it goes, so it returns a tree of links.
    """
    def meet(key: tuple, t: pa.Table) -> pa.Table:
        node, root, left, right = sides(key, t)
        bands = np.array(t.column("bands").to_pylist(), dtype=np.int64).reshape(len(node), -1)
        s = icws.shingles(icws.words_of(t.column("text").to_pylist()))
        w = weights.of(s)
        total = np.add.reduceat(np.append(w, 0), s.bounds[:-1])
        _, number = np.unique(s.hashes, return_inverse=True)
        own = np.zeros(number.max() + 1)
        band = np.argmax(bands == key[0].as_py(), axis=1)
        found: list[tuple[bytes, bytes]] = []
        for i in left:
            rest = right[root[right] != root[i]]
            rest = rest[np.argmax(bands[rest] == bands[i], axis=1) == band[i]]
            if not len(rest):
                continue
            mine = slice(s.bounds[i], s.bounds[i + 1])
            own[number[mine]] = w[mine]
            n = s.bounds[rest + 1] - s.bounds[rest]
            at = np.repeat(s.bounds[rest] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.add.reduceat(np.minimum(own[number[at]], w[at]), np.cumsum(n) - n)
            own[number[mine]] = 0
            for j in rest[common >= (least - 1e-9) * (total[i] + total[rest] - common)]:
                if root[i] != root[j]:
                    found.append((node[i], node[j]))
                    root[root == root[j]] = root[i]
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    return in_blocks(members, BLOCK_NODES // 2, "bands", "text").groupBy("key", "lead", "led").applyInArrow(meet, "a binary, b binary").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node; the root is the smallest node of its component.

    Each round every node hooks onto its smallest neighbour, the trees are
    flattened by pointer jumping and the links are drawn between their roots:
    at least half of the linked nodes disappear per round.
    """
    edges = cut(links.select("a", "b").distinct(), "links")
    whole: DataFrame | None = None
    while True:
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(ways.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "hooks")
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            up = cut(up.join(above, "root").select("node", F.col("higher").alias("root"), (F.col("higher") != F.col("root")).alias("moved")), "jumps")
            if not up.filter("moved").limit(1).count():
                break
            up = up.drop("moved")
        up = up.select("node", "root")
        if whole is None:
            whole = up
        else:
            whole = cut(whole.join(up.select(F.col("node").alias("root"), F.col("root").alias("higher")), "root", "left").select("node", F.coalesce("higher", "root").alias("root")), "roots")
        to_root = lambda end: up.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))  # noqa: E731, B023
        edges = cut(edges.join(to_root("a"), "a").join(to_root("b"), "b").filter(F.col("a_root") != F.col("b_root"))
                    .select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "links")
        if not edges.limit(1).count():
            return whole


def with_root(df: DataFrame, roots: DataFrame | None, node: str, name: str) -> DataFrame:
    if roots is None:
        return df.withColumn(name, F.col(node))
    return df.join(roots.select(F.col("node").alias(node), F.col("root").alias("_r")), node, "left").withColumn(name, F.coalesce("_r", node)).drop("_r")


def find_links(nodes: DataFrame, docs: DataFrame, weights: icws.Weights, least: float, id_col: str, text_col: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Links (a, b) between nodes and their components, both null if there are none."""
    members = nodes.select("node", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("a")).filter("n > 1").select("key", "a")
    buckets = cut(members.join(shared, "key"), "buckets")  # (key, node, a), leaders included
    if not buckets.limit(1).count():
        return None, None
    wanted = cut(buckets.select("node").distinct().join(nodes.select("node", "doc_id", "text_key"), "node"), "wanted")
    found = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("text"))
    hit = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key"))
    texts = found.join(small(wanted), hit).select("node", "text")
    texts = cut(texts if not repeated(wanted, docs, id_col) else texts.dropDuplicates(["node"]), "texts")

    def links_of(pairs: DataFrame) -> DataFrame:
        return cut(compare(pairs, texts, weights).filter(F.col("similarity") >= least - 1e-9).select("a", "b"), "links")

    def grown(links: DataFrame, more: DataFrame, roots: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        if not more.limit(1).count():
            return links, roots
        links = links.unionByName(more)
        return links, components(links)

    pairs = cut(buckets.filter(F.col("node") != F.col("a")).groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("n")), "pairs")
    best = pairs.groupBy("b").agg(F.max(F.struct("n", "a")).alias("m")).select("m.a", "b")
    links = links_of(best)
    roots = components(links) if links.limit(1).count() else None
    apart = with_root(with_root(pairs.join(best, ["a", "b"], "left_anti"), roots, "a", "a_root"), roots, "b", "b_root").filter(F.col("a_root") != F.col("b_root"))
    links, roots = grown(links, links_of(apart), roots)

    members = cut(with_root(buckets.select("key", "node"), roots, "node", "root"), "members")
    open_ = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter((F.col("lo") != F.col("hi")) & (F.col("n") > 2)).select("key")
    members = cut(members.join(open_, "key"), "open")
    some = cut(with_partners(members.join(nodes.select("node", "codes"), "node")), "partners")
    rest = members.join(some, "node").join(nodes.select("node", "bands"), "node").join(texts, "node")
    return grown(links, cut(joining_links(rest, weights, least), "joining"), roots)


def repeated(wanted: DataFrame, docs: DataFrame, id_col: str) -> bool:
    """Does any id occur in several rows?"""
    return bool(docs.groupBy(id_col).count().filter("count > 1").limit(1).count())


def headed(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, head) for every row of ``docs``: head is the first (no_id, doc_id, text_key) of its class, null for a text without words."""
    weights = shingle_weights(docs, text_col, SHARE)
    signed = cut(signatures(docs, weights, id_col, text_col), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    nodes = cut(signed.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("m"), F.first("bands").alias("bands"), F.first("codes").alias("codes"), first.alias("first"))
                .select("node", "m.doc_id", "m.text_key", "bands", "codes", "first"), "nodes")
    _, roots = find_links(nodes, docs, weights, least, id_col, text_col)
    placed = with_root(nodes.select("node", "first"), roots, "node", "root")
    heads = placed.groupBy("root").agg(F.min("first").alias("head"))
    named = cut(placed.join(heads, "root").select("node", "head"), "classes")
    return signed.select("doc_id", "text_key", "node").join(named, "node", "left").select("doc_id", "text_key", "head")


def classes(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, class_id, kept) for every row of ``docs``."""
    out = headed(docs, least, id_col, text_col)
    own = F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id"))
    return out.select("doc_id", "text_key", own.alias("class_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: one row of each class, that with the smallest doc_id and then text_key; a class of null ids keeps one as well."""
    found = cut(headed(docs), "kept")
    stays = F.col("head").isNull() | F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key"))

    def match(pairs: DataFrame) -> Column:
        return docs["doc_id"].cast("long").eqNullSafe(pairs["_gone_id"]) & (F.xxhash64(docs["text"]) == pairs["_gone_key"])

    pair = [F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")]
    gone = small(cut(found.filter(~stays).select(*pair).distinct(), "gone"))
    left = docs.join(gone, match(gone), "left_anti")
    # A row without id and words is a class of its own; other repeated rows are one.
    twice = cut(found.filter(stays & (F.col("head").isNotNull() | F.col("doc_id").isNotNull())).select(*pair).groupBy("_gone_id", "_gone_key").count().filter("count > 1").drop("count"), "twice")
    if not twice.limit(1).count():
        return left
    twice = small(twice)
    return left.join(twice, match(twice), "left_anti").unionByName(left.join(twice, match(twice), "left_semi").dropDuplicates(["doc_id", "text"]))


@query("op3_near_duplicates")
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")
