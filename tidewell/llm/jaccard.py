"""Near duplicates by n-gram Jaccard similarity: a grouped prefix join.

1. Every text becomes the set of its word n-grams, hashed. Equal sets are one class.
2. All (n-gram, class) entries meet in buckets of the n-gram, which gives each n-gram's frequency.
   N-grams order by frequency, then hash. A set's prefix is its first n - ceil(0.8 n) + 1 n-grams:
   sets that link share one of them. N-grams of one class alone come first, so a set with as many
   of these as its prefix is long links with nothing, and is done.
3. Sets with the same prefix and size form a group. Groups that share a prefix n-gram, and whose
   sizes allow the similarity, are candidates. They are held together as clusters, by one edge
   per n-gram and group, never as all pairs.
4. In each cluster all groups are first verified against the centres of their n-grams. Members that
   are not linked to the cluster's main component by then are compared, in blocks of their own,
   with every block of members.
5. Components of the verified links, expanded to all documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.common import components, join_by_key, partitions, stage
from tidewell.llm.hashing import BYTES, Spans, mix, pack, tidied, tidy, unpack

NGRAM = 5
NUMERATOR, DENOMINATOR = 80, 100
CHUNK = 1 << 18  # bytes hashed at a time, in some 20 arrays of eight times that
FLUSH = 1_500_000  # entries a task holds before it sends them
BUCKET_BYTES = 4 << 20  # text per bucket of n-grams
BLOCK = 1_024  # members of a cluster, and as many that ask, which one task holds about
BLOCK_GRAMS = 1 << 20  # and n-grams of either
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLDED = BYTES.copy()
FOLDED[0x41:0x5B] = BYTES[0x61:0x7B]  # A-Z hash as a-z


def shingle_sets(texts: list[bytes], n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """All distinct n-grams of each text, as sorted hashes in a row, and how many each has."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    word = ~SPACE[buffer]
    edge = np.diff(np.concatenate([[False], word]).astype(np.int8), append=-1 if len(word) and word[-1] else 0)
    begins = np.flatnonzero(edge[: len(buffer)] == 1)
    ends = np.flatnonzero(edge == -1)
    words = Spans(buffer, FOLDED).at(begins, ends)
    owner = np.searchsorted(np.cumsum(lengths), begins, "right")
    counts = np.bincount(owner, minlength=len(texts))
    # the n-gram that begins at a word: its words' hashes, each turned by its place
    grams = np.zeros(len(words), np.uint64)
    for k in range(n):
        part = mix(words[k:] + np.uint64(k + 1))
        grams[: len(part)] = grams[: len(part)] * np.uint64(0x9E3779B97F4A7C15) + part
    short = np.minimum(counts, n)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    place = np.arange(len(words)) - first[owner]
    valid = place <= counts[owner] - short[owner]
    for j in np.flatnonzero((counts > 0) & (counts < n)):  # the whole sequence is the one n-gram
        whole = np.zeros(1, np.uint64)
        for k in range(counts[j]):
            part = mix(words[first[j] + k : first[j] + k + 1] + np.uint64(k + 1))
            whole = whole * np.uint64(0x9E3779B97F4A7C15) + part
        grams[first[j]] = mix(whole + np.uint64(counts[j]))[0]
    grams, owner = mix(grams[valid]), owner[valid]
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.bincount(owner[new], minlength=len(texts))


def _digest(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    for batch in batches:
        names, texts, size = [], [], 0
        for name, raw in zip(batch.column(0), batch.column(1), strict=True):
            names.append(name.as_py())
            texts.append(raw.as_py() or b"")
            size += len(texts[-1])
            if size >= CHUNK:
                yield names, texts
                names, texts, size = [], [], 0
        if names:
            yield names, texts


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    for names, texts in _chunks(batches):
        grams, sizes = shingle_sets(texts)
        ends = np.cumsum(sizes)
        digests = np.array([_digest(grams[e - s : e]) for s, e in zip(sizes, ends, strict=True)], np.int64)
        yield names, grams, sizes, digests


def _entries(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed (n-gram, class) entries, one row per bucket and flush."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    count = 0
    kinds = [("bucket", pa.int32()), *((c, pa.binary()) for c in ("gram", "owner", "digest", "size"))]

    def flush() -> pa.RecordBatch:
        nonlocal count
        digests = np.concatenate([h[2] for h in held])
        sizes = np.concatenate([h[1] for h in held])
        grams = np.concatenate([h[0] for h in held])
        held.clear()
        count = 0
        # one of each class is enough
        chosen = np.unique(digests, return_index=True)[1]
        keep = np.zeros(len(digests), bool)
        keep[chosen] = True
        owner = np.repeat(np.arange(len(digests)), sizes)
        mine = keep[owner]
        grams, owner = grams[mine], owner[mine]
        bucket = ((grams >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        grams, owner = grams[order], owner[order]
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(edges)):
            g, o = grams[edges[b] : edges[b + 1]], owner[edges[b] : edges[b + 1]]
            names, place = np.unique(o, return_inverse=True)
            by_gram = np.argsort(g, kind="stable")
            rows.append(
                (int(b), pack(g[by_gram], 5), pack(place[by_gram], 3), pack(digests[names], 8), pack(sizes[names], 4))
            )
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c for c, _ in kinds]
        )

    for _, grams, sizes, digests in _sets(batches):
        if len(grams):
            held.append((grams, sizes, digests))
            count += len(grams)
        if count >= FLUSH:
            yield flush()
    if count:
        yield flush()
    tidy()


def _shared(table: pa.Table, class_buckets: int) -> pa.Table:
    """N-grams of several classes go back to these classes, with their frequency."""
    bucket = table.column("bucket")[0].as_py()
    grams, digests, sizes = [], [], []
    for g, o, d, s in zip(*(table.column(c).to_pylist() for c in ("gram", "owner", "digest", "size")), strict=True):
        place = unpack([o], 3).astype(np.int64)
        grams.append(unpack([g], 5))
        digests.append(unpack([d], 8).view(np.int64)[place])
        sizes.append(unpack([s], 4)[place])
    gram, digest, size = map(np.concatenate, (grams, digests, sizes))
    del grams, digests, sizes
    order = np.lexsort((digest, gram))
    gram, digest, size = gram[order], digest[order], size[order]
    new_gram = np.ones(len(gram), bool)
    new_gram[1:] = gram[1:] != gram[:-1]
    new = new_gram.copy()
    new[1:] |= digest[1:] != digest[:-1]
    gram, digest, size, new_gram = gram[new], digest[new], size[new], new_gram[new]
    group = np.cumsum(new_gram) - 1
    often = np.bincount(group)[group]
    keep = often > 1
    gram, digest, size, often = gram[keep], digest[keep], size[keep], often[keep]
    # the bucket is part of the n-gram's hash that was not sent
    gram = mix(gram * np.uint64(1 << 20) + np.uint64(bucket))
    to = (mix(digest.view(np.uint64)) >> np.uint64(20)) % np.uint64(class_buckets)
    order = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[order], np.arange(class_buckets + 1))
    out: list[list] = [[], [], [], [], []]
    for b in np.flatnonzero(np.diff(edges)):
        part = order[edges[b] : edges[b + 1]]
        for k, value in enumerate(
            (int(b), pack(gram[part], 8), pack(digest[part], 8), pack(size[part], 4), pack(often[part], 5))
        ):
            out[k].append(value)
    kinds = (pa.int32(), *[pa.binary()] * 4)
    return pa.table(dict(zip(("to", "gram", "digest", "size", "often"), (pa.array(o, t) for o, t in zip(out, kinds, strict=True)), strict=True)))


def _candidates(table: pa.Table) -> pa.Table:
    """Classes that may link: their prefix, group, and all n-grams they share with others."""
    gram, digest, size, often = (
        unpack(table.column(c).to_pylist(), w) for c, w in (("gram", 8), ("digest", 8), ("size", 4), ("often", 5))
    )
    digest = digest.view(np.int64)
    order = np.lexsort((gram, often, digest))
    gram, digest, size, often = gram[order], digest[order], size[order].astype(np.int64), often[order]
    starts = np.flatnonzero(np.concatenate([[True], digest[1:] != digest[:-1]])) if len(digest) else np.zeros(0, int)
    ends = np.append(starts[1:], len(digest))
    n = size[starts]
    own = n - (ends - starts)
    prefix = n - -(-NUMERATOR * n // DENOMINATOR) + 1
    rows: list[list] = [[], [], [], [], [], []]
    for k in np.flatnonzero(own < prefix):
        mine = gram[starts[k] : ends[k]]
        first = mine[: prefix[k] - own[k]]
        # own n-grams in the prefix make it unlike any other
        name = _digest(np.concatenate([first, n[k : k + 1].astype(np.uint64)])) if own[k] == 0 else int(digest[starts[k]])
        for column, value in zip(
            rows,
            (int(digest[starts[k]]), int(n[k]), name, first.view(np.int64), float(np.log(often[starts[k] : ends[k]].astype(float)).sum() / n[k]), np.sort(mine).tobytes()),
            strict=True,
        ):
            column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.binary())
    return pa.table(dict(zip(("digest", "n", "grp", "prefix", "centrality", "grams"), (pa.array(r, t) for r, t in zip(rows, kinds, strict=True)), strict=True)))


def _links(sizes_a, sizes_b, common):
    """100 * intersection >= 80 * union."""
    return DENOMINATOR * common >= NUMERATOR * (sizes_a + sizes_b - common)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, na, nb, ga, gb = (batch.column(k) for k in range(6))
        keep = []
        for x, y, m, n in zip(ga, gb, na.to_pylist(), nb.to_pylist(), strict=True):
            left, right = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            common = len(np.intersect1d(left, right, assume_unique=True))
            keep.append(bool(_links(m, n, common)))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])


def _compare(table: pa.Table) -> pa.Table:
    """Links of one block of a cluster's probes with one of its members, one for each of their components."""
    kinds = {"a": pa.int64(), "b": pa.int64()}
    asks = table.column("asks")
    probes, members = table.filter(asks), table.filter(pc.invert(asks))
    if not probes.num_rows or not members.num_rows:
        return pa.table({c: pa.array([], t) for c, t in kinds.items()})
    m_id, m_n, m_root = (members.column(c).to_numpy() for c in ("digest", "n", "root"))
    sets = [np.frombuffer(x, np.uint64) for x in members.column("grams").to_pylist()]
    gram = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    order = np.argsort(gram, kind="stable")
    gram, who = gram[order], who[order]
    a, b = [], []
    for p_id, p_n, p_root, raw in zip(
        *(probes.column(c).to_pylist() for c in ("digest", "n", "root", "grams")), strict=True
    ):
        mine = np.frombuffer(raw, np.uint64)
        left, right = np.searchsorted(gram, mine, "left"), np.searchsorted(gram, mine, "right")
        total = right - left
        hit = np.repeat(left - np.concatenate([[0], np.cumsum(total)])[:-1], total) + np.arange(total.sum())
        common = np.bincount(who[hit], minlength=len(sets))
        good = np.flatnonzero(_links(p_n, m_n, common) & (m_root != p_root) & (m_id != p_id))
        found = good[np.unique(m_root[good], return_index=True)[1]]
        a.extend([p_id] * len(found))
        b.extend(m_id[found].tolist())
    return pa.table({"a": pa.array(a, kinds["a"]), "b": pa.array(b, kinds["b"])})


def _classes(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """(owners: doc_id, mark, n_shingles, set_id per row) and (sets: set_id, m, root, component)."""
    spark = docs.sparkSession
    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("binary").alias("text"), F.xxhash64(text_column).alias("mark"))
    total = docs.agg(F.sum(F.octet_length(F.col(text_column)))).first()[0] or 0
    buckets = max(partitions(spark), -(-total // BUCKET_BYTES))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, _, n, digests in _sets(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k["doc_id"] for k in names], pa.int64()), pa.array([k["mark"] for k in names], pa.int64()), pa.array(n, pa.int64()), pa.array(digests, pa.int64())],
                names=["doc_id", "mark", "n_shingles", "set_id"],
            )
        tidy()

    owners = stage(
        named.select(F.struct("doc_id", "mark"), "text").mapInArrow(
            sizes, "doc_id long, mark long, n_shingles long, set_id long"
        ),
        "jaccard-sizes",
    )
    classes = stage(
        named.select("doc_id", "text")
        .mapInArrow(lambda it: _entries(it, buckets), "bucket int, gram binary, owner binary, digest binary, size binary")
        .groupBy("bucket")
        .applyInArrow(tidied(lambda t: _shared(t, buckets)), "to int, gram binary, digest binary, size binary, often binary")
        .groupBy("to")
        .applyInArrow(tidied(_candidates), "digest long, n long, grp long, prefix array<long>, centrality double, grams binary"),
        "jaccard-classes",
    )
    # Members of a group: any two of them share their prefix, but each is verified by itself below.
    entries = stage(
        classes.select("digest", "n", "grp", "centrality", F.explode("prefix").alias("gram")), "jaccard-prefixes"
    )
    groups = entries.groupBy("gram", "grp").agg(
        F.max_by("digest", F.struct("centrality", "digest")).alias("digest"),
        F.max("centrality").alias("centrality"),
        F.first("n").alias("n"),
    )
    centres = groups.groupBy("gram").agg(
        F.max_by("digest", F.struct("centrality", "digest")).alias("centre"), F.count("*").alias("m")
    )
    n_entries = entries.count()
    stars = stage(
        join_by_key(entries.select("gram", "digest"), centres, "gram", "m", n_entries)
        .filter("digest <> centre")
        .select(F.col("centre").alias("a"), F.col("digest").alias("b"))
        .distinct(),
        "jaccard-stars",
    )
    sets = classes.select("digest", "n", "grams")
    pairs = stars.join(
        sets.select(F.col("digest").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga")), "a"
    ).join(sets.select(F.col("digest").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb")), "b")
    fitting = (F.col("na") * DENOMINATOR >= F.col("nb") * NUMERATOR) & (
        F.col("nb") * DENOMINATOR >= F.col("na") * NUMERATOR
    )
    first = stage(
        pairs.filter(fitting).select("a", "b", "na", "nb", "ga", "gb").mapInArrow(_verify, "a long, b long"),
        "jaccard-links",
    )
    cluster = components(stars, "jaccard-clusters").withColumnRenamed("root", "cluster")
    linked = components(first, "jaccard-linked")
    members = stage(
        cluster.join(linked, "node", "left")
        .select("cluster", F.col("node").alias("digest"), F.coalesce("root", "node").alias("root"))
        .join(sets, "digest"),
        "jaccard-members",
    )
    mass = members.groupBy("cluster", "root").agg(F.count("*").alias("m"), F.sum("n").alias("grams"))
    main = mass.groupBy("cluster").agg(
        F.max_by(F.struct("root", "m", "grams"), F.struct("m", "root")).alias("main"),
        F.sum("m").alias("all"),
        F.sum("grams").alias("grams"),
    )

    def blocks_of(members: Column, grams: Column) -> Column:
        return F.ceil(F.greatest(members / BLOCK, grams / BLOCK_GRAMS)).cast("int")

    # nothing is open in a cluster that is one component
    open_clusters = stage(
        main.filter(F.col("main.m") < F.col("all")).select(
            "cluster",
            F.col("main.root").alias("main"),
            blocks_of(F.col("all"), F.col("grams")).alias("blocks"),
            blocks_of(F.col("all") - F.col("main.m"), F.col("grams") - F.col("main.grams")).alias("sides"),
        ),
        "jaccard-open",
    )
    facing = members.join(open_clusters, "cluster")

    def dealt(over: str) -> Column:
        return F.pmod(F.xxhash64("digest"), F.col(over)).cast("int")

    def every(over: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(over) - 1))

    # a block of members meets a block of probes in one task
    blocks = facing.withColumn("block", dealt("blocks")).withColumn("side", every("sides"))
    probes = (
        facing.filter(F.col("root") != F.col("main"))
        .withColumn("side", dealt("sides"))
        .withColumn("block", every("blocks"))
    )
    columns = ("cluster", "block", "side", "digest", "n", "root", "grams")
    second = (
        probes.select(*columns, F.lit(True).alias("asks"))
        .unionByName(blocks.select(*columns, F.lit(False).alias("asks")))
        .groupBy("cluster", "block", "side")
        .applyInArrow(_compare, "a long, b long")
    )
    roots = components(first.unionByName(second), "jaccard-components")
    found = stage(
        owners.groupBy("set_id")
        .agg(F.min("doc_id").alias("least"), F.count("*").alias("m"))
        .join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
        .select("set_id", "least", "m", F.coalesce("root", "set_id").alias("root")),
        "jaccard-roots",
    )
    names = found.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("sets"))
    n_sets = found.count()
    return owners, join_by_key(found, names, "root", "sets", n_sets).select("set_id", "m", "root", "component")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row's n-gram set size and component under the relation of Jaccard similarity >= 0.8.

    Words are what ASCII white space separates, with A-Z lower-cased; the set holds the distinct
    runs of five words, or of all words where there are fewer. Returns per row: doc_id, n_shingles,
    component_id (smallest id reachable by links, itself included) and set_id (equal for equal
    sets). Rows without words have an empty set, link with nothing and are their own component.
    Repeated rows are equal sets. Null ids take part but name a component only if it has no other
    id. No rows give no rows. Other columns are ignored.
    """
    owners, sets = _classes(docs, id_column, text_column)
    return join_by_key(owners, sets.select("set_id", "m", "component"), "set_id", "m", owners.count()).select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        "set_id",
    )


def one_per_group(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay when each component keeps its document of smallest id (null ids last).

    Rows without words belong to no group, so all of them stay. Of repeated rows of one document
    one stays. All columns are kept.
    """
    owners, sets = _classes(docs, id_column, text_column)
    rooted = join_by_key(
        owners.filter("n_shingles > 0"), sets.select("set_id", "m", "root"), "set_id", "m", owners.count()
    )
    rank = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "mark")
    first = rooted.groupBy("root").agg(F.min(rank).alias("k")).select("k.doc_id", "k.mark", F.lit(True).alias("one"))
    empty = owners.filter("n_shingles = 0").select("doc_id", "mark", F.lit(False).alias("one")).distinct()
    keep = stage(
        first.unionByName(empty).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("one").alias("_one")),
        "jaccard-keep",
    )
    columns = docs.columns
    marked = docs.select(
        F.struct(*[docs[c] for c in columns]).alias("_doc"),
        docs[id_column].cast("long").alias("_own_id"),
        F.xxhash64(docs[text_column]).alias("_own_mark"),
    )
    met = marked.join(keep, F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_mark") == F.col("_mark")))
    if owners.groupBy("doc_id", "mark").count().filter("count > 1").limit(1).count():
        alike = Window.partitionBy("_own_id", "_own_mark").orderBy(F.lit(0))
        met = met.withColumn("_nth", F.row_number().over(alike)).filter((F.col("_nth") == 1) | ~F.col("_one"))
    return met.select("_doc.*")
