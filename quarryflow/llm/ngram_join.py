"""N-gram Jaccard join: near-duplicate documents by their sets of word n-grams.

The link test is a blocked product of the sparse document by n-gram matrix with its transpose:
the columns (n-gram hashes) are dealt into blocks, each block adds its share to the overlap of
each candidate pair, and a pair whose overlap falls short of the bound that the two sizes give
is discarded.  Multiplying everything would pair all documents that share one common n-gram, so
the product is taken over fewer rows and columns without losing a link:

1. *Sets.*  Documents with equal sets form a class; one of them, the smallest doc_id, stands for
   it from here on.  Copies are never paired.
2. *Columns.*  The columns of a set fall, by the first bits of their hashes, into parts of two to
   four members.  Two linked sets of sizes x and y differ in ``d`` = (x + y) 15 / 185 members at
   most, so of the first ``d + 1`` parts of either one at least is the same in both (and of
   ``d + 1 + l`` at least ``l + 1``).  A part is one key; a passage that many texts share fills
   hardly a part alone, so keys meet in near copies and few others.  How many parts there are
   depends on the size class (powers of two); a set near the upper end of its class sends its
   parts for the next class too.  Sets of under 64 members send single members, as a set and its
   links share one of the first ``size - need + 1`` in hash order.  Should the members of a set
   fall into too few parts, it and all sets of about its size also send single members.
3. *Rows.*  A set that meets others in ``l`` parts or fewer has no link.  Of the sets left,
   members are counted and ordered by rarity; a linked set finds ``need`` of them in others.  Only
   the first ``size - need + 1`` make candidates, and those that no other set has make none.
4. *Pairs.*  Sets of about one size that share a column form a bucket.  In each round one set of
   each of the largest components in a bucket (that with the largest share of n-grams known
   elsewhere) is compared with those of the bucket not yet in its component, and leaves the
   bucket.  When few pairs across components are left they are all compared.  So a group of n near
   copies takes about n comparisons, and no pair that could join two components is left out.
   Buckets whose sets stay apart (texts made of common passages) would take a round for every few
   of them: after ``ROUNDS`` rounds they are cut into tiles of sets, and each pair of tiles is one
   dense product that gives all its overlaps; buckets with the same sets are multiplied once.

A key that several sets of one slice of rows hold is sent once under itself; the slice's other
sets go elsewhere, marked as met.  So a key held by a third of all rows costs a row a slice, and
keys are read in order and never gathered.

Hashes are 64 bits, of words hashed from a seed that each call draws anew; a class is known by set
hash and size.  Defined cases: null, empty and blank
texts have empty sets and link with nothing; a text with fewer words than an n-gram is one
n-gram; a null doc_id gets its size but a null component; rows that share a doc_id share a
component; rows that are alike count once for links and each get a row; an empty table gives an
empty result; very long texts and words are taken whole; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap_of, in_bitmap, keep_rows, materialise, row_key, slices
from .textkernel import WORD_BASE, fresh_seed, mix, ngram_hashes, span_hashes, words_of

GRAM, LEVEL = 4, 85
#: Members of a set that one block of columns holds at most, on average, for the largest set.
BLOCK = 16384
#: Bytes of text worked on at once.
SLICE = 2 << 20
#: Components of a bucket whose heads are compared with all its sets in one round.
LEADS = 8
#: Rounds after which buckets of sets that stay apart are multiplied out; sets of a tile, columns of a product.
ROUNDS, TILE, COLUMNS = 4, 256, 4096
#: Share of the pairs of a bucket that must be across components for that.
APART = 0.25
#: Comparisons of two rows of a bucket, for each row of all buckets, up to which the pairs that are left are counted.
COMPARED = 1000
#: Sets of fewer than 2**SMALL members, and all where the least similarity is below GROUPED, send single members.
SMALL, GROUPED = 6, 80
#: The size class of sets that all send single members as others of their size have too few parts.
SINGLE = 63
#: Kinds of rows that meet: not met yet, met in its slice, a set with too few parts.
ALONE, MET, ODD = 0, 1 << 8, 2 << 8


def need(size, level: int = LEVEL):
    """Least overlap with any linked set."""
    return -(-size * level // 100)


def ngram_sets(text: pa.Array, gram: int, seed: int = 0):
    """Distinct n-gram hashes of all rows, sorted by row and hash, with the row of each and the set sizes."""
    words = words_of(text, lower=True, seed=seed)
    rows = len(words.offsets) - 1
    hashes, real = ngram_hashes(words, gram)
    owner = np.repeat(np.arange(rows), np.diff(words.offsets))[: len(hashes)]
    hashes, owner = mix(hashes[real]), owner[real]
    count = np.diff(words.offsets)
    few = np.flatnonzero((count > 0) & (count < gram))
    if len(few):
        whole = mix(span_hashes(words.hashes, words.offsets[few], words.offsets[few + 1], WORD_BASE) + count[few].astype(np.uint64))
        hashes, owner = np.concatenate((hashes, whole)), np.concatenate((owner, few))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))
        hashes, owner = hashes[new], owner[new]
    sizes = np.bincount(owner, minlength=rows)
    return hashes, owner, sizes


def set_keys(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One hash for each set, the same for equal sets."""
    edges = np.concatenate(([0], np.cumsum(sizes)))
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(hashes + np.uint64(0x51)))))
    return mix((total[edges[1:]] - total[edges[:-1]]) ^ sizes.astype(np.uint64))


def _signatures(gram: int, seed: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, most=SLICE):
                hashes, _, sizes = ngram_sets(part.column("text"), gram, seed)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), pa.array(sizes.astype(np.int64)), pa.array(set_keys(hashes, sizes).view(np.int64))], ["doc_id", "row_key", "n", "sig"])

    return run


def size_class(n: np.ndarray, level: int = LEVEL) -> np.ndarray:
    """floor(log2(n)), the same for all sizes that send single members."""
    if level < GROUPED:
        return np.full(len(n), SMALL - 1)
    return np.maximum(np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1, SMALL - 1)


def spare(cls):
    """How many parts more than one two linked sets of a class share: ``l``."""
    return np.where((cls >= SMALL) & (cls < SINGLE), 1 << np.clip(cls - 5, 0, 40), 0)


def part_bits(cls: np.ndarray) -> np.ndarray:
    """log2 of the number of parts; 64 where each member is a part."""
    return np.where((cls < SMALL) | (cls == SINGLE), 64, np.where(cls == SMALL, cls, cls - 1))


def parts_of(hashes: np.ndarray, owner: np.ndarray, sizes: np.ndarray, cls: np.ndarray, level: int, halved: int = 0):
    """The parts that sets (sorted members, sizes above 0) of the given classes send: key and set of each; and which sets have too few."""
    bits = part_bits(cls)
    shift = np.uint64(64) - np.where(bits == 64, 64, bits - halved).astype(np.uint64)
    part = hashes >> shift[owner]
    first = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (owner[1:] != owner[:-1]))))
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(hashes + np.uint64(0x9D)))))
    own = owner[first]
    keys = mix((total[np.concatenate((first[1:], [len(hashes)]))] - total[first]) ^ (cls[own].astype(np.uint64) * np.uint64(WORD_BASE)))
    many = np.bincount(own, minlength=len(sizes))
    single = shift == 0
    differ = np.where(single, sizes - need(sizes, level), (sizes + sizes * 100 // level) * (100 - level) // (100 + level))
    wanted = differ + 1 + spare(cls)
    rank = np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)
    chosen = rank < wanted[own]
    return keys[chosen], own[chosen], many < wanted


def _sent(keys: np.ndarray, sigs: np.ndarray, cls: np.ndarray, odd: np.ndarray) -> pa.RecordBatch:
    """(key, salt, sig, tag) rows of one slice; of the sets that share a key, one goes under it (salt 0) and the others by their own."""
    order = np.lexsort((sigs, keys))
    keys, sigs, cls = keys[order], sigs[order], cls[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=bool)
    met = ~new
    met[:-1] |= ~new[1:]
    salt = np.where(new, np.uint64(0), (sigs & np.uint64(0xFFFF)) + np.uint64(1))
    tags = cls + np.where(met, MET, ALONE)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate((keys, odd)).view(np.int64)),
            pa.array(np.concatenate((salt, np.ones(len(odd), dtype=np.uint64))).astype(np.int32)),
            pa.array(np.concatenate((sigs, odd)).view(np.int64)),
            pa.array(np.concatenate((tags, np.full(len(odd), ODD))).astype(np.int32)),
        ],
        ["key", "salt", "sig", "tag"],
    )


def _parts(gram: int, level: int, seed: int, halved: int = 0, between: tuple[int, int] | None = None):
    """Rows of the parts of each text's set; with ``between``, single members of the sets of these sizes."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=SLICE):
                hashes, owner, sizes = ngram_sets(part.column("text"), gram, seed)
                sigs = set_keys(hashes, sizes)
                once = np.zeros(len(sizes), dtype=bool)  # equal sets of a slice count once
                once[np.unique(sigs, return_index=True)[1]] = True
                once &= sizes > 0
                if between:
                    once &= (sizes >= between[0]) & (sizes <= between[1])
                if not once.any():
                    continue
                chosen = once[owner]
                hashes, owner = hashes[chosen], (np.cumsum(once) - 1)[owner[chosen]]
                sigs, sizes = sigs[once], sizes[once]
                low, high = size_class(sizes, level), size_class(sizes * 100 // level, level)
                out = []
                if between:
                    single = np.full(len(sizes), SINGLE)
                    keys, own, _ = parts_of(hashes, owner, sizes, single, level)
                    out.append((keys, sigs[own], single[own], sigs[:0]))
                else:
                    for more in range(int((high - low).max()) + 1):
                        of = low + more <= high
                        mine = of[owner]
                        cls = (low + more)[of]
                        keys, own, few = parts_of(hashes[mine], (np.cumsum(of) - 1)[owner[mine]], sizes[of], cls, level, halved)
                        out.append((keys, sigs[of][own], cls[own], sigs[of][few]))
                yield _sent(*(np.concatenate([x[i] for x in out]) for i in range(4)))

    return run


def _meeting(batches):
    """Rows sorted by key, salt and set in; (key, sig, cls, odd) of those whose key another set has too, out.

    No group is held: of one that goes on, its first and its last row are carried over.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, salt, sig, tag = (batch.column(c).to_numpy() for c in ("key", "salt", "sig", "tag"))
        sent = np.zeros(len(key), dtype=bool)
        if held is not None:
            key, salt, sig, tag, sent = (np.concatenate((a, b)) for a, b in zip(held, (key, salt, sig, tag, sent)))
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])))
        once = np.flatnonzero(new | np.concatenate(([True], sig[1:] != sig[:-1])))
        tag, sent = np.maximum.reduceat(tag, once), np.logical_or.reduceat(sent, once)
        key, salt, sig, new = key[once], salt[once], sig[once], new[once]
        first = np.flatnonzero(new)
        sizes = np.diff(np.concatenate((first, [len(key)])))
        found = np.repeat((sizes > 1) | (np.maximum.reduceat(tag, first) >= MET), sizes)
        out = found & ~sent
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(sig[out]), pa.array((tag[out] & 0xFF).astype(np.int32)), pa.array(tag[out] >= ODD)], ["key", "sig", "cls", "odd"])
        at = sorted({int(first[-1]), len(key) - 1})
        held = tuple(x[at] for x in (key, salt, sig, tag, sent | found))


def meetings(texts: DataFrame, rows) -> DataFrame:
    sent = texts.mapInArrow(rows, "key long, salt int, sig long, tag int")
    return sent.repartition("key", "salt").sortWithinPartitions("key", "salt", "sig").mapInArrow(_meeting, "key long, sig long, cls int, odd boolean")


def _chosen_sets(flags, gram: int, seed: int):
    def run(batches):
        bitmap = flags.value
        for batch in batches:
            for part in slices(batch, most=SLICE):
                hashes, _, sizes = ngram_sets(part.column("text"), gram, seed)
                keys = set_keys(hashes, sizes)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                take = np.flatnonzero(in_bitmap(bitmap, _pair_key(keys, ids)) & (sizes > 0))
                edges = np.concatenate(([0], np.cumsum(sizes)))
                if len(take):
                    values = np.concatenate([hashes[edges[i] : edges[i + 1]] for i in take]).view(np.int64)
                    offsets = np.concatenate(([0], np.cumsum(sizes[take])))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[take].view(np.int64)), pa.array(sizes[take].astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))], ["doc", "n", "tokens"])

    return run


def _pair_key(sigs: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mix(sigs ^ mix(ids.view(np.uint64) + np.uint64(3)))


def _with_pair_key(batches):
    for b in batches:
        keys = _pair_key(b.column("sig").to_numpy().view(np.uint64), b.column("doc").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])


def connect(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (x, y) can reach, by minimum labels and pointer jumps."""
    both = materialise(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("x")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        step = materialise(step.join(jump, F.col("label") == F.col("at"), "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        labels = step.select("node", "label")
        if step.where("old != label").isEmpty():
            return labels


def _overlapping(pairs: DataFrame, blocks: DataFrame, level: int) -> DataFrame:
    """Of the pairs (a, b) with sizes na, nb those that link: overlaps added up block by block of columns."""
    left = blocks.select(F.col("doc").alias("a"), "block", F.col("tokens").alias("ta"))
    right = blocks.select(F.col("doc").alias("b"), "block", F.col("tokens").alias("tb"))
    shares = pairs.join(left, "a").join(right, ["b", "block"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).cast("long").alias("share"))
    total = shares.groupBy("a", "b", "na", "nb").agg(F.sum("share").alias("overlap"))
    return total.where(F.col("overlap") * (100 + level) >= (F.col("na") + F.col("nb")) * level).select("a", "b")


def _product(level: int):
    def run(table: pa.Table) -> pa.Table:
        """The rows of one pair of tiles in; links that join components out, as few as do."""
        doc, n, component, part = (table.column(c).to_numpy() for c in ("doc", "n", "component", "part"))
        tokens = table.column("tokens").combine_chunks()
        sizes = np.diff(tokens.offsets.to_numpy())
        _, column, often = np.unique(tokens.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = often[column] > 1
        row, column = np.repeat(np.arange(len(doc)), sizes)[shared], (np.cumsum(often > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        overlap = np.zeros((len(doc), len(doc)), dtype=np.float32)  # counts below 2**24, so exact
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, b = np.searchsorted(column, [low, low + COLUMNS])
            block = np.zeros((len(doc), COLUMNS), dtype=np.float32)
            block[row[a:b], column[a:b] - low] = 1
            overlap += block @ block.T
        linked = overlap.astype(np.float64) * (100 + level) >= (n[:, None] + n[None, :]) * float(level)
        linked &= component[:, None] < component[None, :]
        if (part != part[0]).any():  # of two tiles; each by itself is a product of its own
            linked &= part[:, None] != part[None, :]
        above = {}

        def top(x):
            while above.get(x, x) != x:
                x = above[x]
            return x

        links = []
        for i, j in zip(*np.nonzero(linked)):
            x, y = top(component[i]), top(component[j])
            if x != y:
                above[max(x, y)] = min(x, y)
                links.append((min(doc[i], doc[j]), max(doc[i], doc[j])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def _multiplied(placed: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """(a, b): links of sets that share a bucket, enough of them to join all components that links join."""
    marks = [F.count("*").alias("m"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.sum(F.pmod(F.xxhash64("doc", F.lit(1)), F.lit(1 << 31))).alias("y")]
    buckets = placed.groupBy("token").agg(*marks).groupBy("m", "x", "y").agg(F.min("token").alias("token"))
    rows = placed.select("token", "doc", "n", "component").join(buckets.select("token", F.ceil(F.col("m") / TILE).alias("g")), "token")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc"), F.col("g")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    rows = rows.select("token", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "doc", "n", "component")
    filled = rows.join(sets.select(F.col("doc").alias("d"), "tokens"), F.col("doc") == F.col("d")).drop("d")
    return filled.groupBy("token", "i", "j").applyInArrow(_product(level), "a long, b long").distinct()


def _across(links: DataFrame, component: DataFrame) -> DataFrame:
    """(x, y): the components that links join."""
    ends = component.select(F.col("doc").alias("d"), F.col("component").alias("c"))
    return links.join(ends, F.col("a") == F.col("d")).select("b", F.col("c").alias("x")).join(ends, F.col("b") == F.col("d")).select("x", F.col("c").alias("y")).where("x != y")


def _merged(component: DataFrame, edges: DataFrame) -> DataFrame:
    merged = connect(edges)
    return materialise(component.join(merged, F.col("component") == F.col("node"), "left").select("doc", F.coalesce("label", "component").alias("component")), "components")


def _link(sets: DataFrame, level: int, few: float = 8.0) -> DataFrame:
    """(doc, component) of the sets (doc, n, tokens) that link with another, and of some that do not."""
    spark = sets.sparkSession
    largest = sets.agg(F.max("n")).first()[0] or 1
    count = max(1, -(-int(largest) // BLOCK))
    inc = sets.select("doc", "n", F.explode("tokens").alias("token"))
    often = inc.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    known = inc.join(often, "token").groupBy("doc", "n").agg(F.array_sort(F.collect_set(F.struct("df", "token"))).alias("known"))
    # a linked set finds at least ``need`` of its members in others
    known = known.where(F.size("known") * 100 >= F.col("n") * level).withColumn("own", F.col("n") - F.size("known"))
    room = (F.col("n") - F.ceil(F.col("n") * level / 100) + 1 - F.col("own")).cast("int")
    ranked = known.select(F.col("doc").alias("d"), "own", F.slice("known", F.lit(1), room).alias("known"))
    sets = materialise(sets.join(ranked, F.col("doc") == F.col("d")).drop("d").dropDuplicates(["doc"]), "sets")
    within = F.filter("tokens", lambda t: F.pmod(F.shiftright(t, 20), F.lit(count)) == F.col("block"))
    blocks = sets.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    blocks = blocks.select("doc", "block", within.alias("tokens") if count > 1 else "tokens")
    first = sets.select("doc", "n", "own", F.posexplode("known").alias("at", "x"))
    # linked sizes differ by one class at most, so each set goes to its own class and the next
    step = F.floor(F.log("n") / -np.log(level / 100)).cast("int")
    first = first.select(F.col("x.token").alias("token"), "doc", "n", "own", (F.col("own") + F.col("at")).alias("pos"), F.explode(F.array(step, step + 1)).alias("step"))
    # the largest partner that the members from this place on allow; of a linked pair the smaller set allows its own size
    partner = F.floor((F.col("n") - F.col("pos")) * (100 + level) / level) - F.col("n")
    first = first.withColumn("open", partner >= F.col("n")).where(partner >= F.ceil(F.col("n") * level / 100))
    bucket = materialise(first.select(F.xxhash64("token", "step").alias("token"), "doc", "n", "own", "pos", "open"), "buckets")
    component = materialise(bucket.select("doc", F.col("doc").alias("component")).distinct(), "components")
    tested = spark.createDataFrame([], "a long, b long")

    def fits(n1, pos1, n2, pos2):
        """Whether two sets that first share the member at these places can overlap enough, by their sizes alone."""
        least = F.ceil((n1 + n2) * level / (100 + level))
        return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * level) & (F.least(n1 - pos1, n2 - pos2) >= least)

    def across(one):
        """Pairs of a bucket across components that can overlap enough; the smaller set is always an open one."""
        a, b = (part.select("token", *(F.col(c).alias(c + side) for c in ("doc", "n", "pos", "component"))) for part, side in ((one.where("open"), "a"), (one, "b")))
        met = a.join(b, "token").where((F.col("na") <= F.col("nb")) & (F.col("componenta") != F.col("componentb")) & fits(F.col("na"), F.col("posa"), F.col("nb"), F.col("posb")))
        less = F.col("doca") < F.col("docb")
        return met.select(F.least("doca", "docb").alias("a"), F.greatest("doca", "docb").alias("b"), F.when(less, F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(less, F.col("nb")).otherwise(F.col("na")).alias("nb"))

    rounds = 0
    while True:
        placed = materialise(bucket.join(component, "doc"), "placed")
        live = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("open").alias("some")).where("low < high and some").select("token")
        placed = materialise(placed.join(live, "token"), "live")
        per = placed.groupBy("token", "component").agg(F.count("*").alias("k"), F.sum(F.col("open").cast("long")).alias("opens"), F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "doc", "n", "pos")).alias("head"))
        size = per.groupBy("token").agg(F.sum("k").alias("rows"), F.sum("opens").alias("opens"), F.sum(F.col("k") * F.col("opens")).alias("inside"))
        size = size.agg(F.sum("rows").alias("rows"), F.sum(F.col("rows") * F.col("opens") - F.col("inside")).alias("pairs"), F.sum(F.col("rows") * F.col("rows")).alias("all")).first()
        if not size["rows"]:
            return component
        last = size["pairs"] <= few * size["rows"]
        if not last and rounds and size["pairs"] <= COMPARED * size["rows"]:
            last = across(placed).count() <= few * size["rows"]
        if not last and rounds >= ROUNDS and size["pairs"] >= APART * size["all"]:
            edges = _across(_multiplied(placed, sets, level), component)
            return _merged(component, edges)
        rounds += 1
        if last:
            pairs = across(placed).distinct()
        else:
            largest_first = Window.partitionBy("token").orderBy(F.desc("k"), "head")
            lead = per.withColumn("rank", F.row_number().over(largest_first)).where(F.col("rank") <= LEADS)
            lead = materialise(lead.select("token", F.col("head.doc").alias("p"), F.col("head.n").alias("np"), F.col("head.pos").alias("pp"), F.col("component").alias("pc")), "leads")
            met = placed.join(lead, "token").where((F.col("component") != F.col("pc")) & fits(F.col("n"), F.col("pos"), F.col("np"), F.col("pp")))
            less = F.col("p") < F.col("doc")
            pairs = met.select(F.least("p", "doc").alias("a"), F.greatest("p", "doc").alias("b"), F.when(less, F.col("np")).otherwise(F.col("n")).alias("na"), F.when(less, F.col("n")).otherwise(F.col("np")).alias("nb")).distinct()
        pairs = materialise(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        links = _overlapping(pairs, blocks, level)
        component = _merged(component, _across(links, component))
        if last:
            return component
        tested = tested.unionByName(pairs.select("a", "b"))
        bucket = materialise(placed.join(lead.select("token", F.col("p").alias("doc")), ["token", "doc"], "left_anti").select("token", "doc", "n", "own", "pos", "open"), "buckets")


def components(docs: DataFrame, gram: int = GRAM, level: int = LEVEL, halved: int = 0) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, n_shingles, component_id.

    ``halved`` says how often the number of parts is halved: larger parts meet less, but more sets have too few.
    """
    spark, seed = docs.sparkSession, fresh_seed()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text")
    each = materialise(base.mapInArrow(_signatures(gram, seed), "doc_id long, row_key long, n long, sig long"), "signatures")
    known = base.where("doc_id is not null").select("doc_id", "text")
    classes = each.where("doc_id is not null and n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("doc"))
    met = materialise(meetings(known.select("text"), _parts(gram, level, seed, halved)), "meetings")
    odd = met.where("odd").join(classes, "sig").agg(F.min("n").alias("low"), F.max("n").alias("high")).first()
    if odd["low"] is not None:  # sets whose members fall into too few parts: all sets of about their sizes meet by single members
        between = (need(int(odd["low"]), level), int(odd["high"]) * 100 // level)
        met = met.unionByName(materialise(meetings(known.select("text"), _parts(gram, level, seed, halved, between)), "meetings"))
    met = met.where("not odd")
    spared = F.when((F.col("cls") >= SMALL) & (F.col("cls") < SINGLE), F.expr("shiftleft(1L, cls - 5)")).otherwise(0)
    counts = met.groupBy("sig", "cls").agg(F.count("*").alias("k")).where(F.col("k") > spared).select("sig").distinct()
    alive = materialise(classes.join(counts, "sig").select("sig", "n", "doc"), "alive")
    flags = spark.sparkContext.broadcast(bitmap_of(alive.select("sig", "doc").mapInArrow(_with_pair_key, "key long"), "key"))
    # the bitmap may let sets in that are not alive, and a set twice: neither loses a link
    sets = materialise(known.mapInArrow(_chosen_sets(flags, gram, seed), "doc long, n long, tokens array<long>"), "sets")
    linked = _link(sets, level).select(F.col("doc").alias("sig"), "component").join(alive.select("sig", "doc"), "sig")
    named = linked.groupBy("component").agg(F.min("doc").alias("component_id"))
    linked = materialise(linked.join(named, "component").select("sig", "component_id"), "linked")
    heads = classes.join(linked, "sig", "left").select("sig", "n", F.coalesce("component_id", "doc").alias("component_id"))
    placed = each.where("doc_id is not null and n > 0").join(heads, ["sig", "n"])
    lone = each.where("doc_id is null or n = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "row_key", F.col("n").alias("n_shingles"), "component_id"]
    return placed.select(*columns).unionByName(lone.select(*columns))


def keep_one(docs: DataFrame, gram: int = GRAM, level: int = LEVEL) -> DataFrame:
    """The row of the smallest doc_id of each component, with all its columns; rows without n-grams all stay."""
    found = components(docs, gram, level)
    marks = found.where("n_shingles > 0 and doc_id is not null and doc_id != component_id").select("doc_id", "row_key", F.lit(False).alias("kept"))
    return keep_rows(docs, materialise(marks.distinct(), "rejected"))


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_key")
