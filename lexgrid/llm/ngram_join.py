"""N-gram Jaccard join: parity sketches joined block by block in bands of sizes, exact verification, components."""

from __future__ import annotations

from itertools import batched

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrid.llm.bloom import Seen, filled, places, size_of, test
from lexgrid.llm.components import components
from lexgrid.llm.shared import BATCH_ROWS, for_python, memory_of, scratch, written
from lexgrid.llm.sketches import Bands, folded, mixed, parity_bits, shingles

#: Members of a block that meet at a time, about.
CHUNK = 128
#: Rows of an Arrow batch where a row holds two sketches, two whole sets, or a chunk of members.
SKETCH_ROWS, SET_ROWS, CHUNK_ROWS = 500, 64, 8
#: Keys that a task deals out at a time, at least; shingles of a part of the keys, about; keys of a part that are held before they meet; and most rows of an Arrow batch of such keys.
FLUSH, PART, MOST_HELD, KEY_ROWS = 1 << 19, 500_000, 1 << 20, 200
LEAST, ALONE = -(1 << 63), np.uint64(0xD6E8FEB86659FD93)


def prints(docs: DataFrame, doc_id: str, text: str, width: int, bands: Bands) -> DataFrame:
    """(doc_id, text_hash, n_shingles, class, bits): class is a hash of the whole set; bits, its sketch of single bits, is there once for each class and task."""

    def make(batches):
        import pyarrow as pa

        memory_of("shingles")
        seen: set[int] = set()
        for batch in batches:
            n, own, bits = [], [], []
            for x in batch.column(2):
                members = shingles(x.as_py(), width)
                name = class_of(members)
                n.append(len(members))
                own.append(name)
                bits.append(None if name in seen or not len(members) else parity_bits(members, bands))
                seen.add(name)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(own, pa.int64()), pa.array(bits, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "class", "bits"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(make, "doc_id long, text_hash long, n_shingles long, class long, bits binary")


def dealt_keys(found, bands: Bands, parts: int):
    """Sets (class, members) to rows (part, keys, classes) of many keys each: a part is a key's low bits, and of the key its high 48 bits go, so that a key and its class take 14 bytes."""
    most = max(FLUSH, 32 * parts)

    def rows(keys, names):
        import pyarrow as pa

        keys, names = np.concatenate(keys), np.concatenate(names)
        part = (keys & np.uint64(parts - 1)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        keys, names = keys[order].view(np.uint8).reshape(-1, 8)[:, 2:], names[order]
        there, start = np.unique(part[order], return_index=True)
        ends = np.append(start[1:], len(names))
        for k in range(0, len(there), BATCH_ROWS):
            cuts = [(int(x), int(y)) for x, y in zip(start[k : k + BATCH_ROWS], ends[k : k + BATCH_ROWS], strict=True)]
            columns = [pa.array(there[k : k + BATCH_ROWS], pa.int32()), pa.array([keys[x:y].tobytes() for x, y in cuts], pa.binary()), pa.array([names[x:y].tobytes() for x, y in cuts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "keys", "classes"])

    keys, names, held = [], [], 0
    for name, members in found:
        keys.append(bands.blocks(members))
        names.append(np.full(len(keys[-1]), name, np.int64))
        held += len(keys[-1])
        if held >= most:
            yield from rows(keys, names)
            keys, names, held = [], [], 0
    if held:
        yield from rows(keys, names)


class Part:
    """Blocks of two classes or more among a part's keys. It holds each key once, and up to MOST_HELD of what hasn't met the others yet, however many classes have a key."""

    def __init__(self):
        self.keys, self.lows, self.told = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.new: list = []
        self.held, self.first = 0, True

    def add(self, keys: bytes, classes: bytes):
        whole = np.zeros((len(keys) // 6, 8), np.uint8)
        whole[:, 2:] = np.frombuffer(keys, np.uint8).reshape(-1, 6)
        self.new.append((whole.view(np.uint64).ravel(), np.frombuffer(classes, np.int64)))
        self.held += len(whole)
        if self.held >= MOST_HELD:
            yield from self.met(False)

    def met(self, end: bool):
        """(key, class, low, pair) of what is new. low is the smallest class of the block among the first that met; a pair is a block that has two classes and gets no more."""
        if not self.new:
            return
        k, c = (np.concatenate(x) for x in zip(*self.new, strict=True))
        self.new, self.held = [], 0
        order = np.lexsort((c, k))
        k, c = k[order], c[order]
        on = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))
        k, c = k[on], c[on]
        names, start, group, n = np.unique(k, return_index=True, return_inverse=True, return_counts=True)
        low, told, known = c[start].copy(), np.zeros(len(names), bool), np.zeros(len(names), bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, names), len(self.keys) - 1)
            known = self.keys[at] == names
            low[known], told[known] = self.lows[at[known]], self.told[at[known]]
        other = c != low[group]
        meets = np.bincount(group[other], minlength=len(names)) > 0
        pair = (n == 2) & end & self.first
        heads = meets & ~told
        yield np.append(names[heads], k[other]), np.append(low[heads], c[other]), np.append(low[heads], low[group][other]), np.append(pair[heads], pair[group][other])
        if not end:
            if len(self.keys):
                self.told[at[known & meets]] = True
            order = np.argsort(np.append(self.keys, names[~known]), kind="stable")
            self.keys, self.lows, self.told = (np.append(x, y[~known])[order] for x, y in ((self.keys, names), (self.lows, low), (self.told, meets)))
        self.first = False


def blocks_of(docs: DataFrame, reps: DataFrame, items: int, doc_id: str, text: str, width: int, bands: Bands) -> DataFrame:
    """(key, class, low, pair) of the blocks of two classes or more, for reps (class, rep) of `items` shingles in all; see Part. Keys are shuffled once, many in a row, so that disk grows with the keys whatever their number."""
    parts = min(1 << 16, 1 << (items // PART).bit_length())

    def deal(found):
        yield from dealt_keys(found, bands, parts)

    def meet(batches):
        import pyarrow as pa

        def rows(part, made):
            for key, *rest in made:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in ((key | np.uint64(part)).view(np.int64), *rest)], names=["key", "class", "low", "pair"])

        now, held = None, Part()
        for batch in batches:
            for part, keys, classes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    yield from rows(now, held.met(True))
                    now, held = part, Part()
                yield from rows(now, held.add(keys, classes))
        yield from rows(now, held.met(True))

    dealt, filters = picked(docs, reps, doc_id, text, width, deal, "part int, keys binary, classes binary")
    out = written(dealt.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "key long, class long, low long, pair boolean"), "members", min(KEY_ROWS, max(8, parts)))
    filters.destroy()
    return out


def class_of(members: np.ndarray) -> int:
    """A 64-bit hash of a set; equal sets have equal ones."""
    from xxhash import xxh3_64_intdigest

    h = xxh3_64_intdigest(members.tobytes())
    return h - (1 << 64) if h >> 63 else h


def picked(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, width: int, made, schema: str) -> tuple[DataFrame, Broadcast]:
    """What made() yields from the (class, members) of wanted (class, rep), from the text of the document rep. members: its shingles' hashes, sorted.

    A Bloom filter of the wanted ids and one of the wanted pairs of class and id, of bounded size, pick the documents where they are read, so that neither texts nor sets are shuffled. The few others that they let through do no harm. A class that several tasks read comes from each. Then the filters, to be destroyed after use.
    """
    size = size_of(2 * wanted.count())
    alone = lambda ids: mixed(ids.to_numpy().view(np.uint64) + ALONE)
    both = lambda ids, names: mixed(mixed(ids.to_numpy().view(np.uint64)) ^ names)

    def fill(batches):
        seen = Seen(size)
        for batch in batches:
            seen.add(np.concatenate([alone(batch.column(0)), both(batch.column(0), batch.column(1).to_numpy().view(np.uint64))]))
        yield from seen.batches()

    pairs = filled(wanted.select("rep", "class").mapInArrow(fill, Seen.SCHEMA), size)

    def make(batches):
        import pyarrow as pa

        memory_of("shingles")
        filter_, done = np.frombuffer(pairs.value, np.uint8), set()

        def there(hashes):
            a, b = places(hashes, size)
            return test(filter_, a) & test(filter_, b)

        def found():
            for batch in batches:
                batch = batch.filter(pa.array(there(alone(batch.column(0)))))
                sets = [shingles(x.as_py(), width) for x in batch.column(1)]
                names = np.array([class_of(m) for m in sets], np.int64)
                for k in np.flatnonzero(there(both(batch.column(0), names.view(np.uint64)))):
                    if len(sets[k]) and int(names[k]) not in done:
                        done.add(int(names[k]))
                        yield int(names[k]), sets[k]

        yield from made(found())

    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LEAST)).alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(make, schema), pairs


def whole_sets(found):
    """Sets (class, members) to rows of them."""
    import pyarrow as pa

    for some in batched(found, SET_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int64()), pa.array([m.tobytes() for _, m in some], pa.binary())], names=["class", "members"])


def verified(pairs: DataFrame, sets: DataFrame, whole, bands: Bands) -> DataFrame:
    """The pairs (a, b) of classes whose sets link: first by sizes and sketches of single bits, which leave little more than links, then by whole sets, which whole() makes of the classes that are left."""
    short = sets.select("class", "n", "bits")

    def sketched(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for n_a, n_b, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                size = min(len(x), len(y))
                apart = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
                keep.append(apart * (bands.inner + bands.outer) <= (n_a + n_b) * (bands.inner - bands.outer))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    fits = F.lit(bands.inner) * F.least("n_a", "n_b") >= F.lit(bands.outer) * F.greatest("n_a", "n_b")
    near = pairs.join(short.toDF("a", "n_a", "one"), "a").join(short.toDF("b", "n_b", "other"), "b").filter(fits).select("a", "b", "n_a", "n_b", "one", "other")
    near = written(near.mapInArrow(sketched, "a long, b long").distinct(), "near", SKETCH_ROWS)
    if near.isEmpty():
        return near
    full = whole(near.select(F.explode(F.array("a", "b")).alias("class")).distinct())
    x = near.join(full.toDF("a", "one"), "a").join(full.toDF("b", "other"), "b")

    def check(batches):
        import pyarrow as pa

        for batch in batches:
            keep, last, there = [], None, None
            for one, other, b in zip(batch.column(2), batch.column(3), batch.column(1).to_pylist(), strict=True):
                if b != last:
                    last, there = b, np.frombuffer(other.as_buffer(), np.uint64)
                mine = np.frombuffer(one.as_buffer(), np.uint64)
                keep.append(bands.link(len(np.intersect1d(mine, there, assume_unique=True)), len(mine), len(there)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return written(x.select("a", "b", "one", "other").mapInArrow(check, "a long, b long").distinct(), "links", SET_ROWS)


def within(rows: DataFrame, bands: Bands, turn: int) -> DataFrame:
    """rows (key, i, j, chunk, members, a, b), each a whole chunk of members (class, label, n, bits), or with chunk -1 a pair of classes that has failed: of each (key, i, j), pairs (key, a, b) of classes of chunks i and j that may link by sizes and sketches, whose labels differ and which haven't failed.

    Pairs that join what isn't joined yet if they link, the likeliest first: fewer than the classes that meet. From the second turn on also more pairs of two labels, eight times as many each turn.
    """

    def pairs(group, failed):
        names, chunks = ([r[k] for r in group] for k in (0, 2))
        label, chunks = np.unique([r[1] for r in group], return_inverse=True)[1], np.array(chunks)
        sizes, least = np.array([r[3] for r in group]), min(len(r[4]) for r in group)
        bits, seen, found, root = np.stack([folded(r[4], least) for r in group]), {}, [], list(range(int(label.max()) + 1))

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for p in range(len(group)):
            rest = np.arange(p + 1, len(group))
            rest = rest[(label[rest] != label[p]) & (group[0][5] | (chunks[rest] != chunks[p]))]
            apart = np.bitwise_count(bits[rest] ^ bits[p]).sum(1)
            near = (bands.inner * np.minimum(sizes[rest], sizes[p]) >= bands.outer * np.maximum(sizes[rest], sizes[p])) & (apart * (bands.inner + bands.outer) <= (sizes[rest] + sizes[p]) * (bands.inner - bands.outer))
            found += [(int(d), p, int(q)) for d, q in zip(apart[near], rest[near], strict=True) if (min(names[p], names[q]), max(names[p], names[q])) not in failed]
        for _, p, q in sorted(found):
            x, y, two = find(label[p]), find(label[q]), (min(label[p], label[q]), max(label[p], label[q]))
            if x != y or turn and seen.get(two, 0) < 8**turn:
                root[x] = y
                seen[two] = seen.get(two, 0) + 1
                yield min(names[p], names[q]), max(names[p], names[q])

    def run(batches):
        import pyarrow as pa

        def told(key, group, failed):
            out = list(pairs(group, failed)) if len({r[1] for r in group}) > 1 else []
            return pa.RecordBatch.from_pydict({"key": pa.array([key] * len(out), pa.int64()), "a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

        now, group, failed = None, [], set()
        for batch in batches:
            keys = zip(*(c.to_pylist() for c in batch.columns[:4]), *(c.to_pylist() for c in batch.columns[5:]), strict=True)
            for k, (key, i, j, chunk, a, b) in enumerate(keys):
                if (key, i, j) != now:
                    if group:
                        yield told(now[0], group, failed)
                    now, group, failed = (key, i, j), [], set()
                if chunk < 0:
                    failed.add((a, b))
                else:
                    group += {m["class"]: (m["class"], m["label"], chunk, m["n"], m["bits"], i == j) for m in batch.column(4)[k].as_py()}.values()
        if group:
            yield told(now[0], group, failed)

    ordered = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "chunk")
    return written(ordered.select("key", "i", "j", "chunk", "members", "a", "b").mapInArrow(run, "key long, a long, b long"), "pairs", CHUNK_ROWS)


def open_blocks(named: DataFrame) -> DataFrame:
    """(key, n) of the blocks whose members have several labels; of blocks of the same members, one."""
    left = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("class").cast("decimal(20,0)")).alias("sum"), F.bit_xor("class").alias("xor")).filter("low < high")
    return left.groupBy("n", "sum", "xor").agg(F.min("key").alias("key")).select("key", "n")


def next_blocks(named: DataFrame, blocks: DataFrame, turn: int) -> DataFrame:
    """(key, n, chosen) of the blocks that are still open. Chosen: those that are among the largest 8^turn open blocks of any of their labels, so that some are while any is open; for these join most and leave little to do in the others."""
    x = written(named.join(blocks, "key").select("key", "n", "label").distinct(), "places")
    left = x.groupBy("key", "n").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key", "n")
    # Spark keeps only so many rows of a label before it shuffles them
    place = F.row_number().over(W.partitionBy("label").orderBy(F.col("n").desc(), "key"))
    first = x.join(left.select("key"), "key").withColumn("place", place).filter(F.col("place") <= 8**turn).select("key").distinct().withColumn("first", F.lit(True))
    return written(left.join(first, "key", "left").select("key", "n", F.coalesce("first", F.lit(False)).alias("chosen")), "open")


def meetings(named: DataFrame, chosen: DataFrame, sets: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows for within(): members of chosen blocks in chunks of about CHUNK, each chunk once for every chunk that it meets; and pairs that have failed, to where their classes meet."""
    chunk = F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int")
    dealt = named.join(chosen, "key").select("key", "class", "label", "chunks", chunk.alias("chunk"))
    parts = dealt.join(sets.select("class", "n", "bits"), "class").groupBy("key", "chunks", "chunk").agg(F.sort_array(F.collect_list(F.struct("class", "label", "n", "bits"))).alias("members"))
    # a chunk is a row; rows, not members, are dealt to the chunks that they meet
    parts = parts.select("key", "chunk", "members", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    none = F.lit(None).cast("long")
    parts = parts.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "members", none.alias("a"), none.alias("b"))
    one, two = (dealt.select("key", F.col("class").alias(name), F.col("label").alias(f"label_{name}"), F.col("chunk").alias(f"chunk_{name}")) for name in ("a", "b"))
    known = failed.join(one, "a").join(two, ["key", "b"]).filter("label_a <> label_b")
    kind = parts.schema["members"].dataType
    return parts.unionAll(known.select("key", F.least("chunk_a", "chunk_b").alias("i"), F.greatest("chunk_a", "chunk_b").alias("j"), F.lit(-1).alias("chunk"), F.lit(None).cast(kind).alias("members"), "a", "b"))


def join_ngrams(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, outer: int = 80, inner: int = 100) -> DataFrame:
    """(doc_id, text_hash, n_shingles, class_id, component_id) for each row: xxhash64 of the text, the size of its set of shingles of `width` words, a hash of the set, and the smallest id that links reach.

    Two sets link when inner * intersection >= outer * union. Copies are one class from the start. Each class's parity sketches are joined by blocks (see Bands), so that no link is missed; blocks of two classes or more hold the candidates. Each candidate is verified against the smallest class of each of its blocks, whole sets only where sketches of single bits allow a link; components of these links are formed; blocks of three classes or more whose members then have several labels are taken again, in chunks of CHUNK against each other, and each pair in them that labels don't join yet and that single-bit sketches allow is verified, turn by turn until none is left. So a block's members never meet all at once, and every link has been tested or joins what is joined already.
    Null or empty text, or text of blanks, has no shingles, links with nothing and is its own component. Null ids stand before all others as the smallest id, and such rows have component null. Repeated rows are one class. Texts of any length are read whole. An empty table gives an empty one. Other columns are not read.
    """
    for_python(docs.sparkSession)
    bands = Bands(outer, inner)
    with scratch() as keep:
        all_rows, sketched, reps, members = candidates(docs, doc_id, text, width, bands)
        labels = linked(docs, doc_id, text, width, bands, members, reps, sketched)
        ends = reps.join(labels, reps["class"] == labels["node"], "left").select("class", F.coalesce("label", "class").alias("label"), "rep")
        least = ends.groupBy("label").agg(F.min("rep").alias("component"))
        ends = written(ends.join(least, "label").select(F.col("class").alias("end_class"), F.when(F.col("component") != LEAST, F.col("component")).alias("component")), "ends")
        out = all_rows.join(ends, F.col("class") == F.col("end_class"), "left")
        component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
        return keep(written(out.select("doc_id", "text_hash", "n_shingles", F.col("class").alias("class_id"), component.alias("component_id")), "joined"))


def candidates(docs: DataFrame, doc_id: str, text: str, width: int, bands: Bands) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(doc_id, text_hash, n_shingles, class) of all rows, (class, n, bits) of all sets, (class, rep) with the smallest id of each, and (key, class, low, pair) of the blocks of two classes or more."""
    with scratch() as keep:
        all_rows = keep(written(prints(docs, doc_id, text, width, bands), "prints"))
        reps = all_rows.filter("n_shingles > 0").groupBy("class").agg(F.min(F.coalesce("doc_id", F.lit(LEAST))).alias("rep"), F.first("n_shingles").alias("n"))
        reps = keep(written(reps, "reps"))
        items = reps.agg(F.sum("n")).first()[0] or 0
        reps = reps.select("class", "rep")
        members = keep(blocks_of(docs, reps, items, doc_id, text, width, bands))
    return all_rows.drop("bits"), all_rows.filter("bits is not null").select("class", F.col("n_shingles").alias("n"), "bits"), reps, members


def linked(docs: DataFrame, doc_id: str, text: str, width: int, bands: Bands, members: DataFrame, reps: DataFrame, sketched: DataFrame) -> DataFrame:
    """(node, label) of every class of a block: equal labels where links join them."""
    with scratch() as keep:
        wanted = written(reps.join(members.select("class").distinct(), "class"), "wanted")
        sets = written(sketched.join(wanted.select("class"), "class").dropDuplicates(["class"]), "sets")

        def whole(classes):
            read, filters = picked(docs, written(wanted.join(classes, "class"), "asked"), doc_id, text, width, whole_sets, "class long, members binary")
            out = written(read, "whole")
            filters.destroy()
            return out

        with scratch() as on:
            links = on(verified(members.filter("class <> low").select(F.col("class").alias("a"), F.col("low").alias("b")).distinct(), sets, whole, bands))
        labels = relabelled(wanted.select(F.col("class").alias("node"), F.col("class").alias("label")), links)
        # of a pair, the one that there is has been tested; rows of a class that several tasks read are one
        members = written(members.filter("not pair").select("key", "class").distinct(), "blocks")
        named = members.join(labels, members["class"] == labels["node"]).select("key", "class", "label")
        blocks, failed, turn = written(open_blocks(named), "open"), links.limit(0), 0
        while True:
            with scratch() as on:
                blocks = next_blocks(named, blocks, turn)
                chosen = blocks.filter("chosen").select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
                if chosen.isEmpty():
                    break
                asked = within(meetings(named, chosen, sets, failed), bands, turn)
                # a chosen block without pairs has none to come
                blocks = on(written(blocks.join(asked.select("key").distinct().withColumn("more", F.lit(True)), "key", "left").filter("more or not chosen").select("key", "n"), "open"))
                pairs = asked.select("a", "b").distinct()
                more = verified(pairs, sets, whole, bands)
                failed = failed.unionAll(pairs.join(more, ["a", "b"], "left_anti"))
                if not more.isEmpty():
                    labels = on(relabelled(labels, more))
                    named = members.join(labels, members["class"] == labels["node"]).select("key", "class", "label")
                failed = on(written(still_apart(failed, labels), "failed"))
            turn += 1
        return keep(labels)


def still_apart(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) that no other links have joined meanwhile: the others need not be told to their blocks, of which a large group has many."""
    both = failed.join(labels.toDF("a", "label_a"), "a").join(labels.toDF("b", "label_b"), "b")
    return both.filter("label_a <> label_b").select("a", "b")


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after further links (a, b): only labels that these join are nodes of the components to find."""
    with scratch() as keep:
        ends = links.join(labels.toDF("a", "from"), "a").join(labels.toDF("b", "to"), "b").select("from", "to")
        found = components(ends, "from", "to").toDF("old", "new")
        return keep(written(labels.join(found, labels["label"] == found["old"], "left").select("node", F.coalesce("new", "label").alias("label")), "labels"))
