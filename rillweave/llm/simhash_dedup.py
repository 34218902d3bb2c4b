"""SimHash near-duplicates with pigeonring candidates.

Fingerprints of 64 bits are cut into a ring of four segments of 16 bits. If two
differ in at most 3 bits, then from some segment on every chain of consecutive
segments stays within its share of the budget: the first has floor(3/4) = 0
differing bits, the first two at most 1, the first three at most 2, all four at
most 3. The first two conditions make join keys: the start segment as it is,
and the next one without one of its four nibbles (its one differing bit lies in
some nibble). That is 28 bits a key and 16 keys a fingerprint. The third
condition prunes pairs that share a key; the full distance is counted last.

Only distinct fingerprints take part, and only keys held by two or more. A key
held by many is cut into blocks, and each pair of blocks is compared on its
own, so no task holds an unbounded group; what a group gives is a spanning star
of each cluster in it, not its pairs. Links lead to components as any set of
all pairs would.

Near copies of a Jaccard similarity of 0.8 differ in a sixth of the bits, and no
segments of a SimHash guarantee a shared key there: keys short enough to be
shared would be shared by most unrelated texts too. similar_groups() therefore
lets families of texts be found by bands of least shingle hashes, and uses a
wider SimHash in them: chains of consecutive words within proportional budgets
prune pairs, then the full Hamming check, and the pairs left are linked by the
exact similarity of their shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import ODD, mixed
from .common import as_bytes, bucketed, by_pid, cut, small, unused
from .components import connected_components

SEED = 42
_CHUNK = 1 << 16


def shingle_hashes(text: bytes, size: int = 3) -> np.ndarray:
    """XXH64 of each word shingle of the lower-cased (A-Z) text, repeats included; fewer words make one shingle, none makes none."""
    words = text.lower().split()
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - size].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(text: bytes, size: int = 3) -> int:
    """The SimHash as a signed 64-bit number: a bit is set if it is set in over half of the hashes; zero without words."""
    hashes = shingle_hashes(text, size)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int = 3) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            prints = [fingerprint(t, size) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema[0].dataType.simpleString()}, fp long")


def ring_keys(prints: DataFrame) -> DataFrame:
    """(key, fp): 16 keys of 28 bits for each fingerprint, numbered by start segment and dropped nibble."""
    segment = lambda i: F.shiftrightunsigned("fp", 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF).cast("long"))
    keys = []
    for i in range(4):
        for j in range(4):
            kept = segment(i + 1).bitwiseAND(F.lit(0xFFFF & ~(0xF << (4 * j))).cast("long"))
            keys.append(F.lit((i * 4 + j) << 32).cast("long").bitwiseOR(F.shiftleft(segment(i), 16)).bitwiseOR(kept))
    return prints.select(F.explode(F.array(*keys)).alias("key"), "fp")


def linked(a: np.ndarray, b: np.ndarray, start: np.ndarray | int, distance: int) -> np.ndarray:
    """Whether pairs that share a key from segment `start` pass the ring's chains and then the full check."""
    differ = a ^ b
    ring = lambda k: np.bitwise_count((differ >> np.uint64(16) * ((np.asarray(start) + k) % 4).astype(np.uint64)) & np.uint64(0xFFFF))
    two = ring(0) + ring(1)
    passed = (ring(0) * 4 <= distance) & (two * 4 <= 2 * distance)
    passed &= (two + ring(2)) * 4 <= 3 * distance
    return passed & (np.bitwise_count(differ) <= distance)


def group_stars(fps: np.ndarray, start: int, distance: int) -> Iterator[tuple[int, int]]:
    """For a group that shares a key: (centre, member) for each cluster that its links make."""
    n, left = len(fps), np.ones(len(fps), bool)
    match = np.zeros((n, n), bool)
    for at in range(0, n, 256):
        match[at : at + 256] = linked(fps[at : at + 256, None], fps[None, :], start, distance)
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        front = np.array([root])
        while len(front):
            found = match[front].any(axis=0) & left
            left &= ~found
            front = np.flatnonzero(found)
            for x in front:
                yield root, int(x)


def find_links(prints: DataFrame, distance: int, block: int) -> DataFrame:
    """(u, v): links among distinct fingerprints that give the same components as all pairs within `distance`."""
    keys = ring_keys(prints)
    held = keys.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / F.lit(block)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long")).cast("int")
    rows = keys.join(held, "key").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """rows: whole groups, sorted; columns key, a, b, fp."""
            if not len(rows):
                return
            new = np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]
            group = np.cumsum(new) - 1
            sizes = np.bincount(group)
            fps, start = rows[:, 3].astype(np.uint64), (rows[:, 0] >> 34).astype(np.int64)
            left, right = [], []
            small = sizes[group] <= 32
            for d in range(1, min(32, int(sizes.max()))):
                i = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
                i = i[linked(fps[i], fps[i + d], start[i], distance)]
                left.append(fps[i])
                right.append(fps[i + d])
            firsts = np.flatnonzero(new)
            for g in np.flatnonzero(sizes > 32):
                at = firsts[g]
                own = fps[at : at + sizes[g]]
                star = np.array(list(group_stars(own, int(start[at]), distance)), np.int64).reshape(-1, 2)
                left.append(own[star[:, 0]])
                right.append(own[star[:, 1]])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], ["u", "v"])

        for batch in batches:
            held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            rows = np.concatenate(held)
            # The last group may go on in the next batch.
            same = (rows[:, :3] == rows[-1, :3]).all(axis=1)
            whole = int(np.argmax(same)) if len(rows) else 0
            if whole:
                yield from out(rows[:whole])
            held = [rows[whole:]]
        if held:
            yield from out(np.concatenate(held))

    dealt = rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "fp")
    return dealt.mapInArrow(compare, "u long, v long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, distance: int = 3, block: int = 2048) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id for each row.

    component_id is the smallest id reachable over links of at most `distance`
    (0 to 3) differing bits. Null texts are empty; texts without words share
    fingerprint zero and are linked like any others. Rows with null ids belong
    to their group but don't name it; a group of null ids only has a null
    component_id. Other columns are not carried.
    """
    if not 0 <= distance <= 3:
        raise ValueError("four segments find distances of 0 to 3")
    rows = cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    prints = rows.groupBy("fp").agg(F.min("id").alias("least_id"))
    links = find_links(prints.select("fp"), distance, block)
    parts = cut(connected_components(links), "components")
    labelled = prints.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = labelled.join(names, "component").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


#: The wide fingerprint: four words.
WORDS = 4
#: A text has BANDS keys of the least hashes of its shingles under ROWS permutations each. Two texts of similarity s share a key with probability 1 - (1 - s ** ROWS) ** BANDS: 0.998 at 0.8, 0.08 at 0.4.
BANDS, ROWS = 20, 6
_TURNS = np.random.default_rng(23).integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_NAMES = [f"w{i}" for i in range(WORDS)]
_SHIFTS = np.arange(WORDS, dtype=np.uint64) * ODD


def wide_fingerprint(text: bytes, size: int = 5) -> np.ndarray:
    """A SimHash of 256 bits over the set of shingles, four words: a bit is set if it is set in over half of the hashes."""
    return wide_print(np.unique(shingle_hashes(text, size)))


def wide_print(hashes: np.ndarray) -> np.ndarray:
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), _CHUNK // WORDS):
        part = hashes[at : at + _CHUNK // WORDS]
        spread = np.column_stack([mixed(part + shift) for shift in _SHIFTS]).astype("<u8")
        ones += np.unpackbits(spread.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def expected_distance(similarity: float) -> float:
    """How many of the bits differ on average between shingle sets of one size with this Jaccard similarity."""
    return 64 * WORDS * float(np.arccos(2 * similarity / (1 + similarity))) / np.pi


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set of shingle hashes, numbered by band; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[None, at : at + 4096] * _TURNS).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(ROWS, BANDS):
        keys = mixed(keys * ODD + row)
    return keys.view(np.int64)


def wide_linked(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Whether pairs (the last axis has the words) pass the ring's chains of words and then the full check."""
    differ = np.bitwise_count(a ^ b).astype(np.int64)
    ring = np.concatenate([differ, differ], axis=-1)
    budget = distance * np.arange(1, WORDS)
    passed = np.zeros(differ.shape[:-1], bool)
    for start in range(WORDS):
        passed |= (WORDS * np.cumsum(ring[..., start : start + WORDS - 1], axis=-1) <= budget).all(axis=-1)
    passed[passed] = differ[passed].sum(axis=-1) <= distance
    return passed


def jaccard_links(sets: list[np.ndarray], words: np.ndarray, similarity: float, distance: int) -> list[tuple[int, int]]:
    """Links that span each cluster of the sets (sorted, distinct hashes; words are their fingerprints) whose pairs have this Jaccard similarity or more; empty sets link to none.

    Pairs are pruned by the pigeonring over the words and the Hamming distance; what is left is counted exactly.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    left, links = sizes > 0, []
    if left.sum() < 2:
        return []
    codes = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
    mark = np.zeros(int(max(c.max(initial=0) for c in codes)) + 1, bool)
    for root in range(len(sets)):
        front = [root] if left[root] else []
        left[root] = False
        while front:
            x = front.pop()
            near = np.flatnonzero(left & (similarity * np.maximum(sizes, sizes[x]) <= np.minimum(sizes, sizes[x]) + 1e-9))
            near = near[wide_linked(words[near], words[x], distance)]
            if not len(near):
                continue
            mark[codes[x]] = True
            common = np.add.reduceat(mark[np.concatenate([codes[y] for y in near])], np.r_[0, np.cumsum(sizes[near])[:-1]], dtype=np.int64)
            mark[codes[x]] = False
            found = near[common >= similarity * (sizes[near] + sizes[x] - common) - 1e-9]
            left[found] = False
            front += found.tolist()
            links += [(x, y) for y in found.tolist()]
    return links


def _wide_rows(texts: DataFrame, shingle: int) -> DataFrame:
    """rid, id, node (the shingle set's hash), size, keys and words for each row (rid, id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            nodes, sizes, keys, prints = [], [], [], []
            for t in as_bytes(batch.column(2)):
                hashes = np.unique(shingle_hashes(t, shingle))
                nodes.append(xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED))
                sizes.append(len(hashes))
                keys.append(band_keys(hashes))
                prints.append(wide_print(hashes))
            words = np.array(prints, np.uint64).reshape(-1, WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), *(pa.array(words[:, i].view(np.int64)) for i in range(WORDS))], ["rid", "id", "node", "size", "keys", *_NAMES])

    return texts.mapInArrow(run, f"rid long, id {texts.schema['id'].dataType.simpleString()}, node long, size long, keys array<long>, " + ", ".join(f"{w} long" for w in _NAMES))


def _families(wide: DataFrame) -> DataFrame:
    """node, family: sets that share a band key, directly or through others. A key with many sets gives a star, not pairs."""
    keys = wide.select("node", F.explode("keys").alias("key"))
    # Written first: the join is planned by its size, and a hot key can be split.
    least = cut(keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key", "least"), "least")
    edges = keys.join(least, "key").select(F.col("node").alias("u"), F.col("least").alias("v"))
    return cut(connected_components(edges).select("node", F.col("component").alias("family")), "families")


def _confirmed(rows: DataFrame, groups: DataFrame, shingle: int, similarity: float, distance: int) -> DataFrame:
    """u, v: links that span what is similar enough within each group (grp); groups name sets by the row (rid) that has their text."""
    each = groups.select(F.shiftright("rid", 33).cast("int").alias("__pid"), F.col("rid").alias("__rid"), F.struct("grp", "node", *_NAMES).alias("__member"))
    by_row = by_pid(each, "__pid").groupBy("__pid", "__rid").agg(F.collect_list("__member").alias("__members"))
    texts = rows.join(by_row.hint("shuffle_hash"), (F.col("__pid") == F.col("pid")) & (F.col("__rid") == F.col("rid")))
    dealt = texts.select("text", F.explode("__members").alias("m")).select("m.grp", "m.node", *(f"m.{w}" for w in _NAMES), "text")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        words: list[list[int]] = []
        group, left, right = None, [], []

        def close() -> None:
            nodes = list(sets)
            for x, y in jaccard_links(list(sets.values()), np.array(words, np.int64).reshape(-1, WORDS).view(np.uint64), similarity, distance):
                left.append(nodes[x])
                right.append(nodes[y])
            sets.clear()
            words.clear()

        for batch in small(batches):
            for grp, node, *own, text in zip(*(batch.column(i).to_pylist() for i in range(2 + WORDS)), as_bytes(batch.column(2 + WORDS)), strict=True):
                if grp != group:
                    close()
                    group = grp
                if node not in sets:
                    sets[node] = np.unique(shingle_hashes(text, shingle))
                    words.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])
            left.clear()
            right.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])

    return dealt.repartition("grp").sortWithinPartitions("grp").mapInArrow(confirm, "u long, v long")


def _grouped(members: DataFrame, *parts: Column) -> DataFrame:
    return members.withColumn("grp", F.xxhash64("family", *parts))


def _all_links(rows: DataFrame, sets: DataFrame, shingle: int, similarity: float, distance: int, block: int) -> DataFrame:
    """Links that connect each cluster of similar sets within families. sets: family, node, size, rid, words.

    A family of up to about `block` sets (or of block * 2,048 shingles) is one
    group. A larger one is cut into blocks: first each block is a group of its
    own, then one set of each cluster found is compared with those of other
    blocks, and at last the sets outside the family's largest cluster, in
    blocks, with all blocks, so that no pair of different clusters is left out.
    """
    sized = sets.groupBy("family").agg(F.count("*").alias("n"), F.sum("size").alias("total")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(block)), F.ceil(F.col("total") / F.lit(block * 2048))).cast("long")
    members = cut(sets.join(sized.select("family", blocks.alias("blocks")), "family"), "members")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    confirm = lambda groups: _confirmed(rows, groups, shingle, similarity, distance)
    links = cut(confirm(_grouped(members, mine)), "links")
    large = members.where("blocks > 1")
    if large.isEmpty():
        return links

    def clusters(links: DataFrame) -> DataFrame:
        """large with the cluster of each set."""
        parts = cut(connected_components(links), "clusters")
        return large.join(parts, "node", "left").withColumn("cluster", F.coalesce("component", "node")).drop("component")

    heads = clusters(links).where("node = cluster")
    heads = heads.join(heads.groupBy("family").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("parts")), "family")
    links = links.unionByName(cut(confirm(_grouped(heads, F.lit("heads"), F.pmod(F.xxhash64(F.lit(3), F.col("node")), F.col("parts")))), "links"))
    found = cut(clusters(links), "found")
    sizes = found.groupBy("family", "cluster").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("family").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("main"))
    rest_blocks = found.join(largest, "family").where("cluster <> main").groupBy("family").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("rest"))
    open_ = found.join(cut(largest.join(rest_blocks, "family"), "open"), "family")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    rest = open_.where("cluster <> main").withColumn("i", F.pmod(F.xxhash64("node"), F.col("rest")))
    among = rest.withColumn("j", upto(F.col("rest"))).select(*members.columns, F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), F.lit("rest").alias("kind"))
    against = rest.withColumn("j", upto(F.col("blocks"))).select(*members.columns, F.col("i").alias("x"), F.col("j").alias("y"), F.lit("main").alias("kind"))
    main = open_.where("cluster = main").withColumn("j", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("i", upto(F.col("rest")))
    main = main.select(*members.columns, F.col("i").alias("x"), F.col("j").alias("y"), F.lit("main").alias("kind"))
    last = confirm(_grouped(among.unionByName(against).unionByName(main), F.col("kind"), F.col("x"), F.col("y")))
    return links.unionByName(cut(last, "links"))


def _components(rows: DataFrame, shingle: int, similarity: float, slack: int, block: int) -> DataFrame:
    """rid, id, component for each row (pid, rid, id, text)."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must lie in (0, 1]")
    wide = cut(_wide_rows(rows.select("rid", "id", "text"), shingle), "wide")
    nodes = wide.groupBy("node").agg(F.min(F.struct("rid", "size", *_NAMES)).alias("one"))
    sets = nodes.join(_families(wide), "node").select("family", "node", "one.*")
    links = _all_links(rows, sets, shingle, similarity, int(expected_distance(similarity)) + slack, block)
    linked = cut(connected_components(links), "components")
    return wide.select("rid", "id", "node").join(linked, "node", "left").select("rid", "id", F.coalesce("component", "node").alias("component"))


def _with_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """pid, rid, id, text of docs: written once, in buckets of pid, so that what is dealt out by pid meets texts that stay where they are."""
    return bucketed(docs.select(F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")), "pid")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, similarity: float = 0.8, slack: int = 32, block: int = 1024) -> DataFrame:
    """id and component for each row: groups over links of this Jaccard similarity of shingle sets or more, each link confirmed on the sets.

    Candidates share a band key (see BANDS); a pair of similarity 0.8 shares
    one in 99.8 % of cases and is often connected through others as well. Pairs
    that differ in more bits than the expected distance plus `slack` (over five
    standard deviations) are pruned. block bounds the sets of a group. Null
    texts are empty, and texts without words are alike. Sets are told apart by
    64-bit numbers. Other columns are not carried.
    """
    found = _components(_with_rows(docs, id_col, text_col), shingle, similarity, slack, block)
    return found.select(F.col("id").alias(id_col), "component")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, similarity: float = 0.8, slack: int = 32, block: int = 1024) -> DataFrame:
    """docs without near duplicates: of each of the similar_groups exactly one row stays, that with the smallest id (nulls last), with all columns; of rows that share that id any one."""
    pid, rid = unused(docs, "pid"), unused(docs, "rid")
    whole = bucketed(docs.withColumns({pid: F.spark_partition_id(), rid: F.monotonically_increasing_id()}), pid)
    rows = whole.select(F.col(pid).alias("pid"), F.col(rid).alias("rid"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = cut(_components(rows, shingle, similarity, slack, block), "found")
    first = cut(found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")).alias("first"), F.count("*").alias("n")).where("n > 1").select("component", "first.rid"), "first")
    gone = found.select("component", F.col("rid").alias("mine")).join(first, "component").where("mine <> rid").select("mine")
    gone = by_pid(cut(gone, "gone").select(F.shiftright("mine", 33).cast("int").alias("__pid"), F.col("mine").alias("__rid")), "__pid")
    left = whole.join(gone.hint("shuffle_hash"), (F.col(pid) == F.col("__pid")) & (F.col(rid) == F.col("__rid")), "left_anti")
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))
