"""N-gram Jaccard join by parity sketches, with pigeonhole candidates and exact verification.

A document's set holds its distinct five-word shingles.  Equal sets are one node, known
by a 64-bit digest of the set.  Two sets of sizes ``a`` and ``b`` reach a Jaccard
similarity of 3/4 only if they differ in at most ``(a + b) / 7`` shingles.

* A **parity sketch** flips one of its bits for every shingle, so the Hamming distance of
  two sketches is never larger than their symmetric difference.
* For the **pigeonhole join** the shingles of a set fall into blocks (many more than the
  allowed difference), and each block keeps the XOR of its shingles.  A differing
  shingle changes one block, so similar sets agree in a block; in any common order of
  blocks they do so among the first ``difference + 1`` of each.  Blocks with rare
  shingles come first in that order, so a passage that thousands of documents share does
  not make them candidates.  Blocks are laid out per band of sizes (a factor of two); a set that can have
  a smaller partner in the band below is entered there too.
* Sets that share blocks and are next to each other in size are tried first, and their
  links give first components.  Then all pairs of a block that are still in different
  components are tried.  So copies of one text are never expanded into all pairs, yet
  no pair that could join two components is left out.
* A set is entered under ``spare`` more blocks than needed, so similar sets share at least
  ``spare + 1``.  If one of the two has at most ``spare`` entries in crowded blocks, they meet in
  a block that is not crowded.  So in crowded blocks only sets with more such entries are
  paired with each other, and there a folded sketch takes part in the join's condition, so that
  a block of texts that are alike but not similar makes few pairs.  Entries also carry the lowest
  crowded keys of their set: a pair that shares one of them is tried there and in no later block.
  A pair that shares too few blocks, the crowded ones it may share included, is not tried.
* Nine of ten entries share their key with none, so entries move as two ints, a key within its part
  of all keys and the set's **tag**, many of them a row.  Tags name sets only once the blocks are known.
  Different sets with one tag are a pair to try, so what such sets lose in a block is not lost.
* A pair is dropped only if its sketches prove it too far apart; all others are decided
  by the exact intersection of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retail_spark.llm.common import NO_ID, mix, safe_id, true_id
from retail_spark.llm.components import connected_components
from retail_spark.llm.shingles import fingerprint, shingle_set
from retail_spark.sources.scratch import stage

LEAST_SKETCH_BITS = 1024
#: Bits of a block's key; keys that collide only add pairs to try.
KEY_BITS = 48
#: One block in so many shingles is entered as a spare one.
SPARE_PART = 16
#: Parts of all keys for each partition of a shuffle, so that partitions are about equal.
PARTS_PER_PARTITION = 16
#: Entries that a task packs into rows together, one row for each part.
PACKED_ENTRIES = 1_000_000
#: Bits of a tag that come from a set's digest, below those of its size.
TAG_BITS = 26
#: A block that so many sets share is crowded.
CROWDED = 32
#: Longs of the folded sketch that entries in crowded blocks carry; it can part sets of up to about 900 shingles.
FOLDED_LONGS = 8
#: Lowest crowded keys of a set that its entries carry, to try a pair once and not in each block it shares.
LOW_KEYS = 16
#: Shingles that occur in more than one of so many documents come last in the order of blocks.
COMMON_SHARE = 1000
#: The most common shingles kept for that order; it changes the work, never the result.
COMMON_KEPT = 1 << 17
#: Sets that a task remembers to have entered; one that it forgets is entered again, which changes no result.
REMEMBERED_SETS = 200_000
#: Documents whose shingles are counted together before the counts are merged.
COUNTED_SHINGLES = 2_000_000
#: A list of so many row ids is broadcast; a longer one is joined by a shuffle.
BROADCAST_IDS = 1_000_000


def parity_sketch(shingles: np.ndarray) -> bytes:
    """A bit sketch in which each shingle has flipped one bit; its bits grow with the set."""
    bits = max(LEAST_SKETCH_BITS, 1 << (2 * len(shingles)).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches of one length as rows of ``size`` bytes: a half laid over the other is the sketch of half the bits."""
    rows = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    while rows.shape[1] > size:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def hamming(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """Hamming distances of sketches, pair by pair, in the bits of the shorter one."""
    far = np.zeros(len(one), np.int32)
    sizes = np.array([(len(a), len(b)) for a, b in zip(one, two)])
    for a, b in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes[:, 0] == a) & (sizes[:, 1] == b))
        size = min(a, b)
        apart = _folded([one[i] for i in at], size) ^ _folded([two[i] for i in at], size)
        far[at] = np.bitwise_count(apart).sum(axis=1)
    return far


def blocks_of_band(band: int) -> int:
    """Blocks for sets of 2**band to 2**(band + 1) shingles (a third more in the larger set).

    Enough that the blocks with content outnumber the allowed difference by many
    standard deviations, few enough that most hold two shingles or more.
    """
    if band < 4:
        return 1 << 16
    return (4 << band) if band < 6 else (3 << band) // 2 if band < 8 else 1 << band


def tags(sizes: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """32-bit tags of sets, ordered by size: by quarters of a factor of two, then by digest."""
    n = np.clip(np.asarray(sizes, np.int64), 1, (1 << 16) - 1)
    band = np.frexp(n.astype(np.float64))[1].astype(np.int64) - 1
    quarter = 4 * band + (((n << 2) >> band) & 3)
    return (((quarter << TAG_BITS) | (np.asarray(nodes, np.int64) & ((1 << TAG_BITS) - 1))) - (1 << 31)).astype(np.int32)


def spare(n: int) -> int:
    """How many blocks more than needed a set of ``n`` shingles is entered under."""
    return n // SPARE_PART


def block_keys(shingles: np.ndarray, band: int, difference: int, common: np.ndarray) -> np.ndarray:
    """The keys of the first blocks with content, those of rare shingles first.

    One more than ``difference`` is needed, and the spare ones.
    """
    spread = mix(shingles + np.uint64(band + 1))
    block = ((spread >> np.uint64(32)) * np.uint64(blocks_of_band(band))) >> np.uint64(32)
    order = np.argsort(block, kind="stable")
    block, spread, plain = block[order], spread[order], shingles[order]
    first = np.flatnonzero(np.diff(block, prepend=block[:1] + np.uint64(1)))
    if len(first) <= difference:
        raise ValueError(f"{len(shingles)} shingles fill only {len(first)} blocks: take another layout")
    word = np.bitwise_xor.reduceat(spread, first)
    key = mix(word ^ mix((block[first] << np.uint64(6)) + np.uint64(band))) >> np.uint64(64 - KEY_BITS)
    take = difference + 1 + spare(len(shingles))
    usual = np.zeros(len(plain), bool)
    if len(common):
        at = np.minimum(np.searchsorted(common, plain), len(common) - 1)
        usual = common[at] == plain
    usual = np.logical_and.reduceat(usual, first)
    return key if take >= len(key) else key[np.lexsort((key, usual))[:take]]


def keys_of_set(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """All keys under which a set is entered, in its own band and in the one below if it reaches there.

    A pair meets in the band of its smaller set.
    """
    n = len(shingles)
    if n < 3:  # smaller sets are similar to equal ones only
        return np.empty(0, np.uint64)
    band = n.bit_length() - 1
    keys = [block_keys(shingles, band, n // 3, common)]
    smallest = -(-3 * n // 4)
    if smallest.bit_length() - 1 < band:
        keys.append(block_keys(shingles, band - 1, 2 * n // 7, common))
    return np.concatenate(keys)


def _describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Size, digest and sketch per row, and now and then the shingles that were common so far."""
    held: list[np.ndarray] = []
    rows = 0

    def often() -> tuple[list, list]:
        nonlocal held, rows
        if not held:
            return [], []
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        keep = counts >= max(4, rows // COMMON_SHARE)
        held, rows = [], 0
        return values[keep].view(np.int64).tolist(), counts[keep].tolist()

    for frame in frames:
        out = []
        for doc_id, text in zip(frame["doc_id"], frame["text"]):
            shingles = shingle_set(text)
            held.append(shingles)
            rows += 1
            sketch = parity_sketch(shingles) if len(shingles) > 2 else b""
            common = ([], [])
            if sum(map(len, held[-64:])) > COUNTED_SHINGLES or (
                rows % 64 == 0 and sum(map(len, held)) > COUNTED_SHINGLES
            ):
                common = often()
            out.append((doc_id, len(shingles), fingerprint(shingles), sketch, *common))
        made = pd.DataFrame(out, columns=["doc_id", "n", "node", "sketch", "common", "times"])
        yield made.assign(tag=tags(made["n"].to_numpy(np.int64), made["node"].to_numpy(np.int64)))
    values, counts = often()
    if values:
        yield pd.DataFrame(
            [(None, None, None, None, values, counts, None)],
            columns=["doc_id", "n", "node", "sketch", "common", "times", "tag"],
        )


def _shared_keys(common: np.ndarray):
    def enter(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A task enters equal sets once: a text that a third of all rows share is one entry per task and key.
        entered: set[int] = set()
        for frame in frames:
            for at in range(0, len(frame), 250):
                keys, nodes, sizes = [], [], []
                for text in frame["text"].iloc[at : at + 250]:
                    shingles = shingle_set(text)
                    node = fingerprint(shingles)
                    if node in entered:
                        continue
                    if len(entered) >= REMEMBERED_SETS:
                        entered.clear()
                    entered.add(node)
                    own = keys_of_set(shingles, common)
                    keys.append(own)
                    nodes.append(np.full(len(own), node, np.int64))
                    sizes.append(np.full(len(own), len(shingles), np.int32))
                if not keys:
                    continue
                yield pd.DataFrame(
                    {"key": np.concatenate(keys).view(np.int64), "node": np.concatenate(nodes), "n": np.concatenate(sizes)}
                )

    return enter


def _packed_keys(common: np.ndarray, parts: int):
    """Entries as rows of one part of all keys: keys within the part, and tags."""

    def pack(held: list[pd.DataFrame]) -> pd.DataFrame:
        key = np.concatenate([x["key"].to_numpy() for x in held]).view(np.uint64)
        tag = np.concatenate([tags(x["n"].to_numpy(), x["node"].to_numpy()) for x in held])
        part = (key % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)
        order = np.argsort(part, kind="stable")
        key = (key // np.uint64(parts)).astype(np.uint32).view(np.int32)[order]
        part, tag = part[order], tag[order]
        first = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
        return pd.DataFrame({"part": part[first].astype(np.int32), "keys": np.split(key, first[1:]), "tags": np.split(tag, first[1:])})

    def enter(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for entries in _shared_keys(common)(frames):
            held.append(entries)
            size += len(entries)
            if size >= PACKED_ENTRIES:
                yield pack(held)
                held, size = [], 0
        if size:
            yield pack(held)

    return enter


def _sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for at in range(0, len(frame), 100):
            sets = [shingle_set(text) for text in frame["text"].iloc[at : at + 100]]
            nodes = [fingerprint(x) for x in sets]
            yield pd.DataFrame({"node": nodes, "shingles": [x.view(np.int64) for x in sets]})


def _fold_sketches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if len(frame):
            bits = [_folded([x], 8 * FOLDED_LONGS)[0].copy().view(np.int64) for x in frame["sketch"]]
            yield pd.DataFrame({"node": frame["node"], **{f"b{i}": [x[i] for x in bits] for i in range(FOLDED_LONGS)}})


def _near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose blocks and sketches allow them to be similar.

    A pair may say how many blocks that are not crowded it shares (``times``), a set how many of its
    blocks are crowded (``held``).  More than half of the spare blocks are asked for, not all of them,
    because a set may fill fewer blocks than it is to be entered under.
    """

    def distances(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            keep = hamming(frame["sketch_u"].tolist(), frame["sketch_v"].tolist()) <= (frame["nu"] + frame["nv"]) // 7
            yield frame.loc[keep, ["u", "v"]]

    one = sketches.withColumnsRenamed({"node": "u", "n": "nu", "sketch": "sketch_u"})
    two = sketches.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sketch_v"))
    met = pairs.join(one, "u")
    if "times" in pairs.columns:
        met = met.where(F.col("times") + F.col("held") > F.floor(F.floor(3 * F.col("nu") / 4) / (2 * SPARE_PART)))
    return met.select("u", "v", "nu", "sketch_u").join(two, "v").mapInPandas(distances, "u long, v long")


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets reach the similarity, by exact intersection.

    Only documents that stand for a set of some pair are read into shingles again.
    """
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = stage(nodes.join(wanted, "node").select(F.col("row_id").alias("doc_id")), "wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    sets = docs.join(wanted, "doc_id", "left_semi").mapInPandas(_sets, "node long, shingles array<long>")
    sets = stage(sets, "sets").dropDuplicates(["node"])
    one = sets.select(F.col("node").alias("u"), F.col("shingles").alias("one"))
    two = sets.select(F.col("node").alias("v"), F.col("shingles").alias("two"))
    both = F.size(F.array_intersect("one", "two"))
    union = F.size("one") + F.size("two") - both
    return pairs.select("u", "v").join(one, "u").join(two, "v").where(4 * both >= 3 * union).select("u", "v")


def _to_hubs(crowded: DataFrame, named: DataFrame) -> DataFrame:
    """A pair (u, v) for each set: itself and the hub that most of its crowded blocks have.

    The hub of a block is the set in it that is in most crowded blocks.
    """
    fame = crowded.groupBy("tag").agg(F.count("*").alias("fame")).join(named, "tag")
    famed = stage(crowded.select("key", "tag").join(fame, "tag").drop("tag"), "fame")
    hub = famed.groupBy("key").agg(F.max(F.struct("fame", "node", "n")).alias("hub"))
    met = famed.join(hub, "key").where("node <> hub.node and 4 * n >= 3 * hub.n and 4 * hub.n >= 3 * n")
    times = met.groupBy("node", F.col("hub.node").alias("hub")).agg(F.count("*").alias("times"))
    chosen = times.groupBy("node").agg(F.max(F.struct("times", "hub")).alias("best")).select("node", "best.hub")
    return chosen.select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v"))


def ngram_jaccard_join(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``documents`` (doc_id, text).

    ``component_id`` is the smallest ``doc_id`` reachable by links, the row's own
    included.  A NULL or empty text, or one without words, has an empty set and is
    linked with nothing.  Repeated rows come back as often as they came in; rows that
    share a ``doc_id`` but not a text are linked by their texts alone.  A row without a
    ``doc_id`` is measured, but takes no part in links: its ``component_id`` is NULL.
    Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    docs = documents.select(safe_id("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.where(F.col("doc_id") != NO_ID)
    columns = "doc_id long, n int, node long, tag int, sketch binary, common array<long>, times array<int>"
    described = stage(docs.mapInPandas(_describe, columns), "sketches")
    rows = described.where("n is not null")
    often = (
        described.where("size(common) > 0")
        .select(F.explode(F.arrays_zip("common", "times")).alias("x"))
        .groupBy(F.col("x.common").alias("shingle"))
        .agg(F.sum("x.times").alias("times"))
        .where(F.col("times") >= max(8, rows.count() // COMMON_SHARE))
        .orderBy(F.desc("times"), "shingle")
        .limit(COMMON_KEPT)
    )
    # As Arrow: rows of Python objects would take the driver thirty times the memory of the numbers.
    common = np.sort(often.select("shingle").toArrow().column("shingle").to_numpy().astype(np.int64).view(np.uint64))

    conf = documents.sparkSession.conf
    partitions = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or conf.get("spark.sql.shuffle.partitions")
    packed = known.where("text is not null").mapInPandas(
        _packed_keys(common, PARTS_PER_PARTITION * int(partitions)), "part int, keys array<int>, tags array<int>"
    )
    entered = packed.repartition("part").select("part", F.inline(F.arrays_zip("keys", "tags"))).toDF("part", "key", "tag")
    order = Window.partitionBy("key", "part").orderBy("tag")
    # Equal sets stand side by side in a block; only the first of them counts.
    shared = (
        entered.withColumn("before", F.lag("tag").over(order))
        .where("before is null or before <> tag")
        .withColumn("after", F.lead("tag").over(order))
        .where("before is not null or after is not null")
        .withColumn("crowded", F.count("*").over(Window.partitionBy("key", "part")) > CROWDED)
        .select(F.expr("shiftleft(cast(part as bigint), 32) | (cast(key as bigint) & 4294967295)").alias("key"), "tag", "before", "crowded")
    )
    shared = stage(shared, "blocks")
    sketches = stage(
        rows.where((F.col("n") > 2) & (F.col("doc_id") != NO_ID))
        .groupBy("node")
        .agg(F.min("n").alias("n"), F.min("tag").alias("tag"), F.min("sketch").alias("sketch"), F.min("doc_id").alias("row_id")),
        "nodes",
    )
    named = sketches.select("tag", "node", "n")
    alike = "4 * one.n >= 3 * two.n and 4 * two.n >= 3 * one.n"
    # First, for each set, the one next to it that shares most blocks with it.
    next_to = shared.where("before is not null").groupBy("before", "tag").agg(F.count("*").alias("times"))
    next_to = next_to.alias("met").join(named.alias("two"), "tag").where(F.col("times") > F.col("n") / (4 * SPARE_PART))
    next_to = next_to.select("before", "times", "node", "n").alias("two").join(named.alias("one"), F.expr(f"two.before = one.tag and {alike}"))
    next_to = next_to.select(F.least("one.node", "two.node").alias("u"), F.greatest("one.node", "two.node").alias("v"), "times")
    nearest = next_to.groupBy("v").agg(F.max_by("u", "times").alias("u")).select("u", "v")
    nearest = nearest.unionByName(_to_hubs(shared.where("crowded"), named)).distinct()
    nearest = stage(_near(nearest, sketches), "near")
    first = stage(_verified(known, sketches, nearest), "links")
    label = connected_components(first)

    # Then what shares a block and is still apart.
    labelled = named.join(label, "node", "left").select("tag", "node", "n", F.coalesce("component", "node").alias("component"))
    located = shared.select("key", "tag").join(labelled, "tag").drop("tag")
    within = Window.partitionBy("key")
    open_blocks = stage(
        located.withColumn("low", F.min("component").over(within))
        .withColumn("high", F.max("component").over(within))
        .withColumn("held", F.count("*").over(within))
        .where("low <> high")
        .select("key", "node", "n", "component", (F.col("held") > CROWDED).alias("crowded")),
        "open",
    )
    crowded = open_blocks.where("crowded")
    most = F.floor(F.floor(3 * F.col("n") / 4) / SPARE_PART)  # the spare blocks of the smallest partner
    often_crowded = crowded.groupBy("node").agg(F.count("*").alias("held"), F.max("n").alias("n"), F.sort_array(F.collect_list("key")).alias("low"))
    often_crowded = often_crowded.where(F.col("held") > most).select("node", F.slice("low", 1, LOW_KEYS).alias("low"))
    folded = (
        sketches.join(often_crowded.select("node"), "node", "left_semi")
        .select("node", "sketch")
        .mapInPandas(_fold_sketches, "node long, " + ", ".join(f"b{i} long" for i in range(FOLDED_LONGS)))
    )
    crowded = crowded.join(often_crowded.select("node", "low"), "node").join(folded, "node")
    crowded = stage(crowded, "crowded")

    def apart(blocks: DataFrame, further: str = "true") -> DataFrame:
        pair = f"one.node < two.node and one.component <> two.component and {alike}"
        met = blocks.alias("one").join(blocks.alias("two"), F.expr(f"one.key = two.key and {pair} and {further}"))
        return met.select(F.col("one.node").alias("u"), F.col("two.node").alias("v"))

    apart_bits = " + ".join(f"bit_count(one.b{i} ^ two.b{i})" for i in range(FOLDED_LONGS))
    first_met = "coalesce(array_min(array_intersect(one.low, two.low)) >= one.key, true)"
    always = F.lit(1 << 31).alias("times")
    crowded_pairs = apart(crowded, f"7 * ({apart_bits}) <= one.n + two.n and {first_met}").select("u", "v", always)
    twins = named.alias("one").join(named.alias("two"), F.expr(f"one.tag = two.tag and one.node < two.node and {alike}"))
    twins = twins.select(F.col("one.node").alias("u"), F.col("two.node").alias("v"), always)
    rest = apart(open_blocks.where("not crowded")).withColumn("times", F.lit(1).cast("long")).unionByName(crowded_pairs).unionByName(twins)
    rest = rest.groupBy("u", "v").agg(F.sum("times").alias("times"))
    held = sketches.join(open_blocks.where("crowded").groupBy("node").agg(F.count("*").alias("held")), "node", "left")
    rest = _near(rest, held.fillna(0, ["held"]))
    rest = stage(rest.join(nearest, ["u", "v"], "left_anti"), "rest")
    links = first.unionByName(_verified(known, sketches, rest))
    label = connected_components(links)

    known_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    low = (
        rows.groupBy("node")
        .agg(F.min(known_id).alias("low"))
        .join(label, "node", "left")
        .select("node", F.coalesce("component", "node").alias("component"), "low")
    )
    lowest = low.groupBy("component").agg(F.min("low").alias("component_id"))
    named = low.join(lowest, "component").select("node", "component_id")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return (
        rows.join(named, "node")
        .withColumn("component_id", F.when(F.col("doc_id") != NO_ID, own))
        .select(true_id("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id")
    )
