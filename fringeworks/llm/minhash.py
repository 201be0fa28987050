"""Near duplicates by circulant MinHash.

Two permutations give the whole signature: the first scatters shingles over a
universe of 2**20 places, the second, shifted circularly by k, gives coordinate k
as its least value over the text's places (C-MinHash).  A text's places pick
windows of one table, so all coordinates are one minimum over windows.

Texts with equal shingle sets form a class, a node of the graph.  Classes that share
a band meet the band's first class, its leader; a link is confirmed on the full
shingle sets.  What is left around a leader in different components is measured
against a core set: members near enough to the core are linked for certain and meet
one second leader; others can be linked only if they differ from the core in the
same shingles, so pairs come from an inverted index of the rarest of these.  These
filters are exact, and no step compares all pairs of a group or holds a group in
one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec
from .common import counted, drop_scratch, map_batches, materialize, text_column
from .graph import components, relabelled

#: A pair at similarity 0.8 shares no band with probability (1 - 0.8**8)**56 = 3e-5.
BANDS, ROWS = 56, 8
UNIVERSE_BITS = 20
#: The map of candidates' ids has 32 bits for each, within these bounds (16 MB at most);
#: in a fuller map more texts are hashed again, and the result is the same.
BITMAP_BITS = (16, 27)
CORE_MEMBERS, CORE_DEALS = 64, 16
_PRIME = np.uint64(0xC2B2AE3D27D4EB4F)
_windows: dict[int, np.ndarray] = {}


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words; of all
    words as one where there are fewer; empty without words."""
    h = textvec.words(np.frombuffer(text, dtype=np.uint8))[2]
    if not len(h):
        return h
    k = min(width, len(h))
    s = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        s = s * _PRIME + h[j : len(h) - k + 1 + j]
    return np.unique(textvec.mix(s))


def _table(k: int) -> np.ndarray:
    if k not in _windows:
        size = 1 << UNIVERSE_BITS
        second = np.random.default_rng(11).permutation(size).astype(np.uint32)
        turned = second[(-np.arange(size)) % size]
        _windows[k] = np.lib.stride_tricks.sliding_window_view(np.concatenate([turned, turned[:k]]), k)
    return _windows[k]


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` least values of the shifted second permutation."""
    table, size = _table(k), 1 << UNIVERSE_BITS
    places = (textvec.mix(shingles ^ _PRIME) >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
    at = (size - places) % size
    out = np.full(k, np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(at), 256):
        np.minimum(out, table[at[i : i + 256]].min(axis=0), out=out)
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = signatures.reshape(-1, bands, rows).astype(np.uint64)
    key = np.zeros(x.shape[:2], dtype=np.uint64)
    for j in range(rows):
        key = textvec.mix(key * _PRIME + x[:, :, j] + np.uint64(1))
    return (key + np.arange(bands, dtype=np.uint64) * _PRIME).view(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sign(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, digests, signs = [], [], []
        for t in b.column("text").to_pylist():
            s = shingle_set(t.encode(), width)
            sizes.append(len(s))
            digests.append(_digest(s) if len(s) else None)
            signs.append(signature(s, bands * rows))
        keys = band_keys(np.array(signs).reshape(-1, bands * rows), bands, rows)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1)))
        extra = {"key": b.column("key")} if "key" in b.schema.names else {}
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), flat, *extra.values()], ["doc_id", "n", "digest", "bands", *extra])


def _slot(ids: np.ndarray, bits: int) -> np.ndarray:
    return (textvec.mix(ids.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _bitmap_part(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Per task, the non-empty 64-bit words of the bitmap of its ids."""
    words = np.zeros(1 << bits - 6, dtype=np.uint64)
    for b in batches:
        slot = _slot(b.column(0).to_numpy(), bits)
        np.bitwise_or.at(words, slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64))
    at = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words[at].view(np.int64))], ["word", "bits"])


def _sets(batches: Iterator[pa.RecordBatch], width: int, bits: int, wanted) -> Iterator[pa.RecordBatch]:
    words = wanted.value
    for b in batches:
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        slot = _slot(ids, bits)
        take = np.flatnonzero(words[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1))
        texts = b.column("text").take(pa.array(take)).to_pylist()
        sets = [shingle_set(t.encode(), width) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["digest", "shingles"])


def _candidate_sets(texts: DataFrame, nodes: DataFrame, count: int, width: int) -> DataFrame:
    """(node, shingles) of the classes in ``nodes`` (node, rep, digest).

    The ids wanted go out as a bitmap of bounded size, united in the cluster: a text
    that it excludes is neither hashed nor moved.  Rows it lets through wrongly find no
    partner in the join on the digest.
    """
    spark = texts.sparkSession
    low, high = BITMAP_BITS
    bits = min(high, max(low, (32 * count).bit_length()))
    lines = map_batches(nodes.select("rep"), lambda it: _bitmap_part(it, bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << bits - 6, dtype=np.uint64)
    words[lines.column("word").to_numpy()] = lines.column("bits").to_numpy().view(np.uint64)
    wanted = spark.sparkContext.broadcast(words)
    found = map_batches(texts.filter("doc_id is not null").select("doc_id", "text"), lambda it: _sets(it, width, bits, wanted), "digest binary, shingles array<long>")
    # A class of a repeated id or of repeated rows may be found more than once.
    sets = materialize(found.join(nodes.select("digest", "node").hint("merge"), "digest").dropDuplicates(["digest"]).select("node", "shingles"), "minhash-sets")
    wanted.destroy()
    return sets


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> tuple[DataFrame, int]:
    """The pairs (a, b) linked by the sizes of intersection and union, a stored table,
    and their number."""
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")).hint("merge")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")).hint("merge")
    near = 100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb"))
    both = pairs.join(right, "b").join(left, "a").filter(near)
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    sized = both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).cast("long").alias("sum"))
    return counted(sized.filter(f"100 * common >= {percent} * (sum - common)").select("a", "b"), name)


def _measured(around: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``around`` (group, node, label) with n, core (the size of the group's core set),
    diff, the shingles in which the member and the core differ, and cost: 100 for each
    shingle that the member lacks and ``percent`` for each that it has besides.

    The core is what most of CORE_MEMBERS members of the group's own component have.
    Any set would do, as it only serves to bound intersections; this one leaves few
    differences.  In a wide component no shingle may have a majority: the core is empty
    then, and all shingles are differences.
    """
    # The members of least hash, in two steps, so that no task sees a whole group.
    h = F.xxhash64("node")
    deal, whole = Window.partitionBy("group", "deal").orderBy("h", "node"), Window.partitionBy("group").orderBy("h", "node")
    dealt = around.filter("label = group").select("group", "node", h.alias("h"), F.pmod(h, F.lit(CORE_DEALS)).alias("deal"))
    dealt = dealt.withColumn("k", F.row_number().over(deal)).filter(f"k <= {CORE_MEMBERS}")
    chosen = dealt.withColumn("k", F.row_number().over(whole)).filter(f"k <= {CORE_MEMBERS}")
    chosen = chosen.select("group", "node", F.count("*").over(Window.partitionBy("group")).alias("size"))
    votes = chosen.join(sets.hint("merge"), "node").select("group", "size", F.explode("shingles").alias("shingle")).groupBy("group", "shingle").agg(F.count("*").alias("votes"), F.min("size").alias("size"))
    core = votes.filter("2 * votes > size").groupBy("group").agg(F.collect_list("shingle").alias("core"))
    both = around.join(sets.hint("merge"), "node").join(core.hint("merge"), "group", "left").withColumn("core", F.coalesce("core", F.array().cast("array<long>")))
    both = both.withColumns({"extra": F.array_except("shingles", "core"), "missing": F.array_except("core", "shingles")})
    cost = (100 * F.size("missing") + percent * F.size("extra")).cast("long")
    return materialize(both.select("group", "node", "label", F.size("shingles").alias("n"), F.size("core").alias("core"), cost.alias("cost"), F.concat("extra", "missing").alias("diff")), "minhash-measured")


def _possible(measured: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different components of a group that may be linked, and the
    stored index they come from.

    With x shingles in both differences, two members share core - missing(a) -
    missing(b) + x; so they are linked if and only if (100 + percent) x >= cost(a) +
    cost(b) - (100 - percent) core.  Where the right side is not positive both are
    linked with the member of least cost, too, which the step before has seen to.
    Otherwise they share at least a known number of differences: only those that other
    components have too count, and one of these is among the rarest of either member,
    all but that number less one (prefix filter).  No link is lost.
    """
    live = measured.groupBy("group").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("group")
    live = measured.join(live.hint("merge"), "group", "left_semi")
    spread = live.select("group", "node", "n", "label", "core", "cost", F.explode("diff").alias("shingle"))
    shared = spread.groupBy("group", "shingle").agg(F.count("*").alias("f"), F.min("label").alias("x"), F.max("label").alias("y"), F.min("cost").alias("low")).filter("x < y")
    each = Window.partitionBy("group", "node")
    able = spread.join(shared.select("group", "shingle", "f", "low").hint("merge"), ["group", "shingle"])
    able = able.withColumns({"able": F.count("*").over(each), "low": F.min("low").over(each), "place": F.row_number().over(each.orderBy("f", "shingle"))})
    need = F.greatest(F.lit(1), F.ceil((F.col("cost") + F.col("low") - (100 - percent) * F.col("core")) / F.lit(100 + percent)))
    rest = (F.col("able") - F.col("place") + 1).alias("rest")
    first = materialize(able.filter(F.col("place") <= F.col("able") - need + 1).select("group", "shingle", "node", "n", "label", "core", "cost", rest), "minhash-prefix")
    x, y = first.alias("x"), first.alias("y").hint("merge")
    same = (F.col("x.group") == F.col("y.group")) & (F.col("x.shingle") == F.col("y.shingle"))
    sizes = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    enough = (100 + percent) * F.least("x.rest", "y.rest") >= F.col("x.cost") + F.col("y.cost") - (100 - percent) * F.col("x.core")
    pairs = x.join(y, same & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & sizes & enough)
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), first


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row, and ``key_col`` if named.

    Two texts are linked if 100 * intersection >= ``percent`` * union of their
    sets of ``width``-word shingles; a component's id is the smallest doc_id of its
    rows, and the rows with that id and a text of the component are kept.  Null and
    empty texts, and texts of white space, have no shingle, are linked with nothing and
    kept.  A row with a null id has a null component, is kept, and links nothing.  Rows
    that repeat an id are judged each by its own text; rows that repeat id and text
    have one result.  An empty table gives an empty result; other columns are not read.
    """
    made: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(materialize(df, f"minhash-{name}"))
        return made[-1]

    key = [] if key_col is None else [F.col(f"`{key_col}`").cast("long").alias("key")]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text"), *key)
    signed = materialize(map_batches(texts, lambda it: _sign(it, width, bands, rows), "doc_id long, n long, digest binary, bands array<long>" + ", key long" * len(key)), "minhash-signed")
    classes = signed.filter("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    # Stored, so the numbers stay.
    classes = keep(classes.select(F.monotonically_increasing_id().alias("node"), "digest", "rep", "bands"), "classes")

    banded = classes.select(F.explode("bands").alias("band"), "node")
    leaders = banded.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader < last").select("band", "leader")
    members = keep(banded.join(leaders.hint("merge"), "band").select("leader", "node").distinct(), "members")
    named = classes.select("node", "digest", "rep")
    nodes, count = counted(named.join(members.select("node").distinct().hint("merge"), "node", "left_semi"), "minhash-nodes")
    made.append(nodes)
    chain: list[DataFrame] = []
    if count:
        sets = _candidate_sets(texts, nodes, count, width)
        made.append(sets)
        chain = _linked(members, sets, percent, made)
    component = named.select("digest", "rep", "node")
    label = component.withColumn("label", F.col("node"))
    for labels in chain:
        label = relabelled(label, "label", labels)
    if chain:
        least = label.groupBy("label").agg(F.min("rep").alias("component"))
        label = label.join(least.hint("merge"), "label")
    else:
        label = label.withColumn("component", F.col("rep"))
    found = materialize(label.select("digest", "component"), "minhash-components")
    drop_scratch(*made, *chain)
    # Rows without a shingle find none; their keys are spread by the id.
    spread = F.coalesce("digest", F.concat(F.lit("id"), F.col("doc_id").cast("string")).cast("binary"))
    out = signed.select("doc_id", "n", *["key"] * len(key), spread.alias("digest")).join(found.hint("merge"), "digest", "left")
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component_id, F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"), kept.alias("kept"), *([F.col("key").alias(key_col)] if key else []))


def _linked(members: DataFrame, sets: DataFrame, percent: int, made: list[DataFrame]) -> list[DataFrame]:
    """Tables (node, label) to be applied one after the other; after all of them linked
    nodes have one label.  ``made`` gets the stored tables that are done with then."""
    met = members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    star, n = _confirm(met, sets, percent, "minhash-star")
    made.append(star)
    chain = [components(star)] if n else []

    def label(df: DataFrame, column: str, tables: list[DataFrame]) -> DataFrame:
        for labels in tables:
            df = relabelled(df, column, labels)
        return df

    # Groups: what shares a band with a leader, by the leader's component, where more
    # components than one are left.
    around = label(label(members.withColumn("label", F.col("node")), "label", chain).withColumnRenamed("leader", "group"), "group", chain).distinct()
    mixed = around.filter("label <> group").select("group").distinct()
    around, n = counted(around.join(mixed.hint("merge"), "group", "left_semi").select("group", "node", "label"), "minhash-around")
    made.append(around)
    if not n:
        return chain
    measured = _measured(around, sets, percent)
    made.append(measured)
    # The member of least cost is the group's second leader.
    middle = measured.groupBy("group").agg(F.min(F.struct("cost", "node", "label")).alias("m")).select("group", F.col("m.node").alias("middle"), F.col("m.label").alias("own"))
    again = measured.select("group", "node", "label").join(middle.hint("merge"), "group").filter("label <> own")
    again = again.select(F.least("middle", "node").alias("a"), F.greatest("middle", "node").alias("b")).distinct()
    more, n = _confirm(again, sets, percent, "minhash-again")
    made.append(more)
    if n:
        chain.append(components(label(label(more, "a", chain), "b", chain)))
    pairs, index = _possible(label(measured, "label", chain[-1:] if n else []), percent)
    rest, n = _confirm(pairs, sets, percent, "minhash-rest")
    made.extend([index, rest])
    if n:
        chain.append(components(label(label(rest, "a", chain), "b", chain)))
    return chain
