"""Near-duplicate detection with BagMinHash signatures of word shingles."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import OWN, read_table, small, stored, trimmed

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
U53 = float(2**-53)
#: Points drawn at once, and bytes of text taken at once: the bounds of a worker's memory, whatever the batches.
POINTS, PIECE = 1 << 18, 1 << 19
#: Rows whose text and id are the same share this key.
ROW = ["id", "t1", "t2"]
BAG = ["bag", "bag2", "n"]


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct shingles of each text, in order, and each text's number of shingles.

    A text with fewer than `size` words has one shingle of all of them; one without words has none."""
    words, ends = W.split(texts)
    h = W.hashes(words)
    text, place = W.places(ends)
    n_words = np.diff(ends)
    starts = max(0, len(h) - size + 1)
    start = np.flatnonzero(place[:starts] + size <= n_words[text[:starts]])
    of, value = text[start], W.runs(h, size)[start]
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        whole = [W.mix(np.bitwise_xor.reduce(W.mix(h[ends[i] : ends[i + 1]] + np.arange(1, n_words[i] + 1, dtype=np.uint64) * np.uint64(W.BASE)), keepdims=True))[0] for i in short]
        of, value = np.concatenate([of, short]), np.concatenate([value, np.array(whole, np.uint64)])
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (value[1:] != value[:-1])]) if len(of) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(of)))
    return of[at], value[at], count, np.bincount(of, minlength=len(n_words))


def signatures(of: np.ndarray, h: np.ndarray, count: np.ndarray, total: np.ndarray, m: int) -> np.ndarray:
    """BagMinHash of each text's multiset: m numbers, equal in two texts at a place with the chance of their weighted Jaccard.

    A shingle's weight axis is cut into levels 1, 2, 3-4, 5-8, ...; each cut has a Poisson process of points in time
    whose rate is its width, and each point falls on a level within it and on one of the m places. Texts see the points
    on levels up to the shingle's count, the same ones in every text. A place's number is its earliest point. Points
    after a time at which all places are surely filled need not be drawn; texts for which it was too early go on to
    twice that time. Without shingles all places are infinite."""
    best = np.full((len(total), m), np.inf)
    levels = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))), 0).astype(np.int64)
    entry = np.repeat(np.arange(len(h)), levels + 1)
    j = np.arange(len(entry)) - np.repeat(np.cumsum(levels + 1) - (levels + 1), levels + 1)
    width = np.where(j > 0, 2.0 ** np.maximum(j - 1, 0), 1.0)
    seed = W.mix(h[entry] ^ W.mix(j.astype(np.uint64) + np.uint64(0x51ED27)))
    text = of[entry]
    # Texts of like sizes together, so that each entry draws about as many points at once as it needs.
    scale = np.floor(np.log2(np.maximum(total, 1))).astype(np.int64)
    for s in np.unique(scale[total > 0]):
        chosen = np.flatnonzero(scale[text] == s)
        limit = (math.log(m) + 4) / np.maximum(total, 1)
        flat = best.reshape(-1)
        while len(chosen):
            step = int(np.clip(m * (math.log(m) + 4) / 2.0**s / 2, 4, 1024))
            live, time, drawn = chosen, np.zeros(len(chosen)), 0
            while len(live):
                for part in np.array_split(np.arange(len(live)), max(1, len(live) * step // POINTS)):
                    e = live[part]
                    t = np.arange(drawn, drawn + step, dtype=np.uint64)
                    u = W.mix(seed[e][:, None] + (t + np.uint64(1)) * np.uint64(W.BASE))
                    # The carried time is added to from left to right, so that a point's bits don't depend on step.
                    x = np.empty((len(e), step + 1))
                    x[:, 0] = time[part]
                    x[:, 1:] = -np.log(((u >> np.uint64(11)).astype(np.float64) + 1) * U53) / (m * width[e])[:, None]
                    x = np.cumsum(x, axis=1)[:, 1:]
                    r = W.mix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                    place = (r >> np.uint64(32)) % np.uint64(m)
                    seen = x <= limit[text[e]][:, None]
                    lower = np.where(j[e] > 0, width[e], 0.0)[:, None]
                    seen &= lower + np.floor((r & np.uint64(0xFFFFFFFF)) * 2.0**-32 * width[e][:, None]) + 1 <= count[entry[e]][:, None]
                    np.minimum.at(flat, (text[e][:, None] * m + place.astype(np.int64))[seen], x[seen])
                    time[part] = x[:, -1]
                more = time <= limit[text[live]]
                live, time, drawn = live[more], time[more], drawn + step
            limit = limit * 2
            chosen = chosen[np.isinf(best.max(axis=1))[text[chosen]]]
    return best


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), bits.shape[:2]).copy()
    for r in range(rows):
        key = W.mix(key * np.uint64(W.BASE) + bits[:, :, r])
    return key.view(np.int64)


def _pieces(batches, text: int, size: int = PIECE):
    """Batches of at most about `size` bytes of text, or of one text."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths, dtype=np.int64) // size
        at = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int64)))


def _digest(size: int, bands: int, rows: int):
    def run(batches):
        for batch in _pieces(batches, 3):
            of, h, count, total = shingles(batch.column(3), size)
            keys = band_keys(signatures(of, h, count, total, bands * rows), bands, rows)
            # Equal multisets have equal sums of well-mixed hashes; two sums make 128 bits.
            sums = np.zeros((2, len(total)), np.uint64)
            for k, salt in enumerate((0, 0x632BE59BD9B4E019)):
                np.add.at(sums[k], of, W.mix(W.mix(h ^ np.uint64(salt)) ^ count.astype(np.uint64)))
            lists = _lists(np.arange(0, len(total) * bands + 1, bands), keys.reshape(-1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, sums.view(np.int64)), pa.array(total), lists], [*ROW, *BAG, "bands"])

    return run


def _elements(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of each element of the texts' multisets, a shingle's second occurrence being another element; the numbers of elements.

    So multisets become sets, and their weighted Jaccard that of the sets."""
    of, h, count, total = shingles(column, size)
    entry = np.repeat(np.arange(len(h)), count)
    nth = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
    return of[entry], W.mix(h[entry] + nth.astype(np.uint64) * np.uint64(W.BASE)), total


def _bags(size: int):
    def run(batches):
        for batch in _pieces(batches, 1):
            _, e, total = _elements(batch.column(1), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(np.concatenate([[0], np.cumsum(total)]), e)], ["node", "e"])

    return run


def similar(a: str, b: str, least: float) -> Column:
    """Whether two sets of elements have a Jaccard similarity of at least `least`; computed in the JVM."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both) >= least


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp): the least node that links lead to. Each round takes the least label among neighbours, then the
    label of that label; rounds are stored, so none is computed twice."""
    both = stored(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))), "links")
    label = stored(nodes.select("node", F.col("node").alias("comp")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("other"), "comp"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        new = label.join(near, "node", "left").select("node", F.col("comp").alias("old"), F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        new = stored(new, "labels")
        far = new.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        new = stored(new.join(far, "comp").select("node", "old", F.col("far").alias("comp")), "labels")
        label = new.select("node", "comp")
        if not new.where("comp != old").limit(1).count():
            return label


def star_pairs(groups: DataFrame, similarity: float, pivots: int = 2) -> DataFrame:
    """Pairs of each member of a group with the group's pivots: the members of the least hashes under `pivots` hashes."""
    heads = groups.groupBy("key").agg(F.count("*").alias("size"), *(F.min(F.struct(F.xxhash64("node", F.lit(i)), "node", "n"))[c].alias(f"{c}{i}") for i in range(pivots) for c in ("node", "n"))).where("size > 1")
    pairs = groups.join(heads, "key").select("node", "n", F.explode(F.array(*(F.struct(F.col(f"node{i}").alias("node"), F.col(f"n{i}").alias("n")) for i in range(pivots)))).alias("p"))
    pairs = pairs.where("node != p.node").select(F.col("node").alias("a"), F.col("n").alias("na"), F.lit(0).alias("ia"), F.col("p.node").alias("b"), F.col("p.n").alias("nb"), F.lit(0).alias("ib"))
    return _pairs(pairs, similarity)


def _pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b, of the pairs (a, na, ia, b, nb, ib) whose numbers of shingles allow the similarity.

    ia and ib count a text's shingles before the one that the two share, in an order of all shingles. If it is the
    first that they share, no more than the fewer of those from there on are common; a pair that is near passes for
    the first one."""
    most = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    fits = most >= (F.col("na") + F.col("nb")) * F.lit(similarity / (1 + similarity)) - 1e-6
    return rows.where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def cross_pairs(groups: DataFrame, label: DataFrame, similarity: float, limit: int = 32, pivots: int = 2) -> tuple[DataFrame, DataFrame]:
    """Pairs of members of a group that have different components, and the members of groups that need more rounds.

    Groups of one component have nothing to find. Mixed groups of at most `limit` members give all such pairs. In
    larger ones about `pivots` members, drawn by hash, meet all others; the others are left for another round, as
    (key, node, n, place)."""
    known = groups.join(label, "node")
    heads = known.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct(F.xxhash64("node", "key").alias("h"), "node"))["node"].alias("first")).where("lo != hi")
    share = F.pmod(F.xxhash64("key", "node"), F.ceil(F.col("size") / pivots)) == 0
    turn = F.when(F.col("size") > limit, share | (F.col("node") == F.col("first"))).otherwise(F.lit(True))
    # Few heads and few pivots are broadcast, so that the members of a large group stay where they are.
    mixed = stored(known.join(small(stored(heads, "heads")), "key").select("key", "node", "n", "place", "comp", turn.alias("pivot")), "mixed")
    left, right = (mixed.select("key", F.col("node").alias(x), F.col("n").alias("n" + x), F.col("place").alias("i" + x), F.col("comp").alias("c" + x), F.col("pivot").alias("p" + x)) for x in "ab")
    # Two pivots meet once.
    met = right.join(small(left.where("pa")), "key").where("a != b AND ca != cb AND (a < b OR NOT pb)")
    return _pairs(met, similarity), mixed.where("NOT pivot").select("key", "node", "n", "place")


def _counts(cells: int, lone=None):
    """Each batch's elements by hashed cell, a row for each cell that it uses; with lone, only cells of which that is 1."""

    def run(batches):
        for batch in batches:
            cell = (_flat(batch.column(0)).view(np.uint64) % np.uint64(cells)).astype(np.int64)
            if lone is not None:
                cell = cell[lone.value[cell] == 1]
            at, held = np.unique(cell, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held.astype(np.int64))], ["cell", "held"])

    return run


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _prefixes(similarity: float, often):
    def run(batches):
        for batch in batches:
            e, total = _flat(batch.column(1)), pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(np.arange(len(total)), total)
            held = often.value[(e.view(np.uint64) % np.uint64(len(often.value))).astype(np.int64)]
            order = np.lexsort((e, held, of))
            of, e, held = of[order], e[order], held[order]
            place = np.arange(len(of)) - (np.cumsum(total) - total)[of]
            # What no text that is looked for holds, or one of them alone, is no link.
            first = (held > 1) & (place <= (total - np.ceil(total * similarity - 1e-9))[of])
            ids = batch.column(0).to_numpy(zero_copy_only=False)[of[first]]
            yield pa.RecordBatch.from_arrays([pa.array(e[first]), pa.array(ids), pa.array(total[of[first]]), pa.array(place[first])], ["key", "node", "n", "place"])

    return run


def rare_groups(bags: DataFrame, similarity: float, cells: int = 1 << 20) -> DataFrame:
    """(key, node, n, place): groups of bags (node, e, minor) such that each pair of the similarity, of which one at least is
    minor, shares a group.

    Prefix filter: of two sets with a Jaccard of at least s, the n - ceil(s * n) + 1 first elements in any order that all
    share have one in common. The order is by how many minor sets hold an element, so that what none holds comes first
    and passages that many hold come last: counts of elements in hashed cells, a table whose size the caller fixes (the
    order, not the result, depends on it). Only minor sets are counted, and of the others what just one minor set holds."""
    spark = bags.sparkSession

    def table(found: DataFrame) -> np.ndarray:
        out, rows = np.zeros(cells, np.int64), found.groupBy("cell").agg(F.sum("held").alias("held")).toArrow()  # at most `cells` rows
        out[rows["cell"].to_numpy()] = rows["held"].to_numpy()
        return out

    kind = "cell long, held long"
    held = table(bags.where("minor").select("e").mapInArrow(_counts(cells), kind))
    held += table(bags.where("NOT minor").select("e").mapInArrow(_counts(cells, spark.sparkContext.broadcast(held)), kind))
    groups = bags.select("node", "e").mapInArrow(trimmed(_prefixes(similarity, spark.sparkContext.broadcast(held)), spark), "key long, node long, n long, place long")
    groups = stored(groups, "rare")
    shared = groups.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    return stored(groups.join(shared, "key", "left_semi"), "rare-shared")


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """label after more links; only the components that they touch are worked on."""
    ends = links.join(label.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(label.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
    ends = stored(ends.where("ca != cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "merges")
    if not ends.limit(1).count():
        return label
    top = components(ends.select(F.col("a").alias("node")).unionByName(ends.select(F.col("b").alias("node"))).distinct(), ends)
    top = small(stored(top.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "tops"))
    return stored(label.join(top, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "labels")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t1"), F.hash(text_col).alias("t2"), F.col(text_col).alias("text"))


def _same_row(a: str, b: str) -> Column:
    return reduce(Column.__and__, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in ROW))


def near_members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, t1, t2 (hashes of the text), n and rep (the id and text hashes of the class's row that stays) for each row of docs.

    1. A digest of each row: its multiset's 128-bit sum and its bands. 2. Equal multisets are one node from here on; the
    row that stands for a node has the least id. 3. Nodes that share a band with others are read again, once, and their
    multisets stored. 4. Pairs of a group's members with pivots, then within small mixed groups, then by rarest
    elements; each pair is decided on the stored multisets, in the JVM. 5. Components of the links, and back to the rows."""
    plain = _rows(docs, id_col, text_col)
    kinds = dict(plain.dtypes)
    row = ", ".join(f"`{c}` {kinds[c]}" for c in ROW)
    digest = stored(plain.mapInArrow(trimmed(_digest(size, bands, rows), docs.sparkSession), f"{row}, bag long, bag2 long, n long, bands array<long>"), "signatures")
    lead = F.struct(F.col("id").isNull().alias("none"), *ROW)
    nodes = digest.groupBy(*BAG).agg(F.min(lead).alias("lead"), F.any_value("bands").alias("bands"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    groups = nodes.where("n > 0").select("node", "n", F.lit(0).cast("long").alias("place"), F.explode("bands").alias("key"))
    crowded = groups.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    groups = stored(groups.join(crowded, "key", "left_semi"), "bands")
    wanted = stored(nodes.join(groups.select("node").distinct(), "node", "left_semi").select("node", *(F.col(f"lead.{c}").alias(c) for c in ROW)), "wanted")
    texts = plain.alias("p").join(small(wanted).alias("w"), _same_row("p", "w")).select("w.node", "p.text")
    bags = stored(texts.mapInArrow(trimmed(_bags(size), docs.sparkSession), "node long, e array<long>"), "multisets")
    if bags.select("node").count() > wanted.count():  # rows that repeat
        bags = stored(bags.groupBy("node").agg(F.any_value("e").alias("e")), "multisets")

    met = None

    def verified(pairs: DataFrame) -> DataFrame:
        nonlocal met
        pairs = stored(pairs.join(met, ["a", "b"], "left_anti") if met else pairs, "pairs")
        met = met.unionByName(pairs) if met else pairs
        first = pairs.join(bags.select(F.col("node").alias("a"), F.col("e").alias("ea")), "a")
        full = first.join(bags.select(F.col("node").alias("b"), F.col("e").alias("eb")), "b")
        return stored(full.where(similar("ea", "eb", similarity)).select("a", "b"), "linked")

    label = components(nodes.select("node"), verified(star_pairs(groups, similarity)))
    across, rest = cross_pairs(groups, label, similarity)
    label = merged(label, verified(across))
    crowd = stored(_crowd(rest, label), "crowd")
    if crowd.limit(1).count():
        # Cells for the counted texts, some hundred elements each, from 2**20 to 2**22.
        cells = 1 << min(22, max(20, (crowd.where("minor").count() * 256).bit_length()))
        rest, pivots = rare_groups(stored(bags.join(small(crowd), "node"), "crowd-multisets"), similarity, cells), 32
        local = label.join(small(crowd.select("node")), "node", "left_semi")
        found = []
        while rest.limit(1).count():
            across, rest = cross_pairs(rest, local, similarity, pivots=pivots)
            found.append(verified(across))
            local, rest, pivots = merged(local, found[-1]), stored(rest, "rest"), 2 * pivots
        if found:
            label = merged(label, reduce(DataFrame.unionByName, found))
    known = nodes.select("node", *BAG, "lead").join(label, "node")
    reps = known.groupBy("comp").agg(F.min("lead").alias("rep"))
    known = stored(known.join(reps, "comp").select(*BAG, "rep"), "classes")
    return digest.select(*ROW, *BAG).join(known, BAG).select(*ROW, "n", "rep", reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"rep.{c}")) for c in ROW)).alias("kept"))


def _crowd(rest: DataFrame, label: DataFrame) -> DataFrame:
    """(node, minor) of the members (key, node, ...) of groups of several components.

    minor: outside the component that has most members in some group. A link that is still missing in a group joins two
    components, so one of its ends at least is minor."""
    known = stored(rest.join(label, "node").select("key", "node", "comp"), "crowd-members")
    parts = known.groupBy("key", "comp").agg(F.count("*").alias("size"))
    tops = parts.groupBy("key").agg(F.max_by("comp", F.struct("size", "comp")).alias("top"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    return known.join(small(stored(tops, "tops-of-groups")), "key").groupBy("node").agg(F.max(F.col("comp") != F.col("top")).alias("minor"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, class_id, n_shingles, kept for each row of docs; class_id is the least doc_id of the class.

    Two documents are linked if the multisets of their five-word shingles (words as they are, whole texts) have a
    weighted Jaccard similarity of at least 0.8; a class is what links connect. Texts with fewer than five words have
    one shingle of all their words. Texts without words, nulls too, are alike and one class. An empty table gives no
    rows; other columns are not looked at.

    Texts alone decide: rows without an id stand each for themselves, and rows that share an id may be in several
    classes. kept marks the row of the least id (rows without one last, then by a hash of the text); rows that repeat it
    in id and text are marked too. class_id is null if no row of the class has an id.

    Equal multisets collapse into one node before anything is paired. Signatures of bands * rows numbers from bands; a
    pair of similarity 0.8 shares none of the 32 bands of 6 with a chance of 6e-5, one of 0.9 with 1e-11. In each band's
    groups, however large, members are compared with pivots, so that pairs grow with the members. Where that leaves a
    group of at most 32 in several components, all pairs between these are compared: 31 a member at most. A link that is
    still missing in a larger group has an end outside the group's largest component; such texts, and what shares their
    rarest shingles, are grouped once more by these, so that no link is lost; groups that are still large there meet
    pivots, more each round, until none is mixed. All pairs are verified on the multisets themselves. Labels, links and
    components stay distributed."""
    rows = near_members(docs, id_col, text_col, **options)
    return rows.select(F.col("id").alias("doc_id"), F.col("rep.id").alias("class_id"), F.col("n").alias("n_shingles"), "kept")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class, with the columns of docs: that of the least id, see near_classes.

    Of rows that repeat it in id and text, any one stays."""
    winners = near_members(docs, id_col, text_col, **options).where("kept").groupBy(*ROW).agg(F.count("*").alias("copies"))
    winners = stored(winners, "winners").select(*(F.col(c).alias(OWN + c) for c in ROW), "copies")
    keys = {OWN + "r" + c: x for c, x in zip(ROW, (F.col(id_col), F.xxhash64(text_col), F.hash(text_col)), strict=True)}
    rows = docs.withColumns(keys)
    same = reduce(Column.__and__, (F.col(OWN + "r" + c).eqNullSafe(F.col(OWN + c)) for c in ROW))
    out = rows.join(winners.where("copies = 1"), same, "left_semi")
    if winners.where("copies > 1").limit(1).count():
        out = out.unionByName(rows.join(winners.where("copies > 1"), same, "left_semi").dropDuplicates(list(keys)))
    return out.select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read_table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup(docs)
