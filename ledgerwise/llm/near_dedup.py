"""MinHash near-dedup with SuperMinHash: signatures, banding, exact verification and union-find grouping.

SuperMinHash gives each element a random permutation of the signature's slots and the ranks j + r, r in
[0, 1), in that order; a slot keeps the least. All elements of a document take step j together, and a
document stops once every slot holds less than j + 1, since later steps can't lower it.

Documents with equal sets are one class. Classes that share a band are candidates, but never all pairs of
a bucket. Every member is compared on full sets with the bucket's pivot, the member that has most company
in all its buckets: among near copies, the one nearest to the original. What the two sets don't share is
the member's edits. Members linked to a pivot are in one component; so are those whose pivots are.

A member x that isn't linked to a pivot (a straggler) may yet be linked to another member y of that pivot's
group. This matters only if y is in another component so far, and sizes and edits tell exactly: with e edits
and n shingles, |x xor y| = e(x) + e(y) - 2 * shared edits, and a link at 0.8 needs it to be
(n(x) + n(y)) / 9 at most. As e(x) > (n(x) + n(pivot)) / 9, x and y must share edits, about half of them or
more, so a prefix join on each one's rarest edits finds all such pairs. Edits that only one component has
can't be shared with another; they aren't joined. So no link that would change a component goes untold, a
bucket of n near copies costs about n comparisons, and so do several families of near copies in one bucket,
each of which has its own pivot in the buckets that its members share with nobody else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written
from .textarrays import LOWER, NOT_SPACE, Words, lean, mix, text_slices
from .url_filter import bloom_blocks, blocked_bloom, possible_hits

#: 32 bands of 5 slots: a pair at 0.8 shares no band with a chance of 3e-6, at 0.9 of 1e-12.
BANDS, BAND_SLOTS = 32, 5
SLOTS = BANDS * BAND_SLOTS
#: Elements whose permutations are in memory at once (a byte for each slot); a larger set is taken in parts.
CHUNK = 1 << 15
#: Pairs whose sets are in memory at once.
COMPARE_ROWS = 512


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Each row's sorted distinct hashes of k-word shingles; with fewer words, of the whole row."""
    plain = words.hashes()
    at, hashes = words.windows(plain, k)
    cuts = np.searchsorted(at, words.first)
    out = [np.unique(hashes[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]
    for row in np.flatnonzero((words.count < k) & (words.count > 0)):
        whole = words.count[row : row + 1].astype(np.uint64)
        for at in range(words.first[row], words.first[row + 1]):
            whole = mix(whole * np.uint64(31) + plain[at : at + 1])
        out[row] = whole
    return out


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """(rows, slots) of 64-bit ranks, step in the upper and fraction in the lower half; empty sets: all ones."""
    out = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(s) for s in sets])
    at = 0
    while at < len(sets):
        to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK, "right")) + at)
        rows = np.flatnonzero(sizes[at:to]) + at
        if sizes[at] > CHUNK:  # a slot's least rank is the least of the parts' least ranks
            for a in range(0, sizes[at], CHUNK):
                np.minimum(out[at], _signatures([sets[at][a : a + CHUNK]], slots)[0], out=out[at])
        elif len(rows):
            out[rows] = _signatures([sets[r] for r in rows], slots)
        at = to
    return out


def _signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    ranks = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    flat = ranks.reshape(-1)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = np.concatenate(sets)
    order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(element), 1))
    here = np.arange(len(element))
    for step in range(slots):
        drawn = mix(element + np.uint64((2 * step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        swap = step + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(slots - step) >> np.uint64(32)).astype(np.int64)
        slot = order[here, swap]
        order[here, swap] = order[here, step]
        np.minimum.at(flat, row * slots + slot, (drawn >> np.uint64(32)) + np.uint64(step << 32))
        going = ranks.max(axis=1) >= np.uint64((step + 1) << 32)
        if not going.any():
            break
        keep = going[row]
        if keep.sum() < 0.8 * len(keep):
            row, element, here = row[keep], element[keep], here[keep]
    return ranks


def _set_keys(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Two independent 64-bit sums that equal sets have in common."""
    salts = (np.uint64(0), np.uint64(0x5851F42D4C957F2D))
    return [np.array([mix(s ^ salt).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for salt in salts]


def _key_task(k: int):
    """(id, text) -> (id, text, key1, key2)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                keys = _set_keys(shingle_sets(Words(LOWER[data], offsets, NOT_SPACE), k))
                yield pa.record_batch([*(c.slice(lo, hi - lo) for c in batch.columns), *keys], ["id", "text", "key1", "key2"])

    return lean(task)


def _signature_task(k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                sets = shingle_sets(Words(LOWER[data], offsets, NOT_SPACE), k)
                ranks = superminhash(sets)
                grouped = mix(ranks).reshape(len(sets), BANDS, BAND_SLOTS)
                bands = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
                for i in range(BAND_SLOTS):
                    bands = mix(bands + grouped[:, :, i])
                n = hi - lo
                bands = pa.FixedSizeListArray.from_arrays(pa.array(bands.view(np.int64).reshape(-1)), BANDS).cast(pa.list_(pa.int64()))
                yield pa.record_batch([batch.column(0).slice(lo, n), pa.array([len(s) for s in sets], pa.int64()), *_set_keys(sets), bands], ["doc_id", "n_shingles", "key1", "key2", "bands"])

    return lean(task)


def _compare_task(k: int):
    """(a, b, texts) -> sizes of both sets and the shingles that only one of them has."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), COMPARE_ROWS):
                batch, sides = whole.slice(at, COMPARE_ROWS), []
                for c in (2, 3):
                    sets = []
                    for _, _, data, offsets in text_slices(batch.column(c)):
                        sets += shingle_sets(Words(LOWER[data], offsets, NOT_SPACE), k)
                    sides.append(sets)
                edits = [np.setxor1d(one, two, assume_unique=True).view(np.int64) for one, two in zip(*sides, strict=True)]
                cuts = np.concatenate([[0], np.cumsum([len(x) for x in edits])])
                sizes = [pa.array([len(x) for x in side], pa.int64()) for side in sides]
                yield pa.record_batch([batch.column(0), batch.column(1), *sizes, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(edits)))], ["a", "b", "na", "nb", "edits"])

    return lean(task)


def _is_link(total: str, differ: str, percent: int) -> Column:
    """From |x| + |y| and |x xor y|: 100 * intersection >= percent * union, in whole numbers."""
    return F.expr(f"100 * (({total}) - ({differ})) >= {percent} * (({total}) + ({differ}))")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges(a, b) -> (id, comp): each node's smallest reachable id, by least neighbour and pointer jumps, until no label falls.

    Labels only fall, so the rounds end; a chain of n nodes takes about log n of them. Each round's tables replace the last one's.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    state = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("comp"), F.lit(True).alias("changed")).withColumnRenamed("u", "id"), "comps")
    while state.where("changed").limit(1).count():
        jump = state.select(F.col("id").alias("low"), F.col("comp").alias("lower"))
        moved = written(state.withColumn("low", F.col("comp")).join(jump, "low").select("id", "comp", F.least("low", "lower").alias("low")), "jumped")
        seen = moved.select(F.col("id").alias("v"), F.col("low").alias("vcomp"))
        near = both.join(seen, "v").groupBy("u").agg(F.min("vcomp").alias("near"))
        after = moved.join(near, moved.id == near.u).select("id", F.least("low", "near").alias("comp"), (F.least("low", "near") < F.col("low")).alias("changed"))
        after = written(after, "comps")
        dropped(moved, state)
        state = after
    dropped(both)
    return state.select("id", "comp")


def compared(texts: DataFrame, classes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """pairs(a, b) of classes -> (a, b, na, nb, edits) from the full sets; only texts of classes in pairs are shuffled.

    A class's text is one of its least id whose set has the class's keys; an id with several texts may stand for several.
    """
    needed = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    needed = written(needed.join(classes, "class").select("class", F.col("rep").alias("id"), "key1", "key2"), "needed")
    blocks = bloom_blocks(needed.count())
    few = possible_hits(texts, "id", blocked_bloom(needed, "id", blocks), blocks)
    few = few.mapInArrow(_key_task(k), "id long, text string, key1 long, key2 long").join(needed, ["id", "key1", "key2"])
    few = written(few.groupBy("id", "key1", "key2", "class").agg(F.min("text").alias("text")).select("class", "text"), "texts")
    full = pairs.join(few.select(F.col("class").alias("a"), F.col("text").alias("ta")), "a").join(few.select(F.col("class").alias("b"), F.col("text").alias("tb")), "b")
    out = written(full.select("a", "b", "ta", "tb").mapInArrow(_compare_task(k), "a long, b long, na long, nb long, edits array<long>"), "compared")
    dropped(needed, few)
    return out


def straggler_candidates(told: DataFrame, comps: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(members of pivots' groups with their edits, pairs (a, x, y) of members of group a that may be linked).

    told(a, b, na, nb, edits): a is the pivot. comps(class, comp): components by what is known so far. At least one of
    x and y isn't linked to the pivot, and they are of different components. Both tables are the caller's to drop.
    """
    told = told.withColumn("linked", _is_link("na + nb", "size(edits)", percent))
    placed = written(told.select("a", "b", "linked").join(comps.withColumnRenamed("class", "b"), "b"), "placed")
    mixed = placed.groupBy("a").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count_if(~F.col("linked")).alias("s")).where("low < high AND s > 0")
    mixed = written(mixed.select("a"), "mixed")
    members = told.join(mixed, "a").join(placed.select("a", "b", "comp"), ["a", "b"]).select("a", "b", "na", "nb", F.size("edits").alias("e"), "edits", "linked", "comp")
    members = written(members, "groups")
    single = members.select("a", "b", "comp", F.explode("edits").alias("edit"))
    often = single.groupBy("a", "edit").agg(F.count("*").alias("often"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    often = written(often.where("low < high").select("a", "edit", "often"), "often")
    # an edit of one component can't be shared with another, and rare ones come first
    ranked = single.join(often, ["a", "edit"]).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("often", "edit"))).alias("ranked"))
    ranked = ranked.join(members.drop("edits"), ["a", "b"])
    # the fewest edits that a link's two sides share, seen from either side; d: the most that may differ, as a part of |x| + |y|
    d = (100 - percent) / (100 + percent)
    as_any = F.expr(f"greatest(1, ceil((e - {d} * (nb - na)) / 2 - 1e-6))")
    as_straggler = F.expr(f"greatest(1, ceil((e - {d} * (nb + na)) / (1 + {d}) - 1e-6))")
    prefix = lambda least: F.transform(F.slice("ranked", F.lit(1), F.greatest(F.lit(0), F.size("ranked") - least + 1).cast("int")), lambda x: x["edit"])
    either = ranked.select("a", "b", "comp", "e", "nb", "linked", F.size("ranked").alias("r"), prefix(as_any).alias("any"), prefix(as_straggler).alias("own"))
    either = written(either, "prefixes")
    side = lambda which, who: either.select("a", "b", "comp", "e", "nb", "linked", "r", F.posexplode(which).alias("pos", "edit")).select(
        "a", F.col("b").alias(who), F.col("comp").alias(f"c{who}"), F.col("e").alias(f"e{who}"), F.col("nb").alias(f"n{who}"), (F.col("r") - F.col("pos")).alias(f"r{who}"), "linked", "edit")
    x, y = side("own", "x").where("NOT linked").drop("linked"), side("any", "y").drop("linked")
    # at the first edit that two sides share, what is left of either side bounds what they can share
    fit = F.expr(f"cx <> cy AND 100 * least(nx, ny) >= {percent} * greatest(nx, ny) AND least(rx, ry) >= (ex + ey - {d} * (nx + ny)) / 2 - 1e-6")
    pairs = x.withColumnsRenamed({"a": "ax", "edit": "editx"}).join(y, (F.col("ax") == F.col("a")) & (F.col("editx") == F.col("edit")) & fit)
    pairs = written(pairs.select("a", "x", "y").distinct(), "candidates")
    dropped(placed, mixed, often, either)
    return members, pairs


def straggler_links(told: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Links(x, y) between classes of different components that a pivot's group has in common; see straggler_candidates."""
    members, pairs = straggler_candidates(told, comps, percent)
    one, two = (members.select("a", F.col("b").alias(c), F.col("nb").alias(f"n{c}"), F.col("edits").alias(f"e{c}")) for c in "xy")
    found = pairs.join(one, ["a", "x"]).join(two, ["a", "y"])
    found = found.withColumn("differ", F.size("ex") + F.size("ey") - 2 * F.size(F.array_intersect("ex", "ey")))
    found = written(found.where(_is_link("nx + ny", "differ", percent)).select("x", "y").distinct(), "stragglers")
    dropped(members, pairs)
    return found


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents -> (doc_id, n_shingles, component_id, kept), a row for each row.

    Words are runs of non-space characters, A-Z lower-cased; a set has the distinct k-word shingles of
    the whole text, or the whole sequence if there are fewer words. Documents are linked at
    100 * intersection >= percent * union; component_id is the smallest id reachable. Null and empty
    texts are linked with nothing. Rows with the same id are one node, with the links of all its texts. A row with a null id has no links, a null component_id,
    and is kept. Repeated rows are given back as often. An empty table gives an empty one. Other columns,
    whatever their names, are ignored. Texts of any length are read whole, one at a time; a set of more than
    CHUNK shingles is signed in parts. Bands are set for percent >= 80.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = written(texts.mapInArrow(_signature_task(k), "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>"), "signatures")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    keys = ["key1", "key2", "n_shingles"]
    classes = full.groupBy(*keys).agg(F.min("doc_id").alias("rep")).withColumn("class", F.monotonically_increasing_id())
    classes = written(classes, "classes")  # with their numbers
    same = written(full.select("doc_id", *keys).join(classes, keys).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct(), "copies")
    # two different sets have at most n / (n + 1) in common, n the smaller one's size
    able = classes.where(f"100 * n_shingles >= {percent} * (n_shingles + 1)")
    reps = full.join(able.withColumnRenamed("rep", "doc_id"), [*keys, "doc_id"]).dropDuplicates(["class"])
    reps = written(reps.select("class", "n_shingles", "bands"), "representatives")

    rows = reps.select(F.explode("bands").alias("band"), F.col("class").alias("id"))
    # tables, not aggregates, on the small side: Spark splits the partitions of hot keys only then
    shared = written(rows.groupBy("band").agg(F.count("*").alias("company")).where("company > 1"), "shared")
    counted = written(rows.join(shared, "band"), "buckets")
    company = written(counted.groupBy("id").agg(F.sum("company").alias("weight")), "company")
    rows = written(counted.drop("company").join(company, "id"), "buckets")
    dropped(shared, counted, company)
    pivots = rows.groupBy("band").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("pivot"))
    pivots = written(pivots, "pivots")
    pairs = written(rows.join(pivots, "band").where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    dropped(rows, pivots, reps)
    told = compared(texts, classes, pairs, k)
    # classes as the ids that stand for them; links between ids that have copies of one another are known already
    stand = lambda c: classes.select(F.col("class").alias(c), F.col("rep").alias(f"rep_{c}"))
    as_ids = lambda links, a, b: links.join(stand(a), a).join(stand(b), b).select(F.col(f"rep_{a}").alias("a"), F.col(f"rep_{b}").alias("b"))
    links = told.where(_is_link("na + nb", "size(edits)", percent)).select("a", "b")
    links = written(same.unionByName(as_ids(links, "a", "b")).where("a <> b"), "links")
    comps = components(links)
    of_class = classes.join(comps, F.col("rep") == F.col("id"), "left").select("class", F.coalesce("comp", "rep").alias("comp"))
    of_class = written(of_class, "placed")
    found = straggler_links(told, of_class, percent)
    place = lambda c: of_class.select(F.col("class").alias(c), F.col("comp").alias(f"comp_{c}"))
    more = written(found.join(place("x"), "x").join(place("y"), "y").select(F.col("comp_x").alias("a"), F.col("comp_y").alias("b")).distinct(), "more")
    joined = components(more)
    out = signed.select("doc_id", "n_shingles").join(comps.withColumnRenamed("id", "node"), F.col("doc_id") == F.col("node"), "left")
    out = out.withColumn("first", F.coalesce("comp", "doc_id")).drop("comp").join(joined.withColumnsRenamed({"id": "from", "comp": "to"}), F.col("first") == F.col("from"), "left")
    dropped(classes, same, pairs, told, links, of_class, found, more)
    comp = F.coalesce("to", "first")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))
