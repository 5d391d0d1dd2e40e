"""Near-duplicate detection with bottom-k sketches from one hash function.

1. Every text becomes the set of its distinct five-word shingles (64-bit hashes) and keeps the k smallest.
2. Texts with equal sets collapse into one representative, so copies cost nothing below.
3. Inverted lists of the retained values: two sets with similarity t share at least `overlap` of k retained values
   (all but about one in a million borderline pairs), so it is enough to look at each sketch's k - overlap + 1
   rarest values. Values of common passages are the last in that order and seldom used.
4. A list isn't expanded into pairs. Its most common sketch is the centre that all others meet; when links have
   merged what belongs together, only members outside the list's main component meet the others. Members of long
   lists do so by the rarest shingles of their full sets, where the bound on misses is exact and tight.
   Set sizes and the parity of 256 hash classes of the sets rule out most pairs inside the join, without loss.
5. Pairs pass if the union sketch estimates enough similarity; the exact Jaccard of the full sets decides.
6. Components over the links, by smallest label.

Nodes are texts, not documents: every distinct set has an id of its own, taken from its digests.

Defined results: texts without words have an empty set and no links; rows without doc_id are returned with component
null and kept; rows that repeat a doc_id are one document and share a component, whatever their texts, unless `by_text` asks for
components of texts, where each row has the component of its own text; copies share one; an empty table gives an
empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrisk.llm import columns as C
from webrisk.llm.components import components
from webrisk.llm.wordhash import Words, chained, mix, words_of

WIDTH = 5
K = 48
#: Standard deviations allowed below the mean, for values that two sketches share and for the similarity they estimate.
SLACK_SHARED, SLACK_ESTIMATE = 5.4, 5.0
#: Lists of more members are not expanded; their members meet by full-set prefixes instead.
LONG_LIST = 40
BITS = ("s0", "s1", "s2", "s3")
_D2 = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(w: Words) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its shingles."""
    grams = chained(w.hash, WIDTH).view(np.int64)
    for i in range(len(w.first) - 1):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= WIDTH:
            yield np.unique(grams[a:b - WIDTH + 1])
        elif b > a:
            yield chained(w.hash[a:b], b - a).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def parity_bits(values: np.ndarray) -> np.ndarray:
    """256 bits, each the parity of the values that hash to it: two sets differ in at least as many elements as bits."""
    odd = np.bincount(values.view(np.uint64).view(np.int64) & 255, minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """Two sums over each set, of its values and of their scrambling."""
    sums = [(s.view(np.uint64).sum(dtype=np.uint64), mix(s.view(np.uint64) ^ _D2).sum(dtype=np.uint64)) for s in sets]
    return np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)


def _sketch(batches):
    for batch in batches:
        sets = list(shingle_sets(words_of(batch.column(1), lower=True)))
        sums = _digests(sets)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0].copy()),
             pa.array(sums[:, 1].copy()), _lists([s[:K] for s in sets]), *(pa.array(b.copy()) for b in np.array([parity_bits(s) for s in sets], np.int64).reshape(-1, 4).T)],
            ["doc_id", "row", "n", "d1", "d2", "sketch", *BITS])


def _full_sets(batches):
    for batch in batches:
        sets = list(shingle_sets(words_of(batch.column(1), lower=True)))
        sums = _digests(sets)
        yield pa.RecordBatch.from_arrays(
            [pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy()), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], ["d1", "d2", "n", "full"])


def _set_id():
    return F.xxhash64("d1", "d2", "n")


def _whole(ids: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, full) of the sets `ids`, read from one text of each."""
    wanted = ids.join(reps.select(F.col("rep").alias("id"), "first"), "id")
    rows = texts.join(wanted.select(F.col("first").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    full = rows.mapInArrow(_full_sets, "d1 long, d2 long, n long, full array<long>").select(_set_id().alias("id"), "full")
    return full.dropDuplicates(["id"])


def overlap(percent: int) -> int:
    """Fewest shared values of two sketches of K values at the similarity."""
    p = percent / 100
    return math.floor(K * p - SLACK_SHARED * math.sqrt(K * p * (1 - p)))


def least_estimate(percent: int) -> float:
    p = percent / 100
    return p - SLACK_ESTIMATE * math.sqrt(p * (1 - p) / K)


def _close(n, m, other: str, percent: int):
    """Sizes and parity bits (columns BITS against the other side's) allow the similarity."""
    differ = sum(F.bit_count(F.col(b).bitwiseXOR(F.col(other + b))) for b in BITS)
    most = n + m - 2 * F.ceil((n + m) * percent / (100 + percent))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (differ <= most)


def _links(pairs: DataFrame, reps: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have at least the similarity."""
    pairs = C.stored(pairs.distinct(), "pairs")
    left = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    met = pairs.join(left, "a").join(right, "b")
    # k smallest of the union, and how many of them both sketches hold
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    both = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    exact = (F.col("na") <= K) & (F.col("nb") <= K)
    shared = F.size(F.array_intersect("sa", "sb"))
    met = met.select("a", "b", exact.alias("exact"), F.when(
        exact, shared * 100 >= (F.col("na") + F.col("nb") - shared) * percent).otherwise(
        both >= F.size(union) * least_estimate(percent)).alias("passes")).where("passes")
    met = C.stored(met.select("a", "b", "exact"), "estimated")
    open_ = met.where(~F.col("exact"))
    ids = open_.select(F.col("a").alias("id")).union(open_.select(F.col("b"))).distinct()
    full = C.stored(_whole(ids, reps, texts), "sets")
    judged = (open_.join(full.select(F.col("id").alias("a"), F.col("full").alias("fa")), "a")
              .join(full.select(F.col("id").alias("b"), F.col("full").alias("fb")), "b"))
    common = F.size(F.array_intersect("fa", "fb"))
    judged = judged.where(common * 100 >= (F.size("fa") + F.size("fb") - common) * percent)
    return C.stored(met.where("exact").select("a", "b").unionByName(judged.select("a", "b")), "links")


def _ordered(values: DataFrame, carried: tuple[str, ...] = BITS) -> DataFrame:
    """Per representative the values that others hold too, rarest first: (rep, n, held)."""
    common = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    return values.join(common, "v").groupBy("rep", "n", *carried).agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("held"))


def _pairs(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _across(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of list members with different labels, of which one at least is outside the list's main label."""
    per_label = lists.groupBy("v", "label").agg(F.count("*").alias("members"))
    main = per_label.groupBy("v").agg(F.max(F.struct("members", "label")).alias("m"), F.count("*").alias("labels")).where("labels > 1")
    lists = C.stored(lists.join(main.select("v", F.col("m.label").alias("main")), "v"), "open")
    outside = lists.where(F.col("label") != F.col("main")).select("v", F.col("rep").alias("u"), F.col("n").alias("nu"), F.col("label").alias("lu"), F.col("at").alias("au"),
        *(F.col(b).alias("u" + b) for b in BITS))
    # least intersection of two sizes at the similarity, and the positions up to which the pair must meet
    least = F.ceil((F.col("n") + F.col("nu")) * percent / (100 + percent))
    return lists.join(outside, "v").where(
        (F.col("label") != F.col("lu")) & _close(F.col("n"), F.col("nu"), "u", percent)
        & ((F.col("label") == F.col("main")) | (F.col("rep") < F.col("u")))
        & (F.col("at").isNull() | ((F.col("at") <= F.col("n") - least) & (F.col("au") <= F.col("nu") - least)))
    ).select(*_pairs(F.col("rep"), F.col("u"))).distinct()


def _same_document(own: DataFrame) -> DataFrame:
    """Links (a, b) from one to the other sets of a doc_id that has several."""
    several = own.groupBy("doc_id").agg(F.min(F.struct("d1", "d2", "n")).alias("s"), F.max(F.struct("d1", "d2", "n")).alias("t")).where(F.col("s") != F.col("t"))
    one = F.xxhash64("s.d1", "s.d2", "s.n")
    pairs = own.select("doc_id", _set_id().alias("b")).join(several.select("doc_id", one.alias("a")), "doc_id")
    return pairs.where(F.col("a") != F.col("b")).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, by_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id).

    With `by_text`, two texts of one doc_id aren't linked by it, and `row` (columns.row_key) tells the rows apart.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", C.row_key(C.whole_text()).alias("row"))
    sketched = C.stored(texts.mapInArrow(_sketch,
        "doc_id long, row long, n long, d1 long, d2 long, sketch array<long>, s0 long, s1 long, s2 long, s3 long"), "sketches")
    own = sketched.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    reps = C.stored(own.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("first"), F.any_value("sketch").alias("sketch"), *(F.max(b).alias(b) for b in BITS)).withColumn(
        "rep", _set_id()), "reps")

    n, size = F.col("n"), F.least(F.col("n"), F.lit(K))
    loss = 100 - percent
    sure = K - F.floor(n * loss / percent)  # of the union's K smallest, at most this share is not in both
    needed = F.when(n <= K, F.least(F.ceil(n * percent / 100), sure)).otherwise(F.greatest(F.lit(overlap(percent)), sure))
    shared = _ordered(reps.select("rep", "n", *BITS, F.explode("sketch").alias("v")))
    take = (size - needed + 1) - (size - F.size("held"))
    weight = F.aggregate("held", F.lit(0).cast("long"), lambda s, x: s + x["df"])
    lists = C.stored(shared.withColumn("weight", weight).where(take > 0).select(
        "rep", "n", *BITS, "weight", F.explode(F.slice("held", F.lit(1), take.cast("int"))).alias("h")).select(
        "rep", "n", *BITS, "weight", F.col("h.v").alias("v")), "lists")

    centre = lists.groupBy("v").agg(F.max(F.struct("weight", "rep", "n", *BITS)).alias("c"), F.count("*").alias("members"))
    centre = centre.select("v", F.col("c.rep").alias("c"), F.col("c.n").alias("nc"), "members", *(F.col(f"c.{b}").alias("c" + b) for b in BITS))
    first = lists.join(centre, "v").where((F.col("rep") != F.col("c")) & _close(n, F.col("nc"), "c", percent)).select(*_pairs(F.col("rep"), F.col("c")))
    links = _links(first, reps, texts, percent)
    groups = components(links)

    label = F.coalesce("label", "rep").alias("label")
    named = groups.select(F.col("node").alias("rep"), "label")
    placed = C.stored(lists.join(centre.select("v", "members"), "v").join(named, "rep", "left").select(
        "v", "rep", "n", *BITS, label, "members", F.lit(None).cast("long").alias("at")), "placed")
    few = _across(placed.where(F.col("members") <= LONG_LIST), percent)
    # members of long lists meet by the rarest shingles of their full sets, where the bound on misses is exact
    crowd = placed.where(F.col("members") > LONG_LIST).select(F.col("rep").alias("id")).distinct()
    full = _whole(crowd, reps, texts).join(crowd, "id", "left_semi")
    values = C.stored(full.select(F.col("id").alias("rep"), F.size("full").cast("long").alias("n"), F.explode("full").alias("v")), "crowd")
    bits = reps.select("rep", *BITS)
    ranked = _ordered(values, ()).join(bits, "rep")
    absent = n - F.size("held")
    cut = n - F.ceil(n * percent / 100) + 1 - absent
    dense = ranked.where(cut > 0).select("rep", "n", *BITS, absent.alias("absent"), F.posexplode(F.slice("held", F.lit(1), cut.cast("int"))).alias("i", "h")).select(
        "rep", "n", *BITS, F.col("h.v").alias("v"), (F.col("i") + F.col("absent")).cast("long").alias("at"))
    many = _across(dense.join(named, "rep", "left").select("v", "rep", "n", *BITS, label, "at"), percent)
    more = _links(few.unionByName(many), reps, texts, percent)
    links = links.unionByName(more)
    if not by_text:
        links = links.unionByName(_same_document(own))
    groups = components(links)

    labelled = reps.join(groups.select(F.col("node").alias("rep"), "label"), "rep", "left").select(
        "d1", "d2", "n", "first", F.coalesce("label", "rep").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    member = labelled.join(smallest, "label").select("d1", "d2", "n", "component_id")
    out = sketched.select("doc_id", "row", "n", "d1", "d2").join(member, ["d1", "d2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(component)
    return out.select("doc_id", n.alias("n_shingles"), component.cast("long").alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *(["row"] if by_text else []))
