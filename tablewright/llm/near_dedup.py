"""Near duplicates by MinHash with sequential Bayesian verification.

1. Documents with the same set of shingles form a class; only one row for each
   class goes on, so thousands of copies cost one row. Classes are numbered by
   content, not by id.
2. Each class has a MinHash signature, cut into bands. Classes that share a
   band's values share a bucket.
3. In each bucket every member is compared with a few pivots, not with every
   other member. A pair's signatures are compared batch by batch, and the pair
   is given up once the posterior probability of reaching the similarity is
   below ``MISS``. Survivors are verified on their full sets.
4. Verified links give components. In buckets that hold several, members that
   share too few shingles with other components are ruled out, the others are
   compared with the hubs of the bucket, its members with most links so far,
   and in the end, tile by tile, with every member of another component that sizes
   and shared shingles allow. No bucket mate is left uncompared unless both are connected
   already or proven too different.

A pair at the similarity bound shares no band with probability
(1 - 0.75 ** ROWS) ** BANDS, which is about 5e-6.

Defined cases: NULL texts and texts without words have no shingles and are
linked with nothing; fewer words than a shingle make one shingle of the whole
sequence; texts are taken whole; each row stands for its own text, so an id with
two texts may be in two components, and a row without an id is linked like any
other; a component of such rows only has no component_id, and keeps those whose
text has the smallest digest; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.durable import written
from tablewright.llm.shared import components, map_batches, released, unused
from tablewright.llm.words import mix, split_words, window_hashes, word_hashes

SHINGLE_WORDS = 5
#: Links have 100 * intersection >= SIMILAR * union.
SIMILAR = 75
BANDS = 32
ROWS = 4
#: Signature values compared before the posterior is looked at again.
BATCH = 16
#: Probability of giving up a pair that is similar enough.
MISS = 1e-7
#: Members in a block of the last comparison.
TILE = 64
#: Rounds of comparing with the best linked members before the rest is compared in tiles.
HUB_ROUNDS = 1
#: Keys over which the members of one component are dealt.
SALTS = 8
_SEED = np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the word shingles, A-Z lower-cased."""
    words = [] if text is None else split_words(text)
    if not words:
        return np.empty(0, "u8")
    hashes = word_hashes([w.lower() for w in words])
    if len(hashes) < SHINGLE_WORDS:
        return window_hashes(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return np.unique(window_hashes(hashes, SHINGLE_WORDS))


def similar(left: np.ndarray, right: np.ndarray) -> bool:
    """Whether two sets of distinct shingles are linked."""
    shared = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * shared >= SIMILAR * (len(left) + len(right) - shared)


@lru_cache
def _multipliers() -> np.ndarray:
    return mix(np.arange(1, BANDS * ROWS + 1, dtype="u8") * _SEED) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS MinHash values of 32 bits."""
    factors = _multipliers()[:, None]
    best = np.full(BANDS * ROWS, 0xFFFFFFFF, "u4")
    for at in range(0, len(shingles), 2048):
        spread = (factors * shingles[None, at : at + 2048]) >> np.uint64(32)
        best = np.minimum(best, spread.min(axis=1).astype("u4"))
    return best


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band of each signature; ``values`` has a row for each signature."""
    parts = values.reshape(len(values), BANDS, ROWS).astype("u8")
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype="u8") * _SEED, parts.shape[:2])
    for row in range(ROWS):
        keys = mix(keys ^ parts[:, :, row])
    return keys.view("i8")


@lru_cache
def least_matches() -> tuple[int, ...]:
    """After each batch, the fewest equal values with which a pair goes on.

    With a uniform prior, n values of which m are equal leave the posterior
    P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    found = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        total, m, t = 0.0, -1, SIMILAR / 100
        while total < MISS:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        found.append(m)
    return tuple(found)


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, n_shingles, content, signature) of each row; content identifies the set."""

    def make():
        def work(batch: pa.RecordBatch):
            sizes, contents, signatures = [], [], []
            for text in batch.column(2).to_pylist():
                shingles = shingle_set(text)
                sizes.append(len(shingles))
                contents.append(_digest(shingles) if len(shingles) else None)
                signatures.append(signature(shingles).tobytes() if len(shingles) else None)
            return {
                "doc_id": batch.column(0),
                "text_key": batch.column(1),
                "n_shingles": sizes,
                "content": contents,
                "signature": signatures,
            }

        return work

    return map_batches(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_key(text_col).alias("text_key"), text_col),
        make,
        "doc_id long, text_key binary, n_shingles long, content binary, signature binary",
    )


def _text_key(text_col: str) -> Column:
    """What rows with one id are told apart by; NULL for NULL texts."""
    return F.unhex(F.md5(F.col(text_col).cast("binary")))


def _digest(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, member) of each class and band."""

    def make():
        def work(batch: pa.RecordBatch):
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), "u4").reshape(batch.num_rows, -1)
            return {
                "bucket": band_keys(values).ravel(),
                "member": np.repeat(batch.column(0).to_numpy(), BANDS),
            }

        return work

    return map_batches(classes.select("class_id", "signature"), make, "bucket long, member long")


def _promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures leave a chance of being similar enough."""
    both = pairs.join(classes.select(F.col("class_id").alias("a"), F.col("signature").alias("sa")), "a").join(
        classes.select(F.col("class_id").alias("b"), F.col("signature").alias("sb")), "b"
    )

    def make():
        bounds = least_matches()

        def work(batch: pa.RecordBatch):
            left, right = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), "u4").reshape(batch.num_rows, -1)
                for i in (2, 3)
            )
            alive = np.arange(batch.num_rows)
            equal = np.zeros(batch.num_rows, int)
            for step, least in enumerate(bounds):
                part = slice(step * BATCH, (step + 1) * BATCH)
                equal = equal + (left[alive, part] == right[alive, part]).sum(axis=1)
                alive, equal = alive[equal >= least], equal[equal >= least]
                if not len(alive):
                    return None
            return {"a": batch.column(0).take(pa.array(alive)), "b": batch.column(1).take(pa.array(alive))}

        return work

    return map_batches(both.select("a", "b", "sa", "sb"), make, "a long, b long")


def _sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(class_id, shingles) of the wanted classes, from the texts of their smallest ids."""
    ids = wanted.select(F.col("best.doc_id").alias("best_id")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def make():
        def work(batch: pa.RecordBatch):
            sets = [shingle_set(x) for x in batch.column(0).to_pylist()]
            return {"content": [_digest(x) for x in sets], "shingles": [x.view("i8") for x in sets]}

        return work

    found = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("best_id")), "left_semi").select("text")
    sets = map_batches(found, make, "content binary, shingles array<long>")
    return sets.join(wanted.select("content", "class_id"), "content").dropDuplicates(["content"]).drop("content")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links on their full sets."""
    both = pairs.join(sets.select(F.col("class_id").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("class_id").alias("b"), F.col("shingles").alias("sb")), "b"
    )

    def make():
        def work(batch: pa.RecordBatch):
            kept = []
            for i in range(batch.num_rows):
                if similar(*(batch.column(j)[i].values.to_numpy() for j in (2, 3))):
                    kept.append(i)
            at = pa.array(kept, "i8")
            return {"a": batch.column(0).take(at), "b": batch.column(1).take(at)}

        return work

    return map_batches(both.select("a", "b", "sa", "sb"), make, "a long, b long")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


class _Links:
    """Verified links among classes, gathered round by round."""

    def __init__(self, classes: DataFrame, sets: DataFrame):
        self.classes, self.sets = classes, sets
        self.found: list[DataFrame] = []

    def add(self, pairs: DataFrame) -> bool:
        """Verify ``pairs``; whether there were links among them."""
        promising = written(_promising(pairs.distinct(), self.classes))
        return self.keep(_verified(promising, self.sets))

    def keep(self, links: DataFrame) -> bool:
        new = written(links)
        self.found.append(new)
        return not new.isEmpty()

    def all(self) -> DataFrame:
        links = self.found[0]
        for more in self.found[1:]:
            links = links.unionByName(more)
        return links

    def degrees(self) -> DataFrame:
        """(member, degree): the number of links so far."""
        ends = self.all().select(F.explode(F.array("a", "b")).alias("member"))
        return ends.groupBy("member").agg(F.count(F.lit(1)).alias("degree"))

    def components(self) -> DataFrame:
        return components(self.all())


def _in_split_buckets(placed: DataFrame) -> DataFrame:
    """Rows (bucket, member, component) of buckets with several components, and ``main``, the largest of them."""
    parts = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    split = (
        parts.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "component"))["component"].alias("main"))
        .where("parts > 1")
        .select("bucket", "main")
    )
    return written(placed.select("bucket", "member", "component").join(split, "bucket"))


def _hopeful(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``members`` with n and s, without those that cannot be linked to another component in their bucket.

    Only shingles that another component holds too can be shared with it. With
    s such shingles of n, the similarity to a set of m is s / (n + m - s) at
    most; m is no smaller than the bucket's smallest set, nor than the bound on
    similarity allows. Many changes that no other copy has thus rule a copy out
    without comparing it with any.
    """
    classes = members.select("member", "component").distinct()
    held = sets.join(classes, sets["class_id"] == classes["member"]).select(
        "member", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")
    )
    foreign = (
        held.groupBy("shingle")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo <> hi")
        .select("shingle")
    )
    bounds = written(
        held.join(foreign, "shingle")
        .groupBy("member")
        .agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("s"))
        .where(_can_reach(F.ceil(F.col("n") * SIMILAR / 100)))
    )
    bounded = written(members.drop("main").join(bounds, "member"))
    smallest = bounded.groupBy("bucket").agg(F.min("n").alias("least"))
    m = F.greatest("least", F.ceil(F.col("n") * SIMILAR / 100))
    return written(bounded.join(smallest, "bucket").where(_can_reach(m)).drop("least"))


def _can_reach(m: Column) -> Column:
    """Whether s shared shingles of n can make a link with a set of ``m`` or more."""
    return 100 * F.col("s") >= SIMILAR * (F.col("n") + m - F.col("s"))


def _hubs(members: DataFrame, degrees: DataFrame, used: DataFrame) -> DataFrame:
    """(bucket, hub, hub_component): in each bucket, the member with most links so far that was no pivot yet.

    In a group of copies of one text, which are often closer to it than to
    each other, that text collects links in every bucket and becomes the hub.
    """
    order = F.struct(F.coalesce("degree", F.lit(0)).alias("d"), F.xxhash64("member").alias("h"), "member", "component")
    best = (
        members.join(degrees, "member", "left")
        .join(used, ["bucket", "member"], "left_anti")
        .groupBy("bucket")
        .agg(F.max(order).alias("best"))
    )
    return best.select("bucket", F.col("best.member").alias("hub"), F.col("best.component").alias("hub_component"))


def _rest(members: DataFrame, bounds: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among bucket mates of different components, as far as sizes and shared shingles allow them.

    Members outside the bucket's main component meet all others in tiles of
    ``TILE`` by ``TILE``, so sets and signatures are sent once for a block of
    partners and not once for each of them. In a tile, signatures are compared
    batch by batch and survivors on their full sets.
    """
    sent = bounds.withColumnRenamed("member", "class_id").join(classes, "class_id").join(sets, "class_id")
    known = written(members.join(sent.withColumnRenamed("class_id", "member"), "member"))
    sizes = written(
        known.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("all"), F.count_if(F.col("component") != F.col("main")).alias("strays")
        )
    )
    row = F.struct("member", "component", "n", "s", "signature", "shingles")

    def blocks(rows: DataFrame, count: str, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("member"), F.ceil(F.col(count) / TILE))
        return (
            rows.join(sizes, "bucket").groupBy("bucket", block.alias(f"{name}_block"))
            .agg(F.first("main").alias(f"{name}_main"), F.collect_list(row).alias(name))
        )

    tiles = blocks(known.where("component <> main"), "strays", "x").join(blocks(known, "all", "y"), "bucket")

    def make():
        least = least_matches()

        def unpacked(cell):
            rows = cell.values
            fields = [rows.field(c).to_numpy(zero_copy_only=False) for c in ("member", "component", "n", "s")]
            signed = np.frombuffer(b"".join(rows.field("signature").to_pylist()), "u4").reshape(len(rows), -1)
            return *fields, signed, rows.field("shingles")

        def work(batch: pa.RecordBatch):
            found: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                xm, xc, xn, xs, x_signed, x_sets = unpacked(batch.column(1)[i])
                ym, yc, yn, ys, y_signed, y_sets = unpacked(batch.column(2)[i])
                shared = np.minimum(xs[:, None], ys[None, :])
                alive = (xc[:, None] != yc[None, :]) & (
                    (yc == batch.column(0)[i].as_py())[None, :] | (xm[:, None] < ym[None, :])
                )
                alive &= 100 * shared >= SIMILAR * (xn[:, None] + yn[None, :] - shared)
                at_x, at_y = np.nonzero(alive)
                equal = np.zeros(len(at_x), int)
                for step, most in enumerate(least):
                    part = slice(step * BATCH, (step + 1) * BATCH)
                    equal = equal + (x_signed[at_x, part] == y_signed[at_y, part]).sum(axis=1)
                    kept = equal >= most
                    at_x, at_y, equal = at_x[kept], at_y[kept], equal[kept]
                for j, k in zip(at_x.tolist(), at_y.tolist()):
                    if similar(x_sets[j].values.to_numpy(), y_sets[k].values.to_numpy()):
                        found.append((min(xm[j], ym[k]), max(xm[j], ym[k])))
            return {"a": [x[0] for x in found], "b": [x[1] for x in found]} if found else None

        return work

    return map_batches(tiles.select("x_main", "x", "y"), make, "a long, b long").distinct()


def _named(classes: DataFrame, found: DataFrame) -> DataFrame:
    """(content, chosen): the row that stays of each class's component, by id and text digest."""
    linked = written(
        found.join(classes.select(F.col("class_id").alias("member"), "best"), "member").select("member", "component", "best")
    )
    # A component may hold a third of all classes: its rows are dealt over SALTS keys.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    names = linked.groupBy("component").agg(F.min("best").alias("chosen")).select("component", "chosen", salts)
    salt = F.pmod(F.xxhash64("member"), F.lit(SALTS)).cast("int")
    chosen = linked.select("member", "component", salt.alias("salt")).join(names, ["component", "salt"])
    return classes.join(chosen, F.col("class_id") == F.col("member"), "left").select(
        "content", F.coalesce("chosen", "best").alias("chosen")
    )


def _assigned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row's doc_id, text_key, n_shingles and chosen: NULL without shingles, else the row that stays."""
    signed = written(_signed(docs, id_col, text_col))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    classes = written(
        signed.where("content is not null")
        .groupBy("content")
        .agg(F.min(row).alias("best"), F.first("signature").alias("signature"))
        .withColumn("class_id", F.monotonically_increasing_id())
    )
    buckets = written(_buckets(classes))
    # Buckets of one member are most of all; what follows reads the others only.
    crowded = buckets.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("member").alias("first"), F.max("member").alias("last")
    ).where("n > 1")
    members = written(buckets.join(crowded, "bucket").select("bucket", "member", "first", "last"))
    released(docs.sparkSession)
    compared = members.select(F.col("member").alias("class_id")).distinct()
    compared = written(classes.join(compared, "class_id", "left_semi"))
    sets = written(_sets(docs, id_col, text_col, compared))
    links = _Links(compared.select("class_id", "signature"), sets)
    pivots = members.select("bucket", "member", F.explode(F.array("first", "last")).alias("pivot"))
    links.add(pivots.where("member <> pivot").select(*_ordered(F.col("member"), F.col("pivot"))))
    used = pivots.select("bucket", F.col("pivot").alias("member")).distinct()
    found = links.components()
    members = members.select("bucket", "member")
    new = True
    for turn in range(HUB_ROUNDS + 1):
        if new:  # else the components are as they were
            placed = written(
                members.join(found, "member", "left").select(
                    "bucket", "member", F.coalesce("component", "member").alias("component")
                )
            )
            hopeful = _hopeful(_in_split_buckets(placed), sets)
            left = _in_split_buckets(hopeful)
            if left.isEmpty():
                break
            members = left.select("bucket", "member")
        if turn < HUB_ROUNDS:
            hubs = written(_hubs(left, links.degrees(), used))
            pairs = left.join(hubs, "bucket").where("component <> hub_component")
            new = links.add(pairs.select(*_ordered(F.col("member"), F.col("hub"))))
            used = used.unionByName(hubs.select("bucket", F.col("hub").alias("member")))
        else:
            bounds = hopeful.select("member", "n", "s").distinct()
            new = links.keep(_rest(left, bounds, links.classes, sets))
        if new:
            found = links.components()
        released(docs.sparkSession)
    columns = ["doc_id", "text_key", "n_shingles", "chosen"]
    named = _named(classes.drop("signature"), found)
    # Rows without shingles, which may be many, would share one key of the join.
    without = signed.where("content is null").withColumn("chosen", F.lit(None).cast(named.schema["chosen"].dataType))
    return signed.where("content is not null").join(named, "content").select(columns).union(without.select(columns))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest reachable id) and kept."""
    chosen, own = F.col("chosen"), F.col("doc_id")
    component = F.when(chosen.isNull(), own).otherwise(chosen["doc_id"])
    same_text = own.isNotNull() | chosen.isNull() | F.col("text_key").eqNullSafe(chosen["text_key"])
    return _assigned(docs, id_col, text_col).select(
        "doc_id", "n_shingles", component.alias("component_id"), (own.eqNullSafe(component) & same_text).alias("kept")
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, and those without shingles.

    Of several texts with that id the one with the smallest digest stays; rows that
    repeat both id and text stay together.
    """
    chosen, own, key = F.col("chosen"), F.col("doc_id"), F.col("text_key")
    stays = chosen.isNull() | own.eqNullSafe(chosen["doc_id"]) & key.eqNullSafe(chosen["text_key"])
    kept_id, kept_key = unused(docs, "kept_id"), unused(docs, "kept_key")
    kept = _assigned(docs, id_col, text_col).where(stays).select(own.alias(kept_id), key.alias(kept_key))
    same = F.col(id_col).eqNullSafe(F.col(kept_id)) & _text_key(text_col).eqNullSafe(F.col(kept_key))
    return docs.join(kept, same, "left_semi")
