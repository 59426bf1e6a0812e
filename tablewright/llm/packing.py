"""Packing documents into few sequences of a fixed number of tokens.

Method: linear grouping. Only the histogram of piece lengths, one count for
each length up to the sequence size, reaches the driver. Long lengths are put
into groups of equally many pieces and rounded up to the largest of their
group; the few-size problem is solved by column generation over whole-sequence
configurations; actual lengths then take the rounded places, and short pieces
fill what is left, each into the fullest sequence that still holds it. Pieces of
one length are interchangeable, so the plan is a list of runs: ``count``
sequences alike, each with the same lengths. Its size depends on the sequence
size and the number of groups, never on the number of documents. Spark ranks
the pieces within each length, slice by slice, and looks their places up.

Defined cases: NULL text counts as empty, and an empty document is the end mark
alone; a long document is cut into full pieces of which the first may be
shorter; ids identify documents, and repeated rows of one id are packed each
with the same piece numbers; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.durable import written
from tablewright.llm.bpe import Codec
from tablewright.llm.shared import map_batches

SEQUENCE_TOKENS = 2048
END_ID = 0
#: Groups of equally many long pieces; more groups round less and take longer to optimise.
GROUPS = 48
#: Pieces from this part of a sequence upwards are long.
LONG_SHARE = 1 / 3
#: A configuration whose actual pieces fill less is left to best fit.
LEAST_FILL = 0.98
_TINY = 1e-7


class PlainCodec(Codec):
    """The same ids by a compiled encoder where a pre-token is letters only."""

    def __init__(self, path: str):
        super().__init__(path)
        import tiktoken
        from public_tokenizers import PATTERN

        ranks = {raw: i for i, raw in enumerate(self.token_bytes) if raw and raw.decode("utf-8", "replace") not in self.added}
        self.whole = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode_piece(self, piece: str) -> bytes:
        if piece.isalpha() or piece[0] == " " and piece[1:].isalpha():
            return np.array(self.whole(piece), "<u4").tobytes()
        return super().encode_piece(piece)


def token_pieces(
    docs: DataFrame, path: str, size: int = SEQUENCE_TOKENS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece of each document."""

    def make():
        codec = PlainCodec(path)
        end = np.array([END_ID], "<u4").tobytes()

        def work(batch: pa.RecordBatch):
            owners, pieces, starts, lengths, checks = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = codec.encode(text) + end
                total = len(ids) // 4
                first = total % size or size
                for piece, stop in enumerate(range(first, total + 1, size)):
                    start = 0 if not piece else stop - size
                    owners.append(row)
                    pieces.append(piece)
                    starts.append(start)
                    lengths.append(stop - start)
                    checks.append(zlib.crc32(ids[4 * start : 4 * stop]))
            return {
                "doc_id": batch.column(0).take(pa.array(owners, "i8")),
                "piece": pieces,
                "start": starts,
                "length": lengths,
                "ids_crc32": checks,
            }

        return work

    kind = docs.select(id_col).dtypes[0][1]
    return map_batches(
        docs.select(id_col, text_col),
        make,
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long",
    )


@dataclass
class Plan:
    """``runs``: (count, lengths) of sequences alike."""

    size: int
    runs: list[tuple[int, tuple[int, ...]]] = field(default_factory=list)

    @property
    def sequences(self) -> int:
        return sum(count for count, _ in self.runs)

    def places(self) -> list[tuple[int, int, int, int, int]]:
        """(length, rank_from, rank_to, sequence_from, offset): where the pieces of a length go, by rank."""
        used: dict[int, int] = defaultdict(int)
        found, first = [], 0
        for count, lengths in self.runs:
            offset = 0
            for length in lengths:
                found.append((length, used[length], used[length] + count, first, offset))
                used[length] += count
                offset += length
            first += count
        return found


def plan_sequences(
    histogram: dict[int, int], size: int = SEQUENCE_TOKENS, groups: int = GROUPS, long_share: float = LONG_SHARE
) -> Plan:
    """Pack ``histogram`` (pieces by length) into few sequences of ``size``."""
    if not histogram:
        return Plan(size)
    least = max(1, int(size * long_share))
    full = histogram.get(size, 0)
    long = {n: c for n, c in histogram.items() if least <= n < size and c}
    small = {n: c for n, c in histogram.items() if n < least and c}
    runs: list[tuple[int, tuple[int, ...]]] = [(full, (size,))] if full else []
    grouped = _equal_groups(long, groups)
    rounded = [max(lengths) for lengths in grouped]
    demand = np.array([sum(lengths.values()) for lengths in grouped])
    used = _configurations(rounded, demand, size)
    runs += _substitute(used, rounded, long, size)
    # What the whole numbers of configurations left over goes in with the short pieces, longest first.
    return Plan(size, _best_fit(runs, small | {n: c for n, c in long.items() if c}, size))


def _equal_groups(lengths: dict[int, int], groups: int) -> list[dict[int, int]]:
    """Lengths from the longest down, in groups of equally many pieces."""
    share = max(1, -(-sum(lengths.values()) // groups))
    found: list[dict[int, int]] = []
    room = 0
    for n in sorted(lengths, reverse=True):
        left = lengths[n]
        while left:
            if not room:
                found.append({})
                room = share
            taken = min(left, room)
            found[-1][n] = taken
            left -= taken
            room -= taken
    return found


def _configurations(sizes: list[int], demand: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
    """Whole numbers of configurations (counts by group), by column generation on the relaxed problem."""
    k = len(sizes)
    if not k:
        return []
    lengths = np.array(sizes)
    columns = np.diag(size // lengths).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    level = inverse @ demand
    for _ in range(60 * k):
        price = inverse.sum(axis=0)
        worth, counts = _best_configuration(price, lengths, size)
        if worth <= 1 + _TINY:
            break
        direction = inverse @ counts
        ratios = np.where(direction > _TINY, level / np.where(direction > _TINY, direction, 1), np.inf)
        out = int(np.argmin(ratios))
        if not np.isfinite(ratios[out]):
            break
        columns[:, out] = counts
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        level = np.maximum(inverse @ demand, 0)
    whole = np.floor(level + _TINY).astype(int)
    left = demand - columns.astype(int) @ whole
    found = [(int(c), columns[:, i].astype(int)) for i, c in enumerate(whole) if c]
    # Round up where the fraction is large and the demand is really there.
    for i in np.argsort(whole - level):
        counts = columns[:, i].astype(int)
        if level[i] - whole[i] > 0.3 and (counts <= left).all() and lengths @ counts > 0.9 * size:
            left = left - counts
            found.append((1, counts))
    return found


def _best_configuration(price: np.ndarray, lengths: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The dearest configuration that fits: an unbounded knapsack over the capacities."""
    best, choice = np.zeros(size + 1), np.full(size + 1, -1)
    order = np.argsort(lengths)
    sorted_lengths, sorted_price = lengths[order], price[order]
    for room in range(int(sorted_lengths[0]), size + 1):
        fits = bisect.bisect_right(sorted_lengths, room)
        values = best[room - sorted_lengths[:fits]] + sorted_price[:fits]
        i = int(values.argmax())
        if values[i] > best[room - 1] + 1e-12:
            best[room], choice[room] = values[i], order[i]
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(len(lengths)), size
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= int(lengths[choice[room]])
    return float(best[size]), counts


def _substitute(
    configurations: list[tuple[int, np.ndarray]], rounded: list[int], left: dict[int, int], size: int
) -> list[tuple[int, tuple[int, ...]]]:
    """Runs of sequences with actual lengths in the rounded places; takes them out of ``left``.

    A place takes the longest piece left that is not longer than its rounded
    length; the last place takes the longest piece that still fits, so that
    little is lost by rounding. A run ends when one of its lengths is used up.
    """
    runs = []
    lengths_left = sorted(n for n, c in left.items() if c)

    def longest(most: int, take: dict[int, int]) -> int | None:
        at = bisect.bisect_right(lengths_left, most) - 1
        while at >= 0 and left[lengths_left[at]] <= take.get(lengths_left[at], 0):
            at -= 1
        return lengths_left[at] if at >= 0 else None

    order = sorted(configurations, key=lambda x: [rounded[g] for g in np.flatnonzero(x[1])], reverse=True)
    for count, counts in order:
        slots = [rounded[g] for g in np.flatnonzero(counts) for _ in range(int(counts[g]))]
        while count:
            take: dict[int, int] = {}
            lengths: list[int] = []
            room = size
            for i, most in enumerate(slots):
                n = longest(room if i == len(slots) - 1 else min(room, most), take)
                if n is not None:
                    take[n] = take.get(n, 0) + 1
                    lengths.append(n)
                    room -= n
            if not lengths or room > (1 - LEAST_FILL) * size:
                break
            together = min([count, *(left[n] // m for n, m in take.items())])
            for n, m in take.items():
                left[n] -= together * m
                if not left[n]:
                    lengths_left.remove(n)
            runs.append((together, tuple(lengths)))
            count -= together
    return runs


def _best_fit(
    runs: list[tuple[int, tuple[int, ...]]], small: dict[int, int], size: int
) -> list[tuple[int, tuple[int, ...]]]:
    """Short pieces into the runs, longest first, each where the least room is left."""
    open_runs: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for count, lengths in runs:
        open_runs[size - sum(lengths)].append((count, lengths))
    rooms = sorted(open_runs)

    def put(room: int, run: tuple[int, tuple[int, ...]]) -> None:
        if run[0]:
            if not open_runs[room]:
                at = bisect.bisect_left(rooms, room)
                if at == len(rooms) or rooms[at] != room:
                    rooms.insert(at, room)
            open_runs[room].append(run)

    for n in sorted(small, reverse=True):
        left = small[n]
        while left:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                each = size // n
                count, rest = divmod(left, each)
                put(size - each * n, (count, (n,) * each))
                if rest:
                    put(size - rest * n, (1, (n,) * rest))
                break
            room = rooms[at]
            if not open_runs[room]:
                rooms.pop(at)
                continue
            count, lengths = open_runs[room].pop()
            each = room // n
            whole = min(count, left // each)
            put(room - each * n, (whole, lengths + (n,) * each))
            left -= whole * each
            if whole < count and left:
                put(room - left * n, (1, lengths + (n,) * left))
                whole, left = whole + 1, 0
            put(room, (count - whole, lengths))
    return [run for room in sorted(open_runs) for run in open_runs[room]]


def pack(pieces: DataFrame, size: int = SEQUENCE_TOKENS) -> DataFrame:
    """``pieces`` (as of :func:`token_pieces`, read several times) with sequence_id and offset.

    Any number of pieces may have one length: ranks are counted within slices
    of a length, and only a table of (length, slice) counts is summed up.
    """
    spark = pieces.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)).cast("int"))
    counts = written(sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _place_table(spark, plan_sequences(histogram, size))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_first"))
    within = Window.partitionBy("length", "slice").orderBy("doc_id", "piece")
    ranked = (
        sliced.withColumn("nth", F.row_number().over(within) - 1)
        .join(firsts.hint("merge"), ["length", "slice"])
        .withColumn("rank", F.col("rank_first") + F.col("nth"))
    )
    return ranked.join(
        F.broadcast(places),  # as many rows as the plan has runs and places
        (ranked["length"] == places["place_length"])
        & (ranked["rank"] >= places["rank_from"])
        & (ranked["rank"] < places["rank_to"]),
    ).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("sequence_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"),
        "offset",
    )


def _place_table(spark: SparkSession, plan: Plan) -> DataFrame:
    return spark.createDataFrame(
        plan.places(),
        "place_length long, rank_from long, rank_to long, sequence_from long, offset long",
    )


def pack_documents(
    docs: DataFrame, path: str, size: int = SEQUENCE_TOKENS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece of each document with its place in a sequence."""
    return pack(written(token_pieces(docs, path, size, id_col, text_col)), size)


def sequences(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, ids): the token ids of each packed sequence, gapless."""
    from tablewright.llm.bpe import encode_texts

    whole = encode_texts(docs, path, id_col, text_col).select(
        F.col("doc_id").alias("owner"), F.concat("ids", F.array(F.lit(END_ID))).alias("whole")
    )
    parts = placed.join(whole, placed["doc_id"].eqNullSafe(whole["owner"])).select(
        "sequence_id", "offset", F.slice("whole", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids")
    )
    return parts.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids")
    )
