"""Best-fit packing of documents into sequences of one length by linear grouping."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import flatfiles
from assayer.llm.common import materialize
from assayer.llm.tokens import encode_all

CAPACITY = 2048
#: Groups of equal size that the large lengths are rounded up in.
GROUPS = 96
#: Lengths up to this share of the capacity are small.
SMALL = 0.125

_PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, bucket int"
_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32")), ("bucket", pa.int32())]
)


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """Tokenize whole texts (null: empty), end each with the end id and cut only what is longer than a sequence."""

    def cut(batches):
        bucket = TaskContext.get().partitionId()
        for batch in batches:
            rows = defaultdict(list)
            for doc, ids in zip(batch.column(0).to_pylist(), encode_all(tokenizer, batch.column(1).to_pylist()), strict=True):
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    row = (doc, k, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), bucket)
                    for field, value in zip(_PIECES, row, strict=True):
                        rows[field.name].append(value)
            if rows:
                yield flatfiles.table(rows, _PIECES)

    return docs.select("doc_id", "text").mapInArrow(cut, _PIECES_SQL)


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size fill one sequence to the greatest worth."""
    best, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        more, pick = best.copy(), np.full(capacity + 1, -1)
        for j, (s, v) in enumerate(zip(sizes, worth, strict=True)):
            with_j = best[: capacity + 1 - s] + v
            gain = with_j > more[s:] + 1e-12
            more[s:][gain] = with_j[gain]
            pick[s:][gain] = j
        picks.append(pick)
        if (pick < 0).all():
            break
        best = more
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(picks):
        if (j := pick[room]) >= 0:
            pattern[j] += 1
            room -= sizes[j]
    return pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns of few sizes and how often to use each, none beyond the demand: linear program, rounded down.

    Columns are generated until no pattern is worth more than a sequence; what rounding leaves is less than one
    sequence per size.
    """
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(40 * k):
        worth = np.linalg.solve(basis.T, np.ones(k))
        pattern = _best_pattern(sizes, np.maximum(worth, 0), capacity)
        if pattern @ worth <= 1 + 1e-7:
            break
        use, change = np.linalg.solve(basis, demand.astype(float)), np.linalg.solve(basis, pattern.astype(float))
        ratio = np.where(change > 1e-9, np.maximum(use, 0) / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, ratio.argmin()] = pattern
    use = np.linalg.solve(basis, demand.astype(float))
    left, out = demand.copy(), []
    for j in range(k):
        pattern = np.rint(basis[:, j]).astype(np.int64)
        some = pattern > 0
        if (n := min(int(np.floor(use[j] + 1e-6)), int((left[some] // pattern[some]).min()))) > 0:
            out.append((pattern, n))
            left -= n * pattern
    return out


class _Run:
    """Sequences of the same make-up: ``n`` of them, each with a piece of every slot ``(length, rank of the first)``."""

    def __init__(self, n: int, slots: list[tuple[int, int]]):
        self.n, self.slots = n, slots

    def split(self, n: int) -> tuple[_Run, _Run]:
        return _Run(n, self.slots), _Run(self.n - n, [(length, rank + n) for length, rank in self.slots])


def plan(counts: np.ndarray, capacity: int = CAPACITY, n_groups: int = GROUPS, small: float = SMALL) -> np.ndarray:
    """Where pieces go, from the number of pieces of each length (``counts[length]``).

    Returns rows ``length, rank, n, sequence, offset``: of the pieces of this length, those with ranks ``rank`` to
    ``rank + n - 1`` go to as many sequences from ``sequence`` on, each at ``offset``. Large lengths are put, in order,
    into groups of equal cardinality and rounded up to the longest in the group; configurations of the few rounded
    sizes are optimised; actual pieces take the slots, the longest first; then all others, longest first, go where the
    least room is left. The work and the result depend on the number of lengths, not on that of pieces.
    """
    counts = counts.astype(np.int64)
    used = np.zeros(capacity + 1, np.int64)
    open_runs: dict[int, list[_Run]] = defaultdict(list)

    def keep(run: _Run) -> None:
        if run.n:
            open_runs[capacity - sum(length for length, _ in run.slots)].append(run)

    if counts[capacity]:
        keep(_Run(int(counts[capacity]), [(capacity, 0)]))
        used[capacity] = counts[capacity]
    large = [x for x in range(capacity - 1, int(capacity * small), -1) if counts[x]]
    if total := int(sum(counts[x] for x in large)):
        # the pieces in descending order of length, as runs of (length, n), cut into groups
        k = min(n_groups, len(large))
        edges = [total * g // k for g in range(k + 1)]
        groups, at, g = [[] for _ in range(k)], 0, 0
        for x in large:
            n = int(counts[x])
            while n:
                while edges[g + 1] <= at:
                    g += 1
                part = min(n, edges[g + 1] - at)
                groups[g].append([x, part])
                at, n = at + part, n - part
        merged: dict[int, list] = {}
        for group in groups:  # groups of equal rounded size are one
            if group:
                merged.setdefault(group[0][0], []).extend(group)
        sizes = np.array(sorted(merged, reverse=True))
        demand = np.array([sum(n for _, n in merged[s]) for s in sizes])
        ranks = used
        for pattern, n in configurations(sizes, demand, capacity):
            slots = [merged[s] for s, times in zip(sizes, pattern, strict=True) for _ in range(times)]
            # one slot takes n pieces in order; where a slot's length changes, a new run begins
            taken = []
            for group in slots:
                parts, need = [], n
                while need:
                    length, there = group[0]
                    part = min(there, need)
                    parts.append((length, int(ranks[length]), part))
                    ranks[length] += part
                    need -= part
                    group[0][1] -= part
                    if not group[0][1]:
                        group.pop(0)
                taken.append(parts)
            bounds = sorted({0} | {int(b) for parts in taken for b in np.cumsum([p for _, _, p in parts])})
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                run = []
                for parts in taken:
                    at = 0
                    for length, rank, part in parts:
                        if at <= a < at + part:
                            run.append((length, rank + a - at))
                        at += part
                keep(_Run(b - a, run))
    for length in range(capacity - 1, 0, -1):
        left = int(counts[length] - used[length])
        while left:
            room = min((r for r in open_runs if r >= length and open_runs[r]), default=None)
            if room is None:
                fit = capacity // length
                n, fit = (left // fit, fit) if left >= fit else (1, left)
                run = _Run(n, [])
            else:
                run = open_runs[room].pop()
                fit = min(room // length, left)
                if (n := min(run.n, left // fit)) < run.n:
                    run, rest = run.split(n)
                    keep(rest)
            run.slots = run.slots + [(length, int(used[length]) + i * n) for i in range(fit)]
            used[length] += n * fit
            left -= n * fit
            keep(run)
    rows, sequence = [], 0
    for room in sorted(open_runs):
        for run in open_runs[room]:
            offset = 0
            for length, rank in run.slots:
                rows.append((length, rank, run.n, sequence, offset))
                offset += length
            sequence += run.n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """One row per piece of every document: its checksum, its sequence and its place there.

    Spark counts the pieces of each length (at most ``capacity`` numbers, whatever the corpus) and the plan is made
    from these. Pieces of a length are then numbered by prefix sums over the tables they were written in, and each
    number is looked up in the plan, so hot lengths need no group of their own. A null text is an empty document, which
    holds its end id; repeated rows are packed as often as they stand there; an empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = materialize(cut_pieces(docs, capacity, tokenizer), "pieces")
    cells = materialize(pieces.groupBy("bucket", "length").agg(F.count("*").alias("n")), "piece-lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cells.groupBy("length").agg(F.sum("n")).collect():
        counts[length] = n
    where = spark.sparkContext.broadcast(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # a bucket is what one task wrote, so these groups are bounded
    order = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("nth", F.row_number().over(order)).join(bases, ["bucket", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth") - 1).alias("rank"))

    def find(batches):
        rows = where.value
        keys = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            hit = rows[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            kept = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(hit[:, 3] + rank - hit[:, 1]), pa.array(hit[:, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        find, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
