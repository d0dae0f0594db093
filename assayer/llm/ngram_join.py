"""Documents linked by the Jaccard similarity of their word n-grams, by vertical partitioning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import flatfiles
from assayer.llm.common import components, materialize

#: N-grams that stand at the end of the global order, by count; the list goes to every worker, 16 bytes each at most.
FREQUENT = 200_000
#: A frequent n-gram has been seen so often in groups of documents that hold it twice.
FREQUENT_COUNT = 8
#: Cuts of the global order.
FRAGMENTS = 8
#: Prefix entries that are searched for shared n-grams together, about.
BUCKET = 400_000
#: Documents of a block that lead in the first full round, and how many times as many have led after each further one.
LEADERS = 32
GROWTH = 8
#: Slots of the filter that says which documents' sets are needed: bits, fixed.
FILTER_BITS = 1 << 26

_KEYS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams of a text; A-Z are lower-cased, words end at ASCII white space."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = min(words, len(found))
    total = np.full(len(found) - n + 1, n, np.uint64)
    for k in range(n):
        total = _mixed(total + hashes[k : len(hashes) - n + 1 + k] * _KEYS[k % 4])
    return np.unique(total)


def _spread(own: np.ndarray) -> bytes:
    """How many n-grams stand in each of 256 narrow fragments, 255 at most."""
    return np.minimum(np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    """The most frequent n-grams by rising count: those that stand twice within many groups of documents.

    It only sets the global order, which any fixed order would serve; so counts of local groups are enough.
    """

    def count(batches):
        held, size, seen = [], 0, set()

        def told():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            twice = n > 1
            return pa.RecordBatch.from_arrays([pa.array(values[twice].view(np.int64)), pa.array(n[twice])], names=["h", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = shingles(text, words)
                mark = xxhash.xxh3_64_intdigest(own.tobytes())
                if len(own) and mark not in seen:
                    seen.add(mark)
                    held.append(own)
                    size += len(own)
                if size > 4_000_000:
                    yield told()
                    held, size, seen = [], 0, set()
        if held:
            yield told()

    counted = docs.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    top = counted.where(F.col("c") >= FREQUENT_COUNT).orderBy(F.desc("c"), "h").limit(FREQUENT)
    rows = top.toPandas()
    order = np.lexsort((rows["h"], rows["c"]))
    return rows["h"].to_numpy(np.int64)[order].view(np.uint64)


class _Order:
    """The global order: other n-grams by hash, then the frequent ones by count."""

    def __init__(self, frequent: np.ndarray):
        self.by_hash = np.sort(frequent)
        self.rank = np.argsort(frequent)

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """N-grams in order, their fragments, and how many of them are not frequent."""
        if not len(self.by_hash):
            return hashes, (hashes >> np.uint64(61)).astype(np.int8), len(hashes)
        at = np.minimum(np.searchsorted(self.by_hash, hashes), len(self.by_hash) - 1)
        often = self.by_hash[at] == hashes
        rank = self.rank[at[often]]
        order = np.argsort(rank)
        half = FRAGMENTS // 2
        few, many = hashes[~often], hashes[often][order]
        parts = [(few >> np.uint64(62)).astype(np.int8), (half + rank[order] * half // len(self.by_hash)).astype(np.int8)]
        return np.concatenate([few, many]), np.concatenate(parts), len(few)


def _pair_filter(percent: int) -> str:
    """Sizes allow the similarity, and so do the places of the first n-gram in common."""
    return (
        f"100 * least(n, m) >= {percent} * greatest(n, m) AND "
        f"(100 + {percent}) * least(n - pos, m - mpos) >= {percent} * (n + m)"
    )


def linked_documents(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every document of ``docs(doc_id, text)``.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of word n-grams; a text with fewer
    words is one n-gram, one without words has an empty set and no link. ``component_id`` is the smallest doc_id
    reachable by links.

    1. Documents with equal sets become one class, whatever their number; its smallest doc_id stands for it.
    2. All n-grams have a global order, with the frequent ones last. Linked documents share an n-gram of their prefixes
       in this order, so those that share one form a block. Frequent n-grams aside, a block is found by dealing packed
       prefixes to buckets.
    3. In each block the document with the fewest rare n-grams meets the others; what stays unlinked meets random
       leaders of growing number, until all pairs of different components have met. Members of one component never
       meet, so a group of copies costs about its size. Each round links the components of the round before, so only
       its own links are joined.
    4. The order is cut into fragments. A pair's overlap is counted in each fragment alone and summed. Links give
       components.

    A null text is an empty one; repeated rows fall into one class; a null doc_id is returned with no component; rows
    with equal doc_id and different texts count as one document with the links of each. An empty table gives no rows.
    Other columns are left out.
    """
    spark = docs.sparkSession
    narrow = docs.select("doc_id", "text")
    order = spark.sparkContext.broadcast(_Order(_frequent(narrow, words)))

    sig_schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("set", pa.binary()), ("rare", pa.float64()), ("prefix", pa.binary()), ("spread", pa.binary())]
    )

    def sign(batches):
        for batch in batches:
            rows = {f.name: [] for f in sig_schema}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = shingles(text, words)
                n = len(own)
                ranked, _, few = order.value(own)
                keep = n - (percent * n + 99) // 100 + 1 if n else 0
                row = (doc, n, xxhash.xxh3_128_digest(own.tobytes()), few / n if n else 0.0, ranked[:keep].tobytes(), _spread(own))
                for name, value in zip(rows, row, strict=True):
                    rows[name].append(value)
            yield flatfiles.table(rows, sig_schema)

    signed = materialize(narrow.mapInArrow(sign, "doc_id long, n long, set binary, rare double, prefix binary, spread binary"), "ngram-sets")
    classes = signed.where("doc_id IS NOT NULL AND n > 0").groupBy("set").agg(F.min("doc_id").alias("rep"))
    members = signed.select("doc_id", "n", "set").join(classes, "set", "left").select("doc_id", "n", "rep")
    members = materialize(members, "ngram-classes")
    reps = members.where("doc_id = rep AND n > 0").select("rep").distinct()
    prefixes = signed.where("n > 0").withColumnRenamed("doc_id", "rep").join(reps, "rep", "left_semi")
    prefixes = prefixes.dropDuplicates(["rep", "set"]).drop("set", "spread")

    total = signed.agg(F.sum(F.length("prefix"))).first()[0] or 0
    n_buckets = int(total // 8 // BUCKET) + 1

    def deal(batches):
        mine: dict[int, list] = {}
        for batch in batches:
            tokens, reps_, ns, at, rare = [], [], [], [], []
            for rep, n, few, prefix in zip(*(batch.column(c).to_pylist() for c in ("rep", "n", "rare", "prefix")), strict=True):
                own = np.frombuffer(prefix, np.uint64)
                tokens.append(own)
                reps_.append(np.full(len(own), rep, np.int64))
                ns.append(np.full(len(own), n, np.uint32))
                rare.append(np.full(len(own), few, np.float32))
                at.append(np.arange(len(own), dtype=np.uint32))
            if not tokens:
                continue
            tokens, reps_, ns, at, rare = map(np.concatenate, (tokens, reps_, ns, at, rare))
            known = order.value.by_hash
            often = known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens if len(known) else np.zeros(len(tokens), bool)
            bucket = np.where(often, -1 - _mixed(reps_.view(np.uint64)).astype(np.int64) % n_buckets, (tokens % np.uint64(n_buckets)).astype(np.int64))
            sort = np.argsort(bucket, kind="stable")
            keys, starts = np.unique(bucket[sort], return_index=True)
            for key, part in zip(keys, np.split(sort, starts[1:]), strict=True):
                mine.setdefault(int(key), []).append([x[part].tobytes() for x in (tokens, reps_, ns, at, rare)])
        if mine:
            rows = {"bucket": list(mine)}
            for k, name in enumerate(("tokens", "reps", "ns", "at", "rare")):
                rows[name] = [b"".join(x[k] for x in parts) for parts in mine.values()]
            yield pa.RecordBatch.from_pydict(rows)

    block_schema = pa.schema(
        [("token", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("rare", pa.float64())]
    )

    def meet(group: pa.Table) -> pa.Table:
        cols = []
        for name, kind in (("tokens", np.uint64), ("reps", np.int64), ("ns", np.uint32), ("at", np.uint32), ("rare", np.float32)):
            cols.append(np.frombuffer(b"".join(group.column(name).to_pylist()), kind))
        if group.column("bucket")[0].as_py() >= 0:
            _, which, n = np.unique(cols[0], return_inverse=True, return_counts=True)
            cols = [c[n[which] > 1] for c in cols]
        out = [cols[0].view(np.int64), cols[1], *(c.astype(np.int64) for c in cols[2:4]), cols[4].astype(float)]
        return pa.Table.from_arrays([pa.array(c) for c in out], schema=block_schema)

    dealt = prefixes.mapInArrow(deal, "bucket long, tokens binary, reps binary, ns binary, at binary, rare binary")
    blocks = materialize(
        dealt.groupBy("bucket").applyInArrow(meet, "token long, rep long, n long, pos long, rare double"), "ngram-blocks"
    )
    sizes = blocks.groupBy("token").agg(
        F.count("*").alias("size"), F.min(F.struct("rare", "rep", F.col("n").alias("m"), F.col("pos").alias("mpos"))).alias("lead")
    )
    blocks = materialize(blocks.join(sizes.where("size > 1"), "token"), "ngram-blocks")
    allowed = _pair_filter(percent)
    spreads = signed.where("n > 0").select(F.col("doc_id").alias("rep"), "spread")
    first = blocks.where("rep <> lead.rep").selectExpr("rep AS a", "lead.rep AS b", "n", "lead.m AS m", "pos", "lead.mpos AS mpos")
    overlaps = lambda pairs: _links(pairs.where(allowed), narrow, spreads, order, words, percent)
    # each step moves representatives, or what earlier steps moved them to, to smaller ones
    moves = [components(overlaps(first.selectExpr("*", "a AS root", "b AS broot")), "ngram-components")]
    still = _moved(blocks.drop("lead", "rare").withColumn("root", F.col("rep")), moves[-1])
    share = F.pmod(F.xxhash64(F.lit(11), "rep"), F.lit(1 << 30)) / float(1 << 30) * F.col("size")
    met = 0
    while True:
        # blocks that still hold several components; smaller ones have met whole
        still = still.where(F.col("size") > max(met, 2))
        mixed = still.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
        still = materialize(still.join(mixed, "token", "left_semi"), "ngram-open")
        if still.isEmpty():
            break
        before, met = met, met * GROWTH or LEADERS
        leads = still.where((share >= before) & (share < met)).selectExpr(
            "token", "rep AS b", "n AS m", "pos AS mpos", "root AS broot"
        )
        pairs = still.select("token", F.col("rep").alias("a"), "n", "pos", "root").join(leads, "token")
        more = overlaps(pairs.where("root <> broot"))
        if not more.isEmpty():
            moves.append(components(more, "ngram-components"))
            still = _moved(still, moves[-1])
    found = members.withColumn("root", F.coalesce("rep", "doc_id"))
    for step in moves:
        found = _moved(found, step)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))


def _moved(held: DataFrame, step: DataFrame) -> DataFrame:
    """``held`` with its ``root`` moved on by ``step(node, root)``."""
    to = step.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return held.join(to, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to")


def _segments(docs: DataFrame, wanted: DataFrame, order, words: int) -> DataFrame:
    """Sets of the documents ``wanted(rep)``, cut by fragment.

    A filter of fixed size says whose sets may be needed; a few too many do no harm.
    """
    spots = wanted.select(F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS)).alias("bit"))
    bytes_ = spots.groupBy(F.expr("bit div 32").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits"))
    rows = bytes_.toPandas()
    filled = np.zeros(FILTER_BITS // 32, np.uint32)
    filled[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype(np.uint32)
    needed = docs.sparkSession.sparkContext.broadcast(filled)
    schema = pa.schema([("rep", pa.int64()), ("fragment", pa.int32()), ("part", pa.list_(pa.int64()))])

    def cut(batches):
        for batch in batches:
            bit = batch.column(2).to_numpy()
            need = (needed.value[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1
            for k in np.flatnonzero(need):
                own = shingles(batch.column(1)[int(k)].as_py(), words)
                ranked, fragment, _ = order.value(own)
                names = np.unique(fragment)
                parts = [ranked[fragment == f].view(np.int64) for f in names]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(names), batch.column(0)[int(k)].as_py(), np.int64)),
                        pa.array(names.astype(np.int32)),
                        pa.array(parts, pa.list_(pa.int64())),
                    ],
                    schema=schema,
                )

    keyed = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("bit"))
    return keyed.mapInArrow(cut, "rep long, fragment int, part array<long>")


def _links(pairs: DataFrame, docs: DataFrame, spreads: DataFrame, order, words: int, percent: int) -> DataFrame:
    """Roots ``(a, b)`` of the pairs that reach the similarity, of candidates ``(a, b, n, m, root, broot, ...)``.

    The numbers of n-grams in narrow fragments go first: what they differ by is at most the symmetric difference, and
    few pairs pass that are not linked. Only these meet with their sets.
    """

    def close(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 256) for c in ("spread_a", "spread_b"))
            apart = np.abs(a.astype(np.int16) - b).sum(axis=1, dtype=np.int64)
            both = batch.column("both").to_numpy()
            # intersection = (both - symmetric difference) / 2
            yield batch.filter(pa.array((100 + percent) * (both - apart) >= 2 * percent * both)).select(["a", "b", "both", "low", "high"])

    sized = pairs.select(
        F.least("a", "b").alias("a"),
        F.greatest("a", "b").alias("b"),
        (F.col("n") + F.col("m")).alias("both"),
        F.least("root", "broot").alias("low"),
        F.greatest("root", "broot").alias("high"),
    )
    described = sized.distinct().join(spreads.toDF("a", "spread_a"), "a").join(spreads.toDF("b", "spread_b"), "b")
    once = materialize(described.mapInArrow(close, "a long, b long, both long, low long, high long").distinct(), "ngram-pairs")
    if once.isEmpty():
        return once.select(F.col("low").alias("a"), F.col("high").alias("b"))
    segments = _segments(docs, once.select("a").union(once.select("b")).toDF("rep").distinct(), order, words)
    segments = materialize(segments, "ngram-fragments")
    left = segments.select(F.col("rep").alias("a"), "fragment", F.col("part").alias("part_a"))
    right = segments.select(F.col("rep").alias("b"), "fragment", F.col("part").alias("part_b"))
    partial = once.join(left, "a").join(right, ["b", "fragment"]).select(
        "a", "b", "both", "low", "high", "fragment", F.size(F.array_intersect("part_a", "part_b")).cast("long").alias("overlap")
    )
    # repeated rows count a fragment more than once
    pair = ["a", "b", "both", "low", "high"]
    counted = partial.groupBy(*pair, "fragment").agg(F.max("overlap").alias("overlap"))
    summed = counted.groupBy(*pair).agg(F.sum("overlap").alias("overlap"))
    linked = summed.where(f"100 * overlap >= {percent} * (both - overlap)")
    return materialize(linked.select(F.col("low").alias("a"), F.col("high").alias("b")).distinct(), "ngram-links")


__all__ = ["linked_documents", "shingles"]
