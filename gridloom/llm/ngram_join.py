"""Exact Jaccard join of documents on word shingles, by PartEnum signatures.

Sets are put in bands by size.  In a band the domain of shingles is hashed into parts; two
sets of Jaccard similarity 0.8 or more, the smaller with n shingles, differ in at most n/4
shingles and so in at most n/4 parts.  Each part's share of a set is a signature, and under
any one order of signatures the two sets have ``SHARED`` in common among their first
n/4 + SHARED.  Signatures that are known to be frequent come last in that order.  Sets near
a band's upper end sign for the next band too; sets of under ``SMALLEST_BAND`` shingles have
a part for each shingle.  Where hashing leaves a set too few parts, it also signs by single
shingles, and so does any partner that its signatures could miss.

Equal sets are one class from the start.  Candidates are first linked to one document of
each signature, the one whose signatures are most frequent: in a family of near copies that
is close to the text they stem from.  Once components of those links are known, only pairs
that share signatures across components remain, and all of these are tested: pairs of
small groups by a join, those of large groups in blocks that compare bitmaps of the sets,
so that only pairs which can be linked become rows.  Links are found exactly.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import Scratch
from .components import connected_components

SHINGLE = 5
#: Linked when 100 * intersection >= SIMILARITY * union.
SIMILARITY = 80
SMALLEST_BAND = 32
#: Signatures that linked sets share at least. Sets of under four shingles link only with equal ones.
SHARED = 3
#: Documents with a signature up to which their pairs are joined; and in a block beyond.
SMALL_GROUP = 48
BLOCK = 1000
#: Bits of bitmaps that a comparison unpacks at once, and signatures counted at once: both bound memory.
UNPACKED = 2_000_000
COUNTED = 1_000_000
#: A signature is frequent from so many documents of one batch on; so many are remembered.
#: Both set only the order of signatures: results hold for any value.
FREQUENT_IN_BATCH = 6
MAX_FREQUENT = 200_000
#: Parts that the documents with a frequent signature are dealt to.
SALTS = 32
#: Bits of the filter for documents whose texts are needed again.
FILTER_BITS = 1 << 27
WORDS_KEPT = 200_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    x = (x ^ (x >> np.uint64(29))) * _ODD[4]
    return x ^ (x >> np.uint64(32))


def _tag(x: int) -> np.uint64:
    return np.uint64(x * int(_ODD[1]) % (1 << 64))


class Shingler:
    """The set of shingle hashes of a text, sorted; keeps the hashes of words."""

    def __init__(self):
        self._words: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # lowers A-Z and splits at the six ASCII spaces
        n = len(words)
        if not n:
            return np.zeros(0, dtype=np.uint64)
        if n < SHINGLE:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], dtype=np.uint64)
        known = self._words
        try:
            hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=n)
        except KeyError:
            if len(known) > WORDS_KEPT:
                known.clear()
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w in words if w not in known)
            hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=n)
        m = n - SHINGLE + 1
        total = hashes[:m] * _ODD[0]
        for k in range(1, SHINGLE):
            total += hashes[k : k + m] * _ODD[k]
        return np.unique(_mix(total))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and 100 * common >= SIMILARITY * (len(a) + len(b) - common)


def bands(n: int) -> list[int]:
    """The bands that a set of n shingles signs for: 0 for small sets, then their least sizes."""
    own = 0 if n < SMALLEST_BAND else 1 << (n.bit_length() - 1)
    following = SMALLEST_BAND if own == 0 else 2 * own
    return [own, following] if 100 * n >= SIMILARITY * following else [own]


def signatures(shingles: np.ndarray, band: int) -> list[np.ndarray]:
    """All signatures in a band; a second array if single shingles are needed as well."""
    n = len(shingles)
    singles = _mix(shingles + _tag(2 * band + 1))
    if band == 0:
        return [singles]
    part = ((shingles >> np.uint64(32)) * np.uint64(band)) >> np.uint64(32)
    # Shingles are sorted and parts are ranges of them.
    starts = np.flatnonzero(np.diff(part, prepend=np.uint64(band)))
    sums = np.add.reduceat(_mix(shingles), starts)
    signed = _mix(sums + part[starts] * _ODD[0] + _tag(2 * band))
    return [signed, singles] if len(signed) < n // 4 + SHARED else [signed]


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each shingle, among two to four times as many bits as shingles."""
    n = max(64, 4 << max(0, len(shingles).bit_length() - 1))
    bits = np.zeros(n, dtype=bool)
    bits[(shingles >> np.uint64(20)) & np.uint64(n - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_link(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> bool:
    """Whether sets with these bitmaps (uint8) can be linked: each bit that only one has is a shingle the other lacks."""
    if len(a) > len(b):
        a = np.bitwise_or.reduce(a.reshape(-1, len(b)), axis=0)
    elif len(b) > len(a):
        b = np.bitwise_or.reduce(b.reshape(-1, len(a)), axis=0)
    common = min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))
    return 100 * common >= SIMILARITY * (n_a + n_b - common)


def first_in_order(signed: np.ndarray, n: int, frequent: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The first n // 4 + SHARED of a set's signatures, infrequent and frequent ones; and how frequent all of its are."""
    m = n // 4 + SHARED
    if len(frequent):
        place = np.minimum(np.searchsorted(frequent, signed), len(frequent) - 1)
        often = frequent[place] == signed
        score = int(times[place[often]].sum()) // len(signed)
        rare, often = signed[~often], signed[often]
    else:
        rare, often, score = signed, signed[:0], 0
    if len(rare) > m:
        rare = np.partition(rare, m - 1)[:m]
    return rare, np.sort(often)[: m - len(rare)], score


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashes of ``ids`` (id), FILTER_BITS long whatever their number."""
    at = _filter_place(F.col("id"))
    rows = ids.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    width = 4096  # bytes of a bucket
    bits = np.zeros(FILTER_BITS // 8 + width, dtype=np.uint8)
    for r in rows.toLocalIterator():
        begin = r["bucket"] * width
        bits[begin : begin + width] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return bits


def _filter_place(node: Column) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(FILTER_BITS))


def _sets(docs: DataFrame) -> DataFrame:
    """Of ``docs`` (id, text): rows (id, n, digest, bits); and rows (signature, times) of frequent ones."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            ids, texts = batch.columns
            sizes, digests, bits, signed, held = [], [], [], [], 0
            frequent, times = [], []

            def count() -> None:
                values, n = np.unique(np.concatenate(signed), return_counts=True)
                frequent.extend(values[n >= FREQUENT_IN_BATCH].view(np.int64).tolist())
                times.extend(n[n >= FREQUENT_IN_BATCH].tolist())
                signed.clear()

            for text in texts:
                s = shingle(text.as_py())
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                bits.append(bitmap(s))
                for band in bands(len(s)) if len(s) > SHARED else ():
                    signed.extend(signatures(s, band))
                    held += len(signed[-1])
                if held >= COUNTED:
                    count()
                    held = 0
            if signed:
                count()
            n, k = len(sizes), len(frequent)
            columns = [
                pa.concat_arrays([ids, pa.nulls(k, ids.type)]),
                pa.array(sizes + [None] * k, pa.int64()),
                pa.array(digests + [None] * k, pa.binary()),
                pa.array(bits + [None] * k, pa.binary()),
                pa.array([None] * n + frequent, pa.int64()),
                pa.array([None] * n + times, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "digest", "bits", "signature", "times"])

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(build, f"id {id_type}, n bigint, digest binary, bits binary, signature bigint, times bigint")


def _signed(docs: DataFrame, frequent: np.ndarray, times: np.ndarray) -> DataFrame:
    """(signature, salt, score, node) of ``docs`` (node, text); salt and score are 0 for infrequent signatures."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, times))
    node_type = docs.schema["node"].dataType.simpleString()
    names = ["signature", "salt", "score", "node"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            rows: list[list[np.ndarray]] = [[], [], [], []]
            size, salt_of = 0, batch.column(2).to_numpy()
            for i, text in enumerate(batch.column(1)):
                s = shingle(text.as_py())
                for band in bands(len(s)) if len(s) > SHARED else ():
                    for x in signatures(s, band):
                        rare, often, score = first_in_order(x, len(s), *shared.value)
                        for some, salt, points in ((rare, 0, 0), (often, 1 + salt_of[i], score)):
                            rows[0].append(some)
                            for column, value in zip(rows[1:], (salt, points, i)):
                                column.append(np.full(len(some), value, dtype=np.int32))
                            size += len(some)
                if size > 500_000 or i == batch.num_rows - 1 and size:
                    signed, *rest = (np.concatenate(x) for x in rows)
                    node = batch.column(0).take(pa.array(rest.pop()))
                    yield pa.RecordBatch.from_arrays([pa.array(signed.view(np.int64)), *map(pa.array, rest), node], names=names)
                    rows, size = [[], [], [], []], 0

    rows = docs.select("node", "text", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"))
    return rows.mapInArrow(sign, f"signature bigint, salt int, score int, node {node_type}")


def _plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sizes and bitmaps in ``sets`` (node, n, bits) allow a link."""
    node_type = sets.schema["node"].dataType.simpleString()

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [
                may_link(np.frombuffer(a.as_buffer(), np.uint8), n_a, np.frombuffer(b.as_buffer(), np.uint8), n_b)
                for n_a, a, n_b, b in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), batch.column(5))
            ]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(kept, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    of = lambda x, *columns: sets.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    sized = pairs.where("a < b").distinct().join(of("a", "n"), "a").join(of("b", "n"), "b")
    sized = sized.where(100 * F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b")).select("a", "b").distinct()
    both = sized.join(of("b", "n", "bits"), "b").join(of("a", "n", "bits"), "a")
    return both.select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(test, f"a {node_type}, b {node_type}").distinct()


def _blockwise(members: DataFrame) -> DataFrame:
    """Pairs (a, b) across components of large groups, that bitmaps allow to be linked.

    ``members`` has signature, size, node, component, n and bits.  A group is cut into blocks
    and every two of its blocks meet in a group of their own, so none holds more than two
    blocks of ``BLOCK`` rows or so.  A pair is told by the smallest large signature it shares.
    """
    node_type = members.schema["node"].dataType.simpleString()
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = members.groupBy("node").agg(F.sort_array(F.collect_set("signature")).alias("own"))
    m = members.join(own, "node").withColumn("_k", blocks).withColumn("_i", F.pmod(F.xxhash64("node"), F.col("_k")).cast("int"))
    m = m.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    m = m.select("signature", F.least("_i", "_j").alias("low"), F.greatest("_i", "_j").alias("high"), "_i", "node", "component", "n", "bits", "own")

    def meet(group: pa.Table) -> pa.Table:
        low, high, block = (group.column(c).to_numpy() for c in ("low", "high", "_i"))
        nodes = group.column("node").combine_chunks()
        parts = pc.dictionary_encode(group.column("component").combine_chunks()).indices.to_numpy()
        n = group.column("n").to_numpy()
        bits = [np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in group.column("bits").combine_chunks()]
        widths = np.array([len(x) for x in bits])
        found_a, found_b = [], []
        for wide in np.unique(widths):
            for narrow in np.unique(widths[widths <= wide]):
                rows = max(1, UNPACKED // (8 * int(narrow)))
                of = lambda width: (x[k : k + rows] for x in [np.flatnonzero(widths == width)] for k in range(0, len(x), rows))
                for a, b in itertools.product(of(narrow), list(of(wide))):
                    set_a = np.unpackbits(np.stack([bits[i] for i in a]), axis=1)
                    set_b = np.unpackbits(np.bitwise_or.reduce(np.stack([bits[i] for i in b]).reshape(len(b), -1, narrow), axis=1), axis=1)
                    both = set_a.astype(np.float32) @ set_b.astype(np.float32).T
                    n_a, n_b = n[a][:, None], n[b][None, :]
                    common = np.minimum(n_a - set_a.sum(axis=1)[:, None] + both, n_b - set_b.sum(axis=1)[None, :] + both)
                    meets = 100 * common >= SIMILARITY * (n_a + n_b - common)
                    meets &= parts[a][:, None] != parts[b][None, :]
                    if narrow == wide:
                        meets &= a[:, None] < b[None, :]
                    if low[0] != high[0]:  # pairs within a block meet where it is paired with itself
                        meets &= block[a][:, None] != block[b][None, :]
                    at_a, at_b = np.nonzero(meets)
                    found_a.append(a[at_a])
                    found_b.append(b[at_b])
        signature = group.column("signature")[0].as_py()
        shared = [set(x.as_py()) for x in group.column("own").combine_chunks()]
        at_a, at_b = np.concatenate(found_a), np.concatenate(found_b)
        told = np.array([min(shared[i] & shared[j]) == signature for i, j in zip(at_a.tolist(), at_b.tolist())], dtype=bool)
        x, y = nodes.take(pa.array(at_a[told])), nodes.take(pa.array(at_b[told]))
        first = pc.less(x, y)
        return pa.table({"a": pc.if_else(first, x, y), "b": pc.if_else(first, y, x)})

    return m.groupBy("signature", "low", "high").applyInArrow(meet, f"a {node_type}, b {node_type}").distinct()


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts in ``docs`` (id, text) are linked."""
    nodes = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    needed = docs.sparkSession.sparkContext.broadcast(_id_filter(nodes))
    id_type = docs.schema["id"].dataType.simpleString()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            bits = needed.value
            # Buckets count from 0 or 1 and places within them from 0, as the bitmap functions have it.
            bucket, place = np.where(at > 0, 1 + (at - 1) // 32768, 0), np.where(at > 0, (at - 1) % 32768, 0)
            kept = bits[bucket * 4096 + place // 8] >> (place % 8).astype(np.uint8) & 1
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(kept.astype(bool))) for c in batch.columns[:2]], names=["id", "text"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, last, last_set = Shingler(), None, None
        for batch in batches:
            kept = []
            for text_a, text_b in zip(batch.column(2), batch.column(3)):
                text = text_a.as_py()
                if text != last or last_set is None:
                    last, last_set = text, shingle(text)
                kept.append(linked(last_set, shingle(text_b.as_py())))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(kept, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    texts = docs.where("id is not null").select("id", "text", _filter_place(F.col("id")).alias("at")).mapInArrow(pick, f"id {id_type}, text string")
    # A document with very many partners is a skewed side of these joins, which Spark can split.
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(compare, f"a {id_type}, b {id_type}").distinct()


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``.

    component_id is the smallest id reachable by links, the row's own included.  Texts
    without words have 0 shingles and link with nothing, as do rows with a null id, whose
    component_id is null.  Rows with equal ids are one document that has all their texts.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = scratch.keep("sets", _sets(rows))
    sets = found.where("signature is null").select("id", "n", "digest", "bits")
    often = found.where("signature is not null").groupBy("signature").agg(F.sum("times").alias("times"))
    # Bounded by MAX_FREQUENT, 12 bytes each.
    top = sorted(often.orderBy(F.col("times").desc(), "signature").limit(MAX_FREQUENT).collect(), key=lambda r: r["signature"] % (1 << 64))
    frequent = np.array([r["signature"] for r in top], dtype=np.int64).view(np.uint64)
    times = np.array([min(r["times"], 1 << 30) for r in top], dtype=np.int64)

    filled = sets.where("n > 0 and id is not null")
    classes = filled.groupBy("digest").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    classes = scratch.keep("classes", classes)
    nodes = classes.select("node", "n", "bits")
    texts = rows.join(nodes.select(F.col("node").alias("id")).distinct(), "id").select(F.col("id").alias("node"), "text")
    group = Window.partitionBy("signature", "salt")
    best = F.min_by("node", F.struct(-F.col("score"), F.col("node"))).over(group)
    groups = _signed(texts, frequent, times).withColumns({"size": F.count("*").over(group), "best": best, "top": F.max("score").over(group)})
    groups = scratch.keep("groups", groups.where("size > 1 or salt > 0").drop("score"))

    # Each document with the best one of its groups; where a signature is salted, also its salts' best ones.
    ordered = lambda d: d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    stars = groups.select(F.col("best").alias("a"), F.col("node").alias("b"))
    heads = groups.where("salt > 0").select("signature", F.col("best").alias("b"), "top").distinct()
    heads = heads.join(heads.groupBy("signature").agg(F.min_by("b", F.struct(-F.col("top"), F.col("b"))).alias("a")), "signature").select("a", "b")
    tried = scratch.keep("tried", _plausible(ordered(stars.union(heads)), nodes))
    links = scratch.keep("links", _verified(rows, tried))
    component = scratch.keep("starred", connected_components(links))

    member = groups.select("signature", "node").join(component, "node", "left")
    member = scratch.keep("member", member.select("signature", "node", F.coalesce("component", "node").alias("component")))
    scratch.drop("groups", "starred")
    mixed = member.groupBy("signature").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.count("*").alias("size")).where("c < d")
    member = member.join(scratch.keep("mixed", mixed.select("signature", "size")), "signature")
    small = member.where(F.col("size") <= SMALL_GROUP)
    side = lambda x: small.select("signature", F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    across = side("a").join(side("b"), "signature").where("a < b and c_a <> c_b").groupBy("a", "b").agg(F.count("*").alias("k"))
    large = member.where(F.col("size") > SMALL_GROUP).join(nodes, "node")
    # Linked documents that share a large group are found there; others share enough small ones.
    across = across.where(F.col("k") >= SHARED).select("a", "b")
    rest = scratch.keep("rest", _plausible(across.union(_blockwise(large)).join(tried, ["a", "b"], "left_anti"), nodes))
    scratch.drop("member", "mixed", "tried")
    more = scratch.keep("more", _verified(rows, rest))

    # An id with several texts is in several classes, and links them.
    owned = filled.join(classes.select("digest", "node"), "digest").select("id", "node").distinct()
    shared = owned.join(owned.groupBy("id").agg(F.min("node").alias("a"), F.count("*").alias("k")).where("k > 1"), "id")
    component = connected_components(links.union(more).union(shared.select("a", F.col("node").alias("b"))))

    of_class = classes.select("digest", "node").join(component, "node", "left").select("digest", F.coalesce("component", "node").alias("_class"))
    of_class = scratch.keep("of-class", of_class)
    scratch.drop("classes", "links", "rest", "more")
    own = F.when(F.col("n") > 0, F.coalesce("_class", "id")).otherwise(F.col("id"))
    # A digest that very many rows share is a skewed side of this join, which Spark can split.
    placed = sets.join(of_class, "digest", "left").withColumn("component_id", F.when(F.col("id").isNotNull(), own))
    return placed.select("id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component.

    Rows with a null id stay, as do repeated rows of a document that stays; an empty table
    gives an empty one.  Columns and their names are those of ``docs``.
    """
    found = link_documents(docs, id_col, text_col)
    gone = found.where("id <> component_id").select(F.col("id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
