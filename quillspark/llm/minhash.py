"""Near-duplicates by MinHash over five-word shingles, with min-max hashing.

Each of 48 hash functions gives two signature values, its least and its greatest over the shingles, so 96 values
cost 48 evaluations; each value agrees between two texts with the chance of their Jaccard similarity. 24 bands of
4 values miss a pair of similarity 0.85 with a chance of 2e-8.

Links are then made certain on the full sets without forming all pairs of a group:

1. Texts with equal sets are one node. In each bucket the node of least hash leads; every member is compared with
   its leader (one comparison for each node and band at most).
2. What has one leader is a group; its hub R is the member with the fullest buckets, and groups with one hub are one. All
   members are compared with R, those of large groups with a further hub too, and components are found. Where rows meet
   what belongs to their group's hub, those of a large group are dealt over tasks and the hub's row is repeated.
3. Let D(u) be the symmetric difference of u and R. If u isn't linked with R, then any v linked with u shares at least
   t(u, v) = (|D(u)| + |D(v)| - 0.15 / 1.85 (|u| + |v|)) / 2 elements of D(u) and D(v), and t > 0. So the pairs that
   are still open are found by prefix filtering over D, with PPJoin's positional bound, in an order with the elements
   outside R first and rare ones before frequent ones (edits bring rare ones); only pairs of different components
   are asked for, and they are confirmed on the full sets. Pairs whose members are both linked with R are in one already.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, joined
from .scratch import Scratch
from .textnum import chunks, mix, shingles, words

FUNCTIONS, BANDS, ROWS = 48, 24, 4
#: Groups of more members than this get a second hub before their open pairs are looked for.
LARGE_GROUP = 50
#: Members of a group that meet their hub's row in one task, by the size of their bucket.
PART = 256
#: Bytes of text whose words and shingles a worker holds at once.
CHUNK = 1 << 18
_odd = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def min_max(text: np.ndarray, value: np.ndarray, n_texts: int) -> np.ndarray:
    """Signatures (n_texts x 96, uint32) of sorted (text, hash) rows: columns 2i and 2i + 1 are the least and the
    greatest value of function i. A text without shingles has zeros."""
    out = np.zeros((n_texts, 2 * FUNCTIONS), np.uint32)
    if not len(text):
        return out
    first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    rows = text[first]
    with np.errstate(over="ignore"):
        for i, a in enumerate(_odd):
            h = ((value * a) >> np.uint64(32)).astype(np.uint32)
            out[rows, 2 * i] = np.minimum.reduceat(h, first)
            out[rows, 2 * i + 1] = np.maximum.reduceat(h, first)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; a band takes its values from different functions."""
    order = np.arange(2 * FUNCTIONS).reshape(FUNCTIONS, 2).T.reshape(BANDS, ROWS)
    keys = np.empty((len(signature), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b, columns in enumerate(order):
            k = np.full(len(signature), b + 1, np.uint64)
            for c in columns:
                k = mix(k * np.uint64(0x9E3779B97F4A7C15) + signature[:, c])
            keys[:, b] = k
    return keys


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _signatures(batches: Iterator[pa.RecordBatch], banding=bands) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in chunks(batch["text"], CHUNK):
            w = words(batch["text"].slice(a, b - a))
            text, value = shingles(w)
            n = np.bincount(text, minlength=b - a)
            sums = []
            with np.errstate(over="ignore"):
                for salt in (21, 22):
                    s = np.zeros(len(value) + 1, np.uint64)
                    np.cumsum(mix(value, salt), out=s[1:])
                    ends = np.cumsum(n)
                    sums.append(mix(s[ends] - s[ends - n]))
            keys = banding(min_max(text, value, b - a)).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].slice(a, b - a), pa.array(n.astype(np.int64)), _long(sums[0]), _long(sums[1]), pa.FixedSizeListArray.from_arrays(_long(keys), BANDS).cast(pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "node", "check", "keys"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in chunks(batch["text"], CHUNK):
            text, value = shingles(words(batch["text"].slice(a, b - a)))
            n = np.bincount(text, minlength=b - a)
            offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            with np.errstate(over="ignore"):
                s = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value, 21), dtype=np.uint64)))
                node = mix(s[offsets[1:]] - s[offsets[:-1]])
            yield pa.RecordBatch.from_arrays([_long(node), pa.ListArray.from_arrays(pa.array(offsets), _long(value))], ["node", "h"])


def dealt(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """`rows` (a, u, m, ...) joined by a with `keyed` (a, size, ...; one row for each a, size at least the m of its rows). The rows of
    one a go to ceil(m / PART) parts by u, and keyed's row is repeated for each part. size is not returned."""
    copies = keyed.withColumn("part", F.explode(F.expr(f"sequence(0L, ceil(size / {PART}) - 1)"))).drop("size")
    return rows.withColumn("part", F.expr(f"pmod(xxhash64(u), ceil(m / {PART}))")).join(copies, ["a", "part"]).drop("part")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, banding=bands) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Words are what lies between ASCII white space, A-Z lower-cased; a text's set is its distinct five-word shingles, or
    its whole sequence if shorter. Texts are linked if 100 * intersection >= percent * union (percent >= 80, for
    which the bands are laid out; `banding` replaces them). component_id is the least id reachable by links, itself included.

    Null or empty texts and texts without words have the empty set, which is linked with nothing. Rows with a null
    id keep their n_shingles and have null component_id and kept = true: they link nothing. Repeated rows are each
    returned; rows that share an id are judged by their own texts. Other columns are not read. No rows give none."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.keep(docs.mapInArrow(partial(_signatures, banding=banding), "doc_id long, n_shingles long, node long, check long, keys array<long>"))
    named = signed.where("n_shingles > 0 and doc_id is not null")
    nodes = scratch.keep(named.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.first("keys").alias("keys")))

    member = nodes.select("node", F.explode("keys").alias("key"))
    bucket = member.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1")
    led = member.join(bucket, "key").where("node <> a").groupBy("a", F.col("node").alias("u")).agg(F.max("m").alias("m"))
    led = scratch.keep(led)

    fill = F.sum("m").alias("fill")
    degree = member.join(bucket, "key").groupBy("node").agg(fill)

    wanted = led.select("a").union(led.select("u")).distinct().withColumnRenamed("a", "node")
    rep = nodes.join(wanted, "node", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
    plain = docs.join(rep, "doc_id", "left_semi").mapInArrow(_sets, "node long, h array<long>")
    plain = scratch.keep(plain.join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    # One order of elements for all sets: rare before frequent.
    element = plain.select("node", F.explode("h").alias("x"))
    often = element.groupBy("x").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    ordered = element.join(often, "x", "left").groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(1)).alias("f"), "x"))).alias("h"))
    sets = scratch.keep(ordered.select("node", F.col("h.x").alias("h")))

    def with_sets(pairs: DataFrame, x: str, y: str) -> DataFrame:
        return pairs.join(sets.select(F.col("node").alias(x), F.col("h").alias("hx")), x).join(sets.select(F.col("node").alias(y), F.col("h").alias("hy")), y)

    def with_hub_sets(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("a").agg(F.max("m").alias("size"))
        hubs = sets.select(F.col("node").alias("a"), F.col("h").alias("hy")).join(sizes, "a")
        return dealt(rows.join(sets.select(F.col("node").alias("u"), F.col("h").alias("hx")), "u"), hubs)

    share = F.size(F.array_intersect("hx", "hy")).cast("long")

    def compared(pairs: DataFrame) -> DataFrame:
        out = with_hub_sets(pairs).select("a", "u", "m", F.size("hx").cast("long").alias("nu"), F.size("hy").cast("long").alias("na"), share.alias("i"))
        return scratch.keep(out.withColumn("linked", F.expr(f"100 * i >= {percent} * (na + nu - i)")))

    def edges_of(rows: DataFrame) -> DataFrame:
        return rows.where("linked").select(F.col("a").alias("x"), F.col("u").alias("y"))

    sized = compared(led)
    ranked = sized.where("m > 2").select("a", "u", "m").union(sized.where("m > 2").select("a", F.col("a").alias("u"), "m"))
    hub = ranked.join(degree.withColumnRenamed("node", "u"), "u").groupBy("a").agg(F.max_by("u", F.struct("fill", "u")).alias("r"), F.max("m").alias("size"))
    behind = dealt(sized.where("m > 2"), hub).where("r <> u")
    same = behind.where("r = a").select("a", "u", "m", "nu", "na", "i", "linked")
    moved = behind.where("r <> a").groupBy("r", "u").agg(F.max("m").alias("m")).withColumnRenamed("r", "a").join(same.select("a", "u"), ["a", "u"], "left_anti")
    grouped = scratch.keep(same.union(compared(scratch.keep(moved))).dropDuplicates(["a", "u"]).join(degree.withColumnRenamed("node", "u"), "u"))
    edges = edges_of(sized).union(edges_of(grouped))

    def in_components() -> DataFrame:
        return scratch.keep(grouped.join(tied.withColumnRenamed("node", "u"), "u", "left").withColumn("component", F.coalesce("component", "u")))

    # Large groups get a second hub, the one of fullest buckets among the members that the first doesn't hold.
    tied = scratch.keep(components(edges, scratch))
    state, free = in_components(), F.when(~F.col("linked"), F.struct("fill", "u"))
    bars = state.groupBy("a").agg(
        F.max(free).alias("bar"), F.max_by("component", free).alias("own"), F.max("m").alias("size"),
        F.count(F.lit(1)).alias("rows"), F.min("component").alias("c1"), F.max("component").alias("c2"),
    )
    bars = scratch.keep(bars.where(f"rows > {LARGE_GROUP} and c1 < c2 and bar is not null").select("a", "bar", "own", "size"))
    if bars.take(1):
        pairs = dealt(state, bars).where("component <> own").select(F.col("bar.u").alias("a"), "u", "m").dropDuplicates(["a", "u"])
        tied = joined(tied, edges_of(compared(scratch.keep(pairs))), scratch)
        state = in_components()

    # Pairs that are still open: d is |D(u)|; two linked sets differ in at most cut * (sum of their sizes) elements.
    cut, far = (100 - percent) / (100 + percent), 2 * (100 - percent)
    state = state.withColumn("d", F.expr("na + nu - 2 * i"))
    state = state.withColumn("ring", F.expr(f"not linked and 100 * i >= {100 - far} * (na + nu - i)")).withColumn("odd", ~F.col("linked"))
    groups = state.groupBy("a").agg(
        *(F.sum(F.col(c).cast("long")).alias(f"{c}s") for c in ("ring", "linked", "odd")), F.min("component").alias("c1"), F.max("component").alias("c2"), F.max("m").alias("size")
    ).where("c1 < c2 and ((rings > 0 and linkeds > 0) or odds > 1)").drop("c1", "c2")
    open_rows = dealt(state, groups).where("(linked and rings > 0) or (odd and (odds > 1 or (ring and linkeds > 0)))")
    placed = with_hub_sets(scratch.keep(open_rows)).select(
        "a", "u", "nu", "na", "d", "linked", "ring", "component",
        F.concat(F.array_except("hx", "hy"), F.array_except("hy", "hx")).alias("delta"),
    )
    # The longest prefix any pairing of the row can need. Linked: with ring rows, whose d exceeds cut * (nu + na).
    # Not linked: with others not linked, half; ring rows also with linked ones, d less its excess over the cut.
    top = 100 / percent
    half = F.floor(F.expr(f"d / 2 + {cut} * greatest(0, nu - na) / 2")) + 1
    ring_length = F.floor(F.expr(f"{cut} * (nu + least({top} * nu, {top} * na))")) + 1
    reach = F.when(F.col("linked"), half).when(F.col("ring"), F.greatest(half, ring_length)).otherwise(half)
    prefix = placed.select("a", "u", "nu", "d", "linked", "ring", "component", F.posexplode(F.slice("delta", 1, F.least(F.size("delta"), reach.cast("int")))).alias("p", "x"))
    prefix = scratch.keep(prefix)
    left, right = prefix.where("not linked").alias("l"), prefix.alias("r")
    t = f"(l.d + r.d - {cut} * (l.nu + r.nu)) / 2 - 1e-6"
    met = left.join(right, F.expr(f"""l.a = r.a and l.x = r.x and l.component <> r.component and ((r.linked and l.ring) or (not r.linked and l.u < r.u))
        and 100 * l.nu >= {percent} * r.nu and 100 * r.nu >= {percent} * l.nu and 1 + least(l.d - l.p - 1, r.d - r.p - 1) >= {t}"""))
    met = met.select(F.col("l.u").alias("x"), F.col("r.u").alias("y")).distinct()
    more = with_sets(met, "x", "y").where(share * 100 >= percent * (F.size("hx") + F.size("hy") - share)).select("x", "y")

    tied = joined(tied, more, scratch)
    least = nodes.select("node", "rep").join(tied, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = least.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = least.join(named, "component").select("node", F.col("component_id").alias("found"))
    return (
        signed.select("doc_id", "n_shingles", "node").join(found, "node", "left")
        .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("found"))).otherwise(F.col("doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )
