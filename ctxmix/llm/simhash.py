"""SimHash near-duplicates: popcount embedding of fingerprint segments, grid range-join, exact check.

A 64-bit fingerprint is cut into 16 segments of 4 bits; the 16 bit counts (0 to 4) are a
point on an integer grid, packed into one long with a hexadecimal digit each. Flipping a
bit moves one coordinate by one, so the Manhattan distance of two points never exceeds the
bit distance. Two points at distance 2 or less share a grid cell once each is entered in its own
cell and in those one step away, so an equi-join on cells finds every pair; the bit
distance is then checked inside the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxmix.llm import batches as B
from ctxmix.llm.components import components
from ctxmix.llm.tables import fresh
from ctxmix.operators.skew import lookup
from ctxmix.session import materialize

SHINGLE, MAX_BITS, SEED = 3, 2, 42
#: Shingle hashes whose bits are counted at a time, and text bytes of a slice: shingles take about thirty times that.
_CHUNK, _SLICE = 1 << 17, 4 << 20


def fingerprints(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The SimHash of each text as an unsigned 64-bit number; 0 for one without words."""
    raw, offsets = B.buffers(texts)
    raw = B.lower_ascii(raw)
    s, e, bounds, space = B.spans(raw, offsets)
    # words joined by single blanks: keep a word's bytes and the first blank after it
    raw[space] = 32
    keep = ~space
    if raw.size:
        keep[1:] |= space[1:] & ~space[:-1]
    place = np.cumsum(keep, dtype=np.int64)
    text, s, e = raw[keep].tobytes(), place[s] - 1, place[e - 1] if len(e) else e
    n = np.diff(bounds)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))  # shingles of a text
    owner = np.repeat(np.arange(len(n)), count)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + bounds[:-1][owner]
    last = np.minimum(first + shingle, bounds[1:][owner]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[i:j], seed) for i, j in zip(s[first].tolist(), e[last].tolist())), np.uint64, len(owner))
    ones = np.zeros((len(n), 64), np.int64)
    for at in range(0, len(h), _CHUNK):
        bits = np.unpackbits(h[at:at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[at:at + _CHUNK]
        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        ones[own[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    major = ones * 2 > count[:, None]
    return np.packbits(major, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprint_table(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long."""
    return B.add_columns(documents, "text", ["doc_id"], [T.StructField("fp", T.LongType())],
                         lambda: lambda texts: [fingerprints(texts, shingle, seed).view(np.int64)], _SLICE)


def counts(fp: Column) -> Column:
    """Bit counts of the 16 segments, a hexadecimal digit each."""
    ones = F.lit(0x1111111111111111)
    return sum((F.shiftrightunsigned(fp, k).bitwiseAND(ones) for k in (1, 2, 3)), fp.bitwiseAND(ones))


def links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) of representatives whose fingerprints differ in at most ``max_bits`` (2 or 1) bits.

    ``classes`` holds each fingerprint once, with ``rep``. Pairs are checked as the join
    streams them; only links leave it. A pair in the same cell is taken there alone, so
    it is not found again in the 32 cells around.

    The join is a sort-merge join whatever its tables' estimates are: Spark sizes the up to 33 rows of a fingerprint like the
    one they were exploded from, and would broadcast them through the driver.
    """
    if not 1 <= max_bits <= 2:
        raise ValueError("cells one step away find pairs of at most 2 bits")
    point = classes.select("fp", "rep", counts(F.col("fp")).alias("p"))
    near = []
    for i in range(16):
        unit, digit = 1 << (4 * i), F.shiftrightunsigned("p", 4 * i).bitwiseAND(F.lit(15))
        near += [F.when(digit < 4, F.col("p") + F.lit(unit)), F.when(digit > 0, F.col("p") - F.lit(unit))]
    entered = point.select("fp", "rep", "p", F.explode(F.array_compact(F.array(F.col("p"), *near))).alias("cell"))
    x, y = entered.alias("x"), entered.alias("y")
    same = F.col("x.p") == F.col("y.p")
    return x.join(
        y.hint("merge"), (F.col("x.cell") == F.col("y.cell")) & (F.col("x.rep") < F.col("y.rep"))
        & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits)
        & (~same | (F.col("x.cell") == F.col("x.p")))).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def simhash(documents: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for every row.

    Equal fingerprints are one class, represented by the smallest doc_id; links between
    classes and their components are found on representatives only, so copies are never
    expanded into pairs. Null and wordless texts have fingerprint zero and link like any other.
    Components are of fingerprints, so rows that share a doc_id are linked only if their texts are near; a component's
    id is the smallest doc_id of its rows, null if none has one. Repeated rows come back as often as given.
    """
    fps = materialize(fingerprint_table(documents, shingle, seed), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")).withColumn("rep", F.col("fp")), "classes")
    found = components(links(classes, max_bits))
    member = classes.join(found, classes.rep == found.node, "left").select("fp", "size", "least", F.coalesce("component", "rep").alias("component"))
    ids = member.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = member.join(ids, "component").select("fp", "size", "component_id")
    return lookup(fps, facts, "fp", "size").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component, with all columns: that of its smallest doc_id, before rows without an id.

    Components are of fingerprints, so rows that share a doc_id are copies only if their texts are
    near. Of rows with the smallest id, the smallest fingerprint and row hash stay; of rows alike in all
    columns, one.
    """
    row, own, stay_, id_ = (fresh(documents, c) for c in ("__row", "__own", "__stay", "__id"))
    # maps cannot be hashed, their JSON can
    hashed = F.xxhash64(*[F.to_json(documents[f.name]) if "map<" in f.dataType.simpleString() else documents[f.name] for f in documents.schema])
    given = documents.select("doc_id", "text", hashed.alias("row"))
    fps = materialize(B.add_columns(given, "text", ["doc_id", "row"], [T.StructField("fp", T.LongType())],
                                    lambda: lambda texts: [fingerprints(texts, shingle).view(np.int64)], _SLICE), "fingerprints")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "row")
    classes = materialize(fps.groupBy("fp").agg(F.min(best).alias("best")).withColumn("rep", F.col("fp")), "classes")
    found = components(links(classes, max_bits))
    stay = (classes.join(found, classes.rep == found.node, "left").groupBy(F.coalesce("component", "rep"))
            .agg(F.min("best").alias("b")).select(F.col("b.row").alias(stay_), F.coalesce("b.doc_id", F.lit(0)).alias(id_)))
    rows = documents.select("*", hashed.alias(row), F.coalesce("doc_id", F.lit(0)).alias(own))
    kept = rows.join(stay, (F.col(row) == F.col(stay_)) & (F.col(own) == F.col(id_)))
    return kept.dropDuplicates([row, own]).drop(row, own, stay_, id_)
