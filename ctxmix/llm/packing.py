"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids, ids are cut into pieces of at most ``limit``. Pieces of the full
length are sequences of their own. The rest is dealt by a hash into blocks of about as many tokens;
each block is evolved on several islands (tasks of their own), whose elites move to the
next island between epochs.

A block ends with sequences that are not full. So these sequences of all blocks are
opened (at most half of a block's, the worst-filled ones), their pieces are dealt into fewer blocks and evolved again, and so
on until one block is left: what is missing to full sequences is gathered in that one, whatever the number of blocks.

An individual is a partition of a block's pieces into bins. Crossover injects the well-filled
bins of one parent into the other, removes the bins that hold duplicates of their pieces, and puts the
displaced pieces back by best fit.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxmix.llm import batches as B
from ctxmix.session import materialize, ship_code

LIMIT, END = 1024, 2
#: The split pattern of the byte-level vocabularies (a fixed value of their format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Full sequences in a block's tokens, islands and epochs, individuals and generations of an epoch.
BLOCK, ISLANDS, EPOCHS, PEOPLE, GENERATIONS = 2000, 2, 2, 6, 6
#: White space beyond ASCII: next to blanks it would be split elsewhere in a part of a text.
_WIDE_SPACE = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PIECE = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "piece", "start", "length", "ids_crc32", "uid")])


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes: printable Latin-1
    characters stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Token ids of whole texts as the tokenizer file gives them, by the different parts of a batch.

    A part is a word with the white space before it, cut where marks begin. The split pattern ends a
    match at each cut, so a text's ids are its parts' ids in a row. Texts with white space
    beyond ASCII, or with a special token's string, go through the library whole. If ids rise in merge order,
    a part's merges are done by rank, which gives the same ids without building offsets.
    """

    def __init__(self, file: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_str(file.decode())
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        model, back = json.loads(file)["model"], byte_letters()
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        self.ranked = None
        if merged == sorted(merged):
            ranks = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
            self.ranked = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit) one after the other, and the bounds of each text's."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, _WIDE_SPACE)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        whole = [self.library.encode(texts[int(i)].as_py(), add_special_tokens=False).ids for i in odd]
        if len(odd):
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            texts = pc.if_else(pa.array(mask), "", texts)
        w = B.cells(texts)
        parts = w.distinct.to_pylist()
        if self.ranked:
            parts = [self.ranked.encode_ordinary(p) for p in parts]
        else:
            parts = [e.ids for e in self.library.encode_batch_fast(parts, add_special_tokens=False)]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter(chain.from_iterable(parts), np.uint32, int(size.sum()))
        base = np.cumsum(size) - size
        n = size[w.codes]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(base[w.codes] - (ends - n), n)]
        bounds = np.append(0, ends)[w.bounds]
        if not len(odd):
            return ids, bounds
        own = [ids[bounds[i]:bounds[i + 1]] for i in range(len(texts))]
        for i, p in zip(odd, whole):
            own[i] = np.asarray(p, np.uint32)
        return np.concatenate(own), np.append(0, np.cumsum([len(p) for p in own]))


def pieces(documents: DataFrame, file: bytes, limit: int = LIMIT, end: int = END) -> DataFrame:
    """One row per piece of every row's ids (with ``end`` behind): all but the first have the full length.

    ``uid`` is unique in the table: task number and place. It is only stable once written, so
    :func:`pack` writes this table before using it.
    """
    ship_code(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(file)

    def run(batches):
        from pyspark import TaskContext

        encoder, uid = None, TaskContext.get().partitionId() << 36
        for batch in batches:
            encoder = encoder or _encoder(shared.value)
            for part in B.slices(batch, "text"):
                ids, bounds = encoder(part.column(1))
                own = part.column(0).to_pylist()
                rows: list[list] = [[] for _ in PIECE.names]
                for i, doc in enumerate(own):
                    one = np.append(ids[bounds[i]:bounds[i + 1]], np.uint32(end)).astype("<u4")
                    cut = [0, *range(len(one) % limit or limit, len(one) + 1, limit)]
                    for k, (a, b) in enumerate(zip(cut, cut[1:])):
                        for column, value in zip(rows, (doc, k, a, b - a, zlib.crc32(one[a:b].tobytes()), uid)):
                            column.append(value)
                        uid += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=PIECE.names)

    return documents.select("doc_id", "text").mapInArrow(run, PIECE)


_ENCODERS: dict[int, Encoder] = {}


def _encoder(file: bytes) -> Encoder:
    """One tokenizer in a worker process, whatever number of tasks it runs."""
    key = zlib.crc32(file)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(file)
    return _ENCODERS[key]


def best_fit(room: list[tuple[int, int]], sizes: np.ndarray, order: np.ndarray, bins: np.ndarray, free: int, limit: int) -> None:
    """Put the pieces in ``order`` each into the fullest bin that has room, else into a new one.

    ``room`` is the sorted list of (free places, bin); ``bins`` is changed in place.
    """
    for i in order:
        size = int(sizes[i])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b, free = limit, free, free + 1
        bins[i] = b
        if left > size:
            insort(room, (left - size, b))


def fitness(sizes: np.ndarray, bins: np.ndarray, limit: int) -> tuple[int, float]:
    """Fewer bins first, then unevenly filled ones (some full, some empty enough to dissolve)."""
    fill = np.bincount(bins, sizes)
    fill = fill[fill > 0]
    return -len(fill), float(((fill / limit) ** 2).mean()) if len(fill) else 0.0


def crossover(sizes: np.ndarray, giver: np.ndarray, taker: np.ndarray, rng: np.random.Generator, limit: int) -> np.ndarray:
    """The giver's well-filled bins (a random half of the better ones) go into the taker whole; the taker's
    bins with one of their pieces are dissolved; what is displaced is put back by best fit."""
    fill = np.bincount(giver, sizes)
    good = np.flatnonzero(fill >= np.median(fill[fill > 0]))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.permutation(good)[:max(1, len(good) // 2)]] = True
    given = chosen[giver]
    broken = np.zeros(taker.max() + 1, bool)
    broken[taker[given]] = True
    fill = np.bincount(taker, sizes)
    broken |= fill < limit * rng.uniform(0.5, 0.9)  # mutation: badly filled bins are dissolved as well
    displaced = np.flatnonzero(broken[taker] & ~given)
    child = np.where(given, giver + len(broken), taker)
    free = int(child.max()) + 1
    placed = ~broken[taker] | given
    used, fill = np.unique(child[placed], return_inverse=True)
    left = limit - np.bincount(fill, sizes[placed]).astype(int)
    room = sorted((int(x), int(b)) for x, b in zip(left, used) if x)
    best_fit(room, sizes, displaced[np.argsort(-sizes[displaced], kind="stable")], child, free, limit)
    return np.unique(child, return_inverse=True)[1]


def evolve(sizes: np.ndarray, elites: list[np.ndarray], seed: int, people: int, generations: int, limit: int) -> np.ndarray:
    """The best individual of one island after an epoch, starting from immigrants and noisy best-fit packings."""
    rng = np.random.default_rng(seed)
    group = [e.copy() for e in elites]
    while len(group) < people:
        noise = 0 if not group else rng.uniform(0, 0.1)
        order = np.argsort(-sizes * (1 + noise * rng.standard_normal(len(sizes))), kind="stable")
        bins = np.zeros(len(sizes), np.int64)
        best_fit([], sizes, order, bins, 0, limit)
        group.append(bins)
    least = -(-int(sizes.sum()) // limit)
    group.sort(key=lambda b: fitness(sizes, b, limit), reverse=True)
    for _ in range(generations):
        if -fitness(sizes, group[0], limit)[0] <= least:
            break  # no packing is better
        a, b = rng.choice(min(len(group), 3), 2, replace=False)
        child = crossover(sizes, group[a], group[b], rng, limit)
        group[-1] = max(child, group[-1], key=lambda x: fitness(sizes, x, limit))
        group.sort(key=lambda x: fitness(sizes, x, limit), reverse=True)
    return group[0]


def evolve_blocks(items: DataFrame, blocks: int, level: int, limit: int, islands: int, epochs: int, people: int, generations: int) -> DataFrame:
    """(block, uid, length, best) of all ``items`` (uid, length): the bin of each in the best individual of its block."""
    schema = "block long, uid array<long>, length array<long>, island int, best array<int>"
    tasks = min(blocks * islands, max(items.sparkSession.sparkContext.defaultParallelism, blocks * islands // 16))
    state = (items.select(F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(blocks)).alias("block"), "uid", "length").groupBy("block")
             .agg(F.array_sort(F.collect_list(F.struct("uid", "length"))).alias("items"))  # bounded: `BLOCK` sequences of tokens
             .select("block", "items.uid", "items.length", F.array().cast("array<array<int>>").alias("elites")))

    def epoch(number: int):
        def run(batches):
            for batch in batches:
                out = []
                for r in batch.itertuples():
                    sizes = np.asarray(r.length, np.int64)
                    elites = [np.asarray(e, np.int64) for e in r.elites]
                    seed = hash((level, int(r.block), int(r.island), number)) & 0x7FFFFFFF
                    best = evolve(sizes, elites, seed, people, generations, limit)
                    out.append((r.block, r.uid, r.length, r.island, best.astype(np.int32)))
                yield pd.DataFrame(out, columns=["block", "uid", "length", "island", "best"])

        return run

    for number in range(epochs):
        # every island of a block starts from the elites of all islands (a ring of two is all of them)
        dealt = state.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)]))).repartition(tasks, "block", "island")
        grown = materialize(dealt.mapInPandas(epoch(number), schema), "islands")
        if number < epochs - 1:
            moved = grown.groupBy("block").agg(F.collect_list(F.struct("island", "best")).alias("e"))
            state = state.select("block", "uid", "length").join(moved, "block").select(
                "block", "uid", "length", F.transform(F.array_sort("e"), lambda x: x["best"]).alias("elites"))
    winner = grown.groupBy("block").agg(F.min_by(
        F.struct("uid", "length", "best"), F.struct(F.array_max("best"), "island")).alias("w")).select("block", "w.*")
    return (winner.select("block", F.posexplode(F.arrays_zip("uid", "length", "best")).alias("at", "i"))
            .select("block", "i.*"))


def place(items: DataFrame, limit: int = LIMIT, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS,
          people: int = PEOPLE, generations: int = GENERATIONS) -> DataFrame:
    """(level, block, best, uid, length) of ``items`` (uid, length): pieces with equal level, block and best are a sequence.

    Each level but the last opens at most half of its sequences (one of a block at least), so levels shrink by half or more.
    """
    settled, level = [], 0
    while True:
        tokens = items.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        blocks = max(1, -(-tokens // (limit * block)))
        placed = evolve_blocks(items, blocks, level, limit, islands, epochs, people, generations).select(F.lit(level).alias("level"), "*")
        if blocks == 1:
            return reduce(DataFrame.unionByName, [*settled, placed])
        own = Window.partitionBy("block")  # a block has about `block` sequences
        fill = placed.groupBy("block", "best").agg(F.sum("length").alias("fill"))
        worst = (fill.withColumn("n", F.row_number().over(own.orderBy("fill", "best"))).withColumn("of", F.count(F.lit(1)).over(own))
                 .where((F.col("n") == 1) | ((F.col("n") <= F.floor(F.col("of") / 2)) & (F.col("fill") < limit))))
        split = materialize(placed.join(worst.select("block", "best", F.lit(True).alias("open")), ["block", "best"], "left"), "level")
        settled.append(split.where("open is null").select(*placed.columns))
        items, level = split.where("open").select("uid", "length"), level + 1


def pack(documents: DataFrame, file: bytes, limit: int = LIMIT, end: int = END, block: int = BLOCK, islands: int = ISLANDS,
         epochs: int = EPOCHS, people: int = PEOPLE, generations: int = GENERATIONS) -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece with the end token. Repeated rows (and rows without an id) are packed
    each; other columns are not read; an empty table gives an empty result.
    """
    table = materialize(pieces(documents, file, limit, end), "pieces")
    full = table.where(F.col("length") == limit).withColumns({"sequence_id": F.col("uid"), "offset": F.lit(0).cast("long")})
    short = table.where(F.col("length") < limit)
    return _offsets(full, short, place(short.select("uid", "length"), limit, block, islands, epochs, people, generations))


def _offsets(full: DataFrame, short: DataFrame, placed: DataFrame) -> DataFrame:
    """Join the bins back to the pieces and place each one behind those before it."""
    w = Window.partitionBy("level", "block", "best").orderBy("uid")  # a bin holds `limit` tokens at most
    where = placed.withColumn("offset", F.sum("length").over(w) - F.col("length")).select(
        F.col("uid"), (-1 - (F.col("level") * F.lit(1 << 57) + F.col("block") * F.lit(1 << 20) + F.col("best"))).alias("sequence_id"), "offset")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    done = short.join(where, "uid").select(*columns)
    return full.select(*columns).unionByName(done).withColumn("piece", F.col("piece").cast("int"))
