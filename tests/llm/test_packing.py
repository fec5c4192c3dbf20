"""Token ids against the library, cuts, and valid gapless packings."""
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from ctxmix.llm import packing as K


@pytest.fixture(scope="module")
def file():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(file):
    return Tokenizer.from_str(file.decode())


@pytest.mark.parametrize("ranked", [True, False])
def test_ids(file, library, texts, sf_dir, ranked):
    encoder = K.Encoder(file)
    assert encoder.ranked is not None
    encoder.ranked = encoder.ranked if ranked else None
    column = pa.array(texts + ["a   b", "x\n\n\n y ", "don't 'S it's", "1,000.50--ok…,,", " .a .1"] + pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()[:100])
    ids, bounds = encoder(column)
    for i, t in enumerate(column.to_pylist()):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids


def check(rows, documents, library, limit, end=2):
    """Every document's pieces in order, cut as asked, and every sequence gapless within the limit."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for d, t in documents:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [end], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.length <= limit and (r.length == limit or k == 0)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids) and (len(ids) > limit or len(by_doc[d]) == 1)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit
    return len(by_sequence)


def test_query(spark, sf_dir, library):
    from ctxmix.llm.queries import op7_packing

    t = pq.read_table(f"{sf_dir}/documents.parquet")
    rows = op7_packing(spark, sf_dir).collect()
    n = check(rows, list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist())), library, K.LIMIT)
    sizes = np.array([r.length for r in rows if r.length < K.LIMIT])
    assert n - (len(rows) - len(sizes)) <= best_fit_sequences(sizes, K.LIMIT)  # no worse than best fit by falling size


def best_fit_sequences(sizes, limit):
    """Sequences of best fit by falling size over all pieces of the table."""
    greedy = np.zeros(len(sizes), int)
    K.best_fit([], sizes, np.argsort(-sizes, kind="stable"), greedy, 0, limit)
    return int(greedy.max()) + 1


def test_several_blocks_and_islands(spark, sf_dir, file, library):
    """Some twenty small blocks on several levels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = docs.toPandas()
    rows = K.pack(docs, file, limit=256, block=5, islands=3, epochs=2).collect()
    n = check(rows, list(zip(t.doc_id, t.text)), library, 256)
    short = np.array([r.length for r in rows if r.length < 256])
    assert n - (len(rows) - len(short)) <= 1.05 * best_fit_sequences(short, 256)
    assert len({(-1 - r.sequence_id) >> 57 for r in rows if r.length < 256}) >= 3


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_of_the_default_size(spark, seed):
    """Four blocks, two or three levels: no more than one sequence above best fit over the whole table."""
    sizes = np.random.default_rng(seed).gamma(1.2, 420, 22_000).astype(int) % (K.LIMIT - 1) + 1
    items = spark.createDataFrame(list(enumerate(sizes.tolist())), "uid long, length long").repartition(4)
    rows = K.place(items).collect()
    assert sorted(r.uid for r in rows) == list(range(len(sizes)))
    fill = defaultdict(int)
    for r in rows:
        fill[r.level, r.block, r.best] += r.length
    assert max(fill.values()) <= K.LIMIT and len({r.block for r in rows if r.level == 0}) > 3
    assert len(fill) <= best_fit_sequences(sizes, K.LIMIT) + 1


def test_rows(docs, no_docs, file, library):
    rows = K.pack(docs, file, limit=64).collect()
    single = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in (None, 1)]
    assert len([r for r in rows if r.doc_id == 1]) == 2  # the repeated row is packed twice
    check(rows, [], library, 64)
    by_doc = defaultdict(int)
    for r in rows:
        by_doc[r.doc_id] += r.length
    for d, t in single:
        assert by_doc[d] == len(library.encode(t or "", add_special_tokens=False).ids) + 1
    assert by_doc[None] > 0 and K.pack(no_docs, file).count() == 0


def test_genetic_steps():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 1024, 300)
    a, b = (K.evolve(sizes, [], s, 3, 2, 1024) for s in (1, 2))
    for _ in range(20):
        child = K.crossover(sizes, a, b, rng, 1024)
        assert len(child) == 300 and np.bincount(child, sizes).max() <= 1024
        assert set(child) == set(range(child.max() + 1))
        a, b = b, child
    best = K.evolve(sizes, [a, b], 3, 4, 10, 1024)
    assert K.fitness(sizes, best, 1024) >= max(K.fitness(sizes, x, 1024) for x in (a, b))
    assert K.evolve(np.array([], np.int64), [], 1, 2, 2, 1024).tolist() == []
