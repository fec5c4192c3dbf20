"""Counts against the library; the shortcut holds only proved strings."""
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ctxmix.llm import token_counts as tc


@pytest.fixture(scope="module")
def file():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def counter(file):
    return tc.Counter(file)


@pytest.fixture(scope="module")
def library(file):
    return Tokenizer.from_str(file.decode())


def size(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_proof(counter, library):
    some = sorted(counter.proved)[::50]
    assert len(counter.proved) > 20000 and all(size(library, s) == 1 for s in some)


def test_odd_texts(counter, library, texts):
    assert counter(pa.array(texts)).tolist() == [size(library, t) for t in texts]


def test_all_documents(counter, library, sf_dir):
    column = pq.read_table(f"{sf_dir}/documents.parquet")["text"].combine_chunks()
    assert counter(column).tolist() == [size(library, t) for t in column.to_pylist()]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("abDLL éÉß😀'stİΣ \n\t  ́\x1c\x8519,.!<|>"), max_size=40))
def test_random_texts(counter, library, text):
    assert counter(pa.array([text], pa.string())).tolist() == [size(library, text)]


def test_rows(docs, no_docs, file, library, texts):
    rows = tc.token_counts(docs, file, limit=20).collect()
    assert len(rows) == len(texts)
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[3].n_bytes, by_id[3].n_tokens, by_id[3].over_limit) == (0, 0, False)
    assert by_id[7].over_limit and by_id[8].n_bytes == len(texts[7].encode())
    assert tc.token_counts(no_docs, file).count() == 0
