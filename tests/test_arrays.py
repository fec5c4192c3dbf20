"""Top-level arrays read in ranges: the same records as a JSON parser, wherever the cuts fall."""

import json
import random

import pytest

from ctxmix.sources import arrays as A
from ctxmix.sources import io as IO


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at:at + n]


def value(rnd, depth=0):
    kind = rnd.randrange(6)
    if depth > 2 or kind < 3:
        return "".join(rnd.choice('ab"\\[]{},: é\n') for _ in range(rnd.randrange(9)))
    if kind == 3:
        return rnd.choice([None, True, -1.5, 7])
    if kind == 4:
        return [value(rnd, depth + 1) for _ in range(rnd.randrange(4))]
    return {f"k{i}": value(rnd, depth + 1) for i in range(rnd.randrange(4))}


@pytest.mark.parametrize("seed", range(5))
def test_any_cut_of_any_array(monkeypatch, seed):
    rnd = random.Random(seed)
    monkeypatch.setattr(A, "_BLOCK", 5 + seed)
    for _ in range(150):
        given = [value(rnd) for _ in range(rnd.randrange(8))]
        data = rnd.choice(["", " \n", "\ufeff"]).encode() + json.dumps(given, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 1])).encode() + b" \n"
        file, split = Bytes(data), rnd.randrange(1, 40)
        odd = depth = 0
        got = []
        for start in range(0, len(data), split):
            end = min(start + split, len(data))
            o, outside, inside, lone = A.summary(file, start, end)
            assert not lone
            got += list(A.elements(file, start, end, len(data), bool(odd), depth))
            depth, odd = depth + (inside if odd else outside), (odd + o) % 2
        assert [json.loads(v) for _, v in got] == given and [a for a, _ in got] == sorted({a for a, _ in got})
        assert depth == odd == 0


def test_one_file_by_many_tasks(spark, tmp_path):
    rows = [{"doc_id": i // 2, "title": f't "{i}" \\', "text": "[x], {y} \\\\" * (i % 9) + "\n"} for i in range(2000)]
    (tmp_path / "one.json").write_text(json.dumps(rows))
    (tmp_path / "lines.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    found = A.array_elements(spark, f"{tmp_path}/one.json", 10_000)
    from pyspark.sql import functions as F
    assert found.select(F.spark_partition_id()).distinct().count() > 4
    assert [json.loads(r["value"]) for r in found.orderBy("at").collect()] == rows
    arrays, lines = (sorted(map(tuple, IO.read_passages(spark, f"{tmp_path}/{n}", f, split=10_000).collect())) for n, f in (("one.json", "json_array"), ("lines.jsonl", "json_lines")))
    assert arrays == lines and len(arrays) == 1000


def test_odd_files(spark, tmp_path):
    for name, text in (("empty.json", ""), ("none.json", " [ ] "), ("object.json", '{"doc_id": 1, "text": "o, [1]"}'), ("one.json", '[{"doc_id":2,"text":null}]'),
                       ("cut.json", '[{"doc_id": 3, "text": "x"}, {"doc_id": 4, "text": "y"}'), ("null.json", "[null, 5]")):
        (tmp_path / name).write_text(text)
    got = IO.read_passages(spark, str(tmp_path), split=8).where("doc_id is not null").collect()
    assert sorted((r["doc_id"], r["title"], r["text"]) for r in got) == [("1", "", "o, [1]"), ("2", "", ""), ("3", "", "x"), ("4", "", "y")]
    assert IO.read_questions(spark, f"{tmp_path}/none.json").count() == 0
