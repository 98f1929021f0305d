"""The verifier hook, JSON lines by byte ranges, times of files."""

import json

import pytest

from factloom.plans import verify
from factloom.sources import files, lines

FACT = "id int, canon string, label string, metric string, comparator string, value_low double, value_high double, unit_canon string, quote string, source string"


def facts(spark, n=30):
    rows = [(i, f"c{i % 20}", "Material", "m", "=", float(i % 20), None, "pct", f" q  {i % 20} ", "grammar") for i in range(n)]
    rows += [(100, "c1", None, None, None, None, None, None, None, "grammar"), (101, "c1", None, None, None, 1.0, 2.0, None, None, "vision_ocr"), (102, None, None, None, None, None, 7.0, None, None, None)]
    return spark.createDataFrame(rows, FACT).repartition(3)


def log_of(path):
    return [json.loads(x) for f in sorted(path.glob("*")) for x in f.read_text().splitlines()]


def client(folder, fail_from=99):
    """Refuses even values; fails on batches with a value from `fail_from` on; writes what it was asked."""

    def make():
        import uuid

        name = f"{folder}/{uuid.uuid4().hex}"

        def answer(questions):
            with open(name, "a") as f:
                f.write(json.dumps([q["value"] for q in questions]) + "\n")
            if any(float(q["value"][1:].split("..")[0]) >= fail_from for q in questions):
                raise TimeoutError
            return [{"id": q["id"], "keep": float(q["value"][1:]) % 2 == 1, "reason": "even"} for q in questions if q["value"] != "=3.0"] + ["noise", {"id": 99}]

        return answer

    return make


def test_batches_distinct_contents_and_kept_facts(spark, tmp_path):
    (tmp_path / "log").mkdir()
    got = verify.verified(spark, facts(spark), f"file://{tmp_path}/v", client(tmp_path / "log"), batch=6)
    asked = log_of(tmp_path / "log")
    assert sorted(x for b in asked for x in b) == sorted(f"={float(i)}" for i in range(20)) and max(map(len, asked)) <= 6
    assert {r.id for r in got.collect()} == {i for i in range(30) if i % 20 % 2} | {100, 101, 102}


def test_a_failing_verifier_keeps_facts_and_is_asked_again(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    path = f"file://{tmp_path}/v"
    first = verify.verified(spark, facts(spark), path, client(tmp_path / "one", fail_from=0), batch=4)
    assert first.count() == 33
    second = verify.verified(spark, facts(spark), path, client(tmp_path / "two"), batch=4)
    assert {r.id for r in second.collect()} == {i for i in range(30) if i % 20 % 2} | {100, 101, 102}
    again = verify.verdicts(facts(spark), client(tmp_path / "two"), spark.read.parquet(path))
    assert [r.key for r in again.collect()] != [] and again.count() == 1  # the one that was left out of the answer

    def away():
        raise OSError

    assert verify.kept(facts(spark), verify.verdicts(facts(spark), away)).count() == 33
    assert verify.verdicts(facts(spark).limit(0), away).collect() == []


SCHEMA = "doc_id long, text string, share double, ok boolean, _bad string"


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_every_line_once_at_every_range(spark, tmp_path, size):
    good = [{"doc_id": i, "text": "é" * (i % 30), "share": i if i % 2 else i / 2, "ok": i % 3 == 0, "more": [1]} for i in range(40)]
    bad = ["{", "[1]", '{"doc_id": "x"}', '{"ok": 1}', "null", '{"doc_id": true}']
    body = "\n".join([json.dumps(x, ensure_ascii=False) for x in good[:20]] + ["", "  "] + bad + [json.dumps(x) for x in good[20:]])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(body)
    (tmp_path / "in" / "empty").write_text("")
    (tmp_path / "in" / "_SUCCESS").write_text("x")
    (tmp_path / "in" / "b.jsonl").write_text('{"doc_id": 77}\n\n{"doc_id": 78, "text": null}\n')
    got = lines.json_ranges(spark, f"{tmp_path}/in", SCHEMA, range_bytes=max(size, 40)).collect()
    assert sorted(r.doc_id for r in got if r._bad is None) == [*range(40), 77, 78]
    assert sorted(r._bad for r in got if r._bad is not None) == sorted(bad)
    one = next(r for r in got if r.doc_id == 31)
    assert (one.text, one.share, one.ok) == ("é", 31.0, False)


def test_ranges_of_one_byte(spark, tmp_path):
    (tmp_path / "f").write_text('{"doc_id": 1}\n{"doc_id": 2}')
    assert [r.doc_id for r in lines.json_ranges(spark, f"file:{tmp_path}/f", "doc_id long", range_bytes=1).orderBy("doc_id").collect()] == [1, 2]


def test_the_last_line_of_a_key_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1").write_text('{"doc_id": 1, "text": "a"}\n{"doc_id": 2, "text": "a"}\n{"doc_id": 1, "text": "b"}\n{"text": "no key"}\n')
    (tmp_path / "in" / "2").write_text('{"doc_id": 2, "text": "c"}\nbroken\n')
    got = lines.json_ranges(spark, f"{tmp_path}/in", "doc_id long, text string", "doc_id", range_bytes=10)
    assert sorted(map(tuple, got.collect())) == [(1, "b"), (2, "c")]
    (tmp_path / "none").mkdir()
    assert lines.json_ranges(spark, f"{tmp_path}/none", "doc_id long").collect() == []
    with pytest.raises(Exception, match="not read"):
        lines.json_ranges(spark, f"{tmp_path}/in", "doc_id array<int>").collect()


def test_times_of_files(spark, tmp_path):
    (tmp_path / "f").write_text("x")
    assert abs(files.modified_at(spark, f"file://{tmp_path}/f") - (tmp_path / "f").stat().st_mtime) < 2
    assert files.modified_at(spark, f"file://{tmp_path}/none") is None
