"""Random well-formed files against Python's own csv and json modules, whole and cut into splits."""

import csv
import io
import json
import random

import pytest
from conftest import pairs

from chatloom.constants import ANSWER_KEYS, QUESTION_KEYS
from chatloom.sources import datasets
from chatloom.sources.arrays import read_json_array


def random_text(rng, alphabet, longest=12):
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest)))


@pytest.mark.parametrize("whole", [10**9, 0])
def test_csv_like_python(spark, write, splits, whole):
    rng = random.Random(5)
    expected, folder = [], None
    for number in range(6):
        buffer = io.StringIO()
        out = csv.writer(buffer, lineterminator="\n", quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
        out.writerow(["answer", "note", "question"])
        for _ in range(60):
            out.writerow([random_text(rng, 'ab", \n;é') for _ in range(3)])
        path = write(f"d/{number}.csv", buffer.getvalue())
        folder = path.rsplit("/", 1)[0]
        rows = csv.DictReader(io.StringIO(buffer.getvalue()))
        expected += [(r["question"].strip(), r["answer"].strip()) for r in rows]
    assert pairs(datasets.read_csv(spark, folder, "*.csv", whole_file_bytes=whole)) == expected


def random_value(rng, depth=0):
    kinds = ["text", "text", "int", "bool", "null", "empty"] + (["list", "dict"] if depth < 3 else [])
    kind = rng.choice(kinds)
    if kind == "text":
        return random_text(rng, 'ab"\\{}[],: \n\té\U0001f600')
    if kind == "int":
        return rng.randint(-2, 2)
    if kind == "bool":
        return rng.random() < 0.5
    if kind == "list":
        return [random_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    if kind == "dict":
        return {random_text(rng, 'ab"{', 3): random_value(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    return None if kind == "null" else ""


def test_json_arrays_like_python(spark, write, splits):
    rng = random.Random(6)
    expected, folder = [], None
    for number in range(6):
        items = [random_value(rng) for _ in range(80)]
        text = json.dumps(items, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)
        folder = write(f"d/{number}.json", text).rsplit("/", 1)[0]
        expected += items
    for whole in (10**9, 0):
        rows = read_json_array(spark, folder, "*.json", whole_file_bytes=whole, typed=True).orderBy("path", "pos").collect()
        assert [json.loads(r["value"]) for r in rows] == expected


def shown(value):
    """Text of a JSON value as the loader shows it."""
    return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def test_question_answer_like_python(spark, write):
    rng = random.Random(7)
    lines, expected = [], []
    for _ in range(400):
        keys = rng.sample(QUESTION_KEYS + ANSWER_KEYS, rng.randint(1, 6))
        record = {k: random_value(rng, depth=2) for k in keys}
        if any(isinstance(record.get(k), (list, dict)) and record[k] for k in keys):
            record = {k: v if not isinstance(v, (list, dict)) else [] for k, v in record.items()}
        lines.append(json.dumps(record, ensure_ascii=rng.random() < 0.5))
        sides = [next((record[k] for k in names if record.get(k)), "") for names in (QUESTION_KEYS, ANSWER_KEYS)]
        expected.append(tuple(shown(v).strip() for v in sides))
    path = write("a.jsonl", "\n".join(lines))
    assert pairs(datasets.read_qa(spark, path)) == expected
