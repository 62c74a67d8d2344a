"""The stages one after the other on the smallest tables, against brute force, and on odd rows."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from claimgraph.llm import decontamination, near_duplicates
from tests.llm.test_operators import brute_classes, brute_targets, license_words

STAGES = dict(corpus_pipeline.STAGES)
#: Names of columns that operators use or add themselves.
CLASHING = ["x", "id", "row", "rate", "size", "target", "copy", "copy_in", "path_share", "host_share", "quality_p", "quality_keep", "host", "path", "h", "p", "hits", "candidates", "n_words", "source_size", "key", "spans", "start", "component_id", "Rate"]


def test_each_stage_takes_effect(spark, sf_dir):
    docs = corpus_pipeline.read(spark, sf_dir, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "mixing":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.toPandas(), out.schema)
        seen[name] = docs
    assert seen["quality"].count() < corpus_pipeline.read(spark, sf_dir, "documents").count()
    kept = seen["near_duplicates"]
    assert near_duplicates.classes(kept).where("id <> component_id").count() == 0
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontamination.op10(seen["decontamination"], bench).where("contaminated").count() == 0
    assert seen["secrets"].count() == seen["decontamination"].count()
    assert seen["mixing"].count() > 0


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """Labels and benchmark of a few rows, null ones among them."""
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(2, 0), (5, 1), (None, 1), (6, None)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "leak " * 3 + "of the benchmark item that nobody may see here"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


LONG = "the quick brown fox jumps over it " * 4000
ROWS = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, "one two three four five six seven", "en", "s", 32), (3, "one two three four five six seven", "en", "s", 32), (4, "one two three four five six seven", None, "t", 32),
    (None, "nobody has named this text of several words", "en", None, 43), (None, "nobody has named this text of several words", "en", None, 43), (None, None, None, None, None), (5, LONG, "en", "s", len(LONG)), (6, LONG + "end", "en", "t", len(LONG) + 3), (7, " \t\n", "en", "t", 3), (8, "x leak leak leak of the benchmark item that nobody may see here y", "en", "s", 60), (9, "mail password=hunter2hunter now", "en", "u", 31),
]


def wide(spark, rows):
    extra = CLASHING[:-1]  # Spark tells no two names apart by case alone
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    return spark.createDataFrame([(*r, *(f"{c}{i}" for c in extra)) for i, r in enumerate(rows)], schema)


def expected(name, rows):
    """Places of the rows that a stage keeps."""
    if name == "near_duplicates":  # one of 3, 3 and 4; one of the nameless; 5 of 5 and 6
        return [0, 1, 2, 5, 7, 8, 10, 11, 12], {2, 3}, {5, 6}
    if name == "decontamination":
        return [i for i in range(len(rows)) if i != 11], None, None
    return list(range(len(rows))), None, None


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_odd_rows(spark, odd_dir, name):
    """Nulls in any column, empty and very long texts, repeated rows, rows without an id, columns of clashing names."""
    docs = wide(spark, ROWS)
    out = STAGES[name](spark, docs, odd_dir)
    assert len(out.columns) == len({c.lower() for c in out.columns})
    got = out.collect()
    if name == "mixing":
        assert out.columns[-4:] == ["size", "target", "rate", "copy"] and "rate_in" in out.columns and "copy_in_in" in out.columns
        assert {r.doc_id for r in got} <= {r[0] for r in ROWS}
        return
    assert out.columns == docs.columns
    places = [int(r["x"][1:]) for r in got]
    assert all(r[c] == f"{c}{i}" for r, i in zip(got, places, strict=True) for c in CLASHING[:-1])
    if name == "quality":
        assert len(places) == len(set(places)) <= len(ROWS)
        return
    keep, one, other = expected(name, ROWS)
    swap = lambda i: min(s) if (s := next((s for s in (one, other) if s and i in s), None)) else i
    assert sorted(map(swap, places)) == keep
    if name == "secrets":
        texts = {i: r.text for r, i in zip(got, places, strict=True)}
        assert texts[12] == "mail [SECRET] now" and texts[0] is None and texts[1] == "" and texts[8] == LONG
        assert {i: r.n_chars for r, i in zip(got, places, strict=True)}[12] == len("mail [SECRET] now")


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_an_empty_table(spark, odd_dir, name):
    assert STAGES[name](spark, wide(spark, ROWS).limit(0), odd_dir).count() == 0


def test_later_stages_equal_brute_force(spark, tmp_path):
    """Near duplicates, leaks, secrets and the mixture over made documents, each against plain Python over all of them."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(200)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([4, 12, 25])))) for i in range(6)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows, bases = [], [rng.choices(words, k=rng.randint(8, 120)) for _ in range(30)]
    for i in range(160):
        body = list(rng.choice(bases)) if i % 2 else rng.choices(words, k=rng.randint(1, 150))
        for _ in range(rng.choice([0, 0, 1, 3])):
            body[rng.randrange(len(body))] = rng.choice(words)
        if i % 9 == 0:
            body += items[i % 6][1].split()
        if i % 7 == 0:
            body.insert(0, f"token={'abc' * rng.randint(2, 9)}")
        rows.append((i, " ".join(body), "en", rng.choice(["a", "a", "a", "b", None]), len(" ".join(body))))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    kept = corpus_pipeline.keep_distinct(spark, docs, str(tmp_path))
    classes = brute_classes([r[:2] for r in rows])
    left = [r for r in rows if classes[r[0]][1] == r[0]]
    assert sorted(map(tuple, kept.collect())) == left

    def leaks(text):
        w = license_words(text)
        for _, item in items:
            v = license_words(item)
            k = min(10, len(v))
            windows = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}
            if any(tuple(w[j : j + k]) in windows for j in range(len(w) - k + 1)):
                return True
        return False

    unseen = corpus_pipeline.keep_unseen(spark, spark.createDataFrame(left, docs.schema), str(tmp_path))
    left = [r for r in left if not leaks(r[1])]
    assert sorted(map(tuple, unseen.collect())) == left and len(left) < len(kept.collect())

    clean = corpus_pipeline.without_secrets(spark, spark.createDataFrame(left, docs.schema), str(tmp_path))
    left = [(*r[:1], t := re.sub(r"token=[a-z]{6,}", "[SECRET]", r[1]), *r[2:4], len(t)) for r in left]
    assert sorted(map(tuple, clean.collect())) == left

    mixed = corpus_pipeline.mixture(spark, spark.createDataFrame(left, docs.schema), str(tmp_path)).collect()
    sizes, taken = Counter(), Counter()
    for r in left:
        sizes[r[3]] += len(r[1].split())
    copies = defaultdict(list)
    for r in mixed:
        taken[r.source] += r["size"]
        copies[r.doc_id].append(r["copy"])
    want = brute_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] for s in sizes)
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= 3 for c in copies.values())
