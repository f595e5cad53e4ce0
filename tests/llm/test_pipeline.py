import os
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import pytest
from graphloom.llm import decontam, pii, quality
from graphloom.llm.queries import tokenizer

from .conftest import edited, prose
from .test_chosen_path import brute

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    docs = [(k, prose(k, 60), "en", "s", 1) for k in range(300)]
    docs += [(300 + k, edited(prose(k, 60), k, 1), "en", "s", 1) for k in range(30)] + [(0, prose(0, 60), "en", "s", 1)]
    docs += [(600 + k, prose(k + 5000, 50) + f" mail u{k}@example.com", "en", "s", 1) for k in range(40)]
    docs += [(400 + k, prose(k + 900, 60).upper().replace(" ", "!! "), "en", "s", 1) for k in range(60)]
    docs += [(500, prose(3000, 30) + " " + prose(7777, 40) + ". " + prose(3001, 30), "en", "s", 1), (501, prose(4000, 50) + " mail a.b@example.com", None, None, None), (502, None, "en", "s", 0), (503, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 300, 2)] + [(600 + k, 1, 0) for k in range(0, 40, 2)] + [(400 + k, 0, 0) for k in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, prose(7777, 40))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{sf_dir}/{name}")
        docs = spark.read.parquet(f"{sf_dir}/{name}")
        after = [tuple(r) for r in docs.collect()]
        if name != "packing":
            assert docs.columns == columns
        if name == "quality":
            rejected = {r["doc_id"] for r in quality.score(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long"), spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 0").collect()}
            assert sorted(after, key=repr) == sorted((r for r in before if r[0] not in rejected), key=repr)
            assert sum(r[0] < 300 for r in after) >= 295 and not any(400 <= r[0] < 460 for r in after)
        elif name == "near_duplicates":
            component = brute([(r[0], r[1]) for r in before], 5, 80)
            assert sorted(after, key=repr) == sorted({r for r in before if component[r[0]] == r[0]}, key=repr)
            assert not any(300 <= r[0] < 330 for r in after)
        elif name == "decontamination":
            assert {r[0] for r in before} - {r[0] for r in after} == {500}
        elif name == "personal_data":
            text = {r[0]: r[1] for r in after}
            assert text[501].endswith("mail <EMAIL>")
            assert all(text[r[0]] == r[1] for r in before if not pii.candidates(r[1] or "")[0] and not pii.candidates(r[1] or "")[1])
        else:
            from tokenizers import Tokenizer

            plain = Tokenizer.from_file(tokenizer())
            assert sum(r["length"] for r in docs.collect()) == sum(len(plain.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in before)
    assert decontam.terms_of(None) == []


def test_odd_rows_in_every_stage(spark, sf_dir):
    """Columns named like those used inside, null ids, ids that repeat with other texts, empty and very long texts: each stage
    keeps all columns and takes away what it should, row by row."""
    junk, good = prose(905, 60).upper().replace(" ", "!! "), [prose(20 + k, 60) for k in range(6)]
    leak = good[3] + " " + prose(7777, 40) + ". " + prose(3001, 30)
    rows = [(None, good[0]), (None, junk), (7, good[1]), (7, junk), (7, good[2]), (8, None), (9, ""), (10, prose(31, 60_000)), (None, leak), (11, leak), (11, good[4]), (12, good[5]), (12, good[5]), (None, good[0])]
    names = ["doc_id", "text", "lang", "source", "n_chars", "rejected_id", "dropped_id", "leaking_id", "row_id", "ROW_TEXT", "text_hash", "__copy", "a.b", "item_id"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names[5:])
    docs = spark.createDataFrame([(i, t, None, "s", k, *("v" for _ in names[5:])) for k, (i, t) in enumerate(rows)], schema)
    whole = docs.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet"), allowMissingColumns=True)
    left = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.where("source = 's' AND item_id = 'v'").collect()), key=repr)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, whole, sf_dir)
    assert kept.columns == names and [r for r in left(kept) if r[1]] == sorted((r for r in rows if r[1] and r[1] != junk), key=repr)
    one = stages["near_duplicates"](spark, docs, sf_dir)
    assert one.columns == names and one.where("`a.b` = 'v'").count() == one.count()
    # of rows that repeat an id with equal text, or a text without id, one stays
    assert left(one) == sorted([r for k, r in enumerate(rows) if k not in (12, 13)], key=repr)
    clean = stages["decontamination"](spark, docs, sf_dir)
    assert clean.columns == names and left(clean) == sorted((r for r in rows if r[1] != leak), key=repr)
    masked = stages["personal_data"](spark, docs, sf_dir)
    assert masked.columns == names and masked.count() == len(rows)
    packed = stages["packing"](spark, docs, sf_dir)
    assert packed.where("start = 0").count() == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0, name


def test_run_and_empty_table(spark, sf_dir, tmp_path):
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.where("doc_id = 501").count() >= 1
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_works_without_the_pipeline(tmp_path):
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries()) and 'pipeline' not in e.queries()"
    (tmp_path / "graphloom").symlink_to(ROOT / "graphloom")
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}  # which may hold the folder of the real pipeline
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
