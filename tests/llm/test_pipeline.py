"""The pipeline stage by stage, and the library without its corpus part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from tests.llm.test_near_dedup import plain
from tidewarden.llm import decontaminate, mixing, quality_rules
from tidewarden.llm.common import read, written
from tidewarden.llm.near_dedup import Rule

SF = "/root/testdata/sf0.001"
ROOT = Path(corpus_pipeline.__file__).parent


@pytest.fixture(scope="module")
def stages(spark):
    docs = read(spark, SF, "documents")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(written(f(spark, out[-1], SF), name))
    return out


def test_each_stage_does_its_work_on_what_came_before(spark, stages):
    raw, good, single, clean, mixed, tokens = stages
    assert all(s.columns == raw.columns for s in (good, single, clean, mixed))
    rows = [{(r.doc_id, r.text): 0 for r in s.collect()} for s in stages[:5]]
    assert set(rows[0]) > set(rows[1]) > set(rows[2]) > set(rows[3]) >= set(rows[4])
    kept = {r.doc_id for r in quality_rules.judge(raw).filter("kept").collect()}
    assert {i for i, _ in rows[1]} == kept
    comp = plain(list(rows[1]), Rule(5, 80))
    assert {i for i, _ in rows[2]} == {i for i, (_, c) in comp.items() if i == c}
    leaked = {r.doc_id for r in decontaminate.overlaps(single, read(spark, SF, "benchmark")).collect()}
    assert leaked and {i for i, _ in rows[3]} == {i for i, _ in rows[2]} - leaked
    plan = {r.doc_id: r.epochs + r.in_part for r in mixing.plan(clean).collect()}
    taken = [r.doc_id for r in mixed.collect()]
    assert {i: n for i, n in plan.items() if n} == {i: taken.count(i) for i in taken}
    assert sorted(r.doc_id for r in tokens.collect()) == sorted(taken)


def test_run_gives_the_last_stage(spark, stages):
    key = lambda df: sorted(tuple(r) for r in df.select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[-1])


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_tables_and_odd_rows(spark, k):
    docs = read(spark, SF, "documents")
    _, f = corpus_pipeline.STAGES[k]
    assert f(spark, docs.limit(0), SF).count() == 0
    odd = [(None, None, None, None, None), (None, "", None, "s", 0), (1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3)]
    named = spark.createDataFrame(odd, docs.schema).selectExpr("*", "1 AS _row", "2 AS key", "3 AS n", "4 AS kept")
    got = f(spark, named, SF)
    assert got.count() <= 8 and (k == 4 or got.columns == named.columns)


def test_everything_else_works_without_the_corpus_part(tmp_path):
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "*.json")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    n, *rest = out.stdout.split()
    assert int(n) >= 142 and rest == ["False", "False"]
    named = [p for p in ROOT.rglob("*.py") if "llm" not in p.relative_to(ROOT).parts and p.name != "corpus_pipeline.py"]
    users = [p.name for p in named if "tidewarden.llm" in p.read_text()]
    assert users == ["__spark_entry__.py"]
