"""Every stage takes effect, keeps the columns of documents and hands on what it kept."""

from quern.llm import exact_dedup, language, near_dedup, quality
from tests.conftest import DATA


def test_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "exact dedup", "near dedup", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    columns, ids = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, DATA)
        assert docs.columns == columns
        ids = sorted(r[0] for r in docs.select("doc_id").collect())
        want = {
            "quality": lambda b: quality.classify(b, quality.learn(b, labels)).filter("predicted = 1"),
            "language": lambda b: language.identify(b, language.learn(b)).filter("NOT ambiguous"),
            "exact dedup": lambda b: exact_dedup.decisions(b).filter("kept"),
            "near dedup": lambda b: near_dedup.near_duplicates(b).filter("kept"),
        }[name](before)
        assert ids == sorted(r[0] for r in want.select("doc_id").collect())
    packed = corpus_pipeline.run(spark, DATA)
    assert sorted({r[0] for r in packed.select("doc_id").collect()}) == ids


def test_the_rest_stands_without_this_part():
    import pathlib
    import subprocess
    import sys
    import tempfile

    root = pathlib.Path(__file__).resolve().parents[2]
    with tempfile.TemporaryDirectory() as d:
        for p in root.rglob("*.py"):
            rest = p.relative_to(root)
            if "llm" not in rest.parts and rest.name != "corpus_pipeline.py" and ".git" not in rest.parts:
                (pathlib.Path(d) / rest).parent.mkdir(parents=True, exist_ok=True)
                (pathlib.Path(d) / rest).write_text(p.read_text())
        out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), sorted(e.oracle_sql())[:1])"], cwd=d, capture_output=True, text=True, env={"PATH": "/usr/bin", "PYTHONPATH": d})
        assert out.returncode == 0, out.stderr
        assert int(out.stdout.split()[0]) > 80
