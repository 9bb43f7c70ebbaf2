import subprocess
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline
from kindred import storage
from kindred.llm import secrets

from .conftest import SF
from .test_duplicates_and_shards import brute
from .test_scoring_and_packing import check_pieces, ids_of
from .test_texts import brute_repeats


def test_stages_by_brute_force(spark, documents):
    docs, stages = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        out = storage.saved(stage(spark, docs, SF), "stage")
        if name != "packing":
            assert out.columns == documents.columns
            stages[name] = {r.doc_id: r for r in out.collect()}
        docs_before, docs = docs, out
    every = {r.doc_id: r for r in documents.collect()}
    quality = stages["quality rules"]
    for i, r in every.items():
        if r.text is None or len(r.text) < 2500:
            b = brute_repeats(r.text, 10)
            good = b["n_words"] >= 50 and 100 * b["n_repeat_words"] <= 50 * b["n_words"] and b["covered_words"] <= 0.4 * b["n_words"] and b["longest_repeat"] <= 200
            assert (i in quality) == good
    component, _ = brute([(i, r.text) for i, r in quality.items()], 5)
    assert stages["near-dedup"].keys() == {i for i in quality if component[i] == i}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, r in stages["near-dedup"].items() if not any(t in r.text for t in items)}
    assert stages["decontamination"].keys() == clean < stages["near-dedup"].keys()
    last = stages["secret scan"]
    assert last.keys() == clean
    for i, r in last.items():
        before = every[i].text
        found = secrets.base_spans(before) + secrets.lexed_spans(before, 0.5)
        assert (r.text == before) == (not found) and not secrets.base_spans(r.text) and r.n_chars == (len(r.text) if found else every[i].n_chars)
    check_pieces(docs.collect(), ids_of([(i, r.text) for i, r in last.items()]))
    assert docs_before is not None


def test_run_is_the_stages(spark, edge, empty):
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.count() > 0 and "sequence_id" in pieces.columns
    docs, none = edge, empty
    for name, stage in corpus_pipeline.STAGES:
        docs, none = stage(spark, docs, SF), stage(spark, none, SF)
    ids = Counter(r.doc_id for r in docs.collect())
    assert none.count() == 0 and ids and not {1, 2, 3, 4} & ids.keys()


def test_the_rest_works_without_these_folders(tmp_path):
    """The entry point of a copy without this subpackage has the other queries."""
    import shutil

    root = Path(corpus_pipeline.__file__).parent
    shutil.copytree(root / "kindred", tmp_path / "kindred", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op1_') for k in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert said.stdout.split()[-1] == "False" and int(said.stdout.split()[-2]) > 80
