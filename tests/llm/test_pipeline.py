"""The pipeline's stages, one after another, against brute force."""

import base64
import os
import re
import uuid

import duckdb
import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from pactum.llm import language_id, mixing, pipeline_stages, registry
from pactum.plans.session import shared_folder

from ..conftest import SMALL
from ..test_oracle import rows_of
from .conftest import SCHEMA
from .test_copies import plain_components


def library():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain_pipeline(rows):
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    best = {}
    for r in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", r[1])
        if norm not in best or (-len(r[1]), r[0]) < (-len(best[norm][1]), best[norm][0]):
            best[norm] = r
    rows = list(best.values())
    component = plain_components(rows)
    return [r for r in rows if component[r[0]][1] == r[0]]


def staged(spark, docs):
    folder = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/{number}-{name}"
        out = stage(spark, docs, SMALL)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def test_pipeline(spark, docs, rows):
    own = library()
    wanted = {r[0]: own.encode_ordinary(r[1]) for r in plain_pipeline(rows)}
    result = staged(spark, docs).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in result} == wanted
    label = {r[0]: r[2] for r in rows}
    predicted = {r["doc_id"]: r["lang_pred"] for r in language_id.language_report(docs).collect()}
    assert {r["doc_id"]: r["lang"] for r in result} == {k: label[k] or predicted[k] for k in wanted}


def test_the_order_of_the_mix_survives_the_reread(spark, docs, rows):
    kept = plain_pipeline(rows)
    mix = [r["doc_id"] for r in mixing.mixed(spark.createDataFrame(kept, SCHEMA)).collect()]
    found = staged(spark, docs.repartition(7)).select("doc_id", "position").collect()
    assert sorted(r["position"] for r in found) == list(range(len(kept)))
    assert [r["doc_id"] for r in sorted(found, key=lambda r: r["position"])] == mix


def test_pipeline_edges(spark, docs, clashing, empty, nameless):
    """Clashing and dotted column names, null and repeated ids, an empty table, through all five stages."""
    assert staged(spark, empty).count() == 0
    ids = lambda df: sorted((r["doc_id"], r["n_tokens"]) for r in df.collect())
    assert ids(staged(spark, clashing)) == ids(staged(spark, docs))
    left = staged(spark, nameless).select("doc_id", "n_tokens", "position").collect()
    # "same words here" stays once under id 7, "other words" too, and the text without an id.
    assert sorted(str(r["doc_id"]) for r in left) == ["7", "7", "None"]
    assert sorted(r["position"] for r in left) == [0, 1, 2]


def test_near_copies_with_one_id_lose_no_other_text(spark):
    rows = [(3, "one two three four five six"), (7, "one two three four five six"), (7, "quite another text of seven words here")]
    kept = pipeline_stages.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SMALL)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [rows[0], rows[2]]


def test_run_leaves_only_its_result(spark, docs):
    before = scratch_files(spark)
    corpus_pipeline.run(spark, SMALL).count()
    left = scratch_files(spark) - before
    assert len(left) == 1 and all(name.startswith("pipeline-") for name in left)


def scratch_files(spark):
    return set(os.listdir(shared_folder(spark).removeprefix("file://")))


def test_run_reads_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    found = corpus_pipeline.run(spark, SMALL)
    assert sorted(r["doc_id"] for r in found.select("doc_id").collect()) == sorted(r[0] for r in plain_pipeline(rows))


def test_oracle_sql(spark):
    connection = duckdb.connect()
    for view in ("documents", "embeddings", "conversations"):
        connection.execute(f"CREATE VIEW {view} AS SELECT * FROM '{SMALL}/{view}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, SMALL)
        result = connection.execute(sql)
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in result.description], result.fetchall())


def test_entry_without_the_llm_folders(tmp_path):
    """The entry module imports, and its other queries are there, when the folders and the pipeline are deleted."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(os.path.join(root, "pactum"), tmp_path / "pactum", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'dif1_snapshot_diff' in q and 'pipeline' not in q and not [x for x in q if x.startswith('op1_')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
