"""The pipeline on the smallest tables against plain versions of its stages."""

import os
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import cases  # noqa: E402
import corpus_pipeline  # noqa: E402
import pyarrow.parquet as pq  # noqa: E402

from tablewright.llm import scratch  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    expected = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = {d for (d, _), c in zip(expected, cases.classes(expected)) if c[1] == d}
    clean = {d for (d, t), c in zip(expected, cases.overlaps(expected, items)) if not c[1]}
    now = docs
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(at))
        stage(spark, now, FOLDER).write.parquet(path)
        now = spark.read.parquet(path)
        ids = Counter(r.doc_id for r in now.collect())
        if at < 4:
            assert now.columns == docs.columns
        if at == 0:
            assert set(ids) == {d for d, _ in expected}
        elif at == 1:
            assert ids == Counter(kept)
        elif at == 2:
            assert ids == Counter(kept & clean)
        elif at == 3:
            assert set(ids) <= kept & clean and max(ids.values()) <= 3
    assert {"shard", "slot"} <= set(now.columns)


def test_pipeline_on_awkward_rows_and_none(spark, tmp_path):
    for rows in (cases.awkward_rows(), []):
        now = spark.createDataFrame(rows, cases.SCHEMA)
        for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{len(rows)}-{at}")
            stage(spark, now, FOLDER).write.parquet(path)
            now = spark.read.parquet(path)
        assert (now.count() > 0) == bool(rows)


def test_near_duplicates_are_removed_in_small_rows_and_row_groups(spark, monkeypatch):
    """A task holds whole rows and row groups, so both bound its memory: 1.2 million different words in one file."""
    folders, remove = [], []
    write = scratch.Tables.write
    monkeypatch.setattr(scratch.Tables, "write", lambda self, df, *args, **named: folders.append(f"{self.folder}/{self.count}") or write(self, df, *args, **named))
    monkeypatch.setattr(scratch.Tables, "remove", lambda self, table: remove.append(table))
    texts = [(i, " ".join(f"w{i}x{j}" for j in range(20_000))) for i in range(60)]
    docs = spark.createDataFrame(texts + [(60, texts[0][1])], "doc_id long, text string").coalesce(1)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).select("doc_id").collect()) == list(range(60))
    groups, longest = [], 0
    for folder in folders:
        if "/jaccard-kept-" in folder:
            continue  # rows of the caller
        for name in os.listdir(folder := folder.removeprefix("file:")):
            if name.endswith(".parquet"):
                file = pq.ParquetFile(f"{folder}/{name}")
                groups += [file.metadata.row_group(i).total_byte_size for i in range(file.metadata.num_row_groups)]
                if "vocab" in file.schema_arrow.names:
                    longest = max([longest, *map(len, file.read(["vocab"])["vocab"].to_pylist())])
    assert remove and 0 < longest <= 1 << 20 and max(groups) <= 6 << 20
