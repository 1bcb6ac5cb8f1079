import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import question_digest, refresh_index
from jobs.common import configured, settings
from verdigraph.operators.inverted import StoredIndex

TABLES = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture
def documents(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text", "lang")


def config(tmp_path, **more):
    return refresh_index.Config(str(tmp_path / "documents"), str(tmp_path / "index"), str(tmp_path / "state"), **more)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_two_runs_over_growing_input(spark, tmp_path, documents):
    c = config(tmp_path)
    assert refresh_index.run(spark, c).collect() == []  # nothing there yet
    half = documents.where("doc_id % 2 = 0")
    half.repartition(3).write.parquet(c.source)
    refresh_index.run(spark, c)
    batches = set(os.listdir(tmp_path / "index" / "documents"))
    more = documents.where("doc_id % 2 = 1").unionByName(documents.where("doc_id % 10 = 0").withColumn("text", F.concat("text", F.lit(" acrescentado"))))
    more = more.unionByName(documents.where("doc_id = 2").withColumn("text", F.lit(None).cast("string")))
    more.coalesce(2).write.mode("append").parquet(c.source)
    after = rows(refresh_index.run(spark, c))
    added = set(os.listdir(tmp_path / "index" / "documents")) - batches
    assert len(added) == 1
    read = spark.read.parquet(f"{c.target}/documents").groupBy("batch").count().collect()
    assert sorted(r["count"] for r in read) == sorted([half.count(), more.count()])  # the second run took what was new
    latest = documents.where("doc_id <> 2").withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" acrescentado"))).otherwise(F.col("text")))
    whole = StoredIndex(spark, str(tmp_path / "whole"))
    whole.add(latest, 0)
    assert after == rows(refresh_index.current(whole))
    assert rows(refresh_index.run(spark, c)) == after  # a third run finds nothing
    assert set(os.listdir(tmp_path / "index" / "documents")) == batches | added


def test_small_batches_give_the_same(spark, tmp_path, documents):
    documents.repartition(5).write.parquet(str(tmp_path / "documents"))
    refresh_index.run(spark, config(tmp_path, files_per_batch=2))
    assert len([n for n in os.listdir(tmp_path / "index" / "documents") if n.startswith("batch=")]) == 3
    one = refresh_index.Config(f"{TABLES}/documents.parquet", str(tmp_path / "one"), str(tmp_path / "one-state"))
    assert rows(refresh_index.run(spark, one)) == rows(refresh_index.current(refresh_index.opened(spark, config(tmp_path))))


def test_a_failed_batch_is_taken_again(spark, tmp_path, documents, monkeypatch):
    c = config(tmp_path)
    documents.write.parquet(c.source)
    whole = StoredIndex._replaced

    def broken(self, sizes, batch):  # the postings are written by now
        raise OSError("lost")

    monkeypatch.setattr(StoredIndex, "_replaced", broken)
    with pytest.raises(Exception, match="lost"):
        refresh_index.run(spark, c)
    assert refresh_index.current(refresh_index.opened(spark, c)).collect() == []
    monkeypatch.setattr(StoredIndex, "_replaced", whole)
    again = rows(refresh_index.run(spark, c))
    fresh = StoredIndex(spark, str(tmp_path / "fresh"))
    fresh.add(documents, 0)
    assert again == rows(refresh_index.current(fresh))


TALK = [
    (1, 0, "user", "Onde está a NFE?"), (1, 1, "assistant", "Aqui."), (1, 2, "user", "onde esta a nfe"), (2, 0, "user", "ONDE ESTÁ, A NFE"), (3, 0, "user", "Quando são as férias?"),
    (3, 2, "user", "..."), (3, 4, "user", None), (4, 0, "user", "Cookies"), (None, 0, "user", "cookies"), (5, 0, None, "nfe"), (6, 0, "user", "outra coisa"),
]


def test_digest(spark, tmp_path):
    talk = spark.createDataFrame([(*t, "x") for t in TALK], "conv_id long, turn long, role string, text string, department_key string")
    talk.write.parquet(str(tmp_path / "talk"))
    index = StoredIndex(spark, str(tmp_path / "index"))
    index.add(spark.createDataFrame([(7, "a nfe está no portal"), (8, "férias em janeiro"), (9, "outros assuntos")], "doc_id long, text string"), 0)
    departments = {"fiscal": "nfe xml", "dpo": "cookies nfe", "rh": "ferias"}
    c = question_digest.Config(str(tmp_path / "talk"), index.path, str(tmp_path / "digest"), most=1, departments=departments)
    first = question_digest.run(spark, c)
    found = {r.question: (r.department_key, r.text, r.n_asked, r.n_conversations, r.first_conversation, r.best_document, r.place) for r in first.collect()}
    assert found == {
        "onde esta a nfe": ("fiscal", "ONDE ESTÁ, A NFE", 3, 2, 1, 7, 1),
        "quando sao as ferias": ("rh", "Quando são as férias?", 1, 1, 3, 8, 1),
        "cookies": ("dpo", "Cookies", 2, 1, 4, None, 1),
        "outra coisa": ("ouvidoria_fallback", "outra coisa", 1, 1, 6, None, 1),
    }
    before = rows(first.fillna(0))
    assert rows(question_digest.run(spark, c).fillna(0)) == before
    assert sorted(n for n in os.listdir(tmp_path / "digest" / "questions") if "=" in n) == [f"department_key={k}" for k in ("dpo", "fiscal", "ouvidoria_fallback", "rh")]
    talk.where("conv_id = 1").write.mode("overwrite").parquet(str(tmp_path / "talk2"))
    smaller = question_digest.Config(str(tmp_path / "talk2"), index.path, c.target, departments=departments)
    assert question_digest.run(spark, smaller).count() == 1  # a run leaves nothing of the one before


def test_configuration():
    c = configured(refresh_index.Config, json.dumps({"source": "a", "target": "b", "checkpoint": "c"}), target="d", buckets=None)
    assert (c.source, c.target, c.buckets) == ("a", "d", 32)
    with pytest.raises(ValueError, match="unknown settings: sorce"):
        configured(refresh_index.Config, '{"sorce": "a"}')
    for job in (refresh_index, question_digest):
        configured(job.Config, (ROOT / "jobs" / f"{job.__name__.rpartition('.')[2]}.json").read_text())


def test_settings_come_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(ZeroDivisionError), settings(spark, spark__sql__shuffle__partitions="3", spark__verdigraph__none="1"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        1 / 0  # noqa: B018
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.conf.get("spark.verdigraph.none", None) is None


def test_command_line(spark, tmp_path):
    done = subprocess.run(
        [sys.executable, "-m", "jobs.refresh_index", "jobs/refresh_index.json", "--source", f"{TABLES}/documents.parquet", "--target", str(tmp_path / "i"), "--checkpoint", str(tmp_path / "c"), "--buckets", "4"],
        cwd=ROOT, capture_output=True, text=True, timeout=300, env={**os.environ, "SPARK_LOCAL_IP": "127.0.0.1"}, check=False,
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert "200 documents" in done.stderr
    assert StoredIndex(spark, str(tmp_path / "i"), buckets=4).statistics()[0] == 200


@pytest.mark.parametrize("name", ["job1_refresh_index", "job2_question_digest"])
def test_registered_jobs_against_sql(spark, name):
    import duckdb

    from jobs import registry

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    before = dict(spark.conf.getAll)
    df = registry.queries()[name](spark, TABLES)
    found = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    plain = lambda r: tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(plain([r[columns.index(c)] for c in df.columns]) for r in found.fetchall()) == sorted(map(plain, df.collect()))
    after = dict(spark.conf.getAll)
    assert {k: after.get(k) for k in before} == before
