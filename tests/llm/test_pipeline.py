import json
import os
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import pyarrow as pa
import pyspark
import pytest
from pyspark.sql import functions as F

from tesserae.llm import language_id, pieces, toxicity
from tests.llm.test_line_dedup import brute as removed
from tests.llm.test_ngram_join import brute as linked

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.cut(stage(spark, docs, SF), f"test-{k}")
        assert k == 4 or docs.columns == columns
        out.append(docs.collect())
    return out


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_toxic_documents_go(spark, steps):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").where(language_id.fold("doc_id", 5) != 0))
    stay = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in steps[1]} == stay
    before = {r["doc_id"]: r for r in steps[0]}
    assert all(before[r["doc_id"]] == r for r in steps[1])


def test_lines_go(steps):
    gone = removed([(r["doc_id"], r["text"]) for r in steps[1]])
    want = {r["doc_id"]: "\n".join(x for p, x in enumerate(r["text"].split("\n")) if p not in gone.get(r["doc_id"], [])) for r in steps[1]}
    assert {r["doc_id"]: r["text"] for r in steps[2]} == want


def test_one_document_of_a_group_stays(steps):
    want = {i for i, least, _ in linked([(r["doc_id"], r["text"]) for r in steps[2]]) if i == least}
    assert sorted(r["doc_id"] for r in steps[3]) == sorted(want)


def test_mix_and_encoding(steps):
    kept = {r["doc_id"]: r for r in steps[3]}
    assert all(kept[r["doc_id"]] == r for r in steps[4])
    counts = {}
    for r in steps[4]:
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert set(counts.values()) <= {1, 2}
    lib = pieces.encoder(pieces.resolve("piece_bpe_32k.model")).library
    assert sorted((r["doc_id"], r["ids"]) for r in steps[5]) == sorted((r["doc_id"], lib.encode(r["text"] or "")) for r in steps[4])


def test_stages_take_odd_and_empty_documents(spark, odd, empty):
    from tests.llm.conftest import DOCS

    slim = odd.select(*[c.split()[0] for c in DOCS.split(", ")])
    for docs in (slim, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.cut(stage(spark, docs, SF), "test-odd")


def test_rows_go_to_python_in_small_batches(spark, empty):
    """A task and its worker hold whole batches of texts; groups stay whole, and so does a user's lower bound."""
    key, bound = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
    texts = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("some words "), 500).alias("text"))  # 22 MB

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    spark.conf.unset(key)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, empty, SF)
        got = texts.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in got) == 4000 and max(r["size"] for r in got) < 1.1 * bound
        spark.conf.unset(key)
    corpus_pipeline.encode(spark, empty, SF)
    whole = texts.withColumn("k", F.col("id") % 2).groupBy("k").applyInPandas(lambda g: g.assign(n=len(g))[["k", "n"]].head(1), "k long, n long").collect()
    assert sorted((r["k"], r["n"]) for r in whole) == [(0, 2000), (1, 2000)]
    spark.conf.set(key, "1m")
    corpus_pipeline.encode(spark, empty, SF)
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)


GROWN = """
import os, re, sys, time
from pathlib import Path
import psutil
from pyspark.sql import SparkSession, functions as F
from corpus_pipeline import encode
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1024m").config("spark.executor.cores", "1").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()

def executors():
    said = [Path(f"/proc/{p.pid}/smaps_rollup").read_text() for p in psutil.Process().children(recursive=True) if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline())]
    return [int(re.search(r"Pss_Anon: +([0-9]+)", s).group(1)) // 1024 for s in said]

spark.range(0, 2_000_000, 1, 2).groupBy(F.spark_partition_id()).agg(F.collect_list(F.concat(F.col("id"), F.repeat(F.lit("x"), 100))).alias("s")).agg(F.sum(F.size("s"))).collect()
before = executors()
encode(spark, spark.createDataFrame([], "doc_id long, text string"), "")
for _ in range(20):  # pages are given back beside other work
    time.sleep(0.5)
    if max(after := executors()) < min(before) / 2:
        break
Path(sys.argv[1]).write_text(f"{before} {after}")
spark.stop()
"""


def test_executors_give_memory_back_between_stages(tmp_path):
    """Heaps that one stage made large would stay beside the Python workers of the next."""
    home, out = tmp_path / "home", tmp_path / "said"
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():  # workers write their logs into Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    env |= {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_DIRS": str(tmp_path), "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": os.pathsep.join([str(Path(corpus_pipeline.__file__).parent), *sys.path])}
    with (tmp_path / "log").open("w") as log:
        subprocess.run([sys.executable, "-c", GROWN, str(out)], env=env, cwd=tmp_path, stdout=log, stderr=log, timeout=120, check=True)
    before, after = json.loads("[" + out.read_text().replace("] [", "], [") + "]")
    assert len(before) == len(after) == 2 and min(before) > 500
    assert max(after) < min(before) / 2
