import os

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import common, language_id, quality
from marginalia.llm.common import materialize


def test_stages(spark):
    """Every stage but the last returns the columns of documents, and only rows that it was given."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, known = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), "test")
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= known and ids, name
        assert name == "tokens" or docs.columns == columns
        known = ids
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_tokens_decode(spark):
    """The last stage decodes what it encodes: the text comes back from the ids of each row."""
    rows = [(1, "Gr\u00fc\u00dfe, it's  12 o'clock\n\n\tend ", "de", "src1"), (2, None, "en", "src1"), (3, "", None, None), (1, "again \U0001f600", "en", "src2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sorted((r.doc_id, r.decoded, r.n_tokens == len(r.ids) // 4) for r in corpus_pipeline.tokens(spark, docs, "").collect())
    assert got == sorted((i, t or "", True) for i, t, *_ in rows)


def _shuffles(spark):
    """Shuffle files that Spark holds on its local disk."""
    return spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(" ").count(".data")


def test_near_duplicates_leave_no_tables(spark, monkeypatch):
    """What the stage makes on its way goes with it: of its tables one, narrow, stays, and no write leaves shuffle files."""
    made = []
    monkeypatch.setattr(common, "shared_path", lambda s, label, f=common.shared_path: made.append(f(s, label)) or made[-1])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = _shuffles(spark)
    common.materialize(docs.repartition(3, "doc_id"), "dealt")
    assert _shuffles(spark) == before
    made.clear()
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    left = [p for p in made if os.path.exists(p.removeprefix("file:"))]
    assert len(made) > 10 and len(left) == 1 and "other" in left[0]
    assert 0 < kept.count() < docs.count()


def test_empty_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), "test")
        assert docs.isEmpty(), name


def test_clashing_columns(spark):
    """Columns with the names of the operators' own columns pass through every stage unharmed."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for c in ("rejected", "kept", "_row", "fp", "domain", "epoch", "n_tokens", "score", "gid"):
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), "test")
        assert docs.columns == columns and not docs.isEmpty(), name
        assert docs.where("kept <> concat('kept', doc_id) or domain <> concat('domain', doc_id)").isEmpty(), name
    assert not stage_of("tokens")(spark, docs, sf).isEmpty()


def stage_of(name):
    return dict(corpus_pipeline.STAGES)[name]


def _own_mb():
    """MB of this process that are not files."""
    with open("/proc/self/smaps_rollup") as f:
        return sum(int(x.split()[1]) for x in f if x.startswith("Pss_Anon")) / 1024


def test_workers_hand_back():
    """What a task has freed goes back to the system at its end, although a small piece that lasts lies behind it."""
    lasting = []

    def fill():
        held = [bytes(3000) for _ in range(50_000)]
        lasting.append(bytes(3000))
        del held

    def of_batches(batches):
        for x in batches:
            fill()
            yield x

    def of_group(table):
        fill()
        return table

    def of_groups(left, right):
        fill()
        return left, right

    before = _own_mb()
    assert list(common.handing_back(of_batches)(iter([1, 2]))) == [1, 2] and _own_mb() < before + 50
    assert common.handing_back(of_group)(3) == 3 and _own_mb() < before + 50
    assert common.handing_back(of_groups)(4, 5) == (4, 5) and _own_mb() < before + 50


def test_language_looks_up_little_at_a_time(monkeypatch):
    """Texts are scored by some ten thousand symbols, with the results of each text alone."""
    model = language_id.train([(g, f"{g * 3} {w} word {i}") for i in range(40) for g, w in (("en", "the of and"), ("de", "der und die"))])
    texts = [f"the {i} und " * 200 for i in range(300)]
    alone = [model.score([t]) for t in texts]
    met, plain = [], language_id.Model.log_probs
    monkeypatch.setattr(language_id.Model, "log_probs", lambda self, x: met.append(len(x)) or plain(self, x))
    logs, sizes = model.score(texts)
    assert len(met) > 3 and max(met) < 80_000 < sum(met)
    assert all((logs[i] == a[0]).all() and sizes[i] == n[0] for i, (a, n) in enumerate(alone))


def test_rows_pass_by_bytes(spark):
    """Once a stage with Python has been set up, a worker is given a few MB at a time, however large the rows are."""
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 400).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    corpus_pipeline.tokens(spark, docs, "")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["size"])

    got = [r["size"] for r in docs.mapInArrow(sizes, "size long").collect()]
    assert sum(got) > 12_000_000 and max(got) < 6_000_000


def test_steps_are_one_plan_each(spark):
    """The concentration steps and starts take few jobs, none of them a stage of an adaptive plan; the session's settings come back."""
    data = [("g", 0.01 * (i % 37), 0.05 * (i % 11), 0.1 * (i % 5), 0.01 * (i % 23)) for i in range(300)]
    df = spark.createDataFrame(data, "gid string, x_len double, x_sym double, x_line double, x_rep double")
    keys = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    before, adaptive = [spark.conf.get(k) for k in keys], []
    plain = quality._step

    def step(*a):
        adaptive.append(spark.conf.get(keys[0]))
        out = plain(*a)
        assert "Adaptive" not in out._jdf.queryExecution().executedPlan().toString()
        return out

    quality._step = step
    try:
        fit, few = quality.robust_fit(df)
    finally:
        quality._step = plain
    assert few and fit.count() == 1 and set(adaptive) == {"false"} and [spark.conf.get(k) for k in keys] == before
