"""Round trips through files, the stream, and files as sources."""

from pyspark.sql import functions as F

from catalog.inputs import judge_lines, sql_votes, table, truth, vote_lines
from catalog.responses import SQL_JUDGE_TEXT
from catalog.scoring import SCORED, f1_sql, rounded
from tessera.config import Dataset, ModelSpec
from tessera.operators import parse, requests
from tessera.session import shared_path
from tessera.sources import explain_log, jsonl, tables
from tessera.sources import responses as source
from tessera.streaming import votes as stream


def _orders_csv(spark, sf):
    """Orders in key order as CSV, with null tokens and quotes in the text."""
    path = shared_path(spark, "orders") + ".csv"
    note = (F.when(F.col("o_orderstatus") == "P", F.lit("N/A"))
            .otherwise(F.concat(F.lit('say "'), "o_orderpriority", F.lit('", twice'))))
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), note.alias("note"), F.col("o_custkey").cast("string").alias("who"))
    (rows.orderBy(F.col("id").cast("bigint")).write.option("header", True).option("escape", '"').csv(path))
    return path


def s1_csv(spark, sf):
    return tables.read_csv(spark, _orders_csv(spark, sf)).select("id", "note", "who")


def s2_row_key(spark, sf):
    """The record position survives filters and projections."""
    rows = tables.read_csv(spark, _orders_csv(spark, sf), columns=["id", "note", "who"], multiline=False)
    return rows.filter(F.col("note").isNotNull()).select("idx", F.col("id").cast("bigint").alias("id"))


def s3_attributions(spark, sf):
    path = shared_path(spark, "attributions") + ".csv"
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("price"),
                                           F.col("p_size").cast("double").alias("size"))
    tables.write_attributions(rows, path)
    return tables.read_attributions(spark, path)


def s6_explain_log(spark, sf):
    """A log per event with two training rows and one test row."""
    pair = F.array(F.col("event_id") * 3, F.col("event_id") * 3 + 1)
    doc = F.to_json(F.struct(
        pair.alias("train_data_idx"), F.array(F.col("event_id") * 3 + 2).alias("test_data_idx"),
        F.array(F.col("user_id") % 2, F.lit(1).cast("bigint")).alias("train_predictions"),
        F.array(F.lit(0)).alias("test_predictions")))
    path = shared_path(spark, "logs")
    table(spark, sf, "events").select(doc.alias("value")).write.text(path)
    logs = spark.read.text(path).select(F.from_json("value", explain_log.LOG_SCHEMA).alias("d")).select("d.*")
    return explain_log.log_predictions(logs)


def _log_tables(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("idx"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("test")).otherwise(F.lit("train")).alias("split"),
        (F.col("o_custkey") % 2).alias("prediction"))
    sizes = table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_size").alias("importance"))
    path = shared_path(spark, "log")
    explain_log.write_log(rows, sizes, path)
    return explain_log.read_log(spark, path)


def s5_log_tables(spark, sf):
    return _log_tables(spark, sf)[0].select("idx", "split", "prediction")


def s5_log_importances(spark, sf):
    return _log_tables(spark, sf)[1].select("feature", F.round("importance", 9).alias("importance"))


def s6_importances(spark, sf):
    """A log per event with two importances."""
    values = F.create_map(F.lit("user"), F.col("user_id") / 4, F.lit("event"), F.col("event_id") / 2)
    doc = F.to_json(F.struct(F.col("event_id").cast("string").alias("dataset_path"), values.alias("feature_importances")))
    path = shared_path(spark, "logs")
    table(spark, sf, "events").select(doc.alias("value")).write.text(path)
    logs = spark.read.text(path).select(F.from_json("value", explain_log.LOG_SCHEMA).alias("d")).select("d.*")
    return explain_log.log_importances(logs)


def _renamed(spark, folder, name):
    """The only data file in ``folder`` under another name."""
    files = spark.read.format("binaryFile").load(folder).select("path")
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    (old,) = [r["path"] for r in files.collect()]
    target = made(f"{folder}/{name}")
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(made(old), target)


def s12_newest(spark, sf):
    """The orders' keys, from the later of a run's two files; another run's name begins alike."""
    orders, path = table(spark, sf, "orders"), shared_path(spark, "outputs")
    for folder, column in (("alpha_100", "o_custkey"), ("alpha_200", "o_orderkey"), ("alpha_two_300", "o_custkey")):
        orders.select(F.col(column).cast("string").alias("value")).coalesce(1).write.text(f"{path}/{folder}")
        _renamed(spark, f"{path}/{folder}", f"{folder}-predictions.jsonl")
    newest = jsonl.newest_file(spark, path, "alpha")
    return spark.read.text(newest).select(F.col("value").cast("bigint").alias("idx"))


def s13_runs(spark, sf):
    """A masked and an unmasked result document for each region, the masked ones without examples' scores."""
    def scores(**values):
        return F.create_map(*[x for k, v in values.items() for x in (
            F.lit(k.replace("_", "-")), F.struct(v.alias("accuracy"), (v / 2).alias("macro_f1_score")))])
    one = F.count(F.lit(1)) / 100
    tree, other = F.col("tree"), F.col("tree") / 4
    regions = table(spark, sf, "nation").groupBy("n_regionkey").agg(one.alias("tree")).collect()
    path = shared_path(spark, "runs")
    for region in regions:
        row = table(spark, sf, "region").filter(F.col("r_regionkey") == region["n_regionkey"]).select(
            F.lit(region["tree"]).alias("tree"))
        for kind in ("masked", "unmasked"):
            parts = [scores(tree_model=tree, zero_shot_prompting=other).alias("zero_shot_baseline")]
            if kind == "unmasked":
                parts.append(scores(tree_model=tree, guided_few_shot=other * 2).alias("cot"))
            folder = f"{path}/{region['n_regionkey']}-{kind}"
            row.select(F.to_json(F.struct(*parts)).alias("value")).coalesce(1).write.text(folder)
            _renamed(spark, folder, f"region{region['n_regionkey']}_{kind}.json")
    return jsonl.run_scores(jsonl.read_runs(spark, f"{path}/*"))


def u1_load(spark, sf):
    """A written CSV through a dataset's own recipe."""
    def prepare(rows):
        rows = rows.withColumns({"id": F.col("id").cast("bigint"), "who": F.col("who").cast("bigint")})
        return rows.withColumn("noted", F.col("note").isNotNull().cast("int")).drop("note")
    return tables.load(spark, Dataset("orders", "noted", {0: "no", 1: "yes"}, prepare, _orders_csv(spark, sf)))


def s7_requests(spark, sf):
    path = shared_path(spark, "requests")
    key = requests.judge_id(F.col("doc_id"))
    envelope = requests.params_envelope(key, F.col("text"), ModelSpec("model-a", 0.6, 4096))
    jsonl.write_requests(table(spark, sf, "documents").select(envelope.alias("request")), path)
    schema = "custom_id string, params struct<messages: array<struct<content: string>>>"
    return spark.read.schema(schema).json(path).select(
        F.col("custom_id").alias("key"), F.col("params.messages")[0]["content"].alias("text"))


def s11_evaluations(spark, sf):
    path = shared_path(spark, "evaluations")
    got = source.evaluations(judge_lines(spark, sf))
    jsonl.write_evaluations(got.select(F.col("key").alias("request_id"), F.col("text").alias("evaluation")), path)
    return source.evaluations(source.read_lines(spark, path)).select(
        parse.second_id(F.col("key")).alias("idx"), F.col("text").alias("evaluation"))


def s14_sweep(spark, sf):
    """A sweep document per part, exploded to parameters."""
    size = F.col("p_size")
    doc = F.concat(F.lit('{"method": "bayes", "parameters": {"max_depth": {"distribution": "int_uniform", "min": 1, "max": '),
                   size, F.lit('}, "weight": {"values": [1, '), size, F.lit("]}}}"))
    return jsonl.sweep_rows(table(spark, sf, "part").select(doc.alias("value"))).select(
        "parameter", "distribution", "min", "max", F.get("values", F.lit(1)).alias("last"))


def _written_votes(spark, sf):
    path = shared_path(spark, "responses")
    vote_lines(spark, sf).select(F.col("line").alias("value")).repartition(6).write.text(path)
    return path


def t1_stream(spark, sf):
    store = shared_path(spark, "stream")
    stream.ingest(spark, _written_votes(spark, sf), store, files_per_batch=2).awaitTermination()
    return stream.running_labels(spark, store)


def t1_stream_scores(spark, sf):
    store = shared_path(spark, "stream")
    stream.ingest(spark, _written_votes(spark, sf), store, dedupe_agents=True).awaitTermination()
    found = stream.running_scores(spark, store, truth(spark, sf), "y", "x", dedupe_agents=True)
    return rounded(found)


QUERIES = {f.__name__: f for f in (
    s1_csv, s2_row_key, s3_attributions, s5_log_tables, s5_log_importances, s6_explain_log, s6_importances, s7_requests,
    s11_evaluations, s12_newest, s13_runs, u1_load, s14_sweep,
    t1_stream, t1_stream_scores)}

SQL = {
    "s1_csv": """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus <> 'P' THEN
        'say "' || o_orderpriority || '", twice' END AS note, CAST(o_custkey AS VARCHAR) AS who FROM orders""",
    "s2_row_key": """SELECT idx, id FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_orderkey AS id,
        o_orderstatus FROM orders) WHERE o_orderstatus <> 'P'""",
    "s3_attributions": "SELECT p_partkey AS idx, p_retailprice AS price, CAST(p_size AS DOUBLE) AS size FROM part",
    "s5_log_tables": """SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split,
        o_custkey % 2 AS prediction FROM orders""",
    "s5_log_importances": "SELECT p_brand AS feature, round(avg(p_size), 9) AS importance FROM part GROUP BY p_brand",
    "s6_importances": """SELECT unnest([0, 1]) AS position, unnest(['user', 'event']) AS feature,
        unnest([user_id / 4, event_id / 2]) AS importance FROM events""",
    "s12_newest": "SELECT o_orderkey AS idx FROM orders",
    "s13_runs": """WITH r AS (SELECT 'region' || n_regionkey AS dataset, count(*) / 100 AS tree FROM nation GROUP BY n_regionkey),
        m AS (SELECT *, unnest([true, false]) AS masked FROM r),
        s AS (SELECT dataset, masked, 'tree-model' AS strategy, tree AS accuracy FROM m
          UNION ALL SELECT dataset, masked, 'zero-shot-prompting', tree / 4 FROM m
          UNION ALL SELECT dataset, masked, 'guided-few-shot', tree / 2 FROM m WHERE NOT masked)
        SELECT dataset, masked, strategy, accuracy, accuracy / 2 AS macro_f1 FROM s""",
    "u1_load": """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_orderkey AS id, o_custkey AS who,
        CAST(o_orderstatus <> 'P' AS INT) AS noted FROM orders""",
    "s6_explain_log": """SELECT event_id * 3 AS idx, 'train' AS split, user_id % 2 AS prediction FROM events
        UNION ALL SELECT event_id * 3 + 1, 'train', 1 FROM events UNION ALL SELECT event_id * 3 + 2, 'test', 0 FROM events""",
    "s7_requests": "SELECT 'judge_batch-' || doc_id AS key, text FROM documents",
    "s11_evaluations": f"WITH {SQL_JUDGE_TEXT} SELECT event_id AS idx, text AS evaluation FROM judge_texts",
    "s14_sweep": """SELECT 'max_depth' AS parameter, 'int_uniform' AS distribution, CAST(1.0 AS DOUBLE) AS min, CAST(p_size AS DOUBLE) AS max,
        NULL::DOUBLE AS "last" FROM part UNION ALL SELECT 'weight', NULL, NULL, NULL, CAST(p_size AS DOUBLE) FROM part""",
    "t1_stream": f"WITH {sql_votes()} SELECT idx, prediction FROM voted_user_id",
    "t1_stream_scores": f"""WITH {SCORED}, {f1_sql('scored', 'strategy')} SELECT strategy,
        round(avg(CAST(y = prediction AS INT)), 6) AS accuracy, round((SELECT avg(f1) FROM f1), 6) AS macro_f1,
        count(*) AS n FROM scored GROUP BY strategy""",
}
