"""Features, folds, splits, models, metrics and scoring."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tablewright import modeling as M
from tablewright.modeling.candidates import (
    Settings, TrainingFacts, lasso_regression, linear_regression, ridge_regression,
)
from tablewright.modeling.random_trees import ExtraTrees
from tablewright.modeling.softmax_trees import SoftmaxBoosting
from tablewright.session import cut_lineage, scratch_path
from tablewright.streaming import predict_stream, through_stream
from tablewright.suite.registry import (
    CUSTOMER_IDS, ORDERS_GAPS, customer_ids, orders_gaps, query, table,
)

HASH = "('0x' || substr(md5('42:' || {key}), 1, 8))::BIGINT"


# -- pruning and features ----------------------------------------------------------


@query("prune_features", f"WITH {CUSTOMER_IDS} SELECT c_nationkey, c_acctbal, c_mktsegment FROM customer_ids")
def prune_features(spark, sf):
    return M.prune_features(customer_ids(spark, sf), "c_mktsegment")


@query("impute_scale_features", f"""
WITH {ORDERS_GAPS},
filled AS (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS c,
                  coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM orders_gaps)) AS p FROM orders_gaps)
SELECT o_orderkey, round((c - (SELECT avg(c) FROM filled)) / (SELECT stddev_pop(c) FROM filled), 6) AS f_custkey,
       round((p - (SELECT avg(p) FROM filled)) / (SELECT stddev_pop(p) FROM filled), 6) AS f_totalprice
FROM filled""")
def impute_scale_features(spark, sf):
    rows = orders_gaps(spark, sf).select("o_orderkey", "o_custkey", "o_totalprice")
    state = M.fit_features(rows, ["o_custkey", "o_totalprice"], [])
    ready = M.feature_pipeline(rows, state).transform(rows).withColumn("f", vector_to_array("features"))
    return ready.select(
        "o_orderkey", F.round(F.get("f", F.lit(0)), 6).alias("f_custkey"), F.round(F.get("f", F.lit(1)), 6).alias("f_totalprice")
    )


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")
STATES = ("F", "O", "P")


@query("onehot_features", f"""
WITH {ORDERS_GAPS},
p AS (SELECT o_orderpriority AS v FROM orders_gaps WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
filled AS (SELECT o_orderkey, o_orderstatus, coalesce(o_orderpriority, (SELECT v FROM p)) AS priority FROM orders_gaps)
SELECT o_orderkey, """ + ", ".join(
    [f"CAST(priority = '{v}' AS BIGINT) AS priority_{i}" for i, v in enumerate(PRIORITIES)]
    + [f"CAST(o_orderstatus = '{v}' AS BIGINT) AS status_{i}" for i, v in enumerate(STATES)]) + " FROM filled")
def onehot_features(spark, sf):
    rows = orders_gaps(spark, sf).select("o_orderkey", "o_orderpriority", "o_orderstatus")
    state = M.fit_features(rows, [], ["o_orderpriority", "o_orderstatus"])
    ready = M.feature_pipeline(rows, state).transform(rows).withColumn("f", vector_to_array("features"))
    names = [f"priority_{i}" for i in range(len(PRIORITIES))] + [f"status_{i}" for i in range(len(STATES))]
    return ready.select("o_orderkey", *[F.get("f", F.lit(i)).cast("bigint").alias(n) for i, n in enumerate(names)])


@query("encode_target", """
SELECT c_custkey, c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS label FROM customer""")
def encode_target(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return M.label_codes(rows, "c_mktsegment", M.target_classes(rows, "c_mktsegment"))


# -- folds and splits --------------------------------------------------------------


@query("kfold_assign", f"SELECT o_orderkey, CAST({HASH.format(key='o_orderkey')} % 5 AS INTEGER) AS fold FROM orders")
def kfold_assign(spark, sf):
    return M.kfold(table(spark, sf, "orders"), 5, ["o_orderkey"]).select("o_orderkey", "fold")


@query("stratified_kfold_assign", """
SELECT doc_id, toxic, CAST((row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || doc_id), doc_id) - 1) % 5 AS INTEGER) AS fold
FROM labels""")
def stratified_kfold_assign(spark, sf):
    return M.stratified_kfold(table(spark, sf, "labels").select("doc_id", "toxic"), "toxic", 5, ["doc_id"])


@query("train_test_split", f"SELECT o_orderkey, {HASH.format(key='o_orderkey')} / 4294967296.0::DOUBLE < 0.2 AS is_test FROM orders")
def train_test_split(spark, sf):
    return M.train_test(table(spark, sf, "orders"), 0.2, ["o_orderkey"]).select("o_orderkey", "is_test")


@query("stratified_split", """
SELECT o_orderkey, o_orderstatus,
       row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || o_orderkey), o_orderkey)
       <= floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.2::DOUBLE + 0.5) AS is_test
FROM orders""")
def stratified_split(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return M.stratified_train_test(rows, "o_orderstatus", 0.2, ["o_orderkey"])


# -- closed-form models ------------------------------------------------------------


def _one_feature(df, x: str, y: str):
    ready = VectorAssembler(inputCols=[x], outputCol="features").transform(df)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(y).alias("s")).first()
    return ready.withColumnRenamed(y, "label"), TrainingFacts(row["n"], row["s"], 0, 1)


def _line(spark, model):
    return spark.createDataFrame(
        [(round(float(model.coefficients[0]), 4), round(float(model.intercept), 2))], "slope double, intercept double"
    )


@query("ols_fit", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept
FROM lineitem""")
def ols_fit(spark, sf):
    rows, facts = _one_feature(table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice")
    return _line(spark, linear_regression(Settings(), facts).fit(rows))


@query("ridge_fit", """
WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem),
s AS (SELECT sum((l_quantity - mx) * (l_extendedprice - my)) / (sum((l_quantity - mx) * (l_quantity - mx)) + 1000.0) AS b FROM lineitem, m)
SELECT round(b, 4) AS slope, round(my - b * mx, 2) AS intercept FROM s, m""")
def ridge_fit(spark, sf):
    rows, facts = _one_feature(table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice")
    return _line(spark, ridge_regression(Settings(), facts, alpha=1000.0).fit(rows))


@query("lasso_fit", """
WITH m AS (SELECT avg(l_discount) AS mx, avg(l_tax) AS my FROM lineitem),
s AS (SELECT avg((l_discount - mx) * (l_tax - my)) AS cxy, avg((l_discount - mx) * (l_discount - mx)) AS cxx FROM lineitem, m),
b AS (SELECT sign(cxy) * greatest(abs(cxy) - 0.0000001, 0) / cxx AS b FROM s)
SELECT round(b, 4) AS slope, round(my - b * mx, 2) AS intercept FROM b, m""")
def lasso_fit(spark, sf):
    rows, facts = _one_feature(table(spark, sf, "lineitem").select("l_discount", "l_tax"), "l_discount", "l_tax")
    return _line(spark, lasso_regression(Settings(), facts, alpha=1e-7).fit(rows))


@query("predict_linear", """
SELECT l_orderkey, l_quantity, round(slope * l_quantity + intercept, 2) AS prediction
FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept FROM lineitem)""")
def predict_linear(spark, sf):
    rows, facts = _one_feature(
        table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice"
    )
    scored = linear_regression(Settings(), facts).fit(rows).transform(rows)
    return scored.select("l_orderkey", "l_quantity", F.round("prediction", 2).alias("prediction"))


# -- neighbours --------------------------------------------------------------------

SPENDING = """spending AS (
  SELECT c_custkey AS id, CAST(c_acctbal AS DOUBLE) AS a, CAST(c_nationkey AS DOUBLE) AS b, count(o_orderkey) AS label
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2, 3)"""


NEAR_CUSTOMERS = f"""
WITH {SPENDING},
near AS (SELECT s.s_suppkey AS id, t.label,
                row_number() OVER (PARTITION BY s.s_suppkey ORDER BY (s.s_acctbal - t.a) * (s.s_acctbal - t.a)
                                   + (s.s_nationkey - t.b) * (s.s_nationkey - t.b), t.id) AS place
         FROM supplier s, spending t)
SELECT id, round(avg(label), 4) AS prediction FROM near WHERE place <= 5 GROUP BY id"""


def near_customers(spark, sf):
    """Customers with their number of orders, suppliers to ask about."""
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    known = customer.join(orders.select("o_custkey", "o_orderkey"), customer.c_custkey == orders.o_custkey, "left")
    known = known.groupBy(F.col("c_custkey").alias("id"), "c_acctbal", "c_nationkey").agg(F.count("o_orderkey").alias("label"))
    train = known.select("id", "label", F.array("c_acctbal", F.col("c_nationkey").cast("double")).alias("vector"))
    asked = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.array("s_acctbal", F.col("s_nationkey").cast("double")).alias("vector")
    )
    return asked, train


@query("knn_regress", NEAR_CUSTOMERS)
def knn_regress(spark, sf):
    """How many orders to expect from a supplier's five most similar customers."""
    return M.knn_regress(*near_customers(spark, sf)).withColumn("prediction", F.round("prediction", 4))


@query("knn_regress_cells", NEAR_CUSTOMERS)
def knn_regress_cells(spark, sf):
    """The same by the pruned join, as training sets beyond SMALL_ROWS take it."""
    return M.knn_regress(*near_customers(spark, sf), small_rows=0).withColumn("prediction", F.round("prediction", 4))


LIKE_VECTORS = """
WITH v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
near AS (SELECT a.id, b.label, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.e, b.e), b.id) AS place
         FROM v a JOIN v b ON a.id <> b.id),
votes AS (SELECT id, label, count(*) AS n FROM near WHERE place <= 5 GROUP BY id, label)
SELECT id, label AS prediction FROM votes QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1"""


def labelled_vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vector")
    )


@query("knn_classify", LIKE_VECTORS)
def knn_classify(spark, sf):
    """Each embedding labelled by its five nearest others."""
    vectors = labelled_vectors(spark, sf)
    return M.knn_classify(vectors, vectors, exclude_self=True)


@query("knn_classify_cells", LIKE_VECTORS)
def knn_classify_cells(spark, sf):
    """The same by the pruned join."""
    vectors = labelled_vectors(spark, sf)
    return M.knn_classify(vectors, vectors, exclude_self=True, small_rows=0)


# -- metrics -----------------------------------------------------------------------

SCORED = """scored AS (
  SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label,
         CASE WHEN o_totalprice > 300000 THEN 0 WHEN o_totalprice > 120000 THEN 1 ELSE 2 END AS prediction,
         CASE WHEN o_orderpriority <= '2-HIGH' THEN 1 ELSE 0 END AS urgent, round(o_totalprice / 500000, 3) AS score,
         o_totalprice AS y, 200000 + 10.0::DOUBLE * o_custkey AS y_hat
  FROM orders)"""


def scored(spark, sf):
    """Labels, predictions and scores that follow from the order by fixed rules."""
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("label"),
        F.when(price > 300000, 0).when(price > 120000, 1).otherwise(2).alias("prediction"),
        F.when(F.col("o_orderpriority") <= "2-HIGH", 1).otherwise(0).alias("urgent"),
        F.round(price / 500000, 3).alias("score"), price.alias("y"), (200000 + 10.0 * F.col("o_custkey")).alias("y_hat"),
    )


PER_CLASS = f"""
WITH {SCORED},
classes AS (SELECT DISTINCT label AS c FROM scored UNION SELECT DISTINCT prediction FROM scored),
per AS (SELECT c, (SELECT count(*) FROM scored WHERE label = c) AS support, (SELECT count(*) FROM scored WHERE prediction = c) AS predicted,
               (SELECT count(*) FROM scored WHERE label = c AND prediction = c) AS hits FROM classes)
"""


def _metric(key: str, formula: str):
    name = key.removeprefix("metric_")

    @query(key, f"{PER_CLASS} SELECT round({formula}, 6) AS {name} FROM per")
    def run(spark, sf):
        return M.classification_metrics(scored(spark, sf)).select(F.round(name, 6).alias(name))

    return run


_metric("metric_accuracy", "sum(hits) / sum(support)")
_metric("metric_precision", "sum(CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted * support END) / sum(support)")
_metric("metric_recall", "sum(CASE WHEN support = 0 THEN 0 ELSE hits / support * support END) / sum(support)")
_metric("metric_f1", "sum(CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hits / (support + predicted) * support END) / sum(support)")


@query("metric_roc_auc", f"""
WITH {SCORED},
ranked AS (SELECT urgent, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM scored)
SELECT round((sum(CASE WHEN urgent = 1 THEN r END) - count(*) FILTER (urgent = 1) * (count(*) FILTER (urgent = 1) + 1) / 2.0::DOUBLE)
             / (count(*) FILTER (urgent = 1) * CAST(count(*) FILTER (urgent = 0) AS DOUBLE)), 6) AS roc_auc
FROM ranked""")
def metric_roc_auc(spark, sf):
    return M.roc_auc(scored(spark, sf), "urgent", "score").select(F.round("roc_auc", 6).alias("roc_auc"))


@query("metric_regression", f"""
WITH {SCORED}
SELECT round(1 - sum((y - y_hat) * (y - y_hat)) / (count(*) * var_pop(y)), 6) AS r2, round(avg((y - y_hat) * (y - y_hat)) / 1e6, 4) AS mse_millions,
       round(sqrt(avg((y - y_hat) * (y - y_hat))), 4) AS rmse, round(avg(abs(y - y_hat)), 4) AS mae
FROM scored""")
def metric_regression(spark, sf):
    found = M.regression_metrics(scored(spark, sf), "y", "y_hat")
    return found.select(
        F.round("r2", 6).alias("r2"), F.round(F.col("mse") / 1e6, 4).alias("mse_millions"),
        F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"),
    )


@query("decode_labels", f"""
WITH {SCORED} SELECT o_orderkey, CASE prediction WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS prediction FROM scored""")
def decode_labels(spark, sf):
    classes = M.target_classes(table(spark, sf, "orders"), "o_orderstatus")
    return M.decode_labels(scored(spark, sf).select("o_orderkey", "prediction"), "prediction", classes)


# -- selection, importance, persistence, scoring -----------------------------------


def line_features(spark, sf):
    """Line items with what their price may depend on."""
    return table(spark, sf, "lineitem").join(
        table(spark, sf, "part").select("p_partkey", "p_type", "p_size", "p_retailprice"),
        F.col("l_partkey") == F.col("p_partkey"),
    ).select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "p_type", "p_size", "p_retailprice", "l_extendedprice")


LINE_KEY = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice"]


def customer_orders(spark, sf):
    """Customers with what they ordered, for predicting the segment."""
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("spent"), F.max("o_orderpriority").alias("least_priority")
    )
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")


def doc_quality(spark, sf):
    """Documents with a quality label and a few plain traits of the whole text.

    The traits are written once: fitting reads its table many times, the texts are read once.
    """
    docs = table(spark, sf, "documents").select(
        "doc_id", "lang", "source", "n_chars", F.size(F.split("text", r"\s+")).alias("words"),
        F.size(F.split("text", "\n")).alias("lines"), F.size(F.split("text", "[.!?]")).alias("sentences"),
    )
    return cut_lineage(docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id"))


@query("model_leaderboard")
def model_leaderboard(spark, sf):
    """All classifiers on document quality, at the library's own sizes."""
    problem = M.prepare_problem(doc_quality(spark, sf), "quality", key=["doc_id"])
    return M.compare_models(problem)


@query("model_leaderboard_regression")
def model_leaderboard_regression(spark, sf):
    """All regressors on the retail price of parts, at the library's own sizes."""
    rows = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    return M.compare_models(M.prepare_problem(rows, "p_retailprice", key=["p_partkey"]))


@query("train_best")
def train_best(spark, sf):
    """The whole route: compare, refit the winner, score all rows with it."""
    rows = doc_quality(spark, sf)
    model, _ = M.train_best(rows, "quality", key=["doc_id"])
    return model.predict(rows)


# One feature, so that SQL can follow the whole route: split by key hash, fit on the
# training part, score.
QUANTITY_KEY = ["l_orderkey", "l_partkey", "l_linenumber"]
QUANTITY_SPLIT = """split AS (
  SELECT *, ('0x' || substr(md5('42:' || l_orderkey || ':' || l_partkey || ':' || l_linenumber), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2 AS is_test
  FROM lineitem),
line AS (SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept,
                stddev_pop(l_quantity) AS spread FROM split WHERE NOT is_test)"""


def quantity_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")


def _quantity_model(spark, sf):
    problem = M.prepare_problem(quantity_rows(spark, sf), "l_extendedprice", key=QUANTITY_KEY, features=["l_quantity"])
    return M.fit_model(problem, "Linear Regression")


@query("fit_best", f"""
WITH {QUANTITY_SPLIT},
e AS (SELECT l_extendedprice AS y, l_extendedprice - (slope * l_quantity + intercept) AS d FROM split, line WHERE is_test)
SELECT round(1 - sum(d * d) / (count(*) * var_pop(y)), 6) AS r2, round(sqrt(avg(d * d)), 3) AS rmse, round(avg(abs(d)), 3) AS mae FROM e""")
def fit_best(spark, sf):
    """Holdout metrics of a linear model fitted on the training split."""
    found = _quantity_model(spark, sf).meta["metrics"]
    return spark.createDataFrame(
        [(round(found["r2"], 6), round(found["rmse"], 3), round(found["mae"], 3))], "r2 double, rmse double, mae double"
    )


@query("predict_batch", f"""
WITH {QUANTITY_SPLIT}
SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, round(slope * l_quantity + intercept, 2) AS prediction
FROM split, line""")
def predict_batch(spark, sf):
    return _quantity_model(spark, sf).predict(quantity_rows(spark, sf)).withColumn("prediction", F.round("prediction", 2))


@query("feature_importance_single", f"WITH {QUANTITY_SPLIT} SELECT 'l_quantity' AS feature, round(abs(slope * spread), 3) AS importance FROM line")
def feature_importance_single(spark, sf):
    found = _quantity_model(spark, sf).feature_importance(spark)
    return found.withColumn("importance", F.round("importance", 3))


def _line_model(spark, sf):
    return M.fit_model(M.prepare_problem(line_features(spark, sf), "l_extendedprice", key=LINE_KEY), "Linear Regression")


def _quality_model(spark, sf, name="Random Forest"):
    return M.fit_model(M.prepare_problem(doc_quality(spark, sf), "quality", key=["doc_id"]), name)


@query("predict_batch_wide", """
SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, true AS scored
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def predict_batch_wide(spark, sf):
    """Numeric and one-hot features of a joined table: every row is scored once."""
    done = _line_model(spark, sf).predict(line_features(spark, sf))
    return done.select(*LINE_KEY, F.col("prediction").isNotNull().alias("scored"))


def _shares_agree(scored, key: str):
    """(key, whole, likeliest): the shares add up to one, and the prediction has the largest."""
    shares = [c for c in scored.columns if c.startswith("prob_")]
    total = sum((F.col(c) for c in shares[1:]), F.col(shares[0]))
    own = F.element_at(F.create_map(*[x for c in shares for x in (F.lit(c.removeprefix("prob_")), F.col(c))]),
                       F.col("prediction").cast("string"))
    return scored.select(key, (F.abs(total - 1) < 1e-9).alias("whole"), (own == F.greatest(*shares)).alias("likeliest"))


@query("predict_proba", "SELECT doc_id, true AS whole, true AS likeliest FROM documents JOIN labels USING (doc_id)")
def predict_proba(spark, sf):
    return _shares_agree(_quality_model(spark, sf).predict(doc_quality(spark, sf)), "doc_id")


@query("predict_segment", "SELECT c_custkey, true AS whole, true AS likeliest FROM customer")
def predict_segment(spark, sf):
    """Several text classes, with missing feature values to impute."""
    return _shares_agree(_segments(spark, sf), "c_custkey")


def _segments(spark, sf):
    rows = customer_orders(spark, sf)
    model = M.fit_model(M.prepare_problem(rows, "c_mktsegment", key=["c_custkey"]), "Logistic Regression")
    return model.predict(rows)


@query("feature_importance_tree", """
WITH d AS (SELECT lang, source FROM documents JOIN labels USING (doc_id))
SELECT unnest(['doc_id', 'n_chars', 'words', 'lines', 'sentences']) AS feature, true AS present
UNION SELECT 'lang_' || lang, true FROM d UNION SELECT 'source_' || source, true FROM d
UNION ALL SELECT '(sum)', true""")
def feature_importance_tree(spark, sf):
    """Every prepared feature has a share, and the shares add up to one."""
    found = _quality_model(spark, sf).feature_importance(spark)
    total = found.agg(F.lit("(sum)").alias("feature"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("present"))
    return found.select("feature", (F.col("importance") >= 0).alias("present")).union(total)


@query("feature_importance_linear", """
SELECT unnest(['l_quantity', 'l_discount', 'p_size', 'p_retailprice']) AS feature, true AS present
UNION SELECT 'p_type_' || p_type, true FROM part JOIN lineitem ON l_partkey = p_partkey""")
def feature_importance_linear(spark, sf):
    problem = M.prepare_problem(line_features(spark, sf), "l_extendedprice", key=LINE_KEY,
                                features=["l_quantity", "l_discount", "p_type", "p_size", "p_retailprice"])
    found = M.fit_model(problem, "Linear Regression").feature_importance(spark)
    return found.select("feature", (F.col("importance") >= 0).alias("present"))


@query("model_info", """
SELECT 'task_type' AS property, 'classification' AS value UNION ALL SELECT 'target_column', 'quality'
UNION ALL SELECT 'model', 'Decision Tree' UNION ALL SELECT 'target_type', 'int'
UNION ALL SELECT 'classes', '["' || string_agg(q, '", "' ORDER BY q) || '"]'
          FROM (SELECT DISTINCT CAST(quality AS VARCHAR) AS q FROM documents JOIN labels USING (doc_id))
UNION ALL SELECT 'metrics', 'given' UNION ALL SELECT 'numeric_columns', '["doc_id", "n_chars", "words", "lines", "sentences"]'
UNION ALL SELECT 'categorical_columns', '["lang", "source"]'""")
def model_info(spark, sf):
    """What a saved model tells about itself; of the scores only that they are there."""
    info = _quality_model(spark, sf, "Decision Tree").info(spark)
    fixed = ["task_type", "target_column", "model", "target_type", "classes", "metrics", "numeric_columns", "categorical_columns"]
    return info.where(F.col("property").isin(fixed)).withColumn(
        "value", F.when((F.col("property") == "metrics") & F.col("value").contains("accuracy"), "given").otherwise(F.col("value")))


@query("model_roundtrip", "SELECT doc_id, true AS same FROM documents JOIN labels USING (doc_id)")
def model_roundtrip(spark, sf):
    """A model scores the same before it is saved and after it is loaded."""
    path, model, rows = scratch_path(spark, "model"), _quality_model(spark, sf), doc_quality(spark, sf)
    model.save(spark, path)
    first = model.predict(rows).select("doc_id", F.struct("prediction", "prob_0", "prob_1").alias("first"))
    again = M.TrainedModel.load(spark, path).predict(rows).select("doc_id", F.struct("prediction", "prob_0", "prob_1").alias("again"))
    return first.join(again, "doc_id").select("doc_id", F.col("first").eqNullSafe(F.col("again")).alias("same"))


@query("stream_predict", f"""
WITH {QUANTITY_SPLIT}
SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, round(slope * l_quantity + intercept, 2) AS prediction
FROM split, line""")
def stream_predict(spark, sf):
    """A model fitted on the batch scores the table as a stream."""
    model, names = _quantity_model(spark, sf), quantity_rows(spark, sf).columns
    done = through_stream(
        spark, f"{sf}/lineitem*.parquet", table(spark, sf, "lineitem").schema, lambda s: predict_stream(s.select(*names), model)
    )
    return done.withColumn("prediction", F.round("prediction", 2))


# One round, depth one, one yes/no feature: the Newton step of a side has a closed form.
@query("softmax_round", """
WITH cells AS (SELECT l_linestatus, l_returnflag, count(*) AS c FROM lineitem GROUP BY ALL),
sides AS (SELECT l_linestatus, sum(c) AS n FROM cells GROUP BY ALL),
classes AS (SELECT l_returnflag, sum(c) / (SELECT count(*) FROM lineitem) AS p FROM cells GROUP BY ALL),
scores AS (
  SELECT l_linestatus, l_returnflag,
         ln(p) + 0.1 * ((SELECT count(*) FROM classes) - 1) / (SELECT count(*) FROM classes)
                     * (coalesce(c, 0) / n - p) / (p * (1 - p)) AS score
  FROM sides CROSS JOIN classes LEFT JOIN cells USING (l_linestatus, l_returnflag))
SELECT l_linestatus, l_returnflag, round(exp(score) / sum(exp(score)) OVER (PARTITION BY l_linestatus), 6) AS share
FROM scores""")
def softmax_round(spark, sf):
    """Shares of the return flags after one boosting round on the line status."""
    lines = table(spark, sf, "lineitem").select("l_linestatus", "l_returnflag")
    flags = sorted(r[0] for r in lines.select("l_returnflag").distinct().collect())  # three flags
    place = F.array_position(F.array(*map(F.lit, flags)), F.col("l_returnflag")) - 1
    shown = lines.select(
        "l_linestatus", place.cast("double").alias("label"),
        array_to_vector(F.array((F.col("l_linestatus") == "O").cast("double"))).alias("features"))
    scored = SoftmaxBoosting(len(flags), rounds=1, depth=1).fit(shown).transform(shown.dropDuplicates(["l_linestatus"]))
    return scored.select("l_linestatus", F.posexplode("probability").alias("at", "share")).select(
        "l_linestatus", F.get(F.array(*map(F.lit, flags)), F.col("at")).alias("l_returnflag"), F.round("share", 6).alias("share"))


# -- single candidates, each fitted and scored on its holdout ------------------------


def _candidate(key: str, build, name: str):
    @query(key)
    def run(spark, sf):
        model = M.fit_model(build(spark, sf), name)
        return spark.createDataFrame(
            [(name, k, v) for k, v in model.meta["metrics"].items()], "model string, metric string, value double"
        )

    return run


def _price_problem(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    return M.prepare_problem(rows, "p_retailprice", key=["p_partkey"])


def _quality_problem(spark, sf):
    return M.prepare_problem(doc_quality(spark, sf), "quality", key=["doc_id"])


for _name in M.pool_of("regression", others=True):
    _candidate("regressor_" + _name.lower().replace(" ", "_").replace("-", "_"), _price_problem, _name)
for _name in M.pool_of("classification", others=True):
    _candidate("classifier_" + _name.lower().replace(" ", "_").replace("-", "_"), _quality_problem, _name)


@query("model_on_label_column", "SELECT vec_id, label, true AS scored FROM embeddings")
def model_on_label_column(spark, sf):
    """A table whose feature has the name of a Spark ML column."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    problem = M.prepare_problem(rows, "x", "regression", key=["vec_id"], features=["label"])
    done = M.fit_model(problem, "Linear Regression").predict(rows)
    return done.select("vec_id", "label", F.col("prediction").isNotNull().alias("scored"))


@query("onehot_features_wide", """
SELECT l_orderkey, l_linenumber, 1 AS ones,
       dense_rank() OVER (ORDER BY l_orderkey || '-' || l_linenumber) - 1 AS place FROM lineitem""")
def onehot_features_wide(spark, sf):
    """A text feature with nearly as many values as rows, as a sparse vector."""
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"))
    state = M.fit_features(rows, [], ["line"])
    ready = M.feature_pipeline(rows, state).transform(rows)
    # a sparse vector as JSON names its only place
    packed = F.from_json(F.to_json(F.struct("features")), "features struct<indices:array<bigint>,values:array<double>>")
    return ready.select("l_orderkey", "l_linenumber", packed["features"].alias("f")).select(
        "l_orderkey", "l_linenumber", F.size("f.values").alias("ones"), F.get("f.indices", F.lit(0)).alias("place"))


@query("onehot_features_joined", """
WITH filled AS (SELECT o_orderkey, o_totalprice AS x, coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), (
         SELECT o_orderpriority FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS p,
       o_orderstatus AS s, CAST(o_custkey AS VARCHAR) AS c FROM orders),
places AS (SELECT *, dense_rank() OVER (ORDER BY p) - 1 AS at_p, dense_rank() OVER (ORDER BY c) - 1 AS at_c, dense_rank() OVER (ORDER BY s) - 1 AS at_s FROM filled)
SELECT o_orderkey, round((x - (SELECT avg(x) FROM places)) / (SELECT stddev_pop(x) FROM places), 6) AS price,
       1 + at_s AS status_place,
       1 + (SELECT count(DISTINCT s) FROM places) + at_p AS priority_place,
       1 + (SELECT count(DISTINCT s) FROM places) + (SELECT count(DISTINCT p) FROM places) + at_c AS customer_place FROM places""")
def onehot_features_joined(spark, sf):
    """Codes of two columns joined from their tables, one beside a listed column and a number, all in one sparse vector."""
    rows = orders_gaps(spark, sf).withColumn("customer", F.col("o_custkey").cast("string")).drop("o_totalprice").join(
        table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    state = M.fit_features(rows, ["o_totalprice"], ["o_orderstatus", "o_orderpriority", "customer"], most_listed=3)
    ready = M.feature_pipeline(rows, state).transform(rows)
    packed = F.from_json(F.to_json(F.struct("features")), "features struct<indices:array<bigint>,values:array<double>>")
    f = ready.select("o_orderkey", packed["features"].alias("f"))
    return f.select("o_orderkey", F.round(F.get("f.values", F.lit(0)), 6).alias("price"), *[
        F.get("f.indices", F.lit(i)).alias(n) for i, n in ((1, "status_place"), (2, "priority_place"), (3, "customer_place"))])


@query("encode_target_wide", """
SELECT l_orderkey, l_linenumber, CAST(dense_rank() OVER (ORDER BY l_orderkey || '-' || l_linenumber) - 1 AS DOUBLE) AS label,
       l_orderkey || '-' || l_linenumber AS decoded FROM lineitem""")
def encode_target_wide(spark, sf):
    """A target with nearly as many classes as rows: coded and decoded by joins, no class on the driver."""
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"))
    classes = M.target_vocabulary(rows, "line", most_listed=0)
    return M.decode_labels(M.label_codes(rows, "line", classes), "label", classes, "decoded").select(
        "l_orderkey", "l_linenumber", "label", "decoded")


@query("encode_target_numbers", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS DOUBLE) AS label, o_custkey AS decoded FROM orders""")
def encode_target_numbers(spark, sf):
    """Numeric classes keep the order of numbers in their table."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    classes = M.target_vocabulary(rows, "o_custkey", most_listed=0)
    return M.decode_labels(M.label_codes(rows, "o_custkey", classes), "label", classes, "decoded", "bigint").select(
        "o_orderkey", "label", "decoded")


@query("extra_trees_split", """
SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_orderstatus = 'F'), 3) AS prediction FROM orders""")
def extra_trees_split(spark, sf):
    """One feature of two values and one split: whatever the threshold drawn, a tree predicts the mean of a row's side."""
    rows = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").cast("double").alias("done"), F.col("o_totalprice").alias("label"))
    ready = VectorAssembler(inputCols=["done"], outputCol="features").transform(rows)
    model = ExtraTrees(RandomForestRegressor(numTrees=8, maxDepth=1), lambda n: 8 * n).fit(ready)
    return model.transform(ready).select("o_orderkey", F.round("prediction", 3).alias("prediction"))
