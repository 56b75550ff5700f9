"""Scores, models, explanations and the whole plan."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks.feature_queries import (
    CLASS_SQL,
    INTERACTIONS,
    POLYNOMIAL,
    SEVERITY_SQL,
    STATS,
    body_sql,
    demographic_sql,
    flags_sql,
    seasonal_sql,
    stats_sql,
)
from checks.roles import (
    ANALYTES,
    GROUPS,
    LABELLED_SQL,
    LIMITS,
    SURVEY_SQL,
    Tables,
    labelled,
    mix_sql,
    query,
    r6,
    survey,
)
from checks.table_queries import _mode_sql
from panelwise.operators import boosting, explain, forests, metrics, models, prepare
from panelwise.options import Training
from panelwise.plans.pipeline import feature_table, with_row_key
from panelwise.session import new_table_path

# --------------------------------------------------------------------------------------------
# scores of fixed rules

_RULED_SQL = f"""{LABELLED_SQL}, ruled AS (SELECT *, CAST(CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS INTEGER) AS guess,
  CAST(CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS INTEGER) AS guess_lang,
  CAST(doc_id % 2 AS INTEGER) AS guess_odd, CAST(floor(n_chars / 100) AS DOUBLE) AS score FROM labelled)"""


def ruled(t: Tables):
    return labelled(t).select(
        "*",
        (F.col("n_chars") > 500).cast("int").alias("guess"),
        (F.col("lang") == "en").cast("int").alias("guess_lang"),
        (F.col("doc_id") % 2).cast("int").alias("guess_odd"),
        F.floor(F.col("n_chars") / 100).cast("double").alias("score"),
    )


@query(
    "confusion_matrix",
    f"""WITH {_RULED_SQL}, classes AS (SELECT 0 AS actual UNION ALL SELECT 1 UNION ALL SELECT 2)
    SELECT CAST(actual AS INTEGER) AS actual, count(CASE WHEN guess = 0 THEN 1 END) AS predicted_0,
    count(CASE WHEN guess = 1 THEN 1 END) AS predicted_1, count(CASE WHEN guess = 2 THEN 1 END) AS predicted_2
    FROM classes LEFT JOIN ruled ON actual = quality GROUP BY 1""",
)
def _(t: Tables):
    return metrics.confusion_matrix(ruled(t), "quality", "guess", [0, 1, 2])


def _rates_sql(guess: str, source: str = "ruled", label: str = "quality") -> str:
    """CTEs that end in ``rates``: one row per class."""
    return f"""cells AS (SELECT {label} AS a, {guess} AS p, count(*) AS n FROM {source} GROUP BY 1, 2),
    seen AS (SELECT a AS class FROM cells UNION SELECT p FROM cells),
    sums AS (SELECT class, coalesce(sum(CASE WHEN a = class THEN n END), 0) AS support,
      coalesce(sum(CASE WHEN p = class THEN n END), 0) AS predicted,
      CAST(coalesce(sum(CASE WHEN a = class AND p = class THEN n END), 0) AS DOUBLE) AS hits FROM seen, cells GROUP BY 1),
    two AS (SELECT *, coalesce(hits / nullif(predicted, 0), 0) AS pr, coalesce(hits / nullif(support, 0), 0) AS re FROM sums),
    rates AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f FROM two)"""


_REPORT_SQL = f"""WITH {_RULED_SQL}, {_rates_sql('guess')}, report AS (
    SELECT CAST(class AS VARCHAR) AS entry, pr, re, f, support FROM rates
    UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support) FROM rates
    UNION ALL SELECT 'macro avg', avg(pr), avg(re), avg(f), sum(support) FROM rates
    UNION ALL SELECT 'weighted avg', sum(pr * support) / sum(support), sum(re * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM rates)
    SELECT entry, {r6('pr', 'precision')}, {r6('re', 'recall')}, {r6('f', 'f1_score')}, CAST(support AS BIGINT) AS support FROM report"""


@query("classification_report", _REPORT_SQL)
def _(t: Tables):
    return metrics.classification_report(ruled(t), "quality", "guess")


_SCORES_SQL = f"""SELECT {r6('sum(hits) / sum(support)', 'accuracy')}, {r6('sum(pr * support) / sum(support)', 'precision')},
  {r6('sum(re * support) / sum(support)', 'recall')}, {r6('sum(f * support) / sum(support)', 'f1_score')} FROM rates"""


@query("classification_scores", f"WITH {_RULED_SQL}, {_rates_sql('guess')} {_SCORES_SQL}")
def _(t: Tables):
    return metrics.classification_scores(ruled(t), "quality", "guess")


@query(
    "roc_auc",
    f"""WITH {_RULED_SQL}, pairs AS (SELECT CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END AS won
    FROM ruled a JOIN ruled b ON a.quality = 1 AND b.quality = 0) SELECT {r6('avg(won)', 'roc_auc')} FROM pairs""",
)
def _(t: Tables):
    return metrics.roc_auc(ruled(t), "quality", "score")


@query(
    "roc_auc_events",
    """WITH s AS (SELECT value AS score, CAST(event_type = 'purchase' AS INTEGER) AS y FROM events),
    ranked AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s),
    sums AS (SELECT sum(CASE WHEN y = 1 THEN r END) AS r1, CAST(sum(y) AS DOUBLE) AS p, CAST(count(*) - sum(y) AS DOUBLE) AS n FROM ranked)
    SELECT round((r1 - p * (p + 1) / 2) / (p * n), 6) + 0.0 AS roc_auc FROM sums""",
)
def _(t: Tables):
    rows = t.events.select("value", (F.col("event_type") == "purchase").cast("int").alias("y"))
    return metrics.roc_auc(rows, "y", "value")


_PRICE_SQL = """priced AS (SELECT l_extendedprice AS y, l_quantity * 2000.0 AS p FROM lineitem)"""


@query(
    "regression_metrics",
    f"""WITH {_PRICE_SQL} SELECT {r6('avg(pow(y - p, 2)) / 1e6', 'mse')}, {r6('sqrt(avg(pow(y - p, 2))) / 1e3', 'rmse')},
    {r6('avg(abs(y - p)) / 1e3', 'mae')}, {r6('1 - avg(pow(y - p, 2)) / var_pop(y)', 'r2_score')},
    {r6('1 - var_pop(y - p) / var_pop(y)', 'explained_variance')} FROM priced""",
)
def _(t: Tables):
    rows = t.lineitem.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000.0).alias("p"))
    scores = metrics.regression_scores(rows, "y", "p")
    return scores.select(
        (F.col("mse") / 1e6).alias("mse"), (F.col("rmse") / 1e3).alias("rmse"), (F.col("mae") / 1e3).alias("mae"), "r2_score", "explained_variance"
    )


_GUESSES = ("guess", "guess_lang", "guess_odd")


def _best_sql() -> str:
    parts = []
    for i, (target, guess) in enumerate((t, g) for t in ("quality", "long") for g in _GUESSES):
        parts.append(
            f"SELECT '{target}' AS task, '{guess}' AS model, {i % 3} AS ordinal, "
            f"(SELECT sum(f * support) / sum(support) FROM (WITH {_rates_sql(guess, 'targets', target)} SELECT * FROM rates)) AS score"
        )
    return (
        f"WITH {_RULED_SQL}, targets AS (SELECT *, CAST(CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS INTEGER) AS long FROM ruled), "
        f"scores AS ({' UNION ALL '.join(parts)}), ranked AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC, ordinal) AS place FROM scores) "
        f"SELECT task, model, {r6('score', 'score')} FROM ranked WHERE place = 1"
    )


@query("best_model", _best_sql())
def _(t: Tables):
    rows = ruled(t).withColumn("long", (F.col("n_chars") > 400).cast("int"))
    parts = [
        metrics.classification_scores(rows, target, guess).select(
            F.lit(target).alias("task"), F.lit(guess).alias("model"), F.lit(i).alias("ordinal"), F.col("f1_score").alias("score")
        )
        for target in ("quality", "long")
        for i, guess in enumerate(_GUESSES)
    ]
    return metrics.best_models(reduce(lambda a, b: a.unionByName(b), parts))


# --------------------------------------------------------------------------------------------
# models

_QUICK = Training(trees=20, max_depth=5, boost_rounds=10, network_iterations=30, hidden=(16, 8), folds=3)


def _survey_features(t: Tables, **options):
    return feature_table(survey(t), None, ANALYTES, GROUPS, opts=LIMITS, narrow=False, **options)


def _text_input(t: Tables):
    rows = labelled(t).withColumn("words_per_char", F.col("n_spaces") / (F.col("n_chars") + 1))
    return prepare.model_input(rows, "quality", "doc_id", features=["n_chars", "n_spaces", "words_per_char"])


@query("train_classifiers")
def _(t: Tables):
    done = models.train_classifiers(_text_input(t), "doc_id", "quality", _QUICK)
    return models.scores_table(t.spark, {"quality": done})


@query("train_default")
def _(t: Tables):
    """All classifiers at the default settings: 100 trees without a limit of depth, 100 rounds, a
    network of 256-128-64, five folds."""
    done = models.train_classifiers(_text_input(t), "doc_id", "quality")
    return models.scores_table(t.spark, {"quality": done})


@query("train_multiclass")
def _(t: Tables):
    size = t.embeddings.agg(F.max(F.size("embedding"))).first()[0]
    names = [f"x{i}" for i in range(size)]
    wide = t.embeddings.select("vec_id", (F.col("label") % 3).alias("label3"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(names)])
    data = prepare.model_input(wide, "label3", "vec_id", features=names)
    done = models.train_classifiers(data, "vec_id", "label3", Training(trees=10, boost_rounds=5), ("random_forest", "gradient_boosting", "logistic_regression"), validate=False)
    return models.scores_table(t.spark, {"label3": done})


_ONE_TREE = dict(trees=1, bootstrap=False, task_rows=4_000)


@query(
    "exact_tree",
    f"""WITH {LABELLED_SQL} SELECT doc_id,
    CAST(CASE WHEN 2 * sum(quality) OVER same > count(*) OVER same THEN 1 ELSE 0 END AS DOUBLE) AS prediction
    FROM labelled WINDOW same AS (PARTITION BY n_chars, n_spaces)""",
)
def _(t: Tables):
    """A tree without limits tells all rows apart that differ: it predicts the class of most rows
    with the same values."""
    rows = prepare.assemble(labelled(t).withColumns({"label": F.col("quality").cast("double"), "weight": F.lit(1.0)}), ["n_chars", "n_spaces"])
    rows = rows.select("doc_id", "label", "weight", "features")
    return forests.grow_forest(rows, "doc_id", forests.Growth(2, **_ONE_TREE)).transform(rows).select("doc_id", "prediction")


@query(
    "reloaded_model",
    f"""WITH {LABELLED_SQL} SELECT doc_id, CAST(CASE WHEN 2 * sum(quality) OVER same > count(*) OVER same THEN 1 ELSE 0 END AS DOUBLE) AS prediction
    FROM labelled WINDOW same AS (PARTITION BY n_chars)""",
)
def _(t: Tables):
    """A model that predicts after it was saved and loaded."""
    rows = prepare.assemble(labelled(t).withColumns({"label": F.col("quality").cast("double"), "weight": F.lit(1.0)}), ["n_chars"])
    rows = rows.select("doc_id", "label", "weight", "features")
    path = new_table_path(t.spark, "model")
    forests.grow_forest(rows, "doc_id", forests.Growth(2, trees=1, bootstrap=False)).write().overwrite().save(path)
    return forests.Forest.load(path).transform(rows).select("doc_id", "prediction")


@query(
    "exact_regression_tree",
    f"""WITH o AS (SELECT o_orderkey, ln(1 + o_totalprice) AS y, month(o_orderdate) AS m, o_custkey % 50 AS band, length(o_orderpriority) AS p FROM orders)
    SELECT o_orderkey, {r6('avg(y) OVER (PARTITION BY m, band, p)', 'prediction')} FROM o""",
)
def _(t: Tables):
    """Beyond 4,000 rows the upper part of the tree comes from histograms; the leaves are the same."""
    rows = t.orders.select(
        "o_orderkey", F.log1p("o_totalprice").alias("label"), F.lit(1.0).alias("weight"),
        F.month("o_orderdate").cast("double").alias("m"), (F.col("o_custkey") % 50).cast("double").alias("band"), F.length("o_orderpriority").cast("double").alias("p"),
    )
    rows = prepare.assemble(rows, ["m", "band", "p"]).select("o_orderkey", "label", "weight", "features")
    return forests.grow_forest(rows, "o_orderkey", forests.Growth(None, **_ONE_TREE)).transform(rows).select("o_orderkey", "prediction")


@query(
    "boosted_stumps",
    f"""WITH d AS (SELECT c_nationkey % 3 AS y, c_acctbal AS f0, CAST(c_custkey % 7 AS DOUBLE) AS f1 FROM customer),
    prior AS (SELECT y AS k, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM d GROUP BY y),
    cells AS (SELECT k, 0 AS f, f0 AS x, CASE WHEN y = k THEN 1.0 ELSE 0.0 END - p AS r FROM d, prior
      UNION ALL SELECT k, 1, f1, CASE WHEN y = k THEN 1.0 ELSE 0.0 END - p FROM d, prior),
    v AS (SELECT k, f, x, count(*) AS n, sum(r) AS s, sum(abs(r) * (1 - abs(r))) AS h FROM cells GROUP BY k, f, x),
    c AS (SELECT k, f, x, lead(x) OVER w AS nx, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(h) OVER w AS lh,
      sum(n) OVER e AS n, sum(s) OVER e AS s, sum(h) OVER e AS h FROM v WINDOW w AS (PARTITION BY k, f ORDER BY x), e AS (PARTITION BY k, f)),
    best AS (SELECT * FROM c WHERE nx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY ls * ls / ln + (s - ls) * (s - ls) / (n - ln) DESC, f, x) = 1)
    SELECT CAST(k AS INTEGER) AS class_index, CAST(f AS INTEGER) AS feature, {r6('(x + nx) / 2', 'threshold')},
    round(2.0 / 3 * ls / lh, 5) + 0.0 AS left_step, round(2.0 / 3 * (s - ls) / (h - lh), 5) + 0.0 AS right_step FROM best""",
)
def _(t: Tables):
    """One round of trees with one split, and the Newton steps of their leaves."""
    rows = t.customer.select("c_custkey", (F.col("c_nationkey") % 3).cast("double").alias("label"), F.col("c_acctbal").alias("f0"), (F.col("c_custkey") % 7).cast("double").alias("f1"))
    fitted = boosting.BoostingEstimator("c_custkey", boosting.Boosting(3, rounds=1, max_depth=1)).fit(prepare.assemble(rows, ["f0", "f1"]))
    trees = fitted.rounds[0]
    cells = [(k, int(trees.feature[r]), float(trees.threshold[r]), *(round(float(trees.step[c[r]]), 5) for c in (trees.left, trees.right))) for k, r in enumerate(trees.roots)]
    return t.spark.createDataFrame(cells, "class_index int, feature int, threshold double, left_step double, right_step double")


def _order_input(t: Tables):
    rows = t.orders.select(
        "o_orderkey",
        F.log1p("o_totalprice").alias("log_total_ige"),
        F.month("o_orderdate").cast("double").alias("month"),
        (F.col("o_custkey") % 50).cast("double").alias("customer_band"),
        F.length("o_orderpriority").cast("double").alias("priority_length"),
        F.sqrt("o_totalprice").alias("root_price"),
    )
    return prepare.model_input(rows, "log_total_ige", "o_orderkey", classification=False)


@query("train_regressors")
def _(t: Tables):
    done = models.train_regressors(_order_input(t), "o_orderkey", "log_total_ige", _QUICK)
    return models.scores_table(t.spark, {"log_total_ige": done})


@query("model_importance")
def _(t: Tables):
    done = models.train_classifiers(
        _text_input(t), "doc_id", "quality", _QUICK, ("random_forest", "logistic_regression", "neural_network"), validate=False
    )
    return models.importance_table(t.spark, done)


@query(
    "ridge_closed_form",
    """WITH s AS (SELECT avg(l_quantity) AS mx, stddev_pop(l_quantity) AS sx, avg(l_extendedprice) AS my FROM lineitem),
    z AS (SELECT (l_quantity - mx) / sx AS x, l_extendedprice - my AS y FROM lineitem, s)
    SELECT 'l_quantity' AS feature, round(sum(x * y) / (sum(x * x) + 100.0), 4) + 0.0 AS coefficient,
    round((SELECT my FROM s), 4) + 0.0 AS intercept FROM z""",
)
def _(t: Tables):
    rows = t.lineitem.select("l_quantity", F.col("l_extendedprice").alias("label"))
    scaled = prepare.fit_scaler(rows, ["l_quantity"]).apply(rows)
    ready = prepare.assemble(scaled, ["l_quantity"])
    size = ready.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("s")).first()
    fitted = models.ridge_regressor(Training(ridge_alpha=100.0), size["n"], size["s"]).fit(ready)
    return t.spark.createDataFrame(
        [("l_quantity", round(float(fitted.coefficients[0]), 4), round(float(fitted.intercept), 4))],
        "feature string, coefficient double, intercept double",
    )


@query(
    "logistic_optimum",
    f"""WITH {LABELLED_SQL}, names AS (SELECT unnest(['n_chars', 'n_spaces', 'words_per_char']) AS feature)
    SELECT DISTINCT feature, CAST(1 AS INTEGER) AS at_optimum FROM labelled, names""",
)
def _(t: Tables):
    """Gradient of the weighted penalised loss at the fitted point: near zero in every direction."""
    data = _text_input(t)
    train = data.train
    total = train.agg(F.sum("weight")).first()[0]
    fitted = models.logistic_classifier(Training(), total).fit(train)
    beta = list(map(float, fitted.coefficients))
    scored = fitted.transform(train).select(
        "weight", "label", vector_to_array("features").alias("x"), F.get(vector_to_array("probability"), F.lit(1)).alias("p")
    )
    pull = F.col("weight") * (F.col("p") - F.col("label"))
    sums = scored.agg(*[F.sum(pull * F.get("x", F.lit(i))).alias(f"g{i}") for i in range(len(beta))])
    cells = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), (F.abs(F.col(f"g{i}") + beta[i]) < 1e-3).cast("int").alias("at_optimum"))
            for i, f in enumerate(data.features)
        ]
    )
    return sums.select(F.explode(cells).alias("c")).select("c.*")


# --------------------------------------------------------------------------------------------
# attributions

_BETAS = {"l_quantity": 2.0, "l_discount": -30.0, "l_tax": 12.5, "log_price": 0.75}


def _linear_rows(t: Tables):
    return t.lineitem.select(
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_suppkey") % 100).alias("row_id"),
        "l_quantity",
        "l_discount",
        "l_tax",
        F.log1p("l_extendedprice").alias("log_price"),
    )


_LINES_SQL = """lines AS (SELECT l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 AS row_id, l_quantity, l_discount, l_tax,
  ln(1 + l_extendedprice) AS log_price FROM lineitem), means AS (SELECT avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_tax) AS m3, avg(log_price) AS m4 FROM lines),
  phi AS (SELECT row_id, 'l_quantity' AS feature, 2.0 * (l_quantity - m1) AS phi FROM lines, means
  UNION ALL SELECT row_id, 'l_discount', -30.0 * (l_discount - m2) FROM lines, means
  UNION ALL SELECT row_id, 'l_tax', 12.5 * (l_tax - m3) FROM lines, means
  UNION ALL SELECT row_id, 'log_price', 0.75 * (log_price - m4) FROM lines, means)"""


def linear_phi(t: Tables):
    rows = _linear_rows(t)
    means = explain.background_means(rows, list(_BETAS))
    return explain.linear_attribution(rows, "row_id", _BETAS, means)


@query("linear_attribution", f"WITH {_LINES_SQL} SELECT row_id, feature, {r6('phi', 'phi')} FROM phi")
def _(t: Tables):
    return linear_phi(t)


@query(
    "global_importance",
    f"""WITH {_LINES_SQL} SELECT feature, CASE feature WHEN 'log_price' THEN 'Log(price)' WHEN 'l_quantity' THEN 'L Quantity'
    WHEN 'l_discount' THEN 'L Discount' ELSE 'L Tax' END AS name, {r6('avg(abs(phi))', 'importance')} FROM phi GROUP BY 1, 2
    ORDER BY importance DESC, feature LIMIT 3""",
)
def _(t: Tables):
    return explain.top_features(explain.global_importance(linear_phi(t)), 3)


_SUMMARY_SQL = f"""WITH {_LINES_SQL} SELECT {r6('avg(phi)', 'mean')}, {r6('stddev_pop(phi)', 'std')}, {r6('min(phi)', '"min"')},
  {r6('max(phi)', '"max"')}, {r6('quantile_cont(phi, 0.25)', 'q25')}, {r6('median(phi)', 'median')}, {r6('quantile_cont(phi, 0.75)', 'q75')} FROM phi"""


@query("attribution_summary", _SUMMARY_SQL)
def _(t: Tables):
    return explain.attribution_summary(linear_phi(t))


_PAIRS = ("l_quantity", "l_discount", "l_tax", "log_price", "product", "constant")


@query(
    "attribution_correlation",
    f"""WITH {_LINES_SQL}, wide AS (SELECT l_quantity, l_discount, l_tax, log_price, l_quantity * l_tax AS product, 1.0 AS constant FROM lines),
    pairs AS ({' UNION ALL '.join(f"SELECT '{a}' AS feature1, '{b}' AS feature2, corr({a}, {b}) AS r FROM wide" for i, a in enumerate(_PAIRS[:5]) for b in _PAIRS[i + 1:5])})
    SELECT feature1, feature2, {r6('r', 'correlation')} FROM pairs WHERE abs(r) > 0.3 ORDER BY abs(r) DESC, feature1, feature2 LIMIT 10""",
)
def _(t: Tables):
    wide = _linear_rows(t).select("*", (F.col("l_quantity") * F.col("l_tax")).alias("product"), F.lit(1.0).alias("constant"))
    return explain.attribution_correlation(wide, _PAIRS, 0.3)


@query(
    "attribution_matrix",
    f"""WITH {_LINES_SQL} SELECT row_id, {', '.join(r6(f"sum(CASE WHEN feature = '{f}' THEN phi END)", f) for f in _BETAS)} FROM phi GROUP BY 1""",
)
def _(t: Tables):
    return explain.attribution_matrix(linear_phi(t), "row_id", list(_BETAS))


# importances per part type ("model") and part name ("feature"), from the part table
_IMPORTANCE_SQL = """importance AS (SELECT p_type AS model, replace(p_name, ' ', '_') AS feature, avg(p_retailprice) / 1000 + max(p_size) / 100.0 AS importance FROM part GROUP BY 1, 2)"""
_PART_GROUPS = {"indoor": ("ring", "widget"), "outdoor": ("bolt", "gear"), "food": ("plate",)}


def _importances(t: Tables):
    return t.part.groupBy(F.col("p_type").alias("model"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("feature")).agg(
        (F.avg("p_retailprice") / 1000 + F.max("p_size") / 100.0).alias("importance")
    )


@query(
    "top_per_model",
    f"""WITH {_IMPORTANCE_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS place FROM importance)
    SELECT model, feature, {r6('importance', 'importance')}, CAST(place AS INTEGER) AS feature_rank FROM ranked WHERE place <= 3""",
)
def _(t: Tables):
    return explain.top_per_model(_importances(t), 3)


@query(
    "model_comparison",
    f"""WITH {_IMPORTANCE_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS place FROM importance)
    SELECT feature, {r6("coalesce(max(CASE WHEN model = 'ECONOMY' THEN importance END), 0.0)", '"ECONOMY"')},
    {r6("coalesce(max(CASE WHEN model = 'SMALL' THEN importance END), 0.0)", '"SMALL"')} FROM ranked WHERE place <= 10 GROUP BY 1""",
)
def _(t: Tables):
    return explain.model_comparison(_importances(t), ["ECONOMY", "SMALL"])


def _group_sql(feature: str) -> str:
    tests = " ".join(
        "WHEN " + " OR ".join(f"contains({feature}, '{m}')" for m in members) + f" THEN '{g}'" for g, members in _PART_GROUPS.items()
    )
    return f"CASE {tests} END"


@query(
    "group_importance",
    f"""WITH {_IMPORTANCE_SQL}, grouped AS (SELECT {_group_sql('feature')} AS analyte_group, importance FROM importance)
    SELECT analyte_group, count(*) AS n_features, {r6('avg(importance)', 'mean_importance')}, {r6('max(importance)', 'max_importance')}
    FROM grouped WHERE analyte_group IS NOT NULL GROUP BY 1""",
)
def _(t: Tables):
    return explain.group_importance(_importances(t), _PART_GROUPS)


def _title_sql(text: str) -> str:
    """Words of letters only: every word starts with a capital."""
    return f"array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split({text}, ' ')], ' ')"


@query(
    "readable_names",
    f"""WITH raw AS (SELECT p_partkey, replace(p_name, ' ', '_') AS stem, p_partkey % 7 AS form FROM part),
    named AS (SELECT p_partkey, form, stem, CASE form WHEN 0 THEN stem || '_sensitized' WHEN 1 THEN 'log_' || stem WHEN 2 THEN 'poly_' || p_partkey
      WHEN 3 THEN stem || '_interaction' WHEN 4 THEN 'log_LBXF24' WHEN 5 THEN 'xLbxf2_' || stem ELSE stem END AS feature FROM raw)
    SELECT p_partkey, feature, CASE form WHEN 0 THEN stem || ' Sensitization' WHEN 1 THEN 'Log(' || stem || ')' WHEN 2 THEN 'Polynomial ' || feature
      WHEN 4 THEN 'Shrimp' WHEN 5 THEN 'Milk' ELSE {_title_sql("replace(feature, '_', ' ')")} END AS name FROM named""",
)
def _(t: Tables):
    stem, form = F.col("stem"), F.col("p_partkey") % 7
    raw = t.part.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("stem"))
    feature = (
        F.when(form == 0, F.concat(stem, F.lit("_sensitized")))
        .when(form == 1, F.concat(F.lit("log_"), stem))
        .when(form == 2, F.concat(F.lit("poly_"), F.col("p_partkey")))
        .when(form == 3, F.concat(stem, F.lit("_interaction")))
        .when(form == 4, F.lit("log_LBXF24"))
        .when(form == 5, F.concat(F.lit("xLbxf2_"), stem))
        .otherwise(stem)
    )
    named = raw.select("p_partkey", feature.alias("feature"))
    return named.select("p_partkey", "feature", explain.readable_name(F.col("feature")).alias("name"))


@query(
    "interaction_families",
    """WITH f AS (SELECT DISTINCT CASE p_size % 5 WHEN 0 THEN 'age_' || p_name WHEN 1 THEN 'log_ige_' || p_name WHEN 2 THEN 'month_' || p_brand
      WHEN 3 THEN 'Oak_' || p_brand ELSE p_name END AS feature FROM part),
    tagged AS (SELECT 'age_ige' AS family, 'age' AS role, feature FROM f WHERE contains(lower(feature), 'age')
      UNION ALL SELECT 'age_ige', 'ige', feature FROM f WHERE contains(lower(feature), 'ige')
      UNION ALL SELECT 'season_outdoor', 'season', feature FROM f WHERE contains(lower(feature), 'season') OR contains(lower(feature), 'month')
      UNION ALL SELECT 'season_outdoor', 'outdoor', feature FROM f WHERE contains(feature, 'Ragweed') OR contains(feature, 'grass') OR contains(feature, 'Oak') OR contains(feature, 'Birch'))
    SELECT * FROM tagged WHERE family IN (SELECT family FROM tagged GROUP BY 1 HAVING count(DISTINCT role) = 2)""",
)
def _(t: Tables):
    size, name, brand = F.col("p_size") % 5, F.col("p_name"), F.col("p_brand")
    feature = (
        F.when(size == 0, F.concat(F.lit("age_"), name))
        .when(size == 1, F.concat(F.lit("log_ige_"), name))
        .when(size == 2, F.concat(F.lit("month_"), brand))
        .when(size == 3, F.concat(F.lit("Oak_"), brand))
        .otherwise(name)
    )
    return explain.interaction_families(t.part.select(feature.alias("feature")))


@query(
    "background_sample",
    f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {mix_sql('o_orderkey', 42)}, o_orderkey LIMIT 100",
)
def _(t: Tables):
    return explain.background_rows(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 100)


@query("first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500")
def _(t: Tables):
    return explain.first_rows(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 500)


_KEYED_SQL = "picked AS (SELECT min(row_id) AS k FROM lines)"


@query(
    "waterfall_table",
    f"""WITH {_LINES_SQL}, {_KEYED_SQL}, one AS (SELECT row_id, feature, sum(phi) AS phi FROM phi WHERE row_id = (SELECT k FROM picked) GROUP BY 1, 2)
    SELECT row_id, feature, {r6('phi', 'phi')}, CAST(row_number() OVER (ORDER BY abs(phi) DESC, feature) AS INTEGER) AS place,
    {r6('100.0 + sum(phi) OVER (ORDER BY abs(phi) DESC, feature ROWS UNBOUNDED PRECEDING)', 'prediction_upto')} FROM one""",
)
def _(t: Tables):
    phi = linear_phi(t).groupBy("row_id", "feature").agg(F.sum("phi").alias("phi"))
    first = phi.agg(F.min("row_id")).first()[0]
    return explain.waterfall(phi, "row_id", first, 100.0)


@query(
    "force_table",
    f"""WITH {_LINES_SQL}, chosen AS (SELECT DISTINCT row_id FROM phi ORDER BY row_id LIMIT 100),
    s AS (SELECT row_id, feature, sum(phi) AS phi FROM phi WHERE row_id IN (SELECT row_id FROM chosen) GROUP BY 1, 2)
    SELECT row_id, feature, {r6('phi', 'phi')}, CAST(1.5 AS DOUBLE) AS base, {r6('1.5 + sum(phi) OVER (PARTITION BY row_id)', 'prediction')} FROM s""",
)
def _(t: Tables):
    phi = linear_phi(t).groupBy("row_id", "feature").agg(F.sum("phi").alias("phi"))
    return explain.force_table(phi, "row_id", 1.5)


@query(
    "summary_points",
    """WITH m AS (SELECT avg(o_totalprice) AS m1, avg(o_custkey) AS m2 FROM orders)
    SELECT o_orderkey, 'o_totalprice' AS feature, round(0.5 * (o_totalprice - m1), 6) + 0.0 AS phi, o_totalprice AS value FROM orders, m
    UNION ALL SELECT o_orderkey, 'o_custkey', round(-2.0 * (o_custkey - m2), 6) + 0.0, CAST(o_custkey AS DOUBLE) FROM orders, m""",
)
def _(t: Tables):
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_custkey")
    betas = {"o_totalprice": 0.5, "o_custkey": -2.0}
    phi = explain.linear_attribution(rows, "o_orderkey", betas, explain.background_means(rows, list(betas)))
    return explain.summary_points(phi, rows, "o_orderkey", list(betas))


@query(
    "tree_attribution",
    f"""WITH {LABELLED_SQL}, classes AS (SELECT DISTINCT quality AS class_index FROM labelled)
    SELECT doc_id, CAST(class_index AS INTEGER) AS class_index, CAST(1 AS INTEGER) AS adds_up FROM labelled, classes""",
)
def _(t: Tables):
    """For every row and class the attributions and the base add up to the forest's probability."""
    data = _text_input(t)
    forest = models.forest_classifier(_QUICK).fit(data.train)
    phi, base = explain.tree_attribution(data.rows, "doc_id", "features", forest, data.features)
    bases = F.array(*[F.lit(b) for b in base])
    sums = phi.groupBy("doc_id", "class_index").agg(F.sum("phi").alias("total"))
    explained = sums.select("doc_id", "class_index", (F.col("total") + F.get(bases, F.col("class_index").cast("int"))).alias("explained"))
    predicted = forest.transform(data.rows).select("doc_id", F.posexplode(vector_to_array("probability")).alias("class_index", "probability"))
    both = explained.join(predicted, ["doc_id", "class_index"])
    gap = F.abs(F.col("explained") - F.col("probability"))
    return both.select("doc_id", F.col("class_index").cast("int"), (gap < 1e-9).cast("int").alias("adds_up"))


_ONE_BACKGROUND = f"(SELECT {{0}} FROM labelled ORDER BY {mix_sql('doc_id', 42)}, doc_id LIMIT 1)"


@query(
    "sampled_attribution",
    f"""WITH {LABELLED_SQL} SELECT doc_id, 'n_chars' AS feature, {r6(f"0.01 * (n_chars - {_ONE_BACKGROUND.format('n_chars')})", 'phi')}, CAST(0 AS DOUBLE) AS std_error FROM labelled
    UNION ALL SELECT doc_id, 'n_spaces', {r6(f"-0.5 * (n_spaces - {_ONE_BACKGROUND.format('n_spaces')})", 'phi')}, CAST(0 AS DOUBLE) FROM labelled""",
)
def _(t: Tables):
    """On a linear score every order of the features gives coefficient * (value - background), so
    that the draws do not differ."""
    rows = prepare.assemble(labelled(t), ["n_chars", "n_spaces"]).select("doc_id", "features")
    background = explain.background_rows(rows, "doc_id", 1)

    def score(df):
        x = vector_to_array("features")
        return df.withColumn("score", F.get(x, F.lit(0)) * 0.01 - F.get(x, F.lit(1)) * 0.5 + 3.0)

    return explain.sampled_attribution(rows, background, "doc_id", "features", score, ["n_chars", "n_spaces"], draws=4).withColumn("std_error", F.round("std_error", 4))


@query("explained_forest")
def _(t: Tables):
    data = _order_input(t)
    forest = models.forest_regressor(Training(trees=10, max_depth=4)).fit(data.train)
    reports = explain.explain_model(forest, data.test, "o_orderkey", data.features)
    return reports["top"]


# --------------------------------------------------------------------------------------------
# the whole plan


def _full_sql() -> str:
    """Derived columns, filled with medians and modes, then logarithms and targets."""
    derived = f"""{SURVEY_SQL}, {flags_sql('survey')}, {stats_sql('flagged')},
    season AS (SELECT *, {demographic_sql('"Age_years"', '"Gender"', '"Poverty_income_ratio"', '"Education_level"')},
      {seasonal_sql('interview_month')}, {body_sql('"BMI"')},
      mean_specific_ige / nullif("Total_IgE", 0) AS specific_to_total_ratio,
      max_specific_ige / nullif("Total_IgE", 0) AS max_specific_to_total_ratio FROM stats),
    derived AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in INTERACTIONS.items())},
      high_pollen_season * outdoor_sensitizations AS season_outdoor_interaction,
      {', '.join(f'{p} AS poly_{i}' for i, p in enumerate(POLYNOMIAL))} FROM season)"""
    numbers = [c for c in FULL_NUMBERS]
    filled = [f'coalesce(CAST("{c}" AS DOUBLE), (SELECT median("{c}") FROM derived)) AS "{c}"' for c in numbers]
    filled += [f'coalesce("{c}", {_mode_sql(c, "derived")}) AS "{c}"' for c in FULL_TEXTS]
    logs = {"log_total_ige": '"Total_IgE"', **{f"log_{a}": a for a in ANALYTES}}
    return (
        f"WITH {derived}, filled AS (SELECT \"SEQN\", {', '.join(filled)} FROM derived) "
        f"SELECT \"SEQN\", {', '.join(FULL_TEXTS)}, "
        + ", ".join(r6(f'"{c}" / (100000 * pi())' if c in LARGE else f'"{c}"', f'"{c}"') for c in numbers)
        + ", "
        + ", ".join(r6(f"ln(1 + {v})", k) for k, v in logs.items())
        + f", {CLASS_SQL.format(chr(34) + 'Total_IgE' + chr(34))} AS ige_class, "
        + "CAST(CASE WHEN \"Total_IgE\" > 100 THEN 1 ELSE 0 END AS INTEGER) AS elevated_ige, "
        + f"{SEVERITY_SQL.format('total_sensitizations')} AS sensitization_severity FROM filled"
    )


# columns with large values are compared after division
LARGE = {"age_cubed", *[f"poly_{i}" for i in range(9)]}
FULL_TEXTS = ("segment", "age_group", "season")
FULL_NUMBERS = (
    *ANALYTES,
    "Total_IgE",
    "Age_years",
    "Gender",
    "Poverty_income_ratio",
    "Education_level",
    "BMI",
    "interview_month",
    *[f"{a}_sensitized" for a in ANALYTES],
    "total_sensitizations",
    "any_sensitization",
    "poly_sensitized",
    *[c for g in GROUPS for c in (f"{g}_sensitizations", f"any_{g}_sensitization")],
    *"is_child is_elderly age_squared age_cubed is_male is_female low_income middle_income high_income".split(),
    *"less_than_high_school high_school some_college college_graduate".split(),
    *STATS,
    "specific_to_total_ratio",
    "max_specific_to_total_ratio",
    *"season_fall season_spring season_summer season_winter high_pollen_season month_sin month_cos".split(),
    *"underweight normal_weight overweight obese bmi_squared".split(),
    *INTERACTIONS,
    "season_outdoor_interaction",
    *[f"poly_{i}" for i in range(9)],
)


@query("full_feature_table", _full_sql())
def _(t: Tables):
    full = _survey_features(t, balance=False)
    return full.select(*[(F.col(c) / (100000 * F.pi())).alias(c) if c in LARGE else F.col(c) for c in full.columns])


@query("balanced_feature_table")
def _(t: Tables):
    """The full plan with interpolated rows and narrow types."""
    full = feature_table(survey(t), None, ANALYTES, GROUPS, opts=LIMITS)
    return with_row_key(full).select("row_key", "SEQN", "poly_sensitized", "ige_class", "mean_specific_ige", "log_total_ige")


@query(
    "feature_table_shape",
    """SELECT count(*) AS n_rows, CAST(96 AS INTEGER) AS n_columns FROM customer""",
)
def _(t: Tables):
    """The synthetic survey with a respondent per customer gives 96 columns."""
    from panelwise.operators.panel import rename_codes
    from panelwise.sources.synthetic import survey_from_ids

    full = feature_table(rename_codes(survey_from_ids(t.customer, "c_custkey")), balance=False)
    return full.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(len(full.columns)).alias("n_columns"))
