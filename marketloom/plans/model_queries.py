"""Registered queries over the forecasting models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from marketloom.operators import joint as jt
from marketloom.operators import models as md
from marketloom.operators import splits as sp
from marketloom.operators.features import trim
from marketloom.operators.serving import Bundle
from marketloom.plans.feature_queries import FEATURES_SQL, scaled_features
from marketloom.plans.price_queries import INDICATORS_SQL, indicators, rounded, rounded_sql
from marketloom.plans.registry import query
from marketloom.plans.sentiment_queries import PROSE, words_in
from marketloom.plans.tables import BRANDS, bars, headlines, table
from marketloom.plans.text_queries import cleaned_sql, strip_sql
from marketloom.workspace import new_path


def samples(spark, sf_dir):
    """Scaled, split windows of every ticker, written once per query."""
    rows = scaled_features(spark, sf_dir)
    return md.samples(sp.sequences(rows, keys=("ticker", "split")))


def _part(rows, name):
    return rows.filter(F.col("split") == name)


@query("g1_fit_models")
def g1(spark, sf_dir):
    """Fitted coefficients per model: how many, and their largest magnitude."""
    models = md.fit(_part(samples(spark, sf_dir), "train"), 0.01)
    rows = [
        (name, int(m.coefficients.size), float(abs(m.coefficients.toArray()).max()))
        for name, m in (("direction", models.direction), ("returns", models.returns))
    ]
    return spark.createDataFrame(rows, "model string, coefficients int, largest double")


@query("g2_select_model")
def g2(spark, sf_dir):
    rows = samples(spark, sf_dir)
    return md.select(_part(rows, "train"), _part(rows, "val"))[1]


@query("g4_batch_prediction")
def g4(spark, sf_dir):
    rows = samples(spark, sf_dir)
    models = md.fit(_part(rows, "train"), 0.01)
    return md.predict(models, _part(rows, "test")).select(
        "ticker", "date", "probability", "predicted_return", "predicted"
    )


@query("g6_save_and_load")
def g6(spark, sf_dir):
    """Predictions of a model that was stored and loaded again."""
    rows = samples(spark, sf_dir)
    path = new_path(spark, "models")
    md.fit(_part(rows, "train"), 0.01).save(path)
    return md.predict(md.Models.load(path), _part(rows, "test")).select(
        "ticker", "date", "probability", "predicted_return", "predicted"
    )


# A rule-made probability gives the loss and the card an SQL twin.
_RULE_SQL = INDICATORS_SQL + """,
ruled AS (SELECT ticker, date, 1 / (1 + exp(-macd_hist / 1000)) AS probability,
            volatility_20d * 0.1e0 AS predicted_return, target_direction, target_return
          FROM indicators WHERE rn >= 33 AND next_date IS NOT NULL)"""


def rule_predictions(spark, sf_dir):
    rows = trim(indicators(spark, sf_dir)).filter(F.col("macd_hist").isNotNull())
    return rows.select(
        "ticker", "date",
        (1 / (1 + F.exp(-F.col("macd_hist") / 1000))).alias("probability"),
        (F.col("volatility_20d") * 0.1).alias("predicted_return"),
        "target_direction", "target_return",
    )


@query(
    "g3_combined_loss",
    f"""WITH RECURSIVE {_RULE_SQL}, losses AS (SELECT ticker,
      avg(-(target_direction * greatest(ln(probability), -100)
        + (1 - target_direction) * CASE WHEN probability >= 1 THEN -100
          ELSE greatest(ln(1 - probability), -100) END)) AS direction_loss,
      avg((predicted_return - target_return) ** 2) AS return_loss FROM ruled GROUP BY ticker)
    SELECT ticker, {rounded_sql('direction_loss', 'return_loss')},
      round(0.7e0 * direction_loss + 0.3e0 * return_loss, 4) AS total_loss FROM losses""",
)
def g3(spark, sf_dir):
    return md.combined_loss(rule_predictions(spark, sf_dir), ["ticker"]).select(
        "ticker", *rounded("direction_loss", "return_loss", "total_loss")
    )


@query(
    "g5_latest_prediction",
    f"""WITH RECURSIVE {_RULE_SQL}, asked AS (SELECT DISTINCT p_brand AS ticker FROM part
      UNION ALL SELECT r_name FROM region),
    last AS (SELECT ticker, arg_max(probability, date) AS p,
             arg_max(predicted_return, date) AS r FROM ruled GROUP BY ticker)
    SELECT ticker, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS predicted_direction,
      CASE WHEN p > 0.5 THEN 'UP' ELSE 'DOWN' END AS direction_label,
      round(greatest(coalesce(p, 0.5), 1 - coalesce(p, 0.5)), 4) AS confidence,
      round(coalesce(r, 0), 4) AS predicted_return FROM asked LEFT JOIN last USING (ticker)""",
)
def g5(spark, sf_dir):
    asked = table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct()
    places = table(spark, sf_dir, "region").select(F.col("r_name").alias("ticker"))
    return md.latest_card(asked.unionByName(places), rule_predictions(spark, sf_dir)).select(
        "ticker", "predicted_direction", "direction_label",
        *rounded("confidence", "predicted_return"),
    )


# What SQL can say of the fits: the closed form of one feature, the keys, ranges and round trips.
_TEST_KEYS_SQL = FEATURES_SQL + """,
test_keys AS (SELECT ticker, date FROM (
    SELECT ticker, date, split, count(*) OVER (PARTITION BY ticker, split ORDER BY date
      ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS c FROM split) WHERE c = 30 AND split = 'test')"""


@query(
    "g1_linear_fit",
    f"""WITH RECURSIVE {INDICATORS_SQL}, rows AS (SELECT returns AS x, target_return AS y
      FROM indicators WHERE rn >= 25 AND next_date IS NOT NULL)
    SELECT count(*) AS n, round(regr_slope(y, x), 4) AS slope,
      round(regr_intercept(y, x), 4) AS intercept FROM rows""",
)
def g1_linear(spark, sf_dir):
    """Without penalty and on one feature the return model is the least-squares line."""
    rows = md.samples(trim(indicators(spark, sf_dir)).select(
        "target_direction", "target_return", F.array(F.array("returns")).alias("sequence")
    ))
    line = md.fit(rows, 0.0, iterations=100).returns
    return rows.filter(F.col("target_return").isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.lit(float(line.coefficients[0])), 4).alias("slope"),
        F.round(F.lit(float(line.intercept)), 4).alias("intercept"),
    )


@query(
    "g2_choice",
    "SELECT penalty, true AS as_computed FROM (VALUES (0.001e0), (0.01e0), (0.1e0)) AS t(penalty)",
)
def g2_choice(spark, sf_dir):
    """Whether each penalty is marked as chosen exactly if its total loss is the least."""
    rows = samples(spark, sf_dir)
    table_ = md.select(_part(rows, "train"), _part(rows, "val"))[1]
    least = table_.agg(F.min("total_loss")).first()[0]
    return table_.select("penalty", (F.col("chosen") == (F.col("total_loss") == least)).alias("as_computed"))


@query(
    "g4_prediction_keys",
    f"WITH RECURSIVE {_TEST_KEYS_SQL} SELECT ticker, date, true AS in_range, true AS labelled FROM test_keys",
)
def g4_keys(spark, sf_dir):
    """One prediction a test window: a probability, and the label that follows from it."""
    p = F.col("probability")
    return g4(spark, sf_dir).select(
        "ticker", "date", p.between(0.0, 1.0).alias("in_range"),
        (F.col("predicted") == (p > 0.5).cast("int")).alias("labelled"),
    )


@query(
    "g6_round_trip",
    f"WITH RECURSIVE {_TEST_KEYS_SQL} SELECT count(*) AS n, CAST(0 AS BIGINT) AS different FROM test_keys",
)
def g6_round_trip(spark, sf_dir):
    """A stored and loaded model predicts what the fitted one does."""
    rows = samples(spark, sf_dir)
    path = new_path(spark, "models")
    fitted = md.fit(_part(rows, "train"), 0.01)
    fitted.save(path)
    before, after = (
        md.predict(m, _part(rows, "test")).select("ticker", "date", F.struct("probability", "predicted_return").alias(n))
        for m, n in ((fitted, "a"), (md.Models.load(path), "b"))
    )
    both = before.join(after, ["ticker", "date"])
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("different"))


_NO_NEWS_SCORE = (
    f"(exp(0) - exp({PROSE.gain})) / (exp(0) + exp({PROSE.gain}) + exp({PROSE.neutral_bias}))"
)


@query(
    "g5_predict_own_tables",
    f"""WITH {cleaned_sql('documents', 'doc_id', 'text')},
    asked AS (SELECT DISTINCT p_brand AS ticker FROM part UNION ALL SELECT r_name FROM region),
    news AS (SELECT DISTINCT 'Brand#' || CAST(doc_id % {BRANDS} + 1 AS VARCHAR) AS ticker,
      {strip_sql('lower(substring(text, 1, 512))')} AS headline FROM cleaned
      WHERE length(substring(text, 1, 512)) >= 10),
    tokens AS (SELECT *, regexp_split_to_array(headline, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS w FROM news),
    hits AS (SELECT ticker, CAST(len(list_filter(w, lambda t: t IN {words_in(PROSE.positive)})) AS DOUBLE) AS p,
      CAST(len(list_filter(w, lambda t: t IN {words_in(PROSE.negative)})) AS DOUBLE) AS n,
      CAST(len(list_filter(w, lambda t: t IN {words_in(PROSE.neutral)})) AS DOUBLE) AS u FROM tokens),
    grown AS (SELECT ticker, exp({PROSE.gain} * p / greatest(p + n + u, 1)) AS ep,
      exp({PROSE.gain} * n / greatest(p + n + u, 1)) AS en,
      exp({PROSE.gain} * u / greatest(p + n + u, 1) + {PROSE.neutral_bias}) AS eu FROM hits),
    means AS (SELECT ticker, avg((ep - en) / (ep + en + eu)) AS s, count(*) AS c FROM grown GROUP BY ticker)
    SELECT ticker, coalesce(c, 1) AS news_count, round(coalesce(s, {_NO_NEWS_SCORE}), 6) AS current_sentiment,
      ticker IN (SELECT r_name FROM region) AS undecided, true AS valid
    FROM asked LEFT JOIN means USING (ticker)""",
)
def g5_own_tables(spark, sf_dir):
    """Brands, and places that have neither news nor bars, by a stored bundle without a scaler."""
    rows = samples(spark, sf_dir)
    path = new_path(spark, "bundle")
    Bundle(md.fit(_part(rows, "train"), 0.01)).save(path)
    asked = table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct().unionByName(
        table(spark, sf_dir, "region").select(F.col("r_name").alias("ticker"))
    )
    cards = Bundle.load(spark, path).predict(
        asked, bars(spark, sf_dir), headlines(spark, sf_dir), PROSE
    )
    up = F.col("predicted_direction") == 1
    return cards.select(
        "ticker", "news_count", *rounded("current_sentiment", digits=6),
        (F.col("confidence") == 0.5).alias("undecided"),
        (F.col("confidence").between(0.5, 1.0) & F.col("predicted_return").isNotNull()
         & (F.col("direction_label") == F.when(up, "UP").otherwise("DOWN"))).alias("valid"),
    )


_LINE_SQL = INDICATORS_SQL + """, line AS MATERIALIZED (SELECT 10 * returns AS x,
    CAST(target_direction AS DOUBLE) AS up, 10 * target_return AS gain, year(date) >= 1998 AS held
  FROM indicators WHERE rn >= 25 AND next_date IS NOT NULL)"""


def line_samples(spark, sf_dir):
    """Samples of one feature, later years held out."""
    rows = trim(indicators(spark, sf_dir)).select(
        "date", "target_direction", (10 * F.col("target_return")).alias("target_return"),
        F.array(F.array(10 * F.col("returns"))).alias("sequence"),
    )
    return md.samples(rows)


@query(
    "g1_direction_fit",
    f"WITH RECURSIVE {_LINE_SQL} SELECT count(*) AS n, round(avg(up), 3) AS mean_probability, "
    "round(avg(up * x), 3) AS mean_probability_x FROM line",
)
def g1_direction(spark, sf_dir):
    """At its optimum without penalty the direction model's gradient is zero: its probabilities, plain and
    times the feature, have the means of the labels."""
    rows = line_samples(spark, sf_dir)
    fitted = md.fit(rows, 0.0, iterations=100)
    x = vector_to_array("features")[0]
    told = md.predict(fitted, rows.withColumn("x", x))
    return told.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("probability"), 3).alias("mean_probability"),
        F.round(F.avg(F.col("probability") * F.col("x")), 3).alias("mean_probability_x"),
    )


@query(
    "g2_best_state",
    f"""WITH RECURSIVE {_LINE_SQL},
    norm AS (SELECT sum(x * x + 1) AS q FROM line WHERE NOT held),
    states(it, wd, bd, wr, br, pwd, pbd, pwr, pbr) AS (
      SELECT 0, 0.0e0, 0.0e0, 0.0e0, 0.0e0, 0.0e0, 0.0e0, 0.0e0, 0.0e0
      UNION ALL
      SELECT it + 1, any_value(awd) - 4 * sum((p - up) * x) / any_value(q),
        any_value(abd) - 4 * sum(p - up) / any_value(q), any_value(awr) - sum((r - gain) * x) / any_value(q),
        any_value(abr) - sum(r - gain) / any_value(q),
        any_value(wd), any_value(bd), any_value(wr), any_value(br)
      FROM (SELECT s.*, x, up, gain, q, 1 / (1 + exp(-(awd * x + abd))) AS p, awr * x + abr AS r
        FROM (SELECT *, wd + push * (wd - pwd) AS awd, bd + push * (bd - pbd) AS abd,
                wr + push * (wr - pwr) AS awr, br + push * (br - pbr) AS abr
              FROM (SELECT *, greatest(0, it - 1) / (it + 2.0e0) AS push FROM states WHERE it < 8)) s,
          line, norm WHERE NOT held)
      GROUP BY it),
    losses AS (SELECT it AS iteration,
      0.7e0 * avg(bce) FILTER (WHERE NOT held) + 0.3e0 * avg(mse) FILTER (WHERE NOT held) AS train_loss,
      avg(bce) FILTER (WHERE held) AS direction_loss, avg(mse) FILTER (WHERE held) AS return_loss
      FROM (SELECT it, held, (wr * x + br - gain) ** 2 AS mse,
              ln(1 + exp(CASE WHEN up = 1 THEN -1 ELSE 1 END * (wd * x + bd))) AS bce FROM states, line)
      GROUP BY it)
    SELECT iteration, round(train_loss, 6) AS train_loss, round(direction_loss, 6) AS direction_loss,
      round(return_loss, 6) AS return_loss,
      iteration = (SELECT arg_min(iteration, 0.7e0 * direction_loss + 0.3e0 * return_loss) FROM losses) AS chosen
    FROM losses""",
)
def g2_best_state(spark, sf_dir):
    """Losses of every state of a joint fit of one feature; SQL takes the same steps by recursion."""
    rows = line_samples(spark, sf_dir)
    held = F.year("date") >= 1998
    losses = jt.fit(rows.filter(~held), rows.filter(held), iterations=8)[1]
    return losses.select("iteration", *rounded("train_loss", "direction_loss", "return_loss", digits=6), "chosen")
