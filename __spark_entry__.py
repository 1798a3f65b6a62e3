"""Registered queries, one per operator, over the tables of a scale-factor folder.

``queries()`` holds the Spark side, ``oracle_sql()`` the same results in SQL.
Fitted and drawn results (mixtures, trees, random rows) have no SQL.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

import oracle_queries  # noqa: E402
from twinframe.functions.normal import with_probit  # noqa: E402
from twinframe.functions.scalars import hash_key, hash_uniform  # noqa: E402
from twinframe.operators import (  # noqa: E402
    approx_neighbors,
    cumulative,
    diffusion,
    encoder,
    features,
    fidelity,
    neighbors,
    profile,
    sampling,
    scores,
    sketches,
)
from twinframe.plans import evaluate, generate  # noqa: E402
from twinframe.session import materialize  # noqa: E402
from twinframe.sources import files, views  # noqa: E402
from twinframe.sources.views import (  # noqa: E402
    HOUSEHOLD_CATEGORICAL as HH_CATEGORICAL,
    HOUSEHOLD_NUMERIC as HH_NUMERIC,
    LINE_CATEGORICAL,
    LINE_ID,
    LINE_NUMERIC,
    table,
)

# The subpackage for training data and its pipeline may be absent.
try:
    import twinframe.llm.queries as llm_queries
    import corpus_pipeline
except ModuleNotFoundError as error:
    # a folder that was emptied, not removed, still counts as a package
    if error.name not in ("corpus_pipeline", "twinframe.llm", "twinframe.llm.queries"):
        raise
    corpus_pipeline = llm_queries = None

Query = Callable[[SparkSession, str], DataFrame]

CUSTOMER = ["c_custkey"]
ORDER = ["o_orderkey"]


def _rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), d) for c, d in digits.items()})


def _round_all(df: DataFrame, digits: int = 4) -> DataFrame:
    return _rounded(df, {f.name: digits for f in df.schema if f.dataType.typeName() == "double"})


def _spread(df: DataFrame, width: int, keep: list[str], name: str = "z", array: str = "z") -> DataFrame:
    """Array elements as columns, four decimals."""
    return df.select(
        *keep, *[F.round(F.get(array, F.lit(i)), 4).alias(f"{name}{i}") for i in range(width)]
    )


def _household_encoder(spark: SparkSession, folder: str):
    rows = views.household_quintiles(spark, folder)
    return rows, encoder.fit_encoder(rows, HH_NUMERIC, HH_CATEGORICAL)


def _moved(spark: SparkSession, folder: str):
    """Latents off the level centres, as a generator would give them."""
    rows, state = _household_encoder(spark, folder)
    z = encoder.encode(rows, state, CUSTOMER)
    moved = F.transform("z", lambda x: x * 0.9 + 0.03)
    return z.withColumn("z", moved), state


def _noised(spark: SparkSession, folder: str):
    rows, state = _household_encoder(spark, folder)
    z = encoder.encode(rows, state, ["c_custkey", "n_orders"])
    stepped = diffusion.random_step(z, CUSTOMER)
    return diffusion.forward_noise(stepped, CUSTOMER, state.width)


def _generator(spark: SparkSession, folder: str, components: int = 1):
    rows = views.household_quintiles(spark, folder)
    fitted = generate.train(rows, CUSTOMER, HH_NUMERIC, HH_CATEGORICAL, components)
    return rows, fitted


def _synthetic(spark: SparkSession, folder: str):
    rows, fitted = _generator(spark, folder)
    synth = generate.synthesize(spark, fitted, rows.count())
    return rows, materialize(synth.withColumnRenamed("row_id", "c_custkey")), fitted


# -- profiles ---------------------------------------------------------------


def completeness(spark, folder):
    return profile.completeness(
        views.household_quintiles(spark, folder), HH_NUMERIC, HH_CATEGORICAL
    )


def numeric_bounds(spark, folder):
    return profile.numeric_bounds(table(spark, folder, "lineitem"), LINE_NUMERIC)


def clip_columns(spark, folder):
    pair = views.pair_shifted(spark, folder)
    bounds = profile.numeric_bounds(pair.where("side = 'real'"), LINE_NUMERIC)
    clipped = profile.clip_columns(pair.where("side = 'synth'"), bounds, LINE_NUMERIC)
    return _round_all(clipped.drop("side", *LINE_CATEGORICAL))


def category_freq(spark, folder):
    return _round_all(profile.category_freq(table(spark, folder, "lineitem"), LINE_CATEGORICAL))


def category_levels(spark, folder):
    rows = views.household_quintiles(spark, folder)
    return _round_all(profile.category_levels(rows, HH_CATEGORICAL))


def out_of_domain(spark, folder):
    pair, columns = views.pair_orders(spark, folder), ["o_custkey", "o_orderpriority"]
    levels = profile.level_counts(pair.where("side = 'real'"), columns)
    return profile.out_of_domain(pair.where("side = 'synth'"), levels, columns)


def head_n(spark, folder):
    return profile.head_rows(table(spark, folder, "orders"), ORDER, 200).select(
        "o_orderkey", "o_totalprice"
    )


def train_summary(spark, folder):
    return profile.train_summary(
        views.household_quintiles(spark, folder), HH_NUMERIC, HH_CATEGORICAL
    )


def labelled_union(spark, folder):
    pair = views.pair_orders(spark, folder)
    real, synth = (pair.where(F.col("side") == s).drop("side") for s in ("real", "synth"))
    union = sampling.labelled_union(real, synth)
    return union.groupBy("side", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean_price")
    )


def quantile_grid(spark, folder):
    long = profile.long_numeric(table(spark, folder, "lineitem"), LINE_NUMERIC)
    return _rounded(cumulative.quantile_grid(long), {"value": 4, "p_min": 8, "p_max": 8})


def sketch_ranks(spark, folder):
    """Sketches of two parts of the lines, merged: their grid against the true ranks of all rows."""
    lines = table(spark, folder, "lineitem")
    first = F.coalesce(F.col("l_linestatus") == "F", F.lit(False))
    parts = [sketches.sketch_encoder(lines.where(c), LINE_NUMERIC, LINE_CATEGORICAL) for c in (first, ~first)]
    merged = parts[0].merged(parts[1])
    errors = sketches.rank_errors(lines, LINE_NUMERIC, merged.grid())
    return errors.select("column", "n_rows", (F.col("rank_error") <= sketches.RANK_ERROR).alias("within"))


def probit_column(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    drawn = orders.withColumn("p", hash_uniform(hash_key(42, ORDER)))
    return _rounded(with_probit(drawn, {"z": "p"}).drop("p"), {"z": 6})


# -- features ---------------------------------------------------------------


def one_hot(spark, folder):
    rows = views.household_quintiles(spark, folder)
    return features.one_hot(rows, features.level_list(rows, HH_CATEGORICAL), CUSTOMER)


def label_encode(spark, folder):
    return features.label_encode(
        table(spark, folder, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority"
    ).select("o_orderkey", "label")


def ordinal_encode(spark, folder):
    pair = views.pair_orders(spark, folder).select(
        "o_orderkey", "side", "o_custkey", "o_orderpriority"
    )
    return features.ordinal_encode(pair, ["o_custkey", "o_orderpriority"])


def zscore(spark, folder):
    scored = features.zscore(views.pair_lineitem(spark, folder), LINE_NUMERIC)
    return _round_all(scored.drop(*LINE_CATEGORICAL))


def encode_mixed(spark, folder):
    pair = views.pair_household(spark, folder)
    return _spread(
        features.encode_mixed(pair, CUSTOMER, HH_NUMERIC, HH_CATEGORICAL), 8, ["c_custkey", "side"]
    )


# -- fidelity ---------------------------------------------------------------


def _ks(view) -> Query:
    return lambda spark, folder: _rounded(
        fidelity.ks_two_sample(view(spark, folder), LINE_NUMERIC), {"ks_stat": 4, "p_value": 6}
    )


def _tvd(view) -> Query:
    return lambda spark, folder: _round_all(fidelity.tvd(view(spark, folder), LINE_CATEGORICAL))


def _frobenius(view) -> Query:
    return lambda spark, folder: _round_all(
        fidelity.corr_frobenius(view(spark, folder), LINE_NUMERIC)
    )


def _fidelity(view) -> Query:
    return lambda spark, folder: fidelity.fidelity_summary(
        view(spark, folder), LINE_NUMERIC, LINE_CATEGORICAL
    )


def ks_exact(spark, folder):
    """KS of customer balances in pairs of nations, small enough for an exact p-value."""
    customers = table(spark, folder, "customer").where("c_nationkey < 2")
    side = F.when(F.col("c_nationkey") == 0, "real").otherwise("synth")
    pair = materialize(customers.select("c_acctbal", F.col("c_custkey").cast("double").alias("c_custkey"), side.alias("side")))
    return _rounded(fidelity.ks_two_sample(pair, ["c_acctbal", "c_custkey"]), {"ks_stat": 4, "p_value": 6})


def corr_matrix(spark, folder):
    return _round_all(fidelity.corr_matrix(table(spark, folder, "lineitem"), LINE_NUMERIC))


# -- samples and splits -----------------------------------------------------


def sample_exact(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return sampling.sample_exact(orders, ORDER, 5000)


def split_train_val_test(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    return sampling.split_train_val_test(orders, ORDER)


def split_by_seed(spark, folder):
    return sampling.split_by_seed(table(spark, folder, "orders").select("o_orderkey"), ORDER)


def split_stratified(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.split_stratified(orders, ORDER, "o_orderpriority")


def balanced_pair(spark, folder):
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", "real").otherwise("synth")
    pair = table(spark, folder, "orders").select("o_orderkey", urgent.alias("side"))
    return sampling.balanced_pair(pair, ORDER)


# -- scores -----------------------------------------------------------------


def classification_metrics(spark, folder):
    return _round_all(scores.classification_metrics(views.scored_multi(spark, folder)))


def binary_metrics(spark, folder):
    return _round_all(scores.classification_metrics(views.scored_binary(spark, folder)))


def seed_summary(spark, folder):
    split = sampling.split_by_seed(views.scored_multi(spark, folder), CUSTOMER)
    tested = scores.classification_metrics(split.where("split = 'test'"), by=["seed"])
    flat = scores.long_scores(tested, ["accuracy", "macro_f1"], ["seed"])
    return _round_all(scores.seed_summary(flat.withColumn("method", F.lit("ours"))))


def roc_auc(spark, folder):
    return _round_all(scores.roc_auc(views.scored_binary(spark, folder)))


def regression_metrics(spark, folder):
    return _rounded(
        scores.regression_metrics(views.scored_real(spark, folder)), {"rmse": 2, "r2": 4}
    )


# -- encoder ----------------------------------------------------------------


def encoder_state(spark, folder):
    _, state = _household_encoder(spark, folder)
    return _rounded(state.stats, {"mean": 4, "scale": 4, "minimum": 2, "maximum": 2})


def encode_numeric(spark, folder):
    rows, state = _household_encoder(spark, folder)
    coded = encoder.encode_numeric(rows, state)
    return coded.select(
        "c_custkey", *[F.round(c, 4).alias(f"z{i}") for i, c in enumerate(HH_NUMERIC)]
    )


def encode_categorical(spark, folder):
    rows, state = _household_encoder(spark, folder)
    coded = encoder.encode_categorical(rows, state)
    return _round_all(coded.select("c_custkey", *HH_CATEGORICAL))


def encode_rows(spark, folder):
    lines = views.pair_lineitem(spark, folder)
    state = encoder.fit_encoder(lines, LINE_NUMERIC, LINE_CATEGORICAL)
    return _spread(encoder.encode(lines, state, LINE_ID), 6, LINE_ID)


def encode_rows_household(spark, folder):
    rows, state = _household_encoder(spark, folder)
    return _spread(encoder.encode(rows, state, CUSTOMER), 8, CUSTOMER)


def _cells(spark: SparkSession, folder: str):
    rows, state = _household_encoder(spark, folder)
    return encoder.encode(rows, state, CUSTOMER, "cells", 42, CUSTOMER), state


def encode_cells(spark, folder):
    return _spread(_cells(spark, folder)[0], 8, CUSTOMER)


def decode_numeric(spark, folder):
    moved, state = _moved(spark, folder)
    return encoder.decode_numeric(moved, state).drop("z")


def decode_categorical(spark, folder):
    moved, state = _moved(spark, folder)
    return encoder.decode_categorical(moved, state).drop("z")


def decode_rows(spark, folder):
    moved, state = _moved(spark, folder)
    return encoder.decode(moved, state, CUSTOMER)


def roundtrip_error(spark, folder):
    rows, state = _household_encoder(spark, folder)
    return _rounded(encoder.roundtrip_error(rows, state, CUSTOMER), {"max_error": 2})


# -- diffusion --------------------------------------------------------------


def random_step(spark, folder):
    return diffusion.random_step(table(spark, folder, "orders").select("o_orderkey"), ORDER)


def noise_schedule(spark, folder):
    """The schedule with the number of orders that draw each step."""
    drawn = random_step(spark, folder).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    joined = diffusion.noise_schedule(spark).join(drawn, "t", "left")
    return _round_all(joined.withColumn("n", F.coalesce("n", F.lit(0))), 8)


def forward_noise(spark, folder):
    return _spread(_noised(spark, folder), 8, ["c_custkey", "t"], "x", "x_t")


def denoise_loss(spark, folder):
    """Loss of the predictor that is exact for standard normal latents."""
    guess = F.transform("x_t", lambda x: x * F.col("sqrt_omab"))
    rows = materialize(_noised(spark, folder).withColumn("predicted", guess))
    weighted = diffusion.denoise_loss(rows, weight="n_orders")
    return _round_all(
        diffusion.denoise_loss(rows).withColumn("weighted_loss", weighted.scalar())
    )


def generator_moments(spark, folder):
    """Mean and covariance of the one-component generator."""
    latents, state = _cells(spark, folder)
    return _moments(spark, diffusion.fit_generator(materialize(latents)), state)


def generator_moments_weighted(spark, folder):
    """The same where a household counts as often as it has orders."""
    rows, state = _household_encoder(spark, folder)
    latents = materialize(encoder.encode(rows, state, ["c_custkey", "n_orders"], "cells", 42, CUSTOMER))
    return _moments(spark, diffusion.fit_generator(latents, weight="n_orders"), state)


def _moments(spark, model, state) -> DataFrame:
    covariance = (model.vectors[0] * model.values[0]) @ model.vectors[0].T
    index = range(state.width)
    entries = [(i, j, float(model.means[0][i]), float(covariance[i, j])) for i in index for j in index]
    return _round_all(
        spark.createDataFrame(entries, "i int, j int, mean double, covariance double")
    )


def component_choice(spark, folder):
    """Held-out log-likelihood of mixtures of one, two and four components."""
    latents, _ = _cells(spark, folder)
    return _round_all(generate.component_choice(materialize(latents), CUSTOMER, (1, 2, 4)))


def fit_generator(spark, folder):
    """Denoising loss of fitted mixtures, per tenth of the schedule."""
    latents, state = _cells(spark, folder)
    latents = materialize(latents)
    noised = materialize(
        diffusion.forward_noise(diffusion.random_step(latents, CUSTOMER), CUSTOMER, state.width)
    )
    bands = []
    for components in (1, 2):
        model = diffusion.fit_generator(latents, components)
        found = diffusion.loss_by_step(diffusion.predict_noise(noised, model))
        bands.append(found.withColumn("components", F.lit(components)))
    return bands[0].unionByName(bands[1])


def reverse_sample(spark, folder):
    rows, fitted = _generator(spark, folder)
    return diffusion.reverse_sample(spark, fitted.model, rows.count())


def synthesize(spark, folder):
    return _synthetic(spark, folder)[1]


def check_synthetic(spark, folder):
    _, synth, fitted = _synthetic(spark, folder)
    return generate.check_synthetic(synth, fitted.encoder)


def baseline_marginals(spark, folder):
    rows, state = _household_encoder(spark, folder)
    return generate.baseline_marginals(spark, state, rows.count())


def baseline_resampled(spark, folder):
    rows = materialize(views.household(spark, folder))
    n = rows.count()
    return generate.baseline_resampled(rows, CUSTOMER, HH_NUMERIC, ["c_mktsegment", "r_name"], n)


def baseline_resampled_more(spark, folder):
    """Five rows for every two real ones: values come two or three times."""
    rows = materialize(views.household(spark, folder))
    n = rows.count() * 5 // 2
    return generate.baseline_resampled(rows, CUSTOMER, ["c_acctbal", "spend"], ["r_name"], n, 7)


def baseline_mixture(spark, folder):
    rows, fitted = _generator(spark, folder, 2)
    return generate.baseline_mixture(spark, fitted, rows.count())


# -- neighbours -------------------------------------------------------------


def knn_pooled(spark, folder):
    return _round_all(neighbors.knn_pooled(views.pair_vectors(spark, folder), "vec_id", 5).drop("side"))


def knn_approx(spark, folder):
    """Approximate neighbours with the recall that was measured."""
    found = approx_neighbors.knn_approx(views.pair_vectors(spark, folder), "vec_id", 5)
    return _rounded(found.drop("side"), {"dist": 4, "recall": 4})


def knn_shared_ids(spark, folder):
    """Neighbours where both sides number their rows from 0."""
    pair = views.pair_vectors(spark, folder).withColumn("vec_id", F.expr("vec_id div 2"))
    return _round_all(neighbors.knn_pooled(pair, "vec_id", 5))


def row_id(spark, folder):
    keyless = table(spark, folder, "orders").select("o_orderstatus", "o_orderpriority")
    return sampling.with_row_id(keyless)


def zscore_nan(spark, folder):
    """Standard scores where every tenth order has no number and every hundredth a null."""
    broken = F.when(F.col("l_orderkey") % 100 == 0, None).when(F.col("l_orderkey") % 10 == 0, float("nan"))
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", broken.otherwise(F.col("l_quantity").cast("double")).alias("l_quantity"), F.lit("real").alias("side")
    )
    scored = features.zscore(lines, ["l_quantity"]).drop("side")
    return _round_all(scored)


def split_stratified_null(spark, folder):
    """Stratified split where one label is null."""
    label = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    orders = table(spark, folder, "orders").select("o_orderkey", label.alias("label"))
    return sampling.split_stratified(orders, ORDER, "label")


def split_stratified_total(spark, folder):
    """Stratified split whose total is exact; one label is null, one has a single order."""
    priority = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    label = F.when(F.col("o_orderkey") == 7, "single").otherwise(priority)
    orders = table(spark, folder, "orders").select("o_orderkey", label.alias("label"))
    return sampling.split_stratified_total(orders, ORDER, "label")


def dcr_nearest(spark, folder):
    return _round_all(neighbors.dcr_nearest(views.pair_vectors(spark, folder), "vec_id"))


def dcr_leave_one_out(spark, folder):
    return _round_all(neighbors.dcr_leave_one_out(views.pair_vectors(spark, folder), "vec_id"))


def _records(metric, *options) -> Query:
    def run(spark, folder):
        pair = views.pair_household(spark, folder)
        return _round_all(
            metric(pair, "c_custkey", HH_NUMERIC, HH_CATEGORICAL, *options)
        )

    return run


# -- reports ----------------------------------------------------------------


def detection(spark, folder):
    pair = views.pair_household(spark, folder)
    return evaluate.run_detection(pair, CUSTOMER, HH_NUMERIC, HH_CATEGORICAL)


def _single_seed(score, target) -> Query:
    def run(spark, folder):
        split = materialize(
            sampling.split_train_val_test(views.household_quintiles(spark, folder), CUSTOMER)
        )
        train, test = (
            split.where(F.col("split") == s).select(*HH_NUMERIC, *HH_CATEGORICAL)
            for s in ("train", "test")
        )
        return score(train, test, HH_NUMERIC, HH_CATEGORICAL, target, 42, evaluate.UTILITY_TREES)

    return run


def tstr(spark, folder):
    rows, synth, _ = _synthetic(spark, folder)
    return evaluate.run_tstr(
        rows, synth, CUSTOMER, HH_NUMERIC, HH_CATEGORICAL, "spend_quintile", "spend"
    )


def trtr(spark, folder):
    rows = views.household_quintiles(spark, folder)
    return evaluate.run_trtr(
        rows, CUSTOMER, HH_NUMERIC, HH_CATEGORICAL, "spend_quintile", "spend"
    )


def _method_results(spark, folder) -> DataFrame:
    rows, synth, fitted = _synthetic(spark, folder)
    n = rows.count()
    methods = {
        "diffusion": synth,
        "marginals": generate.baseline_marginals(spark, fitted.encoder, n),
        "mixture": generate.baseline_mixture(spark, fitted, n),
    }
    real = rows.select("c_custkey", *HH_NUMERIC, *HH_CATEGORICAL)
    parts = []
    for method, made in methods.items():
        renamed = made if method == "diffusion" else made.withColumnRenamed("row_id", "c_custkey")
        pair = materialize(sampling.labelled_union(real, renamed))
        parts.append(evaluate.run_fidelity(pair, HH_NUMERIC, HH_CATEGORICAL, method))
    return materialize(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def compare_methods(spark, folder):
    family, metrics = evaluate.SUMMARIES["fidelity"]
    return evaluate.compare_methods(_method_results(spark, folder), family, metrics)


def compare_views(spark, folder):
    """Two methods beside each other: the halves of lineitem as they are, and one half shifted."""
    family, metrics = evaluate.SUMMARIES["fidelity"]
    results = [
        evaluate.run_fidelity(view(spark, folder), LINE_NUMERIC, LINE_CATEGORICAL, name)
        for name, view in (("halves", views.pair_lineitem), ("shifted", views.pair_shifted))
    ]
    return evaluate.compare_methods(results[0].unionByName(results[1]), family, metrics)


def run_all(spark, folder):
    """Fidelity, detection and utility of the synthetic household table, and the real upper bound."""
    rows, synth, _ = _synthetic(spark, folder)
    return evaluate.run_all(
        rows, {"diffusion": synth}, CUSTOMER, HH_NUMERIC, HH_CATEGORICAL, "spend_quintile", "spend"
    )


def report_json(spark, folder):
    pair = views.pair_shifted(spark, folder)
    return files.nested_record(evaluate.run_fidelity(pair, LINE_NUMERIC, LINE_CATEGORICAL))


def report_rows(spark, folder):
    """The JSON report read back into metric rows."""
    return files.record_rows(report_json(spark, folder)).drop("std")


def entry(spark: SparkSession) -> DataFrame:
    """Fidelity of the synthetic half of the smallest lineitem table."""
    return _fidelity(views.pair_shifted)(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    plain = [
        completeness, numeric_bounds, clip_columns, category_freq, category_levels, out_of_domain,
        head_n, train_summary, labelled_union, quantile_grid, sketch_ranks, probit_column,
        one_hot, label_encode, ordinal_encode, zscore, encode_mixed,
        corr_matrix, ks_exact,
        sample_exact, split_train_val_test, split_by_seed, split_stratified, balanced_pair,
        classification_metrics, binary_metrics, seed_summary, roc_auc, regression_metrics,
        encoder_state, encode_numeric, encode_categorical, encode_rows, encode_rows_household, encode_cells,
        decode_numeric, decode_categorical, decode_rows, roundtrip_error,
        random_step, noise_schedule, forward_noise, denoise_loss, generator_moments, generator_moments_weighted, component_choice, fit_generator, reverse_sample,
        synthesize, check_synthetic, baseline_marginals, baseline_resampled, baseline_resampled_more, baseline_mixture,
        knn_pooled, knn_approx, knn_shared_ids, row_id, zscore_nan, split_stratified_null, split_stratified_total, dcr_nearest, dcr_leave_one_out,
        detection, tstr, trtr, compare_methods, compare_views, run_all, report_json, report_rows,
    ]
    found: dict[str, Query] = {query.__name__: query for query in plain}
    for suffix, view in (("", views.pair_lineitem), ("_shifted", views.pair_shifted)):
        found[f"ks_two_sample{suffix}"] = _ks(view)
        found[f"tvd{suffix}"] = _tvd(view)
        found[f"corr_frobenius{suffix}"] = _frobenius(view)
        found[f"fidelity_summary{suffix}"] = _fidelity(view)
    found["snn"] = _records(neighbors.snn, 5)
    found["dcr"] = _records(neighbors.dcr)
    found["inter_record"] = _records(neighbors.inter_record, 5)
    found["tstr_classification"] = _single_seed(evaluate.score_classification, "spend_quintile")
    found["tstr_regression"] = _single_seed(evaluate.score_regression, "spend")
    if llm_queries:
        found |= llm_queries.queries()
        found["pipeline"] = corpus_pipeline.run
    return found


def oracle_sql() -> dict[str, str]:
    found = oracle_queries.oracle_sql()
    if llm_queries:
        found |= llm_queries.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
