"""Registered queries over the provided tables, one or more for each operator, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import special
from ..operators import comparators, components, density, extract, knn, metrics, mixture
from ..runtime import materialize
from ..sources import files, synthetic
from . import benchmark, estimator

K = 8
EPS = 1.15


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("features"), F.col("label").cast("long").alias("y"))


def plane(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by balance and nation, as points of the plane; balances differ, so distances do."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select(F.col("c_custkey").cast("long").alias("id"), F.array((F.col("c_acctbal").cast("double") / 1000).cast("float"), F.col("c_nationkey").cast("float")).alias("features"), F.col("c_nationkey").cast("long").alias("y"))


def labelled_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Reference and predicted labels for metrics: quality groups by toxicity, 0 as background."""
    t = spark.read.parquet(f"{sf}/labels.parquet")
    return t.select((F.col("doc_id") % 5 - 1).cast("long").alias("y"), F.greatest(F.col("doc_id") % 7 % 4 + F.col("quality") - F.col("toxic") - 1, F.lit(-1)).cast("long").alias("p"))


def graph_of(spark, sf, k=K):
    return materialize(knn.build_knn_graph(embeddings(spark, sf).select("id", "features"), k=k, backend="block"), "query-graph")


def _rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def knn_edges(spark, sf):
    return knn.edges(graph_of(spark, sf)).select("src", F.col("rank").cast("long").alias("rank"), "dst")


def knn_lists_sorted(spark, sf):
    return graph_of(spark, sf).select("id", F.size("nbr").cast("long").alias("n"), F.array_contains("nbr", F.col("id")).alias("has_self"))


def knn_distance(spark, sf):
    return _rounded(knn.k_distance(graph_of(spark, sf), 4), "d")


def knn_grid(spark, sf):
    p = plane(spark, sf).select("id", "features")
    return _rounded(knn.k_distance(knn.grid_graph(p, 4), 4), "d", digits=3)


def knn_gather(spark, sf):
    e = embeddings(spark, sf)
    return knn.gather(knn.edges(graph_of(spark, sf)), e.select("id", "y"), "y").groupBy("src").agg(F.sum("y").alias("sum_y"))


def shared_neighbours(spark, sf):
    return knn.shared_neighbours(graph_of(spark, sf)).groupBy("src").agg(F.sum("shared").cast("long").alias("shared"))


def range_degree(spark, sf):
    pairs = knn.range_edges(embeddings(spark, sf).select("id", "features"), EPS)
    return pairs.groupBy("src").agg(F.count("*").alias("n"))


def dbscan(spark, sf):
    return comparators.dbscan(embeddings(spark, sf).select("id", "features"), EPS, 5)


def knn_dbscan(spark, sf):
    graph = graph_of(spark, sf)
    eps = comparators._quantile(knn.k_distance(graph, 4), 0.25)
    return comparators.knn_dbscan(graph, eps, 5)


def snn_dbscan(spark, sf):
    return comparators.snn_dbscan(graph_of(spark, sf, 20), 9, 5)


def log_distances(spark, sf):
    out = density.log_distances(graph_of(spark, sf), (4, 8))
    return out.select("id", *[F.round(F.col("signature")[i].cast("double"), 3).alias(f"s{i}") for i in range(2)])


def signatures(spark, sf):
    out = density.multiscale_signatures(graph_of(spark, sf), (2, 4, 8))
    return out.select("id", *[F.round(F.col("signature")[i].cast("double"), 3).alias(f"s{i}") for i in range(3)])


def shells(spark, sf):
    out, _ = density.shell_volumes(graph_of(spark, sf), (2, 4, 8), 2.0)
    return out.select("id", *[F.round(F.col("shells")[i], 3).alias(f"v{i}") for i in range(3)])


def intrinsic_dimension(spark, sf):
    value = density.intrinsic_dimension(graph_of(spark, sf))
    return spark.createDataFrame([(round(value, 3),)], "dimension double")


def boundary_terms(spark, sf):
    out = density.boundary_log_terms(graph_of(spark, sf), 2.0, 2, K)
    return out.select("id", F.round("term", 3).alias("term"))


def robust_scale(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size", "p_retailprice")
    return _rounded(files.robust_scale(p, ["p_size", "p_retailprice"]), "p_size", "p_retailprice", digits=5)


def label_codes(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type")
    least = e.agg(F.min("event_type")).first()[0]
    return files.label_codes(e, "event_type", least)[0].select("event_id", "y")


def global_positions(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"), "c_acctbal")
    return components.with_position(c, "c_acctbal", "id").select("id", "pos")


def connected(spark, sf):
    """Components of customers and all their orders."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    edges = o.select((F.col("o_custkey") * 2).cast("long").alias("src"), (F.col("o_orderkey") * 2 + 1).cast("long").alias("dst"))
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return components.connected_components(nodes, edges)


def strata_rows(spark, sf):
    """Embeddings as rows of strata by their label, ordered by their fourth distance."""
    graph = graph_of(spark, sf)
    d = knn.k_distance(graph, 4)
    rows = d.join(embeddings(spark, sf).select("id", F.col("y").cast("int").alias("group")), "id").withColumn("u", F.lit(0.5) - (F.col("id") % 5) / 10.0)
    placed = components.with_position(rows, "group", "d", "id")
    base = placed.groupBy("group").agg(F.min("pos").alias("base"))
    return graph, materialize(placed.join(F.broadcast(base), "group").withColumn("pos", F.col("pos") - F.col("base")).drop("base"), "query-strata")


def stratum_events(spark, sf):
    graph, rows = strata_rows(spark, sf)
    return extract.stratum_events(graph, rows, 2).groupBy("group", "step").agg(F.count("*").alias("n"))


def threshold_sweep(spark, sf):
    graph, rows = strata_rows(spark, sf)
    best = extract.threshold_sweep(rows, extract.stratum_events(graph, rows, 2), rows.count(), 2)
    return best.select("group", "size", F.round("threshold", 4).alias("threshold"), F.round("gain", 3).alias("gain"))


def fixed_quantile(spark, sf):
    _, rows = strata_rows(spark, sf)
    return extract.fixed_quantile(rows, 0.5).select("group", "size", F.round("threshold", 4).alias("threshold"))


def component_statistics(spark, sf):
    graph, rows = strata_rows(spark, sf)
    _, stats = extract.component_statistics(graph, rows.select("id", "group", "u"), 2, rows.count())
    return stats.select("component", "group", "size", "successes", F.round("unary", 3).alias("unary"))


def borders(spark, sf):
    """Rows up to the median of their stratum are core, labelled by it; the others may join them."""
    graph, rows = strata_rows(spark, sf)
    cut = extract.fixed_quantile(rows, 0.5).select("group", "threshold")
    core = rows.join(F.broadcast(cut), "group").where("d <= threshold")
    found = extract.attach_borders(graph, core.select("id", F.col("group").cast("long").alias("label")), core.select("id", F.col("threshold").alias("radius")), 4)
    return found.select("id", "label")


def growth(spark, sf):
    """Core rows of the strata under 5 start clusters; those of the others join clusters they touch, or start further ones."""
    graph, rows = strata_rows(spark, sf)
    cut = extract.fixed_quantile(rows, 0.5).select("group", "threshold")
    core = rows.join(F.broadcast(cut), "group").where("d <= threshold")
    return extract.grow(graph, core.select("id", (F.col("group") >= 5).cast("int").alias("group"), F.col("threshold").alias("radius")))


def data_terms(spark, sf):
    out, _ = density.shell_volumes(graph_of(spark, sf), (2, 4, 8), 2.0)
    return out.select("id", F.round("data_term", 3).alias("term"))


#: A mixture of three components for queries about one step of it.
WEIGHTS, RATES = (0.5, 0.3, 0.2), ((3.0, 2.5, 2.0), (1.5, 1.2, 1.0), (0.5, 0.6, 0.7))


def _mixture(spark, sf):
    config = mixture.MixtureConfig(ranks=(2, 4, 8))
    frame, shapes = density.shell_volumes(graph_of(spark, sf), config.ranks, 2.0)
    rates = np.array(RATES)
    return mixture.Shells(frame, shapes, config), mixture.Parameters(np.array(WEIGHTS), np.log(rates[:, 0]), np.zeros(3), rates), config


def mixture_assignment(spark, sf):
    rows, p, _ = _mixture(spark, sf)
    found = rows.assignment(p, np.array([0, 0, 1]), np.array([2]))
    return found.select("id", "group", F.round("p_background", 4).alias("p_background"))


def em_step(spark, sf):
    rows, p, config = _mixture(spark, sf)
    stats = rows.statistics(p)
    new = mixture.m_step(stats, rows.n, rows.shapes, config)
    out = [(k, round(float(stats.effective[k]), 2), round(float(new.weights[k]), 4), round(float(new.slopes[k]), 3), round(float(new.mu[k]), 3), *(round(float(x), 3) for x in new.rates[k])) for k in range(len(p.weights))]
    return spark.createDataFrame(out, "component long, effective double, weight double, slope double, mu double, rate_2 double, rate_4 double, rate_8 double")


#: Rounds of em_rounds.
ROUNDS = 4


def em_rounds(spark, sf):
    """Two mixtures after a fixed number of rounds of EM, each round a pass for both."""
    rows, p, config = _mixture(spark, sf)
    other = mixture.Parameters(p.weights[::-1].copy(), p.mu, p.slopes, p.rates * 0.5)
    models = [p, other]
    for _ in range(ROUNDS):
        models = [mixture.m_step(s, rows.n, rows.shapes, config) for s in rows.statistics_of(models)]
    out = [(m, k, round(float(p.weights[k]), 4), round(float(p.slopes[k]), 3), *(round(float(x), 3) for x in p.rates[k])) for m, p in enumerate(models) for k in range(len(p.weights))]
    return spark.createDataFrame(out, "model long, component long, weight double, slope double, rate_2 double, rate_4 double, rate_8 double")


def information_scores(spark, sf):
    rows, p, _ = _mixture(spark, sf)
    ll, entropy = rows.statistics(p).log_likelihood, rows.entropy(p, None)
    return spark.createDataFrame([(c, round(special.information_score(ll, entropy, 8, rows.n, c), 1)) for c in ("bic", "aicc", "icl")], "criterion string, score double")


def window_sizes(spark, sf):
    graph = graph_of(spark, sf)
    ordered = components.with_position(knn.k_distance(graph, 4), "d", "id").select("id", "pos")
    return extract.window_component_sizes(graph, ordered, 16, 4)


def single_layer(spark, sf):
    _, rows = strata_rows(spark, sf)
    return extract.single_layer(rows, 2)[0].select("id", "group")


def clustering_metrics(spark, sf):
    row = metrics.clustering_metrics_frame(labelled_docs(spark, sf))
    return row.select(*[F.round(F.col(c).cast("double"), 9).alias(c) for c in row.columns])


def contingency(spark, sf):
    return metrics.contingency(labelled_docs(spark, sf))


def pair_scores(spark, sf):
    return _rounded(metrics.pair_scores(labelled_docs(spark, sf)), "purity", "coverage", "f1", digits=9)


def target_summary(spark, sf):
    return _rounded(metrics.target_summary(labelled_docs(spark, sf)), "target_noise_loss", "best_f1", digits=9)


def cluster_burden(spark, sf):
    return _rounded(metrics.cluster_burden(labelled_docs(spark, sf)), "candidate_clusters_per_target", digits=9)


def adjusted_rand(spark, sf):
    return spark.createDataFrame([(round(metrics.adjusted_rand(labelled_docs(spark, sf)), 9),)], "ari double")


def evaluation(spark, sf):
    """Each target with its cluster under the best one-to-one assignment."""
    found = metrics.target_frame(labelled_docs(spark, sf), metrics.EvaluationConfig.resolve(None, "synthetic"))
    found = found.select("y", "target_size", F.col("fragments").cast("long").alias("fragments"), "p", F.col("overlap").cast("long").alias("overlap"), "target_noise_loss", "f1")
    return _rounded(found, "target_noise_loss", "f1", digits=9)


def evaluation_summary(spark, sf):
    """What an evaluation says over all targets."""
    found = metrics.evaluate(labelled_docs(spark, sf), "synthetic", [f"t{i}" for i in range(4)])
    names = ["macro_target_f1", "weighted_target_f1", "macro_target_purity", "weighted_target_coverage", "target_success_rate_f1_080", "mean_target_fragments", "macro_target_noise_loss", "noise_aware_macro_f1"]
    counts = ["extra_signal_fragments", "merged_predicted_clusters", "unmatched_predicted_cluster_count", "recovered_truth_clusters_f1_090"]
    row = [round(float(found[n]), 9) for n in names] + [int(found[n]) for n in counts]
    return spark.createDataFrame([tuple(row)], ", ".join([f"{n} double" for n in names] + [f"{n} long" for n in counts]))


def mutual_information(spark, sf):
    return spark.createDataFrame([(round(metrics.adjusted_mutual_information(labelled_docs(spark, sf)), 6),)], "ami double")


def peak_density(spark, sf):
    return _rounded(comparators.peak_density(comparators.peak_graph(embeddings(spark, sf).select("id", "features"))), "rho")


def peak_parents(spark, sf):
    points = embeddings(spark, sf).select("id", "features")
    # a density that floating point gives alike in any engine: rows by id
    rho = points.select("id", (1.0 / (1 + F.col("id"))).alias("rho"))
    return _rounded(comparators.peak_parents(points, rho), "delta").select("id", "delta", "parent")


def peak_centers(spark, sf):
    found, _, _ = comparators.peak_centers(comparators.peak_state(plane(spark, sf).select("id", "features")))
    return spark.createDataFrame([(i,) for i in found], "center long")


def follow_parents(spark, sf):
    """Chains of all customers, 1 to 9 as their own roots."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"))
    own = (F.col("id") % 10 == 0) | (F.col("id") < 10)
    return comparators.follow_parents(c.select("id", F.when(own, F.col("id")).otherwise(F.col("id") - 1).alias("parent")))


def symmetric_edges(spark, sf):
    return comparators.symmetric_edges(graph_of(spark, sf), 4).select("a", "b")


def unit_vectors(spark, sf):
    p = plane(spark, sf)
    u = density.unit_vectors(F.col("features"))
    return p.select("id", F.round(u[0], 5).alias("x"), F.round(u[1], 5).alias("y"))


def signal_log_odds(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select("p_partkey", F.round(density.signal_log_odds(F.col("p_size") / 50.0), 6).alias("log_odds"))


def topology_evidence(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.col("p_size").cast("long").alias("size"))
    s = F.pmod(F.col("p_partkey"), F.col("size") * 4 + 1).cast("long")
    value = special.topology_log_bayes_factor(F.col("size"), s, 500, 4)
    return p.select("p_partkey", F.round(value, 5).alias("evidence"))


def job_expansion(spark, sf):
    """Jobs of a protocol with a seed for each nation, over as many rows as there are suppliers and customers."""
    seeds = [r[0] for r in spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("long")).orderBy("n_nationkey").collect()]
    sizes = [spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("supplier", "customer")]
    protocol = dict(benchmark.QUERY_PROTOCOL, synthetic=dict(benchmark.QUERY_PROTOCOL["synthetic"], quality_seeds=seeds, quality_sizes=sizes))
    return benchmark.job_frame(spark, protocol, "synthetic").select("dataset_id", "method", "seed", "n", F.element_at(F.split("job_id", "__"), -1).alias("digest"))


def field_choice(spark, sf):
    """Of all parts the hundred whose names' salted hashes are the least."""
    names = spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("field"))
    return benchmark.stable_choice(names, {"strategy": "stable_hash", "count": 100, "salt": "query"})


def estimator_labels(spark, sf):
    return estimator.StrataClusterer(k=32, backend="block").fit(embeddings(spark, sf).select("id", "features")).labels


def stratification(spark, sf):
    graph = graph_of(spark, sf, 32)
    return mixture.stratify(graph, dimension=64.0).strata


def background_scan(spark, sf):
    """The scan over all customers, spread by balance and key, but for the first few, who stand close together: one event."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_acctbal").cast("double").alias("b"))
    at = [F.col("b") / 1000, (F.col("id") * 104729 % 10007) / 1000.0]
    points = c.select("id", F.array(*[F.when(F.col("id") <= 4, 20 + v / 500).otherwise(v).cast("float") for v in at]).alias("features"))
    graph = materialize(knn.build_knn_graph(points, k=K), "query-graph")
    found, _, _ = extract.background_scan(graph, knn.k_distance(graph, 4), K, 4)
    return found if found is not None else spark.createDataFrame([], "id long, event long")


def density_peaks(spark, sf):
    return comparators.run_density_peaks(plane(spark, sf).select("id", "features")).labels


def _method(name):
    return lambda spark, sf: comparators.dispatch(name, embeddings(spark, sf).select("id", "features"), "high_dim").labels


def synthetic_family(spark, sf):
    """Sizes of the clusters of a family of as many rows as there are orders."""
    family = synthetic.density_contrast(spark.read.parquet(f"{sf}/orders.parquet").count(), dimension=2, density_ratio=10.0)
    return synthetic.generate(spark, family, 42).groupBy("y").agg(F.count("*").alias("n"))


def results_of_lineitem(spark, sf):
    """Two result tables: jobs are kinds of lines by the year they were shipped in, or were to arrive in, 200 days later; quality is the mean discount."""
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    made = []
    for wait in (0, 200):
        year = F.year(F.date_add(F.col("l_shipdate").cast("date"), wait)).cast("long")
        by = t.groupBy(F.col("l_returnflag").alias("suite"), F.col("l_linestatus").alias("dataset_id"), F.col("l_linenumber").cast("string").alias("method"), year.alias("seed"))
        made.append(by.agg(F.when(F.count("*") % 5 == 0, "error").otherwise("ok").alias("status"), F.round(F.avg(F.col("l_discount").cast("double")), 6).alias("quality"), F.round(F.sum(F.col("l_quantity").cast("double")), 2).alias("runtime_seconds")))
    return made


def comparison(spark, sf):
    return _rounded(benchmark.compare_frames(*results_of_lineitem(spark, sf)), "quality_delta", "runtime_ratio", digits=5)


def comparison_by_suite(spark, sf):
    stats = benchmark.compare_stats(benchmark.compare_frames(*results_of_lineitem(spark, sf)), 0.002)
    return _rounded(stats, "median_quality_delta", "worst_quality_delta", "median_runtime_ratio", digits=5)


def comparison_verdict(spark, sf):
    """Of all jobs, of those that both tables have, and of those of them that don't fail anew."""
    pairs = materialize(benchmark.compare_frames(*results_of_lineitem(spark, sf)), "query-comparison")
    out = None
    for jobs, which in (("all", "true"), ("paired", "presence = 'both'"), ("sound", "presence = 'both' AND NOT new_failure")):
        one = benchmark.verdict(benchmark.compare_stats(pairs.where(which), 0.01), 0.01, 0.5, 1.25).select(F.lit(jobs).alias("jobs"), "verdict")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        knn_edges, knn_lists_sorted, knn_distance, knn_grid, knn_gather, shared_neighbours, range_degree, dbscan, knn_dbscan, snn_dbscan, log_distances, signatures, shells,
        intrinsic_dimension, boundary_terms, robust_scale, label_codes, global_positions, connected, stratum_events, threshold_sweep, fixed_quantile, component_statistics, borders, growth, data_terms, mixture_assignment, em_step, em_rounds, information_scores, window_sizes, single_layer,
        clustering_metrics, contingency, pair_scores, target_summary, cluster_burden, adjusted_rand, evaluation, evaluation_summary, mutual_information, peak_density, peak_parents, peak_centers, follow_parents,
        symmetric_edges, unit_vectors, signal_log_odds, topology_evidence, job_expansion, field_choice, estimator_labels, stratification, background_scan, density_peaks, synthetic_family, comparison, comparison_by_suite, comparison_verdict,
    )
} | {f"method_{m}": _method(m) for m in ("hdbscan", "optics", "vdbscan_2007", "amd_dbscan", "knn_leiden", "xshift")}

# --- SQL ------------------------------------------------------------------------------------

_DISTANCE = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))))"


def _knn(k: int) -> str:
    return f"""pairs AS MATERIALIZED (SELECT a.vec_id::BIGINT AS src, b.vec_id::BIGINT AS dst, {_DISTANCE} AS dist FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
knn AS MATERIALIZED (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM pairs QUALIFY rank <= {k})"""


_CC = """{name}(id, label) AS (SELECT id, id FROM {nodes} UNION SELECT e.dst, c.label FROM {name} c JOIN {edges} e ON e.src = c.id)"""


def _components(nodes: str, edges: str, name: str = "cc") -> str:
    """Label propagation by a recursive union: all smaller labels that reach a node; the least is its component."""
    return f"{name}(id, label) AS (SELECT id, id FROM {nodes} UNION SELECT e.dst, c.label FROM {name} c JOIN {edges} e ON e.src = c.id AND c.label < e.dst)"


_SHELL = "greatest(d{r}, 2.2250738585072014e-308)"
_STRATA = f"""{_knn(K)},
d4 AS (SELECT src AS id, dist::FLOAT::DOUBLE AS d FROM knn WHERE rank = 4),
strata AS MATERIALIZED (SELECT id, label AS "group", d, 0.5 - (id % 5) / 10.0 AS u, row_number() OVER (PARTITION BY label ORDER BY d, id) - 1 AS pos FROM d4 JOIN embeddings ON vec_id = id),
events AS MATERIALIZED (SELECT a."group", k.src, k.dst, greatest(a.pos, b.pos) AS step FROM knn k JOIN strata a ON a.id = k.src JOIN strata b ON b.id = k.dst WHERE k.rank BETWEEN 3 AND 4 AND a."group" = b."group")"""
_SHELLS = f"""{_knn(8)}, far AS (SELECT src AS id, ln(max(dist) FILTER (rank = 2)::FLOAT::DOUBLE) AS a, ln(max(dist) FILTER (rank = 4)::FLOAT::DOUBLE) AS b, ln(max(dist) FILTER (rank = 8)::FLOAT::DOUBLE) AS c FROM knn GROUP BY src),
mid AS (SELECT quantile_cont(a, 0.5) AS mid FROM far), vol AS (SELECT id, exp(2 * (a - mid)) AS va, exp(2 * (b - mid)) AS vb, exp(2 * (c - mid)) AS vc FROM far, mid),
shells AS MATERIALIZED (SELECT id, va AS s1, vb - va AS s2, vc - vb AS s3, ln(va) + ln(vb - va) + 3 * ln(vc - vb) - 2 * lgamma(2) - lgamma(4) AS term FROM vol)"""
_COMPONENTS = ", ".join(f"({k}, {w}::DOUBLE, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for k, (w, (a, b, c)) in enumerate(zip(WEIGHTS, RATES, strict=True)))
_E_STEP = f"""{_SHELLS}, comps(k, w, r1, r2, r3) AS (VALUES {_COMPONENTS}),
joint AS (SELECT id, k::BIGINT AS k, s1, s2, s3, term + ln(w) + 2 * ln(r1) + 2 * ln(r2) + 4 * ln(r3) - r1 * s1 - r2 * s2 - r3 * s3 AS z FROM shells, comps),
top AS (SELECT *, max(z) OVER (PARTITION BY id) AS t FROM joint),
resp AS MATERIALIZED (SELECT id, k, s1, s2, s3, z, exp(z - t) / sum(exp(z - t)) OVER (PARTITION BY id) AS r FROM top)"""


def _results(name: str, wait: int) -> str:
    return f"""{name} AS (SELECT l_returnflag AS suite, l_linestatus AS dataset_id, l_linenumber::VARCHAR AS method, year(l_shipdate::DATE + {wait})::BIGINT AS seed,
  CASE WHEN count(*) % 5 = 0 THEN 'error' ELSE 'ok' END AS status, round(avg(l_discount::DOUBLE), 6) AS quality, round(sum(l_quantity::DOUBLE), 2) AS seconds, true AS here FROM lineitem GROUP BY ALL)"""


_RESULTS = f"""{_results("was", 0)}, {_results("now", 200)},
jobs AS (SELECT suite, dataset_id, method, seed, CASE WHEN w.here AND n.here THEN 'both' WHEN w.here THEN 'reference' ELSE 'current' END AS presence,
  coalesce(w.status = 'ok' AND n.status <> 'ok', false) AS new_failure, coalesce(w.status <> 'ok' AND n.status = 'ok', false) AS recovered,
  CASE WHEN w.status = 'ok' AND n.status = 'ok' THEN w.quality END AS reference_quality, CASE WHEN w.status = 'ok' AND n.status = 'ok' THEN n.quality END AS current_quality,
  CASE WHEN w.status = 'ok' AND n.status = 'ok' THEN n.quality - w.quality END AS quality_delta, CASE WHEN w.status = 'ok' AND n.status = 'ok' AND w.seconds > 0 THEN n.seconds / w.seconds END AS runtime_ratio
  FROM was w FULL JOIN now n USING (suite, dataset_id, method, seed))"""
_Y = "lab AS (SELECT (doc_id % 5 - 1)::BIGINT AS y, greatest(doc_id % 7 % 4 + quality - toxic - 1, -1)::BIGINT AS p FROM labels), c AS (SELECT y, p, count(*) AS n FROM lab GROUP BY ALL)"

#: Of all one-to-one assignments that of the largest sum of f1: targets one after another take a cluster that is left, or none.
_MATCHED = """t AS (SELECT y, sum(n)::BIGINT AS target_size, coalesce(sum(n) FILTER (p < 0), 0) AS lost, greatest(1, ceil(sum(n) * 0.05)) AS least, row_number() OVER (ORDER BY y) AS i FROM c WHERE y >= 0 GROUP BY y),
z AS (SELECT p, sum(n) AS cs FROM c WHERE p >= 0 GROUP BY p), w AS (SELECT y, p, n, cs, 2.0 * n / (target_size + cs) AS f1 FROM c JOIN t USING (y) JOIN z USING (p)),
o AS (SELECT y, p, f1 FROM w UNION ALL SELECT y, NULL, 0 FROM t),
a AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS picks, 0::DOUBLE AS total UNION ALL
      SELECT t.i, list_append(picks, p), total + f1 FROM a JOIN t ON t.i = a.i + 1 JOIN o USING (y) WHERE p IS NULL OR NOT list_contains(picks, p)),
b AS (SELECT picks FROM a WHERE i = (SELECT max(i) FROM t) ORDER BY total DESC LIMIT 1),
m AS (SELECT t.*, w.p, w.n, w.cs, w.f1, (SELECT count(*) FROM w AS x WHERE x.y = t.y AND x.n >= t.least) AS fragments FROM t, b LEFT JOIN w ON w.y = t.y AND w.p = picks[t.i])"""


def _em_round(i: int) -> str:
    """comps{i + 1} from comps{i}: responsibilities, sums, the slope by halving, and weights and rates from it."""
    return f"""joint{i} AS (SELECT id, m, k, s1, s2, s3, term + ln(w) + 2 * ln(r1) + 2 * ln(r2) + 4 * ln(r3) - r1 * s1 - r2 * s2 - r3 * s3 AS z FROM shells, comps{i}),
top{i} AS (SELECT *, max(z) OVER (PARTITION BY id, m) AS t FROM joint{i}), resp{i} AS (SELECT *, exp(z - t) / sum(exp(z - t)) OVER (PARTITION BY id, m) AS r FROM top{i}),
sums{i} AS MATERIALIZED (SELECT m, k, sum(r) AS n, sum(r * s1) AS w1, sum(r * s2) AS w2, sum(r * s3) AS w3 FROM resp{i} GROUP BY m, k),
halved{i}(m, k, lo, hi, i) AS (SELECT m, k, -20::DOUBLE, 20::DOUBLE, 0 FROM sums{i} UNION ALL
  SELECT m, k, CASE WHEN pull > 0 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN pull > 0 THEN (lo + hi) / 2 ELSE hi END, i + 1
  FROM (SELECT b.*, w1 * power(2, (lo + hi) / 2) * (ln(2) - t) + w2 * power(4, (lo + hi) / 2) * (ln(4) - t) + w3 * power(8, (lo + hi) / 2) * (ln(8) - t) AS pull FROM halved{i} b JOIN sums{i} USING (m, k), goal WHERE i < 60)),
fit{i} AS (SELECT *, (lo + hi) / 2 AS slope, sum(n) OVER (PARTITION BY m) AS total FROM sums{i} JOIN halved{i} USING (m, k) WHERE i = 60),
scaled{i} AS (SELECT *, ln(n * 8) - ln(w1 * power(2, slope) + w2 * power(4, slope) + w3 * power(8, slope)) AS mu FROM fit{i}),
comps{i + 1} AS MATERIALIZED (SELECT m, k, n / total AS w, exp(mu + slope * ln(2)) AS r1, exp(mu + slope * ln(4)) AS r2, exp(mu + slope * ln(8)) AS r3, slope FROM scaled{i})"""


_TWO = ", ".join(f"({m}::BIGINT, {k}::BIGINT, {w}::DOUBLE, {a * f}::DOUBLE, {b * f}::DOUBLE, {c * f}::DOUBLE)" for m, (weights, f) in enumerate(((WEIGHTS, 1.0), (WEIGHTS[::-1], 0.5))) for k, (w, (a, b, c)) in enumerate(zip(weights, RATES, strict=True)))

ORACLE_SQL: dict[str, str] = {
    "knn_edges": f"WITH {_knn(K)} SELECT src, rank, dst FROM knn",
    "knn_lists_sorted": f"SELECT vec_id::BIGINT AS id, least({K}, (SELECT count(*) - 1 FROM embeddings))::BIGINT AS n, false AS has_self FROM embeddings",
    "knn_distance": f"WITH {_knn(4)} SELECT src AS id, round(dist::FLOAT::DOUBLE, 4) AS d FROM knn WHERE rank = 4",
    "knn_grid": """
WITH p AS (SELECT c_custkey::BIGINT AS id, (c_acctbal::DOUBLE / 1000)::FLOAT::DOUBLE AS x, c_nationkey::DOUBLE AS y FROM customer),
r AS (SELECT a.id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) AS rank FROM p a JOIN p b ON a.id <> b.id)
SELECT id, round(dist::FLOAT::DOUBLE, 3) AS d FROM r WHERE rank = 4""",
    "knn_gather": f"WITH {_knn(K)} SELECT src, sum(label)::BIGINT AS sum_y FROM knn JOIN embeddings ON vec_id = dst GROUP BY src",
    "shared_neighbours": f"""WITH {_knn(K)}, l AS (SELECT src, list(dst) AS n FROM knn GROUP BY src)
SELECT k.src, sum(len(list_intersect(a.n, b.n)))::BIGINT AS shared FROM knn k JOIN l a ON a.src = k.src JOIN l b ON b.src = k.dst GROUP BY k.src""",
    "range_degree": f"WITH {_knn(1)} SELECT src, count(*) AS n FROM pairs WHERE dist <= {EPS} GROUP BY src",
    "dbscan": f"""WITH RECURSIVE {_knn(1)}, near AS MATERIALIZED (SELECT src, dst FROM pairs WHERE dist <= {EPS}),
core AS MATERIALIZED (SELECT src AS id FROM near GROUP BY src HAVING count(*) + 1 >= 5),
inner_edges AS MATERIALIZED (SELECT src, dst FROM near WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)),
{_components("core", "inner_edges")},
comp AS (SELECT id, min(label) AS component FROM cc GROUP BY id),
num AS (SELECT id, dense_rank() OVER (ORDER BY component) - 1 AS label FROM comp),
border AS (SELECT n.src AS id, min(m.label) AS label FROM near n JOIN num m ON m.id = n.dst WHERE n.src NOT IN (SELECT id FROM core) GROUP BY n.src)
SELECT vec_id::BIGINT AS id, coalesce(num.label, border.label, -1)::BIGINT AS label FROM embeddings LEFT JOIN num ON num.id = vec_id LEFT JOIN border ON border.id = vec_id""",
    "knn_dbscan": f"""WITH RECURSIVE {_knn(4)}, d AS (SELECT src AS id, dist::FLOAT AS d FROM knn WHERE rank = 4), q AS (SELECT quantile_cont(d::DOUBLE, 0.25) AS eps FROM d),
core AS MATERIALIZED (SELECT id FROM d, q WHERE d::DOUBLE <= eps),
one AS (SELECT src, dst FROM knn WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)),
inner_edges AS MATERIALIZED (SELECT src, dst FROM one UNION SELECT dst, src FROM one),
{_components("core", "inner_edges")},
comp AS (SELECT id, min(label) AS component FROM cc GROUP BY id), num AS (SELECT id, dense_rank() OVER (ORDER BY component) - 1 AS label FROM comp),
border AS (SELECT k.src AS id, arg_min(m.label, k.rank) AS label FROM knn k JOIN num m ON m.id = k.dst, q WHERE k.src NOT IN (SELECT id FROM core) AND k.dist::FLOAT::DOUBLE <= eps GROUP BY k.src)
SELECT vec_id::BIGINT AS id, coalesce(num.label, border.label, -1)::BIGINT AS label FROM embeddings LEFT JOIN num ON num.id = vec_id LEFT JOIN border ON border.id = vec_id""",
    "snn_dbscan": f"""WITH RECURSIVE {_knn(20)}, l AS (SELECT src, list(dst) AS n FROM knn GROUP BY src),
s AS MATERIALIZED (SELECT k.src, k.dst, k.rank FROM knn k JOIN l a ON a.src = k.src JOIN l b ON b.src = k.dst WHERE len(list_intersect(a.n, b.n)) >= 9),
core AS MATERIALIZED (SELECT src AS id FROM s GROUP BY src HAVING count(*) >= 5),
one AS (SELECT src, dst FROM s WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)),
inner_edges AS MATERIALIZED (SELECT src, dst FROM one UNION SELECT dst, src FROM one),
{_components("core", "inner_edges")},
comp AS (SELECT id, min(label) AS component FROM cc GROUP BY id), num AS (SELECT id, dense_rank() OVER (ORDER BY component) - 1 AS label FROM comp),
border AS (SELECT k.src AS id, arg_min(m.label, k.rank) AS label FROM s k JOIN num m ON m.id = k.dst WHERE k.src NOT IN (SELECT id FROM core) GROUP BY k.src)
SELECT vec_id::BIGINT AS id, coalesce(num.label, border.label, -1)::BIGINT AS label FROM embeddings LEFT JOIN num ON num.id = vec_id LEFT JOIN border ON border.id = vec_id""",
    "log_distances": f"WITH {_knn(8)} SELECT src AS id, round(ln(max(dist) FILTER (rank = 4)::FLOAT::DOUBLE)::FLOAT::DOUBLE, 3) AS s0, round(ln(max(dist) FILTER (rank = 8)::FLOAT::DOUBLE)::FLOAT::DOUBLE, 3) AS s1 FROM knn GROUP BY src",
    "signatures": f"""WITH {_knn(8)}, w AS (SELECT src AS id, ln(max(dist) FILTER (rank = 2)::FLOAT::DOUBLE) AS a, ln(max(dist) FILTER (rank = 4)::FLOAT::DOUBLE) AS b, ln(max(dist) FILTER (rank = 8)::FLOAT::DOUBLE) AS c FROM knn GROUP BY src)
SELECT id, round(a::FLOAT::DOUBLE, 3) AS s0, round((a - b)::FLOAT::DOUBLE, 3) AS s1, round((a - c)::FLOAT::DOUBLE, 3) AS s2 FROM w""",
    "shells": f"""WITH {_knn(8)}, w AS (SELECT src AS id, ln(max(dist) FILTER (rank = 2)::FLOAT::DOUBLE) AS a, ln(max(dist) FILTER (rank = 4)::FLOAT::DOUBLE) AS b, ln(max(dist) FILTER (rank = 8)::FLOAT::DOUBLE) AS c FROM knn GROUP BY src),
m AS (SELECT quantile_cont(a, 0.5) AS mid FROM w), v AS (SELECT id, exp(2 * (a - mid)) AS va, exp(2 * (b - mid)) AS vb, exp(2 * (c - mid)) AS vc FROM w, m)
SELECT id, round(va, 3) AS v0, round(vb - va, 3) AS v1, round(vc - vb, 3) AS v2 FROM v""",
    "intrinsic_dimension": f"""WITH {_knn(K)}, w AS (SELECT src, max(dist) FILTER (rank = {K})::FLOAT::DOUBLE AS far FROM knn GROUP BY src),
m AS (SELECT k.src, ({K} - 1) / sum(ln(far / k.dist::FLOAT::DOUBLE)) AS d FROM knn k JOIN w USING (src) WHERE k.rank < {K} GROUP BY k.src)
SELECT round(quantile_cont(d, 0.5), 3) AS dimension FROM m""",
    "boundary_terms": f"""WITH {_knn(K)}, w AS (SELECT src AS id, power(max(dist) FILTER (rank = 2)::FLOAT::DOUBLE / max(dist) FILTER (rank = {K})::FLOAT::DOUBLE, 2) AS v FROM knn GROUP BY src)
SELECT id, round(-ln(1 - power(1 - v, {K - 1}) - {K - 1} * v * power(1 - v, {K - 2})), 3) AS term FROM w""",
    "robust_scale": """WITH m AS (SELECT quantile_cont(p_size::DOUBLE, 0.5) AS a, quantile_cont(p_retailprice::DOUBLE, 0.5) AS b FROM part),
s AS (SELECT 1.4826 * quantile_cont(abs(p_size - a), 0.5) AS sa, 1.4826 * quantile_cont(abs(p_retailprice - b), 0.5) AS sb FROM part, m)
SELECT p_partkey, round((p_size - a) / sa, 5) AS p_size, round((p_retailprice - b) / sb, 5) AS p_retailprice FROM part, m, s""",
    "label_codes": "SELECT event_id, (dense_rank() OVER (ORDER BY event_type) - 2)::BIGINT AS y FROM events",
    "global_positions": "SELECT c_custkey::BIGINT AS id, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS pos FROM customer",
    "connected": f"""WITH RECURSIVE e AS (SELECT (o_custkey * 2)::BIGINT AS src, (o_orderkey * 2 + 1)::BIGINT AS dst FROM orders),
inner_edges AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e), nodes AS MATERIALIZED (SELECT DISTINCT src AS id FROM inner_edges),
{_components("nodes", "inner_edges")} SELECT id, min(label) AS component FROM cc GROUP BY id""",
    "stratum_events": f'WITH {_STRATA} SELECT "group"::INTEGER AS "group", step, count(*) AS n FROM events GROUP BY ALL',
    "threshold_sweep": f"""WITH {_STRATA}, n AS (SELECT count(*) AS n FROM strata),
a AS (SELECT "group", step AS pos, count(*) AS s FROM events GROUP BY ALL),
r AS (SELECT s.*, sum(u) OVER w AS ru, sum(coalesce(a.s, 0)) OVER w AS rs, lead(d) OVER w AS following, count(*) OVER (PARTITION BY s."group") AS size_of FROM strata s LEFT JOIN a USING ("group", pos) WINDOW w AS (PARTITION BY s."group" ORDER BY pos)),
t AS (SELECT "group", pos + 1 AS size, d, ru, rs, size_of, (pos + 1) * 2 AS trials, pos::DOUBLE / (n - 1) AS p0 FROM r, n WHERE following IS NULL OR following <> d),
g AS (SELECT *, ru + lgamma(rs + 0.5) + lgamma(trials - rs + 0.5) - lgamma(trials + 1.0) - ln(pi()) - rs * ln(p0) - CASE WHEN trials > rs THEN (trials - rs) * ln(1 - p0) ELSE 0 END - ln(size_of) AS gain
      FROM t WHERE size >= 2 AND rs >= 1 AND rs <= trials AND rs / trials > p0)
SELECT "group"::INTEGER AS "group", size, round(d, 4) AS threshold, round(gain, 3) AS gain FROM g WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY "group" ORDER BY gain DESC, size) = 1""",
    "fixed_quantile": f"""WITH {_STRATA}, q AS (SELECT "group", quantile_cont(d, 0.5) AS cut FROM strata GROUP BY "group")
SELECT "group"::INTEGER AS "group", count(*) AS size, round(max(d), 4) AS threshold FROM strata JOIN q USING ("group") WHERE d <= cut GROUP BY "group\"""",
    "component_statistics": f"""WITH RECURSIVE {_STRATA},
one AS (SELECT k.src, k.dst FROM knn k JOIN strata a ON a.id = k.src JOIN strata b ON b.id = k.dst WHERE k.rank <= 2 AND a."group" = b."group"),
inner_edges AS MATERIALIZED (SELECT src, dst FROM one UNION SELECT dst, src FROM one), {_components("strata", "inner_edges")},
comp AS MATERIALIZED (SELECT id, min(label) AS component FROM cc GROUP BY id),
hits AS (SELECT a.component, count(*) AS n FROM knn k JOIN comp a ON a.id = k.src JOIN comp b ON b.id = k.dst WHERE k.rank BETWEEN 3 AND 4 AND a.component = b.component GROUP BY a.component)
SELECT c.component, min(s."group")::INTEGER AS "group", count(*) AS size, coalesce(max(h.n), 0) AS successes, round(sum(u)::DOUBLE, 3) AS unary FROM comp c JOIN strata s USING (id) LEFT JOIN hits h ON h.component = c.component GROUP BY c.component""",
    "borders": f"""WITH {_STRATA}, q AS (SELECT "group", quantile_cont(d, 0.5) AS mid FROM strata GROUP BY "group"), core AS (SELECT id, "group", max(d) OVER (PARTITION BY "group") AS radius FROM strata JOIN q USING ("group") WHERE d <= mid),
r AS (SELECT k.src AS id, c."group" AS label, k.dist::FLOAT::DOUBLE / c.radius AS ratio, k.rank FROM knn k JOIN core c ON c.id = k.dst WHERE k.rank <= 4 AND k.src NOT IN (SELECT id FROM core))
SELECT id, label::BIGINT AS label FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY ratio, rank) = 1 AND ratio <= 1""",
    "growth": f"""WITH RECURSIVE {_STRATA}, q AS (SELECT "group", quantile_cont(d, 0.5) AS mid FROM strata GROUP BY "group"),
core AS MATERIALIZED (SELECT id, ("group" >= 5)::INTEGER AS g, max(d) OVER (PARTITION BY "group") AS radius FROM strata JOIN q USING ("group") WHERE d <= mid),
e AS MATERIALIZED (SELECT k.src, k.dst, k.dist::FLOAT::DOUBLE AS dist, k.rank, a.g AS ga, b.g AS gb, a.radius AS ra, b.radius AS rb FROM knn k JOIN core a ON a.id = k.src JOIN core b ON b.id = k.dst),
inner_edges AS MATERIALIZED (SELECT src, dst, dist FROM e WHERE ga = gb AND dist <= ra UNION SELECT dst, src, dist FROM e WHERE ga = gb AND dist <= ra), {_components("core", "inner_edges")},
comp AS MATERIALIZED (SELECT id, g, min(label) AS component FROM cc JOIN core USING (id) GROUP BY id, g),
old AS MATERIALIZED (SELECT id, dense_rank() OVER (ORDER BY component) - 1 AS label FROM comp WHERE g = 0),
seeds AS MATERIALIZED (SELECT src AS id, arg_min(label, (dist, rank)) AS label FROM e JOIN old ON old.id = dst WHERE ga = 1 AND gb = 0 AND dist <= rb GROUP BY src),
fresh AS (SELECT id, dense_rank() OVER (ORDER BY component) + coalesce((SELECT max(label) FROM old), -1) AS label FROM comp WHERE g = 1 AND component NOT IN (SELECT component FROM comp JOIN seeds USING (id))),
walk(id, label, far, i) AS (SELECT id, label, 0::DOUBLE, 0 FROM seeds UNION ALL
  SELECT id, arg_min(label, (far, label)), min(far), i + 1 FROM (SELECT * FROM walk UNION ALL SELECT x.dst, label, far + x.dist, i FROM walk JOIN inner_edges x ON x.src = walk.id) WHERE i < 60 GROUP BY id, i)
SELECT id, label::BIGINT AS label FROM old UNION ALL SELECT id, label::BIGINT FROM fresh UNION ALL SELECT id, label::BIGINT FROM walk WHERE i = 60""",
    "data_terms": f"WITH {_SHELLS} SELECT id, round(term, 3) AS term FROM shells",
    "mixture_assignment": f"""WITH {_E_STEP} SELECT id, CASE WHEN arg_max(k, (z, -k)) = 2 THEN 1 ELSE 0 END::INTEGER AS "group", round(sum(r) FILTER (k = 2), 4) AS p_background FROM resp GROUP BY id""",
    "em_step": f"""WITH RECURSIVE {_E_STEP}, s AS MATERIALIZED (SELECT k, sum(r) AS n, sum(r * s1) AS w1, sum(r * s2) AS w2, sum(r * s3) AS w3 FROM resp GROUP BY k),
goal AS (SELECT (2 * ln(2) + 2 * ln(4) + 4 * ln(8)) / 8 AS t),
b(k, lo, hi, i) AS (SELECT k, -20::DOUBLE, 20::DOUBLE, 0 FROM s UNION ALL
  SELECT k, CASE WHEN pull > 0 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN pull > 0 THEN (lo + hi) / 2 ELSE hi END, i + 1
  FROM (SELECT b.*, w1 * power(2, (lo + hi) / 2) * (ln(2) - t) + w2 * power(4, (lo + hi) / 2) * (ln(4) - t) + w3 * power(8, (lo + hi) / 2) * (ln(8) - t) AS pull FROM b JOIN s USING (k), goal WHERE i < 60)),
f AS (SELECT s.*, (lo + hi) / 2 AS slope FROM s JOIN b USING (k) WHERE i = 60),
m AS (SELECT *, ln(n * 8) - ln(w1 * power(2, slope) + w2 * power(4, slope) + w3 * power(8, slope)) AS mu, sum(n) OVER () AS total FROM f)
SELECT k AS component, round(n, 2) AS effective, round(n / total, 4) AS weight, round(slope, 3) AS slope, round(mu, 3) AS mu, round(exp(mu + slope * ln(2)), 3) AS rate_2, round(exp(mu + slope * ln(4)), 3) AS rate_4, round(exp(mu + slope * ln(8)), 3) AS rate_8 FROM m""",
    "em_rounds": f"""WITH RECURSIVE {_SHELLS}, goal AS (SELECT (2 * ln(2) + 2 * ln(4) + 4 * ln(8)) / 8 AS t), comps0(m, k, w, r1, r2, r3) AS (VALUES {_TWO}),
{", ".join(_em_round(i) for i in range(ROUNDS))}
SELECT m AS model, k AS component, round(w, 4) AS weight, round(slope, 3) AS slope, round(r1, 3) AS rate_2, round(r2, 3) AS rate_4, round(r3, 3) AS rate_8 FROM comps{ROUNDS}""",
    "information_scores": f"""WITH {_E_STEP}, t AS (SELECT sum(z - ln(r)) FILTER (k = 0) AS ll, -sum(CASE WHEN r > 0 THEN r * ln(r) ELSE 0 END) AS h, count(*) FILTER (k = 0) AS n FROM resp)
SELECT criterion, round(CASE criterion WHEN 'bic' THEN -2 * ll + 8 * ln(n) WHEN 'aicc' THEN -2 * ll + 16 + 2 * 8 * 9 / (n - 9)::DOUBLE ELSE -2 * ll + 8 * ln(n) + 2 * h END, 1) AS score FROM t, (VALUES ('bic'), ('aicc'), ('icl')) c(criterion)""",
    "window_sizes": f"""WITH RECURSIVE {_knn(K)}, d4 AS (SELECT src AS id, dist::FLOAT::DOUBLE AS d FROM knn WHERE rank = 4),
o AS MATERIALIZED (SELECT id, (row_number() OVER (ORDER BY d, id) - 1) // 16 AS w FROM d4),
one AS (SELECT k.src, k.dst FROM knn k JOIN o a ON a.id = k.src JOIN o b ON b.id = k.dst WHERE k.rank <= 4 AND a.w = b.w),
inner_edges AS MATERIALIZED (SELECT src, dst FROM one UNION SELECT dst, src FROM one), {_components("o", "inner_edges")},
comp AS (SELECT id, min(label) AS component FROM cc GROUP BY id)
SELECT w::BIGINT AS "window", max(n)::BIGINT AS size FROM (SELECT w, component, count(*) AS n FROM comp JOIN o USING (id) GROUP BY ALL) GROUP BY w""",
    "background_scan": f"""WITH RECURSIVE v AS (SELECT c_custkey::BIGINT AS id, c_acctbal::DOUBLE / 1000 AS x, (c_custkey * 104729 % 10007) / 1000.0::DOUBLE AS y FROM customer),
p AS MATERIALIZED (SELECT id, (CASE WHEN id <= 4 THEN 20 + x / 500 ELSE x END)::FLOAT::DOUBLE AS x, (CASE WHEN id <= 4 THEN 20 + y / 500 ELSE y END)::FLOAT::DOUBLE AS y FROM v),
knn AS MATERIALIZED (SELECT a.id AS src, b.id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY dist, b.id) AS rank FROM p a JOIN p b ON a.id <> b.id QUALIFY rank <= 4),
o AS MATERIALIZED (SELECT src AS id, row_number() OVER (ORDER BY dist::FLOAT, src) - 1 AS pos FROM knn WHERE rank = 4), n AS (SELECT count(*) AS n FROM o),
widths AS (SELECT (4 * power(2, j))::BIGINT AS w FROM range(40) t(j), n WHERE 8 * power(2, j) <= n),
one AS (SELECT w, a.pos AS src, b.pos AS dst FROM knn k JOIN o a ON a.id = k.src JOIN o b ON b.id = k.dst, widths WHERE a.pos // w = b.pos // w),
both_ways AS MATERIALIZED (SELECT w, src, dst FROM one UNION SELECT w, dst, src FROM one),
cc(w, pos, label) AS (SELECT w, pos, pos FROM o, widths UNION SELECT e.w, e.dst, c.label FROM cc c JOIN both_ways e ON e.w = c.w AND e.src = c.pos AND c.label < e.dst),
comp AS MATERIALIZED (SELECT w, pos, min(label) AS label FROM cc GROUP BY w, pos),
sizes AS MATERIALIZED (SELECT w, pos // w AS win, label, count(*) AS size FROM comp GROUP BY ALL), largest AS (SELECT w, win, max(size) AS size FROM sizes GROUP BY ALL),
ranks AS (SELECT a.w, count(*) FILTER (b.win > 0 AND b.size >= a.size) AS later, count(*) AS windows FROM largest a JOIN largest b USING (w) WHERE a.win = 0 GROUP BY a.w),
best AS (SELECT w FROM ranks WHERE windows >= 2 ORDER BY -ln((1 + later) / windows) DESC, w LIMIT 1),
top AS (SELECT w, label FROM sizes JOIN best USING (w) WHERE win = 0 ORDER BY size DESC, label LIMIT 1)
SELECT o.id, 0::BIGINT AS event FROM comp JOIN top USING (w, label) JOIN o USING (pos)""",
    "single_layer": """SELECT vec_id::BIGINT AS id, CASE WHEN label = 2 THEN 1 ELSE 0 END::INTEGER AS "group" FROM embeddings""",
    "mutual_information": f"""WITH {_Y}, m AS (SELECT y, greatest(p, -1) AS p, n::DOUBLE AS n FROM c WHERE y >= 0), a AS (SELECT y, sum(n) AS a FROM m GROUP BY y), b AS (SELECT p, sum(n) AS b FROM m GROUP BY p), t AS (SELECT sum(n) AS n FROM m),
mi AS (SELECT sum(m.n / t.n * ln(m.n * t.n / (a.a * b.b))) AS mi FROM m JOIN a USING (y) JOIN b USING (p), t),
h AS (SELECT (SELECT -sum(a / n * ln(a / n)) FROM a, t) AS ha, (SELECT -sum(b / n * ln(b / n)) FROM b, t) AS hb),
g AS (SELECT a, b, n, unnest(generate_series(greatest(1, a + b - n)::BIGINT, least(a, b)::BIGINT))::DOUBLE AS x FROM a, b, t),
e AS (SELECT sum(x / n * ln(n * x / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(x + 1) - lgamma(a - x + 1) - lgamma(b - x + 1) - lgamma(n - a - b + x + 1))) AS emi FROM g)
SELECT round((mi - emi) / ((ha + hb) / 2 - emi), 6) AS ami FROM mi, h, e""",
    "peak_centers": """WITH p AS (SELECT c_custkey::BIGINT AS id, (c_acctbal::DOUBLE / 1000)::FLOAT::DOUBLE AS x, c_nationkey::DOUBLE AS y FROM customer),
pairs AS MATERIALIZED (SELECT a.id AS src, b.id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM p a JOIN p b ON a.id <> b.id),
n AS (SELECT count(*) AS n, ceil(0.02 * count(*))::BIGINT AS k FROM p),
near AS (SELECT src, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM pairs),
l AS (SELECT src AS id, -sum(dist::FLOAT::DOUBLE * dist::FLOAT::DOUBLE) / max(k) AS g FROM near, n WHERE rank <= k GROUP BY src),
rho AS MATERIALIZED (SELECT id, exp(g - max(g) OVER ()) AS rho FROM l),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY rho DESC, id) AS place FROM rho),
d AS (SELECT a.id, any_value(a.rho) AS rho, CASE WHEN any_value(a.place) = 1 THEN max(dist) ELSE min(dist) FILTER (b.place < a.place) END AS delta FROM pairs q JOIN o a ON a.id = q.src JOIN o b ON b.id = q.dst GROUP BY a.id),
means AS (SELECT avg(rho) AS mr, avg(delta) AS md FROM d),
c AS (SELECT id, rho * delta AS gamma FROM d, means WHERE rho > mr AND delta > md),
g AS (SELECT id, gamma, row_number() OVER (ORDER BY gamma DESC, id) AS pos, gamma - lead(gamma) OVER (ORDER BY gamma DESC, id) AS gap, (max(gamma) OVER () - min(gamma) OVER ()) / count(*) OVER () AS mean FROM c)
SELECT id AS center FROM g WHERE pos <= coalesce((SELECT max(pos) FROM g WHERE gap >= mean), 1)""",
    "comparison": f"""WITH {_RESULTS} SELECT * EXCLUDE (quality_delta, runtime_ratio), round(quality_delta, 5) AS quality_delta, round(runtime_ratio, 5) AS runtime_ratio FROM jobs""",
    "comparison_by_suite": f"""WITH {_RESULTS} SELECT suite, count(quality_delta) AS pairs, round(median(quality_delta), 5) AS median_quality_delta, round(min(quality_delta), 5) AS worst_quality_delta, count(*) FILTER (quality_delta > 0.002) AS improved_pairs, count(*) FILTER (quality_delta < -0.002) AS regressed_pairs,
       round(median(runtime_ratio), 5) AS median_runtime_ratio, count(*) FILTER (presence <> 'both') AS unpaired, count(*) FILTER (new_failure) AS new_failures FROM jobs GROUP BY ROLLUP (suite)""",
    "comparison_verdict": f"""WITH {_RESULTS}, x AS (SELECT 'all' AS c, * FROM jobs UNION ALL SELECT 'paired', * FROM jobs WHERE presence = 'both' UNION ALL SELECT 'sound', * FROM jobs WHERE presence = 'both' AND NOT new_failure),
m AS (SELECT c, min(m) AS m FROM (SELECT c, median(quality_delta) AS m FROM x GROUP BY c, suite) GROUP BY c)
SELECT c AS jobs, CASE WHEN count(*) FILTER (presence <> 'both') > 0 THEN 'incomparable' WHEN count(*) FILTER (new_failure) > 0 OR min(m) < -0.01 OR min(quality_delta) < -0.5 THEN 'regressed' WHEN count(quality_delta) = 0 THEN 'incomparable'
  ELSE CASE WHEN median(quality_delta) > 0.01 THEN 'improved' ELSE 'unchanged' END || CASE WHEN median(runtime_ratio) > 1.25 THEN '_slower' ELSE '' END END AS verdict FROM x JOIN m USING (c) GROUP BY c""",
    "clustering_metrics": f"""WITH {_Y}, t AS (SELECT sum(s * (s - 1) / 2)::DOUBLE AS tp FROM (SELECT sum(n) AS s FROM c WHERE y >= 0 GROUP BY y)), q AS (SELECT sum(s * (s - 1) / 2)::DOUBLE AS pp, count(*) AS k FROM (SELECT sum(n) AS s FROM c WHERE p >= 0 GROUP BY p)),
z AS (SELECT coalesce(sum(n * (n - 1) / 2) FILTER (y >= 0 AND p >= 0), 0)::DOUBLE AS b, coalesce(sum(n) FILTER (y >= 0 AND p >= 0), 0)::DOUBLE AS ss, sum(n) FILTER (p >= 0)::DOUBLE AS sp, sum(n) FILTER (y >= 0)::DOUBLE AS st,
             coalesce(sum(n) FILTER (y < 0 AND p < 0), 0)::DOUBLE AS nn, sum(n) FILTER (p < 0)::DOUBLE AS np, sum(n) FILTER (y < 0)::DOUBLE AS nt, sum(n)::DOUBLE AS n FROM c),
r AS (SELECT b / pp AS pr, b / tp AS rr, nn / np AS npr, nn / nt AS nr, ss / sp AS spr, ss / st AS sr, k, np / n AS nf FROM t, q, z),
f AS (SELECT *, 2 * pr * rr / (pr + rr) AS pf, 2 * npr * nr / (npr + nr) AS nff, 2 * spr * sr / (spr + sr) AS sf FROM r)
SELECT round(pr, 9) AS pairwise_precision, round(rr, 9) AS pairwise_recall, round(pf, 9) AS pairwise_f1, round(npr, 9) AS noise_precision, round(nr, 9) AS noise_recall, round(nff, 9) AS noise_f1,
       round(spr, 9) AS signal_precision, round(sr, 9) AS signal_recall, round(sf, 9) AS signal_f1, round((sf + nff) / 2, 9) AS binary_macro_f1, round((sr + nr) / 2, 9) AS binary_balanced_accuracy,
       round(sr, 9) AS signal_coverage, round(nr, 9) AS background_rejection, k::DOUBLE AS n_clusters, round(nf, 9) AS noise_fraction FROM f""",
    "contingency": f"WITH {_Y} SELECT y, p, n FROM c",
    "pair_scores": f"""WITH {_Y}, t AS (SELECT y, sum(n) AS ts FROM c WHERE y >= 0 GROUP BY y), q AS (SELECT p, sum(n) AS cs FROM c WHERE p >= 0 GROUP BY p)
SELECT y, p, n, ts::BIGINT AS target_size, cs::BIGINT AS cluster_size, round(n / cs, 9) AS purity, round(n / ts, 9) AS coverage, round(2 * (n / cs) * (n / ts) / (n / cs + n / ts), 9) AS f1 FROM c JOIN t USING (y) JOIN q USING (p)""",
    "target_summary": f"""WITH {_Y}, t AS (SELECT y, sum(n) AS ts, coalesce(sum(n) FILTER (p < 0), 0) AS lost FROM c WHERE y >= 0 GROUP BY y), q AS (SELECT p, sum(n) AS cs FROM c WHERE p >= 0 GROUP BY p),
f AS (SELECT y, max(2 * (n / cs) * (n / ts) / (n / cs + n / ts)) AS best, count(*) FILTER (n >= greatest(1, ceil(ts * 0.05))) AS fragments FROM c JOIN t USING (y) JOIN q USING (p) GROUP BY y)
SELECT y, ts::BIGINT AS target_size, round(lost / ts, 9) AS target_noise_loss, coalesce(fragments, 0) AS fragments, round(coalesce(best, 0), 9) AS best_f1 FROM t LEFT JOIN f USING (y)""",
    "cluster_burden": f"""WITH {_Y}, q AS (SELECT p, sum(n) AS s, coalesce(sum(n) FILTER (y >= 0), 0) AS hit FROM c WHERE p >= 0 GROUP BY p), t AS (SELECT count(DISTINCT y) AS k FROM c WHERE y >= 0)
SELECT count(*) AS predicted_cluster_count, count(*) FILTER (hit > 0) AS candidate_clusters_with_target_overlap, count(*) FILTER (hit = 0) AS background_only_predicted_clusters,
       count(*) FILTER (s - hit > hit) AS background_majority_predicted_clusters, round(count(*) / max(k), 9) AS candidate_clusters_per_target FROM q, t""",
    "evaluation": f"""WITH RECURSIVE {_Y}, {_MATCHED}
SELECT y, target_size, fragments, p, coalesce(n, 0)::BIGINT AS overlap, round(lost / target_size, 9) AS target_noise_loss, round(coalesce(f1, 0), 9) AS f1 FROM m""",
    "evaluation_summary": f"""WITH RECURSIVE {_Y}, {_MATCHED}, noise AS (SELECT 2 * sum(n) FILTER (y < 0 AND p < 0) / (sum(n) FILTER (p < 0) + sum(n) FILTER (y < 0)) AS f1 FROM c),
held AS (SELECT count(*) AS n FROM (SELECT p FROM w JOIN t USING (y) WHERE n >= least GROUP BY p HAVING count(*) > 1)), q AS (SELECT count(DISTINCT p) AS n FROM c WHERE p >= 0),
s AS (SELECT avg(coalesce(f1, 0)) AS macro, sum(coalesce(f1, 0) * target_size) / sum(target_size) AS weighted, avg(coalesce(n / cs, 0)) AS purity, sum(coalesce(n / target_size, 0) * target_size) / sum(target_size) AS coverage,
  avg((coalesce(f1, 0) >= 0.8)::INTEGER) AS success, avg(fragments) AS fragments, avg(lost / target_size) AS lost, sum(greatest(fragments - 1, 0))::BIGINT AS extra, count(p) AS matched, count(*) FILTER (f1 >= 0.9) AS recovered FROM m)
SELECT round(macro, 9) AS macro_target_f1, round(weighted, 9) AS weighted_target_f1, round(purity, 9) AS macro_target_purity, round(coverage, 9) AS weighted_target_coverage, round(success, 9) AS target_success_rate_f1_080,
  round(fragments, 9) AS mean_target_fragments, round(lost, 9) AS macro_target_noise_loss, round(CASE WHEN macro > 0 AND noise.f1 > 0 THEN 2 / (1 / macro + 1 / noise.f1) ELSE 0 END, 9) AS noise_aware_macro_f1,
  extra AS extra_signal_fragments, held.n AS merged_predicted_clusters, q.n - matched AS unmatched_predicted_cluster_count, recovered AS recovered_truth_clusters_f1_090 FROM s, noise, held, q""",
    "adjusted_rand": f"""WITH {_Y}, m AS (SELECT * FROM c WHERE y >= 0), a AS (SELECT sum(s * (s - 1) / 2)::DOUBLE AS a FROM (SELECT sum(n) AS s FROM m GROUP BY y)), b AS (SELECT sum(s * (s - 1) / 2)::DOUBLE AS b FROM (SELECT sum(n) AS s FROM m GROUP BY p)),
z AS (SELECT sum(n * (n - 1) / 2)::DOUBLE AS z, sum(n)::DOUBLE AS n FROM m) SELECT round((z - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 9) AS ari FROM a, b, z""",
    "peak_density": """WITH n AS (SELECT count(*) AS n, ceil(0.02 * count(*))::BIGINT AS k FROM embeddings), """ + _knn(1_000_000) + """,
l AS (SELECT src AS id, -sum(dist::FLOAT::DOUBLE * dist::FLOAT::DOUBLE) / max(k) AS g FROM knn, n WHERE rank <= k GROUP BY src) SELECT id, round(exp(g - max(g) OVER ()), 4) AS rho FROM l""",
    "peak_parents": f"""WITH {_knn(1)}, top AS (SELECT min(vec_id)::BIGINT AS id FROM embeddings)
SELECT src AS id, round(min(dist) FILTER (dst < src), 4) AS delta, arg_min(dst, (dist, dst)) FILTER (dst < src) AS parent FROM pairs WHERE src <> (SELECT id FROM top) GROUP BY src
UNION ALL SELECT src, round(max(dist), 4), -1 FROM pairs WHERE src = (SELECT id FROM top) GROUP BY src""",
    "follow_parents": "SELECT c_custkey::BIGINT AS id, CASE WHEN c_custkey < 10 THEN c_custkey ELSE c_custkey // 10 * 10 END::BIGINT AS root FROM customer",
    "symmetric_edges": f"WITH {_knn(4)} SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM knn",
    "unit_vectors": """WITH p AS (SELECT c_custkey::BIGINT AS id, (c_acctbal::DOUBLE / 1000)::FLOAT::DOUBLE AS a, c_nationkey::FLOAT::DOUBLE AS b FROM customer)
SELECT id, round(CASE WHEN sqrt(a * a + b * b) > 2.220446049250313e-16 THEN a / sqrt(a * a + b * b) ELSE a END, 5) AS x, round(CASE WHEN sqrt(a * a + b * b) > 2.220446049250313e-16 THEN b / sqrt(a * a + b * b) ELSE b END, 5) AS y FROM p""",
    "signal_log_odds": "WITH p AS (SELECT p_partkey, greatest(least(p_size / 50.0::DOUBLE, 1 - 2.220446049250313e-16), 2.220446049250313e-16) AS p FROM part) SELECT p_partkey, round(CASE WHEN p > 0.999 THEN ln(2.220446049250313e-16) - ln(p) ELSE ln(1 - p) - ln(p) END, 6) AS log_odds FROM p",
    "topology_evidence": """WITH p AS (SELECT p_partkey, p_size::BIGINT AS size, (p_partkey % (p_size * 4 + 1))::DOUBLE AS s, p_size * 4.0::DOUBLE AS t, (p_size - 1) / 499.0::DOUBLE AS p0 FROM part)
SELECT p_partkey, CASE WHEN size >= 2 AND s >= 1 AND s <= t AND s / t > p0 THEN round(lgamma(s + 0.5) + lgamma(t - s + 0.5) - lgamma(t + 1) - ln(pi()) - s * ln(p0) - CASE WHEN t > s THEN (t - s) * ln(1 - p0) ELSE 0 END, 5) END AS evidence FROM p""",
    "job_expansion": """WITH j AS (SELECT c || '__' || t || '__n' || n AS dataset_id, m AS method, s::BIGINT AS seed, n::BIGINT AS n,
       '{"dataset":{"dimension":2,"family":"' || f || '","id":"' || c || '","n":' || n || ',"noise_fraction":0.5,"tier":"' || t || '"},"dataset_id":"' || c || '__' || t || '__n' || n || '","method":"' || m || '","protocol_version":"query","schema_version":1,"seed":' || s || ',"suite":"synthetic"}' AS job
FROM (VALUES ('moons_2d', 'moons'), ('rings_2d', 'rings')) cases(c, f), (VALUES ('quality')) tiers(t), (SELECT count(*) FROM supplier UNION ALL SELECT count(*) FROM customer) sizes(n), (VALUES ('strata'), ('dbscan')) methods(m), (SELECT n_nationkey FROM nation) seeds(s))
SELECT dataset_id, method, seed, n, sha256(job)[1:12] AS digest FROM j""",
    "field_choice": "SELECT 'part-' || p_partkey AS field FROM part ORDER BY sha256('query:part-' || p_partkey) LIMIT 100",
    "synthetic_family": """WITH o AS (SELECT count(*) AS n, round_even(0.75 * count(*), 0)::BIGINT AS signal FROM orders)
SELECT i::BIGINT AS y, signal // 6 + (i < signal % 6)::BIGINT AS n FROM o, range(6) t(i) UNION ALL SELECT -1, n - signal FROM o""",
}
