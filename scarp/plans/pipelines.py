"""The three verbs: embed a data set, analyze a run, compare runs."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scarp.functions import fits
from scarp.functions.featurizers import FEATURIZERS, OPTIONAL, check_reuse, featurize
from scarp.functions.metrics import get_metric
from scarp.functions.scaling import scale_pairs
from scarp.operators import cliffs, compounds, correlation, fitted, geometry, graph, pairs, plotdata, runs, stats, structures, umap
from scarp.operators.differences import Differences
from scarp.sources import datasets, figures, sinks

log = logging.getLogger(__name__)

DEFAULTS = {
    "activity_threshold": 1.0, "similarity_threshold": None, "center": False, "large_coords_to_trim": None, "scaling_function": "linear",
    "scaling_cutoff_percentile": 99.0, "seed": 42, "n_compounds": None, "n_bits": None, "radius": None, "chirality": None, "matrices": True, "figures": True,
}
OPTIONS = ("n_bits", "radius", "chirality")
#: Where embed writes and analyze looks unless a config says otherwise.
EMBEDDINGS = "embeddings"


def _options(config: dict) -> dict:
    return {k: config[k] for k in OPTIONS if config.get(k) is not None}


def _stored_options(path: str) -> dict | None:
    """The featurizer options that embed wrote beside a table; None if there is no record."""
    record = Path(f"{path}.options.json")
    return json.loads(record.read_text()) if record.exists() else None


def _named(rows: DataFrame, config: dict) -> DataFrame:
    """Compounds with compound_id: the trimmed structure, or with `"structure_keys": true` the key that all ways to write a molecule share (rows that cannot be read are left out)."""
    if not config.get("structure_keys"):
        return rows.withColumn("compound_id", F.trim("structure"))
    named = structures.with_key(rows)
    bad = rows.join(named.select("pos"), "pos", "left_anti").agg(F.count("*").alias("n"), F.min("pos").alias("pos")).first()
    if bad["n"]:
        log.warning("%d structures cannot be read, the first in row %d; they are left out", bad["n"], bad["pos"])
    return named


def load(spark: SparkSession, config: dict) -> tuple[DataFrame, datasets.Dataset]:
    """The compounds of a config: repeats removed (the first stays), vectors attached.

    Vectors come from the config's embeddings_file, which must have them; else from the table that
    embed writes by default, if it has them with the same options; else they are made.
    """
    dataset = datasets.resolve(config)
    method, stored = config["embedding_method"], config.get("embeddings_file")
    if stored:
        if not check_reuse(spark.read.parquet(stored).columns, _stored_options(stored), method, _options(config)):
            raise ValueError(f"{stored} has no vectors {method!r}")
    else:
        usual = f"{EMBEDDINGS}/{dataset.name}.parquet"
        if Path(usual).exists() and (method != "morgan" or _stored_options(usual) == _options(config)) and method in spark.read.parquet(usual).columns:
            stored = usual
    if stored:
        rows = spark.read.parquet(stored).withColumn("embedding", F.col(method)).filter("embedding IS NOT NULL")
        rows = compounds.with_activity(rows, dataset.unit, dataset.censor_threshold)
        rows = compounds.head(rows, config["n_compounds"]) if config.get("n_compounds") else rows
    else:
        raw = _named(datasets.read_compounds(spark, dataset, config.get("n_compounds")), config)
        rows = featurize(raw, [method], **_options(config)).withColumnRenamed(method, "embedding").filter("embedding IS NOT NULL")
        bad = raw.join(rows.select("pos"), "pos", "left_anti").agg(F.count("*").alias("n"), F.min("pos").alias("pos")).first()
        if bad["n"]:
            if method not in OPTIONAL and config.get("strict"):
                raise ValueError(f"{bad['n']} structures cannot be read, the first in row {bad['pos']}")
            log.warning("%d structures cannot be read, the first in row %d; they are left out", bad["n"], bad["pos"])
    rows = compounds.keep_first(rows.withColumn("group_key", compounds.group_key(F.col("compound_id"))))
    # coordinates have means only where all vectors have one length
    flat = dict(rows.dtypes)["embedding"] in ("array<double>", "array<float>") and rows.agg(compounds.stackable().alias("s")).first()["s"]
    if flat and config.get("large_coords_to_trim"):
        rows = compounds.trim(rows, config["large_coords_to_trim"])
    return compounds.center(rows) if flat and config.get("center") else rows, dataset


def _rows(df: DataFrame) -> list[dict]:
    """Of a result whose size does not depend on the data."""
    return [r.asDict(recursive=True) for r in df.collect()]


def subset_block(subset: DataFrame, threshold: float) -> dict:
    """What is said of a curated subset of valid pairs: its cliffs, their statistics and slopes, fits of both, and zero distances."""
    total, n = subset.agg(F.count("*"), F.count_if(pairs.is_cliff(threshold))).first()
    found = subset.filter(pairs.is_cliff(threshold))
    block: dict = {"n_total_pairs": total, "n_pairs": n, "fraction_cliffs": n / total if total else 0.0, "activity_threshold": threshold, "regularization_factor": correlation.REGULARIZATION}
    if not n:
        return block | dict.fromkeys(("statistics", "histogram", "kww_fit", "kww_theoretical", "distance_beta_fit")) | {"n_zero": 0, "zero_fraction": 0.0}
    slopes = correlation.with_lipschitz(found)
    kww = fitted.kww(slopes, "regularized_lipschitz")
    zero = _rows(correlation.zero_fraction(found))[0]
    return block | {
        "statistics": {x.pop("measure"): x for x in _rows(correlation.subset_stats(found))}, "histogram": _rows(correlation.lipschitz_histogram(slopes)),
        "kww_fit": kww, "kww_theoretical": fits.kww_theory(kww["a"], kww["k"], kww["b"]), "distance_beta_fit": fitted.beta_distance(found, "distance_scaled", cut=0.99),
        "n_zero": zero["n_zero"], "zero_fraction": zero["zero_fraction"],
    }


def _listed(spark: SparkSession, path: str | None) -> tuple[DataFrame | None, dict | None]:
    """(the pair list, None), or (None, a record of what is wrong with it)."""
    if not path:
        return None, None
    try:
        if "://" not in path and not Path(path).exists():
            return None, {"n_pairs": 0, "error": "file_not_found", "mmp_file": path}
        return datasets.read_listed(spark, path), None
    except ValueError:
        return None, {"n_pairs": 0, "error": "missing_columns", "mmp_file": path}


def analyze(spark: SparkSession, config: dict, table: DataFrame | None = None, listed: DataFrame | None = None, name: str | None = None) -> str:
    """Run every analysis and write tables, plot tables, dense matrices (unless the config says `"matrices": false`), summary.json and report.md; returns the run's folder.

    `table` gives the compounds instead of the config's data set. The pair table is written once
    and every analysis reads it from there. A pair list that cannot be read is recorded, not an error.
    """
    config = DEFAULTS | config
    metric = config["distance_metric"]
    get_metric(metric)
    wrong = None
    if table is None:
        table, dataset = load(spark, config)
        name = dataset.name
        listed, wrong = _listed(spark, dataset.listed_path)
    run = sinks.run_id({k: config[k] for k in sorted(config) if k != "output_dir"})
    folder = f"{config.get('output_dir', 'results')}/{name or 'table'}/{config.get('embedding_method', 'vectors')}_{metric}_{run}"
    threshold = config["activity_threshold"]
    read = lambda t: spark.read.parquet(f"{folder}/{t}")
    sinks.write_table(pairs.pair_table(table, metric), folder, "distances")
    sinks.write_table(correlation.with_lipschitz(scale_pairs(read("distances"), metric, config["scaling_function"], config["scaling_cutoff_percentile"])), folder, "pairs")
    p = read("pairs")
    if config["similarity_threshold"] is not None:
        p = pairs.at_least(p, config["similarity_threshold"])
        if p.isEmpty():
            raise ValueError(f"no pair reaches similarity {config['similarity_threshold']}")
    valid = pairs.valid(p)
    pearson = correlation.with_p_values(correlation.binned_pearson(p))
    tables = {
        "cliff_fractions": cliffs.cliff_fractions(p, threshold), "rank_curve": cliffs.rank_curve(p, threshold), "top_cliffs": cliffs.top_cliffs(p, 5, threshold),
        "cliffs_by_threshold": cliffs.sets_by_threshold(p, threshold), "cliffs_by_rank": cliffs.sets_by_rank(p, threshold),
        "cliff_probability": correlation.cliff_probability(p, threshold), "binned_pearson": pearson, "log_lipschitz": correlation.log_lipschitz(p),
        "conditional_probability": correlation.conditional_probability(p, threshold), "conditional_by_width": correlation.conditional_by_width(p, threshold),
        "lipschitz_histogram": correlation.lipschitz_histogram(p), "identical_pairs": valid.filter("distance_raw = 0"), "same_activity_pairs": valid.filter("log_ratio = 0"),
        "hubs": geometry.hubs(p),
    }
    for key, df in tables.items():
        sinks.write_table(df, folder, key)
    universe = _rows(graph.universe(p, threshold))[0]
    n = universe["n_compounds"]
    sinks.write_table(graph.edges(p), folder, "edges")
    edges = read("edges")
    sinks.write_table(graph.irreducibility(edges, n, threshold), folder, "irreducibility")
    sinks.write_table(graph.persistence(graph.spanning_forest(edges), n), folder, "persistence")
    sinks.write_table(graph.landscape(read("persistence")), folder, "persistence_landscape")
    fractions, ranks = (sorted(_rows(read(t)), key=lambda x: x[k]) for t, k in (("cliff_fractions", "similarity_threshold"), ("rank_curve", "percent_rank")))
    power = fits.fit_power_law([x["percent_rank"] for x in ranks], [x["cumulative_fraction"] for x in ranks])
    shares = fits.fit_sigmoid([x["similarity_threshold"] for x in fractions], [x["cliff_fraction"] for x in fractions], max_x=1.0)
    slopes = valid.filter("regularized_lipschitz IS NOT NULL")
    kww = fitted.kww(slopes, "regularized_lipschitz")
    beta = fitted.beta_distance(valid, "distance_scaled")
    race = fitted.race(valid, "distance_scaled")
    unimodal = fitted.dip(valid)
    label = "not tested" if unimodal["n_values"] < 4 else "multimodal" if unimodal["p_value"] < 0.05 else "unimodal"
    subsets = {"group": subset_block(pairs.group_pairs(p), threshold)}
    if listed is not None:
        subsets["listed"] = subset_block(pairs.listed_pairs(valid.filter("log_ratio IS NOT NULL"), listed), threshold)
    elif wrong:
        subsets["listed"] = wrong
    _plot_tables(p, folder, listed, shares, power, kww, beta, race)
    if config["figures"]:
        figures.write_figures(spark, f"{folder}/plots")
    if config["matrices"]:
        sinks.write_matrices(p, f"{folder}/matrices", {"distance": "distance_scaled_structure", "similarity": "similarity", "log_ratio": "log_ratio"})
    summary = {
        "run": run, "name": name, "config": config, "n_compounds": n, "universe": universe,
        "status": {x["status"]: x["n"] for x in _rows(p.groupBy("status").agg(F.count("*").alias("n")))}, "zero": _rows(correlation.zero_percent(p))[0],
        "distance": _rows(stats.summary(p, "distance_raw"))[0], "lipschitz": _rows(correlation.lipschitz_stats(p))[0],
        "geometry": _rows(geometry.variation(p))[0] | _rows(geometry.relative_contrast(p))[0] | _rows(geometry.hub_summary(read("hubs")))[0], "dip": unimodal | {"label": label},
        "race": race, "distance_beta_fit": beta, "fit_cliff_fraction": shares, "fit_power_law": power | {"gini": fits.gini(power["s"])}, "kww": kww | fits.kww_theory(kww["a"], kww["k"], kww["b"]),
        "half_dissolution": _rows(graph.half_dissolution(read("irreducibility"))), "persistence": _rows(graph.persistence_stats(read("persistence")))[0],
        "subsets": subsets, "pearson": _rows(correlation.pearson_summary(read("binned_pearson")))[0], "extra": _rows(runs.extra_measures(p, run, listed, threshold))[0],
    }
    sinks.write_json(f"{folder}/summary.json", summary)
    Path(f"{folder}/report.md").write_text(report(summary, fractions, ranks))
    return folder


def _plot_tables(p: DataFrame, folder: str, listed: DataFrame | None, shares: dict, power: dict, kww: dict, beta: dict | None, race: list[dict]) -> None:
    """The numbers behind a run's figures, below plots/."""
    read = lambda t: p.sparkSession.read.parquet(f"{folder}/{t}")
    valid = pairs.valid(p)
    found = {
        "cliff_fractions": plotdata.curve_with_fit(read("cliff_fractions"), "similarity_threshold", "cliff_fraction", fits.sigmoid, [shares[k] for k in ("c", "a", "k", "x0")]),
        "cumulative_share": plotdata.curve_with_fit(read("rank_curve"), "percent_rank", "cumulative_fraction", fits.power_law, [power[k] for k in ("a", "s")]),
        "distance_histogram": plotdata.distance_histogram(p), "distance_cdf": plotdata.empirical_cdf(p, "distance_scaled"), "distance_models": plotdata.density_with_models(valid, "distance_scaled", race),
        "slope_density": plotdata.curve_with_fit(stats.density(stats.truncated(valid, "regularized_lipschitz"), "regularized_lipschitz", 100), "center", "density", fits.kww, [kww[k] for k in ("a", "k", "b")]),
        "slope_heatmap": plotdata.slope_heatmap(p), "log_slopes": plotdata.log_slope_histograms(p), "log_slope_quantiles": plotdata.normal_quantiles(valid.filter("regularized_lipschitz > 0").withColumn("log_slope", F.ln("regularized_lipschitz")), "log_slope"),
        "similarity_and_ratio": plotdata.similarity_and_ratio(p), "threshold_accuracy": plotdata.threshold_accuracy(p), "group_panels": plotdata.subset_panels(pairs.group_pairs(p).filter(pairs.is_cliff())),
    }
    if beta:
        model = [{"distribution": "beta", "param1": beta["a"], "param2": beta["b"], "log_likelihood": 0.0}]
        span = beta["scale_hi"] - beta["scale_lo"]
        found["distance_beta"] = plotdata.density_with_models(valid.select(((F.col("distance_scaled") - beta["scale_lo"]) / span).alias("u")), "u", model, 100)
    if listed is not None:
        found["listed_panels"] = plotdata.subset_panels(pairs.listed_pairs(valid, listed).filter(pairs.is_cliff()))
    for key, df in found.items():
        sinks.write_table(df, f"{folder}/plots", key)


def number(x) -> str:
    """Two decimals from 1000 on, four from 1 on, else four digits."""
    if x is None:
        return "n/a"
    if isinstance(x, (bool, str, int)):
        return str(x)
    return f"{x:,.2f}" if abs(x) >= 1000 else f"{x:.4f}" if abs(x) >= 1 else f"{x:.4g}"


def _table(rows: list[dict]) -> list[str]:
    return ["| " + " | ".join(rows[0]) + " |", "|" + "-|" * len(rows[0]), *["| " + " | ".join(number(v) for v in r.values()) + " |" for r in rows], ""] if rows else []


def _facts(title: str, values: dict | None) -> list[str]:
    plain = {k: v for k, v in (values or {}).items() if not isinstance(v, (dict, list))}
    return [f"## {title}", "", "| | |", "|-|-|", *[f"| {k} | {number(v)} |" for k, v in plain.items()], ""]


def report(summary: dict, fractions: list[dict], ranks: list[dict]) -> str:
    """A run's results as markdown: pairs, cliffs, correlation, subsets, irreducibility."""
    lines = [f"# {summary['name']} ({summary['run']})", "", f"{summary['n_compounds']} compounds", ""]
    for title in ("status", "universe", "zero", "distance", "lipschitz", "geometry", "dip", "distance_beta_fit", "fit_cliff_fraction", "fit_power_law", "kww", "persistence", "pearson", "extra"):
        lines += _facts(title.replace("_", " "), summary[title])
    for kind, block in summary["subsets"].items():
        lines += _facts(f"subset {kind}", block)
        lines += _table([{"measure": k} | v for k, v in (block.get("statistics") or {}).items()])
    for title, rows in (("models of the distance", summary["race"]), ("half dissolution", summary["half_dissolution"]), ("cliff fractions", fractions), ("rank curve", ranks)):
        if rows:
            lines += [f"## {title}", "", *_table(rows)]
    return "\n".join(lines)


def embed(spark: SparkSession, config: dict) -> str:
    """Write the table of vectors, statistics of activities, their differences, lengths, centers and projections, and the plot tables; returns its path.

    The differences of all pairs are summed up without being made; a config with log_ratios false leaves them out. Vectors of one
    length are projected by their neighbourhoods too (umap_n_neighbors, umap_min_dist and seed), unless `"umap": false`.
    """
    dataset = datasets.resolve(config)
    methods = config.get("methods") or [m for m in FEATURIZERS if m == "hashed_ngrams"]
    rows = _named(datasets.read_compounds(spark, dataset), config)
    rows = compounds.keep_first(featurize(rows, methods, **_options(config)))
    path = config.get("output_file", f"{EMBEDDINGS}/{dataset.name}.parquet")
    rows.write.mode("overwrite").parquet(path)
    sinks.write_json(f"{path}.options.json", _options(config))
    plots = f"{path}.plots"
    held = spark.read.parquet(path).filter("NOT censored")
    found: dict = {"activity": _rows(stats.summary(held, "log_activity"))[0]}
    mixture = fitted.mixture(held, "log_activity")
    if mixture:
        found["mixture"] = mixture | {f"q{q}": fits.mixture_quantile(q / 100, mixture) for q in (5, 25, 50, 75, 95)}
        sinks.write_table(plotdata.mixture_quantiles(held, "log_activity", mixture), plots, "activity_quantiles")
        sinks.write_table(stats.histogram(held, "log_activity", 50), plots, "activity")
    ratios = Differences(held, "log_activity") if mixture and config.get("log_ratios", True) else None
    if ratios and ratios.pairs:
        found["log_ratio"] = (summary := _rows(ratios.summary())[0])
        density, n = ratios.density(50)
        points = sorted(_rows(density), key=lambda r: r["bin"])
        curve = [[r[c] for r in points] for c in ("center", "density")]
        kww = fits.fit_kww(*curve, n)
        found["log_ratio_kww"] = kww | fits.kww_theory(kww["a"], kww["k"], kww["b"])
        found["log_ratio_gaussian"] = fits.fit_generalized_gaussian(*curve, summary["mean"], summary["std"])
        sinks.write_table(plotdata.curve_with_fit(density, "center", "density", fits.kww, [kww[k] for k in ("a", "k", "b")]), plots, "log_ratio")
        sinks.write_table(ratios.histogram(50), plots, "log_ratio_histogram")
    for m in methods:
        own = held.withColumn("embedding", F.col(m)).filter("embedding IS NOT NULL")
        if not own.agg(compounds.stackable().alias("s")).first()["s"]:
            log.warning("%s has vectors of different lengths, so no statistics", m)
            continue
        lengths = geometry.vector_lengths(own)
        found[m] = {"length": _rows(stats.summary(lengths, "length"))[0], "center": _rows(geometry.center_stats(own))[0]}
        for key, df in {"lengths": stats.histogram(lengths, "length", 50), "coordinates": plotdata.coordinates(own), "from_center": stats.histogram(plotdata.distance_from_center(own), "distance", 50), "pca2": compounds.projection(own)}.items():
            sinks.write_table(df, f"{plots}/{m}", key)
        if config.get("umap", True):
            settings = {"n_neighbors": config.get("umap_n_neighbors", umap.N_NEIGHBORS), "min_dist": config.get("umap_min_dist", umap.MIN_DIST), "seed": config.get("seed", 42)}
            sinks.write_table(umap.umap(own, **settings).join(own.select("pos", "log_activity"), "pos"), f"{plots}/{m}", "umap")
    if config.get("figures", True) and Path(plots).exists():
        for where in (plots, *[f"{plots}/{m}" for m in methods if Path(plots, m).exists()]):
            figures.write_figures(spark, where)
    sinks.write_json(f"{path}.summary.json", found)
    return path


#: The steps of a comparison and, of each run's summary, what they show.
STEPS: dict[str, dict[str, tuple[str, ...]]] = {
    "structure": {"p0_percent": ("zero", "p0_percent"), "cv": ("geometry", "cv"), "contrast": ("geometry", "median"), "hub_skewness": ("geometry", "skewness"), "dip_p": ("dip", "p_value"), "unimodality": ("dip", "label"), "model": ("race",)},
    "cliffs": {k: ("fit_cliff_fraction", k) for k in ("c", "a", "k", "x0")} | {"power_s": ("fit_power_law", "s"), "gini": ("fit_power_law", "gini"), "n_cliffs_top2": ("extra", "n_cliffs_top2")},
    "correlation": {"lipschitz_p90": ("lipschitz", "q90"), "lipschitz_p99": ("lipschitz", "q99"), "kww_k": ("kww", "k"), "kww_b": ("kww", "b"), "mean_r": ("pearson", "mean_r"), "group_std": ("extra", "group_std"), "listed_std": ("extra", "listed_std")},
    "irreducibility": {"half_degree": ("half_dissolution",), "mean_persistence": ("persistence", "mean_persistence"), "max_persistence": ("persistence", "max_persistence")},
}


def _shown(summary: dict, where: tuple[str, ...]):
    value = summary.get(where[0])
    if where[0] == "race":
        return next((m["distribution"] for m in value or [] if m["best"]), None)
    if where[0] == "half_dissolution":
        return next((h["degree"] for h in value or [] if h["level"] == summary["config"]["activity_threshold"]), None)
    return (value or {}).get(where[1])


def compare(spark: SparkSession, folders: list[str], output: str) -> DataFrame:
    """Tables over several analyzed runs, sorted by method and metric: settings, structure, cliffs, correlation, subsets,
    irreducibility, measures with marks, best and worst, Dice of the top cliffs; and report.md. Folders without a summary are left out with a warning."""
    found = []
    for f in folders:
        if Path(f, "summary.json").exists():
            found.append((f, json.loads(Path(f, "summary.json").read_text())))
        else:
            log.warning("%s has no summary.json and is left out", f)
    if not found:
        raise FileNotFoundError("none of the runs has a summary.json")
    method = lambda s: s["config"].get("embedding_method", "vectors")
    found.sort(key=lambda x: (method(x[1]), x[1]["config"]["distance_metric"], x[1]["run"]))
    labels = [f"{method(s)} / {s['config']['distance_metric']}" for _, s in found]
    labels = [x if labels.count(x) == 1 else f"{x} ({s['run']})" for x, (_, s) in zip(labels, found, strict=True)]
    lines = [f"# Comparison of {len(found)} runs", ""]

    def add(name: str, rows: list[dict]) -> None:
        if not rows:
            return
        kinds = {k: "string" if any(isinstance(r[k], str) for r in rows) else "double" for k in rows[0]}
        data = [tuple(None if v is None else str(v) if kinds[k] == "string" else float(v) for k, v in r.items()) for r in rows]
        sinks.write_table(spark.createDataFrame(data, ", ".join(f"`{k}` {t}" for k, t in kinds.items())), output, name)
        lines.extend([f"## {name.replace('_', ' ')}", "", *_table(rows)])

    settings = sorted({k for _, s in found for k, v in s["config"].items() if k != "output_dir" and not isinstance(v, (dict, list))})
    add("configurations", [{"run": x} | {k: None if s["config"].get(k) is None else str(s["config"][k]) for k in settings} for x, (_, s) in zip(labels, found, strict=True)])
    for step, columns in STEPS.items():
        rows = [{"run": x} | {k: _shown(s, where) for k, where in columns.items()} for x, (_, s) in zip(labels, found, strict=True)]
        add(step, rows)
        if any(k in runs.MARKED for k in columns):
            sinks.write_table(runs.best_cells(spark.read.parquet(f"{output}/{step}")), output, f"{step}_best")
    for kind in ("group", "listed"):
        blocks = [(x, s["subsets"].get(kind)) for x, (_, s) in zip(labels, found, strict=True)]
        columns = {"mean_distance": "mean_distance", "f": "f", "variance": "variance_distance", "cv": "cv_distance"}
        add(f"subset_{kind}", [
            {"run": x, "n_total_pairs": b.get("n_total_pairs"), "n_cliff_pairs": b.get("n_pairs")} | {k: (b.get("distance_beta_fit") or {}).get(v) for k, v in columns.items()}
            | {"n_zero": b.get("n_zero"), "zero_percent": None if b.get("zero_fraction") is None else 100 * b["zero_fraction"], "error": b.get("error")} for x, b in blocks if b
        ])
    every, landscapes, tops = None, None, []
    for i, (label, (f, s)) in enumerate(zip(labels, found, strict=True)):
        half = _shown(s, ("half_dissolution",))
        fitted_ = {"fraction_c": s["fit_cliff_fraction"]["c"], "fraction_x0": s["fit_cliff_fraction"]["x0"], "kww_b": s["kww"]["b"], "kww_k": s["kww"]["k"], "half_dissolution_degree": half, "h0_mean_persistence": s["persistence"]["mean_persistence"]}
        fitted_ |= {f"listed_{k}": (((s["subsets"].get("listed") or {}).get("statistics") or {}).get("similarity") or {}).get(v) for k, v in (("mean", "mean"), ("p99", "q99"))}
        own = runs.measures(spark.read.parquet(f"{f}/pairs"), label, i, fitted={k: float(v) for k, v in fitted_.items() if v is not None})
        curve = spark.read.parquet(f"{f}/persistence_landscape").withColumn("run", F.lit(label))
        every, landscapes = (own, curve) if every is None else (every.unionByName(own), landscapes.unionByName(curve))
        tops.append((label, spark.read.parquet(f"{f}/top_cliffs")))
    sinks.write_table(runs.marks(every), output, "measures")
    best = runs.best_and_worst(spark.read.parquet(f"{output}/measures").drop("mark"))
    sinks.write_table(best, output, "best_and_worst")
    sinks.write_table(runs.win_counts(spark.read.parquet(f"{output}/best_and_worst")), output, "win_counts")
    sinks.write_table(graph.landscape_norms(landscapes), output, "landscape_norms")
    sinks.write_table(graph.landscape_distances(landscapes), output, "landscape_distances")
    dice = None
    for i, (a, x) in enumerate(tops):
        for b, y in tops[i + 1 :]:
            own = runs.dice(x, y).select(F.lit(a).alias("one"), F.lit(b).alias("two"), "n_one", "n_two", "n_both", "dice")
            dice = own if dice is None else dice.unionByName(own)
    if dice is not None:
        sinks.write_table(dice, output, "dice_top5pct")
    for name in ("best_and_worst", "win_counts"):
        lines += [f"## {name.replace('_', ' ')}", "", *_table(sorted(_rows(spark.read.parquet(f"{output}/{name}")), key=str))]
    Path(output).mkdir(parents=True, exist_ok=True)
    Path(output, "report.md").write_text("\n".join(lines))
    return spark.read.parquet(f"{output}/best_and_worst")
