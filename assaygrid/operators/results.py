"""The results store as tables, and the queries that are served from it (AG11-AG17, AG21-AG23, JN, TK, SK3-SK6, SK9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.functions import text as tx

#: Columns of each table as DDL; maps and arrays hold what is nested.
SCHEMAS = {
    "runs": "id string, user_sub string, run_name string, status string, created_at timestamp, outcome_variable string, selected_features array<string>, excluded_features array<string>, data_version_id string, n_rounds_completed int, final_match_score double, converged boolean, stop_reason string, error_message string, config_snapshot string",
    "data_versions": "id string, filename string, content_hash string, schema_version string, dvc_hash string, parquet_path string, n_rows int, n_cols int, column_names array<string>, validation_errors array<string>, processed_at timestamp, validation_passed boolean",
    "dataset_upload_encodings": "user_sub string, filename string, encodings string, variable_layout string, created_at timestamp",
    "papers": "id string, user_sub string, filename string, content_hash string, title string, authors array<string>, embedding_model string, source string, mongo_chunk_ids array<string>, n_chunks int, n_tokens int, chunk_size int, parsed_at timestamp, indexed_at timestamp",
    "regimes": "id string, run_id string, label string, method string, description string, size int, summary_stats map<string,double>",
    "experiment_segmentation_batches": "id string, data_version_id string, run_id string, source_filename string, segmentation_method string, batch_index int, panel_entity_col string, panel_time_col string, dataset_columns map<string,string>",
    "experiment_segmented_regimes": "id string, batch_id string, regime_code string, n_rows int, conditions_json array<string>, extra_metadata map<string,string>",
    "experiment_regime_rows": "segmented_regime_id string, source_row_index int, source_row_label string",
    "experiment_regime_column_stats": "segmented_regime_id string, column_name string, column_role string, dtype string, is_constant_in_regime boolean, n_distinct int, value_counts map<string,bigint>",
    "experiment_regime_regression_specs": "segmented_regime_id string, candidate_inputs array<string>, categorical_inputs array<string>, numeric_inputs array<string>, outputs array<string>",
    "hypotheses": "id string, run_id string, hypothesis_id string, round int, description string, rationale string, primary_variables array<string>, control_variables array<string>, interaction_terms array<struct<a:string,b:string>>, model_family string, priority_score double, is_refinement boolean, rag_support array<string>",
    "model_results": "id string, hypothesis_id string, model_type string, regime_label string, r_squared double, adj_r_squared double, aic double, bic double, match_score double, n_observations int, coefficients map<string,double>, p_values map<string,double>, standard_errors map<string,double>, confidence_intervals map<string,struct<lo:double,hi:double>>, significant_variables array<string>, highly_significant array<string>, success boolean, error_message string",
    "validation_results": "id string, model_result_id string, overall_passed boolean, vif_passed boolean, normality_passed boolean, homoscedasticity_passed boolean, anova_passed boolean, cv_passed boolean, effect_size_passed boolean, max_vif double, shapiro_p double, bp_p double, anova_f double, anova_p double, cv_r2_mean double, cv_r2_std double, eta_squared double, effect_size_label string, pass_rate double, n_tests_run int, n_tests_passed int, warnings array<string>",
    "citations": "id string, model_result_id string, source string, title string, url string, authors array<string>, year string, similarity_score double, abstract_snippet string, variable string",
    "arxiv_cache_meta": "arxiv_id string, title string, fetched_at timestamp, expires_at timestamp, hit_count int",
    "s2_cache_meta": "paper_id string, title string, fetched_at timestamp, expires_at timestamp, hit_count int",
}


def owned(df: DataFrame, user: str) -> DataFrame:
    """FL9: a tenant's rows; tables are partitioned by user_sub, so the filter prunes."""
    return df.where(F.col("user_sub") == user)


def summary(runs: DataFrame, user: str, run: str) -> DataFrame:
    return owned(runs, user).where(F.col("id") == run)


def hypotheses_of(hypotheses: DataFrame, run: str, round_no: int | None = None) -> DataFrame:
    """TK5, FL10."""
    out = hypotheses.where(F.col("run_id") == run)
    out = out.where(F.col("round") == round_no) if round_no is not None else out
    return out.orderBy("round", F.desc("priority_score"), "id")


def models_of(hypotheses: DataFrame, models: DataFrame, validations: DataFrame, run: str) -> DataFrame:
    """JN1, JN7, TK6: a run's models by R2 with whether their validation passed (null without one)."""
    mine = models.join(hypotheses.where(F.col("run_id") == run).select(F.col("id").alias("hypothesis_id")), "hypothesis_id", "left_semi")
    passed = validations.select(F.col("model_result_id").alias("_m"), F.col("overall_passed").alias("validation_passed"))
    return mine.join(passed, F.col("id") == F.col("_m"), "left").drop("_m").orderBy(F.desc("r_squared"), "id")


def citations_of(hypotheses: DataFrame, models: DataFrame, citations: DataFrame, run: str, top: int = 100) -> DataFrame:
    """JN5, TK7."""
    mine = models.join(hypotheses.where(F.col("run_id") == run).select(F.col("id").alias("hypothesis_id")), "hypothesis_id", "left_semi").select(F.col("id").alias("model_result_id"))
    return citations.join(mine, "model_result_id", "left_semi").orderBy(F.desc("similarity_score"), "id").limit(top)


def convergence(hypotheses: DataFrame, models: DataFrame, validations: DataFrame) -> DataFrame:
    """JN2, JN3, AG11: run_id, round, avg_match, max_r2, n_models, n_passed."""
    joined = hypotheses.select(F.col("id").alias("hypothesis_id"), "run_id", "round").join(models.select(F.col("id").alias("model_result_id"), "hypothesis_id", "match_score", "r_squared"), "hypothesis_id")
    joined = joined.join(validations.select("model_result_id", "overall_passed"), "model_result_id", "left")
    return joined.groupBy("run_id", "round").agg(F.avg("match_score").alias("avg_match"), F.max("r_squared").alias("max_r2"), F.count("*").alias("n_models"), F.count_if("overall_passed").alias("n_passed"))


def improvement(series: DataFrame, value: str = "avg_match") -> DataFrame:
    """WN9: each round's gain on the one before."""
    return series.withColumn("improvement", F.col(value) - F.lag(value).over(Window.partitionBy("run_id").orderBy("round")))


def top_variables(models: DataFrame, least: int = 1) -> DataFrame:
    """JN4, AG12, AG16: variable, n, avg_match, avg_r2 over the models that have it as significant."""
    long = models.select(F.explode("significant_variables").alias("variable"), "match_score", "r_squared")
    return long.groupBy("variable").agg(F.count("*").alias("n"), F.avg("match_score").alias("avg_match"), F.avg("r_squared").alias("avg_r2")).where(F.col("n") >= least)


def top_citations(citations: DataFrame) -> DataFrame:
    """AG13."""
    return citations.groupBy("title", "url", "source", "year").agg(F.count("*").alias("n"), F.avg("similarity_score").alias("avg_similarity"))


def runs_latest(runs: DataFrame, hypotheses: DataFrame, user: str, n: int = 50) -> DataFrame:
    """TK4, AG14: a tenant's newest runs with their number of hypotheses."""
    newest = owned(runs, user).orderBy(F.desc("created_at"), "id").limit(n)
    counts = hypotheses.groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("n_hypotheses"))
    return newest.join(counts, "id", "left").withColumn("n_hypotheses", F.coalesce("n_hypotheses", F.lit(0)))


def corpus_stats(papers: DataFrame, user: str) -> DataFrame:
    """AG15."""
    return owned(papers, user).agg(F.count("*").alias("n_papers"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))


def consistency(rows: DataFrame) -> DataFrame:
    """AG17: of (variable, output, coefficient, significant): share of outputs it is significant in, dominant sign, outputs."""
    signs = rows.groupBy("variable").agg(
        F.count("*").alias("tested"),
        F.count_if("significant").alias("sig"),
        F.count_if(F.col("significant") & (F.col("coefficient") > 0)).alias("pos"),
        F.count_if(F.col("significant") & (F.col("coefficient") < 0)).alias("neg"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("significant"), F.col("output")))), ",").alias("outputs"),
    )
    return signs.select("variable", "tested", F.round(F.col("sig") / F.col("tested"), 2).alias("consistency"), F.when(F.col("pos") > F.col("neg"), "positive").when(F.col("neg") > F.col("pos"), "negative").otherwise("mixed").alias("direction"), "outputs")


def significant_union(models: DataFrame, group: str) -> DataFrame:
    """AG21, DD8: variables that some model of a group finds significant, and those tested that none does."""
    sig = models.select(F.col(group).alias("group"), F.explode("significant_variables").alias("v")).distinct().groupBy("group").agg(F.array_sort(F.collect_list("v")).alias("significant"))
    every = models.select(F.col(group).alias("group"), F.explode(F.map_keys("coefficients")).alias("v")).distinct().groupBy("group").agg(F.array_sort(F.collect_list("v")).alias("tested"))
    out = every.join(sig, "group", "left").withColumn("significant", F.coalesce("significant", F.array().cast("array<string>")))
    return out.select("group", "significant", F.array_except("tested", "significant").alias("not_significant"))


def effects_top(models: DataFrame, n: int = 8, ident: str = "id") -> DataFrame:
    """TK11: each model's largest coefficients by size, and a bar's width for each."""
    long = models.select(F.col(ident).alias("id"), F.explode("coefficients").alias("variable", "coefficient")).where("variable <> 'const'")
    size = F.abs("coefficient")
    ranked = long.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(size), "variable"))).withColumn("top", F.max(size).over(Window.partitionBy("id")))
    return ranked.where(F.col("rank") <= n).select("id", "variable", "coefficient", "rank", F.greatest(F.lit(10), F.round(F.try_divide(size, F.col("top")) * 48)).cast("int").alias("width"))


def dashboard_top(models: DataFrame, n: int = 3) -> DataFrame:
    """TK10."""
    zero = F.lit(0.0)
    score = F.greatest(zero, F.coalesce("adj_r_squared", zero)) * (0.5 + F.greatest(zero, F.coalesce("match_score", zero)))
    return models.withColumn("dashboard_score", score).orderBy(F.desc("dashboard_score"), "id").limit(n)


def best_per_source(citations: DataFrame) -> DataFrame:
    """WN8."""
    over = Window.partitionBy("source").orderBy(F.desc("similarity_score"), "id")
    return citations.withColumn("_n", F.row_number().over(over)).where("_n = 1").drop("_n")


def json_safe(m: Column, fallback: float) -> Column:
    """SK9: a map without NaN, infinities and nulls."""
    return F.transform_values(m, lambda k, v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(fallback)).otherwise(v))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """SK5, SK6: new rows replace old ones of equal keys; of a replaced row the columns of keep (an id) stay."""
    rest = old.join(new.select(*keys).distinct(), keys, "left_anti")
    if keep:
        kept = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep]).dropDuplicates(keys)
        new = new.join(kept, keys, "left").withColumns({c: F.coalesce(f"_old_{c}", c) for c in keep}).drop(*[f"_old_{c}" for c in keep])
    return rest.unionByName(new.select(*old.columns))


def delete_run(tables: dict[str, DataFrame], run: str) -> dict[str, DataFrame]:
    """Cascade: tables without a run's rows, by anti joins down the keys."""
    gone_h = tables["hypotheses"].where(F.col("run_id") == run).select(F.col("id").alias("hypothesis_id"))
    gone_m = tables["model_results"].join(gone_h, "hypothesis_id", "left_semi").select(F.col("id").alias("model_result_id"))
    return tables | {
        "runs": tables["runs"].where(F.col("id") != run),
        "hypotheses": tables["hypotheses"].where(F.col("run_id") != run),
        "model_results": tables["model_results"].join(gone_h, "hypothesis_id", "left_anti"),
        "validation_results": tables["validation_results"].join(gone_m, "model_result_id", "left_anti"),
        "citations": tables["citations"].join(gone_m, "model_result_id", "left_anti"),
    }


def persist(df: DataFrame, path: str, run: str) -> None:
    """SK3, SK4: a run's rows as their partition, replaced as a whole."""
    df.withColumn("run_id", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def preview(df: DataFrame, row_id: str | None = None, n: int = 100) -> list[dict[str, str]]:
    """SK13: the first rows as display strings."""
    rows = (df.orderBy(row_id) if row_id else df).limit(n).collect()
    return [{k: "" if v is None or v != v else format(v, ".10g") if isinstance(v, float) else str(v) for k, v in r.asDict().items()} for r in rows]


def markdown_report(run: dict, models: list[dict], series: list[dict], citations: list[dict]) -> str:
    """SK10: a run's report from bounded frames, already collected."""
    table = lambda head, rows: "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join(str(c) for c in r) + " |" for r in rows]])
    bar = lambda v: "#" * max(0, min(20, round(20 * (v or 0))))
    return "\n\n".join(
        [
            f"# Run {run.get('run_name') or run.get('id')}",
            table(["field", "value"], [(k, v) for k, v in run.items() if v is not None]),
            "## Convergence\n\n" + table(["round", "match", "", "best R2", "models", "passed"], [(s["round"], f"{s['avg_match'] or 0:.3f}", bar(s["avg_match"]), f"{s['max_r2'] or 0:.3f}", s["n_models"], s["n_passed"]) for s in series]),
            "## Models\n\n" + table(["model", "R2", "adj. R2", "n", "significant"], [(m["id"], f"{m['r_squared'] or 0:.4f}", f"{m['adj_r_squared'] or 0:.4f}", m["n_observations"], ", ".join(m["significant_variables"] or [])) for m in models]),
            "## Citations\n\n" + table(["source", "title", "similarity"], [(c["source"], c["title"], f"{c['similarity_score'] or 0:.2f}") for c in citations]),
        ]
    )


def firsts(hypotheses: DataFrame, models: DataFrame, validations: DataFrame, citations: DataFrame, run: str) -> DataFrame:
    """JN6: of each hypothesis of a run its first model by id with that model's validation, and all citations of it; one row a hypothesis."""
    mine = hypotheses.where(F.col("run_id") == run)
    first = models.groupBy("hypothesis_id").agg(F.min("id").alias("model_id"), F.min_by("r_squared", "id").alias("r_squared"))
    passed = validations.groupBy("model_result_id").agg(F.bool_or("overall_passed").alias("validation_passed"))
    cited = citations.groupBy("model_result_id").agg(F.count("*").alias("n_citations"), F.max("similarity_score").alias("best_similarity"))
    out = mine.select(F.col("id").alias("hypothesis_id")).join(first, "hypothesis_id", "left")
    for part in (passed, cited):
        out = out.join(part, out["model_id"] == part["model_result_id"], "left").drop("model_result_id")
    return out.withColumn("n_citations", F.coalesce("n_citations", F.lit(0)))


def with_grounding(summaries: DataFrame, grounding: DataFrame, key: str = "hypothesis_id", order: str = "id") -> DataFrame:
    """JN10: summaries with the first grounding of their hypothesis (a map); an empty map where there is none."""
    first = grounding.groupBy(key).agg(F.min_by("grounding", order).alias("grounding"))
    return summaries.join(first, key, "left").withColumn("grounding", F.coalesce("grounding", F.create_map().cast("map<string,double>")))


def resolve(hypotheses: DataFrame, models: DataFrame) -> DataFrame:
    """JN11: id and hypothesis (null if there is none) of each model: the hypothesis of the id that it names, or else of that label."""
    by_id = hypotheses.select(F.col("id").cast("string").alias("_id"), F.col("id").alias("_by_id"))
    by_label = hypotheses.groupBy(F.col("label").alias("_label")).agg(F.min("id").alias("_by_label"))
    out = models.join(by_id, F.col("hypothesis") == F.col("_id"), "left").join(by_label, F.col("hypothesis") == F.col("_label"), "left")
    return out.select("id", F.coalesce("_by_id", "_by_label").alias("hypothesis_id"))


def match_means(findings: DataFrame) -> DataFrame:
    """AG23: of (round, hypothesis_id, match_score): each hypothesis's mean and, of these, its round's."""
    per = findings.groupBy("round", "hypothesis_id").agg(F.avg("match_score").alias("global_match"))
    return per.withColumn("round_match", F.avg("global_match").over(Window.partitionBy("round")))


def distinct_citations(citations: DataFrame, by: list[str], n: int) -> DataFrame:
    """TK9: of each group the n most similar citations, one a url."""
    one = citations.groupBy(*by, "url").agg(F.max("similarity_score").alias("similarity_score"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("similarity_score"), "url"))).where(F.col("rank") <= n)


def last_by_url(citations: DataFrame, by: list[str], order: str) -> DataFrame:
    """DD5: of each group's citations of one url, the last in order."""
    rest = [c for c in citations.columns if c not in (*by, "url")]
    return citations.groupBy(*by, "url").agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*by, "url", "_last.*")


def round_grounding(findings: DataFrame, citations: DataFrame, threshold: float = 0.75, top: int = 15) -> DataFrame:
    """VR12: round, global_match (mean of hypotheses' means), n_hypotheses, n_citations (different urls among the top ones), convergence_ready."""
    per = findings.groupBy("round", "hypothesis_id").agg(F.avg("match_score").alias("m")).groupBy("round").agg(F.avg("m").alias("m"), F.count("*").alias("n_hypotheses"))
    cited = distinct_citations(citations, ["round"], top).groupBy("round").agg(F.count("*").alias("n_citations"))
    return per.join(cited, "round", "left").select("round", F.round("m", 4).alias("global_match"), "n_hypotheses", F.coalesce("n_citations", F.lit(0)).alias("n_citations"), (F.col("m") >= threshold).alias("convergence_ready"))


def run_status(runs: DataFrame, hypotheses: DataFrame, models: DataFrame) -> DataFrame:
    """A row for each run: rounds seen, hypotheses, models, and pending, running or completed by how many hypotheses have a model."""
    h = hypotheses.select(F.col("id").alias("hypothesis_id"), "run_id", "round")
    m = models.groupBy("hypothesis_id").agg(F.count("*").alias("n"))
    per = h.join(m, "hypothesis_id", "left").groupBy("run_id").agg(F.count_distinct("round").alias("n_rounds"), F.count("*").alias("n_hypotheses"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_models"), F.count("n").alias("n_fitted"))
    out = runs.select("id").join(per, runs["id"] == per["run_id"], "left").drop("run_id").na.fill(0)
    state = F.when(F.col("n_fitted") == 0, "pending").when(F.col("n_fitted") < F.col("n_hypotheses"), "running").otherwise("completed")
    return out.withColumn("status", state)


def same_request(df: DataFrame, kind: str, regime: str | None, filename: str | None) -> DataFrame:
    """FL12: stored payloads of a kind, regime and file; null equals null."""
    return df.where((F.col("kind") == kind) & F.col("regime").eqNullSafe(F.lit(regime)) & F.col("filename").eqNullSafe(F.lit(filename)))


#: The phase of a run whose literature is complete.
GROUNDED = "grounding_completed"


def grounded_bundles(runs: DataFrame, hypotheses: DataFrame, models: DataFrame, validations: DataFrame, citations: DataFrame, user: str | None = None) -> DataFrame:
    """§2.17: the saved grounding of runs that are grounded, of one user if given: a row for each hypothesis with a model.

    run_id, id, round, description, rationale, primary_variables, model (its first by id, as a struct), validation_passed
    (false without a validation; its first by id) and citations (structs by id; empty without any). Hypotheses that bear the
    mark of the statistics phase are left out. Texts that are not clean give way to a fallback (description) or null
    (rationale). Models and validations are reduced to one a hypothesis before anything is joined.
    """
    done = runs.where(F.get_json_object("config_snapshot", "$.screening_phase") == GROUNDED)
    done = done if user is None else owned(done, user)
    mark = lambda s: F.coalesce(F.get_json_object(s, "$._stats_meta"), F.lit(""))
    marked = F.exists("rag_support", lambda s: ~mark(s).isin("", "null", "false", "0", "{}", "[]"))
    mine = hypotheses.where(~F.coalesce(marked, F.lit(False))).join(done.select(F.col("id").alias("run_id")), "run_id", "left_semi")
    first = models.groupBy(F.col("hypothesis_id").alias("_h")).agg(F.min_by(F.struct(*models.columns), "id").alias("model"))
    judged = validations.groupBy(F.col("model_result_id").alias("_m")).agg(F.min_by("overall_passed", "id").alias("validation_passed"))
    kept = [c for c in ("id", "source", "title", "url", "year", "similarity_score", "abstract_snippet", "variable") if c in citations.columns]
    cited = citations.groupBy(F.col("model_result_id").alias("_c")).agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("citations"))
    out = mine.join(first, F.col("id") == F.col("_h")).join(judged, F.col("model.id") == F.col("_m"), "left").join(cited, F.col("model.id") == F.col("_c"), "left")
    said = lambda c: tx.strip_label(tx.strip_thinking(F.trim(F.coalesce(c, F.lit("")))))
    # columns of their own, so that what a text says is worked out once
    out = out.withColumns({"_d": said(F.col("description")), "_r": said(F.col("rationale"))})
    out = out.withColumns({"_dm": tx.sentence_marks(F.col("_d")), "_rm": tx.sentence_marks(F.col("_r"))})
    sentence = F.when(tx.is_clean_sentence(F.col("_d"), marks=F.col("_dm")), F.col("_d"))
    reason = F.when(tx.is_clean_sentence(F.col("_r"), marks=F.col("_rm")), F.col("_r"))  # clean paragraphs are among these
    names = F.slice(F.coalesce("primary_variables", F.array().cast("array<string>")), 1, 3)
    plain = F.concat(F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("Selected predictors"), F.lit(" are associated with the screened outcome in this regime."))
    return out.select(
        "run_id",
        "id",
        "round",
        F.coalesce(sentence, plain).alias("description"),
        reason.alias("rationale"),
        "primary_variables",
        "model",
        F.coalesce("validation_passed", F.lit(False)).alias("validation_passed"),
        F.coalesce("citations", F.array().cast(cited.schema["citations"].dataType)).alias("citations"),
    )


def key_coalesce(m: Column, key: Column) -> Column:
    """The value of a string-keyed map under a key as it is, or else as a whole number is written; null without."""
    text = key.cast("string")
    return F.coalesce(F.try_element_at(m, text), F.try_element_at(m, text.try_cast("bigint").cast("string")))


def finding_text(variable: Column, outcome: Column, coefficient: Column) -> Column:
    """What a coefficient says in words."""
    verb = F.when(coefficient > 0, "increases").otherwise("decreases")
    return F.format_string("%s %s %s (coefficient=%s)", variable, verb, outcome, tx.fixed(coefficient, 4))


def overall(passed: Column, run: Column) -> Column:
    """DG26: all tests but one, and one at least."""
    return passed >= F.greatest(F.lit(1), run - 1)


def best_of_round(models: DataFrame, validations: DataFrame) -> DataFrame:
    """MD19: of each hypothesis its best model (by R2 among those that passed, or else that succeeded) and whether it passed."""
    v = validations.select(F.col("model_result_id").alias("_m"), "overall_passed")
    joined = models.where("success").join(v, F.col("id") == F.col("_m"), "left").withColumn("passed", F.coalesce("overall_passed", F.lit(False)))
    ranked = joined.withColumn("_n", F.row_number().over(Window.partitionBy("hypothesis_id").orderBy(F.desc("passed"), F.desc("r_squared"), "id")))
    return ranked.where("_n = 1").select("hypothesis_id", F.col("id").alias("model_id"), "r_squared", "passed")


def round_summary(hypotheses: DataFrame, models: DataFrame, validations: DataFrame) -> DataFrame:
    """MD19: run_id, round, n_hypotheses, n_passed, n_failed, best_r_squared (0 without a model), pass_rate."""
    best = best_of_round(models, validations)
    h = hypotheses.select(F.col("id").alias("hypothesis_id"), "run_id", "round").join(best, "hypothesis_id", "left")
    passed = F.count_if(F.coalesce("passed", F.lit(False)))
    return h.groupBy("run_id", "round").agg(F.count("*").alias("n_hypotheses"), passed.alias("n_passed"), (F.count("*") - passed).alias("n_failed"), F.coalesce(F.max("r_squared"), F.lit(0.0)).alias("best_r_squared"), (passed / F.count("*")).alias("pass_rate"))


def top_third(importance: DataFrame, by: str = "model") -> DataFrame:
    """TK12: of (model, variable, importance) the first third of a model's variables, one at least; the first half of these, one at least, are highly so."""
    n = F.count("*").over(Window.partitionBy(by))
    k = F.greatest(F.lit(1), F.floor(n / 3))
    ranked = importance.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("importance"), "variable"))).withColumn("_k", k)
    return ranked.where(F.col("rank") <= F.col("_k")).withColumn("highly", F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("_k") / 2))).drop("_k")


def segmentation(rows: DataFrame, regime: str, row_id: str, columns: list[str], batch: str) -> dict[str, DataFrame]:
    """SK8: rows under their regimes as five tables: batch, regimes, rows, column statistics, regression specifications."""
    code = F.col(f"`{regime}`").cast("string")
    ident = F.concat(F.lit(f"{batch}:"), code)
    kinds = dict(rows.dtypes)
    numeric = [c for c in columns if kinds[c] in ("int", "bigint", "float", "double", "smallint", "tinyint") or kinds[c].startswith("decimal")]
    stats = [F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("dtype"), F.count_distinct(F.col(f"`{c}`")).cast("int").alias("n_distinct")).alias(f"c{i}") for i, c in enumerate(columns)]
    per = rows.groupBy(ident.alias("segmented_regime_id"), code.alias("regime_code")).agg(F.count("*").cast("int").alias("n_rows"), *stats)
    long = per.select("segmented_regime_id", F.explode(F.array(*[F.col(f"c{i}") for i in range(len(columns))])).alias("c")).select("segmented_regime_id", "c.*")
    strings = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    return {
        "experiment_segmentation_batches": rows.agg(F.lit(batch).alias("id"), F.lit(regime).alias("segmentation_method"), F.count("*").alias("n_rows")),
        "experiment_segmented_regimes": per.select(F.col("segmented_regime_id").alias("id"), F.lit(batch).alias("batch_id"), "regime_code", "n_rows"),
        "experiment_regime_rows": rows.select(ident.alias("segmented_regime_id"), F.col(row_id).cast("long").alias("source_row_index")),
        "experiment_regime_column_stats": long.withColumn("is_constant_in_regime", F.col("n_distinct") <= 1),
        "experiment_regime_regression_specs": per.select("segmented_regime_id", strings(columns).alias("candidate_inputs"), strings([c for c in columns if c not in numeric]).alias("categorical_inputs"), strings(numeric).alias("numeric_inputs")),
    }
