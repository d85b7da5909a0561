"""End-to-end predictors: tree heads, heteroskedastic linear heads, regimes."""

from pyspark.sql import functions as F

from barsight.functions.scalars import gaussian_projection
from barsight.operators import hmm as H, linear as LN, regimes as RG, sizing as Z
from barsight.operators.emissions import emission_table, sequences, session_summary
from barsight.operators.labels import join_labels, realized_returns_inner
from barsight.operators.news import news_columns, news_features, regime_news_features, top_entities
from barsight.operators.rich import RICH_COLUMNS, rich_features
from barsight.operators.sampling import kfold, repeated_kfold
from barsight.operators.trees import TreeHeads, cross_validated_heads, shift_check
from barsight.session import cut_lineage


def feature_tables(train, test, use_news=False):
    """Rich (and news) features of both sides, train with labels; written once."""

    def build(part):
        out = rich_features(part["seen"])
        if use_news:
            news = news_features(part["seen"], part["events"], part["headlines"])
            out = out.join(news, "session", "left").fillna(0.0)
        return out

    labels = realized_returns_inner(train["seen"], train["unseen"])
    columns = RICH_COLUMNS + (news_columns() if use_news else [])
    return cut_lineage(join_labels(build(train), labels)), cut_lineage(build(test)), columns


def finish(oof, target, rows=None, config=None, modes=Z.ALL_MODES):
    """Tune the sizing on out-of-fold predictions (or take a frozen one) and rank the target."""
    if config is None:
        by_fold = "fold" in oof.columns
        if by_fold:
            tuned = Z.tune_sizing_by_fold(oof, Z.sizing_grid(modes, (0.0, 1.0)), rows)
        else:
            tuned = Z.tune_sizing(oof, Z.sizing_grid(modes), rows)
        config = Z.config_from_row(Z.best_sizing(tuned, by_fold).first())
    return Z.ranking(target, Z.apply_sizing(target, config, rows)), config


def tailored(train, test, use_news=False, k=5, seeds=(0, 1), config=None, rows=None, check_shift=False, **tree_options):
    """Rich features -> repeated out-of-fold tree heads -> sizing -> refit -> ranking."""
    labelled, target, columns = feature_tables(train, test, use_news)
    folds = cut_lineage(repeated_kfold(labelled, k, seeds))
    oof, rounds = cross_validated_heads(labelled, columns, folds, rows=rows, **tree_options)
    oof = cut_lineage(oof.join(labelled.select("session", "R"), "session"))
    heads = TreeHeads(columns, rows=rows, **tree_options).fit(labelled, rounds)
    preds = cut_lineage(heads.predict(target))
    ranking, used = finish(oof, preds, rows, config)
    out = {"ranking": ranking, "oof": oof, "config": used, "importance": heads.importance(labelled.sparkSession)}
    if check_shift:
        both = labelled.select("session").unionByName(target.select("session"))
        out["shift"] = shift_check(labelled, target, columns, kfold(both, k))
    return out


def probabilistic(train, test, use_news=True, k=5, seed=0, config=None, rows=None):
    """Rich and news features -> heteroskedastic linear heads -> Gaussian contract -> sizing."""
    labelled, target, columns = feature_tables(train, test, use_news)
    rows_in = cut_lineage(labelled.join(kfold(labelled, k, seed), "session"))
    oof, heads = LN.heteroskedastic_oof(rows_in, columns, rows=rows)
    oof = cut_lineage(oof)
    contract = gaussian_projection(oof).join(oof.select("session", "R", "fold"), "session")
    floor = LN.variance_floor(labelled, heads, rows=rows)
    preds = gaussian_projection(LN.predict_heads(target, heads, floor))
    ranking, used = finish(cut_lineage(contract), cut_lineage(preds), rows, config, Z.BASIC_MODES)
    return {"ranking": ranking, "oof": contract, "config": used}


def regime(train, test, method="m1", k_states=3, folds=5, n_clusters=2, use_news=False, config=None, rows=None,
           min_size=100, **fit):
    """State models over bars: pooled (m1), linear heads on posteriors (m1-linear), clustered (m2)."""
    if use_news and method != "m1-linear":
        raise ValueError("news features need the m1-linear method")
    full = train["seen"].unionByName(train["unseen"])
    emissions = cut_lineage(emission_table(full))
    seqs = cut_lineage(sequences(emissions))
    test_emissions = cut_lineage(emission_table(test["seen"]))
    test_seqs = cut_lineage(sequences(test_emissions))
    labels = cut_lineage(realized_returns_inner(train["seen"], train["unseen"]))
    own = cut_lineage(kfold(labels, folds))
    with_r = lambda p: p.join(labels.select("session", "R"), "session")
    if method == "m1":
        oof, (model,) = RG.candidate_fits(seqs, own, [(k_states, "diag")], **fit)
        oof = with_r(oof.drop("candidate"))
        preds = H.forecast_sessions(test_seqs, model)
    elif method == "m2":
        oof = with_r(RG.oof_mixture_forecasts(seqs, emissions, own, n_clusters, k=k_states, min_size=min_size, **fit))
        models, _, _ = RG.cluster_models(seqs, emissions, n_clusters, k_states, min_size=min_size, **fit)
        preds = H.mixture_forecast(test_seqs, models)
    elif method == "m1-linear":
        model = H.fit_models(seqs, [H.Job(k_states)], **fit)[0]
        seen = emissions.where("bar_ix <= 49")

        def stack(seqs_in, emissions_in, part, names):
            out = H.posterior_features(seqs_in, model, 50).join(session_summary(emissions_in), "session")
            if use_news:
                out = out.join(regime_news_features(part["seen"], part["events"], names), "session", "left").fillna(0.0)
            return cut_lineage(out)

        names = [r[0] for r in top_entities(train["events"]).collect()] if use_news else []
        x = stack(seqs, seen, train, names)
        columns = [c for c in x.columns if c != "session"]
        x = cut_lineage(with_r(x).join(own, "session"))
        oof = LN.linear_heads_oof(x, columns, rows=rows)
        preds = LN.linear_heads_fit_predict(x, stack(test_seqs, test_emissions, test, names), columns, rows=rows)
    else:
        raise ValueError(f"unknown regime method: {method}")
    ranking, used = finish(cut_lineage(oof), cut_lineage(preds), rows, config, Z.BASIC_MODES)
    return {"ranking": ranking, "oof": oof, "config": used}
