"""The query catalogue: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from . import clean_queries as cq
from . import match_geo_queries as mg
from . import ml_queries as ml
from . import model_queries as mq
from . import stream_queries as sq
from . import window_queries as wq

QUERIES = {
    "lookback_daily": wq.lookback_daily,
    "completeness_class": wq.completeness_class,
    "lag_pivot": wq.lag_pivot,
    "lag_features_join": wq.lag_features_join,
    "donor_assign": wq.donor_assign,
    "donor_copy": wq.donor_copy,
    "donor_fill": wq.donor_fill,
    "repair_union": wq.repair_union,
    "typed_csv_scan": cq.typed_csv_scan,
    "file_name_keys": cq.file_name_keys,
    "batch_union": cq.batch_union,
    "reject_split": cq.reject_split,
    "header_synonyms": cq.header_synonyms,
    "columns_by_regex": cq.columns_by_regex,
    "optional_filter": cq.optional_filter,
    "name_filters": cq.name_filters,
    "sentinel_filter": cq.sentinel_filter,
    "dropna_cast": cq.dropna_cast,
    "null_aware_flag": cq.null_aware_flag,
    "scalar_clean": cq.scalar_clean,
    "duration_minutes": cq.duration_minutes,
    "outer_join_clean_key": cq.outer_join_clean_key,
    "crosswalk_join": cq.crosswalk_join,
    "left_enrich": cq.left_enrich,
    "join_integrity": cq.join_integrity,
    "sibling_impute": cq.sibling_impute_q,
    "fuzzy_best_match": mg.fuzzy_best_match_q,
    "geo_nearest_donor": mg.geo_nearest_donor,
    "point_in_polygon": mg.point_in_polygon_q,
    "region_total": mg.region_total,
    "hash_split": mq.hash_split_q,
    "kfold_assign": mq.kfold_assign,
    "one_hot": mq.one_hot_q,
    "unseen_share": mq.unseen_share,
    "zscore": mq.zscore,
    "simple_ols": mq.simple_ols,
    "residuals": mq.residuals_q,
    "regression_metrics": mq.regression_metrics_q,
    "leaderboard": mq.leaderboard,
    "worst_decile": mq.worst_decile,
    "worst_row": mq.worst_row,
    "value_shares": mq.value_shares_q,
    "share_lift": mq.share_lift_q,
    "median_contrast": mq.median_contrast_q,
    "histogram": mq.histogram_q,
    "category_count": mq.category_count,
    "null_profile": mq.null_profile_q,
    "knn_predict": ml.knn_predict,
    "knn_wide_predict": ml.knn_wide_predict,
    "knn_wide_cv": ml.knn_wide_cv,
    "linear_wide_cv": ml.linear_wide_cv,
    "forest_contrast": ml.forest_contrast,
    "fitted_leaderboard": ml.fitted_leaderboard,
    "knn_cv": ml.knn_cv,
    "multiple_ols": ml.multiple_ols,
    "ridge_cv": ml.ridge_cv,
    "lasso_cv": ml.lasso_cv,
    "elastic_net_cv": ml.elastic_net_cv,
    "forest_search": ml.forest_search,
    "forest_predict": ml.forest_predict,
    "gbt_baseline": ml.gbt_baseline,
    "gbt_search": ml.gbt_search,
    "learning_curve": ml.learning_curve,
    "feature_importance": ml.feature_importance,
    "permutation_importance": ml.permutation_importance,
    "trial_best": ml.trial_best,
    "stream_clean_enrich": sq.stream_clean_enrich,
    "stream_daily_rollup": sq.stream_daily_rollup,
}
